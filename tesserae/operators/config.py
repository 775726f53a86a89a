"""Configurations: rendering codes, nested settings, names of artifacts. All of it is small and driver-side."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce
from pathlib import PurePosixPath

from tesserae.functions.code import Rendering

#: The digits of a code and what they mean.
DIGITS = {
    "enonly": ["multilang", "en_only", "en_only+en_only_content", "asci_only"],
    "comstr": ["strings+comments", "NO_strings+comments", "NO_strings+NO_comments", "strings+NO_comments"],
    "split": [
        "NO_splitting", "camel+underscore", "camel+underscore+numbers", "camel+underscore+numbers+heuristic", "camel+underscore+bpe_5k", "camel+underscore+bpe_1k", "camel+underscore+bpe_10k", "camel+underscore+bpe_20k",
        "camel+underscore+bpe_0", "camel+underscore+bpe_custom",
    ],
    "tabsnewlines": ["tabs+newlines", "NO_tabs+NO_newlines"],
    "marklogs": ["NO_log_marks", "log_marks"],
    "caps": ["case_preserved", "lowercased"],
}
#: Merges by the split digit; 9 needs its own list.
MERGES = {4: 5000, 5: 1000, 6: 10000, 7: 20000, 8: 0}


@dataclass(frozen=True)
class Code:
    """A valid six-digit rendering code."""

    enonly: int
    comstr: int
    split: int
    tabsnewlines: int
    marklogs: int
    caps: int

    def __post_init__(self):
        for name, values in DIGITS.items():
            if getattr(self, name) not in range(len(values)):
                raise ValueError(f"{name} can't be {getattr(self, name)}")
        if self.split == 0 and (self.enonly or self.caps):
            raise ValueError("finding foreign words and lower-casing need words to be split (split >= 1)")
        if self.enonly == 2 and self.comstr == 2:
            raise ValueError("foreign content stands only in strings and comments, which comstr=2 hides")

    @classmethod
    def parse(cls, code: str) -> Code:
        if len(code) != len(DIGITS) or not code.isdigit():
            raise ValueError(f"a code has {len(DIGITS)} digits, not {code!r}")
        return cls(*map(int, code))

    def __str__(self) -> str:
        return "".join(str(getattr(self, k)) for k in DIGITS)

    def describe(self) -> dict[str, str]:
        return {k: v[getattr(self, k)] for k, v in DIGITS.items()}

    def for_classification(self) -> Code:
        if not self.marklogs:
            raise ValueError(f"{self} can't be used for classification: it marks no logging statements")
        return self

    def merge_base(self) -> Code:
        """The code of the text from which merges are learnt: words split, strings and comments kept, layout and marks dropped."""
        return Code(1, 0, 1, 1, 0, self.caps)

    def rendering(self, split_word=None, nested_content: bool = False) -> Rendering:
        if self.split == 9 and split_word is None:
            raise ValueError("split digit 9 needs its own merges")
        return Rendering(self.enonly, self.comstr, self.split, bool(self.tabsnewlines), bool(self.marklogs), bool(self.caps), split_word if self.split >= 3 else None, nested_content)


@dataclass(frozen=True)
class SplitConfig:
    """How subwords are made: ``none``, ``numbers``, ``dictionary`` (word -> pieces) or ``bpe`` (pair -> rank), with a cache that is asked first."""

    kind: str = "none"
    merges: dict | None = None
    cache: dict | None = None
    dictionary: dict | None = None

    def pieces(self, word: str) -> list[str]:
        from tesserae.functions.code import merge_word

        if self.kind == "dictionary":
            return list((self.dictionary or {}).get(word, [word]))
        if self.kind == "bpe":
            return list(self.cache[word]) if self.cache and word in self.cache else merge_word(word, self.merges or {})
        return [word]

    @staticmethod
    def digits(number: str) -> list[str]:
        return list(number)


def flatten(config: dict, path: str = "") -> dict[str, object]:
    out: dict[str, object] = {}
    for k, v in config.items():
        at = f"{path}.{k}" if path else k
        out |= flatten(v, at) if isinstance(v, dict) else {at: v}
    return out


def diff(a: dict, b: dict) -> dict[str, tuple]:
    """Dotted path -> (value in a, value in b) where they differ; a missing value is None."""
    x, y = flatten(a), flatten(b)
    return {k: (x.get(k), y.get(k)) for k in sorted(x.keys() | y.keys()) if x.get(k) != y.get(k)}


def nearest(config: dict, known: dict[str, dict]) -> tuple[str, dict[str, tuple]]:
    """The known configuration with the fewest differences; ties by name."""
    if not known:
        raise ValueError("no configuration is known")
    name = min(known, key=lambda n: (len(diff(known[n], config)), n))
    return name, diff(known[name], config)


def derived_name(base: str, changes: dict[str, tuple]) -> str:
    return base + "".join(f"_{k.rpartition('.')[2]}_{v[1]}" for k, v in changes.items())


def patched(config: dict, changes: dict[str, object]) -> dict:
    """A copy with dotted paths set; a path that isn't there is an error."""
    out = json.loads(json.dumps(config))
    for path, value in changes.items():
        *way, last = path.split(".")
        at = reduce(lambda d, k: d[k] if isinstance(d, dict) and k in d else _missing(path), way, out)
        if not isinstance(at, dict) or last not in at:
            _missing(path)
        at[last] = value
    return out


def _missing(path: str):
    raise AttributeError(f"no setting {path}")


def load(text: str, union: dict | None = None) -> dict:
    """Settings from JSON, laid over the defaults in ``union``."""
    return {**(union or {}), **json.loads(text)}


def dump(config: dict) -> str:
    return json.dumps(config, indent=4, sort_keys=True)


@dataclass(frozen=True)
class Layout:
    """Where the artifacts of a dataset are kept."""

    root: str
    dataset: str

    def _at(self, *parts: str) -> str:
        scheme, sep, path = self.root.rpartition("://")
        return f"{scheme}{sep}{PurePosixPath(path, self.dataset, *parts)}"

    def raw(self) -> str:
        return self._at("raw")

    def parsed(self) -> str:
        return self._at("parsed")

    def rendered(self, code: Code) -> str:
        return self._at("repr", str(code))

    def metadata(self, code: Code, what: str) -> str:
        return self._at("metadata", str(code), what)

    def merges(self, code: Code, n: int) -> str:
        return self._at("metadata", str(code.merge_base()), f"merges_{n}")

    def cases(self, code: Code, kind: str) -> str:
        return self._at("classification", kind, str(code.for_classification()))

    def model(self, code: Code, percent: str, name: str) -> str:
        return self._at("models", str(code), f"{percent}{name}")


