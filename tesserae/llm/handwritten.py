"""Generated, minified, vendored and data files among source files.

Method: character trigram models of identifiers, trained per language on all files of the
corpus, give the cross-entropy of a file's names; squeezed files have mangled
names, whatever the length of their lines: unlike those of other files and mostly of one or two letters (or hexadecimal). Files written by tools repeat a template: the entropy of the parts of their names is
far below the usual one, or, where they have few names, their line shapes (names, literals and numbers blanked) repeat. Foreign naming shows vendored files: a package, path or
provenance comment that belongs to a library of the vendor list. Data as code is told by the share
of literals among the code's characters.

Precedence, as a file has one kind: vendored, blob, minified, generated. Defined results: null and
empty texts and null file names are no case; repeated rows count once; texts are read whole;
a file delivered with several texts has the kind that comes first in the order above.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import or_
from statistics import median
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.plans.staging import stage

#: Bits of a trigram that the model lacks.
UNSEEN = 12.0
#: Entropy of name parts from which a file counts as made from a template: so many (robust) standard deviations below the median file.
TEMPLATE_DEVIATIONS = 4.0
#: Mean bits a character from which a file's names count as mangled: so many standard deviations above the mean file.
MANGLED_DEVIATIONS = 3.0
#: Share of short or hexadecimal names from which they count as mangled where lines aren't squeezed, and least names to tell.
MANGLED_SHARE, LEAST_NAMES = 0.5, 20
#: Shapes of lines of a template at most.
TEMPLATE_SHAPES = 6
#: Shape pairs per code line up to which a file counts as made from a template.
TEMPLATE_PAIRS = 0.45
#: The same in a folder for generated sources, where short files occur.
TEMPLATE_PAIRS_IN_FOLDER = 0.85
#: Share of the code's characters that are data literals from which a file is a blob.
BLOB_SHARE = 0.5

#: The kinds in order of precedence.
KINDS = ("vendored", "blob", "minified", "generated")

_CODE = {"java", "js", "py"}
_NAME = re.compile(r"[^\W\d_][\w$]*")
# Words of the languages that are no names.
_WORDS = set(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for if implements import instanceof int interface long native new package "
    "private protected public return short static super switch synchronized this throw throws transient try void volatile while true false null var let function typeof delete in of def elif except from global "
    "is lambda not or and pass raise with yield None True False print async await export use strict require module exports console length prototype undefined".split()
)
# A name, or what names aren't looked for in: a number, a comment, a string.
_NAME_OR_OTHER = re.compile(r"([^\W\d_][\w$]*)|(?<![\w$])\d[\w.]*|/\*(?s:.*?)\*/|//[^\n]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'")
_NAME_OR_OTHER_PY = re.compile(r"([^\W\d_][\w$]*)|(?<![\w$])\d[\w.]*|\"\"\"(?s:.*?)\"\"\"|'''(?s:.*?)'''|#[^\n]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'")
# How tools sign what they write.
_MARK = re.compile(
    r"@generated\b|\bgenerated\s+by\b|\bgenerated\s+from\b[^\n]*\bby\b|auto-?generated\b|automatically\s+(?:generated|produced)|(?:produced|generated|created)\s+automatically|machine-(?:made|generated)"
    r"|\bdo\s+not\s+(?:edit|modify)\b|do\s+not\s+touch:\s*output|(?:changes?|edits?)\s+(?:\w+\s+){0,4}(?:lost|overwritten|gone)\b|\bcreated\s+by\b[^\n]*\bschema\b",
    re.I,
)
_ANNOTATION = re.compile(r"^[ \t]*@(?:[a-z]+\.)*Generated(?:\(|\s*$)", re.M)
_FOLDER = re.compile(r"(?:^|/)(?:gen|generated|generated-sources|generated-src|src-gen|autogen)/")
_LITERAL = re.compile(r"(?<![\w.])[-+]?(?:0x[0-9a-fA-F]+|\d[\d_]*(?:\.\d+)?(?:[eE][-+]?\d+)?)[lLfFdD]?\b[\s,;]*|(?:\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\[0-7]{3}){8,}|[A-Za-z0-9+/=_-]{40,}")
_BLANK_STRING, _BLANK_NUMBER, _BLANK_NAME, _BLANK_ROW = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"), re.compile(r"(?<![\w])-?(?:0x\w+|\d[\w.]*)"), re.compile(r"[^\W\d][\w$]*"), re.compile(r"(?:-?0, ?){2,}")
_PACKAGE = re.compile(r"^\s*package\s+([\w.]+)", re.M)


def names_of(text: str, ext: str) -> list[str]:
    return [n for n in (_NAME_OR_OTHER_PY if ext == "py" else _NAME_OR_OTHER).findall(text) if n and n not in _WORDS]


_HEX = re.compile(r"x?(?=[a-f]*\d)[0-9a-f]{4,}")


def mangled_share(names: list[str]) -> float:
    return sum(len(w) <= 2 or w[0] in "xabcdef" and _HEX.fullmatch(w) is not None for w in names) / len(names) if names else 0.0


_PARTS_OF_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[^\W\dA-Za-z_]+|\d+")


def diversity(names: list[str]) -> float:
    """Entropy of the parts of the names, 1 if no part occurs twice."""
    parts = Counter(_PARTS_OF_NAME.findall(" ".join(names)))
    n = sum(parts.values())
    return 1 - sum(c * math.log2(c) for c in parts.values()) / (n * math.log2(n)) if n > 1 else 1.0


def _bits(grams: Counter) -> dict[str, float]:
    heads: Counter = Counter()
    for g, c in grams.items():
        heads[g[:2]] += c
    return {g: -math.log2((c + 0.1) / (heads[g[:2]] + 4)) for g, c in grams.items()}


def _counts(files: list[list[str]]) -> dict[str, float]:
    grams: Counter = Counter()
    for n in files:
        for w in n:
            w = f"^^{w.lower()}$"
            for i in range(len(w) - 2):
                grams[w[i:i + 3]] += 1
    return _bits(grams)


def _limits(mean: float, dev: float, usual: float, apart: float) -> tuple[float, float]:
    """(bits from which names count as mangled, least diversity of names)."""
    return mean + MANGLED_DEVIATIONS * max(dev, 0.05), usual - TEMPLATE_DEVIATIONS * max(1.4826 * apart, 0.02)


def _is_plain(text: str, n: int, share: float) -> bool:
    """Whether a file's ``n`` names, such a ``share`` of them mangled, belong to the model: lines aren't squeezed, names not mangled."""
    return n >= LEAST_NAMES and share < MANGLED_SHARE and max(map(len, text.split("\n"))) < 300


def train(rows: list[tuple[str, str]]) -> dict[str, tuple[dict[str, float], float, float, float]]:
    """Extension -> (bits of each trigram given its first two characters, bits of an unseen one, threshold, least diversity of names), of files in memory.

    The threshold is that of files the model wasn't made of: each half is measured by the other."""
    models = {}
    for ext in _CODE:
        files = [n for e, t in rows if e == ext and _is_plain(t, len(n := names_of(t, ext)), mangled_share(n))]
        halves = (files[::2], files[1::2]) if len(files) > 1 else (files, files)
        each = [entropy(n, other, UNSEEN) for own, rest in (halves, halves[::-1]) for other in (_counts(rest),) for n in own] or [0.0]
        mean = sum(each) / len(each)
        spread = [diversity(n) for n in files] or [1.0]
        usual = median(spread)  # there are generated files too: they must not move the limit
        models[ext] = (_counts(files), UNSEEN, *_limits(mean, math.sqrt(sum((x - mean) ** 2 for x in each) / len(each)), usual, median(abs(x - usual) for x in spread)))
    return models


def _medians(values: DataFrame) -> dict[str, float]:
    """Extension -> exact median of (ext, x); the numbers are sorted on disk where they don't fit in memory."""
    size = {r.ext: r.n for r in values.groupBy("ext").agg(F.count("*").alias("n")).collect()}
    if not size:
        return {}
    ranks = values.withColumn("i", F.row_number().over(Window.partitionBy("ext").orderBy("x")))
    middle = [(F.col("ext") == e) & F.col("i").isin((n + 1) // 2, n // 2 + 1) for e, n in size.items()]
    found: dict[str, list[float]] = {}
    for r in ranks.where(reduce(or_, middle)).collect():
        found.setdefault(r.ext, []).append(r.x)
    return {e: sum(x) / len(x) for e, x in found.items()}


# The signs that names hold in lower case, and the two that mark their ends, numbered; the number behind them stands for all others.
_SIGNS = "abcdefghijklmnopqrstuvwxyz0123456789_$^"
_BASE = len(_SIGNS) + 1
_NUMBER_OF = np.array([_SIGNS.find(chr(i)) % _BASE for i in range(128)])
#: Characters of names that are looked at together; only memory depends on it.
PIECE = 1_000_000


def _trigrams(names: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place of each trigram in it, its number, place of each file's first one) of files' names, joined by blanks.

    A number is of no use where a sign has none of its own (``_odd``)."""
    marked = ["^^" + n.lower().replace(" ", "$^^") + "$" for n in names]
    text = "".join(marked)
    sign = _NUMBER_OF[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 127)]
    at = np.flatnonzero(sign[2:] != _SIGNS.index("^"))  # no name holds the mark, so the others lie across two names
    begins = np.cumsum([0, *map(len, marked[:-1])])
    return text, at, (sign[at] * _BASE + sign[at + 1]) * _BASE + sign[at + 2], np.searchsorted(at, begins)


def _odd(text: str, number: np.ndarray) -> np.ndarray:
    """The trigrams with a sign that has no number of its own."""
    if text.isascii():
        return np.empty(0, int)
    last = _BASE - 1
    return np.flatnonzero((number % _BASE == last) | (number // _BASE % _BASE == last) | (number // _BASE**2 == last))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[str]]]:
    """((ext, half), files' names) of batches (ext, half, names), some files of one model at a time."""
    for b in batches:
        held: dict[tuple, list[str]] = {}
        size: Counter = Counter()
        for ext, half, names in zip(*(b.column(i) for i in range(3))):
            key, names = (ext.as_py(), half.as_py()), names.as_py()
            held.setdefault(key, []).append(names)
            size[key] += len(names)
            if size[key] > PIECE:
                yield key, held.pop(key)
                del size[key]
        yield from held.items()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the trigrams (ext, half, gram, n)."""
    seen: dict[tuple, np.ndarray] = {}
    others: Counter = Counter()
    for key, names in _pieces(batches):
        text, at, number, _ = _trigrams(names)
        odd = _odd(text, number)
        n = np.bincount(np.delete(number, odd), minlength=_BASE**3)
        seen[key] = seen[key] + n if key in seen else n
        others.update((*key, text[i:i + 3]) for i in at[odd].tolist())
        if len(others) > 200_000:
            yield _batch([(*g, k) for g, k in others.items()], _GRAMS)
            others.clear()
    rows = [(*g, k) for g, k in others.items()]
    for key, n in seen.items():
        rows += [(*key, _SIGNS[i // _BASE**2] + _SIGNS[i // _BASE % _BASE] + _SIGNS[i % _BASE], int(n[i])) for i in np.flatnonzero(n).tolist()]
    yield _batch(rows, _GRAMS)


def _numbered(bits: dict[str, float]) -> tuple[np.ndarray, dict[str, float]]:
    """A model by the trigrams' numbers, and its trigrams that have none."""
    table, others = np.full(_BASE**3, UNSEEN), {}
    for g, b in bits.items():
        if all(c in _SIGNS for c in g):
            table[(_SIGNS.index(g[0]) * _BASE + _SIGNS.index(g[1])) * _BASE + _SIGNS.index(g[2])] = b
        else:
            others[g] = b
    return table, others


def _entropies(names: list[str], model: tuple[np.ndarray, dict[str, float]]) -> np.ndarray:
    """``entropy`` of each file."""
    text, at, number, first = _trigrams(names)
    bits = model[0][number]
    odd = _odd(text, number)
    bits[odd] = [model[1].get(text[i:i + 3], UNSEEN) for i in at[odd].tolist()]
    return np.add.reduceat(bits, first) / np.diff(first, append=len(at))


def _read(source: DataFrame, vendors) -> DataFrame:
    """What the files of (project, file, text) show before there are models, and the names that these are made of: written once, as the only reading of the texts.

    The half of a file is drawn by a hash of its path."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for project, file, half, text in zip(*(b.column(i) for i in range(4))):
                file = file.as_py()
                s = shown(file, text.as_py(), vendors)
                if s.kind or s.marked or s.suspect or s.x is not None:
                    rows.append((project.as_py(), file, s.ext, half.as_py(), s.plain, s.kind, s.marked, s.suspect, " ".join(s.names) if s.plain or s.suspect else None, s.x))
                if len(rows) == 1000:
                    yield _batch(rows, _SHOWN)
                    rows = []
            yield _batch(rows, _SHOWN)

    half = F.pmod(F.xxhash64("project", "file"), F.lit(2)).cast("int")
    schema = "project string, file string, ext string, half int, plain boolean, kind string, marked boolean, suspect boolean, names string, x double"
    return stage(source.select("project", "file", half.alias("half"), "text").mapInArrow(read, schema), "shown")


def _trained(files: DataFrame) -> dict[str, tuple[dict[str, float], float, float, float]]:
    """``train`` on all files read. Trigrams are counted and files measured where the names are read, so that the driver gets
    the models (distinct trigrams) and a few numbers only."""
    plain = files.where("plain")
    names = plain.select("ext", "half", "names")
    counts: dict[str, tuple[Counter, Counter]] = {e: (Counter(), Counter()) for e in _CODE}
    for r in names.mapInArrow(_counted, "ext string, half int, gram string, n bigint").groupBy("ext", "half", "gram").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.ext][r.half][r.gram] = r.n
    # a half without files is measured by the other's own model
    halves = {(e, i): _numbered(_bits(c[1 - i] or c[i])) for e, c in counts.items() for i in range(2)}
    shared = files.sparkSession.sparkContext.broadcast(halves)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, names in _pieces(batches):
            bits = _entropies(names, shared.value[key])
            yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(bits), pa.string()), pa.array(bits)], ["ext", "bits"])

    each = names.mapInArrow(measured, "ext string, bits double")
    spread = {r.ext: (r.mean, r.dev) for r in each.groupBy("ext").agg(F.avg("bits").alias("mean"), F.stddev_pop("bits").alias("dev")).collect()}
    usual = _medians(plain.select("ext", "x"))
    at = F.coalesce(*(F.when(F.col("ext") == e, F.lit(v)) for e, v in usual.items()), F.lit(1.0))
    apart = _medians(plain.select("ext", F.abs(F.col("x") - at).alias("x")))
    return {e: (_bits(counts[e][0] + counts[e][1]), UNSEEN, *_limits(*spread.get(e, (0.0, 0.0)), usual.get(e, 1.0), apart.get(e, 0.0))) for e in _CODE}


def train_on(source: DataFrame) -> dict[str, tuple[dict[str, float], float, float, float]]:
    """``train`` on all files of (project, file, text)."""
    return _trained(_read(source, ((), ())))


_SHOWN = {
    "project": pa.string(), "file": pa.string(), "ext": pa.string(), "half": pa.int32(), "plain": pa.bool_(), "kind": pa.string(), "marked": pa.bool_(), "suspect": pa.bool_(), "names": pa.string(), "x": pa.float64(),
}
_GRAMS = {"ext": pa.string(), "half": pa.int32(), "gram": pa.string(), "n": pa.int64()}


def _batch(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types.values())], [*types])


def entropy(names: list[str], bits: dict[str, float], unseen: float) -> float:
    total = n = 0
    for w, k in Counter(names).items():
        w = f"^^{w.lower()}$"
        total += k * sum(bits.get(w[i:i + 3], unseen) for i in range(len(w) - 2))
        n += k * (len(w) - 2)
    return total / n if n else 0.0


def shape_pairs(code_lines: list[str]) -> tuple[float, int, int]:
    """(distinct pairs of following shapes per line, distinct shapes, lines) of lines without comments; ends where there are more shapes than a template has."""
    shapes, distinct = [], set()
    for line in code_lines:
        s = line.replace("[]", "").strip()
        if s in ("", "}", "{", "};", ")", "]", "})") or s[0] == "@" or s.startswith(("import ", "package ", "from ")):
            continue
        shapes.append(_BLANK_ROW.sub("0, ", _BLANK_NUMBER.sub("0", _BLANK_NAME.sub("a", _BLANK_STRING.sub("s", s)))))
        distinct.add(shapes[-1])
        if len(distinct) > TEMPLATE_SHAPES:
            break
    n = len(shapes)
    return (len(set(zip(shapes, shapes[1:]))) / (n - 1) if n > 1 else 1.0), len(distinct), n


_HEAD = re.compile(r"\s*(?:/\*(?s:.*?)\*/|//[^\n]*|#[^\n]*|<!--(?s:.*?)-->)")


def _last_comment(text: str, at: int) -> str:
    """The comment that ends the text, if one does behind ``at``."""
    text = text.rstrip()
    for end, begin in (("*/", "/*"), ("-->", "<!--")):
        if text.endswith(end):
            i = text.rfind(begin)
            return text[i:] if i >= at else ""
    line = text[max(at, text.rfind("\n") + 1):]
    m = re.search(r"//[^\n]*|#[^\n]*", line)
    return m[0] if m else ""


def edge_comments(text: str) -> str:
    """The comments before the first and after the last code (and those right behind a package line)."""
    at, out = 0, []
    text = text.lstrip("﻿")
    while m := _HEAD.match(text, at):
        out.append(m[0])
        at = m.end()
    if m := re.compile(r"\s*package\s[^\n]*\n").match(text, at):
        at = m.end()
        while m := _HEAD.match(text, at):
            out.append(m[0])
            at = m.end()
    if at < len(text) and (last := _last_comment(text, at)):
        out.append(last)
    return "\n".join(out)


_NO_CODE_PY, _NO_CODE = re.compile(r"\"\"\"(?s:.*?)\"\"\"|#[^\n]*"), re.compile(r"/(?:\*(?s:.*?)\*/|(?<![:\"']/)/[^\n]*)")


class Shown(NamedTuple):
    """What a file shows before there are models."""

    ext: str
    #: The kind, whatever its names are.
    kind: str | None = None
    #: Whether it counts as generated unless its names are mangled.
    marked: bool = False
    #: Whether it is minified if its names are unlike those of other files.
    suspect: bool = False
    #: Whether its names belong to the model.
    plain: bool = False
    names: list[str] | None = None
    #: Diversity of the names, if they are enough to tell.
    x: float | None = None


def _is_vendored(file: str, ext: str, text: str, edges: str, vendors) -> bool:
    names, packages = vendors
    if packages and (ext == "java" and (m := _PACKAGE.search(text)) and any(f".{p}." in f".{m[1]}." for p in packages)):
        return True
    if names and any(n in edges for n in names):
        for n in names:
            if re.search(rf"(?:taken from|copied from|part of|belongs to|bundled from|vendored from|copyright[^\n]*?|^[\s/*#!<-]*){re.escape(n)}(?![\w-])", edges, re.I | re.M):
                return True
    base = file.rpartition("/")[2]
    return bool(names) and any(re.match(rf"{re.escape(n)}(?:[-.]v?\d[\w.-]*)?\.(?:min\.)?\w+$", base) or f"/{n}/" in f"/{file}" for n in names if n in file)


def shown(file: str, text: str, vendors) -> Shown:
    """``vendors``: (name, url root, package) of each library."""
    ext = file.rpartition(".")[2].lower()
    edges = edge_comments(text)
    vendored = "vendored" if _is_vendored(file, ext, text, edges, vendors) else None
    if ext not in _CODE:
        return Shown(ext, vendored or ("generated" if _MARK.search(edges) else None))
    names = names_of(text, ext)
    enough, share = len(names) >= LEAST_NAMES, mangled_share(names)
    s = Shown(ext, vendored, plain=_is_plain(text, len(names), share), names=names, x=diversity(names) if enough else None)
    if vendored:
        return s
    code = text
    if ext == "py":
        if "#" in text or '"""' in text:
            code = _NO_CODE_PY.sub("", text)
    elif "/*" in text or "//" in text:
        code = _NO_CODE.sub("", text)
    words = code.split()
    size = sum(map(len, words)) or 1
    lines = code.split("\n")
    marked = bool(_MARK.search(edges) or ext == "java" and "Generated" in text and _ANNOTATION.search(text))
    if not marked and (max(map(len, words), default=0) >= 40 or sum(map(code.count, "0123456789")) > 0.15 * size or code.count("\\x") + code.count("\\u") >= 8):
        data = len("".join("".join(_LITERAL.findall(code)).split()))
        named = len(_NAME.findall(re.sub(r"\"[^\"\n]*\"|'[^'\n]*'|0x\w+", "", code)))
        if data / size >= BLOB_SHARE and data > 8 * named:
            return s._replace(kind="blob")
    squeezed = ext == "js" and max(map(len, lines)) > 200 and size / max(1, sum(1 for x in lines if x.strip())) > 120
    if squeezed and ".min." in file:
        return s._replace(kind="minified")
    if not marked:
        pairs, shapes, n = shape_pairs(lines)
        marked = n >= 6 and shapes <= TEMPLATE_SHAPES and pairs <= TEMPLATE_PAIRS or n >= 3 and shapes <= TEMPLATE_SHAPES and pairs <= TEMPLATE_PAIRS_IN_FOLDER and bool(_FOLDER.search(file))
    return s._replace(marked=marked, suspect=squeezed or enough and share >= MANGLED_SHARE)


def _told(s: Shown, models) -> str | None:
    if s.kind:
        return s.kind
    if s.suspect:
        bits, unseen, limit, _ = models[s.ext]
        if entropy(s.names, bits, unseen) > limit:
            return "minified"
    return "generated" if s.marked or s.x is not None and s.x < models[s.ext][3] else None


def kind_of(file: str, text: str, models, vendors) -> str | None:
    """The kind of one file, None for hand-written ones. ``vendors``: (name, url root, package) of each library."""
    return _told(shown(file, text, vendors), models)


def classify(corpus: DataFrame, vendors: DataFrame) -> DataFrame:
    """One row (project, file, kind) for each file of ``corpus`` (project, file, text) that nobody wrote by hand.

    ``vendors`` (name, url, package) is collected: it is a short hand-kept list. All files are read once, where they are
    stored; the models are trained on all of them and judge what was read. Only the flagged ones are shuffled, to drop repeats."""
    texts = corpus.select("project", "file", "text").where("file is not null and text is not null and text <> ''")
    rows = vendors.select("name", "package").distinct().collect()
    files = _read(texts, (sorted({r.name for r in rows if r.name}), sorted({r.package for r in rows if r.package})))
    models = _trained(files)
    shared = corpus.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for b in batches:
            out = []
            for project, file, ext, kind, marked, suspect, names, x in zip(*(b.column(i).to_pylist() for i in range(8))):
                if kind := _told(Shown(ext, kind, marked, suspect, names=(names or "").split(), x=x), models):
                    out.append((project, file, kind))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(3)], ["project", "file", "kind"])

    low = reduce(or_, ((F.col("ext") == e) & (F.col("x") < m[3]) for e, m in models.items()))
    flagged = files.where(F.col("kind").isNotNull() | F.col("marked") | F.col("suspect") | low)
    found = flagged.select("project", "file", "ext", "kind", "marked", "suspect", F.when(F.col("suspect"), F.col("names")), "x").mapInArrow(run, "project string, file string, kind string")
    first = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    return found.groupBy("project", "file").agg(F.min_by("kind", first).alias("kind"))


def p3_found(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/raw_corpus.parquet"), spark.read.parquet(f"{sf_dir}/vendor_list.parquet"))


def p3_handwritten(spark, sf_dir: str) -> DataFrame:
    """The files (project, file) of the corpus that remain as hand-written."""
    corpus = spark.read.parquet(f"{sf_dir}/raw_corpus.parquet")
    flagged = classify(corpus, spark.read.parquet(f"{sf_dir}/vendor_list.parquet"))
    return corpus.where("file is not null and text is not null and text <> ''").select("project", "file").distinct().join(flagged, ["project", "file"], "left_anti")
