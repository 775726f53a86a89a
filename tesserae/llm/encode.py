"""Encoding of the whole corpus with a public tokenizer.

Method: a streaming transducer with bounded lookahead. A text is read in windows and cut into pre-tokens; a
pre-token is final once ``AHEAD`` characters behind it are known. Each pre-token goes through an incremental
automaton built from the merge list: at each byte it finds the last token of the encoding of the bytes so far, from
the vocabulary's tokens that end there and a test of the pair with the token before, and it emits a token once
every place from which a later token can reach back (no further than the longest token of the merge list) agrees
on it. So a pre-token may be of any length, runs of blanks too, and memory doesn't grow with the text. What short
pre-tokens give is remembered. Decoding is an incremental byte-to-text machine.

Defined results: empty and null texts have the ids ``[]``; strings of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import codecs
import os
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Folder of the tokenizer files; a parameter, also by the environment variable TESSERAE_TOKENIZERS.
FOLDER = os.environ.get("TESSERAE_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the pre-token pattern of the byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters read at a time, and characters of a pre-token from which it is passed on in parts.
WINDOW = PIECE = 1 << 16
#: Characters that must be known behind a pre-token: an apostrophe's longest ending, and one more.
AHEAD = 4
#: Pre-tokens and pairs remembered at most; only speed depends on them.
REMEMBERED = 300_000

_PRE_TOKEN = regex.compile(PATTERN)
_REST_OF = [(regex.compile(c), regex.compile(f"{c}*")) for c in (r"\p{L}", r"\p{N}", r"[^\s\p{L}\p{N}]")]
_BLANKS = regex.compile(r"\s*")


class Automaton:
    """The merge list as a machine that reads bytes and emits ids."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks, self.longest = ranks, max(map(len, ranks))
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.known: dict[str, list[int]] = {}
        self.ends = ahocorasick.Automaton()
        for t in ranks:
            self.ends.add_word(t.decode("latin-1"), t)
        self.ends.make_automaton()

    def merged(self, data: bytes) -> list[bytes]:
        """Byte-pair encoding of a few bytes as the merge list defines it: the lowest rank first."""
        get, never = self.ranks.get, len(self.ranks)
        parts = [data[i:i + 1] for i in range(len(data))]
        rank = [get(data[i:i + 2], never) for i in range(len(data) - 1)]
        while rank:
            low = min(rank)
            if low == never:
                break
            i = rank.index(low)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del rank[i]
            if i:
                rank[i - 1] = get(parts[i - 1] + parts[i], never)
            if i < len(rank):
                rank[i] = get(parts[i] + parts[i + 1], never)
        return parts

    def fits(self, a: bytes, b: bytes) -> bool:
        """Whether ``a`` followed by ``b`` stays these two tokens."""
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) > REMEMBERED:
                self.pairs.clear()
            got = self.pairs[a, b] = self.merged(a + b) == [a, b]
        return got

    def run(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """Ids of one pre-token whose bytes come in chunks."""
        ranks, fits, longest = self.ranks, self.fits, self.longest
        data, base, done = b"", 0, 0  # data holds the bytes from position base on
        last: dict[int, bytes] = {0: b""}  # position -> last token of the encoding of the bytes before it
        at = 0
        for chunk in chunks:
            for i in range(0, len(chunk), 1024):
                data += chunk[i:i + 1024]
                start = max(at - longest - base, 0)
                for end, t in self.ends.iter(data.decode("latin-1"), start):
                    end += base + 1
                    if end > at and end not in last:
                        begin = end - len(t)
                        before = last.get(begin) if begin >= done else None
                        if before is not None and (not before or fits(before, t)):
                            last[end] = t
                at = base + len(data)
                ids, done = self._stable(last, done, at)
                yield from ids
                data, base = data[done - base:], done
        yield from self._path(last, done, at)

    def _path(self, last: dict[int, bytes], done: int, p: int) -> list[int]:
        path = []
        while p > done:
            path.append(self.ranks[last[p]])
            p -= len(last[p])
        return path[::-1]

    def _stable(self, last: dict[int, bytes], done: int, at: int) -> tuple[list[int], int]:
        """Tokens all places that later tokens can start from agree on, from ``done`` on; forgets what lies before their end."""
        live = {p for p in range(max(done, at - self.longest), at + 1) if p in last}
        while len(live) > 1:
            p = max(live)
            if p <= done:
                break
            live.discard(p)
            live.add(p - len(last[p]))
        stop = max(min(live), done)
        ids = self._path(last, done, stop)
        if stop > done:
            for q in [q for q in last if q < stop]:
                del last[q]
            last[stop] = last[stop]
        return ids, stop

    def piece(self, piece: str) -> list[int]:
        """Ids of one short pre-token."""
        ids = self.known.get(piece)
        if ids is None:
            raw = piece.encode("utf-8", "replace")
            # what lies within the reach of one token can't become stable before its end
            ids = [self.ranks[t] for t in self.merged(raw)] if len(raw) <= self.longest else list(self.run((raw,)))
            if len(self.known) > REMEMBERED:
                self.known.clear()
            self.known[piece] = ids
        return ids

    def pieces(self, pieces: list[str]) -> list[int]:
        """Ids of short pre-tokens that follow each other."""
        get, out = self.known.get, []
        for p in pieces:
            out += get(p) or self.piece(p)
        return out

    def encode(self, windows: Iterable[str]) -> Iterator[int]:
        """Ids of a text that comes in windows."""
        windows, held = iter(windows), ""
        w = next(windows, "")
        while w:
            held += w
            w = next(windows, "")
            if not w:
                break
            sure, at, final = len(held) - AHEAD, 0, []
            for m in _PRE_TOKEN.finditer(held):
                if m.end() > sure:
                    break
                final.append(m[0])
                at = m.end()
            yield from self.pieces(final)
            held = held[at:]
            if len(held) > PIECE:
                held = yield from self._long(held, chain((w,), windows))
                w = next(windows, "")
        if len(held) > PIECE and (m := _PRE_TOKEN.match(held)).end() > PIECE:
            held = yield from self._long(held, windows)
        yield from self.pieces(_PRE_TOKEN.findall(held))

    def _long(self, held: str, windows: Iterator[str]) -> Iterator[int]:
        """Feed the first, long pre-token of ``held`` to the automaton until it ends; returns the text behind it."""
        rest = ""

        def parts():
            nonlocal rest
            m = _PRE_TOKEN.match(held)
            if m[0][-1].isspace():  # the last blank of a run belongs to what follows
                kept = held[m.end() - 1:]
                yield held[:m.end() - 1].encode()
                if not kept.isspace():
                    rest = kept
                    return
                for w in windows:
                    n = _BLANKS.match(w).end()
                    text = kept + w[:n]
                    if n < len(w):
                        yield text[:-1].encode()
                        rest = text[-1] + w[n:]
                        return
                    yield text[:-1].encode()
                    kept = text[-1]
                yield kept.encode()
                return
            more = next(rx for one, rx in _REST_OF if one.match(m[0][-1]))
            yield m[0].encode()
            rest = held[m.end():]
            while not rest and (w := next(windows, None)) is not None:
                n = more.match(w).end()
                yield w[:n].encode()
                rest = w[n:]

        yield from self.run(parts())
        return rest


@cache
def encoding(name: str = "byte_bpe_50k", folder: str = FOLDER) -> Automaton:
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return Automaton({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def encode(text: str | None, enc: Automaton) -> list[int]:
    if not text:
        return []
    return list(enc.encode(text[i:i + WINDOW] for i in range(0, len(text), WINDOW)))


def decode(ids: Iterable[int], enc: Automaton) -> Iterator[str]:
    """Text of ids as it becomes certain; the pieces add up to the text."""
    if not hasattr(enc, "tokens"):
        enc.tokens = {i: t for t, i in enc.ranks.items()}
    machine = codecs.getincrementaldecoder("utf-8")("replace")
    for i in ids:
        out = machine.decode(enc.tokens[i])
        if out:
            yield out
    out = machine.decode(b"", True)
    if out:
        yield out


def token_ids(documents: DataFrame, name: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """(doc_id, ids) of every row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(name, folder)
        for b in batches:
            ids = [encode(t, enc) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def p7_ids(spark, sf_dir: str) -> DataFrame:
    return token_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"))
