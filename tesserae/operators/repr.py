"""Parsing and rendering of whole corpora: the state machines of ``functions.code`` in Arrow batches, one file a row."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions import code

from .config import Code, SplitConfig

_TOKEN = pa.struct([
    ("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("parts", pa.list_(pa.string())), ("ctx", pa.string()), ("ctx_id", pa.int32()), ("log_id", pa.int32()), ("log_role", pa.string()), ("level", pa.string()),
    ("block_id", pa.int32()), ("non_eng", pa.bool_()),
])
TOKENS = "array<struct<pos:int,kind:string,text:string,parts:array<string>,ctx:string,ctx_id:int,log_id:int,log_role:string,level:string,block_id:int,non_eng:boolean>>"


#: Values (tokens, or rows of ``per_file``) of a batch that leaves the interpreter; a batch ends with the file that exceeds it. Only speed and memory depend on it.
BATCH_VALUES = 50_000


def _batches(column: pa.Array, values: Callable[[str | None], tuple[object, int]]) -> Iterator[tuple[int, list]]:
    """(first row, values of it and the following rows) of a column of texts, each part of about ``BATCH_VALUES``: what is held at once doesn't grow with the rows of an Arrow batch."""
    first, out, size = 0, [], 0
    for i in range(len(column)):
        value, n = values(column[i].as_py())
        out.append(value)
        size += n
        if size >= BATCH_VALUES:
            yield first, out
            first, out, size = i + 1, [], 0
    if out:
        yield first, out


def _per_text(df: DataFrame, key: list[str], make, spark_type: str, arrow_type, name: str) -> DataFrame:
    """(key..., name): ``make`` of each text, null for null."""
    n = len(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()

        def value(text):
            v = None if text is None else f(text)
            return v, 1 + len(v or ())

        for b in batches:
            for first, out in _batches(b.column(n), value):
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(first, len(out)) for i in range(n)), pa.array(out, arrow_type)], [*key, name])

    types = dict(df.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in key), f"{name} {spark_type}"])
    return df.select(*key, "text").mapInArrow(run, schema)


#: Spark's types of the columns ``per_file`` makes, in Arrow.
_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32()), "array<boolean>": pa.list_(pa.bool_())}


def per_file(df: DataFrame, key: list[str], rows_of: Callable[[list[code.Token]], list[tuple]], columns: dict[str, str], non_english: frozenset[str] = frozenset()) -> DataFrame:
    """(key..., columns...): the rows that ``rows_of`` makes of the tokens of each file, where it is read, so that no token leaves its task; no row for null."""
    n = len(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def value(text):
            rows = [] if text is None else rows_of(code.parse(text, non_english))
            return rows, sum(len(v) if isinstance(v, list) else 1 for r in rows for v in r)

        for b in batches:
            for first, out in _batches(b.column(n), value):
                at = pa.array([first + i for i, rows in enumerate(out) for _ in rows], pa.int64())
                rows = [r for each in out for r in each]
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(n)), *(pa.array([r[i] for r in rows], _ARROW[t]) for i, t in enumerate(columns.values()))], [*key, *columns])

    types = dict(df.dtypes)
    return df.select(*key, "text").mapInArrow(run, ", ".join([*(f"`{k}` {types[k]}" for k in key), *(f"{c} {t}" for c, t in columns.items())]))


def runs(tokens: list[code.Token], *by: str) -> list[tuple]:
    """(values of ``by``..., tokens) of a file's tokens for which the last of ``by``, an id, isn't 0."""
    out: dict[tuple, int] = {}
    for t in tokens:
        if getattr(t, by[-1]):
            k = tuple(getattr(t, x) for x in by)
            out[k] = out.get(k, 0) + 1
    return [(*k, n) for k, n in out.items()]


def parsed(df: DataFrame, key: list[str], non_english: frozenset[str] = frozenset()) -> DataFrame:
    """(key..., tokens): the annotated tokens of each file. ``non_english`` is a dictionary; it is sent with the plan."""
    def make():
        def f(text):
            return [
                {"pos": i, "kind": t.kind, "text": t.text, "parts": [p if isinstance(p, str) else p[0] for p in t.parts], "ctx": t.ctx, "ctx_id": t.ctx_id, "log_id": t.log_id, "log_role": t.log_role, "level": t.level,
                 "block_id": t.block_id, "non_eng": code.is_foreign(t)}
                for i, t in enumerate(code.parse(text, non_english))
            ]
        return f

    return _per_text(df, key, make, TOKENS, pa.list_(_TOKEN), "tokens")


def rendered(df: DataFrame, key: list[str], digits: str, split: SplitConfig | None = None, non_english: frozenset[str] = frozenset()) -> DataFrame:
    """(key..., tokens): the token strings of each file under a six-digit code."""
    valid = Code.parse(digits)
    valid.rendering(split.pieces if split else None)

    def make():
        # words repeat: each task splits a word once
        r = valid.rendering(lru_cache(maxsize=1 << 17)(split.pieces) if split else None)
        return lambda text: code.render(code.parse(text, non_english), r)

    return _per_text(df, key, make, "array<string>", pa.list_(pa.string()), "tokens")


def rendered_vocabulary(df: DataFrame, digits: str, split: SplitConfig | None = None, non_english: frozenset[str] = frozenset()) -> DataFrame:
    """(token, freq) of the rendered texts: each task counts what it renders and sends its counts whenever it holds ``BATCH_VALUES`` of them."""
    valid = Code.parse(digits)
    valid.rendering(split.pieces if split else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = valid.rendering(lru_cache(maxsize=1 << 17)(split.pieces) if split else None)
        counts: Counter = Counter()
        made = lambda: pa.RecordBatch.from_arrays([pa.array([*counts], pa.string()), pa.array([*counts.values()], pa.int64())], ["token", "freq"])
        for b in batches:
            for text in b.column(0):
                if text.is_valid:
                    counts.update(code.render(code.parse(text.as_py(), non_english), r))
                    if len(counts) >= BATCH_VALUES:
                        yield made()
                        counts.clear()
        yield made()

    return df.select("text").mapInArrow(run, "token string, freq bigint").groupBy("token").agg(F.sum("freq").alias("freq"))


def rendered_as(df: DataFrame, key: list[str], codes: list[str], non_english: frozenset[str] = frozenset()) -> DataFrame:
    """(key..., one array c<code> a code): each text is parsed once and rendered under every code; null for null."""
    valid = [Code.parse(c) for c in codes]
    n = len(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ways = [v.rendering(None) for v in valid]

        def value(text):
            tokens = None if text is None else code.parse(text, non_english)
            shown = [None if tokens is None else code.render(tokens, way) for way in ways]
            return shown, 1 + sum(len(x or ()) for x in shown)

        for b in batches:
            for first, out in _batches(b.column(n), value):
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(first, len(out)) for i in range(n)), *(pa.array([r[i] for r in out], pa.list_(pa.string())) for i in range(len(ways)))], [*key, *(f"c{c}" for c in codes)])

    types = dict(df.dtypes)
    return df.select(*key, "text").mapInArrow(run, ", ".join([*(f"`{k}` {types[k]}" for k in key), *(f"c{c} array<string>" for c in codes)]))


def readable(df: DataFrame, key: list[str]) -> DataFrame:
    """(key..., shown): rendered lines as people read them."""
    return _per_text(df, key, lambda: code.beautify, "string", pa.string(), "shown")


def preprocess(text: str, digits: str, split: SplitConfig | None = None, non_english: frozenset[str] = frozenset()) -> list[str]:
    """One string, without Spark."""
    return code.render(code.parse(text, non_english), Code.parse(digits).rendering(split.pieces if split else None))
