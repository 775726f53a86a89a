"""Filling fixed-capacity containers with items.

Method: hierarchical residual packing. Every partition packs its own items best-fit, largest first, and
emits the bins that are nearly full; the residue, the items of underfull bins, goes on to fewer partitions,
where it is packed again, until one small partition is left or a level closes few bins more (then no
other items would fill them). A level's rows are the residue of the level before, so the data shrinks
fast and no task ever sees all items.

Defined results: a text of more tokens than the capacity is cut into pieces of the capacity and a
rest; all others stay whole. Null and empty texts have 0 tokens and are placed as well. Ties are broken by id.
The container is named by its first piece (``doc_id:part``).
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.plans.staging import stage

from . import encode

CAPACITY = 2048
#: Share of the capacity from which a bin is closed before the last level.
NEARLY_FULL = 0.985
#: Underfull bins a partition of the next level gets; one partition is the last level.
FAN_IN = 20_000
#: Share of underfull bins that must be left for another level not to be tried.
STALLED = 0.9
#: Bins a task holds open at a time; beyond it the fullest are handed on.
OPEN_BINS = 200_000

_BIN = "size bigint, docs array<bigint>, parts array<int>, sizes array<int>"
_TYPES = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()))


def best_fit(items: list[tuple], capacity: int) -> list[list]:
    """Bins [size, docs, parts, sizes] of items of that form, largest first into the fullest bin they fit."""
    bins: list[list] = []
    free: list[tuple[int, int]] = []  # (room, bin), sorted
    for size, docs, parts, sizes in sorted(items, key=lambda x: (-x[0], x[1][:1], x[2][:1])):
        i = bisect_left(free, (size, -1))
        if i < len(free):
            room, k = free.pop(i)
            b = bins[k]
            b[0] += size
            b[1] += docs
            b[2] += parts
            b[3] += sizes
        else:
            room, k = capacity, len(bins)
            bins.append([size, [*docs], [*parts], [*sizes]])
        insort(free, (room - size, k))
    return bins


def _batch(bins: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b[i] for b in bins], t) for i, t in enumerate(_TYPES)], ["size", "docs", "parts", "sizes"])


def _first(name: str, folder: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encode.encoding(name, folder)
        items = []
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n, part = len(encode.encode(text, enc)), 0
                while n > capacity:
                    items.append((capacity, [doc], [part], [capacity]))
                    n, part = n - capacity, part + 1
                items.append((n, [doc], [part], [n]))
            if len(items) > OPEN_BINS:
                yield _batch(best_fit(items, capacity))
                items = []
        yield _batch(best_fit(items, capacity))

    return run


def _again(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = []
        for b in batches:
            items += zip(*(b.column(i).to_pylist() for i in range(4)))
            if len(items) > OPEN_BINS:
                yield _batch(best_fit(items, capacity))
                items = []
        yield _batch(best_fit(items, capacity))

    return run


def pack(documents: DataFrame, capacity: int = CAPACITY, name: str = "byte_bpe_50k", folder: str = encode.FOLDER) -> DataFrame:
    """(container, doc_id, part, tokens) for every piece of every document (doc_id, text)."""
    level = stage(documents.select("doc_id", "text").mapInArrow(_first(name, folder, capacity), _BIN), "bins")
    closed, full = [], NEARLY_FULL * capacity
    last = None
    while True:
        n = level.where(F.col("size") < full).count()
        if not n or last is not None and n > STALLED * last:
            closed.append(level)
            break
        last = n
        closed.append(level.where(F.col("size") >= full))
        parts = -(-n // FAN_IN)
        piece = level.where(F.col("size") < full).select(F.inline(F.arrays_zip("docs", "parts", "sizes")))
        residue = piece.select(F.col("sizes").cast("bigint").alias("size"), F.array("docs").alias("docs"), F.array("parts").alias("parts"), F.array("sizes").alias("sizes"))
        spread = residue.repartition(parts, F.xxhash64("docs", "parts")) if parts > 1 else residue.coalesce(1)
        level = stage(spread.mapInArrow(_again(capacity), _BIN), "bins")
        if parts == 1:
            closed.append(level)
            break
    out = closed[0]
    for df in closed[1:]:
        out = out.unionByName(df)
    out = out.where(F.size("docs") > 0)
    name_of = F.concat_ws(":", F.element_at("docs", 1).cast("string"), F.element_at("parts", 1).cast("string"))
    pieces = out.select(name_of.alias("container"), F.inline(F.arrays_zip("docs", "parts", "sizes")))
    return pieces.select("container", F.col("docs").alias("doc_id"), F.col("parts").alias("part"), F.col("sizes").alias("tokens"))


def p8_containers(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def p8_fill(spark, sf_dir: str) -> DataFrame:
    """Containers, pieces, tokens and the unused share."""
    each = p8_containers(spark, sf_dir).groupBy("container").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("tokens"))
    total = each.agg(F.count("*").alias("containers"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"))
    return total.withColumn("unused", F.round(1 - F.col("tokens") / (F.col("containers") * CAPACITY), 6))
