"""Sampling by the numeric prefix of project and file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNKS = 1000


def bounds(percent: float, start: float = 0.0) -> tuple[int, int]:
    """Chunks [low, high) of ``percent`` percent from ``start`` percent on."""
    if not (0 <= start <= 100 and 0 <= percent <= 100 and start + percent <= 100):
        raise ValueError(f"no fraction: {percent} percent from {start}")
    return int(start * CHUNKS * 0.01), int((start + percent) * CHUNKS * 0.01)


def prefix(percent: float, start: float = 0.0) -> str:
    """Name of a fraction: ``50_`` or, with a start, ``50_12.5_``."""
    show = lambda x: f"{x:.1f}" if x % 1 else f"{int(x)}"
    return f"{show(percent)}_" + (f"{show(start)}_" if start else "")


def chunk_of(name: Column) -> Column:
    """The number before the first ``_``; null for hidden names, which belong to no fraction."""
    return F.try_to_number(F.regexp_extract(name, r"^(\d+)_", 1), F.lit("999999")).cast("int")


def in_fraction(df: DataFrame, chunk: Column, percent: float, start: float = 0.0) -> DataFrame:
    low, high = bounds(percent, start)
    return df.where((chunk >= low) & (chunk < high))


def files_in_fraction(df: DataFrame, chunk: Column, percent: float, start: float = 0.0) -> DataFrame:
    low, high = bounds(percent, start)
    return df.agg(F.count_if((chunk >= low) & (chunk < high)).alias("files"))
