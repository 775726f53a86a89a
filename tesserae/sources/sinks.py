"""Sinks. A Spark job's commit is atomic, so there are no part files to rename."""

from __future__ import annotations

import time
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions import text
from tesserae.operators import fractions


def write(df: DataFrame, path: str, rewrite: bool = False, partition: list[str] | None = None) -> None:
    """Parquet, skipped if it exists, unless ``rewrite``."""
    w = df.write.mode("overwrite" if rewrite else "ignore")
    (w.partitionBy(*partition) if partition else w).parquet(path)


def write_rendered(df: DataFrame, path: str, rewrite: bool = False) -> None:
    """Rendered files (split, tokens), one escaped line each, by split."""
    line = F.regexp_replace(text.escape_line(F.col("tokens")), r"\n$", "")
    df.select("split", line.alias("value")).write.mode("overwrite" if rewrite else "ignore").partitionBy("split").text(path)


def write_pairs(df: DataFrame, path: str, key: str, value: str) -> None:
    """Two columns divided by a tab; lists are joined by spaces."""
    v = F.array_join(value, " ") if dict(df.dtypes)[value].startswith("array") else F.col(value).cast("string")
    df.select(F.concat_ws("\t", F.col(key).cast("string"), v).alias("value")).write.mode("overwrite").text(path)


def write_matrix(df: DataFrame, path: str, row: str, column: str, value: str) -> None:
    """A pivoted matrix as CSV with a header."""
    df.groupBy(row).pivot(column).agg(F.first(value)).write.mode("overwrite").csv(path, header=True)


def write_jdbc(df: DataFrame, table: str, url: str, **properties: str) -> None:
    df.write.jdbc(url, table, mode="append", properties=properties)


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of the same key."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def purged(old: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return old.join(keys.select(*key), key, "left_anti")


def write_by_file(df: DataFrame, path: str, file: str = "file") -> None:
    """One folder a file (entropies, outcomes)."""
    df.write.mode("overwrite").partitionBy(file).parquet(path)


def write_splits(df: DataFrame, path: str) -> None:
    """Outcomes of the splitter, by outcome."""
    df.select("outcome", F.concat_ws("|", "token", F.array_join("parts", " ")).alias("value")).write.mode("overwrite").partitionBy("outcome").text(path)


def archived(spark: SparkSession, path: str, at: int | None = None) -> str | None:
    """Move a folder out of the way, under its name and the time in seconds; None if there is none."""
    old = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(old):
        return None
    new = f"{path.rstrip('/')}_{int(time.time()) if at is None else at}"
    if not fs.rename(old, spark._jvm.org.apache.hadoop.fs.Path(new)):
        raise OSError(f"{path} can't be moved")
    return new


def write_byte_pairs(merges: DataFrame, encoded: DataFrame, vocab: DataFrame, root: str, reset: bool = False) -> str:
    """Merges, the words' subwords and the resulting vocabulary in a folder named by the number of merges, which is the path given
    back. Existing ones are kept, or archived if ``reset``."""
    path = f"{root.rstrip('/')}/{merges.count()}"
    if reset:
        archived(merges.sparkSession, path)
    for name, df in (("merges", merges), ("cache", encoded), ("vocab", vocab)):
        write(df, f"{path}/{name}")
    return path


def write_vocabulary(vocab: DataFrame, root: str, percent: float = 100, start: float = 0, rewrite: bool = False) -> str:
    """The frequencies of a fraction's tokens under the fraction's name."""
    path = f"{root.rstrip('/')}/{fractions.prefix(percent, start)}vocab_all"
    write(vocab, path, rewrite)
    return path


def write_ignored(groups: DataFrame, root: str, threshold: float) -> str:
    """The groups left out at a threshold, in a folder of the threshold."""
    path = f"{root.rstrip('/')}/threshold={threshold:g}"
    write(groups, path, rewrite=True)
    return path


def write_report(report: DataFrame, path: str) -> None:
    """The lines of a report (place, line) as text, in their order."""
    report.orderBy("place").select(F.col("line").alias("value")).write.mode("overwrite").text(path)
