"""Duplicate records: groups, the ones to drop, and renamed paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def groups(df: DataFrame, value: str, key: str) -> DataFrame:
    """(digest, first, copies) of values that occur more than once. Only digests are shuffled."""
    d = df.where(F.col(value).isNotNull()).select(F.sha2(value, 256).alias("digest"), key)
    return d.groupBy("digest").agg(F.min(key).alias("first"), F.count("*").alias("copies")).where("copies > 1")


def deduplicated(df: DataFrame, value: str, key: str) -> DataFrame:
    """One row of each value, that of the smallest key; nulls stay. The keepers are found by a pre-aggregated minimum, so a value held by a third of the rows is no hot group."""
    keep = df.where(F.col(value).isNotNull()).groupBy(F.sha2(value, 256).alias("digest")).agg(F.min(key).alias(key)).select(key)
    return df.where(F.col(value).isNull()).unionByName(df.where(F.col(value).isNotNull()).join(keep, key, "left_semi"))


def renamed(paths: DataFrame, names: DataFrame) -> DataFrame:
    """Paths (project, file) under each project's name in its split; unknown projects get a path that doesn't exist."""
    j = paths.join(names, "project", "left")
    return j.select("project", "file", F.coalesce(F.concat_ws("/", "split", "project", "file"), F.lit("")).alias("path")).withColumn("path", F.when(F.col("path").startswith("/"), F.lit("")).otherwise(F.col("path")))


def drop_listed(df: DataFrame, duplicate_groups: DataFrame, key: str) -> DataFrame:
    """Without all but the first member of each listed group (array of keys); members that don't exist are ignored."""
    rest = duplicate_groups.select(F.explode(F.slice("members", 2, F.greatest(F.size("members") - 1, F.lit(0)))).alias(key))
    return df.join(rest, key, "left_anti")


def latest(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")
