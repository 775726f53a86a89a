"""Comparison of lists of merges (list, left, right, freq)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Lists that are compared at most; their names are broadcast, and each meets each.
MOST_LISTS = 2_000


def vectors(a: DataFrame, b: DataFrame) -> DataFrame:
    """(left, right, a, b): frequencies of each pair in two lists, 0 where it is missing."""
    x, y = a.select("left", "right", F.col("freq").alias("a")), b.select("left", "right", F.col("freq").alias("b"))
    return x.join(y, ["left", "right"], "full_outer").na.fill(0, ["a", "b"])


def correlation(a: DataFrame, b: DataFrame) -> DataFrame:
    return vectors(a, b).agg(F.round(F.corr("a", "b"), 6).alias("pearson"))


def overlap_matrix(lists: DataFrame, name: str = "list") -> DataFrame:
    """(list_a, list_b, common, rate): shared pairs of every two lists against the smaller list. The lists meet on their pairs, by an equi-join; empty meetings are filled in over the few list names."""
    sizes = lists.groupBy(name).agg(F.count("*").alias("n"))
    a, b = lists.select(F.col(name).alias("list_a"), "left", "right"), lists.select(F.col(name).alias("list_b"), "left", "right")
    common = a.join(b, ["left", "right"]).groupBy("list_a", "list_b").agg(F.count("*").alias("common"))
    every = sizes.select(F.col(name).alias("list_a"), F.col("n").alias("na")).join(F.broadcast(sizes.select(F.col(name).alias("list_b"), F.col("n").alias("nb")).limit(MOST_LISTS + 1)))
    # the limit bounds what is broadcast; where it bites, the query is an error
    lists = F.count("*").over(Window.partitionBy("list_a"))
    every = every.withColumn("na", F.when(lists > MOST_LISTS, F.raise_error(F.lit(f"more than {MOST_LISTS} lists: a matrix of them is no report"))).otherwise(F.col("na")))
    j = every.join(common, ["list_a", "list_b"], "left").na.fill(0, ["common"])
    return j.select("list_a", "list_b", "common", F.round(F.col("common") / F.least("na", "nb"), 6).alias("rate"))


def occurrences(lists: DataFrame) -> DataFrame:
    """(left, right, lists): in how many lists each pair stands."""
    return lists.groupBy("left", "right").agg(F.count("*").alias("lists"))


def occurrence_summary(lists: DataFrame) -> DataFrame:
    """(lists, share): of all entries, the share of pairs that stand in so many lists."""
    n = occurrences(lists).groupBy("lists").agg(F.sum("lists").alias("entries"))
    total = n.agg(F.sum("entries").alias("total"))
    return n.join(F.broadcast(total)).select("lists", F.round(F.col("entries") / F.col("total"), 6).alias("share"))


def similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Share, weighted by frequency, of words (word, subwords, freq) split alike under two merge lists; unequal frequencies are an error."""
    x, y = a.select("word", F.col("subwords").alias("sa"), F.col("freq").alias("fa")), b.select("word", F.col("subwords").alias("sb"), F.col("freq").alias("fb"))
    j = x.join(y, "word")
    freq = F.when(F.col("fa") != F.col("fb"), F.raise_error(F.lit("frequencies differ"))).otherwise(F.col("fa"))
    return j.select(freq.cast("bigint").alias("f"), (F.col("sa") != F.col("sb")).alias("d")).agg(F.round(1 - F.coalesce(F.sum(F.when(F.col("d"), F.col("f"))), F.lit(0)) / F.sum("f"), 6).alias("similarity"))
