"""Seeded samples and quotas: every draw is a rank by hash, so it is the same on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order(seed: int, *key: str) -> Column:
    return F.xxhash64(*key, F.lit(seed))


def sample(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """``n`` rows, each kept top-n per task before the last step."""
    return df.orderBy(order(seed, key), key).limit(n)


def length_quotas(words: DataFrame, total: int = 1000, power: int = 5) -> DataFrame:
    """(length, n, quota): words of each length and how many to draw, in proportion to ln(n)^power. Rounded up,
    then one less for the largest until the sum is exact. There are as many rows as word lengths."""
    n = words.groupBy(F.length("token").alias("length")).agg(F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(1))
    share = F.pow(F.log(F.col("n").cast("double")), F.lit(float(power)))
    up = n.withColumn("s", share).withColumn("up", F.ceil(F.round(F.col("s") / F.sum("s").over(every) * total, 9)))
    excess = F.sum("up").over(every) - total
    rank = F.row_number().over(every.orderBy(F.desc("up"), "length"))
    return up.withColumn("excess", excess).withColumn("r", rank).select("length", "n", (F.col("up") - F.when(F.col("r") <= F.col("excess"), 1).otherwise(0)).cast("bigint").alias("quota"))


def stratified(words: DataFrame, quotas: DataFrame, chosen: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """Words of a-z drawn up to each length's quota; words already chosen count first. A length may hold a third of all words, so ranks are taken in hash ranges, and only as many ranges as the quota needs are ranked across."""
    w = words.select("token").distinct().where(F.col("token").rlike("^[a-z]+$"))
    if chosen is None:
        w = w.withColumn("first", F.lit(False))
    else:
        w = w.join(chosen.select("token", F.lit(True).alias("first")).distinct(), "token", "left").na.fill(False, ["first"])
    h = w.select("token", F.length("token").alias("length"), "first", order(seed, "token").alias("h")).withColumn("range", F.when(F.col("first"), -1).otherwise(F.shiftrightunsigned(F.col("h"), 54)))
    per = h.groupBy("length", "range").agg(F.count("*").alias("c"))
    before = per.withColumn("before", F.coalesce(F.sum("c").over(Window.partitionBy("length").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    r = h.join(before, ["length", "range"]).join(F.broadcast(quotas.select("length", "quota")), "length").where("before < quota")
    inside = F.row_number().over(Window.partitionBy("length", "range").orderBy("h", "token"))
    return r.withColumn("r", F.col("before") + inside).where("r <= quota").select("length", "token")


def without_some(tokens: Column, ranges: Column, key: Column, seed: int = 0) -> Column:
    """The ranges that a seeded draw removes: their number is uniform from 0 to all, the choice by hash."""
    n = F.pmod(F.xxhash64(key, F.lit(seed)), F.size(ranges) + 1)
    ranked = F.sort_array(F.transform(ranges, lambda r: F.struct(F.xxhash64(key, r["from"], F.lit(seed + 1)).alias("h"), r.alias("r"))))
    return F.transform(F.slice(ranked, 1, n.cast("int")), lambda x: F.struct(x["r"]["from"].alias("from"), (x["r"]["to"] + 1).alias("to")))


def labelled(words: DataFrame, labels: DataFrame) -> DataFrame:
    """(token, label): a sample to be labelled by hand; a label that exists already wins, other words show themselves."""
    known = labels.groupBy("token").agg(F.min("label").alias("known"))
    return words.select("token").distinct().join(known, "token", "left").select("token", F.coalesce("known", "token").alias("label"))


def length_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(length, a, b, difference) of the words of two samples."""
    n = lambda df, name: df.groupBy(F.length("token").alias("length")).agg(F.count("*").alias(name))
    both = n(a, "a").join(n(b, "b"), "length", "full_outer").na.fill(0, ["a", "b"])
    return both.withColumn("difference", F.col("a") - F.col("b"))
