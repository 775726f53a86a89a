"""Dictionaries: membership, difference, look-up with a default, near words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def members(df: DataFrame, words: DataFrame, key: str = "token") -> DataFrame:
    """Rows whose key is in ``words``. No hint: Catalyst broadcasts a small dictionary and shuffles a large one."""
    return df.join(words.select(key).distinct(), key, "left_semi")


def difference(words: DataFrame, known: DataFrame, least: int = 4, key: str = "token") -> DataFrame:
    return words.select(key).where(F.length(key) >= least).distinct().join(known.select(key), key, "left_anti")


def looked_up(df: DataFrame, table: DataFrame, key: str, value: str, default: Column) -> DataFrame:
    return df.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(value, default))


def near_words(words: DataFrame, known: DataFrame) -> DataFrame:
    """(word, fix): pairs one edit or one swap of neighbours apart, by an equi-join on deletion signatures: two
    words at that distance share a form with at most one letter left out. Not a join on length, whose few keys
    would hold all words."""
    def signatures(df: DataFrame, name: str) -> DataFrame:
        w = F.col(name)
        cuts = F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
        return df.select(name, F.explode(F.array_distinct(F.array_append(F.when(F.length(w) > 0, cuts).otherwise(F.array().cast("array<string>")), w))).alias("sig"))

    a, b = signatures(words.select(F.col("token").alias("word")).distinct(), "word"), signatures(known.select(F.col("token").alias("fix")).distinct(), "fix")
    w, x = F.col("word"), F.col("fix")
    swap = F.exists(F.sequence(F.lit(1), F.greatest(F.length(w) - 1, F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.lit(1)), F.substring(w, i, F.lit(1)), F.substring(w, i + 2, F.length(w))) == x)
    near = (F.levenshtein(w, x) == 1) | ((F.levenshtein(w, x) == 2) & (F.length(w) == F.length(x)) & swap)
    return a.join(b, "sig").select("word", "fix").distinct().where((w != x) & near)
