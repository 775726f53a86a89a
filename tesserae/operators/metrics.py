"""Measures of sequence predictions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def subword_average(losses: Column) -> Column:
    """Mean of an array, 0 if it is empty."""
    return F.when(F.size(losses) > 0, F.aggregate(losses, F.lit(0.0), lambda a, x: a + x) / F.size(losses)).otherwise(0.0)


def word_entropies(losses: Column, bounds: Column) -> Column:
    """Sums between boundaries; an error if the last boundary isn't the end."""
    checked = F.when(F.element_at(bounds, -1) != F.size(losses), F.raise_error(F.lit("the last boundary is not the end"))).otherwise(bounds)
    ends = F.slice(checked, 2, F.greatest(F.size(bounds) - 1, F.lit(0)))
    starts = F.slice(bounds, 1, F.greatest(F.size(bounds) - 1, F.lit(0)))
    return F.zip_with(starts, ends, lambda a, b: F.aggregate(F.slice(losses, a + 1, b - a), F.lit(0.0), lambda s, x: s + x))


def word_average(losses: Column, bounds: Column) -> Column:
    return subword_average(word_entropies(losses, bounds))


AGGREGATORS = {"subtoken-average": lambda losses, bounds: subword_average(losses), "full-token-average": word_average, "full-token-entropies": word_entropies}


def subword_accuracy(df: DataFrame, group: str, word: str, predicted: str, target: str) -> DataFrame:
    """(strict, mean): share of words all of whose subwords are right, and mean share of right subwords."""
    hit = F.col(predicted) == F.col(target)
    w = df.groupBy(group, word).agg(F.min(hit.cast("int")).alias("strict"), F.avg(hit.cast("int")).alias("mean"))
    return w.groupBy(group).agg(F.round(F.avg("strict"), 6).alias("strict"), F.round(F.avg("mean"), 6).alias("mean"))


def weighted_average(df: DataFrame, weight: str, *values: str) -> DataFrame:
    return df.agg(*(F.round(F.sum(F.col(v) * F.col(weight)) / F.sum(weight), 6).alias(v) for v in values))


def cross_entropy(df: DataFrame, probability: str) -> DataFrame:
    return df.agg(F.round(-F.avg(F.log(probability)), 6).alias("cross_entropy"))


def top_k(df: DataFrame, rank: str, ks: list[int], category: str | None = None) -> DataFrame:
    """Accuracy among the first k and the mean reciprocal rank, over all or per category."""
    cols = [F.round(F.avg((F.col(rank) <= k).cast("int")), 6).alias(f"top_{k}") for k in ks] + [F.round(F.avg(1 / F.col(rank)), 6).alias("mrr")]
    return (df.groupBy(category) if category else df).agg(*cols)


def vector_mean(df: DataFrame, vector: str) -> DataFrame:
    """(index, mean) of an array column."""
    return df.select(F.posexplode(vector).alias("index", "v")).groupBy("index").agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"))


def early_stop(df: DataFrame, order: str, loss: str, patience: int) -> DataFrame:
    """Running best loss, epochs since it, and whether training stops there. A run's epochs are few rows."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    best = df.select(order, F.round(loss, 6).alias("loss")).withColumn("best", F.min("loss").over(w))
    at = best.withColumn("n", F.row_number().over(Window.orderBy(order))).withColumn("since", F.col("n") - F.max(F.when(F.col("loss") == F.col("best"), F.col("n"))).over(w))
    first = F.min(F.when(F.col("since") >= patience, F.col("n"))).over(Window.partitionBy(F.lit(1)))
    return at.select(order, "loss", "best", F.col("since").cast("bigint").alias("since"), F.coalesce(F.col("n") >= first, F.lit(False)).alias("stopped"))


def neural_cache(df: DataFrame, order: str, hidden: str, target: str, window: int, theta: float) -> DataFrame:
    """(order, cache): probability that the last ``window`` steps, weighted by softmax of theta times the inner product with the present one, give the present target. Neighbours come by an equi-join on step numbers, not by one sorted task with all vectors."""
    # step numbers: ids are dense already in the tables we read; the frame is rows before
    steps = df.select(F.col(order).alias("t"), F.col(hidden).alias("h"), F.col(target).alias("y"))
    now = steps.select("t", "h", "y", F.explode(F.sequence(F.col("t") - window, F.col("t") - 1)).alias("i"))
    past = steps.select(F.col("t").alias("i"), F.col("h").alias("hi"), F.col("y").alias("yi"))
    dot = F.aggregate(F.zip_with("h", "hi", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    w = F.exp(theta * dot)
    j = now.join(past, "i").select("t", "y", "yi", w.alias("w"))
    return j.groupBy("t").agg(F.round(F.sum(F.when(F.col("y") == F.col("yi"), F.col("w")).otherwise(0.0)) / F.sum("w"), 6).alias("cache"))


def top_of(probabilities: Column, k: int) -> Column:
    """The ``k`` largest of an array as (p, index), the largest first, ties by index."""
    ranked = F.array_sort(F.transform(probabilities, lambda p, i: F.struct((-p.cast("double")).alias("n"), i.alias("index"))))
    return F.transform(F.slice(ranked, 1, k), lambda x: F.struct((-x["n"]).alias("p"), x["index"].alias("index")))


def mixed(cache: Column, model: Column, share: float) -> Column:
    """Probability of a cache and a model together, ``share`` of the cache."""
    return share * cache + (1 - share) * model


def parsed_top_k(metric: str) -> tuple[list[int], str | None]:
    """(ranks, category) of a metric's name ``topk_<k>_<k>..._cat_<category>``; the category may be missing."""
    head, _, category = metric.partition("_cat_")
    name, *ks = head.split("_")
    if name != "topk" or not ks or not all(k.isdigit() for k in ks):
        raise ValueError(f"no such metric: {metric}")
    return [int(k) for k in ks], category or None


def top_k_of(df: DataFrame, metric: str, rank: str, category: str) -> DataFrame:
    """Top-k accuracy by a metric's name: of the rows of its category, or of all."""
    ks, wanted = parsed_top_k(metric)
    rows = df if wanted is None else df.where(F.col(category) == wanted)
    return rows.agg(*(F.round(F.avg((F.col(rank) <= k).cast("int")), 6).alias(f"top_{k}") for k in ks))


def profile(df: DataFrame, step: str, seconds: str) -> DataFrame:
    """Calls, longest and mean time of each step."""
    return df.groupBy(step).agg(F.count("*").alias("calls"), F.max(seconds).alias("longest"), F.round(F.avg(seconds), 6).alias("mean"))


def losses(df: DataFrame, key: str, tokens: str, load: Callable[[], Callable[[list[list[str]]], list[list[float]]]]) -> DataFrame:
    """(key, losses): the loss of each token by a model, batch by batch; ``load`` makes the model once a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model(b.column(1).to_pylist()), pa.list_(pa.float64()))], [key, "losses"])

    return df.select(key, tokens).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, losses array<double>")
