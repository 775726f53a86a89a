"""Parameter grids: values per variable, their product, a seeded draw, and the best by a metric."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sampling


#: Values of one variable at most: they are broadcast.
MOST_VALUES = 100_000


@dataclass(frozen=True)
class Variable:
    """Values from ``start`` below ``end`` by adding (``plus``) or multiplying (``mult``) with ``step``."""

    name: str
    start: float
    end: float
    step: float
    kind: str = "plus"

    def count(self) -> int:
        if self.kind == "plus":
            return math.ceil((self.end - self.start) / self.step)
        return math.ceil(math.log(self.end / self.start) / math.log(self.step))

    def value(self, i: int) -> float:
        return float(self.start + self.step * i if self.kind == "plus" else self.start * self.step**i)


def counts(variables: list[Variable], total: float) -> dict[str, int]:
    """How many values of each variable make about ``total`` combinations.

    Starting from all values, the variable that keeps the largest part of its values gives one up, until the product
    isn't above ``total``; the last step is taken back if the product before it was nearer."""
    full = {v.name: v.count() for v in variables}
    kept = dict(full)
    while (product := math.prod(kept.values())) > total and max(kept.values()) > 1:
        name = max((n for n in kept if kept[n] > 1), key=lambda n: (kept[n] / full[n], kept[n]))
        kept[name] -= 1
        fewer = math.prod(kept.values())
        if fewer <= total and product - total < total - fewer:
            kept[name] += 1
            break
    return kept


def grid(spark: SparkSession, variables: list[Variable], total: int, seed: int = 0) -> DataFrame:
    """(id, one column a variable): the product of seeded draws of each variable's values."""
    if total <= 0:
        raise ValueError(f"no grid of {total} points")
    n = counts(variables, total)
    if max(n.values()) > MOST_VALUES:
        raise ValueError(f"more than {MOST_VALUES} values of a variable")
    df = None
    for v in variables:
        values = spark.createDataFrame([(v.value(i), i) for i in range(v.count())], f"`{v.name}` double, i int")
        drawn = sampling.sample(values, n[v.name], "i", seed).select(v.name)
        df = drawn if df is None else df.join(F.broadcast(drawn))
    names = [v.name for v in variables]
    return df.withColumn("id", F.xxhash64(*names))


def best(metrics: DataFrame, n: int = 100, by: str = "metric") -> DataFrame:
    return metrics.orderBy(F.desc(by), "id").limit(n)
