"""Classification cases from rendered files: where logging stands, or could stand, and what it says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions import markers as M
from tesserae.functions import text

from . import fractions, sampling, vocab

CONTEXT = 1000
KINDS = ("location", "level", "level_binary")


def log_ranges(tokens: Column) -> Column:
    return text.ranges_between(tokens, M.LOG, M.LOG_END)


def possible_ranges(tokens: Column) -> Column:
    """(i+1, i) behind each ``{``, ``}``, ``;`` and log end inside a loggable block; the last token of a block isn't
    tried, and a block that doesn't end has none. One pass: places wait until their block ends."""
    none = F.array().cast("array<struct<from:int,to:int>>")
    start = F.struct(none.alias("out"), none.alias("wait"), F.lit(False).alias("open"))
    indexed = F.filter(F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda x: x.t.isin(M.BLOCK, M.BLOCK_END, "{", "}", ";", M.LOG_END))

    def step(a, x):
        opened = F.struct(a.out.alias("out"), none.alias("wait"), F.lit(True).alias("open"))
        closed = F.struct(F.concat(a.out, F.filter(a.wait, lambda w: w["to"] < x.i - 1)).alias("out"), none.alias("wait"), F.lit(False).alias("open"))
        added = F.struct(a.out.alias("out"), F.array_append(a.wait, F.struct((x.i + 1).alias("from"), x.i.alias("to"))).alias("wait"), a.open.alias("open"))
        return F.when(~a.open & (x.t == M.BLOCK), opened).when(a.open & (x.t == M.BLOCK_END), closed).when(a.open & x.t.isin("{", "}", ";", M.LOG_END), added).otherwise(a)

    return F.aggregate(indexed, start, step, lambda a: a.out)


def coverage(rendered: DataFrame, *by: str) -> DataFrame:
    """Files with and without a logging statement per group, and the total (group null)."""
    has = F.array_contains("tokens", M.LOG)
    return rendered.rollup(*by).agg(F.count_if(has).alias("with_logs"), F.count_if(~has).alias("without_logs"))


def ignored(coverage_rows: DataFrame, threshold: float) -> DataFrame:
    """Groups whose share of files with logging is at most ``threshold`` percent."""
    share = F.try_divide("with_logs", F.col("with_logs") + F.col("without_logs"))
    return coverage_rows.where(F.coalesce(share, F.lit(0.0)) <= threshold * 0.01)


def cases(rendered: DataFrame, key: str, kind: str, length: int = CONTEXT, seed: int = 0) -> DataFrame:
    """(key, before, after, label): one case a file; nulls where no logging is left after some of it was removed at random (seeded)."""
    if kind not in KINDS:
        raise ValueError(f"unknown classifier: {kind}")
    base = rendered.select(key, "tokens").withColumn("logs", log_ranges(F.col("tokens")))
    left = base.withColumn("tokens", text.without_ranges(F.col("tokens"), sampling.without_some(F.col("tokens"), F.col("logs"), F.col(key), seed))).withColumn("logs", log_ranges(F.col("tokens")))
    k = F.col(key)
    positive = F.lit(True) if kind != "location" else F.pmod(F.xxhash64(k, F.lit(seed + 2)), F.lit(2)) == 0
    options = left.withColumn("positive", positive).withColumn("places", F.when(F.col("positive"), F.col("logs")).otherwise(possible_ranges(F.col("tokens"))))
    usable = (F.size("logs") > 0) & (F.size("places") > 0)
    at = F.when(usable, F.element_at("places", (F.pmod(F.xxhash64(k, F.lit(seed + 3)), F.greatest(F.size("places"), F.lit(1))) + 1).cast("int")))
    c = options.withColumn("at", at)
    level = F.regexp_replace(F.element_at("tokens", F.col("at")["from"] + 2), "^`", "")
    label = F.when(F.col("positive"), "1").otherwise("0") if kind == "location" else level if kind == "level" else F.when(level.isin(*M.POSITIVE_LEVELS), "1").otherwise("0")
    return c.select(
        key, F.when(F.col("at").isNotNull(), text.context_before(F.col("tokens"), F.col("at")["from"], length)).alias("before"),
        F.when(F.col("at").isNotNull(), text.context_after(F.col("tokens"), F.col("at")["to"], length)).alias("after"), F.when(F.col("at").isNotNull(), label).alias("label"),
    )


def training_rows(case_rows: DataFrame, ignored_groups: DataFrame, group: str) -> DataFrame:
    """Cases with a label, without the ignored groups."""
    return case_rows.where("label is not null and label <> ''").join(ignored_groups.select(group), group, "left_anti")


def batches(rows: DataFrame, key: str, tokens: str, size: int) -> DataFrame:
    """(key, tokens, batch, width): rows in batches of ``size`` of about equal length, the shortest first, each padded on the right to its batch's longest."""
    r = vocab.ranked(rows.select(key, tokens, F.size(tokens).alias("n")), F.asc("n"), F.asc(key), name="place").withColumn("batch", F.floor(F.col("place") / size))
    width = r.groupBy("batch").agg(F.max("n").alias("width"))
    padded = F.concat(F.col(tokens), F.array_repeat(F.lit(M.PAD), F.col("width") - F.col("n")))
    return r.join(width, "batch").select(key, padded.alias(tokens), "batch", "width")


def sets(rows: DataFrame, split: str = "split") -> dict[str, DataFrame]:
    """The training and validation rows; test rows belong to neither."""
    return {name: rows.where(F.col(split) == name) for name in ("train", "valid")}


def scanned(case_rows: DataFrame, ignored_groups: DataFrame, group: str, percent: float = 100, start: float = 0) -> DataFrame:
    """Labelled cases of a fraction of the groups (chunk numbers lead their names), without the ignored ones; no case at all is an error."""
    rows = training_rows(fractions.in_fraction(case_rows, fractions.chunk_of(F.col(group)), percent, start), ignored_groups, group)
    if rows.isEmpty():
        raise ValueError("no cases")
    return rows
