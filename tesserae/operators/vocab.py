"""Vocabularies: counting, capping, growth, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.plans.staging import stage


def explode_tokens(df: DataFrame, tokens: Column, *keep: str) -> DataFrame:
    return df.select(*keep, F.explode(tokens).alias("token"))


def vocabulary(tokens: DataFrame, *by: str) -> DataFrame:
    """(by..., token, freq): partial sums are made before the shuffle."""
    return tokens.groupBy(*by, "token").agg(F.count("*").alias("freq"))


def merge_counts(*counts: DataFrame) -> DataFrame:
    """Sum of several (token, freq) tables."""
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out.groupBy("token").agg(F.sum("freq").alias("freq"))


def cap(vocab: DataFrame, threshold: int) -> DataFrame:
    """At most ``threshold`` tokens; all tokens as frequent as the first one left out are dropped too. No-op if
    the vocabulary isn't larger. The cut is found on the distinct frequencies, of which n tokens' worth of text
    has few, not by ranking all tokens in one task."""
    steps = vocab.groupBy("freq").agg(F.count("*").alias("n"))
    above = steps.withColumn("upto", F.sum("n").over(Window.orderBy(F.desc("freq")).rowsBetween(Window.unboundedPreceding, 0)))
    cut = above.where(F.col("upto") > threshold).agg(F.coalesce(F.max("freq"), F.lit(0)).alias("cut"))
    return vocab.join(F.broadcast(cut), vocab["freq"] > cut["cut"]).select(*vocab.columns)


def growth(tokens: DataFrame, file: str = "doc_id") -> DataFrame:
    """(n_files, vocab_size): distinct tokens seen up to each file in the order of its id. The running sum is over one row a file, by ranges of files first."""
    first = tokens.groupBy("token").agg(F.min(file).alias(file)).groupBy(file).agg(F.count("*").alias("new"))
    files = tokens.select(file).distinct().join(first, file, "left").na.fill(0, ["new"])
    return running(files, file, "new", "vocab_size", "n_files")


def running(df: DataFrame, key: str, value: str, total: str, position: str, width: int = 1000) -> DataFrame:
    """Running sum and position over ``key`` in blocks, so that no task sorts all rows: only one row a block goes through a single task."""
    block = F.floor(F.col(key) / width).alias("block")
    rows = df.select("*", block)
    sums = rows.groupBy("block").agg(F.sum(value).alias("s"), F.count("*").alias("c"))
    over = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("block", F.coalesce(F.sum("s").over(over), F.lit(0)).alias("s"), F.coalesce(F.sum("c").over(over), F.lit(0)).alias("c"))
    inside = Window.partitionBy("block").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.select(key, "block", F.sum(value).over(inside).alias("own"), F.count("*").over(inside).alias("at"))
    return own.join(before, "block").select(key, (F.col("c") + F.col("at")).alias(position), (F.col("s") + F.col("own")).alias(total))


def ranked(df: DataFrame, *order: Column, name: str = "id", first_id: int = 0) -> DataFrame:
    """``df`` with dense ranks in a total order: rows are divided into ranges of the order, ranked inside their range and moved
    by the sizes of the ranges before, so no value, however frequent, is one task's. The ranges are written once, as a second look would draw them anew."""
    place = F.monotonically_increasing_id()
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ranges = stage(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__place", place), "ranks")
    part, at = F.shiftright("__place", 33), F.col("__place").bitwiseAND((1 << 33) - 1)
    sizes = ranges.groupBy(part.alias("__part")).agg(F.count("*").alias("c"))
    before = sizes.select("__part", F.coalesce(F.sum("c").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    j = ranges.withColumn("__part", part).join(before, "__part")
    return j.withColumn(name, (F.col("__before") + at + first_id).cast("bigint")).select(*df.columns, name)


def numbered(vocab: DataFrame, first_id: int = 0) -> DataFrame:
    """Ids by frequency, then token."""
    return ranked(vocab.select("token", "freq"), F.desc("freq"), F.asc("token"), first_id=first_id)


def by_length(words: DataFrame) -> DataFrame:
    """(token, length, place): the order in which a splitter goes through words, the shortest first."""
    return ranked(words.select("token", F.length("token").alias("length")), F.asc("length"), F.asc("token"), name="place")


def foreign_growth(tokens: DataFrame, file: str = "doc_id") -> DataFrame:
    """(n_files, vocab_size, non_eng) over the files in the order of their ids: distinct tokens and distinct foreign tokens (column ``foreign``) so far."""
    first = tokens.groupBy("token").agg(F.min(file).alias(file), F.first("foreign").alias("foreign"))
    new = first.groupBy(file).agg(F.count("*").alias("new"), F.count_if("foreign").alias("new_foreign"))
    files = tokens.select(file).distinct().join(new, file, "left").na.fill(0, ["new", "new_foreign"])
    size = running(files, file, "new", "vocab_size", "n_files")
    return size.join(running(files, file, "new_foreign", "non_eng", "n").drop("n"), file).select(file, "n_files", "vocab_size", "non_eng")


def size_report(growth: DataFrame) -> DataFrame:
    """(place, line): the final size, then for each file the share of files, the share of the final size and the share of foreign tokens, with four decimals."""
    end = growth.agg(F.max("n_files").alias("files"), F.max("vocab_size").alias("size"))
    each = growth.join(F.broadcast(end)).select(F.col("n_files").alias("place"), F.format_string("%.4f\t%.4f\t%.4f", F.col("n_files") / F.col("files"), F.col("vocab_size") / F.col("size"), F.col("non_eng") / F.col("vocab_size")).alias("line"))
    return end.select(F.lit(0).cast("bigint").alias("place"), F.col("size").cast("string").alias("line")).unionByName(each)


def positions(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(key, position, token): the subwords of each row one by one."""
    return df.select(key, F.posexplode(tokens).alias("position", "token"))
