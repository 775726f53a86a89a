"""Sources: project trees, dictionaries, merges, caches, tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8, or Latin-1 where they aren't valid UTF-8."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def project_tree(spark: SparkSession, root: str, suffix: str | None = None) -> DataFrame:
    """(split, project, file, text) of ``root/{train,test,valid}/project/**``; hidden files are left out. The suffix is a glob of the file listing, so other files aren't read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if suffix:
        reader = reader.option("pathGlobFilter", f"*{suffix}")
    path = F.url_decode(F.regexp_replace("path", r"\+", "%2B"))
    rel = F.regexp_extract(path, r"/(train|test|valid)/([^/]+)/(.+)$", 0)
    part = lambda i: F.regexp_extract(path, r"/(train|test|valid)/([^/]+)/(.+)$", i)
    return reader.load(root).where(rel != "").select(part(1).alias("split"), part(2).alias("project"), part(3).alias("file"), decoded(F.col("content")).alias("text")).where(~F.element_at(F.split("file", "/"), -1).startswith("_"))


def projects(corpus: DataFrame) -> DataFrame:
    return corpus.select("split", "project").distinct()


def project_of(name: Column) -> Column:
    """Project of a parsed file's name ``.{project}.…``; an error if the name has another form."""
    p = F.regexp_extract(name, r"^\.?(.+?)\.(?:parsed|filenames|repr).*$", 1)
    return F.when(p == "", F.raise_error(F.concat(F.lit("no project in "), name))).otherwise(p)


def pairs(spark: SparkSession, path: str, delimiter: str = "\t", kind: str | None = None) -> DataFrame:
    """Two-column file (key, value); ``kind``: a type, ``list`` (space-separated), or None to take int where every value is one."""
    df = spark.read.csv(path, sep=delimiter, schema="key string, value string", quote="", ignoreLeadingWhiteSpace=False)
    if kind == "list":
        return df.withColumn("value", F.split("value", " "))
    if kind:
        return df.withColumn("value", F.col("value").try_cast(kind))
    bad = df.where(F.col("value").isNotNull() & F.col("value").try_cast("bigint").isNull()).limit(1).count()
    return df if bad else df.withColumn("value", F.col("value").cast("bigint"))


def lists(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.split("value", " ").alias("items"))


def merges(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """(rank, left, right, freq) of a merges file; the rank is the line's number."""
    p = F.split("text", " ")
    df = lines_of(spark, path).select(F.col("line").cast("int").alias("rank"), p[0].alias("left"), p[1].alias("right"), F.try_element_at(p, F.lit(3)).try_cast("bigint").alias("freq"))
    return df if first is None else df.where(F.col("rank") < first)


def english(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, recursiveFileLookup=True).select(F.lower("value").alias("token")).where("token <> ''").distinct()


def foreign(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, recursiveFileLookup=True).select(F.col("value").alias("line")).where("line <> ''").distinct()


def duplicate_groups(spark: SparkSession, path: str) -> DataFrame:
    """(members) of a JSON file of lists of paths."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", T.ArrayType(T.ArrayType(T.StringType())))).alias("members"))


def table(spark: SparkSession, name: str, where: str, **jdbc: str) -> DataFrame:
    """A stored table: a folder of Parquet files, or over JDBC if a url is given."""
    return spark.read.jdbc(jdbc.pop("url"), name, properties=jdbc) if "url" in jdbc else spark.read.parquet(f"{where}/{name}.parquet")


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text) of a file or a folder. Large files are read in blocks: a line's number is its place in its block and the lines of the blocks before."""
    raw = spark.read.text(path, recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("text")
    )
    blocks = raw.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    above = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return raw.join(blocks.select("file", "block", "first", above.alias("above")), ["file", "block"]).select("file", (F.col("above") + F.col("at") - F.col("first")).alias("line"), "text")


def token_lines(spark: SparkSession, path: str, backwards: bool = False) -> DataFrame:
    """(file, line, tokens) of rendered lines, each from its end if ``backwards``; a folder without lines is an error."""
    tokens = F.split("text", " ")
    return nonempty(lines_of(spark, path), path).select("file", "line", (F.reverse(tokens) if backwards else tokens).alias("tokens"))


def project_list(spark: SparkSession, path: str) -> DataFrame:
    """(name, url) of a list of projects; hidden blanks around a url are no part of it."""
    return spark.read.csv(path, schema="name string, url string", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).where("name is not null")


def tagged_files(spark: SparkSession, path: str) -> DataFrame:
    """(project, file, noneng) of a JSON file of tags: a list of objects, or one object a line."""
    return spark.read.json(path, schema="project string, file string, noneng boolean", multiLine=True)


def nonempty(df: DataFrame, what: str) -> DataFrame:
    """``df``; reading it is an error if it has no rows. The test takes one row and no other pass."""
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


#: Manual splittings: word, type and, for some types, subwords.
TAGS = "word string, type string, subwords string"


def manual_tags(spark: SparkSession, path: str, types: list[str], with_parts: list[str]) -> DataFrame:
    """Tags with unknown types, missing or needless subwords, or subwords that don't make the word raised as errors."""
    df = spark.read.csv(path, sep="|", schema=TAGS)
    bad = (
        F.when(~F.col("type").isin(*types), F.concat(F.lit("unknown type: "), F.col("type"))).when(F.col("type").isin(*with_parts) & F.col("subwords").isNull(), F.concat(F.lit("no subwords: "), F.col("word")))
        .when(~F.col("type").isin(*with_parts) & F.col("subwords").isNotNull(), F.concat(F.lit("needless subwords: "), F.col("word")))
        .when(F.col("subwords").isNotNull() & (F.replace("subwords", F.lit(" "), F.lit("")) != F.col("word")), F.concat(F.lit("other letters: "), F.col("word")))
    )
    return df.withColumn("word", F.when(bad.isNotNull(), F.raise_error(bad)).otherwise(F.col("word")))


def caches(first: DataFrame, *later: DataFrame) -> DataFrame:
    """Union of (word, subwords) caches; a later one overrides an earlier."""
    tagged = first.select("word", "subwords", F.lit(0).alias("p"))
    for i, df in enumerate(later, 1):
        tagged = tagged.unionByName(df.select("word", "subwords", F.lit(i).alias("p")))
    return tagged.groupBy("word").agg(F.max_by("subwords", "p").alias("subwords"))


def selected_by_length(spark: SparkSession, path: str) -> DataFrame:
    words = spark.read.csv(path, sep="|", schema="word string, rest string")
    return words.groupBy(F.length("word").alias("length")).agg(F.sort_array(F.collect_list("word")).alias("words"))
