"""Language statistics, tags and thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import text
from tesserae.operators import langstats, params, vocab
from tesserae.sources import sinks

from .base import query

def _share():
    return F.when(~F.isnan("code_percent"), F.col("code_percent")).alias("code_percent")


def _over(op: str, t=langstats.THRESHOLDS) -> str:
    c = ("code_percent", "code_non_eng", "code_non_eng_uq", "code_str_percent", "code_str_non_eng", "code_str_non_eng_uq")
    p = [f"CAST({x} AS DOUBLE) {op} CAST({v!r} AS DOUBLE)" for x, v in zip(c, t)]
    return f"(({p[0]} AND {p[1]} AND {p[2]}) OR ({p[3]} AND {p[4]} AND {p[5]}))"


@query(
    "WITH w AS (SELECT doc_id, token, regexp_matches(token, '[^\\x00-\\x7F]') AS f FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '\\n$', ''), ' ')) AS token FROM documents)) "
    "SELECT doc_id, count(*) AS total, count(DISTINCT token) AS total_uq, CAST(count(*) FILTER (f) AS BIGINT) AS non_eng, count(DISTINCT CASE WHEN f THEN token END) AS non_eng_uq, "
    "round(count(*) FILTER (f) / count(*), 6) AS percent, round(count(DISTINCT CASE WHEN f THEN token END) / count(DISTINCT token), 6) AS percent_uq FROM w GROUP BY doc_id"
)
def lang_stats(t):
    tokens = vocab.explode_tokens(t.documents, text.words(F.col("text")), "doc_id")
    return langstats.statistics(tokens, text.non_ascii(F.col("token")), "doc_id").drop("sample")


@query(f"SELECT project, file, code_percent, code_str_percent FROM langstats WHERE {_over('>')}")
def noneng_files(t):
    return langstats.foreign_files(t.langstats).select("project", "file", "code_percent", "code_str_percent")


@query(f"SELECT project, count(*) AS files FROM langstats WHERE {_over('>=')} GROUP BY project")
def noneng_projects(t):
    return langstats.foreign_files(t.langstats, inclusive=True).groupBy("project").agg(F.count("*").alias("files"))


@query(
    "SELECT project, file FROM langstats WHERE ((CAST(code_percent AS DOUBLE) > CAST(0.005 AS DOUBLE) AND code_non_eng_uq > 2) OR (CAST(code_str_percent AS DOUBLE) > CAST(0.005 AS DOUBLE) AND code_str_non_eng_uq > 2)) AND length(file) % 15 = 0"
)
def noneng_sample(t):
    over = lambda g: (F.col(f"{g}_percent").cast("double") > 0.005) & (F.col(f"{g}_non_eng_uq") > 2)
    return t.langstats.where((over("code") | over("code_str")) & (F.length("file") % 15 == 0)).select("project", "file")


@query("SELECT m.project, m.file, m.noneng, CASE WHEN CAST(l.code_percent AS VARCHAR) NOT LIKE '%nan%' THEN l.code_percent END AS code_percent FROM noneng_manual_tags m JOIN langstats l ON m.project = l.project AND m.file = l.file")
def tagged_stats(t):
    """Tags with their files' share, in its order; a share that is no number is null."""
    return t.noneng_manual_tags.join(t.langstats, ["project", "file"]).select("project", "file", "noneng", _share()).orderBy("code_percent")


@query("SELECT m.project, m.file, m.noneng, CASE WHEN CAST(l.code_percent AS VARCHAR) NOT LIKE '%nan%' THEN l.code_percent END AS code_percent FROM noneng_manual_tags m JOIN langstats l ON m.file = l.file")
def tagged_stats_by_file(t):
    """The join on the file name alone."""
    m, l = t.noneng_manual_tags.alias("m"), t.langstats.alias("l")
    return m.join(l, F.col("m.file") == F.col("l.file")).select("m.project", "m.file", "noneng", _share())


@query("SELECT DISTINCT project FROM langstats WHERE project NOT IN (SELECT project FROM projects WHERE project IS NOT NULL)")
def orphan_stats(t):
    """Statistics of projects the store doesn't know (the foreign key)."""
    return t.langstats.select("project").distinct().join(t.projects, "project", "left_anti").where("project is not null")


@query("SELECT DISTINCT project, file FROM langstats WHERE project NOT IN (SELECT project FROM projects WHERE processed) AND NOT starts_with(string_split(file, '/')[-1], '.')")
def unprocessed_files(t):
    done = t.projects.where("processed").select("project")
    files = t.langstats.where(~F.element_at(F.split("file", "/"), -1).startswith(".")).select("project", "file").distinct()
    return files.join(done, "project", "left_anti").where("project is not null")


_GRID = [(i, 0.002 * i, 2.01, 2.01, 0.003 * i, 2.01, 2.01) for i in range(1, 11)]


@query(
    "WITH g(id, a, b, c, d, e, f) AS (VALUES " + ", ".join(str(g) for g in _GRID) + "), "
    "t AS (SELECT m.noneng, l.* FROM noneng_manual_tags m JOIN langstats l ON m.project = l.project AND m.file = l.file WHERE m.noneng IS NOT NULL), "
    "h AS (SELECT g.id, t.noneng, " + _over(">=", ("g.a", "g.b", "g.c", "g.d", "g.e", "g.f")).replace("'", "") + " AS hit FROM t, g), "
    "n AS (SELECT id, count(*) FILTER (hit AND noneng) AS tp, count(*) FILTER (hit) AS selected, count(*) FILTER (noneng) AS relevant FROM h GROUP BY id) "
    "SELECT id, tp, selected, relevant, round(coalesce(tp / nullif(selected, 0), 0), 6) AS precision, round(coalesce(tp / nullif(relevant, 0), 0), 6) AS recall, "
    "round((coalesce(tp / nullif(selected, 0), 0) + coalesce(tp / nullif(relevant, 0), 0)) / 2, 6) AS metric FROM n"
)
def threshold_metrics(t):
    grid = t.spark.createDataFrame(_GRID, "id int, a double, b double, c double, d double, e double, f double")
    tagged = t.noneng_manual_tags.where("noneng is not null").join(t.langstats, ["project", "file"])
    return langstats.threshold_metrics(tagged, grid)


@query()
def param_search(t):
    """The best of a drawn grid of thresholds by the mean of precision and recall."""
    v = [params.Variable("a", 0.001, 0.02, 0.001), params.Variable("b", 1, 8, 1), params.Variable("c", 1, 8, 1), params.Variable("d", 0.001, 0.04, 0.002), params.Variable("e", 1.01, 8, 1.4, "mult"), params.Variable("f", 1, 8, 1)]
    tagged = t.noneng_manual_tags.where("noneng is not null").join(t.langstats, ["project", "file"])
    return params.best(langstats.threshold_metrics(tagged, params.grid(t.spark, v, 500)), 100)


@query("SELECT project, file, noneng FROM noneng_manual_tags WHERE NOT EXISTS (SELECT 1 FROM (SELECT project, file FROM langstats WHERE code_str_com_non_eng > 20) n WHERE n.project = noneng_manual_tags.project AND n.file = noneng_manual_tags.file) UNION ALL SELECT DISTINCT project, file, true AS noneng FROM langstats WHERE code_str_com_non_eng > 20")
def upserted_tags(t):
    new = t.langstats.where("code_str_com_non_eng > 20").select("project", "file", F.lit(True).alias("noneng")).distinct()
    return sinks.upserted(t.noneng_manual_tags, new, ["project", "file"])


@query("SELECT project, file FROM langstats WHERE project NOT IN (SELECT project FROM projects WHERE NOT processed)")
def purged_stats(t):
    return sinks.purged(t.langstats.select("project", "file"), t.projects.where("not processed"), ["project"])
