"""Cases, contexts, measures, samples, events."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from tesserae.functions import code, markers as M
from tesserae.functions import text
from tesserae.operators import cases, metrics, repr as rendering, sampling, vocab

from tesserae.plans.staging import stage

from .base import query

_MARKS = ", ".join(f"'{m}'" for m in M.LOGGING)


def _rendered(t):
    java = t.raw_corpus.where("file like '%.java' and text is not null").select(F.concat_ws("/", "project", "file").alias("path"), "project", "text").distinct()
    return rendering.rendered(java, ["path", "project"], "101111")


@query(
    "WITH d AS (SELECT doc_id, string_split(text, ' ') AS t FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, t, len(t) // 2 AS i FROM d) "
    f"SELECT doc_id, array_to_string(list_concat(list_transform(range(10 - least(10, i)), lambda x: '<pad>'), t[greatest(i - 9, 1):i]), ' ') AS before, "
    "array_to_string(list_concat(t[i + 2:i + 11], list_transform(range(10 - least(10, greatest(len(t) - i - 1, 0))), lambda x: '<pad>')), ' ') AS after FROM p"
)
def context_windows(t):
    """Ten tokens on each side of the middle of each document."""
    d = t.documents.where("text is not null").select("doc_id", F.split("text", " ", -1).alias("t")).withColumn("i", F.floor(F.size("t") / 2).cast("int"))
    return d.select("doc_id", F.array_join(text.context_before(F.col("t"), F.col("i"), 10), " ").alias("before"), F.array_join(text.context_after(F.col("t"), F.col("i"), 10), " ").alias("after"))


@query("SELECT doc_id, array_to_string(t[greatest(len(t) - 19, 1):len(t)], ' ') AS context, array_to_string(list_reverse(t)[greatest(len(t) - 19, 1):len(t)], ' ') AS backwards FROM (SELECT doc_id, string_split(text, ' ') AS t FROM documents WHERE text IS NOT NULL)")
def prediction_context(t):
    w = F.split("text", " ", -1)
    d = t.documents.where("text is not null")
    return d.select("doc_id", F.array_join(text.prediction_context(w, 20), " ").alias("context"), F.array_join(text.prediction_context(w, 20, True), " ").alias("backwards"))


def _cases(kind):
    def f(t):
        c = cases.cases(_rendered(t), "path", kind, cases.CONTEXT)
        return c.select("path", F.array_join("before", " ").alias("before"), F.array_join("after", " ").alias("after"), "label")

    f.__name__, f.__doc__ = f"cases_{kind}", f"One {kind} case a file, nulls where there is none."
    return query()(f)


for _kind in cases.KINDS:
    _cases(_kind)


@query()
def training_cases(t):
    """Cases of projects that log enough. The rendered corpus is read twice, so it is written once."""
    r = stage(_rendered(t), "rendered")
    low = cases.ignored(cases.coverage(r, "project").where("project is not null"), 10)
    c = cases.cases(r, "path", "level", cases.CONTEXT).withColumn("project", F.substring_index("path", "/", 1))
    return cases.training_rows(c, low, "project").select("path", "label")


_LOGS = f"regexp_matches(text, '\\b(?:{M.LOGGER})\\.(?:{'|'.join(M.METHODS.values())})\\(')"


def _with_logs(t):
    """Files as streams that hold the log marker where a logging call stands."""
    has = F.col("text").rlike(rf"\b(?:{M.LOGGER})\.(?:{'|'.join(M.METHODS.values())})\(")
    return t.raw_corpus.where("text is not null").select("project", F.when(has, F.array(F.lit(M.LOG))).otherwise(F.array().cast("array<string>")).alias("tokens"))


@query(f"SELECT project, count(*) FILTER ({_LOGS}) AS with_logs, count(*) FILTER (NOT {_LOGS}) AS without_logs FROM raw_corpus WHERE text IS NOT NULL GROUP BY ROLLUP (project)")
def log_coverage(t):
    """Files with and without logging calls per project, and in all."""
    return cases.coverage(_with_logs(t), "project")


@query(f"SELECT project FROM raw_corpus WHERE text IS NOT NULL GROUP BY ROLLUP (project) HAVING count(*) FILTER ({_LOGS}) / count(*) <= 0.25")
def ignored_projects(t):
    """Projects, and null for all of them, in which few files log."""
    return cases.ignored(cases.coverage(_with_logs(t), "project"), 25).select("project")


@query()
def full_words(t):
    """Full words of the rendered corpus: positions per file."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, tokens in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ranges, rest = code.full_words(tokens)
                rows.append((path, len(ranges), len(tokens) - rest))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], x) for i, x in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "words", "left"])

    return _rendered(t).select("path", "tokens").mapInArrow(run, "path string, words bigint, left bigint")


@query(
    "WITH o AS (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_quantity, l_partkey) AS q FROM lineitem GROUP BY l_orderkey) "
    "SELECT l_orderkey, round(list_sum(q) / len(q), 6) AS subtoken, round(list_sum(q) / CASE WHEN len(q) > 2 THEN 2 ELSE 1 END, 6) AS word, round(CASE WHEN len(q) > 2 THEN list_sum(q[1:2]) ELSE list_sum(q) END, 6) AS first_word FROM o"
)
def entropies(t):
    """Subtoken and word means and the first word's entropy; an order's lines are the subtokens, a word ends after the second."""
    o = t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_partkey"))).alias("s")).select("l_orderkey", F.transform("s", lambda x: x.l_quantity).alias("q"))
    bounds = F.when(F.size("q") > 2, F.array(F.lit(0), F.lit(2), F.size("q"))).otherwise(F.array(F.lit(0), F.size("q")))
    return o.select("l_orderkey", F.round(metrics.subword_average(F.col("q")), 6).alias("subtoken"), F.round(metrics.word_average(F.col("q"), bounds), 6).alias("word"), F.round(F.element_at(metrics.word_entropies(F.col("q"), bounds), 1), 6).alias("first_word"))


@query(
    "WITH h AS (SELECT l_returnflag, l_orderkey, CAST(l_quantity % 5 = l_tax * 100 % 5 AS INT) AS hit FROM lineitem), w AS (SELECT l_returnflag, l_orderkey, min(hit) AS strict, avg(hit) AS mean FROM h GROUP BY ALL) SELECT l_returnflag, round(avg(strict), 6) AS strict, round(avg(mean), 6) AS mean FROM w GROUP BY l_returnflag"
)
def subword_accuracy(t):
    df = t.lineitem.select("l_returnflag", "l_orderkey", (F.col("l_quantity") % 5).alias("p"), (F.col("l_tax") * 100 % 5).alias("y"))
    return metrics.subword_accuracy(df, "l_returnflag", "l_orderkey", "p", "y")


@query("SELECT event_type, round(avg(CAST(r <= 1 AS INT)), 6) AS top_1, round(avg(CAST(r <= 3 AS INT)), 6) AS top_3, round(avg(1 / r), 6) AS mrr FROM (SELECT event_type, user_id % 10 + 1 AS r FROM events) GROUP BY event_type")
def top_k(t):
    return metrics.top_k(t.events.select("event_type", (F.col("user_id") % 10 + 1).alias("r")), "r", [1, 3], "event_type")


@query("SELECT round(sum(l_tax * l_quantity) / sum(l_quantity), 6) AS l_tax, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS l_discount FROM lineitem")
def weighted_loss(t):
    return metrics.weighted_average(t.lineitem, "l_quantity", "l_tax", "l_discount")


@query("SELECT round(-avg(ln((l_discount + 0.01) / 1.2)), 6) AS cross_entropy FROM lineitem")
def cross_entropy(t):
    return metrics.cross_entropy(t.lineitem.select(((F.col("l_discount") + 0.01) / 1.2).alias("p")), "p")


@query("SELECT i - 1 AS index, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS mean FROM embeddings, range(1, 65) r(i) WHERE embedding IS NOT NULL GROUP BY i")
def vector_mean(t):
    return metrics.vector_mean(t.embeddings, "embedding").withColumn("index", F.col("index").cast("bigint"))


@query(
    "WITH n AS (SELECT a.vec_id AS t, a.label AS y, b.label AS yi, exp(0.5 * list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))) AS w FROM embeddings a JOIN embeddings b ON b.vec_id BETWEEN a.vec_id - 5 AND a.vec_id - 1) "
    "SELECT t, round(sum(CASE WHEN y = yi THEN w ELSE 0 END) / sum(w), 6) AS cache FROM n GROUP BY t"
)
def neural_cache(t):
    return metrics.neural_cache(t.embeddings, "vec_id", "embedding", "label", 5, 0.5)


@query(
    "WITH d AS (SELECT CAST(date_trunc('day', ts) AS DATE) AS day, round(avg(value), 6) AS loss FROM events GROUP BY 1), b AS (SELECT day, loss, min(loss) OVER (ORDER BY day) AS best, row_number() OVER (ORDER BY day) AS n FROM d), "
    "s AS (SELECT *, n - max(CASE WHEN loss = best THEN n END) OVER (ORDER BY day) AS since FROM b), f AS (SELECT min(n) AS f FROM s WHERE since >= 5) SELECT day, loss, best, since, coalesce(n >= f, false) AS stopped FROM s, f"
)
def early_stop(t):
    d = t.events.groupBy(F.to_date("ts").alias("day")).agg(F.avg("value").alias("loss"))
    return metrics.early_stop(d, "day", "loss", 5)


_LOW = "SELECT DISTINCT token FROM partial_vocab WHERE regexp_matches(token, '^[a-z]+$')"


def _low(t):
    return t.partial_vocab.where(F.col("token").rlike("^[a-z]+$")).select("token").distinct()


@query(
    f"WITH n AS (SELECT length(token) AS length, count(*) AS n FROM ({_LOW}) GROUP BY 1), s AS (SELECT *, pow(ln(n), 5) AS s FROM n), u AS (SELECT *, CAST(ceil(round(s / sum(s) OVER () * 1000, 9)) AS BIGINT) AS up FROM s), "
    "r AS (SELECT *, sum(up) OVER () - 1000 AS excess, row_number() OVER (ORDER BY up DESC, length) AS r FROM u) SELECT length, n, CAST(up - CASE WHEN r <= excess THEN 1 ELSE 0 END AS BIGINT) AS quota FROM r"
)
def length_quotas(t):
    return sampling.length_quotas(_low(t))


@query()
def stratified_words(t):
    w = _low(t)
    return sampling.stratified(w, sampling.length_quotas(w))


@query()
def sampled_words(t):
    """A seeded sample of 100 words: the same on any cluster."""
    return sampling.sample(_low(t), 100, "token")


@query("SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(t):
    w = t.events.groupBy(F.window("ts", "10 minutes").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n")


@query(
    "WITH p AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), "
    "s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM p) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s"
)
def event_sessions(t):
    w = t.events.groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("w.start").alias("start"), "n")


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ROLLUP (event_type)")
def event_rollup(t):
    return t.events.rollup("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("SELECT project, count(*) AS files, CAST(sum(len(string_split(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '\\n$', ''), chr(10)))) AS BIGINT) AS lines FROM raw_corpus WHERE text IS NOT NULL GROUP BY project")
def line_counts(t):
    return t.raw_corpus.where("text is not null").groupBy("project").agg(F.count("*").alias("files"), F.sum(F.size(text.lines(F.col("text")))).alias("lines"))


@query("SELECT file, array_to_string(string_split(file, '/')[greatest(len(string_split(file, '/')) - 1, 1):], '/') AS short FROM (SELECT DISTINCT file FROM raw_corpus)")
def short_paths(t):
    return t.raw_corpus.select("file").distinct().select("file", text.last_levels(F.col("file")).alias("short"))
