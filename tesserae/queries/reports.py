"""Reports, batches, samples to be labelled, and small functions of token lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import markers as M
from tesserae.functions import text
from tesserae.operators import cases, langstats, metrics, repr as rendering, sampling, vocab

from .base import query

_T = "SELECT doc_id, unnest(string_split(regexp_replace(text, '\\n$', ''), ' ')) AS token FROM documents"
_GROWTH = (
    f"WITH t AS ({_T}), f AS (SELECT token, min(doc_id) AS doc_id, bool_or(regexp_matches(token, '[^\\x00-\\x7F]')) AS foreign_word FROM t GROUP BY token), "
    "n AS (SELECT doc_id, count(*) AS new, count(*) FILTER (foreign_word) AS bad FROM f GROUP BY doc_id), d AS (SELECT DISTINCT doc_id FROM t), "
    "g AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n_files, CAST(sum(coalesce(new, 0)) OVER (ORDER BY doc_id) AS BIGINT) AS vocab_size, CAST(sum(coalesce(bad, 0)) OVER (ORDER BY doc_id) AS BIGINT) AS non_eng FROM d LEFT JOIN n USING (doc_id)) "
)


def _growth(t):
    tokens = vocab.explode_tokens(t.documents, text.words(F.col("text")), "doc_id")
    return vocab.foreign_growth(tokens.withColumn("foreign", text.non_ascii(F.col("token"))))


@query(_GROWTH + "SELECT doc_id, n_files, vocab_size, non_eng FROM g")
def foreign_growth(t):
    return _growth(t)


@query(
    _GROWTH + ", e AS (SELECT max(n_files) AS files, max(vocab_size) AS size FROM g) SELECT CAST(0 AS BIGINT) AS place, CAST(size AS VARCHAR) AS line FROM e "
    "UNION ALL SELECT n_files, printf('%.4f', n_files / files) || chr(9) || printf('%.4f', vocab_size / size) || chr(9) || printf('%.4f', non_eng / vocab_size) FROM g, e"
)
def vocab_size_report(t):
    return vocab.size_report(_growth(t))


@query(f"WITH v AS (SELECT DISTINCT token FROM ({_T})) SELECT token, CAST(length(token) AS INT) AS length, row_number() OVER (ORDER BY length(token), encode(token)) - 1 AS place FROM v")
def words_by_length(t):
    return vocab.by_length(vocab.explode_tokens(t.documents, text.words(F.col("text"))).distinct())


@query(f"SELECT doc_id, CAST(generate_subscripts(t, 1) - 1 AS INT) AS position, unnest(t) AS token FROM (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), ' ') AS t FROM documents WHERE text IS NOT NULL)")
def token_positions(t):
    return vocab.positions(t.documents.where("text is not null"), "doc_id", text.words(F.col("text")))


_LINE = "string_split(regexp_replace(line, '^\\s+', ''), ' ')"
_CONTEXTS = "CASE WHEN regexp_matches(line, '^\\s*(//|/?[*]|#)') THEN 'comment' WHEN contains(line, '\"') THEN 'string' END"
_STATS = ", ".join(
    f"CAST(sum({n}) AS BIGINT) AS {c}_total, count(*) FILTER ({n} > 0) AS {c}_total_uq, CAST(sum(CASE WHEN f THEN {n} ELSE 0 END) AS BIGINT) AS {c}_non_eng, count(*) FILTER (f AND {n} > 0) AS {c}_non_eng_uq, "
    f"round(coalesce(sum(CASE WHEN f THEN {n} ELSE 0 END) / nullif(sum({n}), 0), 0), 6) AS {c}_percent, round(coalesce(count(*) FILTER (f AND {n} > 0) / nullif(count(*) FILTER ({n} > 0), 0), 0), 6) AS {c}_percent_uq"
    for c, n in (("code", "c0"), ("code_str", "(c0 + c1)"), ("code_str_com", "(c0 + c1 + c2)"))
)


@query(
    "WITH l AS (SELECT project, file, unnest(string_split(text, chr(10))) AS line FROM raw_corpus WHERE text IS NOT NULL), "
    f"t AS (SELECT project, file, {_CONTEXTS} AS ctx, unnest(string_split(line, ' ')) AS token FROM l), "
    "e AS (SELECT project, file, token, regexp_matches(token, '[^\\x00-\\x7F]') AS f, count(*) FILTER (ctx IS NULL) AS c0, count(*) FILTER (ctx = 'string') AS c1, count(*) FILTER (ctx = 'comment') AS c2 FROM t GROUP BY ALL) "
    f"SELECT project, file, {_STATS} FROM e GROUP BY project, file"
)
def lang_stats_by_line(t):
    """The three readings of each file, lines taken whole: a line that begins a comment, one with a string, or code."""
    lines = t.raw_corpus.where("text is not null").select("project", "file", F.explode(F.split("text", "\n", -1)).alias("line"))
    ctx = F.when(F.col("line").rlike(r"^\s*(//|/?[*]|#)"), "comment").when(F.contains("line", F.lit('"')), "string")
    tokens = lines.select("project", "file", ctx.alias("ctx"), F.explode(F.split("line", " ", -1)).alias("token"))
    return langstats.by_context(tokens.withColumn("foreign", text.non_ascii(F.col("token"))), "project", "file")


@query()
def lang_stats_by_parser(t):
    """The three readings of each Java file, by the parser's contexts and its foreign marks."""
    java = t.raw_corpus.where("file like '%.java' and text is not null")
    return langstats.of_files(rendering.per_file(java, ["project", "file"], langstats.word_counts, langstats.WORD_COUNTS), "project", "file")


_W = "SELECT DISTINCT token FROM partial_vocab WHERE regexp_matches(token, '^[a-z]{{{}}}$')"


@query(f"SELECT w.token, coalesce(l.known, w.token) AS label FROM ({_W.format('8,9')}) w LEFT JOIN (SELECT token, min(regexp_replace(token, '^(...)', '\\1|')) AS known FROM ({_W.format('9')}) GROUP BY token) l USING (token)")
def labelled_sample(t):
    """Words to be split by hand; those of nine letters have a label already."""
    words = lambda n: t.partial_vocab.where(F.col("token").rlike(f"^[a-z]{{{n}}}$")).select("token")
    return sampling.labelled(words("8,9"), words("9").withColumn("label", F.regexp_replace("token", "^(...)", "$1|")))


@query(
    "WITH a AS (SELECT length(token) AS length, count(*) AS a FROM partial_vocab WHERE chunk % 2 = 0 AND token IS NOT NULL GROUP BY 1), b AS (SELECT length(token) AS length, count(*) AS b FROM partial_vocab WHERE chunk % 2 = 1 AND token IS NOT NULL GROUP BY 1) "
    "SELECT CAST(length AS INT) AS length, coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce(a, 0) - coalesce(b, 0) AS difference FROM a FULL JOIN b USING (length)"
)
def length_difference(t):
    half = lambda n: t.partial_vocab.where((F.col("chunk") % 2 == n) & F.col("token").isNotNull())
    return sampling.length_difference(half(0), half(1))


@query("SELECT vec_id, array_to_string(list_transform(list_sort(list_transform(range(len(embedding)), lambda i: {'n': -CAST(embedding[i + 1] AS DOUBLE), 'i': i}))[1:3], lambda x: x.i), ' ') AS top FROM embeddings WHERE embedding IS NOT NULL")
def top_of_row(t):
    top = metrics.top_of(F.col("embedding"), 3)
    return t.embeddings.where("embedding is not null").select("vec_id", F.array_join(F.transform(top, lambda x: x["index"].cast("string")), " ").alias("top"))


@query("SELECT event_id, round(0.3 * (value - floor(value)) + 0.7 * (user_id % 10 / 10), 6) AS p FROM events")
def mixed_probability(t):
    return t.events.select("event_id", F.round(metrics.mixed(F.col("value") - F.floor("value"), F.col("user_id") % 10 / 10, 0.3), 6).alias("p"))


@query("SELECT round(avg(CAST(r <= 1 AS INT)), 6) AS top_1, round(avg(CAST(r <= 5 AS INT)), 6) AS top_5 FROM (SELECT user_id % 10 + 1 AS r FROM events WHERE event_type = 'click')")
def top_k_by_name(t):
    return metrics.top_k_of(t.events.withColumn("r", F.col("user_id") % 10 + 1), "topk_1_5_cat_click", "r", "event_type")


@query("SELECT event_type, count(*) AS calls, max(value) AS longest, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def step_profile(t):
    return metrics.profile(t.events, "event_type", "value")


@query(
    f"WITH d AS (SELECT doc_id, string_split(text, ' ') AS t FROM documents WHERE text IS NOT NULL), r AS (SELECT doc_id, t, (row_number() OVER (ORDER BY len(t), doc_id) - 1) // 32 AS batch FROM d), w AS (SELECT batch, max(len(t)) AS width FROM r GROUP BY batch) "
    f"SELECT doc_id, array_to_string(list_concat(t, list_transform(range(width - len(t)), lambda i: '{M.PAD}')), ' ') AS tokens, batch, CAST(width AS INT) AS width FROM r JOIN w USING (batch)"
)
def padded_batches(t):
    d = t.documents.where("text is not null").select("doc_id", F.split("text", " ", -1).alias("tokens"))
    return cases.batches(d, "doc_id", "tokens", 32).withColumn("tokens", text.joined(F.col("tokens")))


_SPLIT = "string_split(text, ' ')"


@query(f"SELECT doc_id, array_to_string(list_concat({_SPLIT}[1:2], ['<var>', '<var>'], {_SPLIT}[6:]), ' ') AS shown FROM documents WHERE len({_SPLIT}) >= 5")
def replaced_segments(t):
    d = t.documents.select("doc_id", F.split("text", " ", -1).alias("t")).where(F.size("t") >= 5)
    return d.select("doc_id", text.joined(text.replace_segment(F.col("t"), F.lit(2), F.lit(5), F.array(F.lit(M.VAR), F.lit(M.VAR)))).alias("shown"))


@query(
    f"WITH w AS (SELECT doc_id, CAST(generate_subscripts(t, 1) AS INT) AS i, unnest(t) AS token FROM (SELECT doc_id, {_SPLIT} AS t FROM documents WHERE text IS NOT NULL)), f AS (SELECT doc_id, token, min(i) AS i FROM w GROUP BY doc_id, token) "
    "SELECT doc_id, array_to_string(list(token ORDER BY i), ' ') AS shown FROM f GROUP BY doc_id"
)
def distinct_tokens(t):
    return t.documents.where("text is not null").select("doc_id", text.joined(text.without_duplicates(F.split("text", " ", -1))).alias("shown"))


@query("SELECT DISTINCT lower(w) AS form FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents)")
def checked_forms(t):
    w = t.documents.select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), 1)).alias("w"))
    return w.select(text.checked_form(F.lower("w")).alias("form")).distinct()
