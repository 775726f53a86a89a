"""Counting, capping, dictionaries and fractions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import markers, text
from tesserae.operators import bpe, dedup, dictionary, fractions, vocab

from .base import query

_T = "SELECT doc_id, lang, source, unnest(string_split(regexp_replace(text, '\\n$', ''), ' ')) AS token FROM documents"
_VOCAB = f"SELECT token, count(*) AS freq FROM ({_T}) GROUP BY token"


def _tokens(t, *keep):
    return vocab.explode_tokens(t.documents, text.words(F.col("text")), *keep)


def _cap_sql(inner: str, n: int) -> str:
    return f"WITH v AS ({inner}), r AS (SELECT freq, row_number() OVER (ORDER BY freq DESC) AS r FROM v) SELECT token, freq FROM v WHERE freq > coalesce((SELECT freq FROM r WHERE r = {n + 1}), 0)"


@query(_cap_sql(f"SELECT token, count(*) AS freq FROM ({_T}) WHERE doc_id % 1000 >= 0 AND doc_id % 1000 < 1000 GROUP BY token", 5000))
def vocab_top(t):
    """Flagship: fraction, token counts, cap."""
    docs = fractions.in_fraction(t.documents, F.col("doc_id") % 1000, 100)
    v = vocab.vocabulary(vocab.explode_tokens(docs, text.words(F.col("text"))))
    return vocab.cap(v, 5000).orderBy(F.desc("freq"), "token")


@query(_cap_sql(_VOCAB, 50))
def vocab_cap_ties(t):
    return vocab.cap(vocab.vocabulary(_tokens(t)), 50)


@query(f"SELECT source, token, count(*) AS freq FROM ({_T}) GROUP BY source, token")
def vocab_by_source(t):
    return vocab.vocabulary(_tokens(t, "source"), "source")


@query("SELECT split, token, count(*) AS freq FROM (SELECT split, unnest(string_split(regexp_replace(text, '\\n$', ''), ' ')) AS token FROM raw_corpus) GROUP BY split, token")
def vocab_by_split(t):
    return vocab.vocabulary(vocab.explode_tokens(t.raw_corpus, text.words(F.col("text")), "split"), "split")


@query(
    f"WITH t AS ({_T}), f AS (SELECT token, min(doc_id) AS doc_id FROM t GROUP BY token), n AS (SELECT doc_id, count(*) AS new FROM f GROUP BY doc_id), d AS (SELECT DISTINCT doc_id FROM t) "
    "SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n_files, CAST(sum(coalesce(new, 0)) OVER (ORDER BY doc_id) AS BIGINT) AS vocab_size FROM d LEFT JOIN n USING (doc_id)"
)
def vocab_growth(t):
    return vocab.growth(_tokens(t, "doc_id"))


@query(f"SELECT token, freq, row_number() OVER (ORDER BY freq DESC, token) - 1 AS id FROM ({_VOCAB})")
def vocab_ids(t):
    return vocab.numbered(vocab.vocabulary(_tokens(t)))


@query("SELECT token, CAST(sum(freq) AS BIGINT) AS freq FROM partial_vocab WHERE token IS NOT NULL GROUP BY token")
def vocab_merged(t):
    """Partial counters of all files merged."""
    p = t.partial_vocab.where("token is not null")
    return vocab.merge_counts(p.select("token", F.col("freq").cast("bigint").alias("freq")))


@query()
def vocab_size_approx(t):
    """The size of the vocabulary by a sketch of fixed size; a test holds it against the exact one."""
    return t.partial_vocab.agg(F.approx_count_distinct("token", 0.02).alias("size"))


@query("SELECT project, file FROM raw_corpus WHERE TRY_CAST(regexp_extract(project, '^(\\d+)_', 1) AS INT) >= 125 AND TRY_CAST(regexp_extract(project, '^(\\d+)_', 1) AS INT) < 625")
def fraction_filter(t):
    return fractions.in_fraction(t.raw_corpus, fractions.chunk_of(F.col("project")), 50, 12.5).select("project", "file")


@query("SELECT count(*) FILTER (TRY_CAST(regexp_extract(project, '^(\\d+)_', 1) AS INT) < 500) AS files FROM raw_corpus")
def fraction_count(t):
    return fractions.files_in_fraction(t.raw_corpus, fractions.chunk_of(F.col("project")), 50)


_WORD_OF = "lower(regexp_extract(token, '^([^/\t]*)', 1))"


@query(f"WITH w AS (SELECT lang, {_WORD_OF} AS token FROM ({_T})) SELECT DISTINCT token FROM w WHERE lang <> 'en' AND length(token) >= 4 AND token NOT IN (SELECT token FROM w WHERE lang = 'en')")
def noneng_dict(t):
    """The words of dictionary lines in other languages that no English line has."""
    words = _tokens(t, "lang").select("lang", text.dictionary_word(F.col("token")).alias("token"))
    return dictionary.difference(words.where("lang <> 'en'"), words.where("lang = 'en'"))


@query("SELECT token, freq FROM partial_vocab WHERE token IN (SELECT lower(w) FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents WHERE lang = 'en'))")
def token_semi_join(t):
    known = vocab.explode_tokens(t.documents.where("lang = 'en'"), text.lower_words(F.split("text", " ", -1)))
    return dictionary.members(t.partial_vocab, known).select("token", "freq")


@query("SELECT p.project, coalesce(l.url, 'none') AS url FROM (SELECT DISTINCT project FROM projects) p LEFT JOIN (SELECT name AS project, min(url) AS url FROM project_list GROUP BY name) l USING (project)")
def default_lookup(t):
    urls = t.project_list.groupBy(F.col("name").alias("project")).agg(F.min("url").alias("url"))
    return dictionary.looked_up(t.projects.select("project").distinct(), urls, "project", "url", F.lit("none"))


_WORDS = "SELECT token, CAST(sum(freq) AS BIGINT) AS freq FROM partial_vocab WHERE regexp_matches(token, '^[a-z]+$') GROUP BY token"


@query(
    f"WITH v AS ({_WORDS}), a AS (SELECT token AS word FROM v WHERE freq <= 2 AND length(token) >= 8), b AS (SELECT token AS fix FROM v WHERE freq >= 20 AND length(token) >= 7) "
    "SELECT word, fix FROM a JOIN b ON abs(length(word) - length(fix)) <= 1 AND word <> fix AND damerau_levenshtein(word, fix) = 1"
)
def typo_fixes(t):
    """Rare words one edit or one swap of neighbours from a common one."""
    v = vocab.merge_counts(t.partial_vocab.where(F.col("token").rlike("^[a-z]+$")).select("token", F.col("freq").cast("bigint").alias("freq")))
    return dictionary.near_words(v.where("freq <= 2 and length(token) >= 8"), v.where("freq >= 20 and length(token) >= 7"))


@query("SELECT digest, min(doc_id) AS first, count(*) AS copies FROM (SELECT sha256(text) AS digest, doc_id FROM documents WHERE text IS NOT NULL) GROUP BY digest HAVING count(*) > 1")
def dup_groups(t):
    return dedup.groups(t.documents, "text", "doc_id")


@query("SELECT doc_id, lang FROM documents WHERE text IS NULL OR doc_id IN (SELECT min(doc_id) FROM documents WHERE text IS NOT NULL GROUP BY text)")
def dedup_docs(t):
    return dedup.deduplicated(t.documents, "text", "doc_id").select("doc_id", "lang")


@query("SELECT p.project, CASE WHEN l.project IS NULL THEN '' ELSE l.train_test_valid || '/' || p.project || '/' || p.file END AS path, p.file FROM noneng_manual_tags p LEFT JOIN (SELECT project, min(train_test_valid) AS train_test_valid FROM langstats GROUP BY project) l USING (project) ")
def renamed_paths(t):
    split = t.langstats.groupBy("project").agg(F.min("train_test_valid").alias("split"))
    return dedup.renamed(t.noneng_manual_tags.select("project", "file"), split)


@query("SELECT DISTINCT t.project, t.file FROM noneng_manual_tags t SEMI JOIN raw_corpus c ON t.project = c.project AND t.file = c.file")
def existing_tags(t):
    """Tagged files that exist in the corpus."""
    return t.noneng_manual_tags.select("project", "file").distinct().join(t.raw_corpus, ["project", "file"], "left_semi")


def _langs(t, a):
    return _tokens(t, "lang").where(F.col("lang") == a).select("token").distinct()


@query(f"SELECT token FROM ({_T}) WHERE lang = 'de' UNION SELECT token FROM ({_T}) WHERE lang = 'fr'")
def set_union(t):
    return _langs(t, "de").union(_langs(t, "fr")).distinct()


@query(f"SELECT token FROM ({_T}) WHERE lang = 'de' EXCEPT SELECT token FROM ({_T}) WHERE lang = 'en'")
def set_except(t):
    return _langs(t, "de").exceptAll(_langs(t, "en"))


@query(f"SELECT token FROM ({_T}) WHERE lang = 'es' INTERSECT SELECT token FROM ({_T}) WHERE lang = 'pt'")
def set_intersect(t):
    return _langs(t, "es").intersect(_langs(t, "pt"))


@query("SELECT project, max(TRY_CAST(regexp_extract(file, '^mod(\\d+)/', 1) AS INT)) AS latest FROM raw_corpus GROUP BY project")
def latest_numbered(t):
    """The largest number among numbered folders."""
    return t.raw_corpus.groupBy("project").agg(F.max(F.regexp_extract("file", r"^mod(\d+)/", 1).try_cast("int")).alias("latest"))


@query("SELECT token, freq FROM (SELECT token, CAST(sum(freq) AS BIGINT) AS freq FROM partial_vocab GROUP BY token) WHERE token NOT IN (" + ", ".join("'" + s.replace("'", "''") + "'" for s in [*markers.ALL, *markers.TWO_SIGNS, *markers.ONE_SIGN, *markers.ONE_SIGN_VERBOSE, *markers.COMMENT_MARKS, "\t", "\n", "\\t", "\\n", ""]) + ")")
def splittable_vocab(t):
    v = t.partial_vocab.groupBy("token").agg(F.sum("freq").cast("bigint").alias("freq"))
    return bpe.splittable(v)
