"""Token functions, segments, logging, rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import code, markers as M
from tesserae.functions import text
from tesserae.operators import bpe, compare, repr as rendering, splitter, vocab
from tesserae.operators.config import MERGES, Code, SplitConfig
from tesserae.plans.staging import stage

from .base import query

_SQ = text.CODE_TOKEN.replace("'", "''")
_WORDS = "SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS word FROM documents"


def _words(t):
    return t.documents.select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z_][A-Za-z0-9_]*)"), 1)).alias("word")).distinct()


@query(
    "WITH p AS (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(text, ' {4}', '\t', 'g'), '(/\\*|\\*/)', chr(1) || '\\1' || chr(1), 'g'), chr(1))) AS piece FROM documents), "
    f"t AS (SELECT doc_id, unnest(CASE WHEN piece IN ('/*', '*/') THEN [piece] ELSE regexp_extract_all(piece, '{_SQ}', 1) END) AS token FROM p) SELECT token, count(*) AS freq FROM t GROUP BY token"
)
def code_tokens(t):
    """Delimiter split of whole texts, as token counts."""
    return vocab.vocabulary(vocab.explode_tokens(t.documents, text.code_tokens(F.col("text"))))


@query(
    "WITH p AS (SELECT unnest(string_split(regexp_replace(regexp_replace(text, ' {4}', '\t', 'g'), '(/\\*|\\*/)', chr(1) || '\\1' || chr(1), 'g'), chr(1))) AS piece FROM documents) "
    f"SELECT piece_token AS token, count(*) AS freq FROM (SELECT unnest(CASE WHEN piece IN ('/*', '*/') THEN [piece] ELSE regexp_extract_all(piece, '{text.SHORT_TOKEN.replace(chr(39), chr(39) * 2)}', 1) END) AS piece_token FROM p) GROUP BY ALL"
)
def short_tokens(t):
    """The split that leaves brackets and points inside words."""
    return vocab.vocabulary(vocab.explode_tokens(t.documents, text.code_tokens(F.col("text"), text.SHORT_TOKEN)))


@query(
    f"WITH w AS ({_WORDS}) SELECT word, array_to_string(regexp_extract_all(regexp_replace(regexp_replace(word, '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '_|[0-9]+|[A-Z]?[a-z]+|[A-Z]+'), ' ') AS parts FROM w"
)
def split_identifiers(t):
    return _words(t).select("word", F.array_join(text.identifier_parts(F.col("word")), " ").alias("parts"))


@query(
    f"WITH w AS ({_WORDS}), k AS (SELECT word, CASE WHEN lower(word) <> upper(word) AND word = lower(word) THEN 'none' WHEN lower(word) <> upper(word) AND word = upper(word) THEN 'all' "
    "WHEN word[1] = upper(word[1]) AND word[1] <> lower(word[1]) THEN 'first' ELSE 'undefined' END AS kind FROM w) "
    "SELECT word, kind, CASE kind WHEN 'all' THEN lower(word) WHEN 'first' THEN lower(word[1]) || word[2:] ELSE word END AS form, "
    "CASE kind WHEN 'all' THEN word WHEN 'first' THEN word[1] || lower(word[2:]) ELSE word END AS restored FROM k"
)
def canonical_words(t):
    w = F.col("word")
    k = _words(t).select("word", text.capitalization(w).alias("kind"), text.canonical(w).alias("form"))
    return k.select("*", text.restore_case(F.col("form"), F.col("kind")).alias("restored"))


_NUM = M.NUMBER


@query(f"WITH w AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM documents) SELECT word FROM w WHERE regexp_full_match(word, '{_NUM}')")
def number_words(t):
    w = t.documents.select(F.explode(F.split("text", " ", -1)).alias("word")).distinct()
    return w.where(text.is_number(F.col("word")))


@query(
    f"WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '0x[0-9a-fA-F]+L?|[0-9]+\\.[0-9]+[fF]?|[0-9]+[lL]?')) AS number FROM raw_corpus) SELECT number, array_to_string(list_concat(CASE WHEN starts_with(number, '0x') THEN ['0x'] ELSE [] END, "
    "list_transform(string_split(regexp_replace(number, '^0x', ''), ''), lambda c: CASE WHEN c IN ('l', 'L') THEN 'l' WHEN NOT starts_with(number, '0x') AND c IN ('f', 'F', 'd', 'D', 'e', 'E') THEN lower(c) ELSE c END)), ' ') AS parts FROM w"
)
def number_parts(t):
    w = t.raw_corpus.select(F.explode(F.regexp_extract_all("text", F.lit(r"(0x[0-9a-fA-F]+L?|[0-9]+\.[0-9]+[fF]?|[0-9]+[lL]?)"), 1)).alias("number")).distinct()
    return w.select("number", F.array_join(text.number_parts(F.col("number")), " ").alias("parts"))


@query(
    "WITH f AS (SELECT array_agg(token) AS f FROM (SELECT token FROM partial_vocab WHERE regexp_matches(token, '^[0-9]') GROUP BY token HAVING sum(freq) >= 50)), w AS (SELECT DISTINCT token FROM partial_vocab WHERE token IS NOT NULL) "
    "SELECT token, CASE WHEN list_contains(f, token) THEN token WHEN regexp_full_match(token, '[0-9]+') THEN '<decnumber>' WHEN regexp_full_match(token, '0x[0-9]+') THEN '<hexnumber>' WHEN regexp_full_match(token, '[0-9]+[l|L]') THEN '<longnumber>' ELSE token END AS shown FROM w, f"
)
def infrequent_numbers(t):
    """Rare numbers by kind: one sum a term, which is kept where it is frequent."""
    p = t.partial_vocab.where("token is not null").groupBy("token").agg(F.sum("freq").alias("n"))
    keep = F.col("token").rlike("^[0-9]") & (F.col("n") >= 50)
    return p.select("token", text.mask_number(F.col("token"), F.when(keep, F.array("token")).otherwise(F.array().cast("array<string>"))).alias("shown"))


@query(
    "SELECT doc_id, regexp_replace(regexp_replace(text, '\\{\\}', '<var>', 'g'), '%[0-9]*[a-z]', '<var>', 'g') AS shown, "
    "len(string_split(regexp_replace(regexp_replace(text, '\\{\\}', '<var>', 'g'), '%[0-9]*[a-z]', '<var>', 'g'), '<var>')) AS pieces FROM documents WHERE text IS NOT NULL"
)
def format_variables(t):
    v = text.variables(F.col("text"))
    return t.documents.where("text is not null").select("doc_id", v.alias("shown"), F.size(F.filter(text.around_variables(F.col("text")), lambda p: p != M.VAR)).cast("bigint").alias("pieces"))


@query("WITH w AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM documents) SELECT word, regexp_replace(word, '^([0-9a-zA-Z]+\\.)+[0-9a-zA-Z]+$', '<str_res>') AS shown FROM w")
def resource_names(t):
    w = t.documents.select(F.explode(F.split("text", " ", -1)).alias("word")).distinct()
    return w.select("word", text.string_resource(F.col("word")).alias("shown"))


_STOP = ", ".join(f"'{w}'" for w in M.STOP_WORDS)


@query(f"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, ' '), lambda w: lower(w)), lambda w: w NOT IN ({_STOP})), ' ') AS shown FROM documents WHERE text IS NOT NULL")
def stop_words(t):
    w = text.without_stop_words(text.lower_words(F.split("text", " ", -1)))
    return t.documents.where("text is not null").select("doc_id", F.array_join(w, " ").alias("shown"))


@query("SELECT doc_id, array_to_string(list_reverse(string_split(text, ' ')), ' ') AS shown FROM documents WHERE text IS NOT NULL")
def reversed_lines(t):
    return t.documents.where("text is not null").select("doc_id", F.array_join(F.reverse(F.split("text", " ", -1)), " ").alias("shown"))


_CODE_LIST = (
    "flatten(list_transform(string_split(regexp_replace(regexp_replace(text, ' {4}', '\t', 'g'), '(/\\*|\\*/)', chr(1) || '\\1' || chr(1), 'g'), chr(1)), "
    f"lambda piece: CASE WHEN piece IN ('/*', '*/') THEN [piece] ELSE regexp_extract_all(piece, '{_SQ}', 1) END))"
)


@query(
    f"WITH l AS (SELECT project, file, array_to_string({_CODE_LIST}, chr(1)) || chr(1) AS j, len({_CODE_LIST}) AS n FROM raw_corpus WHERE text IS NOT NULL) "
    "SELECT project, file, CASE WHEN n = 0 THEN '' ELSE array_to_string(list_transform(regexp_extract_all(j, '((?:\t\x01)+|[^\x01]*\x01)', 1), lambda r: CASE WHEN starts_with(r, chr(9) || chr(1)) THEN chr(9) || (length(r) // 2) ELSE replace(r, chr(1), '') END), ' ') END AS shown FROM l"
)
def merged_tabs(t):
    """Runs of tabs as one token, in each file's delimiter split."""
    return t.raw_corpus.where("text is not null").select("project", "file", F.array_join(text.merge_tabs(text.code_tokens(F.col("text"))), " ").alias("shown"))


@query("SELECT project, file, replace(replace(replace(replace(text, '\\', '\\\\'), chr(10), '\\n'), chr(9), '\\t'), chr(13), '\\r') || ' ``' || chr(10) AS line FROM raw_corpus WHERE text IS NOT NULL")
def escaped_lines(t):
    return t.raw_corpus.where("text is not null").select("project", "file", text.escape_line(F.array("text")).alias("line"))


_KEPT = ", ".join("'" + s.replace("'", "''") + "'" for s in [*M.KEYWORDS, *M.COMMENT_MARKS, *M.TWO_SIGNS, *M.ONE_SIGN, *M.ONE_SIGN_VERBOSE, "\t", "\n", *M.ALL, *(f"\t{i}" for i in range(11))])


@query(
    f"WITH t AS (SELECT unnest({_CODE_LIST}) AS token FROM raw_corpus WHERE file LIKE '%.java') "
    f"SELECT CASE WHEN regexp_full_match(token, '{_NUM}') OR token IN ({_KEPT}) THEN token ELSE '{M.IDENTIFIER}' END AS token, count(*) AS freq FROM t GROUP BY 1"
)
def masked_identifiers(t):
    """Counts of what is left when identifiers are masked."""
    tokens = text.mask_identifiers(text.code_tokens(F.col("text")))
    return vocab.vocabulary(vocab.explode_tokens(t.raw_corpus.where("file like '%.java'"), tokens))


_METHODS = "|".join(M.METHODS.values())
_LEVEL = "CASE " + " ".join(f"WHEN regexp_full_match(m, '{rx}') THEN '{k}'" for k, rx in M.METHODS.items()) + " ELSE 'unknown' END"


@query(
    f"WITH c AS (SELECT project, unnest(regexp_extract_all(text, '\\b(?:{M.LOGGER})\\.([a-zA-Z]+)\\(', 1)) AS m FROM raw_corpus), l AS (SELECT project, {_LEVEL} AS level FROM c) "
    "SELECT project, level, level IN ('trace', 'debug', 'info') AS positive, count(*) AS calls FROM l WHERE level <> 'unknown' GROUP BY ALL"
)
def log_levels(t):
    c = t.raw_corpus.select("project", F.explode(F.regexp_extract_all("text", F.lit(rf"\b(?:{M.LOGGER})\.([a-zA-Z]+)\("), 1)).alias("m"))
    level = c.select("project", text.log_level(F.col("m")).alias("level")).where("level <> 'unknown'")
    return level.select("project", "level", text.positive_level(F.col("level")).alias("positive")).groupBy("project", "level", "positive").agg(F.count("*").alias("calls"))


def _java(t):
    return t.raw_corpus.where("file like '%.java' and text is not null")


@query()
def log_statements(t):
    """Logging statements of the parser: level and length of each."""
    p = rendering.per_file(_java(t), ["project", "file"], lambda tokens: rendering.runs(tokens, "level", "log_id"), {"level": "string", "log_id": "int", "n": "bigint"})
    return p.groupBy("project", "file", "log_id").agg(F.min("level").alias("level"), F.sum("n").alias("tokens"))


@query()
def text_segments(t):
    """Comments and string literals per file."""
    p = rendering.per_file(_java(t), ["project", "file"], lambda tokens: rendering.runs(tokens, "ctx", "ctx_id"), {"kind": "string", "ctx_id": "int", "n": "bigint"})
    return p.groupBy("project", "file", "kind").agg(F.count_distinct("ctx_id").alias("segments"), F.sum("n").alias("tokens"))


@query()
def loggable_blocks(t):
    p = rendering.per_file(_java(t), ["project", "file"], lambda tokens: rendering.runs(tokens, "block_id"), {"block_id": "int", "n": "bigint"})
    return p.groupBy("project", "file").agg(F.count_distinct("block_id").alias("blocks"), F.sum("n").alias("tokens"))


def _foreign(tokens):
    marks = [code.is_foreign(x) for x in tokens if x.kind == "ident"]
    return [(len(marks), sum(marks))] if marks else []


@query()
def foreign_marks(t):
    """Identifier parts outside English per file."""
    p = rendering.per_file(_java(t), ["project", "file"], _foreign, {"identifiers": "bigint", "non_eng": "bigint"})
    return p.groupBy("project", "file").agg(F.sum("identifiers").alias("identifiers"), F.sum("non_eng").alias("non_eng"))


def _render(digits, split=None):
    def f(t):
        r = rendering.rendered(_java(t), ["project", "file"], digits, split)
        return vocab.vocabulary(vocab.explode_tokens(r, F.col("tokens")))

    f.__name__, f.__doc__ = f"render_{digits}", f"Token counts of the corpus rendered as {digits}."
    return query()(f)


for _code in ("000000", "101110", "021101", "011101", "001101", "102111", "203111", "003111", "123111", "301011", "002010"):
    _render(_code)


@query()
def render_104111(t):
    """Rendered with byte pairs learnt from the corpus' own words, as many as the code's split digit says."""
    merges = bpe.learn(_lower_vocab(t), MERGES[Code.parse("104111").split])
    ranks = {(r["left"], r["right"]): r["rank"] for r in merges.collect()}
    return rendering.rendered_vocabulary(_java(t), "104111", SplitConfig("bpe", merges=ranks))


@query()
def readable_lines(t):
    r = rendering.rendered(_java(t), ["project", "file"], "101111")
    return rendering.readable(r.select("project", "file", F.array_join("tokens", " ").alias("text")), ["project", "file"])


@query()
def identifier_comparison(t):
    """Each identifier under several codes, one column a code."""
    codes = ["000000", "001000", "101111"]
    words = _words(t).select("word", F.col("word").alias("text"))
    shown = lambda c: F.array_join(F.filter(f"c{c}", lambda x: x != "\n"), " ").alias(f"c{c}")
    return rendering.rendered_as(words, ["word"], codes).select("word", *map(shown, codes))


_LOW = "SELECT token, CAST(sum(freq) AS BIGINT) AS freq FROM partial_vocab WHERE regexp_matches(token, '^[a-z]+$') GROUP BY token"


def _lower_vocab(t):
    return t.partial_vocab.where(F.col("token").rlike("^[a-z]+$")).groupBy("token").agg(F.sum("freq").cast("bigint").alias("freq"))


_PAIRS = "SELECT s[i] AS \"left\", s[i + 1] AS \"right\", freq FROM (SELECT string_split(token, '') AS s, freq, unnest(range(1, length(token))) AS i FROM ({v}))"


@query(f"SELECT \"left\", \"right\", CAST(sum(freq) AS BIGINT) AS freq FROM ({_PAIRS.format(v=_LOW)}) GROUP BY ALL")
def pair_stats(t):
    return bpe.pair_statistics(bpe.symbols(_lower_vocab(t)))


@query(
    f"WITH p AS (SELECT \"left\", \"right\", CAST(sum(freq) AS BIGINT) AS freq FROM ({_PAIRS.format(v=_LOW)}) GROUP BY ALL), b AS (SELECT \"left\" || \"right\" AS pair FROM p ORDER BY freq DESC, \"left\", \"right\" LIMIT 1) "
    f"SELECT token, regexp_replace(replace(token, b.pair, '|' || b.pair || '|'), '\\|+', '|', 'g') AS shown FROM ({_LOW}) v, b"
)
def bpe_first_merge(t):
    """The first merge applied to every word."""
    words = bpe.symbols(_lower_vocab(t))
    top = bpe.pair_statistics(words).orderBy(F.desc("freq"), "left", "right").first()
    merged = bpe.merge_pair(words, top["left"], top["right"]) if top else words
    pair = top["left"] + top["right"] if top else ""
    shown = F.array_join(F.transform("symbols", lambda s: F.when(s == pair, F.concat(F.lit("|"), s, F.lit("|"))).otherwise(s)), "")
    return merged.select("token", F.regexp_replace(shown, r"\|+", "|").alias("shown"))


@query()
def bpe_learn(t):
    return bpe.learn(_lower_vocab(t), 500)


@query()
def bpe_encode(t):
    v = stage(_lower_vocab(t), "vocab")
    return bpe.encode(v, bpe.learn(v, 500)).select("token", F.array_join("subwords", " ").alias("subwords"))


@query()
def bpe_result_vocab(t):
    v = stage(_lower_vocab(t), "vocab")
    return bpe.subword_vocabulary(bpe.encode(v, bpe.learn(v, 500)), v)


_HALF = "SELECT token, CAST(sum(freq) AS BIGINT) AS freq FROM partial_vocab WHERE regexp_matches(token, '^[a-z]+$') AND chunk % 2 = {n} GROUP BY token"
_P = "SELECT \"left\", \"right\", CAST(sum(freq) AS BIGINT) AS freq FROM (" + _PAIRS + ") GROUP BY ALL"


def _half(t, n):
    v = t.partial_vocab.where(F.col("token").rlike("^[a-z]+$") & (F.col("chunk") % 2 == n)).groupBy("token").agg(F.sum("freq").cast("bigint").alias("freq"))
    return bpe.pair_statistics(bpe.symbols(v))


@query(f"WITH a AS ({_P.format(v=_HALF.format(n=0))}), b AS ({_P.format(v=_HALF.format(n=1))}) SELECT round(corr(coalesce(a.freq, 0), coalesce(b.freq, 0)), 6) AS pearson FROM a FULL JOIN b ON a.\"left\" = b.\"left\" AND a.\"right\" = b.\"right\"")
def merge_lists_corr(t):
    return compare.correlation(_half(t, 0), _half(t, 1))


_SPLITS = "SELECT split AS list, \"left\", \"right\", CAST(sum(freq) AS BIGINT) AS freq FROM (SELECT split, s[i] AS \"left\", s[i + 1] AS \"right\", freq FROM (SELECT split, string_split(token, '') AS s, freq, unnest(range(1, length(token))) AS i FROM (SELECT c.split, p.token, sum(p.freq) AS freq FROM partial_vocab p JOIN (SELECT DISTINCT split, project, file FROM raw_corpus) c USING (project, file) WHERE regexp_matches(p.token, '^[a-z]+$') GROUP BY ALL))) GROUP BY ALL"


def _lists(t):
    v = t.partial_vocab.where(F.col("token").rlike("^[a-z]+$")).join(t.raw_corpus.select("split", "project", "file").distinct(), ["project", "file"])
    words = v.groupBy("split", "token").agg(F.sum("freq").alias("freq")).select("split", "freq", F.filter(F.split("token", ""), lambda c: c != "").alias("s"))
    return words.select(F.col("split").alias("list"), "freq", F.explode(text.pairs(F.col("s"))).alias("p")).groupBy("list", F.col("p.left").alias("left"), F.col("p.right").alias("right")).agg(F.sum("freq").cast("bigint").alias("freq"))


@query(f"WITH l AS ({_SPLITS}), n AS (SELECT list, count(*) AS n FROM l GROUP BY list), c AS (SELECT a.list AS x, b.list AS y, count(*) AS common FROM l a JOIN l b ON a.\"left\" = b.\"left\" AND a.\"right\" = b.\"right\" GROUP BY ALL) SELECT a.list AS list_a, b.list AS list_b, coalesce(common, 0) AS common, round(coalesce(common, 0) / least(a.n, b.n), 6) AS rate FROM n a CROSS JOIN n b LEFT JOIN c ON x = a.list AND y = b.list")
def merge_overlap(t):
    return compare.overlap_matrix(_lists(t))


@query(f"WITH l AS ({_SPLITS}), o AS (SELECT \"left\", \"right\", count(*) AS lists FROM l GROUP BY ALL), s AS (SELECT lists, sum(lists) AS e FROM o GROUP BY lists) SELECT lists, round(e / (SELECT sum(e) FROM s), 6) AS share FROM s")
def merge_occurrences(t):
    return compare.occurrence_summary(_lists(t))


@query()
def merge_similarity(t):
    """How alike two lists of merges split the same words."""
    v = stage(_lower_vocab(t), "vocab")
    merges = bpe.learn(v, 500)
    a, b = (bpe.encode(v, merges, n).join(v, "token").select(F.col("token").alias("word"), "subwords", "freq") for n in (500, 250))
    return compare.similarity(a, b)


@query()
def word_splits(t):
    """Same-case words split into known words."""
    v = _lower_vocab(t)
    general = vocab.explode_tokens(t.documents.where("lang = 'en'"), F.split(F.lower("text"), "[^a-z]+", -1)).groupBy("token").count().where("count >= 5")
    return splitter.split_words(v, general).select("token", "outcome", F.array_join("parts", " ").alias("parts"), F.round("score", 6).alias("score"))


@query()
def split_errors(t):
    """The splitter against identifiers that were written in camel case: their parts are the true splits."""
    parts = F.transform(text.identifier_parts(F.col("word")), lambda p: F.lower(p))
    camel = _words(t).where(F.col("word").rlike("^[a-z]+([A-Z][a-z]+)+$")).select(F.lower("word").alias("word"), F.array_join(parts, " ").alias("parts")).dropDuplicates(["word"])
    freqs = _words(t).select(F.explode(parts).alias("token")).where(F.col("token").rlike("^[a-z]{2,}$")).groupBy("token").agg(F.count("*").alias("freq"))
    words = camel.select(F.col("word").alias("token"), F.lit(1).cast("bigint").alias("freq"))
    made = splitter.split_words(freqs.unionByName(words).groupBy("token").agg(F.max("freq").alias("freq")), freqs.where("freq < 0")).join(words, "token", "left_semi")
    actual = made.select(F.col("token").alias("word"), F.when(F.col("outcome") == "split", F.array_join("parts", " ")).alias("parts"))
    return splitter.error_statistics(actual, camel)
