"""Operators against small golden cases, and edge rows."""

import pytest
from pyspark.sql import functions as F

from tesserae.functions import markers as M
from tesserae.functions import text
from tesserae.operators import bpe, cases, compare, dedup, dictionary, fractions, langstats, metrics, params, registry, sampling, splitter, vocab
from tesserae.plans.staging import stage
from tesserae.sources import scans, sinks


def one(spark, column, **values):
    names = ", ".join(values)
    return spark.createDataFrame([tuple(values.values())], names if ":" in names else list(values)).select(column.alias("v")).first().v


def test_tie_aware_cap(spark):
    v = spark.createDataFrame([("a", 5), ("b", 3), ("c", 3), ("d", 1)], "token string, freq bigint")
    assert {r.token for r in vocab.cap(v, 2).collect()} == {"a"}
    assert vocab.cap(v, 4).count() == 4 and vocab.cap(v, 9).count() == 4 and vocab.cap(v, 3).count() == 3
    assert vocab.cap(v.where("freq < 0"), 3).count() == 0


def test_growth_and_ids(spark):
    t = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2500, "c")], "doc_id bigint, token string")
    assert sorted(tuple(r) for r in vocab.growth(t).collect()) == [(1, 1, 2), (2, 2, 2), (2500, 3, 3)]
    assert [(r.token, r.id) for r in vocab.numbered(vocab.vocabulary(t)).orderBy("id").collect()] == [("a", 0), ("b", 1), ("c", 2)]


def test_fractions():
    assert fractions.bounds(50) == (0, 500) and fractions.bounds(0.1, 99.9) == (999, 1000)
    assert fractions.prefix(50) == "50_" and fractions.prefix(0.5, 12.5) == "0.5_12.5_"
    for bad in ((101, 0), (50, 60), (-1, 0)):
        with pytest.raises(ValueError):
            fractions.bounds(*bad)


def test_ranges_and_contexts(spark):
    tokens = ["a", M.LOG, "x", M.LOG_END, "b", "c"]
    df = spark.createDataFrame([(tokens,)], "t array<string>")
    r = df.select(text.ranges_between(F.col("t"), M.LOG, M.LOG_END).alias("r"), text.context_before(F.col("t"), F.lit(4), 3).alias("b"), text.context_after(F.col("t"), F.lit(3), 3).alias("a")).first()
    assert [tuple(x) for x in r.r] == [(1, 3)] and r.b == ["<pad>", "a", "x"] and r.a == ["b", "c", "<pad>"]
    cut = df.select(text.without_ranges(F.col("t"), F.expr("array(named_struct('from', 1, 'to', 4))")).alias("v")).first().v
    assert cut == ["a", "b", "c"]
    long = spark.createDataFrame([(["a"] * 5000,)], "t array<string>").select(F.size(text.context_before(F.col("t"), F.lit(400), 1000)).alias("n"), F.element_at(text.context_before(F.col("t"), F.lit(400), 1000), 600).alias("p")).first()
    assert long.n == 1000 and long.p == "<pad>"


def test_cases(spark):
    tokens = f"{M.BLOCK} {{ a ; {M.LOG} `info log ( ) ; {M.LOG_END} b ; }} {M.BLOCK_END}".split()
    df = spark.createDataFrame([(f"f{i}", tokens) for i in range(40)] + [("none", ["a"]), ("empty", [])], "path string, tokens array<string>")
    got = {r.path: r for r in cases.cases(df, "path", "level", 4).collect()}
    assert got["none"].label is None and got["empty"].label is None
    assert {r.label for r in got.values()} == {None, "info"} and all(len(r.before) == 4 for r in got.values() if r.label)
    places = df.limit(1).select(cases.possible_ranges(F.col("tokens")).alias("p")).first().p
    assert [tuple(p) for p in places] == [(2, 1), (4, 3), (10, 9), (11, 10), (13, 12)]
    with pytest.raises(ValueError):
        cases.cases(df, "path", "other")


def test_merges_and_encoding(spark):
    v = spark.createDataFrame([("abab", 3), ("abc", 2), ("<pad>", 9)], "token string, freq bigint")
    small = [tuple(r) for r in bpe.learn(v, 3).collect()]
    large = [tuple(r) for r in bpe.learn(v, 3, words_in_task=1).orderBy("rank").collect()]
    assert small == large and small[0] == (0, "a", "b", 8)
    e = {r.token: r.subwords for r in bpe.encode(v, bpe.learn(v, 1)).collect()}
    assert e["abc"] == ["ab", "c"] and e["abab"] == ["ab", "ab"]
    merged = bpe.merge_pair(spark.createDataFrame([(["a", "a", "a"],)], "symbols array<string>"), "a", "a").first().symbols
    assert merged == ["aa", "a"]


def test_near_words(spark):
    w = spark.createDataFrame([("recieve",), ("abc",), ("",), (None,)], "token string")
    k = spark.createDataFrame([("receive",), ("abcd",), ("xyz",)], "token string")
    assert {tuple(r) for r in dictionary.near_words(w, k).collect()} == {("recieve", "receive"), ("abc", "abcd")}


def test_statistics_of_languages(spark):
    t = spark.createDataFrame([("f", "a"), ("f", "ü"), ("f", "ü"), ("g", "b")], "file string, token string")
    r = {x.file: x for x in langstats.statistics(t, text.non_ascii(F.col("token")), "file").collect()}
    assert (r["f"].total, r["f"].total_uq, r["f"].non_eng, r["f"].non_eng_uq, r["f"].sample) == (3, 2, 2, 1, "ü") and r["g"].percent == 0


def test_duplicates_keep_nulls(spark):
    d = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "")], "doc_id int, text string")
    assert {r.doc_id for r in dedup.deduplicated(d, "text", "doc_id").collect()} == {1, 3, 4, 5}


def test_measures(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [0, 1, 3])], "l array<double>, b array<int>")
    r = df.select(metrics.word_entropies(F.col("l"), F.col("b")).alias("w"), metrics.word_average(F.col("l"), F.col("b")).alias("a"), metrics.subword_average(F.col("l")).alias("s")).first()
    assert r.w == [1.0, 5.0] and r.a == 3.0 and r.s == 2.0
    with pytest.raises(Exception, match="last boundary"):
        df.select(metrics.word_entropies(F.col("l"), F.array(F.lit(0), F.lit(2)))).collect()


def test_splitter():
    freqs = {"class": 500.0, "path": 400.0, "classpath": 1.0}
    assert splitter.best_split("classpath", 1.0, freqs, set())[:2] == ("split", ["class", "path"])
    assert splitter.best_split("zzzzzzzzz", 1.0, freqs, set())[0] == "typo" and splitter.best_split("path", 400.0, freqs, {"path"})[0] == "keep"


def test_samples_repeat(spark):
    w = spark.createDataFrame([(f"{'abcdefghij'[i % 10] * (i % 7 + 1)}{chr(97 + i // 26)}{chr(97 + i % 26)}",) for i in range(600)], "token string")
    q = sampling.length_quotas(w, 100)
    assert q.agg(F.sum("quota")).first()[0] == 100
    a, b = sampling.stratified(w, q).collect(), sampling.stratified(w.repartition(3), q).collect()
    assert sorted(a) == sorted(b) and len(a) == 100


def test_grid(spark):
    v = [params.Variable("a", 0, 10, 1), params.Variable("b", 1, 64, 2, "mult")]
    g = params.grid(spark, v, 12).collect()
    assert 6 <= len(g) <= 24 and all(r.b in (1, 2, 4, 8, 16, 32) for r in g)
    with pytest.raises(ValueError):
        params.grid(spark, v, 0)


def test_comparisons(spark):
    a = spark.createDataFrame([("x", "a", "b", 3), ("x", "c", "d", 1), ("y", "a", "b", 2)], "list string, left string, right string, freq bigint")
    m = {(r.list_a, r.list_b): r.rate for r in compare.overlap_matrix(a).collect()}
    assert m[("x", "y")] == 1.0 and m[("x", "x")] == 1.0
    assert {(r.lists, r.share) for r in compare.occurrence_summary(a).collect()} == {(2, 0.666667), (1, 0.333333)}


def test_registry(spark):
    @registry.step("double")
    def double(df, column):
        return df.withColumn(column, F.col(column) * 2)

    df = spark.range(2)
    assert [r.id for r in registry.chain(df, [("double", {"column": "id"})]).collect()] == [0, 2]
    with pytest.raises(KeyError):
        registry.find("operators.vocab.nothing")


def test_sources_and_sinks(spark, tmp_path):
    base = tmp_path / "raw" / "train" / "1_a b" / "src"
    base.mkdir(parents=True)
    (base / "A.java").write_text("class A {}\n")
    (base / "B.java").write_bytes("caf\xe9".encode("latin-1"))
    (base / "_hidden.java").write_text("x")
    got = {(r.split, r.project, r.file): r.text for r in scans.project_tree(spark, str(tmp_path / "raw"), ".java").collect()}
    assert got == {("train", "1_a b", "src/A.java"): "class A {}\n", ("train", "1_a b", "src/B.java"): "café"}
    df = spark.createDataFrame([("a", ["x", "y"])], "k string, v array<string>")
    sinks.write_pairs(df, str(tmp_path / "d"), "k", "v")
    assert scans.pairs(spark, str(tmp_path / "d"), kind="list").first().value == ["x", "y"]
    (tmp_path / "m").write_text("a b 5\nab c 2\n")
    assert [(r.rank, r.left) for r in scans.merges(spark, str(tmp_path / "m"), 1).collect()] == [(0, "a")]
    c = scans.caches(spark.createDataFrame([("w", "1")], "word string, subwords string"), spark.createDataFrame([("w", "2")], "word string, subwords string"))
    assert c.first().subwords == "2"


def test_staged_tables_have_known_rows(spark):
    assert stage(spark.range(10), "t").count() == 10


def test_streams(spark, tmp_path):
    from tesserae.streaming import live

    spark.createDataFrame([("k", ["`w", "a"]), ("k", ["b", "w`", "c"])], "key string, tokens array<string>").coalesce(1).write.parquet(str(tmp_path / "s"))
    s = spark.readStream.schema("key string, tokens array<string>").parquet(str(tmp_path / "s"))
    q = live.full_words(s, "key", "tokens").writeStream.format("memory").queryName("fw").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.word for r in spark.table("fw").collect()) == ["`w a b w`", "c"]
    v = live.vocabulary(s, F.col("tokens")).writeStream.format("memory").queryName("lv").outputMode("complete").start()
    v.processAllAvailable()
    v.stop()
    assert {r.token: r.freq for r in spark.table("lv").collect()}["a"] == 1


def test_case_queries_have_the_whole_context(spark):
    from tesserae import catalog

    rows = catalog.QUERIES["cases_level"](spark, "/root/testdata/sf0.001").where("before is not null").limit(3).collect()
    assert rows and {len(x.split(" ")) for r in rows for x in (r.before, r.after)} == {cases.CONTEXT}
