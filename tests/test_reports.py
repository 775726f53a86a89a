"""Ranks, reports, labels, checks, batches, sinks."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from tesserae.functions import text
from tesserae.operators import bpe, cases, compare, langstats, metrics, params, sampling, splitter, vocab
from tesserae.operators import repr as rendering
from tesserae.plans import staging
from tesserae.sources import scans, sinks


def test_ranks_are_dense_and_in_order(spark):
    r = random.Random(1)
    rows = [("w%05d" % r.randrange(10**5), r.choice([1, 1, 1, 1, 1, 2, 9])) for _ in range(4000)]
    rows = list({t: (t, n) for t, n in rows}.values())
    got = vocab.numbered(spark.createDataFrame(rows, "token string, freq bigint"), 5).collect()
    assert [(x.token, x.id - 5) for x in sorted(got, key=lambda x: x.id)] == [(t, i) for i, (t, n) in enumerate(sorted(rows, key=lambda x: (-x[1], x[0])))]
    assert vocab.numbered(spark.createDataFrame([], "token string, freq bigint")).count() == 0


def test_staged_tables_are_released(spark):
    df = staging.stage(spark.range(3), "x")
    assert df.count() == 3 and staging.release(spark) > 0 and staging.release(spark) == 0


def test_contexts(spark):
    rows = [("f", "a", None, False), ("f", "a", "string", False), ("f", "é", "comment", True), ("f", "é", "comment", True), ("f", "ü", "string", True), ("g", None, None, None)]
    got = {x.file: x for x in langstats.by_context(spark.createDataFrame(rows, "file string, token string, ctx string, foreign boolean"), "file").collect()}
    f = got["f"]
    assert (f.code_total, f.code_total_uq, f.code_non_eng, f.code_str_total, f.code_str_total_uq, f.code_str_non_eng_uq, f.code_str_com_total, f.code_str_com_non_eng, f.code_str_com_non_eng_uq) == (1, 1, 0, 3, 2, 1, 5, 3, 2)
    assert got["g"].code_percent == 0 and f.code_str_com_percent == 0.6


def test_canonic_forms_are_checked(spark):
    form = lambda w: spark.createDataFrame([(w,)], "w string").select(text.checked_form(F.col("w")).alias("f")).first().f
    assert [form(w) for w in ("a", "été", "1", "aB", None)] == ["a", "été", "1", "aB", None]
    for bad in ("", "A", "Ab", "ÉTÉ"):
        with pytest.raises(Exception, match="form|sign"):
            form(bad)


def test_metric_names():
    assert metrics.parsed_top_k("topk_1_3_cat_new_words") == ([1, 3], "new_words") and metrics.parsed_top_k("topk_5") == ([5], None)
    for bad in ("topk", "top_1", "topk_x"):
        with pytest.raises(ValueError):
            metrics.parsed_top_k(bad)


def test_counts_of_a_grid():
    v = [params.Variable("a", 0, 10, 1), params.Variable("b", 0, 10, 1), params.Variable("c", 0, 4, 1)]
    for total in (1, 7, 50, 123, 399, 400, 1000):
        n = params.counts(v, total)
        product = n["a"] * n["b"] * n["c"]
        assert 1 <= n["a"] <= 10 and 1 <= n["b"] <= 10 and 1 <= n["c"] <= 4 and product <= max(400, total) and abs(product - min(total, 400)) <= 0.35 * total + 1
    assert params.counts(v, 400) == {"a": 10, "b": 10, "c": 4}


def test_labels_and_draws(spark):
    words = spark.createDataFrame([("ab",), ("cd",), ("cd",), (None,)], "token string")
    got = {x.token: x.label for x in sampling.labelled(words, spark.createDataFrame([("cd", "c d"), ("cd", "cd")], "token string, label string")).collect()}
    assert got == {"ab": "ab", "cd": "c d", None: None}
    many = spark.range(3000).select(F.translate(F.format_string("%05d", "id"), "0123456789", "abcdefghij").alias("token"))
    quotas = spark.createDataFrame([(5, 20)], "length int, quota bigint")
    chosen = many.orderBy("token").limit(7)
    drawn = {x.token for x in sampling.stratified(many, quotas, chosen).collect()}
    assert len(drawn) == 20 and {x.token for x in chosen.collect()} <= drawn


def test_splits_with_dictionary_and_cache(spark):
    v = spark.createDataFrame([("filename", 3), ("file", 900), ("name", 800), ("cached", 2), ("", 1), (None, 1)], "token string, freq bigint")
    general = spark.createDataFrame([("name",), ("name",)], "token string")
    cache = spark.createDataFrame([("cached", ["ca", "ched"])], "token string, parts array<string>")
    got = {x.token: (x.outcome, x.parts) for x in splitter.split_words(v, general, cache).collect()}
    assert got["cached"] == ("split", ["ca", "ched"]) and got["name"] == ("keep", ["name"]) and got["filename"][1] in (["file", "name"], ["filename"]) and len(got) == 4


def test_batches_and_sets(spark):
    rows = spark.createDataFrame([(i, ["t"] * (i * 7 % 5)) for i in range(11)], "k int, tokens array<string>")
    got = cases.batches(rows, "k", "tokens", 4).collect()
    per = collections.defaultdict(list)
    for x in got:
        assert len(x.tokens) == x.width
        per[x.batch].append(sum(t != "<pad>" for t in x.tokens))
    assert {b: len(n) for b, n in per.items()} == {0: 4, 1: 4, 2: 3} and max(per[0]) <= min(per[1]) and max(per[1]) <= min(per[2])
    assert {k: v.count() for k, v in cases.sets(spark.createDataFrame([("train",), ("test",), ("valid",), (None,)], "split string")).items()} == {"train": 1, "valid": 1}


def test_scan_of_cases(spark):
    rows = spark.createDataFrame([("1_a", "info"), ("900_b", "info"), ("2_c", ""), ("3_d", None)], "project string, label string")
    none = spark.createDataFrame([], "project string")
    assert [x.project for x in cases.scanned(rows, none, "project", 50).collect()] == ["1_a"]
    with pytest.raises(ValueError):
        cases.scanned(rows, none, "project", 10, 30)


def test_losses(spark):
    df = spark.createDataFrame([(1, ["a", "bb"]), (2, []), (3, None)], "k int, tokens array<string>")
    got = metrics.losses(df, "k", "tokens", lambda: lambda rows: [[float(len(t)) for t in r or []] for r in rows])
    assert {x.k: x.losses for x in got.collect()} == {1: [1.0, 2.0], 2: [], 3: []}


def test_approximate_size(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/partial_vocab.parquet")
    exact = df.agg(F.count_distinct("token").alias("n")).first().n
    assert abs(df.agg(F.approx_count_distinct("token", 0.02).alias("n")).first().n - exact) < 0.1 * exact


def test_compared_lists_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(compare, "MOST_LISTS", 2)
    lists = spark.createDataFrame([(str(i), "a", "b", 1) for i in range(3)], "list string, left string, right string, freq bigint")
    with pytest.raises(Exception, match="more than 2 lists"):
        compare.overlap_matrix(lists).collect()
    assert compare.overlap_matrix(lists.limit(2)).count() == 4


def test_lines_of_large_files_keep_their_numbers(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 40) for i in range(5000)]
    (tmp_path / "a.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.txt").write_text("only")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = {(x.file[-5:], x.line): x.text for x in scans.lines_of(spark, str(tmp_path)).collect()}
        assert got == {("a.txt", i): t for i, t in enumerate(lines)} | {("b.txt", 0): "only"}
        assert scans.token_lines(spark, str(tmp_path / "a.txt"), True).where("line = 3").first().tokens == ["xxx", "3", "line"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_small_sources_and_sinks(spark, tmp_path):
    (tmp_path / "list.csv").write_text("a,https://h/o/a\nb, https://h/o/b \n")
    assert [(x.name, x.url) for x in scans.project_list(spark, str(tmp_path / "list.csv")).collect()] == [("a", "https://h/o/a"), ("b", "https://h/o/b")]
    (tmp_path / "tags.json").write_text('[{"project": "p", "file": "f", "noneng": true}]')
    assert scans.tagged_files(spark, str(tmp_path / "tags.json")).first().noneng is True
    merges = spark.createDataFrame([(0, "a", "b", 3)], "rank int, left string, right string, freq bigint")
    words = spark.createDataFrame([("ab", ["ab"])], "token string, subwords array<string>")
    v = spark.createDataFrame([("ab", 3)], "token string, freq bigint")
    root = str(tmp_path / "bpe")
    path = sinks.write_byte_pairs(merges, words, v, root)
    assert path.endswith("/1") and spark.read.parquet(f"{path}/vocab").first().freq == 3
    assert sinks.write_byte_pairs(merges, words, v, root, reset=True) == path and len([p for p in (tmp_path / "bpe").iterdir() if p.is_dir()]) == 2
    assert sinks.archived(spark, str(tmp_path / "none")) is None
    assert spark.read.parquet(sinks.write_vocabulary(v, str(tmp_path / "v"), 50, 12.5)).count() == 1
    assert sinks.write_ignored(v.select("token"), str(tmp_path / "i"), 0.5).endswith("threshold=0.5")
    sinks.write_report(spark.createDataFrame([(1, "0.5"), (0, "7")], "place int, line string"), str(tmp_path / "r"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "r").glob("part-*"))) == "7\n0.5\n"


def test_learning_goes_on_behind_known_merges(spark):
    r = random.Random(4)
    v = spark.createDataFrame(list({w: (w, r.randrange(1, 50)) for w in ("".join(r.choice("abc") for _ in range(r.randrange(2, 9))) for _ in range(60))}.values()), "token string, freq bigint")
    whole = sorted(tuple(x) for x in bpe.learn(v, 8).collect())
    first = bpe.learn(v, 3)
    for most in (10**6, 1):
        assert sorted(tuple(x) for x in bpe.learn(v, 8, words_in_task=most, known=first).collect()) == whole
    assert sorted(tuple(x) for x in bpe.learn(v, 3, known=bpe.learn(v, 8)).collect()) == whole[:3]


def test_one_parse_serves_all_codes(spark):
    df = spark.createDataFrame([("a", "int fooBar = 12; // héllo"), ("b", None), ("c", "")], "k string, text string")
    codes = ["000000", "101110", "021101"]
    got = {x.k: x for x in rendering.rendered_as(df, ["k"], codes).collect()}
    for c in codes:
        assert {x.k: x.tokens for x in rendering.rendered(df, ["k"], c).collect()} == {k: x[f"c{c}"] for k, x in got.items()}
