"""What must not grow with the rows of a batch, a file or a vocabulary."""

import collections
import contextlib
import io
import random
import statistics

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tesserae.llm import handwritten
from tesserae.operators import bpe
from tesserae.operators import repr as rendering
from tesserae.operators import splitter


def plan_of(df):
    with contextlib.redirect_stdout(out := io.StringIO()):
        df.explain()
    return out.getvalue()


@pytest.mark.parametrize("name", ["foreign_marks", "log_statements", "text_segments", "lang_stats_by_parser", "loggable_blocks"])
def test_no_token_leaves_the_task_that_parses_it(spark, name):
    plan = plan_of(entry.queries()[name](spark, "/root/testdata/sf0.001"))
    assert "Generate" not in plan and "array<struct<pos" not in plan


def _words(n, seed=3):
    r = random.Random(seed)
    return [*{"".join(r.choice("aabcdé€😀") for _ in range(r.randint(0, 9))): r.randint(1, 9) for _ in range(n)}.items()]


@pytest.mark.parametrize("block,alphabet", [(1, 0), (7, 0), (250_000, 0), (3, 1)])
def test_merges_learnt_on_arrays_are_those_of_a_full_count(monkeypatch, block, alphabet):
    monkeypatch.setattr(bpe, "BLOCK_WORDS", block)
    vocab = [("aaaaa", 3), ("aaa", 2), ("baaaab", 1), ("", 4)] if alphabet else _words(60)
    words, expected = [list(w) for w, _ in vocab], []
    for rank in range(25):
        count = collections.Counter()
        for w, (_, n) in zip(words, vocab):
            for p in zip(w, w[1:]):
                count[p] += n
        if not count:
            break
        pair = min(count, key=lambda p: (-count[p], p))
        expected.append((rank, *pair, count[pair]))
        words = [_merged(w, pair) for w in words]
    assert bpe.learned(vocab, 25) == expected


def _merged(w, pair):
    out, k = [], 0
    while k < len(w):
        step = 2 if tuple(w[k:k + 2]) == pair else 1
        out.append("".join(w[k:k + step]))
        k += step
    return out


def test_merges_are_learnt_once_and_the_vocabulary_is_made_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("bigint")
    def counted(n):
        calls.add(1)
        return n

    v = spark.createDataFrame([("abab", 3), ("abc", 2)], "token string, freq bigint").select("token", counted("freq").alias("freq"))
    merges = bpe.learn(v, 3)
    for _ in range(3):
        assert merges.count() == 3
    assert calls.value == 2


@pytest.mark.parametrize("name", ["bpe_encode", "bpe_result_vocab", "merge_similarity"])
def test_the_vocabulary_is_aggregated_once(spark, name):
    plan = plan_of(entry.queries()[name](spark, "/root/testdata/sf0.001"))
    assert "partial_vocab.parquet" not in plan


def test_rendered_tokens_are_counted_where_they_are_rendered(spark):
    texts = ["class A { int value = 10; }", "", None, "int value; // value"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    expected = collections.Counter(w for t in texts if t is not None for w in rendering.preprocess(t, "101111"))
    assert {x.token: x.freq for x in rendering.rendered_vocabulary(df, "101111").collect()} == expected
    assert "Generate" not in plan_of(entry.queries()["render_104111"](spark, "/root/testdata/sf0.001"))


def test_the_rendered_corpus_has_all_merges_of_its_code(spark, tmp_path):
    r = random.Random(5)
    freqs = {"".join(r.choice("abcdefghij") for _ in range(r.randint(4, 9))): r.randint(1, 9) for _ in range(300)}
    spark.createDataFrame([*freqs.items()], "token string, freq bigint").write.parquet(str(tmp_path / "partial_vocab.parquet"))
    text = "\n".join(f"{w} = {w};" for w in freqs)
    spark.createDataFrame([("p", "A.java", text)], "project string, file string, text string").write.parquet(str(tmp_path / "raw_corpus.parquet"))
    merges = bpe.learned([*freqs.items()], 5000)
    assert 300 < len(merges) < 5000
    made = {x.token: x.freq for x in entry.queries()["render_104111"](spark, str(tmp_path)).collect()}
    # fewer merges than 5,000 can be learnt, so every word is whole
    assert made == {**dict.fromkeys(freqs, 2), "=": len(freqs), ";": len(freqs)}


def test_a_vocabulary_of_any_size_is_split(spark):
    r = random.Random(4)
    parts = ["get", "set", "user", "name", "file", "é", "a", "x1"]
    rows = [*{"".join(r.choice(parts) for _ in range(r.randint(1, 4))): r.randint(1, 500) for _ in range(150)}.items(), ("", 3), (None, 1)]
    v = spark.createDataFrame(rows, "token string, freq bigint")
    general = spark.createDataFrame([("username",), ("getname",)], "token string")
    cache = spark.createDataFrame([("setfile", ["set", "file"])], "token string, parts array<string>")
    made = [sorted(map(tuple, splitter.split_words(v, general, cache, most_words=m).collect())) for m in (10**6, 10)]
    assert made[0] == made[1] and any(x[1] == "split" for x in made[1])


def test_name_models_are_those_of_all_files(spark):
    r = random.Random(9)
    words = ["total", "amount", "user", "parse", "buffer", "index", "file", "write"]
    body = lambda n: "".join(f"int {r.choice(words)}{r.choice(words).title()} = {r.choice(words)};\n" for _ in range(n))
    rows = [("p", f"a/A{i}.java", body(r.randint(20, 40))) for i in range(30)] + [("p", "a/Long.java", body(3000) + "int zyxwvq = 1;\n")]
    df = spark.createDataFrame(rows, "project string, file string, text string")
    half = {x.file: x.h for x in df.select("file", F.pmod(F.xxhash64("project", "file"), F.lit(2)).alias("h")).collect()}
    names = [(half[f], handwritten.names_of(t, "java")) for _, f, t in rows]
    models = [handwritten._counts([n for h, n in names if h == i]) for i in range(2)]
    bits = [handwritten.entropy(n, models[1 - h], handwritten.UNSEEN) for h, n in names]
    spread = [handwritten.diversity(n) for _, n in names]
    usual = statistics.median(spread)
    expected = handwritten._limits(statistics.mean(bits), statistics.pstdev(bits), usual, statistics.median(abs(x - usual) for x in spread))
    made = handwritten.train_on(df)
    assert made["java"][0] == handwritten._counts([n for _, n in names]) and "yxw" in made["java"][0]
    assert made["java"][2:] == pytest.approx(expected) and made["py"][0] == {}


def test_texts_are_read_once_and_names_of_all_scripts_count(spark, tmp_path):
    r = random.Random(5)
    words = ["total", "$amount", "İndex", "ΣΑΣ", "имя", "名前", "x1_$", "Größe", "file", "K"]
    lines = ["int {}{} = {};\n", "{}.{}({});\n", "if ({}.{} > {}) return;\n", "{}({}, {});\n", "for (int {} : {}.{}()) {{}}\n", "return {} + {} - {};\n", "{}[{}] = {};\n", "new {}<{}>({});\n"]
    body = lambda n: "".join(line.format(*r.choices(words, k=3)) for line in lines * n)
    rows = [("p", f"a/A{i}.java", body(r.randint(3, 5))) for i in range(30)] + [("p", "a/G.java", "// Generated by x. Do not edit.\n" + body(4)), ("p", "a/n.xml", "<a/>")]
    spark.createDataFrame(rows, "project string, file string, text string").write.parquet(str(tmp_path / "corpus"))
    df = spark.read.parquet(str(tmp_path / "corpus"))
    found = handwritten.classify(df, spark.createDataFrame([], "name string, url string, package string"))
    assert "text#" not in plan_of(found)
    assert [tuple(x) for x in found.collect()] == [("p", "a/G.java", "generated")]
    names = [handwritten.names_of(t, "java") for _, f, t in rows if f[-4:] == "java"]
    bits = handwritten._counts(names)
    assert handwritten.train_on(df)["java"][0] == bits and any(not g.isascii() for g in bits)
    made = handwritten._entropies([" ".join(n) for n in names], handwritten._numbered(bits))
    assert list(made) == pytest.approx([handwritten.entropy(n, bits, handwritten.UNSEEN) for n in names])
