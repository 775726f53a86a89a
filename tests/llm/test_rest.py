"""The other training-data operators against brute force, round trips and edge rows."""

import collections
import random
import unicodedata

import pytest
import xxhash
from pyspark.sql import functions as F

from tesserae.llm import encode, foreign, handwritten, overlap, packing, splits, terms
from tesserae.llm.queries import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"


# splits

def tables(spark, authors=(), urls=(), projects=()):
    return splits.ties(
        spark.createDataFrame([(p,) for p in projects], "project string"), spark.createDataFrame(list(urls), "name string, url string"), spark.createDataFrame(list(authors), "project string, author string"),
    )


def test_components_of_a_chain_and_a_hot_key(spark):
    authors = [(f"{i}_p{i}", f"A <a{i}@x.test>") for i in range(40)] + [(f"{i + 1}_p{i + 1}", f"A{i}@X.TEST") for i in range(39)]
    hot = [(f"9{i:03}_h{i}", "hot@x.test") for i in range(300)]
    none = [("1_z", "root@localhost"), ("2_y", "root@localhost"), ("3_x", None), (None, "a1@x.test"), ("4_w", ""), ("5_v", "(no author)")]
    got = {r.project: r.group_key for r in splits.components(tables(spark, authors + hot + none)).collect()}
    assert len(got) == 340 and {got[f"{i}_p{i}"] for i in range(40)} == {"0_p0"} and {v for k, v in got.items() if "_h" in k} == {"9000_h0"}


@pytest.mark.parametrize("a,b,same", [("ssh://git@h.example/O/r.git", "https://H.example/o/R", True), ("git@h.example:o/r.git", "http://www.h.example/o/r/", True), ("https://h.example/o/r", "https://h.example/o/r2", False), (None, None, False)])
def test_repositories(spark, a, b, same):
    assert (splits.components(tables(spark, urls=[("1_a", a), ("2_b", b)])).count() == 2) is same


def test_names_and_empty_tables(spark):
    assert {tuple(r) for r in splits.components(tables(spark, projects=["1_Ab", "22_aB", "3_c"])).collect()} == {("1_Ab", "1_Ab"), ("22_aB", "1_Ab")}
    assert splits.components(tables(spark)).count() == 0


def test_allotment_keeps_quotas():
    rng = random.Random(3)
    bundles = collections.Counter((rng.choice([1, 1, 2, 3, 50, 400]), rng.choice(["train", "test", "valid"])) for _ in range(3000))
    rows = sorted((s, k, n) for (s, k), n in bundles.items())
    out = splits.allot(rows)
    assert all(sum(o.values()) == n for o, (_, _, n) in zip(out, rows))
    total = sum(s * n for s, _, n in rows)
    for k, p in splits.PROPORTIONS.items():
        assert abs(sum(o[k] * s for o, (s, _, _) in zip(out, rows)) / total - p) < 0.01
    assert splits.allot([]) == []


def test_assignment_keeps_groups_whole(spark):
    files = spark.createDataFrame([("train", f"p{i % 20}", f"f{i}") for i in range(400)] + [("test", None, "x"), ("test", None, "x")], "train_test_valid string, project string, file string")
    groups = spark.createDataFrame([("p1", "p1"), ("p2", "p1")], "project string, group_key string")
    rows = splits.assign(files, groups).collect()
    of = collections.defaultdict(set)
    for r in rows:
        of["p1" if r.project == "p2" else r.project].add(r.split)
    assert len(rows) == 401 and all(len(v) == 1 for v in of.values())


# natural language in code

@pytest.fixture(scope="module")
def ident():
    labelled = {
        "de": ["Die Datei wurde nicht gefunden. Der Server wird neu gestartet, wenn die Verbindung nicht offen ist. Die Liste wird gelesen, sobald der Dienst startet."] * 3,
        "fr": ["Le fichier est lu avant la liste. La liste est toujours vide, mais le serveur n'est pas dans la mémoire. Le message n'est pas envoyé."] * 3,
        "en": ["The server is not started when the file was not found. Returns the value of the list after the message was read."] * 3,
    }
    return foreign.Identifier(labelled, ["int a = b.getValue(c);"])


@pytest.mark.parametrize("comment,langs", [
    ("// Der Server wird nicht gestartet, wenn die Datei nicht gefunden wurde", {"de"}), ("// Это сообщение не будет отправлено", {"ru"}), ('x = "\\u8fd9\\u4e2a\\u6587\\u4ef6\\u6ca1\\u6709";', {"zh"}), ("// このファイルは見つかりません", {"ja"}), ("// Returns the value of the list (Zürich)", set()), ("// привет", set()),
    ("// getValue(der, die, das)", set()), ("int der = die + das; ", set()), ("", set()), ("/* Le fichier nâ€™est pas lu mais la liste est toujours dans la mÃ©moire */", {"fr"}),
])
def test_languages(ident, comment, langs):
    assert {k for k, _ in ident.passages(comment, "java")} == langs


@pytest.mark.parametrize("text,langs", [
    ('s = "用户名不能为空";', {"zh"}), ("// 检查输入参数", {"zh"}), ('s = "连接失败";', {"zh"}), ("//未找到", {"zh"}), ('s = "ошибка в файле";', {"ru"}), ('s = "接続失敗";', {"ja"}), ('s = "失敗した";', {"ja"}), ('s = "値がない";', {"ja"}),
    ('s = "张伟";', set()), ('s = "王小明";', set()), ("// 张成功", set()), ('s = "欧阳修文";', set()), ('s = "山田太郎";', set()), ('s = "さくら";', set()), ('s = "数据库";', set()), ("// Author: 王小明", set()), ('s = "やました";', set()), ('s = "井の頭";', set()), ("// а б в", set()), ("// Иван в", set()),
])
def test_short_passages(ident, text, langs):
    assert {k for k, _ in ident.passages(text, "java")} == langs


def test_shares_edge_rows(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, kind string")
    rows = [("p", "a.java", "// Это сообщение не будет отправлено"), ("p", "a.java", "// Это сообщение не будет отправлено"), ("p", "b.java", None), ("p", "c.java", ""), (None, "d.py", "# 这个文件没有找到"), ("p", "e.java", "// ok " * 100_000)]
    df = spark.createDataFrame(rows, "project string, file string, text string").withColumn("lang", F.lit("x"))
    assert {(r.project, r.file, r.lang) for r in foreign.shares(df, docs).collect()} == {("p", "a.java", "ru"), (None, "d.py", "zh")}


# files nobody wrote by hand

VENDORS = (["lib-box"], ["org.lib.box"])
JS = "function calculateTotal(items) {\n  var total = 0;\n  items.forEach(function (item) {\n    total += item.price;\n  });\n  return total;\n}\n"


@pytest.mark.parametrize("file,text,kind", [
    ("A.java", "// Code generated by X. DO NOT EDIT.\nclass A {}\n", "generated"), ("A.java", "package p;\n@Generated(\"x\")\nclass A {}\n", "generated"), ("A.java", "class A {\n// the generated node is kept apart\n}\n", None), ("A.java", "class A { @GeneratedValue int x; }\n", None),
    ("A.java", "class A {\n" + "".join(f"  int getX{i}() {{ return x{i}; }}\n" for i in range(20)) + "}\n", "generated"), ("B.java", "package org.lib.box.core;\nclass B {}\n", "vendored"), ("B.java", "package com.me.shaded.org.lib.box;\nclass B {}\n", "vendored"), ("B.java", "import org.lib.box.C;\nclass B {}\n", None),
    ("b.js", "// lib-box 1.2 - taken from https://x\n" + JS, "vendored"), ("own.js", "// works with lib-box\n" + JS, None), ("d.js", "var d = [\n" + "[1.5,-2.25,3.125,4.0],\n" * 40 + "];\n", "blob"), ("d.py", "X = (\n" + "    'eWcHjuabAlT5MYiC9ArBOQteDm/FWd2U12/vaS3sabQI1hCCLA810fq6H7frypbcBlpOFhMm'\n" * 9 + ")\n", "blob"),
    ("m.js", "".join(f"function a{i}(b,c){{return b.d(c,{i})}}for(var e=0;e<f.length;e++)g[e]=h(e);" for i in range(30)), "minified"), ("own.js", JS, None),
])
def test_kinds(file, text, kind):
    models = handwritten.train([("js", JS * 3), ("java", "class A { int value; }"), ("py", "value = 1")] * 3)
    assert handwritten.kind_of(file, text, models, VENDORS) == kind


MANGLED_JS = "".join(f"function a{i}(b,c){{return b.d(c,{i})}}for(var e=0;e<f.length;e++)g[e]=h(e);" for i in range(8))
MANGLED_JAVA = "class a {\n" + "".join(f"  int b{i}(c d, e f) {{\n    return g.h(d, {i}) + q.w(f);\n  }}\n" for i in "xyz") + "  void j(k l) {\n    for (m n : l.o) {\n      n.p(l);\n    }\n    if (l.z == q) {\n      throw new v(u);\n    }\n  }\n}\n"
MANGLED_PY = "".join(f"def q{i}(z, x):\n    for w in z.k:\n        x.v(w)\n    while z.j:\n        x += z.u(x)\n        print(z, x[w])\n    return z.q(x, w)\n" for i in "ab")
MIXED = ["}", "]", "(", ")", ":", ";", "!", "?", "%", "&", "*", "+", "/", "<", ">", "=", "~", "^", "#"]


@pytest.mark.parametrize("file,text,kind", [
    ("w.js", "\n".join(MANGLED_JS[i:i + 100] for i in range(0, len(MANGLED_JS), 100)), "minified"), ("s.js", MANGLED_JS[:160], "minified"), ("M.java", MANGLED_JAVA, "minified"), ("m.py", MANGLED_PY, "minified"),
    ("T.java", "class A {\n" + "".join(f'  String text{i}() {{ return "{c}"; }}\n' for i, c in enumerate(MIXED)) + "}\n", "generated"), ("own.js", JS, None),
])
def test_mangled_names_and_templates(file, text, kind):
    java = "class Invoice {\n  int total;\n  void addItem(Item item) {\n    total = total + item.price();\n    listeners.notifyChanged(this, total);\n  }\n}\n"
    py = "def read_lines(path, encoding):\n    with open(path, encoding=encoding) as stream:\n        for line in stream:\n            yield line.strip()\n"
    models = handwritten.train([("js", JS * 3), ("java", java * 3), ("py", py * 3)] * 3)
    assert handwritten.kind_of(file, text, models, VENDORS) == kind


def test_kinds_edge_rows(spark):
    df = spark.createDataFrame([("p", "A.java", "// @generated by X\n"), ("p", "A.java", "// @generated by X\n"), ("p", "b", None), (None, "c.java", ""), (None, None, "x")], "project string, file string, text string").withColumn("kind", F.lit(1))
    v = spark.createDataFrame([(None, None, None)], "name string, url string, package string")
    assert [tuple(r) for r in handwritten.classify(df, v).collect()] == [("p", "A.java", "generated")]
    assert handwritten.classify(df.limit(0), v.limit(0)).count() == 0


# term counts

def brute(rows):
    seen, occ, recs, every = set(), collections.Counter(), collections.defaultdict(set), set()
    for row in set(rows):
        c, p, f, t, n = row
        if t is not None:
            every.add((p, f))
            w = unicodedata.normalize("NFC", t).strip()
            if w:
                occ[w] += n or 0
                recs[w].add((p, f))
    return {(w, occ[w], len(recs[w])) for w in occ}, len(every)


def vocab_rows(seed, n=3000):
    r = random.Random(seed)
    return [(r.choice([1, 2]), r.choice(["p", "q", None]), f"f{r.randrange(30)}", r.choice([None, " a", "a", "a\t", "e\u0301", "é", "b\x1fc", "\x1e0", "", "  ", *"defgh"]), r.choice([None, 1, 2, 7])) for _ in range(n)]


def test_terms_against_brute_force(spark):
    schema = "chunk int, project string, file string, token string, freq bigint"
    old, new = vocab_rows(1), vocab_rows(2)
    a, b = (spark.createDataFrame(x, schema).withColumn("key", F.lit("k")) for x in (old, new))
    state = terms.merge(None, terms.term_deltas(a))
    want, total = brute(old)
    assert {(r.key, r.occurrences, r.records) for r in state.where("kind = 0").collect()} == want
    after = terms.merge(state, terms.term_deltas(b, a))
    assert {(r.key, r.occurrences, r.records) for r in after.where("kind = 0").collect()} == brute(new)[0]
    assert terms.merge(None, terms.term_deltas(a.limit(0))).count() == 0


def records(state):
    return state.where("kind = 1").count()


def test_records_after_updates_of_some_parts(spark):
    schema = "chunk int, project string, file string, token string, freq bigint"
    of = lambda file, words: [(1, "p", file, w, 1) for w in words]
    words = [f"w{i}" for i in range(40)]
    by = collections.defaultdict(list)
    for w in words:
        by[xxhash.xxh32_intdigest(w) % terms.PARTS].append(w)
    assert len(by) == terms.PARTS
    full, less = of("a", words), of("a", [w for k in by if k for w in by[k]])
    df = lambda x: spark.createDataFrame(x, schema)
    state = terms.merge(None, terms.term_deltas(df(full + of("b", by[0]))))
    assert records(state) == 2
    state = terms.merge(state, terms.term_deltas(df(less), df(full)))  # a part of a loses all its terms
    assert records(state) == 2
    state = terms.merge(state, terms.term_deltas(df(of("b", words)), df(of("b", by[0]))))  # b gains parts
    assert records(state) == 2
    state = terms.merge(state, terms.term_deltas(df([]), df(of("b", words))))
    assert records(state) == 1
    assert terms.merge(state, terms.term_deltas(df([]), df(less))).count() == 0


def test_update_of_a_saved_state(spark, tmp_path):
    schema = "chunk int, project string, file string, token string, freq bigint"
    old, new = vocab_rows(3), [x for x in vocab_rows(4) if x[2] not in ("f1", "f2")]
    old = [x for x in old if x[2] != "f3"]
    a, b = (spark.createDataFrame(x, schema) for x in (old, new))
    terms.save(terms.merge(None, terms.term_deltas(a)), f"{tmp_path}/s")
    after = terms.merge(spark.read.parquet(f"{tmp_path}/s"), terms.term_deltas(b, a))
    want, total = brute(new)
    assert {(r.key, r.occurrences, r.records) for r in after.where("kind = 0").collect()} == want and records(after) == total


def test_updated_terms_equal_a_full_count(spark):
    rows = spark.read.parquet(f"{SMALL}/partial_vocab.parquet")
    old, _, removed = terms.before_update(rows.select("chunk", "project", "file", "token", "freq"))
    assert removed.count() and old.exceptAll(rows.select(old.columns)).count()
    assert sorted(map(str, QUERIES["p4_updated"](spark, SMALL).collect())) == sorted(map(str, QUERIES["p4_terms"](spark, SMALL).collect()))



# overlap

@pytest.mark.parametrize("heavy,broadcast", [(64, 1000), (1, 1000), (1, 0)])
def test_pairs_against_brute_force(spark, monkeypatch, heavy, broadcast):
    monkeypatch.setattr(overlap, "HEAVY", heavy)
    monkeypatch.setattr(overlap, "HEAVY_LINES", broadcast)
    r = random.Random(5)
    base = [[f"call{r.randrange(60)}(x{i});" for i in range(r.randrange(3, 25))] for _ in range(12)]
    rows = []
    for i in range(90):
        lines = list(r.choice(base))
        for _ in range(r.randrange(0, 5)):
            lines[r.randrange(len(lines))] = f"new{r.randrange(40)}();"
        r.shuffle(lines)
        rows.append((r.choice(["train", "test", "valid"]), f"p{i % 9}", f"f{i}.java", "package p;\n// c\n" + r.choice(["\n", "\n\n  "]).join(lines) + "\n"))
    for i in range(150):  # the same few lines in many mixes
        rows.append((r.choice(["train", "test", "valid"]), f"q{i % 7}", f"g{i}.java", "".join(f"common{k}();\n" * r.randrange(0, 8) for k in range(5))))
    rows += [("train", "p", "x.java", None), ("test", "p", "x.java", ""), ("test", "p", "y.java", "// only\n"), rows[0], rows[1]]
    bag = {x[:3]: collections.Counter(overlap.code_lines(x[3], "java")) for x in rows if x[3]}
    want = set()
    for a, x in bag.items():
        for b, y in bag.items():
            if a[0] == "train" != b[0] and a[1:] != b[1:] and x and y and sum((x & y).values()) * 5 >= 4 * max(sum(x.values()), sum(y.values())):
                want.add((*min(a[1:], b[1:]), *max(a[1:], b[1:])))
    df = spark.createDataFrame(rows, "split string, project string, file string, text string")
    pairs = overlap.file_pairs(df)
    got = {(*min((r.eval_project, r.eval_file), (r.train_project, r.train_file)), *max((r.eval_project, r.eval_file), (r.train_project, r.train_file))) for r in pairs.collect()}
    assert got == want and len(want) > 20
    assert overlap.file_pairs(df.limit(0)).count() == 0


# encoding and packing

def judge():
    import tiktoken

    return tiktoken.Encoding("judge", pat_str=encode.PATTERN, mergeable_ranks=encode.encoding().ranks, special_tokens={}).encode_ordinary


def test_streamed_ids_are_the_ids(monkeypatch):
    enc, r, ids_of = encode.encoding(), random.Random(1), judge()
    for size in (64, 1 << 16):
        monkeypatch.setattr(encode, "WINDOW", size)
        monkeypatch.setattr(encode, "PIECE", size)
        for alphabet in (" \n", "a", "ab '", "'a", "aé 1!", "日本 ", "\t\n x", "=-", "s'tll ", "\u0301e", "😀a", "etaoin", "012", "\xa0 a"):
            for _ in range(12):
                text = "".join(r.choice(alphabet) for _ in range(r.randrange(1, 700)))
                ids = encode.encode(text, enc)
                assert ids == ids_of(text) and "".join(encode.decode(ids, enc)) == text
    raw = "".join(r.choice("etaoin") for _ in range(20_000)).encode()
    assert list(enc.run([raw[i:i + 333] for i in range(0, len(raw), 333)])) == list(enc.run([raw])) == ids_of(raw.decode())


def test_long_runs_need_no_memory_of_their_size():
    enc, ids_of = encode.encoding(), judge()
    for text in (" " * 300_000, "'a" * 100_000, "a" * 300_000, "\n" * 200_000 + "x", " " * 200_000 + "x", "é" * 100_000):
        assert encode.encode(text, enc) == ids_of(text)


def test_empty_and_odd_texts():
    enc = encode.encoding()
    assert encode.encode(None, enc) == encode.encode("", enc) == []


def test_ids_of_the_other_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{encode.FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    texts = ["<|endoftext|> don't  x", "日本\r\n\t", None, "", "a" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("ids", F.lit(1))
    assert {r.doc_id: r.ids for r in encode.token_ids(df).collect()} == {i: t.encode(x, add_special_tokens=False).ids if x else [] for i, x in enumerate(texts)}


def test_containers(spark):
    r = random.Random(2)
    texts = [None, "", "word " * 10_000, *(" ".join("tok" for _ in range(r.randrange(1, 900))) for _ in range(300))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    enc, rows = encode.encoding(), packing.pack(df).collect()
    load, per = collections.Counter(), collections.Counter()
    for x in rows:
        load[x.container] += x.tokens
        per[x.doc_id] += x.tokens
    assert max(load.values()) <= 2048 and all(per[i] == len(encode.encode(t, enc)) for i, t in enumerate(texts)) and {x.doc_id for x in rows} == set(range(len(texts)))
    assert all(n == 1 or per[d] > 2048 for d, n in collections.Counter(x.doc_id for x in rows).items())
    assert sum(load.values()) / len(load) / 2048 > 0.95 and packing.pack(df.limit(0)).count() == 0


def test_every_query_has_its_columns(spark):
    columns = {"p1_found": "project group_key", "p2_found": "project file lang", "p3_found": "project file kind", "p4_found": "token mark", "p5_found": "project file", "p6_found": "project_a file_a project_b file_b", "p7_ids": "doc_id ids", "p9_found": "doc_id kind value"}
    for name, names in columns.items():
        assert QUERIES[name](spark, SMALL).columns == names.split()
    assert set(SQL) <= set(QUERIES)


def test_kind_of_a_file_with_several_texts(spark):
    vendors = spark.createDataFrame([("quill", "https://h/o/quill", "io.quill")], "name string, url string, package string")
    marked = "// Generated by maker. Do not edit.\nclass A { int x; }"
    rows = [("p", "A.java", marked), ("p", "A.java", "package io.quill.a;\nclass A { }"), ("p", "B.java", marked), ("p", "B.java", "class B { void f() { int hand = 1; } }")]
    found = handwritten.classify(spark.createDataFrame(rows, "project string, file string, text string"), vendors)
    assert {(r.file, r.kind) for r in found.collect()} == {("A.java", "vendored"), ("B.java", "generated")}


def test_names_of_a_template_have_a_low_diversity():
    import random

    rng = random.Random(3)
    words = ["order", "price", "user", "index", "file", "read", "write", "load", "queue", "total", "split", "merge", "first", "cache", "token", "node", "left", "count", "state", "page"]
    hand = [f"class A{i} {{\n" + "\n".join(f"int {rng.choice(words)}{rng.choice(words).title()}{rng.choice(words).title()} = {rng.choice(words)}({rng.choice(words)});" for _ in range(12)) + " }" for i in range(40)]
    models = handwritten.train([("java", t) for t in hand])
    template = "class A { " + " ".join(f"int getField{i}() {{ return field{i} + {'x' * i}; }}" for i in range(1, 40)) + " }"
    assert handwritten.kind_of("a/A.java", template, models, ((), ())) == "generated"
    low = models["java"][3]
    assert all(handwritten.diversity(handwritten.names_of(t, "java")) > low for t in hand) and handwritten.diversity(handwritten.names_of(template, "java")) < low


def test_last_comment_of_any_length():
    assert handwritten.edge_comments("class A { }\n/* " + "x " * 5000 + "Generated by y */").endswith("by y */")
