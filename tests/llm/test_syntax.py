"""Parsers: valid and invalid files of each language, and against CPython's own parser."""

import ast
import json
from pathlib import Path

import pytest

from tesserae.llm import syntax
from tesserae.llm.syntax import first_error, p5_found, rates, syntax_errors

VALID = {
    "java": [
        "", "package a.b;\nimport static java.util.*;\n@A(x = 1) public final class C<T extends Comparable<T> & D> extends E<T> implements F, G<H<T>> {\n int a = 1, b[] = {1, 2};\n C() { super(); }\n static { x(); }\n <R> R f(final int... x) throws E { return (R) x; }\n}\n",
        "record P(int x, List<String> y) implements Q { P { if (x < 0) throw new E(); } }", "sealed interface S permits A, B {}\nnon-sealed class A implements S {}",
        "class A { int f(Object o) { return switch (o) { case 1, 2 -> 3; case B b -> { yield 4; } default -> throw new E(); }; } }",
        "class A { void f() { for (int i = 0, j = 1; i < n; i++, j--) ; for (Map.Entry<K, V> e : m.entrySet()) g(e); for (;;) break; do { } while (x); label: while (true) continue label; } }",
        "class A { Runnable r = () -> { }; F f = (a, b) -> a + b; G g = x -> y -> x; H h = A::new; I i = int[]::new; J j = (J & K) o; int k = (int) -1; boolean l = a < b && c > d; }",
        'class A { String s = """\n  text "q" \\""" here\n  """; char c = \'\\u0041\', d = \'\\\'\'; }', "class A { void f() { try (R r = a(); b) { } catch (X | Y e) { } finally { } synchronized (this) { } assert a : b; int[] x = new int[3][]; x[1] = 2; a.b[2].c().d++; } }",
        "@interface T { int v() default 1; String[] w() default {}; }", "enum E { A(1) { void f() {} }, B; int x; }", "interface I { default void f() {} static void g() {} private void h() {} }", "class A { /* <<<<<<< HEAD */ }\n// =======\n",
        "class A { var x = new B<>() { }; Outer.Inner<String>[] y; boolean z = o instanceof String s && s.isEmpty(); int record = 1; }",
    ],
    "js": [
        "", "'use strict';\nvar a = 1\nlet b = {x: 1, 'y': 2, [z]: 3, f() {}, get g() { return 1 }, ...r}\nconst {c, d: [e = 1, ...f]} = b", "a => a; (a, b) => ({}); async x => await x; async function* g() { yield* 1; for await (const x of y) {} }",
        "x = /[a-z{}/]+\\/1/g.test(y) / 2; if (a) /re/.exec(b); `a ${b + `c ${d}`} e`", "class A extends (b, C) { #p = 1; static { } static async *m() {} get x() { return this.#p } constructor() { super() } }",
        "for (var i in o) if (a) b(); else c()\nfor (const [k, v] of m) ;\nfor (;;) { break }\ndo { x++ } while (y)\nswitch (a) { case 1: b(); default: c }", "a?.b?.[c]?.(d) ?? e ** f; x ||= y; new A; new A.B(c).d; void 0, typeof x; l: for (;;) continue l", "return_ = a\n++b\nlet async = 1, of = 2, get = 3",
    ],
    "py": [
        "", "def f(a, /, b: int = 1, *c, d=2, **e) -> int:\n    return a if b else c\n", "class A(B, metaclass=C):\n    x: int = 1\n    @d\n    async def f(self): await g()\n", "match x:\n    case [1, *r] | {'a': b, **c} if d: pass\n    case P(x=1) as p:\n        pass\nmatch = 1\nmatch(x)\n",
        "with open(a) as b, c: pass\ntry:\n    x\nexcept (A, B) as e:\n    raise C from e\nelse: pass\nfinally: pass\n", "x = [i for i in range(3) if i] + [*a, *b]; y = {**a, 'b': 1}; z = {1, 2}; w = lambda *a, b=1: (yield)\nif (n := 1) > 2: print(f'{n!r:>{w}}', end='')\n", "a = 1 if b else \\\n  2\nd[1:2, ::3, ...] += 0x1F + 1_0.5e-3j\nglobal_ = not a in b is not c\n", "for x, *y in z: pass\ndel a, b[0]\nassert a, 'b'\nfrom . import (a as b, c,)\n",
    ],
    "json": ['{"a": [1, -2.5e3, true, null, "\\u00e9"]}', "[]", '"x"', "0"], "xml": ['<?xml version="1.0"?>\n<!-- c --><a b="c &amp; d"><d/>t<![CDATA[<x>]]></a>\n', "<a:b xmlns:a='c'/>", "<!DOCTYPE a [<!ENTITY x 'y'>]><a>&x;</a>"],
}
INVALID = {
    "java": ["class A {", "class A { int x = ; }", "class A { void f() { a(b) } }", "class A { void f() { foo.bar(x)\n y = 3; } }", "class A { }\n<<<<<<< HEAD\nclass B { }", 'class A { String s = "x; }', "class A { void f( { } }", "def f():\n    pass", "# Title", "class A { int 3x; }", "class A { void f() { if a { } } }", "class A { /* no end }"],
    "js": ["function f( {", "var a = ;", "import x from 'y'", "a b", "<<<<<<< HEAD\nvar a", "{ a: 1, b: 2 ", "x = 'a\n'", "if (a { }", "export default 1"], "py": ["def f(:\n  pass\n", "if a\n    b\n", "print 'x'\n", "def f():\nx\n", "x = (1\n", "  x\n", "a = 'b\n", "class A:\n    x\n  y\n", "<<<<<<< HEAD\n", "return 1 2\n"],
    "json": ["{'a': 1}", '{"a": 1,}', '{"a": t', "[1, 2", '{"a" 1}', "// c\n{}", "01", "NaN", "", "   "], "xml": ["<a>", "<a></b>", "<a b=c/>", "<a b='1' b='2'/>", "<a>&x;</a>", "<a/><b/>", "text", "", "<a>b & c</a>", "{}"],
}


@pytest.mark.parametrize("ext,text", [(e, t) for e, v in VALID.items() for t in v])
def test_valid(ext, text):
    assert first_error(ext, text) is None
    if ext == "py":
        ast.parse(text)


@pytest.mark.parametrize("ext,text", [(e, t) for e, v in INVALID.items() for t in v])
def test_invalid(ext, text):
    assert first_error(ext, text) is not None
    if ext == "py":
        with pytest.raises(SyntaxError):
            ast.parse(text)


@pytest.mark.parametrize("ext,text", [
    *(("java", "class A { void f() { %s } }" % x) for x in ("try { }", "try { a(); } b();", "5;", "true;", "-a;", '"x";', 'g("\\q");', "g('\\z');")),
    *(("py", x) for x in ("try:\n    pass\nexcept X, e:\n    pass\n", "f(a=1, 2)\n", "f(**a, *b)\n", "def f(a=1, b): pass\n", "x = lambda a=1, b: a\n", "os.chmod(p, 0755)\n", "x = 01\n")),
])
def test_invalid_again(ext, text):
    assert first_error(ext, text) is not None
    if ext == "py":
        with pytest.raises(SyntaxError):
            ast.parse(text)


@pytest.mark.parametrize("ext,text", [
    *(("java", "class A { void f() { %s } }" % x) for x in ("try (R r = a()) { }", "try { } catch (X e) { }", "try { } finally { }", '"x".length();', 'g("\\n\\0\\177\\s");', "this.a = 1;", "(a).b();", "++a;", "int b = -5;", "new A().b();", "super.f();", 'g("\\u0041");')),
    *(("py", x) for x in ("f(a, *b, c, d=1, *e, **g, h=2)\n", "f(x for x in y)\n", "def f(a, b=1, /, c=2, *, d, e=3, **g): pass\n", "def f(a, /, b): pass\n", "x = lambda a, b=1, *c, d, **e: a\n", "x = 0, 00, 0_0, 1_0, 0.5, 01.5, 01e3, 07j, 1., .5, 1e5, 3J\n", "class A(B, c=D): pass\n", "def f(*, a,): pass\n", "f(a, )\n")),
])
def test_valid_again(ext, text):
    assert first_error(ext, text) is None
    if ext == "py":
        ast.parse(text)


def test_edge_rows(spark):
    rows = [("p", "a.java", "class {"), ("p", "a.java", "class {"), ("p", "b.java", None), ("p", "c.java", ""), (None, "d.json", "{"), ("p", None, "x"), ("p", "e.txt", "{"), ("p", "f.java", "class A { " + "int x; " * 50_000 + "}")]
    df = spark.createDataFrame(rows, "project string, file string, text string").selectExpr("*", "1 AS line", "'x' AS ext")
    e = syntax_errors(df)
    assert {(r.project, r.file) for r in e.collect()} == {("p", "a.java"), (None, "d.json")} and e.count() == 2
    assert {(r.project, r.ext): r.rate for r in rates(df, e).collect()} == {("p", "java"): 0.5, (None, "json"): 1.0}
    assert syntax_errors(df.limit(0)).count() == 0


def test_query(spark):
    assert p5_found(spark, "/root/testdata/sf0.001").columns == ["project", "file"]


def test_snippets():
    """Hundreds of short files, judged when they were written down by javac 17, V8 and CPython 3.13."""
    snippets = json.loads(Path(__file__).with_name("syntax_snippets.json").read_text())
    assert [s for s in snippets if (first_error(s["ext"], s["text"]) is None) != s["valid"]] == []
    assert all(sum(s["valid"] is v for s in snippets if s["ext"] == e) > 60 for e in ("java", "js", "py") for v in (True, False))


def test_order_of_files_does_not_matter():
    texts = [(s["ext"], s["text"]) for s in json.loads(Path(__file__).with_name("syntax_snippets.json").read_text())]
    forward = {t: first_error(*t) for t in texts}
    for e in ("java", "js", "py"):
        syntax.grammar(e).memo.clear()
    assert {t: first_error(*t) for t in reversed(texts)} == forward


def test_deep_nesting_stays_linear():
    for ext, text in (("java", "class A { int x = " + "f(" * 2000 + "1" + ")" * 2000 + "; }"), ("js", "x = " + "new A(" * 2000 + ")" * 2000), ("js", "(" * 500 + "a" + ")" * 500), ("py", "x = " + "f(" * 1500 + ")" * 1500 + "\n")):
        assert first_error(ext, text) is None


MARKED = ("cafe\u0301", "\u0939\u093f\u0928\u094d\u0926\u0940", "a\u203fb")


@pytest.mark.parametrize("ext,text", [
    *((e, t % n) for e, t in (("java", "class A { int %s = 1; }"), ("js", "var %s = 1"), ("py", "%s = 1\n"), ("xml", "<%s/>")) for n in MARKED[:2 if e == "xml" else 3]),
    ("java", "class A { int a\u200cb, c\u00add, \u20ac, x\u20ac, class\u0301, y\x85; }"), ("js", "class A { #e\u0301 = 1 }\nvar a\ufeff =\u3000 1"), ("xml", "<a e\u0301='b'/>"), ("java", 'class A { String s = "C:\\\\users"; } // \\uu0041'),
])
def test_names_with_signs_that_are_no_letters(ext, text):
    assert first_error(ext, text) is None
    if ext == "py":
        ast.parse(text)


@pytest.mark.parametrize("ext,text,line", [
    ("java", "class A { }\n\u0301", 2), ("java", "class A {\u00a0}", 1), ("java", "class A { }\n\x0b", 2), ("java", "class A { }\n\u2028", 2), ("java", "class A {\r\n// C:\\users\r\n}", 2), ("js", "var a\n\x85", 2), ("js", "var \u0301a", 1),
    ("py", "\u0301a = 1\n", 1), ("py", "a = 1\n# \0\n", 2), ("xml", "<a\u00a0b='c'/>", 1), ("xml", "<a/>\u3000", 1), ("xml", "<\u0301a/>", 1),
])
def test_signs_that_no_file_may_have_there(ext, text, line):
    assert first_error(ext, text)[0] == line


@pytest.mark.parametrize("text", ["match w := x,:\n    case y: pass\n", "match a, *b, c := d:\n    case y: pass\n", 'f"{a = # b\n  }"\n', 'f"{a!r # b\n:>{c}}"\n'])
def test_python_assignments_in_subjects_and_comments_in_fields(text):
    assert first_error("py", text) is None
    ast.parse(text)
    assert first_error("py", text + "1 2\n")[0] == text.count("\n") + 1


@pytest.mark.parametrize("word,valid", [(w, False) for w in "default double final long native new private public short static volatile".split()] + [(w, True) for w in "module open permits record sealed tiny var yield".split()])
def test_words_of_java_in_names_of_packages(word, valid):
    """Judged by javac 17: a reserved word is no part of a package's name, a contextual one is."""
    for text in (f"package net.{word}.a;\n\nclass B {{ }}\n", f"import net.{word}.a.C;\n\nclass B {{ }}\n"):
        assert (first_error("java", text) is None) is valid
