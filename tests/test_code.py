"""Golden cases of tokenizing, segmenting, marking and rendering."""

import random

import pytest

from tesserae.functions import code, markers as M
from tesserae.operators.config import Code, SplitConfig, derived_name, diff, nearest, patched
from tesserae.operators.repr import preprocess


def texts(line):
    return [t.text for t in code.split_line(line)]


def test_numbers_are_found_and_taken_apart():
    line = "long[] lovely_longs = {0x34a35EL,     0x88bc96fl           , -0x34L};"
    numbers = [t for t in code.split_line(line) if t.kind == "number"]
    assert ["".join(t.parts) for t in numbers] == ["0x34a35El", "0x88bc96fl", "-0x34l"]
    assert texts(line).count("\t") == 3
    assert code.number_parts("-0.43E4f") == ("-", "0", ".", "4", "3", "e", "4", "f")
    assert code.number_parts("0x1fE") == ("0x", "1", "f", "E")


@pytest.mark.parametrize("word,parts", [
    ("_my_favoRite_ints_", "_ my _ favo Rite _ ints _"), ("BigAWESOMEString", "Big AWESOME String"), ("a2y", "a 2 y"), ("_test_my123GmyClass_", "_ test _ my 123 Gmy Class _"), ("MalformedURLException", "Malformed URL Exception"),
])
def test_identifiers_split(word, parts):
    assert [code.restored(f, c) for f, c, _ in code.identifier(word).parts] == parts.split()


def test_comment_marks_win_over_two_signs():
    assert texts("~-|=?==!=/* gj **/") == ["~", "-", "|=", "?", "==", "!=", "/*", "gj", "*", "*/"]


def kinds(text):
    return [(t.text, t.ctx) for t in code.parse(text) if t.kind not in ("nl", "tab")]


def test_quotes_and_comments():
    assert kinds('a "// x" b')[1:5] == [('"', "str"), ("//", "str"), ("x", "str"), ('"', "str")]
    assert all(c == "olc" for _, c in kinds("// a */ \" b"))
    assert all(c is None for _, c in kinds("a */ b")) and all(c is None for _, c in kinds('"a\nb"'))
    assert [c for _, c in kinds("'\"' x")] == [None] * 4


def logs(text):
    return [(t.level, t.log_role) for t in code.parse(text) if t.log_id]


def test_logging_statements():
    assert {x[0] for x in logs('log.info("Hi");')} == {"info"}
    tail = logs('log.d("Hi")\n\n\t\t;')
    assert tail[0][0] == "debug" and [r for _, r in tail].count("tail") == 5
    assert not logs('log.info("Hi")') and not logs('log info("Hi");') and not logs('log log.info("Hi");') and not logs('log.what("Hi");')
    assert not logs("log.info(" + "a " * 40 + ");") and logs("log.info(" + "a " * 39 + ");")
    assert {x[0] for x in logs('log.logI(("Hi") * 2);')} == {"info"}
    assert [x[0] for x in logs("log.t(a); LOG.SEVERE(b);")][::8] == ["trace", "fatal"]


def test_blocks_are_method_bodies():
    t = code.parse("class A { static { a(); } class B { void f() { b(); } } }")
    assert [x.text for x in t if x.block_id] == ["{", "a", "(", ")", ";", "}", "{", "b", "(", ")", ";", "}"]
    assert not any(x.block_id for x in code.parse("class A { void f() { } } }"))


@pytest.mark.parametrize("digits,text,expected", [
    ("000000", "hideSoftInputFromWindow", "hideSoftInputFromWindow"), ("101110", "hideSoftInputFromWindow", "`w hide Soft Input From Window w`"),
    ("101110", "LAYOUT_INFLATER_SERVICE", "`w LAYOUT _ INFLATER _ SERVICE w`"), ("101111", "Window", "`C window"), ("021101", 'x = "a"; // b', "x = <str_literal> ; <comment>"), ("301011", "naïve ab", "`E ab"),
])
def test_rendering(digits, text, expected):
    assert [t for t in preprocess(text, digits) if t != "\n"] == expected.split(" ")


def test_rendering_with_merges():
    out = [t for t in preprocess("While", "004011", SplitConfig("bpe", merges={("w", "h"): 0})) if t != "\n"]
    assert out == ["`w", "`C", "wh", "i", "l", "e", "w`"]


def test_log_markers_surround_a_statement():
    out = preprocess('class A { void f() { log.info("x"); } }', "001111")
    assert out[out.index(M.LOG):out.index(M.LOG_END) + 1][:2] == ["`L", "`info"] and out.index(M.BLOCK) < out.index(M.LOG) < out.index(M.BLOCK_END)


def test_codes():
    assert str(Code.parse("101111")) == "101111"
    for bad in ("10111", "400000", "100000", "000001", "221000", "00a000"):
        with pytest.raises(ValueError):
            Code.parse(bad)
    with pytest.raises(ValueError):
        Code.parse("101100").for_classification()
    assert str(Code.parse("003110").merge_base()) == "101100"


def test_full_words_and_rest():
    assert code.full_words("a b `w c d w` e `C".split()) == ([(0, 1), (1, 2), (2, 6), (6, 7)], 7)
    assert code.full_words("`L `info `C x w`".split()) == ([(2, 4)], 5)


def test_beautify():
    assert code.beautify("`w `C artifact `C request `C builder `C class w`") == "ArtifactRequestBuilderClass"
    assert code.beautify("`w `Cs to do w`") == "TODO"
    assert code.beautify("<pad> <pad> a . b ;") == "2x<pad> a.b;\n"


def test_typos():
    assert code.is_typo("abcd", "abdc") and code.is_typo("abc", "abcd") and code.is_typo("abcd", "abxd")
    assert not code.is_typo("abcd", "badc") and not code.is_typo("abc", "abc")


def test_configs():
    a, b = {"x": {"y": 1, "z": 2}}, {"x": {"y": 1, "z": 3}}
    assert diff(a, b) == {"x.z": (2, 3)} and derived_name("n", diff(a, b)) == "n_z_3"
    assert nearest(b, {"p": a, "q": {"x": {}}})[0] == "p" and patched(a, {"x.y": 5})["x"]["y"] == 5
    with pytest.raises(AttributeError):
        patched(a, {"x.q": 1})


def test_short_cuts_of_the_tokenizer_change_nothing():
    r = random.Random(6)
    words = ["".join(r.choice("aBCd_019$") for _ in range(r.randint(1, 12))) for _ in range(3000)]
    assert all(code._ASCII_PARTS.findall(w) == code._PARTS.findall(w) for w in words)
    assert {s[0] for s in code._TWO} <= set(code._ONE)
    assert [(t.kind, t.text) for t in code.split_line("a /* b*c */ d **= 1")] == [("ident", "a"), ("op", "/*"), ("ident", "b"), ("op", "*"), ("ident", "c"), ("op", "*/"), ("ident", "d"), ("op", "**"), ("op", "="), ("ident", "1")]
    rendering = Code.parse("101111").rendering()
    assert [code.render(code.parse(t), rendering) for t in ("getURL", "été getURL", "getURL")] == [["`w", "get", "`Cs", "url", "w`"], ["`E", "`w", "get", "`Cs", "url", "w`"], ["`w", "get", "`Cs", "url", "w`"]]
