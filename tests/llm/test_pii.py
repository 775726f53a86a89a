import pytest

from tesserae.llm import pii


@pytest.mark.parametrize("text,kind,value", [
    ("From: A <x.y+z@mail.a-b.example>", "email", "x.y+z@mail.a-b.example"), ("write a_b [at] c [dot] d [dot] com now", "email", "a_b [at] c [dot] d [dot] com"), ("to a (at) b.test.", "email", "a (at) b.test"), ("me AT mail DOT x DOT org, please", "email", "me AT mail DOT x DOT org"),
    ("Tel. +44 (0)1632 960 345", "phone", "+44 (0)1632 960 345"), ("ring me (+1 (548) 555-0152 ext. 142)", "phone", "+1 (548) 555-0152 ext. 142"), ("mobile is +49 (0)30 / 23125-516.", "phone", "+49 (0)30 / 23125-516"), ("Call 788.555.0156.", "phone", "788.555.0156"), ("Call 01 99 00 34 39 when", "phone", "01 99 00 34 39"),
    ("ssn=919-78-5901", "id_number", "919-78-5901"), ("DNI EX 98 55 97 B", "id_number", "EX 98 55 97 B"), ("taxId: 60288148-J", "id_number", "60288148-J"), ("PESEL/NIN 14071522440 is", "id_number", "14071522440"), ("passport K2R299314 was", "id_number", "K2R299314"),
    ("to Flat 5, 87 Saltmarsh Street, Marrow Falls KX3 4QT.", "address", "Flat 5, 87 Saltmarsh Street, Marrow Falls KX3 4QT"), ("bei Am Mühlteich 94B, 35092 Grauwalde ab", "address", "Am Mühlteich 94B, 35092 Grauwalde"), ("en Plaza del Molino 230, 5º B.", "address", "Plaza del Molino 230, 5º B"),
    ("au 211 avenue du Vieux-Port, 65719 Brécourt-le-Bas", "address", "211 avenue du Vieux-Port, 65719 Brécourt-le-Bas"), ("to 62B Quarry Rd..", "address", "62B Quarry Rd."), ("cc Lars Venander please", "person", "Lars Venander"), ("Thanks to N. Ravuso for", "person", "N. Ravuso"), ("@author Maretti, Saskia", "person", "Maretti, Saskia"),
    ("As ALDO ZANAUX said last week", "person", "ALDO ZANAUX"), ("name='Katya E. Ulvley'", "person", "Katya E. Ulvley"), ("Signed-off-by: Zork Quibble", "person", "Zork Quibble"),
])
def test_found(text, kind, value):
    assert [(k, text[s:e]) for s, e, k in pii.spans(text)] == [(kind, value)] or (kind, value) in [(k, text[s:e]) for s, e, k in pii.spans(text)]


@pytest.mark.parametrize("text", [
    "receipt@89.93.1 from the registry", "git@code.example:delta/event.git", "entry@localhost", "icon_storage@2x.png is", "ISBN 978-0-00-17526-86", "timestamp 16535550992", "Build 2024-0101-555 took", "10.0.96.56:8080", "version 74.93.197", "MAC 00:1b:69:54:ff:01",
    "Main Thread waits on FooBar.", "Wall Clock and Road Map are renamed", "The Quick Sort of X is stable.", "@Override is missing on X.", "uuid 5e1f8a4b94e-4c2a-4f00-9a1b-008a4b94e", "See issue #4415550177 and commit 270033d.", "", "   ", None,
])
def test_not_found(text):
    assert pii.spans(text) == []


def test_edge_rows(spark):
    long = "word " * 200_000 + "a.b@c.test" + " word" * 1000
    df = spark.createDataFrame([(1, "x a.b@c.test y a.b@c.test"), (2, None), (3, ""), (4, long)], "doc_id bigint, text string").selectExpr("*", "'e' AS kind", "1 AS value")
    assert {tuple(r) for r in pii.find(df).collect()} == {(1, "email", "a.b@c.test"), (4, "email", "a.b@c.test")}
    r = {x.doc_id: x.text for x in pii.redact(df).collect()}
    assert r[1] == "x [EMAIL] y [EMAIL]" and r[2] is None and r[3] == "" and len(r[4]) == len(long) - 3
    assert pii.find(df.limit(0)).count() == 0


@pytest.mark.parametrize("text,value", [
    ("The parser was rewritten for Hiroshi Tanaka last year.", "Hiroshi Tanaka"), ("It was Chloe Bennett who fixed it", "Chloe Bennett"), ("Reviewed-by: Peter Close", "Peter Close"), ("Signed-off-by: Zork Road", "Zork Road"), ("we met Anna Quick there", "Anna Quick"),
])
def test_names_outside_the_test_tables(text, value):
    assert [(k, text[s:e]) for s, e, k in pii.spans(text)] == [("person", value)]


def test_cued_name_counts_again_in_its_document():
    text = "Signed-off-by: Zork Quibble\nThen Zork Quibble left."
    assert [text[s:e] for s, e, _ in pii.spans(text)] == ["Zork Quibble"] * 2


def test_names_are_learnt_from_cues(spark):
    texts = ["Signed-off-by: Zork Quibble", "@author Zork Wexley", "Acked-by: Blen Quibble", "as Zork Marl fixed it", "so Ombra Quibble left", "Reviewed-by: Once Seen", "as Once Other", "Close The Road Map", "for Main Quibble"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {(r.doc_id, r.value) for r in pii.find(df).collect()}
    assert got == {(0, "Zork Quibble"), (1, "Zork Wexley"), (2, "Blen Quibble"), (3, "Zork Marl"), (4, "Ombra Quibble"), (5, "Once Seen")}


ALONE = [
    *((v, "id_number") for v in ("919-78-5901", "EX 98 55 97 B", "AB123456C", "60288148-J", "60288148J", "X-1234567-L", "X1234567L", "Y1234567-L", "Z-1234567L", "K2R299314", "C12345678", "AB1234567")),
    *((f"12 Sunset {w}", "address") for w in (*pii._EN_STREETS, *pii._EN_SHORT, "St")), *((f"Berliner {w} 3", "address") for w in pii._DE_STREETS), *((f"Lind{w} 3", "address") for w in pii._DE_ENDINGS), *((f"{w} Mühlteich 4", "address") for w in pii._DE_HEADS),
    *((f"{w} Molino 23", "address") for w in pii._ROMANCE), *((f"11 {w} Vieux", "address") for w in pii._FR_STREETS),
    *((f"pat {o}{b}{w}{b}{c} mail.test", "email") for o, c in ("[]", "()", "{}", "<>") for w in pii._AT for b in ("", " ", "\t")), ("pat AT mail DOT test", "email"), ("pat at mail dot test", "email"), ("pat\tAT\tmail DOT test", "email"), ("pat@mail.test", "email"), ("pat＠mail.test", "email"),
]


@pytest.mark.parametrize("value,kind", ALONE)
def test_each_form_alone(value, kind):
    assert [(k, s, e) for s, e, k in pii.spans(f"x: {value}\n")] == [(kind, 3, 3 + len(value))]


@pytest.mark.parametrize("n", [1, 20, 160, 170, 500, 100_000])
def test_values_of_any_length_are_whole(n):
    mail = "a" * n + ".b@" + "c" * n + ".example.org"
    text = f"see {mail} or ask"
    assert {text[a:b] for a, b, k in pii.spans(text) if k == "email"} == {mail}
    assert pii.spans("x" * n + f" Reviewed-by: Anna B{'b' * n}son")[-1][1:] == (len("x" * n + f" Reviewed-by: Anna B{'b' * n}son"), "person")


def test_long_lines_stay_linear():
    for line in ("x at y dot com ", "Calle Mayor 3 ", "Ann Smith wrote: ", "call +44 20 7946 0958 or "):
        assert len(pii.spans(line * 5_000)) >= 1
