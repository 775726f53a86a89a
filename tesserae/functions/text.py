"""Token and string functions as Column expressions: they stay in the JVM and inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import markers as M


def _rx(signs: list[str]) -> str:
    """An alternation of literal signs, for Java's and RE2's patterns alike."""
    return "|".join("".join("\\" + c if not c.isalnum() else c for c in s) for s in signs)


#: One token: two signs, one sign, tab, or a run of anything else but spaces.
CODE_TOKEN = f"({_rx(M.TWO_SIGNS)}|{_rx(M.ONE_SIGN)}|{_rx(M.ONE_SIGN_VERBOSE)}|\\t|\\n|[^ \\t\\n{''.join(chr(92) + c for c in M.ONE_SIGN + M.ONE_SIGN_VERBOSE)}]+)"
SHORT_TOKEN = f"({_rx(M.TWO_SIGNS)}|{_rx(M.ONE_SIGN)}|[^ {''.join(chr(92) + c for c in M.ONE_SIGN + ['|', '&', '-', '%', '^'])}]+|[|&%^-])"


def words(text: Column) -> Column:
    """Tokens of a rendered line: a final line end is dropped, single spaces divide, so empty tokens are possible."""
    return F.split(F.regexp_replace(text, r"\n\z", ""), " ", -1)


def lines(text: Column) -> Column:
    """Lines of a file; no empty one after a final line end."""
    t = F.regexp_replace(text, r"\r\n?", "\n")
    return F.split(F.regexp_replace(t, r"\n\z", ""), "\n", -1)


def spaces_to_tabs(text: Column) -> Column:
    return F.regexp_replace(text, " {4}", "\t")


def code_tokens(text: Column, token: str = CODE_TOKEN) -> Column:
    """Delimiter split in two stages: comment marks win anywhere, then two signs, one sign, identifiers."""
    pieces = F.split(F.regexp_replace(spaces_to_tabs(text), r"(/\*|\*/)", "\u0001$1\u0001"), "\u0001", -1)
    return F.flatten(F.transform(pieces, lambda p: F.when(p.isin(*M.COMMENT_MARKS), F.array(p)).otherwise(F.regexp_extract_all(p, F.lit(token), 1))))


def identifier_parts(word: Column) -> Column:
    return F.regexp_extract_all(word, F.lit(r"(_|[0-9]+|\p{IsUppercase}?\p{IsLowercase}+|\p{IsUppercase}+(?!\p{IsLowercase}))"), 1)


def capitalization(word: Column) -> Column:
    """none, all, first or undefined (no cased letter, or mixed)."""
    low, up, head = F.lower(word), F.upper(word), F.substring(word, 1, 1)
    cased = low != up
    return F.when(cased & (word == low), "none").when(cased & (word == up), "all").when(cased & (head == F.upper(head)) & (head != F.lower(head)), "first").otherwise("undefined")


def canonical(word: Column) -> Column:
    """Canonical form: all upper to lower, first upper to first lower, others as they are."""
    kind = capitalization(word)
    return F.when(kind == "all", F.lower(word)).when(kind == "first", F.concat(F.lower(F.substring(word, 1, 1)), F.substring(word, 2, 1_000_000))).otherwise(word)


def restore_case(form: Column, kind: Column) -> Column:
    first = F.concat(F.upper(F.substring(form, 1, 1)), F.lower(F.substring(form, 2, 1_000_000)))
    return F.when(kind == "all", F.upper(form)).when(kind == "first", first).otherwise(form)


def non_ascii(word: Column) -> Column:
    return word.rlike(r"[^\x00-\x7F]")


def dictionary_word(line: Column) -> Column:
    """The word of a dictionary line: what stands before ``/`` or a tab, in lower case."""
    return F.lower(F.element_at(F.split(line, "[/\t]"), 1))


def is_number(word: Column) -> Column:
    return word.rlike(rf"^(?:{M.NUMBER})\z")


def number_parts(number: Column) -> Column:
    """Sign, hex prefix, then character by character; suffix and exponent letters in lower case."""
    hexa = F.regexp_like(number, F.lit("^-?0x"))
    body = F.regexp_replace(number, "^-?(0x)?", "")
    chars = F.filter(F.split(body, ""), lambda c: c != "")
    low = F.transform(chars, lambda c: F.when(c.isin("l", "L"), "l").when(~hexa & c.isin("f", "F", "d", "D", "e", "E"), F.lower(c)).otherwise(c))
    return F.concat(F.when(number.startswith("-"), F.array(F.lit("-"))).otherwise(F.array().cast("array<string>")), F.when(hexa, F.array(F.lit("0x"))).otherwise(F.array().cast("array<string>")), low)


def mask_number(word: Column, frequent: Column) -> Column:
    """Infrequent numbers by kind; ``frequent`` is the array of numbers to keep."""
    kind = F.when(word.rlike(r"^[0-9]+\z"), "<decnumber>").when(word.rlike(r"^0x[0-9]+\z"), "<hexnumber>").when(word.rlike(r"^[0-9]+[l|L]\z"), "<longnumber>").otherwise(word)
    return F.when(F.array_contains(frequent, word), word).otherwise(kind)


def variables(text: Column) -> Column:
    """Format variables to ``<var>``."""
    return F.regexp_replace(F.regexp_replace(text, r"\{\}", M.VAR), "%[0-9]*[a-z]", M.VAR)


def around_variables(text: Column) -> Column:
    """``text`` cut before and after each ``<var>``."""
    return F.split(F.regexp_replace(variables(text), M.VAR, f"\u0001{M.VAR}\u0001"), "\u0001", -1)


def split_log_text(pieces: Column) -> Column:
    keep = lambda p: p.isin(M.VAR, M.STRING_RESOURCE)
    return F.flatten(F.transform(pieces, lambda p: F.when(keep(p), F.array(p)).otherwise(code_tokens(p))))


def string_resource(text: Column) -> Column:
    return F.regexp_replace(text, r"^([0-9a-zA-Z]+\.)+[0-9a-zA-Z]+\z", M.STRING_RESOURCE)


def without_placeholders(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, M.VAR, ""), M.STRING_RESOURCE, ""))


def lower_words(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.when(t.isin(M.VAR, M.STRING_RESOURCE), t).otherwise(F.lower(t)))


def without_stop_words(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*M.STOP_WORDS))


def without_signs(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*M.ONE_SIGN, *M.TWO_SIGNS, *M.COMMENT_MARKS))


def merge_tabs(tokens: Column) -> Column:
    """Each run of n tabs becomes one token ``\\tn``."""
    # one pass over the joined tokens: growing an array token by token would copy it each time
    joined = F.concat(F.array_join(tokens, "\u0001"), F.lit("\u0001"))
    runs = F.regexp_extract_all(joined, F.lit("((?:\t\u0001)+|[^\u0001]*\u0001)"), 1)
    shown = F.transform(runs, lambda r: F.when(r.startswith("\t\u0001"), F.concat(F.lit("\t"), F.floor(F.length(r) / 2).cast("string"))).otherwise(F.replace(r, F.lit("\u0001"), F.lit(""))))
    return F.when(F.size(tokens) > 0, shown).otherwise(tokens)


def mask_identifiers(tokens: Column, keep: list[str] | None = None) -> Column:
    known = [*M.KEYWORDS, *M.COMMENT_MARKS, *M.TWO_SIGNS, *M.ONE_SIGN, *M.ONE_SIGN_VERBOSE, "\t", "\n", *M.ALL, *(f"\t{i}" for i in range(11)), *(keep or [])]
    return F.transform(tokens, lambda t: F.when(is_number(t) | t.isin(*known), t).otherwise(M.IDENTIFIER))


def escape_line(tokens: Column) -> Column:
    """A stored line: tokens joined by spaces, backslash and control characters escaped, the end token added."""
    joined = F.array_join(tokens, " ")
    for raw, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        joined = F.replace(joined, F.lit(raw), F.lit(shown))
    return F.concat(joined, F.lit(f" {M.END}\n"))


def append_end(tokens: Column) -> Column:
    return F.array_append(tokens, F.lit(M.END))


def interleave(tokens: Column, separator: str) -> Column:
    """``separator`` between all tokens."""
    both = F.flatten(F.transform(tokens, lambda t: F.array(t, F.lit(separator))))
    return F.slice(both, 1, F.greatest(F.size(both) - 1, F.lit(0)))


def log_level(method: Column) -> Column:
    level = None
    for name, rx in M.METHODS.items():
        cond = method.rlike(rf"^(?:{rx})\z")
        level = F.when(cond, name) if level is None else level.when(cond, name)
    return level.otherwise("unknown")


def positive_level(level: Column) -> Column:
    return F.when(level == "unknown", F.raise_error(F.lit("unknown level has no sign"))).otherwise(level.isin(*M.POSITIVE_LEVELS))


def last_levels(path: Column, n: int = 2) -> Column:
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), n), "/")


def pairs(symbols: Column) -> Column:
    """Adjacent pairs as structs (left, right)."""
    n = F.greatest(F.size(symbols) - 1, F.lit(0))
    return F.zip_with(F.slice(symbols, 1, n), F.slice(symbols, 2, n), lambda a, b: F.struct(a.alias("left"), b.alias("right")))


def without_ranges(tokens: Column, ranges: Column) -> Column:
    """``tokens`` without the positions in ``ranges`` (from, to), to exclusive; ranges don't overlap. What is between
    them is sliced out, so the ranges are evaluated once and not for each token."""
    r = F.sort_array(ranges)
    starts = F.concat(F.array(F.lit(0)), F.transform(r, lambda x: x["to"]))
    ends = F.concat(F.transform(r, lambda x: x["from"]), F.array(F.size(tokens)))
    return F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(tokens, a + 1, F.greatest(b - a, F.lit(0)))))


def ranges_between(tokens: Column, begin: str, end: str) -> Column:
    """(from, to) of each ``begin`` and the first ``end`` behind it; the next search starts after that end."""
    start = F.struct(F.array().cast("array<struct<from:int,to:int>>").alias("out"), F.lit(-1).alias("open"))
    indexed = F.filter(F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda x: x.t.isin(begin, end))

    def step(a, x):
        opened = F.struct(a.out.alias("out"), x.i.alias("open"))
        closed = F.struct(F.array_append(a.out, F.struct(a.open.alias("from"), x.i.alias("to"))).alias("out"), F.lit(-1).alias("open"))
        return F.when((a.open < 0) & (x.t == begin), opened).when((a.open >= 0) & (x.t == end), closed).otherwise(a)
    return F.aggregate(indexed, start, step, lambda a: a.out)


def context_before(tokens: Column, position: Column, length: int) -> Column:
    """The ``length`` tokens before ``position`` that are no logging markers, padded on the left."""
    kept = F.filter(F.slice(tokens, 1, F.greatest(position, F.lit(0))), lambda t: ~t.isin(*M.LOGGING))
    n = F.least(F.size(kept), F.lit(length))
    return F.concat(F.array_repeat(F.lit(M.PAD), length - n), F.slice(kept, F.size(kept) - n + 1, n))


def context_after(tokens: Column, position: Column, length: int) -> Column:
    """The ``length`` tokens behind ``position`` that are no logging markers, padded on the right."""
    rest = F.slice(tokens, position + 2, F.greatest(F.size(tokens) - position - 1, F.lit(0)))
    kept = F.slice(F.filter(rest, lambda t: ~t.isin(*M.LOGGING)), 1, length)
    return F.concat(kept, F.array_repeat(F.lit(M.PAD), length - F.size(kept)))


def prediction_context(tokens: Column, length: int, backwards: bool = False) -> Column:
    t = F.reverse(tokens) if backwards else tokens
    n = F.least(F.size(t), F.lit(length))
    return F.slice(t, F.size(t) - n + 1, n)


def replace_segment(tokens: Column, start: Column, end: Column, new: Column) -> Column:
    """``tokens`` with the positions from ``start`` to before ``end`` replaced by ``new``."""
    return F.concat(F.slice(tokens, 1, start), new, F.slice(tokens, end + 1, F.greatest(F.size(tokens) - end, F.lit(0))))


def joined(tokens: Column) -> Column:
    """Tokens for a reader, a blank between them."""
    return F.array_join(tokens, " ")


def without_duplicates(tokens: Column) -> Column:
    """Each token once, in the order of its first place."""
    return F.array_distinct(tokens)


def checked_form(form: Column) -> Column:
    """A word's canonic form; an empty one, or one that is or begins in upper case, is an error."""
    upper = lambda c: (c == F.upper(c)) & (c != F.lower(c))
    first = F.substring(form, 1, 1)
    return F.when(form == "", F.raise_error(F.lit("a word has a sign at least"))).when(upper(form) | upper(first), F.raise_error(F.concat(F.lit("no canonic form: "), form))).otherwise(form)
