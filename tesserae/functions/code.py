"""Parsing of source text into annotated tokens, and rendering of them.

These are the character and state machines that expressions can't hold. They run inside Arrow batches
(``operators/repr.py``), one file at a time, and know nothing of Spark.

A parsed file is a flat list of ``Token``. Containers are runs of equal ids: ``ctx_id`` for comments and
string literals, ``log_id`` for logging statements, ``block_id`` for blocks that may hold one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

import regex

from . import markers as M


@dataclass(slots=True)
class Token:
    """``kind``: op, nl, tab, ident, number or raw. ``parts``: (form, case, non-English) of an identifier, strings of a number."""

    kind: str
    text: str
    parts: tuple = ()
    ctx: str | None = None
    ctx_id: int = 0
    log_id: int = 0
    log_role: str | None = None
    level: str | None = None
    block_id: int = 0


_TWO, _ONE = sorted(M.TWO_SIGNS), [*M.ONE_SIGN, *M.ONE_SIGN_VERBOSE]
# every sign of two begins like one of one, so the order of words and signs is free; words are the most
_SPLIT = re.compile(r"[^ \t\n" + (_signs := re.escape("".join(_ONE))) + "]+|" + "|".join(map(re.escape, _TWO)) + rf"|[\t\n{_signs}]")
_COMMENT_MARK = re.compile(r"(/\*|\*/)")
_NUMBER = regex.compile(rf"(?:^|(?<=[^[:lower:][:upper:][:digit:]_])){M.NUMBER}(?![[:lower:][:upper:][:digit:]_.]|$)")
_DIGIT = re.compile(r"\d")
_PARTS = regex.compile(r"_|\d+|[[:upper:]]?[[:lower:]]+|[[:upper:]]+(?![[:lower:]])")
_ASCII_PARTS = re.compile(r"_|[0-9]+|[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_LOGGER, _METHOD = re.compile(M.LOGGER), re.compile("|".join(M.METHODS.values()))


def level_of(method: str) -> str:
    return next((name for name, rx in M.METHODS.items() if re.fullmatch(rx, method)), "unknown")


def number_parts(text: str) -> tuple[str, ...]:
    out = []
    if text.startswith("-"):
        out.append("-")
        text = text[1:]
    hexa = text.startswith("0x")
    if hexa:
        out.append("0x")
        text = text[2:]
    return (*out, *(c.lower() if c in "lL" or not hexa and c in "fFdDeE" else c for c in text))


def case_of(word: str) -> str:
    if word.islower():
        return "none"
    if word.isupper():
        return "all"
    return "first" if word[:1].isupper() else "undefined"


def canonical(word: str) -> str:
    kind = case_of(word)
    return word.lower() if kind == "all" else word[0].lower() + word[1:] if kind == "first" else word


def restored(form: str, kind: str) -> str:
    return form.upper() if kind == "all" else form.capitalize() if kind == "first" else form


@lru_cache(maxsize=1 << 17)
def identifier_parts(text: str) -> tuple:
    return tuple(map(_word, (_ASCII_PARTS if text.isascii() else _PARTS).findall(text)))


@lru_cache(maxsize=1 << 17)
def _word(part: str) -> tuple[str, str, bool]:
    return canonical(part), case_of(part), False


def identifier(text: str) -> Token:
    return Token("ident", text, identifier_parts(text))


def split_line(line: str) -> list[Token]:
    """Tokens of one line: numbers, then four spaces to a tab, then delimiters, then identifiers."""
    out: list[Token] = []
    at = 0
    for m in _NUMBER.finditer(line) if _DIGIT.search(line) else ():
        if m.start() > at:
            _split_piece(line[at:m.start()], out)
        out.append(Token("number", m[0], number_parts(m[0])))
        at = m.end()
    _split_piece(line[at:], out)
    return out


def _split_piece(piece: str, out: list[Token]) -> None:
    piece = piece.replace("    ", "\t")
    for part in _COMMENT_MARK.split(piece) if "*" in piece else (piece,):
        if part in M.COMMENT_MARKS:
            out.append(Token("op", part))
            continue
        for t in _SPLIT.findall(part):
            kind = _KINDS.get(t)
            out.append(Token(kind, t) if kind else identifier(t))


_KINDS = {**dict.fromkeys([*_TWO, *_ONE], "op"), "\t": "tab", "\n": "nl"}


def tokenize(text: str) -> list[Token]:
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    out: list[Token] = []
    for line in lines:
        out += split_line(line)
        out.append(Token("nl", "\n"))
    return out


def mark_text(tokens: list[Token]) -> bool:
    """Mark comments and string literals; False (and no marks) if a string holds a line end or a comment ends that never began."""
    runs, active, begin = [], None, -1
    for i, t in enumerate(tokens):
        if t.kind == "nl":
            if active == '"':
                return False
            if active == "//":
                runs.append((begin, i - 1, "olc"))
                active = None
        elif t.kind == "op":
            if t.text == '"':
                back = i - 1
                while back >= 0 and tokens[back].text == "\\":
                    back -= 1
                quoted_char = 0 < i < len(tokens) - 1 and tokens[i - 1].text == "'" and tokens[i + 1].text == "'"
                if (i - back) % 2 == 0 or quoted_char:
                    continue
                if active == '"':
                    runs.append((begin, i, "str"))
                    active = None
                elif active is None:
                    active, begin = '"', i
            elif t.text == "*/":
                if active is None:
                    return False
                if active == "/*":
                    runs.append((begin, i, "mlc"))
                    active = None
            elif t.text in ("/*", "//") and active is None:
                active, begin = t.text, i
    for n, (a, z, kind) in enumerate(runs, 1):
        for t in tokens[a:z + 1]:
            t.ctx, t.ctx_id = kind, n
    return True


def mark_logs(tokens: list[Token]) -> None:
    """Mark logging statements ``logger . method ( ... ) ;`` outside of text."""
    n, i, found = len(tokens), 0, 0
    word = lambda t, rx: t.kind == "ident" and not t.ctx and rx.fullmatch(t.text)
    while i < n:
        if tokens[i].kind != "ident" or not word(tokens[i], _LOGGER):
            i += 1
            continue
        j, ok = i + 4, i + 3 < n and tokens[i + 1].text == "." and word(tokens[i + 2], _METHOD) and tokens[i + 3].text == "(" and not any(t.ctx for t in tokens[i + 1:i + 4])
        if not ok:
            i += 1
            while i < n and word(tokens[i], _LOGGER):  # a token that ends a failed match starts no new one
                i += 1
            continue
        depth, length, content = 1, 0, j
        while j < n:
            length += not (tokens[j].ctx_id and j and tokens[j - 1].ctx_id == tokens[j].ctx_id)
            if length > M.LOG_LENGTH:
                break
            if not tokens[j].ctx:
                depth += (tokens[j].text == "(") - (tokens[j].text == ")")
                if not depth:
                    break
            j += 1
        end = j
        if j < n and not depth:
            j += 1
            while j < n and tokens[j].kind in ("nl", "tab") and not tokens[j].ctx:
                j += 1
            if j < n and tokens[j].text == ";" and not tokens[j].ctx:
                found += 1
                level = level_of(tokens[i + 2].text)
                roles = {i: "object", i + 1: "dot", i + 2: "method", i + 3: "open", end: "close"}
                for k in range(i, j + 1):
                    tokens[k].log_id, tokens[k].level = found, level
                    tokens[k].log_role = roles.get(k) or ("content" if content <= k < end else "tail")
                i = j + 1
                continue
        i = min(j, n - 1) + 1


def mark_blocks(tokens: list[Token]) -> bool:
    """Mark the blocks in which a statement may stand: bodies of methods and static blocks, not of classes.
    False (and no marks) if a bracket closes that never opened or a class has no body."""
    depth: list[int] = []
    waiting, block, current = False, 0, 0
    marks = [0] * len(tokens)
    previous = ""
    for i, t in enumerate(tokens):
        plain = not t.ctx and not t.log_id
        inside = bool(depth) and depth[-1] > 0 and not waiting
        if plain and t.text == "{":
            if waiting or not depth:
                depth.append(0)
                waiting = False
                current = 0
            else:
                if depth[-1] == 0:
                    block += 1
                    current = block
                depth[-1] += 1
                marks[i] = current
        elif plain and t.text == "}":
            if waiting or not depth:
                return False
            if depth[-1] > 0:
                depth[-1] -= 1
                marks[i] = current
                if not depth[-1]:
                    current = 0
            else:
                depth.pop()
                if depth and depth[-1] > 0:
                    block += 1
                    current = block
                    marks[i] = current
        elif plain and t.kind == "ident" and t.text in ("class", "enum", "interface") and previous != ".":
            if waiting:
                return False
            waiting = True
            current = 0
        elif inside:
            if not current:
                block += 1
                current = block
            marks[i] = current
        previous = t.text
    for t, b in zip(tokens, marks):
        t.block_id = b
    return True


def mark_language(tokens: list[Token], non_english: frozenset[str] = frozenset()) -> None:
    """Mark the identifier parts that aren't English: outside ASCII, or in the dictionary of foreign words."""
    for t in tokens:
        if t.kind == "ident" and (non_english or not t.text.isascii()) and t.log_role not in ("object", "method"):
            t.parts = tuple((f, c, not f.isascii() or f.lower() in non_english) for f, c, _ in t.parts)


def is_foreign(t: Token) -> bool:
    return any(not isinstance(p, str) and p[2] for p in t.parts)


def parse(text: str, non_english: frozenset[str] = frozenset()) -> list[Token]:
    tokens = tokenize(text)
    if mark_text(tokens):
        mark_logs(tokens)
        mark_blocks(tokens)
    mark_language(tokens, non_english)
    return tokens


@dataclass(frozen=True)
class Rendering:
    """What a six-digit code asks for, and how words are split further. ``split_word``: form -> pieces."""

    english: int = 0
    text: int = 0
    split: int = 0
    drop_layout: bool = False
    mark_logs: bool = False
    lower: bool = False
    split_word: object = field(default=None, compare=False)
    nested_content: bool = False
    #: The token strings of a part of an identifier: parts repeat far more than identifiers.
    part: object = field(init=False, compare=False, repr=False)

    def __post_init__(self):
        object.__setattr__(self, "part", lru_cache(maxsize=1 << 17)(lambda part: tuple(_part(*part, self))))


def render(tokens: list[Token], r: Rendering) -> list[str]:
    """The token strings of a parsed file under a rendering."""
    out: list[str] = []
    ctx = log = block = 0
    i, n = 0, len(tokens)
    while i < n:
        t = tokens[i]
        if r.mark_logs:
            if log and t.log_id != log:
                out.append(M.LOG_END)
            if block and t.block_id != block:
                out.append(M.BLOCK_END)
            if t.block_id and t.block_id != block:
                out.append(M.BLOCK)
            if t.log_id and t.log_id != log:
                out += [M.LOG, M.LEVEL_MARK[t.level or "unknown"]]
            log, block = t.log_id, t.block_id
        if t.ctx_id and t.ctx_id != ctx:
            ctx = t.ctx_id
            j = i
            while j < n and tokens[j].ctx_id == ctx:
                j += 1
            out += _text(tokens[i:j], r)
            i = j
            continue
        ctx = t.ctx_id
        if t.kind == "op":
            out.append(t.text)
        else:
            out += _one(t, r)
        i += 1
    if r.mark_logs:
        if log:
            out.append(M.LOG_END)
        if block:
            out.append(M.BLOCK_END)
    return out


def _text(run: list[Token], r: Rendering) -> list[str]:
    kind = run[0].ctx
    if kind == "str" and r.text in (1, 2):
        return [M.STRING]
    if kind != "str" and r.text in (2, 3):
        return [M.COMMENT]
    inner = run[1:] if kind == "olc" else run[1:-1]
    opened, closed = {"olc": ("//", [M.LINE_COMMENT_END]), "mlc": ("/*", ["*/"]), "str": ('"', ['"'])}[kind]
    if r.english == 2:
        foreign = sum(any(p[2] for p in t.parts) for t in inner if t.kind == "ident") if r.nested_content else 0
        if foreign >= 4 and foreign > 0.2 * len(inner):
            # a multi-line comment of foreign content opens like a one-line one and isn't closed
            return ["//" if kind != "str" else '"', M.NON_ENG_CONTENT, *(closed if kind != "mlc" else [])]
    return [opened, *(s for t in inner for s in _one(t, r)), *closed]


def _one(t: Token, r: Rendering) -> list[str]:
    kind = t.kind
    if kind == "nl" or kind == "tab":
        return [] if r.drop_layout else [t.text]
    if kind == "number":
        if r.split < 2:
            return ["".join(t.parts)]
        return list(t.parts) if len(t.parts) == 1 else [M.WORD_START, *t.parts, M.WORD_END]
    if kind != "ident":
        return [t.text]
    if not r.split:
        return ["".join(restored(f, c) for f, c, _ in t.parts)]
    res: list[str] = []
    for p in t.parts:
        res += r.part(p)
    if len(res) == 1 or len(res) == 2 and res[0] in (M.CAPITAL, M.CAPITALS):
        return res
    return [M.WORD_START, *res, M.WORD_END]


def _part(form: str, kind: str, foreign: bool, r: Rendering) -> list[str]:
    mark = [{"first": M.CAPITAL, "all": M.CAPITALS}[kind]] if r.lower and kind in ("first", "all") else []
    if foreign and r.english and (r.english != 3 or not form.isascii()):
        return [*mark, M.NON_ENG]
    pieces = list(r.split_word(form)) if r.split_word and form != "_" else [form]
    if r.lower:
        return [*mark, *pieces]
    if kind == "all":
        return [p.upper() for p in pieces]
    return [pieces[0].capitalize(), *pieces[1:]] if kind == "first" else pieces


def full_words(tokens: list[str]) -> tuple[list[tuple[int, int]], int]:
    """(from, to) of each full word, and where an unfinished one begins (the length if none does)."""
    skip = {*M.LOGGING} - {M.LEVEL_MARK["unknown"]}
    out, i, n = [], 0, len(tokens)
    while i < n:
        t = tokens[i]
        if t in skip or t == M.WORD_END:
            i += 1
        elif t == M.WORD_START:
            j = i + 1
            while j < n and tokens[j] != M.WORD_END:
                j += 1
            if j == n:
                return out, i
            out.append((i, j + 1))
            i = j + 1
        elif t in (M.CAPITAL, M.CAPITALS):
            if i + 1 == n:
                return out, i
            out.append((i, i + 2))
            i += 2
        else:
            out.append((i, i + 1))
            i += 1
    return out, n


def _joined(pieces: list[str]) -> str:
    """One word of its pieces: a capital mark holds for the next piece, the mark of all capitals until another mark or a digit."""
    out, mode = [], None
    for p in pieces:
        if p in (M.CAPITAL, M.CAPITALS):
            mode = p
        elif mode == M.CAPITALS and not p[:1].isdigit():
            out.append(p.upper())
        else:
            out.append(p.capitalize() if mode == M.CAPITAL else p)
            mode = None
    return "".join(out)


def beautify(text: str) -> str:
    """Readable text of a rendered line, in one pass over its tokens."""
    tokens, out, i = text.split(" "), [], 0
    ends = [k for k, t in enumerate(tokens) if t == M.WORD_END][::-1]
    while i < len(tokens):
        while ends and ends[-1] <= i:
            ends.pop()
        t = tokens[i]
        if t == M.WORD_START and ends:
            out.append(_joined(tokens[i + 1:ends[-1]]))
            i = ends[-1] + 1
        elif t in (M.CAPITAL, M.CAPITALS) and i + 1 < len(tokens):
            out.append(_joined(tokens[i:i + 2]))
            i += 2
        else:
            out.append(t)
            i += 1
    text = " ".join(out).replace("<eos>", "\n")
    pads = re.compile(rf"(?:{M.PAD} )*{M.PAD}")
    if first := pads.search(text):
        text = pads.sub(f"{len(first[0].split(' '))}x{M.PAD}", text)
    for mark, shown in sorted(M.READABLE.items(), key=lambda x: -len(x[0])):
        text = text.replace(mark, shown)
    for i in range(10, 0, -1):
        text = text.replace(f"\\t{i}", " " * 4 * i)
    return re.sub(r" ?(\{|\}|;|\*/) ?", lambda m: m[1] + "\n", text.replace(" . ", "."))


_NO_RANK = 1 << 60


def merge_word(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """Byte-pair encoding of a word by merge ranks: always the lowest rank, the leftmost on ties."""
    parts, get = list(word), ranks.get
    while len(parts) > 1:
        found = [get(p, _NO_RANK) for p in zip(parts, parts[1:])]
        best = min(found)
        if best == _NO_RANK:
            break
        at = found.index(best)
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts


def is_typo(word: str, known: str) -> bool:
    """One edit, or one swap of neighbours, apart."""
    a, b = len(word), len(known)
    if abs(a - b) > 1 or word == known:
        return False
    i = next((i for i, (x, y) in enumerate(zip(word, known)) if x != y), min(a, b))
    if a == b:
        return word[i + 1:] == known[i + 1:] or word[i + 2:] == known[i + 2:] and word[i:i + 2] == known[i:i + 2][::-1]
    return word[i + 1:] == known[i:] if a > b else word[i:] == known[i + 1:]


