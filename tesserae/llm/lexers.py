"""Lexers that turn a file into lines of terminals for the grammars of ``grammars.py``.

Each returns a list of ``(line number, tuple of terminals)``. A piece of text that is no token of the
language (an unclosed string, a conflict marker's tail, a stray sign) becomes the terminal ``BAD``,
which no grammar has.
"""

from __future__ import annotations

import re
import unicodedata


def _signs(those) -> str:
    """The signs beyond ASCII that ``those`` chooses and ``\\w`` lacks, as a part of a class in a pattern."""
    chosen = [i for r in (range(0x80, 0x20000), range(0xE0000, 0xE0200)) for i in r if not (c := chr(i)).isalnum() and those(c)]
    ends = [a for a, b in zip(chosen, [*chosen[1:], -1]) if b != a + 1]
    begins = [b for a, b in zip([-2, *chosen], chosen) if b != a + 1]
    return "".join(f"{chr(a)}-{chr(z)}" for a, z in zip(begins, ends))


# Signs of names that aren't letters or digits: combining marks and joiners within them, a few signs at their start. Java also takes currency signs, and ignores format and control signs within a name.
_START, _WITHIN = _signs(str.isidentifier), _signs(lambda c: ("a" + c).isidentifier())
_JAVA_START = _signs(lambda c: unicodedata.category(c) in ("Sc", "Pc"))
_JAVA_WITHIN = "\0\x03-\x08\x0e-\x1b\x7f" + _signs(lambda c: unicodedata.category(c) in ("Sc", "Pc", "Mn", "Mc", "Cf", "Cc"))


def _pattern(text: str, start: str, within: str) -> re.Pattern:
    """``text`` with the signs in place of its two marks."""
    return re.compile(text.replace("«", start).replace("»", within))


_JAVA = _pattern(
    r'[ \t\f]*(@interface(?![\w$»])|non-sealed(?![\w$»])|[^\W\d](?<!\d)[\w$»]*|\n|[(){}\[\];,~?]|"""[ \t\f]*\n(?:[^"\\]|\\.|"(?!""))*"""|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\u+[0-9a-fA-F]{4}|\\[0-7]{1,3}|\\.|[\ud800-\udbff][\udc00-\udfff])\''
    r"|//[^\n]*|/\*(?s:.*?)\*/|[^\W\d][\w$»]*|[$«][\w$»]*"
    r"|0[xX](?:[\da-fA-F_]+\.?[\da-fA-F_]*|\.[\da-fA-F_]+)(?:[pP][+-]?\d+)?[lLfFdD]?|0[bB][01_]+[lL]?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?[\d_]+)?[lLfFdD]?"
    r"|\n|>>>=|<<=|>>=|\.\.\.|->|::|\+\+|--|&&|\|\||[=!<>+*/%&|^-]=|<<|[^ \t\f])", _JAVA_START, _JAVA_WITHIN
)
_JAVA_WORDS = {
    w: w for w in (
        "abstract assert boolean break byte case catch char class continue default do double else enum extends final finally float for if implements import "
        "instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws "
        "transient try void volatile while true false null @interface non-sealed record sealed permits yield module open"
    ).split()
} | {w: "BAD" for w in ("goto", "const")}
_OPS = "( ) { } [ ] ; , . @ = < > ! ~ ? : + - * / % & | ^ -> :: ++ -- && || == != <= >= += -= *= /= %= &= |= ^= << <<= >>= >>>= ...".split()
_JAVA_MAP = _JAVA_WORDS | {o: o for o in _OPS} | {"\n": "\n"}
_JAVA_BAD_NUMBER = re.compile(r"0[0-7_]*[89][\d_]*[lL]?|.*_[lLfFdD]?|0[xXbB]", re.S)
_JAVA_BAD_ESCAPE = re.compile(r"(?:[^\\]|\\[btnfrs\"'\\0-7\n])*\\(?![btnfrs\"'\\0-7\n])")
_JAVA_HIDE = re.compile(
    r'//[^\n]*|/\*(?s:.*?)\*/|"""[ \t\f]*\n(?:[^"\\]|\\[btnfrs"\'\\0-7\n]|"(?!""))*"""|"(?:[^"\\\n]|\\[btnfrs"\'\\0-7])*"|\'(?:[^\'\\\n]|\\[0-7]{1,3}|\\[btnfrs"\'\\])\''
)
_JAVA_NAME = _pattern(r"(?<![\w$»])(?!(?:" + "|".join(sorted(w for w in [*_JAVA_WORDS, "non"] if w[0] != "@")) + r")(?![\w$»]))(?:[^\W\d]|[$«])[\w$»]*", _JAVA_START, _JAVA_WITHIN)
_JAVA_NUMBER = _pattern(r"(?<![\w$».])(?:0|[1-9]\d*)(?:\.\d+)?[lLfFdD]?(?![\w$».])", _JAVA_START, _JAVA_WITHIN)
_JAVA_BAD_UNICODE = re.compile(r"(?<!\\)(?:\\\\)*\\u+(?!u|[\da-fA-F]{4})")
_SHAPES: dict[str, tuple] = {}
_SHAPE_ENTRIES = 200_000


def _hidden(m) -> str:
    s = m[0]
    if s[0] == '"':
        return "\x01" + "\n" * s.count("\n")
    return "\x02" if s[0] == "'" else " " + "\n" * s.count("\n")


def _first(tok: str) -> str:
    """Terminal of a Java token that isn't a fixed word or sign."""
    c = tok[0]
    if c == '"':
        return "STR" if len(tok) > 1 and not ("\\" in tok and _JAVA_BAD_ESCAPE.match(tok)) else "BAD"
    if c == "'":
        return "CHAR" if len(tok) > 2 and not ("\\" in tok and _JAVA_BAD_ESCAPE.match(tok)) else "BAD"
    if c.isdigit() or c == ".":
        return "BAD" if _JAVA_BAD_NUMBER.fullmatch(tok) else "NUM"
    if c.isalpha() or c in "_$":
        return "ID"
    return "BAD"


def java(text: str) -> list[tuple[int, tuple]]:
    """By way of remembered line shapes: literals, comments and names are blanked in three passes over
    the text, so most lines were seen before."""
    wrong = 0  # line of an escape that no text may have, within a comment neither
    if "\\u" in text:
        if m := _JAVA_BAD_UNICODE.search(text):
            wrong = text.count("\n", 0, m.end()) + text.count("\r", 0, m.end()) - text.count("\r\n", 0, m.end()) + 1
        text = re.sub(r"(?<!\\)((?:\\\\)*)\\u+([0-9a-fA-F]{4})", lambda m: m[1] + (chr(int(m[2], 16)) if chr(int(m[2], 16)).isalnum() else "_"), text)
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    text = text.replace("\x01", "\x03").replace("\x02", "\x03").removesuffix("\x1a")
    out, lines = [], _JAVA_NUMBER.sub("0", _JAVA_NAME.sub("aa", _JAVA_HIDE.sub(_hidden, text))).split("\n")
    for no, line in enumerate(lines, 1):
        line = line.strip(" \t\f")
        if no == wrong:
            out.append((no, ("BAD",)))
        elif line:
            terms = _SHAPES.get(line)
            if terms is None:
                if len(_SHAPES) > _SHAPE_ENTRIES:
                    _SHAPES.clear()
                toks = _JAVA.findall(line.replace("\x01", '""').replace("\x02", "'a'"))
                terms = _SHAPES[line] = tuple(_JAVA_MAP.get(t) or _first(t) for t in toks if t[:2] not in ("//", "/*"))
            out.append((no, terms))
    out.append((len(lines), ("EOF",)))
    return out


def _lines(terms: list[str], lines: list[int], last: int) -> list[tuple[int, tuple]]:
    out, i, n = [], 0, len(terms)
    while i < n:
        j, at = i, lines[i]
        while j < n and lines[j] == at:
            j += 1
        out.append((at, tuple(terms[i:j])))
        i = j
    out.append((last, ("EOF",)))
    return out


_JS_WORDS = (
    "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch "
    "this throw try typeof var void while with true false null enum async let static get set of yield await"
).split()
_JS_OPS = "( ) { } [ ] ; , . = < > ! ~ ? : + - * / % & | ^ => ++ -- ** && || ?? == != === !== <= >= << >> >>> += -= *= /= %= **= &= |= ^= <<= >>= >>>= &&= ||= ??= ... ?.".split()
_JS_MAP = {w: w for w in _JS_WORDS + _JS_OPS} | {"\n": "\n", " ": "\n", " ": "\n"}
_JS = _pattern(
    r"(?P<skip>[ \t\x0b\x0c\xa0\ufeff\u1680\u2000-\u200a\u202f\u205f\u3000]+|//[^\n  ]*|<!--[^\n]*)|(?P<com>/\*(?s:.*?)\*/)|(?P<str>\"(?:[^\"\\\n]|\\(?s:.))*\"|'(?:[^'\\\n]|\\(?s:.))*')"
    r"|(?P<id>(?:[^\W\d]|[«]|\$|\\u[\da-fA-F]{4}|\\u\{[\da-fA-F]+\})(?:[\w$»‌‍]|\\u[\da-fA-F]{4}|\\u\{[\da-fA-F]+\})*)"
    r"|(?P<num>(?:0[xX][\da-fA-F_]+|0[oO][0-7_]+|0[bB][01_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)n?(?![\w$]))"
    r"|(?P<op>\n| | |\?\.(?!\d)|\.\.\.|>>>=|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|===|!==|=>|\+\+|--|\*\*|&&|\|\||\?\?|[=!<>+*/%&|^-]=|<<|>>|[(){}\[\];,.=<>!~?:+*/%&|^-])"
    r"|(?P<private>#[\w$»]+)|(?P<bad>.)", _START, _WITHIN
)
_JS_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/([\w$]*)")
_TPL = re.compile(r"(?:[^`\\$]|\\(?s:.)|\$(?!\{))*(`|\$\{)?")
_EXPRESSION = {"(", "[", ",", "=", ":", "?", "return", "typeof", "=>", "&&", "||", "??", "!", "+", "-", "*", "==", "===", "!=", "!==", "+=", "in", "of", "throw", "new", "void", "delete", "case"} - {"=>"}
_VALUE_END = {"ID", "NUM", "STR", "REGEX", "TPL", "TPLTAIL", ")", "]", "}", "this", "super", "null", "true", "false", "++", "--", "async", "let", "static", "get", "set", "of", "PRIVATE"}


def javascript(text: str) -> list[tuple[int, tuple]]:
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    terms, lines, line, at, n = [], [], 1, 0, len(text)
    braces: list[bool | None] = []  # True: of a template, False: of an expression, None: of a block
    parens: list[bool] = []
    regex_after_paren = regex_after_brace = False
    if text[:1] == "\ufeff":
        text, n = text[1:], n - 1
    if text[:2] == "#!":
        at = text.find("\n") if "\n" in text else n

    def add(t):
        terms.append(t)
        lines.append(line)

    def template(at, head, middle):
        nonlocal line
        m = _TPL.match(text, at)
        line0, end = line, m[1]
        line += text.count("\n", at, m.end())
        terms.append(("TPL" if head else "TPLTAIL") if end == "`" else ("TPLHEAD" if head else "TPLMID") if end else "BAD")
        lines.append(line0)
        if end == "${":
            braces.append(True)
        return m.end()

    while at < n:
        if text[at] == "`":
            at = template(at + 1, True, False)
            continue
        m = _JS.match(text, at)
        kind, tok = m.lastgroup, m[0]
        if kind == "skip":
            at = m.end()
            continue
        if kind == "com":
            line += tok.count("\n")
            at = m.end()
            continue
        if kind == "op":
            t = _JS_MAP[tok]
            if t == "\n":
                if terms and lines[-1] == line and terms[-1] in ("return", "break", "continue", "throw") and terms[-2:-1] not in (["."], ["?."]):
                    add(";")
                line += 1
                at = m.end()
                continue
            if t in ("/", "/="):
                before = terms[-1] if terms else ";"
                if before not in _VALUE_END or before == ")" and regex_after_paren or before == "}" and regex_after_brace:
                    r = _JS_REGEX.match(text, at)
                    add("REGEX" if r and set(r[1]) <= set("dgimsuvy") and len(set(r[1])) == len(r[1]) else "BAD")
                    at = r.end() if r else at + 1
                    continue
            elif t == "(":
                parens.append(bool(terms) and terms[-1] in ("if", "while", "for", "with") and (len(terms) < 2 or terms[-2] != "."))
            elif t == ")":
                regex_after_paren = parens.pop() if parens else False
            elif t == "{":
                braces.append(False if terms and terms[-1] in _EXPRESSION else None)
            elif t == "}":
                kind = braces.pop() if braces else None
                if kind:
                    at = template(at + 1, False, True)
                    continue
                regex_after_brace = kind is None
            elif t in ("++", "--") and terms and lines[-1] != line:
                t = "N" + t
            elif t == "=>" and terms and lines[-1] != line:
                t = "BAD"
            add(t)
        elif kind == "id":
            add(_JS_MAP.get(tok, "ID"))
        elif kind == "str":
            add("STR")
            line += tok.count("\n")
        else:
            add({"num": "NUM", "private": "PRIVATE"}.get(kind, "BAD"))
        at = m.end()
    return _lines(terms, lines, line)


_PY_WORDS = (
    "del pass break continue return raise import as from global nonlocal assert if elif else while for in try except finally with def class async await lambda or and "
    "not is None True False yield"
).split()
_PY_OPS = "( ) [ ] { } : , ; . = + - * / % @ & | ^ ~ < > -> := ** // << >> <= >= == != += -= *= /= %= @= &= |= ^= >>= <<= **= //= ...".split()
_PY_MAP = {w: w for w in _PY_WORDS + _PY_OPS} | {"\n": "\n"}
_PY_FORMAT = re.compile(r"(?:[rR][fFtT]|[fFtT][rR]?)(\"\"\"|'''|\"|')")
_PY_ESCAPE = re.compile(r"[^\\]*(?:\\(?:x(?![\da-fA-F]{2})|u(?![\da-fA-F]{4})|U(?![\da-fA-F]{8})|N(?!\{))()|\\(?s:.)[^\\]*)*")
_PY = _pattern(
    r"(?P<skip>[ \t\f]+|\\\n|#[^\n]*)|(?P<str>(?:[rR][bBfFtT]?|[bBfFtT][rR]?|[uU])?(?:\"\"\"(?:[^\"\\]|\\(?s:.)|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\(?s:.)|'(?!''))*'''|\"(?!\"\")(?:[^\"\\\n]|\\(?s:.))*\"|'(?!'')(?:[^'\\\n]|\\(?s:.))*'))"
    r"|(?P<id>(?:[^\W\d]|[«])[\w»]*)|(?P<num>(?:0[xX](?:_?[\da-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:(?:0(?:_?0)*|[1-9](?:_?\d)*)(?![\d_.eEjJ]))|(?:(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*[jJ]?|[jJ])))(?![^\W_]))"
    r"|(?P<op>\n|\.\.\.|\*\*=|//=|>>=|<<=|->|:=|\*\*|//|<<|>>|[<>=!+*/%@&|^-]=|[()\[\]{}:,;.=+*/%@&|^~<>-])|(?P<bad>(?s:.))", _START, _WITHIN
)


_PY_BLANK = re.compile(r"[ \t\f]*")
_PY_SPEC = re.compile(r"(?:=(?:\s|#[^\n]*\n)*)?(?:!\s*[rsa](?:\s|#[^\n]*\n)*)?(?:([:}]))?")


def python(text: str) -> list[tuple[int, tuple]]:
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if text[:1] == "﻿":
        text = text[1:]
    if "\0" in text:
        return [(text.count("\n", 0, text.index("\0")) + 1, ("BAD",))]
    terms: list[str] = []
    lines: list[int] = []
    words: list[str] = []
    line, at, n, depth, indents, fresh = 1, 0, len(text), 0, [(0, 0)], True
    head = 0

    def add(t, w=""):
        terms.append(t)
        lines.append(line)
        words.append(w)

    def formatted(at: int, quote: str, raw: bool) -> int:
        """Add the fields of the formatted string whose text begins at ``at``; the place behind its end."""
        nonlocal line
        while at < n:
            c = text[at]
            if text.startswith(quote, at):
                return at + len(quote)
            if c == "\n":
                if len(quote) == 1:
                    break
                line += 1
            if c == "\\" and text[at + 1:at + 2] in ("{", "}"):
                at += 1
            elif c == "\\":
                line += text[at + 1:at + 2] == "\n"
                at = text.find("}", at) + 1 if not raw and text.startswith("N{", at + 1) and "}" in text[at:] else at + 2
            elif c in "{}" and text.startswith(c * 2, at):
                at += 2
            elif c == "{":
                at = field(at + 1, quote, raw)
            elif c == "}":
                break
            else:
                at += 1
        add("BAD")
        return n

    def field(at: int, quote: str, raw: bool) -> int:
        nonlocal line
        add("F{")
        inner = 0
        while at < n:
            if not inner and text[at] in "}:!=" and not (text[at] in "!=" and text.startswith("=", at + 1)):
                break
            f = _PY_FORMAT.match(text, at)
            if f:
                add("STR")
                at = formatted(f.end(), f[1], "r" in f[0].lower())
                continue
            m = _PY.match(text, at)
            kind, tok, at = m.lastgroup, m[0], m.end()
            line += tok.count("\n")
            if kind == "op" and tok != "\n":
                inner += (tok in "([{") - (tok in ")]}") if len(tok) == 1 else 0
                add(_PY_MAP[tok])
            elif kind == "id":
                add(_PY_MAP.get(tok, "NAME"))
            elif kind in ("str", "num", "bad"):
                add({"str": "STR", "num": "NUM"}.get(kind, "BAD"))
        m = _PY_SPEC.match(text, at)
        at = m.end()
        line += m[0].count("\n")
        add("F}")
        if m[1] == ":":
            while at < n and text[at] != "}":
                if text[at] == "{":
                    at = field(at + 1, quote, raw)
                elif text.startswith(quote, at):
                    break
                else:
                    line += text[at] == "\n"
                    at += 1
        elif m[1] is None:
            add("BAD")
            return n
        if m[1] == ":":
            if not text.startswith("}", at):
                add("BAD")
                return n
            at += 1
        return at

    while at < n:
        if fresh:
            m = _PY_BLANK.match(text, at)
            at = m.end()
            if at >= n or text[at] in "#\n":
                end = text.find("\n", at)
                if end < 0:
                    break
                line += 1
                at = end + 1
                continue
            if text.startswith("\\\n", at):
                at += 2
                line += 1
                continue
            col = len(m[0].expandtabs(8)), len(m[0])
            if col[0] > indents[-1][0]:
                add("INDENT" if col[1] > indents[-1][1] else "BAD")
                indents.append(col)
            else:
                while col[0] < indents[-1][0]:
                    indents.pop()
                    add("DEDENT")
                if col != indents[-1]:
                    add("BAD")
            fresh, head = False, len(terms)
        f = _PY_FORMAT.match(text, at)
        if f:
            add("STR")
            at = formatted(f.end(), f[1], "r" in f[0].lower())
            continue
        m = _PY.match(text, at)
        kind, tok = m.lastgroup, m[0]
        at = m.end()
        if kind == "skip":
            line += tok == "\\\n"
        elif kind == "op":
            t = _PY_MAP[tok]
            if t == "\n":
                if not depth:
                    if words[head] in ("match", "case", "type") and terms[head] == "NAME" and len(terms) > head + 1:
                        w, after = words[head], terms[head + 1]
                        if w == "type":
                            if after == "NAME" and "=" in terms[head:]:
                                terms[head] = w
                        elif terms[-1] == ":" or (w == "case" and ":" in terms[head:]):
                            if after not in ("=", ".", ":", ",", ")", "+=", ":="):
                                terms[head] = w
                    add("NL")
                    fresh = True
                line += 1
                continue
            depth += (t in "([{") - (t in ")]}") if len(t) == 1 else 0
            depth = max(depth, 0)
            add(t)
        elif kind == "id":
            add(_PY_MAP.get(tok, "NAME"), tok)
        elif kind == "str":
            bad = "\\" in tok and not set(tok.partition(tok[-1])[0]) & set("rRbB") and _PY_ESCAPE.match(tok)[1] is not None
            add("BAD" if bad else "STR")
            line += tok.count("\n")
        else:
            add("NUM" if kind == "num" else "BAD")
    if depth:
        add("BAD")
    if terms and not fresh:
        add("NL")
    for _ in indents[1:]:
        add("DEDENT")
    return _lines(terms, lines, line)


_JSON = re.compile(
    r'(?P<skip>[ \t\r]+)|(?P<str>"(?:[^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*")|(?P<num>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.+-]))|(?P<word>true\b|false\b|null\b)|(?P<op>[\[\]{}:,])|(?P<nl>\n)|(?P<bad>(?s:.))'
)


def json(text: str) -> list[tuple[int, tuple]]:
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    terms, lines, line = [], [], 1
    for m in _JSON.finditer(text[1:] if text[:1] == "﻿" else text):
        k = m.lastgroup
        if k == "nl":
            line += 1
        elif k != "skip":
            terms.append({"str": "STR", "num": "NUM", "bad": "BAD"}.get(k) or m[0])
            lines.append(line)
    return _lines(terms, lines, line)


_NAME = rf"[^\W\d][\w{_WITHIN}.:·-]*"
_ATTR = rf"""[ \t\r\n]+({_NAME})[ \t\r\n]*=[ \t\r\n]*(?:"((?:[^<&"]|&(?:{_NAME}|#\d+|#x[\da-fA-F]+);)*)"|'((?:[^<&']|&(?:{_NAME}|#\d+|#x[\da-fA-F]+);)*)')"""
_XML = re.compile(
    rf"(?P<com><!--(?:[^-]|-(?!-))*-->)|(?P<cdata><!\[CDATA\[(?s:.*?)\]\]>)|(?P<pi><\?(?P<target>{_NAME})(?:[ \t\r\n](?s:.*?))?\?>)|(?P<doc><!DOCTYPE[ \t\r\n][^\[>]*(?:\[(?s:.*?)\][ \t\r\n]*)?>)"
    rf"|(?P<close></(?P<ctag>{_NAME})[ \t\r\n]*>)|(?P<open><(?P<otag>{_NAME})(?P<attrs>(?:{_ATTR})*)[ \t\r\n]*(?P<empty>/?)>)|(?P<ref>&(?P<ent>{_NAME}|#\d+|#x[\da-fA-F]+);)|(?P<text>[^<&]+)|(?P<bad>(?s:.))"
)
_ENTITIES = {"lt", "gt", "amp", "quot", "apos"}
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def xml(text: str) -> list[tuple[int, tuple]]:
    """Tag names and attribute names are checked here: nesting of equal names is not context-free."""
    if text[:1] == "﻿":
        text = text[1:]
    terms, lines, line, open_tags = [], [], 1, []
    own = "<!ENTITY" in text
    if _CONTROL.search(text):
        return [(1, ("BAD",))]
    for m in _XML.finditer(text):
        k, t = m.lastgroup, "BAD"
        k = next(x for x in ("com", "cdata", "pi", "doc", "close", "open", "ref", "text", "bad") if m[x] is not None)
        if k == "com":
            t = "COMMENT"
        elif k == "cdata":
            t = "CDATA"
        elif k == "pi":
            t = "PI" if m["target"].lower() != "xml" else "DECL" if m.start() == 0 and re.match(r"<\?xml[ \t\r\n]+version[ \t\r\n]*=", m[0]) else "BAD"
        elif k == "doc":
            t = "DOCTYPE"
        elif k == "close":
            t = "CLOSE" if open_tags and open_tags.pop() == m["ctag"] else "BAD"
        elif k == "open":
            names = [a[0] for a in re.findall(_ATTR, m["attrs"])] if m["attrs"] else []
            t = "BAD" if len(names) != len(set(names)) else "EMPTY" if m["empty"] else "OPEN"
            if t == "OPEN":
                open_tags.append(m["otag"])
        elif k == "ref":
            t = "REF" if own or m["ent"] in _ENTITIES or m["ent"][0] == "#" else "BAD"
        elif k == "text":
            t = "SPACE" if not m[0].strip(" \t\r\n") else "BAD" if "]]>" in m[0] else "TEXT"
        terms.append(t)
        lines.append(line)
        line += m[0].count("\n")
        if t == "BAD":
            break
    return _lines(terms, lines, line)
