"""Personal information inside free text.

Method: anchor expansion. An Aho-Corasick automaton finds at-signs and their disguises, dialling
prefixes, labels, street words, given names and the phrases that introduce people; around each hit a
small deterministic parser expands to the whole item and validates its boundaries. Digit shapes that
need no label (the anchor would be every digit) are found by one pass of a compiled pattern.
Names without a cue are told by a bundled list (``names``) and by given and family names that stand behind the
cues of at least two documents, with at least two partners (``learn``); a cued name counts wherever its document repeats it.

Defined results: null, empty and blank texts hold nothing; a value occurring several times in a
document is one row; overlapping items are resolved in favour of the earlier, then the longer one.
Redaction leaves every other character as it is and maps null to null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .names import AMBIGUOUS, GIVEN

FOUND = "doc_id bigint, kind string, value string"
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "person": "[PERSON]"}

# Words before a comma that are greetings, not family names.
_GREETING = {"regards", "thanks", "hi", "hello", "dear", "cheers", "best", "danke", "merci", "gracias", "hallo", "salut", "hola", "bonjour", "obrigado", "grazie", "sincerely", "yours", "greetings", "and", "or"}
# Phrases that stand before (or after) a person.
_BEFORE = (
    "Signed-off-by:", "Reviewed-by:", "Acked-by:", "Tested-by:", "Reported-by:", "Co-authored-by:", "Suggested-by:", "Reported by", "Reviewed by", "Thanks to", "Merci à", "Danke an",
    "Gracias a", "Grazie a", "Obrigado a", "@author", "assignee=", "assignee:", "reporter=", "owner=", "TODO(", "FIXME(", "cc ", "Cc:", "CC:", "talked with", "talked to", "spoke with", "spoke to", "written by", "name='",
    'name="', '"name": "', '"user": "', '"author": "', "Author:", "author:", "From:", "To:", "Dear", "As", "Regards,", "Cheers,", "Best,", "user:", "met with", "ask", "Copyright",
)
_AFTER = (" wrote:", " asked", " said", " schrieb:", " a écrit", " escribió:", " reported", " suggested")

_U, _L = "A-ZÀ-ÖØ-ÞŁŚŻŹĆŃÓĄĘŠČŽ", "a-zß-öø-ÿłśżźćńóąęšžč"
_W = rf"[{_U}][{_L}]+(?:['’-][{_U}]?[{_L}]+)*"
_PART = r"(?:(?:von|van|de|der|den|du|da|di|la|le|al|bin|ter) ){0,2}"
_CAPS = rf"[{_U}]{{2,}}(?:-[{_U}]{{2,}})?"
_PERSON = re.compile(
    rf"(?:{_W}, {_W}(?: [{_U}]\.)?(?![{_L}])|{_W}(?: [{_U}]\.)+ {_PART}{_W}|{_W} {_PART}{_W}|(?:[{_U}]\. ?)+{_PART}{_W}|{_W}, [{_U}]\.|{_CAPS}, {_CAPS}|{_CAPS}(?: [{_U}]\.)* {_CAPS}|(?:[{_U}]\. ?)+{_CAPS})(?![{_U}{_L}0-9_])"
)
_COPYRIGHT = re.compile(r"\s*(?:\(c\)|©)?\s*\d{4}(?:\s*-\s*\d{4})?,?\s+", re.I)
_LONE = re.compile(rf"(?m)^[>* \t/#-]*((?:[{_U}]\. )+{_W}|{_CAPS}(?: [{_U}]\.)? {_CAPS}),?[ \t\r]*(?:\*/)?[ \t\r]*$")
# Words of software, organisations and streets; in a name only beside better evidence, see ``_person``.
_STREETS = {"Street", "Road", "Avenue", "Close", "Lane", "Court", "Square", "Drive", "Crescent"}
_SURNAMES_TOO = set("Quick Gate Ocean Sort Map Clock Wall Field Bond Banks Bridges Case Cook Cross Day Forest Fox Gates House Lake Page Park Pool Rivers Snow Stone Storm Summer Winter Wood Woods Young Best Price Sharp Short Long Small Rich Strong Wise".split())
_THINGS = set(
    "The This That These Those Our All Any Some Each Every Both Other Another Such No Not Only Main Worker Thread Threads Adapter Algorithm Class Build Terms Licence License Team Project Inc Ltd Group Foundation Server Client "
    "Manager Factory Service Services System Systems Software Engine Module Modules Package Packages Library Framework Function Method Object Objects Interface Handler Listener Event Events Queue Stack List Set Table Index Cache Buffer "
    "Stream Reader Writer Parser Lexer Compiler Runtime Kernel Driver Device Network Protocol Socket Port Host Proxy Gateway Router Session Token Key Value Type Types String Integer Boolean Number Array File Files Folder Path Disk "
    "Database Query Schema Record Records Row Column Report Reports Test Tests Testing Suite Release Version Update Upgrade Patch Fix Bug Issue Issues Feature Features Support Security Policy Update Notes Guide Manual Reference "
    "Tutorial Example Examples Sample Code Source Script Command Console Terminal Window Windows Button Menu View Model Controller Template Style Theme Icon Image Video Audio Media Player Editor Studio Tool Tools Kit Platform Cloud "
    "Web Site Page Browser Mobile Desktop Open General Public Private Internal External Global Local Remote Default Standard Common Core Base Data Time Date Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February "
    "March April June July August September October November December".split()
) - {"April", "June", "August", "Page"}
_NOT_GIVEN = _THINGS | _STREETS | _SURNAMES_TOO
# Cues that only people follow.
_STRONG = tuple(c for c in _BEFORE if c.endswith("-by:")) + ("@author", "Author:", "author:", "Reported by", "Reviewed by")
# Words before a family name that are no given name.
_TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "sir", "herr", "frau", "monsieur", "madame", "señor", "señora", "signor", "signora", "senhor", "senhora", "ask", "thank", "see", "when", "while", "since", "though", "although", "after", "before", "because", "as", "did", "does", "has", "is", "let", "maybe", "only", "tell", "with", "without", "cc", "todo", "fixme", "copyright", "author", "from", "to", "by"}

# The parsers and the anchors are made of the same alternatives.
_AT_OPEN, _AT = "[({<", ("at", "AT", "ät")
_EMAIL = re.compile(
    r"(?<![\w.+@/-])[\w][\w.+'-]*(?:@|＠)[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}(?![\w@])"
    r"|(?<![\w.+@/-])[\w][\w.+'-]*\s?(?:" + f"[{re.escape(_AT_OPEN)}]" + r"\s?(?:" + "|".join(_AT) + r")\s?[\])}>]|(?<=\s)AT(?=\s)|(?<=\s)at(?=\s[\w-]+\s?(?:[\[({<]\s?dot|dot\s)))\s?[\w-]+(?:\s?(?:\.|[\[({<]\s?(?:dot|DOT|punkt)\s?[\])}>]|(?<=\s)(?:DOT|dot)(?=\s))\s?[\w-]+)+(?![\w@])"
)
# Endings of file names and addresses that are no mail domain.
_NO_DOMAIN = {"png", "jpg", "jpeg", "gif", "svg", "ico", "webp", "pdf", "js", "css", "html", "java", "py", "json", "xml", "localdomain", "local"}

_PHONE = re.compile(
    r"(?<![\w.+/@:-])(?<!\d )(?:\+\d{8,15}|\+\d{1,3}[ .-]?(?:\(0\) ?)?(?:\(\d{2,4}\)|\d{1,5})(?:(?: / |[ ./-])\d{2,8}){1,5}|\(\d{2,5}\) ?\d{3,8}(?:[-. ]\d{2,6}){0,3}"
    r"|\d{3}([-.])\d{3}\1\d{4}|0\d{1,4}(?: / |[ /-])\d{2,8}(?:[ -]\d{2,8}){0,4})(?:,? ?(?:ext\.?|x|extension|Durchwahl|poste|App\.) ?\d{1,6})?(?!(?:[0-9A-Z_/@-]|[a-z](?![\u0300-\u036f])))(?!\.\d)"
)
_ID_FORMS = (r"\d{3}-\d{2}-\d{4}", r"[A-Z]{2} \d{2} \d{2} \d{2} [A-D]", r"[A-Z]{2}\d{6}[A-D]", r"\d{8}-?[A-Z]", r"[XYZ]-?\d{7}-?[A-Z]", r"[A-Z]\d[A-Z]\d{6}", r"[A-Z]{1,2}\d{7,8}", r"\d{11}")
_ID = re.compile(
    rf"(?<![\w.+/@-])(?:{'|'.join(_ID_FORMS)})" r"(?!(?:[0-9A-Z_@-]|[a-z](?![\u0300-\u036f])))(?!\.\d)"
)
_ID_LABEL = re.compile(r"(?:passport|national id|\bid\b|\bID\b|identity|social security|\bssn\b|\bSSN\b|PESEL|\bNIN\b|\bDNI\b|\bNIE\b|tax ?id|taxId|Ausweis|Steuer|validate\(|carte d'identité|NIF|licence no)", re.I)
_NO_NUMBER = re.compile(r"(?:^|(?<!\w))(?:ISBN|ISSN|timestamp|version|[Bb]uild|issue|commit|sha\d*|uuid|MAC|port|listens on|step|#|\bv|Change-Id:?|0x)[ :#=]*$")

_POST_UK = r"[A-Z]{1,2}\d{1,2}[A-Z]? \d[A-Z]{2}"
_TOWN = rf"(?:(?:Bad|Sankt|Saint|St\.|Le|La|Les|Neu|Alt|San|Santa|Los|Las) )?[{_U}][\w{_L}]+(?:-[\w{_L}]+)*"
_FLAT = r"(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|Floor) \d+[A-Za-z]?, )?"
_EN_STREETS = ("Street", "Road", "Avenue", "Close", "Lane", "Way", "Terrace", "Drive", "Place", "Court", "Square", "Gardens", "Crescent", "Row", "Hill", "Mews", "Grove", "Boulevard")
_EN_SHORT = ("Rd", "Ave", "Dr", "Ln", "Blvd")
_DE_ENDINGS = ("straße", "strasse", "str.", "allee", "weg", "gasse", "platz", "ring", "damm", "ufer", "markt", "graben", "steig")
_DE_STREETS = ("Straße", "Allee", "Weg", "Platz")
_DE_HEADS = ("Am", "An der", "An den", "Im", "In der", "Zum", "Zur", "Auf dem", "Auf der", "Unter den", "Hinter der")
_ROMANCE = ("Calle", "C/", "Avenida", "Avda", "Plaza", "Paseo", "Camino", "Ronda", "Travesía", "Carrera", "Rua", "Via", "Viale", "Piazza", "Corso")
_FR_STREETS = ("rue", "avenue", "boulevard", "impasse", "place", "chemin", "allée", "quai", "cours", "square", "route", "ruelle", "passage")
_ADDRESS = re.compile(
    rf"(?<![\w-]){_FLAT}\d{{1,4}}[A-Za-z]? (?:{_W} ){{1,3}}(?:(?:{'|'.join(_EN_STREETS)})(?![A-Za-z])|(?:{'|'.join(_EN_SHORT)})(?![A-Za-z])\.?|St(?![A-Za-z])(?:\.(?=[.,]))?)"
    rf"(?:,? (?:Flat|Apt\.?) \d+[A-Za-z]?)?(?:, {_W}(?:[ -]{_W}){{0,2}},? {_POST_UK}|, {_POST_UK}(?: {_TOWN})?)?"
    rf"|(?<![\w-])(?:{_W}(?:{'|'.join(map(re.escape, _DE_ENDINGS))})|{_W} (?:{'|'.join(_DE_STREETS)})|(?:{'|'.join(_DE_HEADS)}) {_W}) \d{{1,4}} ?(?:[a-zA-Z](?!\w))?(?:, (?:\d{{1,2}}\. (?:Stock|OG|Etage)|Wohnung \d+))?(?:,? (?:D-)?\d{{5}} {_TOWN})?"
    rf"|(?<![\w-])(?:{'|'.join(w + (chr(92) + '.?') * (w == 'Avda') for w in _ROMANCE)}) (?:(?:de las|de los|de la|del|de|da|do|dos|das|della|dei) )?{_W}(?: {_W})*,? \d{{1,4}} ?(?:[a-zA-Z](?!\w))?(?:, \d{{1,2}}\.?[ºª°](?: ?(?:[A-Z](?!\w)|izq\.?|dcha\.?|der\.?))?)?(?:, \d{{5}} {_TOWN})?"
    rf"|(?<![\w-])\d{{1,4}} ?(?:bis|ter|[A-Za-z](?=[ ,]))?,? (?:{'|'.join(_FR_STREETS)}) (?:(?:de la|de l'|du|des|de|aux) |de l['’]|d['’]|l['’])?{_W}(?: {_W})?(?:, (?:appt?\.?|étage|bât\.?) ?\w+)?(?:, \d{{5}} {_TOWN})?"
)
_STREET_WORDS = {
    *(" " + w for w in (*_EN_STREETS, *_EN_SHORT, "St", *_DE_STREETS)), *_DE_ENDINGS, *(w + " " for w in (*_DE_HEADS, *_FR_STREETS)), *(w if w == "Avda" else w + " " for w in _ROMANCE),
}
# \s of the parser also takes tabs and fixed spaces.
_BLANKS = (" ", "\t", "\xa0")
_AT_SIGNS = {"@", "＠", *(o + b + w for o in _AT_OPEN for b in ("", *_BLANKS) for w in _AT), *(a + w + b for a in _BLANKS for w in ("AT", "at") for b in _BLANKS)}


class Names:
    """Given and family names known without a cue: the bundled ones and those learnt from documents."""

    def __init__(self, given=(), family=()):
        self.given = {x for n in {*GIVEN, *given} - AMBIGUOUS for x in (n, n.upper())}
        self.learnt = {*given}
        self.family = {*family}
        self.automaton = None

    def __getstate__(self):
        return self.__dict__ | {"automaton": None}

    def known(self, name: str) -> bool:
        return any(w in self.given for w in re.split(r"[ ,]+", name))

    def anchors(self):
        if self.automaton is None:
            self.automaton = _automaton(
                ("email", _AT_SIGNS), ("before", _BEFORE), ("after", _AFTER),
                ("given", {x for n in {*GIVEN, *self.learnt} for x in (n, n.upper())}), ("address", _STREET_WORDS), ("family", {" " + n for n in self.family}),
            )
        return self.automaton


def _automaton(*groups):
    import ahocorasick

    a, kinds = ahocorasick.Automaton(), {}
    for kind, words in groups:
        for w in words:
            kinds.setdefault(w, []).append(kind)
    for w, k in kinds.items():
        a.add_word(w, (w, tuple(k)))
    a.make_automaton()
    return a


@cache
def _bundled() -> Names:
    return Names()


@cache
def _strong_cues():
    return _automaton(("before", _STRONG))


def _parts(name: str) -> tuple[str, str]:
    """(given, family) of a person's name in either order; initials and particles are no part."""
    family, comma, given = name.partition(",")
    if comma:
        return given.split()[0] if given.split() else "", family.split()[-1]
    words = name.split()
    return words[0], words[-1]


def _person(name: str, names: Names, cue: str = "") -> bool:
    """Whether a name-shaped text is a person's in spite of words that mostly are no names."""
    words = {w.title() if w.isupper() else w for w in re.findall(rf"[{_U}{_L}]+", name)} & _NOT_GIVEN
    if not words:
        return True
    given, family = _parts(name)
    if given in _NOT_GIVEN or given.title() in _NOT_GIVEN:
        return False
    if cue in _STRONG or cue and (given in names.given or given in AMBIGUOUS):
        return not words & _THINGS or given in names.given
    return given in names.given and not words & (_THINGS | _STREETS)


_DIGITS = re.compile("|".join((r"\d[\d\W]{6,60}\d", *_ID_FORMS)))
#: Documents, and partners, from which a cued given or family name counts without a cue.
LEARNT = 2
#: Characters before a number, on its line, in which a label is taken for its label.
LABEL_REACH = 48


def _email_ok(text: str, m) -> bool:
    v = m[0]
    if "@" in v or "＠" in v:
        domain = re.split("[@＠]", v)[-1]
        if domain.rpartition(".")[2].lower() in _NO_DOMAIN or not re.search(r"[^\W\d_]", v.split("@")[0]):
            return False
        rest = text[m.end():m.end() + 2]
        if rest[:1] == ":" and rest[1:2].strip() and not rest[1:2].isdigit() or text[max(0, m.start() - 3):m.start()].endswith("://") or v.startswith("git@"):
            return False
    return True


def _expand(text: str, kind: str, anchors: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
    """The items that hold an anchor. Each line with an anchor is read once, from its start to its end, so an item is
    never cut, and a long line with many anchors stays linear."""
    pattern, i = (_EMAIL if kind == "email" else _ADDRESS), 0
    anchors.sort()
    while i < len(anchors):
        lo, hi = text.rfind("\n", 0, anchors[i][0]) + 1, text.find("\n", anchors[i][1])
        hi = len(text) if hi < 0 else hi
        for m in pattern.finditer(text, lo, hi):
            while i < len(anchors) and anchors[i][1] < m.start():
                i += 1
            if i < len(anchors) and anchors[i][0] < m.end() and (kind == "address" or _email_ok(text, m)):
                e = m.end()
                while text[e - 1] == " ":
                    e -= 1
                yield m.start(), e, kind
        while i < len(anchors) and anchors[i][0] < hi:
            i += 1
        if i < len(anchors) and anchors[i][0] == hi:
            i += 1


def _name_start(text: str, end: int) -> int:
    """Where the words that a person's name ending at ``end`` may be made of begin: capitalised ones, initials, particles."""
    at = end
    while at:
        space = text.rfind(" ", 0, at - (text[at - 1] == " "))
        space = max(space, text.rfind("\n", space + 1, at))
        word = text[space + 1:at].strip(" ,")
        if not word or not (word[0].isupper() or word in _PARTICLES):
            break
        at = space + 1
        if space < 0 or text[space] == "\n":
            break
    return max(at, 0)


_PARTICLES = {"von", "van", "de", "der", "den", "du", "da", "di", "la", "le", "al", "bin", "ter"}


def _after_cue(text: str, s: int, e: int, word: str):
    """The match of a person behind the cue ``word`` at (s, e)."""
    if word[0].isalpha() and s and (text[s - 1].isalnum() or text[s - 1] in "@_-."):
        return None
    at = e
    if word == "Copyright":
        c = _COPYRIGHT.match(text, at)
        if not c:
            return None
        at = c.end()
    else:
        if word[-1].isalpha() and text[at:at + 1] not in (" ", ":"):
            return None
        while at < len(text) and (text[at] in " :" or word[-1] == "," and text[at] in "\r\n\t*>#/"):
            at += 1
    return _PERSON.match(text, at)


def spans(text: str | None, names: Names | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every item in ``text``, in order and without overlaps."""
    if not text or text.isspace():
        return []
    found: set[tuple[int, int, str]] = set()
    anchored: dict[str, list[tuple[int, int]]] = {"email": [], "address": []}
    givens, cues, families, cued = [], [], [], set()
    names = names or _bundled()
    for end, (word, kinds) in names.anchors().iter(text):
        start = end - len(word) + 1
        for kind in kinds:
            if kind == "given":
                givens.append((start, end + 1))
            elif kind == "family":
                families.append((start + 1, end + 1))
            elif kind in ("before", "after"):
                cues.append((kind, start, end + 1, word))
            else:
                anchored[kind].append((start, end))
    for kind, anchors in anchored.items():
        found.update(_expand(text, kind, anchors))
    for d in _DIGITS.finditer(text):
        lo, end = max(0, d.start() - 6), min(len(text), d.end() + 40)
        lo, hi = max(lo, text.rfind("\n", lo, d.start()) + 1), text.find("\n", d.end(), end)
        for kind, pattern in (("phone", _PHONE), ("id_number", _ID)):
            for m in pattern.finditer(text, lo, end if hi < 0 else hi):
                if m.start() > d.end():
                    break
                before = text[max(0, m.start() - LABEL_REACH):m.start()]
                if _NO_NUMBER.search(before[-14:]):
                    continue
                v, n = m[0], sum(c.isdigit() for c in re.split(r" ?(?:ext|x)", m[0])[0])
                if kind == "phone":
                    if not 8 <= n <= 15 or v[0] == "0" and n < 9:
                        continue
                elif v.isdigit() and not (_ID_LABEL.search(before.rpartition("\n")[2]) or "identity" in text[m.end():m.end() + 40]):
                    continue
                found.add((m.start(), m.end(), kind))
    for kind, s, e, word in cues:
        if kind == "before":
            m = _after_cue(text, s, e, word)
            if m and word in ("As", "Dear", "ask", "To:", "user:") and not (_AFTER_NAME.match(text, m.end()) or m[0].split()[0].strip(",") in names.given):
                m = None
        else:
            base = _name_start(text, s)
            m = None
            for c in _PERSON.finditer(text, base, s):
                if c.end() == s:
                    m = c
            if m is None:
                c = re.search(rf"(?:{_W}, {_W}|{_W}(?: [{_U}]\.)* {_W}|[{_U}]\. {_W}|{_CAPS} {_CAPS})$", text[base:s])
                if c:
                    found_at = (base + c.start(), s)
                    if _person(c[0], names, word) and not (found_at[0] and text[found_at[0] - 1].isalnum()) and (word != " said" or names.known(c[0])):
                        found.add((*found_at, "person"))
                        cued.add(c[0])
            elif word != " wrote:" and word[0] == " " and not names.known(m[0]) and word in (" said", " reported", " suggested", " asked"):
                if not re.fullmatch(rf"[{_U}]\. {_W}|{_W}, {_W}|{_W} {_W}|{_CAPS} {_CAPS}", m[0]) or word != " asked":
                    m = None
        if m and _person(m[0], names, word):
            found.add((m.start(), m.end(), "person"))
            cued.add(m[0])
    for s, e in givens:
        if s and (text[s - 1].isalnum() or text[s - 1] in "_.@+-") or e < len(text) and (text[e].isalnum() or text[e] in "_@+"):
            continue
        upper = text[s:e].isupper()
        if text[s:e] not in names.given and not _AMBIGUOUS_NEXT.match(text, e) and not ((f := _FAMILY.match(text, e)) and f[0].split()[-1] in names.family):
            continue
        back = re.search(rf"({_CAPS if upper else _W}), $", text[_name_start(text, s):s])
        if back and back[1].lower() not in _GREETING and back[1] not in names.given:
            b = s - len(back[0])
            if not (b and (text[b - 1].isalnum() or text[b - 1] in "_.@")) and not re.search(rf"(?:^|[^\w.]){_W} $", text[max(0, _name_start(text, b) - 1):b]):
                if not (_CAPS_NEXT if upper else _W_NEXT).match(text, e):
                    found.add((b, e, "person"))
                    continue
        m = (re.compile(rf"(?: [{_U}]\.)* {_CAPS}(?!\w)") if upper else _FAMILY).match(text, e)
        if m and _person(text[s:m.end()], names):
            found.add((s, m.end(), "person"))
    for s, e in families:
        if e < len(text) and (text[e].isalnum() or text[e] in "_@+"):
            continue
        m = _GIVEN_BEFORE.search(text, _name_start(text, s), s)
        if m and not (m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] in "_.@+-")) and m[1].lower() not in _no_given() and _person(text[m.start():e], names):
            found.add((m.start(), e, "person"))
    for name in cued:
        for m in re.finditer(rf"(?<![\w.@+-]){re.escape(name)}(?![\w@])", text):
            found.add((m.start(), m.end(), "person"))
    for m in _LONE.finditer(text):
        if names.known(m[1]) or re.match(rf"[{_U}]\.", m[1]) and _CLOSING.search(_line_before(text, m.start(1))):
            found.add((m.start(1), m.end(1), "person"))
    out, at = [], -1
    for s, e, k in sorted(found, key=lambda x: (x[0], -x[1], x[2])):
        if s >= at:
            out.append((s, e, k))
            at = e
    return out


_CLOSING = re.compile(r"(?:Regards|Cheers|Best|Thanks|Grüße|Cordialement|Saludos)")
_CAPS_NEXT, _W_NEXT = re.compile(f" {_CAPS}"), re.compile(f" {_W}")


def _line_before(text: str, at: int) -> str:
    """The last line that isn't blank before the line of ``at``."""
    end = text.rfind("\n", 0, at)
    while end > 0 and text[end - 1].isspace():
        end -= 1
    return text[text.rfind("\n", 0, end) + 1:end] if end > 0 else ""


_FAMILY = re.compile(rf"(?: [{_U}]\.)* {_PART}{_W}(?![{_U}{_L}0-9_])")
_AFTER_NAME = re.compile(r" (?:said|wrote|asked|reported|suggested)|,?\s*\n")


_AMBIGUOUS_NEXT = re.compile(rf"(?: [{_U}]\.)+ (?:{_W}|{_CAPS})(?!\w)")
_GIVEN_BEFORE = re.compile(rf"({_W})(?: [{_U}]\.)* {_PART}$")


@cache
def _no_given() -> set[str]:
    from .foreign import _SEED

    return {w for t in _SEED.values() for w in t.split()} | _TITLES | _GREETING


def _cued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = set()
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for end, (word, _) in _strong_cues().iter(text or ""):
                m = _after_cue(text, end - len(word) + 1, end + 1, word)
                if m and _person(m[0], _bundled(), word) and not {*re.split("[ ,]+", m[0])} & _NOT_GIVEN:
                    given, family = ("" if n.isupper() or not re.fullmatch(_W, n) else n for n in _parts(m[0]))
                    if given and given.lower() not in _no_given():
                        rows.add((doc, given, family))
        rows = list(rows)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))], ["doc_id", "given", "family"])


def learn(documents: DataFrame) -> Names:
    """The bundled names and those that stand behind people's cues in ``LEARNT`` documents or more, with as many partners."""
    cued = documents.select("doc_id", "text").mapInArrow(_cued, "doc_id bigint, given string, family string").where("family <> ''")
    both = cued.selectExpr("doc_id", "stack(2, 'given', given, family, 'family', family, given) AS (kind, name, partner)")
    counts = both.groupBy("kind", "name").agg(F.countDistinct("doc_id").alias("docs"), F.countDistinct("partner").alias("partners"))
    rows = counts.where((F.col("docs") >= LEARNT) & (F.col("partners") >= LEARNT)).select("kind", "name").collect()
    return Names(*({r.name for r in rows if r.kind == k} for k in ("given", "family")))


def _found(batches: Iterator[pa.RecordBatch], names: Names | None = None) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = set()
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            rows.update((doc, k, text[s:e]) for s, e, k in spans(text, names))
        rows = list(rows)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))], ["doc_id", "kind", "value"])


def _redacted(batches: Iterator[pa.RecordBatch], names: Names | None = None) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = []
        for text in b.column(1).to_pylist():
            at, parts = 0, []
            for s, e, k in spans(text, names):
                parts += [text[at:s], PLACEHOLDER[k]]
                at = e
            texts.append(text if text is None else "".join([*parts, text[at:]]))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])


def _over(documents: DataFrame, run, schema: str) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(learn(documents))
    return documents.select("doc_id", "text").mapInArrow(lambda batches: run(batches, shared.value), schema)


def find(documents: DataFrame) -> DataFrame:
    """One row (doc_id, kind, value) for each distinct item of each document; only cued names are shuffled."""
    return _over(documents, _found, FOUND)


def redact(documents: DataFrame) -> DataFrame:
    """(doc_id, text) with each item replaced by its typed placeholder; only cued names are shuffled."""
    return _over(documents, _redacted, "doc_id bigint, text string")


def p9_found(spark, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def p9_redacted(spark, sf_dir: str) -> DataFrame:
    return redact(spark.read.parquet(f"{sf_dir}/documents.parquet"))
