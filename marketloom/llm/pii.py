"""Personal data with offset-preserving deobfuscation (operator 7).

Base identifiers are found in the text as it is. Then transducers rewrite a copy: homoglyphs and wide or styled digits to
ASCII, invisible characters to nothing, spelled digits to digits, "at" and "dot" disguises to ``@`` and ``.``. Each step
keeps, for every output character, the source span that it stands for. Identifiers found in the copy are mapped back, and
those that no base span covers are added, so that a fragment never stands for the whole. Spans are code points of the source, end exclusive.

Defined results: null and empty texts have no spans; repeated rows are scanned row by row; equal starts are ordered by kind
as listed; an empty table gives an empty table; other columns are not read; long texts are scanned whole.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_rows, texts
from .endings import ENDINGS

KINDS = ("email", "ip", "card", "phone")

#: The patterns of the base spans. Possessive and bounded forms that match the same spans in linear time.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
DOTTED = re.compile(r"\.[0-9]+\.[0-9]")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, anchored at each @: a match starts where the run of local characters does."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, floor := m.end()))
        at = text.find("@", at + 1)
    return out


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text) if DOTTED.search(text) else ():
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(_digits(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


#: Letters of other scripts that look like ASCII letters.
LOOKALIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "υ": "u",
    "ı": "i", "ɡ": "g", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "․": ".", "。": ".", "﹒": ".", "﹫": "@", "∙": ".",
}
INVISIBLE = frozenset("­​‌‍⁠﻿᠎")
#: Digit names in the languages of the texts.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_NAMES = "|".join(sorted(SPELLED, key=len, reverse=True))
_POINT = r"\x20(?:dot|point|punkt|punto)\x20"
_BETWEEN = rf"(?:{_POINT}|[\x20,.-]{{1,2}})"
#: Runs of digits and digit names with three names at least, or two behind a plus sign.
SPELLED_RUN = re.compile(rf"(?<!\w)(?:(?:{_NAMES}|plus|[0-9]+){_BETWEEN}){{2,}}(?:{_NAMES}|[0-9]+)(?!\w)", re.I)
SPELLED_PART = re.compile(rf"(?P<point>{_POINT})|(?P<gap>[\x20,.-]{{1,2}})|(?P<plus>plus)|(?P<name>{_NAMES})|(?P<number>[0-9]+)", re.I)
OPEN, CLOSE = r"[\[({<]", r"[\])}>]"
_AT = rf"\x20*{OPEN}\x20*(?:at|@|arobase|arroba)\x20*{CLOSE}\x20*"
_DOT = rf"\x20*{OPEN}\x20*(?:dot|point|punkt|punto|\.)\x20*{CLOSE}\x20*"
AT, DOT = re.compile(_AT, re.I), re.compile(_DOT, re.I)
#: Domain endings that are taken after any host.
SURE = frozenset("com org net edu gov mil info biz io ai app dev uk eu fr de ch nl pl pt ru cn jp br ca".split())
#: Words before "dot" that are no host where the ending may be a word too ("at the dot in").
COMMON = frozenset(
    """
    a an the this that these those each every any some no one two three first second third last next other another same such which what
    my your his her its our their red blue green black white yellow orange pink purple brown grey gray golden silver bright dark light
    big small little large tiny huge long short high low new old good bad right left top bottom middle center centre central single
    double only very more most same whole full empty round point it is in on of to by as or and for from with be so do we he me us
    der die das den dem des ein eine einen einem einer kein rot blau gelb schwarz weiß klein groß le la les un une des du ce cette mon
    ton son rouge bleu vert noir blanc petit grand el los las una unos unas este esta ese rojo azul verde negro blanco
    """.split()
)
_L, _H = r"[A-Za-z0-9_%+-]++", r"[A-Za-z0-9-]++"
_SEP = rf"(?:\x20dot\x20|\.|{_DOT})"
#: Addresses whose @ and dots are literal, worded or in brackets, in any mixture.
WORDED = re.compile(rf"(?<![\w@.%+-])({_L}(?:{_SEP}{_L}){{0,30}})(\x20at\x20|@|{_AT})({_H}(?:{_SEP}{_H}){{0,30}})({_SEP})([A-Za-z]{{2,63}}+)(?![\w-])", re.I)
NUMBERS = re.compile(rf"(?<![\w.])[0-9]++(?:{_SEP}[0-9]++){{3,}}(?!\w)", re.I)
WORD_DOT = re.compile(r"\x20dot\x20", re.I)
#: Characters that fold to others.
RARE = re.compile("[\u0250-\uffff\U00010000-\U0010ffff\xad\u0131]")
#: In texts in small letters: two parts of a spelled number side by side, and where the second begins.
PAIR = re.compile(rf"(?<!\w)(?:{_NAMES}|plus|[0-9]+){_BETWEEN}(?:{_NAMES})(?!\w)")
BRACKETED = re.compile(rf"{OPEN}\x20*(?:at|@|arobase|arroba|dot|point|punkt|punto|\.)\x20*{CLOSE}")
AT_HOST = re.compile(r"\x20at\x20[a-z0-9-]+\.[a-z0-9]")
SECOND = ahocorasick.Automaton()
for _gap in " ,.-":
    for _name in SPELLED:
        SECOND.add_word(_gap + _name, len(_name) + 1)
SECOND.make_automaton()
ENDS = frozenset(n[-1] for n in SPELLED) | frozenset("0123456789s,.- ")


def disguised(text: str) -> bool:
    """Whether a text may hold a disguise: what one without lacks is looked for in turn, the cheapest first."""
    if RARE.search(text):
        return True
    low = text.lower()
    if " dot " in low or any(c in low for c in "[({<") and BRACKETED.search(low) or " at " in low and AT_HOST.search(low):
        return True
    for end, size in SECOND.iter(low):
        at = end - size + 1
        if at and low[at - 1] in ENDS and PAIR.search(low, max(0, at - 24), end + 2):
            return True
    return False


Mapped = tuple[str, list[int], list[int]]


def _rewrite(m: Mapped, edits: list[tuple[int, int, str]]) -> Mapped:
    """Replace the spans; every character of a replacement stands for the whole source of what it replaces."""
    text, starts, ends = m
    out, s, e, at = [], [], [], 0
    for a, b, new in edits:
        out.append(text[at:a])
        s += starts[at:a]
        e += ends[at:a]
        if new:
            out.append(new)
            s += [starts[a]] * len(new)
            e += [ends[b - 1]] * len(new)
        at = b
    out.append(text[at:])
    return "".join(out), s + starts[at:], e + ends[at:]


def fold_characters(m: Mapped) -> Mapped:
    edits = []
    for k, c in enumerate(m[0]):
        if c < "­":
            continue
        if c in INVISIBLE:
            edits.append((k, k + 1, ""))
        elif c in LOOKALIKE:
            edits.append((k, k + 1, LOOKALIKE[c]))
        elif (d := unicodedata.decimal(c, None)) is not None:
            edits.append((k, k + 1, str(d)))
        elif c > "ɏ" and (n := unicodedata.normalize("NFKC", c)) != c and n.isascii() and len(n) == 1:
            edits.append((k, k + 1, n))
    return _rewrite(m, edits) if edits else m


def spelled_digits(m: Mapped) -> Mapped:
    """One edit for each digit name, plus and worded point, so that every digit keeps the place of its own word.

    Gaps beside a name go; a lone full stop stays, as do gaps before a plus, where the next number begins.
    """
    edits = []
    for run in SPELLED_RUN.finditer(m[0]):
        parts = [(x.lastgroup, x.start(), x.end()) for x in SPELLED_PART.finditer(m[0], run.start(), run.end())]
        names = sum(k == "name" for k, _, _ in parts)
        if names < (2 if m[0][: run.start()].endswith("+") or any(k == "plus" for k, _, _ in parts) else 3):
            continue
        kinds = [k for k, _, _ in parts]
        for n, (kind, a, b) in enumerate(parts):
            if kind == "plus":
                edits.append((a, b, "+"))
            elif kind == "name":
                edits.append((a, b, SPELLED[m[0][a:b].lower()]))
            elif kind == "point":
                edits.append((a, b, "."))
            elif kind == "gap" and kinds[n + 1] != "plus" and m[0][a:b] != "." and (kinds[n - 1] in ("plus", "name") or kinds[n + 1] == "name"):
                edits.append((a, b, ""))
    return _rewrite(m, edits) if edits else m


def is_address(w: re.Match) -> bool:
    """Whether a match of WORDED is an address rather than prose: the less is literal, the less the ending has to say."""
    local, at, host, dot, end = w.groups()
    if end.lower() not in ENDINGS:
        return False
    if at.lower() != " at ":
        return True
    if dot == "." and host.replace(".", "").replace("-", "").isalnum():
        # "look at example.com": only a name that isn't a word alone makes this an address
        return re.search(r"[A-Za-z]", local) is not None and re.search(r"[0-9._%+\x20-]", local) is not None
    return end.lower() in SURE or not host.isalnum() or host.lower() not in COMMON


def disguises(m: Mapped) -> Mapped:
    edits = [(x.start(), x.end(), "@") for x in AT.finditer(m[0])] + [(x.start(), x.end(), ".") for x in DOT.finditer(m[0])]
    for w in WORDED.finditer(m[0]):
        if is_address(w):
            if w[2].lower() == " at ":
                edits.append((w.start(2), w.end(2), "@"))
            edits += [(x.start(), x.end(), ".") for a, b in ((w.start(1), w.end(1)), (w.start(3), w.end(4))) for x in WORD_DOT.finditer(m[0], a, b)]
    for w in NUMBERS.finditer(m[0]):
        edits += [(x.start(), x.end(), ".") for x in WORD_DOT.finditer(m[0], w.start(), w.end())]
    edits.sort()
    kept, floor = [], 0
    for x in edits:
        if x[0] >= floor:
            kept.append(x)
            floor = x[1]
    return _rewrite(m, kept) if kept else m


def all_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans: those and what only the rewritten text shows."""
    base = base_spans(text)
    if not disguised(text):
        return base, base
    source: Mapped = (text, list(range(len(text))), list(range(1, len(text) + 1)))
    new = source
    for step in (fold_characters, spelled_digits, disguises):
        new = step(new)
    if new[0] == text:
        return base, base
    more, k, reach = [], 0, -1
    for s, kind, e in sorted({(new[1][s], kind, new[2][e - 1]) for s, kind, e in base_spans(new[0])}):
        while k < len(base) and base[k][0] <= s:
            reach = max(reach, base[k][2])
            k += 1
        if reach < e:
            more.append((s, kind, e))
    return base, sorted(base + more)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def personal_data(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [all_spans(t) for t in texts(b)]
        out = {"doc_id": b.column(0)}
        for n, k in enumerate(KINDS):
            out[f"n_{k}"] = pa.array([sum(x[1] == n for x in base) for base, _ in found], pa.int64())
        out["base_sha256"] = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string())
        out["spans"] = pa.array([joined(every) for _, every in found], pa.string())
        out["n_added"] = pa.array([len(every) - len(base) for base, every in found], pa.int64())
        return pa.RecordBatch.from_pydict(out)

    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_rows(rows, work, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redacted(text: str) -> str:
    """The text with each span replaced by its kind's mark; overlapping spans become one mark, that of the first."""
    out, at = [], 0
    for s, kind, e in all_spans(text)[1]:
        if s >= at:
            out += (text[at:s], f"<{KINDS[kind].upper()}>")
        at = max(at, e)
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame) -> DataFrame:
    """The input with personal data replaced in text, and n_chars, where there is such a number, counted anew."""
    names = docs.columns
    at = names.index("text")
    chars = next((k for k, f in enumerate(docs.schema) if f.name == "n_chars" and isinstance(f.dataType, T.IntegralType)), None)

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        columns = list(b.columns)
        old = columns[at].to_pylist()
        new = [t and redacted(t) for t in old]
        columns[at] = pa.array(new, columns[at].type)
        if chars is not None:
            was = columns[chars].to_pylist()
            columns[chars] = pa.array([n if a == x or x is None else len(x) for n, a, x in zip(was, old, new, strict=True)], columns[chars].type)
        return pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return map_rows(docs, work, docs.schema)
