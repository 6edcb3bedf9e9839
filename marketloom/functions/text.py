"""Text functions of the news path."""

from __future__ import annotations

import html
import re
import unicodedata
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from marketloom.functions.columns import col

#: Letters that fold to ASCII before anything else.
TURKISH_FROM = "çğıöşüÇĞİIÖŞÜ"
TURKISH_TO = "cgiosucgiiosu"

#: Unicode white space.
ODD_WHITE = r"\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs of it that aren't one plain space already: most gaps are, and stay as they are.
WHITE = rf"[{ODD_WHITE}][\x20{ODD_WHITE}]*|\x20[\x20{ODD_WHITE}]+"


def clean(c: str | Column) -> Column:
    """Tags out, white space collapsed, trimmed. Entities must be unescaped before (``unescaped``)."""
    return F.trim(F.regexp_replace(F.regexp_replace(col(c), "<[^>]+>", " "), WHITE, " "))


#: Entities that are replaced natively; a text with any other goes to the function below.
PLAIN_ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\xa0", "copy": "\xa9", "middot": "\xb7", "#39": "'", "#039": "'", "#x27": "'", "amp": "&"}
OTHER_ENTITY = rf"&(?!(?:{'|'.join(PLAIN_ENTITIES)});)(?:#|[A-Za-z])"
#: Ampersands, and all else that may be an entity with its semicolon.
CLOSED_ENTITY = re.compile("&amp;?|&(#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);")
OTHER_CLOSED_ENTITY = rf"&(?!(?:{'|'.join(PLAIN_ENTITIES)});|amp)(?:#[xX]?[0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);"


def unescape_closed(value: str) -> str:
    """As ``html.unescape``, but an entity that lacks its semicolon stays as it is, unless it is an ampersand."""
    known = lambda name: name is None or name[0] == "#" or f"{name};" in html5
    return CLOSED_ENTITY.sub(lambda m: html.unescape(m[0]) if known(m[1]) else m[0], value)


@F.pandas_udf(StringType())
def _unescaped(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def _unescaped_closed(s: pd.Series) -> pd.Series:
    return s.map(unescape_closed, na_action="ignore")


def unescaped(c: str | Column, closed: bool = False) -> Column:
    """HTML entities as their characters. Texts with none but common ones stay in the JVM; the others' go to the full table.

    closed: entities without their semicolon stay as they are, save the ampersand (``unescape_closed``).
    """
    text = col(c)
    plain = text
    for name, character in PLAIN_ENTITIES.items():  # amp comes last, so that what it uncovers isn't replaced again
        plain = F.regexp_replace(plain, "&amp;?", "&") if closed and name == "amp" else F.replace(plain, F.lit(f"&{name};"), F.lit(character))
    rest, full = (OTHER_CLOSED_ENTITY, _unescaped_closed) if closed else (OTHER_ENTITY, _unescaped)
    any_, other = F.contains(text, F.lit("&")), F.rlike(text, F.lit(rest))
    return F.when(~any_, text).when(other, full(F.when(other, text))).otherwise(plain)


def url_key(c: str | Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(col(c))), "/+$", "")


def content_hash(*parts: str | Column) -> Column:
    """SHA-256 of the parts, a line each; a missing part is an empty line."""
    return F.sha2(F.concat_ws("\n", *[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts]), 256)


def normalize_match_text(value: str) -> str:
    """The matching form of any text: case folding and compatibility decomposition, marks dropped."""
    folded = unicodedata.normalize("NFKD", value.translate(str.maketrans(TURKISH_FROM, TURKISH_TO)).casefold())
    plain = "".join(ch for ch in folded if not unicodedata.combining(ch))
    return re.sub("[^a-z0-9]+", " ", re.sub("<[^>]+>", " ", plain)).strip()


def _folding() -> tuple[str, str, str]:
    """(characters, their replacements, characters that become several), by rule over the basic plane.

    Marks come last and without replacement, which drops them; what becomes neither letter, digit nor angle bracket is left
    out, since it is a gap like any other character.
    """
    one, to, marks, several = [], [], [], []
    turkish = str.maketrans(TURKISH_FROM, TURKISH_TO)
    for n in (*range(ord("A"), ord("Z") + 1), *range(0x80, 0xD800), *range(0xE000, 0x10000)):
        folded = unicodedata.normalize("NFKD", chr(n).translate(turkish).casefold())
        plain = "".join(ch for ch in folded if not unicodedata.combining(ch))
        if not plain:
            marks.append(chr(n))
        elif len(plain) == 1 and re.match("[a-z0-9<>]", plain):
            one.append(chr(n))
            to.append(plain)
        elif re.search("[a-z0-9<>]", plain):
            several.append(chr(n))
    return "".join(one + marks), "".join(to), "".join(several)


FOLD_FROM, FOLD_TO, SEVERAL = _folding()
#: The German sharp s is the one character that becomes several and isn't rare.
SHARP = "\xdf\u1e9e"


def _ranges(characters: str) -> str:
    """The inside of a character class: runs of neighbours as ranges, since a class is searched range by range."""
    out: list[list[int]] = []
    for n in sorted(map(ord, characters)):
        if out and n == out[-1][1] + 1:
            out[-1][1] = n
        else:
            out.append([n, n])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" if a < b else f"\\u{a:04x}" for a, b in out)


#: Texts with characters that become several, or beyond the basic plane, take the slower function. Most texts have none above
#: U+024F, which one range decides.
RARE_LATIN = "[" + _ranges("".join(c for c in SEVERAL if c not in SHARP and c < "\u0250")) + "]"
BEYOND = r"[^\x00-\u024f]"
RARE_BEYOND = "[" + _ranges("".join(c for c in SEVERAL if c not in SHARP and c >= "\u0250")) + r"\x{10000}-\x{10ffff}]"
NOT_ASCII = r"[^\x00-\x7f]"


@F.pandas_udf(StringType())
def _match_text(s: pd.Series) -> pd.Series:
    return s.map(normalize_match_text, na_action="ignore")


def match_text(c: str | Column) -> Column:
    """The matching form: folded letters and digits, everything else one space. Only rare characters leave the JVM."""
    text = col(c)
    wide = F.rlike(text, F.lit(NOT_ASCII))
    sharp = F.replace(F.replace(text, F.lit(SHARP[0]), F.lit("ss")), F.lit(SHARP[1]), F.lit("ss"))
    plain = F.when(wide, F.translate(sharp, FOLD_FROM, FOLD_TO)).otherwise(F.lower(text))
    native = F.trim(F.regexp_replace(F.regexp_replace(plain, "<[^>]+>", " "), "[^a-z0-9 ][^a-z0-9]*| [^a-z0-9]+", " "))
    rare = wide & (F.rlike(text, F.lit(RARE_LATIN)) | F.rlike(text, F.lit(BEYOND)) & F.rlike(text, F.lit(RARE_BEYOND)))
    return F.when(rare, _match_text(F.when(rare, text))).otherwise(native)


#: Zone names of mail dates, in hours from UTC. Any other name counts as UTC.
ZONES = {"AST": -4, "ADT": -3, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7}
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
#: A mail date's parts, each by name: day and month in either order, two to four digits of a year, a time, a zone and a remark.
_DAY, _MONTH = r"(\d{1,2}),?", r"([a-z]+),?"
_REST = r"[\s-]+(\d{2,4}),?\s+(\d{1,2})[:.](\d{1,2})(?:[:.](\d{1,2}))?\s*([+-][\d:]{1,6}|[a-z]+)?(?:\s*\(.*\))?$"
DAY_FIRST = rf"(?i)^(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*[,.]?\s+|[a-z]+,\s*)?{_DAY}[\s-]+{_MONTH}{_REST}"
MONTH_FIRST = rf"(?i)^(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*[,.]?\s+|[a-z]+,\s*)?{_MONTH}[\s-]+{_DAY}{_REST}"


def _mail_date(v: Column, pattern: str, day: int, month: int) -> Column:
    part = lambda n: F.nullif(F.regexp_extract(v, pattern, n), F.lit(""))
    number = lambda n: part(n).try_cast("int")
    name = F.lower(part(month))
    which = F.coalesce(*[F.when(name.isin(m, m[:3]), k) for k, m in enumerate(MONTHS, 1)])
    year = number(3)
    year = F.when(year >= 100, year).when(year > 68, year + 1900).otherwise(year + 2000)
    zone = F.upper(F.coalesce(part(7), F.lit("")))
    digits = F.when(zone.rlike(r"^[+-]\d+$"), zone.try_cast("int"))
    size = F.abs(digits)
    shift = F.when(digits.isNotNull(), F.signum(digits).cast("int") * (F.floor(size / 100) * 60 + size % 100))
    for z, h in ZONES.items():
        shift = F.when(zone == z, h * 60).otherwise(shift)
    local = F.try_make_timestamp(year, which, number(day), number(4), number(5), F.coalesce(number(6), F.lit(0)).cast("double"), F.lit("UTC"))
    return local - F.make_dt_interval(mins=F.coalesce(shift, F.lit(0)).cast("int"))


def feed_timestamp(c: str | Column) -> Column:
    """A mail date (RFC 822, with zone names, short years, full month names, in any case) or ISO 8601 text as a time stamp.

    No zone, or a zone of another name, means UTC. What is neither is missing.
    """
    v = F.trim(col(c))
    iso = F.regexp_replace(v, r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.coalesce(
        _mail_date(v, DAY_FIRST, 1, 2), _mail_date(v, MONTH_FIRST, 2, 1),
        F.try_to_timestamp(F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?\s*(Z|z|[+-]\d{2}:?\d{2})?)?$"), F.replace(iso, F.lit("z"), F.lit("Z")))),
        F.try_to_timestamp(F.when(v.rlike(r"^\d{8}$"), v), F.lit("yyyyMMdd")),
    )
