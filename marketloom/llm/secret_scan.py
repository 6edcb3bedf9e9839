"""Secret scan with multipart credential linking (operator 2), in DataFrame functions only.

Strong patterns are reported wherever they match. Weak ones (long mixed tokens, temporary access identifiers, service
endpoints) are candidates; a candidate is reported only when a complementary part lies within ``SCOPE`` code points. Parts are of
three classes: access identifiers, secrets (assignments among them) and endpoints; parts of different classes are complementary.
That holds both ways: what vouches for a candidate is strong, or is a candidate that the other vouches for in turn, so nothing is
reported on the word of a part that isn't (a key and the endpoint of its connection string are both reported, and neither alone).

The interval join runs inside each row by sort and merge: the starts of candidates are sorted among the ends of parts, and
their ends among the starts of parts; the candidate with number k at place i has i - k of these before it, so that the parts
next to it on either side are known. A part that overlaps a candidate is no complement of it: no text vouches for itself. No
pair is ever built that isn't an answer, nothing is shuffled, and a text of n matches costs n log n.

Patterns run only on texts that hold a word which each of their matches has; weak secrets only where an identifier or an
endpoint may stand, since nothing else can ask for them.

Offsets come from two native functions: ``split`` gives the texts between matches, ``regexp_extract_all`` the matches, and
running sums of their lengths give the starts (code points, end exclusive).

Defined results: null and empty texts have no spans; repeated rows are scanned row by row; equal starts are ordered by kind
as listed; an empty table gives an empty table; other columns are not read; long texts are scanned whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCOPE = 300
STEP = 128
#: Kinds in the order in which they are listed.
BASE = ("assign", "access", "hex")
WEAK = ("weak_access", "weak_secret", "endpoint")
KINDS = (*BASE, *WEAK)

#: The patterns of the base spans.
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # AKIA[A-Z0-9]+ of 20 characters or more: a shorter run holds no longer match
HEX = r"[0-9a-f]{24,}"  # likewise
#: Candidates of the method.
WEAK_PREFIXES = ("ASIA", "AROA", "AIDA", "AGPA", "ANPA")
LONG_PREFIX = "GOOG"
WEAK_ACCESS = rf"(?<![A-Za-z0-9])(?:(?:{'|'.join(WEAK_PREFIXES)})[A-Z0-9]{{16}}|{LONG_PREFIX}[A-Z0-9]{{20,57}})(?![A-Za-z0-9])"
#: 40 characters or more, of all three classes, with padding; "=" may stand before them and a full stop behind.
WEAK_SECRET = r"(?<![A-Za-z0-9+/_.-])(?=[A-Za-z+/]*+[0-9])(?=[a-z0-9+/]*+[A-Z])(?=[A-Z0-9+/]*+[a-z])[A-Za-z0-9+/]{40,}+={0,2}(?![A-Za-z0-9+/_-])"
HOSTS = ("amazonaws.com", "googleapis.com", "windows.net", "cloudflarestorage.com", "digitaloceanspaces.com")
ENDPOINT = rf"(?<![A-Za-z0-9.-])(?:[a-z0-9-]{{1,63}}\.){{1,8}}(?:{'|'.join(HOSTS)})(?![A-Za-z0-9.-])".replace(".com", r"\.com").replace(".net", r"\.net")


def _fold(values: Column, start: Column) -> Column:
    """Exclusive running sums from ``start``."""
    kind = "struct<s:int,out:array<int>>"
    return F.aggregate(values, F.struct(start.cast("int").alias("s"), F.array().cast("array<int>").alias("out")).cast(kind), lambda a, x: F.struct((a["s"] + x).alias("s"), F.concat(a["out"], F.array(a["s"])).alias("out")).cast(kind))["out"]


def running(values: Column) -> Column:
    """Exclusive running sums of an int array, in steps of ``STEP`` so that long arrays aren't copied once per element."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / STEP).cast("int")), lambda b: F.slice(values, b * STEP + 1, STEP))
    sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x))
    return F.when(F.size(values) > 0, F.flatten(F.zip_with(blocks, _fold(sums, F.lit(0)), lambda b, o: _fold(b, o)))).otherwise(F.array().cast("array<int>"))


def matches(text: Column, pattern: str, least: Column | None = None) -> Column:
    """Spans (start, end) of a pattern's leftmost non-overlapping matches; ``least``: which of them count."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    sizes = F.transform(found, F.length)
    step = F.zip_with(F.transform(gaps, F.length), sizes, lambda g, m: g + m)
    # a match ends where the gaps and matches up to it do
    ends = F.zip_with(running(step), step, lambda a, x: a + x)
    spans = F.zip_with(ends, sizes, lambda e, m: F.struct((e - m).alias("s"), e.alias("e")))
    if least is not None:
        spans = F.transform(F.filter(F.arrays_zip(spans.alias("x"), least.alias("ok")), lambda z: z["ok"]), lambda z: z["x"])
    none = F.array().cast("array<struct<s:int,e:int>>")
    return F.when(F.rlike(text, F.lit(pattern)), spans).otherwise(none)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once: other than a lambda's variable, a column is worked out for each element."""
    return F.transform(F.array(value), body)[0]


def _before(points: Column, weak: Column, place: str, first: bool) -> Column:
    """For each weak span how many of the points lie before its ``place``; ``first``: points at that very place count too."""
    merged = F.array_sort(
        F.concat(
            F.transform(points, lambda p: F.struct(p.alias("at"), F.lit(0 if first else 1).alias("turn"), F.lit(-1).alias("k"))),
            F.transform(weak, lambda w, k: F.struct(w[place].alias("at"), F.lit(1 if first else 0).alias("turn"), k.alias("k"))),
        )
    )
    at = F.filter(F.transform(merged, lambda m, i: F.struct(m["k"].alias("k"), (i - m["k"]).alias("n"))), lambda m: m["k"] >= 0)
    return F.transform(at, lambda m: m["n"])


def linked(weak: Column, parts: Column, scope: int) -> Column:
    """For each weak span, in order, whether a part that doesn't overlap it lies within ``scope`` code points of it.

    Weak spans are sorted and apart from each other; parts may nest in any way.
    """
    ends, starts = F.array_sort(F.transform(parts, lambda p: p["e"])), F.array_sort(F.transform(parts, lambda p: p["s"]))

    def told(z: Column) -> Column:
        left = F.zip_with(z["weak"], _before(z["ends"], z["weak"], "s", True), lambda w, n: w["s"] - F.get(z["ends"], n - 1) <= scope)
        right = F.zip_with(z["weak"], _before(z["starts"], z["weak"], "e", False), lambda w, n: F.get(z["starts"], n) - w["e"] <= scope)
        return F.zip_with(left, right, lambda x, y: F.coalesce(x, F.lit(False)) | F.coalesce(y, F.lit(False)))

    return _let(F.struct(weak.alias("weak"), ends.alias("ends"), starts.alias("starts")), told)


def only(spans: Column, keep: Column) -> Column:
    return F.transform(F.filter(F.arrays_zip(spans.alias("x"), keep.alias("ok")), lambda z: z["ok"]), lambda z: z["x"])


def spans(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Per row: doc_id and an array of spans (s, e) for each kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<struct<s:int,e:int>>")

    def has(words: tuple[str, ...], of: Column = text) -> Column:
        found = F.contains(of, F.lit(words[0]))
        for w in words[1:]:
            found = found | F.contains(of, F.lit(w))
        return found

    ids, hosts = has(("AKIA", *WEAK_PREFIXES, LONG_PREFIX)), has(HOSTS)
    long_enough = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(1)), lambda g: F.length(g) >= 6)
    one = docs.select(
        "doc_id",
        F.when(has(WORDS, F.lower(text)), matches(text, ASSIGN, long_enough)).otherwise(none).alias("assign"),
        F.when(has(("AKIA",)), matches(text, ACCESS)).otherwise(none).alias("access"),
        matches(text, HEX).alias("hex"),
        F.when(has((*WEAK_PREFIXES, LONG_PREFIX)), matches(text, WEAK_ACCESS)).otherwise(none).alias("weak_access"),
        F.when(ids | hosts, matches(text, WEAK_SECRET)).otherwise(none).alias("weak_secret"),
        F.when(hosts, matches(text, ENDPOINT)).otherwise(none).alias("endpoint"),
    )
    order = lambda *c: F.array_sort(F.concat(*[F.col(x) for x in c]))
    ids, secrets = order("access", "weak_access"), order("assign", "weak_secret")
    told = lambda weak, parts: F.when((F.size(weak) > 0) & (F.size(parts) > 0), only(F.col(weak), linked(F.col(weak), parts, scope))).otherwise(none)
    return one.select(
        "doc_id",
        *BASE,
        told("weak_access", F.array_sort(F.concat(secrets, F.col("endpoint")))).alias("weak_access"),
        told("weak_secret", F.array_sort(F.concat(ids, F.col("endpoint")))).alias("weak_secret"),
        told("endpoint", F.array_sort(F.concat(ids, secrets))).alias("endpoint"),
    )


def _joined(kinds: tuple[str, ...]) -> Column:
    def tag(n: int):  # a lambda of two parameters would get the index as its second
        return lambda x: F.struct(x["s"].alias("s"), F.lit(n).alias("kind"), x["e"].alias("e"))

    tagged = F.concat(*[F.transform(F.col(k), tag(n)) for n, k in enumerate(kinds)])
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(F.array_sort(tagged), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_linked, the number of reported candidates."""
    found = spans(docs, scope)
    told = found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        _joined(BASE).alias("base"),
        _joined(KINDS).alias("spans"),
        sum((F.size(k) for k in WEAK), F.lit(0)).cast("long").alias("n_linked"),
    )
    return told.select("doc_id", *[f"n_{k}" for k in BASE], F.sha2("base", 256).alias("base_sha256"), "spans", "n_linked")
