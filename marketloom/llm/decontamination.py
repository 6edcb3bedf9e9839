"""Benchmark decontamination by a prefix-filtered set join (operator 12), in DataFrame functions only.

A benchmark item becomes windows of ``WINDOW`` consecutive words (an item of fewer words is one window); equal windows of several
items are one. A window is a set of word shingles with their places in it, and a text holds the window only if it holds all of
them, so for containment of 1 the necessary prefix is one shingle:

* **Rarity.** One walk over all documents keeps the benchmark's shingles that occur in them, and counts each over the whole corpus.
  A window with a shingle that occurs nowhere can't occur either and is done with. Of the others the rarest shingle is the prefix.
* **Prefix join.** Documents without a prefix shingle are done with. The others are walked again for the places of prefix
  shingles, each with the words around it. These meet the offsets at which the shingle stands in windows: at most ``WINDOW`` x
  ``WINDOW`` of them, however many windows share it.
* **Bounds.** A candidate that would begin before the text or end behind it is dropped: by place and by length.
* **Verification.** The candidate's words, as one text, are joined with the windows' words. Equality is exact containment.

Texts are never shuffled. In both walks a filter of bounded size (``key_filter``) goes to each task; what it lets pass is looked up
exactly. Hot shingles, windows and rows (a passage in a third of all documents) are looked up by broadcast of fewer than 1,000
rows. Which items a set of windows stands for is worked out once for each distinct set, so that many copies of a text don't meet
many copies of an item. Between the walks a row is known by 128 bits of hashes of its id and text, the same in every reading.

Defined results: null and empty texts have no words; repeated rows are judged row by row; items of equal item_id are one item, and
a null item_id is an item written as the empty string; an item without words is never found; empty tables give no rows or no
hits; other columns are not read; long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import key_filter
from .common import hot_join, stored

WINDOW = 10
SHINGLE = 3
#: What stands between words, once A-Z are small.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def raw_words(text: Column) -> Column:
    """A text's words in small letters (A-Z only); an empty one at either end stands for what isn't there."""
    whole = F.coalesce(text, F.lit(""))
    # lower() does the same on texts of single bytes, and does it faster
    small = F.when(F.octet_length(whole) == F.char_length(whole), F.lower(whole)).otherwise(F.translate(whole, _UPPER, _UPPER.lower()))
    return F.split(small, BETWEEN)


def shingles(of: Column, size: int) -> Column:
    """Hashes of a word array's shingles, one for each word; the last ones, which lack words, equal none that are whole."""
    return F.transform(of, lambda w, k: F.xxhash64(F.lit(size), w, *[F.coalesce(F.get(of, k + d), F.lit("")) for d in range(1, size)]))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def windows_of(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (window, item): the window's words joined by blanks, and the item's id as text."""
    w = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.array_remove(raw_words(F.col("text")), "").alias("w")).filter("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    cut = w.select("item", "w", F.explode(starts).alias("at")).select("item", F.array_join(F.slice("w", F.col("at"), F.lit(window)), " ").alias("window"))
    return stored(cut.distinct(), "windows")


def shingles_of(windows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(window, size, length, k, h): each window's shingles by place; a window shorter than a shingle is one."""
    w = windows.select("window").distinct().select("window", F.split("window", " ").alias("w"))
    parts = None
    for size in range(1, shingle + 1):
        fits = F.size("w") >= size if size == shingle else F.size("w") == size
        own = w.filter(fits).select("window", F.lit(size).alias("size"), F.size("w").alias("length"), F.posexplode(shingles(F.col("w"), size)).alias("k", "h")).filter(F.col("k") + size <= F.col("length"))
        parts = own if parts is None else parts.unionByName(own)
    return stored(parts, "shingles")


def places(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """(doc_id, row, w, lead, pos, at, h): the shingles of each size at each word; every row of ``docs`` has one at ``pos`` 0.

    ``w`` are the raw words, of which ``lead`` (0 or 1) are empty and stand before the text; ``at`` counts real words.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    row = F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text, "doc_id").alias("b"))
    each = lambda w: F.struct(w.alias("w"), F.concat(*[shingles(w, s) for s in sizes]).alias("h"))
    rows = docs.select("doc_id", row.alias("row"), _let(raw_words(F.col("text")), each).alias("x"))
    out = rows.select("doc_id", "row", F.col("x.w").alias("w"), F.posexplode("x.h").alias("pos", "h"))
    lead = F.when(F.get("w", F.lit(0)) == "", 1).otherwise(0)
    return out.select("doc_id", "row", "w", lead.alias("lead"), "pos", (F.col("pos") % F.size("w") - lead).alias("at"), "h")


def n_words() -> Column:
    """The number of real words among the raw ones."""
    return (F.size("w") - F.col("lead") - F.when((F.size("w") > 1) & (F.element_at("w", -1) == ""), 1).otherwise(0)).cast("long")


def occurring(docs: DataFrame, of: DataFrame, sizes: list[int], words_: int) -> DataFrame:
    """(doc_id, row, n_words, pos, h): each row of ``docs`` at ``pos`` 0 with h null, and the windows' shingles in it with pos null."""
    known = key_filter.build(of.select("h"), F.col("h"), words_)
    kept = key_filter.marked(places(docs, sizes), F.col("h"), known, words_).filter("pos = 0 OR _known")
    return stored(kept.select("doc_id", "row", n_words().alias("n_words"), F.when(F.col("pos") == 0, 0).alias("pos"), F.when(F.col("_known"), F.col("h")).alias("h")), "occurring")


def rarity(seen: DataFrame, of: DataFrame) -> DataFrame:
    """(h, n): how often each of the windows' shingles occurs in all documents; those that don't occur are left out."""
    counts = seen.filter("h IS NOT NULL").groupBy("h").agg(F.count("*").alias("n"))
    return stored(counts.join(of.select("h").distinct(), "h", "left_semi"), "rarity")


def prefixes(of: DataFrame, counts: DataFrame) -> DataFrame:
    """(h, n, offsets): the rarest shingle of each window that may occur, and where it stands in windows of which length."""
    ranked = of.join(counts, "h", "left").groupBy("window", "length").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "k")).alias("least"))
    may = ranked.filter("least.n > 0").select("least.h", "least.n", F.struct(F.col("least.k").alias("k"), "length").alias("o"))
    return stored(may.groupBy("h", "n").agg(F.collect_set("o").alias("offsets")), "prefixes")


def matches(docs: DataFrame, windows: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, words_: int = key_filter.WORDS) -> tuple[DataFrame, DataFrame]:
    """((doc_id, row, n_words) of every row, (row, start, length, window) of every occurrence of a window in distinct rows)."""
    of = shingles_of(windows, shingle)
    sizes = sorted(r[0] for r in of.select("size").distinct().collect()) or [shingle]  # at most ``shingle`` numbers
    seen = occurring(docs, of, sizes, words_)
    prefix = prefixes(of, rarity(seen, of))
    known = key_filter.build(prefix, F.col("h"), words_)
    # rows that may hold a prefix shingle, and of these the places
    asked, _ = key_filter.split(seen.filter("h IS NOT NULL").select("row", "h"), F.col("h"), known, words_)
    rows_asked = key_filter.build(asked, F.col("row"), words_)
    text = F.coalesce(F.col("text"), F.lit(""))
    named = docs.select("doc_id", "text", F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text, "doc_id").alias("b")).alias("row"))
    again, _ = key_filter.split(named, F.col("row"), rows_asked, words_)
    walked = key_filter.marked(places(again, sizes), F.col("h"), known, words_).filter("_known AND at >= 0")
    first = F.greatest(F.col("at") - (window - 1), F.lit(0))
    near = F.slice("w", first + F.col("lead") + 1, F.lit(2 * window))
    found = stored(walked.select("row", n_words().alias("n_words"), "at", "h", first.alias("first"), near.alias("near")), "places")
    begin = F.col("at") - F.col("o.k")
    fits = (begin >= 0) & (begin + F.col("o.length") <= F.col("n_words"))
    tried = hot_join(found, prefix, "h", found.count()).withColumn("o", F.explode("offsets")).filter(fits)
    tried = tried.select("row", begin.alias("start"), F.col("o.length").alias("length"), F.array_join(F.slice("near", begin - F.col("first") + 1, F.col("o.length")), " ").alias("window"))
    tried = stored(tried, "candidates")
    there = tried.groupBy("window").agg(F.count("*").alias("n")).join(windows.select("window").distinct(), "window", "left_semi")
    hits = hot_join(tried, stored(there.withColumn("there", F.lit(True)), "held"), "window", tried.count()).filter("there").drop("there")
    return seen.filter("pos = 0").select("doc_id", "row", "n_words"), hits


def _covered(intervals: Column) -> Column:
    """The number of places in the union of (start, length) intervals."""
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))

    def step(a: Column, x: Column) -> Column:
        end = x["start"] + x["length"]
        more = F.greatest(end - F.greatest(a["end"], x["start"]), F.lit(0))
        return F.struct(F.greatest(a["end"], end.cast("long")).alias("end"), (a["n"] + more).alias("n"))

    return F.aggregate(F.array_sort(intervals), zero, step)["n"]


def items_found(hits: DataFrame, windows: DataFrame) -> DataFrame:
    """(row, n_hit, n_items, items_sha256) of the rows that hold a window.

    A row's windows are as many as its words at most. Their items are gathered once for each distinct set of windows.
    """
    own = hits.groupBy("row").agg(F.collect_set(F.struct("start", "length")).alias("at"), F.array_sort(F.collect_set("window")).alias("held"))
    own = stored(own.select("row", _covered(F.col("at")).alias("n_hit"), "held", F.sha2(F.array_join("held", ","), 256).alias("set")), "held")
    sets = own.groupBy("set").agg(F.first("held").alias("held"), F.count("*").alias("n"))
    items = sets.select("set", "n", F.explode("held").alias("window")).join(windows, "window").select("set", "n", "item").distinct()
    ids = items.groupBy("set", "n").agg(F.array_sort(F.collect_list("item")).alias("ids"))
    told = stored(ids.select("set", "n", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256")), "items")
    return hot_join(own.drop("held"), told, "set", own.count()).drop("set")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, words_: int = key_filter.WORDS) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    windows = windows_of(items, window)
    rows, hits = matches(docs, windows, window, shingle, words_)
    told = stored(items_found(hits, windows), "found")
    maybe, clean = key_filter.split(rows, F.col("row"), key_filter.build(told, F.col("row"), words_), words_)
    often = maybe.groupBy("row").agg(F.count("*").alias("n"))  # rows that repeat id and text are one in ``told``
    told = stored(told.join(often, "row"), "found")
    none = F.lit(0).cast("long")
    n_items, n_hit = F.coalesce("n_items", none), F.coalesce("n_hit", none)
    columns = lambda d, hit, n, sha: d.select("doc_id", "n_words", hit.alias("n_hit"), n.alias("n_items"), sha.alias("items_sha256"), (hit > 0).alias("contaminated"))
    nothing = F.sha2(F.lit(""), 256)
    found = columns(hot_join(maybe, told, "row", rows.count()), n_hit, n_items, F.coalesce("items_sha256", nothing))
    return found.unionByName(columns(clean, none, none, nothing))
