"""News: feed parsing, normalisation, greedy deduplication, entity linking, context as of a decision, source health."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.dealing import bounded_batches
from marketloom.functions import text as X
from marketloom.functions.columns import yes
from marketloom.sources import feed_xml
from marketloom.store import stored

MOST_ALIASES = 1_000_000

ITEM = ("source_id", "title", "url", "summary", "published_timestamp", "fetched_timestamp", "language", "category", "source_access", "raw_source_url", "content_hash")

def parse_feeds(feeds: DataFrame) -> DataFrame:
    """Items of RSS and Atom documents (source_id, source_url, language, category, fetched_timestamp, body as text or bytes).

    Items without a title or an address are dropped; the first Atom link's href outranks a link's text. A document that isn't
    XML has no items: ``feed_errors`` says what is wrong with it.
    """
    rows = feed_xml.parsed(feeds).filter("error IS NULL").withColumnRenamed("source_url", "raw_source_url").withColumn("published_timestamp", X.feed_timestamp("published"))
    rows = rows.withColumns({"source_access": F.lit("rss"), "content_hash": X.content_hash("source_id", "title", "url", "published_timestamp", "summary")})
    return rows.select(*ITEM)


def feed_errors(feeds: DataFrame) -> DataFrame:
    """(source_id, error) of the sources whose document can't be read."""
    return feed_xml.parsed(feeds).filter("error IS NOT NULL").groupBy("source_id").agg(F.min("error").alias("error"))


def normalize(items: DataFrame) -> DataFrame:
    """Clean title and summary, and the hash of the clean item."""
    fix = lambda c: X.clean(X.unescaped(F.col(c)))
    out = items.withColumns({"title": fix("title"), "summary": F.nullif(fix("summary"), F.lit("")), "url": F.trim("url")})
    return out.withColumn("content_hash", X.content_hash("source_id", "title", X.url_key("url"), "published_timestamp", "summary"))


def _along_chains(open_: DataFrame) -> DataFrame:
    """Of open items (_u, _t, _o) those that stay because all that they wait for, one after the other, is decided.

    An item that leads one of its keys and comes second in the other waits for the item before it alone: it stays if that one goes.
    Such waits form chains. Each item's pointer to what it waits for is doubled until it reaches an item that doesn't wait so; if
    that one leads both keys it stays, and of the chain every second item with it. A chain of n items takes log n steps.
    """
    first = lambda rows, c, name: rows.filter(F.col(c).isNotNull()).groupBy(c).agg(F.min("_o").alias(name))
    told = open_.join(first(open_, "_u", "_fu"), "_u", "left").join(first(open_, "_t", "_ft"), "_t", "left")
    leads = lambda c, f: F.col(c).isNull() | (F.col("_o") == F.col(f))
    told = stored(told.withColumns({"_lu": leads("_u", "_fu"), "_lt": leads("_t", "_ft")}), "open-items")
    second = lambda c, lead, name: first(told.filter(~F.col(lead)), c, name)
    told = told.join(second("_u", "_lu", "_su"), "_u", "left").join(second("_t", "_lt", "_st"), "_t", "left")
    waits = F.when(F.col("_lt") & ~F.col("_lu") & (F.col("_o") == F.col("_su")), F.col("_fu")).when(F.col("_lu") & ~F.col("_lt") & (F.col("_o") == F.col("_st")), F.col("_ft"))
    told = stored(told.select("_u", "_t", "_o", (F.col("_lu") & F.col("_lt")).alias("_leads"), waits.alias("_to")), "waiting-items")
    ends = told.filter("_to IS NULL").select(F.col("_o").alias("_end"), "_leads")
    chain = told.filter("_to IS NOT NULL").select("_o", "_to", F.lit(True).alias("_odd"))
    while True:
        # whoever points to a waiting item points to where that one does
        next_ = chain.select(F.col("_o").alias("_to"), F.col("_to").alias("_further"), F.col("_odd").alias("_more"))
        longer = chain.join(next_, "_to", "left")
        moved = stored(longer.select("_o", F.coalesce("_further", "_to").alias("_to"), (F.col("_odd") != F.coalesce("_more", F.lit(False))).alias("_odd"), F.col("_further").isNotNull().alias("_moved")), "chains")
        chain = moved.drop("_moved")
        if moved.filter("_moved").isEmpty():
            break
    stay = chain.filter("NOT _odd").join(ends.filter("_leads"), F.col("_to") == F.col("_end"), "left_semi").select("_o")
    return told.filter("_leads").select("_u", "_t", "_o").unionByName(told.join(stay, "_o", "left_semi").select("_u", "_t", "_o"))


def deduplicate(items: DataFrame, key: str, order: str = "published_timestamp", rounds: int = 3) -> DataFrame:
    """Greedy first-seen deduplication by address, then title, in the order of time, source, address; an empty one is no key.

    Dropped items register nothing, so this isn't one deduplication per key. In each round an item that is the first of all
    with its address and with its title stays, and those that share either with it go; that decides all but chains in which
    each item waits for another. From then on, after ``rounds``, a round follows chains to their ends by doubled pointers, until
    nothing is open: no task gets a chain or a component. Copies of one (address, title) collapse before anything else.
    """
    at = F.coalesce(order, "fetched_timestamp") if "fetched_timestamp" in items.columns and order == "published_timestamp" else F.col(order)
    place = F.struct(at.alias("_rank"), "source_id", "url", F.col(key).alias("_id"))
    keyed = items.select(F.nullif(X.url_key("url"), F.lit("")).alias("_u"), F.nullif(F.lower("title"), F.lit("")).alias("_t"), place.alias("_o"))
    bare = F.col("_u").isNull() & F.col("_t").isNull()
    free = keyed.filter(bare).select("_o._id")
    open_ = stored(keyed.filter(~bare).groupBy("_u", "_t").agg(F.min("_o").alias("_o")), "open-items")
    kept = []
    first = lambda c: open_.filter(F.col(c).isNotNull()).groupBy(c).agg(F.min("_o").alias(f"_first{c}"))
    done = 0
    while done < rounds or not open_.isEmpty():
        if done < rounds:
            told = open_.join(first("_u"), "_u", "left").join(first("_t"), "_t", "left")
            leads = lambda c: F.col(c).isNull() | (F.col("_o") == F.col(f"_first{c}"))
            found = told.filter(leads("_u") & leads("_t")).select("_u", "_t", "_o")
        else:
            found = _along_chains(open_)
        stay = stored(found, "kept-items")
        kept.append(stay.select("_o._id"))
        rest = open_.join(stay.select("_u"), "_u", "left_anti").join(stay.select("_t"), "_t", "left_anti")
        # an item without one of the keys shares the other alone, and one that stays is open no longer
        open_ = stored(rest.join(stay.select("_o"), "_o", "left_anti"), "open-items")
        done += 1
    ids = free
    for k in kept:
        ids = ids.unionByName(k)
    return items.join(ids.withColumnRenamed("_id", key), key, "left_semi")


def match_aliases(items: DataFrame, aliases: DataFrame, key: str, text: Column | None = None) -> DataFrame:
    """(key, entity_type, entity_id, matched_term) of the aliases that stand in a text between word boundaries.

    The alias table is a dimension and goes to the driver (at most ``MOST_ALIASES`` rows, else an error); each text is read once
    by a keyword automaton over all aliases, however many there are. Texts without a match leave no row.
    """
    terms = aliases.select("normalized_alias", "entity_type", "entity_id", "alias").filter("normalized_alias <> ''").distinct().limit(MOST_ALIASES + 1).collect()
    if len(terms) > MOST_ALIASES:
        raise ValueError(f"more than {MOST_ALIASES} aliases")
    of: dict[str, list[tuple[str, str, str]]] = {}
    for r in terms:
        of.setdefault(f" {r.normalized_alias} ", []).append((r.entity_type, r.entity_id, r.alias))
    body = text if text is not None else X.match_text(F.concat_ws(" ", "title", F.coalesce("summary", F.lit(""))))
    rows = items.select(key, body.alias("_text"))
    names = ("entity_type", "entity_id", "matched_term")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = ahocorasick.Automaton()
        for k in of:
            search.add_word(k, k)
        if of:
            search.make_automaton()
        for b in batches:
            at, found = [], []
            for n, t in enumerate(b.column(1).to_pylist()):
                hits = dict.fromkeys(k for _, k in search.iter(f" {t} ")) if of and t else ()
                for e in dict.fromkeys(e for k in hits for e in of[k]):
                    at.append(n)
                    found.append(e)
            columns = [b.column(0).take(pa.array(at, pa.int64())), *(pa.array([f[k] for f in found], pa.string()) for k in range(3))]
            yield pa.RecordBatch.from_arrays(columns, [key, *names])

    return bounded_batches(rows).mapInArrow(work, f"{key} {items.schema[key].dataType.simpleString()}, " + ", ".join(f"{n} string" for n in names))


def linked(items: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    """Items with linked_entities and matched_terms, both in the order of type, entity and term."""
    own = matches.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("entity_type", "entity_id", "matched_term"))).alias("m"))
    out = items.join(own, key, "left")
    entity = F.array_distinct(F.transform("m", lambda x: F.concat_ws(":", x["entity_type"], x["entity_id"])))
    none = F.array().cast("array<string>")
    return out.withColumns({"linked_entities": F.coalesce(entity, none), "matched_terms": F.coalesce(F.transform("m", lambda x: x["matched_term"]), none)}).drop("m")


def match_summary(items: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    """Items, matched and unmatched items, then items per entity: (entity, items)."""
    total = items.join(matches.select(key, F.lit(1).alias("hit")).distinct(), key, "left").agg(F.count("*").alias("total"), F.count("hit").alias("matched"))
    rows = total.select(F.explode(F.array(F.struct(F.lit("all items").alias("entity"), F.col("total").alias("items")), F.struct(F.lit("matched items").alias("entity"), F.col("matched").alias("items")), F.struct(F.lit("unmatched items").alias("entity"), (F.col("total") - F.col("matched")).alias("items")))).alias("r")).select("r.*")
    per = matches.groupBy(F.concat_ws(":", "entity_type", "entity_id").alias("entity")).agg(F.count_distinct(key).alias("items"))
    return rows.unionByName(per)


def context(items: DataFrame, matches: DataFrame, key: str, decision: str, lookback_days: int = 7, required: DataFrame | None = None) -> DataFrame:
    """Per entity what was public in the days up to the decision, both ends included; required entities appear with zeros."""
    at = F.lit(decision).cast("timestamp")
    public = items.filter(F.col("published_timestamp").between(at - F.make_dt_interval(F.lit(lookback_days)), at)).select(key, "source_id", "url", "published_timestamp")
    hits = matches.withColumn("entity", F.concat_ws(":", "entity_type", "entity_id")).join(public, key)
    per_item = hits.select("entity", key, "source_id", "url", "published_timestamp").distinct()
    agg = per_item.groupBy("entity").agg(F.count("*").alias("news_count"), F.count_distinct("source_id").alias("source_count"), F.max("published_timestamp").alias("latest_news_timestamp"))
    # of repeated addresses only the first is gathered: the list holds what the result shows
    first = per_item.groupBy("entity", "url").agg(F.min(F.struct("published_timestamp", F.col(key).alias("item"))).alias("at"))
    urls = F.transform(F.array_sort(F.collect_list(F.struct("at", "url"))), lambda x: x["url"])
    agg = agg.join(first.groupBy("entity").agg(urls.alias("evidence_urls")), "entity")
    # terms of an item count for each of its entities
    terms = per_item.select("entity", key).join(matches.select(key, "matched_term"), key).groupBy("entity").agg(F.array_sort(F.collect_set("matched_term")).alias("matched_terms"))
    out = agg.join(terms, "entity", "left")
    if required is not None:
        out = required.select("entity").union(out.select("entity")).distinct().join(out, "entity", "left")
    none = F.array().cast("array<string>")
    return out.select(
        F.split("entity", ":", 2)[0].alias("entity_type"), F.split("entity", ":", 2)[1].alias("entity_id"), F.lit(decision).alias("decision_timestamp"), F.lit(lookback_days).alias("lookback_days"),
        F.coalesce("news_count", F.lit(0)).alias("news_count"), F.coalesce("source_count", F.lit(0)).alias("source_count"), "latest_news_timestamp",
        F.array_join(F.coalesce("evidence_urls", none), ";").alias("evidence_urls"), F.array_join(F.coalesce("matched_terms", none), ";").alias("matched_terms"),
    )


def _windows(decisions: DataFrame, lookback_days: int) -> DataFrame:
    """(at, since, day, whole): the days that each distinct decision time looks back on; whole days lie all in its window."""
    if lookback_days < 1:
        raise ValueError("lookback_days must be positive")
    at = F.col("decision_timestamp").cast("timestamp")
    each = decisions.select(at.alias("at")).filter("at IS NOT NULL").distinct().withColumn("since", F.col("at") - F.make_dt_interval(F.lit(lookback_days)))
    days = each.withColumn("day", F.explode(F.sequence(F.to_date("since"), F.to_date("at"))))
    return days.withColumn("whole", (F.col("day") > F.to_date("since")) & (F.col("day") < F.to_date("at")))


def in_windows(items: DataFrame, decisions: DataFrame, lookback_days: int = 7) -> DataFrame:
    """The items that lie in the window of any decision (decision_timestamp): an equi-join on days, of which there are few.

    They are broadcast, a row each, so that no item moves: dealt by day, a whole day's items would go to one task.
    """
    days = _windows(decisions, lookback_days)
    last = F.col("day") == F.to_date("at")
    # of a day's windows the latest that ends there holds all that others hold which end there, and so the earliest that begins
    said = days.groupBy(F.col("day").alias("_day")).agg(F.bool_or("whole").alias("_all"), F.max(F.when(last, F.col("at"))).alias("_until"), F.min(F.when(~last & ~F.col("whole"), F.col("since"))).alias("_from"))
    p = F.col("published_timestamp")
    held = F.col("_all") | yes(p <= F.col("_until")) | yes(p >= F.col("_from"))
    return items.join(F.broadcast(said), F.to_date("published_timestamp") == F.col("_day")).filter(held).drop("_day", "_all", "_until", "_from")


def contexts(items: DataFrame, aliases: DataFrame, key: str, decisions: DataFrame, lookback_days: int = 7, required: Sequence[str] = ()) -> DataFrame:
    """``context`` for many decisions (decision_timestamp) at once: a row per decision and entity that was mentioned, or required.

    Only items in some window are matched. They are summed up once per entity and day, and windows that overlap share these sums:
    a window adds up its whole days, and reads items only of the day that it begins in and the one that it ends in.
    """
    windows = stored(_windows(decisions, lookback_days), "windows")
    seen = stored(in_windows(items, decisions, lookback_days), "window-items")
    matches = stored(match_aliases(seen, aliases, key), "window-matches")
    terms = matches.groupBy(key).agg(F.collect_set("matched_term").alias("terms"))
    public = seen.select(key, "source_id", "url", "published_timestamp").join(terms, key)
    entity = F.concat_ws(":", "entity_type", "entity_id").alias("entity")
    hits = stored(matches.select(key, entity).distinct().join(public, key).withColumn("day", F.to_date("published_timestamp")), "hits")

    def summed(rows: DataFrame, *keys: str) -> DataFrame:
        one = rows.groupBy(*keys, "url").agg(
            F.count("*").alias("n"), F.max("published_timestamp").alias("latest"), F.min(F.struct("published_timestamp", F.col(key).alias("item"))).alias("first"),
            F.collect_set("source_id").alias("sources"), F.array_distinct(F.flatten(F.collect_set("terms"))).alias("terms"),
        )
        return one.groupBy(*keys).agg(
            F.sum("n").alias("n"), F.max("latest").alias("latest"), F.collect_list(F.struct("first", "url")).alias("urls"),
            F.array_distinct(F.flatten(F.collect_list("sources"))).alias("sources"), F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"),
        )

    buckets = stored(summed(hits, "entity", "day"), "day-sums")
    whole = windows.filter("whole").join(buckets, "day").drop("since", "day", "whole")
    edge = windows.filter("NOT whole").join(hits, "day").filter("published_timestamp BETWEEN since AND at")
    parts = whole.unionByName(summed(edge, "at", "entity"))
    none = F.array().cast("array<string>")
    told = parts.groupBy("at", "entity").agg(
        F.sum("n").alias("news_count"), F.max("latest").alias("latest_news_timestamp"), F.array_sort(F.flatten(F.collect_list("urls"))).alias("urls"),
        F.size(F.array_distinct(F.flatten(F.collect_list("sources")))).cast("bigint").alias("source_count"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("matched_terms"),
    )
    # addresses come in the order of their first item; later parts may repeat one
    told = told.withColumn("urls", F.array_distinct(F.transform("urls", lambda u: u["url"])))
    if required:
        asked = windows.select("at").distinct().withColumn("entity", F.explode(F.array(*map(F.lit, required))))
        told = asked.join(told, ["at", "entity"], "full")
    return told.select(
        F.split("entity", ":", 2)[0].alias("entity_type"), F.split("entity", ":", 2)[1].alias("entity_id"), F.col("at").alias("decision_timestamp"), F.lit(lookback_days).alias("lookback_days"),
        F.coalesce("news_count", F.lit(0)).alias("news_count"), F.coalesce("source_count", F.lit(0)).alias("source_count"), "latest_news_timestamp",
        F.array_join(F.coalesce("urls", none), ";").alias("evidence_urls"), F.array_join(F.coalesce("matched_terms", none), ";").alias("matched_terms"),
    )


def fetch_status(sources: DataFrame, items: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Per configured source (source_id): status, item_count and fetch_detail. ``failed`` names sources that gave an error (source_id, error)."""
    seen = items.groupBy("source_id").agg(F.count("*").alias("item_count"), F.count_if(F.col("published_timestamp").isNull()).alias("_undated"))
    out = sources.select("source_id").distinct().join(seen, "source_id", "left")
    out = out.join(failed.select("source_id", F.col("error").alias("_error")), "source_id", "left") if failed is not None else out.withColumn("_error", F.lit(None).cast("string"))
    n = F.coalesce("item_count", F.lit(0))
    undated = F.concat(F.col("_undated").cast("string"), F.lit(" items without a publication time"))
    status = F.when(F.col("_error").isNotNull(), "error").when((n == 0) | (F.col("_undated") > 0), "warning").otherwise("pass")
    detail = F.when(F.col("_error").isNotNull(), F.col("_error")).when(n == 0, "the feed had no items").when(F.col("_undated") > 0, undated).otherwise("")
    return out.select("source_id", status.alias("fetch_status"), F.when(F.col("_error").isNull(), n).otherwise(F.lit(0)).alias("item_count"), detail.alias("fetch_detail"))


def source_health(raw: DataFrame, normalized: DataFrame, as_of: str, stale_after_hours: int = 24, sources: DataFrame | None = None, fetch: DataFrame | None = None) -> DataFrame:
    """Per source: counts, latest publication, status and what it rests on. ``fetch`` has source_id, fetch_status, fetch_detail."""
    a = raw.groupBy("source_id").agg(F.count("*").alias("raw_count"), F.max("published_timestamp").alias("latest_published_timestamp"))
    b = normalized.groupBy("source_id").agg(F.count("*").alias("normalized_count"))
    ids = a.select("source_id")
    for more in (sources, fetch):
        if more is not None:
            ids = ids.union(more.select("source_id"))
    out = ids.distinct().join(a, "source_id", "left").join(b, "source_id", "left")
    out = out.join(fetch, "source_id", "left") if fetch is not None else out.withColumns({"fetch_status": F.lit(None).cast("string"), "fetch_detail": F.lit(None).cast("string")})
    out = out.withColumns({"raw_count": F.coalesce("raw_count", F.lit(0)), "normalized_count": F.coalesce("normalized_count", F.lit(0))})
    out = out.withColumn("duplicate_count", F.greatest(F.col("raw_count") - F.col("normalized_count"), F.lit(0)))
    hours = F.timestamp_diff("SECOND", F.col("latest_published_timestamp"), F.lit(as_of).cast("timestamp")) / 3600
    cases = [
        (F.col("fetch_status") == "error", "error", F.col("fetch_detail")),
        (F.col("raw_count") == 0, "warning", F.lit("no items")),
        (F.col("latest_published_timestamp").isNull(), "warning", F.lit("no item has a publication time")),
        (hours > stale_after_hours, "warning", F.lit(f"nothing newer than {stale_after_hours} hours")),
        (F.col("duplicate_count") > 0, "pass", F.concat(F.col("duplicate_count").cast("string"), F.lit(" repeats left out"))),
    ]
    status, detail = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for mask, s, d in cases:
        status, detail = status.when(mask, s), detail.when(mask, d)
    return out.select("source_id", status.otherwise("pass").alias("status"), "raw_count", "normalized_count", "duplicate_count", "latest_published_timestamp", detail.otherwise("nothing to report").alias("detail"))


def context_status(rows: DataFrame) -> DataFrame:
    """One row over the active context rows: counts, latest time, first five addresses, warnings, status."""
    active = rows.filter("coalesce(news_count, 0) > 0")
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    late = F.coalesce(F.col("latest_news_timestamp").cast("timestamp") > F.col("decision_timestamp").cast("timestamp"), F.lit(False))
    safe = F.col("latest_news_timestamp").isNotNull() & ~late
    one = active.agg(
        F.count("*").alias("rows"), F.coalesce(F.sum(F.when(safe, F.col("news_count"))), F.lit(0)).alias("evidence_count"), F.coalesce(F.sum(F.when(safe, F.col("source_count"))), F.lit(0)).alias("source_count"),
        F.max(F.when(safe, F.col("latest_news_timestamp"))).alias("latest_timestamp"), F.bool_or(blank("latest_news_timestamp")).alias("w1"), F.bool_or(blank("evidence_urls")).alias("w2"), F.bool_or(late).alias("w3"),
    )
    # the first five addresses in the order of entities: a top-k, whatever the number of rows
    each = active.filter(safe).select("entity_type", "entity_id", F.posexplode(F.split("evidence_urls", ";")).alias("n", "url")).filter("url <> ''")
    top = each.groupBy("url").agg(F.min(F.struct("entity_type", "entity_id", "n")).alias("at")).orderBy("at").limit(5)
    shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "url"))), lambda x: x["url"]), ";")
    one = one.join(F.broadcast(top.agg(shown.alias("evidence_urls"))), F.lit(True))  # one row each
    warnings = F.array_compact(F.array(F.when(F.col("rows") == 0, F.lit("EMPTY_RSS_CONTEXT")), F.when(F.col("w1"), F.lit("RSS_CONTEXT_MISSING_TIMESTAMP")), F.when(F.col("w2"), F.lit("RSS_CONTEXT_MISSING_EVIDENCE_URLS")), F.when(F.col("w1"), F.lit("RSS_CONTEXT_INVALID_TIMESTAMP")), F.when(F.col("w3"), F.lit("RSS_CONTEXT_FUTURE_TIMESTAMP"))))
    one = one.withColumn("_w", warnings)
    status = F.when(F.col("evidence_count") <= 0, "unavailable").when(F.size("_w") > 0, "warning").otherwise("available")
    return one.select(status.alias("status"), "evidence_count", "source_count", "latest_timestamp", F.array_join("_w", "+").alias("warnings"), "evidence_urls")
