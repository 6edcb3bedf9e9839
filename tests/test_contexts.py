"""Contexts of many decisions: each as one decision alone has it, from items that its window holds."""

import random

from pyspark.sql import functions as F

from marketloom.functions import text as X
from marketloom.operators import news

ALIASES = [("ticker", "AAA", "alpha"), ("ticker", "BBB", "beta"), ("macro", "fx", "gamma"), ("macro", "fx", "alpha")]


def frames(spark, rows):
    items = spark.createDataFrame(rows, "id long, source_id string, title string, url string, published string").withColumns({"summary": F.lit(None).cast("string"), "published_timestamp": F.col("published").cast("timestamp")})
    aliases = spark.createDataFrame(ALIASES, "entity_type string, entity_id string, alias string").withColumn("normalized_alias", X.match_text("alias"))
    return items, aliases


def plain(df):
    return sorted(tuple(str(v) for v in (r.entity_type, r.entity_id, r.news_count, r.source_count, r.latest_news_timestamp, r.evidence_urls, r.matched_terms)) for r in df.collect())


def test_each_decision_as_if_it_were_alone(spark):
    rng = random.Random(1)
    rows = [(k, f"s{rng.randrange(3)}", rng.choice(["Alpha", "beta and alpha", "gamma", "none", "Beta"]), f"u{rng.randrange(8)}", f"2024-01-{rng.randrange(1, 25):02d} {rng.randrange(24):02d}:00:00") for k in range(120)]
    rows += [(200, "s", "alpha", "u", None), (201, "s", "beta", None, "2024-01-10 12:00:00"), (202, "s", "alpha", "x", "2024-01-10 12:00:00"), (203, "s", "alpha", "y", "2024-01-08 12:00:00"), (204, "s", "alpha", "z", "2024-01-10 12:00:01"), (205, "s", "alpha", "w", "2024-01-08 11:59:59")]
    items, aliases = frames(spark, rows)
    times = ["2024-01-10 12:00:00", "2024-01-10 18:30:00", "2024-01-11 00:00:00", "2024-01-20 05:00:00", "2024-03-01 00:00:00", "2024-01-10 12:00:00"]
    decisions = spark.createDataFrame([(t,) for t in times] + [(None,)], "decision_timestamp string")
    matches = news.match_aliases(items, aliases, "id")
    required = spark.createDataFrame([("ticker:AAA",)], "entity string")
    for days in (1, 2, 7):
        got = news.contexts(items, aliases, "id", decisions, days, ["ticker:AAA"]).withColumn("at", F.col("decision_timestamp").cast("string"))
        assert {r["at"] for r in got.select("at").distinct().collect()} == set(times)
        for t in set(times):
            assert plain(got.filter(F.col("at") == t)) == plain(news.context(items, matches, "id", t, days, required))


def test_items_outside_all_windows_are_not_matched(spark):
    rows = [(1, "s", "alpha", "u", "2024-01-01 00:00:00"), (2, "s", "alpha", "u", "2024-01-08 12:00:00"), (3, "s", "alpha", "u", "2024-01-08 11:59:59"), (4, "s", "alpha", "u", "2024-01-10 12:00:00"), (5, "s", "alpha", "u", "2024-01-10 12:00:01"), (6, "s", "alpha", "u", "2024-01-09 00:00:00"), (7, "s", "alpha", "u", None)]
    items, aliases = frames(spark, rows)
    one = spark.createDataFrame([("2024-01-10 12:00:00",)], "decision_timestamp string")
    assert sorted(r.id for r in news.in_windows(items, one, 2).collect()) == [2, 4, 6]
    assert news.contexts(items, aliases, "id", one.limit(0)).collect() == []
    assert news.contexts(items.limit(0), aliases, "id", one, required=["ticker:AAA"]).first().news_count == 0
