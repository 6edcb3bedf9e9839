"""Rows go to as many tasks as there are cores, texts to Python workers in small batches."""

import random
import re

from pyspark.sql import functions as F

from marketloom.dealing import BATCH_BYTES, BATCH_KEY
from marketloom.functions import text as X
from marketloom.operators import news
from marketloom.sources import tables


def test_one_row_group_is_read_by_many_tasks(spark, tmp_path):
    rng = random.Random(2)
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.sha2(F.col("id").cast("string"), 512), *[F.sha2(F.concat("id", F.lit(str(rng.random()))), 512) for _ in range(20)]).alias("text"), F.lit("s").alias("source"), F.lit("en").alias("lang"))
    rows.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.conf.unset(BATCH_KEY)
    items = tables.news(spark, str(tmp_path))
    each = [r["count"] for r in items.groupBy(F.spark_partition_id()).count().collect()]
    assert len(each) > 2 and max(each) < 2000 and sum(each) == 4000
    assert int(spark.conf.get(BATCH_KEY)) <= BATCH_BYTES


def test_no_item_moves_to_the_task_of_its_day(spark):
    items = spark.range(100).select("id", F.timestamp_seconds(F.col("id") * 3600).alias("published_timestamp"))
    seen = news.in_windows(items, spark.createDataFrame([("1970-01-03 00:00:00",)], "decision_timestamp string"), 1)
    assert "SortMergeJoin" not in seen._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.id for r in seen.collect()) == list(range(24, 49))


def test_runs_of_white_space(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(" \n\t\x0b\x0c\r\x1c\x1f\x85\xa0   　ab<>") for _ in range(rng.randrange(12))) for _ in range(3000)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.clean("t").alias("c"), X.match_text("t").alias("m")).collect()
    for r in got:
        assert r.c == re.sub(r"[\s\x1c-\x1f\x85\xa0]+", " ", re.sub("<[^>]+>", " ", r.t)).strip(" ")
        assert r.m == X.normalize_match_text(r.t)
