"""Lines and orders meet once for all that a study starts from."""

from pyspark.sql import functions as F

from marketloom import store
from marketloom.sources import tables

SF = "/root/testdata/sf0.001"


def test_bars_indices_and_fundamentals_share_one_pass(spark, monkeypatch):
    store.release(spark)
    read = []
    monkeypatch.setattr(tables, "table", lambda spark, d, name: read.append(name) or spark.read.parquet(f"{d}/{name}.parquet"))
    bars, *_ = tables.bars(spark, SF), tables.benchmark(spark, SF), tables.sector_benchmarks(spark, SF), tables.fundamentals(spark, SF)
    assert read.count("lineitem") == read.count("orders") == 1
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").agg(F.sum("l_quantity").cast("long")).first()[0]
    assert bars.agg(F.sum("volume")).first()[0] == lines
    store.release(spark)
