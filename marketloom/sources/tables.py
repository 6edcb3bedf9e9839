"""Adapters from the star-schema tables to bars, universe, fundamentals, news and macro records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.dealing import bounded_batches, spread
from marketloom.functions.columns import by_symbol, ratio
from marketloom.store import kept

BANK_SECTOR = "EUROPE"
DOWNLOADED = "2030-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, sector. A dimension of fixed size."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("symbol"), F.col("r_name").alias("sector"))


@kept("line_sums")
def line_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over line items by symbol, sector, date and quarter of the order: lines and orders meet once for bars, indices and fundamentals.

    Prices are whole cents, quantities whole numbers, so that sums of sums are exact.
    """
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    quarter = F.date_trunc("quarter", F.col("o_orderdate")).cast("date")
    placed = order.join(cust, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey", quarter.alias("quarter"))
    dim = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("symbol"), F.col("r_name").alias("sector"))
    cents = lambda c: F.sum(F.round(c * 100).cast("bigint"))
    price, net = F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_extendedprice") * (1 - F.col("l_discount"))
    sums = (
        line.join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("c_nationkey", F.col("l_shipdate").cast("date").alias("date"), "quarter")
        .agg(
            cents(F.col("l_extendedprice")).alias("gross"), F.sum("l_quantity").alias("quantity"), F.max(price).alias("high"), F.min(price).alias("low"),
            cents(net).alias("net"), cents(net * F.col("l_tax")).alias("tax"), F.count("*").alias("lines"),
        )
    )
    return sums.join(dim, F.col("c_nationkey") == F.col("n_nationkey")).drop("c_nationkey", "n_nationkey")


def daily(sums: DataFrame, *keys: str) -> DataFrame:
    """Daily bars of ``line_sums`` by the keys and date."""
    close = F.sum("gross").cast("double") / (100 * F.sum("quantity"))
    return sums.groupBy(*keys, "date").agg(close.alias("close"), F.max("high").alias("high"), F.min("low").alias("low"), F.sum("quantity").cast("bigint").alias("volume"))


def with_open(bars: DataFrame, *keys: str) -> DataFrame:
    """The previous close as open; the first bar opens at its close."""
    return bars.withColumn("open", F.coalesce(F.lag("close").over(by_symbol(*keys)), F.col("close")))


@kept("bars")
def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, sector, date, open, high, low, close, volume."""
    out = with_open(daily(line_sums(spark, sf_dir), "symbol", "sector"))
    return out.select("symbol", "sector", "date", "open", "high", "low", "close", "volume")


@kept("benchmark")
def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, close of the whole market."""
    return daily(line_sums(spark, sf_dir)).select("date", "close")


@kept("sector_benchmarks")
def sector_benchmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sector, date, close."""
    return daily(line_sums(spark, sf_dir), "sector").select("sector", "date", "close")


@kept("fundamentals")
def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly records per nation from orders and their lines; public 40 days after the period at 18:30, UTC+3."""
    sums = line_sums(spark, sf_dir).withColumnRenamed("symbol", "ticker")
    q = sums.groupBy("ticker", "sector", "quarter").agg(*[F.sum(c).alias(c) for c in ("net", "tax", "gross", "lines")])
    period_end = F.date_sub(F.add_months("quarter", 3), 1)
    money = lambda c: (c / F.lit(100.0)).cast("double")
    return q.select(
        "ticker",
        F.col("ticker").alias("symbol"),
        "sector",
        profile("sector").alias("metric_profile"),
        period_end.alias("period_end"),
        F.lit("quarterly").alias("period_type"),
        disclosure(period_end).alias("disclosure_timestamp"),
        F.lit("orders").alias("source"),
        money(F.col("net")).alias("revenue"),
        money(F.col("net") - F.col("tax")).alias("gross_profit"),
        money(F.col("net") - 2 * F.col("tax")).alias("operating_profit"),
        money(F.col("net") - 3 * F.col("tax")).alias("net_income"),
        money(F.col("tax")).alias("net_interest_income"),
        money(2 * F.col("gross")).alias("total_assets"),
        money(F.col("gross") + F.col("tax")).alias("total_liabilities"),
        money(F.col("gross") - F.col("tax")).alias("total_equity"),
        money(F.col("tax") * 5).alias("total_debt"),
        money(F.col("net") - F.col("lines") * 100).alias("operating_cash_flow"),
        money(F.col("net") - F.col("lines") * 300).alias("free_cash_flow"),
    )


def profile(sector: str) -> Column:
    """The metric profile of a sector: bank where its name has that word, or for the stand-in bank sector."""
    s = F.lower(F.col(sector))
    return F.when(s.contains("bank") | (F.col(sector) == BANK_SECTOR), "bank").otherwise("industrial")


def disclosure(period_end: Column, lag_days: int = 40) -> Column:
    """A synthetic disclosure: so many days after the period at 18:30 local time (UTC+3), as text."""
    return F.concat(F.date_format(F.date_add(period_end, lag_days), "yyyy-MM-dd"), F.lit("T18:30:00+03:00"))


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as feed items: title is the first line, summary the rest."""
    d = bounded_batches(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"), "doc_id", "text"))
    text = F.coalesce(F.col("text"), F.lit(""))
    title = F.substring_index(text, "\n", 1)
    return d.select(
        F.col("doc_id").alias("item_id"),
        F.col("source").alias("source_id"),
        title.alias("title"),
        F.concat(F.lit("http://news.example.com/"), F.col("source"), F.lit("/"), (F.col("doc_id") - F.col("doc_id") % 3).cast("string")).alias("url"),
        F.substr(text, F.length(title) + 2).alias("summary"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") % 1000 * 3600).alias("published_timestamp"),
        F.col("lang").alias("language"),
    )


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily means of each event type as macro records, public the next morning at 09:00."""
    e = table(spark, sf_dir, "events")
    cents = F.sum(F.round(F.col("value") * 100).cast("bigint")).cast("double")
    day = e.groupBy(F.col("event_type").alias("indicator_name"), F.col("ts").cast("date").alias("observed_period_end")).agg(ratio(cents, 100.0 * F.count("value")).alias("value"), F.count("*").alias("observations"))
    return day.withColumn("publication_date", F.date_add("observed_period_end", 1))
