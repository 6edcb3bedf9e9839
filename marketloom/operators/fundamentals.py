"""Point-in-time fundamentals: ratios, changes against earlier periods, and returns after disclosure."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.columns import change, ratio, utc_date
from marketloom.operators import asof
from marketloom.operators.catch_up import peer_medians
from marketloom.store import stored

#: The metrics of each profile, and the columns of the result.
INDUSTRIAL = ("revenue", "gross_margin", "operating_margin", "net_income", "debt_to_assets", "operating_cash_flow", "free_cash_flow")
BANK = ("net_interest_income", "net_income", "assets_to_equity", "liabilities_to_assets")
METRICS = tuple(dict.fromkeys(INDUSTRIAL + BANK))
COLUMNS = (
    "ticker", "symbol", "sector", "metric_profile", "period_end", "disclosure_timestamp", "source", "metric_name", "current_value", "qoq_change", "yoy_change",
    "horizon", "status", "entry_date", "entry_close", "exit_date", "exit_close", "post_disclosure_return", "benchmark_return", "benchmark_relative_return",
    "sector_peer_count", "sector_peer_median_return", "sector_relative_return",
)


def with_ratios(records: DataFrame) -> DataFrame:
    return records.withColumns(
        {
            "gross_margin": ratio("gross_profit", "revenue"),
            "operating_margin": ratio("operating_profit", "revenue"),
            "debt_to_assets": ratio("total_debt", "total_assets"),
            "assets_to_equity": ratio("total_assets", "total_equity"),
            "liabilities_to_assets": ratio("total_liabilities", "total_assets"),
        }
    )


def with_changes(records: DataFrame) -> DataFrame:
    """``_qoq_change`` and ``_yoy_change`` of each metric: one period back, and four quarters or one year back."""
    w = Window.partitionBy("ticker", "period_type").orderBy("period_end", "disclosure_timestamp")
    year = lambda m: F.when(F.col("period_type") == "annual", F.lag(m, 1).over(w)).otherwise(F.lag(m, 4).over(w))
    out = with_ratios(records)
    return out.withColumns({f"{m}_qoq_change": change(F.col(m), F.lag(m, 1).over(w)) for m in METRICS} | {f"{m}_yoy_change": change(F.col(m), year(m)) for m in METRICS})


def metric_rows(records: DataFrame) -> DataFrame:
    """One row per record and metric of its profile."""
    own = lambda names: F.array(*[F.struct(F.lit(m).alias("metric_name"), F.col(m).alias("current_value"), F.col(f"{m}_qoq_change").alias("qoq_change"), F.col(f"{m}_yoy_change").alias("yoy_change")) for m in names])
    each = F.explode(F.when(F.col("metric_profile") == "bank", own(BANK)).otherwise(own(INDUSTRIAL)))
    keep = ("ticker", "symbol", "sector", "metric_profile", "period_end", "disclosure_timestamp", "source")
    return with_changes(records).select(*keep, each.alias("m")).select(*keep, "m.*")


def observations(records: DataFrame, bars: DataFrame, benchmark: DataFrame | None = None, horizons: tuple[int, ...] = (1, 5, 20)) -> DataFrame:
    """One row per record, metric and horizon. Returns are computed once per symbol, disclosure and horizon, not per metric."""
    asked = records.select("symbol", "sector", utc_date("disclosure_timestamp").alias("known")).distinct()
    asked = asked.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    # Every symbol of the sector is seen once from each date on which any of it disclosed; a record's peers are the others there.
    seen = asked.select("sector", "known", "horizon").distinct().join(records.select("symbol", "sector").distinct(), "sector")
    # read twice below: by the records and by their peers
    own = stored(asof.next_bar(seen.drop("sector").distinct(), bars, "known", horizons).select("symbol", "known", "horizon", "entry_date", F.col("entry_price").alias("entry_close"), "exit_date", F.col("exit_price").alias("exit_close"), (ratio("exit_price", "entry_price") - 1).alias("post_disclosure_return")), "returns")
    group = ("sector", "known", "horizon")
    told = peer_medians(seen.join(own.select("symbol", "known", "horizon", "post_disclosure_return"), ["symbol", "known", "horizon"]), group, measured="sector_peer_count", sector_peer_median_return="post_disclosure_return")
    peers = told.join(asked, ["symbol", *group], "left_semi").select("symbol", *group, "sector_peer_count", "sector_peer_median_return")

    rows = metric_rows(records).withColumns({"known": utc_date("disclosure_timestamp"), "horizon": F.explode(F.array(*[F.lit(h) for h in horizons]))})
    rows = rows.join(own, ["symbol", "known", "horizon"], "left").join(peers, ["symbol", "sector", "known", "horizon"], "left")
    ok = F.col("exit_date").isNotNull()
    if benchmark is None:
        rows = rows.withColumn("_b", F.lit(None).cast("double"))
    else:
        index = benchmark.select(F.lit("index").alias("symbol"), "date", "close")
        of_index = asof.next_bar(asked.select(F.lit("index").alias("symbol"), "known", "horizon").distinct(), index, "known", horizons)
        rows = rows.join(of_index.select("known", "horizon", (ratio("exit_price", "entry_price") - 1).alias("_b")), ["known", "horizon"], "left")
    rows = rows.withColumns(
        {
            "status": F.when(ok, "ok").otherwise("insufficient_forward_history"),
            "benchmark_return": F.when(ok, F.col("_b")),
            "benchmark_relative_return": F.when(ok, F.col("post_disclosure_return") - F.col("_b")),
            "sector_peer_count": F.when(ok, F.coalesce("sector_peer_count", F.lit(0))).otherwise(F.lit(0)).cast("long"),
            "sector_peer_median_return": F.when(ok, F.col("sector_peer_median_return")),
        }
    )
    return rows.withColumn("sector_relative_return", F.col("post_disclosure_return") - F.col("sector_peer_median_return")).select(*COLUMNS)


def summary(rows: DataFrame) -> DataFrame:
    both = lambda c: (F.avg(c).alias(f"average_{c}"), F.median(c).alias(f"median_{c}"))
    return rows.groupBy("metric_profile", "metric_name", "horizon", "status").agg(
        F.count("*").alias("observation_count"), *both("qoq_change"), *both("yoy_change"), *both("post_disclosure_return"),
        F.avg("benchmark_relative_return").alias("average_benchmark_relative_return"), F.avg("sector_relative_return").alias("average_sector_relative_return"),
    )
