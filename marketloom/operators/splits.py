"""Selection and unseen periods, market regimes, and whether results hold in both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.functions.columns import period_split, regime, utc_date
from marketloom.operators.weekday import benchmark_regime


def label_trades(trades: DataFrame, benchmark: DataFrame, unseen_start: str | None, lookback_days: int = 20) -> DataFrame:
    """Tradable rows with signal_date (UTC), period_split and market_regime."""
    ok = trades.filter("status = 'ok'").withColumn("signal_date", utc_date("known_at"))
    days = benchmark_regime(benchmark, lookback_days).withColumnRenamed("date", "signal_date")
    out = ok.join(days, "signal_date", "left")
    return out.withColumns({"period_split": period_split("signal_date", unseen_start), "market_regime": regime("regime_return")})


def regime_counts(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("period_split", "market_regime").agg(F.count("signal_id").alias("trade_count"), F.avg("cost_adjusted_return").alias("average_return"))


def stability(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Counts and means of both periods side by side, their difference and a label. Rows with a missing key don't count."""
    ok = rows.filter((F.col("status") == "ok") & F.col("period_split").isin("selection", "unseen")).dropna(subset=keys)
    of = lambda s: F.when(F.col("period_split") == s, F.col(value))
    out = ok.groupBy(*keys).agg(
        F.count(of("selection")).alias("selection_count"), F.count(of("unseen")).alias("unseen_count"),
        F.avg(of("selection")).alias("selection_average_return"), F.avg(of("unseen")).alias("unseen_average_return"),
    )
    a, b = F.col("selection_average_return"), F.col("unseen_average_return")
    label = (
        F.when((F.col("selection_count") == 0) | (F.col("unseen_count") == 0) | a.isNull() | b.isNull(), "unavailable")
        .when((a > 0) & (b > 0), "stable_positive")
        .when((a < 0) & (b < 0), "stable_negative")
        .when(a * b < 0, "sign_flip")
        .otherwise("inconclusive")
    )
    return out.withColumns({"stability_delta": b - a, "stability_label": label})
