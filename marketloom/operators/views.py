"""Per-symbol views over the studies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.columns import past_return, yes
from marketloom.operators.catch_up import peer_medians


def latest(rows: DataFrame, back: tuple[int, ...] = (1,), keys: tuple[str, ...] = ("symbol",), order: str = "date") -> DataFrame:
    """The n-th latest rows per key; ``back`` counts from 1. Spark turns the bound on row_number into a limit per group."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))
    return rows.withColumn("back", n).filter(F.col("back") <= max(back)).filter(F.col("back").isin(*back))


def recent_events(last: DataFrame, events: DataFrame, days: int = 20) -> DataFrame:
    """symbol, recent_event: whether an event lies in the calendar days up to the symbol's last bar."""
    hits = last.select("symbol", "date").join(events.select("symbol", "event_date"), "symbol").filter(F.col("event_date").between(F.date_sub("date", days), F.col("date")))
    return hits.select("symbol").distinct().withColumn("recent_event", F.lit(True))


def snapshot(bars: DataFrame, frame: DataFrame, events: DataFrame, lookback_days: int = 20) -> DataFrame:
    """The last bar of each symbol with its return, the median of its sector's other symbols at their own last bars, and state."""
    rows = bars.select("symbol", "sector", "date", "close").withColumn("return_20", past_return("close", lookback_days))
    last = latest(rows).drop("back")
    ranked = peer_medians(last, ("sector",), peer_median_return="return_20")
    out = ranked.join(frame.drop("sector", "close", "open", "high", "low", "volume"), ["symbol", "date"]).join(recent_events(last, events), "symbol", "left")
    return out.withColumns({"catch_up_gap": F.col("return_20") - F.col("peer_median_return"), "recent_event": yes(F.col("recent_event"))})


def scenario(rows: DataFrame, keys: tuple[str, ...], value: str, adjusted: str) -> DataFrame:
    """Counts, mean, median, win rate and cost-adjusted mean of the eligible rows by the keys."""
    return rows.filter("status = 'ok'").groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean_return"), F.median(value).alias("median_return"),
        F.avg((F.col(value) > 0).cast("double")).alias("win_rate"), F.avg(adjusted).alias("mean_cost_adjusted"),
    )


def sector_history(rows: DataFrame) -> DataFrame:
    ok = rows.filter("status = 'ok' AND is_laggard")
    return ok.groupBy("symbol", "horizon").agg(F.count("*").alias("n"), F.avg("future_relative_return").alias("mean_return"), F.median("future_relative_return").alias("median_return"), F.avg(F.col("false_positive").cast("double")).alias("false_positive_rate"))
