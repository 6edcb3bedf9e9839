"""What followed technical events: entry at the next bar's close, exit a number of bars later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.functions.columns import ratio, yes
from marketloom.operators import asof, events as ev, weekday

COLUMNS = (
    "symbol", "event_family", "event_type", "event_date", "known_at", "signal_group", "horizon", "status",
    "entry_date", "entry_close", "exit_date", "exit_close", "forward_return", "bounce", "market_regime",
)


def observations(bars: DataFrame, events: DataFrame, benchmark: DataFrame | None = None, horizons: tuple[int, ...] = (1, 3, 5, 10), regime_lookback_days: int = 20) -> DataFrame:
    """One row per event and horizon, single events and combined ones. The regime is that of the entry bar."""
    names = ("symbol", "event_family", "event_type", "event_date", "known_at")
    asked = events.select(*names).withColumn("signal_group", F.lit("individual")).unionByName(ev.combined(events).select(*names).withColumn("signal_group", F.lit("combined")))
    asked = asked.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    found = asof.next_bar(asked, bars, "event_date", horizons)
    days = weekday.with_regime(bars.select("symbol", "date", "close"), benchmark, regime_lookback_days).select("symbol", F.col("date").alias("entry_date"), "market_regime")
    rows = found.join(days, ["symbol", "entry_date"], "left")
    rows = rows.withColumns(
        {
            "entry_close": F.col("entry_price"),
            "exit_close": F.col("exit_price"),
            "forward_return": ratio("exit_price", "entry_price") - 1,
            "market_regime": F.coalesce("market_regime", F.lit("unknown")),
        }
    )
    status = F.when(F.col("exit_date").isNull(), "insufficient_forward_history").when(F.col("market_regime") == "unknown", "insufficient_regime_history").otherwise("ok")
    return rows.withColumns({"bounce": yes(F.col("forward_return") > 0), "status": status}).select(*COLUMNS)


def summary(rows: DataFrame) -> DataFrame:
    out = rows.filter("status = 'ok'").groupBy("event_family", "event_type", "signal_group", "horizon", "market_regime").agg(
        F.count("symbol").alias("event_count"),
        F.sum(F.col("bounce").cast("long")).alias("bounce_count"),
        F.avg("forward_return").alias("average_forward_return"),
        F.median("forward_return").alias("median_forward_return"),
    )
    return out.withColumns({"failure_count": F.col("event_count") - F.col("bounce_count"), "bounce_rate": ratio(F.col("bounce_count").cast("double"), F.col("event_count").cast("double"))})
