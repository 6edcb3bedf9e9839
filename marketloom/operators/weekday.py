"""Weekday and multi-day patterns with costs, regimes and a fixed unseen period."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.columns import by_symbol, past_return, period_split, ratio, regime

COLUMNS = (
    "symbol", "date", "weekday", "pattern_type", "pattern_name", "holding_days", "status", "entry_close", "exit_close", "gross_return",
    "cost_bps", "slippage_bps", "cost_adjusted_return", "unconditional_mean_return", "market_regime", "period_split",
)
KEYS = ("pattern_type", "pattern_name", "holding_days", "period_split", "market_regime")


def benchmark_regime(benchmark: DataFrame, lookback_days: int = 20) -> DataFrame:
    """date, regime_return of one benchmark series: a calendar-sized dimension."""
    w = Window.orderBy("date")
    return benchmark.select("date", (ratio(F.col("close"), F.lag("close", lookback_days).over(w)) - 1).alias("regime_return"))


def with_regime(bars: DataFrame, benchmark: DataFrame | None, lookback_days: int) -> DataFrame:
    if benchmark is None:
        out = bars.withColumn("regime_return", past_return("close", lookback_days))
    else:
        out = bars.join(benchmark_regime(benchmark, lookback_days), "date", "left")
    return out.withColumn("market_regime", regime("regime_return"))


def observations(
    bars: DataFrame, benchmark: DataFrame | None = None, holding_days: tuple[int, ...] = (1, 2, 3, 4, 5), trading_cost_bps: float = 10.0,
    slippage_bps: float = 5.0, regime_lookback_days: int = 20, unseen_start_date: str | None = None,
) -> DataFrame:
    """One row per bar and holding period. A missing regime outranks a missing exit."""
    w = by_symbol()
    base = with_regime(bars.select("symbol", "date", "close"), benchmark, regime_lookback_days)
    base = base.withColumns({f"_x{h}": F.lead("close", h).over(w) for h in holding_days})
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("holding_days"), F.col(f"_x{h}").alias("exit_close")) for h in holding_days]))
    rows = base.select("symbol", "date", F.col("close").alias("entry_close"), "market_regime", each.alias("_h")).select("*", "_h.holding_days", "_h.exit_close")
    gross = ratio("exit_close", "entry_close") - 1
    day = F.date_format("date", "EEEE")
    cost = (trading_cost_bps + slippage_bps) / 10000
    rows = rows.withColumns({"gross_return": gross, "weekday": day})
    rows = rows.withColumns(
        {
            "pattern_type": F.when(F.col("holding_days") == 1, "weekday").otherwise("multi_day"),
            "pattern_name": F.when(F.col("holding_days") == 1, F.col("weekday")).otherwise(F.concat("weekday", F.lit("_"), F.col("holding_days").cast("string"), F.lit("d_hold"))),
            "status": F.when(F.col("market_regime") == "unknown", "insufficient_regime_history").when(F.col("exit_close").isNull(), "insufficient_forward_history").otherwise("ok"),
            "cost_bps": F.lit(float(trading_cost_bps)),
            "slippage_bps": F.lit(float(slippage_bps)),
            "cost_adjusted_return": F.col("gross_return") - cost,
            "unconditional_mean_return": F.avg("gross_return").over(Window.partitionBy("symbol", "holding_days")),
            "period_split": period_split("date", unseen_start_date),
        }
    )
    return rows.select(*COLUMNS)


def summary(rows: DataFrame) -> DataFrame:
    return rows.filter("status = 'ok'").groupBy(*KEYS).agg(
        F.count("symbol").alias("observation_count"),
        F.avg("gross_return").alias("average_gross_return"),
        F.median("gross_return").alias("median_gross_return"),
        F.avg("cost_adjusted_return").alias("average_cost_adjusted_return"),
        F.median("cost_adjusted_return").alias("median_cost_adjusted_return"),
        F.avg("unconditional_mean_return").alias("average_unconditional_return"),
    )
