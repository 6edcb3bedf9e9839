"""Strategy variants A to E: layered signal components under the same prices and costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators import backtest

COMPONENTS = ("technical", "sector", "fundamentals", "macro", "news_video")
#: Each variant has the first so many components.
VARIANTS = {
    "A": ("technical", 1),
    "B": ("technical + sector", 2),
    "C": ("technical + sector + fundamentals", 3),
    "D": ("technical + sector + fundamentals + macro", 4),
    "E": ("technical + sector + fundamentals + macro + verified news/video context", 5),
}
SOURCE_COMPONENT = {"technical_reversal_fixed": "technical", "sector_catch_up_laggard": "sector", "fundamentals_positive_change": "fundamentals"}


def definitions(spark: SparkSession) -> DataFrame:
    """variant, description, components (array): five rows."""
    return spark.createDataFrame([(v, d, list(COMPONENTS[:n])) for v, (d, n) in VARIANTS.items()], "variant string, description string, components array<string>")


def component_signals(signals: DataFrame) -> DataFrame:
    """Signals of the executable sources with their component; calendar signals are left out."""
    pairs = [x for s, c in SOURCE_COMPONENT.items() for x in (F.lit(s), F.lit(c))]
    return signals.withColumn("component", F.create_map(*pairs)[F.col("source")]).filter("component IS NOT NULL")


def availability(signals: DataFrame) -> DataFrame:
    """variant, description, components, missing_components, status."""
    there = signals.agg(F.collect_set("component").alias("there"))
    out = definitions(signals.sparkSession).join(F.broadcast(there))
    missing = F.array_except("components", "there")
    return out.select("variant", "description", F.array_join("components", "+").alias("components"), F.array_join(missing, "+").alias("missing_components"), F.when(F.size(missing) > 0, "unavailable").otherwise("ok").alias("status"))


def trades(signals: DataFrame, bars: DataFrame, benchmark: DataFrame | None = None, **costs) -> DataFrame:
    """One backtest over all variants at once; signal_id becomes variant:component:id and both parts stand as columns too."""
    runs = availability(signals).filter("status = 'ok'").select("variant", F.explode(F.split("components", r"\+")).alias("component"))
    keyed = signals.join(F.broadcast(runs), "component")
    keyed = keyed.withColumns({"component_signal_id": F.col("signal_id"), "signal_id": F.concat_ws(":", "variant", "component", "signal_id"), "source": F.col("component")})
    return backtest.run(keyed, bars, benchmark, extra=("variant", "component", "component_signal_id"), **costs)


def compare(signals: DataFrame, bars: DataFrame, benchmark: DataFrame | None = None, trading_cost_bps: float = 10.0, slippage_bps: float = 5.0, horizons: tuple[int, ...] | None = None) -> DataFrame:
    """One row per variant: status, costs, data period and, where it could run, the backtest's summary."""
    done = backtest.summary(trades(signals, bars, benchmark, trading_cost_bps=trading_cost_bps, slippage_bps=slippage_bps, horizons=horizons), "variant").drop("status")
    period = bars.agg(F.min("date").alias("data_start"), F.max("date").alias("data_end"))
    out = availability(signals).join(F.broadcast(period)).join(done, "variant", "left")
    return out.withColumns({"trading_cost_bps": F.lit(float(trading_cost_bps)), "slippage_bps": F.lit(float(slippage_bps))})
