"""Fixed signal rules over the research observations. Only what is known at the signal's time enters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.columns import after_close, yes

COLUMNS = ("signal_id", "symbol", "known_at", "direction", "horizon", "source")
SOURCES = ("sector_catch_up_laggard", "weekday_monday_fixed", "technical_reversal_fixed", "fundamentals_positive_change")


def _signals(rows: DataFrame, prefix: str, source: str, known, *parts) -> DataFrame:
    name = F.concat_ws(":", F.lit(prefix), F.col("symbol"), *parts, F.concat(F.lit("h"), F.col("horizon").cast("string")))
    return rows.select(name.alias("signal_id"), "symbol", known.alias("known_at"), F.lit("long").alias("direction"), F.col("horizon").cast("int").alias("horizon"), F.lit(source).alias("source"))


def sector(rows: DataFrame, horizon: int = 5) -> DataFrame:
    ok = rows.filter((F.col("status") == "ok") & (F.col("horizon") == horizon) & F.col("is_laggard"))
    return _signals(ok, "sector_catch_up", SOURCES[0], after_close("date"), F.col("date").cast("string"))


def monday(rows: DataFrame, horizon: int = 5) -> DataFrame:
    name = "Monday" if horizon == 1 else f"Monday_{horizon}d_hold"
    ok = rows.filter((F.col("status") == "ok") & (F.col("holding_days") == horizon) & (F.col("pattern_name") == name)).withColumn("horizon", F.col("holding_days"))
    return _signals(ok, "weekday_monday", SOURCES[1], after_close("date"), F.col("date").cast("string"))


def technical(rows: DataFrame, horizon: int = 5) -> DataFrame:
    """Combined events where there is any combined event at all, single ones otherwise."""
    ok = rows.filter((F.col("status") == "ok") & (F.col("horizon") == horizon))
    any_combined = ok.agg(F.coalesce(F.bool_or(F.col("signal_group") == "combined"), F.lit(False)).alias("any_combined"))
    ok = ok.join(F.broadcast(any_combined)).filter(~F.col("any_combined") | (F.col("signal_group") == "combined"))
    return _signals(ok, "technical_reversal", SOURCES[2], F.col("known_at"), F.col("event_date").cast("string"), F.col("signal_group"), F.col("event_family"), F.col("event_type"))


def fundamental(rows: DataFrame, horizon: int = 20) -> DataFrame:
    ok = rows.filter((F.col("status") == "ok") & (F.col("horizon") == horizon) & (yes(F.col("qoq_change") > 0) | yes(F.col("yoy_change") > 0)))
    return _signals(ok, "fundamentals_positive_change", SOURCES[3], F.col("disclosure_timestamp"), F.col("period_end").cast("string"), F.col("metric_name"))


def assemble(sector_rows=None, weekday_rows=None, technical_rows=None, fundamental_rows=None, preferred_horizon: int = 5, fundamentals_horizon: int = 20) -> DataFrame:
    """All signals; of equal ids the first in the order sector, weekday, technical, fundamentals stays."""
    parts = []
    for n, (rows, rule, h) in enumerate(((sector_rows, sector, preferred_horizon), (weekday_rows, monday, preferred_horizon), (technical_rows, technical, preferred_horizon), (fundamental_rows, fundamental, fundamentals_horizon))):
        if rows is not None:
            parts.append(rule(rows, h).withColumn("_order", F.lit(n)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    first = F.row_number().over(Window.partitionBy("signal_id").orderBy("_order", "known_at", "symbol"))
    return out.withColumn("_n", first).filter("_n = 1").select(*COLUMNS)
