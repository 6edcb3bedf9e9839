"""One-symbol analyses, for all symbols at once: sections, a quality gate over them, and a fixed label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.columns import change, col, ratio, yes
from marketloom.operators.views import latest, snapshot

#: What an analysis may be called.
CATCH_UP, LOOK, GAP = "POTENTIAL_CATCH_UP_CANDIDATE", "INVESTIGATE", "INCONCLUSIVE_DATA_GAP"
#: Macro readings from which on a market counts as at risk.
RISK = {"tuik_inflation": 80.0, "tcmb_policy_rate": 60.0}
#: What a backtest must say of itself.
MEASURES = ("cumulative_return", "sharpe_ratio", "maximum_drawdown", "benchmark_difference")
SECTIONS = ("sector", "technical", "fundamentals", "macro", "backtest")


def trend(now: str | Column, before: str | Column) -> Column:
    """improving, weakening or flat; unknown where either is missing."""
    a, b = col(now), col(before)
    return F.when(a > b, "improving").when(a < b, "weakening").when(a == b, "flat").otherwise("unknown")


def kama_trend(frame: DataFrame, back: int = 5) -> DataFrame:
    """(symbol, kama, kama_slope): the last value against that of ``back`` rows before, or of the first row, and against the one before it."""
    w = Window.partitionBy("symbol").orderBy("date")
    rows = frame.select("symbol", "date", "kama_10", F.lag("kama_10", 1).over(w).alias("_one"), F.lag("kama_10", back).over(w).alias("_back"), F.first("kama_10").over(w).alias("_first"), F.row_number().over(w).alias("_n"))
    before = F.when(F.col("_n") > back, F.col("_back")).otherwise(F.col("_first"))
    return latest(rows).select("symbol", trend("kama_10", before).alias("kama"), (F.col("kama_10") - F.col("_one")).alias("kama_slope"))


def market(bars: DataFrame) -> DataFrame:
    return bars.filter("date IS NOT NULL AND close IS NOT NULL").groupBy("symbol").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("row_count"), F.max_by("close", "date").alias("latest_close"))


def technical_history(events: DataFrame, reversals: DataFrame, horizon: int = 5) -> DataFrame:
    """Per symbol what followed its last event's type, or any event where that type has no measured case."""
    order = F.struct("event_date", "event_family", "event_type")
    last = events.groupBy("symbol").agg(F.max(order).alias("_e")).select("symbol", F.col("_e.event_family").alias("last_family"), F.col("_e.event_type").alias("last_type"), F.col("_e.event_date").alias("last_event_date"))
    done = reversals.filter((F.col("status") == "ok") & (F.col("horizon") == horizon) & (F.col("signal_group") == "individual")).select("symbol", "event_family", "event_type", "forward_return")
    like = (F.col("event_family") == F.col("last_family")) & (F.col("event_type") == F.col("last_type"))
    rows = last.join(done, "symbol", "left").withColumn("_like", yes(like)).withColumn("_any", F.max("_like").over(Window.partitionBy("symbol")))
    own = rows.withColumn("_r", F.when(F.col("_like") | ~F.col("_any"), F.col("forward_return")))
    return own.groupBy("symbol", "last_family", "last_type", "last_event_date").agg(F.count("_r").alias("similar_events"), F.count_if(F.col("_r") > 0).alias("positive_after"), F.median("_r").alias("median_after"))


def fundamentals_section(records: DataFrame) -> DataFrame:
    """Per symbol the latest record's main metric against one and four periods before, and the change of its operating margin."""
    w = Window.partitionBy("symbol").orderBy("period_end", "disclosure_timestamp")
    main = F.when(F.col("metric_profile") == "bank", F.col("net_interest_income")).otherwise(F.col("revenue"))
    rows = records.filter("period_end IS NOT NULL").withColumns({"_main": main, "operating_margin": ratio("operating_profit", "revenue")})
    rows = rows.withColumns({"primary_qoq": change("_main", F.lag("_main", 1).over(w)), "primary_yoy": change("_main", F.lag("_main", 4).over(w)), "operating_margin_change": F.col("operating_margin") - F.lag("operating_margin", 1).over(w)})
    return latest(rows, order="period_end").select("symbol", "period_end", "primary_qoq", "primary_yoy", "operating_margin", "operating_margin_change")


def hard_risk(records: DataFrame, decision: str | None = None, limits: dict[str, float] = RISK) -> DataFrame:
    """One row: whether any macro records, and whether a latest reading has reached its limit. Records have indicator, value, publication_timestamp."""
    known = records if decision is None else records.filter(F.col("publication_timestamp") <= F.lit(decision).cast("timestamp"))
    last = known.filter("publication_timestamp IS NOT NULL").groupBy("indicator").agg(F.max_by("value", F.struct("publication_timestamp", "value")).alias("value"))
    over = F.lit(False)
    for name, limit in limits.items():
        over = over | ((F.col("indicator") == name) & (F.col("value") >= limit))
    return last.agg((F.count("*") > 0).alias("macro_known"), F.coalesce(F.max(yes(over)), F.lit(False)).alias("hard_risk"))


def sanity(summary: DataFrame) -> DataFrame:
    """One row: whether a backtest summary is there, and the codes of measures that are missing or can't be believed."""
    lacking = [F.when(F.col(m).isNull(), F.lit(f"MISSING_{m.upper()}")) for m in MEASURES]
    far = lambda c, code: F.when(F.abs(F.col(c)) > 10, F.lit(code))
    depth = F.when((F.col("maximum_drawdown") < -1) | (F.col("maximum_drawdown") > 0), F.lit("DRAWDOWN_OUT_OF_RANGE"))
    codes = F.array_compact(F.array(*lacking, far("cumulative_return", "UNREALISTIC_CUMULATIVE_RETURN"), far("benchmark_difference", "UNREALISTIC_BENCHMARK_DIFFERENCE"), far("sharpe_ratio", "LARGE_SHARPE_RATIO"), depth))
    one = summary.agg(F.count("*").alias("_n"), F.flatten(F.collect_list(codes)).alias("backtest_codes"))
    return one.select((F.col("_n") > 0).alias("backtest_known"), "backtest_codes")


def gated(rows: DataFrame) -> DataFrame:
    """Rows with a status per section as columns ``<section>_status``: add quality_codes, quality_status and label."""
    passed = lambda s: F.col(f"{s}_status") == "pass"
    codes = F.concat(F.array_compact(F.array(F.when(~passed("backtest"), F.lit("BACKTEST_NOT_PASSED")))), F.col("backtest_codes"), F.array_compact(F.array(F.when(F.col("hard_risk"), F.lit("MACRO_HARD_RISK")))))
    out = rows.withColumn("quality_codes", codes)
    unbelievable = F.exists("quality_codes", lambda c: c.startswith("UNREALISTIC") | c.startswith("MISSING"))
    every = F.lit(True)
    for s in SECTIONS:
        every = every & passed(s)
    status = F.when(F.col("market_status") != "pass", "FAIL").when(unbelievable, "INVESTIGATE").when((F.size("quality_codes") > 0) | ~every, "PASS_WITH_WARNINGS").otherwise("PASS")
    out = out.withColumn("quality_status", status)
    constructive = yes(F.col("supertrend") == "bullish") | yes(F.col("rsi_14") < 45) | F.col("lower_band_event")
    improving = yes(F.col("primary_yoy") > 0) | yes(F.col("primary_qoq") > 0) | yes(F.col("operating_margin_change") > 0)
    behind = yes(F.col("lag_score") < 0) & constructive & yes(F.col("median_after") > 0)
    label = (
        F.when(F.col("quality_status") == "FAIL", GAP)
        .when((F.col("quality_status") != "PASS") | F.col("hard_risk"), LOOK)
        .when(behind | (improving & constructive), CATCH_UP)
        .otherwise(LOOK)
    )
    return out.withColumn("label", label)


def analyse(universe: DataFrame, bars: DataFrame, frame: DataFrame, events: DataFrame, reversals: DataFrame, records: DataFrame, macro: DataFrame, summary: DataFrame, limits: dict[str, float] = RISK, event_days: int = 20) -> DataFrame:
    """One row per symbol of the universe. ``frame`` holds the indicators, ``summary`` the backtest's summary row, if any."""
    snap = snapshot(bars, frame, events).select("symbol", "return_20", "peer_median_return", F.col("catch_up_gap").alias("lag_score"), "rsi_14", "supertrend_direction")
    last = bars.groupBy("symbol").agg(F.max("date").alias("_last"))
    touched = events.filter("event_family = 'bollinger' AND event_type = 'lower_band_touch'").join(last, "symbol").filter(F.col("event_date").between(F.date_sub("_last", event_days), F.col("_last")))
    rows = universe.select("symbol").distinct().join(market(bars), "symbol", "left").join(snap, "symbol", "left").join(kama_trend(frame), "symbol", "left")
    rows = rows.join(touched.select("symbol", F.lit(True).alias("lower_band_event")).distinct(), "symbol", "left").join(technical_history(events, reversals), "symbol", "left").join(fundamentals_section(records), "symbol", "left")
    # each of these is an aggregation without keys, so exactly one row
    one = hard_risk(macro, limits=limits).join(F.broadcast(sanity(summary)), F.lit(True))
    rows = rows.join(F.broadcast(one), F.lit(True))
    told = lambda ok, other="inconclusive": F.when(ok, "pass").otherwise(other)
    rows = rows.withColumns(
        {
            "lower_band_event": yes(F.col("lower_band_event")),
            "supertrend": F.when(F.col("supertrend_direction") > 0, "bullish").when(F.col("supertrend_direction") < 0, "bearish").otherwise("unknown"),
            "market_status": told(F.col("row_count").isNotNull(), "missing"),
            "sector_status": told(F.col("lag_score").isNotNull()),
            "technical_status": told(F.col("row_count").isNotNull(), "warning"),
            "fundamentals_status": told(F.col("period_end").isNotNull()),
            "macro_status": told(F.col("macro_known")),
            "backtest_status": F.when(~F.col("backtest_known"), "inconclusive").when(F.size("backtest_codes") > 0, "warning").otherwise("pass"),
        }
    )
    return gated(rows.drop("macro_known", "backtest_known", "supertrend_direction"))
