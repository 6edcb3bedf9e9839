"""Registered queries of file imports, their readiness, and one-symbol analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom import schemas
from marketloom.operators import backtest, indicators, quality, symbol, views
from marketloom.plans import news_and_quality  # noqa: F401  its expressions are used below
from marketloom.plans import oracles as O
from marketloom.plans.registry import all_events, bars, catch_up_rows, fundamentals_records, reactions, register, reversal_rows, trade_rows, weekday_rows
from marketloom.sources import files
from marketloom.sources import tables as T
from marketloom.store import scratch

DOWNLOADED = "2030-01-01T00:00:00+03:00"


def members(spark: SparkSession, d: str) -> DataFrame:
    """The universe as its file has it."""
    return T.universe(spark, d).select(F.col("symbol").alias("ticker"), F.concat("symbol", F.lit(".X")).alias("yahoo_symbol"), "sector")


def _landed(rows: DataFrame, name: str) -> str:
    """The rows as a CSV file with a header, columns in a turned order."""
    path = scratch(rows.sparkSession, name)
    files.write_csv(rows.select(*reversed(rows.columns)), path)
    return path


def fundamentals_import(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Records written to a file, some of them spoiled, and read again."""
    rows = fundamentals_records(spark, d)
    numbers = {c: F.col(c).cast("string") if c in rows.columns else F.lit(None).cast("string") for c in schemas.NUMERIC_FUNDAMENTALS}
    spoiled = {
        "ticker": F.when(F.col("ticker") == "NATION_7", "NOBODY").otherwise(F.lower("ticker")), "yahoo_symbol": F.lit(""), "sector": F.lit("?"), "metric_profile": F.lit(""), "period_end": F.col("period_end").cast("string"),
        "period_type": F.when(F.month("period_end") == 3, "monthly").otherwise("Quarterly"), "download_timestamp": F.lit(DOWNLOADED), "currency": F.when(F.month("period_end") == 6, "EUR").otherwise(""), **numbers,
        "revenue": F.when(F.year("period_end") == 1995, "n/a").otherwise(F.col("revenue").cast("string")),
    }
    path = _landed(rows.select(*[spoiled.get(c, F.col(c) if c in rows.columns else F.lit("")).alias(c) for c in schemas.FUNDAMENTALS]), "fundamentals-file")
    return files.fundamentals(spark, path, members(spark, d))


GOOD = "symbol <> 'NATION_7' AND month(period_end) <> 3 AND year(period_end) <> 1995"


@register(
    "fundamentals_file", "ticker yahoo_symbol sector metric_profile period_end period_type public source currency ~revenue ~net_income ~cash_and_equivalents ~free_cash_flow",
    f"SELECT ticker, symbol || '.X' AS yahoo_symbol, sector, 'industrial' AS metric_profile, period_end, 'quarterly' AS period_type, strftime(CAST(period_end + 40 AS TIMESTAMP) + INTERVAL 930 MINUTE, '%Y-%m-%d %H:%M') AS public, source, CASE WHEN month(period_end) = 6 THEN 'EUR' ELSE 'TRY' END AS currency, revenue, net_income, NULL AS cash_and_equivalents, free_cash_flow FROM fund WHERE {GOOD}", "fund",
)
def _(spark, d):
    return fundamentals_import(spark, d)[0].withColumn("public", F.date_format("disclosure_timestamp", "yyyy-MM-dd HH:mm"))


@register("fundamentals_rejected", "ticker period_end #faults", f"SELECT CASE WHEN symbol = 'NATION_7' THEN 'NOBODY' ELSE lower(ticker) END AS ticker, CAST(period_end AS VARCHAR) AS period_end, (symbol = 'NATION_7')::INT + (month(period_end) = 3)::INT + (year(period_end) = 1995)::INT AS faults FROM fund WHERE NOT ({GOOD})", "fund")
def _(spark, d):
    return fundamentals_import(spark, d)[1].withColumn("faults", F.size("errors"))


@register("fundamentals_readiness", "#valid_rows #error_count #universe_coverage safe status", f"SELECT count(*) FILTER ({GOOD}) AS valid_rows, count(*) FILTER (NOT ({GOOD})) AS error_count, count(DISTINCT ticker) FILTER ({GOOD}) AS universe_coverage, TRUE AS safe, CASE WHEN count(*) FILTER ({GOOD}) = 0 THEN 'blocked_no_valid_fundamentals' WHEN count(*) FILTER (NOT ({GOOD})) > 0 THEN 'ready_with_import_warnings' ELSE 'ready' END AS status FROM fund", "fund")
def _(spark, d):
    return quality.fundamentals_readiness(*fundamentals_import(spark, d))


#: Event types stand for indicators; errors have none.
NAMED = "CASE indicator_name WHEN 'view' THEN 'usd_try' WHEN 'click' THEN 'eur_try' WHEN 'purchase' THEN 'tcmb_policy_rate' WHEN 'signup' THEN 'fed_policy_rate' ELSE 'nothing' END"


def context_import(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Macro records written to a file and read again; errors have an unknown indicator, some days no public access."""
    day = F.col("observed_period_end")
    rows = T.macro(spark, d).withColumn("indicator", F.expr(NAMED))
    told = {
        "context_id": F.concat_ws("-", F.lit("macro"), "indicator_name", day.cast("string")), "context_type": F.lit("MACRO"), "scope": F.lit("Macro"), "value": F.col("value").cast("string"), "observed_period_start": day.cast("string"), "observed_period_end": day.cast("string"),
        "publication_timestamp": F.concat(F.date_format("publication_date", "yyyy-MM-dd"), F.lit("T09:00:00+03:00")), "download_timestamp": F.lit(DOWNLOADED), "source": F.lit("events"), "source_access": F.when(F.dayofmonth(day) == 13, "private").otherwise("Public"),
    }
    return files.context(spark, _landed(rows.select(*[told.get(c, F.col(c) if c == "indicator" else F.lit("")).alias(c) for c in schemas.CONTEXT]), "context-file"))


FIT = "indicator_name <> 'error' AND dayofmonth(observed_period_end) <> 13"


@register("context_file", "context_id context_type scope indicator ~value observed_period_end public source_access title", f"SELECT 'macro-' || indicator_name || '-' || observed_period_end AS context_id, 'macro' AS context_type, 'macro' AS scope, {NAMED} AS indicator, value, observed_period_end, strftime(publication_date, '%Y-%m-%d') || ' 06:00' AS public, 'public' AS source_access, NULL AS title FROM macro WHERE {FIT}", "macro")
def _(spark, d):
    return context_import(spark, d)[0].withColumn("public", F.date_format("publication_timestamp", "yyyy-MM-dd HH:mm"))


@register("context_rejected", "context_id errors", f"SELECT 'macro-' || indicator_name || '-' || observed_period_end AS context_id, concat_ws('; ', CASE WHEN dayofmonth(observed_period_end) = 13 THEN 'source_access is unknown' END, CASE WHEN indicator_name = 'error' THEN 'indicator is unknown' END) AS errors FROM macro WHERE NOT ({FIT})", "macro")
def _(spark, d):
    return context_import(spark, d)[1].withColumn("errors", F.array_join("errors", "; "))


@register("macro_readiness", "#valid_rows #error_count missing_indicators safe status", f"SELECT count(*) FILTER ({FIT}) AS valid_rows, count(*) FILTER (NOT ({FIT})) AS error_count, 'tuik_inflation' AS missing_indicators, TRUE AS safe, 'ready_with_source_gaps' AS status FROM macro", "macro")
def _(spark, d):
    return quality.macro_readiness(*context_import(spark, d), schemas.MACRO_INDICATORS)


O.cte("kama_rows", f"SELECT symbol, date, kama_10, lag(kama_10) {O.LAG} AS one, coalesce(lag(kama_10, 5) {O.LAG}, CASE WHEN idx <= 5 THEN first_value(kama_10) {O.LAG} END) AS back, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS n FROM recursive_ind", "recursive_ind")
O.cte("kama_now", "SELECT symbol, CASE WHEN round(kama_10, 9) > round(back, 9) THEN 'improving' WHEN round(kama_10, 9) < round(back, 9) THEN 'weakening' WHEN back IS NOT NULL THEN 'flat' ELSE 'unknown' END AS kama, kama_10 - one AS kama_slope FROM kama_rows WHERE n = 1", "kama_rows")


@register("kama_trend", "symbol kama ~kama_slope", "kama_now", "kama_now")
def _(spark, d):
    return symbol.kama_trend(indicators.recursive(bars(spark, d)))


HISTORY = """SELECT l.symbol, last_family, last_type, last_event_date, count(r) AS similar_events, count(*) FILTER (r > 0) AS positive_after, median(r) AS median_after FROM (SELECT *, CASE WHEN own OR NOT any_own THEN forward_return END AS r FROM (
    SELECT *, bool_or(own) OVER (PARTITION BY symbol) AS any_own FROM (SELECT e.*, forward_return, coalesce(event_family = last_family AND event_type = last_type, FALSE) AS own FROM
    (SELECT symbol, event_date AS last_event_date, event_family AS last_family, event_type AS last_type FROM ev_all QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY event_date DESC, event_family DESC, event_type DESC) = 1) e LEFT JOIN (SELECT * FROM all_reversal WHERE status = 'ok' AND horizon = 5 AND signal_group = 'individual') o USING (symbol)))) l GROUP BY ALL"""


@register(
    "technical_history", "symbol last_family last_type last_event_date #similar_events #positive_after ~median_after",
    HISTORY, "ev_all", "all_reversal",
)
def _(spark, d):
    return symbol.technical_history(all_events(spark, d), reversal_rows(spark, d))


#: A market is taken to be at risk where purchases are worth so much on a day.
LIMITS = {"purchase": 95.0}


def _macro(spark: SparkSession, d: str) -> DataFrame:
    return T.macro(spark, d).select(F.col("indicator_name").alias("indicator"), "value", F.col("publication_date").cast("timestamp").alias("publication_timestamp"))


@register("hard_risk", "macro_known hard_risk", "SELECT TRUE AS macro_known, (SELECT max_by(value, publication_date) >= 45 FROM macro WHERE indicator_name = 'purchase') OR (SELECT max_by(value, publication_date) >= 45 FROM macro WHERE indicator_name = 'view') AS hard_risk", "macro")
def _(spark, d):
    return symbol.hard_risk(_macro(spark, d), limits={"purchase": 45.0, "view": 45.0})


@register("backtest_sanity", "backtest_known codes", "SELECT TRUE AS backtest_known, concat_ws(';', CASE WHEN abs(cumulative_return) > 10 THEN 'UNREALISTIC_CUMULATIVE_RETURN' END, CASE WHEN abs(benchmark_difference) > 10 THEN 'UNREALISTIC_BENCHMARK_DIFFERENCE' END, CASE WHEN abs(sharpe_ratio) > 10 THEN 'LARGE_SHARPE_RATIO' END, CASE WHEN maximum_drawdown < -1 OR maximum_drawdown > 0 THEN 'DRAWDOWN_OUT_OF_RANGE' END) AS codes FROM bt_risk", "bt_risk")
def _(spark, d):
    return symbol.sanity(backtest.summary(trade_rows(spark, d))).withColumn("codes", F.array_join("backtest_codes", ";"))


#: Figures of a backtest that can be believed, so that labels rest on the sections.
BELIEVED = "cumulative_return double, benchmark_difference double, sharpe_ratio double, maximum_drawdown double"
QL = "OVER (PARTITION BY symbol ORDER BY period_end, disclosure_timestamp)"


O.cte(
    "sections",
    f"""SELECT *, supertrend = 'bullish' OR coalesce(rsi_14 < 45, FALSE) OR lower_band_event AS constructive FROM (
    SELECT n_name AS symbol, m.row_count, m.latest_close, s.return_20 - p.m AS lag_score, ri.rsi_14, CASE WHEN ri.supertrend_direction > 0 THEN 'bullish' WHEN ri.supertrend_direction < 0 THEN 'bearish' ELSE 'unknown' END AS supertrend, k.kama,
    EXISTS (SELECT 1 FROM ev_bollinger e WHERE e.symbol = n_name AND e.event_type = 'lower_band_touch' AND e.event_date BETWEEN m.last - 20 AND m.last) AS lower_band_event, h.last_type, h.similar_events, h.median_after, f.*
    FROM nation LEFT JOIN (SELECT symbol, count(*) AS row_count, max(date) AS last, arg_max(close, date) AS latest_close FROM bar GROUP BY 1) m ON m.symbol = n_name
    LEFT JOIN (SELECT symbol, date, close / lag(close, 20) {O.LAG} - 1 AS return_20 FROM bar) s ON s.symbol = n_name AND s.date = m.last
    LEFT JOIN (SELECT a.symbol, median(b.ret) AS m FROM (SELECT DISTINCT symbol, sector FROM bar) a JOIN (SELECT symbol, sector, arg_max(ret, date) FILTER (last = date) AS ret FROM (SELECT symbol, sector, date, max(date) OVER (PARTITION BY symbol) AS last, close / lag(close, 20) {O.LAG} - 1 AS ret FROM bar) GROUP BY 1, 2) b ON a.sector = b.sector AND a.symbol <> b.symbol GROUP BY 1) p ON p.symbol = n_name
    LEFT JOIN recursive_ind ri ON ri.symbol = n_name AND ri.date = m.last LEFT JOIN kama_now k ON k.symbol = n_name
    LEFT JOIN ({{history}}) h ON h.symbol = n_name
    LEFT JOIN (SELECT symbol AS f_symbol, period_end, main / nullif(lag(main) {QL}, 0) - 1 AS primary_qoq, main / nullif(lag(main, 4) {QL}, 0) - 1 AS primary_yoy, om - lag(om) {QL} AS operating_margin_change, row_number() OVER (PARTITION BY symbol ORDER BY period_end DESC) AS n FROM
    (SELECT *, CASE WHEN metric_profile = 'bank' THEN net_interest_income ELSE revenue END AS main, operating_profit / nullif(revenue, 0) AS om FROM fund)) f ON f.f_symbol = n_name AND f.n = 1)""".replace("{history}", HISTORY),
    "bar", "ev_bollinger", "ev_all", "all_reversal", "recursive_ind", "kama_now", "fund",
)
#: A label of rows with quality_status, from the sections.
LABEL = """CASE WHEN quality_status = 'FAIL' THEN 'INCONCLUSIVE_DATA_GAP' WHEN quality_status <> 'PASS' THEN 'INVESTIGATE' WHEN constructive AND (coalesce(lag_score < 0 AND median_after > 0, FALSE) OR coalesce(primary_yoy > 0, FALSE) OR coalesce(primary_qoq > 0, FALSE) OR coalesce(operating_margin_change > 0, FALSE))
    THEN 'POTENTIAL_CATCH_UP_CANDIDATE' ELSE 'INVESTIGATE' END"""
#: The gate's verdict of rows with codes.
VERDICT = "CASE WHEN row_count IS NULL THEN 'FAIL' WHEN contains(quality_codes, 'UNREALISTIC') OR contains(quality_codes, 'MISSING') THEN 'INVESTIGATE' WHEN quality_codes <> '' OR lag_score IS NULL OR period_end IS NULL THEN 'PASS_WITH_WARNINGS' ELSE 'PASS' END"


@register(
    "symbol_analysis", "symbol row_count ~latest_close ~lag_score ~rsi_14 supertrend kama lower_band_event last_type #similar_events ~median_after ~primary_qoq ~primary_yoy ~operating_margin_change quality_status quality_codes label",
    f"SELECT *, {LABEL} AS label FROM (SELECT *, {VERDICT} AS quality_status FROM (SELECT *, '' AS quality_codes FROM sections))", "sections",
)
def _(spark, d):
    believed = spark.createDataFrame([(0.5, 0.1, 1.0, -0.2)], BELIEVED)
    frame = indicators.add_all(bars(spark, d))
    out = symbol.analyse(T.universe(spark, d), bars(spark, d), frame, all_events(spark, d), reversal_rows(spark, d), fundamentals_records(spark, d), _macro(spark, d), believed, LIMITS)
    return out.withColumn("quality_codes", F.array_join("quality_codes", ";"))


#: Codes of a backtest's summary row, as ``symbol.sanity`` gives them.
CODES = """concat_ws(';', CASE WHEN cumulative_return IS NULL THEN 'MISSING_CUMULATIVE_RETURN' END, CASE WHEN sharpe_ratio IS NULL THEN 'MISSING_SHARPE_RATIO' END, CASE WHEN maximum_drawdown IS NULL THEN 'MISSING_MAXIMUM_DRAWDOWN' END, CASE WHEN benchmark_difference IS NULL THEN 'MISSING_BENCHMARK_DIFFERENCE' END,
    CASE WHEN abs(cumulative_return) > 10 THEN 'UNREALISTIC_CUMULATIVE_RETURN' END, CASE WHEN abs(benchmark_difference) > 10 THEN 'UNREALISTIC_BENCHMARK_DIFFERENCE' END, CASE WHEN abs(sharpe_ratio) > 10 THEN 'LARGE_SHARPE_RATIO' END, CASE WHEN maximum_drawdown < -1 OR maximum_drawdown > 0 THEN 'DRAWDOWN_OUT_OF_RANGE' END)"""


@register(
    "symbol_gate", "variant symbol quality_status quality_codes label",
    f"""SELECT *, CASE WHEN quality_status <> 'FAIL' AND risk THEN 'INVESTIGATE' ELSE {LABEL} END AS label FROM (SELECT *, {VERDICT} AS quality_status FROM (
    SELECT *, concat_ws(';', CASE WHEN codes <> '' THEN 'BACKTEST_NOT_PASSED' END, nullif(codes, ''), CASE WHEN risk THEN 'MACRO_HARD_RISK' END) AS quality_codes FROM sections, (
      SELECT 'own' AS variant, {CODES} AS codes, FALSE AS risk FROM bt_risk UNION ALL SELECT 'no sharpe', {CODES}, FALSE FROM (SELECT * REPLACE (CAST(NULL AS DOUBLE) AS sharpe_ratio) FROM bt_risk) UNION ALL SELECT 'at risk', {CODES}, TRUE FROM bt_risk)))""",
    "sections", "bt_risk",
)
def _(spark, d):
    """Labels upon the study's own backtest: as it is, without its Sharpe ratio, and with the market at risk."""
    own = backtest.summary(trade_rows(spark, d))
    frame = indicators.add_all(bars(spark, d))
    sections = lambda summary, limits: symbol.analyse(T.universe(spark, d), bars(spark, d), frame, all_events(spark, d), reversal_rows(spark, d), fundamentals_records(spark, d), _macro(spark, d), summary, limits)
    variants = {"own": (own, LIMITS), "no sharpe": (own.withColumn("sharpe_ratio", F.lit(None).cast("double")), LIMITS), "at risk": (own, {"purchase": 0.0})}
    out = None
    for name, how in variants.items():
        rows = sections(*how).select(F.lit(name).alias("variant"), "symbol", "quality_status", F.array_join("quality_codes", ";").alias("quality_codes"), "label")
        out = rows if out is None else out.unionByName(rows)
    return out


# ------------------------------------------------------------------------------------------------ scenarios of a symbol

MEASURES = "#n ~mean_return ~median_return ~win_rate ~mean_cost_adjusted"


def _scenario(name: str, keys: tuple[str, ...], source: str, value: str, adjusted: str, build, need: str, where: str = "status = 'ok'") -> None:
    sql = f"SELECT {', '.join(keys)}, count(*) AS n, avg({value}) AS mean_return, median({value}) AS median_return, avg(CASE WHEN {value} > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, avg({adjusted}) AS mean_cost_adjusted FROM {source} WHERE {where} GROUP BY ALL"
    register(name, " ".join(f"%{k}" if k in ("holding_days", "horizon") else k for k in keys) + " " + MEASURES, sql, need)(lambda spark, d: views.scenario(build(spark, d).filter(where), keys, value, adjusted))


_scenario("scenario_holding_table", ("symbol", "holding_days"), "weekdays", "gross_return", "cost_adjusted_return", weekday_rows, "weekdays")
_scenario("scenario_split_table", ("symbol", "period_split"), "weekdays", "gross_return", "cost_adjusted_return", weekday_rows, "weekdays")
_scenario("scenario_fundamental_table", ("symbol", "metric_name", "horizon"), "reaction", "post_disclosure_return", "benchmark_relative_return", reactions, "reaction")
_scenario("scenario_sector_table", ("symbol", "horizon", "is_laggard"), "catch_up", "future_return", "future_relative_return", catch_up_rows, "catch_up")


@register(
    "scenario_false_positives", "symbol %horizon #laggards #false_positives ~false_positive_rate",
    "SELECT symbol, horizon, count(*) AS laggards, count(*) FILTER (false_positive) AS false_positives, avg(CASE WHEN false_positive THEN 1.0 ELSE 0.0 END) AS false_positive_rate FROM catch_up WHERE status = 'ok' AND is_laggard GROUP BY 1, 2", "catch_up",
)
def _(spark, d):
    ok = catch_up_rows(spark, d).filter("status = 'ok' AND is_laggard")
    return ok.groupBy("symbol", "horizon").agg(F.count("*").alias("laggards"), F.count_if("false_positive").alias("false_positives"), F.avg(F.col("false_positive").cast("double")).alias("false_positive_rate"))
