"""Registered queries and the SQL that they are checked against.

A query is a builder (spark, sf_dir) -> DataFrame and a list of output columns. The list shapes both sides alike: ``~`` rounds
to six digits, ``#`` casts to BIGINT, ``%`` to INT, ``^`` gives ``log_`` columns: sign times log(1 + size), for compounded values
that outgrow any fixed number of digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions.columns import after_close, full, past_return, period_split, forward_return, ratio, regime
from marketloom.operators import asof, backtest, catch_up, events, fundamentals, indicators, reversals, signals, splits, variants, weekday
from marketloom.plans import oracles as O
from marketloom.sources import files
from marketloom.sources import tables as T
from marketloom.store import kept, together

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}
#: Six digits. Both engines floor the same product, so exact halves fall the same way.
SCALE = 1_000_000.0


def _spark(c: str) -> Column:
    name = c.lstrip("~#%^")
    if c[0] == "^":
        x = F.col(name)
        return (F.floor(F.signum(x) * F.log1p(F.abs(x)) * SCALE + 0.5) / SCALE).alias(f"log_{name}")
    kind = {"~": F.floor(F.col(name).cast("double") * SCALE + 0.5) / SCALE, "#": F.col(name).cast("bigint"), "%": F.col(name).cast("int")}
    return kind.get(c[0], F.col(name)).alias(name)


def _sql(c: str) -> str:
    name = c.lstrip("~#%^")
    if c[0] == "^":
        return f"floor(sign({name}) * ln(1 + abs({name})) * {SCALE} + 0.5) / {SCALE} AS log_{name}"
    return {"~": f"floor(CAST({name} AS DOUBLE) * {SCALE} + 0.5) / {SCALE}", "#": f"CAST({name} AS BIGINT)", "%": f"CAST({name} AS INTEGER)"}.get(c[0], name) + f" AS {name}"


def register(name: str, columns: str, sql: str | None = None, *needs: str) -> Callable[[Builder], Builder]:
    """``sql`` is what follows FROM over the common table expressions ``needs``; a text that starts with SELECT stands alone."""
    names = columns.split()

    def wrap(build: Builder) -> Builder:
        QUERIES[name] = lambda spark, sf_dir: build(spark, sf_dir).select(*[_spark(c) for c in names])
        if sql is not None:
            body = f"SELECT {', '.join(map(_sql, names))} FROM " + (f"({sql})" if sql.lstrip().upper().startswith("SELECT") else sql)
            ORACLES[name] = O.query(body, *needs) if needs else body
        return build

    return wrap


# ------------------------------------------------------------------------------------------------ bars and windows


@register("universe_scan", "symbol sector", "SELECT n_name AS symbol, r_name AS sector FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(spark, d):
    return T.universe(spark, d)


@register("bars_daily", "symbol sector date ~open ~high ~low ~close #volume", "bar", "bar")
def bars(spark, d):
    return T.bars(spark, d)


@register("benchmark_bars", "date ~close", "bench", "bench")
def benchmark(spark, d):
    return T.benchmark(spark, d)


@register("sector_benchmark_bars", "sector date ~close", "sector_bench", "sector_bench")
def _(spark, d):
    return T.sector_benchmarks(spark, d)


@register("missing_symbols", "symbol reason", "SELECT n_name AS symbol, 'no price history' AS reason FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 10 = 3)")
def _(spark, d):
    """Nations without one of some suppliers stand for symbols without prices."""
    there = T.table(spark, d, "supplier").filter("s_suppkey % 10 = 3").select(F.col("s_nationkey").alias("n_nationkey"))
    return files.missing_symbols(T.table(spark, d, "nation").withColumn("yahoo_symbol", F.col("n_name")), T.table(spark, d, "nation").join(there, "n_nationkey", "left_semi").withColumn("symbol", F.col("n_name")))


@register("returns_lookback", "symbol date ~return_1 ~return_5 ~return_20", f"SELECT symbol, date, close / lag(close) {O.LAG} - 1 AS return_1, close / lag(close, 5) {O.LAG} - 1 AS return_5, close / lag(close, 20) {O.LAG} - 1 AS return_20 FROM bar", "bar")
def _(spark, d):
    return bars(spark, d).withColumns({f"return_{n}": past_return("close", n) for n in (1, 5, 20)})


@register("returns_forward", "symbol date ~forward_5 ~forward_10 ~forward_20", f"SELECT symbol, date, lead(close, 5) {O.LAG} / close - 1 AS forward_5, lead(close, 10) {O.LAG} / close - 1 AS forward_10, lead(close, 20) {O.LAG} / close - 1 AS forward_20 FROM bar", "bar")
def _(spark, d):
    return bars(spark, d).withColumns({f"forward_{n}": forward_return("close", n) for n in (5, 10, 20)})


@register("sma_20_50", "symbol date ~sma_20 ~sma_50", "ind", "ind")
def _(spark, d):
    return indicators.sma(bars(spark, d), 20, 50)


@register("bollinger", "symbol date ~bb_lower ~bb_middle ~bb_upper ~bb_width", "ind", "ind")
def _(spark, d):
    return indicators.bollinger(bars(spark, d))


@register("atr_14", "symbol date ~atr_14", "ind", "ind")
def _(spark, d):
    return indicators.atr(bars(spark, d), 14)


@register("ichimoku", "symbol date ~ichimoku_conversion ~ichimoku_base ~ichimoku_span_a ~ichimoku_span_b ~ichimoku_lagging", "ind", "ind")
def _(spark, d):
    return indicators.ichimoku(bars(spark, d))


@register("support_resistance", "symbol date ~support ~resistance ~support_distance ~resistance_distance", "ind", "ind")
def _(spark, d):
    return indicators.support_resistance(bars(spark, d))


@register("relative_volume", "symbol date ~volume_sma ~relative_volume", "ind", "ind")
def _(spark, d):
    return indicators.volume(bars(spark, d))


@register("market_regime", "date ~regime_return market_regime", f"SELECT date, regime_return, {O.REGIME} AS market_regime FROM regime", "regime")
def _(spark, d):
    return weekday.benchmark_regime(benchmark(spark, d)).withColumn("market_regime", regime("regime_return"))


# ------------------------------------------------------------------------------------------------ sector catch-up


@kept("catch_up_rows")
def catch_up_rows(spark, d):
    return catch_up.observations(bars(spark, d))


@register("sector_catch_up", "symbol sector date ~close ~lookback_return #peer_count ~peer_median_lookback_return ~catch_up_score %rank_in_sector is_laggard %horizon ~future_return ~peer_median_future_return ~future_relative_return status false_positive", "catch_up", "catch_up")
def _(spark, d):
    return catch_up_rows(spark, d)


@register("sector_laggard_summary", "%horizon #observations ~mean_relative_return ~median_relative_return #false_positives", "SELECT horizon, count(*) AS observations, avg(future_relative_return) AS mean_relative_return, median(future_relative_return) AS median_relative_return, count(*) FILTER (false_positive) AS false_positives FROM catch_up WHERE status = 'ok' AND is_laggard GROUP BY horizon", "catch_up")
def _(spark, d):
    return catch_up.laggard_summary(catch_up_rows(spark, d))


@register("sector_status_counts", "%horizon status #n #false_positives", "SELECT horizon, status, count(*) AS n, count(*) FILTER (false_positive) AS false_positives FROM catch_up GROUP BY horizon, status", "catch_up")
def _(spark, d):
    # straight from the bars: of the observations' columns only what is counted is worked out, and nothing is stored
    return catch_up.status_counts(catch_up.observations(bars(spark, d)))


@register("sector_rank", "symbol sector date ~lookback_return %rank_in_sector #peer_count", "panel1", "panel1")
def _(spark, d):
    return catch_up.observations(bars(spark, d), horizons=(5,))


# ------------------------------------------------------------------------------------------------ weekday patterns


@kept("weekday_rows")
def weekday_rows(spark, d):
    return weekday.observations(bars(spark, d), benchmark(spark, d), unseen_start_date=O.UNSEEN)


@register("weekday_observations", "symbol date weekday pattern_type pattern_name %holding_days status ~entry_close ~exit_close ~gross_return ~cost_bps ~slippage_bps ~cost_adjusted_return ~unconditional_mean_return market_regime period_split", "weekdays", "weekdays")
def _(spark, d):
    return weekday_rows(spark, d)


@register("weekday_summary", "pattern_type pattern_name %holding_days period_split market_regime #observation_count ~average_gross_return ~median_gross_return ~average_cost_adjusted_return ~median_cost_adjusted_return ~average_unconditional_return", "SELECT pattern_type, pattern_name, holding_days, period_split, market_regime, count(*) AS observation_count, avg(gross_return) AS average_gross_return, median(gross_return) AS median_gross_return, avg(cost_adjusted_return) AS average_cost_adjusted_return, median(cost_adjusted_return) AS median_cost_adjusted_return, avg(unconditional_mean_return) AS average_unconditional_return FROM weekdays WHERE status = 'ok' GROUP BY 1, 2, 3, 4, 5", "weekdays")
def _(spark, d):
    return weekday.summary(weekday_rows(spark, d))


@register("unconditional_mean", "symbol %holding_days ~unconditional_mean_return", "SELECT DISTINCT symbol, holding_days, round(unconditional_mean_return, 9) AS unconditional_mean_return FROM weekdays", "weekdays")
def _(spark, d):
    return weekday_rows(spark, d).groupBy("symbol", "holding_days").agg(F.avg("gross_return").alias("unconditional_mean_return"))


@register("period_split", "symbol date period_split", f"SELECT symbol, date, CASE WHEN date >= DATE '{O.UNSEEN}' THEN 'unseen' ELSE 'selection' END AS period_split FROM bar", "bar")
def _(spark, d):
    return bars(spark, d).withColumn("period_split", period_split("date", O.UNSEEN))


# ------------------------------------------------------------------------------------------------ recursive indicators and events


def _recursive(name: str, columns: str) -> None:
    register(name, f"symbol date {columns}", "recursive_ind", "recursive_ind")(lambda spark, d: indicators.recursive(bars(spark, d)))


_recursive("ema_20", "~ema_20")
_recursive("rsi_14", "~rsi_14")
_recursive("macd", "~macd ~macd_signal ~macd_histogram")
_recursive("kama_10", "~kama_10")
_recursive("supertrend", "~supertrend ~supertrend_direction ~supertrend_upper ~supertrend_lower")


@register(
    "indicators_all",
    "symbol date " + " ".join(f"~{c}" for c in indicators.SIMPLE + indicators.RECURSIVE),
    "SELECT i.*, r.* EXCLUDE (symbol, date, idx, close) FROM ind i JOIN recursive_ind r ON i.symbol = r.symbol AND i.date = r.date",
    "ind", "recursive_ind",
)
def _(spark, d):
    return indicators.add_all(bars(spark, d))


EVENT = "symbol event_family event_type event_date known_at ~value ~reference details"


@kept("all_events")
def all_events(spark, d):
    return events.detect(indicators.add_all(bars(spark, d)))


for _family in events.FAMILIES:

    def _events_of(spark, d, family=_family):
        frame = bars(spark, d)
        if family in ("rsi", "kama", "supertrend"):
            frame = frame.select("symbol", "date", "close").join(indicators.recursive(frame), ["symbol", "date"])
        else:
            frame = {"bollinger": indicators.bollinger, "ichimoku": indicators.ichimoku, "support_resistance": indicators.support_resistance}[family](frame)
        return events.detect(frame, (family,))

    register(f"events_{_family}", EVENT, f"ev_{_family}", f"ev_{_family}")(_events_of)


@register("events_all", EVENT, "ev_all", "ev_all")
def _(spark, d):
    return all_events(spark, d)


@register("events_combined", "symbol event_family event_type event_date known_at", "ev_combined", "ev_combined")
def _(spark, d):
    return events.combined(all_events(spark, d))


@register("event_counts", "event_family event_type #n", "SELECT event_family, event_type, count(*) AS n FROM ev_all GROUP BY 1, 2", "ev_all")
def _(spark, d):
    return all_events(spark, d).groupBy("event_family", "event_type").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------------------------------------ as-of and reversals


@register(
    "asof_next_bar", "symbol known %horizon entry_date ~entry_close exit_date ~exit_close",
    "SELECT i.symbol, i.known, i.horizon, i.entry_date, i.entry_close, x.date AS exit_date, x.close AS exit_close FROM f_in i LEFT JOIN bar x ON x.symbol = i.symbol AND x.idx = i.e_idx + i.horizon", "f_in", "bar",
)
def _(spark, d):
    asked = fundamentals_records(spark, d).select("symbol", F.to_date(F.to_timestamp("disclosure_timestamp")).alias("known")).distinct()
    asked = asked.withColumn("horizon", F.explode(F.array(F.lit(1), F.lit(5), F.lit(20))))
    return asof.next_bar(asked, bars(spark, d), "known", (1, 5, 20)).withColumn("exit_close", F.col("exit_price"))


@kept("reversal_rows")
def reversal_rows(spark, d):
    return reversals.observations(bars(spark, d), *together(lambda: all_events(spark, d), lambda: benchmark(spark, d)))


@register("reversal_observations", "symbol event_family event_type event_date known_at signal_group %horizon status entry_date ~entry_close exit_date ~exit_close ~forward_return bounce market_regime", "all_reversal", "all_reversal")
def _(spark, d):
    return reversal_rows(spark, d)


@register("reversal_summary", "event_family event_type signal_group %horizon market_regime #event_count #bounce_count #failure_count ~bounce_rate ~average_forward_return ~median_forward_return", "SELECT event_family, event_type, signal_group, horizon, market_regime, count(*) AS event_count, count(*) FILTER (bounce) AS bounce_count, count(*) - count(*) FILTER (bounce) AS failure_count, count(*) FILTER (bounce) / count(*) AS bounce_rate, avg(forward_return) AS average_forward_return, median(forward_return) AS median_forward_return FROM all_reversal WHERE status = 'ok' GROUP BY 1, 2, 3, 4, 5", "all_reversal")
def _(spark, d):
    return reversals.summary(reversal_rows(spark, d))


# ------------------------------------------------------------------------------------------------ fundamentals


def fundamentals_records(spark, d):
    return T.fundamentals(spark, d)


@register("fundamentals_normalized", "ticker symbol sector metric_profile period_end period_type disclosure_timestamp source ~revenue ~gross_profit ~operating_profit ~net_income ~net_interest_income ~total_assets ~total_liabilities ~total_equity ~total_debt ~operating_cash_flow ~free_cash_flow", "fund", "fund")
def _(spark, d):
    return fundamentals_records(spark, d)


@register("fundamental_ratios", "ticker period_end ~gross_margin ~operating_margin ~debt_to_assets ~assets_to_equity ~liabilities_to_assets", "fund", "fund")
def _(spark, d):
    return fundamentals.with_ratios(fundamentals_records(spark, d))


@register("fundamental_changes", "ticker period_end metric_name ~current_value ~qoq_change ~yoy_change", "metric", "metric")
def _(spark, d):
    return fundamentals.metric_rows(fundamentals_records(spark, d))


@kept("reactions")
def reactions(spark, d):
    return fundamentals.observations(fundamentals_records(spark, d), bars(spark, d), benchmark(spark, d))


@register("fundamental_reactions", "ticker symbol sector metric_profile period_end disclosure_timestamp source metric_name ~current_value ~qoq_change ~yoy_change %horizon status entry_date ~entry_close exit_date ~exit_close ~post_disclosure_return ~benchmark_return ~benchmark_relative_return #sector_peer_count ~sector_peer_median_return ~sector_relative_return", "reaction", "reaction")
def _(spark, d):
    return reactions(spark, d)


def _both(c: str) -> str:
    return f"avg({c}) AS average_{c}, median({c}) AS median_{c}"


@register(
    "fundamental_summary", "metric_profile metric_name %horizon status #observation_count ~average_qoq_change ~median_qoq_change ~average_yoy_change ~median_yoy_change ~average_post_disclosure_return ~median_post_disclosure_return ~average_benchmark_relative_return ~average_sector_relative_return",
    f"SELECT metric_profile, metric_name, horizon, status, count(*) AS observation_count, {_both('qoq_change')}, {_both('yoy_change')}, {_both('post_disclosure_return')}, avg(benchmark_relative_return) AS average_benchmark_relative_return, avg(sector_relative_return) AS average_sector_relative_return FROM reaction GROUP BY 1, 2, 3, 4", "reaction",
)
def _(spark, d):
    return fundamentals.summary(reactions(spark, d))


@register("synthetic_disclosure", "ticker period_end disclosure_timestamp", "fund", "fund")
def _(spark, d):
    return fundamentals_records(spark, d)


NUMERICS = ("revenue", "gross_profit", "operating_profit", "net_income", "net_interest_income", "total_assets", "total_liabilities", "total_equity", "total_debt", "operating_cash_flow", "free_cash_flow")


@register(
    "fundamentals_coverage", "ticker #record_count first_period last_period latest_disclosure populated_fields",
    "SELECT ticker, count(*) AS record_count, min(period_end) AS first_period, max(period_end) AS last_period, max(disclosure_timestamp) AS latest_disclosure, concat_ws(';', " + ", ".join(f"CASE WHEN count({c}) > 0 THEN '{c}' END" for c in NUMERICS) + ") AS populated_fields FROM fund GROUP BY ticker", "fund",
)
def _(spark, d):
    there = F.array_join(F.array_compact(F.array(*[F.when(F.count(c) > 0, F.lit(c)) for c in NUMERICS])), ";")
    return fundamentals_records(spark, d).groupBy("ticker").agg(F.count("*").alias("record_count"), F.min("period_end").alias("first_period"), F.max("period_end").alias("last_period"), F.max("disclosure_timestamp").alias("latest_disclosure"), there.alias("populated_fields"))


# ------------------------------------------------------------------------------------------------ signals, backtest, splits, variants


@kept("signal_rows")
def signal_rows(spark, d):
    return signals.assemble(*together(*[lambda study=study: study(spark, d) for study in (catch_up_rows, weekday_rows, reversal_rows, reactions)]))


@kept("trade_rows")
def trade_rows(spark, d):
    needs = together(*[lambda need=need: need(spark, d) for need in (signal_rows, bars, benchmark, T.sector_benchmarks)])
    return backtest.run(*needs, T.universe(spark, d), horizons=(5, 20))


@register("signals_assembled", "signal_id symbol known_at direction %horizon source", "signal", "signal")
def _(spark, d):
    return signal_rows(spark, d)


@register("backtest_trades", "signal_id symbol source known_at direction %horizon status entry_date ~entry_price exit_date ~exit_price ~gross_return ~cost_adjusted_return ~benchmark_return ~benchmark_relative_return sector ~sector_benchmark_return ~sector_relative_return ~buy_hold_return", "trades", "trades")
def _(spark, d):
    return trade_rows(spark, d)


SUMMARY = "#signal_count #trade_count #symbol_count ~average_gross_return ~median_gross_return ~average_cost_adjusted_return ~median_cost_adjusted_return ^cumulative_return ~sharpe_ratio ~maximum_drawdown ~win_rate ^cumulative_benchmark_return ^benchmark_difference ~average_benchmark_relative_return ~average_sector_relative_return"


@register("backtest_summary", "status " + SUMMARY, "bt_summary CROSS JOIN bt_risk", "bt_summary", "bt_risk")
def _(spark, d):
    return backtest.summary(trade_rows(spark, d))


@register("risk_metrics", "^cumulative_return ~sharpe_ratio ~maximum_drawdown ~win_rate ^cumulative_benchmark_return ^benchmark_difference", "bt_risk", "bt_risk")
def _(spark, d):
    return backtest.risk_metrics(trade_rows(spark, d))


@register("exit_date_returns", "exit_date ~strategy_return ~benchmark_return #trade_count", "bt_days", "bt_days")
def _(spark, d):
    return backtest.exit_date_returns(trade_rows(spark, d))


@register("drawdown_curve", "exit_date ^equity ^peak ~drawdown", "bt_curve", "bt_curve")
def _(spark, d):
    return backtest.drawdown_curve(backtest.exit_date_returns(trade_rows(spark, d)))


def labelled(spark, d):
    return splits.label_trades(trade_rows(spark, d), benchmark(spark, d), O.UNSEEN)


@register("split_regime_labels", "signal_id signal_date period_split ~regime_return market_regime", "SELECT *, known AS signal_date FROM labelled", "labelled")
def _(spark, d):
    return labelled(spark, d)


@register("regime_counts", "period_split market_regime #trade_count ~average_return", "SELECT period_split, market_regime, count(*) AS trade_count, avg(cost_adjusted_return) AS average_return FROM labelled GROUP BY 1, 2", "labelled")
def _(spark, d):
    return splits.regime_counts(labelled(spark, d))


@register(
    "unseen_stability", "source %horizon #selection_count #unseen_count ~selection_average_return ~unseen_average_return ~stability_delta stability_label",
    """SELECT *, b - a AS stability_delta, a AS selection_average_return, b AS unseen_average_return, CASE WHEN selection_count = 0 OR unseen_count = 0 OR a IS NULL OR b IS NULL THEN 'unavailable' WHEN a > 0 AND b > 0 THEN 'stable_positive'
    WHEN a < 0 AND b < 0 THEN 'stable_negative' WHEN a * b < 0 THEN 'sign_flip' ELSE 'inconclusive' END AS stability_label FROM (SELECT source, horizon, count(*) FILTER (period_split = 'selection') AS selection_count,
    count(*) FILTER (period_split = 'unseen') AS unseen_count, avg(cost_adjusted_return) FILTER (period_split = 'selection') AS a, avg(cost_adjusted_return) FILTER (period_split = 'unseen') AS b FROM labelled GROUP BY 1, 2)""", "labelled",
)
def _(spark, d):
    return splits.stability(labelled(spark, d), ["source", "horizon"], "cost_adjusted_return")


def component_rows(spark, d):
    return variants.component_signals(signal_rows(spark, d))


@register("variant_trades", "variant component component_signal_id signal_id symbol status entry_date ~entry_price exit_date ~exit_price ~gross_return ~cost_adjusted_return ~benchmark_return", "variant_trades", "variant_trades")
def _(spark, d):
    return variants.trades(component_rows(spark, d), bars(spark, d), benchmark(spark, d), horizons=(5, 20))


@register(
    "strategy_variants", "variant description status components missing_components data_start data_end ~trading_cost_bps ~slippage_bps #signal_count #trade_count ~average_gross_return ^cumulative_return ~sharpe_ratio ~maximum_drawdown ~win_rate ^benchmark_difference",
    """SELECT v.*, p.*, 10.0 AS trading_cost_bps, 5.0 AS slippage_bps, s.* EXCLUDE (variant, status), r.* EXCLUDE (variant) FROM (VALUES ('A', 'technical', 'ok', 'technical', ''), ('B', 'technical + sector', 'ok', 'technical+sector', ''),
    ('C', 'technical + sector + fundamentals', 'ok', 'technical+sector+fundamentals', ''), ('D', 'technical + sector + fundamentals + macro', 'unavailable', 'technical+sector+fundamentals+macro', 'macro'),
    ('E', 'technical + sector + fundamentals + macro + verified news/video context', 'unavailable', 'technical+sector+fundamentals+macro+news_video', 'macro+news_video')) v(variant, description, status, components, missing_components)
    CROSS JOIN (SELECT min(date) AS data_start, max(date) AS data_end FROM bar) p LEFT JOIN va_summary s ON s.variant = v.variant LEFT JOIN va_risk r ON r.variant = v.variant""", "va_summary", "va_risk", "bar",
)
def _(spark, d):
    return variants.compare(component_rows(spark, d), bars(spark, d), benchmark(spark, d), horizons=(5, 20))
