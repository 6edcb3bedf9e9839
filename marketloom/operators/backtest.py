"""Point-in-time backtest: entry at the next bar's open, exit at a close, costs, benchmark and sector comparison, risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.columns import local_date, ratio
from marketloom.operators import asof

TRADE_COLUMNS = (
    "signal_id", "symbol", "source", "known_at", "direction", "horizon", "status", "entry_timing", "exit_timing", "entry_date", "entry_price", "exit_date", "exit_price",
    "gross_return", "trading_cost_bps", "slippage_bps", "total_cost_bps", "cost_adjusted_return", "benchmark_return", "benchmark_relative_return",
    "sector", "sector_benchmark_return", "sector_relative_return", "buy_hold_return",
)
ENTRY, EXIT = "next_trading_day_open", "close_after_horizon"


def unfit(bars: DataFrame) -> DataFrame:
    """symbol, message of the histories that no trade may use: repeated dates, prices that aren't positive."""
    day = bars.groupBy("symbol", "date").agg(F.count("*").alias("n"), F.min(F.least("close", F.coalesce("open", "close"))).alias("low"))
    one = day.groupBy("symbol").agg(F.max("n").alias("n"), F.min("low").alias("low"))
    return one.select("symbol", F.when(F.col("n") > 1, "contains duplicate dates").when(F.col("low") <= 0, "contains non-positive prices").alias("message")).filter("message IS NOT NULL")


def _index_return(rows: DataFrame, index: DataFrame, out: str, *keys: str) -> DataFrame:
    """Close-to-close return of an index between a trade's dates; missing unless both are days of the index."""
    enter = index.select(*keys, F.col("date").alias("entry_date"), F.col("close").alias("_in"))
    leave = index.select(*keys, F.col("date").alias("exit_date"), F.col("close").alias("_out"))
    both = rows.join(enter, [*keys, "entry_date"], "left").join(leave, [*keys, "exit_date"], "left")
    return both.withColumn(out, F.when(F.col("exit_date").isNotNull(), ratio("_out", "_in") - 1)).drop("_in", "_out")


def run(
    signals: DataFrame, bars: DataFrame, benchmark: DataFrame | None = None, sector_benchmarks: DataFrame | None = None, symbol_sectors: DataFrame | None = None,
    horizons: tuple[int, ...] | None = None, default_horizon: int = 5, trading_cost_bps: float = 10.0, slippage_bps: float = 5.0, extra: tuple[str, ...] = (),
) -> DataFrame:
    """One row per signal. ``extra`` names columns to keep.

    Where ``horizons`` names all that the signals carry, each bar brings its exits along; else exits are found by bar number.
    """
    if trading_cost_bps < 0 or slippage_bps < 0 or trading_cost_bps + slippage_bps <= 0:
        raise ValueError("costs must not be negative, and not both zero")
    text = lambda c, d: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit(d)) if c in signals.columns else F.lit(d)
    asked = signals.select(
        F.col("signal_id").cast("string"), "symbol", text("source", "unspecified").alias("source"), F.col("known_at").cast("string").alias("known_at"),
        F.lower(text("direction", "long")).alias("direction"), (F.coalesce(F.col("horizon").cast("int"), F.lit(default_horizon)) if "horizon" in signals.columns else F.lit(default_horizon)).alias("horizon"),
        local_date("known_at").alias("_known"), *extra,
    )
    prices = bars.select("symbol", "date", (F.coalesce("open", "close") if "open" in bars.columns else F.col("close")).alias("open"), "close")
    prices = prices.join(unfit(prices), "symbol", "left_anti")
    known = prices.groupBy("symbol").agg(F.lit(True).alias("_priced"))
    if symbol_sectors is not None:
        asked = asked.join(symbol_sectors.select("symbol", "sector").distinct(), "symbol", "left")
    else:
        asked = asked.withColumn("sector", F.lit(None).cast("string"))
    rows = asof.next_bar(asked, prices, "_known", tuple(sorted({*horizons, default_horizon})) if horizons else None, "open").join(known, "symbol", "left")
    status = (
        F.when(F.col("direction") != "long", "unsupported_direction")
        .when(F.col("_priced").isNull(), "missing_price_history")
        .when(F.col("exit_date").isNull(), "insufficient_forward_history")
        .otherwise("ok")
    )
    cost = (trading_cost_bps + slippage_bps) / 10000
    usable = F.col("direction") == "long"
    rows = rows.withColumn("status", status)
    rows = rows.withColumns({c: F.when(usable, F.col(c)) for c in ("entry_date", "entry_price", "exit_date", "exit_price")})
    rows = rows.withColumns(
        {
            "gross_return": ratio("exit_price", "entry_price") - 1,
            "buy_hold_return": F.when(usable, ratio(F.coalesce("exit_price", "entry_close"), "first_close") - 1),
        }
    )
    rows = rows.withColumns(
        {
            "cost_adjusted_return": F.col("gross_return") - cost,
            "entry_timing": F.lit(ENTRY),
            "exit_timing": F.lit(EXIT),
            "trading_cost_bps": F.lit(float(trading_cost_bps)),
            "slippage_bps": F.lit(float(slippage_bps)),
            "total_cost_bps": F.lit(float(trading_cost_bps) + float(slippage_bps)),
        }
    )
    none = F.lit(None).cast("double")
    rows = _index_return(rows, benchmark, "benchmark_return") if benchmark is not None else rows.withColumn("benchmark_return", none)
    rows = _index_return(rows, sector_benchmarks, "sector_benchmark_return", "sector") if sector_benchmarks is not None else rows.withColumn("sector_benchmark_return", none)
    rows = rows.withColumns({"benchmark_relative_return": F.col("gross_return") - F.col("benchmark_return"), "sector_relative_return": F.col("gross_return") - F.col("sector_benchmark_return")})
    return rows.select(*extra, *TRADE_COLUMNS)


def daily_rate(r: str, horizon: str = "horizon") -> Column:
    """A return over ``horizon`` days as one per day; a loss of all stays a loss of all."""
    rate = F.pow(F.greatest(1 + F.col(r), F.lit(0.0)), 1 / F.greatest(F.coalesce(F.col(horizon), F.lit(1)), F.lit(1))) - 1
    return F.when(F.col(r).isNotNull(), rate)  # greatest() passes over a missing value


def exit_date_returns(trades: DataFrame, *keys: str) -> DataFrame:
    """Mean daily rates by exit date: strategy and benchmark."""
    ok = trades.filter("status = 'ok' AND exit_date IS NOT NULL").withColumns({"_s": daily_rate("cost_adjusted_return"), "_b": daily_rate("benchmark_return")})
    return ok.groupBy(*keys, "exit_date").agg(F.avg("_s").alias("strategy_return"), F.avg("_b").alias("benchmark_return"), F.count("_s").alias("trade_count"))


def drawdown_curve(returns: DataFrame, *keys: str) -> DataFrame:
    """Equity, peak and drawdown by exit date. The peak starts at the first equity. A return of -1 makes equity zero for good."""
    w = Window.partitionBy(*keys).orderBy("exit_date").rowsBetween(Window.unboundedPreceding, 0)
    lost = F.max((F.col("strategy_return") <= -1).cast("int")).over(w) == 1
    grown = F.exp(F.sum(F.when(F.col("strategy_return") > -1, F.log1p("strategy_return"))).over(w))
    rows = returns.filter("strategy_return IS NOT NULL").withColumn("equity", F.when(lost, 0.0).otherwise(grown))
    rows = rows.withColumn("peak", F.max("equity").over(w))
    return rows.withColumn("drawdown", ratio("equity", "peak") - 1)


def risk_metrics(trades: DataFrame, *keys: str) -> DataFrame:
    """Compounded returns, Sharpe over exit dates (not annualised), maximum drawdown, win rate over exit dates."""
    days = exit_date_returns(trades, *keys)
    n, sd = F.count("strategy_return"), F.stddev_samp("strategy_return")
    compounded = lambda c: F.when(F.count(c) > 0, F.product(1 + F.col(c)) - 1)
    out = days.groupBy(*keys).agg(
        compounded("strategy_return").alias("cumulative_return"),
        F.when(n >= 2, ratio(F.avg("strategy_return"), sd) * F.sqrt(n.cast("double"))).alias("sharpe_ratio"),
        ratio(F.count_if(F.col("strategy_return") > 0).cast("double"), n.cast("double")).alias("win_rate"),
        compounded("benchmark_return").alias("cumulative_benchmark_return"),
    )
    worst = drawdown_curve(days, *keys).groupBy(*keys).agg(F.min("drawdown").alias("maximum_drawdown"))
    both = out.join(worst, list(keys)) if keys else out.join(F.broadcast(worst))
    return both.withColumn("benchmark_difference", F.col("cumulative_return") - F.col("cumulative_benchmark_return"))


def summary(trades: DataFrame, *keys: str) -> DataFrame:
    ok = F.col("status") == "ok"
    when = lambda c: F.when(ok, F.col(c))
    counts = trades.groupBy(*keys).agg(
        F.lit("ok").alias("status"), F.count("*").alias("signal_count"), F.count_if(ok).alias("trade_count"), F.count_distinct(when("symbol")).alias("symbol_count"),
        F.avg(when("gross_return")).alias("average_gross_return"), F.median(when("gross_return")).alias("median_gross_return"),
        F.avg(when("cost_adjusted_return")).alias("average_cost_adjusted_return"), F.median(when("cost_adjusted_return")).alias("median_cost_adjusted_return"),
        F.avg(when("benchmark_relative_return")).alias("average_benchmark_relative_return"), F.avg(when("sector_relative_return")).alias("average_sector_relative_return"),
    ).filter("signal_count > 0")
    risk = risk_metrics(trades, *keys)
    return counts.join(risk, list(keys), "left") if keys else counts.join(F.broadcast(risk), F.lit(True), "left")
