"""Whole studies from settings: observations, signals, trades, splits, variants and their reports.

Results are lazy DataFrames, except that observations which several results share are stored once in the shared folder.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.operators import backtest, catch_up, events, fundamentals, indicators, reports, reversals, signals, splits, variants, weekday
from marketloom.sources.settings import Settings
from marketloom.store import stored

SCENARIO_HORIZONS = {"sector": (5, 10, 20), "weekday": (1, 2, 3, 4, 5), "technical": (1, 3, 5, 10), "fundamentals": (1, 5, 20)}


@dataclass
class Study:
    bars: DataFrame
    benchmark: DataFrame | None
    events: DataFrame
    sector: DataFrame
    weekday: DataFrame
    technical: DataFrame
    fundamentals: DataFrame | None


def allowed(settings: Settings, scenario: str) -> tuple[int, ...]:
    """The configured horizons that a scenario knows; all of its own where none is configured."""
    known = SCENARIO_HORIZONS[scenario]
    return tuple(h for h in known if h in settings.horizons) or known


def research(bars: DataFrame, benchmark: DataFrame | None, records: DataFrame | None, settings: Settings) -> Study:
    """The four scenarios over one set of bars (symbol, sector, date, open, high, low, close, volume)."""
    found = stored(events.detect(indicators.add_all(bars)), "events")
    return Study(
        bars, benchmark, found,
        stored(catch_up.observations(bars, horizons=allowed(settings, "sector")), "sector"),
        stored(weekday.observations(bars, benchmark, allowed(settings, "weekday"), settings.trading_cost_bps, settings.slippage_bps, settings.regime_lookback_days, settings.unseen_start_date), "weekday"),
        stored(reversals.observations(bars, found, benchmark, allowed(settings, "technical"), settings.regime_lookback_days), "technical"),
        None if records is None else stored(fundamentals.observations(records, bars, benchmark, allowed(settings, "fundamentals")), "fundamentals"),
    )


def preferred(settings: Settings) -> int:
    return 5 if 5 in settings.horizons else settings.horizons[0]


def assembled(study: Study, settings: Settings) -> DataFrame:
    return signals.assemble(study.sector, study.weekday, study.technical, study.fundamentals, preferred(settings))


def trades(study: Study, settings: Settings, sector_benchmarks: DataFrame | None = None) -> DataFrame:
    sectors = study.bars.select("symbol", "sector").distinct()
    return backtest.run(assembled(study, settings), study.bars, study.benchmark, sector_benchmarks, sectors, trading_cost_bps=settings.trading_cost_bps, slippage_bps=settings.slippage_bps)


def split_regime(done: DataFrame, study: Study, settings: Settings, least: int = 20) -> tuple[DataFrame, DataFrame, list[str]]:
    """Stability by source and horizon, counts by split and regime, and warnings about small samples."""
    index = study.benchmark if study.benchmark is not None else study.bars.groupBy("date").agg(F.avg("close").alias("close"))
    labelled = splits.label_trades(done, index, settings.unseen_start_date, settings.regime_lookback_days)
    stable, counts = splits.stability(labelled, ["source", "horizon"], "cost_adjusted_return"), splits.regime_counts(labelled)
    warnings = [] if settings.unseen_start_date else ["no unseen period is configured"]
    small = counts.filter(F.col("trade_count") < least).select("period_split", "market_regime", "trade_count").collect()
    return stable, counts, warnings + [f"{r.period_split}/{r.market_regime}: {r.trade_count} trades" for r in small]


def write_reports(study: Study, done: DataFrame, settings: Settings, folder: str) -> list[str]:
    """Markdown reports of all studies; returns their paths."""
    stable, counts, warnings = split_regime(done, study, settings)
    summary = backtest.summary(done)
    status = reports.run_status(done.filter("status = 'ok'").limit(1).count(), len(warnings))
    costs = {"trading_cost_bps": settings.trading_cost_bps, "slippage_bps": settings.slippage_bps}
    out = [
        reports.markdown(f"{folder}/sector_catch_up.md", "Sector catch-up", {}, {"Status": (catch_up.status_counts(study.sector), ["horizon", "status"]), "Laggards": (catch_up.laggard_summary(study.sector), ["horizon"])}),
        reports.markdown(f"{folder}/weekday_patterns.md", "Weekday patterns", costs, {"Summary": (weekday.summary(study.weekday), list(weekday.KEYS))}),
        reports.markdown(f"{folder}/technical_reversals.md", "Technical reversals", {}, {"Summary": (reversals.summary(study.technical), ["event_family", "event_type", "horizon"])}),
        reports.markdown(f"{folder}/backtest.md", "Backtest", costs | {"status": status}, {"Summary": (summary, []), "Trades by source": (done.groupBy("source", "status").count(), ["source", "status"])}),
        reports.markdown(f"{folder}/split_regime.md", "Splits and regimes", {"warnings": "; ".join(warnings)}, {"Stability": (stable, ["source", "horizon"]), "Regimes": (counts, ["period_split", "market_regime"])}),
        reports.markdown(f"{folder}/strategy_variants.md", "Strategy variants", costs, {"Variants": (variants.compare(variants.component_signals(assembled(study, settings)), study.bars, study.benchmark, settings.trading_cost_bps, settings.slippage_bps), ["variant"])}),
    ]
    if study.fundamentals is not None:
        out.append(reports.markdown(f"{folder}/quarterly_fundamentals.md", "Quarterly fundamentals", {}, {"Summary": (fundamentals.summary(study.fundamentals), ["metric_profile", "metric_name", "horizon"])}))
    return [str(p) for p in out]
