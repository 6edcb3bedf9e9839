"""Named tools over DataFrames. Answers are {status, data, warnings, errors}; data stays lazy."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from marketloom.operators import backtest, catch_up, events, evidence, indicators, quality, weekday
from marketloom.sources.files import known_by

NAMES = ("market_history", "indicators_events", "sector_ranking", "weekday_test", "point_in_time_fundamentals", "context", "backtest", "data_quality", "evidence_bundle")


class Tools:
    def __init__(self) -> None:
        self.handlers: dict[str, Callable[..., DataFrame]] = {
            "market_history": lambda bars: quality.market_history(bars),
            "indicators_events": lambda bars: events.detect(indicators.add_all(bars)),
            "sector_ranking": lambda bars, lookback_days=20, horizons=(5,): catch_up.observations(bars, lookback_days, horizons),
            "weekday_test": lambda bars, benchmark=None, **k: weekday.summary(weekday.observations(bars, benchmark, **k)),
            "point_in_time_fundamentals": lambda records, decision: known_by(records, decision),
            "context": lambda records, decision: known_by(records, decision),
            "backtest": lambda signals, bars, **k: backtest.summary(backtest.run(signals, bars, **k)),
            "data_quality": lambda bars, least_rows=20: quality.price_issues(bars, least_rows),
            "evidence_bundle": lambda rows, features, sources: evidence.bundle(rows, features, sources),
        }

    def list(self) -> list[str]:
        return list(self.handlers)

    def call(self, name: str, **args) -> dict:
        """A tool's answer; what goes wrong while its plan is built becomes an error answer."""
        if name not in self.handlers:
            return {"status": "error", "data": None, "warnings": [], "errors": [f"unknown tool: {name}"]}
        try:
            data = self.handlers[name](**args)
        except Exception as e:  # noqa: BLE001  any failure is an answer here
            return {"status": "error", "data": None, "warnings": [], "errors": [f"{type(e).__name__}: {e}"]}
        late = quality.outcome_columns(data.columns) if name == "evidence_bundle" else []
        return {"status": "warning" if late else "ok", "data": data, "warnings": late, "errors": []}
