"""Recursive indicators in blocks against the loops over whole histories."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from marketloom.operators import indicator_blocks as B
from marketloom.operators import indicators


def history(kind, n, rng):
    close = {
        "walk": 100 + np.cumsum(rng.normal(0, 1, n)), "rise": np.arange(n) + 50.0, "fall": 400.0 - np.arange(n), "flat": np.full(n, 70.0), "waves": 100 + 20 * np.sin(np.arange(n) / 7) + rng.normal(0, 0.5, n),
    }[kind]
    return close + rng.random(n) * 2, close - rng.random(n) * 2, close


def whole(high, low, close):
    last = np.concatenate(([np.nan], close[:-1]))
    true_range = np.fmax(high - low, np.fmax(np.abs(high - last), np.abs(low - last)))
    frame = {"symbol": "a", "date": pd.date_range("2000-01-01", periods=len(close)), "high": high, "low": low, "close": close, "atr_10": pd.Series(true_range).rolling(10).mean()}
    return indicators.kernel(pd.DataFrame(frame))


@pytest.mark.parametrize("kind", ["walk", "rise", "fall", "flat", "waves"])
def test_states_carry_over_any_cuts(kind):
    rng = np.random.default_rng(len(kind))
    for _ in range(40):
        n = int(rng.integers(1, 260))
        high, low, close = history(kind, n, rng)
        edges = [0, *sorted(set(rng.integers(1, n + 1, rng.integers(0, 12))) - {n}), n]
        state, trend, got = np.zeros(len(B.STATE)), None, []
        for a, b in zip(edges, edges[1:]):
            h = slice(max(a - B.HALO, 0), a)
            block = B.Bars(high[a:b], low[a:b], close[a:b], a, (high[h], low[h], close[h]) if a else None)
            values, _ = block.averages(state)
            got.append(pd.DataFrame(values | dict(zip(indicators.RECURSIVE[6:], block.supertrend(trend).T))))
            m = np.array(block.matrix()).reshape(len(B.STATE), -1)
            state, trend = m[:, :-1] @ state + m[:, -1], B.carried(block.steps(), trend)
        got, want = pd.concat(got, ignore_index=True), whole(high, low, close)
        for c in indicators.RECURSIVE:
            np.testing.assert_allclose(got[c], want[c], rtol=1e-9, atol=1e-9, err_msg=c)


def test_one_symbol_over_many_tasks(spark):
    rng = np.random.default_rng(2)
    rows = []
    for symbol, n in (("LONG", 900), ("A", 1), ("B", 40), ("Z", 30)):
        high, low, close = history("walk", n, rng)
        rows += [(symbol, dt.date(2000, 1, 1) + dt.timedelta(k), float(h), float(lo), float(c)) for k, (h, lo, c) in enumerate(zip(high, low, close))]
    bars = spark.createDataFrame(rows, "symbol string, date date, high double, low double, close double").repartition(5)
    cut = B.blocks(bars, 64)
    assert cut.filter("symbol = 'LONG'").count() >= 900 // 64 and cut.filter("symbol = 'LONG' AND whole").count() == 0
    of = lambda df: df.orderBy("symbol", "date").toPandas()
    want = of(indicators.recursive(bars))
    for most in (64, B.BLOCK):
        got = of(B.recursive(bars, most))
        assert got[["symbol", "date"]].equals(want[["symbol", "date"]])
        for c in indicators.RECURSIVE:
            np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-9, err_msg=c)
    lacking = bars.unionByName(spark.createDataFrame([("A", dt.date(2001, 1, 1), 1.0, None, 1.0)], bars.schema))
    assert B.recursive(lacking).count() == 971 and B.recursive(bars.limit(0)).count() == 0
