"""The recursive indicators of long histories, in blocks: a two-level scan.

Rows are sorted once, by range, so a symbol with very many bars spreads over many tasks; each task cuts its rows into blocks of at
most ``BLOCK`` bars of one symbol. A block that is a whole symbol is done at once. The others are done in three steps:

1. One ordered pass over the blocks' last rows tells each block how many bars lie before it and what the last ten of them were.
2. Each block sums itself up as a map from the state before it to the state behind it. For the averages (EMA, Wilder, MACD, its
   signal, KAMA) that map is affine, and trying it on zero and on unit vectors gives its matrix. For Supertrend it is a step
   function: a band that comes in stays as it is until the first bar that resets it, and from then on it doesn't depend on what came
   in; only bars with a new extreme can be that first one, so the summary holds these.
3. One ordered pass carries the state over the summaries; each block is then worked out from the state before it.

The ordered passes stream and carry one state; bars never pass them. Bars need all prices: those that lack one are left out, as
the readers do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.operators.indicators import RECURSIVE
from marketloom.store import stored

BLOCK = 4096
#: How many bars before a block its first values look back on.
HALO = 10
#: The state of the averages: EMA 20, 12 and 26, MACD's signal, gain, loss, KAMA.
STATE = ("ema_20", "ema_12", "ema_26", "signal", "gain", "loss", "kama")
ARRAYS = "high array<double>, low array<double>, close array<double>"


def _follow(x: np.ndarray, weight: np.ndarray | float, before: float | None) -> np.ndarray:
    """y[k] = y[k-1] + weight[k] * (x[k] - y[k-1]) from ``before``, or from the first value."""
    if not len(x):
        return x
    if np.isscalar(weight):
        start = x if before is None else np.concatenate(([before], x))
        out = pd.Series(start).ewm(alpha=weight, adjust=False).mean().to_numpy()
        return out if before is None else out[1:]
    out = np.empty(len(x))
    now = x[0] if before is None else before
    for k in range(len(x)):
        now = out[k] = now + (weight[k] if before is not None or k else 0.0) * (x[k] - now)
    return out


def _sums(x: np.ndarray, n: int = HALO) -> np.ndarray:
    """Sums of n values, each added up anew: running ones would drift."""
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        out[n - 1 :] = np.lib.stride_tricks.sliding_window_view(x, n).sum(axis=1)
    return out


class Bars:
    """A block's bars with those before them, and what doesn't depend on the state."""

    def __init__(self, high, low, close, before: int = 0, halo: tuple | None = None):
        h0, l0, c0 = (np.array(x, float) for x in halo) if halo else (np.empty(0),) * 3
        self.n, self.before, self.had = len(close), before, len(c0)
        self.close = np.array(close, float)
        h, l, c = (np.concatenate((a, np.array(b, float))) for a, b in ((h0, high), (l0, low), (c0, close)))
        place = np.arange(before - self.had, before + self.n)  # of each bar in its symbol, from 0
        last = np.concatenate(([np.nan], c[:-1]))
        true_range = np.fmax(h - l, np.fmax(np.abs(h - last), np.abs(l - last)))
        atr = _sums(true_range) / 10
        own = slice(self.had, None)
        self.place, self.step, self.last = place[own], (c - last)[own], last[own]
        mid = (h + l)[own] / 2
        self.top, self.bottom = mid + 3.0 * atr[own], mid - 3.0 * atr[own]
        path = _sums(np.abs(c - last))
        moved = np.abs(c - np.concatenate((np.full(10, np.nan), c))[: len(c)])
        efficiency = np.divide(moved, path, out=np.zeros(len(c)), where=path > 0)
        self.speed = ((efficiency * (2 / 3 - 2 / 31) + 2 / 31) ** 2)[own]

    def averages(self, state: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """(the averages of each bar, the state behind the block)."""

        def ema(x, alpha, before, first, k):
            """From ``first``, the place of the series' first value; ``k`` names the state."""
            skip = max(first - self.before, 0)
            out = np.full(self.n, np.nan)
            out[skip:] = _follow(x[skip:], alpha[skip:] if not np.isscalar(alpha) else alpha, before if self.before > first else None)
            if skip < self.n:
                behind[k] = out[-1]
            return out

        behind = state.copy()
        e20, e12, e26 = (ema(self.close, 2 / (n + 1), state[k], 0, k) for k, n in enumerate((20, 12, 26)))
        line = np.where(self.place >= 25, e12 - e26, np.nan)
        signal = ema(line, 0.2, state[3], 25, 3)
        gain, loss = (ema(np.clip(s, 0, None), 1 / 14, state[k], 1, k) for k, s in ((4, self.step), (5, -self.step)))
        kama = ema(self.close, self.speed, state[6], HALO, 6)
        with np.errstate(divide="ignore", invalid="ignore"):
            rsi = np.where(loss == 0, 100.0, 100 - 100 / (1 + gain / loss))
        from_ = lambda x, place: np.where(self.place >= place, x, np.nan)
        line, signal = from_(line, 25), from_(signal, 33)
        return {"ema_20": from_(e20, 19), "kama_10": kama, "rsi_14": from_(rsi, 14), "macd": line, "macd_signal": signal, "macd_histogram": line - signal}, behind

    def matrix(self) -> list[float]:
        """The map of the state as rows of eight numbers: the factors of the state before, and what is added."""
        base = self.averages(np.zeros(len(STATE)))[1]
        columns = [self.averages(np.eye(len(STATE))[k])[1] - base for k in range(len(STATE))]
        return np.column_stack([*columns, base]).ravel().tolist()

    def _bands(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(band, close before, close) of the upper band, and of the lower one upside down: both fall until a close passes them."""
        on = ~np.isnan(self.top)
        for sign, band in ((1.0, self.top), (-1.0, self.bottom)):
            yield sign * band[on], sign * self.last[on], sign * self.close[on]

    def steps(self) -> list[list[float]]:
        """For each band the bars that may be the first to reset it: place, new low of the band, new high of the close before, the
        band behind the block if so, the last bar that passes the band since, and the closes of the bar and the one before."""
        out = []
        for band, last, close in self._bands():
            n = len(band)
            end, passed = band.copy(), np.full(n, -1)
            for j in range(n - 1, -1, -1):
                hits = (last[j + 1 :] > band[j]) | (band[j + 1 :] < band[j])
                k = j + 1 + int(hits.argmax()) if hits.any() else None
                over = np.flatnonzero(close[j + 1 : n if k is None else k + 1] > band[j])
                own = j + 1 + int(over[-1]) if len(over) else -1
                if k is None:
                    passed[j] = own
                else:
                    end[j], passed[j] = end[k], passed[k] if passed[k] >= 0 else own
            low, high = np.minimum.accumulate(band), np.maximum.accumulate(last)
            first = [j for j in range(n) if j == 0 or low[j] < low[j - 1] or high[j] > high[j - 1]]
            out.append([float(v) for j in first for v in (j, low[j], high[j], end[j], passed[j], close[j], close[j - 1] if j else -np.inf)] + [float(n), close[-1] if n else -np.inf])
        return out

    def supertrend(self, state: list[float] | None) -> np.ndarray:
        """Columns trend, direction, upper, lower from the state (upper, lower, direction) before the block."""
        out = np.full((self.n, 4), np.nan)
        upper, lower, way = state or (np.nan,) * 3
        for k in np.flatnonzero(~np.isnan(self.top)):
            top, bottom, last, close = self.top[k], self.bottom[k], self.last[k], self.close[k]
            if np.isnan(upper):
                upper, lower, way = top, bottom, 1.0
            else:
                way = 1.0 if close > upper else -1.0 if close < lower else way
                upper = top if top < upper or last > upper else upper
                lower = bottom if bottom > lower or last < lower else lower
            out[k] = (lower if way == 1.0 else upper, way, upper, lower)
        return out


def carried(steps: list[list[float]], state: list[float] | None) -> list[float] | None:
    """The Supertrend state behind a block, from its steps and the state before it."""
    ends, flags = [], []
    for said, value in zip(steps, (None, None) if state is None else (state[0], -state[1]), strict=True):
        n, last_close = int(said[-2]), said[-1]
        if not n:
            return state
        rows = np.array(said[:-2]).reshape(-1, 7)
        if value is None:  # the first bar with a band begins
            ends.append(rows[0, 3])
            flags.append(rows[0, 4])
            continue
        hit = np.flatnonzero((rows[:, 1] < value) | (rows[:, 2] > value))
        if not len(hit):
            ends.append(value)
            flags.append(n - 1 if last_close > value else -1)
        else:
            j, _, _, end, passed, close, before = rows[hit[0]]
            ends.append(end)
            flags.append(passed if passed >= 0 else j if close > value else j - 1 if before > value else -1)
    up, down = flags
    way = 1.0 if up >= max(down, 0) else -1.0 if down >= 0 else (state[2] if state is not None else 1.0)
    return [float(ends[0]), float(-ends[1]), way]


def _mapped(df: DataFrame, work: Callable[[Iterator[dict]], Iterator[dict]], schema: str, most: int = 64) -> DataFrame:
    """``mapInArrow`` of a generator over a partition's rows in their order."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for r in work(r for b in batches for at in range(0, b.num_rows, most) for r in b.slice(at, most).to_pylist()):
            held.append(r)
            if len(held) == most:
                yield pa.RecordBatch.from_pylist(held, kinds)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, kinds)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kinds = to_arrow_schema(_parse_datatype_string(schema))
    return df.mapInArrow(each, schema)


def blocks(bars: DataFrame, most: int = BLOCK) -> DataFrame:
    """(symbol, block, whole, date, high, low, close): runs of a symbol's bars in order, as arrays; ``block`` grows with the order."""
    prices = ("high", "low", "close")
    rows = bars.select("symbol", "date", *[F.col(c).cast("double").alias(c) for c in prices]).dropna(subset=["date", *prices])
    rows = rows.repartitionByRange("symbol", "date").sortWithinPartitions("symbol", "date")

    def work(found: Iterator[dict]) -> Iterator[dict]:
        task, number, open_, before = TaskContext.get().partitionId() << 33, 0, True, None

        def block(symbol, held: list[dict], whole: bool) -> dict:
            nonlocal number
            number += 1
            return {"symbol": symbol, "block": task + number, "whole": whole} | {c: [r[c] for r in held] for c in ("date", *prices)}

        for symbol, own in groupby(found, lambda r: r["symbol"]):
            if before is not None:  # another symbol follows it in this task
                yield block(*before, whole=not open_)
                open_ = False
            held: list[dict] = []
            for r in own:
                if len(held) == most:
                    yield block(symbol, held, whole=False)
                    held, open_ = [], True
                held.append(r)
            before = (symbol, held)
        if before is not None:
            yield block(*before, whole=False)

    return _mapped(rows, work, f"symbol string, block long, whole boolean, date array<date>, {ARRAYS}", 8)


def _ordered(df: DataFrame) -> DataFrame:
    return df.repartition("symbol").sortWithinPartitions("symbol", "block")


def _before(cut: DataFrame) -> DataFrame:
    """(block, before, halo_*): of each block how many bars its symbol has before it, and the last ten of these."""
    names = ("high", "low", "close")
    ends = cut.select("symbol", "block", F.size("close").alias("n"), *[F.slice(c, F.greatest(F.size(c) - HALO + 1, F.lit(1)), F.lit(HALO)).alias(c) for c in names])

    def work(found: Iterator[dict]) -> Iterator[dict]:
        for _, own in groupby(found, lambda r: r["symbol"]):
            n, tail = 0, {c: [] for c in names}
            for r in own:
                yield {"block": r["block"], "before": n} | {f"halo_{c}": tail[c] for c in names}
                n, tail = n + r["n"], {c: (tail[c] + r[c])[-HALO:] for c in names}

    return _mapped(_ordered(ends), work, "block long, before long, halo_high array<double>, halo_low array<double>, halo_close array<double>")


def _bars(r: dict) -> Bars:
    return Bars(r["high"], r["low"], r["close"], r.get("before") or 0, (r["halo_high"], r["halo_low"], r["halo_close"]) if r.get("before") else None)


def _states(summaries: DataFrame) -> DataFrame:
    """(block, state, trend): the states before each block."""

    def work(found: Iterator[dict]) -> Iterator[dict]:
        for _, own in groupby(found, lambda r: r["symbol"]):
            state, trend = np.zeros(len(STATE)), None
            for r in own:
                yield {"block": r["block"], "state": state.tolist(), "trend": trend}
                m = np.array(r["matrix"]).reshape(len(STATE), len(STATE) + 1)
                state, trend = m[:, :-1] @ state + m[:, -1], carried(r["steps"], trend)

    return _mapped(_ordered(summaries), work, "block long, state array<double>, trend array<double>")


def _worked_out(cut: DataFrame) -> DataFrame:
    """The indicators of blocks; those with ``state`` and ``trend`` begin there."""
    kinds = ", ".join(f"{c} double" for c in RECURSIVE)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                r = b.slice(k, 1).to_pylist()[0]
                bars = _bars(r)
                values, _ = bars.averages(np.array(r.get("state") or [0.0] * len(STATE)))
                trend = bars.supertrend(r.get("trend"))
                values |= dict(zip(RECURSIVE[6:], trend.T, strict=True))
                columns = [pa.array([r["symbol"]] * bars.n), pa.array(r["date"], pa.date32()), *(pa.array(values[c], pa.float64(), from_pandas=True) for c in RECURSIVE)]
                yield pa.RecordBatch.from_arrays(columns, ["symbol", "date", *RECURSIVE])

    return cut.mapInArrow(each, f"symbol string, date date, {kinds}")


def recursive(bars: DataFrame, most: int = BLOCK) -> DataFrame:
    """symbol, date and the recursive indicators, as ``indicators.recursive`` gives them, of histories of any length."""
    cut = stored(blocks(bars, most), "blocks")
    split = cut.filter("NOT whole")
    known = stored(split.join(_before(split), "block"), "blocks-before")

    def summed(found: Iterator[dict]) -> Iterator[dict]:
        for r in found:
            bars_ = _bars(r)
            yield {"symbol": r["symbol"], "block": r["block"], "matrix": bars_.matrix(), "steps": bars_.steps()}

    summaries = stored(_mapped(known, summed, "symbol string, block long, matrix array<double>, steps array<array<double>>", 8), "block-summaries")
    begun = known.join(_states(summaries), "block")
    return _worked_out(cut.filter("whole")).unionByName(_worked_out(begun))
