"""Technical indicators over daily bars.

Everything that a row window can express is a Spark window over (symbol, date); all windows share one shuffle and one sort.
The recursive ones (EMA family, Wilder averages, KAMA, Supertrend) need their previous output; one grouped Arrow kernel
computes them together, one symbol at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.functions.columns import by_symbol, full, ratio

SIMPLE = (
    "sma_20", "sma_50", "atr_14", "bb_lower", "bb_middle", "bb_upper", "bb_width",
    "ichimoku_conversion", "ichimoku_base", "ichimoku_span_a", "ichimoku_span_b", "ichimoku_lagging",
    "support", "resistance", "support_distance", "resistance_distance", "volume_sma", "relative_volume",
)
RECURSIVE = ("ema_20", "kama_10", "rsi_14", "macd", "macd_signal", "macd_histogram", "supertrend", "supertrend_direction", "supertrend_upper", "supertrend_lower")


def sma(bars: DataFrame, *windows: int, column: str = "close") -> DataFrame:
    return bars.withColumns({f"sma_{n}": full(F.avg, column, n) for n in windows})


def bollinger(bars: DataFrame, window: int = 20, deviations: float = 2.0) -> DataFrame:
    mid, sd = full(F.avg, "close", window), full(F.stddev_samp, "close", window)
    out = bars.withColumns({"bb_middle": mid, "_sd": sd})
    out = out.withColumns({"bb_upper": F.col("bb_middle") + F.col("_sd") * deviations, "bb_lower": F.col("bb_middle") - F.col("_sd") * deviations})
    return out.withColumn("bb_width", ratio(F.col("bb_upper") - F.col("bb_lower"), "bb_middle")).drop("_sd")


def true_range(bars: DataFrame) -> DataFrame:
    """The largest of high - low and the distances of both to the previous close; the first row has the first only."""
    before = F.lag("close").over(by_symbol())
    return bars.withColumn("true_range", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def atr(bars: DataFrame, *windows: int) -> DataFrame:
    return true_range(bars).withColumns({f"atr_{n}": full(F.avg, "true_range", n) for n in windows}).drop("true_range")


def _midpoint(n: int):
    return (full(F.max, "high", n) + full(F.min, "low", n)) / 2


def ichimoku(bars: DataFrame, conversion: int = 9, base: int = 26, span_b: int = 52, displacement: int = 26) -> DataFrame:
    """``ichimoku_lagging`` shows a later close; it must never be a feature."""
    w = by_symbol()
    out = bars.withColumns({"ichimoku_conversion": _midpoint(conversion), "ichimoku_base": _midpoint(base), "_b": _midpoint(span_b)})
    return out.withColumns(
        {
            "ichimoku_span_a": F.lag((F.col("ichimoku_conversion") + F.col("ichimoku_base")) / 2, displacement).over(w),
            "ichimoku_span_b": F.lag("_b", displacement).over(w),
            "ichimoku_lagging": F.lead("close", displacement).over(w),
        }
    ).drop("_b")


def support_resistance(bars: DataFrame, window: int = 20) -> DataFrame:
    out = bars.withColumns({"support": full(F.min, "low", window), "resistance": full(F.max, "high", window)})
    return out.withColumns({"support_distance": ratio(F.col("close") - F.col("support"), "close"), "resistance_distance": ratio(F.col("resistance") - F.col("close"), "close")})


def volume(bars: DataFrame, window: int = 20) -> DataFrame:
    out = bars.withColumn("volume_sma", full(F.avg, F.col("volume").cast("double"), window))
    return out.withColumn("relative_volume", ratio(F.col("volume").cast("double"), "volume_sma"))


def _smoothed(x: np.ndarray, alpha: float, least: int) -> np.ndarray:
    return pd.Series(x).ewm(alpha=alpha, adjust=False, min_periods=least).mean().to_numpy()


def ema(x: np.ndarray, span: int) -> np.ndarray:
    return _smoothed(x, 2 / (span + 1), span)


def rsi(close: np.ndarray, window: int = 14) -> np.ndarray:
    step = np.diff(close, prepend=np.nan)
    gain, loss = _smoothed(np.clip(step, 0, None), 1 / window, window), _smoothed(-np.clip(step, None, 0), 1 / window, window)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = 100 - 100 / (1 + gain / loss)
    return np.where(loss == 0, 100.0, out)


def kama(close: np.ndarray, window: int = 10, fast: int = 2, slow: int = 30) -> np.ndarray:
    n = len(close)
    out = np.full(n, np.nan)
    if n <= window:
        return out
    step = np.abs(np.diff(close))
    path = np.array([step[k - window : k].sum() for k in range(window, n)])
    moved = np.abs(close[window:] - close[:-window])
    efficiency = np.divide(moved, path, out=np.zeros_like(moved), where=path > 0)
    f, s = 2 / (fast + 1), 2 / (slow + 1)
    speed = (efficiency * (f - s) + s) ** 2
    now = out[window] = close[window]
    for k in range(window + 1, n):
        now = out[k] = now + speed[k - window] * (close[k] - now)
    return out


def supertrend(high: np.ndarray, low: np.ndarray, close: np.ndarray, atr_values: np.ndarray, multiplier: float = 3.0) -> np.ndarray:
    """Columns trend, direction, upper, lower. Bands ratchet; the direction turns when a close leaves the previous bands."""
    n = len(close)
    out = np.full((n, 4), np.nan)
    mid = (high + low) / 2
    top, bottom = mid + multiplier * atr_values, mid - multiplier * atr_values
    upper = lower = way = np.nan
    for k in range(n):
        if np.isnan(atr_values[k]):
            continue
        if np.isnan(upper):
            upper, lower, way = top[k], bottom[k], 1.0
        else:
            before, old_upper, old_lower = close[k - 1], upper, lower
            if top[k] < old_upper or before > old_upper:
                upper = top[k]
            if bottom[k] > old_lower or before < old_lower:
                lower = bottom[k]
            if close[k] > old_upper:
                way = 1.0
            elif close[k] < old_lower:
                way = -1.0
        out[k] = (lower if way == 1.0 else upper, way, upper, lower)
    return out


def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("date", kind="stable")
    close, high, low = (pdf[c].to_numpy(float) for c in ("close", "high", "low"))
    line = ema(close, 12) - ema(close, 26)
    signal = _smoothed(line, 2 / 10, 9)
    trend = supertrend(high, low, close, pdf["atr_10"].to_numpy(float))
    return pd.DataFrame(
        {
            "symbol": pdf["symbol"], "date": pdf["date"], "ema_20": ema(close, 20), "kama_10": kama(close), "rsi_14": rsi(close),
            "macd": line, "macd_signal": signal, "macd_histogram": line - signal,
            "supertrend": trend[:, 0], "supertrend_direction": trend[:, 1], "supertrend_upper": trend[:, 2], "supertrend_lower": trend[:, 3],
        }
    )


def recursive(bars: DataFrame) -> DataFrame:
    """symbol, date and the recursive indicators; NaN comes back as null."""
    rows = atr(bars.select("symbol", "date", "high", "low", "close"), 10)
    kinds = ", ".join(f"{c} double" for c in RECURSIVE)
    return rows.groupBy("symbol").applyInPandas(kernel, f"symbol string, date date, {kinds}")


def simple(bars: DataFrame) -> DataFrame:
    """The bars with every indicator that a window expresses."""
    return volume(support_resistance(ichimoku(bollinger(atr(sma(bars, 20, 50), 14)))))


def add_all(bars: DataFrame) -> DataFrame:
    """The bars with all indicator columns. Both sides are already dealt by symbol; the join adds a sort, not rows."""
    return simple(bars).join(recursive(bars), ["symbol", "date"])
