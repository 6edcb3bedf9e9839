"""Indicator events: twenty masks over the current and previous row, turned into rows by one explode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.columns import after_close, by_symbol, yes

NEAR = 0.005
FAMILIES = ("bollinger", "rsi", "supertrend", "kama", "ichimoku", "support_resistance")
NEEDS = {
    "bollinger": ("close", "bb_lower", "bb_middle", "bb_upper"),
    "rsi": ("rsi_14",),
    "supertrend": ("supertrend_direction",),
    "kama": ("close", "kama_10"),
    "ichimoku": ("close", "ichimoku_conversion", "ichimoku_base", "ichimoku_span_a", "ichimoku_span_b"),
    "support_resistance": ("close", "support", "resistance"),
}
#: Recursive values are compared at nine digits, so that the last bit of a recursion can't make an event.
DIGITS = 9


def before(c: str, n: int = 1) -> Column:
    return F.lag(c, n).over(by_symbol())


def _prepared(frame: DataFrame, families: tuple[str, ...], strict: bool) -> DataFrame:
    rounded = {c: F.round(c, DIGITS) for c in ("rsi_14", "kama_10") if c in frame.columns}
    out = frame.withColumns(rounded) if rounded else frame
    need = {c for f in families for c in NEEDS[f]}
    more = {f"_{c}_1": before(c) for c in need}
    if "rsi" in families:
        more |= {"_rsi_next": F.lead("rsi_14").over(by_symbol()), "_rsi_2": before("rsi_14", 2)}
    if "kama" in families:
        more |= {"_kama_2": before("kama_10", 2)}
    out = out.withColumns(more)
    if "ichimoku" in families:
        out = out.withColumns({"_top": F.greatest("ichimoku_span_a", "ichimoku_span_b"), "_bottom": F.least("ichimoku_span_a", "ichimoku_span_b")})
        out = out.withColumns({"_top_1": before("_top"), "_bottom_1": before("_bottom")})
    return out


def _masks(family: str, strict: bool) -> list[tuple[str, Column, Column, Column]]:
    """(type, mask, value, reference) of each event of a family."""
    c, p = F.col, lambda x: F.col(f"_{x}_1")
    if family == "bollinger":
        close, was = c("close"), p("close")
        return [
            ("lower_band_touch", (close <= c("bb_lower")) & (was > p("bb_lower")), close, c("bb_lower")),
            ("middle_cross_up", (close >= c("bb_middle")) & (was < p("bb_middle")), close, c("bb_middle")),
            ("middle_cross_down", (close <= c("bb_middle")) & (was > p("bb_middle")), close, c("bb_middle")),
            ("upper_band_touch", (close >= c("bb_upper")) & (was < p("bb_upper")), close, c("bb_upper")),
        ]
    if family == "rsi":
        r, was, nxt = c("rsi_14"), p("rsi_14"), c("_rsi_next")
        if strict:  # a turn is stamped on the day that shows it
            peak = (was >= 70) & (was > c("_rsi_2")) & (was > r)
            trough = (was <= 30) & (was < c("_rsi_2")) & (was < r)
            turn = was
        else:
            peak, trough, turn = (r >= 70) & (r > was) & (r > nxt), (r <= 30) & (r < was) & (r < nxt), r
        return [
            ("overbought_peak", peak, turn, F.lit(70.0)),
            ("oversold_trough", trough, turn, F.lit(30.0)),
            ("oversold_exit", (r > 30) & (was <= 30), r, F.lit(30.0)),
            ("overbought_exit", (r < 70) & (was >= 70), r, F.lit(70.0)),
        ]
    if family == "supertrend":
        d, was = c("supertrend_direction"), p("supertrend_direction")
        return [("flip_up", (d == 1) & (was == -1), d, was), ("flip_down", (d == -1) & (was == 1), d, was)]
    if family == "kama":
        k, was, close = c("kama_10"), p("kama_10"), c("close")
        slope, slope_was = F.round(k - was, DIGITS), F.round(was - c("_kama_2"), DIGITS)
        return [
            ("price_cross_up", (close >= k) & (p("close") < was), close, k),
            ("price_cross_down", (close <= k) & (p("close") > was), close, k),
            ("slope_turn_up", (slope > 0) & (slope_was <= 0), k, was),
            ("slope_turn_down", (slope < 0) & (slope_was >= 0), k, was),
        ]
    if family == "ichimoku":
        a, b, close = c("ichimoku_conversion"), c("ichimoku_base"), c("close")
        return [
            ("conversion_cross_above_base", (a >= b) & (p("ichimoku_conversion") < p("ichimoku_base")), a, b),
            ("conversion_cross_below_base", (a <= b) & (p("ichimoku_conversion") > p("ichimoku_base")), a, b),
            ("price_breaks_above_cloud", (close > c("_top")) & (p("close") <= c("_top_1")), close, c("_top")),
            ("price_breaks_below_cloud", (close < c("_bottom")) & (p("close") >= c("_bottom_1")), close, c("_bottom")),
        ]
    close, s, r = c("close"), c("support"), c("resistance")
    return [
        ("support_touch", F.try_divide(F.abs(close - s), close) <= NEAR, close, s),
        ("resistance_touch", F.try_divide(F.abs(r - close), close) <= NEAR, close, r),
    ]


def detect(frame: DataFrame, families: tuple[str, ...] = FAMILIES, strict_point_in_time: bool = False) -> DataFrame:
    """symbol, event_family, event_type, event_date, known_at, value, reference, details.

    A peak or trough of the RSI needs the next row. By default it carries its own day, as the compared results have it;
    ``strict_point_in_time`` stamps it on the day that shows it.
    """
    prepared = _prepared(frame, families, strict_point_in_time)
    each = [F.when(yes(mask), F.struct(F.lit(f).alias("event_family"), F.lit(kind).alias("event_type"), value.cast("double").alias("value"), ref.cast("double").alias("reference"))) for f in families for kind, mask, value, ref in _masks(f, strict_point_in_time)]
    rows = prepared.select("symbol", "date", F.explode(F.array_compact(F.array(*each))).alias("e"))
    return rows.select(
        "symbol", "e.event_family", "e.event_type", F.col("date").alias("event_date"), after_close("date").alias("known_at"),
        F.col("e.value").alias("value"), F.col("e.reference").alias("reference"), F.lit("known_after_daily_close").alias("details"),
    )


def detect_available(frame: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Events of the families whose columns are there, and what kept the others from running."""
    missing = {f: [c for c in need if c not in frame.columns] for f, need in NEEDS.items()}
    errors = {f: f"missing columns: {', '.join(m)}" for f, m in missing.items() if m}
    return detect(frame, tuple(f for f in FAMILIES if f not in errors)), errors


def combined(events: DataFrame) -> DataFrame:
    """Days on which a symbol has two events or more, as one event each."""
    day = events.groupBy("symbol", "event_date").agg(F.count("*").alias("n"), F.max("known_at").alias("known_at"), F.array_sort(F.collect_set("event_type")).alias("types"))
    return day.filter("n >= 2").select("symbol", F.lit("combined").alias("event_family"), F.array_join("types", "+").alias("event_type"), "event_date", "known_at")
