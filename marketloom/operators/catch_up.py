"""Sector catch-up: a symbol's return against the median of its sector peers, and what followed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.columns import col, forward_return, past_return, yes

COLUMNS = (
    "symbol", "sector", "date", "close", "lookback_return", "peer_count", "peer_median_lookback_return", "catch_up_score", "rank_in_sector",
    "is_laggard", "horizon", "future_return", "peer_median_future_return", "future_relative_return", "status", "false_positive",
)


def middle(values: str | Column) -> Column:
    """Of a group's values what a median without any one of them needs: their number and the three in the middle."""
    c = col(values)
    there = F.sort_array(F.collect_list(c))
    first = F.greatest(F.floor((F.count(c) - 2) / 2), F.lit(0)).cast("int")
    return F.struct(F.count(c).alias("n"), first.alias("first"), F.slice(there, first + 1, F.lit(3)).alias("values"))


def without_one(mid: Column, own: Column) -> Column:
    """Median of a group, known by its ``middle``, without one row's own value; of all of it where ``own`` is missing.

    Taking a value out moves those above it down by one place. Which of the middle ones move shows by comparing them with it;
    among equal values it doesn't matter which is taken out. So a row needs no rank.
    """
    m = mid["n"] - F.when(own.isNotNull(), 1).otherwise(0)

    def at(k: Column) -> Column:
        place = (k - mid["first"]).cast("int")
        here = F.get(mid["values"], place)
        return F.when(own <= here, F.get(mid["values"], place + 1)).otherwise(here)

    return F.when(m > 0, (at(F.floor((m - 1) / 2)) + at(F.floor(m / 2))) / 2)


def peer_medians(frame: DataFrame, keys: tuple[str, ...] = ("sector", "date"), size: str | None = None, measured: str | None = None, **of: str) -> DataFrame:
    """Add for each ``name=value column`` the median over the other rows of the keys.

    ``size`` names the number of other rows, ``measured`` that of those with a value in the last of the columns.

    A group's values are gathered and sorted once; what is joined back onto its rows are the three in the middle. The work is
    k log k for k peers where a self-join would take k squared.
    """
    count = [(F.count("*") - 1).alias(size)] if size else []
    day = frame.groupBy(*keys).agg(*[middle(c).alias(f"_{n}") for n, c in of.items()], *count)
    out = frame.join(day, list(keys)).withColumns({n: without_one(F.col(f"_{n}"), F.col(c)) for n, c in of.items()})
    if measured:
        name, own = list(of.items())[-1]
        out = out.withColumn(measured, F.col(f"_{name}")["n"] - F.col(own).isNotNull().cast("int"))
    return out.drop(*[f"_{n}" for n in of])


def observations(bars: DataFrame, lookback_days: int = 20, horizons: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """One row per bar and horizon. ``bars`` has symbol, sector, date, close."""
    base = bars.select("symbol", "sector", "date", "close").withColumns({"lookback_return": past_return("close", lookback_days), **{f"_f{h}": forward_return("close", h) for h in horizons}})
    peers = Window.partitionBy("sector", "date")
    rank = F.row_number().over(peers.orderBy(F.col("lookback_return").desc_nulls_last(), "symbol"))
    base = base.withColumn("rank_in_sector", F.when(F.col("lookback_return").isNotNull(), rank))
    base = peer_medians(base, size="peer_count", peer_median_lookback_return="lookback_return", **{f"_m{h}": f"_f{h}" for h in horizons})
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"_f{h}").alias("future_return"), F.col(f"_m{h}").alias("peer_median_future_return")) for h in horizons]))
    rows = base.withColumn("_h", each).select("*", "_h.horizon", "_h.future_return", "_h.peer_median_future_return")
    rows = rows.withColumns({"catch_up_score": F.col("lookback_return") - F.col("peer_median_lookback_return"), "future_relative_return": F.col("future_return") - F.col("peer_median_future_return")})
    status = (
        F.when(F.col("peer_median_future_return").isNull() & (F.col("peer_count") >= 1), "insufficient_peer_forward_history")
        .when(F.col("future_return").isNull(), "insufficient_forward_history")
        .when(F.col("lookback_return").isNull(), "insufficient_history")
        .when(F.col("peer_count") < 1, "insufficient_peers")
        .otherwise("ok")
    )
    rows = rows.withColumns({"is_laggard": yes(F.col("catch_up_score") < 0), "status": status})
    rows = rows.withColumn("false_positive", yes((F.col("status") == "ok") & F.col("is_laggard") & (F.col("future_relative_return") <= 0)))
    return rows.select(*COLUMNS)


def status_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("horizon", "status").agg(F.count("*").alias("n"), F.sum(F.col("false_positive").cast("long")).alias("false_positives"))


def laggard_summary(rows: DataFrame) -> DataFrame:
    ok = rows.filter("status = 'ok' AND is_laggard")
    return ok.groupBy("horizon").agg(
        F.count("symbol").alias("observations"),
        F.avg("future_relative_return").alias("mean_relative_return"),
        F.median("future_relative_return").alias("median_relative_return"),
        F.sum(F.col("false_positive").cast("long")).alias("false_positives"),
    )
