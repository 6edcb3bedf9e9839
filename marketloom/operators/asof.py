"""First bar strictly after a date, and the bar a number of rows later.

Each bar carries what stands h rows later, and the date of the bar before it. A request then matches exactly one bar:
``previous <= known < date``. Where the known date is itself a bar's date this is an equality on the previous date, so
requests and bars meet in one equi-join on (symbol, previous date); other dates are first moved back to the bar at or
before them by a union with the bars and one running maximum. Neither form compares every request with every bar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.columns import by_symbol

#: Stands for "before the first bar".
NEVER = "0001-01-01"


def entries(bars: DataFrame, entry: str = "close", close: str = "close", exits: Column | None = None) -> DataFrame:
    """symbol, previous, entry_date, entry_price, entry_close, first_close, place (the bar's number), and exits if asked for."""
    w = by_symbol()
    previous = F.coalesce(F.lag("date").over(w), F.lit(NEVER).cast("date"))
    return bars.select(
        "symbol", previous.alias("previous"), F.col("date").alias("entry_date"), F.col(entry).alias("entry_price"), F.col(close).alias("entry_close"),
        F.first(close).over(w).alias("first_close"), F.row_number().over(w).alias("place"), *([exits.alias("exits")] if exits is not None else []),
    )


def leads(horizons: tuple[int, ...], close: str = "close") -> Column:
    """A map from horizon to what stands so many bars later."""
    w = by_symbol()
    later = [F.struct(F.lead("date", h).over(w).alias("exit_date"), F.lead(close, h).over(w).alias("exit_price")) for h in horizons]
    return F.map_from_arrays(F.array(*[F.lit(h) for h in horizons]), F.array(*later))


def at_or_before(requests: DataFrame, bars: DataFrame, known: str) -> DataFrame:
    """The requests' (symbol, known) pairs with ``previous``, the latest bar date at or before ``known``."""
    asked = requests.select("symbol", F.col(known).alias("_on")).distinct()
    both = asked.withColumn("_bar", F.lit(None).cast("date")).unionByName(bars.select("symbol", F.col("date").alias("_on"), F.col("date").alias("_bar")))
    by_date = Window.partitionBy("symbol").orderBy("_on").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("previous", F.coalesce(F.max("_bar").over(by_date), F.lit(NEVER).cast("date")))
    return found.filter("_bar IS NULL").select("symbol", F.col("_on").alias(known), "previous")


def next_bar(requests: DataFrame, bars: DataFrame, known: str, horizons: tuple[int, ...] | None = None, entry: str = "close") -> DataFrame:
    """Requests (with symbol, ``known`` and horizon) with entry_date, entry_price, exit_date, exit_price, entry_close, first_close.

    ``horizons`` are all that the requests hold: then the exits come with the entry bar, and another horizon is an error.
    Without them the exit bar is joined by its number.
    """
    named = requests.join(at_or_before(requests, bars, known), ["symbol", known])
    if horizons is None:
        out = named.join(entries(bars, entry), ["symbol", "previous"], "left").withColumn("place", F.col("place") + F.col("horizon"))
        leave = bars.select("symbol", F.col("date").alias("exit_date"), F.col("close").alias("exit_price"), F.row_number().over(by_symbol()).alias("place"))
        return out.join(leave, ["symbol", "place"], "left").drop("place", "previous")
    out = named.join(entries(bars, entry, exits=leads(horizons)), ["symbol", "previous"], "left")
    known_horizon = F.col("exits").isNull() | F.map_contains_key("exits", F.col("horizon"))
    e = F.when(known_horizon, F.col("exits")[F.col("horizon")]).otherwise(F.raise_error(F.concat(F.lit("a horizon that wasn't named: "), F.col("horizon").cast("string"))))
    return out.withColumn("_e", e).withColumns({"exit_date": F.col("_e.exit_date"), "exit_price": F.col("_e.exit_price")}).drop("exits", "previous", "place", "_e")
