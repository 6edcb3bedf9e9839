"""Data quality: price histories, point-in-time records, leakage names, audits and coverage."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRICE_COLUMNS = ("open", "high", "low", "close", "adj_close")
OUTCOME = ("future", "forward", "next_", "lead_", "outcome")
#: Looks back by name only: it holds a later close.
LATE = ("ichimoku_lagging",)


def _issues(rows: DataFrame, keys: tuple[str, ...], checks: list[tuple]) -> DataFrame:
    """(keys, severity, code, message) of the checks (mask, severity, code, message) that hold."""
    each = F.array(*[F.when(mask, F.struct(F.lit(s).alias("severity"), F.lit(c).alias("code"), (m if not isinstance(m, str) else F.lit(m)).alias("message"))) for mask, s, c, m in checks])
    return rows.select(*keys, F.explode(F.array_compact(each)).alias("i")).select(*keys, "i.*")


def backward_dates(rows: DataFrame, order: str, within: Sequence[str] = ()) -> DataFrame:
    """(symbol, back): how often a symbol's dates go back in file order.

    A symbol's dates in a split are summed up as (first, last, times they go back); summaries of splits that follow one another
    add up, with one more where a split begins before the last one ended. No task gets more of a symbol than a split holds.
    """
    own = ["symbol", *within]
    w = Window.partitionBy(*own).orderBy(order)
    dated = rows.select(*own, order, F.col("date").try_cast("date").alias("date")).filter("date IS NOT NULL")
    each = dated.withColumn("_back", F.lag("date").over(w) > F.col("date")).groupBy(*own).agg(F.min_by("date", order).alias("first"), F.max_by("date", order).alias("last"), F.count_if("_back").alias("back"))
    if not within:
        return each.select("symbol", "back")
    joint = F.lag("last").over(Window.partitionBy("symbol").orderBy(*within)) > F.col("first")
    return each.withColumn("_joint", joint).groupBy("symbol").agg((F.sum("back") + F.count_if("_joint")).alias("back"))


def price_issues(bars: DataFrame, least_rows: int = 20, order: str | None = None, required: Iterable[str] = (), expected: DataFrame | None = None, within: Sequence[str] = ()) -> DataFrame:
    """One aggregation per symbol. ``order`` names the column of file order, for the check that dates come sorted, and ``within``
    the columns, in order, that say in which file and split that order holds (``lines.PLACE``).

    Where columns of ``required`` are missing that is each symbol's only issue; symbols of ``expected`` without rows are empty.
    """
    if expected is not None:
        none = expected.select("symbol").distinct().join(bars.select("symbol").distinct(), "symbol", "left_anti")
        empty = none.select("symbol", F.lit("blocking").alias("severity"), F.lit("EMPTY_PRICE_HISTORY").alias("code"), F.lit("no bars at all").alias("message"))
        return price_issues(bars, least_rows, order, required, None, within).unionByName(empty)
    if absent := missing_columns(bars, required):
        return bars.select("symbol").distinct().select("symbol", F.lit("blocking").alias("severity"), F.lit("MISSING_PRICE_COLUMNS").alias("code"), F.lit("columns not there: " + ", ".join(absent)).alias("message"))
    rows = bars
    prices = [c for c in PRICE_COLUMNS if c in bars.columns]
    n = lambda mask: F.count_if(F.coalesce(mask, F.lit(False)))
    number = lambda c: F.col(c).try_cast("double")
    date = F.col("date").try_cast("date")
    down = F.col("download_timestamp").try_cast("timestamp") if "download_timestamp" in bars.columns else None
    aggs = [F.count("*").alias("rows"), F.count(date).alias("dates"), F.count_distinct(F.coalesce(F.col("date").cast("string"), F.lit(""))).alias("distinct")]
    for c in prices:
        aggs += [n(number(c).isNull() | F.isnan(number(c))).alias(f"bad_{c}"), n(number(c) <= 0).alias(f"low_{c}")]
    aggs += [n(number("high") < number("low")).alias("crossed"), n(number("high").isNull() | number("low").isNull()).alias("open_range"), n(number("volume").isNull() | (number("volume") < 0)).alias("volume")]
    if down is not None:
        aggs += [n(down.isNull()).alias("bad_down"), n(date > F.to_date(down)).alias("early")]
    one = rows.groupBy("symbol").agg(*aggs)
    one = one.join(backward_dates(rows, order, within), "symbol", "left") if order else one.withColumn("back", F.lit(0))
    c = F.col
    checks = [
        (c("rows") < least_rows, "warning", "SMALL_SAMPLE", F.concat(c("rows").cast("string"), F.lit(f" bars where {least_rows} are wanted"))),
        (c("dates") < c("rows"), "blocking", "INVALID_PRICE_DATE", "a date can't be read"),
        ((c("dates") == c("rows")) & (c("back") > 0), "blocking", "NON_MONOTONIC_PRICE_DATES", "dates go back in file order"),
        (c("distinct") < c("rows"), "blocking", "DUPLICATE_PRICE_DATES", "a date occurs twice"),
    ]
    for p in prices:
        checks += [(c(f"bad_{p}") > 0, "blocking", "INVALID_PRICE_VALUE", f"a value of {p} is no number"), ((c(f"bad_{p}") == 0) & (c(f"low_{p}") > 0), "blocking", "NON_POSITIVE_PRICE", f"a value of {p} isn't above zero")]
    checks += [((c("open_range") == 0) & (c("crossed") > 0), "blocking", "HIGH_BELOW_LOW", "a high lies under its low"), (c("volume") > 0, "blocking", "INVALID_VOLUME", "a volume is negative or no number")]
    if down is not None:
        checks += [(c("bad_down") > 0, "blocking", "INVALID_DOWNLOAD_TIMESTAMP", "a download time can't be read"), ((c("bad_down") == 0) & (c("early") > 0), "blocking", "PRICE_DATE_AFTER_DOWNLOAD", "a bar is later than its download")]
    return _issues(one, ("symbol",), checks)


def missing_columns(frame: DataFrame, required: Iterable[str]) -> list[str]:
    return [c for c in required if c not in frame.columns]


def dataset_issues(bars: DataFrame, expected: DataFrame, missing: DataFrame | None = None, least_rows: int = 20, order: str | None = None, within: Sequence[str] = ()) -> DataFrame:
    """Issues of all histories, of expected symbols that were not fetched, and of symbols reported missing (symbol, reason)."""
    absent = expected.select("symbol").distinct().join(bars.select("symbol").distinct(), "symbol", "left_anti")
    out = price_issues(bars, least_rows, order, within=within).unionByName(absent.select("symbol", F.lit("warning").alias("severity"), F.lit("EXPECTED_SYMBOL_NOT_FETCHED").alias("code"), F.lit("not among the fetched symbols").alias("message")))
    if missing is not None:
        out = out.unionByName(missing.select("symbol", F.lit("warning").alias("severity"), F.lit("MISSING_SYMBOL").alias("code"), F.col("reason").alias("message")))
    return out


def point_in_time_issues(records: DataFrame, decision: str) -> DataFrame:
    """Records (record_id, source, observation_period_end, publication_timestamp, download_timestamp) against a decision time."""
    said = F.col("publication_timestamp").cast("timestamp")
    at = F.lit(decision).cast("timestamp")
    text = lambda tail: F.concat(F.col("record_id").cast("string"), F.lit(tail))
    checks = [
        (said.isNull(), "warning", "MISSING_PUBLICATION_TIMESTAMP", F.concat(F.col("record_id").cast("string"), F.lit(" of "), F.col("source"), F.lit(": publication time unknown"))),
        (said > at, "blocking", "FUTURE_INFORMATION_LEAKAGE", text(": public only after the decision")),
        (F.col("observation_period_end").cast("date") > F.to_date(said), "blocking", "OBSERVATION_AFTER_PUBLICATION", text(": period ends after publication")),
        (F.col("download_timestamp").cast("timestamp") < said, "blocking", "DOWNLOAD_BEFORE_PUBLICATION", text(": downloaded before publication")),
    ]
    return _issues(records, ("record_id",), checks)


def outcome_columns(names: Iterable[str]) -> list[str]:
    """Column names that must not be features."""
    return [n for n in names if n.lower() in LATE or any(t in n.lower() for t in OUTCOME)]


def market_audit(bars: DataFrame, expected: DataFrame, least_rows: int = 20, order: str | None = None, within: Sequence[str] = ()) -> DataFrame:
    """Per expected symbol: rows, first and last date, issue counts, status; a symbol without rows is an error."""
    date = F.col("date").try_cast("date")
    rows = bars.groupBy("symbol").agg(F.count("*").alias("row_count"), F.min(date).alias("first_date"), F.max(date).alias("last_date"))
    found = price_issues(bars, least_rows, order, within=within).groupBy("symbol").agg(F.count_if(F.col("severity") == "blocking").alias("blocking_count"), F.count_if(F.col("severity") == "warning").alias("warning_count"))
    out = expected.select("symbol").distinct().join(rows, "symbol", "left").join(found, "symbol", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = out.withColumns({c: zero(c) for c in ("row_count", "blocking_count", "warning_count")})
    status = F.when((F.col("row_count") == 0) | (F.col("blocking_count") > 0), "error").when(F.col("warning_count") > 0, "warning").otherwise("pass")
    return out.withColumn("status", status)


def macro_coverage(records: DataFrame, indicator: str = "indicator_name", published: str = "publication_date") -> DataFrame:
    """Per indicator: records, periods, latest publication, range of values; sources and access, where the records name them."""
    told = [F.array_join(F.array_sort(F.collect_set(c)), ";").alias(f"{c}_list") for c in ("source", "source_access") if c in records.columns]
    return records.groupBy(indicator).agg(
        F.count("*").alias("record_count"), F.min("observed_period_end").alias("first_period"), F.max("observed_period_end").alias("last_period"),
        F.max(published).alias("latest_publication"), F.min("value").alias("least_value"), F.max("value").alias("greatest_value"), *told,
    )


def _safe(records: DataFrame, decision: str | None) -> Column:
    """Whether no record (publication_timestamp, download_timestamp, observation_period_end) blocks; by default as of the last download."""
    said, down, end = (F.col(c).cast("timestamp") for c in ("publication_timestamp", "download_timestamp", "observation_period_end"))
    blocked = F.coalesce(F.to_date(end) > F.to_date(said), F.lit(False)) | F.coalesce(down < said, F.lit(False))
    late = F.max(said) > (F.max(down) if decision is None else F.lit(decision).cast("timestamp"))
    return ~(F.coalesce(F.max(blocked), F.lit(False)) | F.coalesce(late, F.lit(False)))


def fundamentals_point_in_time(records: DataFrame) -> DataFrame:
    """Fundamentals records in the layout of the point-in-time checks."""
    return records.select(F.concat_ws("-", "ticker", "period_end").alias("record_id"), "source", F.col("period_end").alias("observation_period_end"), F.col("disclosure_timestamp").alias("publication_timestamp"), "download_timestamp")


def context_point_in_time(records: DataFrame) -> DataFrame:
    """Context records in the layout of the point-in-time checks."""
    return records.select(F.col("context_id").alias("record_id"), "source", F.col("observed_period_end").alias("observation_period_end"), "publication_timestamp", "download_timestamp")


def _readiness(cases: list[tuple[Column, str]]) -> Column:
    out = F.when(F.lit(False), "")
    for mask, status in cases:
        out = out.when(mask, status)
    return out.otherwise("ready")


def fundamentals_readiness(valid: DataFrame, rejected: DataFrame, decision: str | None = None) -> DataFrame:
    """One row: valid_rows, error_count, universe_coverage, safe, status. ``valid`` and ``rejected`` are what the reader returns."""
    points = fundamentals_point_in_time(valid).withColumn("ticker", F.substring_index("record_id", "-", 1))
    one = points.agg(F.count("*").alias("valid_rows"), F.count_distinct("ticker").alias("universe_coverage"), _safe(points, decision).alias("safe"))
    bad = rejected.agg(F.count("*").alias("error_count"))
    status = _readiness([(F.col("valid_rows") == 0, "blocked_no_valid_fundamentals"), (~F.col("safe"), "blocked_point_in_time_unsafe"), (F.col("error_count") > 0, "ready_with_import_warnings")])
    return one.join(F.broadcast(bad), F.lit(True)).withColumn("status", status)


def macro_readiness(valid: DataFrame, rejected: DataFrame, indicators: Iterable[str], decision: str | None = None) -> DataFrame:
    """One row: valid_rows, error_count, missing_indicators, safe, status, of the macro records that the reader returns."""
    points = valid.filter("context_type = 'macro'").withColumn("observation_period_end", F.col("observed_period_end"))
    missing = F.array_except(F.array(*[F.lit(i) for i in indicators]), F.collect_set("indicator"))
    one = points.agg(F.count("*").alias("valid_rows"), F.array_join(missing, ";").alias("missing_indicators"), _safe(points, decision).alias("safe"))
    bad = rejected.agg(F.count("*").alias("error_count"))
    status = _readiness([(F.col("valid_rows") == 0, "blocked_no_valid_macro_context"), (~F.col("safe"), "blocked_point_in_time_unsafe"), (F.col("missing_indicators") != "", "ready_with_source_gaps"), (F.col("error_count") > 0, "ready_with_import_warnings")])
    return one.join(F.broadcast(bad), F.lit(True)).withColumn("status", status)


def missing_input(kind: str) -> str:
    """The status of an import whose file isn't there."""
    return f"blocked_missing_{kind}_csv"


def market_history(bars: DataFrame) -> DataFrame:
    """Per symbol: rows, first and last date, last close."""
    return bars.groupBy("symbol").agg(F.count("*").alias("row_count"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.max_by("close", "date").alias("last_close"))
