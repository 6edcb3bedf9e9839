"""Readers and writers of the engine's files.

Readers take fixed schemas; bad rows are kept apart with what is wrong with them, so that one bad row costs one row.
"""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom import schemas
from marketloom.functions import text as X
from marketloom.functions.columns import number, yes
from marketloom.sources import lines

TRUE, FALSE = ("true", "1", "yes", "y"), ("false", "0", "no", "n")


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file of a fixed layout. Columns are named by the header, in any order; a file whose header differs is an error."""
    names = [x.split()[0] for x in schema.split(", ")]
    return named_csv(spark, path, names).select(*[F.col(n).try_cast(t).alias(n) if t != "string" else F.col(n) for n, t in (x.split() for x in schema.split(", "))])


def named_csv(spark: SparkSession, path: str, required: Sequence[str], columns: Sequence[str] | None = None, with_place: bool = False) -> DataFrame:
    """Text columns by their header names, in any order: the required ones, and those of ``columns`` that are there or missing.

    Spark takes an explicit schema by position, so the header is read first, and every file's header is held against it.
    Quoted fields may hold line breaks, if ``columns`` are given. ``with_place`` adds where each row stands (``lines.PLACE``).
    """
    reader = lambda: spark.read.option("header", True).option("multiLine", columns is not None).option("escape", '"')
    names = reader().option("inferSchema", False).csv(path).columns
    missing = [c for c in required if c not in names]
    if missing:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    raw = reader().schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).option("enforceSchema", False).csv(path)
    raw = lines.placed(raw) if with_place else raw
    return raw.select(*[F.col(f"`{c}`") if c in names else F.lit(None).cast("string").alias(c) for c in columns or required], *[c for c in lines.PLACE if with_place])


def write_header(path: str, columns: Sequence[str]) -> None:
    """A file of the header alone, to be filled by hand."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(",".join(columns) + "\n", encoding="utf-8")


def optional(read, *args) -> DataFrame | None:
    """What a reader returns, or None where its path doesn't exist."""
    try:
        return read(*args)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def trimmed(df: DataFrame) -> DataFrame:
    return df.select(*[F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def universe(spark: SparkSession, path: str) -> DataFrame:
    return trimmed(csv(spark, path, schemas.UNIVERSE))


def universe_issues(members: DataFrame, size: int = 30, suffix: str = ".IS") -> DataFrame:
    """(code, subject): wrong size, repeated tickers, blanks, symbols without the suffix."""
    wrong = members.agg(F.count("*").alias("n")).filter(F.col("n") != size).select(F.lit("WRONG_SIZE").alias("code"), F.col("n").cast("string").alias("subject"))
    twice = members.groupBy("ticker").count().filter("count > 1").select(F.lit("DUPLICATE_TICKER").alias("code"), F.col("ticker").alias("subject"))
    blank = members.filter((F.col("ticker") == "") | (F.col("yahoo_symbol") == "") | (F.col("sector") == "")).select(F.lit("BLANK_FIELD").alias("code"), F.col("ticker").alias("subject"))
    other = members.filter(~F.col("yahoo_symbol").endswith(suffix)).select(F.lit("WRONG_SUFFIX").alias("code"), F.col("ticker").alias("subject"))
    return wrong.unionByName(twice).unionByName(blank).unionByName(other)


def resolve_member(members: DataFrame, query: str, suffix: str = ".IS") -> DataFrame:
    """The member whose ticker or symbol is the query in any case, with or without the suffix."""
    q = query.strip().upper()
    return members.filter(F.upper("ticker").isin(q, q.removesuffix(suffix)) | F.upper("yahoo_symbol").isin(q, q + suffix))


def prices(spark: SparkSession, path: str) -> DataFrame:
    """One scan over all cached histories; a filter on symbol prunes where the folder is partitioned by it."""
    return normalize_prices(csv(spark, path, schemas.PRICES))


def price_rows(spark: SparkSession, path: str) -> DataFrame:
    """The price files' rows as they are written, as text, with where they stand: for audits, before anything is dropped."""
    found = spark.read.option("header", True).csv(path).columns
    return named_csv(spark, path, ["symbol", *[n for n in (c.split()[0] for c in schemas.PRICES.split(", ")) if n in found and n != "symbol"]], with_place=True)


def import_prices(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(bars, rows that are none with what is wrong with each)."""
    raw = price_rows(spark, path)
    checks = [(_date("date").isNull(), "date is not a date"), *[(number(F.trim(F.col(c)).try_cast("double")).isNull(), f"{c} is not a number") for c in ("open", "high", "low", "close")]]
    valid, rejected = _checked(raw, checks)
    names = [c.split()[0] for c in schemas.PRICES.split(", ")]
    kinds = dict(c.split() for c in schemas.PRICES.split(", "))
    typed = valid.select(*[F.trim(F.col(n)).try_cast(kinds[n]).alias(n) if n in valid.columns else F.lit(None).cast(kinds[n]).alias(n) for n in names])
    return normalize_prices(typed), rejected


def normalize_prices(raw: DataFrame) -> DataFrame:
    """Adjusted close falls back to close, volume to zero; rows without a date or a price are dropped."""
    fix = {c: number(c) for c in ("open", "high", "low", "close", "adj_close") if c in raw.columns}
    out = raw.withColumns(fix)
    adjusted = F.coalesce("adj_close", "close") if "adj_close" in raw.columns else F.col("close")
    out = out.withColumns({"date": F.col("date").try_cast("date"), "adj_close": adjusted, "volume": F.coalesce(F.col("volume").try_cast("double"), F.lit(0.0)).cast("bigint")})
    return out.dropna(subset=["date", "open", "high", "low", "close"])


def with_members(bars: DataFrame, members: DataFrame) -> DataFrame:
    """Bars with their symbol's sector; a bar of a symbol outside the universe is an error when it is read."""
    dim = members.select(F.col("yahoo_symbol").alias("symbol"), F.col("sector").alias("_sector"))
    told = bars.join(dim, "symbol", "left")
    known = F.coalesce("_sector", F.raise_error(F.concat(F.lit("not in the universe: "), F.col("symbol"))).cast("string"))
    return told.withColumn("sector", known).drop("_sector")


def missing_symbols(members: DataFrame, bars: DataFrame) -> DataFrame:
    return members.select(F.col("yahoo_symbol").alias("symbol")).join(bars.select("symbol").distinct(), "symbol", "left_anti").withColumn("reason", F.lit("no price history"))


def write_prices(bars: DataFrame, path: str, kind: str = "parquet") -> None:
    """Partitioned by symbol, each in one file: rows of a symbol are dealt to one task before the write."""
    bars.repartition("symbol").sortWithinPartitions("symbol", "date").write.mode("overwrite").partitionBy("symbol").option("header", True).format(kind).save(path)


def _checked(rows: DataFrame, checks: list[tuple[Column, str]]) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): rejected rows carry ``errors``."""
    marked = rows.withColumn("errors", F.array_compact(F.array(*[F.when(F.coalesce(mask, F.lit(True)), F.lit(m)) for mask, m in checks])))
    return marked.filter(F.size("errors") == 0).drop("errors"), marked.filter(F.size("errors") > 0)


def _stamp(c: str) -> Column:
    return F.try_to_timestamp(F.nullif(F.trim(F.col(c)), F.lit("")))


def _date(c: str) -> Column:
    return F.trim(F.col(c)).try_cast("date")


def _filled(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)), F.lit("")) != ""


def context(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return normalize_context(named_csv(spark, path, schemas.REQUIRED_CONTEXT, schemas.CONTEXT))


def _text(c: str) -> Column:
    return F.nullif(F.trim(F.col(c)), F.lit(""))


def normalize_context(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Macro, news and video records. Each type has fields of its own that must be there. Rejected rows stay as they came."""
    kind, access, value = F.lower(_text("context_type")), F.lower(_text("source_access")), F.trim(F.col("value")).try_cast("double")
    macro, spoken = kind == "macro", kind.isin("news", "video")
    checks = [
        *[(~_filled(c), f"{c} is required") for c in ("context_id", "scope", "source")],
        (~kind.isin(*schemas.CONTEXT_TYPES), "context_type is unknown"),
        (~access.isin(*schemas.SOURCE_ACCESS), "source_access is unknown"),
        *[(_date(c).isNull(), f"{c} is not a date") for c in ("observed_period_start", "observed_period_end")],
        *[(_stamp(c).isNull(), f"{c} is not a time stamp") for c in ("publication_timestamp", "download_timestamp")],
        (_filled("value") & value.isNull(), "value is not a number"),
        (yes(macro) & ~yes(_text("indicator").isin(*schemas.MACRO_INDICATORS)), "indicator is unknown"),
        (yes(macro) & value.isNull(), "a macro record needs a value"),
        *[(yes(spoken) & ~_filled(c), f"a news or video record needs {c}") for c in ("title", "claim", "source_url")],
        (yes(kind == "video") & ~_filled("video_timestamp"), "a video record needs video_timestamp"),
    ]
    valid, rejected = _checked(raw, checks)
    typed = {"context_type": kind, "source_access": access, "scope": F.lower(_text("scope")), "value": number(value)}
    typed |= {c: _date(c) for c in ("observed_period_start", "observed_period_end")} | {c: _stamp(c) for c in ("publication_timestamp", "download_timestamp")}
    return valid.select(*[typed.get(c, _text(c)).alias(c) for c in schemas.CONTEXT]), rejected


def known_by(records: DataFrame, decision: str) -> DataFrame:
    """Records that were public by the decision."""
    return records.filter(F.col("publication_timestamp") <= F.lit(decision).cast("timestamp"))


def fundamentals(spark: SparkSession, path: str, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    return normalize_fundamentals(named_csv(spark, path, schemas.REQUIRED_FUNDAMENTALS, schemas.FUNDAMENTALS), members)


def normalize_fundamentals(raw: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records of universe members with typed numbers, a metric profile and the default currency. Symbol and sector come from the universe."""
    dim = members.select(F.col("ticker").alias("_ticker"), F.col("yahoo_symbol").alias("_symbol"), F.col("sector").alias("_sector"))
    columns = [F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in schemas.FUNDAMENTALS]
    rows = raw.select(*columns).join(dim, F.upper(F.trim("ticker")) == F.col("_ticker"), "left")
    kind = F.lower(_text("period_type"))
    numeric = schemas.NUMERIC_FUNDAMENTALS
    checks = [
        (F.col("_symbol").isNull(), "ticker is not in the universe"),
        (~kind.isin(*schemas.PERIOD_TYPES), "period_type is unknown"),
        (_date("period_end").isNull(), "period_end is not a date"),
        *[(_stamp(c).isNull(), f"{c} is not a time stamp") for c in ("disclosure_timestamp", "download_timestamp")],
        (~_filled("source"), "source is required"),
        *[(_filled(c) & F.trim(F.col(c)).try_cast("double").isNull(), f"{c} is not a number") for c in numeric],
    ]
    valid, rejected = _checked(rows, checks)
    typed = {
        "ticker": F.col("_ticker"), "yahoo_symbol": F.col("_symbol"), "sector": F.col("_sector"), "metric_profile": F.when(F.lower("_sector").contains("bank"), "bank").otherwise("industrial"),
        "period_end": _date("period_end"), "period_type": kind, "disclosure_timestamp": _stamp("disclosure_timestamp"), "download_timestamp": _stamp("download_timestamp"),
        "currency": F.coalesce(_text("currency"), F.lit("TRY")), **{c: number(F.trim(F.col(c)).try_cast("double")) for c in numeric},
    }
    return valid.select(*[typed.get(c, _text(c)).alias(c) for c in schemas.FUNDAMENTALS]), rejected.select(*schemas.FUNDAMENTALS, "errors")


def statements(wide: DataFrame, labels: dict[str, tuple[str, ...]], ticker: str = "ticker", label: str = "label") -> DataFrame:
    """Statement frames (a row per label, a column per period) as one row per ticker and period.

    ``labels`` names each metric's labels in order of preference; a period stays if it is a date and any metric has a value.
    """
    periods = [c for c in wide.columns if c not in (ticker, label)]
    long = wide.unpivot([ticker, label], periods, "period_end", "value").withColumn("_l", F.regexp_replace(F.lower(F.col(label)), "[^a-z0-9]+", ""))
    plain = lambda s: "".join(ch for ch in s.lower() if ch.isalnum())
    one = lambda names: F.coalesce(*[F.max(F.when(F.col("_l") == plain(n), F.col("value").try_cast("double"))) for n in names])
    out = long.groupBy(ticker, F.col("period_end").try_cast("date").alias("period_end")).agg(*[one(names).alias(m) for m, names in labels.items()])
    return out.filter(F.coalesce(*labels).isNotNull() & F.col("period_end").isNotNull())


def _next_morning(day: Column) -> Column:
    """09:00 of the next day, UTC+3: when what a day's market shows counts as public."""
    return F.to_timestamp(F.concat(F.date_format(F.date_add(day, 1), "yyyy-MM-dd"), F.lit("T09:00:00+03:00")))


def fx_context(rates: DataFrame, downloaded: str, unit: str = "TRY", source: str = "exchange_rates") -> DataFrame:
    """Exchange rates (indicator, date, close) as macro records; a rate that wasn't public yet at the download is left out."""
    day, at = F.col("date").try_cast("date"), F.lit(downloaded).cast("timestamp")
    rows = rates.select("indicator", day.alias("_day"), number("close").alias("value")).filter("value IS NOT NULL AND _day IS NOT NULL")
    known = {
        "context_id": F.concat_ws("-", F.lit("macro"), "indicator", F.col("_day").cast("string")), "context_type": F.lit("macro"), "scope": F.lit("macro"), "indicator": F.col("indicator"), "value": F.col("value"),
        "unit": F.lit(unit), "observed_period_start": F.col("_day"), "observed_period_end": F.col("_day"), "publication_timestamp": _next_morning(F.col("_day")), "download_timestamp": at,
        "source": F.lit(source), "source_access": F.lit("public"),
    }
    out = rows.select(*[known.get(c, F.lit(None).cast("string")).alias(c) for c in schemas.CONTEXT])
    return out.filter("publication_timestamp <= download_timestamp")


#: Macro records that are kept by hand: id, scope, indicator, value, unit, period, publication, source.
CURATED = (
    ("macro-tcmb-policy-rate-2026-09-10", "macro", "tcmb_policy_rate", 37.0, "%", "2026-09-10", "2026-09-10", "2026-09-10T14:00:00+03:00", "tcmb_press_release"),
    ("macro-tuik-inflation-2026-08", "macro", "tuik_inflation", 31.51, "% yoy", "2026-08-01", "2026-08-31", "2026-09-03T10:00:00+03:00", "tuik_cpi_release"),
    ("macro-fed-policy-rate-2026-09-16", "global", "fed_policy_rate", 3.875, "% target midpoint", "2026-09-16", "2026-09-16", "2026-09-16T14:00:00-04:00", "federal_reserve_fomc_statement"),
)


def curated_macro(spark: SparkSession, downloaded: str) -> DataFrame:
    """The records that are kept by hand, in the layout of context files."""
    names = ("context_id", "scope", "indicator", "value", "unit", "observed_period_start", "observed_period_end", "publication_timestamp", "source")
    rows = spark.createDataFrame(CURATED, ", ".join(f"{n} {'double' if n == 'value' else 'string'}" for n in names))
    fixed = {"context_type": F.lit("macro"), "source_access": F.lit("public"), "download_timestamp": F.lit(downloaded).cast("timestamp")}
    typed = {c: F.to_date(c) for c in ("observed_period_start", "observed_period_end")} | {"publication_timestamp": F.to_timestamp("publication_timestamp")}
    return rows.select(*[(fixed | typed).get(c, F.col(c) if c in names else F.lit(None).cast("string")).alias(c) for c in schemas.CONTEXT])


def aliases(spark: SparkSession, path: str) -> DataFrame:
    rows = trimmed(csv(spark, path, schemas.ALIASES)).withColumn("entity_type", F.lower("entity_type"))
    known = F.col("entity_type").isin("ticker", "sector", "macro")
    checked = rows.withColumn("entity_type", F.when(known, F.col("entity_type")).otherwise(F.raise_error(F.concat(F.lit("unknown entity_type: "), F.col("entity_type")))))
    return checked.withColumn("normalized_alias", X.match_text("alias")).filter("normalized_alias <> ''")


def questions(spark: SparkSession, path: str) -> DataFrame:
    """Harness questions; a flag that is no boolean is an error."""
    rows = trimmed(csv(spark, path, schemas.QUESTIONS))

    def flag(c: str) -> Column:
        v = F.lower(F.trim(F.col(c)))
        return F.when(v.isin(*TRUE), True).when(v.isin(*FALSE), False).otherwise(F.raise_error(F.concat(F.lit(f"{c} is no boolean: "), F.coalesce(v, F.lit("")))).cast("boolean"))

    return rows.withColumns({c: flag(c) for c in rows.columns if c.startswith("requires_")})


#: What a news item may lack.
OPTIONAL_NEWS = ("summary", "published_timestamp")


def jsonl(spark: SparkSession, path: str, schema: str, optional_fields: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """One object a line: (right lines, wrong ones), each with its file and row. Every field but ``optional_fields`` must be there."""
    names = [f.split(" ", 1)[0] for f in schema.split(", ")]
    return lines.objects(lines.numbered(spark, path), schema, [n for n in names if n not in optional_fields])


def news(spark: SparkSession, path: str) -> DataFrame:
    """News items; a line that isn't one is an error that names its file and row."""
    return lines.strict(jsonl(spark, path, schemas.NEWS, OPTIONAL_NEWS))


def matched_news(spark: SparkSession, path: str) -> DataFrame:
    return lines.strict(jsonl(spark, path, schemas.MATCHED_NEWS, OPTIONAL_NEWS))


def news_context(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """Context rows from a path or as they are."""
    if isinstance(source, DataFrame):
        return source
    return csv(spark, source, schemas.NEWS_CONTEXT)


def feeds(spark: SparkSession, path: str, sources: DataFrame) -> DataFrame:
    """Landed feed documents (one file per source, named by source_id) with the sources' fields."""
    files = spark.read.format("binaryFile").load(path)
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1)
    rows = files.select(name.alias("source_id"), F.col("content").alias("body"), F.col("modificationTime").alias("fetched_timestamp"))
    return rows.join(sources, "source_id")


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Fields in the order of their names."""
    df.select(*sorted(df.columns)).write.mode(mode).option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Arrays joined by ``;``. A frame without rows gives the header alone."""
    flat = [F.array_join(F.col(c), ";").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode(mode).option("header", True).csv(path)
