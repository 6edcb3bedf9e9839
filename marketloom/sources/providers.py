"""Ingestion from providers: what a provider gives for each symbol, pair, statement or feed, without one failure stopping the rest.

A provider is any picklable object with the method of its protocol. Requests are rows of a table; executors serve them, one
request at a time, so that a long list is fetched in parallel and nothing passes the driver. A request that raises becomes a row
of the second result. Providers must give the same answer when a task is run again, or land their bytes first.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom import schemas
from marketloom.sources.files import normalize_prices
from marketloom.store import stored


class PriceProvider(Protocol):
    def download(self, symbol: str, start: str, end: str | None) -> pd.DataFrame:
        """Bars with date, open, high, low, close, and adj_close and volume where known."""


class RateProvider(Protocol):
    def download(self, pair: str, start: str, end: str | None) -> pd.DataFrame:
        """Rates with date and close."""


class StatementProvider(Protocol):
    def download(self, symbol: str) -> pd.DataFrame:
        """Statement lines with label, period_end and value."""


class FeedClient(Protocol):
    def fetch(self, url: str) -> bytes:
        """The bytes of a feed."""


BARS = "date string, open double, high double, low double, close double, adj_close double, volume double"


def requests(spark: SparkSession, names: list[str], column: str = "symbol") -> DataFrame:
    """A table of requests; repeated names are asked once."""
    return spark.createDataFrame([(n,) for n in dict.fromkeys(names)], f"{column} string")


def fetched(asked: DataFrame, key: str, fetch, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows of all answers with their key, requests that failed with their error). ``fetch(key)`` returns a pandas frame."""
    names = [c.split()[0] for c in schema.split(", ")]

    kinds = dict(c.split() for c in schema.split(", "))

    def typed(values, kind: str) -> list:
        there = [None if pd.isna(v) else v for v in values]
        return [None if v is None else str(v) for v in there] if kind == "string" else [None if v is None else float(v) for v in there]

    def answer(k: str) -> dict[str, list]:
        got = fetch(k)
        if got is None or not len(got):
            raise ValueError("nothing was returned")
        got = got.rename(columns={c: str(c).strip().lower().replace(" ", "_") for c in got.columns})
        if "date" in kinds and "date" not in got.columns:
            got = got.rename_axis("date").reset_index()
        return {n: typed(got[n], t) if n in got.columns else [None] * len(got) for n, t in kinds.items()}

    def serve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                try:
                    rows = answer(k)
                    rows = {key: [k] * len(rows[names[0]]), **rows, "error": [None] * len(rows[names[0]])}
                except Exception as e:  # noqa: BLE001  a provider may raise anything; it becomes this request's row
                    rows = {key: [k], **{n: [None] for n in names}, "error": [f"{type(e).__name__}: {e}"]}
                arrow = [pa.string(), *[pa.string() if t == "string" else pa.float64() for t in kinds.values()], pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), arrow, strict=True)], list(rows))

    rows = stored(asked.repartition(key).mapInArrow(serve, f"{key} string, {schema}, error string"), "fetched")
    return rows.filter("error IS NULL").drop("error"), rows.filter("error IS NOT NULL").select(key, "error")


def prices(spark: SparkSession, symbols: list[str], provider: PriceProvider, start: str, end: str | None, source: str, downloaded: str) -> tuple[DataFrame, DataFrame]:
    """(bars in the layout of the price files, symbols that gave none with the reason)."""
    got, failed = fetched(requests(spark, symbols), "symbol", lambda s: provider.download(s, start, end), BARS)
    bars = normalize_prices(got).withColumns({"source": F.lit(source), "download_timestamp": F.lit(downloaded).cast("timestamp")})
    lost = got.select("symbol").distinct().join(bars.select("symbol").distinct(), "symbol", "left_anti").select("symbol", F.lit("no usable rows").alias("error"))
    return bars.select(*[c.split()[0] for c in schemas.PRICES.split(", ")]), failed.unionByName(lost).withColumnRenamed("error", "reason")


def rates(spark: SparkSession, pairs: dict[str, str], provider: RateProvider, start: str, end: str | None) -> tuple[DataFrame, DataFrame]:
    """(indicator, date, close) of the pairs, given by indicator; and the indicators that failed."""
    return fetched(requests(spark, list(pairs), "indicator"), "indicator", lambda i: provider.download(pairs[i], start, end), "date string, close double")


def statements(spark: SparkSession, symbols: list[str], provider: StatementProvider) -> tuple[DataFrame, DataFrame]:
    """(symbol, label, period_end, value) of all statement lines, and the symbols that failed."""
    return fetched(requests(spark, symbols), "symbol", provider.download, "label string, period_end string, value double")


def feeds(spark: SparkSession, sources: DataFrame, client: FeedClient, at: str) -> tuple[DataFrame, DataFrame]:
    """(feed documents, as bytes, with their source's fields, sources that failed). ``sources`` has source_id, url, language, category."""
    urls = {r.source_id: r.url for r in sources.select("source_id", "url").distinct().collect()}  # a settings file
    got, failed = fetched(requests(spark, list(urls), "source_id"), "source_id", lambda s: pd.DataFrame({"body": [base64.b64encode(client.fetch(urls[s])).decode()]}), "body string")
    got = got.withColumn("body", F.unbase64("body"))  # bytes as they came: the document says how it is encoded
    rows = got.join(sources, "source_id").withColumnRenamed("url", "source_url").withColumn("fetched_timestamp", F.lit(at))
    return rows.select("source_id", "source_url", "language", "category", "fetched_timestamp", "body"), failed
