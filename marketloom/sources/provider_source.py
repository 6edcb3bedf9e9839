"""Providers as data sources: ``spark.read.format(...)`` over whatever gives bars, rates or statement lines by key.

Each key (a symbol, a pair) is a partition of its own, so a long list is fetched by many tasks. Filters on the key prune partitions before
anything is asked for; filters on the date narrow the span that is asked for, and Spark applies them once more. A key that fails is a
row: its key, nothing else, and ``error``. A filter on the date leaves such rows out, as it does any row without a date; the options
``start`` and ``end`` don't. Providers are asked anew whenever the frame is used: store it where both bars and errors are wanted.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

BARS = "symbol string, date date, open double, high double, low double, close double, adj_close double, volume double, error string"
RATES = "indicator string, date date, close double, error string"
STATEMENTS = "symbol string, label string, period_end date, value double, error string"


@dataclass
class Asked(InputPartition):
    """One key and the span that is asked for."""

    key: str
    start: str | None
    end: str | None

    def __post_init__(self) -> None:
        super().__init__(self.key)


def _converted(value: Any, kind: str) -> Any:
    if value is None or pd.isna(value):
        return None
    if kind == "date":
        day = pd.to_datetime(value, errors="coerce")
        return None if pd.isna(day) else day.date()
    if kind == "double":
        number = pd.to_numeric(value, errors="coerce")
        return None if pd.isna(number) else float(number)
    return str(value)


class Reader(DataSourceReader):
    def __init__(self, provider: Any, schema: StructType, keys: list[str], start: str | None, end: str | None):
        self.provider, self.fields = provider, [(f.name, f.dataType.simpleString()) for f in schema.fields]
        self.key, self.keys, self.start, self.end = schema.fields[0].name, list(dict.fromkeys(keys)), start, end
        self.dated = "date" in schema.names

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes filters on the key; those on the date narrow the request and stay Spark's."""
        for f in filters:
            name, value = getattr(f, "attribute", (None,))[0], getattr(f, "value", None)
            if name == self.key and isinstance(f, (EqualTo, In)):
                wanted = {value} if isinstance(f, EqualTo) else set(value)
                self.keys = [k for k in self.keys if k in wanted]
                continue
            if self.dated and name == "date" and isinstance(value, dt.date):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.start = max(filter(None, (self.start, value.isoformat())))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):  # a provider's end may lie outside its span
                    self.end = min(filter(None, (self.end, (value + dt.timedelta(days=1)).isoformat())))
            yield f

    def partitions(self) -> list[Asked]:
        return [Asked(k, self.start, self.end) for k in self.keys]

    def read(self, partition: Asked | None) -> Iterator[tuple]:
        if partition is None:  # Spark's one partition of a source that has none
            return
        names = [n for n, _ in self.fields[1:-1]]
        try:
            got = self.provider.download(partition.key, partition.start, partition.end) if self.dated else self.provider.download(partition.key)
            if got is None or not len(got):
                raise ValueError("nothing was returned")
            got = got.rename(columns={c: str(c).strip().lower().replace(" ", "_") for c in got.columns})
            if self.dated and "date" not in got.columns:
                got = got.rename_axis("date").reset_index()
            columns = [[_converted(v, t) for v in got[n]] if n in got.columns else [None] * len(got) for n, t in self.fields[1:-1]]
        except Exception as e:  # noqa: BLE001  a provider may raise anything; it becomes this key's row
            yield (partition.key, *[None] * len(names), f"{type(e).__name__}: {e}")
            return
        for row in zip(*columns, strict=True):
            yield (partition.key, *row, None)


def data_source(provider: Any, schema: str, source_name: str) -> type[DataSource]:
    """A data source over a provider with ``download(key, start, end)``, or ``download(key)`` where the schema has no date.

    The schema's first column is the key, its last one ``error``. Options: ``keys``, with commas between, ``start`` and ``end``.
    """

    class ProviderSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return source_name

        def schema(self) -> str:
            return schema

        def reader(self, schema: StructType) -> DataSourceReader:
            keys = [k.strip() for k in self.options.get("keys", "").split(",") if k.strip()]
            return Reader(provider, schema, keys, self.options.get("start"), self.options.get("end"))

    return ProviderSource


def register(spark: SparkSession, provider: Any, schema: str, source_name: str) -> None:
    """From now on ``spark.read.format(source_name)`` reads from the provider, and filters are handed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(data_source(provider, schema, source_name))
