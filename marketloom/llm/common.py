"""What the corpus operators share: inputs, Arrow mapping, tables that cut lineage."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.dealing import bounded_batches
from marketloom.store import scratch, shared_dir, stored  # noqa: F401

#: The white space of the contracts, in Java and Python regular expressions alike.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, most_rows: int = 512) -> DataFrame:
    """``mapInArrow`` by slices of at most ``most_rows`` rows, so that a worker holds few long texts at a time."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, most_rows):
                yield work(b.slice(at, most_rows))

    return bounded_batches(df).mapInArrow(each, schema)


#: A key that more than one row in ``HOT`` has is hot; there are fewer than ``HOT`` of these, whatever the input.
HOT = 1000


def hot_join(rows: DataFrame, table_: DataFrame, key: str, total: int, hot: int = HOT) -> DataFrame:
    """Left join of rows with a table of one row per key, whose column ``n`` says how many of ``total`` rows have the key.

    Hot keys are looked up by broadcast, the others by shuffle, where each has a small part of the rows. ``n`` is left out.
    """
    often = F.col("n") * hot > total
    few, many = F.broadcast(table_.filter(often).drop("n")), table_.filter(~often).drop("n")
    rest = rows.join(few.select(key), key, "left_anti").join(many.hint("merge"), key, "left")
    return rows.join(few, key).unionByName(rest)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The batch's texts; null counts as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def held_out(doc_id: int | None) -> bool:
    """Whether crc32 of doc_id as text leaves remainder 0 at division by 5. Null is never held out."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def held_out_column(c: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(c).cast("string")) % 5 == 0, F.lit(False))
