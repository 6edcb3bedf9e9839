"""Bounded, deterministic samples of labelled rows for the quality operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out_column


def bounded(ids: DataFrame, most: int) -> DataFrame:
    """At most ``most`` distinct ids, those with the smallest hashes: a top-k that keeps k rows per task."""
    return ids.select("doc_id").filter("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def learnable(df: DataFrame) -> DataFrame:
    """Rows outside the held-out fold."""
    return df.filter(~held_out_column())


def agreed(labels: DataFrame) -> DataFrame:
    """(doc_id, quality) of the documents whose labels all say the same, 0 or 1, outside the held-out fold."""
    one = learnable(labels).filter("quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
    return one.filter("quality = most").drop("most")


def samples(docs: DataFrame, roles: dict[str, DataFrame]) -> DataFrame:
    """Rows (doc_id, text, roles) of the documents whose ids one of the bounded id tables holds, one row for each id.

    The ids are few by construction (each table went through ``bounded``), hence the broadcast. Of rows that share a doc_id
    that with the least text is taken, so that the sample's rows are bounded too, however often an id is repeated.
    """
    parts = [ids.select("doc_id", F.lit(r).alias("role")) for r, ids in roles.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    wanted = every.groupBy("doc_id").agg(F.collect_set("role").alias("roles"))
    found = docs.select("doc_id", "text").join(F.broadcast(wanted.select("doc_id")), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    return found.join(F.broadcast(wanted), "doc_id").select("doc_id", "text", "roles")


def label_is(value: int) -> Column:
    return F.col("quality") == value
