"""Filters of bounded size over keys of any number, in DataFrame functions only.

A filter is a table of at most ``WORDS`` words of 64 bits; a key sets two bits of one word (a blocked Bloom filter). A task
holds a whole filter, whatever the number of keys, so it may be broadcast. A key whose bits aren't set is certainly absent;
the others are looked up by an exact join, so that a filter decides how many rows move and never what comes out. Beyond some
30 million keys a filter of this size lets most rows pass, and the plan that follows it moves them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

WORDS = 1 << 20


def _word(h: Column, words: int) -> Column:
    return F.pmod(h, F.lit(words)).cast("long")


def _mask(h: Column) -> Column:
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, at).bitwiseAND(F.lit(63)).cast("int"))
    return bit(40).bitwiseOR(bit(50))


def build(keys: DataFrame, key: Column, words: int = WORDS) -> DataFrame:
    """The filter of the keys' hashes: one row (_word, _bits) per word that has any."""
    h = F.xxhash64(key)
    bits = keys.select(_word(h, words).alias("_word"), _mask(h).alias("_mask")).groupBy("_word").agg(F.bit_or("_mask").alias("_bits"))
    return stored(bits, "filter")


def marked(rows: DataFrame, key: Column, filter_: DataFrame, words: int = WORDS) -> DataFrame:
    """The rows with ``_known``: whether their key may be in the filter. Nothing is shuffled."""
    names = rows.columns
    h = F.xxhash64(key)
    told = rows.select("*", _word(h, words).alias("_word"), _mask(h).alias("_mask")).join(F.broadcast(filter_), "_word", "left")
    return told.select(*names, F.coalesce(F.col("_bits").bitwiseAND(F.col("_mask")) == F.col("_mask"), F.lit(False)).alias("_known"))


def split(rows: DataFrame, key: Column, filter_: DataFrame, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be in the filter, rows whose key is certainly not). Nothing is shuffled."""
    told = marked(rows, key, filter_, words)
    return told.filter("_known").drop("_known"), told.filter("NOT _known").drop("_known")
