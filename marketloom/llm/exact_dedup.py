"""Exact duplicates by a log-structured merge index (operator 6), in DataFrame functions only.

* **Memtable and flush.** Each task sorts its rows' 64-bit digests in memory and writes them as one sorted run of its own to the
  shared folder. Nothing is shuffled for that, and ``spark.sql.files.maxPartitionBytes`` bounds a run.
* **Compaction.** Groups of ``FAN`` runs merge into one run of the next level, and so on until one is left: of a digest the
  smallest identifier stays, with the number of rows. The last level holds the digests that several rows share.
* **Filter.** The last level has a filter of bounded size (``key_filter``). Rows that it doesn't know are unique: neither their
  digests nor their texts move any more.
* **Hits.** Rows that the filter knows are looked up in the last level. Their texts are compared byte by byte: rows group by
  (digest, text), which collapses copies in each task before anything moves. Digests with more than one text are collisions,
  and their rows go through the index once more, by their SHA-256.

The plan is the same at every size. Hot digests are looked up without a shuffle, so no task gets a hot group.

Texts are equal when identical after each run of ``[\\x20\\x09-\\x0D]`` becomes one space. Defined results: null counts as
empty; the row with the smallest doc_id stays, a null doc_id only when the group has no other; of rows that repeat both
text and doc_id exactly one stays; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import key_filter
from .common import SPACE, hot_join, stored

#: How many runs merge into one of the next level.
FAN = 64
#: What a run is sorted by, and what the index is keyed by.
DIGEST_BITS = 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def digest_of(norm: Column, bits: int = DIGEST_BITS) -> Column:
    d = F.xxhash64(norm)
    return d if bits == 64 else d.bitwiseAND(F.lit((1 << bits) - 1))


def flush(docs: DataFrame, bits: int = DIGEST_BITS) -> DataFrame:
    """Runs (run, digest, doc_id, tie, sha), one of each task, sorted by digest; ``tie`` tells rows of equal doc_id apart."""
    norm = docs.select("doc_id", normalised(F.col("text")).alias("norm"))
    rows = norm.select("doc_id", digest_of(F.col("norm"), bits).alias("digest"), F.unhex(F.sha2("norm", 256)).alias("sha"))
    rows = rows.select(F.spark_partition_id().alias("run"), "digest", "doc_id", F.monotonically_increasing_id().alias("tie"), "sha")
    return stored(rows.sortWithinPartitions("digest", "doc_id"), "runs")


def compact(runs: DataFrame, fan: int = FAN) -> DataFrame:
    """The last level (digest, keep_id, keep_tie, group_size): the digests that several rows share."""
    level = runs.select("run", "digest", F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "tie").alias("least"), F.lit(1).cast("long").alias("n"))
    last = runs.agg(F.max("run")).first()[0] or 0
    while True:
        last //= fan
        # on a level of one run its number is a constant, so digests alone are the key
        number = F.expr(f"run div {fan}").cast("int") if last else F.lit(0)
        level = level.groupBy(number.alias("run"), "digest").agg(F.min("least").alias("least"), F.sum("n").alias("n"))
        if not last:
            shared = level.filter("n > 1").select("digest", F.col("least.doc_id").alias("keep_id"), F.col("least.tie").alias("keep_tie"), F.col("n").alias("group_size"))
            return stored(shared.sortWithinPartitions("digest"), "level")
        level = stored(level.sortWithinPartitions("run", "digest"), "level")


def collisions(docs: DataFrame, known: DataFrame, bits: int, words: int) -> DataFrame:
    """Digests whose rows hold different bytes."""
    norm = docs.select(normalised(F.col("text")).alias("norm")).select("norm", digest_of(F.col("norm"), bits).alias("digest"))
    hits, _ = key_filter.split(norm, F.col("digest"), known, words)
    apart = hits.groupBy("digest", "norm").agg(F.lit(1).alias("one")).groupBy("digest").agg(F.count("*").alias("texts")).filter("texts > 1")
    return stored(apart.select("digest"), "collisions")


def look_up(runs: DataFrame, level: DataFrame, known: DataFrame, words: int) -> DataFrame:
    """Per row: doc_id, sha, keep_id, group_size, kept."""
    maybe, alone = key_filter.split(runs.select("doc_id", "tie", "digest", "sha"), F.col("digest"), known, words)
    of_level = level.select("digest", "keep_id", "keep_tie", F.col("group_size").alias("n"), "group_size")
    found = hot_join(maybe, of_level, "digest", runs.count())
    # the filter, being of bounded size, takes some unique rows for hits
    hit = F.col("keep_tie").isNotNull()
    found = found.select("doc_id", "sha", F.when(hit, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.coalesce(F.col("tie") == F.col("keep_tie"), F.lit(True)).alias("kept"))
    return found.unionByName(alone.select("doc_id", "sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")))


def exact_duplicates(docs: DataFrame, bits: int = DIGEST_BITS, fan: int = FAN, words: int = key_filter.WORDS) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256."""
    runs = flush(docs, bits)
    level = compact(runs, fan)
    known = key_filter.build(level, F.col("digest"), words)
    apart = collisions(docs, known, bits, words)
    if apart.isEmpty():
        out = look_up(runs, level, known, words)
    else:
        again = stored(runs.join(apart, "digest", "left_semi").withColumn("digest", F.col("sha")), "runs")
        second = compact(again, fan)
        out = look_up(stored(runs.join(apart, "digest", "left_anti"), "runs"), level, known, words)
        out = out.unionByName(look_up(again, second, key_filter.build(second, F.col("digest"), words), words))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, bits: int = DIGEST_BITS, fan: int = FAN, words: int = key_filter.WORDS) -> DataFrame:
    """The input's rows that stay; all columns stay as they are. Only rows whose doc_id the filter of dropped ones knows move."""
    said = exact_duplicates(docs, bits, fan, words).filter("NOT kept").select(F.col("doc_id").alias("_gone"), F.unhex("text_sha256").alias("_sha"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("_twice"))
    gone = stored(said.distinct(), "dropped")
    key = F.coalesce(F.col("_id").cast("string"), F.lit(""))
    known = key_filter.build(gone.withColumnRenamed("_gone", "_id"), key, words)
    rows = docs.select(F.struct("*").alias("_row"), docs["doc_id"].alias("_id"), docs["text"].alias("_text"))
    maybe, alone = key_filter.split(rows, key, known, words)
    maybe = maybe.withColumn("_key", F.unhex(F.sha2(normalised(F.col("_text")), 256))).drop("_text")
    same = F.col("_id").eqNullSafe(F.col("_gone")) & (F.col("_key") == F.col("_sha"))
    kept = maybe.join(gone.filter("NOT _twice").hint("merge"), same, "left_anti")
    twice = gone.filter("_twice")
    if not twice.isEmpty():
        # of rows that repeat the staying doc_id and its text, one
        repeated = kept.join(twice, same, "left_semi").groupBy("_id", "_key").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
        kept = kept.join(twice, same, "left_anti").select("_row").unionByName(repeated.select("_row"))
    return alone.select("_row.*").unionByName(kept.select("_row.*"))
