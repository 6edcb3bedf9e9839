"""How rows are dealt to tasks and to their Python workers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The most bytes of rows, more than one, that go to a Python worker at once.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """The frame, in a session whose Arrow batches are small enough for long texts."""
    conf = df.sparkSession.conf
    size = conf.get(BATCH_KEY)
    if not size.removesuffix("b").isdecimal() or int(size.removesuffix("b")) > BATCH_BYTES:
        conf.set(BATCH_KEY, str(BATCH_BYTES))
    return df


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows of a scan, dealt anew by the keys if a task would read over half more than a core's even share.

    A scan can't split a row group, so a file of one large group is read by one task, however many cores there are. Counting the
    rows of each task reads the files' footers alone.
    """
    each = rows.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"))
    total, most = each.agg(F.sum("n"), F.max("n")).first()
    if total and 2 * most * rows.sparkSession.sparkContext.defaultParallelism > 3 * total:
        return rows.repartition(*keys)
    return rows
