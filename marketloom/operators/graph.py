"""Connected components of links that lie in tables, without bound on chains or groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.store import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for links (a, b): each linked node and the smallest node that it reaches.

    Alternating contraction: a large star hangs a node's larger neighbours on its smallest one, a small star its smaller
    ones. Every round is two aggregations and two joins over a written table, and the number of rounds grows with the logarithm
    of the longest chain. Rounds end when the table no longer changes, which happens with one star for each component.
    """
    e = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v"))))
        e = stored(large.join(least, "u").select(hung.alias("x")).select("x.u", "x.v").filter("u <> v").distinct(), "edges")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
