"""Files as they are: where each line stands, numbered across splits, and JSON lines checked field by field."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPLIT = ("_file", "_split")
#: Where a row stands: file, the split's first byte, and a number that grows inside the split.
PLACE = (*SPLIT, "_place")


def placed(rows: DataFrame) -> DataFrame:
    """Rows just read from files, with their place."""
    return rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_place"))


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, line): lines numbered from 1 in each file, blank ones too.

    Lines are counted once per split, where they lie; the counts' prefix sums say with which number each split begins, and a
    line's number follows from its place. Only the counts are shuffled, and no file passes one task.
    """
    lines = placed(spark.read.text(path))
    sizes = lines.groupBy(*SPLIT).agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*SPLIT, (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    return lines.join(starts, list(SPLIT)).select(F.col("_file").alias("file"), (F.col("_place") + F.col("_shift")).alias("row"), F.col("value").alias("line"))


def _typed(value: Column, name: str, kind: str) -> tuple[Column, Column]:
    """(a field of a VARIANT object, whether it is there but of another type)."""
    path = f"$['{name}']"
    text = F.nullif(F.regexp_replace(F.try_variant_get(value, path, "string"), r"^\s+|\s+$", ""), F.lit(""))
    if kind == "string":
        return text, F.lit(False)
    if kind == "timestamp":
        got = F.try_to_timestamp(text)
        return got, text.isNotNull() & got.isNull()
    got, raw = F.try_variant_get(value, path, kind), F.try_variant_get(value, path, "variant")
    return got, F.coalesce(~F.is_variant_null(raw), F.lit(False)) & got.isNull()


def parsed_object(line: Column) -> Column:
    """A line's JSON object as VARIANT; null if it isn't one object and nothing else.

    The parser passes over what follows a value, so the line is read as a list's first element that an element of ours follows.
    """
    read = F.try_parse_json(F.concat(F.lit("["), line, F.lit(",0]")))
    first = F.try_variant_get(read, "$[0]", "variant")
    alone = F.coalesce(F.try_variant_get(read, "$[1]", "int") == 0, F.lit(False)) & F.try_variant_get(read, "$[2]", "variant").isNull()
    return F.when(alone & F.coalesce(F.schema_of_variant(first).startswith("OBJECT"), F.lit(False)), first)


def objects(lines: DataFrame, schema: str, required: Iterable[str]) -> tuple[DataFrame, DataFrame]:
    """(file, row and the schema's fields of the lines that are right; file, row, error and line of the others).

    A line must be an object with all ``required`` fields, not blank, and each field of its type. Blank lines are passed over;
    they count as rows. Where text is asked for, any other value is text as it is written.
    """
    fields = [f.strip().split(" ", 1) for f in schema.split(", ")]
    required = set(required)
    rows = lines.filter(F.trim(F.regexp_replace("line", r"\s+", " ")) != "").withColumn("_v", parsed_object(F.col("line")))
    object_ = F.col("_v").isNotNull()
    typed = {n: _typed(F.col("_v"), n, t) for n, t in fields}
    wrong = F.coalesce(
        F.when(~object_, F.lit("not a JSON object")),
        *[F.when(bad, F.lit(f"{n} is no {dict(fields)[n]}")) for n, (_, bad) in typed.items() if dict(fields)[n] != "string"],
        *[F.when(got.isNull(), F.lit(f"missing {n}")) for n, (got, _) in typed.items() if n in required],
    )
    told = rows.select("file", "row", "line", wrong.alias("error"), *[got.alias(n) for n, (got, _) in typed.items()])
    return told.filter("error IS NULL").select("file", "row", *[n for n, _ in fields]), told.filter("error IS NOT NULL").select("file", "row", "error", "line")


def strict(found: tuple[DataFrame, DataFrame]) -> DataFrame:
    """The right lines, where there are no others; else an error that names the file and row of one that isn't."""
    right, wrong = found
    fail = F.raise_error(F.concat_ws(" ", F.col("file"), F.lit("row"), F.col("row").cast("string"), F.col("error")))
    names = [c for c in right.columns if c not in ("file", "row")]
    nothing = wrong.filter(fail.cast("boolean")).select(*[F.lit(None).cast(right.schema[n].dataType).alias(n) for n in names])
    return right.select(*names).unionByName(nothing)
