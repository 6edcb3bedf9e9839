"""Decision records: sealed by a hash of their canonical JSON, appended to a log of lines, read back and replayed.

A record's sections (what the harness was, what went in, what the tools gave, what the gate said) are VARIANT columns, whose parts
are read by path. Its hash is that of its JSON with sorted keys and the shortest form of each number, which the standard library
writes; Spark's own writer has other number forms, so a small function per batch makes that text.
"""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from marketloom.sources import lines

#: The fields of a record.
FIELDS = (
    "schema_version", "decision_id", "created_at", "output_label", "review_status", "reviewer", "review_notes", "harness_snapshot", "inputs", "tool_outputs", "evidence_hash", "quality_gate", "record_hash",
)
SECTIONS = ("harness_snapshot", "inputs", "tool_outputs", "quality_gate")
REVIEWS = ("accept", "modify", "reject")
VERSION = "1.0"


def _canonical(line: str, hashed: str | None = None) -> str:
    """The record of a line without its hash, or with this one, as canonical JSON."""
    record = {k: v for k, v in json.loads(line).items() if k in FIELDS and k != "record_hash"}
    return json.dumps(record | ({} if hashed is None else {"record_hash": hashed}), sort_keys=True, separators=(",", ":"))


@F.pandas_udf(StringType())
def record_hash(line: pd.Series) -> pd.Series:
    """The hash that the record of a JSON line should have."""
    return line.map(lambda x: hashlib.sha256(_canonical(x).encode()).hexdigest(), na_action="ignore")


@F.pandas_udf(StringType())
def _sealed(line: pd.Series, hashed: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else _canonical(x, h) for x, h in zip(line, hashed, strict=True)])


def _filled(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != ""


def seal(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sealed records as lines: decision_id, record_hash, line; rows that can't be decisions with errors).

    ``rows`` have the fields but the version and the hash, sections as structs, maps or VARIANT, and ``saved``: whether the harness
    has saved the decision.
    """
    checks = [
        (~_filled("output_label"), "output_label is required"), (~F.coalesce(F.lower("review_status").isin(*REVIEWS), F.lit(False)), "review_status must be one of " + ", ".join(REVIEWS)), (~_filled("reviewer"), "reviewer is required"),
        (~F.coalesce(F.col("saved"), F.lit(False)), "the harness hasn't saved the decision"), (~_filled("evidence_hash"), "the gate has no evidence hash"),
    ]
    told = rows.withColumn("errors", F.array_compact(F.array(*[F.when(bad, F.lit(m)) for bad, m in checks])))
    right, wrong = told.filter("size(errors) = 0"), told.filter("size(errors) > 0")
    fixed = {"schema_version": F.lit(VERSION), "review_status": F.lower("review_status"), "reviewer": F.trim("reviewer"), "review_notes": F.coalesce("review_notes", F.lit(""))}
    plain = F.to_json(F.struct(*[fixed.get(f, F.col(f) if f in rows.columns else F.lit(None)).alias(f) for f in FIELDS if f != "record_hash"]), {"ignoreNullFields": "false"})
    sealed = right.select("decision_id", plain.alias("_line")).withColumn("record_hash", record_hash("_line"))
    return sealed.select("decision_id", "record_hash", _sealed("_line", "record_hash").alias("line")), wrong


def append(sealed: DataFrame, path: str) -> None:
    """Lines added to the log; what it holds stays as it is."""
    sealed.select(F.col("line").alias("value")).write.mode("append").text(path)


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records with file, row and line, sections as VARIANT; lines that are none with file, row and error)."""
    found = lines.numbered(spark, path).filter(F.trim(F.regexp_replace("line", r"\s+", " ")) != "")
    v = lines.parsed_object(F.col("line"))
    found = found.withColumn("_v", v)
    part = lambda f: F.try_variant_get("_v", f"$.{f}", "variant")
    absent = F.array_join(F.array_compact(F.array(*[F.when(part(f).isNull(), F.lit(f)) for f in sorted(FIELDS)])), ", ")
    error = F.when(F.col("_v").isNull(), F.lit("not a JSON object")).when(absent != "", F.concat(F.lit("missing "), absent))
    typed = {f: part(f) if f in SECTIONS else F.try_variant_get("_v", f"$.{f}", "string") for f in FIELDS}
    told = found.select("file", "row", "line", error.alias("error"), *[c.alias(f) for f, c in typed.items()])
    return told.filter("error IS NULL").drop("error"), told.filter("error IS NOT NULL").select("file", "row", "error")


#: What is in JSON where a section has nothing.
NOTHING = ("{}", "[]", "null", '""', "0", "false")


def replay(records: DataFrame) -> DataFrame:
    """Records with ``recomputed_hash``, ``messages`` and ``replay_status``: whether what each says agrees with itself."""
    inside = lambda section, name: F.try_variant_get(section, f"$.{name}", "string")
    rows = records.withColumn("recomputed_hash", record_hash("line"))
    differs = lambda a, b: ~a.eqNullSafe(F.col(b))
    messages = [
        (differs(F.col("recomputed_hash"), "record_hash"), "the record was changed after it was sealed"),
        (differs(inside("quality_gate", "evidence_hash"), "evidence_hash"), "the gate judged other evidence"),
        (differs(inside("harness_snapshot", "output_label"), "output_label"), "the harness had another label"),
        (differs(inside("harness_snapshot", "review_status"), "review_status"), "the harness had another review"),
        *[(F.to_json(s).isin(*NOTHING), f"{s} is empty") for s in ("inputs", "tool_outputs", "quality_gate")],
    ]
    found = F.array_compact(F.array(*[F.when(bad, F.lit(m)) for bad, m in messages]))
    return rows.withColumn("messages", found).withColumn("replay_status", F.when(F.size("messages") == 0, "ok").otherwise("error"))
