"""Evidence bundles with hashes, the quality gate, decision records and their replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.operators.quality import outcome_columns

IDS = ("signal_id", "context_id", "record_id", "symbol")
#: The states of an analysis in order, and the tools that each permits.
STATES = ("select_universe", "load_validate", "run_analyses", "add_context", "build_evidence", "compare_variants", "backtest", "risk_gate", "explain", "human_review", "save_decision")
TOOLS = {
    "load_validate": ("market_history", "data_quality"),
    "run_analyses": ("indicators_events", "sector_ranking", "weekday_test", "point_in_time_fundamentals"),
    "add_context": ("context",),
    "build_evidence": ("evidence_bundle", "data_quality"),
    "compare_variants": ("data_quality",),
    "backtest": ("backtest",),
    "risk_gate": ("backtest", "data_quality"),
}


def bundle(rows: DataFrame, features: list[str], sources: list[str]) -> DataFrame:
    """evidence_id, observed_features and sources (maps without missing values), and the hash of both in the order of names."""
    ids = [F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in IDS if c in rows.columns]

    def present(names: list[str]) -> Column:
        names = sorted(names)
        every = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n).cast("string") for n in names]))
        return F.map_filter(every, lambda _, v: v.isNotNull())

    out = rows.select(F.coalesce(*ids).alias("evidence_id"), present(features).alias("observed_features"), present(sources).alias("sources"))
    return out.withColumn("evidence_hash", F.sha2(F.to_json(F.struct(F.coalesce("evidence_id", F.lit("")).alias("evidence_id"), "observed_features", "sources")), 256))


def commit(evidence: DataFrame) -> DataFrame:
    """One hash over all evidence, whatever its order, and the number of rows.

    Equal hashes are counted; distinct ones are digested by their first six digits, these digests by the first three, and those
    together. Each step joins some thousand digests at most, until the evidence has billions of rows.
    """
    one = evidence.groupBy("evidence_hash").agg(F.count("*").alias("n"))
    entry = F.struct(F.concat_ws(":", "evidence_hash", F.col("n").cast("string")).alias("t"))
    digest = lambda rows: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(rows)), lambda x: x["t"]), ","), 256)
    six = one.groupBy(F.substring("evidence_hash", 1, 6).alias("b")).agg(digest(entry).alias("t"), F.sum("n").alias("n"))
    three = six.groupBy(F.substring("b", 1, 3).alias("c")).agg(digest(F.struct("b", "t")).alias("t"), F.sum("n").alias("n"))
    return three.agg(digest(F.struct("c", "t")).alias("evidence_set_hash"), F.coalesce(F.sum("n"), F.lit(0)).alias("evidence_count"))


def gate_issues(evidence: DataFrame, features: list[str], least: int = 1) -> DataFrame:
    """(severity, code, subject): what the gate finds in a bundle; a bundle's rows are judged where they lie."""
    if least < 1:
        raise ValueError("least must be positive")
    own = F.array_compact(F.array(F.when(F.size("observed_features") == 0, F.lit("NO_OBSERVED_FEATURES")), F.when(F.coalesce(F.element_at("sources", "source"), F.lit("")) == "", F.lit("MISSING_SOURCE"))))
    rows = evidence.select(F.explode(own).alias("code"), F.col("evidence_id").alias("subject")).select(F.lit("warning").alias("severity"), "code", "subject")
    small = evidence.agg(F.count("*").alias("n")).filter(F.col("n") < least).select(F.lit("warning").alias("severity"), F.lit("SMALL_EVIDENCE_SET").alias("code"), F.col("n").cast("string").alias("subject"))
    late = evidence.sparkSession.createDataFrame([("blocking", "FUTURE_OUTCOME_FEATURE", n) for n in outcome_columns(features)], "severity string, code string, subject string")
    return rows.unionByName(small).unionByName(late)


def gate(evidence: DataFrame | None, features: list[str], least: int = 1, reports: DataFrame | None = None) -> DataFrame:
    """One row: counts of each kind of issue and the verdict. Only outcomes among the features, no bundle at all and blocking
    issues of other ``reports`` (severity) make an analysis unsafe; whatever else is found is a warning."""
    spark = (evidence if evidence is not None else reports).sparkSession
    if evidence is None:
        evidence = spark.createDataFrame([], "evidence_id string, observed_features map<string,string>, sources map<string,string>")
        none = True
    else:
        none = False
    bad = len(outcome_columns(features))
    source = F.coalesce(F.element_at("sources", "source"), F.lit("")) == ""
    one = evidence.agg(F.count("*").alias("evidence_count"), F.count_if(F.size("observed_features") == 0).alias("without_features"), F.count_if(source).alias("without_source"))
    other = (reports if reports is not None else spark.createDataFrame([], "severity string")).agg(F.count_if(F.col("severity") == "blocking").alias("blocking_reports"), F.count_if(F.col("severity") == "warning").alias("_warnings"))
    one = one.join(F.broadcast(other), F.lit(True))  # one row each
    blocked = F.lit(none) | F.lit(bad > 0) | (F.col("blocking_reports") > 0)
    warned = (F.col("evidence_count") < least) | (F.col("without_source") > 0) | (F.col("without_features") > 0) | (F.col("_warnings") > 0)
    return one.withColumns({"outcome_features": F.lit(bad), "warned": warned, "verdict": F.when(blocked, "ANALYSIS_UNSAFE").otherwise("ANALYSIS_SAFE")}).drop("_warnings")


def record_hash(*columns: str) -> Column:
    """Hash of a record's fields as JSON in the order of their names, missing ones as null."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def chain(log: DataFrame, run: str, order: str, *fields: str) -> DataFrame:
    """Log rows with their own hash and the hash of the row before them in the same run."""
    out = log.withColumn("record_hash", record_hash(*fields))
    return out.withColumn("previous_hash", F.lag("record_hash").over(Window.partitionBy(run).orderBy(order)))


def replay(decisions: DataFrame, *fields: str) -> DataFrame:
    """Decisions whose stored hash isn't that of their fields are tampered; empty sections are named."""
    same = F.col("record_hash") == record_hash(*fields)
    empty = F.array_compact(F.array(*[F.when(F.col(f).isNull() | (F.trim(F.col(f).cast("string")) == ""), F.lit(f)) for f in sorted(fields)]))
    return decisions.withColumns({"hash_ok": F.coalesce(same, F.lit(False)), "empty_sections": F.array_join(empty, ";")}).withColumn("replay_status", F.when(~F.col("hash_ok"), "tampered").when(F.col("empty_sections") != "", "incomplete").otherwise("ok"))


def conformance(log: DataFrame, run: str, order: str, state: str) -> DataFrame:
    """Whether each step of a run stays in its state or moves to the next one."""
    index = F.array_position(F.array(*[F.lit(s) for s in STATES]), F.col(state)).cast("int")
    out = log.withColumn("state_index", index)
    before = F.lag("state_index").over(Window.partitionBy(run).orderBy(order))
    return out.withColumns({"previous_index": before, "conforms": F.coalesce(F.col("state_index") - before, F.when(F.col("state_index") == 1, 0).otherwise(-1)).between(0, 1) & (F.col("state_index") > 0)})


def permitted(state: str, tool: str) -> bool:
    return tool in TOOLS.get(state, ())


def harness_variants(questions: DataFrame) -> DataFrame:
    """Five harness variants against fixed questions (seven ``requires_`` columns): counts and the share that passes."""
    spark = questions.sparkSession
    kinds = [("A", "raw LLM"), ("B", "LLM + tools"), ("C", "tools + enforced states"), ("D", "C + evidence/quality gate"), ("E", "D + memory/human review")]
    # each variant adds one ability to those before it
    v = spark.createDataFrame([(a, d, n >= 1, n >= 2, n >= 3, n >= 4) for n, (a, d) in enumerate(kinds)], "variant string, description string, tools boolean, states boolean, gate boolean, memory boolean")
    q = questions.drop("description") if "description" in questions.columns else questions
    both = v.join(F.broadcast(q))
    c = F.col
    rows = both.withColumns(
        {
            "unsupported": c("requires_numbers") & ~c("tools"),
            "invalid": c("requires_tools") & (~c("tools") | (c("requires_state_enforcement") & ~c("states"))),
            "evidence": ~c("requires_evidence") | c("gate"),
            "quality": ~c("requires_quality_gate") | c("gate"),
            "replayed": ~c("requires_replay") | c("memory"),
            "reviewed": ~c("requires_human_review") | c("memory"),
        }
    )
    passed = ~c("unsupported") & ~c("invalid") & c("evidence") & c("quality") & c("replayed") & c("reviewed")
    out = rows.groupBy("variant", "description").agg(
        F.count("*").alias("question_count"), F.count_if("unsupported").alias("unsupported_number_count"), F.count_if("invalid").alias("invalid_tool_call_count"),
        F.count_if("evidence").alias("evidence_complete_count"), F.count_if("replayed").alias("replayable_count"), F.count_if("quality").alias("quality_gate_count"),
        F.count_if("reviewed").alias("human_review_count"), (F.count_if(passed) / F.count("*")).alias("score"),
    )
    return out.withColumn("status", F.when(c("score") == 1, "ok").otherwise("limited"))
