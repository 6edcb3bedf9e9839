"""Decision records: canonical hashes, refusals, appended logs, replay."""

import hashlib
import json

from pyspark.sql import functions as F

from marketloom.operators import decisions

RECORD = {
    "schema_version": "1.0", "decision_id": "d-1", "created_at": "2026-01-01T00:00:00+00:00", "output_label": "INVESTIGATE", "review_status": "accept", "reviewer": "someone", "review_notes": "ş \"quoted\"\n",
    "harness_snapshot": {"output_label": "INVESTIGATE", "review_status": "accept", "states": ["a", "b"]}, "inputs": {"b": 1.0, "a": 1e-07, "c": [1, 2.50, None, True], "z": {"y": 12345678901234567890, "x": 0.1}},
    "tool_outputs": {"t": {}}, "evidence_hash": "e", "quality_gate": {"evidence_hash": "e", "gate_status": "PASS"},
}


def hashed(record):
    return hashlib.sha256(json.dumps(record, sort_keys=True, default=str, separators=(",", ":")).encode()).hexdigest()


def written(tmp_path, *records):
    path = tmp_path / "log.jsonl"
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, sort_keys=True) for r in records) + "\n", encoding="utf-8")
    return str(path)


def test_logs_of_other_writers_are_read_and_replayed(spark, tmp_path):
    good = RECORD | {"record_hash": hashed(RECORD)}
    changed = good | {"review_notes": "other"}
    gate = RECORD | {"quality_gate": {"gate_status": "PASS"}, "inputs": {}, "tool_outputs": None}
    harness = RECORD | {"harness_snapshot": {"output_label": "X"}, "quality_gate": {}}
    path = written(tmp_path, good, "", good | {"more": 1}, changed, gate | {"record_hash": hashed(gate)}, harness | {"record_hash": hashed(harness)}, "{}", "[]", {k: v for k, v in good.items() if k not in ("inputs", "reviewer")})
    right, wrong = decisions.read(spark, path)
    got = {r.row: (r.replay_status, list(r.messages)) for r in decisions.replay(right).collect()}
    assert got == {
        1: ("ok", []), 3: ("ok", []), 4: ("error", ["the record was changed after it was sealed"]),
        5: ("error", ["the gate judged other evidence", "inputs is empty", "tool_outputs is empty"]),
        6: ("error", ["the gate judged other evidence", "the harness had another label", "the harness had another review", "quality_gate is empty"]),
    }
    errors = {r.row: r.error for r in wrong.collect()}
    assert errors[8] == "not a JSON object" and errors[9] == "missing inputs, reviewer" and errors[7].startswith("missing created_at, decision_id")
    assert right.filter("row = 1").select(F.try_variant_get("inputs", "$.z.x", "double")).first()[0] == 0.1


def rows(spark, **changes):
    base = {"decision_id": "d", "created_at": "t", "output_label": "L", "review_status": "Modify", "reviewer": " r ", "review_notes": None, "evidence_hash": "e", "saved": True} | changes
    df = spark.createDataFrame([tuple(base.values())], ", ".join(f"{k} {'boolean' if k == 'saved' else 'string'}" for k in base))
    side = F.struct(F.col("output_label"), F.lower("review_status").alias("review_status"))
    return df.withColumns({"harness_snapshot": side, "inputs": F.parse_json(F.lit('{"n": 1.50}')), "tool_outputs": F.create_map(F.lit("k"), F.lit(2.0)), "quality_gate": F.struct(F.col("evidence_hash"))})


def test_sealed_records_replay_and_the_log_only_grows(spark, tmp_path):
    path = str(tmp_path / "log")
    for n in range(3):
        sealed, wrong = decisions.seal(rows(spark, decision_id=f"d{n}"))
        assert wrong.count() == 0
        before = {p: p.read_bytes() for p in (tmp_path / "log").glob("part-*")} if n else {}
        decisions.append(sealed, path)
        assert all(p.read_bytes() == b for p, b in before.items())
    right, wrong = decisions.read(spark, path)
    got = decisions.replay(right).collect()
    assert sorted(r.decision_id for r in got) == ["d0", "d1", "d2"] and wrong.count() == 0 and {r.replay_status for r in got} == {"ok"}
    record = json.loads(got[0].line)
    assert set(record) == set(decisions.FIELDS) and (record["reviewer"], record["review_status"], record["review_notes"], record["schema_version"]) == ("r", "modify", "", "1.0")
    assert record.pop("record_hash") == hashed(record) == got[0].recomputed_hash


def test_what_cannot_be_sealed(spark):
    for change, said in (({"output_label": None}, "output_label is required"), ({"review_status": "maybe"}, "review_status must be one of accept, modify, reject"), ({"review_status": None}, "review_status must be one of accept, modify, reject"), ({"reviewer": " "}, "reviewer is required"), ({"saved": False}, "the harness hasn't saved the decision"), ({"evidence_hash": ""}, "the gate has no evidence hash")):
        sealed, wrong = decisions.seal(rows(spark, **change))
        assert sealed.count() == 0 and wrong.first().errors == [said]
