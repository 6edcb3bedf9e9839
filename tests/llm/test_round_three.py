"""Fill-in-middle, decontamination and conversation repair: against brute force, at their edges, in small pieces."""

import random

import pytest
from pyspark.sql import functions as F

from marketloom.llm import conversation_repair as repair
from marketloom.llm import decontamination, fill_in_middle, secret_scan
from marketloom.llm import queries as Q
from marketloom.llm.common import table
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def say(rows):
    return sorted(map(repr, map(tuple, rows)))


def docs_frame(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, 1, 2, "w", "h", 3, "o") for i, t in rows], "doc_id long, text string, row int, n int, w string, h string, at int, output string")


# --- fill in the middle


@pytest.mark.parametrize("stride", [1, 2, 7, 256])
def test_checkpoints_find_every_cut(stride):
    rng = random.Random(stride)
    for _ in range(100):
        text = "".join(rng.choice(["a", "bc", "Z", " ", "é", "😀", "\n", "<", "S>", "1"]) for _ in range(rng.randrange(60)))
        units = brute.re.findall("[A-Za-z]+|[^A-Za-z]", text)
        index = fill_in_middle.CheckpointIndex(text, stride)
        assert index.total == len(units) and len(index.units) == len(units) // stride + 1
        for k in range(len(units) + 1):
            start = "".join(units[:k])
            assert (index.cut(k), index.byte(len(start)), index.unit_of_byte(len(start.encode()))) == (len(start), len(start.encode()), k)


def test_a_byte_inside_a_unit_counts_whole_units_only():
    index = fill_in_middle.CheckpointIndex("ab é cd", 2)
    assert [index.unit_of_byte(k) for k in range(9)] == [0, 0, 1, 2, 2, 3, 4, 4, 5]


LONG = " ".join(f"word{k}é" for k in range(40_000))
TEXTS = [(1, None), (2, ""), (3, "x"), (4, LONG), (5, "has <P> in it"), (6, "a<S" + "b" * 20), (7, "<<<>>> P> <M S>"), (7, "<<<>>> P> <M S>"), (None, "one two three"), *[(k, "Hello wörld, 12 times!\n" * (k % 5 + 1)) for k in range(100, 180)]]


def test_forms_and_outputs(spark):
    got = fill_in_middle.restore(fill_in_middle.fill_in_middle(docs_frame(spark, TEXTS))).collect()
    assert len(got) == len(TEXTS)
    for i, t in TEXTS:
        want = brute.middle("" if i is None else i, t or "")
        own = [r for r in got if r.doc_id == i and r.text == (t or "")]
        assert own and all((r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == want for r in own)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        if r.form != "plain":
            whole = r.text.encode()
            prefix, middle = whole[: r.prefix_bytes].decode(), whole[r.prefix_bytes : r.prefix_bytes + r.middle_bytes].decode()
            assert (len(prefix), len(middle), len(r.text) - len(prefix) - len(middle)) == (r.prefix_chars, r.middle_chars, r.suffix_chars)
    assert fill_in_middle.digests(docs_frame(spark, TEXTS).limit(0)).collect() == []


def test_other_markers_and_rates(spark):
    m, docs = fill_in_middle.Markers("[PRE]", "[SUF]", "[MID]"), docs_frame(spark, TEXTS)
    for rates in (fill_in_middle.Rates(0, 100), fill_in_middle.Rates(0, 0)):
        got = fill_in_middle.restore(fill_in_middle.fill_in_middle(docs, m, rates, 3), m).collect()
        assert say([(r.doc_id, r.text) for r in got]) == say([(i, t or "") for i, t in TEXTS])
        assert {r.form for r in got if r.text} == {"spm" if rates.spm else "psm"}


def test_fill_in_middle_query(spark):
    docs = {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}
    got = Q.op11_checkpoint_fill_in_middle(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        n, form, prefix, middle, output = brute.middle(r.doc_id, docs[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, prefix, middle, brute.sha(output), brute.sha(docs[r.doc_id]))


# --- decontamination


def items_frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "item_id long, text string, window string, n int")


def contaminated(spark, docs, items, **how):
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    return say(decontamination.contamination(docs_frame(spark, docs), items_frame(spark, items), **how).select(*names).collect())


def test_windows_of_every_length(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("the of And alpha beta Über 日本 x1 y2 z3".split())
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 2, 3, 5, 9, 10, 11, 14])))) for k in range(12)] + [(90, None), (91, ""), (92, "?!."), (None, "alpha beta alpha beta gamma"), (93, "alpha beta alpha beta gamma"), (0, "zeta eta theta")]
    docs = []
    for k in range(60):
        parts = [word() for _ in range(rng.randrange(40))]
        if k % 3 == 0:
            parts[rng.randrange(len(parts) + 1) : 0] = [rng.choice(items)[1] or ""]
        docs.append((k, rng.choice([" ", ", ", "\n"]).join(parts)))
    docs += [(100, None), (101, ""), (102, "..."), (5, docs[5][1]), (5, docs[3][1]), (None, docs[6][1]), (103, ". " + docs[9][1] + " ."), (104, (items[11][1] + " ") * 300)]
    for how in ({}, {"words_": 1}):
        assert contaminated(spark, docs, items, **how) == say(brute.contaminated(docs, items))


def test_a_passage_in_most_documents_and_items_that_share_it(spark):
    passage = " ".join(f"p{k}" for k in range(14))
    items = [(k, passage) for k in range(30)] + [(k, f"intro {k} {passage} end {k}") for k in range(30, 60)]
    docs = [(k, f"{k} {passage} {k}") for k in range(300)] + [(k, f"clean {k} p1 p2 p3 p4 p5 p6 p7 p8 p9") for k in range(300, 340)] + [(7, f"7 {passage} 7")] * 40
    assert contaminated(spark, docs, items) == say(brute.contaminated(docs, items))


def test_nothing_to_find(spark):
    docs, items = [(1, "a b c"), (2, None)], [(1, "d e f g h i j k l m n")]
    assert contaminated(spark, docs, items) == say(brute.contaminated(docs, items))
    assert contaminated(spark, docs, []) == say(brute.contaminated(docs, []))
    assert contaminated(spark, [], items) == []


def test_decontamination_is_native(spark):
    plan = decontamination.contamination(table(spark, SF, "documents"), table(spark, SF, "benchmark"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Cartesian", "NestedLoop"))


def test_decontamination_query(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.01", "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, "/root/testdata/sf0.01", "benchmark").collect()]
    got = Q.op12_prefix_filter_decontamination(spark, "/root/testdata/sf0.01").collect()
    assert say(got) == say(brute.contaminated(docs, items))
    assert sum(r.contaminated for r in got) > 5


# --- conversation repair


def talk(seed, convs, most):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "no end", "", "  ", "Why?", "a\nb.", ":", "...", None]
    out = []
    for c in [*range(convs), None]:
        for t in range(rng.randrange(most)):
            out.append((c, rng.choice([t, t + 3, None if rng.random() < 0.1 else t]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), rng.choice(texts) if rng.random() < 0.5 else f"Text {rng.randrange(40)}."))
    return out


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "conv_id long, turn long, role string, text string, audit string, seg int, whole string")


NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize(("most", "seed"), [(repair.SEGMENT, 1), (3, 2), (1, 3)])
def test_repairs_whole_and_in_segments(spark, most, seed):
    rows = talk(seed, 60, 14)
    got = repair.digests(repair.damaged(conversations(spark, rows)), most)
    assert got.columns == NAMES
    assert say(got.collect()) == say((c, *v) for c, v in brute.repaired(rows).items())


def test_one_conversation_with_nearly_all_rows(spark):
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"T{rng.randrange(300)}" + rng.choice([".", ""])) for t in range(900)] + talk(4, 10, 5)
    assert say(repair.digests(repair.damaged(conversations(spark, rows)), 50).collect()) == say((c, *v) for c, v in brute.repaired(rows).items())


def test_a_conversation_that_loses_all_rows(spark):
    rows = [(c, t, "user", "Hi.") for c in range(400) for t in (0,)]
    want = brute.repaired(rows)
    assert any(v == (0, 0, 0, 0, 0, 0, "", brute.sha("")) for v in want.values())
    assert say(repair.digests(repair.damaged(conversations(spark, rows))).collect()) == say((c, *v) for c, v in want.items())
    assert repair.digests(repair.damaged(conversations(spark, []))).collect() == []


def test_repaired_rows_are_given(spark):
    rows = [(3, 0, "user", "A."), (3, 1, "user", "B."), (3, 2, "assistant", "C."), (3, 3, "system", "D")]
    plain = conversations(spark, rows).select("conv_id", "turn", "role", "text", F.lit(False).alias("dropped"))
    piece = repair.repair(plain).collect()
    assert [(r.role, r.text) for p in piece for r in p.repaired] in ([("user", "B."), ("assistant", "C.")], [("user", "A."), ("assistant", "C.")])
    assert [p.audit for p in piece] == ["DKKD"]


def test_repair_query(spark):
    rows = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert say(Q.op13_bucket_queue_repair(spark, SF).collect()) == say((c, *v) for c, v in brute.repaired(rows).items())


# --- multipart secrets

KEYS = ("aB3dE6gH9jK2mN5pQ8sT1vW4xY7zA0cF3iL6oR9u", "k3aB3dE6gH9jK2mN5pQ8sT1vW4xY7zA0cF3iL6oR9uaB3dE6gH9jK2mN5pQ8sT1vW4xY7zA0cF3iL6oR9uaB3d==")
CLASSES = {"access": 0, "weak_access": 0, "assign": 1, "weak_secret": 1, "endpoint": 2}


def credentials(text):
    """All spans as the operator writes them: candidates that no part of another class stands near are taken out, until none is left to take."""
    found = {(kind, s, e) for s, _, kind, e in brute.secrets(text)}
    for kind, pattern in (("weak_access", secret_scan.WEAK_ACCESS), ("weak_secret", secret_scan.WEAK_SECRET), ("endpoint", secret_scan.ENDPOINT)):
        found |= {(kind, m.start(), m.end()) for m in brute.re.finditer(pattern, text)}
    near = lambda a, b: a[2] <= b[1] <= a[2] + secret_scan.SCOPE or b[2] <= a[1] <= b[2] + secret_scan.SCOPE
    while True:
        gone = {a for a in found if a[0] in secret_scan.WEAK and not any(b[0] in CLASSES and CLASSES[a[0]] != CLASSES[b[0]] and near(a, b) for b in found)}
        if not gone:
            return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(found, key=lambda x: (x[1], secret_scan.KINDS.index(x[0]), x[2])))
        found -= gone


def test_links_are_a_fixed_point(spark):
    rng = random.Random(11)
    parts = [*KEYS, "AKIA" + "ABCDEFGHIJKLMNOP", "ASIA" + "B" * 16, "GOOG1E" + "C" * 30, "GOOG" + "D" * 20, "s3.eu-central-1.amazonaws.com", "https://foo.blob.core.windows.net/", "secret=abcdefgh", "token: AKIA" + "Z" * 16, "password=" + KEYS[0], "0123456789abcdef01234567", "é", "plain words"]
    gaps = [" ", "\n", "; ", " x" * 100, " y" * 149, " z" * 151, " w" * 400]
    texts = [f"AccountName=foo;AccountKey={KEYS[1]};BlobEndpoint=https://foo.blob.core.windows.net/", f"AccountKey={KEYS[1]}", "https://foo.blob.core.windows.net/", f"GOOG1E{'C' * 30} {KEYS[0]}"]
    texts += ["".join(rng.choice(parts) + rng.choice(gaps) for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    got = {r.doc_id: r for r in secret_scan.secrets(docs_frame(spark, list(enumerate(texts)))).collect()}
    for k, t in enumerate(texts):
        assert got[k].spans == credentials(t), t
    assert [got[k].n_linked for k in range(4)] == [2, 0, 0, 2]
