"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, for each operator."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marketloom.llm import automaton_codec, exact_dedup, packing, pii, pu_quality, quality_rules, secret_scan, simhash, token_counts, warc
from tests.llm import brute

CLASH = ", digest string, keep_id string, fp string, kept string, score double, n string, _row string, component_id int, kind string, key string, roles string, quality string"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long" + CLASH
LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(60_000)) + " " + "a" * 3000 + " password=abcdef123456"
random.seed(5)
WORDS = [" ".join(random.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(random.randrange(40)) for _ in range(70)) for _ in range(6)]
TEXTS = [(1, None), (2, ""), (3, "   "), (4, LONG), (5, WORDS[0]), (6, WORDS[0]), (6, WORDS[0]), (7, WORDS[0].replace(" ", "\n")), (8, WORDS[1]), (9, WORDS[2] + " é😀 <|endoftext|> 日本"), (None, WORDS[3]), (None, WORDS[0]), (10, "x"), (10, WORDS[4])]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None if t is None else len(t), *["?"] * 3, "z", 0.5, "q", "r", 1, "k", "y", "s", "u") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, TEXTS).persist()


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(k, k % 2, 0) for k in range(1, 60)] + [(None, 1, 0), (3, None, None), (999, 1, 0), (5, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def say(rows):
    return sorted(map(repr, rows))


def test_row_operators_keep_every_row(docs, labels, spark):
    for op in (secret_scan.secrets, token_counts.count_tokens, automaton_codec.digests, pii.personal_data, simhash.near_duplicates, exact_dedup.exact_duplicates, lambda d: pu_quality.classify(d, labels), lambda d: quality_rules.quality_rules(d, labels)):
        out = op(docs)
        got = out.collect()
        assert say([r.doc_id for r in got]) == say([i for i, _ in TEXTS])
        empty = op(docs.limit(0)).collect()
        assert empty == []


def test_secrets(docs):
    got = say([(r.doc_id, r.base_sha256) for r in secret_scan.secrets(docs).collect()])
    assert got == say([(i, brute.sha(brute.joined(brute.secrets(t or "")))) for i, t in TEXTS])


def test_secret_matches_fail_without_retry(spark):
    texts = ["token: secret=abcdef", "secret=abc password = 'abcdefg'", "AKIA" + "B" * 15, "AKIAAKIA" + "B" * 16, "x" * 40 + "0123456789abcdef01234567" * 3, 'API_KEY":"abcdef', "k apikey=ab.cd/ef+g=", "passwordtoken=abcdef é AKIA" + "Z9" * 10, "secret=ab\ntoken=abcdef", "password=abcdef" * 300]
    got = say([(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secret_scan.secrets(frame(spark, list(enumerate(texts)))).collect()])
    want = []
    for i, t in enumerate(texts):
        b = brute.secrets(t)
        want.append((i, *[sum(x[1] == k for x in b) for k in range(3)], brute.sha(brute.joined(b))))
    assert got == say(want)


def test_weak_candidates_need_a_partner(spark):
    weak, key = "aB3dE6gH9jK2mN5pQ8sT1vW4xY7zA0cF3iL6oR9u", "AKIA" + "ABCDEFGHIJKLMNOP"
    host = "s3.eu-central-1.amazonaws.com"
    rows = [(0, weak), (1, f"{key} {weak}"), (2, key + " " * 400 + weak), (3, f"{weak} ... {key}"), (4, host), (5, f"{host} {key}"), (6, "ASIA" + "B" * 16), (7, "ASIA" + "B" * 16 + " secret=abcdefgh"), (8, f"{key} " + f"{weak} " * 200)]
    got = {r.doc_id: r for r in secret_scan.secrets(frame(spark, rows)).collect()}
    assert [got[k].n_linked for k in range(9)] == [0, 1, 0, 1, 0, 1, 0, 1, sum(21 + 41 * k - 20 <= secret_scan.SCOPE for k in range(200))]
    assert got[1].spans == "access:0:20,weak_secret:21:61"


def test_weak_secrets_in_their_usual_forms(spark):
    weak, key = "aB3dE6gH9jK2mN5pQ8sT1vW4xY7zA0cF3iL6oR9u", "AKIA" + "ABCDEFGHIJKLMNOP"
    storage, spaces = "k3" + weak + weak + "aB3d==", weak + "x7Q"
    assert len(storage) == 88 and len(spaces) == 43
    rows = [(0, f"{key}\nAWS_SECRET_ACCESS_KEY={weak}"), (1, f"{key} is used with {weak}."), (2, f"{key} {storage}"), (3, f"{key} {spaces}"), (4, f"KEY={weak}"), (5, f"{key} {weak}_x")]
    got = {r.doc_id: r.spans.split(",") for r in secret_scan.secrets(frame(spark, rows)).collect()}
    for k, token in ((0, weak), (1, weak), (2, storage), (3, spaces)):
        at = rows[k][1].index(token)
        assert f"weak_secret:{at}:{at + len(token)}" in got[k]
    assert not any("weak" in x for k in (4, 5) for x in got[k])


def test_exact(docs):
    got = exact_dedup.exact_duplicates(docs).collect()
    by = {}
    for r in got:
        by.setdefault(r.text_sha256, []).append(r)
    for i, t in TEXTS:
        assert brute.sha(brute.SPACE.sub(" ", t or "")) in by
    for group in by.values():
        ids = [r.doc_id for r in group if r.doc_id is not None]
        keep = min(ids) if ids else None
        assert {(r.keep_id, r.group_size) for r in group} == {(keep, len(group))}
        assert sum(r.kept for r in group) == 1 and [r.doc_id for r in group if r.kept] == [keep]


def test_exact_survives_digest_collisions(docs, spark):
    for bits in (0, 1, 3):
        assert say(exact_dedup.exact_duplicates(docs, bits).collect()) == say(exact_dedup.exact_duplicates(docs).collect())


def test_drop_copies_keeps_columns(docs):
    out = exact_dedup.drop_copies(docs)
    assert out.schema == docs.schema
    kept = [(r.doc_id, r.text) for r in out.collect()]
    norm = lambda t: brute.SPACE.sub(" ", t or "")
    assert sorted(norm(t) for _, t in kept) == sorted({norm(t) for _, t in TEXTS})
    assert exact_dedup.drop_copies(docs.limit(0)).collect() == []


def test_near(spark):
    base = WORDS[5]
    rows = [(100 + k, base) for k in range(4)] + [(k, t) for k, t in enumerate([*WORDS, None, "", "one two", "ONE two", base + " tail", base + " tail end"])]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute.near(rows)


def test_near_with_hot_buckets(spark):
    """Every bucket above one node is dealt anew; the components stay those of brute force."""
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(3)]
    fps = {c for c in centres}
    for _ in range(150):
        f = rng.choice(sorted(fps))
        fps.add(f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    nodes = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    want = {}
    for f in fps:
        want[f] = f

    def find(f):
        while want[f] != f:
            f = want[f]
        return f

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 2:
                want[find(a)] = find(b)
    for hot in (1, 10, 10_000):
        roots = {r.node: r.root for r in simhash.components(simhash.links(nodes, hot=hot)).collect()}
        groups = {}
        for f in fps:
            groups.setdefault(find(f), set()).add(roots.get(signed(f), signed(f)))
        assert all(len(g) == 1 for g in groups.values())
        assert len({min(g) for g in groups.values()}) == len(groups)


def test_drop_near_copies(docs):
    out = simhash.drop_near_copies(docs)
    assert out.schema == docs.schema
    ids = [r.doc_id for r in out.collect()]
    assert 5 in ids and 7 not in ids and ids.count(None) == 2 and ids.count(10) == 2
    assert simhash.drop_near_copies(docs.limit(0)).collect() == []


def test_drop_near_copies_finds_all_similar_texts(spark):
    """Against all pairs by brute force: edits that leave a five-word Jaccard similarity about 0.8, far beyond two bits."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(3000)]
    texts = []
    for _ in range(12):
        base = rng.choices(words, k=rng.choice((4, 30, 90, 400)))
        texts.append(base)
        for edits in (1, 1, 2, 3, 8):
            new = list(base)
            for _ in range(edits):
                new[rng.randrange(len(new))] = rng.choice(words)
            texts.append(new + rng.choices(words, k=rng.randrange(3)))
    boiler = rng.choices(words, k=40)
    texts += [boiler + rng.choices(words, k=n) for n in (1, 2, 5, 9, 15, 60)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    pairs, least = brute.similar_pairs(rows), brute.similar(rows)
    far = [(a, b) for a, b in pairs if (brute.fingerprint(" ".join(texts[a])) ^ brute.fingerprint(" ".join(texts[b]))).bit_count() > 2]
    assert len(far) > 5
    assert {r.doc_id: r.component_id for r in simhash.near_copies(frame(spark, rows)).collect()} == least
    assert {r.doc_id for r in simhash.drop_near_copies(frame(spark, rows)).collect()} == {i for i in least if least[i] == i}


def test_a_passage_of_many_texts_makes_no_rows_where_it_comes_last(spark):
    """It lies in all prefixes, but too far behind to be the first thing that similar sets share."""
    rows = [(1, k, k, 100, at, 0) for k, at in enumerate([15] * 200, 1)] + [(2, k, k, 100, at, 0) for k, at in ((301, 0), (302, 11), (303, 12), (304, 19))]
    open_ = spark.createDataFrame(rows, "h long, fp long, root long, size long, at long, main long")
    assert sorted((r.a.fp, r.b.fp) for r in simhash.meetings(open_, simhash.SIMILAR).collect()) == [(301, 302)]


def test_near_copies_beside_a_passage_of_many_texts(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(3000)]
    passage = rng.choices(words, k=30)
    texts = []
    for _ in range(40):
        own = rng.choices(words, k=rng.choice((20, 90, 140)))
        for _ in range(4):
            new = list(own)
            for at in rng.sample(range(len(new)), rng.randrange(4)):
                new[at] = rng.choice(words)
            texts.append(passage + new)
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    assert {r.doc_id: r.component_id for r in simhash.near_copies(frame(spark, rows)).collect()} == brute.similar(rows)


def test_near_copies_of_one_text_are_not_paired_with_each_other(spark):
    """A group of edited copies that are similar to their source but hardly to each other, among texts that share a passage."""
    rng = random.Random(4)
    words = [f"w{k}" for k in range(4000)]
    base, passage = rng.choices(words, k=120), rng.choices(words, k=60)
    texts = [base]
    for _ in range(60):
        new = list(base)
        for at in rng.sample(range(120), 2):
            new[at] = rng.choice(words)
        texts.append(new)
    texts += [passage + rng.choices(words, k=rng.choice((10, 25, 80))) for _ in range(40)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    docs = frame(spark, rows)
    assert {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()} == brute.similar(rows)
    signed = simhash.prefixes(docs, 5, simhash.SIMILAR, simhash.frequent_shingles(docs, 5))
    nodes = signed.withColumnRenamed("doc_id", "least")
    shared = simhash.shared_shingles(nodes)
    some = simhash.verified(docs, nodes, simhash.proposed(nodes, shared, 2, simhash.SIMILAR), 5, simhash.SIMILAR)
    assert some.count() <= 3 * len(rows)
    assert simhash.remaining(shared, simhash.components(some), simhash.SIMILAR).count() < 61 * 60 / 8


def test_exact_survives_levels_and_full_filters(docs):
    """Many levels of two runs each, and filters that let every row pass."""
    want = say(exact_dedup.exact_duplicates(docs).collect())
    many = docs.repartition(9)
    for fan, words, bits in ((2, 1, 64), (2, 1 << 20, 2), (64, 1, 0)):
        assert say(exact_dedup.exact_duplicates(many, bits, fan, words).collect()) == want
    kept = say([(r.doc_id, r.text) for r in exact_dedup.drop_copies(many, 1, 2, 1).collect()])
    norm = lambda t: brute.SPACE.sub(" ", t or "")
    assert sorted(norm(eval(x)[1]) for x in kept) == sorted({norm(t) for _, t in TEXTS})


def test_linking_against_all_pairs(spark):
    """Weak spans apart from each other, parts that nest and overlap in any way."""
    rng = random.Random(8)
    rows = []
    for k in range(120):
        at, weak = 0, []
        for _ in range(rng.randrange(6)):
            at += rng.randrange(1, 60)
            weak.append((at, at := at + rng.randrange(1, 20)))
        parts = sorted((s, s + rng.randrange(1, 200)) for s in (rng.randrange(300) for _ in range(rng.randrange(6))))
        rows.append((k, weak, parts))
    kind = "array<struct<s:int,e:int>>"
    got = spark.createDataFrame(rows, f"k int, weak {kind}, parts {kind}").select("k", secret_scan.linked(F.col("weak"), F.col("parts"), 30).alias("told"))
    told = {r.k: r.told for r in got.collect()}
    for k, weak, parts in rows:
        want = [any(0 <= s - e2 <= 30 or 0 <= s2 - e <= 30 for s2, e2 in parts) for s, e in weak]
        assert told[k] == want, (weak, parts)


def test_no_candidate_vouches_for_itself(spark):
    key = "AKIA" + "ABCDEFGHIJKLMNOP"
    rows = [(0, 'token: "s3.eu.amazonaws.com"'), (1, "token=ASIA" + "B" * 16), (2, f"secret={key}/" + "x" * 400 + " s3.amazonaws.com"), (3, "token=ASIA" + "B" * 16 + " password=abcdefgh")]
    got = {r.doc_id: r for r in secret_scan.secrets(frame(spark, rows)).collect()}
    assert [got[k].n_linked for k in range(4)] == [0, 0, 1, 1]


def test_prefix_tables(docs):
    few = docs.filter("doc_id IS NULL OR doc_id <> 4")
    tables = token_counts.prefix_tables(few)
    want = {}
    c = token_counts.counter(token_counts.bpe.vocabulary(token_counts.VOCABULARY))
    got = say([(r.doc_id, list(r.counts)) for r in tables.collect()])
    assert got == say([(i, [c.count((t or "")[:k]) for k in range(len(t or "") + 1)]) for i, t in TEXTS if i != 4])
    for limit in (0, 3, 40):
        cut = say([tuple(r) for r in token_counts.cut_to(tables, limit).collect()])
        want = [(i, n := max(k for k in range(len(t or "") + 1) if c.count((t or "")[:k]) <= limit), c.count((t or "")[:n])) for i, t in TEXTS if i != 4]
        assert cut == say(want)
    assert token_counts.prefix_tables(docs.limit(0)).collect() == []


def test_packing_buckets(docs, tmp_path, spark):
    """Sequences are numbered without gaps from the longest, alike however the table is split; rows are laid out by bucket."""
    a, b = packing.pack(docs.repartition(7)), packing.pack(docs.coalesce(1))
    rows = sorted(a.collect(), key=lambda r: r.sequence_id)
    assert say(map(tuple, rows)) == say(map(tuple, b.collect()))
    assert [r.sequence_id for r in rows] == list(range(len(rows)))
    assert [r.length for r in rows] == sorted((r.length for r in rows), reverse=True)
    packing.write_buckets(a, str(tmp_path / "out"))
    assert {int(p.name.split("=")[1]) for p in (tmp_path / "out").glob("bucket=*")} == {r.length.bit_length() - 1 for r in rows}
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)


def test_warc_records_refer_to_each_other(spark, tmp_path):
    same = "s" * 200
    rows = [(5, "u", same), (2, "v", same), (2, "v", same), (7, "w", same + "x"), (9, "w", same + "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = warc.write_archives(pages, f"file://{tmp_path}/a")
    ids, refers = [], []
    for r in manifest.collect():
        with open(r.path.removeprefix("file://"), "rb") as f:
            for h, _ in warc.read_records(f):
                (ids if h["warc-type"] == "response" else refers).append(h.get("warc-refers-to") or h["warc-record-id"])
    assert len(set(ids)) == len(ids) == 3 and len(refers) == 2
    assert refers[0] in ids or refers[1] in ids
    read = {(r.page, r.kind): r for r in warc.read_pages(manifest).collect()}
    assert read["5", "revisit"].payload_bytes == 200 and read["9", "revisit"].payload_digest == hashlib.sha256((same + "x").encode()).hexdigest()
    lost = warc.resolve(spark.createDataFrame([("1", None, "revisit", "2", "d", None, None, "urn:marketloom:page:2:d", None, None, None, None)], warc.READ)).collect()
    assert len(lost) == 1 and "missing" in lost[0].error


def test_warc_passes_over_what_it_cannot_read(spark, tmp_path):
    member = lambda b: (z := zlib.compressobj(1, zlib.DEFLATED, 31)).compress(b) + z.flush()
    good = [next(warc.records_of(k, "u", b"abc" * 9, hashlib.sha256(b"abc" * 9).hexdigest(), None, f"0-{k}")) for k in range(7)]
    no_length = good[0].replace(b"Content-Length", b"Content-Lenght")
    bad_number = warc.record([("WARC-Type", "continuation"), ("WARC-Segment-Number", "two"), ("WARC-Segment-Origin-ID", "x")], b"y")
    broken = bytearray(member(good[0]))
    broken[30] ^= 0xFF
    cut = member(good[0])[:-20]
    parts = [member(good[1]), member(b"junk" * 50), member(good[2]), member(no_length), member(good[3]), member(good[0][:-30]), member(bad_number), member(good[4] + good[5]), bytes(broken), member(good[6]), cut]
    path = tmp_path / "x.warc.gz"
    path.write_bytes(b"".join(parts))
    got = warc.read_pages(spark.createDataFrame([(f"file://{path}",)], "path string")).collect()
    assert {r.page for r in got if r.error is None} == {str(k) for k in range(1, 7)}
    assert len([r for r in got if r.error is not None]) >= 6


def test_redact_and_pipeline_on_empty_tables(spark, tmp_path, docs, labels):
    assert pii.redact(docs.limit(0)).collect() == []
    src = "/root/testdata/sf0.001"
    for name in ("documents", "labels"):
        spark.read.parquet(f"{src}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_packing(docs):
    rows = packing.pack(docs, with_ids=True).collect()
    assert sum(r.length for r in rows if r.doc_id == 1) == 1 and all(r.length in {1 << k for k in range(12)} for r in rows)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)
    assert packing.pack(docs.limit(0)).collect() == []
    assert packing.pieces(2048 * 2 + 7) == [2048, 2048, 4, 2, 1] and packing.pieces(1) == [1]


def test_encode_and_decode(docs):
    back = automaton_codec.decode(automaton_codec.encode(docs)).collect()
    assert say([tuple(r) for r in back]) == say([(i, t or "") for i, t in TEXTS])


def test_redact(spark):
    rows = [(1, "mail a.b@c.de now"), (2, None), (3, "clean"), (4, "jane [at] example [dot] com"), (5, "")]
    out = pii.redact(frame(spark, rows))
    assert out.schema == frame(spark, rows).schema
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {1: ("mail <EMAIL> now", 16), 2: (None, None), 3: ("clean", 5), 4: ("<EMAIL>", 7), 5: ("", 0)}


def test_keep_good_keeps_columns(docs, labels):
    out = pu_quality.keep_good(docs, labels)
    assert out.schema == docs.schema
    assert pu_quality.keep_good(docs.limit(0), labels).collect() == []
    assert pu_quality.keep_good(docs, labels.limit(0)).count() == docs.count()


def test_warc(spark, tmp_path):
    same, big = "s" * 200, "<p>" + "".join(random.choice("abcdef\r\n") for _ in range(200_000)) + "</p>"
    rows = [(5, "u", same), (2, "http://x/ y\r\nz", same), (9, None, same), (9, None, same), (1, "u", None), (3, "u", ""), (4, "u", "tiny"), (6, "u", "tiny"), (7, "é", big), (8, "v", big), (None, "w", "s" * 201), (11, "q", "é" * 50), (12, "q", "é" * 50)]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, digest string, first string")
    got = say([tuple(r)[:5] for r in warc.round_trip(pages, segment=4096).collect()])
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        least = min(j for j, _, g in rows if (g or "") == (h or "") and j is not None) if i is not None else None
        ref = least if len(b) >= 100 and i is not None and i != least else None
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "response" if ref is None else "revisit", ref))
    assert got == say(want)
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_warc_reports_broken_segments(spark):
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(b"abc" * 5000)
    cut = [block[k : k + 4000] for k in range(0, len(block), 4000)]
    def rows(origin, parts, total):
        return [("1", None, "response" if n == 1 else "continuation", None, None, None, origin, origin, n, total if n == len(cut) else None, bytearray(b), None) for n, b in parts]
    good = list(enumerate(cut, 1))
    data = rows("a", good[::-1], len(block)) + rows("b", good[:1] + good[2:], len(block)) + rows("c", good, len(block) + 1)
    got = {r.origin: r for r in warc.reassemble(spark.createDataFrame(data, warc.READ)).collect()}
    assert got["a"].error is None and got["a"].payload_bytes == 15000
    assert "missing" in got["b"].error and "due" in got["c"].error


def test_pipeline(spark, tmp_path):
    """The stages by brute force, each on what its predecessor kept."""
    src = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{src}/documents.parquet")
    good = corpus_pipeline.quality(spark, documents, src)
    assert good.schema == documents.schema
    rows = [(r.doc_id, r.text) for r in good.collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{src}/labels.parquet").collect()}
    dropped = {r.doc_id for r in documents.select("doc_id").collect()} - {i for i, _ in rows}
    assert sum(labels.get(i) == 1 for i in dropped) <= 2  # of some eighty, learned from as few
    said = brute.exact(rows)
    rows = [(i, t) for i, t in rows if said[i][2]]
    near = brute.similar(rows)
    rows = {i: pii.redacted(t or "") for i, t in rows if near[i] == i}
    done = corpus_pipeline.run(spark, src).collect()
    assert {r.doc_id for r in done} == set(rows)
    e = packing.encoder(packing.place(packing.VOCABULARY))
    for r in done:
        ids = e.encode(rows[r.doc_id]) + (1).to_bytes(4, "little")
        assert r.doc_tokens == len(ids) // 4 and zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32


def test_samples_are_bounded_in_rows(spark, labels):
    """Rows that repeat a sampled doc_id go to no sample twice, and labels that differ aren't learned from."""
    from marketloom.llm import training

    docs = frame(spark, [(1, f"text {k}") for k in range(50)] + [(2, None), (3, "x")])
    rows = training.samples(docs, {"a": spark.createDataFrame([(1,), (2,)], "doc_id long"), "b": spark.createDataFrame([(1,)], "doc_id long")}).collect()
    assert say([(r.doc_id, r.text, sorted(r.roles)) for r in rows]) == say([(1, "text 0", ["a", "b"]), (2, None, ["a"])])
    both = spark.createDataFrame([(21, 1), (21, 0), (22, 1), (22, 1), (24, None)], "doc_id long, quality int")
    assert [tuple(r) for r in training.agreed(both).collect()] == [(22, 1)]


def test_the_pipeline_delivers_what_it_packed(spark, tmp_path):
    """The ids of each document's pieces, put together, are those of the redacted text of the stage before, and decode to its words."""
    import struct

    from tokenizers import Tokenizer

    from marketloom.llm.bpe import vocabulary

    src = "/root/testdata/sf0.001"
    done = corpus_pipeline.run(spark, src).collect()
    docs = spark.read.parquet(f"{src}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, src)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert "<EMAIL>" in " ".join(texts.values()) and texts.keys() == {r.doc_id for r in done}
    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    for doc_id, text in texts.items():
        pieces = sorted((r for r in done if r.doc_id == doc_id), key=lambda r: r.start)
        ids = [i for r in pieces for i in struct.unpack(f"<{r.length}I", r.ids)]
        assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in pieces)
        assert ids == [*library.encode(text, add_special_tokens=False).ids, 1]
        assert "".join(library.decode(ids[:-1], skip_special_tokens=False).split()) == "".join(library.decode(library.encode(text, add_special_tokens=False).ids, skip_special_tokens=False).split())
