"""Each query over a whole small table against the contract by brute force."""

import hashlib
import struct
import zlib

import numpy as np
import pytest

from marketloom.llm import queries as Q
from marketloom.llm.bpe import vocabulary
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_warc(spark):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    first = {}
    for i, p in sorted(pages.items()):
        first.setdefault(p, i)
    got = by_id(Q.op1_warc_segment_reassembly(spark, SF), "page_id")
    assert got.keys() == pages.keys()
    for i, p in pages.items():
        r = got[i]
        ref = first[p] if len(p) >= 100 and first[p] != i else None
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.error) == (len(p), hashlib.sha256(p).hexdigest(), "revisit" if ref is not None else "response", ref, None)


def test_secrets(spark, docs):
    got = by_id(Q.op2_multipart_secret_scan(spark, SF))
    assert len(got) == len(docs)
    for i, t in docs:
        b = brute.secrets(t or "")
        n = [sum(x[1] == k for x in b) for k in range(3)]
        r = got[i]
        assert [r.n_assign, r.n_access, r.n_hex] == n
        assert r.base_sha256 == brute.sha(brute.joined(b))
        assert set(filter(None, brute.joined(b).split(","))) <= set(r.spans.split(","))


def test_rules(spark, docs):
    got = by_id(Q.op3_boosted_quality_rules(spark, SF))
    for i, t in docs:
        r, want = got[i], brute.rules(t or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_token_counts_and_codec(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    counts, codes = by_id(Q.op4_prefix_token_counts(spark, SF)), by_id(Q.op10_automaton_bpe(spark, SF))
    for i, t in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        r = counts[i]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((t or "").encode()), len(ids), len(ids) > 512)
        assert len(library.encode((t or "")[: r.fit_chars], add_special_tokens=False).ids) <= 512
        c = codes[i]
        assert (c.n_tokens, c.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert c.decoded_sha256 == brute.sha(library.decode(ids, skip_special_tokens=False))


def test_classifier(spark, docs):
    got = by_id(Q.op5_pu_quality_classifier(spark, "/root/testdata/sf0.01"))
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(got[i].score, y) for i, y in labels.items() if got[i].held_out]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    auc = np.mean([(a > b) + (a == b) / 2 for a in good for b in bad])
    assert auc > 0.95
    assert np.mean([(s >= 0.3) == y for s, y in held]) > 0.95


def test_exact(spark, docs):
    got = {i: (r.keep_id, r.group_size, r.kept, r.text_sha256) for i, r in by_id(Q.op6_log_structured_dedup(spark, SF)).items()}
    assert got == brute.exact(docs)


def test_personal(spark, docs):
    got = by_id(Q.op7_pii_deobfuscation(spark, SF))
    for i, t in docs:
        b = brute.personal(t or "")
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[1] == k for x in b) for k in range(4)]
        assert r.base_sha256 == brute.sha(brute.joined(b))
        assert set(filter(None, brute.joined(b).split(","))) <= set(r.spans.split(","))


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    rows = Q.op8_binary_packing(spark, SF).collect()
    of: dict = {}
    for r in rows:
        of.setdefault(r.doc_id, []).append(r)
    assert len({r.sequence_id for r in rows}) == len(rows)
    for i, t in docs:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(of[i], key=lambda r: r.start):
            part = ids[at : at + r.length]
            assert (r.start, r.doc_tokens, r.offset) == (at, len(ids), 0)
            assert r.length <= 2048 and r.length & (r.length - 1) == 0
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += r.length
        assert at == len(ids)


def test_near(spark, docs):
    got = {i: (r.fingerprint, r.component_id) for i, r in by_id(Q.op9_bit_sliced_simhash(spark, SF)).items()}
    assert got == brute.near(docs)
