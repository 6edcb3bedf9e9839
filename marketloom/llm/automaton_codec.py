"""BPE encoding and decoding by the tokenization automaton (operator 10).

``bpe.Automaton`` compiles the merges by successive merge gadgets. A text is split into pre-tokens, each distinct one is
walked through the automaton's stored arcs once, byte by byte, and decoding emits the labels of the arcs.

Defined results: null and empty texts give no ids and the empty text; strings of added special tokens give their id;
repeated rows are encoded row by row; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe
from .common import map_rows, texts

VOCABULARY = "byte_bpe_50k.json"


class Codec:
    def __init__(self, automaton: bpe.Automaton):
        self.automaton = automaton
        self.special = bpe.Special(automaton.special)
        #: Ids as little-endian unsigned 32-bit integers.
        self.words = bpe.Memo(lambda w: self._packed(automaton.encode_word(w.encode())))
        self.chunks = bpe.Memo(lambda c: b"".join(map(self.words.__getitem__, bpe.SPLIT.findall(c))))

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return pack(f"<{len(ids)}I", *ids)

    def _plain(self, text: str) -> bytes:
        words = bpe.pre_tokens(text)
        return b"".join(map(self.chunks.__getitem__, bpe.CHUNK.findall(text)) if words is None else map(self.words.__getitem__, words))

    def encode(self, text: str) -> bytes:
        if not self.special.within(text):
            return self._plain(text)
        special = self.automaton.special
        return b"".join(self._packed([special[p]]) if p in special else self._plain(p) for p in self.special.split(text))

    def decode(self, packed: bytes) -> str:
        return self.automaton.decode(np.frombuffer(packed, "<u4").tolist())


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(bpe.load(path))


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per row: doc_id and ids, an array of token ids."""

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(bpe.vocabulary(vocabulary))
        ids = [np.frombuffer(c.encode(t), "<u4").astype(np.int32) for t in texts(b)]
        return pa.RecordBatch.from_pydict({"doc_id": b.column(0), "ids": pa.array(ids, pa.list_(pa.int32()))})

    rows = docs.select("doc_id", "text")
    return map_rows(rows, work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per row of ``encode``: doc_id and the text that its ids stand for."""

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        a = bpe.load(bpe.vocabulary(vocabulary))
        return pa.RecordBatch.from_pydict({"doc_id": b.column(0), "text": pa.array([a.decode(x or []) for x in b.column(1).to_pylist()], pa.string())})

    rows = encoded.select("doc_id", "ids")
    return map_rows(rows, work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def digests(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 and decoded_sha256; encodes and decodes in one pass, moving no ids."""

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(bpe.vocabulary(vocabulary))
        packed = [c.encode(t) for t in texts(b)]
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": b.column(0),
                "n_tokens": pa.array([len(x) // 4 for x in packed], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in packed], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(c.decode(x).encode()).hexdigest() for x in packed], pa.string()),
            }
        )

    rows = docs.select("doc_id", "text")
    return map_rows(rows, work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
