"""Packing by power-of-two decomposition (operator 8).

A document of n tokens becomes pieces of ``SEQUENCE`` tokens and then one piece for each binary digit of the rest, longest
first. Pieces of equal length form a bucket (``bucket`` is the length's exponent). Each piece is a sequence of its own, so no
sequence crosses documents, and none is padded, since every length is a power of two.

Sequences are numbered bucket by bucket from the longest pieces, without gaps, so that a bucket is a range of sequence ids from
which batches of one length are drawn; ``write_buckets`` lays them out that way. Within a bucket the order is that of a hash of
the piece, then of doc_id and start: the same table gets the same numbers however it is split into files and tasks. Numbers come
from at most 12 x ``SLOTS`` counts and a sort of each slot's own rows.

Defined results: a null or empty text is the end token alone, one piece of length 1; repeated rows are packed row by row;
an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from functools import lru_cache
from struct import pack as pack_ids

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import Memo, Special, byte_alphabet, vocabulary as place
from .common import map_rows, stored, texts

VOCABULARY = "word_bpe_49k.json"
SEQUENCE = 2048
END_ID = 1
SLOTS = 1024


def pieces(n: int, sequence: int = SEQUENCE) -> list[int]:
    """Lengths of the pieces of n tokens: whole sequences, then the binary digits of the rest from the highest."""
    whole, rest = divmod(n, sequence)
    return [sequence] * whole + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


class WordEncoder:
    """Ids of the tokenizers library; equal words are encoded once.

    The vocabulary drops white space and treats each code point below U+0300 on its own (these are normalised already), so
    a text's ids are its words' ids in order. Other texts go to the library whole.
    """

    #: What sends a whole text to the library: code points from U+0300 on, separators that only str.split() knows, special names.
    OTHER = re.compile("[^\x00-\x1b\x20-\u02ff]")
    #: What sends a chunk between white space to the library: control characters, and letters whose small form lies elsewhere.
    ODD = re.compile("[\x00-\x08\x0e-\x1b\x7f-\x84\x86-\x9f\xad" + "".join(c for c in map(chr, range(0x300)) if len(c.lower()) > 1 or c.lower() > "\u02ff") + "]")
    LETTERS, DIGITS = (re.escape("".join(c for c in map(chr, range(0x300)) if unicodedata.category(c)[0] == k)) for k in "LN")
    PARTS = re.compile(rf"[{LETTERS}]+|'(?:[stmd]|re|ve|ll)|[{DIGITS}]|[^\s{LETTERS}{DIGITS}]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.special = Special({t.content: i for i, t in self.library.get_added_tokens_decoder().items()})
        self.letters = {b: c for c, b in byte_alphabet().items()}
        self.words = Memo(self._word, 200_000)

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return pack_ids(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        if not word.isascii():
            word = "".join(map(self.letters.__getitem__, word.encode()))
        return self._packed([t.id for t in self.model.tokenize(word)])

    def _whole(self, text: str) -> bytes:
        return self._packed(self.library.encode(text, add_special_tokens=False).ids)

    def _parts(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.PARTS.findall(text.lower())))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.special.within(text) or self.OTHER.search(text):
            return self._whole(text)
        if self.ODD.search(text):
            return b"".join(self._whole(c) if self.ODD.search(c) else self._parts(c) for c in text.split())
        return self._parts(text)


@lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def cut(docs: DataFrame, sequence: int = SEQUENCE, vocabulary: str = VOCABULARY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, bucket; with_ids adds the ids."""

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        e = encoder(place(vocabulary))
        end = end_id.to_bytes(4, "little")
        rows: list[tuple] = []
        for doc_id, text in zip(b.column(0).to_pylist(), texts(b), strict=True):
            ids = e.encode(text) + end
            n, start = len(ids) // 4, 0
            for size in pieces(n, sequence):
                part = ids[4 * start : 4 * (start + size)]
                rows.append((doc_id, start, size, zlib.crc32(part), n, size.bit_length() - 1, part))
                start += size
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket", "ids"][: 6 + with_ids]
        kinds = [b.schema.field(0).type, *[pa.int64()] * 4, pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names))], names)

    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_rows(rows, work, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, bucket int" + ", ids binary" * with_ids)


def numbered(cut_pieces: DataFrame) -> DataFrame:
    """The pieces with sequence_id: 0, 1, 2, ... from the longest bucket to the shortest."""
    rows = stored(cut_pieces.withColumn("_slot", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(SLOTS)).cast("int")), "pieces", {"compression": "zstd"})
    sizes = rows.groupBy("bucket", "_slot").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy(F.col("bucket").desc(), "_slot").rowsBetween(Window.unboundedPreceding, -1))
    base = sizes.select("bucket", "_slot", F.coalesce(before, F.lit(0)).alias("_base"))
    own = F.row_number().over(Window.partitionBy("bucket", "_slot").orderBy("doc_id", "start", "ids_crc32", "doc_tokens"))
    return rows.withColumn("_own", own).join(F.broadcast(base), ["bucket", "_slot"]).withColumn("sequence_id", F.col("_base") + F.col("_own") - 1).drop("_own", "_base", "_slot")


def pack(docs: DataFrame, sequence: int = SEQUENCE, vocabulary: str = VOCABULARY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket; with_ids adds the ids."""
    out = numbered(cut(docs, sequence, vocabulary, end_id, with_ids))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket", *["ids"] * with_ids]
    return out.withColumn("offset", F.lit(0).cast("long")).select(columns)


def write_buckets(packed: DataFrame, path: str) -> None:
    """A folder for each bucket, rows in the order of their sequences."""
    packed.sortWithinPartitions("bucket", "sequence_id").write.partitionBy("bucket").parquet(path)
