"""Token counts by prefix dynamic programming (operator 4).

Each distinct pre-token gets one dynamic program over its prefixes: ``count[i] = count[i - len(t)] + 1``, where t is the
one token that the encoding of the prefix ends in. A text's table is the running sum over its chunks plus the chunk's own
prefix counts, so "how many tokens has the text up to here" and "where does a budget run out" are look-ups.

Defined results: null and empty texts have 0 tokens; repeated rows are counted row by row; an empty table gives an empty
table; other columns of the input are not read. Strings of added special tokens count as one token each, as the library
has it by default. Very long texts are counted whole.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import map_rows, texts

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
WHITE = frozenset(c for c in map(chr, range(0x3001)) if not bpe.CHUNK.fullmatch("x" + c))


class PrefixCounts:
    """The prefix table of texts under one vocabulary."""

    def __init__(self, automaton: bpe.Automaton):
        self.automaton = automaton
        self.special = bpe.Special(automaton.special)
        self.words = bpe.Memo(lambda w: automaton.prefixes(w.encode())[-1])
        self.chunks = bpe.Memo(lambda c: sum(map(self.words.__getitem__, bpe.SPLIT.findall(c))))

    def pieces(self, text: str) -> list[tuple[str, int]]:
        """Chunks of the text in order with their token counts."""
        if not self.special.within(text):
            chunks = bpe.CHUNK.findall(text)
            return list(zip(chunks, map(self.chunks.__getitem__, chunks), strict=True))
        out = []
        for part in self.special.split(text):
            if part in self.automaton.special:
                out.append((part, 1))
            else:
                out += ((c, self.chunks[c]) for c in bpe.CHUNK.findall(part))
        return out

    def count(self, text: str) -> int:
        if self.special.within(text):
            return sum(n for _, n in self.pieces(text))
        words = bpe.pre_tokens(text)
        return sum(map(self.chunks.__getitem__, bpe.CHUNK.findall(text))) if words is None else sum(map(self.words.__getitem__, words))

    def within(self, chunk: str) -> list[int]:
        """Tokens of each prefix of a chunk (code points, the empty prefix first), each as a text of its own."""
        out = [0]
        base, done = 0, 0
        words = bpe.SPLIT.findall(chunk)
        for w in words:
            for k in range(1, len(w) + 1):
                cut = bpe.SPLIT.findall(w[:k])
                out.append(base + sum(self.automaton.prefixes(x.encode())[-1] for x in cut) if len(cut) > 1 else 0)
            byte_at = list(accumulate(len(c.encode()) for c in w))
            dp = self.automaton.prefixes(w.encode())
            for k in range(1, len(w) + 1):
                if not out[done + k]:
                    out[done + k] = base + dp[byte_at[k - 1]]
            base, done = base + dp[-1], done + len(w)
        return out

    def table(self, text: str) -> list[int]:
        """The exact number of tokens of ``text[:i]`` for each i."""
        out, base, before = [0], 0, ""
        for chunk, n in self.pieces(text):
            if chunk in self.automaton.special:
                # cut inside the name of a special token: ordinary text that joins the chunk before it
                keep = self.chunks[before] if before else 0
                out += (base - keep + self.count(before + chunk[:k]) for k in range(1, len(chunk)))
                out.append(base + n)
                base, before = base + n, ""
                continue
            own = self.within(chunk)
            if before and before[0] in WHITE and before[-1] in WHITE and chunk[0] in WHITE:
                own[1] = self.count(before + chunk[0]) - self.chunks[before]  # the cut text ends in one run of white space
            out += (base + x for x in own[1:])
            base, before = base + n, chunk
        return out

    def measured(self, text: str, limit: int) -> tuple[int, int]:
        """The text's tokens, and the most code points of a prefix of at most ``limit`` tokens."""
        words = None if self.special.within(text) else bpe.pre_tokens(text)
        if words is None:
            words, counts = zip(*self.pieces(text), strict=True) if text else ((), ())
        else:
            counts = map(self.words.__getitem__, words)
        ends = list(accumulate(counts))
        n = ends[-1] if ends else 0
        if n <= limit:
            return n, len(text)
        # The word in which the budget runs out. What ends beyond it has more tokens, unless it is white space that goes on;
        # white space before it may join it where the cut falls.
        k = bisect_right(ends, limit)
        tail = max(0, k - 2)
        while tail and words[tail - 1].isspace():
            tail -= 1
        head, before = sum(map(len, words[:tail])), ends[tail - 1] if tail else 0
        near = self.table("".join(words[tail : k + 2]))
        return n, head + max(i for i, x in enumerate(near) if before + x <= limit)

    def fits(self, text: str, limit: int) -> int:
        """The most code points of the text whose prefix has at most ``limit`` tokens."""
        return self.measured(text, limit)[1]


@lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounts:
    return PrefixCounts(bpe.load(path))


def prefix_tables(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per row: doc_id and counts, the number of tokens of the text's first 0, 1, 2, ... code points."""

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        c = counter(bpe.vocabulary(vocabulary))
        return pa.RecordBatch.from_pydict({"doc_id": b.column(0), "counts": pa.array([c.table(t) for t in texts(b)], pa.list_(pa.int32()))})

    rows = docs.select("doc_id", "text")
    return map_rows(rows, work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, counts array<int>", 64)


def cut_to(tables: DataFrame, limit: int) -> DataFrame:
    """Per row of ``prefix_tables``: doc_id, fit_chars and fit_tokens of the longest prefix of at most ``limit`` tokens; no text is read."""
    chars = F.size("counts") - F.array_position(F.transform(F.reverse("counts"), lambda n: n <= limit), True)
    return tables.select("doc_id", chars.cast("long").alias("fit_chars"), "counts").select("doc_id", "fit_chars", F.get("counts", F.col("fit_chars").cast("int")).cast("long").alias("fit_tokens"))


def count_tokens(docs: DataFrame, limit: int = LIMIT, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit, and fit_chars, the longest prefix within the limit."""

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        c = counter(bpe.vocabulary(vocabulary))
        all_texts = texts(b)
        both = [c.measured(t, limit) for t in all_texts]
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": b.column(0),
                "n_bytes": pa.array([len(t.encode()) for t in all_texts], pa.int64()),
                "n_tokens": pa.array([n for n, _ in both], pa.int64()),
                "over_limit": pa.array([n > limit for n, _ in both], pa.bool_()),
                "fit_chars": pa.array([k for _, k in both], pa.int64()),
            }
        )

    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_rows(rows, work, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")
