"""Fill-in-middle transformation over a sparse checkpoint index (operator 11).

A text is cut into units (``[A-Za-z]+|[^A-Za-z]``). Counting them walks the text once, ``STRIDE`` units at a time, and records
the code-point and byte offset at which each stride begins: the checkpoints. A cut after k units is found by binary search for
the last checkpoint that isn't behind it and a rescan of fewer than ``STRIDE`` units from there. A text of n units costs n for
counting and two short rescans; the index holds n / ``STRIDE`` entries. It answers for code points and bytes as well as units.

Which cuts and which form a document gets follows from a hash of its id alone, so a run can be repeated on any cluster.
``restore`` takes an output apart again in native functions: the markers occur in no text that is rearranged, and a marker holds
``<`` only at its start, so the first occurrence of each is its place.

Nothing is shuffled; a worker holds a few texts at a time. Defined results: null and empty texts are plain; a null doc_id hashes
as the empty string; repeated rows are transformed row by row; an empty table gives an empty table; very long texts are handled
whole; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, texts

#: Units between checkpoints.
STRIDE = 256
UNIT = "[A-Za-z]+|[^A-Za-z]"
ONE = re.compile(UNIT)


@dataclass(frozen=True)
class Markers:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


@dataclass(frozen=True)
class Rates:
    """Per cent: texts left plain, and of the others those in suffix-first order."""

    plain: int = 10
    spm: int = 20


@lru_cache(maxsize=8)
def strides(stride: int) -> re.Pattern:
    """A whole stride as one match: no unit in it can be given up, so none is tried twice."""
    return re.compile(f"(?>{UNIT}){{{stride}}}")


class CheckpointIndex:
    """Offsets of every ``stride``-th unit of a text, recorded while its units are counted."""

    def __init__(self, text: str, stride: int = STRIDE):
        self.text, self.units, self.points, self.bytes = text, [0], [0], [0]
        run = strides(stride)
        while m := run.match(text, self.points[-1]):
            self.units.append(self.units[-1] + stride)
            self.points.append(m.end())
            self.bytes.append(self.bytes[-1] + len(m[0].encode()))
        self.total = self.units[-1] + sum(1 for _ in ONE.finditer(text, self.points[-1]))

    def cut(self, unit: int) -> int:
        """The code point at which the first ``unit`` units end."""
        k = bisect_right(self.units, unit) - 1
        at, rest = self.points[k], unit - self.units[k]
        for _, m in zip(range(rest), ONE.finditer(self.text, at)):
            at = m.end()
        return at

    def byte(self, point: int) -> int:
        """The byte offset (UTF-8) of a code point."""
        k = bisect_right(self.points, point) - 1
        return self.bytes[k] + len(self.text[self.points[k] : point].encode())

    def unit_of_byte(self, byte: int) -> int:
        """The number of whole units in the first ``byte`` bytes."""
        k = bisect_right(self.bytes, byte) - 1
        at, n = self.bytes[k], self.units[k]
        for m in ONE.finditer(self.text, self.points[k]):
            at += len(m[0].encode())
            if at > byte:
                break
            n += 1
        return n


def draws(doc_id: int | None) -> tuple[int, ...]:
    """Four unsigned 32-bit numbers of a document."""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(h[k : k + 8], 16) for k in range(0, 32, 8))


def transform(doc_id: int | None, text: str, markers: Markers = Markers(), rates: Rates = Rates(), stride: int = STRIDE) -> tuple:
    """(units, form, prefix, middle and suffix length in code points, prefix and middle length in bytes, output) of one text."""
    index, (h1, h2, h3, h4) = CheckpointIndex(text, stride), draws(doc_id)
    n = index.total
    if not text or any(m in text for m in (markers.prefix, markers.suffix, markers.middle)) or h3 % 100 >= 100 - rates.plain:
        return n, "plain", None, None, None, None, None, text
    first, second = (index.cut(u) for u in sorted((h1 % (n + 1), h2 % (n + 1))))
    b1, b2 = index.byte(first), index.byte(second)
    prefix, middle, suffix = markers.prefix + text[:first], markers.middle + text[first:second], markers.suffix + text[second:]
    form, parts = ("spm", (suffix, prefix, middle)) if h4 % 100 < rates.spm else ("psm", (prefix, suffix, middle))
    return n, form, first, second - first, len(text) - second, b1, b2 - b1, "".join(parts)


def fill_in_middle(docs: DataFrame, markers: Markers = Markers(), rates: Rates = Rates(), stride: int = STRIDE) -> DataFrame:
    """Per row: doc_id, n, form, lengths of the parts in code points and bytes (null if plain), and the output text."""

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(i, *transform(i, t, markers, rates, stride)) for i, t in zip(b.column(0).to_pylist(), texts(b), strict=True)]
        kinds = [b.schema.field(0).type, pa.int64(), pa.string(), *[pa.int64()] * 5, pa.string()]
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "suffix_chars", "prefix_bytes", "middle_bytes", "output"]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names))], names)

    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_rows(rows, work, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, suffix_chars long, prefix_bytes long, middle_bytes long, output string", 128)


def restored(output: Column, form: Column, markers: Markers = Markers()) -> Column:
    """The source text, from an output and its form alone."""

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        a = F.substring_index(F.substr(output, F.lit(len(first) + 1)), second, 1)
        rest = F.substr(output, F.length(a) + len(first) + len(second) + 1)
        b = F.substring_index(rest, markers.middle, 1)
        return a, b, F.substr(rest, F.length(b) + len(markers.middle) + 1)

    prefix, suffix, middle = parts(markers.prefix, markers.suffix)
    late_suffix, early_prefix, late_middle = parts(markers.suffix, markers.prefix)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(early_prefix, late_middle, late_suffix)).otherwise(output)


def restore(transformed: DataFrame, markers: Markers = Markers()) -> DataFrame:
    """The transformed rows with the source ``text`` rebuilt."""
    return transformed.withColumn("text", restored(F.col("output"), F.col("form"), markers))


def digests(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n, form, lengths of prefix and middle, digests of the output and of the text restored from it."""
    t = fill_in_middle(docs)
    return t.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"), "prefix_bytes", "middle_bytes")
