"""SimHash near-duplicates by bit-sliced comparison (operator 9).

1. One Arrow pass gives each row its 64-bit fingerprint over word shingles (XXH64, majority of bits).
2. Equal fingerprints collapse to one node, so a group of copies of any size is one row from here on.
3. Candidates: the 64 bits are four blocks; two fingerprints within radius 2 agree in two whole blocks at least, so six
   tables keyed by two blocks (32 bits) hold every link. Buckets above ``HOT`` nodes are dealt anew by parts of the remaining
   bits, until none is left (again no link can be lost), so no task compares a large bucket.
4. In a bucket, bit planes lie vertically in machine words: one XOR per plane updates the distances of 64 fingerprints,
   carry-save counters hold them as bits, and a block is abandoned once all its distances exceed the radius.
   A bucket emits a spanning forest of its links, never all pairs.
5. Components: alternating large-star and small-star contraction of the forest, with a written table per round.

Defined results: null and empty texts have fingerprint zero and are linked like any other; repeated rows come back each;
the order of rows with equal keys doesn't matter; a null doc_id never becomes a component_id unless the component has no
other; an empty table gives an empty table; other columns are not read.

``drop_near_copies`` keeps one document of each group of texts that chains of five-word Jaccard similarity of 0.8 or more link.
Fingerprints alone can't tell these: at 0.8 two texts differ in ten bits or so, and at 0.6 in fifteen. So they propose links,
which are verified on the sets, and an exact search adds what they miss. No step makes all pairs of a group.

1. Equal sets collapse to one node, with the fingerprint of its set.
2. Two similar sets of n and m share one of the first n - ceil(0.8 n) + 1 and m - ceil(0.8 m) + 1 elements under any common order
   (prefix filter), so only these are keyed. The order puts shingles that are frequent in a sample of the texts last; it decides
   how many candidates there are, never which links are found.
3. Proposed links, a few for each node: the forest of the operator above at its radius, and, of the nodes that lead the groups
   of a shared prefix shingle, the one with the nearest fingerprint. Verified, they join nearly all of a large group.
4. Exact search over what is still apart: of each shared prefix shingle, nodes outside its largest component meet the nodes of
   other components, if it lies so far in front that it may be the first shingle both share. Pairs whose sizes and shared
   shingles allow the similarity are verified too.
5. A pair is verified by the intersection of its sets, made again from the texts of candidates only.

A text of fewer words than a shingle is one shingle, so empty texts are alike. Sets are of 64-bit hashes.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.operators.graph import components

from . import key_filter
from .common import hot_join, map_rows, stored, texts

SHINGLE = 3
RADIUS = 2
SEED = 42
BLOCKS = 4
HOT = 2048
FREE = 9
TILE = 512
COPY_SHINGLE = 5
#: Least Jaccard similarity of near copies, as a fraction of integers.
SIMILAR = (4, 5)
#: One text in ``SAMPLE`` tells which shingles are frequent; at most ``FREQUENT`` of them are sent to the tasks.
SAMPLE = 16
FREQUENT = 200_000
#: Fingerprints of leaders that are proposed differ in so many bits at most.
NEAR = 16
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(words: list[bytes], shingle: int, seed: int = SEED) -> np.ndarray:
    n = len(words) - shingle + 1
    if n < 1:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    digest = xxhash.xxh64_intdigest
    rows = zip(*(words[k : n + k] for k in range(shingle)), strict=True)
    return np.fromiter((digest(s, seed) for s in map(b" ".join, rows)), np.uint64, n)


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = text.encode().translate(LOWER).split()
    if not words:
        return 0
    return majority(shingle_hashes(words, shingle, seed))


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """Per row: doc_id and fp, the fingerprint as a signed long."""

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t, shingle, seed) for t in texts(b)], np.uint64).view(np.int64)
        return pa.RecordBatch.from_pydict({"doc_id": b.column(0), "fp": pa.array(fp, pa.int64())})

    rows = docs.select("doc_id", "text")
    return map_rows(rows, work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes: row b holds bit b of all fingerprints, 64 to a word."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    pad = -bits.shape[1] % 64
    return np.ascontiguousarray(np.packbits(np.pad(bits, ((0, 0), (0, pad))), axis=1, bitorder="little")).view("<u8")


def within(left: np.ndarray, right: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) with at most ``radius`` differing bits between left[i] and right[j]."""
    vertical = planes(right)
    flips = np.where(np.unpackbits(left.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
    counters = [np.zeros((len(left), vertical.shape[1]), np.uint64) for _ in range((radius + 1).bit_length())]
    over = np.zeros_like(counters[0])  # distances above the radius, which stay so
    rows = np.arange(len(left))
    for b in range(64):
        carry = vertical[b][None, :] ^ flips[rows, b][:, None]
        for k, c in enumerate(counters):
            counters[k], carry = c ^ carry, c & carry
        above = carry
        for low in range(radius + 1, 1 << len(counters)):
            match = ~np.zeros_like(above)
            for k, c in enumerate(counters):
                match &= c if low >> k & 1 else ~c
            above = above | match
        over |= above
        if b % 8 == 7:
            alive = ~(over == np.uint64(0xFFFFFFFFFFFFFFFF)).all(1)
            if not alive.any():
                return np.empty(0, np.int64), np.empty(0, np.int64)
            if not alive.all():
                rows, over, counters = rows[alive], over[alive], [c[alive] for c in counters]
    near = np.unpackbits(np.ascontiguousarray(~over).view(np.uint8), axis=1, bitorder="little")[:, : len(right)]
    i, j = np.nonzero(near)
    return rows[i], j


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots of n nodes under the links (i, j): the smallest index of each component."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        open_ = low < high
        if not open_.any():
            break
        i, j, low, high = i[open_], j[open_], low[open_], high[open_]
        np.minimum.at(root, high, low)
        while not np.array_equal(jumped := root[root], root):
            root = jumped
    return root


def bucket_links(fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints, tile by tile."""
    n = len(fps)
    a, b = [], []
    for p in range(0, n, TILE):
        for q in range(p, n, TILE):
            i, j = within(fps[p : p + TILE], fps[q : q + TILE], radius)
            keep = i + p < j + q
            i, j = i[keep] + p, j[keep] + q
            if len(i) > 2 * TILE:  # the tile's own forest says the same
                where = np.unique(np.concatenate([i, j]))
                root = forest(len(where), np.searchsorted(where, i), np.searchsorted(where, j))
                i, j = where[root], where
                i, j = i[i != j], j[i != j]
            a.append(i)
            b.append(j)
    root = forest(n, np.concatenate(a) if a else np.empty(0, np.int64), np.concatenate(b) if b else np.empty(0, np.int64))
    child = np.nonzero(root != np.arange(n))[0]
    return fps[child], fps[root[child]]


def _masks(bits: list[int], parts: int, agree: int) -> list[int]:
    """Masks of the unions of ``agree`` out of ``parts`` blocks of the given bit positions."""
    edges = [round(k * len(bits) / parts) for k in range(parts + 1)]
    blocks = [sum(1 << x for x in bits[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, agree)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _linked(buckets: DataFrame, radius: int) -> DataFrame:
    """Links inside buckets (mask, key, fp); equal keys lie in one partition, sorted, and stream through."""

    def each(batches):
        held_key, held = None, []  # the bucket that may go on in the next batch
        small: list[np.ndarray] = []  # whole buckets that are compared in one go: a link across buckets is a link too
        filled = 0

        def links(fps: np.ndarray) -> pa.RecordBatch | None:
            a, b = bucket_links(np.unique(fps), radius)
            if not len(a):
                return None
            return pa.RecordBatch.from_pydict({"a": pa.array(a.view(np.int64), pa.int64()), "b": pa.array(b.view(np.int64), pa.int64())})

        def close():
            nonlocal held, filled, small
            fps = np.concatenate(held) if held else np.empty(0, np.uint64)
            held = []
            if 1 < len(fps) < TILE:
                small.append(fps)
                filled += len(fps)
            elif len(fps) > 1 and (out := links(fps)) is not None:
                yield out
            if filled >= TILE:
                yield from flush()

        def flush():
            nonlocal small, filled
            if small and (out := links(np.concatenate(small))) is not None:
                yield out
            small, filled = [], 0

        for batch in batches:
            kind = np.asarray(batch.column(0))
            key = np.asarray(batch.column(1))
            fp = np.asarray(batch.column(2)).view(np.uint64)
            if not len(fp):
                continue
            new = np.nonzero((kind[1:] != kind[:-1]) | (key[1:] != key[:-1]))[0] + 1
            starts = np.concatenate([[0], new])
            ends = np.append(new, len(fp))
            single = (ends - starts == 1) & (starts > 0) & (ends < len(fp))  # alone in its bucket: no link
            for s, e in zip(starts[~single], ends[~single], strict=True):
                if (this := (int(kind[s]), int(key[s]))) != held_key:
                    yield from close()
                    held_key = this
                held.append(fp[s:e])
        yield from close()
        yield from flush()

    return buckets.select("mask", "key", "fp").mapInArrow(each, "a long, b long")


def links(nodes: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints whose transitive closure is that of all links within the radius.

    A bucket is a mask and the bits under it. One above ``hot`` nodes is dealt anew by each of radius + 1 blocks of the bits that
    its mask leaves free, one of which any link agrees in, and so on. With ``FREE`` free bits a bucket can't hold more than
    2 ** FREE fingerprints, so this ends after a few rounds with no bucket above both bounds.
    """
    assert radius < BLOCKS
    free = lambda m: [b for b in range(64) if not m >> b & 1]
    bucket = lambda m: F.struct(F.lit(_signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
    masks = _masks(list(range(64)), BLOCKS, BLOCKS - radius)
    keyed = nodes.select("fp", F.explode(F.array(*map(bucket, masks))).alias("k")).select("k.mask", "k.key", "fp")
    done = []
    while masks := [m for m in masks if len(free(m)) > FREE]:
        large = F.col("mask").isin([_signed(m) for m in masks])
        sizes = stored(keyed.filter(large).groupBy("mask", "key").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("mask", "key"), "hot-buckets")
        if sizes.isEmpty():
            break
        done.append(keyed.join(sizes, ["mask", "key"], "left_anti"))
        finer = {m: [m | x for x in _masks(free(m), radius + 1, 1)] for m in masks}
        anew = F.coalesce(*[F.when(F.col("mask") == _signed(m), F.array(*map(bucket, f))) for m, f in finer.items()])
        keyed = stored(keyed.join(sizes, ["mask", "key"], "left_semi").select("fp", F.explode(anew).alias("k")).select("k.mask", "k.key", "fp").distinct(), "dealt")
        masks = sorted({m for f in finer.values() for m in f})
    for d in done:
        keyed = keyed.unionByName(d)
    return _linked(keyed.repartition("mask", "key").sortWithinPartitions("mask", "key"), radius)


def _told(rows: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The rows (doc_id, fp) with component_id, the least doc_id that their node's edges reach."""
    roots = components(edges)
    linked = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of = linked.select("fp", "root").join(named, "root").select("fp", "component_id")
    return rows.join(stored(of, "components"), "fp")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, hot: int = HOT) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id."""
    rows = stored(fingerprints(docs, shingle), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    out = _told(rows, nodes, links(nodes, radius, hot))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_set(text: str, shingle: int = COPY_SHINGLE) -> np.ndarray:
    """The distinct hashes of the text's word shingles, sorted."""
    return np.unique(shingle_hashes(text.encode().translate(LOWER).split(), shingle))


def _node(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes(), SEED)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64), pa.int64()))


def frequent_shingles(docs: DataFrame, shingle: int, sample: int = SAMPLE, most: int = FREQUENT) -> np.ndarray:
    """Shingles of several texts in the sample, the rarer first."""

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, shingle) for t in texts(b)]
        return pa.RecordBatch.from_pydict({"h": pa.array((np.concatenate(sets) if sets else np.empty(0, np.uint64)).view(np.int64), pa.int64())})

    some = docs.select("text").filter(F.xxhash64("text") % sample == 0)
    counted = map_rows(some, work, "h long", 64).groupBy("h").agg(F.count("*").alias("n")).filter("n > 3")
    top = counted.orderBy(F.desc("n"), "h").limit(most).collect()
    return np.array([r.h for r in reversed(top)], np.int64).view(np.uint64)


def prefixes(docs: DataFrame, shingle: int, similar: tuple[int, int], frequent: np.ndarray) -> DataFrame:
    """Per row: doc_id, fp (the set's node), its size and fingerprint ``bits``, and the prefix that a similar set must share a shingle with."""
    num, den = similar
    order = np.argsort(frequent)
    known = frequent[order]

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        nodes, sizes, bits, heads = [], [], [], []
        for t in texts(b):
            h = shingle_set(t, shingle)
            n = len(h)
            nodes.append(_node(h))
            sizes.append(n)
            bits.append(majority(h))
            if len(known):
                k = np.minimum(np.searchsorted(known, h), len(known) - 1)
                h = h[np.argsort(np.where(known[k] == h, order[k] + 1, 0), kind="stable")]
            heads.append(h[: n - -(-num * n // den) + 1])
        signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64), pa.int64())
        return pa.RecordBatch.from_pydict({"doc_id": b.column(0), "fp": signed(nodes), "size": pa.array(sizes, pa.int64()), "bits": signed(bits), "prefix": _lists(heads)})

    rows = docs.select("doc_id", "text")
    return map_rows(rows, work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long, size long, bits long, prefix array<long>")


def shared_shingles(nodes: DataFrame) -> DataFrame:
    """(h, fp, size, bits, at, n): prefix shingles that n nodes have, n > 1, and their places."""
    keyed = nodes.select("fp", "size", "bits", F.posexplode("prefix").alias("at", "h"))
    counts = keyed.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").withColumn("_n", F.col("n"))
    found = hot_join(keyed, stored(counts, "shingle-counts"), "h", keyed.count())
    return stored(found.filter("_n IS NOT NULL").withColumnRenamed("_n", "n"), "shared-shingles")


def _enough(common: Column, size_a: Column, size_b: Column, similar: tuple[int, int]) -> Column:
    num, den = similar
    return common * (num + den) >= num * (size_a + size_b)


def proposed(nodes: DataFrame, shared: DataFrame, radius: int, similar: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of nodes that are likely links; three for each node at most."""
    num, den = similar
    one = nodes.groupBy("bits").agg(F.min("fp").alias("first"))
    same = nodes.join(one, "bits").select(F.col("fp").alias("a"), F.col("first").alias("b"))
    forest_ = links(one.select(F.col("bits").alias("fp")), radius)
    firsts = [one.select(F.col("bits").alias(x), F.col("first").alias(f"_{x}")) for x in "ab"]
    sliced = forest_.join(firsts[0], "a").join(firsts[1], "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))

    # A text from which others were edited has few shingles that nobody shares; such a node leads, or one by chance.
    own = shared.groupBy("fp").agg(F.count("*").alias("_shared"))
    lone = shared.join(nodes.join(own, "fp").select("fp", (F.size("prefix") - F.col("_shared")).alias("lone")), "fp")
    node = F.struct("fp", "size", "bits")
    leaders = lone.groupBy("h").agg(F.min(F.struct("lone", F.xxhash64("fp").alias("by"), node.alias("node")))["node"].alias("base"), F.min(F.struct(F.xxhash64("fp").alias("by"), node.alias("node")))["node"].alias("any"), F.count("*").alias("n"))
    met = hot_join(shared.drop("n"), stored(leaders, "leaders"), "h", shared.count())
    met = met.select("fp", "size", "bits", F.posexplode(F.array("base", "any")).alias("kind", "x"))
    far = F.bit_count(F.col("bits").bitwiseXOR(F.col("x.bits")))
    fits = (F.col("fp") != F.col("x.fp")) & (den * F.least("size", F.col("x.size")) >= num * F.greatest("size", F.col("x.size")))
    nearest = met.filter(fits & (far <= NEAR)).groupBy("fp", "kind").agg(F.min(F.struct(far.alias("far"), F.col("x.fp").alias("to"))).alias("best"))
    led = nearest.select(F.col("fp").alias("a"), F.col("best.to").alias("b"))
    every = same.unionByName(sliced).unionByName(led).filter("a <> b")
    return stored(every.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "proposed")


def meetings(open_: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """(a, b), each size and fp: nodes of different components that meet at a shingle which may be the first that both sets share.

    Behind the first one only so much is left of either set; where that is too little the two aren't similar, or have met before.
    The smaller set has it in the front part of its prefix, so two nodes that both have a shingle farther behind never meet there:
    a passage that many texts share, and which the order puts last, makes no rows.
    """
    num, den = similar
    front = F.col("at") * (num + den) <= F.col("size") * (den - num)
    side = lambda rows, x, kinds: rows.select("h", kinds.alias("kind"), F.struct("size", "fp", "at").alias(x), F.col("root").alias(f"root_{x}"), (F.col("root") == F.col("main")).alias(f"main_{x}"))
    few = side(open_.filter("root <> main"), "x", F.when(front, 0).otherwise(1))
    every = side(open_, "y", F.explode(F.when(front, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    left = 1 + F.least(F.col("x.size") - 1 - F.col("x.at"), F.col("y.size") - 1 - F.col("y.at"))
    fits = (den * F.least("x.size", "y.size") >= num * F.greatest("x.size", "y.size")) & _enough(left, F.col("x.size"), F.col("y.size"), similar)
    met = few.join(every.hint("merge"), ["h", "kind"]).filter((F.col("root_x") != F.col("root_y")) & (F.col("main_y") | (F.col("x.fp") < F.col("y.fp"))) & fits)
    node = lambda x: F.struct(f"{x}.fp", f"{x}.size")
    return met.select(F.least(node("x"), node("y")).alias("a"), F.greatest(node("x"), node("y")).alias("b")).distinct()


def remaining(shared: DataFrame, linked: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of nodes of different components that may be similar: no link between components is missing here."""
    num, den = similar
    rooted = shared.drop("n").join(linked.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = stored(rooted, "rooted")
    of_root = rooted.groupBy("h", "root").agg(F.count("*").alias("n"))
    main = of_root.groupBy("h").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), F.count("*").alias("roots")).filter("roots > 1").drop("roots")
    open_ = stored(hot_join(rooted, stored(main, "main-roots"), "h", rooted.count()).filter("main IS NOT NULL"), "open-shingles")
    pairs = stored(meetings(open_, similar), "meetings")
    # All that both prefixes share: of shingles that one node has alone nothing is needed.
    asked = pairs.select(F.explode(F.array("a.fp", "b.fp")).alias("fp")).distinct()
    own = open_.join(asked, "fp", "left_semi").groupBy("fp").agg(F.array_sort(F.collect_list(F.struct("at", "h"))).alias("own"))
    own = stored(own, "candidate-prefixes")
    told = pairs.select("a.fp", "a", "b").join(own.withColumnRenamed("own", "_a").hint("merge"), "fp").select(F.col("b.fp"), "a", "b", "_a")
    told = told.join(own.withColumnRenamed("own", "_b").hint("merge"), "fp").withColumn("common", F.array_intersect("_a.h", "_b.h"))
    last = lambda x: F.element_at(F.col(f"{x}.at"), F.array_position(F.col(f"{x}.h"), F.element_at("common", -1)).cast("int"))
    common = told.select("a", "b", F.size("common").alias("n"), last("_a").alias("at_a"), last("_b").alias("at_b"))
    # What both sets can share at most: the common shingles that both prefixes show, and none between the last of them and the
    # end of the prefix that ends first; the rest of one set is what lies behind its prefix.
    behind = F.least(F.col("a.size") - 1 - F.col("at_a"), F.col("b.size") - 1 - F.col("at_b"))
    rest = lambda c: F.expr(f"({c} * {num} + {den - 1}) div {den} - 1")
    most = F.col("n") + F.least(behind, F.greatest(rest("a.size"), rest("b.size")))
    return stored(common.filter(_enough(most, F.col("a.size"), F.col("b.size"), similar)).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")), "remaining")


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, shingle: int, similar: tuple[int, int]) -> DataFrame:
    """The pairs whose sets are similar. Only texts that a filter of bounded size takes for candidates move."""

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, shingle) for t in texts(b)]
        return pa.RecordBatch.from_pydict({"fp": pa.array(np.array([_node(h) for h in sets], np.uint64).view(np.int64), pa.int64()), "hashes": _lists(sets)})

    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "candidate-nodes")
    ids = stored(nodes.join(wanted, "fp", "left_semi").select(F.col("least").alias("_one")).distinct(), "candidate-documents")
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    maybe, _ = key_filter.split(docs.select("doc_id", "text"), key("doc_id"), key_filter.build(ids, key("_one")))
    chosen = maybe.join(ids.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_one")), "left_semi")
    sets = stored(map_rows(chosen.select("doc_id", "text"), work, "fp long, hashes array<long>", 64).join(wanted, "fp", "left_semi").dropDuplicates(["fp"]), "sets")
    left, right = (sets.select(F.col("fp").alias(x), F.col("hashes").alias(f"_{x}")).hint("merge") for x in "ab")
    both = pairs.join(left, "a").join(right, "b")
    return stored(both.filter(_enough(F.size(F.array_intersect("_a", "_b")), F.size("_a"), F.size("_b"), similar)).select("a", "b"), "similar")


def near_copies(docs: DataFrame, shingle: int = COPY_SHINGLE, similar: tuple[int, int] = SIMILAR, radius: int = RADIUS) -> DataFrame:
    """Per row: doc_id, component_id: the least doc_id that chains of texts with similar shingle sets reach."""
    signed = stored(prefixes(docs, shingle, similar, frequent_shingles(docs, shingle)), "prefixes")
    first = lambda c: F.any_value(c).alias(c)
    nodes = stored(signed.groupBy("fp").agg(F.min("doc_id").alias("least"), first("size"), first("bits"), first("prefix")), "nodes")
    shared = shared_shingles(nodes)
    some = verified(docs, nodes, proposed(nodes, shared, radius, similar), shingle, similar)
    rest = verified(docs, nodes, remaining(shared, components(some), similar), shingle, similar)
    return _told(signed.select("doc_id", "fp"), nodes.select("fp", "least"), some.unionByName(rest)).select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, shingle: int = COPY_SHINGLE, similar: tuple[int, int] = SIMILAR, radius: int = RADIUS) -> DataFrame:
    """The input's rows without the documents whose component has a smaller doc_id; all columns stay as they are.

    A doc_id that several rows share is dropped only if all of them are; a null doc_id always stays. Only rows whose doc_id the
    filter of dropped ones knows move.
    """
    said = near_copies(docs, shingle, similar, radius)
    gone = stored(said.groupBy("doc_id").agg(F.min(F.col("doc_id") != F.col("component_id")).alias("gone")).filter("gone").select(F.col("doc_id").alias("_gone")), "near-copies")
    known = key_filter.build(gone, F.col("_gone"))
    maybe, alone = key_filter.split(docs.select(F.struct("*").alias("_row"), docs["doc_id"].alias("_id")), F.col("_id"), known)
    kept = maybe.join(gone.hint("merge"), F.col("_id") == F.col("_gone"), "left_anti")
    return alone.select("_row.*").unionByName(kept.select("_row.*"))
