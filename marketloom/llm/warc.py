"""WARC archives: writing with revisits, and reading with segment reassembly (operator 1).

**Writing.** Payload digests decide first, on narrow rows, which page of equal payloads is the response. Then each task streams
its pages into gzip-per-record archives in the shared folder: HTTP responses in chunked framing, cut into continuation
records above ``SEGMENT`` bytes of block; copies become revisit records. Files are written under a name of the attempt and
renamed when whole, so a task that runs again writes the same file.

**Reading.** Each task streams whole archives. Records in one piece are decoded where they are read, and stay there. Segments are
dealt by their origin identifier, sorted by segment number and put together one origin at a time; number gaps and totals that
don't match become errors. Then the chunked transfer framing is taken off and the payload digested. Revisits take length and
digest of their payload from the response that they refer to; one without its response is an error. A record that can't be
read becomes a row with an error, and reading goes on with the next gzip member.

Defined results: null html is an empty payload, null urls an empty target; repeated rows give a record each; of equal payloads
the smallest page_id is the response (rows that repeat that page_id are responses too); a null page_id counts as larger than any;
an empty table gives an empty table; other columns are not read; payloads of any length are read whole. A response's record id
holds page and payload digest, which is what revisits refer to; rows that repeat both have a number of their own behind it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import key_filter
from .common import bounded_batches, hot_join, scratch, stored

LEAST = 100
SEGMENT = 32 * 1024
CHUNK = 8 * 1024
ROLL = 1 << 30
#: The most bytes of a record's head.
MOST_HEAD = 1 << 20
END = b"\r\n\r\n"


# ---------------------------------------------------------------------------------------------------- records


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + END


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing."""
    parts = [b"%x\r\n%s\r\n" % (len(c), c) for c in (payload[k : k + size] for k in range(0, len(payload), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload in chunked framing; chunk extensions and trailers are passed over. Raises ValueError if it is cut short."""
    out, at = [], 0
    while True:
        eol = body.find(b"\r\n", at)
        if eol < 0:
            raise ValueError("a chunk has no size line")
        size = int(body[at:eol].split(b";", 1)[0].strip(), 16)
        at = eol + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """The payload of an application/http block."""
    end = block.find(END)
    if end < 0:
        raise ValueError("the HTTP head is cut short")
    head, body = block[:end].lower(), block[end + 4 :]
    return unchunked(body) if b"transfer-encoding: chunked" in head else body


def header_safe(s: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in s or "")


def record_id(page_id, digest: str, copy: str = "") -> str:
    return f"<urn:marketloom:page:{'' if page_id is None else page_id}:{digest}{copy and ':' + copy}>"


def records_of(page_id, url: str | None, payload: bytes, digest: str, refers, name: str, copy: bool = False, segment: int = SEGMENT) -> Iterator[bytes]:
    """The WARC records of one page: a response with its continuations, or a revisit. ``name`` is unique in the archive."""
    own = record_id(page_id, digest, name if copy else "")
    base = [("WARC-Record-ID", own), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", header_safe(url)), ("WARC-Payload-Digest", f"sha256:{digest}")]
    http = ("Content-Type", "application/http; msgtype=response")
    if refers is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        yield record([("WARC-Type", "revisit"), *base, profile, ("WARC-Refers-To", record_id(refers, digest)), http], block)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment:
        yield record([("WARC-Type", "response"), *base, http], block)
        return
    yield record([("WARC-Type", "response"), *base, http, ("WARC-Segment-Number", "1")], block[:segment])
    for n, at in enumerate(range(segment, len(block), segment), 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if at + segment >= len(block) else []
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:marketloom:segment:{name}:{n}>"), base[1], base[2], ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(n)), *last], block[at : at + segment])


class _Members:
    """Bytes of a gzip file of many members, read piece by piece."""

    def __init__(self, stream, size: int = 1 << 20):
        self.stream, self.size, self.rest, self.z = stream, size, b"", None
        self.whole = True  # whether a member has just ended

    def read(self) -> bytes:
        """Some more bytes, of one member; none at the end."""
        while True:
            raw = self.rest or self.stream.read(self.size)
            if not raw:
                if self.z is not None:
                    self.z = None
                    raise ValueError("a gzip member is cut short")
                return b""
            if self.z is None:
                self.z = zlib.decompressobj(31)
            try:
                out = self.z.decompress(raw)
            except zlib.error as e:
                # what follows may hold the head of another member
                self.rest, self.z = raw[1:], None
                self.rest = self.rest[max(0, self.rest.find(b"\x1f\x8b\x08")) :] if b"\x1f\x8b\x08" in self.rest else b""
                self.whole = True
                raise ValueError(f"not a gzip member: {e}") from e
            self.rest = self.z.unused_data
            self.whole = self.z.eof
            if self.z.eof:
                self.z = None
            if out:
                return out

    def skip(self) -> None:
        """Pass over the rest of the member."""
        while not self.whole and self.read():
            pass


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a .warc.gz stream; header names in lower case.

    What can't be read gives ({"error": why}, b""), and reading goes on behind the gzip member that it stands in.
    """
    members, held = _Members(stream), bytearray()

    def fill(least: int) -> bool:
        while len(held) < least:
            more = members.read()
            if not more:
                return False
            held.extend(more)
        return True

    def one() -> tuple[dict[str, str], bytes] | None:
        if not fill(1):
            return None
        end, seen = -1, 0
        while (end := held.find(END, max(0, seen - 3))) < 0:
            seen = len(held)
            if seen >= 5 and not held.startswith(b"WARC/") or seen > MOST_HEAD or not fill(seen + 1):
                raise ValueError("a WARC head is cut short")
        lines = bytes(held[:end]).decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = headers.get("content-length", "")
        if not size.isdecimal():
            raise ValueError("a WARC record has no length")
        n = int(size)
        if not fill(end + 4 + n + 4):
            raise ValueError("a WARC block is cut short")
        block = bytes(held[end + 4 : end + 4 + n])
        del held[: end + 4 + n + 4]
        headers.pop("error", None)
        return headers, block

    while True:
        try:
            got = one()
        except ValueError as e:
            yield {"error": str(e)}, b""
            held.clear()
            while True:
                try:
                    members.skip()
                    break
                except ValueError:
                    continue
            continue
        if got is None:
            return
        yield got


# ---------------------------------------------------------------------------------------------------- writing


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


def _body() -> Column:
    return F.coalesce(F.col("html"), F.lit("")).cast("binary")


def shared_payloads(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(digest, first, n): digests that several pages of ``least`` bytes or more share, and their smallest page_id."""
    narrow = pages.select("page_id", F.unhex(F.sha2(_body(), 256)).alias("digest"), F.length(_body()).alias("size")).filter(F.col("size") >= least)
    return stored(narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1"), "shared-payloads")


def repeats(pages: DataFrame) -> DataFrame:
    """(page_id, digest, n) of several rows."""
    narrow = pages.select("page_id", F.unhex(F.sha2(_body(), 256)).alias("digest"))
    return narrow.groupBy("page_id", "digest").agg(F.count("*").alias("n")).filter("n > 1")


def write_archives(pages: DataFrame, to: str, segment: int = SEGMENT, least: int = LEAST) -> DataFrame:
    """Write one record per page below ``to``; returns the manifest (path, records, bytes).

    Pages whose payload nobody shares are written by the task that scans them; a filter of bounded size tells which these are.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), _body().alias("body")).withColumn("digest", F.unhex(F.sha2("body", 256)))
    shared, twice = shared_payloads(pages, least), stored(repeats(pages), "repeats")
    maybe, alone = key_filter.split(rows, F.col("digest"), key_filter.build(shared, F.col("digest")))
    rows = hot_join(maybe, shared, "digest", pages.count()).unionByName(alone.withColumn("first", F.lit(None).cast(pages.schema["page_id"].dataType)))
    refers = F.when((F.length("body") >= least) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    rows = rows.select("page_id", "url", "body", "digest", refers.alias("refers"), F.lit(False).alias("copy"))
    if not twice.isEmpty():
        key = lambda: F.struct(F.coalesce(F.col("page_id").cast("string"), F.lit("")), "digest")
        maybe, once = key_filter.split(rows, key(), key_filter.build(twice, key()))
        many = twice.select(key().alias("_key"), "n", F.lit(True).alias("copy"))
        found = hot_join(maybe.drop("copy").withColumn("_key", key()), many, "_key", pages.count()).drop("_key").withColumn("copy", F.coalesce("copy", F.lit(False)))
        rows = once.unionByName(found)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fs, folder = _place(to)
        fs.create_dir(folder, recursive=True)
        done: list[tuple[str, int, int]] = []
        stream, n, size = None, 0, 0
        draft = ""

        def close() -> None:
            nonlocal stream, n, size
            if stream is not None:
                stream.close()
                name = f"part-{context.partitionId():06d}-{len(done):04d}.warc.gz"
                fs.move(draft, f"{folder}/{name}")
                done.append((f"{to}/{name}", n, size))
            stream, n, size = None, 0, 0

        seen = 0
        for b in batches:
            for k in range(b.num_rows):
                page_id, url, payload, digest, refers_to, copy = (b.column(c)[k].as_py() for c in range(6))
                if stream is None:
                    draft = f"{folder}/.draft-{context.partitionId()}-{context.taskAttemptId()}-{len(done)}"
                    stream = fs.open_output_stream(draft, compression=None)
                seen += 1
                for r in records_of(page_id, url, payload, digest.hex(), refers_to, f"{context.partitionId()}-{seen}", copy, segment):
                    z = zlib.compressobj(1, zlib.DEFLATED, 31)
                    data = z.compress(r) + z.flush()
                    stream.write(data)
                    size += len(data)
                n += 1
                if size >= ROLL:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    return stored(bounded_batches(rows).mapInArrow(each, "path string, records long, bytes long"), "manifest")


# ---------------------------------------------------------------------------------------------------- reading

READ = "page string, target string, kind string, refers string, payload_digest string, payload_bytes long, origin string, key string, number int, total long, block binary, error string"
_READ = pa.schema([(c, {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[t]) for c, t in (x.split() for x in READ.split(", "))])
BATCH_BYTES = 8 << 20


def _known(own: str) -> tuple[str | None, str | None]:
    """The page that a record id names, and the id without the number that tells repeated rows apart."""
    part = own.strip("<>").split(":")
    return (part[3] or None, ":".join(part[:5])) if part[:3] == ["urn", "marketloom", "page"] and len(part) > 4 else (None, None)


def _decoded(row: dict, block: bytes, claimed: str | None) -> dict:
    try:
        payload = payload_of(block)
    except ValueError as e:
        return row | {"error": str(e)}
    digest = hashlib.sha256(payload).hexdigest()
    wrong = "the payload digest differs" if claimed and claimed != digest else None
    return row | {"payload_digest": digest, "payload_bytes": len(payload), "error": wrong}


def _row(headers: dict[str, str], block: bytes) -> dict:
    """What one record says: a whole record's result, a segment to be put together, or what is wrong with it."""
    if "error" in headers:
        return {"error": headers["error"]}
    kind, own = headers.get("warc-type", ""), headers.get("warc-record-id", "")
    claimed = headers.get("warc-payload-digest", "").removeprefix("sha256:") or None
    number, total = headers.get("warc-segment-number"), headers.get("warc-segment-total-length")
    page, key = _known(own)
    row = {"page": page, "target": headers.get("warc-target-uri"), "kind": kind, "origin": own, "key": key}
    if any(x is not None and not (x.isdecimal() and len(x) < 18) for x in (number, total)) or number is not None and int(number) >= 1 << 31:
        return row | {"error": "a segment's number or total length is no number"}
    if kind == "continuation":
        if number is None or "warc-segment-origin-id" not in headers:
            return row | {"error": "a continuation lacks its number or origin"}
        return row | {"origin": headers["warc-segment-origin-id"], "number": int(number), "total": total and int(total), "block": block}
    if number is not None:
        return row | {"number": int(number), "payload_digest": claimed, "block": block}
    if kind == "revisit":
        refers, key = _known(headers.get("warc-refers-to", ""))
        return row | {"refers": refers, "key": key, "payload_digest": claimed}
    return _decoded(row, block, claimed)


def _batches(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 500 + len(r.get("block") or b"")
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, _READ)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, _READ)


def read_archives(manifest: DataFrame) -> DataFrame:
    """Records of the archives whose paths the manifest holds; segments are still apart."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for path in b.column(0).to_pylist():
                    fs, name = _place(path)
                    with fs.open_input_stream(name, compression=None, buffer_size=1 << 20) as stream:
                        for headers, block in read_records(stream):
                            yield _row(headers, block)

        yield from _batches(rows())

    files = manifest.select("path")
    return files.repartition(max(1, files.count())).mapInArrow(each, READ)


def reassemble(segments: DataFrame) -> DataFrame:
    """One row per origin: its segments are put together in order, verified, and their payload decoded."""

    def whole(parts: list[dict]) -> dict:
        first = parts[0]
        row = first | {"block": None, "number": None, "total": None}
        if [p["number"] for p in parts] != list(range(1, len(parts) + 1)):
            return row | {"payload_digest": None, "error": "segments are missing or repeated"}
        block = b"".join(p["block"] for p in parts)
        if first["kind"] == "continuation":
            return row | {"payload_digest": None, "error": "the first segment is no record of its own"}
        total = parts[-1]["total"]
        if total != len(block):
            return row | {"payload_digest": None, "error": f"segments have {len(block)} bytes, {total} are due"}
        return _decoded(row, block, first["payload_digest"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            held: list[dict] = []
            for b in batches:
                for r in b.to_pylist():
                    if held and r["origin"] != held[0]["origin"]:
                        yield whole(held)
                        held = []
                    held.append(r)
            if held:
                yield whole(held)

        yield from _batches(rows())

    return bounded_batches(segments).repartition("origin").sortWithinPartitions("origin", "number").mapInArrow(each, READ)


def resolve(records: DataFrame) -> DataFrame:
    """Records with the payload of revisits taken from the response that they refer to."""
    visits, others = records.filter("kind = 'revisit' AND error IS NULL"), records.filter("NOT (kind <=> 'revisit' AND error IS NULL)")
    wanted = visits.filter("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n"))
    there = others.filter("kind = 'response' AND error IS NULL").groupBy("key").agg(F.max("payload_digest").alias("own_digest"), F.max("payload_bytes").alias("own_bytes"))
    found = stored(wanted.join(there, "key"), "responses")
    visits = hot_join(visits, found, "key", visits.count())
    error = F.when(F.col("own_digest").isNull(), "the response that is referred to is missing").when(F.col("payload_digest") != F.col("own_digest"), "the payload digest differs from the response's")
    visits = visits.withColumns({"payload_digest": F.col("own_digest"), "payload_bytes": F.col("own_bytes"), "error": error})
    return others.unionByName(visits.select(others.columns))


def read_pages(manifest: DataFrame) -> DataFrame:
    """One row per record of the archives, segments put together and revisits resolved."""
    read = stored(read_archives(manifest), "records")
    joined = reassemble(read.filter("number IS NOT NULL"))
    return resolve(stored(read.filter("number IS NULL").unionByName(joined).drop("block", "number", "total", "target", "origin"), "whole-records"))


def round_trip(pages: DataFrame, segment: int = SEGMENT, least: int = LEAST) -> DataFrame:
    """Write all pages as archives, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to, error."""
    spark: SparkSession = pages.sparkSession
    manifest = write_archives(pages, scratch(spark, "warc"), segment, least)
    kind = pages.schema["page_id"].dataType.simpleString()
    return read_pages(manifest).select(
        F.col("page").cast(kind).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("kind").alias("record_type"),
        F.col("refers").cast(kind).alias("refers_to"),
        "error",
    )
