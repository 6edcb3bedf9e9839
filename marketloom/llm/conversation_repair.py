"""Conversation structure repair by shortest paths in a bucket queue (operator 13).

A repaired conversation's role initials read ``(s?(ua)+)?``. Rows are kept (0), given the role that is due (1), deleted (2; required
for blank and repeated rows), or an empty row is inserted (5); a truncated row that isn't deleted costs 5 more.

**Graph.** A node is a place between rows and a state of the pattern's automaton: nothing yet, after s, after u, after a. Each edit
is an arc. The state decides which role is due, so an edit's initial decides where it leads, and no two paths share an audit.

**Dial's queue.** Costs are small integers. Distances to the goal are found backwards from the end with one bucket per distance,
emptied from the least on. Then the path is walked forwards over tight arcs (cost + distance behind = distance before), at each
node along the one whose initial is least: the least audit of the cheapest ones.

**Long conversations.** Rows are sorted once, by range, over all tasks, so a hot conversation spreads over many. A task cuts its
rows into segments of at most ``SEGMENT`` rows of one conversation. A segment that neither begins nor ends a task's rows, nor was cut by
length, is a whole conversation and is repaired at once. Of the others only a summary travels: distances from each state before
it to each state behind it. One ordered pass adds these up from the end, each segment then walks from each of the four states
it may be entered in, one ordered pass picks which, and the pieces of audit and text follow one another. The passes stream and carry
four numbers; what was said before is found by grouping digests, with partial sums. Rows are never gathered by conversation. Only the
digest of a long conversation's whole text is worked out in one task, as a stream, because SHA-256 has no other way.

Defined results: a null role or text is one blank; rows are ordered by turn (null first), then role and text, and a repeated row
stands beside its source; null conv_ids are one conversation; a conversation without rows left has zeros and empty texts; other
columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import bounded_batches, stored

#: The most rows of a segment, and the code points after which it ends.
SEGMENT, SEGMENT_CHARS = 4096, 1 << 20
SPACES = " \t\n\x0b\x0c\r"
ENDS = ".!?"
#: States: nothing yet, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: The role that is due in each state, and where it leads.
DUE = ("user", "user", "assistant", "user")
NEXT = (USER, USER, ASSISTANT, USER)
GOALS = {START: 0, ASSISTANT: 0}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
LEGAL = {"su", "ua", "au"}


def accepts(state: int, initial: str) -> int | None:
    """Where a row of that initial leads, if it may stand there."""
    if initial == "s" and state == START:
        return SYSTEM
    return NEXT[state] if initial == DUE[state][0] else None


@dataclass
class Row:
    turn: int | None
    role: str
    text: str
    fault: str = ""  # blank, duplicate, truncated or none

    @property
    def gone(self) -> bool:
        return self.fault in ("blank", "duplicate")

    def arcs(self, state: int) -> Iterator[tuple[str, int, int]]:
        """(edit, cost, state behind the row) of the edits that use the row up, in the order of their initials."""
        yield "D", DELETE, state
        if not self.gone:
            more = TRUNCATED if self.fault == "truncated" else 0
            to = accepts(state, self.role[:1])
            if to is not None:
                yield "K", KEEP + more, to
            yield "R", REROLE + more, NEXT[state]


def distances(rows: list[Row], behind: dict[int, int]) -> list[list[int | None]]:
    """The distance from each place and state to the goal, where ``behind`` has the distances of the states behind the last row."""
    n = len(rows)
    into: list[list[list[tuple[int, int]]]] = [[[] for _ in STATES] for _ in range(n + 1)]  # arcs backwards: (cost, state before)
    for k, row in enumerate(rows):
        for state in STATES:
            for _, cost, to in row.arcs(state):
                into[k + 1][to].append((cost, state))
    least: list[list[int | None]] = [[None] * 4 for _ in range(n + 1)]
    base = min(behind.values())
    buckets: list[list[tuple[int, int]]] = [[] for _ in range(max(behind.values()) - base + 1)]
    for state, d in behind.items():
        buckets[d - base].append((n, state))
    d = 0
    while d < len(buckets):
        for place, state in buckets[d]:  # arcs of no cost add to the bucket that is being emptied
            if least[place][state] is None:
                least[place][state] = base + d
                before = [(cost, place - 1, s) for cost, s in into[place][state]] if place else []
                before += [(INSERT, place, s) for s in STATES if NEXT[s] == state]
                for cost, at, s in before:
                    if least[at][s] is None:
                        while len(buckets) <= d + cost:
                            buckets.append([])
                        buckets[d + cost].append((at, s))
        buckets[d] = []
        d += 1
    return least


def walk(rows: list[Row], least: list[list[int | None]], state: int, last: bool = True) -> tuple[str, list[tuple[str, str]], int]:
    """(audit, repaired rows, state behind) of the cheapest path from a state, along tight arcs in the order of their initials.

    Insertions behind the last row belong to what follows it, if anything does.
    """
    audit, out, place = [], [], 0
    while place < len(rows) or last and least[place][state]:
        d = least[place][state]
        arcs = [(e, c, place + 1, to) for e, c, to in rows[place].arcs(state)] if place < len(rows) else []
        arcs.append(("I", INSERT, place, NEXT[state]))
        edit, _, at, to = min(a for a in arcs if least[a[2]][a[3]] is not None and a[1] + least[a[2]][a[3]] == d)
        if edit == "K":
            out.append((rows[place].role, rows[place].text))
        elif edit != "D":
            out.append((DUE[state], rows[place].text if edit == "R" else ""))
        audit.append(edit)
        place, state = at, to
    return "".join(audit), out, state


def faulted(rows: list[tuple], firsts: set[int] | None = None) -> list[Row]:
    """Rows (turn, role, text) with their first fault; ``firsts``: the places of rows that nothing said before, where that is known."""
    out, seen = [], set()
    for k, (turn, role, text) in enumerate(rows):
        said = text.rstrip(SPACES)
        new = (role, text) not in seen if firsts is None else k in firsts
        seen.add((role, text))
        out.append(Row(turn, role, text, "blank" if not said else "duplicate" if not new else "truncated" if said[-1] not in ENDS else ""))
    return out


STATS = "blank long, duplicate long, truncated long, illegal long, first string, last string, least_turn long, most_turn long, turns long"


def stats(rows: list[Row]) -> dict:
    """Counts of a segment, and what its neighbours must know of its ends."""
    turns = [r.turn for r in rows if r.turn is not None]
    faults, initials = [r.fault for r in rows], [r.role[:1] for r in rows]
    return {
        "blank": faults.count("blank"), "duplicate": faults.count("duplicate"), "truncated": faults.count("truncated"),
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
        "first": initials[0] if rows else None, "last": initials[-1] if rows else None,
        "least_turn": turns[0] if turns else None, "most_turn": turns[-1] if turns else None, "turns": len(set(turns)),
    }


def added(a: dict, b: dict) -> dict:
    """The counts of two segments that follow one another."""
    if b["first"] is None or a["first"] is None:
        return a if b["first"] is None else b
    out = {k: a[k] + b[k] for k in ("blank", "duplicate", "truncated", "illegal", "turns")}
    out["illegal"] += a["last"] + b["first"] not in LEGAL
    out["turns"] -= a["most_turn"] is not None and a["most_turn"] == b["least_turn"]
    first = a["least_turn"] if a["least_turn"] is not None else b["least_turn"]
    last = b["most_turn"] if b["most_turn"] is not None else a["most_turn"]
    return out | {"first": a["first"], "last": b["last"], "least_turn": first, "most_turn": last}


def gaps(s: dict) -> int:
    return 0 if s["least_turn"] is None else s["most_turn"] - s["least_turn"] + 1 - s["turns"]


def streamed(df: DataFrame, work: Callable[[Iterator[dict]], Iterator[dict]], schema: T.StructType, most: int = 256) -> DataFrame:
    """``mapInArrow`` of a generator over a partition's rows in their order, ``most`` results at a time."""
    arrow = to_arrow_schema(schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for at in range(0, b.num_rows, most) for r in b.slice(at, most).to_pylist())
        held: list[dict] = []
        for r in work(rows):
            held.append(r)
            if len(held) == most:
                yield pa.RecordBatch.from_pylist(held, arrow)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, arrow)

    return bounded_batches(df).mapInArrow(each, schema)


def _schema(conv: T.DataType, *parts: str) -> T.StructType:
    return T.StructType([T.StructField("conv_id", conv), *(f for p in parts for f in T._parse_datatype_string(p).fields)])


SAID, PIECE, ROWS = "gaps long, cost long", "audit string, repaired array<struct<role:string,text:string>>", "rows array<struct<turn:long,role:string,text:string>>"


def _said(out: list[tuple[str, str]]) -> list[dict]:
    return [{"role": r, "text": t} for r, t in out]


def segments(rows: DataFrame, most: int = SEGMENT) -> DataFrame:
    """Sorted rows (conv_id, turn, role, text, dropped) as whole conversations, repaired, and segments of others, with their rows."""

    def work(found: Iterator[dict]) -> Iterator[dict]:
        task, number, open_ = TaskContext.get().partitionId() << 33, 0, True

        def segment(conv, held: list[tuple], whole: bool) -> dict:
            nonlocal number
            number += 1
            out = {"conv_id": conv, "seg": task + number, "whole": whole}
            if not whole:
                return out | {"rows": [dict(zip(("turn", "role", "text"), h, strict=True)) for h in held]}
            told = faulted(held)
            least, s = distances(told, GOALS), stats(told)
            audit, repaired, _ = walk(told, least, START)
            return out | s | {"gaps": gaps(s), "cost": least[0][START], "audit": audit, "repaired": _said(repaired)}

        before: tuple | None = None  # the conversation that is to be given out once it's known whether others follow it in this task
        for conv, own in groupby(found, lambda r: r["conv_id"]):
            if before is not None:
                yield segment(*before, whole=not open_)
                open_ = False
            held: list[tuple] = []
            chars = 0
            for r in own:
                if len(held) == most or chars > SEGMENT_CHARS:
                    yield segment(conv, held, whole=False)
                    held, chars, open_ = [], 0, True
                if not r["dropped"]:
                    held.append((r["turn"], r["role"], r["text"]))
                    chars += len(r["text"])
            before = (conv, held)
        if before is not None:
            yield segment(*before, whole=False)

    return streamed(rows, work, _schema(rows.schema["conv_id"].dataType, "seg long, whole boolean", STATS, SAID, PIECE, ROWS))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text, dropped) after damage by crc32 of ``conv_id:turn``; dropped rows stay, marked."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    act = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = F.when(act == 1, "").when(act == 2, F.translate(blank("text"), ENDS, "")).otherwise(blank("text"))
    role = F.when(act == 4, "user").otherwise(blank("role"))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (act == 0).alias("dropped"), F.when(act == 3, 2).otherwise(1).alias("n"))
    return rows.select("conv_id", "turn", "role", "text", "dropped", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy")).drop("copy")


def ordered(rows: DataFrame) -> DataFrame:
    """Rows in the order of their conversations, dealt to tasks by range: a hot conversation or turn goes to many of them."""
    order = ["conv_id", "turn", "role", "text"]
    return rows.select(*order, "dropped").repartitionByRange(*order).sortWithinPartitions(*order)


def _behind(cut: DataFrame) -> DataFrame:
    """(seg, behind, tail, cost): of each segment the distances from each state behind it to the goal, whether it is the last, and
    the distance from the start. One pass from the end."""

    def work(found: Iterator[dict]) -> Iterator[dict]:
        for _, own in groupby(found, lambda r: r["conv_id"]):
            behind: list[int | None] = [GOALS.get(q) for q in STATES]
            for k, r in enumerate(own):
                m = r["through"]
                here = [min(m[4 * q + to] + behind[to] for to in STATES if m[4 * q + to] is not None and behind[to] is not None) for q in STATES]
                yield {"conv_id": r["conv_id"], "seg": r["seg"], "behind": behind, "tail": k == 0, "cost": here[START]}
                behind = here

    rows = cut.select("conv_id", "seg", "through").repartition("conv_id").sortWithinPartitions("conv_id", F.col("seg").desc())
    return streamed(rows, work, _schema(cut.schema["conv_id"].dataType, "seg long, behind array<long>, tail boolean, cost long"))


def _entered(exits: DataFrame) -> DataFrame:
    """(seg, state): in which state the path enters each segment. One pass from the start."""

    def work(found: Iterator[dict]) -> Iterator[dict]:
        for _, own in groupby(found, lambda r: r["conv_id"]):
            state = START
            for r in own:
                yield {"conv_id": r["conv_id"], "seg": r["seg"], "state": state}
                state = r["exits"][state]

    rows = exits.repartition("conv_id").sortWithinPartitions("conv_id", "seg")
    return streamed(rows, work, _schema(exits.schema["conv_id"].dataType, "seg long, state int"))


def _rows(r: dict) -> list[Row]:
    return faulted([(x["turn"], x["role"], x["text"]) for x in r["rows"]], set(r["firsts"] or ()))


def _least(r: dict) -> tuple[list[Row], list[list[int | None]]]:
    rows = _rows(r)
    return rows, distances(rows, {q: d for q, d in enumerate(r["behind"]) if d is not None})


def split_conversations(cut: DataFrame) -> DataFrame:
    """The segments (conv_id, seg, rows) of conversations, with counts, cost of the whole conversation, audit and repaired rows."""
    conv = cut.schema["conv_id"].dataType
    said = cut.select("conv_id", "seg", F.posexplode("rows").alias("pos", "r"))
    said = said.select("conv_id", F.sha2(F.concat(F.length("r.role").cast("string"), F.lit(":"), "r.role", "r.text"), 256).alias("said"), F.struct("seg", "pos").alias("at"))
    firsts = said.groupBy("conv_id", "said").agg(F.min("at").alias("at")).groupBy("at.seg").agg(F.collect_list("at.pos").alias("firsts"))
    known = stored(cut.select("conv_id", "seg", "rows").join(firsts, "seg", "left"), "segments")

    def summary(found: Iterator[dict]) -> Iterator[dict]:
        for r in found:
            rows = _rows(r)
            from_each = [distances(rows, {to: 0})[0] for to in STATES]
            yield {"conv_id": r["conv_id"], "seg": r["seg"], "through": [from_each[to][q] for q in STATES for to in STATES]} | stats(rows)

    summed = stored(streamed(known, summary, _schema(conv, "seg long, through array<long>", STATS)), "summaries")
    behind = stored(_behind(summed), "behind")
    held = known.join(behind.drop("conv_id"), "seg")

    def leave(found: Iterator[dict]) -> Iterator[dict]:
        for r in found:
            rows, least = _least(r)
            yield {"conv_id": r["conv_id"], "seg": r["seg"], "exits": [walk(rows, least, q, r["tail"])[2] for q in STATES]}

    entered = stored(_entered(stored(streamed(held, leave, _schema(conv, "seg long, exits array<int>")), "exits")), "entered")

    def mend(found: Iterator[dict]) -> Iterator[dict]:
        for r in found:
            audit, repaired, _ = walk(*_least(r), r["state"], r["tail"])
            yield {"conv_id": r["conv_id"], "seg": r["seg"], "cost": r["cost"], "audit": audit, "repaired": _said(repaired)}

    mended = streamed(held.join(entered.drop("conv_id"), "seg"), mend, _schema(conv, "seg long, cost long", PIECE), 16)
    return mended.join(summed.drop("conv_id", "through"), "seg")


def repair(rows: DataFrame, most: int = SEGMENT) -> DataFrame:
    """Pieces of repaired conversations: conv_id, seg (their order), whole, counts, gaps, cost, audit and the repaired rows.

    A whole conversation is one piece. Of others the counts are each piece's own, gaps are null, and cost is the whole path's.
    """
    cut = stored(segments(ordered(rows), most), "conversations")
    split = split_conversations(cut.filter("NOT whole"))
    return cut.filter("whole").drop("rows").unionByName(split, allowMissingColumns=True).withColumn("whole", F.coalesce("whole", F.lit(False)))


OUT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def digests(rows: DataFrame, most: int = SEGMENT) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    pieces = repair(rows, most)
    conv = rows.schema["conv_id"].dataType
    text = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    names = ["conv_id", *(f.name for f in T._parse_datatype_string(OUT).fields)]
    whole = pieces.filter("whole").withColumn("repaired_sha256", F.sha2(text, 256)).select(*names)

    def joined(found: Iterator[dict]) -> Iterator[dict]:
        for conv_id, own in groupby(found, lambda r: r["conv_id"]):
            sha, audit, total, cost, begun = hashlib.sha256(), [], None, None, False
            for r in own:
                total = r if total is None else added(total, r)
                cost = r["cost"] if cost is None else cost  # from the start of the first piece
                audit.append(r["audit"])
                if r["n"]:
                    sha.update(("\n" * begun + r["text"]).encode())
                    begun = True
            yield {"conv_id": conv_id, "gaps": gaps(total), "cost": cost, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()} | {k: total[k] for k in ("blank", "duplicate", "truncated", "illegal")}

    parts = pieces.filter("NOT whole").select("conv_id", "seg", *(f.name for f in T._parse_datatype_string(STATS).fields), "cost", "audit", F.size("repaired").alias("n"), text.alias("text"))
    parts = parts.repartition("conv_id").sortWithinPartitions("conv_id", "seg")
    return whole.unionByName(streamed(parts, joined, _schema(conv, OUT)).select(*names))
