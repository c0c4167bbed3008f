"""Conversation structure repair by a Viterbi search over the grammar (s?(ua)+)? of role initials.

A conversation's rows are walked in the order of their turns.  Each of the four
grammar states (nothing yet, after s, after u, after a) carries the cheapest
(cost, audit string) that reaches it; a row moves every state by its edits, and
the layer is closed by insertions, of which two in a row are all that can pay.
An audit's letters fix its cost, so of two different audits of equal cost none
is the other's beginning, and the least one can be kept state by state.

Rows are dealt out by ranges of (conversation, turn), so that a conversation of
any length is spread over tasks.  What lies inside a task's range is finished
there.  Of a conversation that is cut, by a range's end or by its length, each
piece gives the cheapest way from every state to every other; a second search
over the pieces picks the ways, and the repaired text is hashed piece by piece.
A SHA-256 is one chain: only that reads a whole conversation in one task, as a
stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from timbral.llm.shared import shuffle_width, stored

# White space, sentence ends, the costs of edits.
BLANKS, ENDS = "\x20\x09\x0a\x0b\x0c\x0d", ".!?"
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a role's initial leads from each state, and the role that a row or an insertion can be given there.
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
GIVEN = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
#: Insertions that end a conversation in each state.
CLOSING = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
LEGAL = {"su", "ua", "au"}
#: A piece has so many rows or so many characters at most (a longer single row is a piece).
PIECE_ROWS, PIECE_CHARS = 1024, 1 << 20

Layer = dict[int, tuple[int, str]]


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage by crc32('conv_id:turn') % 20, and dropped, which marks the rows that damage takes out.

    Nulls are one space.  0 drops a row, 1 empties its text, 2 removes its
    sentence ends, 3 repeats it, 4 makes it the user's.
    """
    blank = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    role = F.when(kind == 4, F.lit("user")).otherwise(blank("role"))
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(blank("text"), ENDS, "")).otherwise(blank("text"))
    gone = kind == 0
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(~gone, role).alias("role"), F.when(~gone, text).alias("text"), gone.alias("dropped"), copies.alias("_copy")).drop("_copy")


def ordered(rows: DataFrame) -> DataFrame:
    """rows dealt out by ranges of (conv_id, turn, digest) and sorted, with repeated: an earlier turn, or the row before, has the same role and text.

    Rows of one turn come in the order of the digest of role and text.  Which
    texts a conversation repeats is found on digests alone.
    """
    sort = ["conv_id", "turn", "digest"]
    key: Column = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    rows = rows.withColumn("digest", key)
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    again = rows.where("not dropped").groupBy(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest")).agg(F.min(when).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    joined = rows.join(again, rows["conv_id"].eqNullSafe(again["_conv"]) & (rows["digest"] == again["_digest"]), "left")
    marked = joined.select("conv_id", "turn", "role", "text", "dropped", "digest", F.col("_n").isNotNull().alias("repeats"), (F.col("_n").isNotNull() & ~F.col("turn").eqNullSafe(F.col("_first.turn"))).alias("later"))
    return marked.repartitionByRange(shuffle_width(rows.sparkSession), *sort).sortWithinPartitions(*sort)


def closed(layer: Layer) -> Layer:
    """The layer and what one or two insertions reach from it."""
    out = dict(layer)
    for _ in range(2):
        for state, (cost, audit) in list(out.items()):
            to = GIVEN[state][1]
            offer(out, to, (cost + INSERT, audit + "I"))
    return out


def offer(layer: Layer, state: int, way: tuple[int, str]) -> None:
    if state not in layer or way < layer[state]:
        layer[state] = way


def moved(layer: Layer, initial: str, fault: str) -> Layer:
    """The layer after a row: every state closed, then the row deleted, kept or given the role that fits."""
    out: Layer = {}
    for state, (cost, audit) in closed(layer).items():
        offer(out, state, (cost + DELETE, audit + "D"))
        if fault in ("", "truncated"):
            extra = TRUNCATED if fault else 0
            if initial in NEXT[state]:
                offer(out, NEXT[state][initial], (cost + extra, audit + "K"))
            offer(out, GIVEN[state][1], (cost + extra + REROLE, audit + "R"))
    return out


def replay(audit: str, roles: Iterable[str], texts: Iterable[str], state: int = START) -> list[str]:
    """The lines role:text that an audit leaves of rows, from a state on."""
    rows, lines = zip(roles, texts, strict=True), []
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit == "K":
            state = NEXT[state][role[:1]]
        else:
            role, state = GIVEN[state]
        lines.append(f"{role}:{text}")
    return lines


@dataclass
class Piece:
    """Rows of one conversation that follow one another, and what they count to."""

    conv: object
    roles: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    faults: list[str] = field(default_factory=list)
    turns: int = 0
    low: int | None = None
    high: int | None = None
    chars: int = 0

    def add(self, turn: int | None, role: str, text: str, repeated: bool) -> None:
        solid = text.rstrip(BLANKS)
        self.faults.append("blank" if not solid else "duplicate" if repeated else "truncated" if solid[-1] not in ENDS else "")
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text)
        if turn is not None and turn != self.high:
            self.turns, self.low, self.high = self.turns + 1, turn if self.low is None else self.low, turn

    def search(self, state: int) -> Layer:
        layer: Layer = {state: (0, "")}
        for role, fault in zip(self.roles, self.faults, strict=True):
            layer = moved(layer, role[:1], fault)
        return layer

    def row(self, part: int, piece: int, whole: bool) -> dict:
        initials = [r[:1] for r in self.roles]
        out = {"conv_id": self.conv, "part": part, "piece": piece, "whole": whole, "turns": self.turns, "low": self.low, "high": self.high}
        out |= {k: self.faults.count(k) for k in ("blank", "duplicate", "truncated")}
        out["illegal"] = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
        if whole:
            cost, audit = min(way for state, way in closed(self.search(START)).items() if state in (START, ASSISTANT))
            lines = "\n".join(replay(audit, self.roles, self.texts))
            return out | {"cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(lines.encode()).hexdigest()}
        ways = [layer.get(j) for i in range(4) for layer in [self.search(i)] for j in range(4)]
        rank = {audit: k for k, audit in enumerate(sorted({w[1] for w in ways if w}))}
        out |= {"costs": [w[0] if w else -1 for w in ways], "ranks": [rank[w[1]] if w else -1 for w in ways], "audits": [w[1] if w else "" for w in ways]}
        return out | {"head": initials[0] if initials else None, "tail": initials[-1] if initials else None, "roles": self.roles, "texts": self.texts}


_COUNTS = "turns long, low long, high long, blank long, duplicate long, truncated long, illegal long"
_WAYS = "head string, tail string, costs array<long>, ranks array<int>"
_RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def pieces(rows: DataFrame, most_rows: int = PIECE_ROWS, most_chars: int = PIECE_CHARS) -> DataFrame:
    """A row for each conversation that one task has whole, and for each piece of the others; rows: as ordered() gives them."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, part int, piece int, whole boolean, {_COUNTS}, {_WAYS}, audits array<string>, roles array<string>, texts array<string>, cost long, audit string, repaired_sha256 string"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, out, size = TaskContext.get().partitionId(), 0, [], 0
        now: Piece | None = None
        # the first and the last conversation of a range may go on in its neighbours
        edge, previous = True, None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal out, size
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
            out, size = [], 0

        for batch in batches:
            for conv, turn, role, text, dropped, digest, repeats, later in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "dropped", "digest", "repeats", "later")), strict=True):
                if now is None or conv != now.conv:
                    if now is not None:
                        out.append(now.row(part, number, not edge))
                        size, edge = size + now.chars, False
                    now, number, previous = Piece(conv), 0, None
                elif len(now.roles) >= most_rows or now.chars >= most_chars:
                    out.append(now.row(part, number, False))
                    size, edge = size + now.chars, True
                    now, number = Piece(conv), number + 1
                if not dropped:
                    now.add(turn, role, text, later or (repeats and (turn, digest) == previous))
                    previous = (turn, digest)
                if len(out) >= 1000 or size > 4 << 20:
                    yield from flush()
        if now is not None:
            out.append(now.row(part, number, False))
        yield from flush()

    return rows.mapInArrow(run, schema)


def chosen(table: pa.Table) -> pa.Table:
    """Of one conversation's pieces: each one's way, from which state, and on the last row the counts of all and the insertions that close it."""
    found = table.sort_by([("part", "ascending"), ("piece", "ascending")]).to_pylist()
    layer = {START: (0, 0)}  # state -> cost, rank of its audit among the layer's
    back: list[dict[int, int]] = []
    for row in found:
        best: dict[int, tuple[int, int, int, int]] = {}
        for i, (cost, rank) in layer.items():
            for j in range(4):
                if row["costs"][4 * i + j] >= 0:
                    way = (cost + row["costs"][4 * i + j], rank, row["ranks"][4 * i + j], i)
                    best[j] = min(best.get(j, way), way)
        order = {x: k for k, x in enumerate(sorted({w[1:3] for w in best.values()}))}
        layer = {j: (w[0], order[w[1:3]]) for j, w in best.items()}
        back.append({j: w[3] for j, w in best.items()})
    cost, _, closing, state = min((cost + INSERT * len(CLOSING[j]), rank, CLOSING[j], j) for j, (cost, rank) in layer.items())
    ways = []
    for step in reversed(back):
        ways.append((step[state], state))
        state = step[state]
    ways.reverse()
    total = {k: sum(r[k] for r in found) for k in ("blank", "duplicate", "truncated", "illegal")}
    edges = [(a, b) for a, b in zip((r for r in found if r["head"] is not None), [r for r in found if r["head"] is not None][1:], strict=False)]
    total["illegal"] += sum(a["tail"] + b["head"] not in LEGAL for a, b in edges)
    known = [r for r in found if r["low"] is not None]
    turns = sum(r["turns"] for r in known) - sum(a["high"] == b["low"] for a, b in zip(known, known[1:], strict=False))
    gaps = known[-1]["high"] - known[0]["low"] + 1 - turns if known else 0
    last = len(found) - 1
    return pa.table(
        {"conv_id": table.column("conv_id").slice(0, 1).take(pa.array([0] * len(found)))}
        | {"part": pa.array([r["part"] for r in found], pa.int32()), "piece": pa.array([r["piece"] for r in found], pa.int32())}
        | {"from_state": pa.array([w[0] for w in ways], pa.int32()), "way": pa.array([4 * w[0] + w[1] for w in ways], pa.int32())}
        | {"closing": pa.array([closing if k == last else None for k in range(len(found))], pa.string()), "end_state": pa.array([ways[-1][1]] * len(found), pa.int32())}
        | {k: pa.array([v if n == last else None for n in range(len(found))], pa.int64()) for k, v in ({"gaps": gaps} | total | {"cost": cost}).items()}
    )


def joined_pieces(cut: DataFrame) -> DataFrame:
    """The results of the conversations that pieces() has cut."""
    kind = cut.schema["conv_id"].dataType.simpleString()
    choice = f"conv_id {kind}, part int, piece int, from_state int, way int, closing string, end_state int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
    slim = cut.select("conv_id", "part", "piece", *[c.split()[0] for c in f"{_COUNTS}, {_WAYS}".split(", ")])
    ways = slim.groupBy("conv_id").applyInArrow(chosen, choice).withColumnsRenamed({"conv_id": "_conv", "part": "_part", "piece": "_piece"})
    held = cut.select("conv_id", "part", "piece", "audits", "roles", "texts")
    both = held.join(ways, held["conv_id"].eqNullSafe(ways["_conv"]) & (held["part"] == ways["_part"]) & (held["piece"] == ways["_piece"])).drop("_conv", "_part", "_piece")
    # partitioned by conversation, a task reads them one after the other; nothing of a conversation stays but its audit
    line = both.repartition(shuffle_width(cut.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part", "piece")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, any_line, audit = hashlib.sha256(), False, []
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                own = row["audits"][row["way"]]
                lines = replay(own, row["roles"], row["texts"], row["from_state"])
                audit.append(own)
                if row["closing"] is not None:
                    audit.append(row["closing"])
                    lines += replay(row["closing"], [], [], row["end_state"])
                for text in lines:
                    sha.update((("\n" if any_line else "") + text).encode())
                    any_line = True
                if row["closing"] is not None:
                    columns = [batch.column("conv_id").slice(k, 1), *(batch.column(c).slice(k, 1) for c in counts), pa.array(["".join(audit)]), pa.array([sha.hexdigest()])]
                    yield pa.RecordBatch.from_arrays(columns, names=["conv_id", *counts, "audit", "repaired_sha256"])
                    sha, any_line, audit = hashlib.sha256(), False, []

    fields = ", ".join(f"{c} long" for c in counts)
    return line.mapInArrow(run, f"conv_id {kind}, {fields}, audit string, repaired_sha256 string")


def repair(rows: DataFrame, most_rows: int = PIECE_ROWS, most_chars: int = PIECE_CHARS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: a row for each conv_id of rows.

    rows: conv_id, turn, role, text, dropped, without nulls in role and text
    unless dropped (as damage() gives them).  A dropped row only keeps its
    conversation in the result.  A null conv_id is a conversation of its own, a
    null turn comes first and is in no count of turns.  Rows of one turn come in
    the order of the MD5 of role and text, so repeated ones lie together.  An
    empty role has no initial and must be changed.  A conversation without rows
    has zeros, no audit and the hash of no bytes; no rows give no rows.  Other
    columns are left aside.
    """
    found = stored(pieces(ordered(rows), most_rows, most_chars))
    gaps = F.when(F.col("low").isNull(), 0).otherwise(F.col("high") - F.col("low") + 1 - F.col("turns")).cast("long")
    done = found.where("whole").withColumn("gaps", gaps).select("conv_id", *_RESULT)
    return done.unionByName(joined_pieces(found.where("not whole")).select("conv_id", *_RESULT))


def damaged_repair(conversations: DataFrame) -> DataFrame:
    """repair() of damage(conversations), every original conv_id included."""
    return repair(damage(conversations))
