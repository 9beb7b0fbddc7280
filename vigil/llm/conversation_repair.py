"""Repair of damaged conversations by weighted CYK parsing over spans of turns.

A repair grammar in Chomsky normal form derives the sequences of roles that belong to a conversation: an optional
system turn, then pairs of user and assistant. A span of rows has one cell for each nonterminal, that is for each form
its repaired rows may have: none, system alone, or an alternating sequence by its first and last role. A cell holds the
cheapest edits that bring the span to that form, as (cost, audit); the audit names each edit by its initial. Insertions
derive roles from empty spans; each cell is closed under them. Cells are filled bottom-up by span length, and the cells
of two neighbouring spans give those of both together. So long conversations are parsed in blocks whose cells are
combined by doubling span lengths, over as many partitions as their rows lie in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Workspace, small_batches, text_batches

#: Costs of the edits; a truncated row that isn't deleted costs more.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: What may stand between words.
SPACE = " \t\n\x0b\x0c\r"
#: Initials of roles that may follow each other.
LEGAL = frozenset({"su", "ua", "au"})

#: Nonterminals: no row; the system row; alternating rows by first and last role; the same after a system row.
NONE, SYS, UU, UA, AU, AA, SU, SA = range(8)
#: Rules X -> Y Z; besides these every X is derived from NONE X and X NONE.
RULES = [
    (UU, UA, UU), (UU, UU, AU), (UA, UU, AA), (UA, UA, UA), (AU, AA, UU), (AU, AU, AU), (AA, AA, UA), (AA, AU, AA),
    (SU, SYS, UU), (SU, SU, AU), (SU, SA, UU), (SA, SYS, UA), (SA, SU, AA), (SA, SA, UA),
]
RULES = [(NONE, NONE, NONE), *((x, NONE, x) for x in range(1, 8)), *((x, x, NONE) for x in range(1, 8)), *RULES]
#: The forms of a whole conversation.
START = (NONE, UA, SA)
#: Rows that are parsed in one chart, and cells that a worker remembers.
BLOCK, MEMORY = 16, 100_000

Cell = tuple[tuple[int, str] | None, ...]
#: The empty span: nothing, or roles by insertion alone.
EMPTY: Cell = ((0, ""), None, (INSERT, "I"), (2 * INSERT, "II"), (2 * INSERT, "II"), (INSERT, "I"), None, None)


def _least(found: list, rules: list[tuple[int, int, int]], left: Any, right: Any) -> bool:
    """Improve ``found`` by all rules over two neighbouring spans; whether it changed."""
    changed = False
    for x, y, z in rules:
        if (a := left[y]) is not None and (b := right[z]) is not None:
            now, cost = found[x], a[0] + b[0]
            if now is None or cost < now[0] or (cost == now[0] and a[1] + b[1] < now[1]):
                found[x] = (cost, a[1] + b[1])
                changed = True
    return changed


_INSERTED_LEFT = [r for r in RULES if r[1] != NONE and EMPTY[r[1]] is not None]
_INSERTED_RIGHT = [r for r in RULES if r[2] != NONE and EMPTY[r[2]] is not None]


def closed(found: list) -> Cell:
    """Insertions before and after a span, until they improve nothing; each costs, so that this ends."""
    while _least(found, _INSERTED_LEFT, EMPTY, found) | _least(found, _INSERTED_RIGHT, found, EMPTY):
        pass
    return tuple(found)


def combined(left: Cell, right: Cell) -> Cell:
    """The cells of two neighbouring spans together."""
    found: list = [None] * 8
    _least(found, RULES, left, right)
    return closed(found)


def leaf(symbol: str) -> Cell:
    """The cells of one row: x for a row that must go, else its role's initial (o: another), a capital if truncated."""
    found: list = [None] * 8
    found[NONE] = (DELETE, "D")
    if symbol != "x":
        more = TRUNCATED if symbol.isupper() else 0
        found[UU] = found[AA] = (REROLE + more, "R")
        own = {"u": UU, "a": AA, "s": SYS}.get(symbol.lower())
        if own is not None:
            found[own] = (more, "K")
    return closed(found)


_CELLS: dict[str, Cell] = {}


def chart(symbols: str) -> Cell:
    """The cells of a block of rows, from those of all its spans, shortest first; spans that look alike share theirs."""
    if symbols in _CELLS:
        return _CELLS[symbols]
    if len(_CELLS) > MEMORY:
        _CELLS.clear()
    for n in range(1, len(symbols) + 1):
        for i in range(len(symbols) - n + 1):
            span = symbols[i : i + n]
            if span in _CELLS:
                continue
            if n == 1:
                _CELLS[span] = leaf(span)
                continue
            found: list = [None] * 8
            for k in range(1, n):
                _least(found, RULES, _CELLS[span[:k]], _CELLS[span[k:]])
            _CELLS[span] = closed(found)
    return _CELLS[symbols] if symbols else EMPTY


class Spans:
    """The cells of a conversation's rows so far: spans whose numbers of blocks are powers of two, longest first."""

    def __init__(self) -> None:
        self.held: list[tuple[int, Cell]] = []
        self.waiting = ""

    def add(self, symbols: str) -> None:
        self.waiting += symbols
        while len(self.waiting) >= BLOCK:
            self.push(chart(self.waiting[:BLOCK]))
            self.waiting = self.waiting[BLOCK:]

    def push(self, cell: Cell) -> None:
        size = 1
        while self.held and self.held[-1][0] == size:
            cell = combined(self.held.pop()[1], cell)
            size *= 2
        self.held.append((size, cell))

    def cell(self) -> Cell:
        found = chart(self.waiting)
        for _, left in reversed(self.held):
            found = combined(left, found)
        return found


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text, copies) with the faults that the hash of conversation and turn gives them.

    Null roles and texts are one space. Of 20 kinds one drops the row (no copies), one empties its text, one takes away
    its full stops, question and exclamation marks, one repeats the row and one makes its role ``user``.
    """
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    shown = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown(conv), F.lit(":"), shown(turn))) % 20
    role, text = shown(F.col("role")), shown(F.col("text"))
    rows = conversations.select(conv.alias("conv_id"), turn.alias("turn"), role.alias("role"), text.alias("text"), kind.alias("kind"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"),
    )


def _digest() -> Column:
    """Tells rows of a conversation with different roles or texts apart."""
    return F.md5(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("~")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))


#: The order of a conversation's rows.
ORDER = ("conv_id", "turn", "role", "digest")
_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_PIECE = "low long, high long, n_turns long, first_turn long, last_turn long, first_role string, last_role string"


def _symbols(rows: DataFrame, work: Workspace) -> DataFrame:
    """One row for equal rows of a conversation's turn: (conv_id, turn, role, digest, initial, fault, copies, later).

    ``later`` is whether the same role and text stand at an earlier turn.
    """
    tail = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(tail == "", "blank").when(~F.substring(tail, -1, 1).isin(".", "!", "?"), "truncated").otherwise("")
    initial = F.substring("role", 1, 1)
    looked = rows.select("conv_id", "turn", "role", _digest().alias("digest"), F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"), fault.alias("fault"), "copies")
    met = work.table(looked.groupBy("conv_id", "turn", "role", "digest", "initial", "fault").agg(F.sum("copies").alias("copies")), "turns")
    at = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = met.where("copies > 0").groupBy("digest").agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    return met.join(firsts, "digest", "left").select("conv_id", "turn", "role", "digest", "initial", "fault", "copies", F.coalesce(F.col("first") < at, F.lit(False)).alias("later"))


class _Piece:
    """What is counted of a conversation's rows, or of those of them that lie in one partition."""

    def __init__(self, conv: int | None):
        self.conv, self.spans = conv, Spans()
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.low = self.high = self.first_turn = self.last_turn = self.first_role = self.last_role = None
        self.n_turns = 0

    def add(self, turn: int | None, initial: str, fault: str, copies: int, later: bool) -> None:
        if not copies:
            return
        if self.last_role is not None:
            self.counts["illegal"] += self.last_role + initial not in LEGAL
        else:
            self.first_role, self.first_turn = initial, turn
        self.counts["illegal"] += copies - 1  # no role may follow itself
        if turn is not None:
            self.low, self.high = turn if self.low is None else self.low, turn
            self.n_turns += self.last_turn != turn
        self.last_turn, self.last_role = turn, initial
        if fault == "blank":
            self.counts["blank"] += copies
            self.spans.add("x" * copies)
            return
        self.counts["duplicate"] += copies - (not later)
        if later:
            self.spans.add("x" * copies)
        else:
            self.counts["truncated"] += fault == "truncated"
            self.spans.add((initial.upper() if fault else initial) + "x" * (copies - 1))

    def report(self, cell: Cell) -> tuple:
        gaps = self.high - self.low + 1 - self.n_turns if self.low is not None else 0
        return (self.conv, gaps, *self.counts.values(), *min(x for s in START if (x := cell[s]) is not None))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reports of the conversations of a partition's sorted rows; first and last one come with their cells, as rows of
    theirs may lie in other partitions."""
    part, held, piece, first = TaskContext.get().partitionId(), [], None, True

    def row(p: _Piece, edge: bool) -> tuple:
        cell = p.spans.cell()
        cells = [None if x is None else {"cost": x[0], "audit": x[1]} for x in cell] if edge else None
        return (*p.report(cell), p.low, p.high, p.n_turns, p.first_turn, p.last_turn, p.first_role, p.last_role, part, edge, cells)

    for batch in batches:
        for conv, turn, initial, fault, copies, later in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "fault", "copies", "later")), strict=True):
            if piece is None or conv != piece.conv:
                if piece is not None:
                    held.append(row(piece, first))
                    first = False
                piece = _Piece(conv)
            piece.add(turn, initial, fault, copies, later)
        if len(held) >= 1000:
            yield _batch(held, _PARSED)
            held = []
    if piece is not None:
        held.append(row(piece, True))
    if held:
        yield _batch(held, _PARSED)


_LONGS = [("conv_id", pa.int64()), ("gaps", pa.int64()), *((c, pa.int64()) for c in _COUNTS), ("cost", pa.int64()), ("audit", pa.string())]
_CELL = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))
_PARSED = pa.schema([*_LONGS, *((c, pa.int64()) for c in ("low", "high", "n_turns", "first_turn", "last_turn")), ("first_role", pa.string()), ("last_role", pa.string()), ("part", pa.int32()), ("edge", pa.bool_()), ("cells", _CELL)])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema.names)


def _whole(pieces: pd.DataFrame) -> pd.DataFrame:
    """The report of one conversation from its pieces, at most one a partition."""
    of = lambda x: None if pd.isna(x) else int(x)
    whole = _Piece(of(pieces["conv_id"].iloc[0]))
    cell = None
    for p in pieces.sort_values("part").itertuples():
        own = tuple(None if x is None else (int(x["cost"]), x["audit"]) for x in p.cells)
        cell = own if cell is None else combined(cell, own)
        for c in _COUNTS:
            whole.counts[c] += int(getattr(p, c))
        if p.first_role is None:
            continue
        if whole.last_role is not None:
            whole.counts["illegal"] += whole.last_role + p.first_role not in LEGAL
        if of(p.low) is not None:
            whole.low, whole.high = of(p.low) if whole.low is None else whole.low, of(p.high)
            whole.n_turns += int(p.n_turns) - (whole.last_turn is not None and whole.last_turn == of(p.first_turn))
        whole.last_role, whole.last_turn = p.last_role, of(p.last_turn)
    out = pd.DataFrame([whole.report(cell)], columns=["conv_id", "gaps", *_COUNTS, "cost", "audit"])
    return out.astype({c: "Int64" for c in out.columns if c != "audit"})


def reports(rows: DataFrame, work: Workspace) -> DataFrame:
    """For each conversation of damaged rows: its faults by kind, the cost of the cheapest repair and its audit.

    The rows are dealt by ranges of (conversation, turn), without their texts; a conversation of any length may lie in
    several partitions, each of which gives the cells of its part. Conversations whose copies are all 0 have an empty
    audit and no faults.
    """
    dealt = _symbols(rows, work).repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).select("conv_id", "turn", "initial", "fault", "copies", "later")
    cells = "cells array<struct<cost: long, audit: string>>"
    parsed = work.table(dealt.mapInArrow(_parse, f"{_REPORT}, {_PIECE}, part int, edge boolean, {cells}"), "parsed")
    names = ["conv_id", "gaps", *_COUNTS, "cost", "audit"]
    # at most two conversations a partition
    edges = parsed.where("edge").groupBy("conv_id").applyInPandas(_whole, _REPORT)
    return parsed.where("NOT edge").select(names).unionByName(edges.select(names))


_EDITED = pa.schema([*_LONGS, ("position", pa.int64()), ("role", pa.string()), ("content", pa.string()), ("edit", pa.string())])


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Carry out the audits over rows sorted by conversation, each after its report; the report goes on as row 0."""
    head, audit, at, place, odd = None, "", 0, 0, 0
    held: list[tuple] = []

    def put(role: str | None, text: str, edit: str) -> None:
        nonlocal place
        own = role if role is not None else ("user", "assistant")[(place - odd) % 2]
        place += 1
        held.append((*head, place, own, text, edit))

    def inserts() -> None:
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            put(None, "", "I")
            at += 1

    names = [n for n, _ in _LONGS]
    for batch in text_batches(batches, "text", 1 << 20):
        columns = {c: batch.column(c).to_pylist() for c in (*names, "kind", "role", "text", "copies")}
        for i, kind in enumerate(columns["kind"]):
            if kind == 0:
                if head is not None:
                    inserts()
                report = tuple(columns[c][i] for c in names)
                audit, at, place = report[-1], 0, 0
                odd = (len(audit) - audit.count("D")) % 2
                head = (report[0], *[None] * (len(names) - 1))
                held.append((*report, 0, None, None, None))
                continue
            for _ in range(columns["copies"][i]):
                inserts()
                edit, at = audit[at], at + 1
                if edit != "D":
                    put(columns["role"][i] if edit == "K" else None, columns["text"][i], edit)
        if held:
            yield _batch(held, _EDITED)
            held = []
    if head is not None:
        inserts()
    if held:
        yield _batch(held, _EDITED)


def _edited(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The reports, as rows at position 0, each followed by its conversation's repaired rows in order.

    Texts are moved once. A conversation's rows go through one task in order, as a stream that holds one batch.
    """
    small_batches(rows.sparkSession)
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    heads = found.withColumns({"kind": F.lit(0), "turn": F.lit(None).cast("long"), "role": F.lit(""), "digest": F.lit(""), "text": F.lit(""), "copies": F.lit(0)})
    texts = rows.where("copies > 0").withColumn("digest", _digest()).select("conv_id", *(none("long", c) for c in ("gaps", *_COUNTS, "cost")), none("string", "audit"), F.lit(1).alias("kind"), "turn", "role", "digest", "text", "copies")
    both = heads.select(*texts.columns).unionByName(texts)
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")
    return ordered.mapInArrow(_edit, f"{_REPORT}, position long, role string, content string, edit string")


def repaired(conversations: DataFrame, work: Workspace) -> DataFrame:
    """The repaired conversations: (conv_id, position from 1, role, text, edit), each row with the edit that it comes from."""
    rows = damaged(conversations)
    return _edited(rows, reports(rows, work)).where("position > 0").select("conv_id", "position", "role", F.col("content").alias("text"), "edit")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    report, digest, held = None, hashlib.sha256(), []
    names = [n for n, _ in _LONGS]
    schema = pa.schema([*_LONGS, ("repaired_sha256", pa.string())])
    for batch in batches:
        columns = {c: batch.column(c).to_pylist() for c in (*names, "position", "role", "content")}
        for i, position in enumerate(columns["position"]):
            if position == 0:
                if report is not None:
                    held.append((*report, digest.hexdigest()))
                report, digest = tuple(columns[c][i] for c in names), hashlib.sha256()
            else:
                digest.update(f"{chr(10) if position > 1 else ''}{columns['role'][i]}:{columns['content'][i]}".encode())
        if len(held) >= 1000:
            yield _batch(held, schema)
            held = []
    if report is not None:
        held.append((*report, digest.hexdigest()))
    if held:
        yield _batch(held, schema)


def repair(conversations: DataFrame, work: Workspace) -> DataFrame:
    """For each conversation: its faults after damage, the cheapest repair's cost and audit, and the repaired rows' digest.

    Rows of a conversation are ordered by turn (null first), ties by role, then by a hash of the text; equal rows are
    repeats. Null conversation ids are one conversation; null roles and texts are one space, so such texts are blank and
    such roles must be changed or deleted. Empty texts are blank. A very long text is moved once and hashed as it comes. A
    conversation of any number of rows is parsed in parts, its digest is one stream. An empty table gives no rows; extra
    columns are ignored.
    """
    rows = damaged(conversations)
    return _edited(rows, reports(rows, work)).mapInArrow(_digests, f"{_REPORT}, repaired_sha256 string")
