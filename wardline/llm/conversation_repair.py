"""Repair of conversations: the cheapest edits after which the roles of the turns follow a grammar.

The rows of a conversation are a sentence, and a grammar in Chomsky normal form says how spans of it may be
edited.  Its language is (s?(ua)+)?, taken over the initials of the roles.  A nonterminal (p, q) stands for a span
whose edited turns take the machine of that language from state p to state q, so the binary rules are
(p, q) -> (p, r) (r, q), and the unary ones are the edits of one row: keep, change the role, delete.  The cell of a
span has the least (cost, audit) of each nonterminal, where the audit is the initials of the edits.  Turns may be
inserted anywhere: the empty span has cells of its own, closed under insertion, and every cell takes them up on
both sides.

Spans are combined bottom up, lengths 1, 2, 4 and so on.  One split of each span is enough: both parts name the
machine's state in between, so every split gives the same cell.  Two audits of equal cost over the same rows are
never one the head of the other (they would differ in insertions, which cost), so the least audit of a whole is
made of least audits of its parts.  That holds across chunks too: a long conversation is cut into chunks, and the
cells of neighbouring chunks are combined by grouping, a bounded number at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from wardline.llm.common import require, saved
from wardline.operators.ordered import Running, running

#: Rows of a conversation that are parsed in one task, and neighbouring chunks that are combined at a time.
CHUNK, FAN = 256, 16
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States: nothing yet, after s, after u, after a; where each initial leads; where a conversation may end.
_MOVES = {"s": ((0, 1),), "u": ((0, 2), (1, 2), (3, 2)), "a": ((2, 3),)}
_ENDS = (0, 3)
_ROLES = {"u": "user", "a": "assistant"}
_WORD = r"[^\x20\x09-\x0D]"

Cell = dict[tuple[int, int], tuple[int, str]]


def _better(cell: Cell, at: tuple[int, int], value: tuple[int, str]) -> None:
    if at not in cell or value < cell[at]:
        cell[at] = value


def joined(x: Cell, y: Cell) -> Cell:
    """The cell of a span from the cells of its two parts."""
    out: Cell = {}
    for (p, r), (cost, audit) in x.items():
        for q in range(4):
            if (r, q) in y:
                _better(out, (p, q), (cost + y[r, q][0], audit + y[r, q][1]))
    return out


def _empty() -> Cell:
    """The cell of the empty span: any insertions."""
    one = {move: (INSERT, "I") for initial in _ROLES for move in _MOVES[initial]}
    cell: Cell = {(p, p): (0, "") for p in range(4)}
    while True:
        more = dict(cell)
        for at, value in joined(cell, one).items():
            _better(more, at, value)
        if more == cell:
            return cell
        cell = more


EMPTY = _empty()


def leaf(code: str) -> Cell:
    """The cell of one row.  Codes: x must go; s, u, a, o by the role's initial, as a capital if it is truncated."""
    cell: Cell = {(p, p): (DELETE, "D") for p in range(4)}
    if code != "x":
        more = TRUNCATED * code.isupper()
        for initial in _ROLES:
            for move in _MOVES[initial]:
                _better(cell, move, (REROLE + more, "R"))
        for move in _MOVES.get(code.lower(), ()):
            _better(cell, move, (KEEP + more, "K"))
    return joined(joined(EMPTY, cell), EMPTY)


def combined(row: list[Cell]) -> Cell:
    """The cell of neighbouring spans together, by doubling lengths."""
    while len(row) > 1:
        row = [joined(*row[i : i + 2]) if i + 1 < len(row) else row[i] for i in range(0, len(row), 2)]
    return row[0] if row else EMPTY


def best(cell: Cell) -> tuple[int, str]:
    """Least cost, and its least audit, of a whole conversation."""
    return min(cell[0, q] for q in _ENDS if (0, q) in cell)


def _cells_column(cells: list[Cell]) -> pa.Array:
    flat = [{"p": p, "q": q, "cost": c, "audit": a} for cell in cells for (p, q), (c, a) in cell.items()]
    at = [0]
    for cell in cells:
        at.append(at[-1] + len(cell))
    kind = pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, kind))


_CELLS = "array<struct<p:int,q:int,cost:long,audit:string>>"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    leaves = {c: leaf(c) for c in "xsuaoSUAO"}
    # Short conversations repeat one another; what a worker keeps is bounded.
    known: dict[str, Cell] = {}
    for t in batches:
        cells = []
        for codes in t.column("codes").to_pylist():
            cell = known.get(codes)
            if cell is None:
                cell = combined([leaves[c] for c in codes])
                if len(codes) <= 16 and len(known) < 50_000:
                    known[codes] = cell
            cells.append(cell)
        yield pa.RecordBatch.from_arrays([t.column("id"), t.column("chunk"), _cells_column(cells)], names=["id", "chunk", "cells"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in batches:
        cells = []
        for parts in t.column("parts").to_pylist():
            parts.sort(key=lambda x: x["chunk"])
            cells.append(combined([{(c["p"], c["q"]): (c["cost"], c["audit"]) for c in x["cells"]} for x in parts]))
        yield pa.RecordBatch.from_arrays([t.column("id"), t.column("chunk"), _cells_column(cells)], names=["id", "chunk", "cells"])


def faults(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per row: id, pos (1-based, by turn, role and text, nulls first), turn, role, text, fault, initial, and the row before.

    A null role or text counts as one space.  fault is the first of: blank (no word character), duplicate (an earlier
    row has the same role and text), truncated (the last word character is none of .!?); null if the row has none.
    """
    rows = require(turns, conv_id, turn, role, text).toDF("id", "turn", "role", "text")
    rows = rows.withColumns({"role": F.coalesce(F.col("role").cast("string"), F.lit(" ")), "text": F.coalesce("text", F.lit(" "))})
    rows = rows.withColumn("initial", F.substring("role", 1, 1))
    specs = [Running("pos", "sum", F.lit(1).cast("long"), strict=False), Running("before", "previous", F.struct("initial", "turn"))]
    rows = running(rows, ["id"], ["turn", "role", "text"], F.col("turn"), specs)
    same = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    repeated = F.row_number().over(Window.partitionBy("id", "_same").orderBy("pos")) > 1
    rows = rows.withColumn("_same", same).withColumn("_repeated", repeated)
    fault = (
        F.when(~F.rlike("text", F.lit(_WORD)), "blank")
        .when(F.col("_repeated"), "duplicate")
        .when(~F.rlike("text", F.lit(r"[.!?][\x20\x09-\x0D]*\z")), "truncated")
    )
    return rows.select("id", "pos", "turn", "role", "text", fault.alias("fault"), "initial", "before")


def _code() -> Column:
    known = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    return (
        F.when(F.col("fault").isin("blank", "duplicate"), "x")
        .when(F.col("fault") == "truncated", F.upper(known))
        .otherwise(known)
    )


def repair(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(summary, edits) of conversations.

    summary, one row per conversation that has rows: its id, gaps (turn numbers missing between the first and the
    last), blank, duplicate, truncated (rows by first fault), illegal (neighbours whose initials may not follow one
    another), cost and audit of the cheapest edits; of those of equal cost the ASCII-least audit.
    edits, one row per letter of the audit, in order: id, place, edit (K, R, D, I), role, text, turn; a deleted row has
    its own role and text.  Its partitions hold whole conversations in order, for `digests`.

    Rows with a null id are one conversation.  Rows of equal turn go by role and text; repeated rows are duplicates.
    An empty table gives empty results.  A conversation of any length is parsed in chunks; only its edits, which
    follow one another, are written in one task, row by row.
    """
    rows = saved(faults(turns, conv_id, turn, role, text), "faults")
    number = lambda c: F.count_if(c).cast("long")
    follows = F.concat("before.initial", "initial").isin("su", "ua", "au")
    chunks = rows.groupBy("id", F.floor((F.col("pos") - 1) / chunk).cast("long").alias("chunk")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", _code().alias("code")))), lambda x: x["code"]), "").alias("codes"),
        F.min("turn").alias("low"),
        F.max("turn").alias("high"),
        number(F.col("turn").isNotNull() & ~F.coalesce(F.col("turn") == F.col("before.turn"), F.lit(False))).alias("turns"),
        *[number(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
        number(F.col("before").isNotNull() & ~follows).alias("illegal"),
    )
    chunks = saved(chunks, "chunks")
    figures = chunks.groupBy("id").agg(
        F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("turns"), F.lit(0)).cast("long").alias("gaps"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")],
    )
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, chunk long, cells {_CELLS}"
    cells = chunks.select("id", "chunk", "codes").mapInArrow(_parse, schema)
    last = chunks.agg(F.max("chunk")).first()[0] or 0
    while last:
        # So many neighbours at a time; a group never has more.
        parts = cells.groupBy("id", F.floor(F.col("chunk") / FAN).cast("long").alias("to")).agg(F.collect_list(F.struct("chunk", "cells")).alias("parts"))
        cells = saved(parts.select("id", F.col("to").alias("chunk"), "parts").mapInArrow(_merge, schema), "cells")
        last //= FAN
    whole = F.filter("cells", lambda c: (c["p"] == 0) & c["q"].isin(*_ENDS))
    least = F.array_min(F.transform(whole, lambda c: F.struct(c["cost"], c["audit"])))
    found = saved(cells.select("id", least.alias("x")).select("id", "x.cost", "x.audit"), "audits")
    left, right = figures.alias("l"), found.alias("r")
    summary = left.join(right, F.col("l.id").eqNullSafe(F.col("r.id"))).select(
        F.col("l.id").alias(conv_id), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"
    )
    lines = rows.select("id", "pos", "turn", "role", "text").unionByName(
        found.select("id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    )
    turn_kind = rows.schema["turn"].dataType.simpleString()
    edits = lines.repartition("id").sortWithinPartitions("id", "pos").mapInArrow(_edit, f"id {kind}, place long, edit string, role string, text string, turn {turn_kind}")
    return summary, edits.withColumnRenamed("id", conv_id)


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations row by row, each behind its audit: what every edit leaves."""
    ids, audit, at, after, place = None, "", 0, "", 0

    def inserted(out: list) -> None:
        nonlocal at, after, place
        while at < len(audit) and audit[at] == "I":
            initial = "a" if after == "u" else "u"
            after, at, place = initial, at + 1, place + 1
            out.append((ids, place, "I", _ROLES[initial], "", None))

    for t in batches:
        out: list = []
        for i, pos, turn, role, text in zip(*(t.column(c).to_pylist() for c in ("id", "pos", "turn", "role", "text"))):
            if pos == 0:
                ids, audit, at, after, place = i, text, 0, "", 0
                inserted(out)
                continue
            edit, at, place = audit[at], at + 1, place + 1
            if edit == "R":
                after = "a" if after == "u" else "u"
                role = _ROLES[after]
            elif edit == "K":
                after = role[:1]
            out.append((i, place, edit, role, text, turn))
            inserted(out)
        columns = list(zip(*out)) or [[]] * 6
        types = [t.schema.field("id").type, pa.int64(), pa.string(), pa.string(), pa.string(), t.schema.field("turn").type]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), ty) for c, ty in zip(columns, types)], names=["id", "place", "edit", "role", "text", "turn"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state, first, begun, kind = hashlib.sha256(), True, False, pa.int64()
    now = None
    for t in batches:
        out, kind = [], t.schema.field(0).type
        for i, edit, role, text in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), t.column(2).to_pylist(), t.column(3).to_pylist()):
            if not begun or i != now:
                if begun:
                    out.append((now, state.hexdigest()))
                now, begun, state, first = i, True, hashlib.sha256(), True
            if edit != "D":
                state.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], kind), pa.array([x[1] for x in out])], names=["id", "repaired_sha256"])
    if begun:
        yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([state.hexdigest()])], names=["id", "repaired_sha256"])


def digests(edits: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """Per conversation of `edits`, as `repair` returns it: the SHA-256 of its repaired role:text lines.

    A digest is a chain over the text, so one task reads a conversation's rows, with one row at a time in memory.
    """
    kind = edits.schema[conv_id].dataType.simpleString()
    return edits.select(F.col(conv_id).alias("id"), "edit", "role", "text").mapInArrow(_digest, f"id {kind}, repaired_sha256 string").withColumnRenamed("id", conv_id)
