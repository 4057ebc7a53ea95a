"""Mixing sources to target weights by Pfair scheduling.

The rows of a source are put into blocks.  Block i of a source with share w of all weights is released at
slot floor(i / w) and due at slot ceil((i + 1) / w).  In every slot the released block that is due first is
placed (earliest deadline first), which keeps each source within less than one block of its share at every
prefix.  The windows repeat after as many slots as the whole-number weights add up to, so the schedule of one
period, a table whose size is fixed by the weights, places the blocks of any amount of data by a join.  When
a source has no block left, the others go on by their own weights: a new phase with a period of its own.
"""

from __future__ import annotations

import heapq
import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from wardline.llm.common import require, rows_of

#: The sum of all weights, so the number of slots in a period, at most.
MOST_SLOTS = 10_000
#: Rows of a block, and rows that are numbered in one task, about.
BLOCK_ROWS, TASK_ROWS = 32, 5_000


def period(weights: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """(source, i, slot, release, deadline) for all blocks of one period."""
    total = sum(weights.values())
    window = lambda s, i: (i * total // weights[s], -(-(i + 1) * total // weights[s]))
    waiting = [(*window(s, 0), s, 0) for s in weights]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int, int]] = []
    out = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            release, deadline, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, s, i, release))
        deadline, s, i, release = heapq.heappop(ready)
        out.append((s, i, slot, release, deadline))
        if i + 1 < weights[s]:
            heapq.heappush(waiting, (*window(s, i + 1), s, i + 1))
    return out


def phases(weights: dict[str, int], blocks: dict[str, int]) -> tuple[list[tuple], list[tuple]]:
    """(source, phase, first block, end, first slot, weight, period) and (source, phase, i, slot, release, deadline)."""
    spans, slots = [], []
    used = dict.fromkeys(weights, 0)
    start = 0
    for phase in range(len(weights)):
        active = {s: w for s, w in weights.items() if used[s] < blocks.get(s, 0)}
        if not active:
            break
        divisor = math.gcd(*active.values())
        active = {s: w // divisor for s, w in active.items()}
        total, table = sum(active.values()), period(active)
        at = {(s, i): slot for s, i, slot, _, _ in table}
        left = {s: blocks[s] - used[s] for s in active}
        last = {s: (n - 1) // active[s] * total + at[s, (n - 1) % active[s]] for s, n in left.items()}
        # The phase ends with the first source that runs out; the slots so far are whole periods and a rest.
        length = min(last.values()) + 1
        rest = {s: sum(at[s, i] < length % total for i in range(w)) for s, w in active.items()}
        for s, w in active.items():
            n = min(length // total * w + rest[s], left[s])
            spans.append((s, phase, used[s], used[s] + n, start, w, total))
            used[s] += n
        slots += [(s, phase, *x) for s, *x in table]
        start += length
    return spans, slots


def mix(
    docs: DataFrame, weights: dict[str, int], rest: int, doc_id: str = "doc_id", source: str = "source", block_rows: int = BLOCK_ROWS, task_rows: int = TASK_ROWS
) -> DataFrame:
    """Per row: its id, source, group, block, release, deadline, slot, and place within the block.

    `weights` are whole numbers per source; all other sources, and a null one, form one group of weight
    `rest`.  Together they are MOST_SLOTS at most.  Rows of a group are ordered by a hash of their id, so a
    block is a fair sample of its group.  (slot, place) orders the mixture; no row is left out and none
    repeated.  Release, deadline and slot count blocks from the start of the mixture.  Rows that repeat an id
    have places of their own.  No rows give no rows.

    A group's rows are numbered in tiles of about `task_rows` rows, and the tiles' sizes added up, so a source
    with a third of all rows is spread over many tasks, and so is an id that is repeated, or null, as often.  Only
    one count per group and the heaviest ids go to the driver.
    """
    return place(require(docs, doc_id, source).toDF("id", "source"), weights, rest, "id", "source", block_rows, task_rows).toDF(
        doc_id, source, "group", "block", "release", "deadline", "slot", "place"
    )


#: Heavy ids that are found at most; an id with a larger part of all rows than one in so many always is.
HEAVY = 1024


def _heavy(rows: DataFrame, task_rows: int) -> DataFrame:
    """(group, _t, _heavy): the hashes in a tile that more than `task_rows` rows share, and into how many parts they go."""
    name = F.concat_ws(" ", F.col("_t").cast("string"), F.col("_h").cast("string"), "group")
    top = rows.select(name.alias("x")).agg(F.expr(f"approx_top_k(x, {HEAVY}, {8 * HEAVY})").alias("top")).first().top
    found: dict[tuple[str, int], list[tuple[int, int]]] = {}
    for r in top or []:
        if r["count"] > task_rows:
            t, h, group = r["item"].split(" ", 2)
            found.setdefault((group, int(t)), []).append((int(h), -(-r["count"] // task_rows)))
    # At most HEAVY hashes, from a sketch of bounded size.
    parts = pa.list_(pa.struct([("h", pa.int64()), ("parts", pa.int64())]))
    schema = pa.schema([("group", pa.string()), ("_t", pa.int64()), ("_heavy", parts)])
    return rows_of(rows.sparkSession, [(*k, [{"h": h, "parts": n} for h, n in v]) for k, v in found.items()], schema)


def place(rows: DataFrame, weights: dict[str, int], rest: int, doc_id: str, source: str, block_rows: int, task_rows: int) -> DataFrame:
    """`rows` with group, block, release, deadline, slot and place; the input may have any other columns but these."""
    spark = rows.sparkSession
    if min([rest, *weights.values()]) < 1 or rest + sum(weights.values()) > MOST_SLOTS or "" in weights:
        raise ValueError("weights are whole numbers of at least 1 for named sources, and add up to MOST_SLOTS at most")
    columns = rows.columns
    group = F.when(F.col(f"`{source}`").isin(*weights), F.col(f"`{source}`")).otherwise("") if weights else F.lit("")
    rows = rows.withColumns({"group": F.coalesce(group, F.lit("")), "_h": F.xxhash64(f"`{doc_id}`"), "_row": F.monotonically_increasing_id()})
    count = {r["group"]: r["count"] for r in rows.groupBy("group").count().collect()}
    shares = {**weights, "": rest}
    spans, slots = phases(shares, {g: -(-n // block_rows) for g, n in count.items()})

    # The tile is a range of the hash, so tiles follow one another in the order of the hash.
    tiles = {g: max(1, -(-n // task_rows)) for g, n in count.items()}
    most = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for g in tiles.items() for x in g]), F.col("group")), F.lit(1)) if tiles else F.lit(1)
    rows = rows.withColumn("_t", F.least(F.floor((F.col("_h") / F.lit(2.0**64) + 0.5) * most), most - 1).cast("long"))
    # Rows of a heavy id (or of none) have one hash: they are tiles of their own, between what lies before and after.
    heavy = _heavy(rows, task_rows)
    rows = rows.join(F.broadcast(heavy), ["group", "_t"], "left")
    below = F.size(F.filter("_heavy", lambda x: x["h"] < F.col("_h")))
    parts = F.get(F.filter("_heavy", lambda x: x["h"] == F.col("_h")), F.lit(0))["parts"]
    rows = rows.withColumns({
        "_v": F.coalesce(2 * below + F.when(parts.isNotNull(), 1).otherwise(0), F.lit(0)),
        "_u": F.coalesce(F.pmod(F.xxhash64("_row"), parts), F.lit(0)),
    })
    tile = ["_t", "_v", "_u"]
    sums = rows.groupBy("group", *tile).count()
    before = Window.partitionBy("group").orderBy(*tile).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("group", *tile, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_b"))
    number = F.row_number().over(Window.partitionBy("group", *tile).orderBy("_h", f"`{doc_id}`", "_row"))
    rows = rows.withColumn("_i", number - 1).join(sums, ["group", *tile])
    rows = rows.withColumn("_i", F.col("_i") + F.col("_b"))
    rows = rows.withColumns({"block": F.floor(F.col("_i") / block_rows), "place": (F.col("_i") % block_rows).cast("int")})

    # Both tables are bounded by the weights: a row per group and phase, and one per slot of each phase's period.
    phase = [("group", pa.string()), ("_p", pa.int32())]
    spans = rows_of(spark, spans, pa.schema(phase + [(c, pa.int64()) for c in ("_from", "_to", "_start", "_w", "_len")]))
    slots = rows_of(spark, slots, pa.schema(phase + [(c, pa.int64()) for c in ("_k", "_s", "_r", "_d")]))
    rows = rows.join(F.broadcast(spans), (rows["group"] == spans["group"]) & F.col("block").between(F.col("_from"), F.col("_to") - 1)).drop(spans["group"])
    rows = rows.withColumns({"_k": (F.col("block") - F.col("_from")) % F.col("_w"), "_c": F.floor((F.col("block") - F.col("_from")) / F.col("_w"))})
    rows = rows.join(F.broadcast(slots), ["group", "_p", "_k"])
    base = F.col("_start") + F.col("_c") * F.col("_len")
    return rows.select(
        *[F.col(f"`{c}`") for c in columns],
        "group",
        "block",
        (base + F.col("_r")).alias("release"),
        (base + F.col("_d")).alias("deadline"),
        (base + F.col("_s")).alias("slot"),
        "place",
    )
