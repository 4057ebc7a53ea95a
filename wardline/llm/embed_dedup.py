"""Near copies among embeddings: random-hyperplane signatures in several tables, exact cosine, components.

Every table cuts space by `bits` random hyperplanes; vectors with the same signs meet in a cell.  Two vectors
with cosine c get the same sign with chance 1 - acos(c) / pi, so a pair of cosine 0.93 is missed by all of
24 tables of 10 bits with a chance of 4e-4, one of 0.95 with 3e-5.  All pairs of a cell are compared by their
exact cosine in blocks of a matrix product; only sums per vector and a spanning set of links leave the task.
A pair counts in the first table in which it meets.  Cells of more rows than `tile` are dealt into tiles, and
each pair of tiles is a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wardline.llm import words as W
from wardline.llm.common import require, saved
from wardline.llm.links import components

U = np.uint64
BITS, TABLES, SEED, TILE = 10, 24, 1729, 2048


def _planes(dim: int, tables: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, tables * bits))


def _cells(tables: int, bits: int, seed: int, dtype):
    """(cell, table, node, copies, signs, v): one row per vector and table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = 1 << np.arange(bits, dtype=np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                t = whole.slice(at, 2000)
                lists = t.column("embedding")
                sizes = np.diff(lists.offsets.to_numpy())
                for dim in np.unique(sizes):
                    part = t.filter(pa.array(sizes == dim))
                    v = part.column("embedding").flatten().to_numpy().reshape(-1, dim).astype(dtype)
                    unit = v.astype(float)
                    unit /= np.abs(unit).max(1, keepdims=True)
                    signs = (unit @ _planes(int(dim), tables, bits, seed) > 0).reshape(len(v), tables, bits) @ weight
                    place = W.mix(W.mix(part.column("label").to_numpy().astype(np.int64).view(U) + U(dim << 40))[:, None] + np.arange(tables, dtype=U))
                    cell = W.mix(place ^ W.mix(signs.astype(U) + U(1))).view(np.int64)
                    rows = np.repeat(np.arange(len(v)), tables)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(cell.ravel()),
                            pa.array(np.tile(np.arange(tables, dtype=np.int32), len(v))),
                            part.column("node").take(pa.array(rows)),
                            part.column("copies").take(pa.array(rows)),
                            pa.array([x.tobytes() for x in signs.astype(np.uint32)], pa.binary()).take(pa.array(rows)),
                            pa.array([x.tobytes() for x in v], pa.binary()).take(pa.array(rows)),
                        ],
                        names=["cell", "table", "node", "copies", "signs", "v"],
                    )

    return run


def _runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Tables that end where a run of equal keys ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        changed = np.zeros(batch.num_rows, bool)
        for k in keys:
            c = batch.column(k).to_numpy()
            changed[1:] |= c[1:] != c[:-1]
            changed[0] |= bool(held) and held[-1].column(k)[-1].as_py() != c[0]
        edges = np.flatnonzero(changed)
        if len(edges):
            held.append(batch.slice(0, edges[-1]))
            if any(b.num_rows for b in held):
                yield pa.Table.from_batches(held).combine_chunks()
            held = [batch.slice(edges[-1])]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _compared(least: float, dtype):
    """Per run: (node, links, root): copies linked for the first time, and the smallest node linked within it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, "cell", "pair"):
            cell, pair, table, node, copies, tile = (t.column(c).to_numpy() for c in ("cell", "pair", "table", "node", "copies", "tile"))
            at = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (pair[1:] != pair[:-1])]))
            to = np.concatenate([at[1:], [len(cell)]])
            signs_at, v_at = t.column("signs"), t.column("v")
            out = []
            for a, b in zip(at, to):
                if b - a < 2:
                    continue
                v = np.frombuffer(b"".join(v_at.slice(a, b - a).to_pylist()), dtype).reshape(b - a, -1).astype(float)
                v /= np.abs(v).max(1, keepdims=True)
                v /= np.sqrt((v * v).sum(1, keepdims=True))
                near = np.empty((b - a, b - a), bool)
                for x in range(0, b - a, 512):
                    near[x : x + 512] = v[x : x + 512] @ v.T >= least
                np.fill_diagonal(near, False)
                if pair[a] >= 0 and tile[a:b].min() != tile[a:b].max():
                    # A pair of different tiles: the others are compared within their own.
                    near &= tile[a:b][:, None] != tile[a:b][None, :]
                if not near.any():
                    continue
                label = node[a:b].copy()
                while True:
                    low = np.concatenate([np.where(near[x : x + 512], label[None, :], np.iinfo(np.int64).max).min(1) for x in range(0, b - a, 512)])
                    low = np.minimum(low, label)
                    if (low == label).all():
                        break
                    label = low
                signs = np.frombuffer(b"".join(signs_at.slice(a, b - a).to_pylist()), np.uint32).reshape(b - a, -1)
                for earlier in range(table[a]):
                    near &= signs[:, earlier][:, None] != signs[:, earlier][None, :]
                some = np.flatnonzero(label != node[a:b])
                links = np.concatenate([near[x : x + 512] @ copies[a:b] for x in range(0, b - a, 512)])
                keep = np.union1d(some, np.flatnonzero(links))
                out.append((node[a:b][keep], links[keep], label[keep]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)], names=["node", "links", "root"])

    return run


def near_copies(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    least: float = 0.93,
    tables: int = TABLES,
    bits: int = BITS,
    tile: int = TILE,
    seed: int = SEED,
) -> DataFrame:
    """Per row: its id, n_links (rows linked with it directly), component_id, kept (it is its component's id).

    Rows link if their labels (whole numbers) are equal and not null and the cosine of their embeddings, in
    double precision, is at least `least`.  A null, empty or zero embedding, one with a null or non-finite
    component, and a null label link with nothing; embeddings of unlike length do not link.  Equal vectors
    are compared once, and count by their number.  component_id is the smallest id reached; a row with a null
    id takes part, and is named only by other ids.  No rows give no rows.
    """
    rows = require(vectors, vec_id, embedding, label).toDF("id", "embedding", "label")
    id_type = rows.schema["id"].dataType.simpleString()
    dtype = np.float32 if "float" in rows.schema["embedding"].dataType.simpleString() else np.float64
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)
    rows = saved(rows.withColumn("usable", F.coalesce(usable, F.lit(False))).withColumn("row", F.monotonically_increasing_id()), "vectors")
    nodes = saved(
        rows.where("usable").groupBy("label", "embedding").agg(F.min("row").alias("node"), F.min("id").alias("first_id"), F.count("*").alias("copies")),
        "distinct-vectors",
    )
    spread = nodes.select("embedding", F.col("label").cast("long").alias("label"), "node", "copies").mapInArrow(
        _cells(tables, bits, seed, dtype), "cell long, table int, node long, copies long, signs binary, v binary"
    )
    spread = saved(spread, "hashed")
    # Large cells are dealt into tiles; every row goes to each pair of tiles that its own is part of.
    large = spread.groupBy("cell").count().where(F.col("count") > 2 * tile).select("cell", F.ceil(F.col("count") / tile).cast("long").alias("tiles"))
    spread = spread.join(large, "cell", "left").withColumn("tile", F.pmod(F.xxhash64("node"), F.coalesce("tiles", F.lit(1))))
    ends = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda t: F.least(t, F.col("tile")) * F.col("tiles") + F.greatest(t, F.col("tile"))
    )
    spread = spread.withColumn("pair", F.explode(F.when(F.col("tiles").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(ends))).drop("tiles")
    ordered = spread.repartition("cell", "pair").sortWithinPartitions("cell", "pair", "node")
    found = saved(ordered.mapInArrow(_compared(least, dtype), "node long, links long, root long"), "compared")

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = components(found, "node", "root")
    named = nodes.join(links, "node", "left").join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = named.join(smallest, "component").select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.where("usable").select("id", "label", "embedding").join(named, ["label", "embedding"]).select("id", "n_links", "component_id")
    out = out.unionAll(rows.where("not usable").select("id", F.lit(0).cast("long"), "id"))
    return out.select(
        F.col("id").cast(id_type).alias(vec_id), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )
