"""Connected components of a link table by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardline.session import checkpointed


def _state(edges: DataFrame) -> tuple:
    # A sum over all edges that changes when any edge does; wide enough not to overflow.
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row.n, row.s


def components(links: DataFrame, a: str, b: str, rounds: int | None = None) -> DataFrame:
    """(node, component): the smallest node that `node` reaches; nodes without links are left out.

    With `rounds`, at most so many: nodes of equal component are then connected, but connected nodes may
    still have unlike ones.

    Every round moves links towards the smallest neighbour.  The smallest neighbour is a plain minimum, so
    it is aggregated before the shuffle, and the join back is one that adaptive execution may split: a node
    with a third of all links needs no task of its own.  The number of rounds grows with the logarithm of
    the longest chain.  Each round is checkpointed in the shared folder.  Nulls link with nothing.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    )
    edges = checkpointed(edges.distinct())
    state = _state(edges) if rounds is None else None
    while rounds is None and state[0] or rounds:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Large star: every larger neighbour goes to the smallest one.  u is edge end, so no self links.
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # Small star: the smaller neighbours, and the node, go to the smallest one.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = checkpointed(small.unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        edges = after
        if rounds is not None:
            rounds -= 1
            continue
        new = _state(after)
        if new == state:
            break
        state = new
    low = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    # At the end every node points at its root, and roots point at nothing; before, the smaller one counts.
    if state is None:
        return low.unionAll(roots).groupBy("node").agg(F.min("component").alias("component"))
    return low.unionAll(roots)
