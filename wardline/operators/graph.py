"""Graph queries over edge tables (src, dst).

Loops cut their lineage with reliable checkpoints after every round, so a lost
executor costs one round.  Edges are joined with the (much smaller) frontier or
node table; where one node has a large part of all edges, adaptive execution
splits that join partition, and the aggregates combine before their shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from wardline.operators.sizing import checked_broadcast
from wardline.session import checkpointed


def build_edges(events: DataFrame) -> DataFrame:
    """Flow edges with count, weight, first and last time; no self-loops."""
    return (
        events.filter(F.col("src") != F.col("dst"))
        .groupBy("src", "dst")
        .agg(
            F.count("*").alias("n"),
            F.sum(F.col("magnitude").cast("decimal(18,2)")).cast("decimal(18,2)").alias("bytes"),
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
        )
    )


#: Rows that the ends of one node may make in one task: more go to several.
HUB_ROWS = 10_000_000


def _salted(found: DataFrame, hop: DataFrame, hub_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of a hop with `_salt`: the ends of a hub are dealt into parts, and its starts go to every part.

    A hub is a node whose starts times ends are more than `hub_rows`; all other nodes have one part.
    """
    ins = found.groupBy("node").agg(F.count("*").alias("_in"))
    outs = hop.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("_out"))
    salts = F.least(F.ceil(F.col("_in") * F.col("_out") / F.lit(hub_rows)), F.col("_out")).cast("int")
    hubs = ins.join(outs, "node").select("node", salts.alias("_salts")).filter("_salts > 1")
    hubs = checked_broadcast(hubs)
    parts = F.coalesce("_salts", F.lit(1))
    starts = found.join(hubs, "node", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_salts")
    ends = hop.join(hubs, F.col("src") == F.col("node"), "left").withColumn("_salt", F.pmod(F.xxhash64("dst"), parts).cast("int"))
    return starts, ends.drop("_salts", "node")


def graph_pattern(
    edges: DataFrame, path: Sequence[str], filters: dict[int, Column] | None = None, hub_rows: int = HUB_ROWS
) -> DataFrame:
    """Typed path match over (src, dst, kind): where paths of these kinds start and end, and how many there are.

    Paths that meet in a node are counted, not listed.  A hub's starts and ends still meet in pairs, which are
    the result; its ends are dealt into parts, so that no task has more than about `hub_rows` of them.
    `filters` holds, per 0-based hop, a predicate on the edge's own columns.
    """
    filters = filters or {}
    found = None
    for i, kind in enumerate(path):
        hop = edges.filter(F.col("kind") == kind)
        if i in filters:
            hop = hop.filter(filters[i])
        hop = hop.groupBy("src", "dst").agg(F.count("*").alias("_m"))
        if found is None:
            found = hop.select(F.col("src").alias("start"), F.col("dst").alias("node"), F.col("_m").alias("n_paths"))
        else:
            starts, ends = _salted(found, hop, hub_rows)
            found = (
                starts.join(ends, (F.col("node") == F.col("src")) & (starts["_salt"] == ends["_salt"]))
                .groupBy("start", F.col("dst").alias("node"))
                .agg(F.sum(F.col("n_paths") * F.col("_m")).alias("n_paths"))
            )
    return found.withColumnRenamed("node", "end")


def k_hop(edge: DataFrame, seeds: DataFrame, k: int | None, by: Sequence[str] = ()) -> DataFrame:
    """Nodes within k hops of the seeds (`node`, and `by` columns that keep searches apart) with the least hop number.

    k of None goes on until nothing new is found; cycles end by themselves.
    """
    links = checkpointed(edge.select("src", "dst").distinct())
    ids = [*by, "node"]
    frontier = checkpointed(seeds.select(*ids).distinct().withColumn("hops", F.lit(0)))
    seen, h = frontier, 0
    while k is None or h < k:
        h += 1
        step = frontier.join(links, F.col("node") == F.col("src")).select(*by, F.col("dst").alias("node")).distinct()
        frontier = checkpointed(step.join(seen.select(*ids), ids, "left_anti").withColumn("hops", F.lit(h)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if h % 8 == 0:
            seen = checkpointed(seen)
    return seen


def degree_centrality(edge: DataFrame) -> DataFrame:
    """In, out and total degree, weighted strength, and total degree scaled by n - 1."""
    # Side 0 is the source, side 1 the destination; one pass over the edges for both ends.
    ends = edge.select("bytes", F.posexplode(F.array("src", "dst")).alias("side", "node"))
    nodes = checkpointed(ends.groupBy("node").agg(
        F.sum("side").alias("in_degree"),
        F.sum(1 - F.col("side")).alias("out_degree"),
        F.count("*").alias("total"),
        F.sum("bytes").alias("strength"),
    ))
    n = nodes.agg(F.count("*")).scalar()
    return nodes.withColumn("centrality", F.when(n > 1, F.col("total") / (n - 1)).otherwise(0.0))


def pagerank(edge: DataFrame, d: float = 0.85, iters: int = 10, slice_edges: int = 5_000_000) -> DataFrame:
    """PageRank with a fixed number of iterations; the mass of dangling nodes is spread evenly.

    The edges are partitioned once and stay where they are; a round moves only one number per node.
    A node with very many edges has them in slices of about `slice_edges`, each a partition key of its own.
    """
    spark = edge.sparkSession
    plain = checkpointed(edge.select("src", "dst").distinct())
    out = plain.groupBy("src").agg(F.count("*").alias("_out"))
    nodes = plain.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    nodes = checkpointed(nodes.join(out.withColumnRenamed("src", "node"), "node", "left"))
    slices = F.ceil(F.col("_out") / F.lit(slice_edges)).cast("long")
    place = ["src", "_slice"]
    links = (
        plain.join(nodes.select(F.col("node").alias("src"), slices.alias("_n")), "src")
        .select("src", "dst", F.pmod(F.xxhash64("dst"), F.col("_n")).alias("_slice"))
        .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *place)
        .sortWithinPartitions(*place)
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    # Spark knows how a cached frame is partitioned only once it is filled.
    links.count()
    n = nodes.count()
    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    for _ in range(iters):
        # The rank a node passes on is known before the join: one division per node, not per edge.
        given = ranks.filter(F.col("_out").isNotNull()).select(
            F.col("node").alias("src"),
            (F.col("rank") / F.col("_out")).alias("_give"),
            F.explode(F.sequence(F.lit(0).cast("long"), slices - 1)).alias("_slice"),
        )
        got = links.join(given, place).groupBy(F.col("dst").alias("node")).agg(F.sum("_give").alias("_got"))
        lost = ranks.filter(F.col("_out").isNull()).agg(F.coalesce(F.sum("rank"), F.lit(0.0))).scalar()
        new = F.lit((1 - d) / n) + F.lit(d) * (F.coalesce(F.col("_got"), F.lit(0.0)) + lost / F.lit(n))
        ranks = checkpointed(nodes.join(got, "node", "left").select("node", "_out", new.alias("rank")))
    links.unpersist()
    return ranks.select("node", "rank")


_WORD = 64


def bit_search(edge: DataFrame, starts: DataFrame, k: int | None) -> tuple[DataFrame, DataFrame]:
    """(numbered, reached) of searches from many starts at once, 64 of them in one word per node.

    numbered: (node, block, bit) of each start.  reached: (block, node, bits, hops), where the bits are the starts of
    the block that reach the node for the first time in `hops` steps.  A round has at most nodes x blocks rows and
    combines its words with `bit_or` before the shuffle.  k of None goes on until nothing new is found.
    """
    links = checkpointed(edge.select("src", "dst").distinct())
    # Numbers rise by one within a partition, so words are full but for the last one of each.
    numbered = starts.select("node").distinct().withColumn("_n", F.monotonically_increasing_id())
    block, bit = F.shiftright("_n", 6), (F.col("_n") % _WORD).cast("int")
    numbered = checkpointed(numbered.select("node", block.alias("block"), bit.alias("bit")))
    one = F.expr("shiftleft(1L, bit)")
    frontier = checkpointed(numbered.groupBy("block", "node").agg(F.bit_or(one).alias("bits")).withColumn("hops", F.lit(0)))
    seen, reached, h = frontier.drop("hops"), frontier, 0
    while k is None or h < k:
        h += 1
        step = frontier.join(links, F.col("node") == F.col("src")).groupBy("block", F.col("dst").alias("node")).agg(F.bit_or("bits").alias("_new"))
        fresh = step.join(seen, ["block", "node"], "left")
        new = F.col("_new").bitwiseAND(F.bitwise_not(F.coalesce("bits", F.lit(0).cast("long"))))
        fresh = fresh.select("block", "node", new.alias("bits")).filter("bits <> 0")
        frontier = checkpointed(fresh.withColumn("hops", F.lit(h)))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
        if h % 8 == 0:
            reached = checkpointed(reached)
        seen = checkpointed(seen.unionByName(frontier.drop("hops")).groupBy("block", "node").agg(F.bit_or("bits").alias("bits")))
    return numbered, reached


def per_start(reached: DataFrame, numbered: DataFrame, value: Column | None = None, name: str = "n") -> DataFrame:
    """(node, hops, `name`) for each start: how many nodes it reaches in `hops` steps, or the sum of `value` over them.

    Each block has one sum per bit, so the rows that meet are as many as the blocks and hops.
    """
    has = lambda i: F.expr(f"shiftrightunsigned(bits, {i}) & 1")
    one = lambda i: F.sum(has(i)) if value is None else F.sum(F.when(has(i) == 1, value))
    sums = reached.groupBy("block", "hops").agg(*[one(i).alias(f"_{i}") for i in range(_WORD)])
    each = sums.select("block", "hops", F.posexplode(F.array(*[F.col(f"_{i}") for i in range(_WORD)])).alias("bit", name))
    return each.join(numbered, ["block", "bit"]).select("node", "hops", name)


def harmonic_closeness(edge: DataFrame, k: int) -> DataFrame:
    """Sum of 1/hops over the nodes that a node reaches within k hops; exact at every size.

    All nodes are followed at once, 64 of them in one word per node (`bit_search`).  On large dense graphs
    `harmonic_closeness_approx` does with one sketch per node.
    """
    nodes = edge.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    numbered, reached = bit_search(edge, nodes, k)
    near = F.sum(F.when(F.col("hops") > 0, F.col("n") / F.col("hops")))
    return per_start(reached, numbered).groupBy("node").agg(F.coalesce(near, F.lit(0.0)).alias("closeness"))


def harmonic_closeness_approx(edge: DataFrame, k: int, lg_k: int = 12) -> DataFrame:
    """`harmonic_closeness` by sketches.

    One distinct-count sketch per node instead of all (node, node) pairs: the ball of radius h is
    the union of the neighbours' balls of radius h - 1.  Counts are exact while a ball is small for
    the sketch (some hundred nodes at the default size) and within its error beyond.
    """
    links = checkpointed(edge.select("src", "dst").distinct())
    nodes = links.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    ball = checkpointed(nodes.groupBy("node").agg(F.hll_sketch_agg("node", lg_k).alias("ball")).withColumns(
        {"size": F.lit(1).cast("long"), "closeness": F.lit(0.0)}
    ))
    for h in range(1, k + 1):
        around = (
            links.join(ball.select(F.col("node").alias("dst"), "ball"), "dst")
            .select(F.col("src").alias("node"), "ball")
            .groupBy("node")
            .agg(F.hll_union_agg("ball").alias("_around"))
        )
        grown = ball.join(around, "node", "left").withColumn(
            "_ball", F.when(F.col("_around").isNull(), F.col("ball")).otherwise(F.hll_union("ball", "_around"))
        )
        size = F.greatest(F.hll_sketch_estimate("_ball"), F.col("size"))
        ball = checkpointed(
            grown.select(
                "node",
                F.col("_ball").alias("ball"),
                size.alias("size"),
                (F.col("closeness") + (size - F.col("size")) / F.lit(h)).alias("closeness"),
            )
        )
    return ball.select("node", "closeness")


def blast_radius(edge: DataFrame, node_value: DataFrame, seeds: DataFrame) -> DataFrame:
    """For each seed that reaches others the number and the total worth of all other nodes it reaches, and the depth.

    `seeds` has `node`, `node_value` has one row per node (`node`, `worth`).  All seeds are followed at once, 64 of
    them in one word per node.
    """
    numbered, reached = bit_search(edge, seeds, None)
    reached = checkpointed(reached.filter("hops > 0").join(node_value, "node", "left"))
    counts = per_start(reached, numbered).filter("n > 0")
    worth = per_start(reached, numbered, F.col("worth").cast("decimal(18,2)"), "worth")
    return (
        counts.join(worth, ["node", "hops"])
        .groupBy(F.col("node").alias("seed"))
        .agg(
            F.sum("n").alias("n_reached"),
            F.coalesce(F.sum("worth"), F.lit(0)).cast("double").alias("worth"),
            F.max("hops").alias("depth"),
        )
    )


def components(edge: DataFrame) -> DataFrame:
    """Connected components of the undirected graph; the label is the least node id.

    Alternating large-star and small-star steps (Kiveris et al., SoCC 2014): every step is one
    minimum per node joined back to the edges, and the number of rounds grows with the logarithm
    of the graph, not with its diameter.
    """
    nodes = checkpointed(edge.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    pairs = checkpointed(
        edge.filter(F.col("src") != F.col("dst"))
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct()
    )
    state = None
    while True:
        pairs = checkpointed(_small_star(_large_star(pairs)))
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    labels = pairs.select(F.col("u").alias("node"), F.col("v").alias("_least"))
    return nodes.join(labels, "node", "left").select("node", F.coalesce("_least", "node").alias("component"))


def _large_star(pairs: DataFrame) -> DataFrame:
    both = pairs.select(
        F.explode(
            F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b")))
        ).alias("e")
    ).select("e.*")
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    # Here every pair has v < u.
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    moved = pairs.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
