"""The trie of conversations: every distinct sequence of first turns is a node, with figures of its subtree.

A conversation is a path of tokens, one token per turn (a digest of role and text, and the text's length).  Equal
paths are one item.  Items are dealt into shards by ranges of paths, so a subtree lies in neighbouring shards, and
in a single one unless its top is the head of a splitter path between two shards.

* Skeleton: the trie of the splitter paths, broadcast to all tasks as the sorted paths and their common lengths.
* Local shards: a task walks through its sorted items with a stack and finishes every node outside the skeleton.
* Reduction: of a skeleton node each shard knows a part (members, leaves, savings outside the skeleton); the parts
  are added up by grouping, and one pass over the skeleton, which is bounded, adds up its subtrees.

Paths are cut at `SEGMENT` turns, so that a row is bounded.  A longer conversation continues in a trie of the next
level, whose root stands for the whole path so far; levels are worked off from the deepest, and the figures of a
root go to the node above that it continues.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from wardline.llm.common import crc_of, require, saved
from wardline.operators.ordered import position
from wardline.operators.same import join_same
from wardline.operators.sizing import checked_broadcast

#: Turns of a path segment.
SEGMENT = 4096
#: Bytes of a token: digest, length.
TOKEN = 20
#: Bytes of paths that a shard is made for, shards at most, and bytes of paths that are sampled for the splitters.
SHARD_BYTES, SHARDS, SAMPLE_BYTES = 32 << 20, 8192, 32 << 20
#: Ids in one piece of a list of members.
_PIECE_BITS = 16
_ROOT = "00" * TOKEN


def token_of(role: str, text: str) -> Column:
    """A turn as a token: the digest of role and text, and the code points of the text, in hex.  A null is empty."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    digest = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    return F.concat(digest, F.lpad(F.hex(F.char_length(text)), 8, "0"))


def rebuilt(turns: DataFrame, group: int = 100, heads: int = 6) -> DataFrame:
    """Conversations that share their first turns: (conv_id, depth, token), from (conv_id, turn, token).

    The first h = crc32(conv_id) % heads turns of conversation c - c % group come first, then the own turns after the
    first h.  Turns go by number (null first), then by token.  Every id has a row of depth 0 without a token; rows
    with a null id are left out.
    """
    rows = position(require(turns, "conv_id", "turn", "token").where("conv_id is not null"), ["conv_id"], ["turn", "token"], F.col("turn"), "pos")
    rows = saved(rows.select("conv_id", "pos", "token"), "turns")
    h = crc_of(F.col("conv_id")) % heads
    base = F.col("conv_id") - F.col("conv_id") % group
    convs = rows.select("conv_id").distinct().select("conv_id", h.alias("h"), base.alias("base"))
    first = rows.where((F.col("pos") < heads) & (F.col("conv_id") == base)).withColumnRenamed("conv_id", "base")
    # At most heads - 1 turns for each of the conversations of a base.
    shared = convs.join(first, "base").where("pos <= h").select("conv_id", F.col("pos").alias("depth"), "token")
    counts = first.groupBy("base").agg(F.count("*").alias("n"))
    own = rows.withColumns({"h": h, "base": base}).where("pos > h").join(counts, "base", "left")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.least(F.col("h"), F.coalesce("n", F.lit(0)))).alias("depth"), "token")
    none = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("string").alias("token"))
    return shared.unionByName(own).unionByName(none)


def _segments(rows: DataFrame, segment: int) -> DataFrame:
    """Per conversation and level: root, key (root and path), next (the root that would follow), and whether it is the last one."""
    tokens = rows.select("conv_id", "depth", F.when(F.col("depth") > 0, F.struct("depth", "token")).alias("t"))
    level = F.floor(F.greatest(F.col("depth") - 1, F.lit(0)) / segment).cast("int")
    # A level has at most `segment` turns of a conversation.
    paths = tokens.groupBy("conv_id", level.alias("level")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda x: x["token"]), "").alias("path")
    )
    w = Window.partitionBy("conv_id").orderBy("level")
    so_far = F.collect_list(F.md5(F.col("path").cast("binary"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    root = lambda hashes: F.concat(F.md5(F.array_join(hashes, "").cast("binary")), F.lit("00000000"))
    return (
        paths.withColumns({"_all": so_far, "last": F.lead("level").over(w).isNull()})
        .withColumn("_before", F.slice("_all", F.lit(1), F.size("_all") - 1))
        .select(
            "conv_id", "level", "last",
            F.unhex(F.concat(F.when(F.size("_before") > 0, root(F.col("_before"))).otherwise(_ROOT), "path")).alias("key"),
            F.unhex(root(F.col("_all"))).alias("next"),
        )
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each key, which come in order."""
    key, state = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["node", "ends"])

    for t in batches:
        keys, ends = [], []
        for k, ids in zip(t.column(0).to_pylist(), t.column(1).to_pylist()):
            if k != key:
                if key is not None:
                    keys.append(key)
                    ends.append(state.hexdigest())
                key, state = k, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ends, pa.string())], names=["node", "ends"])
    if key is not None:
        yield row()


def _ends(segments: DataFrame) -> DataFrame:
    """Per path at which conversations end: the digest of their ids.  Lists are made in pieces of 65,536 ids."""
    last = segments.where("last").select(F.unhex(F.md5("key")).alias("node"), "conv_id")
    pieces = last.groupBy("node", F.shiftright("conv_id", _PIECE_BITS).alias("piece")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids")
    )
    ordered = pieces.repartition("node").sortWithinPartitions("node", "piece").select("node", "ids")
    return ordered.mapInArrow(_digests, "node binary, ends string")


def _common(a: bytes, b: bytes) -> int:
    """Tokens at the head of both paths."""
    most = min(len(a), len(b)) // TOKEN
    n = 0
    while n < most and a[n * TOKEN : (n + 1) * TOKEN] == b[n * TOKEN : (n + 1) * TOKEN]:
        n += 1
    return n


class Skeleton:
    """The trie of sorted splitter paths.  Node (j, d): the head of d tokens of splitter j, the first that has it."""

    def __init__(self, splitters: list[bytes]):
        self.paths = splitters
        self.common = [0, *[_common(a, b) for a, b in zip(splitters, splitters[1:])]]

    def shard(self, key: bytes) -> int:
        return bisect_right(self.paths, key)

    def node(self, j: int, d: int) -> tuple[int, int]:
        while j and self.common[j] >= d:
            j -= 1
        return j, d

    def held(self, shard: int, key: bytes) -> tuple[int, int]:
        """How many tokens of a key are nodes of the skeleton, and of which splitter; only the two next to its shard can have more than others."""
        found = (0, 0)
        for j in (shard - 1, shard):
            if 0 <= j < len(self.paths):
                found = max(found, (_common(self.paths[j], key), j))
        return found


_NODE = (
    "root binary, d int, conv long, parent long, ref_j int, ref_d int, n long, children long, leaves long, saved long, ends string, "
    "skel_j int, length long, up long"
)
_NAMES = [c.split()[0] for c in _NODE.split(", ")]
_TYPES = [{"binary": pa.binary(), "int": pa.int32(), "long": pa.int64(), "string": pa.string()}[c.split()[1]] for c in _NODE.split(", ")]


class _Open:
    """A node on the stack of a shard's walk, with what its subtree adds up to so far."""

    __slots__ = ("conv", "n", "children", "leaves", "saved", "ends", "up", "waiting")

    def __init__(self) -> None:
        self.conv, self.n, self.children, self.leaves, self.saved, self.ends, self.up, self.waiting = None, 0, 0, 0, 0, None, None, []


def _walk(shared):
    """Sorted items of shards to nodes: whole ones outside the skeleton, parts of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skeleton: Skeleton = shared.value
        stack: list[_Open] = []
        key, shard, held, j = b"", None, 0, 0
        out: list[tuple] = []

        def close() -> None:
            """Take the deepest node off the stack."""
            d, node = len(stack), stack.pop()
            root, length = key[:TOKEN], int.from_bytes(key[d * TOKEN - 4 : d * TOKEN])
            at = skeleton.node(j, d) if d <= held else None
            if at:
                out.append((root, d, node.conv, None, None, None, node.n, node.children, node.leaves, node.saved, node.ends, at[0], length, node.up))
                return
            leaves, saving = node.leaves or 1, node.saved + (node.n - 1) * length
            for r, c, *rest in node.waiting:
                out.append((r, d + 1, c, node.conv, None, None, *rest[:-1], None, None, rest[-1]))
            above = stack[-1] if stack else None
            if above is None or d - 1 <= held:
                ref = skeleton.node(j, d - 1) if d > 1 else (None, None)
                out.append((root, d, node.conv, None, *ref, node.n, node.children, leaves, saving, node.ends, None, None, node.up))
            else:
                above.waiting.append((root, node.conv, node.n, node.children, leaves, saving, node.ends, node.up))
            if above:
                above.children += 1
                above.leaves += leaves
                above.saved += saving

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) or [[]] * len(_NAMES)
            made = pa.RecordBatch.from_arrays([pa.array(list(c), ty) for c, ty in zip(columns, _TYPES)], names=_NAMES)
            out.clear()
            return made

        for t in batches:
            names = ("shard", "key", "n", "conv", "ends", "children", "leaves", "saved", "up")
            for here, path, n, conv, ends, children, leaves, saving, up in zip(*(t.column(c).to_pylist() for c in names)):
                same = _common(key, path) if here == shard else 0
                while len(stack) > same:
                    close()
                shard, key = here, path
                held, j = skeleton.held(shard, key)
                while len(stack) < len(key) // TOKEN:
                    stack.append(_Open())
                for node in stack:
                    node.n += n
                    node.conv = conv if node.conv is None else min(node.conv, conv)
                    node.up = up
                end = stack[-1]
                end.ends = ends
                # What hangs below a path that continues on the next level.
                end.children, end.leaves, end.saved = end.children + children, end.leaves + leaves, end.saved + saving
                if len(out) > 20_000:
                    yield flush()
        while stack:
            close()
        yield flush()

    return run


def _reduce(shared):
    """Added parts of skeleton nodes, by (j, d): whole figures, with the splitters' order as the order of the walk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skeleton: Skeleton = shared.value
        rows = [r for t in batches for r in t.to_pylist()]
        at = {(r["skel_j"], r["d"]): r for r in rows}
        for r in rows:
            above = at.get(skeleton.node(r["skel_j"], r["d"] - 1)) if r["d"] > 1 else None
            r["above"], r["parent"] = above, above["conv"] if above else None
        # Backwards, every node comes after all below it.
        for r in reversed(rows):
            r["leaves"] = r["leaves"] or 1
            r["saved"] += (r["n"] - 1) * r["length"]
            if r["above"]:
                r["above"]["children"] += 1
                r["above"]["leaves"] += r["leaves"]
                r["above"]["saved"] += r["saved"]
        for x in range(0, len(rows), 20_000):
            part = [tuple(r.get(c) for c in _NAMES) for r in rows[x : x + 20_000]]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), ty) for c, ty in zip(zip(*part), _TYPES)], names=_NAMES)

    return run


def _dealt(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skeleton: Skeleton = shared.value
        for t in batches:
            shard = pa.array([skeleton.shard(k) for k in t.column("key").to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([shard, *t.columns], names=["shard", *t.schema.names])

    return run


def _level(items: DataFrame, shards: int | None) -> DataFrame:
    """All nodes of a level's items (key, n, conv, ends, children, leaves, saved, up), roots of the level included."""
    spark = items.sparkSession
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("key")), F.lit(0)).alias("b")).first()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = shards or min(SHARDS, max(least, -(-size.b // SHARD_BYTES)))
    # Splitters decide only how the work is dealt.  The sample is bounded in bytes, not only in rows.
    share = min(1.0, 32 * shards / max(size.n, 1), SAMPLE_BYTES / max(size.b, 1))
    sample = sorted(bytes(r.key) for r in items.select("key").sample(share, seed=11).collect())
    splitters = sorted({sample[len(sample) * i // shards] for i in range(1, shards)}) if sample else []
    shared = spark.sparkContext.broadcast(Skeleton(splitters))
    dealt = items.select("key", "n", "conv", "ends", "children", "leaves", "saved", "up")
    schema = "shard int, key binary, n long, conv long, ends string, children long, leaves long, saved long, up long"
    dealt = dealt.mapInArrow(_dealt(shared), schema).repartitionById(len(splitters) + 1, F.col("shard"))
    nodes = saved(dealt.sortWithinPartitions("shard", "key").mapInArrow(_walk(shared), _NODE), "walked")
    parts = nodes.where("skel_j is not null").groupBy("skel_j", "d").agg(
        F.first("root").alias("root"), F.min("conv").alias("conv"), F.sum("n").alias("n"), F.sum("children").alias("children"),
        F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.max("ends").alias("ends"), F.max("length").alias("length"), F.max("up").alias("up"),
    )
    # At most SAMPLE_BYTES / TOKEN nodes: the splitters are a part of the sample.
    whole = parts.repartition(1).sortWithinPartitions("skel_j", "d").mapInArrow(_reduce(shared), _NODE)
    whole = saved(whole, "skeleton")
    known = checked_broadcast(whole.select(F.col("skel_j").alias("ref_j"), F.col("d").alias("ref_d"), F.col("conv").alias("ref_conv")))
    local = nodes.where("skel_j is null").join(known, ["ref_j", "ref_d"], "left").withColumn("parent", F.coalesce("parent", "ref_conv"))
    columns = ["root", "d", "conv", "n", "children", "leaves", "saved", "ends"]
    # Above the first turns of a level stands the node that the level continues.
    parent = F.when((F.col("d") == 2) & F.col("up").isNotNull(), F.col("up")).otherwise(F.col("parent")).alias("parent")
    return saved(local.select(*columns, parent).unionByName(whole.select(*columns, parent)), "nodes")


def trie(rows: DataFrame, segment: int = SEGMENT, shards: int | None = None) -> DataFrame:
    """Per node of the trie of `rows` (conv_id, depth, token as `token_of` makes it; depth 0 for every conversation, without one).

    conv_id (its smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves (nodes
    without children in the subtree), saved_tokens (over the subtree, (n_convs - 1) times the code points of the last
    text) and ends_sha256 (of the ids of the conversations that end here, ascending, with commas; of the empty text
    if there are none).  Turns are equal if their tokens are.  Depths of a conversation run from 1 without gaps.
    An empty table has no root.
    """
    segments = saved(_segments(rows, segment), "segments")
    ends = saved(_ends(segments), "ends")
    last = segments.agg(F.max("level")).first()[0]
    hung = out = None
    for level in range(-1 if last is None else last, -1, -1):
        own = segments.where(F.col("level") == level)
        items = own.groupBy("key", "next").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv"), F.bool_or("last").alias("ending"))
        items = items.withColumn("node", F.unhex(F.md5("key"))).join(ends, "node", "left")
        up = F.lit(None).cast("long").alias("up")
        if level:
            above = segments.where(F.col("level") == level - 1).groupBy(F.col("next").alias("root")).agg(F.min("conv_id").alias("up"))
            items = items.withColumn("root", F.substring("key", 1, TOKEN)).join(above, "root")
            up = F.col("up")
        below = [F.lit(0).cast("long").alias(c) for c in ("children", "leaves", "saved")]
        if hung is not None:
            items = items.join(hung, "next", "left")
            below = [F.coalesce(c, F.lit(0)).alias(c) for c in ("children", "leaves", "saved")]
        items = saved(items.select("key", "n", "conv", "ends", *below, up), "items")
        nodes = _level(items, shards)
        hung = nodes.where("d = 1").select(F.col("root").alias("next"), "children", "leaves", "saved") if level else None
        nodes = nodes.where("d > 1") if level else nodes
        nodes = nodes.withColumn("depth", F.col("d").cast("long") - 1 + level * segment)
        out = nodes if out is None else out.unionByName(nodes)
    if out is None:
        none = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
        return rows.sparkSession.createDataFrame([], none)
    return out.select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
