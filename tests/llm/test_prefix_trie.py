"""The trie of conversations against brute force, over segments, shards and odd rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from wardline.llm import prefix_trie

LENGTHS = {"a": 1, "b": 22, "c": 3}


def token(w):
    return None if w is None else hashlib.md5(w.encode()).hexdigest() + "%08X" % LENGTHS[w]


def brute(paths):
    nodes = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes.setdefault(p[:d], []).append(c)
    kids = lambda z: sum(len(q) == len(z) + 1 and q[: len(z)] == z for q in nodes)
    out = []
    for p, m in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        ends = ",".join(str(c) for c in sorted(m) if len(paths[c]) == len(p))
        saved = sum((len(nodes[q]) - 1) * (LENGTHS[q[-1]] if q else 0) for q in below)
        above = min(nodes[p[:-1]]) if p else None
        out.append((min(m), len(p), above, len(m), kids(p), sum(not kids(q) for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, paths, *args):
    rows = [(c, d + 1, token(w)) for c, p in paths.items() for d, w in enumerate(p)] + [(c, 0, None) for c in paths]
    df = spark.createDataFrame(rows, "conv_id long, depth long, token string")
    return sorted((tuple(r) for r in prefix_trie.trie(df, *args).collect()), key=repr)


@pytest.mark.parametrize("segment, shards", [(4096, None), (4096, 7), (2, 3), (3, 1)])
def test_nodes_are_those_of_brute_force(spark, segment, shards):
    rng = random.Random(segment)
    paths = {c: tuple(rng.choice("abc") for _ in range(rng.choice([0, 1, 2, 3, 5, 7]))) for c in range(-3, 40)}
    assert found(spark, paths, segment, shards) == brute(paths)


def test_a_third_of_all_conversations_may_be_copies(spark):
    paths = {c: ("a", "b") if c % 3 == 0 else ("a", *"abc"[c % 2 : c % 2 + 1] * (c % 5)) for c in range(300)}
    assert found(spark, paths, 4096, 6) == brute(paths)
    assert found(spark, {5: ()}) == brute({5: ()})


def test_skeleton_nodes_are_named_by_their_first_splitter():
    t = lambda s: b"".join(c.encode().ljust(prefix_trie.TOKEN) for c in s)
    skeleton = prefix_trie.Skeleton([t("ab"), t("abc"), t("ac"), t("b")])
    assert [skeleton.node(j, d) for j, d in ((1, 2), (1, 3), (2, 1), (2, 2), (3, 1))] == [(0, 2), (1, 3), (0, 1), (2, 2), (3, 1)]
    assert skeleton.held(skeleton.shard(t("abb")), t("abb"))[0] == 2 and skeleton.held(skeleton.shard(t("c")), t("c"))[0] == 0


def test_conversations_are_rebuilt(spark):
    rows = [(c, t, "user", f"{c} {t}") for c in (0, 5, 7, 205) for t in range(7)] + [(9, None, None, None), (9, 1, "user", "x"), (None, 1, "user", "gone")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("odd", F.lit(1))
    named = turns.withColumn("token", prefix_trie.token_of("role", "text"))
    got = {}
    for r in prefix_trie.rebuilt(named).collect():
        got.setdefault(r.conv_id, {})[r.depth] = r.token
    import zlib

    own = {}
    for r in named.where("conv_id is not null").orderBy(F.asc_nulls_first("turn")).collect():
        own.setdefault(r.conv_id, []).append(r.token)
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        assert got[c] == dict(enumerate([None, *own.get(c - c % 100, [])[:h], *mine[h:]]))
    # A null role or text is empty.
    one = spark.createDataFrame([(None, None), ("", "")], "role string, text string").select(prefix_trie.token_of("role", "text").alias("t")).collect()
    assert one[0].t == one[1].t
    empty = prefix_trie.trie(prefix_trie.rebuilt(named.limit(0)))
    assert empty.count() == 0 and "ends_sha256" in empty.columns


def test_a_very_long_conversation(spark):
    paths = {1: tuple("ab" * 150), 2: tuple("ab" * 150), 3: tuple("ab" * 100 + "c")}
    assert found(spark, paths, 64, 3) == brute(paths)
