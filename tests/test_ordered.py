"""Ordered computations on a table in which one key holds a third of all rows."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from wardline.operators import detect, enrich
from wardline.operators.ordered import (
    Running, exact_quantiles, following, nth_before, parts, position, previous, profile_keys, running, value_ranks,
)


@pytest.fixture(scope="module")
def data():
    rnd = random.Random(5)
    rows = []
    for i in range(1500):
        key = 0 if i % 3 == 0 else rnd.randint(1, 60)
        # Few distinct times: many ties, which the id must order.
        rows.append((i, key, rnd.randint(0, 400), rnd.choice([None, 1.5, 2.5, 7.0]), rnd.choice("ab")))
    return rows


@pytest.fixture(scope="module")
def df(spark, data):
    return spark.createDataFrame(data, "id long, key long, t long, x double, c string")


def ordered(data):
    by_key = defaultdict(list)
    for r in sorted(data, key=lambda r: (r[1], r[2], r[0])):
        by_key[r[1]].append(r)
    return by_key


def expected(data):
    out = {}
    for rows in ordered(data).values():
        total, best, last = 0, None, None
        for n, r in enumerate(rows):
            before = rows[n - 1] if n else None
            after = rows[n + 1] if n + 1 < len(rows) else None
            total += r[2]
            out[r[0]] = (
                before and before[0], after and after[0], last, best, total, n + 1, rows[n - 3][0] if n >= 3 else None
            )
            if r[3] is not None:
                last, best = r[3], r[3] if best is None else max(best, r[3])
    return out


@pytest.mark.parametrize("hot", ["plain", "one heavy key", "all heavy"])
def test_running_values(spark, data, df, hot):
    if hot != "plain":
        spark.conf.set("wardline.hot.rows", "100" if hot == "one heavy key" else "0")
        spark.conf.set("wardline.hot.pieces", "9")
    try:
        keys, order, at = ["key"], ["t", "id"], F.col("t")
        split = profile_keys(df, keys, at)
        assert len(split.hashes) == {"plain": 0, "one heavy key": 1, "all heavy": 61}[hot]
        out = running(
            df, keys, order, at,
            [
                Running("p", "previous", F.col("id")), Running("l", "last", F.col("x")),
                Running("m", "max", F.col("x")), Running("s", "sum", F.col("t"), strict=False),
            ],
        )
        out = nth_before(position(following(out, keys, order, at, f=F.col("id")), keys, order, at), keys, order, at, 3, "n3", F.col("id"))
        got = {r.id: (r.p, r.f, r.l, r.m, r.s, r.seq, r.n3) for r in out.collect()}
    finally:
        spark.conf.unset("wardline.hot.rows")
        spark.conf.unset("wardline.hot.pieces")
    assert got == expected(data)


def test_null_keys_and_values_in_heavy_groups(heavy):
    rows = [(i, None if i % 2 else 1, None if i % 5 == 0 else i) for i in range(40)]
    df = heavy.createDataFrame(rows, "id long, key long, t long")
    out = {r.id: r.p for r in previous(df, ["key"], ["t", "id"], F.col("t"), p=F.col("id")).collect()}
    want = {}
    for k in (None, 1):
        mine = sorted((r for r in rows if r[1] == k), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
        for n, r in enumerate(mine):
            want[r[0]] = mine[n - 1][0] if n else None
    assert out == want


def test_exact_quantiles_and_ranks(heavy, data):
    df = heavy.createDataFrame([(r[4], float(r[2])) for r in data], "g string, v double")
    got = {r.g: (r.q, r.h) for r in exact_quantiles(df, ["g"], "v", {"q": 0.37, "h": 0.5}).collect()}
    for g in "ab":
        vals = sorted(float(r[2]) for r in data if r[4] == g)
        for i, p in enumerate((0.37, 0.5)):
            at = (len(vals) - 1) * p
            lo = int(at)
            hi = min(lo + 1, len(vals) - 1)
            assert got[g][i] == pytest.approx(vals[lo] + (vals[hi] - vals[lo]) * (at - lo))
    ranks = {(r.g, r.v): (r.below, r.distinct_below, r.cnt) for r in value_ranks(df, ["g"], "v").collect()}
    for (g, v), (below, distinct, cnt) in ranks.items():
        vals = [float(r[2]) for r in data if r[4] == g]
        assert (below, distinct, cnt) == (sum(x < v for x in vals), len({x for x in vals if x < v}), vals.count(v))


def test_parts_bound_every_group(heavy, df):
    cut = parts(df, ["key"], ["t", "id"], F.col("t"), 7).groupBy("key", "part").count()
    sizes = defaultdict(list)
    for r in cut.collect():
        sizes[r.key].append((r.part, r["count"]))
    for s in sizes.values():
        assert [p for p, _ in sorted(s)] == list(range(len(s)))
        assert all(n == 7 for _, n in sorted(s)[:-1]) and sorted(s)[-1][1] <= 7


def test_correlation_equals_brute_force(heavy, data):
    df = heavy.createDataFrame(data, "event_id long, key long, t long, x double, c string").withColumn(
        "ts", F.timestamp_seconds("t").cast("timestamp_ntz")
    )
    got = enrich.correlate_pairs(df.filter("c = 'a'"), df.filter("c = 'b'"), "key", 20)
    got = {r.effect_id: (r.cause_id, r.n_causes) for r in got.collect()}
    want = {}
    for e in (r for r in data if r[4] == "b"):
        causes = [r for r in data if r[4] == "a" and r[1] == e[1] and 0 < e[2] - r[2] <= 20]
        if causes:
            want[e[0]] = (max(causes, key=lambda r: (r[2], r[0]))[0], len(causes))
    assert got == want


def test_sessions_equal_brute_force(heavy, data):
    df = heavy.createDataFrame(data, "event_id long, key long, t long, x double, c string").withColumns(
        {"ts": F.timestamp_seconds("t").cast("timestamp_ntz"), "level": F.lit(1)}
    )
    got = sorted((r.key, r.n) for r in detect.sessionize_alerts(df, "key", 9).collect())
    want = []
    for key, rows in ordered(data).items():
        n = 0
        for i, r in enumerate(rows):
            if i and r[2] - rows[i - 1][2] > 9:
                want.append((key, n))
                n = 0
            n += 1
        want.append((key, n))
    assert got == sorted(want)
