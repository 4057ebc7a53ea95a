"""Operators whose work must not grow with pairs, groups or copies: results by brute force, and the size of what lies between."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.operators import detect, enrich, graph, keys, response, risk
from wardline.operators.ordered import exact_quantiles, value_ranks

T0 = dt.datetime(2024, 1, 1)
RULES = "rule_id int, category string, min_magnitude double, attr_lo int, attr_hi int, rule_level int"
PLAYS = "playbook_id int, category string, min_risk double, mission string, benefit double, cost double"


def key(version):
    parts = version.removeprefix("v").split(".") if version else [""]
    return tuple(map(int, parts)) if all(p.isdigit() for p in parts) else None


@pytest.mark.parametrize("mode", ["spark", "heavy"])
def test_vulnerable_versions_are_those_of_all_pairs(request, mode):
    spark = request.getfixturevalue(mode)
    rng = random.Random(4)
    tag = lambda: rng.choice(["v1.2.0-rc1", None, *[f"v{rng.randrange(3)}.{rng.randrange(12)}.{rng.randrange(3)}"] * 12, "1.2", "v1"])
    services = [(i, rng.choice(["a", "b", None]), tag()) for i in range(300)]
    feed = [(i, rng.choice(["a", "b", "c"]), tag(), rng.choice([tag(), None])) for i in range(40)]
    got = enrich.match_vulnerabilities(
        spark.createDataFrame(services, "service_id int, vendor string, version string"),
        spark.createDataFrame(feed, "vuln_id int, vendor string, lo string, hi string"),
    )
    want = []
    for i, vendor, version in services:
        if not version or key(version) is None:
            want.append((i, None, "not_comparable"))
            continue
        for v, of, lo, hi in feed:
            if of == vendor and lo and key(lo) and key(version) >= key(lo) and (hi is None or key(hi) and key(version) < key(hi)):
                want.append((i, v, "affected"))
    assert sorted(map(str, want)) == sorted(str((r.service_id, r.vuln_id, r.status)) for r in got.collect())


def test_a_hub_with_many_incidents_has_alerts_brought_to_it(spark):
    n, asks, hour = 400, 300, 3600
    rng = random.Random(2)
    alerts = [(i, 1 + i % n, T0 + dt.timedelta(seconds=rng.randrange(50 * hour))) for i in range(800)] + [(900 + i, 2000 + i, T0 + dt.timedelta(hours=i)) for i in range(5)]
    incidents = [(5000 + i, 0, T0 + dt.timedelta(seconds=i * 600)) for i in range(asks)] + [(6000, 3000, T0 + dt.timedelta(hours=6))]
    edges = [(u, 0) for u in range(1, n + 1)] + [(2000 + i, 3000) for i in range(5)]
    a = spark.createDataFrame(alerts, "event_id long, entity_id long, ts timestamp")
    i = spark.createDataFrame(incidents, "incident_id long, entity_id long, session_start timestamp")
    e = spark.createDataFrame(edges, "src long, dst long")
    lines = detect.cause_lines(i, a, detect._reach(i, e, 1, "entity_id"), 12 * hour)
    assert lines.count() < 2 * len(alerts) + asks + 20 < asks * n
    want = {}
    for q, entity, start in incidents:
        near = {u for u, d in edges if d == entity} | {entity}
        seen = [(t, x, u) for x, u, t in alerts if u in near and start - dt.timedelta(hours=12) <= t <= start]
        if seen:
            want[q] = min(seen)
    assert {r.incident_id: (r.cause_ts, r.cause_id, r.cause_entity) for r in detect.root_cause(i, a, e, 12 * hour).collect()} == want


def test_bit_search_is_a_search_from_each_start(spark):
    rng = random.Random(9)
    pairs = list({(rng.randrange(150), rng.randrange(150)) for _ in range(260)})
    edge = spark.createDataFrame(pairs, "src long, dst long")
    nodes = edge.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    numbered, reached = graph.bit_search(edge, nodes, None)
    found = graph.per_start(reached, numbered).filter("n > 0")
    plain = graph.k_hop(edge, nodes.select(F.col("node").alias("start"), "node"), None, by=["start"]).groupBy(F.col("start").alias("node"), "hops").agg(F.count("*").alias("n"))
    assert sorted(found.collect()) == sorted(plain.collect())
    blocks = numbered.select("block").distinct().count()
    most = reached.groupBy("hops").count().agg(F.max("count")).first()[0]
    assert most <= nodes.count() * blocks and blocks <= nodes.count() / 64 + numbered.rdd.getNumPartitions()


def test_a_hub_of_paths_is_dealt_into_parts(spark):
    rows = [(i, -1, "in") for i in range(60)] + [(-1, i, "out") for i in range(50)] + [(-1, 3, "out"), (7, -2, "in"), (-2, 9, "out")]
    edges = spark.createDataFrame(rows, "src long, dst long, kind string")
    plain = graph.graph_pattern(edges, ["in", "out"]).collect()
    assert sorted(graph.graph_pattern(edges, ["in", "out"], hub_rows=200).collect()) == sorted(plain) and len(plain) == 3000
    found = edges.filter("kind = 'in'").select(F.col("src").alias("start"), F.col("dst").alias("node"), F.lit(1).alias("n_paths"))
    hop = edges.filter("kind = 'out'").groupBy("src", "dst").agg(F.count("*").alias("_m"))
    starts, ends = graph._salted(found, hop, 200)
    met = starts.join(ends, (F.col("node") == F.col("src")) & (starts["_salt"] == ends["_salt"])).groupBy("node", starts["_salt"]).count()
    sizes = [r["count"] for r in met.collect()]
    assert sum(sizes) == 3001 and max(sizes) < 1000


def test_quantiles_of_few_large_groups(spark):
    rng = np.random.default_rng(3)
    values = {"a": rng.normal(0, 1e6, 501), "b": np.round(rng.exponential(1, 400), 1), None: np.array([-0.0, 0.0, 1e-310, -np.inf, np.inf]), "one": np.array([7.0])}
    rows = [(g, float(x)) for g, xs in values.items() for x in xs] + [("a", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: (r.p0, r.p50, r.p95) for r in exact_quantiles(df, ["g"], "x", {"p0": 0.0, "p50": 0.5, "p95": 0.95}).collect()}
    for g, xs in values.items():
        if g is not None:
            assert got[g] == pytest.approx(tuple(np.quantile(xs, [0, 0.5, 0.95])), rel=1e-12)
    assert got[None][:2] == (-math.inf, 0.0) and exact_quantiles(df.limit(0), ["g"], "x", {"m": 0.5}).count() == 0


@pytest.mark.parametrize("descending", [False, True])
def test_ranks_of_values(spark, descending):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.choice([None, float("nan"), 0.0, -0.0, 1e300, -1e300, *[rng.gauss(0, 1) for _ in range(5)]])) for _ in range(400)]
    got = value_ranks(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", descending=descending).collect()
    order = lambda x: (-1, 0) if x is None else (1, 0) if x != x else (0, x + 0.0)
    for r in got:
        own = [order(x) for g, x in rows if g == r.g]
        sign = 1 if not descending else -1
        low = [o for o in own if (o < order(r.x)) == (sign > 0) and o != order(r.x)]
        assert (r.below, r.distinct_below, r.cnt, r.n) == (len(low), len(set(low)), own.count(order(r.x)), len(own))


@pytest.mark.parametrize("mode", ["spark", "heavy"])
@pytest.mark.parametrize("alpha", [0.3, 0.01, 1.0, 0.0])
def test_ewma_over_many_blocks(request, mode, alpha):
    spark = request.getfixturevalue(mode)
    rng = random.Random(7)
    rows = [(k, T0.date() + dt.timedelta(days=i // 3), rng.choice([None, rng.uniform(-5, 5), float(i)]) if i else 2.5) for k in ("x", None) for i in range(2500)]
    got = risk.ewma(spark.createDataFrame(rows, "k string, day date, score double"), ["k"], "day", "score", alpha).collect()
    for k in ("x", None):
        e, want = None, []
        for _, day, x in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2] is not None, r[2] or 0)):
            e = e if x is None else x if e is None else alpha * x + (1 - alpha) * e
            want.append((day, e))
        mine = [(r.day, r.ewma) for r in got if r.k == k]
        assert len(mine) == len(want)
        order = lambda r: (r[0], r[1] is not None, round(r[1], 5) if r[1] is not None else 0)
        for (d, a), (f, b) in zip(sorted(mine, key=order), sorted(want, key=order)):
            assert d == f and (a is b is None or a == pytest.approx(b, abs=1e-4))


def test_the_number_of_rules_changes_nothing(spark):
    rules = spark.createDataFrame([(1, "error", 1.0, None, None, 5), (2, None, None, None, 9, 7), (3, "error", None, None, None, 7), (4, "view", None, 1, 2, 9)], RULES)
    rows = [(i, c, m, a) for i in (1, 1, None, None, 2) for c, m, a in (("error", 2.0, 5), ("error", 2.0, 50), (None, 0.0, 1))]
    events = spark.createDataFrame(rows, "event_id long, category string, magnitude double, attr int")
    few, many = (detect.match_rules(events, rules, n) for n in (2000, 0))
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))
    assert few.filter("is_best").count() == len(rows)


def test_the_number_of_playbooks_changes_nothing_and_feedback_reaches_the_choice(spark):
    plays = spark.createDataFrame([(1, "error", 10.0, None, 0.5, 1.0), (2, "error", None, "m", 0.4, 0.0), (3, None, None, None, 0.1, 0.0), (4, "view", 99.0, None, 9.0, 0.0)], PLAYS)
    rows = [(c, r, m, s) for c in ("error", "view", None) for r in (0.0, 20.0) for m in ("m", None) for s in ("s1", None)] * 2
    cases = spark.createDataFrame(rows, "category string, risk double, mission string, segment string")
    few, many = (response.select_playbook(cases, plays, max_plays=n) for n in (2000, 0))
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect())) and few.count() == len(rows)
    outcomes = spark.createDataFrame([(1, "s1", False)] * 8 + [(3, "s1", True)] * 8 + [(3, None, True)], "playbook_id int, segment string, success boolean")
    learned = response.playbook_feedback(outcomes, plays)
    for n in (2000, 0):
        got = {(r.category, r.risk, r.mission, r.segment): r.playbook_id for r in response.select_playbook(cases, plays, learned, max_plays=n).collect()}
        assert got["error", 20.0, None, None] == 1 and got["error", 20.0, None, "s1"] == 3


def test_upserts_of_a_null_key_change_nothing_the_second_time(spark):
    target = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c")], "k long, v string")
    updates = spark.createDataFrame([(None, "new"), (3, "d")], "k long, v string")
    once = keys.upsert_by_key(target, updates, "k")
    assert sorted(map(str, once.collect())) == sorted(map(str, keys.upsert_by_key(once, updates, "k").collect()))
    assert {(r.k, r.v) for r in once.collect()} == {(1, "a"), (None, "new"), (2, "c"), (3, "d")}


@pytest.mark.parametrize("mode", ["spark", "heavy"])
def test_trend_without_groups(request, mode):
    spark = request.getfixturevalue(mode)
    scores = [3, None, 8, 1, 1, 9, 4, 2, 7, None, 5, 6]
    df = spark.createDataFrame([(T0.date() + dt.timedelta(days=i), s) for i, s in enumerate(scores)], "day date, score long")
    got = [tuple(r)[2:] for r in sorted(risk.risk_trend(df, window=3).collect(), key=lambda r: r.day)]
    for i, (mean, change, top) in enumerate(got):
        near = [x for x in scores[max(0, i - 2) : i + 1] if x is not None]
        assert mean == pytest.approx(sum(near) / len(near)) and top == max(x for x in scores[: i + 1] if x is not None)
        assert change == (None if not i or scores[i] is None or scores[i - 1] is None else scores[i] - scores[i - 1])
