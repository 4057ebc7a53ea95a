"""Hand-made rows: empty inputs, ties, nulls, cycles, malformed values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wardline import functions as fn
from wardline.operators import behaviour, detect, enrich, graph, keys, normalize, privacy, response, risk, surface
from wardline.plans import views as v

T0 = dt.datetime(2024, 1, 1)
EVENT = "event_id long, entity_id long, ts timestamp_ntz, category string, magnitude double, attr int, level int"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def column(spark, values, expr, type_="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], f"i int, x {type_}")
    return [r.y for r in df.orderBy("i").select(expr(F.col("x")).alias("y")).collect()]


def test_version_key_orders_numerically(spark):
    got = column(spark, ["v2.9.0", "v2.10.0", "v2.10.1", "2.3.0", "", "v2.x", None], fn.version_key)
    assert got == [[2, 9, 0], [2, 10, 0], [2, 10, 1], [2, 3, 0], None, None, None]
    tags = spark.createDataFrame([(x,) for x in ["v2.9.0", "v2.10.0", "v2.10.1", "2.3.0", ""]], "version string")
    assert [r.version for r in keys.semver_latest(tags, "version", n=2).collect()] == ["v2.10.0", "v2.9.0"]


def test_upgrade_path_guards(spark):
    tags = spark.createDataFrame([(x,) for x in ["v2.0.0", "v2.1.0", "v2.2.0", "v2.3.0", "v2.10.0"]], "version string")
    path = lambda a, b: [r.version for r in keys.upgrade_path(tags, a, b).orderBy("step").collect()]
    assert path("v2.1.0", "v2.3.0") == ["v2.2.0", "v2.3.0"]
    assert path("v2.1.0", "v2.1.0") == []
    assert path("v2.2.0", "v2.10.0") == ["v2.3.0", "v2.10.0"]
    with pytest.raises(Exception, match="lower version"):
        path("v2.3.0", "v2.1.0")


def test_addresses(spark):
    ips = ["0.0.0.0", "255.255.255.255", "256.1.1.1", "172.19.0.1", "1.2.3", "1.2.3.4.5", None]
    assert column(spark, ips, fn.ip_to_long) == [0, 4294967295, None, 2886926337, None, None, None]
    obs = spark.createDataFrame([(i, x) for i, x in enumerate(ips)], "id int, ip string")
    found = enrich.cidr_match(obs, v.cidr_block(spark))
    assert rows(found, "id", "net") == [(0, "0.0.0.0"), (3, "172.19.0.0")]


def test_hosts_and_urls(spark):
    urls = ["HTTPS://www.A.example:8443/x?y#z", "b.example", "http://u@c.example/", " www.d.example ", None]
    assert column(spark, urls, fn.canonical_host) == ["a.example", "b.example", "c.example", "d.example", None]
    move = lambda c: fn.migrate_url(c, ("http", 4001), ("https", 4443))
    urls = ["http://h:4001/g", "http://h:4002/g", "https://h:4001/g", "http://h:4001", None]
    assert column(spark, urls, move) == ["https://h:4443/g", "http://h:4002/g", "https://h:4001/g", "https://h:4443", None]


def test_keyed_text(spark):
    texts = ["A='x y'\nB=\"z\"\nnoise\nA=2=3", "", None]
    assert column(spark, texts, fn.kv_extract) == [{"A": "2", "B": "z"}, {}, None]
    df = spark.createDataFrame([("KEY=old\nMYKEY=old\nKEY2=old",), ("OTHER=1",)], "t string")
    got = normalize.rewrite_keyed_value(df, "t", "KEY", "a$1\\b").collect()
    assert [(r.t, r.changed) for r in got] == [("KEY=a$1\\b\nMYKEY=old\nKEY2=old", True), ("OTHER=1", False)]


def test_durations_and_dates(spark):
    df = spark.createDataFrame([(at(0), at(125.9)), (at(0), at(59)), (None, at(1))], "a timestamp_ntz, b timestamp_ntz")
    got = [(r.minutes, r.seconds) for r in normalize.add_elapsed(df, "a", "b").collect()]
    assert got == [(2, 5), (0, 59), (None, None)]
    e = spark.range(1).select(fn.expiry_date(F.lit("2024-02-28"), 365, at=F.lit("2025-02-27")).alias("e")).first().e
    assert (e.text, e.expired) == ("27/02/2025", False)


def test_bad_json_is_not_an_error(spark):
    raw = [(1, "{"), (2, "null"), (3, '{"k":"x"}'), (4, "{}"), (5, '{"k": 7}')]
    df = spark.createDataFrame([(i, T0, 1, "click", 1.0, p) for i, p in raw], v.EVENTS_SCHEMA)
    assert rows(v.canonical(df).filter("attr IS NOT NULL"), "event_id", "attr") == [(5, 7)]


def test_normalize_flags_missing_fields(spark):
    df = spark.createDataFrame([(1, None), (None, T0), (2, T0)], "e long, t timestamp_ntz")
    out = normalize.normalize_events(df, {"entity_id": F.col("e"), "ts": F.col("t")})
    assert [r.valid for r in out.collect()] == [False, False, True]


def test_extracted_indicators(spark):
    text = "a 1.2.3.4. and 1.2.3.4 not 256.1.1.1 nor 1.2.3.4.5; Me@X.example, https://H.example/p " + "a" * 40 + " " + "b" * 41
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id int, text string")
    got = rows(normalize.extract_iocs(df, "id", "text"), "id", "ioc_type", "ioc")
    assert got == [(1, "email", "me@x.example"), (1, "host", "h.example"), (1, "ipv4", "1.2.3.4"), (1, "sha1", "a" * 40)]


def test_upsert(spark):
    schema = "key long, v string"
    target = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], schema)
    updates = spark.createDataFrame([(2, "B"), (4, "d"), (3, "c")], schema)
    assert rows(keys.upsert_by_key(target, updates, "key"), "key", "v") == [(1, "a"), (2, "B"), (3, "c"), (4, "d")]
    twice = spark.createDataFrame([(2, "x"), (2, "y")], schema)
    with pytest.raises(Exception, match="repeated update key"):
        keys.upsert_by_key(target, twice, "key").collect()
    null_update = spark.createDataFrame([(1, None)], schema)
    assert (1, None) in [tuple(r) for r in keys.upsert_by_key(target, null_update, "key").collect()]
    new = spark.createDataFrame([(1, "z"), (9, "n"), (9, "m")], schema)
    assert rows(keys.insert_if_absent(target.filter("v IS NOT NULL"), new, "key"), "key", "v") == [(1, "a"), (2, "b"), (9, "m")]


def test_replace_stale_twice_is_once(spark):
    schema = "key long, v string"
    target = spark.createDataFrame([(1, "old"), (2, "keep")], schema)
    stale = spark.createDataFrame([(1,), (7,)], "key long")
    fresh = spark.createDataFrame([(1, "new"), (2, "ignored")], schema)
    once = keys.replace_stale(target, stale, fresh, "key")
    again = keys.replace_stale(once, stale, fresh, "key")
    assert rows(once, "key", "v") == rows(again, "key", "v") == [(1, "new"), (2, "keep")]


def test_reserved_names_match_in_full(spark):
    df = spark.createDataFrame([("bridge",), ("bridge2",), ("host",), (None,)], "n string")
    assert [r.n for r in keys.exclude_reserved(df, "n", ["bridge", "host", "none"]).collect()] == ["bridge2", None]


def test_lookup_and_members(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    names = spark.createDataFrame([("a", "A")], "k string, n string")
    assert [r.resolved for r in keys.lookup_default(df, names, "k", "n").orderBy("k").collect()] == [None, "A", "b"]
    lists = spark.createDataFrame([("p", "x  y"), ("q", "")], "k string, l string")
    assert rows(keys.expand_members(lists, "k", "l"), "k", "place", "member") == [("p", 0, "x"), ("p", 1, "y")]


def test_gap_boundary_is_inclusive(spark):
    df = spark.createDataFrame(
        [(i, 1, at(s), "error", 1.0, 1, 1) for i, s in enumerate([0, 10, 20.000001, 30])], EVENT
    )
    assert rows(detect.sessionize_alerts(df, "entity_id", 10), "incident_id", "n") == [(0, 2), (2, 2)]
    # Against the previous raw alert: 10 s is within the quiet time, 10.000001 s is not.
    assert rows(detect.dedup_alerts(df, ["entity_id"], 10), "event_id") == [(0,), (2,)]
    assert rows(detect.frequency_rule(df, "entity_id", 2, 10), "event_id") == [(1,), (3,)]


def test_empty_inputs(spark):
    none = spark.createDataFrame([], EVENT)
    assert detect.sessionize_alerts(none, "entity_id", 10).count() == 0
    assert detect.zscore_anomalies(none, "category", "magnitude").count() == 0
    assert detect.mad_anomalies(none, "category", "magnitude").count() == 0
    assert behaviour.transition_matrix(none, "entity_id", "category").count() == 0
    assert graph.components(spark.createDataFrame([], "src long, dst long")).count() == 0
    assert graph.k_hop(spark.createDataFrame([], "src long, dst long"), spark.createDataFrame([], "node long"), 3).count() == 0


def test_ties_go_to_the_least_id(spark):
    df = spark.createDataFrame([(i, 1, T0, "error", 1.0, 1, 5) for i in (3, 1, 2)], EVENT)
    assert rows(detect.prune_alerts(df, ["entity_id"], 1, 0), "event_id", "n_pruned") == [(1, 2)]
    hits = detect.match_rules(df, v.rule(spark).withColumn("min_magnitude", F.lit(0.0)).withColumn("rule_level", F.lit(1)))
    assert rows(hits.filter("is_best"), "event_id", "rule_id") == [(1, 1), (2, 1), (3, 1)]


def test_as_of(spark):
    s = "key long, ts timestamp_ntz, id long"
    facts = spark.createDataFrame([(1, at(10), 1), (1, at(5), 2), (1, at(100), 3), (2, at(10), 4)], s)
    states = spark.createDataFrame([(1, at(10), 7), (1, at(20), 8)], s)
    got = enrich.context_asof(facts, states, "key", "ts", "id", "id", 60)
    assert [(r.id, r.state_id) for r in got.orderBy("id").collect()] == [(1, 7), (2, None), (3, None), (4, None)]


def test_snapshots(spark):
    s = "asset_id long, vuln_id long, state string"
    prev = spark.createDataFrame([(1, 1, "open"), (2, 1, "open"), (3, 1, None), (4, 1, None)], s)
    curr = spark.createDataFrame([(1, 1, "open"), (3, 1, "open"), (4, 1, None), (5, 1, "fixed")], s)
    diff = surface.scan_diff(prev, curr, ["asset_id", "vuln_id"], ["state"])
    assert rows(diff, "asset_id", "status") == [(1, "same"), (2, "gone"), (3, "changed"), (4, "same"), (5, "new")]
    assert {r.status for r in surface.scan_diff(prev, prev, ["asset_id", "vuln_id"], ["state"]).collect()} == {"same"}


@pytest.fixture(scope="module")
def cyclic(spark):
    # a cycle 1-2-3, a tail to 4 (dangling), a self-loop on 6, a pair of its own 8-9
    return spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (6, 6), (8, 9)], "src long, dst long")


def test_graph_with_cycles(spark, cyclic):
    seeds = spark.createDataFrame([(1,)], "node long")
    assert rows(graph.k_hop(cyclic, seeds, None), "node", "hops") == [(1, 0), (2, 1), (3, 2), (4, 3)]
    assert rows(graph.k_hop(cyclic, seeds, 1), "node", "hops") == [(1, 0), (2, 1)]
    parts = [(1, 1), (2, 1), (3, 1), (4, 1), (6, 6), (8, 8), (9, 8)]
    assert rows(graph.components(cyclic), "node", "component") == parts
    worth = spark.createDataFrame([(2, 5.0), (4, 1.0)], "node long, worth double")
    starts = spark.createDataFrame([(1,), (8,), (4,)], "node long")
    blast = graph.blast_radius(cyclic, worth, starts)
    assert rows(blast, "seed", "n_reached", "worth", "depth") == [(1, 3, 6.0, 3), (8, 1, 0.0, 1)]
    close = {r.node: r.closeness for r in graph.harmonic_closeness(cyclic, 3).collect()}
    assert close == pytest.approx({1: 1 + 1 / 2 + 1 / 3, 2: 1 + 1 / 2 + 1 / 2, 3: 2 + 1 / 2, 4: 0, 6: 0, 8: 1, 9: 0})
    assert sum(r["rank"] for r in graph.pagerank(cyclic).collect()) == pytest.approx(1.0)


def test_long_chain_is_one_component(spark):
    chain = spark.range(200).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {r.component for r in graph.components(chain).collect()} == {0}


def test_small_classes(spark):
    data = [(i, "s1", "north", "a") for i in range(5)] + [(10, "s2", "north", "b"), (11, "s3", "north", "c"), (12, None, "south", "a")]
    df = spark.createDataFrame(data, "id long, subnet string, site string, mission string")
    got = rows(privacy.k_anonymize(df, "id", [["subnet"], ["site"]], 2), "id", "level", "q0")
    assert got == [(i, 0, "s1") for i in range(5)] + [(10, 1, "north"), (11, 1, "north")]
    assert rows(privacy.l_diversity(df, ["site"], "mission", 2), "site", "n_values") == [("south", 1)]


def test_redaction_and_pseudonyms(spark):
    df = spark.createDataFrame([(f"me@x.example 1.2.3.4 {'f' * 40} 4465758382889437 ok",), (None,)], "t string")
    got = privacy.redact_text(df, "t").collect()
    assert (got[0].t, got[0].n_redacted) == ("[EMAIL] [IP] [HASH] [CARD] ok", 4)
    a = privacy.pseudonymize(spark.createDataFrame([(1,), (1,), (2,)], "id long"), ["id"], "s").collect()
    assert a[0].id == a[1].id != a[2].id


def test_playbook_choice(spark):
    cases = spark.createDataFrame(
        [(1, "error", 70.0, "BUILDING"), (2, "error", 70.0, "MACHINERY"), (3, "click", 5.0, "BUILDING"), (4, None, 50.0, None)],
        "asset_id long, category string, risk double, mission string",
    )
    got = response.select_playbook(cases, v.playbook(spark))
    assert rows(got, "asset_id", "playbook_id", "utility") == [(1, 1, 33.0), (2, 2, 39.0), (3, 0, 0.0), (4, 4, 14.0)]


def test_ntile_of_uneven_groups(spark):
    df = spark.createDataFrame([(i, "x", float(i % 3)) for i in range(10)] + [(99, "y", 1.0)], "asset_id long, site string, risk double")
    got = {r.asset_id: (r.place, r.quartile, r["rank"], r.dense_rank) for r in risk.risk_rank(df, "site").collect()}
    assert got[2] == (1, 1, 1, 1) and got[1] == (4, 2, 4, 2) and got[9] == (10, 4, 7, 3) and got[99] == (1, 1, 1, 1)


def test_share_policy_gives_nothing_to_silent_peers(spark):
    objs = spark.createDataFrame([(1, "green"), (2, "red"), (3, None)], "id long, marking string")
    peers = spark.createDataFrame(
        [("a", True, ["green", "green"]), ("b", False, ["green", "red"]), ("c", True, [])],
        "peer string, shares boolean, allowed array<string>",
    )
    assert rows(enrich.apply_share_policy(objs, peers), "id", "peer") == [(1, "a")]
