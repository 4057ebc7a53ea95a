"""Rows that must not get lost: null groups and keys, odd blocks, wildcard-like values, long numbers."""

import pytest
from pyspark.sql import functions as F

from wardline.functions.versions import version_key
from wardline.operators import behaviour, detect, enrich, graph, keys, ordered, privacy, response, risk
from wardline.sources import scan_glob


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_null_groups_stay(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "a", 5, float(i % 7 + 100 * (i in (40, 41)))) for i in range(60)], "event_id long, g string, level int, x double")
    assert {r.g for r in detect.prune_alerts(df, ["g"], 3, 1).collect()} == {None, "a"}
    assert {r.event_id for r in detect.zscore_anomalies(df, "g", "x").collect()} == {40, 41}
    assert {r.event_id for r in detect.mad_anomalies(df, "g", "x").collect()} == {40, 41}
    ranked = risk.risk_rank(df.select(F.col("event_id").alias("asset_id"), "g", F.col("x").alias("risk")), "g")
    assert ranked.count() == 60
    report = behaviour.case_report(df.withColumn("t", F.col("event_id")), "g", "level", [5], "t", "x", "event_id")
    assert report.count() == 2


def test_blocks_of_any_length(spark):
    blocks = spark.createDataFrame([("10.0.0.0", p) for p in [8, None, *range(33, 90)]], "net string, prefix int")
    obs = spark.createDataFrame([("10.1.1.1",), ("11.1.1.1",)], "ip string")
    assert rows(enrich.cidr_match(obs, blocks)) == [("10.1.1.1", "10.0.0.0", 8)]


def test_a_category_that_looks_like_the_wildcard(spark):
    events = spark.createDataFrame([(1, "*", 5.0, 1.0), (2, None, 5.0, 1.0)], "event_id long, category string, magnitude double, attr double")
    rules = spark.createDataFrame([(7, None, 3, None, None, None), (8, "*", 4, None, None, None)], "rule_id int, category string, rule_level int, min_magnitude double, attr_lo double, attr_hi double")
    got = [(r.event_id, r.rule_id, r.is_best) for r in detect.match_rules(events, rules).collect()]
    assert sorted(got) == [(1, 7, False), (1, 8, True), (2, 7, True)]


def test_null_keys_are_inserted_once_and_repeated_updates_fail(spark):
    target = spark.createDataFrame([(1, "a")], "k long, v string")
    new = spark.createDataFrame([(None, "n"), (2, "b")], "k long, v string")
    once = keys.insert_if_absent(target, new, "k")
    assert rows(keys.insert_if_absent(once, new, "k")) == rows(once) and once.count() == 3
    with pytest.raises(Exception, match="repeated update key"):
        keys.upsert_by_key(target, new.unionByName(new), "k").count()


def test_long_version_numbers(spark):
    df = spark.createDataFrame([("v20241201123456.0.0",), ("v99999999999999999999.0",), ("v1.2",)], "v string")
    assert [r.k for r in df.select(version_key(F.col("v")).alias("k")).collect()] == [[20241201123456, 0, 0], None, [1, 2]]


def test_whole_hashes_go_and_releases_draw_anew(spark):
    df = spark.createDataFrame([("a" * 64 + " " + "ABCDEF0123" * 4,)], "t string")
    out = privacy.redact_text(df, "t").first()
    assert (out.t, out.n_redacted) == ("[HASH] [HASH]", 2)
    many = spark.range(100).select(F.col("id").alias("s"), F.lit("x").alias("k"))
    first = privacy.dp_counts(many, "s", ["k"], 1.0, "secret", "one").first().noisy_n
    second = privacy.dp_counts(many.limit(99), "s", ["k"], 1.0, "secret", "two").first().noisy_n
    assert abs(first - second - 1.0) > 1e-6


def test_text_ids_nan_and_nulls_rank_alike_when_split(spark, request):
    df = spark.createDataFrame(
        [(f"asset-{i % 37:03d}-{i}" if i % 11 else None, "g" if i % 3 else None, float("nan") if i % 13 == 0 else None if i % 17 == 0 else float(i % 5)) for i in range(200)],
        "asset_id string, g string, risk double",
    ).withColumn("k", F.coalesce("asset_id", F.lit("none")))
    order = ["risk", "k"]
    ranked = lambda: rows(risk.risk_rank(df.filter("asset_id is not null"), "g").select("asset_id", "place", "rank", "quartile"))
    previous = lambda: rows(ordered.previous(df.withColumn("n", F.monotonically_increasing_id()), ["g"], [*order, "n"], F.col("risk"), before=F.col("k")).select("n", "before"))
    plain = ranked(), previous()
    request.getfixturevalue("heavy")
    assert (ranked(), previous()) == plain


def test_equal_cases_stay(spark):
    cases = spark.createDataFrame([(1, "error", "m", 70.0)] * 3 + [(2, None, None, None)], "asset_id long, category string, mission string, risk double")
    plays = spark.createDataFrame([(7, "error", 60.0, None, 0.9, 30.0)], "playbook_id int, category string, min_risk double, mission string, benefit double, cost double")
    got = response.select_playbook(cases, plays).select("asset_id", "playbook_id")
    assert rows(got) == [(1, 7)] * 3 + [(2, 0)]


def test_tables_as_folders_and_with_unlike_columns(spark, tmp_path):
    root = tmp_path / "a+b c"
    spark.range(5).repartition(3).write.parquet(f"{root}/event_a.parquet")
    spark.range(2).withColumn("extra", F.lit("x")).write.parquet(f"{root}/event_b.parquet")
    got = scan_glob(spark, str(root), "event*.parquet").groupBy("source").agg(F.count("*").alias("n"), F.count("extra").alias("x"))
    assert rows(got.select("source", "n", "x")) == [("event_a.parquet", 5, 0), ("event_b.parquet", 2, 2)]


def test_closeness_is_exact_at_a_hub(spark):
    hub = spark.range(1, 3001).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    close = graph.harmonic_closeness(hub.unionByName(spark.createDataFrame([(1, 0), (0, 0)], "src long, dst long")), 2)
    got = {r.node: r.closeness for r in close.filter("node < 3").collect()}
    assert got == {0: 3000.0, 1: 1 + 2999 / 2, 2: 0.0}
