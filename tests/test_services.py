"""Rules in both forms, services, missions, and users' own functions on odd rows."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from wardline.operators import detect, extend, risk, surface
from wardline.plans import views as v


def test_few_and_many_rules_give_the_same(spark, sf, monkeypatch):
    events = v.tel(spark, sf).select("event_id", "category", "magnitude", "attr").withColumn(
        "category", F.when(F.col("event_id") % 7 > 0, F.col("category"))
    )
    rules = v.rule(spark).unionByName(v.rule(spark).withColumn("rule_id", F.col("rule_id") + 10).withColumn(
        "rule_level", F.when(F.col("rule_id") % 2 == 0, F.col("rule_level"))
    ))
    few = sorted(map(repr, detect.match_rules(events, rules).collect()))
    monkeypatch.setattr(detect, "MAX_RULES", 1)
    assert few and few == sorted(map(repr, detect.match_rules(events, rules).collect()))
    assert detect.match_rules(events, rules.limit(0)).count() == 0
    monkeypatch.setattr(detect, "MAX_RULES", 2000)
    assert detect.match_rules(events, rules.limit(0)).count() == 0


def test_mission_weights_are_passed_on(spark):
    asset = spark.createDataFrame([(1, "A"), (2, "B"), (3, None), (3, "A")], "asset_id long, mission string")
    uses = spark.createDataFrame([(1, 4), (2, 4), (4, 5), (5, 6), (2, 2), (None, 7), (1, None)], "src long, dst long")
    run = lambda hops: {
        r.node: r.criticality for r in surface.mission_criticality(asset, {"A": 1.0, "B": 0.6}, uses, hops).collect() if r.node is not None
    }
    assert run(0) == {1: 1.0, 2: 0.6, 3: 1.0}
    assert run(2) == {1: 1.0, 2: 0.6, 3: 1.0, 4: 0.5, 5: 0.25}
    assert surface.mission_criticality(asset.limit(0), {"A": 1.0}, uses, 2).count() == 0


def test_service_risk(spark):
    service = spark.createDataFrame([(1,), (2,), (3,)], "service_id long")
    affected = spark.createDataFrame([(1, 10), (1, 11), (2, 12), (1, 10)], "service_id long, vuln_id long")
    latest = spark.createDataFrame(
        [(7, 10, 4, "open"), (8, 10, 2, "open"), (8, 11, 9, "fixed"), (9, 12, None, "open")],
        "asset_id long, vuln_id long, cvss int, state string",
    )
    at = spark.createDataFrame([(7, 10.0), (8, 50.0), (9, 1.0)], "asset_id long, risk double")
    got = {r.service_id: (r.n_vulns, r.n_findings, r.risk) for r in surface.service_risk(service, affected, latest, at).collect()}
    assert got == {1: (2, 2, 20.0), 2: (1, 1, 0.0), 3: (0, 0, 0.0)}


def test_merged_scores_of_a_constant_or_null_feature(spark):
    df = spark.createDataFrame([(1, "a", 1.0, 5.0), (2, "a", None, 5.0), (3, None, 3.0, 5.0)], "id long, site string, x double, y double")
    got = {r.id: (r.z_y, r.score) for r in detect.federated_score(df, "site", ["x", "y"]).collect()}
    assert got[2] == (None, None) and round(got[1][1], 6) == round(got[3][1], 6) == 0.707107


def test_parser_with_a_decimal_and_a_struct(spark):
    class Halves:
        def eval(self, x: str):
            if x is not None:
                yield Decimal(x) / 2, {"of": x}

    df = spark.createDataFrame([(1, "3"), (2, None)], "id long, x string")
    out = extend.apply_parser(df, Halves, "half decimal(10,2), origin struct<of:string>", "x", ["id"])
    assert [(r.id, r.half, r.origin.of) for r in out.collect() if r.half is not None] == [(1, Decimal("1.50"), "3")]


def test_aggregate_lets_go_of_keys(spark, monkeypatch):
    monkeypatch.setattr(extend, "HELD_KEYS", 50)
    partial = lambda rows: rows.groupby("k", as_index=False).agg(s=("x", "sum"))
    merge = lambda states: states.groupby("k", as_index=False).agg(s=("s", "sum"))
    df = spark.range(200_000).select((F.col("id") % 5000).alias("k"), F.lit(1).alias("x"))
    out = extend.apply_aggregate(df, "k", partial, merge, "s long", F.col("s"), ["x"], "n")
    assert out.groupBy("n").count().collect() == [(40, 5000)]


def test_ewma_of_timestamps(spark):
    rows = [("a", dt.datetime(2024, 1, 1, h), float(h)) for h in range(3)]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, x double")
    assert [r.ewma for r in risk.ewma(df, ["k"], "t", "x", 0.5).orderBy("t").collect()] == [0.0, 0.5, 1.25]
