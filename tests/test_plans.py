"""What the plans must and must not contain."""

import pytest
from pyspark.sql import functions as F

from wardline import sources
from wardline.operators import detect, enrich, keys, surface
from wardline.plans import views as v
from wardline.plans.catalog import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)



@pytest.mark.parametrize("name", [
    "apply_share_policy", "asset_context", "base_risk", "cidr_match", "context_asof", "correlate_pairs",
    "domain_suffix_match", "enrich_iocs", "explain_anomaly", "federated_average", "graph_pattern", "match_rules",
    "match_vulnerabilities", "posture_summary", "root_cause", "select_playbook", "zscore_anomalies",
])
def test_no_nested_loops_even_without_broadcasts(no_broadcast, sf, name):
    text = plan(QUERIES[name](no_broadcast, sf))
    assert "NestedLoop" not in text and "CartesianProduct" not in text


def test_filters_and_columns_reach_the_scan(spark, sf):
    text = plan(v.alerts(spark, sf).select("event_id"))
    assert "EqualTo(event_type,error)" in text
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in text
    text = plan(sources.scan_glob(spark, sf, "event*.parquet").filter("event_id < 5").select("event_id", "source"))
    assert "LessThan(event_id,5)" in text and "value" not in text.split("ReadSchema")[1]


def test_small_feed_leaves_the_observations_unshuffled(spark, sf):
    text = plan(enrich.enrich_iocs(v.ioc_obs(spark, sf).filter("ioc_type <> 'host'"), v.ioc_feed(spark, sf), ["ioc_type", "ioc"]))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text and "hashpartitioning" not in text


def test_plain_keys_cost_one_shuffle(spark, sf):
    alerts = v.alerts(spark, sf)
    for df in (
        detect.dedup_alerts(alerts, ["entity_id"], 60),
        detect.sessionize_alerts(alerts, "entity_id", 60),
        detect.frequency_rule(alerts, "entity_id", 3, 60),
    ):
        assert plan(df).count("Exchange hashpartitioning") == 1


def test_heavy_keys_are_windows_over_pieces(heavy, sf):
    text = plan(detect.dedup_alerts(v.alerts(heavy, sf), ["entity_id"], 60))
    assert "hashpartitioning(entity_id#" in text and "_piece#" in text.split("hashpartitioning(")[1].split(")")[0]


def test_limits_apply_before_the_shuffle(spark, sf):
    text = plan(detect.prune_alerts(v.alerts(spark, sf).select("event_id", "entity_id", "level"), ["entity_id"], 2, 0))
    assert "WindowGroupLimit" in text and "Partial" in text
    assert "TakeOrderedAndProject" in plan(keys.top_talkers(v.edge(spark, sf), "bytes", 10))


def test_aggregates_combine_before_the_shuffle(spark, sf):
    text = plan(surface.threat_score(v.alerts(spark, sf), v.AS_OF, v.HALF_LIFE_S))
    assert "partial_sum" in text
    text = plan(surface.latest_findings(v.finding(spark, sf), ["asset_id", "vuln_id"], surface.finding_order(), ["cvss"]))
    assert "partial_max" in text and "Window" not in text


def test_set_operations_share_one_shuffle(spark, sf):
    assert plan(QUERIES["profile_set_ops"](spark, sf)).count("Exchange hashpartitioning") == 1


def test_scores_are_built_in_expressions(spark, sf):
    for name in ("normalize_events", "extract_iocs", "redact_text", "hunt_text", "decode_logs", "pseudonymize"):
        text = plan(QUERIES[name](spark, sf))
        assert "Python" not in text and "Pandas" not in text and "Exchange" not in text


def test_pagerank_rounds_do_not_move_the_edges(no_broadcast, sf, monkeypatch):
    from wardline.operators import graph

    plans, keep = [], graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df: plans.append(plan(df)) or keep(df))
    graph.pagerank(v.edge(no_broadcast, sf), iters=1)
    above_cache = plans[-1].split("InMemoryTableScan")[0].splitlines()
    join = next(i for i, line in enumerate(above_cache) if "_slice" in line and "SortMergeJoin" in line)
    assert not any("Exchange" in line or "Sort [" in line for line in above_cache[join:])


def test_few_rules_move_no_event(no_broadcast, sf):
    events = v.tel(no_broadcast, sf).select("event_id", "category", "magnitude", "attr")
    assert "Exchange hashpartitioning" not in plan(detect.match_rules(events, v.rule(no_broadcast)))


def test_two_snapshots_come_from_one_scan(spark, sf):
    assert plan(QUERIES["scan_diff"](spark, sf)).count("lineitem.parquet") == 1
