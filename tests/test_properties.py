"""Invariants of the operators on the test tables."""

import pytest
from pyspark.sql import functions as F

from wardline.operators import detect, enrich, graph, privacy
from wardline.operators.ordered import exact_quantiles
from wardline.operators.sizing import checked_broadcast
from wardline.plans import posture, views as v
from wardline.plans.catalog import QUERIES


def test_hits_and_unmatched_make_up_all_observations(spark, sf):
    obs, feed, on = v.ioc_obs(spark, sf), v.ioc_feed(spark, sf), ["ioc_type", "ioc"]
    hits, rest = enrich.ioc_hits(obs, feed, on), enrich.unmatched_iocs(obs, feed, on)
    assert hits.count() and rest.count()
    assert hits.unionByName(rest).exceptAll(obs).isEmpty() and obs.exceptAll(hits.unionByName(rest)).isEmpty()
    # A feed with repeated rows changes nothing.
    assert enrich.ioc_hits(obs, feed.unionByName(feed), on).count() == hits.count()
    assert enrich.enrich_iocs(obs, feed.unionByName(feed), on).count() == obs.count()


def test_released_classes_have_k_rows(spark, sf):
    out = QUERIES["k_anonymize"](spark, sf)
    assert out.groupBy("level", "q0", "q1").count().agg(F.min("count")).first()[0] >= 10
    assert out.count() == out.select("asset_id").distinct().count()


def test_merged_model_is_the_central_fit(spark, sf):
    t = v.tel(spark, sf).withColumn("site", F.col("entity_id") % 4)
    model = detect.federated_average(t, "site", "magnitude")
    central = t.agg(F.avg("magnitude").alias("m"), F.stddev_samp("magnitude").alias("s")).first()
    got = model.first()
    assert (got.global_mean, got.global_sd) == pytest.approx((central.m, central.s))
    scored = detect.federated_score(t, "site", ["magnitude", "level"])
    spread = scored.agg(*[f(f"z_{c}") for c in ("magnitude", "level") for f in (F.avg, F.stddev_samp)]).first()
    assert tuple(spread) == pytest.approx((0, 1, 0, 1), abs=1e-9)


def test_pagerank_adds_up_to_one(spark, sf):
    ranks = graph.pagerank(v.edge(spark, sf))
    assert ranks.agg(F.sum("rank")).first()[0] == pytest.approx(1.0)
    # Slicing the edges of a node changes nothing.
    sliced = graph.pagerank(v.edge(spark, sf), slice_edges=3).withColumnRenamed("rank", "again")
    assert ranks.join(sliced, "node").filter(F.abs(F.col("rank") - F.col("again")) < 1e-12).count() == ranks.count()


def test_closeness_sketch_stays_near_the_exact_value_on_a_larger_graph(spark):
    # Everybody reaches the same 5000 nodes in two hops: far beyond what the sketch counts exactly.
    hub = spark.range(1, 5001).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    spokes = spark.range(1, 5001).select(F.col("id").alias("src"), F.lit(0).cast("long").alias("dst"))
    close = graph.harmonic_closeness_approx(hub.unionByName(spokes), 2)
    got = close.filter("node > 0").agg(F.avg("closeness")).first()[0]
    assert got == pytest.approx(1 + 4999 / 2, rel=0.05)


def test_noise_is_centred_and_subjects_count_once(spark):
    df = spark.range(4000).select((F.col("id") % 10).alias("subject"), (F.col("id") % 400).alias("key"))
    noisy = privacy.dp_counts(df.unionByName(df), "subject", ["key"], 1.0, "s", "first")
    stats = noisy.agg(F.avg("noisy_n").alias("m"), F.stddev("noisy_n").alias("s")).first()
    exact = df.distinct().groupBy("key").count().first()["count"]
    assert abs(stats.m - exact) < 0.4 and 0.9 < stats.s < 2.0


def test_flagged_share_follows_the_quantile(spark, sf):
    views = detect.entity_views(v.tel(spark, sf))
    out = detect.kmeans_anomalies(views, ["volume", "magnitude"], 2, 7, 0.8)
    share = out.filter("flagged").count() / out.count()
    assert 0 < share <= 0.25


def test_approximate_fan_out_is_near_the_exact_one(spark, sf):
    t = v.tel(spark, sf)
    exact = detect.fan_out(t, "src", "dst", "1 day", 1).withColumnRenamed("n_peers", "exact")
    both = detect.fan_out(t, "src", "dst", "1 day", 1, approx=True).join(exact, ["bucket", "src"])
    assert both.filter(F.abs(F.col("n_peers") - F.col("exact")) > 0.1 * F.col("exact") + 1).isEmpty()


def test_every_asset_has_a_risk_within_bounds(spark, sf):
    risk = posture.risk(spark, sf)
    lo, hi, n = risk.agg(F.min("risk"), F.max("risk"), F.count("*")).first()
    assert 0 <= lo <= hi <= 100 and n == v.asset(spark, sf).count()


def test_redacted_text_has_nothing_left_to_redact(spark, sf):
    docs = v.table(spark, sf, "documents").select("doc_id", "text")
    once = privacy.redact_text(docs, "text")
    assert once.agg(F.sum("n_redacted")).first()[0] > 0
    again = privacy.redact_text(once.drop("n_redacted"), "text")
    assert again.agg(F.sum("n_redacted")).first()[0] == 0


def test_pseudonyms_keep_joins(spark, sf):
    t = v.tel(spark, sf).select("event_id", "entity_id")
    masked = privacy.pseudonymize(t, ["entity_id"], "s")
    count = lambda df: sorted(r["count"] for r in df.groupBy("entity_id").count().collect())
    assert count(t) == count(masked)


def test_large_frames_are_not_broadcast(spark):
    df = spark.range(100)
    assert "ResolvedHint" in checked_broadcast(df, max_rows=100)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in checked_broadcast(df, max_rows=99)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in checked_broadcast(df, max_bytes=50)._jdf.queryExecution().analyzed().toString()


def test_quantiles_of_a_constant(spark):
    df = spark.range(50).select(F.lit(1).alias("g"), F.lit(3.0).alias("x"))
    assert exact_quantiles(df, ["g"], "x", {"a": 0.1, "b": 0.99}).select("a", "b").first() == (3.0, 3.0)
