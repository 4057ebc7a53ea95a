"""The scores of all assets, and the flagship: which assets are at most risk, and what to do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wardline.operators import detect, graph, response, risk as risk_ops, surface
from wardline.operators.ordered import micros, profile_keys
from wardline.plans import views as v

HALF_DAY_S = 12 * 3600


def latest(spark: SparkSession, sf: str) -> DataFrame:
    return surface.latest_findings(
        v.finding(spark, sf), ["asset_id", "vuln_id"], surface.finding_order(), ["cvss", "found_at", "state"]
    )


def threat(spark: SparkSession, sf: str) -> DataFrame:
    scores = surface.threat_score(v.alerts(spark, sf), v.AS_OF, v.HALF_LIFE_S)
    return scores.withColumnRenamed("entity_id", "asset_id")


def criticality(spark: SparkSession, sf: str) -> DataFrame:
    return surface.criticality_score(v.asset(spark, sf), v.MISSION_WEIGHTS, graph.degree_centrality(v.edge(spark, sf)))


def risk(spark: SparkSession, sf: str) -> DataFrame:
    """Risk of every asset, to six places."""
    cvss = surface.cvss_score(latest(spark, sf)).select("asset_id", F.col("max_cvss").cast("double").alias("cvss"))
    scores = surface.base_risk(criticality(spark, sf), threat(spark, sf), cvss)
    return scores.withColumn("risk", F.round("risk", 6))


def asset_risk(spark: SparkSession, sf: str) -> DataFrame:
    """Risk next to the asset's place and mission."""
    places = v.asset(spark, sf).select("asset_id", "site", "subnet", "mission")
    return risk(spark, sf).select("asset_id", "risk").join(places, "asset_id")


def cases(spark: SparkSession, sf: str) -> DataFrame:
    """One case per asset that has kept alerts: the category of its strongest one (ties: least event id), its risk.

    Events -> rules (best one per event) -> deduplication -> asset context -> risk.
    """
    events = v.tel(spark, sf).select("event_id", "entity_id", "ts", "category", "magnitude", "attr", "level")
    hits = detect.match_rules(events, v.rule(spark)).filter("is_best")
    keys = ["entity_id", "category"]
    # Heavy keys of the hits are heavy among the events, which are cheaper to profile.
    split = profile_keys(events, keys, micros("ts"))
    kept = detect.dedup_alerts(hits, keys, HALF_DAY_S, split=split)
    strongest = F.max_by("category", F.struct("level", -F.col("event_id")))
    per_asset = kept.groupBy(F.col("entity_id").alias("asset_id")).agg(
        strongest.alias("category"), F.count("*").alias("n_alerts"), F.max("rule_level").alias("rule_level")
    )
    return per_asset.join(asset_risk(spark, sf), "asset_id")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return response.select_playbook(cases(spark, sf), v.playbook(spark))


def daily_by_site(spark: SparkSession, sf: str) -> DataFrame:
    """Sum of alert levels per site and day; alerts are summed per asset and day before the join."""
    per_asset = risk_ops.daily_score(v.alerts(spark, sf), by=["entity_id"])
    sites = v.asset(spark, sf).select(F.col("asset_id").alias("entity_id"), "site")
    return per_asset.join(sites, "entity_id").groupBy("site", "day").agg(F.sum("score").alias("score"))


# The same chain as SQL.
_WEIGHT = "CASE mission " + " ".join(f"WHEN '{m}' THEN {w}" for m, w in v.MISSION_WEIGHTS.items()) + " ELSE 0 END"
v.SQL_VIEWS.update(
    {
        "degree": (("edge",), """SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree,
 CAST(sum(i + o) AS BIGINT) AS total, CAST(sum(bytes) AS DOUBLE) AS strength
 FROM (SELECT src AS node, 0 AS i, 1 AS o, bytes FROM edge UNION ALL SELECT dst, 1, 0, bytes FROM edge) GROUP BY node"""),
        "crit": (("asset", "degree"), f"""SELECT asset_id, raw / max(raw) OVER () * 10 AS criticality FROM (
 SELECT asset_id, {_WEIGHT} * (1 + coalesce(total, 0) / (SELECT max(total) FROM degree)) AS raw FROM asset LEFT JOIN degree ON asset_id = node)"""),
        "threat": (("alerts",), f"""SELECT entity_id AS asset_id, sum(level * pow(0.5, (epoch_us(TIMESTAMP '{v.AS_OF}') - epoch_us(ts)) / 1e6 / {v.HALF_LIFE_S}.0)) AS threat
 FROM alerts WHERE ts <= TIMESTAMP '{v.AS_OF}' GROUP BY entity_id"""),
        "cvss": (("latest",), """SELECT asset_id, max(cvss) AS max_cvss, avg(cvss) AS mean_cvss, count(*) FILTER (WHERE cvss >= 7) AS n_severe
 FROM latest WHERE state = 'open' GROUP BY asset_id"""),
        "risk": (("crit", "threat", "cvss"), """SELECT asset_id, criticality, threat, cvss, round(100 * (
 0.4 * CASE WHEN max(criticality) OVER () > min(criticality) OVER () THEN (criticality - min(criticality) OVER ()) / (max(criticality) OVER () - min(criticality) OVER ()) ELSE 0 END
 + 0.3 * CASE WHEN max(threat) OVER () > min(threat) OVER () THEN (threat - min(threat) OVER ()) / (max(threat) OVER () - min(threat) OVER ()) ELSE 0 END
 + 0.3 * CASE WHEN max(cvss) OVER () > min(cvss) OVER () THEN (cvss - min(cvss) OVER ()) / (max(cvss) OVER () - min(cvss) OVER ()) ELSE 0 END), 6) AS risk
 FROM (SELECT asset_id, coalesce(criticality, 0) AS criticality, coalesce(threat, 0) AS threat, CAST(coalesce(max_cvss, 0) AS DOUBLE) AS cvss
 FROM crit FULL OUTER JOIN threat USING (asset_id) FULL OUTER JOIN cvss USING (asset_id))"""),
        "asset_risk": (("risk", "asset"), "SELECT asset_id, risk, site, subnet, mission FROM risk JOIN asset USING (asset_id)"),
        "cases": (("tel", "rule", "asset_risk"), """SELECT k.*, risk, site, subnet, mission FROM (
 SELECT entity_id AS asset_id, arg_max(category, (level, -event_id)) AS category, count(*) AS n_alerts, max(rule_level) AS rule_level FROM (
 SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY entity_id, category ORDER BY ts, event_id)) AS gap FROM (
 SELECT event_id, entity_id, ts, tel.category, level, max(rule_level) AS rule_level FROM tel JOIN rule
 ON (rule.category IS NULL OR tel.category = rule.category) AND magnitude >= min_magnitude AND attr BETWEEN attr_lo AND attr_hi GROUP BY ALL))
 WHERE gap IS NULL OR gap > 43200000000 GROUP BY entity_id) k JOIN asset_risk USING (asset_id)"""),
        "chosen": (("cases", "playbook"), """SELECT c.*, coalesce(p.playbook_id, 0) AS playbook_id, coalesce(p.u, 0) AS utility FROM cases c LEFT JOIN (
 SELECT asset_id, playbook_id, round(benefit * risk - cost, 6) AS u, row_number() OVER (PARTITION BY asset_id ORDER BY round(benefit * risk - cost, 6) DESC, playbook_id) AS rn
 FROM cases JOIN playbook p ON (p.category IS NULL OR p.category = cases.category) AND risk >= min_risk AND (p.mission IS NULL OR p.mission = cases.mission)) p
 ON c.asset_id = p.asset_id AND rn = 1"""),
        "daily": (("alerts", "asset"), """SELECT site, CAST(ts AS DATE) AS day, CAST(sum(level) AS BIGINT) AS score FROM alerts JOIN asset ON entity_id = asset_id GROUP BY ALL"""),
    }
)
