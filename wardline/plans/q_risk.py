"""Queries over privacy, attack surface, graph, risk and response."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.operators import enrich, graph, privacy, response, risk as risk_ops, surface
from wardline.plans import posture, views as v
from wardline.plans.registry import query
from wardline.plans.views import with_views
from wardline.session import shared_dir

_r6 = lambda *cols: {c: F.round(c, 6) for c in cols}


@query("flagship", with_views("chosen", "SELECT asset_id, category, n_alerts, rule_level, risk, site, subnet, mission, playbook_id, utility FROM chosen"))
def flagship(spark, sf):
    return posture.flagship(spark, sf)


# -- privacy ---------------------------------------------------------------------

def _people(spark, sf):
    c = v.asset(spark, sf)
    band = lambda width: F.floor(F.col("worth") / width).cast("int")
    return c.select("asset_id", "subnet", "site", "mission", band(2000).alias("band"), band(6000).alias("wide_band"))


_SQL_PEOPLE = """people AS (SELECT asset_id, subnet, site, mission, CAST(floor(worth / 2000) AS INT) AS band, CAST(floor(worth / 6000) AS INT) AS wide_band FROM asset)"""


@query("k_anonymize", with_views("asset", """, a AS (SELECT *, count(*) OVER (PARTITION BY subnet, band) AS c FROM people),
 b AS (SELECT *, count(*) OVER (PARTITION BY site, band) AS d FROM a WHERE c < 10), e AS (SELECT *, count(*) OVER (PARTITION BY site, wide_band) AS f FROM b WHERE d < 10)
SELECT asset_id, 0 AS level, subnet AS q0, CAST(band AS VARCHAR) AS q1 FROM a WHERE c >= 10
 UNION ALL SELECT asset_id, 1, site, CAST(band AS VARCHAR) FROM b WHERE d >= 10
 UNION ALL SELECT asset_id, 2, site, CAST(wide_band AS VARCHAR) FROM e WHERE f >= 10""", extra=_SQL_PEOPLE))
def k_anonymize(spark, sf):
    levels = [["subnet", "band"], ["site", "band"], ["site", "wide_band"]]
    return privacy.k_anonymize(_people(spark, sf), "asset_id", levels, 10)


@query("k_anonymity_report", with_views("asset", """SELECT count(*) AS n_classes, min(c) AS min_class, round(avg(c), 6) AS mean_class,
 round(sum(CASE WHEN c < 10 THEN c ELSE 0 END) / sum(c), 6) AS share_at_risk FROM (SELECT count(*) AS c FROM people GROUP BY subnet, band)""", extra=_SQL_PEOPLE))
def k_anonymity_report(spark, sf):
    report = privacy.k_anonymity_report(_people(spark, sf), ["subnet", "band"], 10)
    return report.withColumns(_r6("mean_class", "share_at_risk"))


@query("l_diversity", with_views("asset", """SELECT subnet, band, count(DISTINCT mission) AS n_values, count(*) AS n FROM people GROUP BY subnet, band HAVING count(DISTINCT mission) < 5""", extra=_SQL_PEOPLE))
def l_diversity(spark, sf):
    return privacy.l_diversity(_people(spark, sf), ["subnet", "band"], "mission", 5)


@query("dp_counts", with_views("asset", """, u AS (SELECT mission, count(DISTINCT asset_id) AS n,
 (CAST('0x' || substr(sha256('pepper|' || sha256('pepper|2024-Q1|0.5|' || mission)), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 - 0.5 AS u FROM asset GROUP BY mission)
SELECT mission, round(n - sign(u) * ln(1 - 2 * abs(u)) / 0.5, 6) AS noisy_n FROM u"""))
def dp_counts(spark, sf):
    return privacy.dp_counts(v.asset(spark, sf), "asset_id", ["mission"], 0.5, "pepper", "2024-Q1").withColumns(_r6("noisy_n"))


@query("dp_release", with_views("asset", """, r(release, e) AS (VALUES ('2024-Q1', '0.5'), ('2024-Q3', '0.25')),
 u AS (SELECT mission, release, CAST(e AS DOUBLE) AS e, count(DISTINCT asset_id) AS n,
 (CAST('0x' || substr(sha256('pepper|' || sha256('pepper|' || release || '|' || e || '|' || mission)), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 - 0.5 AS u
 FROM asset, r GROUP BY mission, release, r.e)
SELECT mission, release, round(n - sign(u) * ln(1 - 2 * abs(u)) / e, 6) AS noisy_n, 0.75::DOUBLE AS spent FROM u"""))
def dp_release(spark, sf):
    # The second release would spend more than is left, so it is refused; the third fits.
    ledger, granted = shared_dir(spark, "ledger"), []
    for release, epsilon in (("2024-Q1", 0.5), ("2024-Q2", 0.75), ("2024-Q3", 0.25)):
        try:
            counts = privacy.dp_release(v.asset(spark, sf), "asset_id", ["mission"], epsilon, "pepper", release, ledger, "asset", 1.0)
        except privacy.BudgetSpent:
            continue
        granted.append(counts.withColumn("release", F.lit(release)))
    spent = privacy.dp_spent(spark, ledger).select("spent").scalar()
    return granted[0].unionByName(granted[1]).withColumn("spent", spent).withColumns(_r6("noisy_n"))


@query("pseudonymize", with_views("tel", """SELECT event_id, sha256(concat('pepper:', CAST(entity_id AS VARCHAR))) AS entity_id FROM tel"""))
def pseudonymize(spark, sf):
    return privacy.pseudonymize(v.tel(spark, sf).select("event_id", "entity_id"), ["entity_id"], "pepper:")


# The check has its own words for the same texts.
_SQL_REDACTIONS = {
    "EMAIL": r"[\w.+-]+@[[:alnum:]-]+(?:\.[[:alpha:]]+)+", "HASH": "[[:xdigit:]]{40,}",
    "CARD": "(?:[0-9]{4}[ -]?){3}[0-9]{4}", "IP": "(?:[0-9]{1,3}[.]){3}[0-9]{1,3}",
}


def _sql_redact():
    text, parts = "text", []
    for tag, pattern in _SQL_REDACTIONS.items():
        parts.append(f"len(regexp_extract_all({text}, '{pattern}'))")
        text = f"regexp_replace({text}, '{pattern}', '[{tag}]', 'g')"
    return f"SELECT doc_id, {text} AS text, CAST({' + '.join(parts)} AS BIGINT) AS n_redacted FROM documents"


@query("redact_text", _sql_redact())
def redact_text(spark, sf):
    return privacy.redact_text(v.table(spark, sf, "documents").select("doc_id", "text"), "text")


# -- attack surface and scores -----------------------------------------------------

_LATEST_OF = """(SELECT asset_id, vuln_id, cvss, state FROM (SELECT *, row_number() OVER (PARTITION BY asset_id, vuln_id
 ORDER BY found_at DESC, run_id DESC, seq DESC, scanner_id DESC, cvss DESC, state) AS rn FROM finding {where}) WHERE rn = 1)"""


@query("scan_diff", with_views("finding", f""", p AS {_LATEST_OF.format(where="WHERE found_at < TIMESTAMP '1998-07-01'")}, c AS {_LATEST_OF.format(where="")}
SELECT coalesce(p.asset_id, c.asset_id) AS asset_id, coalesce(p.vuln_id, c.vuln_id) AS vuln_id,
 CASE WHEN p.asset_id IS NULL THEN 'new' WHEN c.asset_id IS NULL THEN 'gone' WHEN p.cvss = c.cvss AND p.state = c.state THEN 'same' ELSE 'changed' END AS status,
 coalesce(p.state, '') AS before_state, coalesce(c.state, '') AS after_state, coalesce(p.cvss, -1) AS before_cvss, coalesce(c.cvss, -1) AS after_cvss
 FROM p FULL OUTER JOIN c ON p.asset_id = c.asset_id AND p.vuln_id = c.vuln_id"""))
def scan_diff(spark, sf):
    f = v.finding(spark, sf)
    cut = F.lit("1998-07-01").cast("timestamp_ntz")
    diff = surface.scan_diff_at(f, cut, ["asset_id", "vuln_id"], surface.finding_order(), ["cvss", "state"])
    text, number = (lambda c: F.coalesce(c, F.lit(""))), (lambda c: F.coalesce(c, F.lit(-1)))
    return diff.withColumns(
        {
            "before_state": text("before_state"), "after_state": text("after_state"),
            "before_cvss": number("before_cvss"), "after_cvss": number("after_cvss"),
        }
    )


@query("latest_findings", with_views("latest", "SELECT asset_id, vuln_id, cvss, found_at, state FROM latest"))
def latest_findings(spark, sf):
    return posture.latest(spark, sf)


@query("cvss_score", with_views("cvss", "SELECT asset_id, max_cvss, round(mean_cvss, 6) AS mean_cvss, n_severe FROM cvss"))
def cvss_score(spark, sf):
    return surface.cvss_score(posture.latest(spark, sf)).withColumns(_r6("mean_cvss"))


@query("threat_score", with_views("threat", "SELECT asset_id, round(threat, 6) AS threat FROM threat"))
def threat_score(spark, sf):
    return posture.threat(spark, sf).withColumns(_r6("threat"))


@query("criticality_score", with_views("crit", "SELECT asset_id, round(criticality, 6) AS criticality FROM crit"))
def criticality_score(spark, sf):
    return posture.criticality(spark, sf).withColumns(_r6("criticality"))


@query("base_risk", with_views("risk", "SELECT asset_id, round(criticality, 6) AS criticality, round(threat, 6) AS threat, cvss, risk FROM risk"))
def base_risk(spark, sf):
    return posture.risk(spark, sf).withColumns(_r6("criticality", "threat"))


@query("mission_criticality", with_views("asset link", f""", c0 AS (SELECT asset_id AS node, {posture._WEIGHT} AS c FROM asset),
 c1 AS (SELECT node, max(c) AS c FROM (SELECT * FROM c0 UNION ALL SELECT dst, c * 0.5::DOUBLE FROM link JOIN c0 ON src = node) GROUP BY node),
 c2 AS (SELECT node, max(c) AS c FROM (SELECT * FROM c1 UNION ALL SELECT dst, c * 0.5::DOUBLE FROM link JOIN c1 ON src = node) GROUP BY node)
SELECT node, round(CAST(c AS DOUBLE), 6) AS criticality FROM c2 WHERE c > 0"""))
def mission_criticality(spark, sf):
    return surface.mission_criticality(v.asset(spark, sf), v.MISSION_WEIGHTS, v.link(spark, sf), 2).withColumns(_r6("criticality"))


@query("service_risk", with_views("service vuln_feed latest risk", """, a AS (SELECT service_id, vuln_id FROM service s JOIN vuln_feed f ON s.vendor = f.vendor
 WHERE major * 1000 + minor >= 1010 AND (hi IS NULL OR major * 1000 + minor < 2025)),
 p AS (SELECT vuln_id, count(*) AS n, max(r.risk) * max(l.cvss) / 10 AS worst FROM latest l JOIN risk r ON l.asset_id = r.asset_id WHERE state = 'open' GROUP BY vuln_id),
 o AS (SELECT service_id, count(*) AS n_vulns, sum(n) AS n_findings, max(worst) AS risk FROM a LEFT JOIN p ON a.vuln_id = p.vuln_id GROUP BY service_id)
SELECT s.service_id, coalesce(n_vulns, 0) AS n_vulns, CAST(coalesce(n_findings, 0) AS BIGINT) AS n_findings, round(coalesce(o.risk, 0), 4) AS risk FROM service s LEFT JOIN o ON s.service_id = o.service_id"""))
def service_risk(spark, sf):
    services = v.service(spark, sf)
    affected = enrich.match_vulnerabilities(services, v.vuln_feed(spark, sf))
    out = surface.service_risk(services, affected, posture.latest(spark, sf), posture.risk(spark, sf))
    return out.withColumn("risk", F.round("risk", 4))


# -- graph -----------------------------------------------------------------------

@query("build_edges", with_views("edge", "SELECT src, dst, n, CAST(bytes AS DOUBLE) AS bytes, first_ts, last_ts FROM edge"))
def build_edges(spark, sf):
    return v.edge(spark, sf).withColumn("bytes", F.col("bytes").cast("double"))


@query("graph_pattern", """SELECT o_custkey AS start, l_partkey AS "end", count(*) AS n_paths FROM orders JOIN lineitem ON o_orderkey = l_orderkey
 WHERE round(l_discount * 100) >= 9 GROUP BY o_custkey, l_partkey""")
def graph_pattern(spark, sf):
    orders = v.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"), F.lit("runs").alias("kind"), F.lit(0).alias("cvss")
    )
    lines = v.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit("exposes").alias("kind"),
        F.round(F.col("l_discount") * 100).cast("int").alias("cvss"),
    )
    return graph.graph_pattern(orders.unionByName(lines), ["runs", "exposes"], {1: F.col("cvss") >= 9})


def _seeds(spark, sf):
    return v.alerts(spark, sf).filter("level >= 13").select(F.col("entity_id").alias("node")).distinct()


@query("k_hop", with_views("link alerts", """, r(node, hops) AS (SELECT DISTINCT entity_id, 0 FROM alerts WHERE level >= 13
 UNION SELECT dst, hops + 1 FROM r JOIN link ON node = src WHERE hops < 3)
SELECT node, min(hops) AS hops FROM r GROUP BY node""", recursive=True))
def k_hop(spark, sf):
    return graph.k_hop(v.link(spark, sf), _seeds(spark, sf), 3)


@query("degree_centrality", with_views("degree", """SELECT node, in_degree, out_degree, total, strength, round(total / (SELECT count(*) - 1 FROM degree), 6) AS centrality FROM degree"""))
def degree_centrality(spark, sf):
    d = graph.degree_centrality(v.edge(spark, sf))
    return d.withColumns({"strength": F.col("strength").cast("double"), **_r6("centrality")})


def _sql_pagerank(iters: int = 10, d: float = 0.85) -> str:
    steps = [
        "l AS MATERIALIZED (SELECT DISTINCT src, dst FROM edge)",
        "nodes AS MATERIALIZED (SELECT node, (SELECT nullif(count(*), 0) FROM l WHERE src = node) AS outs FROM (SELECT src AS node FROM l UNION SELECT dst FROM l))",
        "r0 AS MATERIALIZED (SELECT node, outs, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS rank FROM nodes)",
    ]
    for i in range(iters):
        steps.append(
            f"""r{i + 1} AS MATERIALIZED (SELECT n.node, n.outs, {1 - d} / (SELECT count(*) FROM nodes) + {d} * (coalesce(g.got, 0)
 + (SELECT coalesce(sum(rank), 0) FROM r{i} WHERE outs IS NULL) / (SELECT count(*) FROM nodes)) AS rank FROM nodes n LEFT JOIN
 (SELECT dst, sum(rank / outs) AS got FROM l JOIN r{i} ON src = node GROUP BY dst) g ON n.node = g.dst)"""
        )
    return with_views("edge", f"SELECT node, round(rank, 9) AS rank FROM r{iters}", extra=",\n".join(steps))


@query("pagerank", _sql_pagerank())
def pagerank(spark, sf):
    return graph.pagerank(v.edge(spark, sf)).withColumn("rank", F.round("rank", 9))


@query("harmonic_closeness", with_views("link", """, nodes AS (SELECT src AS node FROM link UNION SELECT dst FROM link),
 r(a, b, hops) AS (SELECT node, node, 0 FROM nodes UNION SELECT a, dst, hops + 1 FROM r JOIN link ON b = src WHERE hops < 3),
 m AS (SELECT a, b, min(hops) AS h FROM r GROUP BY a, b)
SELECT a AS node, round(coalesce(sum(1.0 / h) FILTER (WHERE h > 0), 0), 6) AS closeness FROM m GROUP BY a""", recursive=True))
def harmonic_closeness(spark, sf):
    return graph.harmonic_closeness(v.link(spark, sf), 3).withColumns(_r6("closeness"))


@query("blast_radius", with_views("link alerts asset", """, r(seed, node) AS (SELECT DISTINCT entity_id, entity_id FROM alerts WHERE level >= 13
 UNION SELECT seed, dst FROM r JOIN link ON node = src)
SELECT seed, count(*) AS n_reached, coalesce(CAST(sum(CAST(worth AS DECIMAL(18,2))) AS DOUBLE), 0) AS worth FROM r LEFT JOIN asset ON node = asset_id WHERE node <> seed GROUP BY seed""", recursive=True))
def blast_radius(spark, sf):
    worth = v.table(spark, sf, "customer").select(F.col("c_custkey").alias("node"), F.col("c_acctbal").alias("worth"))
    return graph.blast_radius(v.link(spark, sf), worth, _seeds(spark, sf)).drop("depth")


@query("components", with_views("link", """, u AS (SELECT src AS a, dst AS b FROM link UNION SELECT dst, src FROM link), r(node, m) AS (SELECT a, a FROM u UNION SELECT u.b, r.m FROM r JOIN u ON r.node = u.a)
SELECT node, min(m) AS component FROM r GROUP BY node""", recursive=True))
def components(spark, sf):
    return graph.components(v.link(spark, sf))


# -- risk ------------------------------------------------------------------------

@query("exposure_rollup", with_views("finding asset", """SELECT coalesce(site, '*') AS site, coalesce(subnet, '*') AS subnet, coalesce(severity, '*') AS severity, n, "grouping" FROM (
 SELECT site, subnet, severity, count(*) AS n, CAST(grouping(site, subnet, severity) AS INT) AS "grouping" FROM (
 SELECT site, subnet, CASE WHEN cvss >= 7 THEN 'high' WHEN cvss >= 4 THEN 'medium' ELSE 'low' END AS severity FROM finding JOIN asset USING (asset_id))
 GROUP BY ROLLUP (site, subnet, severity))"""))
def exposure_rollup(spark, sf):
    rolled = risk_ops.exposure_rollup(v.finding(spark, sf), v.asset(spark, sf))
    return rolled.withColumns({c: F.coalesce(c, F.lit("*")) for c in ("site", "subnet", "severity")})


@query("exposure_by_side", with_views("finding asset", """, a AS (SELECT asset_id, site, CASE WHEN asset_id % 5 = 4 THEN 'unknown' WHEN asset_id % 5 = 3 THEN 'external' ELSE 'internal' END AS side FROM asset)
SELECT coalesce(side, '*') AS side, coalesce(site, '*') AS site, coalesce(severity, '*') AS severity, n, "grouping" FROM (
 SELECT side, site, severity, count(*) AS n, CAST(grouping(side, site, severity) AS INT) AS "grouping" FROM (
 SELECT side, site, CASE WHEN cvss >= 7 THEN 'high' WHEN cvss >= 4 THEN 'medium' ELSE 'low' END AS severity FROM finding JOIN a USING (asset_id))
 GROUP BY ROLLUP (side, site, severity))"""))
def exposure_by_side(spark, sf):
    # Addresses by asset number: three private networks, a public one, and none.
    net = F.get(F.array(*map(F.lit, ("10.0", "172.31", "192.168", "172.32"))), (F.col("asset_id") % 5).cast("int"))
    host = F.concat_ws(".", (F.col("asset_id") % 200).cast("string"), F.lit("7"))
    address = F.when(F.col("asset_id") % 5 < 4, F.concat_ws(".", net, host))
    asset = v.asset(spark, sf).withColumn("side", risk_ops.surface_side(address))
    rolled = risk_ops.exposure_rollup(v.finding(spark, sf), asset, ["side", "site"])
    return rolled.withColumns({c: F.coalesce(c, F.lit("*")) for c in ("side", "site", "severity")})


def _sql_cube(groups: str) -> str:
    return with_views("asset_risk", f"""SELECT coalesce(site, '*') AS site, coalesce(mission, '*') AS mission, round(mean_risk, 6) AS mean_risk, max_risk, n_assets, "grouping" FROM (
 SELECT site, mission, CAST(sum(CAST(risk AS DECIMAL(18,6))) AS DOUBLE) / count(*) AS mean_risk, max(risk) AS max_risk, count(*) AS n_assets,
 CAST(grouping(site, mission) AS INT) AS "grouping" FROM asset_risk GROUP BY {groups})""")


def _stars(df):
    return df.withColumns({**{c: F.coalesce(c, F.lit("*")) for c in ("site", "mission")}, **_r6("mean_risk")})


@query("risk_cube", _sql_cube("CUBE (site, mission)"))
def risk_cube(spark, sf):
    return _stars(risk_ops.risk_cube(posture.asset_risk(spark, sf), ["site", "mission"]))


@query("risk_grouping_sets", _sql_cube("GROUPING SETS ((site), (mission))"))
def risk_grouping_sets(spark, sf):
    return _stars(
        risk_ops.risk_grouping_sets(posture.asset_risk(spark, sf), ["site", "mission"], [["site"], ["mission"]])
    )


@query("risk_trend", with_views("daily", """SELECT site, day, score, round(avg(score) OVER (PARTITION BY site ORDER BY day ROWS 6 PRECEDING), 6) AS moving_mean,
 score - coalesce(lag(score) OVER (PARTITION BY site ORDER BY day), score) AS change, max(score) OVER (PARTITION BY site ORDER BY day) AS running_max FROM daily"""))
def risk_trend(spark, sf):
    trend = risk_ops.risk_trend(posture.daily_by_site(spark, sf), by=["site"])
    return trend.withColumns({**_r6("moving_mean"), "change": F.coalesce("change", F.lit(0))})


@query("risk_projection", with_views("daily", """, l AS (SELECT site, regr_slope(CAST(score AS DOUBLE), day - DATE '1970-01-01') AS b, regr_intercept(CAST(score AS DOUBLE), day - DATE '1970-01-01') AS a, max(day) AS last FROM daily GROUP BY site)
SELECT site, CAST(last + CAST(i AS INT) AS DATE) AS day, round(b, 4) AS slope, round(greatest(a + b * (last + CAST(i AS INT) - DATE '1970-01-01'), 0), 4) AS projected FROM l, range(1, 8) t(i)"""))
def risk_projection(spark, sf):
    ahead = risk_ops.risk_projection(posture.daily_by_site(spark, sf), 7, ["site"])
    return ahead.withColumns({c: F.round(c, 4) for c in ("slope", "projected")})


@query("ewma", with_views("daily", """, o AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY day) AS i FROM daily),
 r(site, day, i, ewma) AS (SELECT site, day, i, CAST(score AS DOUBLE) FROM o WHERE i = 1
 UNION ALL SELECT o.site, o.day, o.i, 0.3::DOUBLE * o.score + 0.7::DOUBLE * r.ewma FROM r JOIN o ON o.site = r.site AND o.i = r.i + 1)
SELECT site, day, round(ewma, 6) AS ewma FROM r""", recursive=True))
def ewma(spark, sf):
    return risk_ops.ewma(posture.daily_by_site(spark, sf), ["site"], "day", "score", 0.3).withColumns(_r6("ewma"))


@query("risk_rank", with_views("asset_risk", """SELECT asset_id, site, risk, place, rank, dense_rank, quartile, round(percent_rank, 6) AS percent_rank, round(cume_dist, 6) AS cume_dist FROM (
 SELECT asset_id, site, risk, row_number() OVER t AS place, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank, CAST(ntile(4) OVER t AS INT) AS quartile,
 percent_rank() OVER w AS percent_rank, cume_dist() OVER w AS cume_dist FROM asset_risk
 WINDOW w AS (PARTITION BY site ORDER BY risk DESC), t AS (PARTITION BY site ORDER BY risk DESC, asset_id))"""))
def risk_rank(spark, sf):
    ranked = risk_ops.risk_rank(posture.asset_risk(spark, sf).select("asset_id", "site", "risk"), "site")
    return ranked.withColumns(_r6("percent_rank", "cume_dist"))


@query("posture_summary", with_views("asset alerts latest ioc_obs ioc_feed risk", """SELECT kpi, round(value, 4) AS value FROM (
 SELECT 'assets' AS kpi, CAST(count(*) AS DOUBLE) AS value FROM asset UNION ALL SELECT 'alerts', count(*) FROM alerts
 UNION ALL SELECT 'open_findings', count(*) FROM latest WHERE state = 'open'
 UNION ALL SELECT 'ioc_hits', count(*) FROM (SELECT o.* FROM ioc_obs o SEMI JOIN ioc_feed f ON o.ioc_type = f.ioc_type AND o.ioc = f.ioc)
 UNION ALL SELECT 'mean_risk', avg(risk) FROM risk UNION ALL SELECT 'max_risk', max(risk) FROM risk
 UNION ALL SELECT 'p50_risk', quantile_cont(risk, 0.5) FROM risk UNION ALL SELECT 'p95_risk', quantile_cont(risk, 0.95) FROM risk)"""))
def posture_summary(spark, sf):
    from wardline.operators import enrich

    hits = enrich.ioc_hits(v.ioc_obs(spark, sf), v.ioc_feed(spark, sf), ["ioc_type", "ioc"])
    figures = risk_ops.posture_summary(
        v.asset(spark, sf), v.alerts(spark, sf), posture.latest(spark, sf), hits, posture.risk(spark, sf)
    )
    return figures.withColumn("value", F.round("value", 4))


# -- response --------------------------------------------------------------------

@query("select_playbook", with_views("chosen", "SELECT asset_id, category, risk, mission, playbook_id, utility FROM chosen"))
def select_playbook(spark, sf):
    cases = posture.cases(spark, sf).select("asset_id", "category", "risk", "mission")
    return response.select_playbook(cases, v.playbook(spark))


@query("playbook_feedback", with_views("playbook", """, o AS (SELECT CAST(substr(o_orderpriority, 1, 1) AS INT) AS playbook_id, c_mktsegment AS segment,
 CASE o_orderstatus WHEN 'F' THEN true WHEN 'P' THEN false END AS success FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT playbook_id, segment, count(success) AS n, count(*) FILTER (WHERE success) AS n_ok, round((count(*) FILTER (WHERE success) + 1) / (count(success) + 2), 6) AS rate,
 round(benefit * (count(*) FILTER (WHERE success) + 1) / (count(success) + 2), 6) AS adjusted_benefit FROM o JOIN playbook USING (playbook_id) GROUP BY playbook_id, segment, benefit"""))
def playbook_feedback(spark, sf):
    ok = F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "P", False)
    segments = v.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    outcomes = (
        v.table(spark, sf, "orders")
        .select("o_custkey", F.substr("o_orderpriority", F.lit(1), F.lit(1)).cast("int").alias("playbook_id"), ok.alias("success"))
        .join(segments, "o_custkey")
    )
    rates = response.playbook_feedback(outcomes, v.playbook(spark))
    return rates.withColumns(_r6("rate", "adjusted_benefit"))
