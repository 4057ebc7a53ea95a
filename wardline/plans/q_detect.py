"""Queries over enrichment, detection and behaviour."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.functions import url_host
from wardline.operators import behaviour, detect, enrich
from wardline.operators.normalize import EMAIL
from wardline.operators.same import join_same
from wardline.plans import views as v
from wardline.plans.registry import query
from wardline.plans.views import with_views

HOUR, DAY = 3600, 86400
CATEGORIES = ["signup", "error", "click", "view", "purchase"]
H12_US, H24_US = 12 * HOUR * 1_000_000, DAY * 1_000_000

# -- enrichment ------------------------------------------------------------------

ON = ["ioc_type", "ioc"]


@query("enrich_iocs", with_views("ioc_obs ioc_feed", """SELECT doc_id, o.ioc_type, o.ioc, coalesce(severity, 0) AS severity,
 severity IS NOT NULL AS is_hit FROM ioc_obs o LEFT JOIN ioc_feed f ON o.ioc_type = f.ioc_type AND o.ioc = f.ioc"""))
def enrich_iocs(spark, sf):
    found = enrich.enrich_iocs(v.ioc_obs(spark, sf), v.ioc_feed(spark, sf), ON)
    return found.withColumn("severity", F.coalesce("severity", F.lit(0)))


@query("ioc_hits", with_views("ioc_obs ioc_feed", "SELECT o.* FROM ioc_obs o SEMI JOIN ioc_feed f ON o.ioc_type = f.ioc_type AND o.ioc = f.ioc"))
def ioc_hits(spark, sf):
    return enrich.ioc_hits(v.ioc_obs(spark, sf), v.ioc_feed(spark, sf), ON).select("doc_id", *ON)


@query("unmatched_iocs", with_views("ioc_obs ioc_feed", "SELECT o.* FROM ioc_obs o ANTI JOIN ioc_feed f ON o.ioc_type = f.ioc_type AND o.ioc = f.ioc"))
def unmatched_iocs(spark, sf):
    return enrich.unmatched_iocs(v.ioc_obs(spark, sf), v.ioc_feed(spark, sf), ON).select("doc_id", *ON)


@query("domain_suffix_match", """WITH h AS (SELECT page_id, lower(regexp_extract(url, 'https?://([^/?#:]+)', 1)) AS host FROM pages),
 f AS (SELECT DISTINCT regexp_extract(host, '[^.]+[.][^.]+$') AS ioc FROM h UNION SELECT DISTINCT regexp_extract(host, '[^.]+[.][^.]+[.][^.]+$')
 FROM h WHERE starts_with(host, 'blog.')),
 m AS (SELECT page_id, host, ioc, row_number() OVER (PARTITION BY page_id ORDER BY length(ioc) DESC) AS rn
 FROM h JOIN f ON host = ioc OR ends_with(host, '.' || ioc))
SELECT page_id, host, ioc AS matched FROM m WHERE rn = 1 AND ioc <> ''""")
def domain_suffix_match(spark, sf):
    obs = v.table(spark, sf, "pages").select("page_id", url_host(F.col("url")).alias("host"))
    tail = lambda n: F.regexp_extract("host", "[^.]+" + "[.][^.]+" * (n - 1) + "$", 0).alias("ioc")
    feed = obs.select(tail(2)).union(obs.filter(F.col("host").startswith("blog.")).select(tail(3))).filter("ioc <> ''")
    return enrich.domain_suffix_match(obs, feed.distinct()).select("page_id", "host", "matched")


@query("cidr_match", with_views("ioc_obs cidr_block", """, o AS (SELECT doc_id, ioc AS ip, list_transform(string_split(ioc, '.'), lambda x: CAST(x AS BIGINT)) AS p
 FROM ioc_obs WHERE ioc_type = 'ipv4' AND regexp_matches(ioc, '^(0|[1-9][0-9]{0,2})([.](0|[1-9][0-9]{0,2})){3}$')),
 b AS (SELECT net, prefix, list_transform(string_split(net, '.'), lambda x: CAST(x AS BIGINT)) AS p FROM cidr_block),
 m AS (SELECT doc_id, ip, net, prefix, row_number() OVER (PARTITION BY doc_id, ip ORDER BY prefix DESC) AS rn FROM o JOIN b
 ON (o.p[1] * 16777216 + o.p[2] * 65536 + o.p[3] * 256 + o.p[4]) >> (32 - prefix) = (b.p[1] * 16777216 + b.p[2] * 65536 + b.p[3] * 256 + b.p[4]) >> (32 - prefix)
 WHERE list_max(o.p) <= 255)
SELECT doc_id, ip, net, prefix FROM m WHERE rn = 1"""))
def cidr_match(spark, sf):
    obs = v.ioc_obs(spark, sf).filter("ioc_type = 'ipv4'").select("doc_id", F.col("ioc").alias("ip"))
    return enrich.cidr_match(obs, v.cidr_block(spark)).select("doc_id", "ip", "net", "prefix")


@query("asset_context", with_views("alerts asset", "SELECT event_id, entity_id, subnet, site, mission FROM alerts JOIN asset ON entity_id = asset_id"))
def asset_context(spark, sf):
    return enrich.asset_context(v.alerts(spark, sf).select("event_id", "entity_id"), v.asset(spark, sf).drop("worth"))


@query("context_asof", with_views("tel", """SELECT e.event_id, CASE WHEN epoch_us(e.ts) - epoch_us(s.ts) <= 259200000000 THEN s.event_id ELSE -1 END AS state_id
 FROM (SELECT * FROM tel WHERE category = 'error') e ASOF LEFT JOIN (SELECT * FROM tel WHERE category = 'signup') s
 ON e.entity_id = s.entity_id AND e.ts >= s.ts"""))
def context_asof(spark, sf):
    t = v.tel(spark, sf).select("event_id", "entity_id", "ts", "category")
    found = enrich.context_asof(
        t.filter("category = 'error'"), t.filter("category = 'signup'"), "entity_id", "ts", "event_id", "event_id", 3 * DAY
    )
    return found.select("event_id", F.coalesce("state_id", F.lit(-1)).alias("state_id"))


@query("correlate_pairs", with_views("tel", f"""SELECT b.entity_id, b.event_id AS effect_id, arg_max(a.event_id, (a.ts, a.event_id)) AS cause_id, count(*) AS n_causes
 FROM tel a JOIN tel b ON a.entity_id = b.entity_id AND b.ts > a.ts AND epoch_us(b.ts) - epoch_us(a.ts) <= {H12_US}
 WHERE a.category = 'signup' AND b.category = 'error' GROUP BY b.entity_id, b.event_id"""))
def correlate_pairs(spark, sf):
    t = v.tel(spark, sf).select("event_id", "entity_id", "ts", "category")
    found = enrich.correlate_pairs(
        t.filter("category = 'signup'"), t.filter("category = 'error'"), "entity_id", 12 * HOUR
    )
    return found.select("entity_id", "effect_id", "cause_id", "n_causes")


@query("match_vulnerabilities", with_views("service vuln_feed", """SELECT service_id, s.vendor, version, vuln_id, 'affected' AS status FROM service s JOIN vuln_feed f ON s.vendor = f.vendor
 WHERE major * 1000 + minor >= 1010 AND (hi IS NULL OR major * 1000 + minor < 2025)"""))
def match_vulnerabilities(spark, sf):
    return enrich.match_vulnerabilities(v.service(spark, sf), v.vuln_feed(spark, sf)).select(
        "service_id", "vendor", "version", "vuln_id", "status"
    )


@query("apply_share_policy", """WITH o AS (SELECT doc_id, CASE WHEN source IN ('src0', 'src1') THEN 'red' WHEN lang = 'en' THEN 'green' ELSE 'amber' END AS marking FROM documents)
SELECT doc_id, marking, peer FROM o JOIN (VALUES ('a', 'green'), ('a', 'amber'), ('b', 'green')) AS p(peer, allowed) ON marking = allowed""")
def apply_share_policy(spark, sf):
    marking = (
        F.when(F.col("source").isin("src0", "src1"), "red").when(F.col("lang") == "en", "green").otherwise("amber")
    )
    objs = v.table(spark, sf, "documents").select("doc_id", marking.alias("marking"))
    peers = spark.sql(
        "SELECT * FROM (VALUES ('a', true, array('green', 'amber')), ('b', true, array('green')), "
        "('c', false, array('green', 'amber', 'red'))) AS t(peer, shares, allowed)"
    )
    return enrich.apply_share_policy(objs, peers).select("doc_id", "marking", "peer")


# -- detection -------------------------------------------------------------------

@query("match_rules", with_views("tel rule", """, m AS (SELECT event_id, rule_id, rule_level FROM tel JOIN rule ON (rule.category IS NULL OR tel.category = rule.category)
 AND magnitude >= min_magnitude AND attr BETWEEN attr_lo AND attr_hi)
SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY rule_level DESC, rule_id) = 1 AS is_best FROM m"""))
def match_rules(spark, sf):
    t = v.tel(spark, sf).select("event_id", "category", "magnitude", "attr")
    return detect.match_rules(t, v.rule(spark)).select("event_id", "rule_id", "rule_level", "is_best")


@query("frequency_rule", with_views("alerts", f"""SELECT event_id, entity_id FROM (SELECT *, count(*) OVER (PARTITION BY entity_id ORDER BY epoch_us(ts)
 RANGE BETWEEN {H12_US} PRECEDING AND CURRENT ROW) AS c FROM alerts) WHERE c >= 2"""))
def frequency_rule(spark, sf):
    a = v.alerts(spark, sf).select("event_id", "entity_id", "ts")
    return detect.frequency_rule(a, "entity_id", 2, 12 * HOUR).select("event_id", "entity_id")


@query("dedup_alerts", with_views("alerts", f"""SELECT event_id, entity_id, category FROM (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY entity_id, category ORDER BY ts, event_id)) AS gap
 FROM alerts) WHERE gap IS NULL OR gap > {H12_US}"""))
def dedup_alerts(spark, sf):
    a = v.alerts(spark, sf).select("event_id", "entity_id", "category", "ts")
    return detect.dedup_alerts(a, ["entity_id", "category"], 12 * HOUR).drop("ts")


SQL_INCIDENTS = """g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 21600000000 THEN 0 ELSE 1 END AS s FROM alerts
 WINDOW w AS (PARTITION BY entity_id ORDER BY ts, event_id)),
 i AS (SELECT *, sum(s) OVER (PARTITION BY entity_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g),
 incidents AS (SELECT entity_id, min(event_id) AS incident_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n, max(level) AS max_level
 FROM i GROUP BY entity_id, k)"""


def incidents(spark, sf):
    a = v.alerts(spark, sf).select("event_id", "entity_id", "ts", "level")
    return detect.sessionize_alerts(a, "entity_id", 6 * HOUR)


@query("sessionize_alerts", with_views("alerts", "SELECT * FROM incidents", extra=SQL_INCIDENTS))
def sessionize_alerts(spark, sf):
    return incidents(spark, sf)


@query("prune_alerts", with_views("alerts", """, r AS (SELECT event_id, entity_id, level, CAST(ts AS DATE) AS day, CASE WHEN level >= 3 THEN
 row_number() OVER (PARTITION BY entity_id, CAST(ts AS DATE) ORDER BY level DESC, event_id) END AS rn,
 count(*) OVER (PARTITION BY entity_id, CAST(ts AS DATE)) AS c, count(*) FILTER (WHERE level >= 3) OVER (PARTITION BY entity_id, CAST(ts AS DATE)) AS ok FROM alerts)
SELECT event_id, entity_id, level, c - 1 AS n_pruned FROM r WHERE rn = 1"""))
def prune_alerts(spark, sf):
    a = v.alerts(spark, sf).select("event_id", "entity_id", "level", F.col("ts").cast("date").alias("day"))
    return detect.prune_alerts(a, ["entity_id", "day"], 1, 3).drop("day")


@query("root_cause", with_views("alerts edge", """, up AS (SELECT DISTINCT dst AS e, src AS node FROM edge UNION SELECT DISTINCT entity_id, entity_id FROM incidents),
 c AS (SELECT incident_id, a.ts AS ts, event_id, a.entity_id AS node, row_number() OVER (PARTITION BY incident_id ORDER BY a.ts, event_id) AS rn
 FROM incidents JOIN up ON incidents.entity_id = up.e JOIN alerts a ON a.entity_id = up.node AND a.ts <= session_start
 AND epoch_us(session_start) - epoch_us(a.ts) <= 86400000000)
SELECT incident_id, event_id AS cause_id, node AS cause_entity FROM c WHERE rn = 1""", extra=SQL_INCIDENTS))
def root_cause(spark, sf):
    a = v.alerts(spark, sf).select("event_id", "entity_id", "ts")
    found = detect.root_cause(incidents(spark, sf), a, v.edge(spark, sf), DAY)
    return found.select("incident_id", "cause_id", "cause_entity")


@query("zscore_anomalies", with_views("tel", """, s AS (SELECT category, avg(magnitude) AS m, stddev_samp(magnitude) AS sd FROM tel GROUP BY category)
SELECT event_id, tel.category, round((magnitude - m) / sd, 4) AS z FROM tel JOIN s ON tel.category = s.category WHERE abs(magnitude - m) / sd > 3"""))
def zscore_anomalies(spark, sf):
    t = v.tel(spark, sf).select("event_id", "category", "magnitude")
    return detect.zscore_anomalies(t, "category", "magnitude").select("event_id", "category", F.round("z", 4).alias("z"))


@query("mad_anomalies", with_views("tel", """, m AS (SELECT category, quantile_cont(magnitude, 0.5) AS med FROM tel GROUP BY category),
 d AS (SELECT event_id, tel.category, abs(magnitude - med) AS dev FROM tel JOIN m ON tel.category = m.category),
 q AS (SELECT category, quantile_cont(dev, 0.5) AS mad FROM d GROUP BY category)
SELECT event_id, d.category, round(0.6745 * dev / mad, 4) AS score FROM d JOIN q ON d.category = q.category WHERE 0.6745 * dev / mad > 5"""))
def mad_anomalies(spark, sf):
    t = v.tel(spark, sf).select("event_id", "category", "magnitude")
    found = detect.mad_anomalies(t, "category", "magnitude")
    return found.select("event_id", "category", F.round("score", 4).alias("score"))


@query("seasonal_baseline", with_views("tel", """, h AS (SELECT date_trunc('hour', ts) AS hour_start, CAST(hour(ts) AS INT) AS hour, count(*) AS n FROM tel GROUP BY ALL)
SELECT a.hour_start, a.hour, a.n, round(avg(b.n), 4) AS mean, round(stddev_samp(b.n), 4) AS sd,
 round(CASE WHEN stddev_samp(b.n) > 0 THEN (a.n - avg(b.n)) / stddev_samp(b.n) ELSE 0 END, 4) AS z
 FROM h a JOIN h b ON a.hour = b.hour AND a.hour_start <> b.hour_start GROUP BY a.hour_start, a.hour, a.n HAVING count(*) > 1"""))
def seasonal_baseline(spark, sf):
    b = detect.seasonal_baseline(v.tel(spark, sf))
    return b.withColumns({c: F.round(F.coalesce(c, F.lit(0.0)), 4) for c in ("mean", "sd", "z")})


WEIGHTS = {"volume": 1.0, "magnitude": 2.0, "fan_out": 1.0, "error_share": 2.0}
SQL_VIEWS4 = """ev AS (SELECT entity_id, CAST(count(*) AS DOUBLE) AS volume, CAST(sum(CAST(magnitude AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS magnitude,
 CAST(count(DISTINCT dst) AS DOUBLE) AS fan_out, count(*) FILTER (WHERE category = 'error') / count(*) AS error_share FROM tel GROUP BY entity_id),
 sc AS (SELECT *, (percent_rank() OVER (ORDER BY volume) + 2 * percent_rank() OVER (ORDER BY magnitude) + percent_rank() OVER (ORDER BY fan_out)
 + 2 * percent_rank() OVER (ORDER BY error_share)) / 6 AS score FROM ev)"""


def multiview(spark, sf):
    return detect.multiview_score(detect.entity_views(v.tel(spark, sf)), WEIGHTS, 0.7)


@query("multiview_score", with_views("tel", "SELECT entity_id, round(score, 6) AS score, score > 0.7 AS flagged FROM sc", extra=SQL_VIEWS4))
def multiview_score(spark, sf):
    return multiview(spark, sf).select("entity_id", F.round("score", 6).alias("score"), "flagged")


@query("embedding_outliers", """WITH p AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
 c AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM p GROUP BY label, i),
 d AS (SELECT vec_id, p.label, round(sqrt(sum((x - m) * (x - m))), 6) AS distance FROM p JOIN c ON p.label = c.label AND p.i = c.i GROUP BY vec_id, p.label)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY distance DESC, vec_id) AS INT) AS place FROM d) WHERE place <= 5""")
def embedding_outliers(spark, sf):
    return detect.embedding_outliers(v.table(spark, sf, "embeddings"), "embedding", "label", 5, 64)


@query("kmeans_anomalies")
def kmeans_anomalies(spark, sf):
    views = detect.entity_views(v.tel(spark, sf))
    return detect.kmeans_anomalies(views, ["volume", "magnitude", "fan_out", "error_share"], 4, 7, 0.95)


@query("federated_average", with_views("tel asset", """, j AS (SELECT site, magnitude FROM tel JOIN asset ON entity_id = asset_id)
SELECT site, count(*) AS n, round(avg(magnitude), 6) AS mean, round(var_samp(magnitude), 6) AS var,
 round((SELECT avg(magnitude) FROM j), 6) AS global_mean, round((SELECT stddev_samp(magnitude) FROM j), 6) AS global_sd FROM j GROUP BY site"""))
def federated_average(spark, sf):
    t = enrich.asset_context(v.tel(spark, sf).select("entity_id", "magnitude"), v.asset(spark, sf).select("asset_id", "site"))
    model = detect.federated_average(t, "site", "magnitude")
    return model.withColumns({c: F.round(c, 6) for c in ("mean", "var", "global_mean", "global_sd")})


@query("federated_score", with_views("tel asset", """, j AS (SELECT event_id, magnitude, level, attr FROM tel JOIN asset ON entity_id = asset_id),
 m AS (SELECT avg(magnitude) AS m1, stddev_samp(magnitude) AS s1, avg(level) AS m2, stddev_samp(level) AS s2, avg(attr) AS m3, stddev_samp(attr) AS s3 FROM j),
 z AS (SELECT event_id, (magnitude - m1) / s1 AS z1, (level - m2) / s2 AS z2, (attr - m3) / s3 AS z3 FROM j, m)
SELECT event_id, round(z1, 6) AS z_magnitude, round(z2, 6) AS z_level, round(z3, 6) AS z_attr, round(greatest(abs(z1), abs(z2), abs(z3)), 6) AS score FROM z"""))
def federated_score(spark, sf):
    t = v.tel(spark, sf).select("event_id", "entity_id", "magnitude", "level", "attr")
    t = enrich.asset_context(t, v.asset(spark, sf).select("asset_id", "site"))
    scored = detect.federated_score(t, "site", ["magnitude", "level", "attr"])
    return scored.select("event_id", *[F.round(c, 6).alias(c) for c in ("z_magnitude", "z_level", "z_attr", "score")])


@query("first_seen", with_views("tel", """SELECT entity_id, attr, arg_min(event_id, (ts, event_id)) AS first_id,
 min(ts) >= TIMESTAMP '2024-01-20' AS is_new FROM tel GROUP BY entity_id, attr"""))
def first_seen(spark, sf):
    cut = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    return detect.first_seen(v.tel(spark, sf), "entity_id", "attr", "ts", cut).drop("first_ts")


@query("rare_values", with_views("tel", """SELECT attr, count(DISTINCT entity_id) AS n_entities, count(*) AS n,
 round(count(*) / (SELECT count(*) FROM tel), 6) AS share FROM tel GROUP BY attr HAVING count(DISTINCT entity_id) <= 15"""))
def rare_values(spark, sf):
    return detect.rare_values(v.tel(spark, sf), "attr", "entity_id", 15).withColumn("share", F.round("share", 6))


@query("beaconing", with_views("tel", """, g AS (SELECT src, dst, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY src, dst ORDER BY ts, event_id))) / 1e6 AS gap FROM tel)
SELECT src, dst, count(*) AS n, round(avg(gap), 3) AS mean_gap, round(stddev_samp(gap) / avg(gap), 6) AS cv FROM g GROUP BY src, dst HAVING count(*) >= 3"""))
def beaconing(spark, sf):
    found = detect.beaconing(v.tel(spark, sf), 3)
    return found.withColumns({"mean_gap": F.round("mean_gap", 3), "cv": F.round("cv", 6)})


@query("flow_aggregate", with_views("tel", """, f AS (SELECT date_trunc('day', ts) AS bucket, category, count(*) AS n, sum(CAST(magnitude AS DECIMAL(18,2))) AS total,
 max(magnitude) AS largest, count(DISTINCT dst) AS n_peers FROM tel GROUP BY ALL)
SELECT CAST(bucket AS TIMESTAMP) AS bucket, category, n, CAST(total AS DOUBLE) AS total, largest, n_peers,
 round(CAST(total AS DOUBLE) / CAST(sum(total) OVER (PARTITION BY bucket) AS DOUBLE), 6) AS share FROM f"""))
def flow_aggregate(spark, sf):
    flows = detect.flow_aggregate(v.tel(spark, sf), ["category"], "1 day")
    return flows.withColumns({"total": F.col("total").cast("double"), "share": F.round("share", 6)})


@query("fan_out", with_views("tel", """SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS bucket, src, count(DISTINCT dst) AS n_peers FROM tel GROUP BY ALL HAVING count(DISTINCT dst) >= 4"""))
def fan_out(spark, sf):
    return detect.fan_out(v.tel(spark, sf), "src", "dst", "1 day", 4)


@query("fan_out_approx", with_views("tel", """SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS bucket, src, count(DISTINCT dst) AS n_peers, TRUE AS is_near FROM tel GROUP BY ALL HAVING count(DISTINCT dst) > 0"""))
def fan_out_approx(spark, sf):
    # The exact count, and whether the sketch lies within four standard errors of 5 % (or 1) of it.
    count = lambda approx: detect.fan_out(v.tel(spark, sf), "src", "dst", "1 day", 1, approx=approx)
    both = join_same(count(False), count(True).withColumnRenamed("n_peers", "about"), ["bucket", "src"])
    near = F.abs(F.col("about") - F.col("n_peers")) <= F.greatest(F.lit(1.0), 0.2 * F.col("n_peers"))
    return both.select("bucket", "src", "n_peers", near.alias("is_near"))


@query("explain_anomaly", with_views("tel", """, st AS (SELECT avg(volume) AS m1, stddev_samp(volume) AS s1, avg(magnitude) AS m2, stddev_samp(magnitude) AS s2,
 avg(fan_out) AS m3, stddev_samp(fan_out) AS s3, avg(error_share) AS m4, stddev_samp(error_share) AS s4 FROM sc),
 z AS (SELECT entity_id, 'volume' AS feature, (volume - m1) / s1 AS c FROM sc, st WHERE score > 0.7
 UNION ALL SELECT entity_id, 'magnitude', (magnitude - m2) / s2 FROM sc, st WHERE score > 0.7
 UNION ALL SELECT entity_id, 'fan_out', (fan_out - m3) / s3 FROM sc, st WHERE score > 0.7
 UNION ALL SELECT entity_id, 'error_share', (error_share - m4) / s4 FROM sc, st WHERE score > 0.7)
SELECT entity_id, feature, round(c, 6) AS contribution, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY round(abs(c), 9) DESC, feature) AS INT) AS place FROM z""", extra=SQL_VIEWS4))
def explain_anomaly(spark, sf):
    found = detect.explain_anomaly(multiview(spark, sf), list(WEIGHTS))
    return found.withColumn("contribution", F.round("contribution", 6))


# -- behaviour -------------------------------------------------------------------

@query("behaviour_sequence", with_views("tel", f"""SELECT entity_id, event_id AS first_id, l AS last_id FROM (SELECT *, lead(category) OVER w AS c2, lead(category, 2) OVER w AS c3,
 lead(ts, 2) OVER w AS t3, lead(event_id, 2) OVER w AS l FROM tel WINDOW w AS (PARTITION BY entity_id ORDER BY ts, event_id))
 WHERE category = 'signup' AND c2 = 'error' AND c3 = 'purchase' AND epoch_us(t3) - epoch_us(ts) <= {H24_US}"""))
def behaviour_sequence(spark, sf):
    found = behaviour.behaviour_sequence(v.tel(spark, sf), "entity_id", ["signup", "error", "purchase"], DAY)
    return found.select("entity_id", "first_id", "last_id")


@query("behaviour_funnel", with_views("tel", """, a AS (SELECT * FROM tel WHERE category = 'view'), b AS (SELECT * FROM tel WHERE category = 'click'),
 c AS (SELECT * FROM tel WHERE category = 'purchase'),
 ab AS (SELECT b.entity_id, b.event_id, b.ts, max(epoch_us(a.ts)) AS s FROM b JOIN a ON a.entity_id = b.entity_id AND (a.ts, a.event_id) < (b.ts, b.event_id)
 AND epoch_us(b.ts) - epoch_us(a.ts) <= 259200000000 GROUP BY b.entity_id, b.event_id, b.ts),
 abc AS (SELECT DISTINCT c.entity_id FROM c JOIN ab ON ab.entity_id = c.entity_id AND (ab.ts, ab.event_id) < (c.ts, c.event_id) AND epoch_us(c.ts) - s <= 259200000000)
SELECT entity_id, CAST(CASE WHEN entity_id IN (SELECT entity_id FROM abc) THEN 3 WHEN entity_id IN (SELECT entity_id FROM ab) THEN 2
 WHEN entity_id IN (SELECT entity_id FROM a) THEN 1 ELSE 0 END AS INT) AS stage FROM (SELECT DISTINCT entity_id FROM tel WHERE category IN ('view', 'click', 'purchase'))"""))
def behaviour_funnel(spark, sf):
    return behaviour.behaviour_funnel(v.tel(spark, sf), "entity_id", ["view", "click", "purchase"], 3 * DAY)


@query("transition_matrix", with_views("tel", """, l AS (SELECT category, lead(category) OVER (PARTITION BY entity_id ORDER BY ts, event_id) AS next_state FROM tel)
SELECT category, next_state, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY category), 6) AS p FROM l WHERE next_state IS NOT NULL GROUP BY category, next_state"""))
def transition_matrix(spark, sf):
    return behaviour.transition_matrix(v.tel(spark, sf), "entity_id", "category").withColumn("p", F.round("p", 6))


def _bundles(spark, sf):
    turns = v.table(spark, sf, "conversations").withColumn("size", F.length("text"))
    return behaviour.build_bundle(turns, "conv_id", "role", "turn", ["size"], F.col("turn"), max_objects=4)


@query("build_bundle", """WITH t AS (SELECT conv_id, turn, role, length(text) AS size, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 4 AS part FROM conversations)
SELECT conv_id, CAST(part AS BIGINT) AS part, count(*) AS n_objects, CAST(to_json(struct_pack(type := 'bundle', id := concat('bundle-', conv_id, '-', part),
 objects := list(struct_pack(type := role, id := CAST(turn AS VARCHAR), size := size) ORDER BY turn))) AS VARCHAR) AS bundle FROM t GROUP BY conv_id, part""")
def build_bundle(spark, sf):
    return _bundles(spark, sf)


@query("flatten_bundle", """SELECT concat('bundle-', conv_id, '-', (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 4) AS bundle_id,
 role AS type, CAST(turn AS VARCHAR) AS id, length(text) AS size FROM conversations""")
def flatten_bundle(spark, sf):
    flat = behaviour.flatten_bundle(_bundles(spark, sf))
    return flat.select("bundle_id", "type", "id", F.variant_get("props", "$.size", "long").alias("size"))


@query("bundle_types", """SELECT role AS type, count(*) AS n,
 CASE WHEN count(text) = 0 THEN 'OBJECT<id: STRING, type: STRING>' ELSE 'OBJECT<id: STRING, size: BIGINT, type: STRING>' END AS properties FROM conversations GROUP BY role""")
def bundle_types(spark, sf):
    return behaviour.bundle_types(behaviour.flatten_bundle(_bundles(spark, sf)))


@query("timeline", """WITH b AS (SELECT user_id AS entity_id, ts, 'events' AS source, event_id AS ref_id FROM events
 UNION ALL SELECT o_custkey, o_orderdate, 'orders', o_orderkey FROM orders)
SELECT entity_id, source, ref_id, row_number() OVER (PARTITION BY entity_id ORDER BY ts, source, ref_id) AS seq FROM b""")
def timeline(spark, sf):
    events = v.tel(spark, sf).select("entity_id", "ts", F.col("event_id").alias("ref_id"), "category")
    orders = v.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("entity_id"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("ref_id"), "o_orderstatus"
    )
    lines = behaviour.timeline({"events": events, "orders": orders}, "ts", "entity_id", "ref_id")
    return lines.select("entity_id", "source", "ref_id", "seq")


# The check has its own words for the same texts.
SQL_HUNTS = {"token": "token = .(?:[0-9]|[a-f]){40}", "mail": r"[\w.+-]+@[[:alnum:]-]+(?:\.[[:alpha:]]+)+"}
HUNTS = {"token": ("token = .[0-9a-f]{40}", "token = "), "mail": (EMAIL, "@")}


@query("hunt_text", "WITH h AS (" + " UNION ALL ".join(
    f"""SELECT doc_id, '{n}' AS hunt, text, regexp_extract(text, '{p}') AS m, CAST(len(regexp_extract_all(text, '{p}')) AS BIGINT) AS hits FROM documents"""
    for n, p in SQL_HUNTS.items()
) + """) SELECT doc_id, hunt, hits, substr(text, greatest(strpos(text, m) - 20, 1), strpos(text, m) - greatest(strpos(text, m) - 20, 1) + length(m) + 20) AS snippet
 FROM h WHERE hits > 0""")
def hunt_text(spark, sf):
    return behaviour.hunt_text(v.table(spark, sf, "documents"), "doc_id", "text", HUNTS)


@query("case_report", with_views("tel", "SELECT entity_id, count(*) AS n, " + ", ".join(
    f"count(*) FILTER (WHERE category = '{c}') AS n_{c}" for c in CATEGORIES
) + """, min(ts) AS first_ts, max(ts) AS last_ts,
 array_to_string((list(event_id ORDER BY level DESC, event_id))[1:3], ',') AS evidence FROM tel GROUP BY entity_id"""))
def case_report(spark, sf):
    return behaviour.case_report(v.tel(spark, sf), "entity_id", "category", CATEGORIES, "ts", "level", "event_id")
