"""Queries over sources, normalisation and key maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from wardline import sources
from wardline.functions import (
    canonical_host, expiry_date, first_token, kv_extract, migrate_url, version_key,
)
from wardline.operators import keys, normalize
from wardline.operators.ordered import micros, previous
from wardline.plans import views as v
from wardline.plans.registry import query
from wardline.plans.views import with_views
from wardline.session import shared_dir


# -- sources and sinks ---------------------------------------------------------

@query("scan_glob", "SELECT 'events.parquet' AS source, count(*) AS n, max(event_id) AS last_id FROM events")
def scan_glob(spark, sf):
    found = sources.scan_glob(spark, sf, "event*.parquet")
    return found.groupBy("source").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))


@query("read_indicator_csv", """SELECT s_suppkey AS ioc_id, s_name AS name,
 CASE WHEN s_acctbal < 1000 THEN -1.0 ELSE s_acctbal END AS score, s_acctbal < 1000 AS is_corrupt FROM supplier""")
def read_indicator_csv(spark, sf):
    score = F.when(F.col("s_acctbal") < 1000, "n/a").otherwise(F.col("s_acctbal").cast("string"))
    lines = v.table(spark, sf, "supplier").select(F.concat_ws(",", "s_suppkey", "s_name", score).alias("value"))
    path = shared_dir(spark, "indicators")
    lines.write.text(path)
    schema = StructType(
        [StructField("ioc_id", LongType()), StructField("name", StringType()), StructField("score", DoubleType())]
    )
    return sources.read_indicator_csv(spark, path, schema).select(
        "ioc_id", "name", F.coalesce("score", F.lit(-1.0)).alias("score"),
        F.col("_corrupt").isNotNull().alias("is_corrupt"),
    )


@query("replay_tail", """SELECT event_id, event_type FROM events UNION ALL
 (SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 50)""")
def replay_tail(spark, sf):
    return sources.replay_tail(v.table(spark, sf, "events").select("event_id", "event_type"), "event_id", 50)


@query("ingest_lines", "SELECT concat_ws(' ', CAST(event_id AS VARCHAR), event_type, props) AS value FROM events")
def ingest_lines(spark, sf):
    src, out, ckpt = (shared_dir(spark, n) for n in ("lines-in", "lines-out", "lines-ckpt"))
    events = v.table(spark, sf, "events")
    events.select(F.concat_ws(" ", "event_id", "event_type", "props").alias("value")).write.option(
        "maxRecordsPerFile", 20000
    ).text(src)
    sources.ingest_lines(spark, src, out, ckpt, max_files=4).awaitTermination()
    return spark.read.schema("value string").parquet(out)


@query("route", with_views("tel", """SELECT event_id, CASE WHEN level >= 8 THEN 'critical' WHEN category = 'error' THEN 'alert'
 WHEN attr < 10 THEN 'watch' ELSE 'archive' END AS route FROM tel"""))
def route(spark, sf):
    routes = {
        "critical": F.col("level") >= 8,
        "alert": F.col("category") == "error",
        "watch": F.col("attr") < 10,
    }
    return sources.route(v.tel(spark, sf), routes, "archive").select("event_id", "route")


@query("publish_cti_events", with_views("ioc_obs", """SELECT doc_id, CAST(0 AS BIGINT) AS part, count(*) AS n_attributes,
 CAST(to_json(struct_pack(attributes := list(struct_pack(type := ioc_type, value := ioc) ORDER BY ioc_type, ioc))) AS VARCHAR) AS event
 FROM (SELECT DISTINCT doc_id, ioc_type, ioc FROM ioc_obs) GROUP BY doc_id"""))
def publish_cti_events(spark, sf):
    return sources.publish_cti_events(v.ioc_obs(spark, sf), ["doc_id"], "ioc_type", "ioc")


# -- normalisation ---------------------------------------------------------------

@query("normalize_events", with_views("tel", """SELECT event_id, ts, entity_id, category, magnitude, attr, level,
 entity_id IS NOT NULL AND ts IS NOT NULL AS valid FROM tel"""))
def normalize_events(spark, sf):
    k = F.get_json_object("props", "$.k")
    return normalize.normalize_events(
        v.table(spark, sf, "events"),
        {
            "event_id": F.col("event_id"), "ts": F.col("ts"), "entity_id": F.col("user_id"),
            "category": F.lower(F.trim("event_type")), "magnitude": F.col("value"), "attr": k.try_cast("int"),
            "level": F.least(F.lit(15), F.floor(F.col("value") / 20)).cast("int"),
        },
    )


@query("decode_logs", """SELECT page_id, CASE WHEN regexp_matches(url, '^https://') THEN 'secure' WHEN regexp_matches(url, '^http://')
 THEN 'plain' ELSE 'none' END AS decoder, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host,
 regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1) AS path FROM pages""")
def decode_logs(spark, sf):
    rest = "([^/?#]+)(/[^?#]*)?"
    decoders = {"secure": (f"^https://{rest}", ["host", "path"]), "plain": (f"^http://{rest}", ["host", "path"])}
    return normalize.decode_logs(v.table(spark, sf, "pages"), "url", decoders).select(
        "page_id", F.coalesce("decoder", F.lit("none")).alias("decoder"),
        F.coalesce(F.col("fields")["host"], F.lit("")).alias("host"),
        F.coalesce(F.col("fields")["path"], F.lit("")).alias("path"),
    )


@query("extract_iocs", f"""WITH f AS (
 SELECT doc_id, 'ipv4' AS ioc_type, unnest(regexp_extract_all(text, '{normalize.DOTTED_DIGITS}')) AS ioc FROM documents
 UNION ALL SELECT doc_id, 'email', lower(unnest(regexp_extract_all(text, '{normalize.EMAIL}'))) FROM documents
 UNION ALL SELECT doc_id, 'host', lower(unnest(regexp_extract_all(text, '{normalize.URL_HOST}', 1))) FROM documents
 UNION ALL SELECT doc_id, 'sha1', unnest(regexp_extract_all(text, '{normalize.HEX_RUN}')) FROM documents)
SELECT DISTINCT doc_id, ioc_type, ioc FROM f WHERE (ioc_type <> 'sha1' OR length(ioc) = 40) AND (ioc_type <> 'ipv4' OR (
 regexp_matches(ioc, '^(0|[1-9][0-9]{{0,2}})([.](0|[1-9][0-9]{{0,2}})){{3}}$') AND list_max(list_transform(string_split(ioc, '.'), lambda x: TRY_CAST(x AS INT))) <= 255))""")
def extract_iocs(spark, sf):
    return normalize.extract_iocs(v.table(spark, sf, "documents"), "doc_id", "text")


@query("canonical_host", r"""SELECT page_id, regexp_replace(regexp_extract(lower(trim(url)), '^[a-z]+://([^/?#:]+)', 1), '^www[.]', '') AS host FROM pages""")
def canonical_host_q(spark, sf):
    return v.table(spark, sf, "pages").select("page_id", canonical_host(F.col("url")).alias("host"))


@query("replace_literal", "SELECT page_id, replace(url, 'example.com', 'corp.test') AS url FROM pages")
def replace_literal(spark, sf):
    return normalize.replace_literal(
        v.table(spark, sf, "pages").select("page_id", "url"), ["url"], "example.com", "corp.test"
    )


@query("migrate_url", """SELECT page_id, CASE WHEN regexp_matches(url, '^http://[^/?#:]+([/?#].*)?$')
 THEN regexp_replace(url, '^http://([^/?#:]+)', 'https://\\1:4443') ELSE url END AS url FROM pages""")
def migrate_url_q(spark, sf):
    moved = migrate_url(F.col("url"), ("http", None), ("https", 4443))
    return v.table(spark, sf, "pages").select("page_id", moved.alias("url"))


@query("kv_extract", r"""WITH q AS (SELECT page_id, string_split(regexp_extract(url, '[?]([^#]*)', 1), '&') AS parts FROM pages),
 e AS (SELECT page_id, unnest(parts) AS p, generate_subscripts(parts, 1) AS i FROM q),
 r AS (SELECT page_id, trim(split_part(p, '=', 1)) AS key, regexp_replace(split_part(p, '=', 2), '[\s''"]', '', 'g') AS value, i,
 row_number() OVER (PARTITION BY page_id, split_part(p, '=', 1) ORDER BY i DESC) AS rn FROM e WHERE contains(p, '='))
SELECT page_id, key, value FROM r WHERE rn = 1""")
def kv_extract_q(spark, sf):
    settings = kv_extract(F.regexp_extract("url", "[?]([^#]*)", 1), "&")
    return v.table(spark, sf, "pages").select("page_id", F.explode(settings).alias("key", "value"))


@query("rewrite_keyed_value", """SELECT c_custkey, concat('NAME=', c_name, chr(10), 'SEGMENT=corp.test', chr(10), 'NATION=', CAST(c_nationkey AS VARCHAR)) AS text,
 c_mktsegment <> 'corp.test' AS changed FROM customer""")
def rewrite_keyed_value(spark, sf):
    text = F.concat(
        F.lit("NAME="), "c_name", F.lit("\nSEGMENT="), "c_mktsegment", F.lit("\nNATION="), F.col("c_nationkey").cast("string")
    )
    keyed = v.table(spark, sf, "customer").select("c_custkey", text.alias("text"))
    return normalize.rewrite_keyed_value(keyed, "text", "SEGMENT", "corp.test")


@query("select_by_environment", with_views("asset", """SELECT asset_id, CASE WHEN site IN ('EUROPE', 'ASIA') THEN subnet ELSE mission END AS selected FROM asset"""))
def select_by_environment(spark, sf):
    inside = F.col("site").isin("EUROPE", "ASIA")
    return normalize.select_by_environment(v.asset(spark, sf), inside, "subnet", "mission").select("asset_id", "selected")


@query("first_token", "SELECT p_partkey, split_part(p_name, ' ', 1) AS token FROM part")
def first_token_q(spark, sf):
    return v.table(spark, sf, "part").select("p_partkey", first_token(F.col("p_name")).alias("token"))


@query("elapsed_parts", with_views("tel", """SELECT event_id, (s // 60)::BIGINT AS minutes, (s % 60)::BIGINT AS seconds FROM (
 SELECT event_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY entity_id ORDER BY ts, event_id))) // 1000000 AS s FROM tel) WHERE s IS NOT NULL"""))
def elapsed(spark, sf):
    t = v.tel(spark, sf).select("event_id", "entity_id", "ts")
    gaps = previous(t, ["entity_id"], ["ts", "event_id"], micros("ts"), before=F.col("ts")).filter("before IS NOT NULL")
    return normalize.add_elapsed(gaps, "before", "ts").select("event_id", "minutes", "seconds")


@query("expiry_date", """SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) + 365, '%d/%m/%Y') AS text,
 CAST(o_orderdate AS DATE) + 365 < DATE '1998-01-01' AS expired FROM orders""")
def expiry(spark, sf):
    e = expiry_date(F.col("o_orderdate"), 365, at=F.lit("1998-01-01"))
    return v.table(spark, sf, "orders").select("o_orderkey", e.alias("e")).select("o_orderkey", "e.text", "e.expired")


@query("version_key", with_views("service", """SELECT service_id, concat(CAST(major AS VARCHAR), '-', CAST(minor AS VARCHAR), '-0') AS key_text,
 major > 2 OR (major = 2 AND minor > 9) AS newer FROM service"""))
def version_key_q(spark, sf):
    k = version_key(F.col("version"))
    return v.service(spark, sf).select(
        "service_id", F.array_join(F.transform(k, lambda p: p.cast("string")), "-").alias("key_text"),
        (k > version_key(F.lit("v2.9.0"))).alias("newer"),
    )


@query("summarize_lines", """WITH n AS (SELECT *, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1) // 5 AS part FROM orders)
SELECT o_custkey, CAST(part AS BIGINT) AS part, count(*) AS n_lines, string_agg(o_orderpriority, chr(10) ORDER BY o_orderdate, o_orderkey) AS report
FROM n GROUP BY o_custkey, part""")
def summarize_lines(spark, sf):
    return normalize.summarize_lines(
        v.table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], micros("o_orderdate"),
        "o_orderpriority", max_lines=5,
    )


# -- filters, sets, keys ---------------------------------------------------------

@query("membership_filter", with_views("tel asset", """SELECT event_id, entity_id FROM tel
 WHERE entity_id IN (SELECT asset_id FROM asset WHERE mission = 'BUILDING')"""))
def membership_filter(spark, sf):
    allowed = v.table(spark, sf, "customer").filter(F.col("c_mktsegment") == "BUILDING")
    return keys.membership_filter(
        v.tel(spark, sf).select("event_id", "entity_id"), allowed.select(F.col("c_custkey").alias("entity_id")), "entity_id"
    )


@query("missing_required", "SELECT c_custkey AS asset_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def missing_required(spark, sf):
    assets = v.table(spark, sf, "customer").select(F.col("c_custkey").alias("asset_id"))
    seen = v.table(spark, sf, "events").select(F.col("user_id").alias("asset_id"))
    return keys.missing_required(assets, seen, "asset_id")


@query("exclude_reserved", with_views("tel", "SELECT event_id, category FROM tel WHERE category NOT IN ('view', 'click')"))
def exclude_reserved(spark, sf):
    return keys.exclude_reserved(v.tel(spark, sf).select("event_id", "category"), "category", ["view", "click"])


@query("lookup_default", """SELECT c_custkey, n_name AS subnet, CASE WHEN n_regionkey = 1 THEN lower(n_name) ELSE n_name END AS resolved
 FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def lookup_default(spark, sf):
    nation = v.table(spark, sf, "nation")
    aliases = nation.filter("n_regionkey = 1").select(F.col("n_name").alias("subnet"), F.lower("n_name").alias("alias"))
    placed = v.table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return keys.lookup_default(placed.select("c_custkey", F.col("n_name").alias("subnet")), aliases, "subnet", "alias")


@query("expand_members", """SELECT p_partkey, CAST(generate_subscripts(string_split(p_name, ' '), 1) - 1 AS INT) AS place,
 unnest(string_split(p_name, ' ')) AS member FROM part""")
def expand_members(spark, sf):
    return keys.expand_members(v.table(spark, sf, "part"), "p_partkey", "p_name")


_CUSTOMER = ["c_custkey", "c_name", "c_acctbal"]


def _updates(spark, sf):
    c = v.table(spark, sf, "customer").select(*_CUSTOMER)
    balance = F.round(F.col("c_acctbal") + 100, 2)
    changed = c.filter("c_acctbal < 2000").withColumn("c_acctbal", balance)
    # New customers: negative keys, which the table does not have.
    new = c.filter("c_acctbal > 8000").withColumns({"c_custkey": -1 - F.col("c_custkey"), "c_acctbal": balance})
    return c, changed.unionByName(new)


_SQL_UPDATES = """WITH c AS (SELECT c_custkey, c_name, c_acctbal FROM customer),
 u AS (SELECT c_custkey, c_name, round(c_acctbal + 100, 2) AS c_acctbal FROM c WHERE c_acctbal < 2000
 UNION ALL SELECT -1 - c_custkey, c_name, round(c_acctbal + 100, 2) FROM c WHERE c_acctbal > 8000)
"""


@query("upsert_by_key", _SQL_UPDATES + """SELECT * FROM u UNION ALL SELECT * FROM c WHERE c_custkey NOT IN (SELECT c_custkey FROM u)""")
def upsert_by_key(spark, sf):
    target, updates = _updates(spark, sf)
    return keys.upsert_by_key(target, updates, "c_custkey")


@query("insert_if_absent", _SQL_UPDATES + """SELECT * FROM c UNION ALL SELECT * FROM u WHERE c_custkey NOT IN (SELECT c_custkey FROM c)""")
def insert_if_absent(spark, sf):
    target, updates = _updates(spark, sf)
    return keys.insert_if_absent(target, updates, "c_custkey")


@query("replace_stale", _SQL_UPDATES + """, k AS (SELECT * FROM c WHERE c_acctbal >= 1000)
SELECT * FROM k UNION ALL SELECT * FROM u WHERE c_custkey NOT IN (SELECT c_custkey FROM k)""")
def replace_stale(spark, sf):
    target, updates = _updates(spark, sf)
    return keys.replace_stale(target, target.filter("c_acctbal < 1000").select("c_custkey"), updates, "c_custkey")


@query("semver_latest", with_views("service", """SELECT version FROM (SELECT DISTINCT version, major, minor FROM service
 WHERE regexp_matches(version, '^v[0-9]+[.][0-9]+[.]0$')) ORDER BY major DESC, minor DESC LIMIT 3"""))
def semver_latest(spark, sf):
    return keys.semver_latest(v.service(spark, sf), "version", n=3)


@query("upgrade_path", with_views("service", """, p AS (SELECT DISTINCT vendor, version, major * 1000 + minor AS k FROM service),
 b AS (SELECT vendor, min(k) AS lo FROM p GROUP BY vendor)
SELECT vendor, version, CAST(row_number() OVER (PARTITION BY vendor ORDER BY k) AS INT) AS step FROM p JOIN b USING (vendor) WHERE k > lo"""))
def upgrade_path(spark, sf):
    s = v.service(spark, sf).select("vendor", "version")
    k = version_key(F.col("version"))
    ends = s.groupBy("vendor").agg(F.min_by("version", k).alias("current"), F.max_by("version", k).alias("target"))
    return keys.upgrade_path(s.join(ends, "vendor"), F.col("current"), F.col("target"), by=["vendor"])


@query("profile_set_ops", with_views("tel", """, a AS (SELECT DISTINCT entity_id FROM tel WHERE category = 'error'),
 b AS (SELECT DISTINCT entity_id FROM tel WHERE category = 'purchase')
SELECT coalesce(a.entity_id, b.entity_id) AS entity_id, CASE WHEN b.entity_id IS NULL THEN 'left' WHEN a.entity_id IS NULL THEN 'right'
 ELSE 'both' END AS member_of FROM a FULL OUTER JOIN b ON a.entity_id = b.entity_id"""))
def profile_set_ops(spark, sf):
    t = v.tel(spark, sf)
    of = lambda c: t.filter(F.col("category") == c).select("entity_id")
    return keys.profile_set_ops(of("error"), of("purchase"))


@query("profile_matrix", with_views("tel", """SELECT entity_id, """ + ", ".join(
    f"CAST(max(CASE WHEN category = '{c}' THEN 1 ELSE 0 END) AS INT) AS \"{c}\"" for c in ("signup", "error", "click", "view", "purchase")
) + " FROM tel GROUP BY entity_id"))
def profile_matrix(spark, sf):
    return keys.profile_matrix(v.tel(spark, sf), "entity_id", "category", ["signup", "error", "click", "view", "purchase"])


@query("top_talkers", with_views("edge", "SELECT src, CAST(sum(bytes) AS DOUBLE) AS total FROM edge GROUP BY src ORDER BY sum(bytes) DESC, src LIMIT 10"))
def top_talkers(spark, sf):
    return keys.top_talkers(v.edge(spark, sf), "bytes", 10).withColumn("total", F.col("total").cast("double"))
