"""The test tables in the vocabulary of the operators, and the same views as SQL for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wardline.functions import find_all, url_host
from wardline.operators.graph import build_edges
from wardline.operators.normalize import normalize_events
from wardline.streaming.sinks import stream_buffered

# Schemas of the tables: reading with them opens no file before the query runs.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
EVENTS_SCHEMA = SCHEMAS["events"]

# Weights, rules, playbooks, blocks and peers of the checks.
MISSION_WEIGHTS = {"AUTOMOBILE": 1.0, "MACHINERY": 0.9, "BUILDING": 0.7, "HOUSEHOLD": 0.5, "FURNITURE": 0.3}
AS_OF = "2024-01-31 00:00:00"
HALF_LIFE_S = 7 * 86400
RULES = """VALUES (1, 'error', 100.0, 0, 99, 7), (2, 'error', 200.0, 0, 99, 12), (3, 'purchase', 150.0, 50, 99, 8),
 (4, CAST(NULL AS STRING), 300.0, 0, 99, 13), (5, 'signup', 0.0, 0, 4, 3)"""
PLAYBOOKS = """VALUES (1, 'error', 60.0, CAST(NULL AS STRING), 0.90, 30.0), (2, 'error', 20.0, 'MACHINERY', 0.70, 10.0),
 (3, 'purchase', 40.0, CAST(NULL AS STRING), 0.60, 15.0), (4, CAST(NULL AS STRING), 10.0, CAST(NULL AS STRING), 0.30, 1.0)"""
BLOCKS = """VALUES ('0.0.0.0', 1), ('64.0.0.0', 2), ('108.0.0.0', 8), ('108.51.0.0', 16), ('128.0.0.0', 2), ('172.19.0.0', 16)"""

IPV4_LOOSE = "[0-9]{1,3}(?:[.][0-9]{1,3}){3}"
EMAIL = "[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z]+)+"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf}/{name}.parquet")


def canonical(events: DataFrame) -> DataFrame:
    """Raw events -> canonical events."""
    k = F.get_json_object("props", "$.k")
    return normalize_events(
        events,
        {
            "event_id": F.col("event_id"),
            "ts": F.col("ts"),
            "entity_id": F.col("user_id"),
            # As it is, so that a filter on it reaches the scan.
            "category": F.col("event_type"),
            "magnitude": F.col("value"),
            "attr": k.try_cast("int"),
            "level": F.least(F.lit(15), F.floor(F.col("value") / 20)).cast("int"),
            "src": F.col("user_id"),
            "dst": k.try_cast("long"),
        },
    ).drop("valid")


def tel(spark: SparkSession, sf: str) -> DataFrame:
    return canonical(table(spark, sf, "events"))


def event_stream(
    spark: SparkSession, path: str, pattern: str = "events.parquet", max_files: int | None = 1
) -> DataFrame:
    """Canonical events as a stream, with a TIMESTAMP event time."""
    raw = stream_buffered(spark, path, EVENTS_SCHEMA, max_files, pattern)
    return canonical(raw).withColumn("ts", F.col("ts").cast("timestamp"))


def alerts(spark: SparkSession, sf: str) -> DataFrame:
    return tel(spark, sf).filter(F.col("category") == "error")


def asset(spark: SparkSession, sf: str) -> DataFrame:
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return (
        table(spark, sf, "customer")
        .join(places, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("c_custkey").alias("asset_id"), F.col("n_name").alias("subnet"), F.col("r_name").alias("site"),
            F.col("c_mktsegment").alias("mission"), F.col("c_acctbal").alias("worth"),
        )
    )


def service(spark: SparkSession, sf: str) -> DataFrame:
    major = (F.col("p_size") % 3 + 1).cast("int")
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("service_id"), F.col("p_brand").alias("vendor"), F.col("p_type").alias("product_class"),
        major.alias("major"), F.col("p_size").cast("int").alias("minor"),
        F.concat(F.lit("v"), major.cast("string"), F.lit("."), F.col("p_size").cast("string"), F.lit(".0")).alias("version"),
    )


def vuln_feed(spark: SparkSession, sf: str) -> DataFrame:
    least = service(spark, sf).groupBy("vendor").agg(F.min("service_id").alias("vuln_id"))
    return least.select(
        "vendor", "vuln_id", F.lit("v1.10.0").alias("lo"),
        F.when(F.col("vuln_id") % 5 == 0, None).otherwise("v2.25.0").alias("hi"),
    )


def finding(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return (
        table(spark, sf, "lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("o_custkey").alias("asset_id"), F.col("l_partkey").alias("vuln_id"),
            F.col("l_suppkey").alias("scanner_id"), F.round(F.col("l_discount") * 100).cast("int").alias("cvss"),
            F.col("l_shipdate").alias("found_at"),
            F.when(F.col("l_linestatus") == "O", "open").otherwise("fixed").alias("state"),
            F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("seq"),
        )
    )


def edge(spark: SparkSession, sf: str) -> DataFrame:
    return build_edges(tel(spark, sf))


def link(spark: SparkSession, sf: str) -> DataFrame:
    return tel(spark, sf).filter(F.col("src") != F.col("dst")).select("src", "dst").distinct()


def ioc_obs(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    found = lambda kind, pattern, needs: F.transform(
        F.array_distinct(find_all(text, pattern, needs=needs)),
        lambda v: F.struct(F.lit(kind).alias("ioc_type"), v.alias("ioc")),
    )
    # Both kinds in one pass over the texts.
    both = F.concat(found("ipv4", IPV4_LOOSE, "."), found("email", EMAIL, "@"))
    texts = table(spark, sf, "documents").select("doc_id", F.explode(both).alias("i")).select("doc_id", "i.*")
    hosts = table(spark, sf, "pages").select(
        F.col("page_id").alias("doc_id"), F.lit("host").alias("ioc_type"), url_host(F.col("url")).alias("ioc")
    )
    return texts.unionByName(hosts.distinct())


def ioc_feed(spark: SparkSession, sf: str) -> DataFrame:
    seen = ioc_obs(spark, sf).select("ioc_type", "ioc").distinct().filter(F.length("ioc") % 3 == 0)
    return seen.withColumn("severity", (F.length("ioc") % 5 + 1).cast("int"))


def _values(spark: SparkSession, values: str, names: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM ({values}) AS t({names})")


def rule(spark: SparkSession) -> DataFrame:
    df = _values(spark, RULES, "rule_id, category, min_magnitude, attr_lo, attr_hi, rule_level")
    return df.withColumn("min_magnitude", F.col("min_magnitude").cast("double"))


def playbook(spark: SparkSession) -> DataFrame:
    df = _values(spark, PLAYBOOKS, "playbook_id, category, min_risk, mission, benefit, cost")
    return df.withColumns({c: F.col(c).cast("double") for c in ("min_risk", "benefit", "cost")})


def cidr_block(spark: SparkSession) -> DataFrame:
    return _values(spark, BLOCKS, "net, prefix")


# The same views for the SQL checks, each with the views that it reads.
SQL_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "tel": ((), """SELECT event_id, ts, user_id AS entity_id, event_type AS category, value AS magnitude,
 CAST(json_extract_string(props, '$.k') AS INT) AS attr, CAST(LEAST(15, FLOOR(value / 20)) AS INT) AS level,
 user_id AS src, CAST(json_extract_string(props, '$.k') AS BIGINT) AS dst FROM events"""),
    "alerts": (("tel",), "SELECT * FROM tel WHERE category = 'error'"),
    "asset": ((), """SELECT c_custkey AS asset_id, n_name AS subnet, r_name AS site, c_mktsegment AS mission,
 c_acctbal AS worth FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""),
    "service": ((), """SELECT p_partkey AS service_id, p_brand AS vendor, p_type AS product_class,
 CAST(p_size % 3 + 1 AS INT) AS major, CAST(p_size AS INT) AS minor,
 concat('v', CAST(p_size % 3 + 1 AS VARCHAR), '.', CAST(p_size AS VARCHAR), '.0') AS version FROM part"""),
    "vuln_feed": (("service",), """SELECT vendor, min(service_id) AS vuln_id, 'v1.10.0' AS lo,
 CASE WHEN min(service_id) % 5 = 0 THEN NULL ELSE 'v2.25.0' END AS hi FROM service GROUP BY vendor"""),
    "finding": ((), """SELECT o_custkey AS asset_id, l_partkey AS vuln_id, l_suppkey AS scanner_id,
 CAST(ROUND(l_discount * 100) AS INT) AS cvss, l_shipdate AS found_at,
 CASE WHEN l_linestatus = 'O' THEN 'open' ELSE 'fixed' END AS state, l_orderkey AS run_id, l_linenumber AS seq
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""),
    "latest": (("finding",), """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY asset_id, vuln_id
 ORDER BY found_at DESC, run_id DESC, seq DESC, scanner_id DESC, cvss DESC, state) AS rn FROM finding) WHERE rn = 1"""),
    "edge": (("tel",), """SELECT src, dst, count(*) AS n, CAST(sum(CAST(magnitude AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS bytes,
 min(ts) AS first_ts, max(ts) AS last_ts FROM tel WHERE src <> dst GROUP BY src, dst"""),
    "link": (("tel",), "SELECT DISTINCT src, dst FROM tel WHERE src <> dst"),
    "ioc_obs": ((), f"""SELECT DISTINCT doc_id, 'ipv4' AS ioc_type, v AS ioc
 FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{IPV4_LOOSE}')) AS v FROM documents)
 UNION ALL SELECT DISTINCT doc_id, 'email', v
 FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{EMAIL}')) AS v FROM documents)
 UNION ALL SELECT DISTINCT page_id, 'host', lower(regexp_extract(url, 'https?://([^/?#:]+)', 1)) FROM pages"""),
    "ioc_feed": (("ioc_obs",), """SELECT ioc_type, ioc, CAST(length(ioc) % 5 + 1 AS INT) AS severity
 FROM (SELECT DISTINCT ioc_type, ioc FROM ioc_obs) d WHERE length(ioc) % 3 = 0"""),
    "rule": ((), f"""SELECT rule_id, category, CAST(min_magnitude AS DOUBLE) AS min_magnitude, attr_lo, attr_hi, rule_level
 FROM ({RULES}) AS t(rule_id, category, min_magnitude, attr_lo, attr_hi, rule_level)"""),
    "playbook": ((), f"""SELECT playbook_id, category, CAST(min_risk AS DOUBLE) AS min_risk, mission,
 CAST(benefit AS DOUBLE) AS benefit, CAST(cost AS DOUBLE) AS cost
 FROM ({PLAYBOOKS}) AS t(playbook_id, category, min_risk, mission, benefit, cost)"""),
    "cidr_block": ((), f"SELECT * FROM ({BLOCKS}) AS t(net, prefix)"),
}


def with_views(names: str, body: str, recursive: bool = False, extra: str = "") -> str:
    """`body` after the named views (and what they read) as common table expressions; a body may begin with further ones."""
    order: list[str] = []

    def visit(n: str) -> None:
        for dep in SQL_VIEWS[n][0]:
            visit(dep)
        if n not in order:
            order.append(n)

    for n in names.split():
        visit(n)
    ctes = [f"{n} AS (\n{SQL_VIEWS[n][1]})" for n in order]
    if extra:
        ctes.append(extra)
    if not ctes:
        return body
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n" + body
