"""Queries over streams, and over users' own functions.

Streams read the tables as files, run to the end of what is there, and write to the shared folder.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window, functions as F

from wardline import streaming
from wardline.operators import detect, enrich, extend
from wardline.operators.ordered import exact_quantiles
from wardline.operators.sizing import checked_broadcast
from wardline.plans import views as v
from wardline.plans.registry import query
from wardline.plans.views import EVENTS_SCHEMA, event_stream, with_views
from wardline.session import shared_dir
from wardline.sources import replay_tail
from wardline.streaming import drain

HOUR, DAY = 3600, 86400


def _batch_types(df, *times):
    """Back to the types of the batch tables: TIMESTAMP_NTZ, DOUBLE."""
    cols = {t: F.col(t).cast("timestamp_ntz") for t in times}
    if "total" in df.columns:
        cols["total"] = F.col("total").cast("double")
    return df.withColumns(cols)


def _files(spark, df, n: int) -> str:
    """`df` as `n` or more files in a new folder, rows spread by hash."""
    path = shared_dir(spark, "events")
    df.repartition(n, F.xxhash64("event_id")).write.parquet(path)
    return path


def _ending_stream(spark, sf):
    """All events as a stream, and a closing row of each kind long after the last one: it moves the watermark past all results."""
    events = v.table(spark, sf, "events")
    last = events.agg(F.max("event_id").alias("e"), F.max("ts").alias("t"))
    closing = last.select(
        (F.col("e") + 1).alias("event_id"), (F.col("t") + F.expr("interval 60 days")).alias("ts"),
        F.lit(-1).cast("long").alias("user_id"), F.explode(F.array(F.lit("signup"), F.lit("error"))).alias("event_type"),
        F.lit(0.0).alias("value"), F.lit("{}").alias("props"),
    )
    path = shared_dir(spark, "closing")
    closing.coalesce(1).write.parquet(path)
    return event_stream(spark, sf).unionByName(event_stream(spark, path, "*.parquet"))


@query("stream_tumbling", with_views("tel", """SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, CAST(date_trunc('day', ts) + INTERVAL 1 DAY AS TIMESTAMP) AS "end", category,
 count(*) AS n, CAST(sum(CAST(magnitude AS DECIMAL(18,2))) AS DOUBLE) AS total FROM tel GROUP BY ALL"""))
def stream_tumbling(spark, sf):
    out = streaming.stream_tumbling(_ending_stream(spark, sf), "1 day", "1 hour")
    return _batch_types(drain(out, "tumbling"), "start", "end")


@query("stream_sliding", with_views("tel", """SELECT CAST(date_trunc('day', ts) - CAST(i AS INT) * INTERVAL 1 DAY AS TIMESTAMP) AS start, CAST(date_trunc('day', ts) + (2 - CAST(i AS INT)) * INTERVAL 1 DAY AS TIMESTAMP) AS "end",
 category, count(*) AS n, CAST(sum(CAST(magnitude AS DECIMAL(18,2))) AS DOUBLE) AS total FROM tel, range(2) t(i) GROUP BY ALL"""))
def stream_sliding(spark, sf):
    out = streaming.stream_sliding(_ending_stream(spark, sf), "2 days", "1 day", "1 hour")
    return _batch_types(drain(out, "sliding"), "start", "end")


@query("stream_top_talkers", with_views("tel", """, c AS (SELECT date_trunc('day', ts) AS d, src, count(*) AS n FROM tel GROUP BY ALL)
SELECT CAST(d AS TIMESTAMP) AS start, CAST(sum(n) AS BIGINT) AS n_events, CAST(least(10, count(*)) AS BIGINT) AS n_listed, TRUE AS is_near FROM c GROUP BY d"""))
def stream_top_talkers(spark, sf):
    # The leaders of each day by sketch; how many they are, and whether all lie within the stated error of the exact counts.
    listed = drain(streaming.stream_top_talkers(_ending_stream(spark, sf), "1 day", "1 hour", 10), "talkers")
    exact = v.tel(spark, sf).groupBy(F.date_trunc("day", "ts").alias("start"), "src").agg(F.count("*").alias("n"))
    total = exact.groupBy("start").agg(F.sum("n").alias("n_events"))
    # The least count that a leader may have: that of the tenth.
    tenth = top_k(exact, ["start"], 10).groupBy("start").agg(F.min("n").alias("tenth"))
    both = listed.select("start", "src", "about", "error").join(exact.withColumn("start", F.col("start").cast("timestamp")), ["start", "src"], "left")
    figures = total.join(tenth, "start").withColumn("start", F.col("start").cast("timestamp"))
    near = (F.abs(F.col("about") - F.coalesce("n", F.lit(0))) <= F.col("error")) & (F.coalesce("n", F.lit(0)) >= F.col("tenth") - F.col("error"))
    out = both.join(figures, "start").groupBy("start", "n_events").agg(F.count("*").alias("n_listed"), F.every(near).alias("is_near"))
    return _batch_types(out, "start")


def top_k(counts, by, k):
    """The k largest counts of each group; ties by source."""
    w = Window.partitionBy(*by).orderBy(F.desc("n"), "src")
    return counts.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= k).drop("_k")


@query("stream_score", with_views("tel asset", """, j AS (SELECT event_id, magnitude, level, attr FROM tel JOIN asset ON entity_id = asset_id),
 m AS (SELECT avg(magnitude) AS m1, stddev_samp(magnitude) AS s1, avg(level) AS m2, stddev_samp(level) AS s2, avg(attr) AS m3, stddev_samp(attr) AS s3 FROM j)
SELECT event_id, round(greatest(abs((magnitude - m1) / s1), abs((level - m2) / s2), abs((attr - m3) / s3)), 6) AS score FROM tel, m"""))
def stream_score(spark, sf):
    # The model of the sites' own figures, applied to all events as they arrive.
    features = ["magnitude", "level", "attr"]
    t = v.tel(spark, sf).select("entity_id", *features)
    model = detect.federated_model(enrich.asset_context(t, v.asset(spark, sf).select("asset_id", "site")), "site", features)
    scored = detect.score_by(event_stream(spark, sf).select("event_id", *features), model)
    return drain(scored.select("event_id", F.round("score", 6).alias("score")), "score")


@query("stream_sessions", with_views("alerts", """, g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 21600000000 THEN 0 ELSE 1 END AS s FROM alerts WINDOW w AS (PARTITION BY entity_id ORDER BY ts, event_id)),
 i AS (SELECT *, sum(s) OVER (PARTITION BY entity_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT entity_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n, max(level) AS max_level FROM i GROUP BY entity_id, k"""))
def stream_sessions(spark, sf):
    alerts = _ending_stream(spark, sf).filter("category = 'error'")
    out = streaming.stream_sessions(alerts, "entity_id", "6 hours", "1 hour")
    return _batch_types(drain(out, "sessions"), "start", "end")


@query("stream_dedup", "SELECT event_id, event_type FROM events")
def stream_dedup(spark, sf):
    path = _files(spark, replay_tail(v.table(spark, sf, "events"), "event_id", 50), 4)
    raw = streaming.stream_buffered(spark, path, EVENTS_SCHEMA, 1).withColumn("ts", F.col("ts").cast("timestamp"))
    out = streaming.stream_dedup(raw, ["event_id"], "40 days")
    return drain(out.select("event_id", "event_type"), "dedup")


@query("stream_enrich", with_views("tel", """SELECT event_id, attr, CASE WHEN attr < 30 THEN attr % 5 + 1 ELSE 0 END AS severity, attr < 30 AS is_hit FROM tel"""))
def stream_enrich(spark, sf):
    feed = v.tel(spark, sf).filter("attr < 30").select("attr", (F.col("attr") % 5 + 1).alias("severity")).distinct()
    out = streaming.stream_enrich(event_stream(spark, sf).select("event_id", "attr"), feed, ["attr"])
    return drain(out.select("event_id", "attr", F.coalesce("severity", F.lit(0)).alias("severity"), "is_hit"), "enrich")


@query("stream_match_rules", with_views("tel rule", """SELECT event_id, rule_id, rule_level FROM tel JOIN rule ON (rule.category IS NULL OR tel.category = rule.category)
 AND magnitude >= min_magnitude AND attr BETWEEN attr_lo AND attr_hi"""))
def stream_match_rules(spark, sf):
    events = event_stream(spark, sf).select("event_id", "category", "magnitude", "attr")
    return drain(streaming.stream_match_rules(events, v.rule(spark)).select("event_id", "rule_id", "rule_level"), "rules")


@query("stream_unmatched_iocs", with_views("tel", "SELECT DISTINCT attr FROM tel WHERE attr >= 30"))
def stream_unmatched_iocs(spark, sf):
    feed = v.tel(spark, sf).filter("attr < 30").select("attr")
    return drain(streaming.stream_unmatched_iocs(event_stream(spark, sf), feed, ["attr"], "40 days").select("attr"), "unmatched")


@query("stream_correlate", with_views("tel", """SELECT b.entity_id, b.event_id AS effect_id, arg_max(a.event_id, (a.ts, a.event_id)) AS cause_id, count(*) AS n_causes
 FROM tel a JOIN tel b ON a.entity_id = b.entity_id AND b.ts > a.ts AND epoch_us(b.ts) - epoch_us(a.ts) <= 43200000000
 WHERE a.category = 'signup' AND b.category = 'error' GROUP BY b.entity_id, b.event_id"""))
def stream_correlate(spark, sf):
    events = _ending_stream(spark, sf)
    of = lambda kind: events.filter(F.col("category") == kind)
    out = streaming.stream_correlate(of("signup"), of("error"), "entity_id", 12 * HOUR, "1 hour")
    return drain(out, "correlate").select("entity_id", "effect_id", "cause_id", "n_causes")


@query("stream_throttle", with_views("alerts", """, r(entity_id, event_id, ts) AS (
 SELECT entity_id, arg_min(event_id, (ts, event_id)), min(ts) FROM alerts GROUP BY entity_id
 UNION ALL SELECT r.entity_id, n.event_id, n.ts FROM r, LATERAL (SELECT arg_min(a.event_id, (a.ts, a.event_id)) AS event_id, min(a.ts) AS ts FROM alerts a
 WHERE a.entity_id = r.entity_id AND epoch_us(a.ts) - epoch_us(r.ts) > 43200000000) n WHERE n.event_id IS NOT NULL)
SELECT entity_id, event_id FROM r""", recursive=True))
def stream_throttle(spark, sf):
    alerts = _ending_stream(spark, sf).filter("category = 'error'")
    out = streaming.stream_throttle(alerts, "entity_id", 12 * HOUR, "1 hour")
    return drain(out.select("entity_id", "event_id"), "throttle")


@query("stream_frequency", with_views("alerts", """, f AS (SELECT *, lag(ts, 2) OVER (PARTITION BY entity_id ORDER BY ts, event_id) AS burst_start FROM alerts)
SELECT entity_id, event_id, burst_start FROM f WHERE epoch_us(ts) - epoch_us(burst_start) <= 86400000000"""))
def stream_frequency(spark, sf):
    alerts = _ending_stream(spark, sf).filter("category = 'error'")
    out = streaming.stream_frequency(alerts, "entity_id", 3, DAY, "1 hour")
    return _batch_types(drain(out.select("entity_id", "event_id", "burst_start"), "frequency"), "burst_start")


@query("stream_late_split", with_views("tel", """SELECT event_id, category = 'purchase' AND epoch_us(ts) < (SELECT max(epoch_us(ts)) FROM tel WHERE category <> 'purchase') - 86400000000 AS late FROM tel"""))
def stream_late_split(spark, sf):
    # Purchases arrive later than their neighbours; each arrival is one batch of as many files as there are.
    events = v.table(spark, sf, "events")
    path, out, ckpt = (shared_dir(spark, n) for n in ("events", "late", "late-ckpt"))
    for arrival in ("event_type <> 'purchase'", "event_type = 'purchase'"):
        events.filter(arrival).write.mode("append").parquet(path)
        streaming.split_late(event_stream(spark, path, "*.parquet", None), out, ckpt, DAY).awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("event_id", F.col("late").cast("boolean").alias("late"))


@query("stream_upsert", with_views("tel", """SELECT entity_id, max(event_id) AS event_id, arg_max(category, (ts, event_id)) AS category FROM tel GROUP BY entity_id"""))
def stream_upsert(spark, sf):
    path = _files(spark, v.table(spark, sf, "events"), 4)
    out, ckpt = shared_dir(spark, "upsert"), shared_dir(spark, "upsert-ckpt")
    latest = event_stream(spark, path, "*.parquet").select("entity_id", "event_id", "ts", "category")
    order = ["ts", "event_id"]
    streaming.stream_upsert(latest, out, ckpt, "entity_id", order).awaitTermination()
    return streaming.current_table(spark, out).select("entity_id", "event_id", "category")


@query("stream_buffered", "SELECT event_id, event_type, value FROM events")
def stream_buffered(spark, sf):
    path = _files(spark, v.table(spark, sf, "events"), 8)
    return drain(streaming.stream_buffered(spark, path, EVENTS_SCHEMA, 2).select("event_id", "event_type", "value"), "buffered")


# -- users' own functions ----------------------------------------------------------

def change_point(series: pd.DataFrame) -> pd.DataFrame:
    """The day that best splits a series in two levels, and the step between them."""
    n = series["n"].to_numpy(dtype=float)
    if len(n) < 2:
        return pd.DataFrame({"entity_id": [], "bucket": [], "shift": []})
    i = np.arange(1, len(n))
    left = np.cumsum(n)[:-1]
    shift = np.round((n.sum() - left) / (len(n) - i) - left / i, 9)
    best = int(np.argmax(np.abs(shift)))
    return pd.DataFrame(
        {"entity_id": [series["entity_id"].iloc[0]], "bucket": [series["bucket"].iloc[best + 1]], "shift": [shift[best]]}
    )


@query("custom_detector", with_views("tel", """, d AS (SELECT entity_id, date_trunc('day', ts) AS bucket, count(*) AS n FROM tel GROUP BY ALL),
 s AS (SELECT entity_id, bucket, round(avg(n) OVER (PARTITION BY entity_id ORDER BY bucket ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
 - avg(n) OVER (PARTITION BY entity_id ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 9) AS shift FROM d)
SELECT entity_id, CAST(bucket AS TIMESTAMP) AS bucket, round(shift, 6) AS shift FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY abs(shift) DESC, bucket) AS rn FROM s WHERE shift IS NOT NULL) WHERE rn = 1"""))
def custom_detector(spark, sf):
    t = v.tel(spark, sf).select("entity_id", "ts")
    schema = "entity_id long, bucket timestamp_ntz, shift double"
    return extend.apply_detector(t, "entity_id", change_point, schema).withColumn("shift", F.round("shift", 6))


def logistic(level: pd.Series, magnitude: pd.Series) -> pd.Series:
    return 1 / (1 + np.exp(3 - 0.3 * level - 0.01 * magnitude))


@query("custom_scorer", with_views("tel", "SELECT event_id, round(1 / (1 + exp(3 - 0.3::DOUBLE * level - 0.01::DOUBLE * magnitude)), 6) AS score FROM tel"))
def custom_scorer(spark, sf):
    scored = extend.apply_scorer(v.tel(spark, sf).select("event_id", "level", "magnitude"), logistic, ["level", "magnitude"])
    return scored.select("event_id", F.round("score", 6).alias("score"))


class PathTokens:
    """The parts of a URL's path with their places."""

    def eval(self, url: str):
        path = url.split("://", 1)[-1].split("?", 1)[0].split("#", 1)[0]
        for i, token in enumerate(t for t in path.split("/")[1:] if t):
            yield i, token


@query("custom_parser", """WITH p AS (SELECT page_id, list_filter(string_split(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/'), lambda t: t <> '') AS t FROM pages)
SELECT page_id, CAST(generate_subscripts(t, 1) - 1 AS INT) AS place, unnest(t) AS token FROM p""")
def custom_parser(spark, sf):
    return extend.apply_parser(v.table(spark, sf, "pages"), PathTokens, "place: int, token: string", "url", ["page_id"])


def sum_count(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.groupby("category", as_index=False).agg(s=("magnitude", "sum"), n=("magnitude", "size"))


def add_states(states: pd.DataFrame) -> pd.DataFrame:
    return states.groupby("category", as_index=False).agg(s=("s", "sum"), n=("n", "sum"))


@query("custom_aggregate", with_views("tel", """, q AS (SELECT category, quantile_cont(magnitude, 0.1) AS lo, quantile_cont(magnitude, 0.9) AS hi FROM tel GROUP BY category)
SELECT tel.category, round(avg(magnitude), 6) AS trimmed_mean FROM tel JOIN q ON tel.category = q.category WHERE magnitude BETWEEN lo AND hi GROUP BY tel.category"""))
def custom_aggregate(spark, sf):
    t = v.tel(spark, sf).select("category", "magnitude")
    ends = checked_broadcast(exact_quantiles(t, ["category"], "magnitude", {"lo": 0.1, "hi": 0.9}))
    kept = t.join(ends, "category").filter(F.col("magnitude").between(F.col("lo"), F.col("hi")))
    mean = extend.apply_aggregate(
        kept, "category", sum_count, add_states, "s double, n long", F.col("s") / F.col("n"), ["magnitude"], "trimmed_mean"
    )
    return mean.withColumn("trimmed_mean", F.round("trimmed_mean", 6))
