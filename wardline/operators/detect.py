"""Detection and correlation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from wardline.operators.ordered import (
    KeySplit, Running, exact_quantiles, micros, nth_before, previous, profile_keys, running, value_ranks,
)
from wardline.operators.same import join_same
from wardline.operators.sizing import checked_broadcast, measured
from wardline.session import checkpointed

_US = 1_000_000
#: So many rules are held as lists next to each event; more are joined.
MAX_RULES = 2_000


def own_key(category: Column) -> Column:
    """The key of a category; no wildcard has it, whatever the category's text."""
    return F.struct(F.lit(False).alias("any"), category.cast("string").alias("category"))


def category_key(category: Column) -> Column:
    """The key of a category, or of the wildcard where it is null."""
    return F.struct(category.isNull().alias("any"), F.coalesce(category.cast("string"), F.lit("")).alias("category"))


def _fits(rule: Callable[[str], Column]) -> Column:
    """Whether a rule's limits take the event; a limit that is null takes all."""
    return (
        (rule("min_magnitude").isNull() | (F.col("magnitude") >= rule("min_magnitude")))
        & (rule("attr_lo").isNull() | (F.col("attr") >= rule("attr_lo")))
        & (rule("attr_hi").isNull() | (F.col("attr") <= rule("attr_hi")))
    )


def rule_hits(events: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per (event, matching rule), for a table or a stream of events.

    A rule without a category stands under a wildcard key, and each event looks under its
    category and under the wildcard: an equality join, whatever the number of rules.
    """
    keyed = rules.withColumn("_key", category_key(F.col("category"))).drop("category")
    looked = events.withColumn("_key", F.explode(F.array(own_key(F.col("category")), category_key(F.lit(None)))))
    hits = looked.join(checked_broadcast(keyed), "_key").filter(_fits(F.col))
    return hits.select(*events.columns, "rule_id", "rule_level")


def category_lists(rules: DataFrame, one: Column) -> tuple[DataFrame, Column]:
    """Measured few rules as lists `_rules`: a broadcast frame by `_key` for the categories, and the list of those without one."""
    # Few rules fit one partition, where grouping them takes no exchange.
    lists = rules.coalesce(1).groupBy(category_key(F.col("category")).alias("_key")).agg(F.collect_list(one).alias("_rules"))
    none = F.array().cast(lists.schema["_rules"].dataType)
    # The rules without a category are one row, for all events.
    wild = lists.filter("_key.any").select("_rules").scalar()
    return F.broadcast(lists.filter("not _key.any")), F.concat(F.coalesce(F.col("_rules"), none), F.coalesce(wild, none))


def match_rules(events: DataFrame, rules: DataFrame, max_rules: int = MAX_RULES) -> DataFrame:
    """One row per (event, matching rule); `is_best` marks the event's rule of highest level, of those the least id.

    Rules that prove to be few are held as one list per category: an event meets all its rules in one
    row, and nothing is shuffled.  Otherwise rules are joined and the best one is found by event.  Every
    row of `events` is an event of its own, whatever its id.
    """
    rules, few = measured(rules, max_rules)
    if not few:
        rows = checkpointed(events.withColumn("_row", F.monotonically_increasing_id()))
        # A window partition holds the rules of one event.
        w = Window.partitionBy("_row").orderBy(F.desc("rule_level"), "rule_id")
        return rule_hits(rows, rules).withColumn("is_best", F.row_number().over(w) == 1).drop("_row")
    best_first = [F.col("rule_level").isNull().alias("_last"), (-F.col("rule_level").cast("double")).alias("_down")]
    own, every = category_lists(rules, F.struct(*best_first, "rule_id", "rule_level", "min_magnitude", "attr_lo", "attr_hi"))
    looked = events.withColumn("_key", own_key(F.col("category"))).join(own, "_key", "left")
    hits = F.sort_array(F.filter("_every", lambda r: _fits(lambda c: r[c])))
    return looked.withColumn("_every", every).select(*events.columns, F.posexplode(hits).alias("_place", "_rule")).select(
        *events.columns, "_rule.rule_id", "_rule.rule_level", (F.col("_place") == 0).alias("is_best")
    )


def frequency_rule(
    events: DataFrame, key: str, n: int, seconds: int, t: str = "ts", id_col: str = "event_id"
) -> DataFrame:
    """Events that are at least the n-th of their key in the trailing window; `burst_start` is the n-th last one."""
    marked = nth_before(events, [key], [t, id_col], micros(t), n - 1, "burst_start", F.col(t))
    return marked.filter(micros(t) - micros("burst_start") <= seconds * _US)


def dedup_alerts(
    alerts: DataFrame, keys: Sequence[str], quiet_s: int, t: str = "ts", id_col: str = "event_id",
    split: KeySplit | None = None,
) -> DataFrame:
    """Drop an alert that comes within the quiet time of the previous raw alert of the same keys."""
    seen = previous(alerts, list(keys), [t, id_col], micros(t), split, _prev=micros(t))
    return seen.filter(F.col("_prev").isNull() | (micros(t) - F.col("_prev") > quiet_s * _US)).drop("_prev")


def session_starts(
    df: DataFrame, keys: Sequence[str], gap_s: int, t: str = "ts", id_col: str = "event_id", out: str = "session_start",
    split: KeySplit | None = None,
) -> DataFrame:
    """Add the start time of the run that each row belongs to; gaps inside a run are at most `gap_s`."""
    keys, order, at = list(keys), [t, id_col], micros(t)
    split = split or profile_keys(df, keys, at)
    gapped = running(df, keys, order, at, [Running("_prev", "previous", at)], split=split)
    starts = F.when(F.col("_prev").isNull() | (at - F.col("_prev") > gap_s * _US), F.col(t))
    return running(gapped, keys, order, at, [Running(out, "last", starts, strict=False)], split=split).drop("_prev")


def sessionize_alerts(
    alerts: DataFrame, key: str, gap_s: int, t: str = "ts", id_col: str = "event_id", level: str = "level"
) -> DataFrame:
    """Incidents: maximal runs of one key's alerts with gaps of at most `gap_s`."""
    return (
        session_starts(alerts, [key], gap_s, t, id_col)
        .groupBy(key, "session_start")
        .agg(
            F.min(id_col).alias("incident_id"),
            F.max(t).alias("session_end"),
            F.count("*").alias("n"),
            F.max(level).alias("max_level"),
        )
    )


def prune_alerts(
    alerts: DataFrame, per: Sequence[str], k: int, min_level: int, level: str = "level", id_col: str = "event_id"
) -> DataFrame:
    """The k highest-level alerts of each group, none under `min_level`, with the number pruned from the group."""
    per = list(per)
    w = Window.partitionBy(*per).orderBy(F.desc(level), id_col)
    # row_number() <= k: Spark limits each group before the shuffle already.
    kept = alerts.filter(F.col(level) >= min_level).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)
    sizes = alerts.groupBy(*per).agg(
        F.count("*").alias("_n"), F.count_if(F.col(level) >= min_level).alias("_ok")
    )
    pruned = F.col("_n") - F.least(F.col("_ok"), F.lit(k))
    return join_same(kept, sizes, per).select(*alerts.columns, pruned.alias("n_pruned"))


def _reach(incidents: DataFrame, edge: DataFrame, hops: int, entity: str) -> DataFrame:
    """(_e, node): each entity with incidents, and the nodes upstream of it within `hops`."""
    links = edge.select(F.col("dst").alias("_at"), F.col("src").alias("_up")).distinct()
    reach = incidents.select(entity).distinct().select(F.col(entity).alias("_e"), F.col(entity).alias("node"))
    for _ in range(hops):
        step = reach.join(links, F.col("node") == F.col("_at")).select("_e", F.col("_up").alias("node"))
        reach = reach.unionByName(step).distinct()
    return checkpointed(reach)


def cause_lines(incidents: DataFrame, alerts: DataFrame, reach: DataFrame, lookback_s: int, entity: str = "entity_id") -> DataFrame:
    """Questions (_side 0) and alerts (_side 1) by `_place`, in whose order of time every question finds its answer.

    An entity's incidents may ask each upstream node, which makes incidents x nodes questions, or have the alerts of
    those nodes brought to the entity, which makes one question per incident.  Each entity does what makes fewer
    rows: at a hub with many incidents the alerts move, elsewhere the questions do.
    """
    asks = incidents.groupBy(F.col(entity).alias("_e")).agg(F.count("*").alias("_asks"))
    held = alerts.groupBy(F.col(entity).alias("node")).agg(F.count("*").alias("_held"))
    costs = reach.join(held, "node", "left").groupBy("_e").agg(F.count("*").alias("_nodes"), F.coalesce(F.sum("_held"), F.lit(0)).alias("_brought"))
    brings = costs.join(asks, "_e").select("_e", (F.col("_brought") + F.col("_asks") < F.col("_asks") * F.col("_nodes")).alias("_bring"))
    reach = reach.join(brings, "_e")
    start = micros("session_start")
    place = lambda kind, name: F.struct(F.lit(kind).alias("brought"), F.col(name).alias("node")).alias("_place")
    question = ["incident_id", start.alias("_hi"), (start - lookback_s * _US).alias("_t"), F.lit(0).alias("_side"), F.col("incident_id").alias("_id")]
    alert = [
        micros("ts").alias("_t"), F.lit(1).alias("_side"), F.col("event_id").alias("_id"),
        F.struct("ts", "event_id", F.col(entity).alias("node")).alias("_alert"),
    ]
    by_entity = F.col(entity) == F.col("_e")
    asked = incidents.join(reach.filter("not _bring"), by_entity).select(place(False, "node"), *question)
    bring = incidents.join(brings.filter("_bring"), by_entity).select(place(True, "_e"), *question)
    own = alerts.select(place(False, entity), *alert)
    brought = alerts.join(reach.filter("_bring"), F.col(entity) == F.col("node")).select(place(True, "_e"), *alert)
    return asked.unionByName(bring).unionByName(own.unionByName(brought), allowMissingColumns=True)


def root_cause(
    incidents: DataFrame, alerts: DataFrame, edge: DataFrame, lookback_s: int, hops: int = 1, entity: str = "entity_id"
) -> DataFrame:
    """For each incident the earliest alert, inside the look-back, of its entity or of one upstream within `hops`.

    A question is for the first alert at or after the start of the look-back; alerts and questions run through one
    ordered pass per place (see `cause_lines`).
    """
    incidents = checkpointed(incidents)
    lines = cause_lines(incidents, alerts, _reach(incidents, edge, hops, entity), lookback_s, entity)
    first = Running("_first", "last", F.col("_alert"))
    run = running(lines, ["_place"], ["_t", "_side", "_id"], F.col("_t"), [first], descending=True)
    run = run.filter((F.col("_side") == 0) & (micros(F.col("_first.ts")) <= F.col("_hi")))
    causes = run.groupBy("incident_id").agg(F.min("_first").alias("c"))
    return incidents.join(causes, "incident_id").select(
        *incidents.columns,
        F.col("c.event_id").alias("cause_id"),
        F.col("c.node").alias("cause_entity"),
        F.col("c.ts").alias("cause_ts"),
    )


def zscore_anomalies(df: DataFrame, group: str, col: str, t: float = 3.0) -> DataFrame:
    """Rows more than `t` standard deviations from their group's mean."""
    stats = df.groupBy(group).agg(F.avg(col).alias("mean"), F.stddev_samp(col).alias("sd"))
    scored = join_same(df, checked_broadcast(stats), [group]).withColumn(
        "z", F.when(F.col("sd") > 0, (F.col(col) - F.col("mean")) / F.col("sd"))
    )
    return scored.filter(F.abs("z") > t).drop("mean", "sd")


def mad_anomalies(df: DataFrame, group: str, col: str, t: float = 5.0) -> DataFrame:
    """Rows far from their group's median in units of the median absolute deviation; groups with MAD 0 give none."""
    half = {"median": 0.5}
    medians = checked_broadcast(exact_quantiles(df, [group], col, half))
    dev = join_same(df, medians, [group]).withColumn("_dev", F.abs(F.col(col) - F.col("median")))
    mads = checked_broadcast(exact_quantiles(dev.select(group, "_dev"), [group], "_dev", {"mad": 0.5}))
    scored = join_same(dev, mads, [group]).withColumn(
        "score", F.when(F.col("mad") > 0, F.lit(0.6745) * F.col("_dev") / F.col("mad"))
    )
    return scored.filter(F.col("score") > t).drop("_dev")


def seasonal_baseline(df: DataFrame, t: str = "ts") -> DataFrame:
    """Each hour's count against mean and deviation of the same hour of the *other* days."""
    hours = df.groupBy(F.date_trunc("hour", t).alias("hour_start")).agg(F.count("*").alias("n"))
    hours = hours.withColumn("hour", F.hour("hour_start"))
    totals = hours.groupBy("hour").agg(
        F.count("*").alias("_d"), F.sum("n").alias("_s"), F.sum(F.col("n") * F.col("n")).alias("_ss")
    )
    others = F.col("_d") - 1
    mean = (F.col("_s") - F.col("n")) / others
    squares = (F.col("_ss") - F.col("n") * F.col("n")).cast("double")
    var = (squares - others * F.col("mean") * F.col("mean")) / (others - 1)
    return (
        hours.join(totals, "hour")
        .filter(F.col("_d") > 2)
        .withColumn("mean", mean)
        .withColumn("sd", F.sqrt(F.greatest(var, F.lit(0.0))))
        .withColumn("z", F.when(F.col("sd") > 0, (F.col("n") - F.col("mean")) / F.col("sd")))
        .select(F.col("hour_start").cast("timestamp_ntz").alias("hour_start"), "hour", "n", "mean", "sd", "z")
    )


def entity_views(events: DataFrame) -> DataFrame:
    """The views of an entity: volume, mean magnitude, fan-out, share of errors."""
    return events.groupBy("entity_id").agg(
        F.count("*").cast("double").alias("volume"),
        # Decimal sums: the same bits whatever the order of the rows.
        (F.sum(F.col("magnitude").cast("decimal(18,2)")).cast("double") / F.count("*")).alias("magnitude"),
        F.count_distinct("dst").cast("double").alias("fan_out"),
        (F.count_if(F.col("category") == "error") / F.count("*")).alias("error_share"),
    )


def multiview_score(views: DataFrame, weights: dict[str, float], cut: float, key: str = "entity_id") -> DataFrame:
    """Weighted mean of an entity's percent ranks in several views, and whether it passes the cut."""
    views = checkpointed(views)
    long = views.unpivot([key], list(weights), "view", "value")
    ranks = value_ranks(long, ["view"], "value").select(
        "view", "value", F.when(F.col("n") > 1, F.col("below") / (F.col("n") - 1)).otherwise(0.0).alias("pr")
    )
    weight = F.lit(0.0)
    for view, w in weights.items():
        weight = F.when(F.col("view") == view, F.lit(float(w))).otherwise(weight)
    score = F.sum(F.col("pr") * weight) / sum(weights.values())
    scores = long.join(ranks, ["view", "value"]).groupBy(key).agg(score.alias("score"))
    return views.join(scores, key).withColumn("flagged", F.col("score") > cut)


def embedding_outliers(df: DataFrame, vec: str, label: str, n: int, dim: int, id_col: str = "vec_id") -> DataFrame:
    """The `n` vectors of each label that lie farthest from the label's centroid."""
    means = F.array(*[F.avg(F.col(vec)[i].cast("double")) for i in range(dim)])
    centroids = df.groupBy(label).agg(means.alias("_c"))
    squares = F.zip_with(vec, "_c", lambda x, c: (x - c) * (x - c))
    far = F.round(F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)), 6)
    w = Window.partitionBy(label).orderBy(F.desc("distance"), id_col)
    return (
        join_same(df, checked_broadcast(centroids), [label])
        .select(id_col, label, far.alias("distance"))
        .withColumn("place", F.row_number().over(w))
        .filter(F.col("place") <= n)
    )


def kmeans_anomalies(df: DataFrame, features: Sequence[str], k: int, seed: int, q: float) -> DataFrame:
    """Cluster the rows; flag those whose distance to their centre lies past the q quantile."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    raw = VectorAssembler(inputCols=list(features), outputCol="_raw").transform(checkpointed(df))
    scaled = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True).fit(raw).transform(raw)
    model = KMeans(k=k, seed=seed, featuresCol="_x", predictionCol="cluster").fit(scaled)
    # k centres of a few features each: as large as the parameter k, not as the data.
    centres = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in model.clusterCenters()])
    placed = model.transform(scaled).withColumn("_c", F.element_at(centres, F.col("cluster") + 1))
    gaps = F.zip_with(vector_to_array("_x"), "_c", lambda x, c: (x - c) * (x - c))
    placed = placed.withColumn("distance", F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x)))
    cut = placed.approxQuantile("distance", [q], 0.0001)[0]
    return placed.select(*df.columns, "cluster", "distance", (F.col("distance") > cut).alias("flagged"))


def _local(df: DataFrame, site: str, cols: Sequence[str]) -> DataFrame:
    """What leaves a site: number, mean and variance of each column."""
    figures = [f(c).alias(f"{n}_{c}") for c in cols for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))]
    return checkpointed(df.groupBy(site).agg(*figures))


def _merged(local: DataFrame, col: str) -> tuple[Column, Column]:
    """n-weighted mean and pooled deviation of a column."""
    n, m, var = (F.col(f"{x}_{col}") for x in ("n", "mean", "var"))
    total = local.agg(F.sum(n)).scalar()
    mean = local.agg(F.sum(n * m) / F.sum(n)).scalar()
    inside = (n - 1) * F.coalesce(var, F.lit(0.0))
    spread = local.select((inside + n * (m - mean) * (m - mean)).alias("s")).agg(F.sum("s")).scalar()
    return mean, F.when(total > 1, F.sqrt(spread / (total - 1)))


def federated_average(df: DataFrame, site: str, col: str) -> DataFrame:
    """Each site's own statistics next to the model merged from them (n-weighted mean, pooled deviation).

    Only (n, mean, variance) leave a site; the merged model equals the fit over all rows.
    """
    local = _local(df, site, [col])
    mean, sd = _merged(local, col)
    own = [F.col(f"{x}_{col}").alias(x) for x in ("n", "mean", "var")]
    return local.select(site, *own, mean.alias("global_mean"), sd.alias("global_sd"))


def federated_model(df: DataFrame, site: str, features: Sequence[str]) -> DataFrame:
    """The model merged from the sites' own statistics, one row per feature: what can be kept and handed on."""
    local = _local(df, site, features)
    row = df.sparkSession.range(1)
    figures = [F.struct(F.lit(f).alias("feature"), *[c.alias(n) for n, c in zip(("mean", "sd"), _merged(local, f))]) for f in features]
    return row.select(F.inline(F.array(*figures)))


def score_by(df: DataFrame, model: DataFrame) -> DataFrame:
    """z of each feature by a given model (feature, mean, sd), and `score`, the largest deviation.

    `df` may be a stream.  The model has one row per column, so it is read here and becomes part of the plan.
    A feature that is null, or without a deviation in the model, has no z; `score` goes by the others.
    """
    z = {}
    for feature, mean, sd in model.select("feature", "mean", "sd").toLocalIterator():
        known = mean is not None and sd is not None and sd > 0
        z[f"z_{feature}"] = (F.col(feature) - F.lit(mean)) / F.lit(sd) if known else F.lit(None).cast("double")
    far = [F.abs(c) for c in z]
    return df.withColumns(z).withColumn("score", F.greatest(*far) if len(far) > 1 else far[0])


def federated_score(df: DataFrame, site: str, features: Sequence[str]) -> DataFrame:
    """z of each feature by the model merged from the sites' own statistics, and `score`, the largest deviation.

    A feature that is null, or the same in all rows, has no z; `score` goes by the others.
    """
    local = _local(df, site, features)
    z = {}
    for f in features:
        mean, sd = _merged(local, f)
        z[f"z_{f}"] = F.when(sd > 0, (F.col(f) - mean) / sd)
    scored = df.withColumns(z)
    far = [F.abs(c) for c in z]
    return scored.withColumn("score", F.greatest(*far) if len(far) > 1 else far[0])


def first_seen(df: DataFrame, key: str, value: str, t: str, cut, id_col: str = "event_id") -> DataFrame:
    """First time of each (entity, value); `is_new` where that is at or after the training cut."""
    first = df.groupBy(key, value).agg(F.min(F.struct(t, id_col)).alias("f"))
    return first.select(
        key, value, F.col(f"f.{t}").alias("first_ts"), F.col(f"f.{id_col}").alias("first_id"),
        (F.col(f"f.{t}") >= F.lit(cut)).alias("is_new"),
    )


def rare_values(df: DataFrame, col: str, entity: str, max_entities: int) -> DataFrame:
    """Values seen on few entities, with counts and share of all rows."""
    total = df.agg(F.count("*")).scalar()
    return (
        df.groupBy(col)
        .agg(F.count_distinct(entity).alias("n_entities"), F.count("*").alias("n"))
        .filter(F.col("n_entities") <= max_entities)
        .withColumn("share", F.col("n") / total)
    )


def beaconing(
    df: DataFrame, min_n: int, src: str = "src", dst: str = "dst", t: str = "ts", id_col: str = "event_id"
) -> DataFrame:
    """Per (src, dst) the coefficient of variation of the gaps between contacts; a low one is regular contact."""
    seen = previous(df.select(src, dst, t, id_col), [src, dst], [t, id_col], micros(t), _prev=micros(t))
    gap = (micros(t) - F.col("_prev")) / F.lit(1e6)
    return (
        seen.groupBy(src, dst)
        .agg(F.count("*").alias("n"), F.avg(gap).alias("mean_gap"), F.stddev_samp(gap).alias("_sd"))
        .filter((F.col("n") >= min_n) & (F.col("mean_gap") > 0))
        .select(src, dst, "n", "mean_gap", (F.col("_sd") / F.col("mean_gap")).alias("cv"))
    )


def flow_aggregate(
    df: DataFrame, keys: Sequence[str], width: str, t: str = "ts", value: str = "magnitude", peer: str = "dst"
) -> DataFrame:
    """Flows per key and time bucket: count, sum, max, distinct peers, share of the bucket's sum."""
    amount = F.col(value).cast("decimal(18,2)")
    flows = df.groupBy(F.window(t, width).alias("_w"), *keys).agg(
        F.count("*").alias("n"),
        F.sum(amount).alias("total"),
        F.max(value).alias("largest"),
        F.count_distinct(peer).alias("n_peers"),
    )
    flows = flows.withColumn("bucket", F.col("_w.start")).drop("_w")
    # Bucket totals are sums of the flows at hand: a window over a bucket would put it into one task.
    flows = checkpointed(flows)
    whole = flows.groupBy("bucket").agg(F.sum("total").alias("_all"))
    share = F.when(F.col("_all") != 0, F.col("total").cast("double") / F.col("_all").cast("double"))
    return flows.join(checked_broadcast(whole), "bucket").withColumn("share", share).drop("_all")


def fan_out(df: DataFrame, src: str, dst: str, width: str, min_d: int, t: str = "ts", approx: bool = False) -> DataFrame:
    """Sources with at least `min_d` distinct peers in a time bucket; `approx` counts by sketch."""
    peers = F.approx_count_distinct(dst) if approx else F.count_distinct(dst)
    return (
        df.groupBy(F.window(t, width).alias("_w"), src)
        .agg(peers.alias("n_peers"))
        .filter(F.col("n_peers") >= min_d)
        .select(F.col("_w.start").alias("bucket"), src, "n_peers")
    )


def explain_anomaly(scored: DataFrame, features: Sequence[str], key: str = "entity_id") -> DataFrame:
    """Per flagged entity the signed contribution of each feature (its z value), strongest first."""
    stats = [F.avg(f).alias(f"m_{f}") for f in features] + [F.stddev_samp(f).alias(f"s_{f}") for f in features]
    model = checkpointed(scored.agg(*stats))
    one = lambda c: model.select(c).scalar()
    flagged = scored.filter("flagged").select(
        key,
        *[
            F.when(one(f"s_{f}") > 0, (F.col(f) - one(f"m_{f}")) / one(f"s_{f}")).otherwise(0.0).alias(f)
            for f in features
        ],
    )
    long = flagged.unpivot([key], list(features), "feature", "contribution")
    # A window partition holds the features of one entity.
    w = Window.partitionBy(key).orderBy(F.desc(F.round(F.abs("contribution"), 9)), "feature")
    return long.withColumn("place", F.row_number().over(w))
