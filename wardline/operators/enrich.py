"""Enrichment and joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from wardline.functions import ip_to_long, mask_address, version_key, version_number
from wardline.operators.ordered import Running, micros, running
from wardline.operators.sizing import checked_broadcast
from wardline.session import checkpointed


def enrich_iocs(obs: DataFrame, feed: DataFrame, on: Sequence[str]) -> DataFrame:
    """Every observation with the feed's fields and `is_hit`; repeated feed rows do not multiply it."""
    on = list(on)
    fields = [c for c in feed.columns if c not in on]
    best = feed.groupBy(*on).agg(F.max(F.struct(*fields)).alias("_f"))
    joined = obs.join(checked_broadcast(best), on, "left")
    return joined.select(
        *obs.columns, *[F.col(f"_f.{c}").alias(c) for c in fields], F.col("_f").isNotNull().alias("is_hit")
    )


def ioc_hits(obs: DataFrame, feed: DataFrame, on: Sequence[str]) -> DataFrame:
    """Observations that the feed knows."""
    return obs.join(checked_broadcast(feed.select(*on).distinct()), list(on), "left_semi").select(*obs.columns)


def unmatched_iocs(obs: DataFrame, feed: DataFrame, on: Sequence[str]) -> DataFrame:
    """Observations that the feed does not know."""
    return obs.join(checked_broadcast(feed.select(*on).distinct()), list(on), "left_anti").select(*obs.columns)


def domain_suffix_match(obs: DataFrame, feed: DataFrame, host: str = "host", ioc: str = "ioc") -> DataFrame:
    """Hosts that equal an indicator or end in ``.`` + indicator; the longest indicator wins.

    Each distinct host is matched once, over the list of its suffixes, by an equality join.
    """
    labels = F.split(host, "[.]")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    tails = obs.select(host).distinct().select(host, F.explode(suffixes).alias(ioc))
    best = (
        tails.join(feed.select(ioc).distinct(), ioc)
        .groupBy(host)
        .agg(F.max_by(ioc, F.length(ioc)).alias("matched"))
    )
    return obs.join(best, host).select(*obs.columns, "matched")


def cidr_match(obs: DataFrame, blocks: DataFrame, ip: str = "ip") -> DataFrame:
    """Addresses in a block (`net`, `prefix`); the longest prefix wins.

    Equality join on (prefix length, masked address): one try per prefix length from 0 to 32.  Blocks of any
    other length, or of none, match nothing.
    """
    nets = blocks.filter(F.col("prefix").between(0, 32)).select(
        F.col("net"),
        F.col("prefix"),
        mask_address(ip_to_long(F.col("net")), F.col("prefix")).alias("masked"),
    ).distinct()
    tries = (
        obs.select(ip)
        .distinct()
        .withColumn("_n", ip_to_long(F.col(ip)))
        .filter(F.col("_n").isNotNull())
        .withColumn("prefix", F.explode(F.sequence(F.lit(0), F.lit(32))))
        .withColumn("masked", mask_address(F.col("_n"), F.col("prefix")))
    )
    best = (
        tries.join(nets, ["prefix", "masked"])
        .groupBy(ip)
        .agg(F.max(F.struct("prefix", "net")).alias("b"))
        .select(ip, F.col("b.net").alias("net"), F.col("b.prefix").alias("prefix"))
    )
    return obs.join(best, ip).select(*obs.columns, "net", "prefix")


def asset_context(alerts: DataFrame, asset: DataFrame, entity: str = "entity_id", key: str = "asset_id") -> DataFrame:
    """Every alert with the place and mission of its asset."""
    context = asset.withColumnRenamed(key, "_asset")
    return alerts.join(context, F.col(entity) == F.col("_asset"), "left").drop("_asset")


def context_asof(
    facts: DataFrame,
    states: DataFrame,
    key: str,
    t: str,
    fact_id: str,
    state_id: str,
    tolerance_s: int | None = None,
) -> DataFrame:
    """The last state at or before each fact's time, of the same key; null if older than the tolerance.

    One shuffle: facts and states in one ordered run, carrying the last state along.
    """
    fact_cols = [F.col(c) for c in facts.columns]
    state = F.struct(F.col(t).alias("state_ts"), F.col(state_id).alias("state_id"))
    line = lambda df, side, i, **c: df.select(
        key, F.col(t).alias("_t"), F.lit(side).alias("_side"), F.col(i).alias("_id"), *[v.alias(n) for n, v in c.items()]
    )
    both = line(facts, 1, fact_id, _fact=F.struct(*fact_cols)).unionByName(
        line(states, 0, state_id, _state=state), allowMissingColumns=True
    )
    carried = running(
        both, [key], ["_t", "_side", "_id"], micros("_t"), [Running("_last", "last", F.col("_state"), strict=False)]
    ).filter(F.col("_side") == 1)
    last = F.col("_last")
    if tolerance_s is not None:
        age = micros("_t") - micros(F.col("_last.state_ts"))
        last = F.when(age <= tolerance_s * 1_000_000, last)
    return carried.select("_fact.*", last["state_ts"].alias("state_ts"), last["state_id"].alias("state_id"))


def correlate_pairs(
    causes: DataFrame, effects: DataFrame, key: str, within_s: int, t: str = "ts", id_col: str = "event_id"
) -> DataFrame:
    """Each effect that follows causes of the same key, 0 < effect - cause <= within.

    One row per effect: the nearest cause and the number of causes in reach, so the output
    grows with the effects, not with the product of both sides.  The count is the difference
    of two running totals, at the effect's time and at the start of its reach.
    """
    point = causes.select(
        key, micros(t).alias("_t"), F.lit(1).alias("_side"), F.col(id_col).alias("_id"), F.col(t).alias("_ts")
    )
    end = micros(t)
    probe = effects.select(
        key,
        F.col(id_col).alias("_id"),
        F.col(t).alias("_ts"),
        F.explode(F.array(end, end - F.lit(within_s * 1_000_000))).alias("_t"),
        end.alias("_end"),
        F.lit(0).alias("_side"),
    )
    run = running(
        point.unionByName(probe, allowMissingColumns=True),
        [key],
        ["_t", "_side", "_id"],
        F.col("_t"),
        [
            Running("_n", "sum", F.col("_side").cast("long"), strict=False),
            Running("_last", "last", F.when(F.col("_side") == 1, F.struct("_ts", "_id")), strict=False),
        ],
    ).filter(F.col("_side") == 0)
    at_end = F.col("_t") == F.col("_end")
    total = lambda cond: F.coalesce(F.max(F.when(cond, F.coalesce(F.col("_n"), F.lit(0)))), F.lit(0))
    return (
        run.groupBy(F.col("_id").alias("effect_id"), key)
        .agg(
            F.max("_ts").alias("effect_ts"),
            (total(at_end) - total(~at_end)).alias("n_causes"),
            F.max(F.when(at_end, F.col("_last"))).alias("_c"),
        )
        .filter(F.col("n_causes") > 0)
        .select(
            key, "effect_id", "effect_ts", F.col("_c._id").alias("cause_id"), F.col("_c._ts").alias("cause_ts"), "n_causes"
        )
    )


def vulnerable_versions(versions: DataFrame, vuln: DataFrame) -> DataFrame:
    """(vendor, version, vuln_id) for each distinct version in an affected range: a sweep over ranks, without pairs to test.

    `versions` has vendor, version and `_k`.  Range ends and versions of a vendor go through one ordered run, which
    gives each end the number of versions below it.  A range is then a run of ranks, and each of these is a hit.
    """
    ends = vuln.select("vendor", "vuln_id", version_key(F.col("lo")).alias("_lo"), version_key(F.col("hi")).alias("_hi"), F.col("hi").isNull().alias("_open"))
    ends = ends.filter(F.col("_lo").isNotNull() & (F.col("_open") | F.col("_hi").isNotNull()))
    point = lambda df, k, own: df.select("vendor", F.col(k).alias("_k"), F.lit(own).cast("long").alias("_own"))
    points = point(versions, "_k", 1).unionAll(point(ends, "_lo", 0)).unionAll(point(ends.filter("not _open"), "_hi", 0))
    points = points.groupBy("vendor", "_k").agg(F.max("_own").alias("_own"))
    below = Running("_below", "sum", F.col("_own"))
    ranks = checkpointed(running(points, ["vendor"], ["_k"], version_number(F.col("_k")), [below]).withColumn("_below", F.coalesce("_below", F.lit(0))))
    rank = lambda k, to: ranks.select("vendor", F.col("_k").alias(k), F.col("_below").alias(to))
    sizes = ranks.groupBy("vendor").agg(F.sum("_own").alias("_all"))
    spans = ends.join(rank("_lo", "_from"), ["vendor", "_lo"]).join(sizes, "vendor").join(rank("_hi", "_to"), ["vendor", "_hi"], "left")
    to = F.when(F.col("_open"), F.col("_all")).otherwise(F.col("_to"))
    spans = spans.filter(to > F.col("_from"))
    hits = spans.select("vendor", "vuln_id", F.explode(F.sequence(F.col("_from"), to - 1)).alias("_below"))
    found = hits.join(ranks.filter("_own = 1").select("vendor", "_k", "_below"), ["vendor", "_below"])
    return found.join(versions, ["vendor", "_k"]).select("vendor", "version", "vuln_id")


def match_vulnerabilities(service: DataFrame, vuln: DataFrame) -> DataFrame:
    """Services whose version lies in an affected range of their vendor: lo <= version < hi, open where hi is null.

    Ranges are looked up once per distinct (vendor, version), not once per service.  `status` is ``affected``, or
    ``not_comparable`` with a null `vuln_id` for a service whose version is missing or not numeric: nobody can
    say whether it is affected.  A range with such an end takes nothing.
    """
    k = version_key(F.col("version"))
    versions = checkpointed(service.select("vendor", "version", k.alias("_k")).distinct().filter("_k is not null"))
    affected = service.join(vulnerable_versions(versions, vuln), ["vendor", "version"])
    unknown = service.filter(k.isNull())
    columns = [F.col(c) for c in service.columns]
    none = F.lit(None).cast(vuln.schema["vuln_id"].dataType).alias("vuln_id")
    return affected.select(*columns, "vuln_id", F.lit("affected").alias("status")).unionAll(
        unknown.select(*columns, none, F.lit("not_comparable").alias("status"))
    )


def apply_share_policy(objs: DataFrame, peers: DataFrame, marking: str = "marking") -> DataFrame:
    """Each object once for each peer that shares and whose `allowed` list has the object's marking."""
    grants = peers.filter("shares").select("peer", F.explode(F.array_distinct("allowed")).alias(marking))
    return objs.join(grants, marking).select(*objs.columns, "peer")
