"""Attack surface and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from wardline.session import checkpointed


def scan_diff(prev: DataFrame, curr: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Compare two snapshots: ``new``, ``gone``, ``changed`` or ``same``, with values before and after."""
    pack = lambda df, n: df.select(*keys, F.struct(*cols).alias(n))
    return _compared(pack(prev, "_b").join(pack(curr, "_a"), list(keys), "full_outer"), keys, cols)


def scan_diff_at(
    finding: DataFrame, cut: Column, keys: Sequence[str], order: Sequence[Column], cols: Sequence[str], t: str = "found_at"
) -> DataFrame:
    """`scan_diff` of the latest findings before the time `cut` and of all: one pass, one aggregate."""
    row = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.struct(*cols).alias("_v"))
    both = finding.groupBy(*keys).agg(F.max(F.when(F.col(t) < cut, row))["_v"].alias("_b"), F.max(row)["_v"].alias("_a"))
    return _compared(both, keys, cols)


def _compared(both: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    status = (
        F.when(F.col("_b").isNull(), "new")
        .when(F.col("_a").isNull(), "gone")
        .when(F.col("_a").eqNullSafe(F.col("_b")), "same")
        .otherwise("changed")
    )
    values = [F.col(f"{s}.{c}").alias(f"{n}_{c}") for c in cols for s, n in (("_b", "before"), ("_a", "after"))]
    return both.select(*keys, status.alias("status"), *values)


def latest_findings(finding: DataFrame, keys: Sequence[str], order: Sequence[Column], cols: Sequence[str]) -> DataFrame:
    """Current state: per key the row that is greatest in `order`.

    An aggregate, not a window: repeated findings of one key are combined before the shuffle.
    """
    ranked = [o.alias(f"o{i}") for i, o in enumerate(order)]
    return (
        finding.groupBy(*keys)
        .agg(F.max(F.struct(*ranked, *cols)).alias("_r"))
        .select(*keys, *[F.col(f"_r.{c}").alias(c) for c in cols])
    )


def finding_order() -> list[Column]:
    """What makes a finding the latest; ``fixed`` wins over ``open`` when all else is equal."""
    return [
        *[F.col(c) for c in ("found_at", "run_id", "seq", "scanner_id", "cvss")],
        F.when(F.col("state") == "fixed", 1).otherwise(0),
    ]


def cvss_score(latest: DataFrame, key: str = "asset_id", cut: int = 7) -> DataFrame:
    """Per asset: highest, mean and number of severe open findings."""
    return (
        latest.filter(F.col("state") == "open")
        .groupBy(key)
        .agg(
            F.max("cvss").alias("max_cvss"),
            F.avg("cvss").alias("mean_cvss"),
            F.count_if(F.col("cvss") >= cut).alias("n_severe"),
        )
    )


def threat_score(alerts: DataFrame, as_of: str, half_life_s: int, key: str = "entity_id") -> DataFrame:
    """Per asset the sum of level x 0.5^(age / half-life) at a fixed time; later alerts do not count."""
    now = F.unix_micros(F.lit(as_of).cast("timestamp"))
    age = (now - F.unix_micros(F.col("ts").cast("timestamp"))) / F.lit(1e6)
    return (
        alerts.filter(age >= 0)
        .groupBy(key)
        .agg(F.sum(F.col("level") * F.pow(F.lit(0.5), age / F.lit(float(half_life_s)))).alias("threat"))
    )


def _weight(weights: dict[str, float]) -> Column:
    weight = F.lit(0.0)
    for mission, w in weights.items():
        weight = F.when(F.col("mission") == mission, F.lit(float(w))).otherwise(weight)
    return weight


def criticality_score(asset: DataFrame, weights: dict[str, float], centrality: DataFrame) -> DataFrame:
    """Mission weight x (1 + centrality / its maximum), scaled to 0-10; an asset outside the graph has centrality 0.

    `centrality` (node, total) is read twice, so it had better be materialised, as `degree_centrality` returns it.
    """
    links = centrality.select(F.col("node").alias("asset_id"), F.col("total").alias("_deg"))
    most = links.agg(F.max("_deg")).scalar()
    share = F.when(most > 0, F.coalesce(F.col("_deg"), F.lit(0)) / most).otherwise(0.0)
    raw = checkpointed(asset.join(links, "asset_id", "left").select("asset_id", (_weight(weights) * (1 + share)).alias("_raw")))
    top = raw.agg(F.max("_raw")).scalar()
    return raw.select("asset_id", F.when(top > 0, F.col("_raw") / top * 10).otherwise(0.0).alias("criticality"))


def mission_criticality(
    asset: DataFrame, weights: dict[str, float], uses: DataFrame, hops: int, keep: float = 0.5
) -> DataFrame:
    """(node, criticality): the weight of the weightiest mission that needs a node, times `keep` per step of dependence.

    An asset has its own mission's weight; what it uses (src uses dst) is needed by that mission too, and so on for
    `hops` steps.  Nodes that no mission of weight above 0 reaches are left out.  A hop keeps one number per node,
    combined before the shuffle, so a node that everything uses is no larger than another.
    """
    links = checkpointed(uses.select("src", "dst").distinct()) if hops else None
    own = asset.select(F.col("asset_id").alias("node"), _weight(weights).alias("criticality")).filter("criticality > 0")
    now = own.groupBy("node").agg(F.max("criticality").alias("criticality"))
    for _ in range(hops):
        passed = links.join(now, F.col("src") == F.col("node")).select(
            F.col("dst").alias("node"), (F.col("criticality") * F.lit(keep)).alias("criticality")
        )
        now = checkpointed(now.unionByName(passed).groupBy("node").agg(F.max("criticality").alias("criticality")))
    return now


def service_risk(service: DataFrame, affected: DataFrame, latest: DataFrame, risk: DataFrame) -> DataFrame:
    """Risk of every service: the worst, over its vulnerabilities, of asset risk x highest open score / 10.

    Inputs: services (service_id), affected (service_id, vuln_id), latest findings (asset_id, vuln_id, cvss, state)
    and asset risks (asset_id, risk).  Findings are combined per vulnerability before they meet the services, so a
    vulnerability of many services and many assets makes no pairs.  A service without one has risk 0.
    """
    at_risk = latest.filter(F.col("state") == "open").join(risk.select("asset_id", "risk"), "asset_id")
    per = at_risk.groupBy("vuln_id").agg(
        F.count("*").alias("_assets"), (F.max("risk") * F.max("cvss") / 10).alias("_risk")
    )
    own = (
        affected.select("service_id", "vuln_id").distinct().join(per, "vuln_id", "left").groupBy("service_id")
        .agg(F.count("*").alias("_n"), F.sum("_assets").alias("_assets"), F.max("_risk").alias("_risk"))
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return service.select("service_id").join(own, "service_id", "left").select(
        "service_id", zero("_n").alias("n_vulns"), zero("_assets").alias("n_findings"),
        F.coalesce("_risk", F.lit(0.0)).alias("risk"),
    )


def base_risk(
    crit: DataFrame, threat: DataFrame, cvss: DataFrame, weights: tuple[float, float, float] = (0.4, 0.3, 0.3)
) -> DataFrame:
    """100 x weighted sum of the three scores, each min-max scaled over all assets; a missing score is 0.

    Inputs: (asset_id, criticality), (asset_id, threat), (asset_id, cvss).
    """
    names = ("criticality", "threat", "cvss")
    joined = crit.join(threat, "asset_id", "full_outer").join(cvss, "asset_id", "full_outer")
    scores = checkpointed(joined.select("asset_id", *[F.coalesce(F.col(n), F.lit(0.0)).alias(n) for n in names]))
    total = F.lit(0.0)
    for n, w in zip(names, weights):
        # One-row aggregates as scalar subqueries instead of a window over everything.
        lo, hi = scores.agg(F.min(n)).scalar(), scores.agg(F.max(n)).scalar()
        total = total + F.lit(float(w)) * F.when(hi > lo, (F.col(n) - lo) / (hi - lo)).otherwise(0.0)
    return scores.select("asset_id", *names, (total * 100).alias("risk"))
