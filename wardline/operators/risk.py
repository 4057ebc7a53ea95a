"""Risk aggregation, trend and projection."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DateType, NumericType

from wardline.functions import is_private
from wardline.operators.ordered import Running, exact_quantiles, micros, nth_before, position, running, value_ranks
from wardline.session import checkpointed
from wardline.operators.same import join_same


def severity(cvss: Column) -> Column:
    """Severity class of a score."""
    return F.when(cvss >= 7, "high").when(cvss >= 4, "medium").otherwise("low")


def exposure_rollup(finding: DataFrame, asset: DataFrame, levels: Sequence[str] = ("site", "subnet")) -> DataFrame:
    """Finding counts by the assets' levels (coarse to fine) and severity, with subtotals and grand total.

    Findings are counted per asset, one column per severity, so that the join finds them partitioned
    already; and per finest cell before the rollup.
    """
    kinds, levels = ("high", "medium", "low"), list(levels)
    is_of = lambda kind: severity(F.col("cvss")) == kind
    per_asset = finding.groupBy("asset_id").agg(*[F.count_if(is_of(k)).alias(k) for k in kinds])
    wide = (
        per_asset.join(asset.select("asset_id", *levels), "asset_id")
        .groupBy(*levels)
        .agg(*[F.sum(k).alias(k) for k in kinds])
    )
    cells = wide.unpivot(levels, list(kinds), "severity", "n").filter("n > 0")
    return cells.rollup(*levels, "severity").agg(
        F.sum("n").alias("n"), F.grouping_id().cast("int").alias("grouping")
    )


def surface_side(address: Column) -> Column:
    """Which side an address faces: ``internal``, ``external``, or ``unknown`` where it is null or no address."""
    private = is_private(address)
    return F.when(private, "internal").when(~private, "external").otherwise("unknown")


def _cells(risk: DataFrame, dims: Sequence[str], col: str) -> DataFrame:
    return risk.groupBy(*dims).agg(
        F.sum(F.col(col).cast("decimal(18,6)")).alias("_s"), F.count("*").alias("_n"), F.max(col).alias("_m")
    )


def _measures() -> list[Column]:
    return [
        (F.sum("_s").cast("double") / F.sum("_n")).alias("mean_risk"),
        F.max("_m").alias("max_risk"),
        F.sum("_n").alias("n_assets"),
        F.grouping_id().cast("int").alias("grouping"),
    ]


def risk_cube(risk: DataFrame, dims: Sequence[str], col: str = "risk") -> DataFrame:
    """Mean and highest risk over all combinations of the dimensions."""
    return _cells(risk, dims, col).cube(*dims).agg(*_measures())


def risk_grouping_sets(
    risk: DataFrame, dims: Sequence[str], sets: Sequence[Sequence[str]], col: str = "risk"
) -> DataFrame:
    """As the cube, over the named combinations only."""
    wanted = [[F.col(c) for c in s] for s in sets]
    return _cells(risk, dims, col).groupingSets(wanted, *dims).agg(*_measures())


def daily_score(alerts: DataFrame, t: str = "ts", level: str = "level", by: Sequence[str] = ()) -> DataFrame:
    """Sum of levels per day (and group)."""
    return alerts.groupBy(*by, F.col(t).cast("date").alias("day")).agg(F.sum(level).cast("long").alias("score"))


def _time_number(df: DataFrame, t: str) -> Column:
    """A number in the order of a date, a time or a number."""
    kind = df.schema[t].dataType
    return F.unix_date(t) if isinstance(kind, DateType) else F.col(t).cast("double") if isinstance(kind, NumericType) else micros(t)


def risk_trend(daily: DataFrame, t: str = "day", col: str = "score", by: Sequence[str] = (), window: int = 7) -> DataFrame:
    """Score with the mean over the last `window` rows, the change to the row before, and the highest so far.

    The mean is a difference of running sums, so nothing depends on how many rows a group has.
    """
    keys, at = ["_all", *by], _time_number(daily, t)
    number = F.col(col).cast("decimal(38,6)")
    rows = running(
        daily.withColumn("_all", F.lit(0)), keys, [t, col], at,
        [
            Running("_before", "previous", F.col(col)),
            Running("running_max", "max", F.col(col), strict=False),
            Running("_sum", "sum", F.coalesce(number, F.lit(0)), strict=False),
            Running("_n", "sum", F.when(F.col(col).isNotNull(), 1).otherwise(0).cast("long"), strict=False),
        ],
    )
    rows = nth_before(rows, keys, [t, col], at, window, "_gone", F.struct("_sum", "_n"))
    total = (F.col("_sum") - F.coalesce(F.col("_gone._sum"), F.lit(0))).cast("double")
    n = F.col("_n") - F.coalesce(F.col("_gone._n"), F.lit(0))
    return rows.select(
        *daily.columns, F.when(n > 0, total / n).alias("moving_mean"), (F.col(col) - F.col("_before")).alias("change"), "running_max"
    )


def risk_projection(daily: DataFrame, horizon: int, by: Sequence[str], t: str = "day", col: str = "score") -> DataFrame:
    """Least-squares line per group, projected `horizon` days beyond its last day, not below 0."""
    x = F.unix_date(F.col(t)).cast("double")
    y = F.col(col).cast("double")
    lines = daily.groupBy(*by).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.max(t).alias("_last")
    )
    ahead = lines.withColumn("ahead", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    day = F.date_add("_last", F.col("ahead"))
    value = F.col("intercept") + F.col("slope") * F.unix_date(day)
    return ahead.select(*by, day.alias("day"), "slope", F.greatest(value, F.lit(0.0)).alias("projected"))


def ewma(df: DataFrame, key: Sequence[str], t: str, col: str, alpha: float) -> DataFrame:
    """Exponentially weighted mean in time order, one value per row: (key, t, ewma).

    The mean is a chain of linear maps, e -> (1 - alpha) e + alpha x, and chains of them compose.  A key's rows are cut
    into blocks, short enough that the powers of (1 - alpha) keep their precision.  Within a block the mean is a
    running sum of weighted values; what a block hands on is a plain sum, and reaches four blocks at most, beyond
    which its weight is below what a double can hold.  Rows of equal time go by value; a row without a value repeats
    the mean so far.
    """
    keys, left = list(key), 1.0 - alpha
    size = 1 if left <= 0 else 1 << 40 if left >= 1 else max(1, int(230 / -math.log(left)))
    at = _time_number(df, t)
    rows = df.select(*keys, t, F.col(col).cast("double").alias("_x"))
    seen = Running("_pos", "sum", F.when(F.col("_x").isNotNull(), 1).otherwise(0).cast("long"), strict=False)
    rows = running(rows, keys, [t, "_x"], at, [seen])
    before = F.greatest(F.col("_pos") - 1, F.lit(0))
    power = lambda n: F.pow(F.lit(left), n) if left > 0 else F.when(n == 0, 1.0).otherwise(0.0)
    share = F.when(F.col("_pos") == 1, F.col("_x")).otherwise(alpha * F.col("_x"))
    rows = rows.withColumns({"_block": F.floor(before / size).cast("long"), "_at": before % size})
    rows = rows.withColumn("_u", F.coalesce(share / power(F.col("_at")) if left > 0 else share, F.lit(0.0)))
    w = Window.partitionBy(*keys, "_block").orderBy(t, "_x").rowsBetween(Window.unboundedPreceding, 0)
    rows = checkpointed(rows.withColumn("_inside", F.sum("_u").over(w) * power(F.col("_at"))))
    ends = rows.groupBy(*keys, "_block").agg((F.sum("_u") * F.lit(left ** (size - 1) if size < 1 << 40 else 1.0)).alias("_end"))
    reach = F.array(*[F.struct((F.col("_block") + m).alias("to"), (F.col("_end") * F.lit((left**size) ** (m - 1))).alias("part")) for m in range(1, 5)])
    handed = ends.select(*keys, F.explode(reach).alias("h")).groupBy(*keys, F.col("h.to").alias("_block")).agg(F.sum("h.part").alias("_handed"))
    rows = join_same(rows, handed, [*keys, "_block"], "left")
    mean = F.col("_inside") + F.coalesce(F.col("_handed") * power(F.col("_at") + 1), F.lit(0.0))
    return rows.select(*keys, t, F.when(F.col("_pos") > 0, mean).alias("ewma"))


def risk_rank(risk: DataFrame, per: str, n: int | None = None, col: str = "risk", id_col: str = "asset_id") -> DataFrame:
    """rank, dense_rank, ntile(4), percent_rank and cume_dist by falling risk; the first `n` of each group.

    A group may hold a large part of all assets, and many assets may share one risk: ranks come
    from the counted distinct values, places among equals from a second, per-value order.
    """
    risk = checkpointed(risk)
    ranks = value_ranks(risk, [per], col, descending=True).withColumnRenamed("n", "_size")
    placed = position(risk, [per, col], [id_col], F.col(id_col), "_tie")
    placed = join_same(placed, ranks, [per, col])
    place = F.col("below") + F.col("_tie")
    # SQL's ntile: the first (size mod 4) tiles have one row more.
    q, r = F.floor(F.col("_size") / 4), F.col("_size") % 4
    big = r * (q + 1)
    tile = F.when(place <= big, F.floor((place - 1) / (q + 1)) + 1).otherwise(
        r + F.floor((place - 1 - big) / F.greatest(q, F.lit(1))) + 1
    )
    ranked = placed.select(
        *risk.columns,
        place.alias("place"),
        (F.col("below") + 1).alias("rank"),
        (F.col("distinct_below") + 1).alias("dense_rank"),
        tile.cast("int").alias("quartile"),
        F.when(F.col("_size") > 1, F.col("below") / (F.col("_size") - 1)).otherwise(0.0).alias("percent_rank"),
        ((F.col("below") + F.col("cnt")) / F.col("_size")).alias("cume_dist"),
    )
    return ranked if n is None else ranked.filter(F.col("place") <= n)


def posture_summary(
    asset: DataFrame, alerts: DataFrame, latest: DataFrame, hits: DataFrame, risk: DataFrame
) -> DataFrame:
    """The dashboard's figures as (kpi, value)."""
    count = lambda df, name: df.agg(F.count("*").cast("double").alias("value")).select(F.lit(name).alias("kpi"), "value")
    risk = checkpointed(risk.select(F.lit(0).alias("all"), "risk"))
    mean = F.avg(F.col("risk").cast("decimal(18,6)")).cast("double")
    spread = risk.agg(mean.alias("mean_risk"), F.max("risk").alias("max_risk"))
    quantiles = exact_quantiles(risk, ["all"], "risk", {"p50_risk": 0.5, "p95_risk": 0.95})
    figures = [
        count(asset, "assets"),
        count(alerts, "alerts"),
        count(latest.filter(F.col("state") == "open"), "open_findings"),
        count(hits, "ioc_hits"),
        spread.unpivot([], ["mean_risk", "max_risk"], "kpi", "value"),
        quantiles.unpivot([], ["p50_risk", "p95_risk"], "kpi", "value"),
    ]
    out = figures[0]
    for f in figures[1:]:
        out = out.unionByName(f)
    return out
