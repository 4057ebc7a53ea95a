"""Filters, set operations, key maintenance, top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from wardline.functions import version_key, version_number
from wardline.operators.ordered import position


def membership_filter(df: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """Keep rows whose key equals a member of the allowed set."""
    return df.join(allowed.select(key), key, "left_semi").select(*df.columns)


def missing_required(required: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Required keys that have no counterpart."""
    # distinct() first: the present side may hold one key very often.
    return required.select(key).join(present.select(key).distinct(), key, "left_anti")


def exclude_reserved(df: DataFrame, col: str, names: Sequence[str]) -> DataFrame:
    """Drop rows whose name is, in full, one of the reserved names; null names stay."""
    return df.filter(F.col(col).isNull() | ~F.col(col).isin(list(names)))


def lookup_default(df: DataFrame, map_df: DataFrame, key: str, col: str, out: str = "resolved") -> DataFrame:
    """Look the key up in a table of unique keys; where it is absent, the key itself is the result."""
    names = map_df.select(F.col(key).alias("_key"), F.col(col).alias("_value"))
    return df.join(names, F.col(key) == F.col("_key"), "left").select(
        *df.columns, F.coalesce("_value", F.col(key)).alias(out)
    )


def expand_members(df: DataFrame, key: str, list_col: str, sep: str = " ", out: str = "member") -> DataFrame:
    """One row per member of a separated list, with its 0-based place."""
    members = F.filter(F.split(list_col, sep), lambda m: m != "")
    return df.select(key, F.posexplode(members).alias("place", out))


def _unique(df: DataFrame, key: str) -> DataFrame:
    """`df` with its rows packed in `_row`; a repeated key is an error."""
    packed = df.groupBy(key).agg(F.count("*").alias("_n"), F.first(F.struct(*df.columns)).alias("_row"))
    complaint = F.concat(F.lit(f"repeated update key {key}="), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    # The check is part of the key, so no join on it can leave it out.
    return packed.select(F.when(F.col("_n") > 1, F.raise_error(complaint)).otherwise(F.col(key)).alias(key), "_row")


def upsert_by_key(target: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Replace rows of equal key by their update, append updates with a new key, keep the rest.

    A null key is a key like any other, so a second run changes nothing.
    """
    # A full outer join on a null-safe condition would be a nested loop; the key and whether it is null are plain ones.
    on = [F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_on"), F.col(key).isNull().alias("_null")]
    new = _unique(updates.select(*target.columns), key).select(*on, F.col("_row").alias("_new"))
    old = target.select(*on, F.struct(*target.columns).alias("_old"))
    return old.join(new, ["_on", "_null"], "full_outer").select(F.coalesce("_new", "_old").alias("r")).select("r.*")


def insert_if_absent(target: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Append only rows whose key is absent; of several new rows with one key the least is taken."""
    rest = [c for c in target.columns if c != key]
    one = new.groupBy(key).agg(F.min(F.struct(*rest)).alias("_r")).select(key, "_r.*")
    there = target.select(F.col(key).alias("_there"))
    return target.unionByName(one.join(there, F.col(key).eqNullSafe(F.col("_there")), "left_anti"))


def replace_stale(target: DataFrame, stale_keys: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Delete the named keys where present, then insert what is absent; doing it twice changes nothing."""
    stale = stale_keys.select(F.col(key).alias("_stale"))
    return insert_if_absent(target.join(stale, F.col(key).eqNullSafe(F.col("_stale")), "left_anti"), fresh, key)


def semver_latest(df: DataFrame, col: str, pattern: str = "^v[0-9]+[.][0-9]+[.]0$", n: int = 1) -> DataFrame:
    """The `n` highest version tags among those that match the pattern."""
    tags = df.filter(F.col(col).rlike(pattern)).select(col).distinct()
    return tags.orderBy(F.desc(version_key(F.col(col))), F.desc(col)).limit(n)


def upgrade_path(
    releases: DataFrame, current: str | Column, target: str | Column, col: str = "version", by: Sequence[str] = ()
) -> DataFrame:
    """Releases with current < version <= target, numbered in order; empty when both are equal.

    A target below the current version is refused.  `by` makes one path per group.
    """
    at = lambda v: version_key(F.lit(v) if isinstance(v, str) else v)
    refused = F.raise_error(F.lit("cannot go back to a lower version"))
    wanted = F.when(at(target) < at(current), refused).otherwise(
        (version_key(F.col(col)) > at(current)) & (version_key(F.col(col)) <= at(target))
    )
    steps = releases.filter(wanted).select(*by, col).distinct().withColumn("_k", version_key(F.col(col)))
    steps = steps.withColumn("_all", F.lit(0))
    return position(steps, ["_all", *by], ["_k"], version_number(F.col("_k")), "step").withColumn("step", F.col("step").cast("int")).drop("_k", "_all")


def profile_set_ops(a: DataFrame, b: DataFrame) -> DataFrame:
    """Members of two sets, labelled ``both``, ``left`` or ``right``: one shuffle for all three."""
    flagged = a.withColumns({"_a": F.lit(1), "_b": F.lit(0)}).unionByName(
        b.withColumns({"_a": F.lit(0), "_b": F.lit(1)})
    )
    side = F.when((F.col("_a") == 1) & (F.col("_b") == 1), "both").when(F.col("_a") == 1, "left").otherwise("right")
    return (
        flagged.groupBy(*a.columns)
        .agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
        .select(*a.columns, side.alias("member_of"))
    )


def profile_matrix(df: DataFrame, row: str, col: str, values: Sequence[str]) -> DataFrame:
    """Member x profile matrix of 0 and 1 for the given profiles."""
    return df.groupBy(row).agg(
        *[F.max(F.when(F.col(col) == v, 1).otherwise(0)).alias(str(v)) for v in values]
    )


def top_talkers(edge: DataFrame, by: str, n: int, src: str = "src") -> DataFrame:
    """The `n` sources with most traffic; ties by id."""
    return edge.groupBy(src).agg(F.sum(by).alias("total")).orderBy(F.desc("total"), src).limit(n)
