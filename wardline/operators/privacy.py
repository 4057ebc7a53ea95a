"""Privacy-preserving sharing."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, functions as F

from wardline.session import checkpointed

# Both Java's and RE2's engine read these alike.
EMAIL = "[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z]+)+"
SHA1 = "[0-9A-Fa-f]{40,}"
CARD = "[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}"
IPV4 = "[0-9]{1,3}(?:[.][0-9]{1,3}){3}"
REDACTIONS = {"EMAIL": EMAIL, "HASH": SHA1, "CARD": CARD, "IP": IPV4}
# Text that any match must contain.
NEEDS = {"EMAIL": "@", "IP": "."}


def k_anonymize(df: DataFrame, id_col: str, levels: Sequence[Sequence[str]], k: int) -> DataFrame:
    """Release each row at the first level at which its class has k rows; suppress what never reaches k.

    `levels[i]` names the quasi-identifiers of level i; every later level must be a function of
    level 0.  Levels are decided on the distinct classes; the rows are joined once, at the end.
    """
    every = list(dict.fromkeys(c for level in levels for c in level))
    placed = None
    left = checkpointed(df.groupBy(*every).agg(F.count("*").alias("_n")))
    for i, level in enumerate(levels):
        sizes = left.groupBy(*level).agg(F.sum("_n").alias("_size")).filter(F.col("_size") >= k).drop("_size")
        # null-safe: a missing quasi-identifier is a value like any other
        right = sizes.select(*[F.col(c).alias(f"_r_{c}") for c in level])
        match = None
        for c in level:
            e = F.col(c).eqNullSafe(F.col(f"_r_{c}"))
            match = e if match is None else match & e
        hit = left.join(right, match, "left_semi").select(
            *every, F.lit(i).alias("level"), *[F.col(c).cast("string").alias(f"q{j}") for j, c in enumerate(level)]
        )
        placed = hit if placed is None else placed.unionByName(hit, allowMissingColumns=True)
        left = checkpointed(left.join(right, match, "left_anti"))
    cond = None
    for c in every:
        e = F.col(f"d.{c}").eqNullSafe(F.col(f"p.{c}"))
        cond = e if cond is None else cond & e
    q = [f"q{j}" for j in range(max(len(level) for level in levels))]
    return df.alias("d").join(placed.alias("p"), cond).select(F.col(f"d.{id_col}").alias(id_col), "level", *q)


def k_anonymity_report(df: DataFrame, qids: Sequence[str], k: int) -> DataFrame:
    """Number of classes, smallest and mean class, share of rows in classes smaller than k."""
    classes = df.groupBy(*qids).agg(F.count("*").alias("c"))
    return classes.agg(
        F.count("*").alias("n_classes"),
        F.min("c").alias("min_class"),
        F.avg("c").alias("mean_class"),
        (F.sum(F.when(F.col("c") < k, F.col("c")).otherwise(0)) / F.sum("c")).alias("share_at_risk"),
    )


def l_diversity(df: DataFrame, qids: Sequence[str], sensitive: str, l: int) -> DataFrame:
    """Classes with fewer than l distinct sensitive values."""
    return (
        df.groupBy(*qids)
        .agg(F.count_distinct(sensitive).alias("n_values"), F.count("*").alias("n"))
        .filter(F.col("n_values") < l)
    )


def dp_counts(df: DataFrame, subject: str, keys: Sequence[str], epsilon: float, secret: str, release: str) -> DataFrame:
    """Counts of subjects with Laplace(1/epsilon) noise; a subject counts once per key.

    The noise is drawn from a nested keyed hash of the release, epsilon and the key: a task that runs again
    gives the same noise, and another release draws anew, so the difference of two releases hides a change.
    Every release of a table spends `epsilon` of the budget of its subjects; `dp_release` keeps account of it.
    """
    counts = df.select(subject, *keys).distinct().groupBy(*keys).agg(F.count("*").alias("n"))
    inner = F.sha2(F.concat_ws("|", F.lit(secret), F.lit(release), F.lit(repr(float(epsilon))), *[F.col(k).cast("string") for k in keys]), 256)
    digest = F.sha2(F.concat_ws("|", F.lit(secret), inner), 256)
    # 52 bits of the digest as a number strictly between -1/2 and 1/2.
    u = (F.conv(F.left(digest, F.lit(13)), 16, 10).cast("double") + 0.5) / F.lit(2.0**52) - 0.5
    noise = -F.signum(F.col("_u")) * F.log(1 - 2 * F.abs("_u")) / F.lit(float(epsilon))
    noisy = counts.withColumn("_u", u)
    return noisy.select(*keys, (F.col("n") + noise).alias("noisy_n"))


class BudgetSpent(ValueError):
    """A release is refused: its epsilon goes beyond the budget, or its name has been used."""


LEDGER = "dataset string, release string, epsilon decimal(18,9)"


def dp_release(
    df: DataFrame, subject: str, keys: Sequence[str], epsilon: float, secret: str, release: str,
    ledger: str, dataset: str, budget: float,
) -> DataFrame:
    """Noisy counts as `dp_counts` gives them, if the budget of `dataset` allows; else `BudgetSpent` is raised.

    `ledger` is a shared folder of Parquet rows that are only ever added.  A release first books its epsilon, then
    reads the ledger: of releases that run at the same time none goes beyond the budget, at worst all are refused.  A
    refused one books its epsilon back.  A name can be used once, whatever came of it: the noise follows the name.
    """
    if epsilon <= 0:
        raise ValueError("epsilon must be positive")
    spark = df.sparkSession
    # One row at a time: a booking is not data of the table.
    book = lambda sign: (
        spark.createDataFrame([(dataset, release, sign * Decimal(repr(float(epsilon))))], LEDGER)
        .coalesce(1).write.mode("append").parquet(ledger)
    )
    book(1)
    own = F.col("release") == release
    seen = spark.read.schema(LEDGER).parquet(ledger).filter(F.col("dataset") == dataset)
    total, used = seen.agg(F.sum("epsilon"), F.count_if(own)).first()
    if used > 1 or total > Decimal(repr(float(budget))):
        book(-1)
        why = f"{release!r} has been used" if used > 1 else f"{total} would be spent of {budget}"
        raise BudgetSpent(f"no release of {dataset!r}: {why}")
    return dp_counts(df, subject, keys, epsilon, secret, release)


def dp_spent(spark: SparkSession, ledger: str) -> DataFrame:
    """What the ledger says per dataset: epsilon spent, and the number of releases."""
    booked = spark.read.schema(LEDGER).parquet(ledger).groupBy("dataset", "release").agg(F.sum("epsilon").alias("e"))
    return booked.groupBy("dataset").agg(F.sum("e").cast("double").alias("spent"), F.count_if(F.col("e") > 0).alias("n_releases"))


def pseudonymize(df: DataFrame, cols: Sequence[str], salt: str) -> DataFrame:
    """Replace values by stable keyed tokens: equal values give equal tokens, so joins survive."""
    return df.withColumns({c: F.sha2(F.concat(F.lit(salt), F.col(c).cast("string")), 256) for c in cols})


def redact_text(df: DataFrame, col: str, types: Sequence[str] = tuple(REDACTIONS)) -> DataFrame:
    """Replace sensitive tokens by type tags; `n_redacted` counts the replacements."""
    out, text, n = df.withColumn("n_redacted", F.lit(0).cast("long")), F.col(col), F.col("n_redacted")
    for t in types:
        # A cheap test first: most texts hold none.
        may = text.contains(NEEDS[t]) if t in NEEDS else F.lit(True)
        hits = F.coalesce(F.when(may, F.regexp_count(text, F.lit(REDACTIONS[t]))), F.lit(0))
        out = out.withColumn("_hits", hits)
        cleaned = F.when(F.col("_hits") > 0, F.regexp_replace(text, REDACTIONS[t], f"[{t}]")).otherwise(text)
        out = out.withColumns({col: cleaned, "n_redacted": n + F.col("_hits")}).drop("_hits")
    return out
