"""Broadcasting only what has been measured."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardline.session import checkpointed

MAX_ROWS = 200_000
MAX_BYTES = 64 * 1024 * 1024


def measured(df: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, bool]:
    """`df`, materialised once, and whether it proved to be small.

    Rows that are written in the query itself are known to be small without a job.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    if plan.getClass().getSimpleName() == "LocalRelation":
        known = plan.stats()
        if int(str(known.rowCount().get())) <= max_rows and int(str(known.sizeInBytes())) <= max_bytes:
            return df, True
    kept = checkpointed(df)
    size = (
        kept.select(F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in kept.columns]))).alias("b"))
        .agg(F.count("*").alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b"))
        .first()
    )
    return kept, size.n <= max_rows and size.b <= max_bytes


def checked_broadcast(df: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Materialise `df` once; hint a broadcast only if it proved to be small.

    Beyond the bound the frame comes back without a hint, so the join turns
    into a shuffled one that adaptive execution can split where it is skewed.
    """
    kept, small = measured(df, max_rows, max_bytes)
    return F.broadcast(kept) if small else kept
