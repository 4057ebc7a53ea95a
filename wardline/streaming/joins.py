"""Joins of streams with tables and with other streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from wardline.operators.detect import rule_hits
from wardline.operators.sizing import checked_broadcast
from wardline.streaming.state import stream_dedup


def stream_enrich(sdf: DataFrame, feed: DataFrame, on: Sequence[str]) -> DataFrame:
    """Every streamed row with the feed's fields and `is_hit`; the feed is a table."""
    on = list(on)
    fields = [c for c in feed.columns if c not in on]
    best = feed.groupBy(*on).agg(F.max(F.struct(*fields)).alias("_f"))
    joined = sdf.join(checked_broadcast(best), on, "left")
    return joined.select(
        *sdf.columns, *[F.col(f"_f.{c}").alias(c) for c in fields], F.col("_f").isNotNull().alias("is_hit")
    )


def stream_match_rules(sdf: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per (streamed event, matching rule), as in the batch form but for `is_best`; keeps no state."""
    return rule_hits(sdf, rules)


def stream_unmatched_iocs(
    sdf: DataFrame, feed: DataFrame, on: Sequence[str], delay: str, t: str = "ts", salts: int = 8
) -> DataFrame:
    """Streamed indicators that the feed does not know, each once within the delay: what has to be looked up.

    A null is no indicator.  `salts` spreads the copies of a frequent one before the last step, as in `stream_dedup`.
    """
    on = list(on)
    known = checked_broadcast(feed.select(*on).distinct())
    unknown = sdf.select(*on, t).dropna(subset=on).join(known, on, "left_anti")
    return stream_dedup(unknown, on, delay, t, salts).select(*on, t)
