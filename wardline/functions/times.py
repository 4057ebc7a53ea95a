"""Durations and dates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def elapsed_parts(start: Column, end: Column) -> Column:
    """Duration as whole minutes and remaining whole seconds."""
    seconds = F.floor(
        (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(1_000_000)
    ).cast("long")
    minutes = F.floor(seconds / F.lit(60)).cast("long")
    return F.struct(minutes.alias("minutes"), (seconds - minutes * 60).alias("seconds"))


def expiry_date(date: Column, days: int, fmt: str = "dd/MM/yyyy", at: Column | None = None) -> Column:
    """Date plus `days`: the date, its formatted text and, given `at`, whether it has passed by then."""
    expires = F.date_add(date.cast("date"), days)
    expired = (expires < at.cast("date")) if at is not None else F.lit(None).cast("boolean")
    return F.struct(
        expires.alias("expires"), F.date_format(expires, fmt).alias("text"), expired.alias("expired")
    )
