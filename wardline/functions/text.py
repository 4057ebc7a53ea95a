"""Separated and keyed text."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def find_all(text: Column, pattern: str, group: int = 0, needs: str | None = None) -> Column:
    """All matches of a pattern; a text without the literal `needs`, which any match must contain, is not searched."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    if needs is None:
        return found
    return F.when(text.contains(needs), found).otherwise(F.array().cast("array<string>"))


def first_token(col: Column, sep: str = " ") -> Column:
    """First field of a separated string."""
    return F.split_part(col, F.lit(sep), F.lit(1))


def kv_extract(col: Column, pair_sep: str = "\n", kv_sep: str = "=") -> Column:
    """Keyed text -> map.

    The value is the field after the first separator (a further separator ends it),
    without its quotes and white space; of equal keys the last one counts.
    """
    pairs = F.filter(F.split(col, re.escape(pair_sep)), lambda p: p.contains(kv_sep))
    field = lambda p, n: F.split_part(p, F.lit(kv_sep), F.lit(n))
    entries = F.transform(
        pairs,
        lambda p: F.struct(
            field(p, 1).alias("key"), F.regexp_replace(field(p, 2), r"""[\s"']""", "").alias("value")
        ),
    )
    # map_from_entries refuses repeated keys, so drop an entry whose key comes again.
    again = lambda e, i: F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"])
    return F.map_from_entries(F.filter(entries, lambda e, i: ~again(e, i)))


def rewrite_line(col: Column, key: str, value: str, sep: str = "=") -> Column:
    """In keyed multi-line text, set the value on lines that start with the key."""
    literal = re.sub(r"([\\$])", r"\\\1", f"{key}{sep}{value}")
    return F.regexp_replace(col, f"(?m)^{re.escape(key + sep)}.*", literal)
