"""Version tags."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def version_key(col: Column) -> Column:
    """``vA.B.C`` -> array of numbers, which Spark compares element by element.

    A tag that is not numeric in all parts, or has a part beyond 64 bits, gives null.
    """
    parts = F.transform(F.split(F.regexp_replace(col, "^v", ""), "[.]"), lambda p: p.try_cast("bigint"))
    return F.when(col.rlike("^v?[0-9]+([.][0-9]+)*$") & F.forall(parts, lambda p: p.isNotNull()), parts)


_PART = 1 << 20


def version_number(k: Column) -> Column:
    """A number that never falls as a version key rises: where to cut many versions into pieces."""
    part = lambda i: F.least(F.coalesce(F.get(k, F.lit(i)), F.lit(0)), F.lit(_PART))
    minor = part(1)
    rest = F.when(minor == _PART, F.lit(_PART) * _PART + _PART).otherwise(minor * _PART + part(2))
    return F.get(k, F.lit(0)).cast("double") * float(_PART) ** 2 * 2 + rest
