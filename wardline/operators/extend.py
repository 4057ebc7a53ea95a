"""Places for a user's own code; all get bounded batches, never a whole unbounded group."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType


def apply_detector(
    df: DataFrame,
    key: str,
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    schema: StructType | str,
    t: str = "ts",
    bucket: str = "day",
    measures: dict[str, Column] | None = None,
) -> DataFrame:
    """A user's pandas function per key, over the key's series of one row per time bucket.

    `measures` say how the events of a bucket are aggregated (default: their count `n`).  The series
    of a key is as long as the calendar, so a key with a third of all events is no larger than another.
    """
    measures = measures or {"n": F.count("*")}
    series = df.groupBy(key, F.date_trunc(bucket, t).cast("timestamp_ntz").alias("bucket")).agg(
        *[c.alias(n) for n, c in measures.items()]
    )
    return series.groupBy(key).applyInPandas(lambda pdf: fn(pdf.sort_values("bucket")), schema)


def apply_scorer(
    df: DataFrame, fn: Callable[..., pd.Series], cols: Sequence[str], out: str = "score", returns: str = "double"
) -> DataFrame:
    """A user's vectorised function of some columns."""

    def score(*args: pd.Series) -> pd.Series:
        return fn(*args)

    return df.withColumn(out, F.pandas_udf(score, returns)(*[F.col(c) for c in cols]))


def apply_parser(df: DataFrame, parser: type, returns: StructType | str, col: str, keep: Sequence[str]) -> DataFrame:
    """A user's 1 -> n parser: a class with ``eval(self, value)`` that yields rows; values travel in Arrow batches."""
    schema = StructType.fromDDL(returns) if isinstance(returns, str) else returns
    table = F.udtf(parser, returnType=schema, useArrow=True)
    return df.lateralJoin(table(F.col(col).outer())).select(*keep, *[F.col(f"`{n}`") for n in schema.names])


#: Keys whose states a task holds at a time.
HELD_KEYS = 100_000


def apply_aggregate(
    df: DataFrame,
    key: str,
    partial: Callable[[pd.DataFrame], pd.DataFrame],
    merge: Callable[[pd.DataFrame], pd.DataFrame],
    state: str,
    finish: Column,
    cols: Sequence[str],
    out: str = "value",
) -> DataFrame:
    """A user's grouped reduction in two steps, as Spark's own aggregates work.

    `partial` turns a batch of rows into one state row per key, `merge` several state rows per key into one;
both keep the columns (key, *state).  A task combines what it reads and holds the states of a bounded
    number of keys; after the shuffle a key has one state for each time that a task let go of it.
    `finish` computes the result from the state.
    """
    schema = f"{key} {df.schema[key].dataType.simpleString()}, {state}"

    def combine(batches):
        held = None
        for batch in batches:
            part = partial(batch)
            held = part if held is None else merge(pd.concat([held, part]))
            if len(held) > HELD_KEYS:
                yield held
                held = None
        if held is not None:
            yield held

    states = df.select(key, *cols).mapInPandas(combine, schema)
    return states.groupBy(key).applyInPandas(merge, schema).select(key, finish.alias(out))
