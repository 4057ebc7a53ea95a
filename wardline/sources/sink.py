"""Sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from wardline.operators.ordered import parts


def ingest_lines(spark: SparkSession, src_dir: str, out_dir: str, ckpt: str, max_files: int = 100) -> StreamingQuery:
    """Append every incoming text line to a durable table, in batches of at most `max_files` files."""
    return (
        spark.readStream.option("maxFilesPerTrigger", max_files)
        .text(src_dir)
        .writeStream.format("parquet")
        .option("checkpointLocation", ckpt)
        .trigger(availableNow=True)
        .start(out_dir)
    )


def route(df: DataFrame, routes: dict[str, Column], default: str = "default") -> DataFrame:
    """Name, in `route`, the first route whose predicate holds; a null predicate does not hold."""
    chosen = F.lit(default)
    for name, holds in reversed(routes.items()):
        chosen = F.when(holds, F.lit(name)).otherwise(chosen)
    return df.withColumn("route", chosen)


def write_routed(df: DataFrame, path: str, max_records: int = 5_000_000) -> None:
    """Write a routed frame, one folder for each route; file size is bounded, tasks are not merged by route."""
    df.write.option("maxRecordsPerFile", max_records).partitionBy("route").mode("append").parquet(path)


def publish_cti_events(
    attrs: DataFrame, group_cols: Sequence[str], type_col: str, value_col: str, max_attributes: int = 1000
) -> DataFrame:
    """Group indicator attributes into event objects, as JSON.

    An event object holds at most `max_attributes`; further ones follow in parts 1, 2, ...
    """
    unique = attrs.select(*group_cols, F.col(type_col).alias("type"), F.col(value_col).alias("value")).distinct()
    # The text order has no number to cut along, so a heavy group is cut along a hash:
    # inside an object the attributes are sorted, and the part depends on (hash, type, value) only.
    keyed = unique.withColumn("_h", F.xxhash64("type", "value"))
    cut = parts(keyed, group_cols, ["_h", "type", "value"], F.col("_h"), max_attributes)
    return (
        cut.groupBy(*group_cols, "part")
        .agg(F.sort_array(F.collect_list(F.struct("type", "value"))).alias("attributes"))
        .select(
            *group_cols,
            "part",
            F.size("attributes").cast("long").alias("n_attributes"),
            F.to_json(F.struct("attributes")).alias("event"),
        )
    )
