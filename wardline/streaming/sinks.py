"""Bounded sources, and sinks that stand a retry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from wardline.session import checkpointed, shared_dir


def stream_buffered(
    spark: SparkSession, path: str, schema: StructType | str, max_files: int | None, pattern: str | None = None, fmt: str = "parquet"
) -> DataFrame:
    """A file stream in batches of at most `max_files` (None: all that is there): a slow sink delays rows but never loses one."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path)


def drain(sdf: DataFrame, name: str) -> DataFrame:
    """Run a stream over all that is there now and return what it wrote to the shared folder."""
    spark = sdf.sparkSession
    out, ckpt = shared_dir(spark, name), shared_dir(spark, f"{name}-ckpt")
    # The result of a stream without input; what the stream writes takes its place.
    spark.createDataFrame([], sdf.schema).write.parquet(out)
    query = (
        sdf.writeStream.format("parquet").outputMode("append").option("checkpointLocation", ckpt)
        .trigger(availableNow=True).start(out)
    )
    query.awaitTermination()
    return spark.read.schema(sdf.schema).parquet(out)


def stream_upsert(
    sdf: DataFrame, path: str, ckpt: str, key: str, order: list[str], buckets: int = 64
) -> StreamingQuery:
    """Keep the latest row of each key in a table of `buckets` folders by the key's hash; null is a key like others.

    A micro-batch reads and rewrites only the buckets that its keys fall into, so reading costs what the table holds,
    however many batches there were.  Merged buckets are first staged next to the checkpoint and then take the place of
    the old ones: a batch that runs again after a failure takes what is staged, and one that is staged anew gives the
    same rows.  Choose `buckets` so that one is a few hundred megabytes; it stays the same for a table's life.
    """

    def keep(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fs, staged = _file_system(spark, ckpt), f"{ckpt}/staged/v={epoch}"
        if not fs(f"{staged}/_SUCCESS", "exists"):
            rows = _newest(batch, key, order).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
            rows = checkpointed(rows)
            # At most as many as the parameter says.
            touched = [r.bucket for r in rows.select("bucket").distinct().toLocalIterator()]
            if _file_system(spark, path)(path, "exists"):
                old = spark.read.schema(rows.schema).parquet(path).filter(F.col("bucket").isin(touched))
                rows = _newest(rows.unionByName(old), key, order)
            rows.write.mode("overwrite").parquet(staged)
        merged = spark.read.schema(_with_bucket(batch)).parquet(staged)
        (
            merged.repartition(F.col("bucket")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("bucket").parquet(path)
        )
        # This batch may have to run again; those before it are done.
        fs(f"{ckpt}/staged/v={epoch - 1}", "delete")

    return sdf.writeStream.foreachBatch(keep).option("checkpointLocation", ckpt).trigger(availableNow=True).start()


def _with_bucket(df: DataFrame) -> StructType:
    return StructType([*df.schema.fields, StructField("bucket", IntegerType())])


def _file_system(spark: SparkSession, path: str) -> Callable[[str, str], bool]:
    """Asks for paths of the file system that holds `path`, or deletes them."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return lambda p, what: fs.exists(at(p)) if what == "exists" else fs.delete(at(p), True)


def _newest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*")


def current_table(spark: SparkSession, path: str) -> DataFrame:
    """The table that `stream_upsert` keeps."""
    return spark.read.parquet(path).drop("bucket")


def split_late(sdf: DataFrame, path: str, ckpt: str, delay_s: int, t: str = "ts") -> StreamingQuery:
    """Mark records that lie more than the delay behind the highest event time of all earlier micro-batches.

    Both kinds are written, in folders ``late=false`` and ``late=true`` of each batch; the highest
    event time so far is a one-row table per batch, so it outlives a restart.
    """

    def split(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        top = F.lit(None).cast("timestamp")
        if epoch > 0:
            top = F.lit(spark.read.parquet(f"{path}/top/v={epoch - 1}").first()["top"]).cast("timestamp")
        late = F.coalesce(F.col(t) < top - F.expr(f"interval {delay_s} seconds"), F.lit(False))
        batch.withColumn("late", late).write.mode("overwrite").partitionBy("late").parquet(f"{path}/rows/v={epoch}")
        batch.agg(F.greatest(F.max(t), top).alias("top")).write.mode("overwrite").parquet(f"{path}/top/v={epoch}")

    return sdf.writeStream.foreachBatch(split).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
