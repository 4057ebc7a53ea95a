"""Session settings and the shared working folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings every operator relies on.  They are all settable on a
# live session, so they also apply to a session that somebody else has built.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join partition even where a later aggregate on the same
    # key then has to shuffle again: one more shuffle beats one endless task.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Batches for Python are bounded in bytes too: a table may have very long texts.
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
    # State on local disk, of which each batch writes only the changes to the checkpoint.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Merge sessions before the shuffle in streaming session windows.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}

_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_session(app: str = "wardline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's settings; `conf` adds or overrides."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    # Checkpoint files go when their frame is no longer in use; a setting of the context, so only here.
    static = {"spark.cleaner.referenceTracking.cleanCheckpoints": "true"}
    for key, value in {**RUNTIME_CONF, **static, **conf}.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that already exists."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_root(spark: SparkSession) -> str:
    """The shared folder of the cluster, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster the
    executors would not see it.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if named is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="wardline-"))
    return named or context.getCheckpointDir()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new, unused path under the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Within it, what is computed once and kept gives its shuffle files up at the end, not when the JVM collects garbage."""
    before = spark.conf.get(_RELEASE)
    spark.conf.set(_RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.set(_RELEASE, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """`df`, computed once and kept in the shared folder (survives lost executors)."""
    shared_root(df.sparkSession)
    with shuffles_released(df.sparkSession):
        # A frame of its own: the setting counts when a frame is made.
        return df.select("*").checkpoint(eager=True)
