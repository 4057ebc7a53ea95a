"""The corpus pipeline: classify, apply rules, remove near copies, mix sources, encode.

Every stage takes (spark, docs, sf_dir), where docs is all that the stage before kept, and returns a frame that
is written as Parquet and read again for the next one.  All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from wardline.llm import ngram_join, pfair, pieces, quality_bayes, quality_rules
from wardline.llm.common import saved
from wardline.llm.queries import PIECES_FILE, REST, WEIGHTS
from wardline.operators.sizing import checked_broadcast

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Rows that a part of the mixture has, about.
PART_ROWS = 10_000
#: Bytes of a batch for Python: a Python worker and the JVM each hold some copies of one, for every task at a time.
BATCH_BYTES = "2m"

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _in_batches(stage: Stage) -> Stage:
    """`stage` on a session whose batches for Python are bounded, whoever made the session."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        # It stays set, as the frame that is returned runs later.
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return run


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _numbered(docs: DataFrame) -> DataFrame:
    """`docs` with `row`, the number of the file and the place in it; every row has its own, equal rows too."""
    try:
        placed = docs.select(*COLUMNS, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    except AnalysisException:
        # Not straight from files.
        return _numbered(saved(docs, "numbered"))
    files = placed.select("_file").distinct().coalesce(1).withColumn("_no", F.monotonically_increasing_id())
    row = F.shiftleft("_no", 40).bitwiseOR(F.col("_at")).alias("row")
    return placed.join(checked_broadcast(saved(files, "files")), "_file").select(*COLUMNS, row)


def _but(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of `docs` (numbered) that are not in `dropped`."""
    return docs.join(checked_broadcast(dropped.select("row")), "row", "left_anti").select(*COLUMNS)


@_in_batches
def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that text, source and language together show as bad, each row by its own verdict.

    A row with nulls is judged like any other; repeated rows stay or go alike; an empty table stays empty; columns
    beyond those of documents are left out.
    """
    docs = _numbered(docs)
    return _but(docs, quality_bayes.classify(docs, _labels(spark, sf_dir), row="row").where("not kept"))


@_in_batches
def ruled(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that a rule rejects, each row by its own verdict.

    A row with nulls is judged like any other; repeated rows stay or go alike; an empty table stays empty; columns
    beyond those of documents are left out.
    """
    docs = _numbered(docs)
    return _but(docs, quality_rules.judge(docs, _labels(spark, sf_dir), row="row").where("not kept"))


@_in_batches
def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The keeper row of each group of near copies, whatever ids its rows have.

    Repeated rows are near copies; rows without words, or with a null text, all stay.  An empty table stays empty.
    """
    docs = _numbered(docs)
    return _but(docs, ngram_join.jaccard_components(docs, row="row").where("not keeper"))


@_in_batches
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture: parts follow one another, rows within them too.

    A null source belongs to the rest; null and repeated ids have places of their own.  An empty table stays empty.
    """
    docs = _numbered(docs)
    places = pfair.place(docs.select("row", "doc_id", "source"), WEIGHTS, REST, "doc_id", "source", pfair.BLOCK_ROWS, pfair.TASK_ROWS)
    places = saved(places.select("row", "slot", "place"), "places")
    end = places.agg(F.max("slot").alias("slot"), F.count("*").alias("n")).first()
    parts = max(1, -(-(end.n or 0) // PART_ROWS))
    part = F.floor(F.col("slot") * parts / ((end.slot or 0) + 1)).cast("int")
    return docs.join(places, "row").repartitionById(parts, part).sortWithinPartitions("slot", "place", "doc_id").select(*COLUMNS)


@_in_batches
def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, with their digest, round trip and parity; a null text counts as empty."""
    return pieces.encode(docs, PIECES_FILE)


STAGES = [
    ("quality_classifier", classified),
    ("quality_rules", ruled),
    ("ngram_jaccard", deduplicated),
    ("pfair_mix", mixed),
    ("sentencepiece", encoded),
]

#: The classifier is a fitted model, which SQL cannot express; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over the documents of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
