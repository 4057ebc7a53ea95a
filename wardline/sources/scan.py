"""Sources."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructType

CORRUPT = "_corrupt"


def scan_glob(spark: SparkSession, root: str, pattern: str, schema: StructType | None = None) -> DataFrame:
    """All Parquet tables in `root` whose name matches, as one relation with their name in `source`.

    A table is a file or a folder of part files.  The relation has the columns of all of them; a table without
    one has nulls there.
    """
    base = re.sub("^[a-z0-9]+:(//[^/]*)?", "", root).rstrip("/")
    reader = spark.read.option("mergeSchema", "true") if schema is None else spark.read.schema(schema)
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    name = F.regexp_extract(path, re.escape(base) + "/([^/]+)", 1)
    return reader.parquet(f"{root.rstrip('/')}/{pattern}").withColumn("source", name)


def read_indicator_csv(spark: SparkSession, path: str, schema: StructType, header: bool = False) -> DataFrame:
    """An indicator list in CSV; a row that does not fit the schema keeps its text in ``_corrupt``."""
    return (
        spark.read.schema(StructType([*schema.fields]).add(CORRUPT, StringType()))
        .option("header", header)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .csv(path)
    )


def split_indicators(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable rows, and the texts of the others."""
    return df.filter(F.col(CORRUPT).isNull()).drop(CORRUPT), df.filter(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def replay_tail(df: DataFrame, order_col: str, n: int = 50) -> DataFrame:
    """The relation plus a second copy of its last `n` rows in the given order."""
    return df.unionByName(df.orderBy(F.desc(order_col)).limit(n))
