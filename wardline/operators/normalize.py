"""Projection and normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from wardline.functions import find_all, is_ipv4, rewrite_line
from wardline.functions.times import elapsed_parts
from wardline.operators.ordered import parts

# Patterns that both Java's and RE2's engine read alike.
EMAIL = "[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z]+)+"
DOTTED_DIGITS = "[0-9][0-9.]*[0-9]"
HEX_RUN = "[0-9a-f]{40,}"
URL_HOST = "https?://([A-Za-z0-9.-]+)"


def normalize_events(
    raw: DataFrame, mapping: dict[str, Column], required: Sequence[str] = ("entity_id", "ts")
) -> DataFrame:
    """Map raw records to the canonical event schema; `valid` is false where a required field is null."""
    valid = F.lit(True)
    for name in required:
        valid = valid & F.col(name).isNotNull()
    return raw.select(*[c.alias(n) for n, c in mapping.items()]).withColumn("valid", valid)


def decode_logs(lines: DataFrame, col: str, decoders: dict[str, tuple[str, Sequence[str]]]) -> DataFrame:
    """Apply named regex decoders in order; the first that matches gives `decoder` and the map `fields`."""
    name, fields = F.lit(None).cast("string"), F.lit(None).cast("map<string,string>")
    for decoder, (pattern, groups) in reversed(decoders.items()):
        hit = F.col(col).rlike(pattern)
        values = F.array(*[F.regexp_extract(col, pattern, i + 1) for i in range(len(groups))])
        name = F.when(hit, F.lit(decoder)).otherwise(name)
        fields = F.when(hit, F.map_from_arrays(F.array(*[F.lit(g) for g in groups]), values)).otherwise(fields)
    return lines.withColumns({"decoder": name, "fields": fields})


def extract_iocs(
    df: DataFrame, id_col: str, text_col: str, types: Sequence[str] = ("ipv4", "email", "host", "sha1")
) -> DataFrame:
    """One row per (id, type, distinct value) for the indicators found in the whole text."""
    text = F.col(text_col)
    found = {
        "ipv4": F.filter(find_all(text, DOTTED_DIGITS, needs="."), is_ipv4),
        "email": F.transform(find_all(text, EMAIL, needs="@"), F.lower),
        "host": F.transform(find_all(text, URL_HOST, 1, needs="://"), F.lower),
        "sha1": F.filter(find_all(text, HEX_RUN), lambda h: F.length(h) == 40),
    }

    def tag(kind: str) -> Column:
        return F.transform(
            F.array_distinct(found[kind]), lambda v: F.struct(F.lit(kind).alias("ioc_type"), v.alias("ioc"))
        )

    tagged = [tag(kind) for kind in types]
    return df.select(F.col(id_col), F.explode(F.concat(*tagged)).alias("i")).select(id_col, "i.ioc_type", "i.ioc")


def replace_literal(df: DataFrame, cols: Sequence[str], old: str, new: str) -> DataFrame:
    """Replace every occurrence of a literal in the given columns."""
    return df.withColumns({c: F.replace(F.col(c), F.lit(old), F.lit(new)) for c in cols})


def rewrite_keyed_value(df: DataFrame, col: str, key: str, value: str) -> DataFrame:
    """In keyed multi-line text, replace the value on the line of the key; `changed` tells whether it did."""
    new = rewrite_line(F.col(col), key, value)
    return df.withColumns({"changed": new != F.col(col), col: new})


def select_by_environment(df: DataFrame, cond: Column, a: str, b: str, name: str = "selected") -> DataFrame:
    """Column `a` where the predicate holds, else column `b`."""
    return df.withColumn(name, F.when(cond, F.col(a)).otherwise(F.col(b)))


def add_elapsed(df: DataFrame, start: str, end: str) -> DataFrame:
    """Minutes and seconds between two timestamps as two columns."""
    return (
        df.withColumn("_d", elapsed_parts(F.col(start), F.col(end)))
        .withColumns({"minutes": F.col("_d.minutes"), "seconds": F.col("_d.seconds")})
        .drop("_d")
    )


def summarize_lines(
    df: DataFrame, group: Sequence[str], order: Sequence[str], at: Column, text: str, max_lines: int = 1000
) -> DataFrame:
    """Join the texts of a group, in order, into a report.

    A report part holds at most `max_lines` lines; a longer report goes on in parts 1, 2, ...
    """
    cut = parts(df, group, order, at, max_lines)
    line = F.struct(*order, F.col(text).alias("_text"))
    return cut.groupBy(*group, "part").agg(
        F.count("*").alias("n_lines"),
        F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["_text"]), "\n").alias("report"),
    )
