"""Behaviour sequences, bundles, timelines, hunting, case reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType

from wardline.operators.same import join_same
from wardline.operators.ordered import Running, following, micros, parts, position, profile_keys, running

_US = 1_000_000


def behaviour_sequence(
    df: DataFrame, key: str, steps: Sequence[str], within_s: int, state: str = "category", t: str = "ts",
    id_col: str = "event_id",
) -> DataFrame:
    """Places where a key's adjacent events have the categories of `steps`, first to last inside `within_s`."""
    order, at = [t, id_col], micros(t)
    split = profile_keys(df, [key], at)
    ahead = df.select(key, state, t, id_col).withColumn("_n0", F.struct(state, t, id_col))
    for i in range(1, len(steps)):
        # The next row's "next" is the row after that: i steps ahead by i single steps.
        step = Running(f"_n{i}", "previous", F.col(f"_n{i - 1}"))
        ahead = running(ahead, [key], order, at, [step], descending=True, split=split)
    last = f"_n{len(steps) - 1}"
    hit = micros(F.col(f"{last}.{t}")) - at <= within_s * _US
    for i, s in enumerate(steps):
        hit = hit & (F.col(f"_n{i}.{state}") == s)
    return ahead.filter(hit).select(
        key, F.col(id_col).alias("first_id"), F.col(t).alias("first_ts"),
        F.col(f"{last}.{id_col}").alias("last_id"), F.col(f"{last}.{t}").alias("last_ts"),
    )


def behaviour_funnel(
    df: DataFrame, key: str, steps: Sequence[str], within_s: int, state: str = "category", t: str = "ts",
    id_col: str = "event_id",
) -> DataFrame:
    """The furthest stage each key reached: steps in order, others may lie between, all inside `within_s`.

    Each step event carries the latest start of a chain that leads to it.  A later start never
    spoils a chain, so the running maximum decides exactly whether any chain is short enough.
    """
    order, at = [t, id_col], micros(t)
    run = df.filter(F.col(state).isin(list(steps))).select(key, state, t, id_col)
    split = profile_keys(run, [key], at)
    run = run.withColumn("_s1", F.when(F.col(state) == steps[0], at))
    stage = F.when(F.col("_s1").isNotNull(), 1).otherwise(0)
    for i in range(2, len(steps) + 1):
        run = running(run, [key], order, at, [Running("_m", "max", F.col(f"_s{i - 1}"))], split=split)
        run = run.withColumn(f"_s{i}", F.when(F.col(state) == steps[i - 1], F.col("_m"))).drop("_m")
        stage = F.when(at - F.col(f"_s{i}") <= within_s * _US, i).otherwise(stage)
    return run.groupBy(key).agg(F.max(stage).alias("stage"))


def transition_matrix(
    df: DataFrame, key: str, state: str, t: str = "ts", id_col: str = "event_id"
) -> DataFrame:
    """Counts and probabilities of a key's next state, given the present one."""
    pairs = following(df.select(key, state, t, id_col), [key], [t, id_col], micros(t), next_state=F.col(state))
    counts = pairs.filter("next_state IS NOT NULL").groupBy(state, "next_state").agg(F.count("*").alias("n"))
    # Over the counts, not over the events.
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(state)))


def build_bundle(
    df: DataFrame, key: str, kind: str, obj_id: str, props: Sequence[str], at: Column, max_objects: int = 1000
) -> DataFrame:
    """Objects of a key -> JSON bundles of typed objects, at most `max_objects` in each part.

    Properties keep their types: numbers, booleans, arrays and structs become JSON of their kind; a null one is left out.
    """
    cut = parts(df, [key], [obj_id], at, max_objects)
    text = lambda c: F.col(c).cast("string")
    fields = [text(kind).alias("type"), text(obj_id).alias("id"), *[F.col(p) for p in props]]
    obj = F.struct(F.col(obj_id).alias("_o"), F.struct(*fields).alias("m"))
    objects = F.transform(F.array_sort(F.collect_list(obj), lambda a, b: F.when(a["_o"] < b["_o"], -1).when(a["_o"] > b["_o"], 1).otherwise(0)), lambda o: o["m"])
    name = F.concat_ws("-", F.lit("bundle"), text(key), text("part"))
    return (
        cut.groupBy(key, "part")
        .agg(F.count("*").alias("n_objects"), objects.alias("objects"))
        .select(
            key, "part", "n_objects",
            F.to_json(F.struct(F.lit("bundle").alias("type"), name.alias("id"), "objects")).alias("bundle"),
        )
    )


def flatten_bundle(df: DataFrame, col: str = "bundle") -> DataFrame:
    """JSON bundle -> one row per object: bundle id, type, id, and the object with all its properties as a VARIANT.

    Take properties with ``variant_get(props, '$.name', type)``; nested ones by their path.  A text that is no JSON
    gives no rows, nor does a bundle without objects; an object without a type or id has null there.
    """
    field = lambda v, path, kind: F.try_variant_get(v, path, kind)
    opened = df.select(F.try_parse_json(col).alias("b")).select(
        field("b", "$.id", "string").alias("bundle_id"), F.explode(field("b", "$.objects", "array<variant>")).alias("props")
    )
    return opened.select("bundle_id", field("props", "$.type", "string").alias("type"), field("props", "$.id", "string").alias("id"), "props")


def bundle_types(flat: DataFrame) -> DataFrame:
    """The properties that the objects of each type have, with their types, and the number of objects."""
    return flat.groupBy("type").agg(F.count("*").alias("n"), F.schema_of_variant_agg("props").alias("properties"))


def timeline(sources: dict[str, DataFrame], t: str, key: str, id_col: str) -> DataFrame:
    """Unlike sources as one timeline per key, in time order, with source name and sequence number."""
    both = None
    for name, df in sources.items():
        named = df.withColumn("source", F.lit(name))
        both = named if both is None else both.unionByName(named, allowMissingColumns=True)
    return position(both, [key], [t, "source", id_col], micros(t))


def hunt_text(
    df: DataFrame, id_col: str, text_col: str, patterns: dict[str, str | tuple[str, str]], ctx: int = 20
) -> DataFrame:
    """One row per (text, hunt) with hits: their number and the first one within its context.

    A hunt is a pattern, or a pattern and a literal that any match must contain; the literal is looked for first.
    """
    text = F.col(text_col)
    hunts = []
    for name, hunt in patterns.items():
        pattern, needs = hunt if isinstance(hunt, tuple) else (hunt, "")
        hits = F.regexp_count(text, F.lit(pattern)).cast("long")
        first = F.regexp_extract(text, pattern, 0)
        start = F.instr(text, first)
        begin = F.greatest(start - ctx, F.lit(1))
        snippet = F.substr(text, begin, start - begin + F.length(first) + ctx)
        hunts.append(
            F.when(
                text.contains(needs) & (hits > 0),
                F.struct(
                    F.lit(name).alias("hunt"),
                    hits.alias("hits"),
                    snippet.alias("snippet"),
                ),
            )
        )
    return df.select(id_col, F.explode(F.array_compact(F.array(*hunts))).alias("h")).select(id_col, "h.*")


def case_report(
    findings: DataFrame, key: str, kind: str, kinds: Sequence[str], t: str, weight: str, evidence: str, top: int = 3
) -> DataFrame:
    """One row per case: counts by kind, first and last time, the `top` pieces of evidence by weight."""
    counts = findings.groupBy(key).agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in kinds],
        F.min(t).alias("first_ts"),
        F.max(t).alias("last_ts"),
    )
    w = Window.partitionBy(key).orderBy(F.desc(weight), evidence)
    # The limit per case applies before the shuffle; the list below holds `top` entries at most.
    best = findings.select(key, weight, evidence).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= top)
    lists = best.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_rn", evidence))).alias("_l"))
    named = F.array_join(F.transform("_l", lambda e: e[evidence].cast(StringType())), ",")
    return join_same(counts, lists, [key]).withColumn("evidence", named).drop("_l")
