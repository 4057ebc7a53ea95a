"""Throttle and correlation: keys share buckets, rows are worked off together or slice by slice, batches are large or small."""

import random

import pytest
from pyspark.sql import functions as F

from wardline import streaming
from wardline.plans.views import event_stream
from wardline.session import shared_dir
from wardline.streaming import drain, state

from test_streaming import CLOSING, T0, put, throttled


@pytest.fixture(params=["together", "slice by slice"])
def ways(request, monkeypatch):
    if request.param == "slice by slice":
        monkeypatch.setattr(state, "_FEW", 20)
        monkeypatch.setattr(state, "_PIECE", 5)


def random_rows(n, span, keys, seed):
    """Times repeat, also within a key; some keys are null."""
    rng = random.Random(seed)
    return [(i, rng.randrange(span), rng.choice(keys), rng.choice(["signup", "error"]), 1.0) for i in range(n)]


def correlated(rows, within):
    want = {}
    for i, t, k, kind, _ in rows:
        near = [(s, c) for c, s, u, what, _ in rows if what == "signup" and u == k and k is not None and 0 < t - s <= within]
        if kind == "error" and near:
            want[i] = (k, max(near)[1], len(near))
    return want


def all_throttled(rows, quiet):
    keys = {r[2] for r in rows}
    return sorted(i for k in keys for i in throttled({r[0]: r[1] for r in rows if r[2] == k}, quiet))


def correlate(spark, path, within, delay, of=lambda stream: stream, **more):
    stream = of(event_stream(spark, path, "*.parquet"))
    kind = lambda what: stream.filter(F.col("category") == what)
    out = drain(streaming.stream_correlate(kind("signup"), kind("error"), "entity_id", within, delay, **more), "t")
    return {r.effect_id: (r.entity_id, r.cause_id, r.n_causes) for r in out.collect()}


def throttle(spark, path, quiet, delay, of=lambda stream: stream, **more):
    out = streaming.stream_throttle(of(event_stream(spark, path, "*.parquet")), "entity_id", quiet, delay, **more)
    return sorted(r.event_id for r in drain(out, "t").collect())


ENDS = [CLOSING, (1000, 10**8, 999, "signup", 1.0)]
KEYS = [1, 2, 3, (1 << 62) + 1, None]


@pytest.mark.parametrize("buckets", [1, 3])
def test_results_by_brute_force(spark, ways, buckets):
    path = shared_dir(spark, "t")
    rows = random_rows(600, 3000, KEYS, buckets)
    put(spark, path, rows[::2])
    put(spark, path, rows[1::2])
    put(spark, path, [(10_000 + i, *rest) for i, *rest in ENDS])
    got = throttle(spark, path, 100, "1 hour", buckets=buckets)
    assert got == all_throttled(rows, 100) and len(got) > 50
    got = correlate(spark, path, 160, "1 hour", buckets=buckets)
    assert got == correlated(rows, 160) and len({k for k, _, _ in got.values()}) == 4


def test_a_null_key_leaves_other_keys_alone(spark):
    path = shared_dir(spark, "t")
    rows = random_rows(600, 3000, [*range(1, 41), None], 5)
    put(spark, path, rows)
    put(spark, path, [(10_000 + i, *rest) for i, *rest in ENDS])
    out = streaming.stream_throttle(event_stream(spark, path, "*.parquet"), "entity_id", 100, "1 hour")
    key = {r[0]: r[2] for r in rows}
    assert sorted((r.event_id, r.entity_id or 0) for r in drain(out, "t").collect()) == [(i, key[i] or 0) for i in all_throttled(rows, 100)]


def test_many_small_batches_as_one(spark, ways):
    path = shared_dir(spark, "t")
    rows = random_rows(240, 1500, KEYS, 7)
    by_time = sorted(rows, key=lambda r: r[1])
    # The watermark passes slices between the batches; the disorder stays within the delay.
    for x in range(0, 240, 20):
        part = by_time[x : x + 20]
        put(spark, path, part[::-1])
    put(spark, path, [(10_000 + i, *rest) for i, *rest in ENDS])
    assert throttle(spark, path, 60, "100 seconds", buckets=2) == all_throttled(rows, 60)
    assert correlate(spark, path, 400, "100 seconds", buckets=2) == correlated(rows, 400)


@pytest.mark.parametrize("kind", ["string", "double", "timestamp", "date"])
def test_keys_of_other_types(spark, kind):
    path = shared_dir(spark, "t")
    rows = random_rows(120, 900, [1, 2, None], 3)
    put(spark, path, rows)
    put(spark, path, [(10_000 + i, *rest) for i, *rest in ENDS])
    text = {"timestamp": "concat('2024-01-0', cast(entity_id % 10 as string), ' 01:02:03.000004')", "date": "concat('2024-01-0', cast(entity_id % 10 as string))"}
    value = F.expr(f"cast({text.get(kind, 'entity_id')} as {kind})")
    of = lambda stream: stream.withColumn("entity_id", value)
    assert throttle(spark, path, 50, "1 hour", of) == all_throttled(rows, 50)
    named = {r.n: r.v for r in spark.sql("select * from values (1L), (2L), (999L) as t(entity_id)").select(F.col("entity_id").alias("n"), value.alias("v")).collect()}
    want = {i: (named[k], c, n) for i, (k, c, n) in correlated(rows, 60).items()}
    assert correlate(spark, path, 60, "1 hour", of) == want


def test_zeros_and_not_a_numbers_are_one_key_each(spark):
    path = shared_dir(spark, "t")
    rows = [(i, 10 * i, i % 4, "error", 1.0) for i in range(40)]
    put(spark, path, rows)
    put(spark, path, [CLOSING])
    of = lambda stream: stream.withColumn("entity_id", F.expr("case entity_id when 0 then 0.0D when 1 then 0.0D * -1 when 999 then 5.0D else double('NaN') end"))
    assert throttle(spark, path, 45, "1 hour", of) == all_throttled([(i, t, u // 2, *rest) for i, t, u, *rest in rows], 45)


def test_state_grows_with_buckets_and_not_with_keys(spark):
    """A call into the state costs more than a row: 30,000 keys with two rows each had a chunk for each row."""
    path = shared_dir(spark, "t")
    n = 30_000
    spark.range(2 * n).select(
        F.col("id").alias("event_id"), (F.lit(T0) + F.make_dt_interval(secs=(F.col("id") % 997).cast("decimal(18,6)"))).cast("timestamp_ntz").alias("ts"),
        F.expr(f"id % {n}").alias("user_id"), F.expr(f"if(id < {n}, 'signup', 'error')").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"),
    ).coalesce(1).write.parquet(path)
    put(spark, path, [(10 * n + i, *rest) for i, *rest in ENDS])
    stream = event_stream(spark, path, "*.parquet")
    kind = lambda what: stream.filter(F.col("category") == what)
    for out in (
        streaming.stream_throttle(kind("error"), "entity_id", 10, "1 hour"),
        streaming.stream_correlate(kind("signup"), kind("error"), "entity_id", 600, "1 hour"),
    ):
        query = (
            out.writeStream.format("noop").outputMode("append").option("checkpointLocation", shared_dir(spark, "t-ckpt")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        held = [op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]]
        # Nothing but the closing rows stays.
        assert 0 < max(held) < n / 2 and held[-1] < 50
