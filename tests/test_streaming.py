"""Streams: late rows, replays, restarts, retries."""

import datetime as dt
from bisect import bisect_left

from pyspark.sql import functions as F

from wardline import streaming
from wardline.operators import detect
from wardline.operators.detect import frequency_rule
from wardline.plans import views as v
from wardline.plans.catalog import QUERIES
from wardline.session import shared_dir
from wardline.plans.views import event_stream
from wardline.streaming import drain, state

T0 = dt.datetime(2024, 1, 1)


def events(spark, rows):
    return spark.createDataFrame(
        [(i, T0 + dt.timedelta(seconds=s), u, c, x, "{}") for i, s, u, c, x in rows], v.EVENTS_SCHEMA
    )


def put(spark, path, rows):
    events(spark, rows).coalesce(1).write.mode("append").parquet(path)


def test_dedup_needs_a_delay_that_covers_the_disorder(spark):
    path = shared_dir(spark, "t")
    put(spark, path, [(1, 0, 1, "error", 1.0), (2, 7200, 1, "error", 1.0)])
    put(spark, path, [(3, 60, 1, "error", 1.0), (1, 0, 1, "error", 1.0)])
    put(spark, path, [(3, 60, 1, "error", 1.0), (4, 90, 1, "error", 1.0)])
    ids = lambda delay: sorted(
        r.event_id for r in drain(streaming.stream_dedup(event_stream(spark, path, "*.parquet"), ["event_id"], delay), "t").collect()
    )
    assert ids("1 day") == [1, 2, 3, 4]
    # Event 4 comes a batch after the watermark has passed it.
    assert ids("1 minute") == [1, 2, 3]


def test_dedup_of_very_many_copies(spark):
    path = shared_dir(spark, "t")
    put(spark, path, [(7, 0, 1, "error", 1.0)] * 400 + [(i, i, 1, "error", 1.0) for i in range(20, 50)])
    put(spark, path, [(7, 0, 1, "error", 1.0)] * 100)
    rows = streaming.stream_dedup(event_stream(spark, path, "*.parquet"), ["event_id"], "1 day", salts=8)
    assert sorted(r.event_id for r in drain(rows, "t").collect()) == [7, *range(20, 50)]


CLOSING = (999, 10**8, 999, "error", 1.0)


def test_throttle_looks_at_what_was_emitted(spark):
    path = shared_dir(spark, "t")
    # 8 s after the last raw alert, but 16 s after the last emitted one; the batches bring them out of order.
    put(spark, path, [(3, 16, 1, "error", 1.0), (2, 8, 1, "error", 1.0), (4, 0, 2, "error", 1.0), (6, 27, 1, "error", 1.0)])
    put(spark, path, [(5, 20, 1, "error", 1.0), (1, 0, 1, "error", 1.0)])
    put(spark, path, [CLOSING])
    out = streaming.stream_throttle(event_stream(spark, path, "*.parquet"), "entity_id", 10, "1 hour")
    assert sorted(r.event_id for r in drain(out, "t").collect()) == [1, 3, 4, 6]


def throttled(times, quiet):
    last, out = None, []
    for i, t in sorted(times.items(), key=lambda x: (x[1], x[0])):
        if last is None or t - last > quiet:
            last = t
            out.append(i)
    return out


def test_a_heavy_key_never_forms_one_frame(spark, tmp_path):
    path, sizes = shared_dir(spark, "t"), tmp_path / "sizes"
    times = {i: (i * 7919) % 6000 for i in range(3000)}
    put(spark, path, [(i, t, 1, "error", 1.0) for i, t in times.items()])
    put(spark, path, [CLOSING])

    class Counted(state._Throttle):
        def handleInputRows(self, key, rows, timerValues):
            def counted():
                for frame in rows:
                    with open(sizes, "a") as f:
                        print(len(frame), file=f)
                    yield frame

            return super().handleInputRows(key, counted(), timerValues)

    before, whole = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), state._Throttle
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200")
    state._Throttle = Counted
    try:
        out = streaming.stream_throttle(event_stream(spark, path, "*.parquet"), "entity_id", 100, "1 hour")
        got = sorted(r.event_id for r in drain(out, "t").collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        state._Throttle = whole
    assert got == sorted(throttled(times, 100))
    seen = [int(x) for x in sizes.read_text().split()]
    assert sum(seen) >= 3000 and max(seen) <= 200


def test_frequency_as_in_the_batch_form(spark):
    path = shared_dir(spark, "t")
    rows = [(i, (i * 37) % 900, i % 3, "error", 1.0) for i in range(150)]
    for part in range(3):
        put(spark, path, rows[part::3])
    put(spark, path, [CLOSING])
    out = streaming.stream_frequency(event_stream(spark, path, "*.parquet"), "entity_id", 4, 60, "1 hour", slice_s=20)
    got = {(r.event_id, r.burst_start) for r in drain(out, "t").collect()}
    batch = frequency_rule(v.canonical(events(spark, rows)).withColumn("ts", F.col("ts").cast("timestamp")), "entity_id", 4, 60)
    assert got == {(r.event_id, r.burst_start) for r in batch.collect()} and got


def test_correlation_keeps_events_and_no_pairs(spark):
    path = shared_dir(spark, "t")
    n = 10_000
    rows = [(i, (i * 7919) % 20_000, 1, "signup" if i < n else "error", 1.0) for i in range(2 * n)]
    put(spark, path, rows[::2])
    put(spark, path, rows[1::2])
    put(spark, path, [(10**6, 10**8, 9, "signup", 1.0), (10**6 + 1, 10**8, 9, "error", 1.0)])
    stream = event_stream(spark, path, "*.parquet")
    of = lambda kind: stream.filter(F.col("category") == kind)
    out = streaming.stream_correlate(of("signup"), of("error"), "entity_id", 3600, "1 day")
    got = {r.effect_id: (r.n_causes, r.cause_id) for r in drain(out, "t").collect()}
    seconds = {i: t for i, t, *_ in rows}
    causes = sorted((seconds[i], i) for i in range(n))
    times = [c[0] for c in causes]
    want = {}
    for i in range(n, 2 * n):
        low, high = bisect_left(times, seconds[i] - 3600), bisect_left(times, seconds[i])
        if high > low:
            want[i] = (high - low, causes[high - 1][1])
    assert got == want
    # Chunks and counts, not the 3,600 causes of each of the 10,000 effects.
    query = out.writeStream.format("memory").queryName("correlated").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert 0 < max(op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]) < 3 * 2 * n


def test_late_rows_go_aside(spark):
    path, out, ckpt = (shared_dir(spark, "t") for _ in range(3))
    put(spark, path, [(1, 0, 1, "error", 1.0), (2, 1000, 1, "error", 1.0)])
    put(spark, path, [(3, 899, 1, "error", 1.0), (4, 900, 1, "error", 1.0), (5, 2000, 1, "error", 1.0)])
    split = lambda: streaming.split_late(event_stream(spark, path, "*.parquet"), out, ckpt, 100).awaitTermination()
    split()
    # A restart goes on from the stored highest time.
    put(spark, path, [(6, 1899, 1, "error", 1.0), (7, 1900, 1, "error", 1.0)])
    split()
    got = {r.event_id: bool(r.late) for r in spark.read.parquet(f"{out}/rows").withColumn("late", F.col("late").cast("boolean")).collect()}
    assert got == {1: False, 2: False, 3: True, 4: False, 5: False, 6: True, 7: False}


def test_upsert_survives_restart_and_repetition(spark):
    path, out, ckpt = (shared_dir(spark, "t") for _ in range(3))
    order = ["ts", "event_id"]
    stream = lambda: event_stream(spark, path, "*.parquet").select("entity_id", "event_id", "ts", "category")
    run = lambda to=ckpt: streaming.stream_upsert(stream(), out, to, "entity_id", order, buckets=4).awaitTermination()
    now = lambda: {r.entity_id: r.event_id for r in streaming.current_table(spark, out).collect()}
    put(spark, path, [(1, 0, 1, "view", 1.0), (2, 5, 2, "view", 1.0), (5, 5, None, "view", 1.0)])
    run()
    put(spark, path, [(3, 9, 1, "view", 1.0), (4, 1, 2, "view", 1.0), (6, 7, None, "view", 1.0), (7, 7, None, "view", 1.0)])
    run()
    run()
    want = {1: 3, 2: 2, None: 7}
    assert now() == want
    # All batches once more, as after the loss of the checkpoint.
    run(shared_dir(spark, "t"))
    assert now() == want
    assert streaming.current_table(spark, out).count() == 3


def test_upsert_rewrites_the_buckets_of_a_batch_only(spark):
    path, out, ckpt = (shared_dir(spark, "t") for _ in range(3))
    run = lambda: streaming.stream_upsert(
        event_stream(spark, path, "*.parquet").select("entity_id", "event_id", "ts"), out, ckpt, "entity_id", ["ts", "event_id"], 16
    ).awaitTermination()
    files = lambda: {r.f for r in spark.read.parquet(out).select(F.col("_metadata.file_path").alias("f")).distinct().collect()}
    put(spark, path, [(i, i, i, "view", 1.0) for i in range(200)])
    run()
    before = files()
    for i in range(3):
        put(spark, path, [(1000 + i, 1000 + i, 7, "view", 1.0)])
        run()
    after = files()
    # One file per bucket, however many batches there were; all but one are those of the first batch.
    assert len(after) == len(before) and len(after - before) == 1
    assert {r.entity_id: r.event_id for r in spark.read.parquet(out).collect()} == {**{i: i for i in range(200)}, 7: 1002}


def test_leaders_of_a_window_within_the_stated_error(spark):
    path = shared_dir(spark, "t")
    rows = [(i, i % 3000, 1 if i % 3 == 0 else 2 if i % 4 == 1 else 10 + i, "view", 1.0) for i in range(3000)]
    put(spark, path, rows[:1500])
    put(spark, path, rows[1500:] + [(9000, 10, None, "view", 1.0)])
    put(spark, path, [CLOSING])
    top = lambda tracked: {
        r.src: (r.about, r.error, r.n_events)
        for r in drain(streaming.stream_top_talkers(event_stream(spark, path, "*.parquet"), "1 hour", "1 minute", 2, tracked=tracked), "t").collect()
    }
    true = {s: sum(r[2] == s for r in rows) for s in (1, 2)}
    # More sources than the sketch tracks: about, with a bound.
    small = top(64)
    assert set(small) == {1, 2} and all(abs(small[s][0] - true[s]) <= small[s][1] < 200 for s in small)
    # All sources tracked: exact.
    large = top(4096)
    assert {s: r[0] for s, r in large.items()} == true and all(r[2] == 3000 for r in large.values())


def test_a_kept_model_scores_a_stream(spark):
    rows = spark.createDataFrame([("a", 1.0, 5.0), ("a", 3.0, 5.0), ("b", 5.0, None), ("b", 7.0, 5.0)], "site string, magnitude double, flat double")
    model = detect.federated_model(rows, "site", ["magnitude", "flat"])
    kept = shared_dir(spark, "model")
    model.write.parquet(kept)
    path = shared_dir(spark, "t")
    put(spark, path, [(1, 0, 1, "view", 4.0), (2, 0, 1, "view", 8.0), (3, 0, 1, "view", None)])
    stream = event_stream(spark, path, "*.parquet").select("event_id", "magnitude", F.lit(2.0).alias("flat"))
    got = {r.event_id: (r.score, r.z_flat) for r in drain(detect.score_by(stream, spark.read.parquet(kept)), "t").collect()}
    sd = (20 / 3) ** 0.5
    assert got[1] == (0.0, None) and abs(got[2][0] - 4 / sd) < 1e-12 and got[3] == (None, None)
    batch = detect.federated_score(rows.select("site", "magnitude"), "site", ["magnitude"]).select("magnitude", "score")
    again = detect.score_by(rows.select("magnitude"), model.filter("feature = 'magnitude'")).select("magnitude", "score")
    rounded = lambda df: sorted((r.magnitude, round(r.score, 9)) for r in df.collect())
    assert rounded(batch) == rounded(again)


def test_bounded_batches_keep_all_lines(spark):
    src, out, ckpt = (shared_dir(spark, "t") for _ in range(3))
    spark.range(90).select(F.col("id").cast("string").alias("value")).repartition(9).write.text(src)
    from wardline.sources import ingest_lines

    q = ingest_lines(spark, src, out, ckpt, max_files=2)
    q.awaitTermination()
    assert len([p for p in q.recentProgress if p.numInputRows]) == 5
    assert spark.read.parquet(out).distinct().count() == 90


def test_routes_are_folders(spark, sf):
    from wardline.sources import write_routed

    path = shared_dir(spark, "t")
    routed = QUERIES["route"](spark, sf)
    write_routed(routed, path)
    assert spark.read.parquet(path).groupBy("route").count().exceptAll(routed.groupBy("route").count()).isEmpty()


def test_stream_forms_equal_batch_forms(spark, sf):
    pairs = QUERIES["stream_correlate"](spark, sf)
    batch = QUERIES["correlate_pairs"](spark, sf)
    assert pairs.count() > 0 and pairs.exceptAll(batch).isEmpty() and batch.exceptAll(pairs).isEmpty()


def test_windows_leave_the_state(spark):
    path = shared_dir(spark, "t")
    for day in range(6):
        put(spark, path, [(10 * day + i, 86400 * day + 3600 * i, 1, "error", 1.0) for i in range(3)])
    out = streaming.stream_tumbling(event_stream(spark, path, "*.parquet"), "1 day", "1 hour")
    run = (
        out.writeStream.format("noop").outputMode("append").option("checkpointLocation", shared_dir(spark, "t-ckpt"))
        .trigger(availableNow=True).start()
    )
    run.awaitTermination()
    kept = [p.stateOperators[0].numRowsTotal for p in run.recentProgress if p.stateOperators]
    assert len(kept) >= 6 and max(kept) <= 2


def test_a_stream_without_input_gives_no_rows(spark):
    path = shared_dir(spark, "t")
    put(spark, path, [(1, 0, 1, "error", 1.0)])
    out = drain(event_stream(spark, path, "none*.parquet"), "t")
    assert out.count() == 0 and "entity_id" in out.columns


def test_unknown_indicators_are_queued_once(spark):
    path = shared_dir(spark, "t")
    put(spark, path, [(1, 0, 1, "error", 1.0), (2, 1, 2, "error", 1.0), (3, 2, 2, "error", 1.0), (4, 3, None, "error", 1.0)])
    put(spark, path, [(5, 4, 2, "error", 1.0), (6, 5, 3, "error", 1.0)])
    feed = spark.createDataFrame([(1,), (1,), (None,)], "entity_id long")
    out = streaming.stream_unmatched_iocs(event_stream(spark, path, "*.parquet"), feed, ["entity_id"], "1 day")
    assert sorted(r.entity_id for r in drain(out, "t").collect()) == [2, 3]
