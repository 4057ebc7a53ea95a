"""The pipeline's stages, each against what its operator says of the same input."""

import time
import tracemalloc

import corpus_pipeline as cp
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from test_operators import brute_components, shingle_set
from wardline.llm import common, ngram_join, pfair, pieces, quality_bayes, quality_rules
from wardline.llm.common import saved


def test_stages_follow_their_operators(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    one = saved(cp.classified(spark, docs, sf), "one")
    assert ids(one) == ids(quality_bayes.classify(docs, labels).where("kept")) and one.columns == docs.columns
    two = saved(cp.ruled(spark, one, sf), "two")
    assert ids(two) == ids(quality_rules.judge(one, labels).where("kept")) and two.columns == docs.columns
    three = saved(cp.deduplicated(spark, two, sf), "three")
    rows = [(r.doc_id, shingle_set(r.text)) for r in two.collect()]
    linked = lambda i, j: bool(rows[i][1] and rows[j][1]) and 100 * len(rows[i][1] & rows[j][1]) >= 80 * len(rows[i][1] | rows[j][1])
    assert ids(three) == set(brute_components([r[0] for r in rows], linked)) and three.columns == docs.columns
    four = saved(cp.mixed(spark, three, sf), "four")
    order = [r.doc_id for r in pfair.mix(three, cp.WEIGHTS, cp.REST).orderBy("slot", "place").collect()]
    assert [r.doc_id for r in four.coalesce(1).collect()] == order and four.columns == docs.columns
    five = cp.encoded(spark, four, sf)
    assert sorted(five.collect()) == sorted(pieces.encode(four, cp.PIECES_FILE).collect())


def test_odd_documents_pass_through(spark, sf):
    rows = [(None, None, None, None, None), (1, "", "en", "src0", 0), (1, "a " * 80, None, "src0", 5), (2, "b", "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (docs, docs.limit(0)):
        for name, stage in cp.STAGES:
            docs = saved(stage(spark, docs, sf), name)
        assert docs.count() >= 0


def _stored(spark, rows):
    return saved(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "stored")


def test_one_row_of_each_group_of_near_copies_stays(spark, sf):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(4, text), (4, text), (9, text + " extra"), (9, "other words here"), (None, text), (None, "alone in the world"), (7, None), (7, None)]
    docs = _stored(spark, [(i, t, "en", "src0", 0) for i, t in rows])
    left = [(r.doc_id, r.text) for r in cp.deduplicated(spark, docs, sf).collect()]
    assert sorted(left, key=str) == sorted([(4, text), (9, "other words here"), (None, "alone in the world"), (7, None), (7, None)], key=str)


def test_rows_that_share_an_id_are_judged_and_placed_apart(spark, sf):
    good = " ".join(f"word{i} stands" for i in range(80))
    for i, stay in ((None, 2), (5, 2)):
        docs = _stored(spark, [(i, good, "en", "src0", 0), (i, "too short", "en", "src0", 0), (i, good + " too", None, "src1", 0)])
        left = cp.ruled(spark, docs, sf).collect()
        assert sorted(r.text for r in left) == [good, good + " too"] and len(left) == stay
        placed = cp.mixed(spark, docs, sf).collect()
        assert sorted(r.text for r in placed) == sorted(r.text for r in docs.collect())
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    verdict = quality_bayes.classify(docs.select(*[F.lit(None).cast("long").alias(c) if c == "doc_id" else c for c in docs.columns]), spark.read.parquet(f"{sf}/labels.parquet"))
    assert verdict.where("kept").count() == docs.count()
    # Half of the rows lose their id; the verdict of each is the one of its own text, source and language.
    half = saved(docs.withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id"))), "half")
    kept = cp.classified(spark, half, sf)
    rows = cp._numbered(half)
    verdict = quality_bayes.classify(rows, spark.read.parquet(f"{sf}/labels.parquet"), row="row")
    assert verdict.where("not kept and doc_id is null").count() and kept.where("doc_id is null").count()
    want = rows.join(verdict.where("kept").select("row"), "row").select("text")
    assert sorted(r.text for r in kept.select("text").collect()) == sorted(r.text for r in want.collect())


def test_encoding_holds_a_part_of_a_batch_at_a_time():
    rng = np.random.default_rng(3)
    words = ["".join(map(chr, rng.integers(97, 123, 7))) for _ in range(300_000)]
    texts = [" ".join(words[i : i + 500]) for i in range(0, len(words), 500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["id", "text"])
    run = pieces._encoded(cp.PIECES_FILE, 1, False)
    list(run(iter([batch.slice(0, 1)])))
    tracemalloc.start()
    ids, peak = [], 0
    for out in run(iter([batch])):
        ids += out.column(0).to_pylist()
        peak = max(peak, tracemalloc.get_traced_memory()[1])
    tracemalloc.stop()
    assert ids == list(range(len(texts)))
    # Numpy's arrays, texts and lists, without the two libraries' own.
    assert peak < 70 << 20, peak >> 20


def test_batches_for_python_are_bounded_on_any_session(spark, sf):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    try:
        spark.conf.set(name, "64m")
        out = cp.encoded(spark, docs, sf)
        assert spark.conf.get(name) == cp.BATCH_BYTES and out.columns[0] == "doc_id"
        assert all(hasattr(stage, "__wrapped__") for _, stage in cp.STAGES)
    finally:
        spark.conf.set(name, before)


def test_the_schedule_stands_in_the_plan(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source")
    # Python's rows would be read by Python workers of their own.
    for task_rows in (pfair.TASK_ROWS, 1):
        placed = pfair.place(docs.unionAll(docs), cp.WEIGHTS, cp.REST, "doc_id", "source", pfair.BLOCK_ROWS, task_rows)
        assert "ExistingRDD" not in placed._jdf.queryExecution().toString()
        assert placed.count() == 2 * docs.count()


def test_a_worker_gives_up_what_no_task_has_asked_for():
    made = []
    make = lambda: made.append(1) or len(made)
    run = common.lean(lambda batches: ((common.once("a", make), b)[1] for b in batches))
    kept = common._held()
    kept["b"] = 0, time.monotonic() - common.HELD_S - 1
    assert list(run(iter([1, 2]))) == [1, 2] and list(run(iter([3]))) == [3]
    assert made == [1] and "a" in kept and "b" not in kept
    kept["a"] = 1, time.monotonic() - common.HELD_S - 1
    assert list(run(iter([4]))) == [4] and made == [1, 1]
    # What a long task uses is held for the one after it.
    for b in run(iter([5])):
        kept["a"] = kept["a"][0], time.monotonic()
    assert time.monotonic() - kept.pop("a")[1] < 1


def test_pairs_of_pages_do_not_depend_on_batches():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 63, 60).astype(np.uint64)) for _ in range(6)]
    sets = [np.unique(np.concatenate([s[i % 7 :], rng.integers(0, 1 << 63, i % 3).astype(np.uint64)])) for i, s in enumerate(sets * 20)]
    n, node = np.array([len(s) for s in sets]), np.arange(len(sets))
    vec = [ngram_join._vector(s, 56, ngram_join.GROUPS) for s in sets]
    points = pa.RecordBatch.from_arrays([pa.array(np.repeat([3, 4], len(n))), *[pa.array(np.tile(x, 2)) for x in (n, node, node)], pa.array(vec * 2, pa.binary())], names=["cell", "n", "node", "comp", "vec"])
    # The two cells have the same points, so that every pair comes twice.
    pages = [r for x in range(0, points.num_rows, 20) for t in ngram_join._pages(iter([points.slice(x, 20)])) for r in t.to_pylist()]
    both = lambda a, b: {f"{k}_{s}": v for s, r in (("a", a), ("b", b)) for k, v in {**r, "min": r["n_min"], "max": r["n_max"]}.items()}
    two = pa.RecordBatch.from_pylist([both(a, b) for i, a in enumerate(pages) for b in pages[i:] if a["cell"] == b["cell"]])
    for best in (True, False):
        out = [[r for t in ngram_join._page_pairs(80, best)(iter(parts)) for r in map(tuple, (x.values() for x in t.to_pylist()))] for parts in ([two], [two.slice(i, 1) for i in range(two.num_rows)])]
        assert out[0] and len(set(out[0])) == len(out[0]) and out[0] == out[1]
