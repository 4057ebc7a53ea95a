"""Cross-entropy difference of a target and a background language model.

Both are bigram models over one vocabulary, the words of all documents and one unknown word.  The target model
counts the target documents, the background model all documents; background counts are scaled to the target's
number of words, so the two are matched.  A document's score is the mean over its words of the target's loss
less the background's: the lower, the more like the target.  A document's own counts are taken out of both
models before it is scored, or those that the target model has seen would win by that alone.

Every word and every pair of words is counted under a key of its own, a 63-bit hash, so the models grow with the
input and lie in no one place.  The n-grams in most documents of a sample, a list of fixed length, are counted in
each task, and their sums go to all tasks.  Every other n-gram of a document is an entry of a bucket, which its key
names; the bucket adds up the entries of a key and sends each document its counts.  The list decides only which
way a count takes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from wardline.llm import words as W
from wardline.llm.common import require, saved
from wardline.operators.sizing import checked_broadcast

U = np.uint64
#: N-grams that are counted in each task, and the bytes of text that they are found in, about.
NAMED, SAMPLE_BYTES = 1 << 18, 32 << 20
#: Bytes of text for each bucket of the other n-grams, and the number of buckets at least.
BUCKET_BYTES, BUCKETS = 8 << 20, 64
#: Named n-grams whose sums are added up together.
RANGE = 1024
#: Pseudo-counts of the unigram model in every context.
STRENGTH = 50.0
_PARTS = "kind int, bucket long, block long, at int, a binary, b binary, c binary"


class Grams:
    """The distinct words and pairs of each document of a column; `word`, `pair` and `context` name the entry of each word.

    Keys of words are even, those of pairs odd.  Entries are in order of document and key.  `context` is -1 at the
    start of a document.  `place` is an entry's place among the named keys, or -1; `other` are the entries without one.
    """

    def __init__(self, column: pa.Array, named: np.ndarray):
        data, offsets = W.column_bytes(column)
        starts, ends, self.docs = W.word_spans(data, offsets)
        hashes = W.span_hashes(data, starts, ends)
        self.n = np.diff(self.docs)
        doc = np.repeat(np.arange(len(self.n)), self.n)
        first = self.docs[:-1][self.n > 0]
        before = np.empty_like(hashes)
        before[1:] = hashes[:-1]
        before[first] = 0
        pairs = W.mix(W.mix(before) * U(0x9E3779B97F4A7C15) + hashes)
        keys = np.concatenate([hashes & ~U(1), pairs | U(1)])
        docs = np.concatenate([doc, doc])
        order = np.lexsort((keys, docs))
        keys, docs = keys[order], docs[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
        entry = np.empty(len(keys), np.int64)
        entry[order] = np.cumsum(new) - 1
        self.word, self.pair = entry[: len(doc)], entry[len(doc) :]
        self.context = np.empty_like(self.word)
        self.context[1:] = self.word[:-1]
        self.context[first] = -1
        self.key, self.doc = keys[new], docs[new]
        self.count = np.diff(np.append(np.flatnonzero(new), len(keys)))
        self.place = np.full(len(self.key), -1)
        if len(named):
            at = np.minimum(np.searchsorted(named, self.key), len(named) - 1)
            self.place = np.where(named[at] == self.key, at, -1)
        self.other = np.flatnonzero(self.place < 0)
        #: First of the other entries of each document.
        self.others = np.searchsorted(self.doc[self.other], np.arange(len(self.n)))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with the block of a few megabytes that they lie in, their place in it, and their bytes."""
    block = TaskContext.get().partitionId() << 32
    for whole in batches:
        for t in W.slices(whole, "text"):
            sizes = np.diff(W.column_bytes(t.column("text"))[1])
            added = [pa.array(np.full(t.num_rows, block, np.int64)), pa.array(np.arange(t.num_rows, dtype=np.int32)), pa.array(sizes)]
            yield pa.RecordBatch.from_arrays([*added, *t.columns], names=["block", "at", "bytes", *t.schema.names])
            block += 1


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one block after another; a block may come in several runs."""
    for whole in batches:
        block = whole.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for x, y in zip(cuts, cuts[1:]):
            if y > x:
                yield whole.slice(x, y - x)


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each n-gram."""
    for whole in batches:
        for t in W.slices(whole, "text", 16 << 20):
            key, n = np.unique(Grams(t.column("text"), np.empty(0, U)).key, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on, in as few bytes each as the largest needs; the first byte says how many."""
    size = next(x for x in (1, 2, 4, 8) if not len(values) or int(values.max()) >> (8 * x) == 0)
    return bytes([size]) + values.astype(f"u{size}").tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, f"u{blob[0]}", offset=1).astype(np.int64)


def _part(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=["kind", "bucket", "block", "at", "a", "b", "c"])


def _counted(named: np.ndarray, buckets: int):
    """Of each task: sums of words and documents (kind 0), of ranges of the named n-grams (1), and entries of buckets (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, len(named)), np.int64)
        totals = np.zeros(4, np.int64)
        for t in _runs(batches):
            grams = Grams(t.column("text"), named)
            target = t.column("target").to_numpy(zero_copy_only=False).astype(bool)
            some = grams.n > 0
            totals += [grams.n.sum(), grams.n[target].sum(), some.sum(), (some & target).sum()]
            of_target = target[grams.doc]
            for side, chosen in enumerate((grams.place >= 0, (grams.place >= 0) & of_target)):
                np.add.at(sums[side], grams.place[chosen], grams.count[chosen])
            key = grams.key[grams.other]
            bucket = ((key >> U(24)) % U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            key = key[order]
            # The order keeps places rising within a bucket, so their steps are small.
            own = (grams.count[grams.other] * 2 + of_target[grams.other])[order]
            block, at = t.column("block")[0].as_py(), t.column("at")[0].as_py()
            rows = [
                (2, i, block, at, key[x:y].tobytes(), _packed(np.diff(order[x:y], prepend=0)), _packed(own[x:y]))
                for i, (x, y) in enumerate(zip(cuts.tolist(), cuts[1:].tolist()))
                if y > x
            ]
            if rows:
                yield _part(rows)
        yield _part([(0, 0, 0, 0, totals.tobytes(), b"", b"")])
        for x in range(0, len(named), RANGE):
            part = sums[:, x : x + RANGE]
            if part.any():
                yield _part([(1, x // RANGE, 0, 0, part[0].tobytes(), part[1].tobytes(), b"")])

    return run


def _added(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """Sums of a kind and bucket.  A bucket has a row for each part of a block, with the counts that others than the
    document have of its entries, where there are any, and one with the number of its distinct words (kind 3)."""
    kind, bucket = (x.as_py() for x in key)
    blob = lambda name, of: [np.frombuffer(x, of) for x in rows.column(name).to_pylist()]
    if kind < 2:
        a, b = (sum(blob(name, np.int64)) for name in ("a", "b"))
        out = [(kind, bucket, 0, 0, a.tobytes(), b.tobytes(), b"")]
    else:
        parts, own = blob("a", U), np.concatenate([_unpacked(x) for x in rows.column("c").to_pylist()])
        distinct, back = np.unique(np.concatenate(parts), return_inverse=True)
        target = own & 1
        own >>= 1
        counts = []
        for weight in (own, own * target):
            total = np.zeros(len(distinct), np.int64)
            np.add.at(total, back, weight)
            counts.append(total[back] - weight)
        cuts = np.cumsum([0, *map(len, parts)]).tolist()
        out = [(3, bucket, int((distinct & U(1) == 0).sum()), 0, b"", b"", b"")]
        for block, at, steps, x, y in zip(*(rows.column(c).to_pylist() for c in ("block", "at", "b")), cuts, cuts[1:]):
            seen = np.flatnonzero(counts[0][x:y])
            if len(seen):
                steps = np.diff(np.cumsum(_unpacked(steps))[seen], prepend=0)
                out.append((2, bucket, block, at, _packed(steps), _packed(counts[0][x:y][seen]), _packed(counts[1][x:y][seen])))
    return pa.Table.from_batches([_part(out)])


class Models:
    """What all tasks need: the named keys and their counts, the numbers of words and documents, and the vocabulary's size.

    The first of each pair of figures is the background's, the second the target's.
    """

    def __init__(self, named: np.ndarray, sums: np.ndarray, totals: np.ndarray, words: int):
        self.named, self.sums, self.words = named, sums, words
        self.totals, self.starts = totals[:2], totals[2:]
        self.scale = (totals[1] / totals[0] if totals[0] and totals[1] else 1.0), 1.0

    def losses(self, column: pa.Array, target: np.ndarray, answers: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
        """Number of words of each text, and its mean loss in the background and in the target model."""
        grams = Grams(column, self.named)
        firsts = answers.column("at").to_pylist()
        given = [[_unpacked(x) for x in answers.column(c).to_pylist()] for c in ("a", "b", "c")]
        some = np.flatnonzero(grams.n)
        out = []
        for side in (0, 1):
            # Without the document itself, which the target model has counted only if it is a target.
            mine = np.ones(len(grams.n), np.int64) if side == 0 else target.astype(np.int64)
            counts = np.zeros(len(grams.key), np.int64)
            listed = np.flatnonzero(grams.place >= 0)
            counts[listed] = self.sums[side][grams.place[listed]] - grams.count[listed] * mine[grams.doc[listed]]
            for at, steps, n in zip(firsts, given[0], given[1 + side]):
                counts[grams.other[grams.others[at] + np.cumsum(steps)]] = n
            doc = np.repeat(np.arange(len(grams.n)), grams.n)
            scale = self.scale[side]
            every = (self.totals[side] - grams.n * mine)[doc] * scale
            start = (self.starts[side] - mine)[doc]
            context = np.where(grams.context < 0, start, counts[grams.context]) * scale
            unigram = (counts[grams.word] * scale + 1) / (every + self.words + 1)
            loss = -np.log((counts[grams.pair] * scale + STRENGTH * unigram) / (context + STRENGTH))
            mean = np.zeros(len(grams.n))
            if len(some):
                mean[some] = np.add.reduceat(loss, grams.docs[some]) / grams.n[some]
            out.append(mean)
        return grams.n, out


def _scored(models: Models):
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        rows = rows.sort_by("at").combine_chunks()
        text = rows.column("text").combine_chunks() if rows.num_rows else pa.array([], pa.string())
        n, (background, target) = models.losses(text, rows.column("target").to_numpy().astype(bool), answers)
        figures = [pa.array(np.round(x, 9), mask=n == 0) for x in (target, background, target - background)]
        return pa.table([rows.column("id"), pa.array(n), *figures], names=["id", "n_words", "target_loss", "background_loss", "score"])

    return run


def score(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", named: int = NAMED) -> DataFrame:
    """Per row: its id, n_words, target_loss, background_loss and score (their difference), means per word.

    `target` has the ids of the target documents.  All words and pairs of all documents are counted, each on its
    own; `named` of them go to all tasks, which changes no result.  Losses and score are null for a text without
    words.  Rows that repeat an id count each.  Without target documents the target model is uniform.
    """
    rows = require(docs, doc_id, text).toDF("id", "text")
    id_type = rows.schema["id"].dataType.simpleString()
    ids = checked_broadcast(require(target, doc_id).toDF("id").where("id is not null").distinct())
    marked = rows.join(ids.withColumn("target", F.lit(True)), "id", "left").select("id", F.coalesce("target", F.lit(False)).alias("target"), "text")
    # Written once, so that a block has the same rows whenever it is read.
    texts = saved(marked.mapInArrow(_blocks, f"block long, at int, bytes long, id {id_type}, target boolean, text string"), "texts")
    size = texts.agg(F.sum("bytes").alias("n")).first().n or 0
    share = min(1.0, SAMPLE_BYTES / max(size, 1))
    sample = texts.where((F.xxhash64("block", "at") / F.lit(2.0**64) + 0.5) <= share).select("text")
    top = sample.mapInArrow(_frequent, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "key").limit(named)
    known = np.sort(top.select("key").toPandas()["key"].to_numpy(np.int64).view(U))
    buckets = max(BUCKETS, -(-size // BUCKET_BYTES))
    parts = texts.select("block", "at", "target", "text").mapInArrow(_counted(known, buckets), _PARTS)
    added = saved(parts.groupBy("kind", "bucket").applyInArrow(_added, _PARTS), "counts")
    # A row for all, one for each range of the named n-grams, and the sum of the buckets' words.
    totals, sums = np.zeros(4, np.int64), np.zeros((2, len(known)), np.int64)
    for r in added.where("kind < 2").select("kind", "bucket", "a", "b").collect():
        if r.kind == 0:
            totals = np.frombuffer(r.a, np.int64)
        else:
            for side, x in enumerate((r.a, r.b)):
                sums[side][r.bucket * RANGE : (r.bucket + 1) * RANGE] = np.frombuffer(x, np.int64)
    words = (added.where("kind = 3").agg(F.sum("block").alias("n")).first().n or 0) + int((known & U(1) == 0).sum())
    answers = added.where("kind = 2").select("block", "at", "a", "b", "c")
    schema = f"id {id_type}, n_words long, target_loss double, background_loss double, score double"
    both = texts.select("block", "at", "id", "target", "text").groupBy("block").cogroup(answers.groupBy("block"))
    return both.applyInArrow(_scored(Models(known, sums, totals, words)), schema).withColumnRenamed("id", doc_id)
