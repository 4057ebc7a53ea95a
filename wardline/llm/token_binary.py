"""Token ids as a concatenated array with Elias-Fano coded document boundaries.

The output is a folder of blocks in ascending document order, as Parquet rows (part, seq, n_docs, n_ids,
doc_ids, data): Parquet gives the safe writes and the listing, `data` is the format.  Layout of `data`, little
endian: magic "EFT1", bytes of an id (2 or 4) u8, then the Elias-Fano sequence of the documents' ends, then
the ids.  A block has whole documents and stands alone.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import DataType

from wardline.llm import elias_fano, words as W
from wardline.llm.common import once, require
from wardline.operators.sizing import checked_broadcast

_MAGIC = b"EFT1"
#: A block ends after the document with which it has this many ids.
BLOCK_IDS = 2_000_000
#: Words whose ids a task keeps at most.
KEPT_WORDS = 1_500_000

#: Encodes texts: (ids one after another, number of ids of each text).
Encode = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


class CachedWords:
    """Ids of documents whose tokenizer never joins text across the given separators.

    Texts are cut at the separators; every distinct piece is encoded once while it is kept.  `white` says
    which bytes separate, `with_gap` whether the separators before a piece belong to it.  After a call
    `sizes_of` has the number of ids of each piece and `docs_of` the first piece of each document.
    """

    def __init__(self, encode: Encode, white: np.ndarray, with_gap: bool = False):
        self.encode, self.white, self.with_gap = encode, white, with_gap
        self._reset()

    def _reset(self) -> None:
        self.hashes = np.empty(0, np.uint64)
        self.at = np.empty(0, np.int64)
        self.sizes = np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        ids, sizes = self.encode(pieces)
        if len(self.hashes) + len(hashes) > KEPT_WORDS:
            self._reset()
        self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(sizes) - sizes])
        self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])
        self.hashes = np.concatenate([self.hashes, hashes])
        self.sizes = np.concatenate([self.sizes, sizes])
        # Two sorted runs, which a stable sort merges.
        order = np.argsort(self.hashes, kind="stable")
        self.hashes, self.at, self.sizes = self.hashes[order], self.at[order], self.sizes[order]

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each document."""
        starts, ends, docs = W.word_spans(data, offsets, self.white)
        if self.with_gap and len(offsets) > 1:
            # A piece begins where the one before it ends, or with its document; the end of a text may be a gap.
            first = np.concatenate([docs[:-1][np.diff(docs) > 0]])
            starts = np.concatenate([[0], ends[:-1]]) if len(ends) else starts
            starts[first] = offsets[:-1][np.diff(docs) > 0]
            tail = np.where(np.diff(docs) > 0, ends[np.maximum(docs[1:] - 1, 0)] if len(ends) else 0, offsets[:-1])
            more = np.flatnonzero(tail < offsets[1:])
            order = np.argsort(np.concatenate([starts, tail[more]]), kind="stable")
            starts = np.concatenate([starts, tail[more]])[order]
            ends = np.concatenate([ends, offsets[1:][more]])[order]
            docs = np.searchsorted(starts, offsets)
        hashes = W.span_hashes(data, starts, ends, fold=False)
        unique, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.hashes, unique)
        known = place < len(self.hashes)
        known[known] = self.hashes[place[known]] == unique[known]
        if not known.all():
            # If the cache would overflow, it starts again with all pieces of these texts.
            new = np.ones_like(known) if len(self.hashes) + int((~known).sum()) > KEPT_WORDS else ~known
            raw = data.tobytes()
            self._learn(unique[new], [raw[a:b].decode() for a, b in zip(starts[first[new]], ends[first[new]])])
            place = np.searchsorted(self.hashes, unique)
        place = place[back]
        sizes = self.sizes[place]
        self.sizes_of, self.docs_of = sizes, docs
        total = np.concatenate([[0], np.cumsum(sizes)])
        return self.ids[W.ragged(self.at[place], sizes)], np.diff(total[docs])


def _block(part: int, seq: int, doc_ids: list, ids: list[np.ndarray], sizes: np.ndarray, width: int, id_type: pa.DataType) -> pa.RecordBatch:
    ids = np.concatenate(ids) if ids else np.empty(0, np.uint32)
    data = _MAGIC + bytes([width]) + elias_fano.encode(np.cumsum(sizes)) + ids.astype(f"<u{width}").tobytes()
    values = pa.concat_arrays(doc_ids)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([part], pa.int32()),
            pa.array([seq], pa.int32()),
            pa.array([len(sizes)], pa.int64()),
            pa.array([len(ids)], pa.int64()),
            pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(id_type)),
            pa.array([data], pa.binary()),
        ],
        names=["part", "seq", "n_docs", "n_ids", "doc_ids", "data"],
    )


def _encoder(make: Callable[[], CachedWords], end_id: int, width: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seq = make(), TaskContext.get().partitionId(), 0
        doc_ids, ids, sizes, total = [], [], [], 0
        for whole in batches:
            for batch in W.slices(whole, "text"):
                data, offsets = W.column_bytes(batch.column(1))
                got, n = encode(data, offsets)
                # The end id after each document.
                n = n + 1
                ends = np.cumsum(n) - 1
                every = np.empty(int(n.sum()), np.uint32)
                every[ends] = end_id
                inside = np.ones(len(every), bool)
                inside[ends] = False
                every[inside] = got
                if width == 2 and len(every) and every.max() > 0xFFFF:
                    raise ValueError("an id needs more than two bytes")
                doc_ids.append(batch.column(0))
                ids.append(every)
                sizes.append(n)
                total += len(every)
                if total >= block_ids:
                    yield _block(part, seq, doc_ids, ids, np.concatenate(sizes), width, batch.column(0).type)
                    doc_ids, ids, sizes, total, seq = [], [], [], 0, seq + 1
        if sizes:
            yield _block(part, seq, doc_ids, ids, np.concatenate(sizes), width, doc_ids[0].type)

    return run


def write(docs: DataFrame, path: str, make: Callable[[], CachedWords], end_id: int, vocabulary: int, doc_id: str = "doc_id", text: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Encode whole texts and write them to `path` in ascending order of id; a null text counts as empty.

    `make` makes the encoder in a task.  Rows that repeat an id follow one another; null ids come first.
    """
    docs = require(docs, doc_id, text).toDF("id", "text").withColumn("tie", F.monotonically_increasing_id())
    width = 2 if max(vocabulary, end_id + 1) <= 1 << 16 else 4
    schema = f"part int, seq int, n_docs long, n_ids long, doc_ids array<{docs.schema['id'].dataType.simpleString()}>, data binary"
    ordered = docs.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    ordered.mapInArrow(_encoder(make, end_id, width, block_ids), schema).write.parquet(path)


def parse(data: bytes) -> tuple[elias_fano.EliasFano, np.ndarray]:
    """The documents' ends and the ids of a block."""
    if data[:4] != _MAGIC:
        raise ValueError("not a token block")
    view = memoryview(data)[5:]
    ends = elias_fano.EliasFano(view)
    return ends, np.frombuffer(view, f"<u{data[4]}", offset=ends.size)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in batches:
        for base, doc_ids, data in zip(t.column("base").to_pylist(), t.column("doc_ids"), t.column("data")):
            ends, ids = parse(data.as_py())
            # Where a document ends and the one before it does, by select.
            to = ends.select_many(np.arange(len(ends)))
            at = np.concatenate([[0], to[:-1]])
            wide = ids.astype("<u4")
            crc = [zlib.crc32(wide[a:b]) for a, b in zip(at, to)]
            yield pa.RecordBatch.from_arrays(
                [doc_ids.values, pa.array(base + at), pa.array(to - at), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
            )


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks in `path` with `base`, the number of ids before each."""
    every = spark.read.parquet(path)
    # Sums per part first, so that only one row per part, and not per block, meets in one task.
    parts = every.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    seqs = every.select("part", "seq", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("inside"))
    bases = seqs.join(parts, "part").select("part", "seq", (F.col("before") + F.col("inside")).alias("base"))
    # A few bytes for each block of millions of ids: while these are few, the blocks stay where they are.
    return every.join(checked_broadcast(bases), ["part", "seq"])


def read_index(spark: SparkSession, path: str, id_type: DataType | str = "long") -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, and the crc32 of its ids as 32-bit integers."""
    name = id_type if isinstance(id_type, str) else id_type.simpleString()
    return blocks(spark, path).select("base", "doc_ids", "data").mapInArrow(_read, f"doc_id {name}, start long, n_tokens long, ids_crc32 long")


def _word_encoder(file: str) -> CachedWords:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(file)

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = []
        for x in range(0, len(texts), 20_000):
            ids += [e.ids for e in tokenizer.encode_batch_fast(texts[x : x + 20_000], add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes

    white = np.zeros(256, bool)
    white[[0x20, 0x0A]] = True
    return CachedWords(encode, white)


def word_tokenizer(file: str) -> Callable[[], CachedWords]:
    """A maker for a tokenizer file whose pieces never reach across a space or a line end."""
    return lambda: once(("words", file), lambda: _word_encoder(file))
