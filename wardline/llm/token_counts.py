"""Token counts by lookup: nothing but counts leaves a task, and no pre-token is ever shuffled.

A text is cut into pre-tokens that the tokenizer never joins: a run of white space together with the word after
it, and the white space at the end.  Most pre-tokens of a corpus are few distinct ones, so their lengths in tokens
are looked up in two tiers:

* a compact hash table of frequent pre-tokens, the same in all tasks.  It is learned from the heads of a few
  partitions (`HEADS`, `HEAD_BYTES`), has at most `FREQUENT` entries and is broadcast;
* a table that each Python worker fills with what it had to encode, bounded by `KEPT` entries.

What neither has is encoded by the library.  The tables decide the speed only: every length is the library's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wardline.llm import words as W
from wardline.llm.common import once, require

U = np.uint64
#: Entries of the broadcast table: ten bytes each in a table at most half full.
FREQUENT = 1 << 17
#: Partitions whose heads the table is learned from, and the bytes of text read of each.
HEADS, HEAD_BYTES = 16, 4 << 20
#: Pre-tokens whose lengths a worker keeps.
KEPT = 1 << 20
LIMIT = 512
_ASCII_WHITE = np.zeros(256, bool)
_ASCII_WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: White space beyond ASCII, as UTF-8: the tokenizer's pattern takes it for white space, the cuts here do not.
_OTHER_WHITE = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


class Lengths:
    """A hash table from 64-bit hashes to lengths, in two arrays; open addressing, at most half full."""

    def __init__(self, hashes: np.ndarray, lengths: np.ndarray):
        self.n = len(hashes)
        self.bits = max(4, (2 * self.n).bit_length())
        self.keys = np.zeros(1 << self.bits, U)
        self.values = np.full(1 << self.bits, -1, np.int32)
        self.probes = 0
        left, step = np.arange(self.n), 0
        while len(left):
            slot = self._slot(hashes[left], step)
            free = self.values[slot] < 0
            # Of several that want a free slot, the last one written has it.
            self.keys[slot[free]] = hashes[left[free]]
            self.values[slot[free]] = lengths[left[free]]
            left = left[~free | (self.keys[slot] != hashes[left])]
            step += 1
        self.probes = step

    def _slot(self, hashes: np.ndarray, step: int) -> np.ndarray:
        return ((hashes >> U(64 - self.bits)).astype(np.int64) + step) & ((1 << self.bits) - 1)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """The lengths, -1 where a hash is not in the table."""
        out = np.full(len(hashes), -1, np.int64)
        open_ = np.arange(len(hashes))
        for step in range(self.probes):
            slot = self._slot(hashes[open_], step)
            found = (self.values[slot] >= 0) & (self.keys[slot] == hashes[open_])
            out[open_[found]] = self.values[slot[found]]
            # An empty slot ends the search.
            open_ = open_[~found & (self.values[slot] >= 0)]
            if not len(open_):
                break
        return out

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        used = self.values >= 0
        return self.keys[used], self.values[used]


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every pre-token, and the first pre-token of each document (one more entry at the end)."""
    _, ends, docs = W.word_spans(data, offsets, _ASCII_WHITE)
    # White space at the end of a document is a pre-token of its own.
    last = np.where(np.diff(docs) > 0, ends[np.maximum(docs[1:] - 1, 0)] if len(ends) else 0, offsets[:-1])
    ends = np.sort(np.concatenate([ends, offsets[1:][last < offsets[1:]]]))
    starts = np.concatenate([[0], ends[:-1]])[: len(ends)]
    return starts, ends, np.searchsorted(starts, offsets)


def _odd(data: np.ndarray) -> bool:
    raw = data.tobytes()
    return any(w in raw for w in _OTHER_WHITE)


def _tokenizer(file: str):
    """Token counts of texts by the library of the file: tokenizers for .json, sentencepiece for .model."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if file.endswith(".model"):
        raise ValueError("pre-tokens of a .model file are not cut at white space; use a .json file")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(file)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def count(texts: list[str]) -> np.ndarray:
        sizes: list[int] = []
        for x in range(0, len(texts), 10_000):
            sizes += [len(e) for e in tokenizer.encode_batch_fast(texts[x : x + 10_000], add_special_tokens=False)]
        return np.asarray(sizes, np.int64)

    return count


class Counter:
    """Counts tokens of texts through both tiers; `encoded` is the number of pre-tokens that the library had to see."""

    def __init__(self, file: str, kept: int = KEPT):
        self.library = once(("token counts", file), lambda: _tokenizer(file))
        self.kept, self.encoded = kept, 0
        self.cache = Lengths(np.empty(0, U), np.empty(0, np.int64))

    def _encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self.encoded += len(starts)
        raw = data.tobytes()
        return self.library([raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist())])

    def __call__(self, data: np.ndarray, offsets: np.ndarray, frequent: Lengths) -> np.ndarray:
        """Tokens of each text."""
        if _odd(data):
            # Rare white space in the texts: those that have it are encoded whole, without a cut.
            whole = np.array([_odd(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:])])
            sizes = np.zeros(len(whole), np.int64)
            at = np.flatnonzero(whole)
            sizes[at] = self._encode(data, offsets[:-1][at], offsets[1:][at])
            rest = np.flatnonzero(~whole)
            lengths = np.diff(offsets)[rest]
            kept = data[W.ragged(offsets[:-1][rest], lengths)]
            sizes[rest] = self(kept, np.concatenate([[0], np.cumsum(lengths)]), frequent) if len(rest) else 0
            return sizes
        starts, ends, docs = cut(data, offsets)
        hashes = W.span_hashes(data, starts, ends, fold=False)
        sizes = frequent(hashes)
        missed = np.flatnonzero(sizes < 0)
        if len(missed):
            unique, first, back = np.unique(hashes[missed], return_index=True, return_inverse=True)
            known = self.cache(unique)
            new = np.flatnonzero(known < 0)
            if len(new):
                at = missed[first[new]]
                known[new] = self._encode(data, starts[at], ends[at])
                old = self.cache.items() if self.cache.n + len(new) <= self.kept else (unique[:0], known[:0])
                room = new[: self.kept]
                self.cache = Lengths(np.concatenate([old[0], unique[room]]), np.concatenate([old[1], known[room]]))
            sizes[missed] = known[back]
        total = np.concatenate([[0], np.cumsum(sizes)])
        return np.diff(total[docs])


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The most frequent pre-tokens at the head of a partition: hash, count, text."""
    hashes, counts, texts, read = np.empty(0, U), np.empty(0, np.int64), np.empty(0, object), 0
    for batch in (x for whole in batches for x in W.slices(whole, "text", HEAD_BYTES)):
        data, offsets = W.column_bytes(batch.column(batch.schema.get_field_index("text")))
        if read and read + len(data) > HEAD_BYTES or len(data) > HEAD_BYTES:
            break
        read += len(data)
        starts, ends, _ = cut(data, offsets)
        found, first, n = np.unique(W.span_hashes(data, starts, ends, fold=False), return_index=True, return_counts=True)
        raw = data.tobytes()
        more = np.array([raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())] + [None], object)[:-1]
        hashes, at, back = np.unique(np.concatenate([hashes, found]), return_index=True, return_inverse=True)
        texts = np.concatenate([texts, more])[at]
        counts = np.bincount(back, np.concatenate([counts, n]), len(hashes)).astype(np.int64)
    top = np.argsort(-counts, kind="stable")[: FREQUENT // 8]
    columns = [pa.array(hashes[top].view(np.int64)), pa.array(counts[top]), pa.array(list(texts[top]), pa.binary())]
    one = [pa.ListArray.from_arrays(pa.array([0, len(top)], pa.int32()), c) for c in columns]
    yield pa.RecordBatch.from_arrays(one, names=["hash", "n", "text"])


def frequent(docs: DataFrame, file: str, text: str = "text") -> Lengths:
    """The broadcast tier.  A few tasks run, each on the head of its partition, and each returns a bounded row."""
    heads = require(docs, text).toDF("text").mapInArrow(_heads, "hash array<long>, n array<long>, text array<binary>")
    seen: dict[int, list] = {}
    for row in heads.limit(HEADS).collect():
        for h, n, t in zip(row.hash, row.n, row.text):
            seen.setdefault(h, [0, t])[0] += n
    top = sorted(seen.items(), key=lambda x: (-x[1][0], x[0]))[:FREQUENT]
    lengths = _tokenizer(file)([bytes(t).decode() for _, (_, t) in top])
    return Lengths(np.array([h for h, _ in top], np.int64).view(U), lengths)


def _count(file: str, table, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, first = once(("counter", file), lambda: Counter(file)), table.value
        for whole in batches:
            for batch in W.slices(whole, "text"):
                data, offsets = W.column_bytes(batch.column(1))
                n = counter(data, offsets, first)
                sizes = np.diff(offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"]
                )

    return run


def count_tokens(docs: DataFrame, file: str, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Per row of `docs`: its id, n_bytes (UTF-8), n_tokens as the library of `file` gives them, and over_limit.

    Without begin, end or padding; a special token's string inside a text is that token, as the library has it by
    default.  A null or empty text has no bytes and no tokens.  Rows are independent: null and repeated ids keep a
    row each, an empty table gives none, and extra columns are left out.  A very long text is taken alone and is
    never cut but at white space.  `file` is a byte-level BPE of the tokenizers library whose pattern splits before
    white space and that adds no prefix.
    """
    spark = docs.sparkSession
    rows = require(docs, doc_id, text).toDF("id", "text")
    table = spark.sparkContext.broadcast(frequent(docs, file, text))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_count(file, table, limit), f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.select(F.col("id").alias(doc_id), "n_bytes", "n_tokens", "over_limit")
