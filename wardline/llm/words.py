"""Words, shingles and their hashes over whole Arrow text columns, with numpy instead of a loop per word.

A word's hash is the polynomial sum of a random 64-bit value per byte.  All sums of a block of text come
from one running sum: the part of a word is a difference of two of its values, moved to the same power by
the inverse of the odd base.  Two words have the same hash with a chance of about 2^-60.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from wardline.llm.common import once

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(74).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _FOLDED[97:123]
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
_SPAN = 1 << 19
#: Bytes of text at a time, about, where the memory of a worker counts; its arrays take many times as much.
SLICE_BYTES = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole word."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def _table(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(_SPAN * 2, 1 << int(n).bit_length())
    made = lambda: tuple(np.concatenate([np.ones(1, U), np.cumprod(np.full(size - 1, U(b)), dtype=U)]) for b in (_BASE, _INVERSE))
    # Longer tables than usual are for one very long word only.
    return once("powers", made) if size == 2 * _SPAN else made()


def word_spans(data: np.ndarray, offsets: np.ndarray, white: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the first word of each document (one more entry at the end)."""
    gap = white[data]
    first = np.empty(len(data), bool)
    last = np.empty(len(data), bool)
    if len(data):
        first[0], first[1:] = True, gap[:-1]
        last[-1], last[:-1] = True, gap[1:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        first[edges] = True
        last[edges - 1] = True
        first &= ~gap
        last &= ~gap
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash per span; `fold` makes A-Z equal to a-z."""
    value = _FOLDED if fold else _BYTE
    out = np.empty(len(starts), U)
    at = 0
    while at < len(starts):
        # Spans of about half a megabyte of text together, one at least.
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _SPAN, "right")))
        low, high = int(starts[at]), int(ends[to - 1])
        power, inverse = _table(high - low)
        total = np.zeros(high - low + 1, U)
        np.cumsum(value[data[low:high]] * power[: high - low], dtype=U, out=total[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = (total[e] - total[s]) * inverse[s] + (e - s).astype(U)
        at = to
    return mix(out)


def shingles(words: np.ndarray, docs: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles and the offsets per document.

    A document with one to k - 1 words has one: the whole sequence.
    """
    counts = np.diff(docs)
    sizes = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    n = len(words)
    padded = np.concatenate([words, np.zeros(k, U)])
    whole = np.zeros(n, U)
    for j in range(k):
        whole = mix(whole ^ padded[j : j + n]) + U(j + 1)
    keep = np.zeros(n, bool)
    long = counts >= k
    if n:
        # A window is inside its document if k - 1 words follow it.
        end = np.repeat(docs[1:], counts)
        keep = np.arange(n) + k <= end
    for d in np.flatnonzero((counts > 0) & ~long):
        h = np.zeros(1, U)
        for j in range(docs[d], docs[d + 1]):
            h = mix(h ^ words[j : j + 1]) + U(100 + j - docs[d])
        whole[docs[d]] = h[0]
        keep[docs[d]] = True
    return whole[keep], offsets


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about `most` bytes of text, one row at least."""
    if not batch.num_rows:
        return
    _, at = column_bytes(batch.column(batch.schema.get_field_index(column)))
    row = 0
    while row < batch.num_rows:
        to = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        yield batch.slice(row, to - row)
        row = to


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the runs [start, start + size) one after another."""
    total = int(sizes.sum())
    if not total:
        return np.empty(0, np.int64)
    moved = np.cumsum(sizes) - sizes
    return np.arange(total) + np.repeat(starts - moved, sizes)
