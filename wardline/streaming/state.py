"""Stateful operators.

Operators that need a key's rows in the order of time keep them in slices of time.  A slice lies in the state as
chunks, each as large as a batch for Python, and is worked off when the watermark has passed its end: chunk by
chunk, slice after slice.  So no frame ever holds a key, and the result does not depend on how the stream was cut
into micro-batches.  The state is in RocksDB (see `wardline.session`), so it may be larger than memory.
A call into the state costs more than the row it brings, so throttle and correlation keep many keys in one bucket
(`_Buckets`): calls grow with the chunks and not with the keys.
Columns for a processor have no leading underscore: its frames would lose such names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from heapq import merge
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def stream_dedup(sdf: DataFrame, keys: Sequence[str], delay: str, t: str = "ts", salts: int = 1) -> DataFrame:
    """One copy of each key within the watermark; the delay must cover the disorder of the source.

    Where one key may come in very many copies, `salts` > 1 first spreads them over that many state
    partitions, so that the last step sees at most `salts` copies of a key.
    """
    rows = sdf.withWatermark(t, delay)
    if salts > 1:
        spread = rows.withColumn("_salt", (F.rand() * salts).cast("int"))
        rows = spread.dropDuplicatesWithinWatermark([*keys, "_salt"]).drop("_salt")
    return rows.dropDuplicatesWithinWatermark(list(keys))


class _Slices(StatefulProcessor):
    """Chunks of rows (_us, _id, _side) per slice of time; `passed` gets the slices whose end the watermark has passed."""

    def __init__(self, width_us: int, id_type: str, schema: str):
        self.width, self.id_type = width_us, id_type
        self.columns = [c.split()[0] for c in schema.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getMapState("chunks", "slice long, seq long", f"us array<long>, ids array<{self.id_type}>, side int")
        self.next = handle.getValueState("next", "n long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seq = self.next.get()[0] if self.next.exists() else 0
        for frame in rows:
            if frame.empty:
                continue
            slices = frame["at_us"] // self.width
            for (slice_, side), part in frame.groupby([slices, frame["at_side"]]):
                # Rows of a slice that is done are too late; Spark drops them by the watermark as well.
                if self._end_ms(slice_) <= timerValues.getCurrentWatermarkInMs():
                    continue
                part = part.sort_values(["at_us", "at_id"])
                self.chunks.updateValue((int(slice_), seq), (part["at_us"].tolist(), part["at_id"].tolist(), int(side)))
                self.handle.registerTimer(self._end_ms(slice_))
                seq += 1
        self.next.update((seq,))
        return iter(())

    def _end_ms(self, slice_: int) -> int:
        return int((slice_ + 1) * self.width // 1000)

    def until(self, us: int) -> int:
        """When what matters up to `us` may go: the slice that holds `us` has been worked off by then."""
        return int((us + self.width) // 1000) + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        seqs: dict[int, list[int]] = {}
        for slice_, seq in self.chunks.keys():
            seqs.setdefault(slice_, []).append(seq)
        for slice_ in sorted(s for s in seqs if self._end_ms(s) <= now):
            yield from self._framed(key, self.passed(slice_, seqs[slice_]))
        self.forget(now)

    def _framed(self, key, found: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        out = []
        for row in found:
            out.append((*key, *row))
            if len(out) == 10_000:
                yield pd.DataFrame(out, columns=self.columns)
                out = []
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def taken(self, slice_: int, seqs: list[int]) -> Iterator[tuple[list[int], list, int]]:
        """The chunks of a slice, one at a time, which then leave the state."""
        for seq in sorted(seqs):
            yield self.chunks.getValue((slice_, seq))
            self.chunks.removeKey((slice_, seq))

    def passed(self, slice_: int, seqs: list[int]) -> Iterator[tuple]:
        raise NotImplementedError

    def forget(self, now: int) -> None:
        """Let go of what no later row can need."""


#: Rows and slices of a chunk, about, and rows that are worked off at once.
_PIECE, _SPAN, _FEW = 1_000, 100, 100_000
_LOWEST, _HIGHEST = -(1 << 63), (1 << 63) - 1


class _Chunk(NamedTuple):
    """Slices `first` to `last`, `keep` the last one that later rows ask for, `n` rows: the key of a chunk in the state."""

    first: int
    last: int
    keep: int
    seq: int
    n: int


class _Rows(NamedTuple):
    """Columns of a chunk, or of several ones together."""

    keys: list
    us: np.ndarray
    ids: list
    sides: np.ndarray

    def at(self, where: np.ndarray) -> _Rows:
        x = where.tolist()
        return _Rows([self.keys[i] for i in x], self.us[where], [self.ids[i] for i in x], self.sides[where])

    def of(self, side: int) -> _Rows:
        return self.at(np.flatnonzero(self.sides == side))


def _joined(parts: list[_Rows]) -> _Rows:
    if len(parts) == 1:
        return parts[0]
    keys, us, ids, sides = zip(*parts)
    return _Rows([k for x in keys for k in x], np.concatenate(us), [i for x in ids for i in x], np.concatenate(sides))


def _order(us: int, id_) -> tuple:
    """Rows by time and id, a null id first."""
    return us, id_ is not None, id_


class _Buckets(StatefulProcessor):
    """Rows of all keys of a bucket, in chunks of one or more slices of time, which stay as they are written.

    When the watermark has passed the end of slices, their rows are worked off: as many slices at once as have `_FEW`
    rows together (`few`), and a slice that has more alone, chunk by chunk (`many`).  One timer stands at a time.
    `reach_us`: so far back do rows of `side` 0 count for later ones.
    """

    def __init__(self, width_us: int, key_type: str, id_type: str, schema: str, reach_us: int = 0):
        self.width, self.key_type, self.id_type, self.reach = width_us, key_type, id_type, reach_us
        self.columns = [c.split()[0] for c in schema.split(", ")]
        self.back = reach_us // width_us + 1 if reach_us else 0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        value = f"names array<{self.key_type}>, us binary, ids array<{self.id_type}>, sides binary"
        self.chunks = handle.getMapState("chunks", "first long, last long, keep long, seq long, n long", value)
        # The next chunk's number, the last slice that is done, and when the timer is due.
        self.mark = handle.getValueState("mark", "seq long, done long, due long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seq, done, due = self._marked()
        passed, first = self._last(timerValues.getCurrentWatermarkInMs()), _HIGHEST
        for frame in rows:
            if frame.empty:
                continue
            us = frame["at_us"].to_numpy(np.int64)
            # Rows of a slice that is done are too late; Spark drops them by the watermark as well.
            order = np.flatnonzero(us // self.width > passed)
            if not len(order):
                continue
            order = order[np.argsort(us[order], kind="stable")]
            seq = self._put(_Rows(frame["at_key"].tolist(), us, frame["at_id"].tolist(), frame["at_side"].to_numpy(np.int8)).at(order), seq)
            first = min(first, int(us[order[0]] // self.width))
        if first < _HIGHEST:
            if self._end_ms(first) < due:
                due = self._end_ms(first)
                self.handle.registerTimer(due)
            self.mark.update((seq, done, due))
        return iter(())

    def _marked(self) -> tuple[int, int, int]:
        return tuple(self.mark.get()) if self.mark.exists() else (0, _LOWEST, _HIGHEST)

    def _put(self, rows: _Rows, seq: int) -> int:
        """Rows in the order of time become chunks, cut between slices; no chunk reaches over a long gap."""
        slices = rows.us // self.width
        cuts = [0, *(np.flatnonzero(np.diff(slices)) + 1).tolist(), len(slices)]
        start = 0
        for end in cuts[1:]:
            if end < len(slices) and end - start < _PIECE and slices[end] - slices[start] < _SPAN:
                continue
            kept = slices[start:end][rows.sides[start:end] == 0] if self.reach else slices[:0]
            chunk = _Chunk(int(slices[start]), int(slices[end - 1]), int(kept[-1]) if len(kept) else _LOWEST, seq, end - start)
            value = rows.keys[start:end], rows.us[start:end].tobytes(), rows.ids[start:end], rows.sides[start:end].tobytes()
            self.chunks.updateValue(tuple(chunk), value)
            start, seq = end, seq + 1
        return seq

    def _read(self, chunk: _Chunk, low: int, high: int) -> _Rows:
        """Rows of a chunk in the slices from `low` to `high`."""
        names, us, ids, sides = self.chunks.getValue(tuple(chunk))
        rows = _Rows(list(names), np.frombuffer(us, np.int64), list(ids), np.frombuffer(sides, np.int8))
        if low <= chunk.first and chunk.last <= high:
            return rows
        slices = rows.us // self.width
        return rows.at(np.flatnonzero((slices >= low) & (slices <= high)))

    def _end_ms(self, slice_: int) -> int:
        return (slice_ + 1) * self.width // 1000

    def _last(self, ms: int) -> int:
        """The last slice that ends by then."""
        return ((ms + 1) * 1000 - 1) // self.width - 1

    def until(self, us: int) -> int:
        """When what matters up to `us` may go: the slice that holds `us` has been worked off by then."""
        return (us + self.width) // 1000 + 1

    def _kept_until(self, chunk: _Chunk) -> int:
        return self.until((chunk.keep + 1) * self.width + self.reach)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        seq, done, due = self._marked()
        if due > now:
            return
        chunks, last = sorted(_Chunk(*c) for c in self.chunks.keys()), self._last(now)
        yield from self._framed(self._passed(chunks, done + 1, last))
        left, due = [], self.forget(now)
        for c in chunks:
            if c.last > last:
                due = min(due, self._end_ms(max(c.first, last + 1)))
            elif self._kept_until(c) <= now:
                self.chunks.removeKey(tuple(c))
            else:
                due = min(due, self._kept_until(c))
                left.append(c)
        seq = self._merged([c for c in left if c.n < _PIECE], seq)
        if due < _HIGHEST:
            self.handle.registerTimer(due)
            self.mark.update((seq, last, due))
        else:
            self.mark.clear()

    def _merged(self, small: list[_Chunk], seq: int) -> int:
        """Many small chunks of slices that are done become one: only what later rows ask for."""
        if len(small) < 8:
            return seq
        small = small[: _FEW // _PIECE]
        rows = _joined([self._read(c, c.first, c.last).of(0) for c in small])
        for c in small:
            self.chunks.removeKey(tuple(c))
        return self._put(rows.at(np.argsort(rows.us, kind="stable")), seq)

    def _passed(self, chunks: list[_Chunk], low: int, last: int) -> Iterator[tuple]:
        while low <= last:
            ahead = [c for c in chunks if c.last >= low and c.first <= last]
            if not ahead:
                return
            low = max(low, ahead[0].first)
            near = [c for c in chunks if c.last >= low - self.back and c.first <= last]
            # As far as the rows together are few.
            high, n = last, 0
            for c in near:
                n += c.n
                if n > _FEW:
                    high = c.first - 1
                    break
            if high >= low:
                yield from self.few(_joined([self._read(c, low - self.back, high) for c in near if c.first <= high]), low)
            else:
                high = low
                yield from self.many([c for c in near if c.first <= high], low)
            low = high + 1

    def _framed(self, found: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        out = []
        for row in found:
            out.append(row)
            if len(out) == 10_000:
                yield pd.DataFrame(out, columns=self.columns)
                out = []
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def few(self, rows: _Rows, low: int) -> Iterator[tuple]:
        """The results of the slices from `low` on, whose rows, and those that count for them, are `rows`."""
        raise NotImplementedError

    def many(self, chunks: list[_Chunk], slice_: int) -> Iterator[tuple]:
        """The results of one slice, whose rows, and those that count for them, lie in `chunks`."""
        raise NotImplementedError

    def forget(self, now: int) -> int:
        """Let go of what no later row can need, chunks aside; when the next may go."""
        return _HIGHEST


def ranks(values: list) -> np.ndarray:
    """The place of each value in their order, equal for equal ones; a null is below all."""
    return pd.factorize(pd.Series(values), sort=True)[0]


class _Throttle(_Buckets):
    """Slices as wide as the quiet time: at most one row of a key and slice is emitted, the first that is late enough."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.kept = handle.getMapState("last", "part long", f"names array<{self.key_type}>, us binary")
        self.last = {}

    def _passed(self, chunks: list[_Chunk], low: int, last: int) -> Iterator[tuple]:
        self.last = {}
        self.parts = sorted(p for p, in self.kept.keys())
        for part in self.parts:
            names, us = self.kept.getValue((part,))
            self.last.update(zip(names, np.frombuffer(us, np.int64).tolist()))
        yield from super()._passed(chunks, low, last)

    def few(self, rows: _Rows, low: int) -> Iterator[tuple]:
        for x in np.lexsort((ranks(rows.ids), rows.us)).tolist():
            yield from self._emitted(rows.keys[x], int(rows.us[x]), rows.ids[x])

    def many(self, chunks: list[_Chunk], slice_: int) -> Iterator[tuple]:
        first = {}
        for c in chunks:
            rows = self._read(c, slice_, slice_)
            for k, us, i in zip(rows.keys, rows.us.tolist(), rows.ids):
                if self._late_enough(k, us) and (k not in first or _order(us, i) < first[k]):
                    first[k] = _order(us, i)
        for k, (us, _, i) in first.items():
            yield from self._emitted(k, us, i)

    def _late_enough(self, key, us: int) -> bool:
        after = self.last.get(key)
        return after is None or us > after + self.width

    def _emitted(self, key, us: int, id_) -> Iterator[tuple]:
        if self._late_enough(key, us):
            self.last[key] = us
            yield key, id_, us

    def forget(self, now: int) -> int:
        left = [(k, us) for k, us in self.last.items() if self.until(us + self.width) > now]
        parts = range(0, len(left), 10_000)
        for part in parts:
            names, us = zip(*left[part : part + 10_000])
            self.kept.updateValue((part,), (list(names), np.array(us, np.int64).tobytes()))
        for part in self.parts:
            if part not in parts:
                self.kept.removeKey((part,))
        self.last = {}
        return self.until(max(us for _, us in left) + self.width) if left else _HIGHEST


class _Frequency(_Slices):
    """The times of the last n - 1 rows go with a key from slice to slice."""

    def __init__(self, width_us: int, id_type: str, schema: str, n: int, reach_us: int):
        super().__init__(width_us, id_type, schema)
        self.n, self.reach = n, reach_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.recent = handle.getValueState("recent", "us array<long>")

    def passed(self, slice_: int, seqs: list[int]) -> Iterator[tuple]:
        recent = list(self.recent.get()[0]) if self.recent.exists() else []
        runs = [list(zip(us, ids)) for us, ids, _ in self.taken(slice_, seqs)]
        for us, i in merge(*runs):
            recent.append(us)
            if len(recent) >= self.n:
                if us - recent[-self.n] <= self.reach:
                    yield i, us, recent[-self.n]
                del recent[: len(recent) - self.n + 1]
        self.recent.update((recent,))
        if recent:
            self.handle.registerTimer(self.until(recent[-1] + self.reach))

    def forget(self, now: int) -> None:
        recent = self.recent.get()[0] if self.recent.exists() else []
        if len(recent) and self.until(recent[-1] + self.reach) <= now:
            self.recent.clear()


def _rows(sdf: DataFrame, key: Column, t: str, id_col: str, delay: str) -> DataFrame:
    side = F.lit(0).alias("at_side")
    return sdf.where(F.col(t).isNotNull()).withWatermark(t, delay).select(key.alias("at_key"), F.col(id_col).alias("at_id"), F.unix_micros(t).alias("at_us"), side, t)


def _types(sdf: DataFrame, *columns: str) -> list[str]:
    return [sdf.schema[c].dataType.simpleString() for c in columns]


def key_text(sdf: DataFrame, key: str) -> tuple[Column, str, str]:
    """The key as a processor holds it, its type there and its own type.

    Numbers and times become text, from which they come back by a cast: in a frame a null would turn them into doubles.
    """
    own = sdf.schema[key].dataType.simpleString()
    if own.startswith(("string", "binary", "array", "struct")):
        return F.col(key), own, own
    # Groups know one zero.
    return (F.col(key) + F.lit(0.0) if own in ("float", "double") else F.col(key)).cast("string"), "string", own


def bucket_of(name: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(buckets)).cast("int")


def stream_throttle(
    sdf: DataFrame, key: str, quiet_s: int, delay: str, t: str = "ts", id_col: str = "event_id", buckets: int = 1024
) -> DataFrame:
    """Emit an alert only if the last *emitted* one of its key is older than the quiet time.

    Alerts are taken in the order of time and id, whatever batch brings them, and are emitted when the watermark
    has passed their slice of time.  What stays of a key is one timestamp, until it is older than the quiet time.
    Rows without a time are left out; rows with a null key are one key.  The keys of one of `buckets` share state and
    task; their timestamps are in memory together while a slice is worked off.  The number stays the same for a stream's life.
    """
    name, key_type, own = key_text(sdf, key)
    (id_type,) = _types(sdf, id_col)
    schema = f"at_key {key_type}, at_id {id_type}, at_us long"
    return (
        _rows(sdf, name, t, id_col, delay)
        .withColumn("at_bucket", bucket_of(F.col("at_key"), buckets))
        .groupBy("at_bucket")
        .transformWithStateInPandas(_Throttle(quiet_s * 1_000_000, key_type, id_type, schema), schema, "append", "eventTime")
        .select(F.col("at_key").cast(own).alias(key), F.col("at_id").alias(id_col), F.timestamp_micros("at_us").alias(t))
    )


def stream_frequency(
    sdf: DataFrame, key: str, n: int, seconds: int, delay: str, t: str = "ts", id_col: str = "event_id", slice_s: int = 60
) -> DataFrame:
    """The frequency rule on a stream: events that are at least the n-th of their key in the trailing window.

    One row per event, with `burst_start`, the time of the n-th last one, as in the batch form.  What stays of a key
    is the times of its last n - 1 events, while they may count.  Of one key, a slice of `slice_s` seconds is sorted
    at a time.  Rows without a time are left out; rows with a null key are one key.
    """
    key_type, id_type = _types(sdf, key, id_col)
    schema = f"at_key {key_type}, at_id {id_type}, at_us long, at_start long"
    processor = _Frequency(slice_s * 1_000_000, id_type, schema, n, seconds * 1_000_000)
    return (
        _rows(sdf, F.col(key), t, id_col, delay)
        .groupBy("at_key")
        .transformWithStateInPandas(processor, schema, "append", "eventTime")
        .select(F.col("at_key").alias(key), F.col("at_id").alias(id_col), F.timestamp_micros("at_us").alias(t), F.timestamp_micros("at_start").alias("burst_start"))
    )


def _nearest(effects: _Rows, causes: _Rows, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Per effect the number of causes of its key in its reach, and which of them is the nearest (if there is one)."""
    codes = pd.factorize(np.array(effects.keys + causes.keys, object))[0]
    mine, theirs = codes[: len(effects.us)], codes[len(effects.us) :]
    # Times as ranks, so that key and time fit into one number.
    times, rank = np.unique(np.concatenate([causes.us, effects.us - reach, effects.us]), return_inverse=True)
    own, from_, to = np.split(rank, [len(causes.us), len(causes.us) + len(effects.us)])
    order = np.lexsort((ranks(causes.ids), own, theirs))
    places = (theirs * len(times) + own)[order]
    low = np.searchsorted(places, mine * len(times) + from_, "left")
    high = np.searchsorted(places, mine * len(times) + to, "left")
    n = high - low
    at = np.full(len(n), -1)
    at[n > 0] = order[high[n > 0] - 1]
    return n, at


class _Correlate(_Buckets):
    """Causes (side 0) and effects (side 1) of the keys of one bucket and tile.

    In a slice with many rows, of the slices of causes that lie wholly in an effect's reach only number and last cause
    of each key are looked at; the causes themselves are read for the slices at the rim of the reach and for its own.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.counts = handle.getMapState("counts", "slice long, part long", f"names array<{self.key_type}>, n binary, us binary, ids array<{self.id_type}>")

    def few(self, rows: _Rows, low: int) -> Iterator[tuple]:
        causes, effects = rows.of(0), rows.at(np.flatnonzero((rows.sides == 1) & (rows.us // self.width >= low)))
        if not causes.keys or not effects.keys:
            return
        n, at = _nearest(effects, causes, self.reach)
        for x in np.flatnonzero(n).tolist():
            yield effects.keys[x], effects.ids[x], int(effects.us[x]), causes.ids[at[x]], int(causes.us[at[x]]), int(n[x])

    def many(self, chunks: list[_Chunk], slice_: int) -> Iterator[tuple]:
        known: dict[int, dict] = {}
        waiting, n = [], 0
        for c in chunks:
            if c.last >= slice_:
                waiting.append(self._read(c, slice_, slice_).of(1))
                n += len(waiting[-1].us)
            # Many effects at a time: each time all causes in reach are read.
            if n and (n >= _FEW // 2 or c is chunks[-1]):
                yield from self._matched(_joined(waiting), chunks, slice_, known)
                waiting, n = [], 0

    def _matched(self, effects: _Rows, chunks: list[_Chunk], slice_: int, known: dict[int, dict]) -> Iterator[tuple]:
        low, rim = (int(x) // self.width for x in (effects.us.min() - self.reach, effects.us.max() - self.reach))
        n, near = np.zeros(len(effects.us), np.int64), [None] * len(effects.us)

        def found(x: int, count: int, us: int, id_) -> None:
            n[x] += count
            if near[x] is None or _order(us, id_) > near[x]:
                near[x] = _order(us, id_)

        for c in chunks:
            for a, b in ((low, min(rim, slice_ - 1)), (slice_, slice_)):
                if c.keep >= a and c.first <= b:
                    causes = self._read(c, a, b).of(0)
                    count, at = _nearest(effects, causes, self.reach)
                    for x in np.flatnonzero(count).tolist():
                        found(x, int(count[x]), int(causes.us[at[x]]), causes.ids[at[x]])
        for s in range(rim + 1, slice_):
            if s not in known:
                known[s] = self._summed(s, chunks)
            for x, k in enumerate(effects.keys):
                if k in known[s]:
                    found(x, *known[s][k])
        for x in np.flatnonzero(n).tolist():
            yield effects.keys[x], effects.ids[x], int(effects.us[x]), near[x][2], near[x][0], int(n[x])

    def _summed(self, slice_: int, chunks: list[_Chunk]) -> dict:
        """Number and last cause of each key in a slice, from the state if they have been asked for before."""
        out: dict = {}
        part = 0
        while (kept := self.counts.getValue((slice_, part))) is not None:
            names, n, us, ids = kept
            out.update(zip(names, zip(np.frombuffer(n, np.int64).tolist(), np.frombuffer(us, np.int64).tolist(), ids)))
            part += 1
        if part:
            return out
        for c in chunks:
            if c.keep >= slice_ and c.first <= slice_:
                rows = self._read(c, slice_, slice_).of(0)
                for k, us, i in zip(rows.keys, rows.us.tolist(), rows.ids):
                    n, *last = out.get(k, (0, us, i))
                    out[k] = n + 1, *max((us, i), last, key=lambda x: _order(*x))
        items = list(out.items())
        for part in range(max(1, -(-len(items) // 10_000))):
            names = [k for k, _ in items[part * 10_000 : (part + 1) * 10_000]]
            n, us, ids = ([out[k][j] for k in names] for j in range(3))
            self.counts.updateValue((slice_, part), (names, np.array(n, np.int64).tobytes(), np.array(us, np.int64).tobytes(), ids))
        return out

    def forget(self, now: int) -> int:
        due = _HIGHEST
        for s, part in list(self.counts.keys()):
            until = self.until((s + 1) * self.width + self.reach)
            if until <= now:
                self.counts.removeKey((s, part))
            else:
                due = min(due, until)
        return due


#: Parts of the reach that are slices, and reaches that are one tile.
_PARTS, _TILE = 8, 8


def stream_correlate(
    causes: DataFrame, effects: DataFrame, key: str, within_s: int, delay: str, t: str = "ts", id_col: str = "event_id", buckets: int = 256
) -> DataFrame:
    """Each streamed effect that follows streamed causes of the same key, 0 < effect - cause <= within.

    One row per effect: nearest cause and number of causes, as in the batch form.  The state holds each cause once,
    and counts per slice of time, so it grows with the events and never with the pairs.  The keys of one of `buckets`
    share state; a bucket is cut into tiles of eight reaches, so that the state of a heavy key spreads; causes at the end
    of a tile go to the next one as well.  The number of buckets stays the same for a stream's life.
    Rows without a time or key correlate with nothing.
    """
    tile_us = _TILE * within_s * 1_000_000
    us = F.unix_micros(t)
    tile = lambda at: F.floor(at / F.lit(tile_us)).cast("long")
    both = lambda df, side, tiles: df.where(F.col(t).isNotNull() & F.col(key).isNotNull()).select(
        key_text(df, key)[0].alias("at_key"), F.explode(tiles).alias("at_tile"), F.col(id_col).alias("at_id"), us.alias("at_us"), F.lit(side).alias("at_side"), t
    )
    reach = F.array_distinct(F.array(tile(us), tile(us + F.lit(within_s * 1_000_000))))
    rows = both(causes, 0, reach).unionByName(both(effects, 1, F.array(tile(us)))).withWatermark(t, delay)
    _, key_type, own = key_text(causes, key)
    (id_type,) = _types(causes, id_col)
    schema = f"at_key {key_type}, effect_id {id_type}, effect_us long, cause_id {id_type}, cause_us long, n_causes long"
    processor = _Correlate(max(1_000, within_s * 1_000_000 // _PARTS), key_type, id_type, schema, within_s * 1_000_000)
    return (
        rows.withColumn("at_bucket", bucket_of(F.col("at_key"), buckets))
        .groupBy("at_bucket", "at_tile")
        .transformWithStateInPandas(processor, schema, "append", "eventTime")
        .select(
            F.col("at_key").cast(own).alias(key), "effect_id", F.timestamp_micros("effect_us").alias("effect_ts"), "cause_id",
            F.timestamp_micros("cause_us").alias("cause_ts"), "n_causes",
        )
    )
