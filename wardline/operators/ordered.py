"""Ordered computations per key that stay parallel when one key is huge.

A plain ``Window.partitionBy(key).orderBy(t)`` sends all rows of a key to one
task.  Here a cheap profile pass looks for heavy keys first (a mergeable
frequent-items sketch, no shuffle by key).  If there is none, the plain window
is used: one shuffle.  If there are some, their rows, and only theirs, are cut
into pieces along the order column at measured quantiles; each piece is its own
window partition, and what a piece must know of the earlier ones (last value,
running total, ...) comes from one small row per piece.

The profile decides only how work is split, never a result.  It may therefore be
taken from any frame with the same keys and times, such as the raw events below a
costly plan, and be passed on (`split`).

Two session settings steer it: ``wardline.hot.rows`` (rows from which a key is
heavy) and ``wardline.hot.pieces`` (pieces into which heavy rows are cut).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType

from wardline.operators.same import join_same
from wardline.operators.sizing import MAX_ROWS, checked_broadcast, measured
from wardline.session import checkpointed

HOT_ROWS = 20_000_000  # what one task may still sort in good time
HOT_KEYS = 4096  # also: a key with more than 1/HOT_KEYS of all rows is always found
TRACKED = 8 * HOT_KEYS
PIECES = 1024
SAMPLED = 64  # texts looked at for each piece

_PIECE, _HOT, _AT, _NAN = "_piece", "_hot", "_at", "_nan"


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch, for TIMESTAMP and TIMESTAMP_NTZ alike."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


@dataclass(frozen=True)
class KeySplit:
    """How the rows of the heavy keys are cut: hashes of the keys, cut points (numbers, or texts for a text)."""

    keys: tuple[str, ...]
    hashes: tuple[int, ...] = ()
    cuts: tuple[float, ...] | tuple[str, ...] = ()

    @property
    def plain(self) -> bool:
        return not self.hashes

    def hot(self) -> Column:
        return F.xxhash64(*self.keys).isin(list(self.hashes))

    def assign(self, df: DataFrame, at: Column) -> DataFrame:
        """Add the heavy-key flag and the piece number (0 for all other keys).

        Pieces follow Spark's own order: nulls in the first piece, NaN after all numbers.
        """
        marked = df.withColumn(_HOT, self.hot())
        if _is_text(df, at):
            reached = F.filter(F.lit(list(self.cuts)), lambda c: c <= at)
            return marked.withColumn(_PIECE, F.when(F.col(_HOT) & at.isNotNull(), F.size(reached)).otherwise(0))
        number = at.cast("double")
        marked = marked.withColumn(_AT, F.when(F.col(_HOT), number)).withColumn(_NAN, F.isnan(_AT))
        marked = marked.withColumn(_AT, F.when(~F.col(_NAN), F.col(_AT)))
        splits = [float("-inf"), *self.cuts, float("inf")]
        cut = Bucketizer(splits=splits, inputCol=_AT, outputCol=_PIECE).transform(marked)
        piece = F.when(F.col(_NAN), len(splits) - 1).otherwise(F.coalesce(F.col(_PIECE), F.lit(0.0)))
        return cut.withColumn(_PIECE, piece.cast("int")).drop(_AT, _NAN)


def _is_text(df: DataFrame, at: Column) -> bool:
    return isinstance(df.select(at).schema[0].dataType, StringType)


def profile_keys(df: DataFrame, keys: Sequence[str], at: Column) -> KeySplit:
    """Find the heavy keys of `df` and where to cut their rows along `at`."""
    conf = df.sparkSession.conf
    hot_rows = int(conf.get("wardline.hot.rows", str(HOT_ROWS)))
    pieces = int(conf.get("wardline.hot.pieces", str(PIECES)))
    seen = df.select(F.xxhash64(*keys).alias("h")).agg(
        F.expr(f"approx_top_k(h, {HOT_KEYS}, {TRACKED})").alias("top"), F.count("*").alias("n")
    ).first()
    split = KeySplit(tuple(keys), tuple(r["item"] for r in seen.top if r["count"] > hot_rows))
    if split.plain:
        return split
    rows = df.filter(split.hot())
    if _is_text(df, at):
        # A text has no quantiles in Spark; cuts come from a sample, which decides only how work is divided.
        share = min(1.0, pieces * SAMPLED / sum(r["count"] for r in seen.top if r["item"] in split.hashes))
        texts = sorted((r.at for r in rows.select(at.alias("at")).dropna().sample(share, seed=0).collect()), key=str.encode)
        found = {texts[len(texts) * i // pieces] for i in range(1, pieces)} if texts else {""}
        return KeySplit(split.keys, split.hashes, tuple(sorted(found, key=str.encode)))
    cuts = (
        rows.select(at.cast("double").alias("at"))
        .approxQuantile("at", [i / pieces for i in range(1, pieces)], 1 / (4 * pieces))
    )
    return KeySplit(split.keys, split.hashes, tuple(sorted(set(cuts))) or (0.0,))


@dataclass(frozen=True)
class Running:
    """One running value: `kind` is previous, last, max, min or sum.

    ``previous``: `value` of the row just before.  ``last``: the last non-null
    `value` so far.  `strict` leaves the current row out (always so for previous).
    """

    name: str
    kind: str
    value: Column
    strict: bool = True


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    at: Column,
    specs: Sequence[Running],
    *,
    descending: bool = False,
    split: KeySplit | None = None,
) -> DataFrame:
    """Add the running values of `specs`, per `keys`, in the order of `order`.

    `at` is the number that `order` leads with (rows with equal `at` stay in one
    piece); `descending` walks backwards, so ``previous`` is then the next row.
    """
    split = split or profile_keys(df, keys, at)
    by = [F.desc(c) if descending else F.asc(c) for c in order]
    if split.plain:
        w = Window.partitionBy(*keys).orderBy(*by)
        return df.withColumns({s.name: _within(s, w) for s in specs})

    cut = split.assign(df, at)
    carry = _carry(cut, keys, order, specs, descending)
    w = Window.partitionBy(*keys, _PIECE).orderBy(*by)
    boxed = cut.withColumns({f"_in_{s.name}": _within(s, w, box=True) for s in specs})
    match = [F.col(f"l.{k}").eqNullSafe(F.col(f"r._k{i}")) for i, k in enumerate(keys)]
    out = boxed.alias("l").join(
        checked_broadcast(carry).alias("r"), [*match, F.col(f"l.{_PIECE}") == F.col("r._p")], "left"
    )
    return out.select(*[F.col(f"l.`{c}`") for c in df.columns], *[_merge(s).alias(s.name) for s in specs])


def _within(s: Running, w, box: bool = False) -> Column:
    frame = w.rowsBetween(Window.unboundedPreceding, -1 if s.strict else 0)
    if s.kind == "previous":
        return F.lag(F.struct(s.value.alias("v")) if box else s.value).over(w)
    if s.kind == "last":
        boxed = F.when(s.value.isNotNull(), F.struct(s.value.alias("v"))) if box else s.value
        return F.last(boxed, ignorenulls=True).over(frame)
    return {"max": F.max, "min": F.min, "sum": F.sum}[s.kind](s.value).over(frame)


def _carry(cut: DataFrame, keys, order, specs, descending) -> DataFrame:
    """Per heavy key and piece: what the pieces before it add up to."""
    rank = F.struct(*order)
    pick = F.min_by if descending else F.max_by

    def piece_total(s: Running) -> Column:
        if s.kind == "previous":
            return pick(F.struct(s.value.alias("v")), rank)
        if s.kind == "last":
            return pick(F.struct(s.value.alias("v")), F.when(s.value.isNotNull(), rank))
        return {"max": F.max, "min": F.min, "sum": F.sum}[s.kind](s.value)

    totals = cut.filter(F.col(_HOT)).groupBy(*keys, _PIECE).agg(*[piece_total(s).alias(f"_t_{s.name}") for s in specs])
    # One row per piece, so a key has at most as many rows here as there are pieces.
    w = (
        Window.partitionBy(*keys)
        .orderBy(F.desc(_PIECE) if descending else F.asc(_PIECE))
        .rowsBetween(Window.unboundedPreceding, -1)
    )

    def before(s: Running) -> Column:
        total = F.col(f"_t_{s.name}")
        if s.kind in ("previous", "last"):
            return F.last(total, ignorenulls=True).over(w)
        return {"max": F.max, "min": F.min, "sum": F.sum}[s.kind](total).over(w)

    return totals.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col(_PIECE).alias("_p"),
        *[before(s).alias(f"_c_{s.name}") for s in specs],
    )


def _merge(s: Running) -> Column:
    inside, before = F.col(f"l._in_{s.name}"), F.col(f"r._c_{s.name}")
    if s.kind in ("previous", "last"):
        return F.coalesce(inside, before)["v"]
    if s.kind == "max":
        return F.greatest(inside, before)
    if s.kind == "min":
        return F.least(inside, before)
    return F.when(inside.isNull() & before.isNull(), None).otherwise(
        F.coalesce(inside, F.lit(0)) + F.coalesce(before, F.lit(0))
    )


def previous(df, keys, order, at, split: KeySplit | None = None, **values: Column) -> DataFrame:
    """The given values of the row before, per key."""
    return running(df, keys, order, at, [Running(n, "previous", v) for n, v in values.items()], split=split)


def following(df, keys, order, at, **values: Column) -> DataFrame:
    """The given values of the row after, per key."""
    return running(df, keys, order, at, [Running(n, "previous", v) for n, v in values.items()], descending=True)


def position(df, keys, order, at, name: str = "seq", **kw) -> DataFrame:
    """1-based place of each row within its key."""
    return running(df, keys, order, at, [Running(name, "sum", F.lit(1).cast("long"), strict=False)], **kw)


def nth_before(df, keys, order, at, n: int, name: str, value: Column) -> DataFrame:
    """`value` of the n-th row before, per key; null where there is none."""
    split = profile_keys(df, keys, at)
    if split.plain:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(name, F.lag(value, n).over(w))
    placed = position(df, keys, order, at, "_pos", split=split)
    # Joining on (key, place) spreads a heavy key as evenly as any other.
    earlier = placed.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], (F.col("_pos") + n).alias("_to"), value.alias(name)
    )
    match = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return placed.join(earlier, [*match, F.col("_pos") == F.col("_to")], "left").select(*df.columns, name)


#: Bits of a value that a round of a histogram looks at; together all 64.
_ROUNDS = (22, 21, 21)
_BUCKET = "_bucket"


def ordered_bits(value: Column) -> Column:
    """A double as a long of the same order: NaN after all numbers, -0.0 as 0.0."""
    number = F.coalesce(value.cast("double"), F.lit(0.0)) + F.lit(0.0)
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), number).cast("long")
    return F.when(value.isNull(), None).when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit((1 << 63) - 1)))


def _value_of(bits: Column) -> Column:
    raw = F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit((1 << 63) - 1)))
    return F.java_method(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), raw).cast("double")


def value_ranks(df: DataFrame, groups: Sequence[str], value: str, *, descending: bool = False) -> DataFrame:
    """Per group, one row per distinct value: `cnt`, rows `below` it, distinct values below, group size `n`.

    All rank functions follow from it: rank = below + 1, dense_rank = distinct_below + 1,
    percent_rank = below / (n - 1), cume_dist = (below + cnt) / n.  Ties collapse
    before the shuffle, so a value shared by a third of all rows costs nothing.

    Numbers are ordered within buckets of about a thousandth of their size, which are as many tasks as there are
    buckets, however few the groups; what lies in the buckets below comes from a histogram, which is bounded.
    """
    if isinstance(df.schema[value].dataType, StringType):
        return _text_ranks(df, groups, value, descending)
    groups = list(groups)
    counted = df.groupBy(*groups, value).agg(F.count("*").alias("cnt"))
    # A null has a bucket of its own: before all numbers, or after them where the order falls.
    bucket = F.coalesce(F.shiftright(ordered_bits(F.col(value)), 64 - _ROUNDS[0]).cast("long"), F.lit(-(1 << 40)))
    counted = checkpointed(counted.withColumn(_BUCKET, -bucket if descending else bucket))
    hist = counted.groupBy(*groups, _BUCKET).agg(F.sum("cnt").alias("_c"), F.count("*").alias("_d"))
    # At most 2^22 buckets in a group.
    w = Window.partitionBy(*groups).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    base = hist.select(
        *groups, _BUCKET, F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_b"), F.coalesce(F.sum("_d").over(w), F.lit(0)).alias("_e"),
        F.sum("_c").over(Window.partitionBy(*groups)).alias("n"),
    )
    order = F.desc_nulls_last(value) if descending else F.asc_nulls_first(value)
    inside = Window.partitionBy(*groups, _BUCKET).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumns({"_i": F.coalesce(F.sum("cnt").over(inside), F.lit(0)), "_j": F.coalesce(F.count("*").over(inside), F.lit(0))})
    out = join_same(placed, base, [*groups, _BUCKET])
    return out.select(
        *groups, value, "cnt", (F.col("_b") + F.col("_i")).cast("long").alias("below"), (F.col("_e") + F.col("_j")).cast("long").alias("distinct_below"), "n"
    )


def _text_ranks(df: DataFrame, groups: Sequence[str], value: str, descending: bool) -> DataFrame:
    split = profile_keys(df, groups, F.col(value))
    counted = df.groupBy(*groups, value).agg(F.count("*").alias("cnt"))
    specs = [Running("below", "sum", F.col("cnt")), Running("distinct_below", "sum", F.lit(1).cast("long"))]
    ranked = running(counted, groups, [value], F.col(value), specs, descending=descending, split=split)
    sizes = counted.groupBy(*groups).agg(F.sum("cnt").alias("n"))
    if not split.plain:
        # The pieces of a heavy group must not meet again for the sake of this join.
        sizes = checked_broadcast(sizes)
    return join_same(ranked, sizes, list(groups)).withColumns(
        {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("below", "distinct_below")}
    )


def exact_quantiles(df: DataFrame, groups: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles per group, one column per name in `probs`; values are taken as doubles.

    Selection by histograms: three reads, each of which counts the values by the next bits and goes on with the
    buckets that hold a wanted rank.  The counts are combined before the shuffle, so a group may hold all rows.
    """
    groups = list(groups)
    bits = ordered_bits(F.col(value))
    cuts = [F.shiftright(bits, 42)] + [F.shiftright(bits, s).bitwiseAND(F.lit((1 << 21) - 1)) for s in (21, 0)]
    rows = df.filter(F.col(value).isNotNull()).select(*groups, *[c.alias(f"_b{i}") for i, c in enumerate(cuts)])
    wanted = None
    for i in range(len(_ROUNDS)):
        by, bucket = [*groups, *[f"_b{j}" for j in range(i)]], f"_b{i}"
        left = rows if wanted is None else join_same(rows, wanted.select(*by), by)
        counted = left.groupBy(*by, bucket).agg(F.count("*").alias("cnt"))
        # A window partition holds one histogram: at most 2^22 rows.
        ranked = counted.withColumn("_below", F.sum("cnt").over(Window.partitionBy(*by).orderBy(bucket)) - F.col("cnt"))
        if wanted is None:
            place = lambda p: (F.sum("cnt").over(Window.partitionBy(*groups)) - 1) * F.lit(float(p))
            rank = lambda n, side, r, p: F.struct(F.lit(n).alias("name"), F.lit(side).alias("side"), r(place(p)).cast("long").alias("rank"), (place(p) - F.floor(place(p))).alias("part"))
            ranks = [rank(n, side, r, p) for n, p in probs.items() for side, r in (("lo", F.floor), ("hi", F.ceil))]
            ranked = ranked.withColumn("_ranks", F.array(*ranks))
        else:
            ranked = join_same(ranked, wanted, by)
        here = F.filter("_ranks", lambda r: (r["rank"] >= F.col("_below")) & (r["rank"] < F.col("_below") + F.col("cnt")))
        moved = F.transform("_here", lambda r: r.withField("rank", r["rank"] - F.col("_below")))
        hit = ranked.withColumn("_here", here).filter(F.size("_here") > 0).select(*by, bucket, moved.alias("_ranks"))
        if i == 0:
            wanted, small = measured(hit, MAX_ROWS // (2 * len(probs)))
        elif i == 1:
            # No more rows than wanted ranks; the first round has shown how many groups there are.
            wanted = checkpointed(hit)
        else:
            wanted = hit
        wanted = F.broadcast(wanted) if small and i < 2 else wanted
    found = _value_of(F.shiftleft("_b0", 42).bitwiseOR(F.shiftleft("_b1", 21)).bitwiseOR(F.col("_b2")))
    flat = wanted.select(*groups, found.alias("_v"), F.explode("_ranks").alias("_r"))
    one = lambda n, side, c: F.max(F.when((F.col("_r.name") == n) & (F.col("_r.side") == side), c))
    picked = flat.groupBy(*groups).agg(
        *[a for n in probs for a in (one(n, "lo", F.col("_v")).alias(f"_lo_{n}"), one(n, "hi", F.col("_v")).alias(f"_hi_{n}"), one(n, "lo", F.col("_r.part")).alias(f"_f_{n}"))]
    )
    return picked.select(
        *groups,
        *[
            F.when(F.col(f"_lo_{n}") == F.col(f"_hi_{n}"), F.col(f"_lo_{n}"))
            .otherwise(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}"))
            .alias(n)
            for n in probs
        ],
    )


def parts(df, keys, order, at, size: int, name: str = "part") -> DataFrame:
    """Number the rows of each key and cut them into parts of `size` rows.

    For results that build one text or object per key: a part is bounded, a key is not.
    """
    placed = position(df, keys, order, at, "_pos")
    return placed.withColumn(name, F.floor((F.col("_pos") - 1) / size).cast("long")).drop("_pos")
