"""Similarity join of documents on word shingles by the Jaccard measure, with count vectors and an R-tree.

A document is the set of the hashes of its shingles.  Its hashes are dealt into groups, and the number in
each group is a coordinate of a point.  The overlap of two sets is at most the sum over the groups of the
smaller count, so two points whose summed minima are too small need no look at the sets.

The tree has three levels, and every level is exact:

* Cells.  A set is cut by hash value into K blocks.  Two sets of similarity t differ in D shingles at most,
  and each of these spoils one block, so at least K - D blocks are equal in both.  With all blocks ranked by
  size and content alike in every document, the first equal block is among the first D + 1 of both.  These
  are the cells that a document belongs to.  K goes by size class, and a pair's class is that of the larger.
  As a cell needs several equal shingles and no other, a passage that many documents share rarely makes one.
* Pages.  The points of a cell, in order of size, are cut into pages; a page has the smallest and the largest
  value of each coordinate.  Pages are compared by the bound on their boxes.
* Points.  Points of two pages are compared by the bound on the counts, what is left by the bound on counts of
  more groups, and what is left then is verified on the sets.

Most work is saved by comparing first with the two outermost members of each cell and keeping to pairs that
are not yet in one component: within a group of near copies nearly all pairs need no comparison.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wardline.llm import words as W
from wardline.llm.common import lean, require, saved
from wardline.llm.links import components
from wardline.operators.sizing import checked_broadcast

U = np.uint64
GROUPS = 256
FINE = 512
PAGE = 128
#: Pairs of pages' points that a task holds to tell repeated ones, about.
PAIRS = 100_000
ROUNDS = 1


def _need(na, nb, percent):
    """Overlap times (100 + percent) that a pair needs: 100 I >= percent (na + nb - I)."""
    return percent * (na.astype(np.int64) + nb)


class _Cells:
    """The cells of a set, for one similarity."""

    def __init__(self, percent: int):
        self.percent = percent

    def __call__(self, s: np.ndarray) -> np.ndarray:
        n, p, out = len(s), self.percent, []
        if not n:
            return np.empty(0, np.int64)
        own = (n.bit_length() - 1) // 2
        for level in (own, own + 1):
            low, high = 4**level, 4 ** (level + 1)
            largest = min(100 * n // p, high - 1)
            if largest < max(n, low):
                continue
            # |A xor B| <= (100 - p) / (100 + p) (|A| + |B|)
            differ = (100 - p) * (n + largest) // (100 + p)
            blocks = max(64, high // 2, 2 * ((100 - p) * 2 * high // (100 + p)) + 2)
            block = (s >> U(20)) % U(blocks)
            order = np.argsort(block, kind="stable")
            block = block[order]
            at = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            size = np.diff(np.concatenate([at, [n]]))
            content = np.add.reduceat(W.mix(s[order]), at)
            cell = W.mix(content ^ W.mix(block[at] + U((level + 1) << 40)))
            first = np.lexsort((cell, -size))[: differ + 1]
            out.append(cell[first])
            if len(at) < differ + 1:
                # Too few blocks with content: the empty ones take part, last in rank.
                empty = np.setdiff1d(np.arange(blocks, dtype=U), block[at])
                cell = np.sort(W.mix(empty + U((level + 1) << 40)))
                out.append(cell[: differ + 1 - len(at)])
        return np.unique(np.concatenate(out)).view(np.int64)


def _vector(s: np.ndarray, shift: int, groups: int) -> bytes:
    # Cut at 15, two counts in a byte.  Cut counts never differ by more than the true ones, so the bound holds.
    counts = np.minimum(np.bincount((s >> U(shift)).astype(np.int64) & (groups - 1), minlength=groups), 15).astype(np.uint8)
    return (counts[::2] | counts[1::2] << 4).tobytes()


def _counts(packed: np.ndarray) -> np.ndarray:
    """Counts of rows of packed vectors, the even groups before the odd ones."""
    return np.concatenate([packed & 15, packed >> 4], axis=-1).astype(np.int8)


def _sets(batch: pa.RecordBatch, text: str, k: int) -> Iterator[np.ndarray]:
    data, offsets = W.column_bytes(batch.column(batch.schema.get_field_index(text)))
    starts, ends, docs = W.word_spans(data, offsets)
    hashes, at = W.shingles(W.span_hashes(data, starts, ends), docs, k)
    for i in range(len(at) - 1):
        s = np.sort(hashes[at[i] : at[i + 1]])
        yield s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) > 1 else s


def _mark(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit sums that name a set."""
    a = W.mix(s + U(0x51ED270B)).sum(dtype=U).view(np.int64)
    b = W.mix(s ^ U(0xA0761D6478BD642F)).sum(dtype=U).view(np.int64)
    return int(a), int(b)


def _features(k: int, percent: int):
    cells = _Cells(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in W.slices(whole, "text", W.SLICE_BYTES):
                n, a, b, key, vec = [], [], [], [], []
                for s in _sets(batch, "text", k):
                    n.append(len(s))
                    x, y = _mark(s)
                    a.append(x)
                    b.append(y)
                    key.append(cells(s))
                    vec.append(_vector(s, 56, GROUPS))
                at = np.concatenate([[0], np.cumsum([len(x) for x in key])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.columns[2:],
                        batch.column(0),
                        pa.array(n, pa.int64()),
                        pa.array(a, pa.int64()),
                        pa.array(b, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(key), pa.int64())),
                        pa.array(vec, pa.binary()),
                    ],
                    names=[*batch.schema.names[2:], "id", "n", "mark_a", "mark_b", "cells", "vec"],
                )

    return run


def _text_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in W.slices(whole, "text", W.SLICE_BYTES):
                a, b, sets, fine = [], [], [], []
                for s in _sets(batch, "text", k):
                    x, y = _mark(s)
                    a.append(x)
                    b.append(y)
                    sets.append(s.tobytes())
                    fine.append(_vector(s, 40, FINE))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sets, pa.binary()), pa.array(fine, pa.binary())],
                    names=["mark_a", "mark_b", "set", "fine"],
                )

    return run


def _matrix(column: pa.Array, dtype=np.uint8) -> np.ndarray:
    data, _ = W.column_bytes(column)
    return data.view(dtype).reshape(len(column), -1)


def _bounded(percent: int):
    """Pairs whose summed minima are large enough, with the bound on their similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            na, nb = t.column("na").to_numpy(), t.column("nb").to_numpy()
            if not t.num_rows:
                continue
            apart = np.abs(_counts(_matrix(t.column("va"))) - _counts(_matrix(t.column("vb")))).sum(1, dtype=np.int64)
            most = np.minimum((na + nb - apart) // 2, np.minimum(na, nb))
            ok = (100 + percent) * most >= _need(na, nb, percent)
            score = most / np.maximum(na + nb - most, 1)
            yield pa.RecordBatch.from_arrays(
                [t.column("a").filter(pa.array(ok)), t.column("b").filter(pa.array(ok)), pa.array(score[ok], pa.float64())], names=["a", "b", "score"]
            )

    return run


def _closer(percent: int):
    """Pairs that the counts of more groups leave over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if not t.num_rows:
                continue
            apart = np.abs(_counts(_matrix(t.column("va"))) - _counts(_matrix(t.column("vb")))).sum(1, dtype=np.int64)
            both = t.column("na").to_numpy() + t.column("nb").to_numpy()
            ok = pa.array((100 - percent) * both >= (100 + percent) * apart)
            yield pa.RecordBatch.from_arrays([t.column("a").filter(ok), t.column("b").filter(ok)], names=["a", "b"])

    return run


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            ok = np.zeros(t.num_rows, bool)
            for i, (x, y) in enumerate(zip(t.column("sa"), t.column("sb"))):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([t.column("a").filter(pa.array(ok)), t.column("b").filter(pa.array(ok))], names=["a", "b"])

    return run


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link; the sets travel only where the finer counts leave a pair over."""
    with_fine = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("fine").alias("va")), "a")
    with_fine = with_fine.join(sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("fine").alias("vb")), "b")
    close = with_fine.select("a", "b", "na", "nb", "va", "vb").mapInArrow(lean(_closer(percent)), "a long, b long")
    close = saved(close, "close")
    joined = close.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a")
    joined = joined.join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b").select("a", "b", "sa", "sb")
    return joined.mapInArrow(lean(_verified(percent)), "a long, b long")


_PAGE = "cell long, n_min long, n_max long, low binary, high binary, n binary, node binary, comp binary, vec binary"


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one cell in order of size, cut into pages."""
    names = [c.split()[0] for c in _PAGE.split(", ")]
    types = [pa.int64()] * 3 + [pa.binary()] * 6
    for t in batches:
        if not t.num_rows:
            continue
        cell, node, n, comp = (t.column(c).to_numpy() for c in ("cell", "node", "n", "comp"))
        vec = _matrix(t.column("vec"))
        # A page ends with its batch too; a cell's pages are compared with one another in any case.
        at = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        rows = []
        for low, high in zip(at, np.concatenate([at[1:], [len(cell)]])):
            for x in range(low, high, PAGE):
                y = min(x + PAGE, high)
                v = _counts(vec[x:y])
                sizes = n[x:y].min(), n[x:y].max()
                rows.append((cell[x], *sizes, v.min(0).tobytes(), v.max(0).tobytes(), *(c[x:y].tobytes() for c in (n, node, comp, vec))))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), ty) for c, ty in zip(zip(*rows), types)], names=names)


def _firsts(rows: np.ndarray) -> np.ndarray:
    """Rows (ca, cb, score, a, b) that have the largest score of one of their two components; ties by the points."""
    both = np.concatenate([rows, rows[:, [1, 0, 2, 3, 4]]])
    order = np.lexsort((both[:, 4], both[:, 3], -both[:, 2], both[:, 0]))
    own = both[order, 0]
    first = order[np.concatenate([[True], own[1:] != own[:-1]])] if len(rows) else order
    return rows[np.unique(first % max(len(rows), 1))]


def _page_pairs(percent: int, best: bool):
    """Pairs of points of two pages of a cell that lie in different components and pass the bound.

    All of them as (a, b); or with `best` only the most promising of each component, as (ca, cb, score, a, b).
    """
    names = ["ca", "cb", "score", "a", "b"] if best else ["a", "b"]
    fewest = _firsts if best else lambda rows: np.unique(rows, axis=0)
    table = lambda rows: pa.RecordBatch.from_arrays([pa.array(rows[:, i]) for i in range(len(names))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Over batches too, as these are bounded in bytes and a page has many.
        found, n = [], 0
        for t in batches:
            for r in t.to_pylist():
                box = [np.frombuffer(r[c], np.uint8).astype(np.int64) for c in ("low_a", "high_a", "low_b", "high_b")]
                gap = np.maximum(np.maximum(box[0] - box[3], box[2] - box[1]), 0).sum()
                # Points of the two boxes differ by `gap` at least, so their summed minima are too small.
                if (100 - percent) * (r["max_a"] + r["max_b"]) < (100 + percent) * gap:
                    continue
                na, nb = np.frombuffer(r["n_a"], np.int64), np.frombuffer(r["n_b"], np.int64)
                ia, ib = np.frombuffer(r["node_a"], np.int64), np.frombuffer(r["node_b"], np.int64)
                ca, cb = np.frombuffer(r["comp_a"], np.int64), np.frombuffer(r["comp_b"], np.int64)
                x, y = np.nonzero((ca[:, None] != cb[None, :]) & (100 * np.minimum(na[:, None], nb) >= percent * np.maximum(na[:, None], nb)))
                if not len(x):
                    continue
                va, vb = (_counts(np.frombuffer(r[c], np.uint8).reshape(-1, GROUPS // 2)) for c in ("vec_a", "vec_b"))
                most = (na[x] + nb[y] - np.abs(va[x] - vb[y]).sum(1, dtype=np.int64)) // 2
                ok = (100 + percent) * most >= _need(na[x], nb[y], percent)
                x, y, most = x[ok], y[ok], most[ok]
                pair = [np.minimum(ia[x], ib[y]), np.maximum(ia[x], ib[y])]
                if best:
                    # Bounds in millionths, so that all is one table of integers.
                    score = 1_000_000 * most // np.maximum(na[x] + nb[y] - most, 1)
                    pair = [np.minimum(ca[x], cb[y]), np.maximum(ca[x], cb[y]), score, *pair]
                found.append(np.stack(pair, 1))
                if best:
                    found[-1] = _firsts(found[-1])
                n += len(found[-1])
                if n > PAIRS:
                    found = [fewest(np.concatenate(found))]
                    n = len(found[0])
                if n > PAIRS // 2 and len(found) == 1:
                    yield table(found[0])
                    found, n = [], 0
        if found:
            yield table(fewest(np.concatenate(found)))

    return run


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, row: str | None = None) -> DataFrame:
    """Per row of `docs`: its id, n_shingles, component_id, and `keeper` (true for one row of each component).

    Words are runs of characters other than the six ASCII white space ones, with A-Z lower-cased.  Two rows
    link if 100 |A and B| >= percent |A or B| for their sets of k-word shingles; with fewer than k words the
    whole sequence is the one shingle.  component_id is the smallest id that can be reached by links.  A row
    without words, or with a null text, has no shingles and stands alone.  Rows that repeat an id are rows of
    their own: equal ones get equal results, one of them is the keeper.  A null id takes part in links, and is
    nobody's component_id unless all ids of the component are null.  An empty table gives no rows.

    `row` names a long column that tells all rows apart, and adds it to the result as `row`.
    `percent` is at least 50, so that every document differs from its partners in less than it has.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent is between 50 and 100")
    tags = ["tag"] if row else []
    docs = require(docs, doc_id, text, *([row] if row else [])).toDF("id", "text", *tags)
    id_type = docs.schema["id"].dataType.simpleString()
    schema = f"{'tag long, ' if row else ''}id {id_type}, n long, mark_a long, mark_b long, cells array<long>, vec binary"
    rows = saved(docs.mapInArrow(lean(_features(k, percent)), schema).withColumn("row", F.monotonically_increasing_id()), "shingles")

    # Equal sets are one node, named by its first row.
    nodes = saved(
        rows.where("n > 0").groupBy("mark_a", "mark_b", "n").agg(F.min("row").alias("node"), F.min("id").alias("first_id"), F.count("*").alias("copies")), "nodes"
    )
    copies = rows.select("row", "mark_a", "mark_b", "n").join(nodes.where("copies > 1"), ["mark_a", "mark_b", "n"]).where("row <> node")
    points = rows.where("n > 0").join(checked_broadcast(copies.select("row")), "row", "left_anti")
    points = points.withColumnRenamed("row", "node")

    # Cells with two points and more.
    member = points.select("node", F.explode("cells").alias("cell"))
    shared = member.groupBy("cell").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("members")).where("members > 1")
    member = saved(member.join(shared, "cell"), "cells")

    # First the outermost points of every cell against the others.
    vectors = saved(
        points.select("node", "id", "n", "vec", "mark_a", "mark_b").join(member.select("node").distinct(), "node", "left_semi"), "points"
    )
    to_ends = member.where("node <> lo").select(F.col("node").alias("b"), F.col("lo").alias("a")).unionAll(
        member.where("node <> hi and node <> lo").select(F.col("hi").alias("b"), F.col("node").alias("a"))
    )
    shape = vectors.select("node", "n", "vec")

    def promising(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that pass the bound, with their score."""
        pairs = pairs.distinct().join(shape.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("vec").alias("va")), "a")
        pairs = pairs.join(shape.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("vec").alias("vb")), "b")
        pairs = pairs.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b", "na", "nb", "va", "vb")
        return pairs.mapInArrow(lean(_bounded(percent)), "a long, b long, score double")

    ends = saved(promising(to_ends), "ends")

    # The sets of all points that take part in a comparison, from the texts once more.
    ids = checked_broadcast(vectors.select("id").distinct())
    texts = docs.join(ids, docs["id"].eqNullSafe(ids["id"]), "left_semi").select("text")
    sets = texts.mapInArrow(lean(_text_sets(k)), "mark_a long, mark_b long, set binary, fine binary")
    marks = vectors.select("mark_a", "mark_b", "node", "n")
    sets = saved(sets.join(marks, ["mark_a", "mark_b"]).dropDuplicates(["mark_a", "mark_b", "node"]).select("node", "n", "fine", "set"), "sets")

    # The best partner of every point first: this joins most of a group of copies with one comparison each.
    best = ends.groupBy("b").agg(F.max(F.struct("score", "a")).alias("x")).select(F.col("x.a").alias("a"), "b")
    links = saved(_verify(best, sets, percent), "links")
    known = saved(components(links, "a", "b", 1), "known")

    def apart(pairs: DataFrame, known: DataFrame) -> DataFrame:
        """The pairs (a, b, score) between different components ca and cb."""
        pairs = pairs.join(known.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left")
        pairs = pairs.join(known.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
        return pairs.withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")}).where("ca <> cb")

    # The other pairs with an outermost point, where they lie in different components.
    links = saved(links.unionAll(_verify(apart(ends, known), sets, percent)), "links")
    known = saved(components(links, "a", "b", 1), "known")

    # Cells that still have several components.  Up to three points have been compared with one another.
    large = member.where("members > 3").select("cell", "node")

    def still_open(known: DataFrame) -> DataFrame:
        every = large.join(known, "node", "left").select("cell", "node", F.coalesce("component", "node").alias("comp"))
        several = every.groupBy("cell").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("cell")
        return every.join(several, "cell", "left_semi")

    def page_pairs(known: DataFrame, best: bool) -> DataFrame:
        """What `_page_pairs` finds in the cells that have several components."""
        still = saved(still_open(known).join(shape, "node"), "open")
        still = still.select("cell", "node", "n", "comp", "vec").repartitionByRange("cell", "n", "node").sortWithinPartitions("cell", "n", "node")
        pages = still.mapInArrow(lean(_pages), _PAGE)
        pages = saved(pages.withColumn("page", F.monotonically_increasing_id()), "pages")
        side = lambda s: pages.select("cell", F.col("page").alias(f"page_{s}"), F.col("n_min").alias(f"min_{s}"), F.col("n_max").alias(f"max_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("low", "high", "n", "node", "comp", "vec")])
        two = side("a").join(side("b"), "cell").where(
            (F.col("page_a") <= F.col("page_b")) & (100 * F.col("max_b") >= percent * F.col("min_a")) & (100 * F.col("max_a") >= percent * F.col("min_b"))
        )
        return two.mapInArrow(lean(_page_pairs(percent, best)), "ca long, cb long, score long, a long, b long" if best else "a long, b long")

    # Parts of one group of copies that the outermost points did not join: of each component the most promising pair
    # first, so what is handed on grows with the number of components and not with that of their pairs.
    for _ in range(ROUNDS):
        near = page_pairs(known, True).select("score", "a", "b", F.explode(F.array("ca", "cb")).alias("comp"))
        near = near.groupBy("comp").agg(F.max(F.struct("score", (-F.col("a")).alias("x"), (-F.col("b")).alias("y"))).alias("p"))
        near = near.select((-F.col("p.x")).alias("a"), (-F.col("p.y")).alias("b")).distinct()
        links = saved(links.unionAll(_verify(near, sets, percent)), "links")
        # Finished components stand for the links that made them.
        known = saved(components(links, "a", "b"), "known")
        links = known.select(F.col("node").alias("a"), F.col("component").alias("b"))

    # All other pairs of these cells.
    links = links.unionAll(_verify(page_pairs(known, False).distinct(), sets, percent))
    known = saved(components(links, "a", "b"), "components")

    # Back to the rows.
    named = nodes.join(known, "node", "left").select("mark_a", "mark_b", "n", "node", "first_id", F.coalesce("component", "node").alias("component"))
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = named.join(smallest, "component").select("mark_a", "mark_b", "n", "component", "component_id")
    out = saved(rows.select("row", "id", "n", "mark_a", "mark_b", *tags).join(named, ["mark_a", "mark_b", "n"], "left"), "found")
    first = out.where("n > 0").groupBy("component").agg(F.min(F.struct(~F.col("id").eqNullSafe(F.col("component_id")), F.col("row"))).alias("x"))
    keepers = first.select(F.col("x.row").alias("row"), F.lit(True).alias("keeper"))
    out = out.join(keepers, "row", "left")
    return out.select(
        F.col("id").alias(doc_id),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        F.coalesce("keeper", F.col("n") == 0).alias("keeper"),
        *[F.col(c).alias("row") for c in tags],
    )
