"""Quality classifier with host and path evidence by hierarchical empirical Bayes.

A logistic model on figures of the text gives each document its own evidence: the log odds of being good,
less the prior log odds of the training rows.  Sites add theirs: the expected number of good documents of a
host is a beta-binomial posterior around the global share, that of a path within the host one around the
host's.  The strengths of both priors come from the spread of the shares, so a site with few documents stays
near the level above it.  A document's own evidence is taken out of its sites before it is added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wardline.llm import words as W
from wardline.llm.common import lean, require, saved
from wardline.operators.sizing import checked_broadcast

#: Labelled rows that the text model is fitted on, at most: those with the smallest hash of their id.
SAMPLE = 20_000
FIGURES = ("log_words", "word_length", "upper", "symbols", "exclaimed", "other_marks", "digits", "distinct", "top_word", "twin_lines", "line_words")
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91] = 1
_CLASS[[ord(c) for c in "#*$%&|<>"]] = 2
_CLASS[[ord("!"), ord("?")]] = 3
_CLASS[[ord(c) for c in ".,;:'\"()[]{}-_/\\=+@^~`"]] = 4
_CLASS[48:58] = 5
_SPREAD = 6


def figures(column: pa.Array) -> np.ndarray:
    """One row of FIGURES per text; all zero for a text without words."""
    data, offsets = W.column_bytes(column)
    starts, ends, docs = W.word_spans(data, offsets)
    hashes = W.span_hashes(data, starts, ends)
    n = np.diff(docs)
    out = np.zeros((len(n), len(FIGURES)))
    sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[docs])
    chars = np.maximum(sums(ends - starts), 1)
    kinds = _CLASS[data]
    for place, kind in ((2, 1), (3, 2), (4, 3), (5, 4), (6, 5)):
        count = np.concatenate([[0], np.cumsum(kinds == kind)])
        out[:, place] = (count[offsets[1:]] - count[offsets[:-1]]) / chars
    out[:, 0] = np.log1p(n)
    out[:, 1] = np.log1p(chars / np.maximum(n, 1))
    line_at, line_to, lines = W.word_spans(data, offsets, np.arange(256) == 10)
    line_hash = W.span_hashes(data, line_at, line_to, fold=False)
    for i in np.flatnonzero(n):
        own, count = np.unique(hashes[docs[i] : docs[i + 1]], return_counts=True)
        # By the expected growth of the vocabulary, or long texts would look repetitive.
        out[i, 7] = np.log(len(own)) / np.log1p(n[i])
        out[i, 8] = count.max() / (n[i] + 10)
        m = lines[i + 1] - lines[i]
        out[i, 9] = 1 - len(np.unique(line_hash[lines[i] : lines[i + 1]])) / max(m, 1)
        out[i, 10] = np.log1p(n[i] / max(m, 1))
    out[n == 0] = 0
    return out


def _fit(x: np.ndarray, good: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, spread and weights (the last is the constant) by Newton's method with a ridge."""
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.clip((x - mean) / spread, -_SPREAD, _SPREAD)
    z = np.column_stack([z, z**2, np.ones(len(z))])
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (good - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, spread, w


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for t in W.slices(whole, "text", W.SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([t.column("good"), pa.array(list(figures(t.column("text"))), pa.list_(pa.float64()))], names=["good", "x"])


def _scored(mean, spread, w, prior):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for t in W.slices(whole, "text", W.SLICE_BYTES):
                x = figures(t.column("text"))
                z = np.clip((x - mean) / spread, -_SPREAD, _SPREAD)
                evidence = np.column_stack([z, z**2, np.ones(len(z))]) @ w - prior
                evidence[~x.any(1)] = 0.0
                yield pa.RecordBatch.from_arrays(
                    [t.column("id"), t.column("host"), t.column("path"), *t.columns[4:], pa.array(np.clip(evidence, -30, 30))],
                    names=["id", "host", "path", *t.schema.names[4:], "evidence"],
                )

    return run


def _logit(p: Column) -> Column:
    return F.ln(p / (1 - p))


def _strength(level: DataFrame, mean: Column) -> Column:
    """Pseudo-counts of a beta prior for rows (s, n): their spread around `mean` beyond what sampling explains."""
    noise = F.sum(mean * (1 - mean))
    extra = (F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - mean, 2)) - noise) / F.sum("n")
    inside = F.max(mean * (1 - mean))
    return F.least(F.greatest(inside / F.greatest(extra, F.lit(1e-6)) - 1, F.lit(1.0)), F.lit(1e4))


def classify(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    host: str = "source",
    path: str = "lang",
    quality: str = "quality",
    threshold: float = 0.5,
    sample: int = SAMPLE,
    row: str | None = None,
) -> DataFrame:
    """Per row: its id, evidence (log odds of the text), site (the path's share of good documents), p_good, kept.

    The text model is fitted on `sample` labelled rows at most; host and path shares cover all rows.  Null hosts
    and paths are sites of their own.  A text without words has no evidence, so its site decides.  A label counts
    once per id; null or contradictory ones do not.  Without labels of both kinds there is no evidence, and all
    rows are kept.  Rows that repeat an id are scored alike.  `row` names a column that tells all rows apart, and
    adds it to the result as `row`.
    """
    tags = ["row"] if row else []
    rows = require(docs, doc_id, text, host, path, *([row] if row else [])).toDF("id", "text", "host", "path", *tags)
    truth = require(labels, doc_id, quality).toDF("id", "good").where("id is not null and good is not null")
    truth = truth.groupBy("id").agg(F.min("good").alias("x"), F.max("good").alias("y")).where("x = y").select("id", (F.col("x") == 1).alias("good"))
    # `sample` rows at most, so small enough to broadcast.
    chosen = checked_broadcast(truth.orderBy(F.xxhash64("id"), "id").limit(sample))
    # One row for each id, however often it is repeated.
    one = rows.join(chosen, "id").groupBy("id", "good").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    fit = one.select("good", "text").mapInArrow(lean(_sampled), "good boolean, x array<double>").toPandas()
    if fit.empty or fit["good"].nunique() < 2:
        model = (np.zeros(len(FIGURES)), np.ones(len(FIGURES)), np.zeros(2 * len(FIGURES) + 1), 0.0)
    else:
        good = fit["good"].to_numpy(float)
        mean, spread, w = _fit(np.stack(fit["x"].to_numpy()), good)
        model = (mean, spread, w, float(np.log(good.mean() / (1 - good.mean()))))
    prior = 1 / (1 + np.exp(-model[3]))
    types = {c: rows.schema[c].dataType.simpleString() for c in ("id", "host", "path", *tags)}
    scored = rows.mapInArrow(lean(_scored(*model)), ", ".join(f"{c} {t}" for c, t in types.items()) + ", evidence double")
    alone = F.lit(1.0) / (1 + F.exp(-(F.col("evidence") + model[3])))
    scored = saved(scored.withColumns({"host": F.coalesce(F.col("host").cast("string"), F.lit("")), "path": F.coalesce(F.col("path").cast("string"), F.lit("")), "own": alone}), "evidence")

    # Sums per path and host; the global figures are one row.
    paths = scored.groupBy("host", "path").agg(F.sum("own").alias("s"), F.count("*").alias("n"))
    hosts = paths.groupBy("host").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    top = hosts.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    share = float(np.clip(top.s / top.n, 1e-6, 1 - 1e-6)) if top.n else prior
    k_host = (hosts.agg(_strength(hosts, F.lit(share)).alias("k")).first().k or 1.0) if top.n else 1.0
    hosts = hosts.select("host", F.col("s").alias("host_s"), F.col("n").alias("host_n"))
    around = F.greatest(F.least((F.col("host_s") + k_host * share) / (F.col("host_n") + k_host), F.lit(1 - 1e-6)), F.lit(1e-6))
    sites = paths.join(hosts, "host")
    k_path = (sites.agg(_strength(sites, around).alias("k")).first().k or 1.0) if top.n else 1.0
    scored = scored.join(sites, ["host", "path"])
    # Without the document itself, at both levels.
    of_host = (F.col("host_s") - F.col("own") + k_host * share) / (F.col("host_n") - 1 + k_host)
    of_path = (F.col("s") - F.col("own") + k_path * of_host) / (F.col("n") - 1 + k_path)
    site = F.greatest(F.least(of_path, F.lit(1 - 1e-6)), F.lit(1e-6))
    scored = scored.withColumn("site", site)
    p = F.lit(1.0) / (1 + F.exp(-(F.col("evidence") + _logit(F.col("site")))))
    return scored.select(F.col("id").alias(doc_id), "evidence", "site", p.alias("p_good"), (p >= threshold).alias("kept"), *tags)
