"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Every rule gives a text a number; a text is rejected if the number lies above the rule's cutoff.  Cutoffs are
chosen per stratum on labelled documents.  For a cutoff, the false rejections among the n good documents of a
stratum are a binomial sample, so P(X <= k) at the allowed rate is an exact p-value of "this cutoff rejects too
many".  Cutoffs are tested from the loosest on, each only if all looser ones have passed (a fixed sequence, so
no correction within a rule), and the level is divided by the number of rules times strata (Bonferroni).  With
confidence 1 - delta, no stratum loses more than alpha of its good documents to all rules together.  Among the
cutoffs that passed, the one that rejects most bad documents, each good one counted `cost` times, is taken.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from wardline.llm.common import WHITE, require, saved

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rules and their cutoffs from the loosest to the tightest; every number lies between 0 and 1.
GRID = [x / 100 for x in (95, 90, 85, 80, 75, 70, 65, 60, 55, 50, 45, 40, 35, 30, 25, 20, 15, 12, 10, 8, 6, 5, 4, 3, 2)]
RULES = {
    "symbols": lambda: F.least(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)), F.lit(1.0)),
    "upper": lambda: F.least(F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)), F.lit(1.0)),
    "exclaimed": lambda: F.least(F.col("n_exclaimed") / F.greatest(F.col("n_words"), F.lit(1)), F.lit(1.0)),
    "dup_lines": lambda: F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
    "repeated": lambda: F.col("n_repeat_words") / F.greatest(F.col("n_words"), F.lit(1)),
}


def _let(value: Column, body) -> Column:
    """`body` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _repeated(words: Column) -> Column:
    """Words that stand in a 3-word window found twice or more."""

    def of_hashes(h: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            twin = lambda e, i: (e["v"] == F.get(s, i + 1)["v"]) | (e["v"] == F.get(s, i - 1)["v"])
            places = F.transform(F.filter(s, twin), lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2))
            return F.size(F.array_distinct(F.flatten(places)))

        ordered = F.array_sort(F.transform(h, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_let(ordered, of_sorted))

    windows = F.transform(words, lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, 0).otherwise(_let(F.slice(windows, F.lit(1), F.greatest(F.size(words) - 2, F.lit(1))), of_hashes))


def signals(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` without its text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_exclaimed.

    Words are runs of characters other than the six ASCII white space ones; a null text has none.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    words = F.array_remove(F.split(F.translate(t, WHITE, " " * len(WHITE)), " "), "")
    by_word = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated(w).cast("long").alias("n_repeat_words")))
    lines = F.filter(F.split(t, "\n"), lambda line: _without(line, WHITE) != "")
    by_line = _let(
        lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    )
    chars = F.char_length(t)
    count = lambda c: (chars - F.char_length(_without(t, c))).cast("long")
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    out = docs.select(
        *others,
        by_word.alias("_w"),
        by_line.alias("_l"),
        F.char_length(_without(t, WHITE)).cast("long").alias("word_chars"),
        count(SYMBOLS).alias("n_symbols"),
        count(UPPER).alias("n_upper"),
        count("!").alias("n_exclaimed"),
    )
    return out.select(*others, "_w.n_words", "word_chars", "n_symbols", "_l.n_dup_lines", "_w.n_repeat_words", "_l.n_lines", "n_upper", "n_exclaimed")


def _log_factorial(x: Column) -> Column:
    """ln x!, by Stirling's series at x + 8, right to 12 digits."""
    y = x.cast("double") + 8
    series = (y + 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    down = [F.ln(y - k) for k in range(8)]
    return series - sum(down[1:], down[0])


def binomial_at_most(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial with rate p, where k lies below the mean, else 1.

    Terms are added from k down while they matter (ten standard deviations); the rest is bounded by a
    geometric sum and added too, so the value is never too small.
    """
    last = F.exp(_log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p))
    ratio = lambda i: i * (1 - p) / ((n - i + 1) * p)
    terms = F.least(k, F.ceil(10 * F.sqrt(n * p) + 50)).cast("int")
    steps = F.when(terms > 0, F.sequence(F.lit(0), terms - 1)).otherwise(F.array().cast("array<int>"))
    start = F.struct(last.alias("t"), last.alias("s"))

    def add(acc: Column, j: Column) -> Column:
        t = acc["t"] * ratio(k - j)
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

    def finish(acc: Column) -> Column:
        r = ratio(k - terms)
        return F.least(acc["s"] + acc["t"] * r / (1 - r), F.lit(1.0))

    return F.when(k < n * p, F.aggregate(steps, start, add, finish)).otherwise(1.0)


def cutoffs(holdout: DataFrame, alpha: float, delta: float, cost: int) -> DataFrame:
    """(stratum, rule, cutoff) from rows (stratum, good, and the columns of `signals`); a rule without a cutoff has no row.

    All labelled rows count.  Each gives one row per rule, with the number of cutoffs that would reject it,
    and these are counted before any shuffle.
    """
    grid = F.array(*[F.lit(x) for x in GRID])
    rejected_by = lambda x: F.size(F.filter(grid, lambda c: x <= c))  # noqa: E731  cutoffs before the first that rejects
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), rejected_by(f()).alias("at")) for r, f in RULES.items()]))
    rows = holdout.select("stratum", "good", each.alias("x")).groupBy("stratum", "x.rule", "x.at").agg(
        F.sum(F.col("good").cast("long")).alias("good"), F.sum((~F.col("good")).cast("long")).alias("bad")
    )
    # One row per cutoff, with what it and the looser ones reject; the list has an entry per cutoff at most.
    points = rows.groupBy("stratum", "rule").agg(F.sum("good").alias("n"), F.collect_list(F.struct("at", "good", "bad")).alias("h"))
    at = F.explode(F.sequence(F.lit(0), F.lit(len(GRID) - 1)))
    points = points.select("stratum", "rule", "n", "h", at.alias("c"))
    total = lambda field: F.aggregate("h", F.lit(0).cast("long"), lambda acc, e: acc + F.when(e["at"] <= F.col("c"), e[field]).otherwise(0))
    points = points.select("stratum", "rule", "n", "c", total("good").alias("k"), total("bad").alias("bad"))
    # One row, which goes to the driver as a number.
    strata = points.select("stratum").distinct().count()
    p = binomial_at_most(F.col("k"), F.col("n"), alpha / len(RULES))
    passed = (F.col("n") > 0) & (p <= delta / max(1, strata * len(RULES)))
    sequence = Window.partitionBy("stratum", "rule").orderBy("c")
    points = points.withColumn("passed", F.min(passed.cast("int")).over(sequence.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    gain = F.col("bad") - cost * F.col("k")
    best = points.where(F.col("passed") & (gain > 0)).groupBy("stratum", "rule").agg(F.max(F.struct(gain.alias("gain"), (-F.col("c")).alias("c"))).alias("x"))
    return best.select("stratum", "rule", F.element_at(F.array(*[F.lit(x) for x in GRID]), (1 - F.col("x.c")).cast("int")).alias("cutoff"))


def judge(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    stratum: str = "lang",
    quality: str = "quality",
    alpha: float = 0.05,
    delta: float = 0.05,
    cost: int = 5,
    row: str | None = None,
) -> DataFrame:
    """Per row: its id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rejected_by.

    base_failed: fewer than 50 words, or more than half of them repeated.  kept: not base_failed, and no rule of
    the row's stratum with a cutoff rejects it; rejected_by names the rules that do.  Strata with too few
    labelled ids to bound the risk have no cutoffs; the risk is that of good documents which pass the base rule.
    A label counts once per id, with the least of the id's rows; ids with several unlike labels
    and null labels or ids do not count.  A null stratum is one of its own.  `row` names a column that tells all
    rows apart, and adds it to the result as `row`.
    """
    tags = ["row"] if row else []
    rows = saved(signals(require(docs, doc_id, stratum, text, *([row] if row else [])).toDF("id", "stratum", "text", *tags)), "signals")
    rows = rows.withColumn("stratum", F.coalesce(F.col("stratum").cast("string"), F.lit("")))
    truth = require(labels, doc_id, quality).toDF("id", "good").where("id is not null and good is not null")
    truth = truth.groupBy("id").agg(F.min("good").alias("x"), F.max("good").alias("y")).where("x = y").select("id", (F.col("x") == 1).alias("good"))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    # Copies under one id are no further evidence: the least of an id's rows stands for it.
    figures = [c for c in rows.columns if c not in ("id", *tags)]
    holdout = rows.where(~base).join(truth, "id").groupBy("id", "good").agg(F.min(F.struct(*figures)).alias("x")).select("good", "x.*")
    chosen = saved(cutoffs(holdout, alpha, delta, cost), "cutoffs")
    # A row per stratum, at most as many rules as there are.
    chosen = chosen.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cuts"))
    rows = rows.join(chosen, "stratum", "left").withColumn("base_failed", base)
    over = [F.when(f() > F.col("cuts")[r], r) for r, f in RULES.items()]
    rows = rows.withColumn("rejected_by", F.array_compact(F.array(*over)))
    return rows.select(
        F.col("id").alias(doc_id), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept"), "rejected_by", *tags,
    )
