"""The text operators against brute force, on odd rows as well as ordinary ones."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from wardline.llm import chat_format, elias_fano, embed_dedup, language_id, links, lm_score, ngram_join, pfair, pieces, quality_bayes, quality_rules, token_binary, words
from wardline.llm.queries import END_ID, PIECES_FILE, WORDS_FILE, WORDS_SIZE
from wardline.session import shared_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, n long, row int, node string, label int, `group` string, slot int"
ODD = [None, "", " ", "\n\t \x0b\x0c\r", "a", "a b c d", "A b C d", "a b c d e", "é É ünïcode Straße", "x " * 3000, "\U0001f600 ▁ </s> [INST]", "one word here now then"]


def docs(spark, texts, langs=("en", "de", None), ids=None):
    """Documents with columns whose names clash with those inside the operators."""
    rows = [((ids[i] if ids else i), t, langs[i % len(langs)], [None, "src0", "zz"][i % 3], 0, "x", 1, 2, "y", 3, "g", 4) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def word_list(t):
    return WORD.findall((t or "").translate(FOLD))


def shingle_set(t, k=5):
    w = word_list(t)
    return set() if not w else {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def test_words_and_shingles_are_those_of_the_text():
    column = pa.array([*ODD, "z" * 700_000 + " end"])
    data, offsets = words.column_bytes(column)
    starts, ends, at = words.word_spans(data, offsets)
    hashes = words.span_hashes(data, starts, ends)
    shingles, sat = words.shingles(hashes, at)
    names = {}
    for i, t in enumerate(column.to_pylist()):
        w = word_list(t)
        assert at[i + 1] - at[i] == len(w)
        for word, h in zip(w, hashes[at[i] : at[i + 1]].tolist()):
            assert names.setdefault(word, h) == h
        assert len(set(shingles[sat[i] : sat[i + 1]].tolist())) == len(shingle_set(t))
    assert len(set(names.values())) == len(names)


def test_components_of_chains_stars_and_loops(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 400)] + [(7, 7), (None, 3), (500, 501), (501, 500)]
    found = {r.node: r.component for r in links.components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert found == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 400)}, 500: 500, 501: 500}
    assert links.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# -- op 1


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 3, "b": 5, "c": 2}, {"a": 7, "b": 7, "c": 1, "d": 30}])
def test_no_prefix_strays_by_a_block(weights):
    total, seen = sum(weights.values()), Counter()
    for s, i, slot, release, deadline in sorted(pfair.period(weights), key=lambda x: x[2]):
        assert release <= slot < deadline and i == seen[s]
        seen[s] += 1
        assert all(abs(seen[x] - w * (slot + 1) / total) < 1 for x, w in weights.items())


def test_every_row_has_one_place_and_sources_keep_their_weights(spark):
    sources = ["a"] * 700 + ["b"] * 200 + ["c"] * 90 + ["q"] * 5 + [None] * 5
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(sources)], "doc_id long, source string")
    out = pfair.mix(rows, {"a": 50, "b": 30, "c": 15}, 5, block_rows=10, task_rows=40).collect()
    assert sorted(r.doc_id for r in out) == list(range(1000))
    by_slot = {s: list(g) for s, g in itertools.groupby(sorted(out, key=lambda r: (r.slot, r.place)), key=lambda r: r.slot)}
    assert sorted(by_slot) == list(range(70 + 20 + 9 + 1))
    for slot, g in by_slot.items():
        assert len({(r.group, r.block) for r in g}) == 1 and [r.place for r in g] == list(range(len(g)))
        assert all(r.release <= slot < r.deadline for r in g)
    # Until the first source runs out, no source strays by a block.
    ends = min(max(s for s, g in by_slot.items() if g[0].group == x) for x in ("a", "b", "c", ""))
    count = Counter()
    for slot in range(ends + 1):
        count[by_slot[slot][0].group] += 1
        assert all(abs(count[x] - w * (slot + 1) / 100) < 1 for x, w in (("a", 50), ("b", 30), ("c", 15), ("", 5)))
    again = pfair.mix(rows.repartition(7), {"a": 50, "b": 30, "c": 15}, 5, block_rows=10, task_rows=1000).collect()
    assert sorted(out) == sorted(again)


# -- op 2


def test_rule_figures_match_brute_force(spark):
    texts = [*ODD, "a b c a b c x y", "l1 x\nl1 x\n\n  \nl1 x\nq # * $", "p q r s p q r", None]
    got = {r.doc_id: r for r in quality_rules.judge(docs(spark, texts), labels(spark, [])).collect()}
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        windows = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        often = Counter(windows)
        covered = {j + d for j, x in enumerate(windows) if often[x] > 1 for d in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and r.kept == (not r.base_failed)
    assert quality_rules.judge(docs(spark, []), labels(spark, [])).count() == 0


def test_binomial_bound_is_exact_and_cutoffs_keep_the_good(spark):
    cases = [(k, n, p) for n in (1, 20, 400, 3000) for p in (0.01, 0.05) for k in {0, 1, int(n * p / 2), int(n * p) - 1} if 0 <= k < n * p]
    for k, n, p in cases:
        true = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
        got = spark.range(1).select(quality_rules.binomial_at_most(F.lit(k), F.lit(n), p).alias("x")).first().x
        assert true * (1 - 1e-9) <= got <= true * (1 + 1e-6)
    rng = random.Random(5)
    good = [" ".join(f"w{rng.randrange(9999)}" for _ in range(60)) for _ in range(900)]
    bad = [" ".join(f"w{rng.randrange(9999)}***" for _ in range(60)) for _ in range(100)]
    d = docs(spark, good + bad, langs=("en",))
    out = quality_rules.judge(d, labels(spark, [(i, int(i < 900), 0) for i in range(1000)])).collect()
    assert all(r.kept == (r.doc_id < 900) for r in out) and all("symbols" in r.rejected_by for r in out if not r.kept)
    # Too few labels: nothing can be guaranteed, so nothing is rejected.
    few = quality_rules.judge(d, labels(spark, [(i, int(i < 900), 0) for i in range(850, 950)]))
    assert few.where("not kept").count() == 0


# -- op 3


def test_classifier_on_labelled_rows_and_without_labels(spark, sf):
    d, truth = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = quality_bayes.classify(d, truth)
    assert out.count() == d.count()
    wrong = out.join(truth, "doc_id").where("kept <> (quality = 1)").count()
    assert wrong <= 0.03 * truth.count()
    odd = docs(spark, ODD, ids=[None, 1, 1, *range(3, 12)])
    assert quality_bayes.classify(odd, truth).count() == len(ODD)
    bare = quality_bayes.classify(odd, labels(spark, [(1, None, 0), (None, 1, 0), (3, 0, 0), (3, 1, 0)])).collect()
    assert len(bare) == len(ODD) and all(r.kept and r.evidence == 0 for r in bare)
    assert quality_bayes.classify(docs(spark, []), truth).count() == 0


def test_classifier_on_labels_it_has_not_seen(spark):
    sf = "/root/testdata/sf0.01"
    d, truth = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    # The fold goes by the text, so that no copy of a document lies in both.
    held = d.where(F.crc32(F.col("text").cast("binary")) % 3 == 0).select("doc_id").distinct()
    out = quality_bayes.classify(d, truth.join(held, "doc_id", "left_anti")).join(held, "doc_id").join(truth, "doc_id").cache()
    bad, wrong = out.where("quality = 0"), out.where("kept <> (quality = 1)")
    figures = bad.count(), bad.where("not kept").count(), wrong.count(), out.count()
    assert figures[0] >= 20 and figures[1] >= 0.8 * figures[0] and figures[2] <= 0.05 * figures[3], figures


def test_sparse_sites_stay_near_the_level_above(spark):
    text = "word " * 5
    rows = [(i, text, "small" if i == 0 else "big", "p") for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    out = {r.doc_id: r for r in quality_bayes.classify(d, labels(spark, [])).collect()}
    assert abs(out[0].site - out[5].site) < 1e-6


# -- op 4


def test_losses_match_brute_force(spark):
    texts = ["a b a b c", "a b c", "q r s q", None, "", "a A a", "b c d"]
    target = [0, 5]
    d = docs(spark, texts)
    got = {r.doc_id: r for r in lm_score.score(d, spark.createDataFrame([(i,) for i in target], "doc_id long")).collect()}
    lists = [word_list(t) for t in texts]
    size = len({w for x in lists for w in x}) + 1

    def loss(i, members, scale):
        uni, ctx, pair = Counter(), Counter(), Counter()
        for j in members:
            if j != i:
                uni.update(lists[j])
                ctx.update(lists[j])
                ctx["^"] += bool(lists[j])
                pair.update(zip(["^", *lists[j]], lists[j]))
        every, out = sum(uni.values()) * scale, []
        for v, w in zip(["^", *lists[i]], lists[i]):
            p = (uni[w] * scale + 1) / (every + size)
            n = ctx[v] * scale
            out.append(-math.log((min(pair[v, w] * scale, n) + lm_score.STRENGTH * p) / (n + lm_score.STRENGTH)))
        return sum(out) / len(out)

    scale = sum(len(lists[i]) for i in target) / sum(map(len, lists))
    for i, x in enumerate(lists):
        r = got[i]
        assert r.n_words == len(x)
        if not x:
            assert r.score is None
            continue
        a, b = loss(i, target, 1.0), loss(i, range(len(texts)), scale)
        assert abs(r.target_loss - a) < 1e-6 and abs(r.background_loss - b) < 1e-6 and abs(r.score - (a - b)) < 1e-6
    assert lm_score.score(docs(spark, []), d.select("doc_id")).count() == 0
    assert lm_score.score(d, d.select("doc_id").limit(0)).count() == len(texts)


@pytest.mark.parametrize("named", [0, 700])
def test_every_word_and_pair_has_a_count_of_its_own(spark, named):
    rng = random.Random(4)
    # Far more words and pairs than fixed tables of 32,768 and 524,288 places hold apart, repeated and null ids among the rows.
    lists = [[f"w{rng.randrange(40_000)}" for _ in range(2_000)] for _ in range(270)]
    lists += [[f"w{int(rng.paretovariate(0.5))}" for _ in range(500)] for _ in range(60)] + [["a", "b", "a"], [], ["a", "b", "a"]]
    ids = [i if i % 7 else [None, 3][i % 2] for i in range(len(lists))]
    target = {i for i in ids if i is not None and i % 3 == 0}
    d = docs(spark, [" ".join(x) for x in lists], ids=ids)
    got = lm_score.score(d, spark.createDataFrame([(i,) for i in target], "doc_id long"), named=named).collect()
    uni, ctx, pair, total = ([Counter(), Counter()] for _ in range(4))
    pairs = lambda x: list(zip(["^", *x], x))
    for i, x in zip(ids, lists):
        for side in (0, 1) if i in target else (0,):
            uni[side].update(x)
            ctx[side].update([*x, *(["^"] if x else [])])
            pair[side].update(pairs(x))
            total[side]["n"] += len(x)
    assert len(uni[0]) > 1 << 15 and len(pair[0]) > 1 << 19

    def loss(i, x, side):
        scale = 1.0 if side else total[1]["n"] / total[0]["n"]
        own = side == 0 or i in target
        own_uni, own_pair = (Counter(x), Counter(pairs(x))) if own else (Counter(), Counter())
        out = []
        for v, w in pairs(x):
            p = ((uni[side][w] - own_uni[w]) * scale + 1) / ((total[side]["n"] - own * len(x)) * scale + len(uni[0]) + 1)
            n = (ctx[side][v] - (own if v == "^" else own_uni[v])) * scale
            out.append(-math.log(((pair[side][v, w] - own_pair[v, w]) * scale + lm_score.STRENGTH * p) / (n + lm_score.STRENGTH)))
        return sum(out) / len(out)

    figures = lambda rows: sorted((-1 if i is None else i, n, *(() if a is None else (a, b))) for i, n, a, b in rows)
    want = figures((i, len(x), loss(i, x, 1) if x else None, loss(i, x, 0) if x else None) for i, x in zip(ids, lists))
    have = figures((r.doc_id, r.n_words, r.target_loss, r.background_loss) for r in got)
    assert len(want) == len(have) and all(a == pytest.approx(b, abs=1e-6) for a, b in zip(want, have))


# -- op 5


def test_elias_fano_round_trip():
    rng = np.random.default_rng(1)
    for n, u in ((0, 1), (1, 0), (5, 3), (1000, 10**6), (5000, 100), (3000, 10**9)):
        x = np.sort(rng.integers(0, u + 1, n))
        code = elias_fano.encode(x)
        e = elias_fano.EliasFano(code + b"more")
        assert e.size == len(code) and (e.all() == x).all() and all(e.select(i) == x[i] for i in range(0, n, max(1, n // 40)))
        if n >= 1000:
            assert 8 * len(code) <= n * (2.2 + max(0, math.log2(u / n))) + 400
    with pytest.raises(ValueError):
        elias_fano.encode(np.array([3, 2]))


def test_blocks_hold_the_tokenizers_ids_in_order(spark, sf):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(WORDS_FILE)
    texts = [*ODD, "it's <|endoftext|> x<|endoftext|>y", "\x85 \x1c a", *[r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]]
    ids = [None, -5, *range(7, 5 + len(texts))]
    path = shared_dir(spark, "blocks")
    token_binary.write(docs(spark, texts, ids=ids).repartition(5), path, token_binary.word_tokenizer(WORDS_FILE), END_ID, WORDS_SIZE, block_ids=3000)
    out = sorted(token_binary.read_index(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in out] == ids
    at = 0
    for r, t in zip(out, texts):
        want = [*own.encode(t or "", add_special_tokens=False).ids, END_ID]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        at += len(want)
    empty = shared_dir(spark, "blocks")
    token_binary.write(docs(spark, []), empty, token_binary.word_tokenizer(WORDS_FILE), END_ID, WORDS_SIZE)
    assert token_binary.read_index(spark, empty).count() == 0


# -- op 6


def brute_components(ids, linked):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(ids)), 2):
        if linked(i, j):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    members = {}
    for i in range(len(ids)):
        members.setdefault(find(i), []).append(ids[i])
    return [min((x for x in members[find(i)] if x is not None), default=None) for i in range(len(ids))]


@pytest.mark.parametrize("percent", [80, 60])
def test_near_copies_match_brute_force(spark, percent):
    rng = random.Random(percent)
    passage = [f"p{i}" for i in range(60)]
    texts = [*ODD, "a b c d", "x y"]
    for size in (6, 9, 30, 120, 400):
        base = [f"w{rng.randrange(4000)}" for _ in range(size)]
        texts.append(" ".join(base))
        for _ in range(14):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, size // 18))):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(9999)}"
            texts.append(" ".join(copy))
    texts += [" ".join([f"z{rng.randrange(9999)}" for _ in range(rng.randrange(10, 40))] + passage) for _ in range(40)]
    texts += texts[-3:] * 3
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    got = {r.doc_id: r for r in ngram_join.jaccard_components(docs(spark, texts, ids=ids), percent=percent).collect()}
    sets = [shingle_set(t) for t in texts]
    linked = lambda i, j: bool(sets[i] and sets[j]) and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    want = brute_components(ids, linked)
    for i, c in zip(ids, want):
        assert (got[i].n_shingles, got[i].component_id) == (len(sets[ids.index(i)]), c)
        assert got[i].keeper == (got[i].n_shingles == 0 or i == c)


def test_near_copies_with_repeated_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    near = text + " extra"
    out = ngram_join.jaccard_components(docs(spark, [text, text, near, "other words here", text], ids=[4, 4, 9, 9, None])).collect()
    assert sorted((r.doc_id or -1, r.component_id, r.n_shingles) for r in out) == [(-1, 4, 36), (4, 4, 36), (4, 4, 36), (9, 4, 37), (9, 9, 1)]
    assert sum(r.keeper for r in out) == 2
    assert ngram_join.jaccard_components(docs(spark, [])).count() == 0


def test_best_pairs_follow_the_components_and_not_their_pairs():
    rng = np.random.default_rng(3)
    comps = list(itertools.combinations(range(60), 2))
    rows = np.array([(x, y, rng.integers(5), 100 + x, 200 + y) for x, y in comps])
    kept = ngram_join._firsts(rows)
    assert len(kept) <= 60
    for c in range(60):
        own = rows[(rows[:, 0] == c) | (rows[:, 1] == c)]
        best = min(own.tolist(), key=lambda r: (-r[2], r[3], r[4]))
        assert best in kept.tolist()
    assert len(ngram_join._firsts(rows[:0])) == 0 and len(ngram_join._firsts(rows[:1])) == 1


def test_cells_hold_every_pair_that_links():
    rng = np.random.default_rng(3)
    cells = ngram_join._Cells(80)
    for n in (1, 2, 4, 5, 9, 31, 64, 250, 1023, 1030, 4000):
        for _ in range(15):
            common = int(np.ceil(0.8 * n))
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
            more = rng.integers(0, 1 << 63, int((common - 0.8 * n) / 0.8), dtype=np.uint64)
            b = np.concatenate([a[:common], more])
            a, b = np.unique(a), np.unique(b)
            both = len(np.intersect1d(a, b))
            assert 100 * both < 80 * (len(a) + len(b) - both) or len(np.intersect1d(cells(a), cells(b)))


# -- op 7


@pytest.mark.parametrize("tile", [4, 2048])
def test_embedding_links_match_brute_force(spark, tile):
    rng = np.random.default_rng(9)
    rows, n = [], 0
    for label in (1, 2, None):
        for _ in range(6):
            centre = rng.standard_normal(24)
            for spread in (0, 0, 0.05, 0.1, 0.2, 0.3):
                rows.append((n, [float(x) for x in np.float32(centre + spread * rng.standard_normal(24))], label))
                n += 1
    rows += [(n, None, 1), (n + 1, [0.0] * 24, 1), (n + 2, [float("nan")] + [1.0] * 23, 1), (n + 3, [], 2), (n + 4, [None] * 24, 2), (n + 5, [1.0], 1), (n + 6, [2.0], 1)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, id string, node int")
    got = {r.vec_id: r for r in embed_dedup.near_copies(table, tile=tile).collect()}

    def linked(i, j):
        (_, a, x), (_, b, y) = rows[i], rows[j]
        if x is None or x != y or not a or not b or None in a or None in b or len(a) != len(b):
            return False
        a, b = np.float32(a).astype(float), np.float32(b).astype(float)
        return bool(a.any() and b.any() and np.isfinite([*a, *b]).all() and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93)

    want = brute_components([r[0] for r in rows], linked)
    for i, c in enumerate(want):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (sum(linked(i, j) for j in range(len(rows)) if j != i), c, c == i)
    assert embed_dedup.near_copies(table.limit(0)).count() == 0


# -- op 8


def test_language_of_held_out_and_odd_texts(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.train(d.where(language_id.fold() != 2))
    out = language_id.predict(d, model).join(d, "doc_id").where(language_id.fold() == 2)
    assert out.where("lang_pred <> lang").count() <= 0.02 * out.count()
    odd = language_id.predict(docs(spark, [*ODD, "1234 !?"]), model).collect()
    for r, t in zip(sorted(odd, key=lambda r: r.doc_id), [*ODD, "1234 !?"]):
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in t or "")) and 0 <= r.score <= 1
    assert language_id.train(d.limit(0)) is None
    assert {r.lang_pred for r in language_id.predict(docs(spark, ODD), None).collect()} == {"und"}


def test_no_language_and_no_letter_is_left_out(spark):
    # One language has only one, very long text; 420 have a few texts of their own letters, 6,300 in all.
    rows = [(0, "żółw gęś " * 30_000, "pl")]
    own = lambda i: "".join(chr(0x4E00 + 15 * i + j) for j in range(15))
    rows += [(1 + 3 * i + k, f"{own(i)} {own(i)[::-1]}", f"x{i}") for i in range(420) for k in range(3)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(model.languages) == {r[2] for r in rows} and model.alphabet.size > 6_300
    asked = [(i, own(i), f"x{i}") for i in range(420)] + [(999, "gęś żółw", "pl")]
    out = language_id.predict(spark.createDataFrame(asked, "doc_id long, text string, lang string"), model).collect()
    assert {(r.doc_id, r.lang_pred) for r in out} == {(i, lang) for i, _, lang in asked}


def test_every_letter_has_symbols_of_its_own():
    letters = np.array([i for i in range(0x110000) if chr(i).isalpha()], np.uint32)
    alphabet = language_id.Alphabet(letters)
    symbols, at = alphabet.symbols(letters, np.arange(len(letters) + 1))
    assert len(letters) > 1 << 16 and symbols.max() < (1 << alphabet.bits) - 1
    assert len({tuple(symbols[x:y]) for x, y in zip(at, at[1:])}) == len(letters)


def test_kneser_ney_sums_to_one():
    flat, at = language_id._codepoints(pa.array(["banana bandana", "abab ana", None, ""]))
    alphabet = language_id.Alphabet(np.unique(flat[flat != 32]))
    codes, _ = language_id._grams(alphabet.numbers(flat), at)
    model = language_id.KneserNey(["x"], alphabet, [np.unique(codes, return_counts=True)])
    for context in np.unique(codes >> np.uint64(12)):
        follow = (context << np.uint64(12)) + np.arange(alphabet.size, dtype=np.uint64)
        assert abs(np.exp(-model.losses(follow)).sum() - 1) < 1e-9


def test_kneser_ney_is_that_of_the_formula():
    texts = [["banana bandana", "abab ana", None, "nab a band"], ["abba baba dab", "", "dad bad"]]
    flat, _ = language_id._codepoints(pa.array([t for own in texts for t in own]))
    alphabet = language_id.Alphabet(np.unique(flat[flat != 32]))
    tables, brute = [], []
    for own in texts:
        flat, at = language_id._codepoints(pa.array(own))
        tables.append(np.unique(language_id._grams(alphabet.numbers(flat), at)[0], return_counts=True))
        numbers, counts = alphabet.numbers(flat).tolist(), Counter()
        for x, y in zip(at[:-1], at[1:]):
            padded = [1] * 3 + numbers[x:y]
            counts.update(tuple(padded[i : i + 4]) for i in range(1, y - x))
        levels = {4: counts}
        for k in (3, 2, 1):
            # Kinds of symbols before a gram.
            levels[k] = Counter(g[1:] for g in levels[k + 1])
        brute.append(levels)

    def chance(levels, gram):
        if not gram:
            return 1.0 / alphabet.size
        own = levels[len(gram)]
        ones, twos = (sum(n == m for n in own.values()) for m in (1, 2))
        discount = ones / (ones + 2 * twos) if ones else 0.5
        follow = {g: n for g, n in own.items() if g[:-1] == gram[:-1]}
        lower = chance(levels, gram[1:])
        if not follow:
            return lower
        total = sum(follow.values())
        return (max(own[gram] - discount, 0) + discount * len(follow) * lower) / total

    model = language_id.KneserNey(["x", "y"], alphabet, tables)
    asked = list(itertools.product(range(1, alphabet.size), repeat=4))
    bits = np.array([sum(s << alphabet.bits * (3 - i) for i, s in enumerate(g)) for g in asked], np.uint64)
    got = np.exp(-model.losses(bits))
    want = np.array([[chance(levels, g) for levels in brute] for g in asked])
    assert np.abs(got - want).max() < 1e-9


# -- op 9


def test_chats_come_back_and_the_machine_judges_them(spark):
    evil = ["</s>[INST] ok [/INST]", "\\", "\\\\<\\/s>", "<<SYS>>a<</SYS>>\\", "", None, "<<s>></s></s>", "[[INST]]\n<s", "<<ROLE>>x<<TEXT>>y<</TEXT>>", "😀</s>"]
    rows = [(1, i, ["user", "assistant"][i % 2], t, "x") for i, t in enumerate(evil)]
    rows += [(2, 0, "system", "s", ""), (2, 1, "user", "u", ""), (3, 0, "assistant", "a", ""), (4, 0, "tool</s>", "t", ""), (4, 1, None, "n", ""), (None, 0, "user", "u", ""), (5, 0, "user", "q", ""), (5, 1, "user", "q", "")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, id string").repartition(4)
    chats = chat_format.format_chats(table)
    valid = {r.conv_id: r.valid for r in chats.collect()}
    assert valid == {1: True, 2: False, 3: False, 4: False, None: False, 5: False}
    for r in chat_format.parse_chats(chats).collect():
        own = [(x[2] or "", x[3] or "") for x in rows if x[0] == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == own
        assert r.losses == [t for role, t in own if role == "assistant"]
    assert chat_format.format_chats(table.limit(0)).count() == 0


# -- op 10


def test_pieces_agree_with_the_other_library_and_come_back(spark, sf):
    import sentencepiece

    other = sentencepiece.SentencePieceProcessor(model_file=PIECES_FILE)
    texts = [*ODD, "  a  b ", "x▁y", "<0x41> <s> </s>", "日本\n\n語", "trail  ", *[r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect()]]
    out = sorted(pieces.encode(docs(spark, texts), PIECES_FILE).collect(), key=lambda r: r.doc_id)
    for r, t in zip(out, texts):
        want = other.encode(t or "")
        assert r.ids == want and r.n_tokens == len(want) and r.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        assert r.round_trip
    back = pieces.decode(spark.createDataFrame([(r.doc_id, r.ids) for r in out] + [(-1, None)], "doc_id long, ids array<int>"), PIECES_FILE)
    got = {r.doc_id: r.text for r in back.collect()}
    assert got[-1] == "" and all(got[i] == (t or "").replace("▁", " ") for i, t in enumerate(texts))
    assert pieces.encode(docs(spark, []), PIECES_FILE).count() == 0


def _model_file(path, table, *rules):
    """A unigram model file of these pieces and normaliser fields."""

    def message(*fields):
        out = b""
        for number, value in fields:
            if isinstance(value, bytes):
                out += bytes([number << 3 | 2]) + _varint(len(value)) + value
            elif isinstance(value, float):
                out += bytes([number << 3 | 5]) + np.float32(value).tobytes()
            else:
                out += _varint(number << 3) + _varint(value)
        return out

    def _varint(n):
        out = b""
        while n > 127:
            out += bytes([n & 127 | 128])
            n >>= 7
        return out + bytes([n])

    data = b"".join(message((1, message((1, p.encode()), (2, s), (3, k)))) for p, s, k in table)
    data += message((2, message((3, 1)))) + message((3, message(*rules)))
    path.write_bytes(data)
    return str(path), data


UNIGRAMS = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("▁", -2.0, 1), ("▁a", -1.5, 1), ("a", -3.0, 1), ("b", -3.0, 1), ("ab", -1.0, 1)]


def test_a_unigram_model_is_rebuilt(tmp_path):
    import sentencepiece

    file, data = _model_file(tmp_path / "m.model", UNIGRAMS, (3, 1), (4, 1), (5, 1))
    model = pieces.parse_model(data)
    assert model.kind == pieces.UNIGRAM and model.pieces == UNIGRAMS and model.squeeze and model.unk_id == 0
    other = sentencepiece.SentencePieceProcessor(model_file=file)
    texts = ["a ab", "  abab   b ", "b"]
    ids, n, good, same = pieces.Codec(file, 1, True).encode(pa.array(texts))
    to = np.cumsum(n)
    assert [ids[b - k : b].tolist() for b, k in zip(to, n)] == other.encode(texts) and good.all() and same.all()


def test_parity_covers_the_normaliser(tmp_path):
    import sentencepiece

    rules = pieces.parse_model(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()).charsmap
    assert len(rules) > 100_000
    table = [*UNIGRAMS, ("8", -3.0, 1), ("1", -3.0, 1), ("é", -3.0, 1), ("…", -3.0, 1), (".", -3.0, 1)]
    file, _ = _model_file(tmp_path / "n.model", table, (2, rules), (3, 1), (4, 1), (5, 1))
    other = sentencepiece.SentencePieceProcessor(model_file=file)
    texts = ["ａｂ　 ａ", "a\u00a0\tb\n", "e\u0301b", "①⑧ ab", "a…", "", None, "  ", "ab " * 40_000]
    codec = pieces.Codec(file, 1, True)
    ids, n, _, same = codec.encode(pa.array(texts))
    to = np.cumsum(n)
    assert [ids[b - k : b].tolist() for b, k in zip(to, n)] == [other.encode(t or "") for t in texts] and same.all()
    # Without its map of characters the texts that need it differ, and the mark says so.
    codec = pieces.Codec(file, 1, True)
    codec.normal = pieces.normalizer(pieces.Model(squeeze=True))
    same = codec.encode(pa.array(texts))[3]
    assert not same[:5].any() and same[5:].all()


def test_files_are_read_in_place():
    assert WORDS_FILE == public_tokenizers.path("word_bpe_49k.json")


def test_many_places_of_a_sequence_at_once():
    rng = np.random.default_rng(8)
    for n, top in ((1, 5), (1000, 10), (20_000, 400), (5000, 1)):
        values = np.cumsum(rng.integers(0, top + 1, n))
        coded = elias_fano.EliasFano(elias_fano.encode(values))
        at = np.unique(rng.integers(0, n, max(1, n // 3)))
        assert (coded.select_many(at) == values[at]).all() and (coded.select_many(np.arange(n)) == values).all()
        assert coded.select_many(np.empty(0, int)).size == 0
    with pytest.raises(IndexError):
        coded.select_many(np.array([n]))


def test_copies_of_a_label_are_no_evidence(spark):
    """30 good documents guarantee no cutoff, however often their rows are repeated."""
    good = [(i, "en", " ".join(f"word{i}x{j}" for j in range(60))) for i in range(30)]
    odd = [(1000 + i, "en", " ".join(f"{'#' * 9}{i}{j}" for j in range(60))) for i in range(300)]
    labels = spark.createDataFrame([(i, 1) for i in range(30)] + [(1000 + i, 0) for i in range(300)], "doc_id long, quality int")
    for times in (1, 30):
        docs = spark.createDataFrame(good * times + odd + [(None, "en", good[0][2])] * 50, "doc_id long, lang string, text string")
        assert quality_rules.judge(docs, labels).where("size(rejected_by) > 0").count() == 0


def test_the_sample_is_bounded_in_rows(spark, monkeypatch):
    seen = []
    fit = quality_bayes._fit
    monkeypatch.setattr(quality_bayes, "_fit", lambda x, y: seen.append(len(x)) or fit(x, y))
    docs = spark.createDataFrame([(1, f"good text number {i}", "s", "en") for i in range(500)] + [(2, "bad", "s", "en"), (None, "x", None, None)], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    assert quality_bayes.classify(docs, labels, sample=3).count() == 502 and seen == [2]


def test_a_heavy_id_is_in_many_tiles(spark):
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, "src0" if i % 2 else "other") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    out = pfair.place(docs, {"src0": 600}, 400, "doc_id", "source", 10, 100)
    got = out.collect()
    assert len(got) == 3000 and len({(r.slot, r.place) for r in got}) == 3000
    for g in ("src0", ""):
        mine = sorted((r.block, r.place) for r in got if r.group == g)
        assert mine == [(i // 10, i % 10) for i in range(len(mine))]
    plain = pfair.place(docs.where("doc_id > 7"), {"src0": 600}, 400, "doc_id", "source", 10, 100).collect()
    again = pfair.place(docs.where("doc_id > 7").repartition(5), {"src0": 600}, 400, "doc_id", "source", 10, 100).collect()
    assert sorted(map(tuple, plain)) == sorted(map(tuple, again))
    # The tiles of the heavy ids are no larger than others.
    h = docs.withColumns({"group": F.lit(""), "_h": F.xxhash64("doc_id"), "_t": F.lit(0).cast("long")})
    assert {x.parts for r in pfair._heavy(h, 100).collect() for x in r._heavy} == {10}
