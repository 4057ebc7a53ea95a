"""Language identification by interpolated Kneser-Ney character models, one per language.

Texts are lower-cased, letters kept, and all else between letters becomes one space.  A model of order 4
interpolates down to the uniform distribution: the highest order uses counts, the lower ones the number of
different characters before an n-gram, and each order has its own discount n1 / (n1 + 2 n2).  N-grams and
contexts of all languages stand in one sorted array of hashes per order, with a column per language.  The
language with the lowest cross-entropy per character is chosen; a temperature that was fitted on training
documents held back from counting turns the differences into a probability, and a threshold on it, chosen
there as well, says which predictions to reject.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from wardline.llm import words as W
from wardline.llm.common import crc_of, once, require, saved
from wardline.operators.sizing import checked_broadcast

U = np.uint64
ORDER = 4
#: Training documents per language, at most, those with the smallest hash of their id, and their characters
#: together, at most: the shorter ones of the sample, one at least.
SAMPLE, CHARACTERS = 500, 100_000_000
#: Bits of a symbol: the fewest and the most.  With more letters than fit, the last ones are two symbols each.
_BITS, _MOST_BITS = 12, 16
_SINGLE = (1 << _MOST_BITS) - 4
_SECOND = 15
_CALIBRATION = 5
_SLOTS = 1 << 22
#: Losses that are worked out at a time, about.
_ROOM = 1 << 23


def _letter_table() -> np.ndarray:
    return once("letters", lambda: np.array([chr(i).isalpha() for i in range(0x110000)]))


def _codepoints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts with single spaces for all else, and the offset of each text; a space at both ends."""
    letters = _letter_table()
    texts = [(x or "").lower() for x in column.to_pylist()]
    sizes = np.array([len(x) + 2 for x in texts], np.int64)
    flat = np.frombuffer(" ".join(["", *[x + " " for x in texts]]).encode("utf-32-le", "surrogatepass"), np.uint32)[: int(sizes.sum())].copy() if texts else np.empty(0, np.uint32)
    # A text is a space, its characters and a space.
    flat[~letters[np.minimum(flat, 0x10FFFF)]] = 32
    at = np.concatenate([[0], np.cumsum(sizes)])
    first = np.zeros(len(flat), bool)
    first[at[:-1]] = True
    keep = np.ones(len(flat), bool)
    keep[1:] = (flat[1:] != 32) | (flat[:-1] != 32) | first[1:]
    kept = np.concatenate([[0], np.cumsum(keep)])
    return flat[keep], kept[at]


class Alphabet:
    """Numbers of letters: 1 for the space, 2 and on for known letters, 0 for all others; `size` counts the symbols."""

    def __init__(self, letters: np.ndarray):
        self.letters = np.sort(letters.astype(np.uint32))
        self.wide = len(self.letters) + 2 > _SINGLE
        self.size = 1 << _MOST_BITS if self.wide else len(self.letters) + 2
        self.bits = max(_BITS, self.size.bit_length()) if not self.wide else _MOST_BITS

    def numbers(self, flat: np.ndarray) -> np.ndarray:
        table = np.zeros(0x110000, np.uint32)
        table[self.letters] = np.arange(2, len(self.letters) + 2, dtype=np.uint32)
        table[32] = 1
        return table[flat]

    def symbols(self, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of texts, each letter known by its own one or two, and the offset of each text."""
        numbers = self.numbers(flat)
        if not self.wide:
            return numbers, at
        two = numbers >= _SINGLE
        place = np.concatenate([[0], np.cumsum(1 + two)])
        out = np.empty(place[-1], np.uint32)
        rest = numbers - np.where(two, _SINGLE, 0).astype(np.uint32)
        out[place[:-1]] = np.where(two, _SINGLE + (rest >> _SECOND), numbers)
        out[place[:-1][two] + 1] = 2 + (rest[two] & ((1 << _SECOND) - 1))
        return out, place[at]


def _grams(numbers: np.ndarray, at: np.ndarray, bits: int = _BITS) -> tuple[np.ndarray, np.ndarray]:
    """The 4-gram that ends at each character but the first of a text (spaces before it), and the offsets per text."""
    n = len(numbers)
    out = numbers.astype(U)
    # Characters before the start of a text count as spaces.
    place = np.arange(n) - np.repeat(at[:-1], np.diff(at))
    code = out.copy()
    for back in range(1, ORDER):
        before = np.ones(n, U)
        before[back:] = out[:-back] if back < n else out[:0]
        before[place < back] = 1
        code |= before << U(bits * back)
    keep = place > 0
    return code[keep], np.concatenate([[0], np.cumsum(np.diff(at) - 1)]).astype(np.int64) if len(at) > 1 else np.zeros(1, np.int64)


class KneserNey:
    """All languages' models as sorted arrays of hashes, built from the counts of their 4-grams."""

    def __init__(self, languages: list[str], alphabet: Alphabet, counts: list[tuple[np.ndarray, np.ndarray]]):
        self.languages, self.alphabet, self.bits = languages, alphabet, alphabet.bits
        bits = self.bits
        self.temperature, self.least = 1.0, 0.0
        self.grams: list[tuple[np.ndarray, ...]] = []
        self.contexts: list[tuple[np.ndarray, ...]] = []
        for order in range(1, ORDER + 1):
            mask = U((1 << (bits * order)) - 1)
            parts, outs = [], []
            for codes, n in counts:
                if order < ORDER:
                    # Different characters before the gram, out of the grams one longer.
                    longer = np.unique(codes & U((1 << (bits * (order + 1))) - 1))
                    codes, n = np.unique(longer & mask, return_counts=True)
                n = n.astype(float)
                ones, twos = (n == 1).sum(), (n == 2).sum()
                discount = ones / (ones + 2 * twos) if ones else 0.5
                context, back = np.unique(codes >> U(bits), return_inverse=True)
                total, kinds = np.bincount(back, n), np.bincount(back)
                parts.append((codes, np.maximum(n - discount, 0) / total[back]))
                outs.append((context, discount * kinds / total))
            self.grams.append(self._joined(parts))
            self.contexts.append(self._joined(outs))

    @staticmethod
    def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, ...]:
        """All languages' codes mixed and in order, where the entries of each start, and the language and value of each.

        Only what a language has is held, so the size follows the n-grams and not their number times the languages.
        """
        code = np.concatenate([W.mix(c) for c, _ in parts])
        order = np.argsort(code, kind="stable")
        column = np.repeat(np.arange(len(parts), dtype=np.int32), [len(c) for c, _ in parts])
        keys, starts = np.unique(code[order], return_index=True)
        return keys, np.append(starts, len(code)), column[order], np.concatenate([v for _, v in parts])[order]

    def _found(self, joined: tuple[np.ndarray, ...], wanted: np.ndarray, missing: float) -> np.ndarray:
        keys, starts, column, value = joined
        out = np.full((len(wanted), len(self.languages)), missing)
        if len(keys):
            wanted = W.mix(wanted)
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == wanted)
            sizes = starts[at[hit] + 1] - starts[at[hit]]
            entry = W.ragged(starts[at[hit]], sizes)
            out[np.repeat(hit, sizes), column[entry]] = value[entry]
        return out

    def losses(self, codes: np.ndarray) -> np.ndarray:
        """-ln p of the last character of each 4-gram, a column per language."""
        p = np.full((len(codes), len(self.languages)), 1.0 / self.alphabet.size)
        for order in range(1, ORDER + 1):
            gram = codes & U((1 << (self.bits * order)) - 1)
            here = self._found(self.grams[order - 1], gram, 0.0)
            p = here + self._found(self.contexts[order - 1], gram >> U(self.bits), 1.0) * p
        return -np.log(np.maximum(p, 1e-12))


class _Cache:
    """Losses of 4-grams already seen, each in one place that its hash names."""

    def __init__(self, model: KneserNey):
        self.model = model
        size = 1 << max(10, (_SLOTS // (4 * len(model.languages))).bit_length())
        self.mask = U(size - 1)
        self.codes = np.full(size, np.iinfo(np.uint64).max, U)
        self.values = np.zeros((size, len(model.languages)), np.float32)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        place = ((codes * U(0x9E3779B97F4A7C15)) >> U(40)) & self.mask
        miss = self.codes[place] != codes
        new, back = np.unique(codes[miss], return_inverse=True)
        out = self.values[place]
        if len(new):
            worked = self.model.losses(new).astype(np.float32)
            out[miss] = worked[back]
            at = ((new * U(0x9E3779B97F4A7C15)) >> U(40)) & self.mask
            self.codes[at], self.values[at] = new, worked
            # Where several codes share a place, the code kept and the values kept must be those of one.
            kept = self.codes[at] == new
            self.values[at[kept]] = worked[kept]
        return out


def _entropies(cache: _Cache, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Mean loss per character and language, and the number of letters, of each text."""
    flat, at = _codepoints(column)
    symbols, ends = cache.model.alphabet.symbols(flat, at)
    codes, to = _grams(symbols, ends, cache.model.bits)
    n = np.diff(to)
    out = np.zeros((len(n), len(cache.model.languages)))
    some = np.flatnonzero(n)
    # Texts, or parts of one, of so many characters that their losses in all languages stay small.
    most = max(1, _ROOM // max(1, len(cache.model.languages)))
    x = 0
    while x < len(some):
        y = max(x + 1, int(np.searchsorted(to[some + 1], to[some[x]] + most, "right")))
        part = some[x:y]
        low, high = to[part[0]], to[part[-1] + 1]
        if y > x + 1:
            out[part] = np.add.reduceat(cache(codes[low:high]), to[part] - low, axis=0, dtype=float)
        else:
            for z in range(low, high, most):
                out[part[0]] += cache(codes[z : min(z + most, high)]).sum(0, dtype=float)
        x = y
    out[some] /= n[some][:, None]
    letters = np.concatenate([[0], np.cumsum(flat != 32)])
    return out, letters[at[1:]] - letters[at[:-1]]


def _chances(entropy: np.ndarray, temperature: float) -> np.ndarray:
    x = -(entropy - entropy.min(1, keepdims=True)) * temperature
    e = np.exp(x)
    return e / e.sum(1, keepdims=True)


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for t in W.slices(whole, "text", 4 << 20):
            flat, _ = _codepoints(t.column("text"))
            letter, n = np.unique(flat[flat != 32], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(letter.astype(np.int32)), pa.array(n)], names=["letter", "n"])


def _gram_counts(alphabet: Alphabet):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for t in W.slices(whole, "text", 4 << 20):
                lang = t.column("lang").to_numpy(zero_copy_only=False)
                for one in np.unique(lang):
                    flat, at = _codepoints(t.column("text").filter(pa.array(lang == one)))
                    code, n = np.unique(_grams(*alphabet.symbols(flat, at), alphabet.bits)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([one] * len(code), pa.string()), pa.array(code.view(np.int64)), pa.array(n)], names=["lang", "code", "n"]
                    )

    return run


def _held_back(model: KneserNey):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Cache(model)
        for whole in batches:
            for t in W.slices(whole, "text", 4 << 20):
                entropy, n = _entropies(cache, t.column("text"))
                some = pa.array(n > 0)
                yield pa.RecordBatch.from_arrays([t.column("lang").filter(some), pa.array(list(entropy[n > 0]), pa.list_(pa.float64()))], names=["lang", "entropy"])

    return run


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = SAMPLE, accuracy: float = 0.99) -> KneserNey | None:
    """A model of the languages of `docs`, or None if no text has one.

    Every language and every letter of the texts used is learned.  At most `sample` documents per language are used,
    those with the smallest hashes of their ids, the shortest row of each; of these the longest are left out if all
    have more than CHARACTERS, but never the shortest one.  Every fifth is used only to fit the temperature and the
    rejection threshold: the lowest at which `accuracy` of the predictions kept are right.
    """
    rows = require(docs, doc_id, text, lang).toDF("id", "text", "lang")
    rows = rows.where(F.col("lang").isNotNull() & F.col("id").isNotNull() & F.col("text").isNotNull())
    rows = rows.withColumn("lang", F.col("lang").cast("string"))
    # The share of hashes that holds about twice the sample, then the smallest ones; both without texts.
    share = checked_broadcast(rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(2 * sample + 100) / F.count("*")).alias("share")))
    hashed = F.xxhash64("id")
    near = rows.select("id", "lang", F.char_length("text").alias("size")).join(share, "lang").where((hashed / F.lit(2.0**64) + 0.5) <= F.col("share"))
    near = near.groupBy("lang", "id").agg(F.min("size").alias("size")).withColumn("h", F.xxhash64("id"))
    by_hash, by_size = Window.partitionBy("lang").orderBy("h", "id"), Window.partitionBy("lang").orderBy("size", "h", "id")
    chosen = near.withColumn("i", F.row_number().over(by_hash)).where(F.col("i") <= sample)
    total, place = F.sum("size").over(by_size.rowsBetween(Window.unboundedPreceding, 0)), F.row_number().over(by_size)
    chosen = chosen.withColumns({"total": total, "i": place}).where((F.col("total") <= CHARACTERS) | (F.col("i") == 1))
    # The first of a language is counted, so a language with few documents is learned too.
    chosen = chosen.select("lang", "id", (F.row_number().over(by_hash) % _CALIBRATION == 0).alias("back"))
    rows = rows.join(checked_broadcast(chosen), ["id", "lang"]).select("lang", "id", "back", F.struct(F.char_length("text").alias("size"), "text").alias("x"))
    rows = saved(rows.groupBy("lang", "id", "back").agg(F.min("x").alias("x")).select("lang", F.col("x.text").alias("text"), "back"), "training")
    counted, back = rows.where("not back"), rows.where("back")
    letters = counted.mapInArrow(_letters, "letter int, n long").groupBy("letter").agg(F.sum("n").alias("n"))
    alphabet = Alphabet(np.array([r.letter for r in letters.collect()], np.uint32))
    counts = counted.select("lang", "text").mapInArrow(_gram_counts(alphabet), "lang string, code long, n long")
    counts = counts.groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique())
    if not languages:
        return None
    tables = []
    for one in languages:
        part = counts[counts["lang"] == one].sort_values("code")
        tables.append((part["code"].to_numpy(np.int64).view(U), part["n"].to_numpy()))
    model = KneserNey(languages, alphabet, tables)
    held = back.where(F.col("lang").isin(languages)).select("lang", "text").mapInArrow(_held_back(model), "lang string, entropy array<double>").toPandas()
    if len(held):
        entropy = np.stack(held["entropy"].to_numpy())
        right = held["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy()
        grid = np.exp(np.linspace(np.log(0.5), np.log(200), 60))
        fits = [np.log(np.maximum(_chances(entropy, t)[np.arange(len(right)), right], 1e-12)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmax(fits))])
        chance = _chances(entropy, model.temperature)
        order = np.argsort(-chance.max(1), kind="stable")
        share_right = np.cumsum((chance.argmax(1) == right)[order]) / np.arange(1, len(order) + 1)
        enough = np.flatnonzero(share_right >= accuracy)
        model.least = float(chance.max(1)[order][enough[-1]]) if len(enough) else 1.0
    return model


def _predicted(model: KneserNey | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Cache(model) if model else None
        for whole in batches:
            for t in W.slices(whole, "text", 4 << 20):
                if cache:
                    entropy, n = _entropies(cache, t.column("text"))
                    chance = _chances(entropy, model.temperature)
                    best = chance.argmax(1)
                    names = np.where(n > 0, np.array(model.languages, object)[best], "und")
                    score = np.where(n > 0, chance.max(1), 0.0)
                    loss = pa.array(entropy[np.arange(len(best)), best], mask=n == 0)
                    no = (n == 0) | (score < model.least)
                else:
                    names, score, no = np.full(t.num_rows, "und", object), np.zeros(t.num_rows), np.ones(t.num_rows, bool)
                    loss = pa.nulls(t.num_rows, pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [t.column("id"), pa.array(list(names), pa.string()), pa.array(score), loss, pa.array(no)], names=["id", "lang_pred", "score", "cross_entropy", "rejected"]
                )

    return run


def predict(docs: DataFrame, model: KneserNey | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: its id, lang_pred, score (0 to 1), cross_entropy (nats per character) and rejected, from the whole text alone.

    lang_pred is `und`, with score 0, for a null text or one without a letter, and without a model.  Rejected
    predictions keep their language and are marked.
    """
    rows = require(docs, doc_id, text).toDF("id", "text")
    schema = f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double, cross_entropy double, rejected boolean"
    return rows.mapInArrow(_predicted(model), schema).withColumnRenamed("id", doc_id)


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, mod 4; 2 is held out."""
    return crc_of(F.col(f"`{doc_id}`")) % 4
