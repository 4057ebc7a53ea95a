"""Token counts by lookup against the library over whole texts."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wardline.llm import token_counts as T, words as W

FILE = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [" ", "  ", "\n", "\t", " \n ", "a", "Hello", "'s", "'ll", "'", "123", "é", "中文", "😀", ".", "...", "<|endoftext|>", "  <|endoftext|>  ", "\x1c", "\x85", "\xa0", " ", "　", "-", "\r\n", "​"]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(FILE)
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("kept", [50, 1 << 20])
def test_cut_texts_have_as_many_tokens_as_whole_ones(library, kept):
    rng = random.Random(kept)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(30))) for _ in range(3000)] + ["", " ", "\n\n", "x" * 5000]
    counter, none = T.Counter(FILE, kept), T.Lengths(np.empty(0, np.uint64), np.empty(0, np.int64))
    for x in range(0, len(texts), 250):
        data, offsets = W.column_bytes(pa.array(texts[x : x + 250]))
        assert counter(data, offsets, none).tolist() == library(texts[x : x + 250])
        assert counter.cache.n <= kept


def test_table_of_lengths():
    rng = np.random.default_rng(1)
    hashes = np.unique(np.concatenate([rng.integers(0, 1 << 64, 5000, dtype=np.uint64), np.arange(64, dtype=np.uint64)]))
    lengths = rng.integers(0, 9, len(hashes))
    table = T.Lengths(hashes, lengths)
    assert (table(hashes) == lengths).all() and (table(hashes + np.uint64(1 << 40)) == -1).mean() > 0.9
    kept, values = table.items()
    assert sorted(zip(kept.tolist(), values.tolist())) == sorted(zip(hashes.tolist(), lengths.tolist()))


def test_rows(spark, library):
    long = "word " * 300_000
    rows = [(1, "some text here"), (1, "some text here"), (None, None), (2, ""), (3, long), (None, "x" * 2000), (4, "   y  <|endoftext|> z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    got = sorted((tuple(r) for r in T.count_tokens(docs, FILE).collect()), key=str)
    n = library([t for _, t in rows])
    assert got == sorted(((i, len((t or "").encode()), k, k > 512) for (i, t), k in zip(rows, n)), key=str)
    assert T.count_tokens(docs.limit(0), FILE).count() == 0


def test_most_pre_tokens_are_in_the_broadcast_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    table, counter = T.frequent(docs, FILE), T.Counter(FILE)
    data, offsets = W.column_bytes(pa.array([r.text for r in docs.collect()]))
    counter(data, offsets, table)
    assert 0 < table.n <= T.FREQUENT and counter.encoded < 0.2 * len(T.cut(data, offsets)[0])


def test_only_lookup_files_are_taken():
    with pytest.raises(ValueError):
        T.Counter("some.model")
