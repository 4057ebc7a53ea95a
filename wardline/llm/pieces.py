"""SentencePiece encoding and decoding on the tokenizers library.

The model file is a protocol buffer.  Its pieces, scores and settings are read here and rebuilt as a
tokenizers model: the precompiled normaliser, the marker for spaces, unigram scores or, for a BPE model, the
merges that its scores stand for, and bytes for characters outside the vocabulary.
"""

from __future__ import annotations

import itertools
import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wardline.llm import words as W
from wardline.llm.common import lean, once, require
from wardline.llm.token_binary import CachedWords

MARK = "▁"
# Fixed values of the file format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Bytes of text that are encoded at once, about, and pieces that both libraries have at a time: a worker's memory follows them.
SLICE_BYTES, PART_TEXTS = 1 << 20, 4_000


@dataclass
class Model:
    """What a model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    suffix: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True

    @property
    def unk_id(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a message: integers, 32-bit floats and byte strings."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        wire = tag & 7
        if wire == 0:
            yield tag >> 3, varint()
        elif wire == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        elif wire == 5:
            yield tag >> 3, struct.unpack_from("<f", data, at)[0]
            at += 4
        elif wire == 1:
            yield tag >> 3, struct.unpack_from("<d", data, at)[0]
            at += 8
        else:
            raise ValueError("not a model file")


def parse_model(data: bytes) -> Model:
    """Read a model file."""
    model = Model()
    for number, value in _fields(data):
        if number == 1:
            piece = {1: b"", 2: 0.0, 3: NORMAL} | dict(_fields(value))
            model.pieces.append((piece[1].decode(), piece[2], piece[3]))
        elif number == 2:
            trainer = dict(_fields(value))
            model.kind = trainer.get(3, UNIGRAM)
            model.byte_fallback = bool(trainer.get(35, 0))
            model.suffix = bool(trainer.get(24, 0))
        elif number == 3:
            rules = dict(_fields(value))
            model.charsmap = rules.get(2, b"")
            model.dummy_prefix, model.squeeze, model.escape = (bool(rules.get(k, 1)) for k in (3, 4, 5))
    if model.kind not in (UNIGRAM, BPE) or model.suffix or not model.escape:
        raise ValueError("only unigram and BPE models with a leading space marker")
    return model


def _merges(model: Model, ids: dict[str, int]) -> list[tuple[str, str]]:
    """All ways to make a piece from two, the best score first, as the BPE rule takes them."""
    ways = []
    for piece, score, kind in model.pieces:
        if kind == NORMAL:
            ways += [(-score, ids[piece[:i]], ids[piece[i:]]) for i in range(1, len(piece)) if piece[:i] in ids and piece[i:] in ids]
    return [(model.pieces[a][0], model.pieces[b][0]) for _, a, b in sorted(ways)]


def build(model: Model):
    """The tokenizer, without its normaliser, which works on whole texts (see `normalizer`)."""
    from tokenizers import AddedToken, Tokenizer, decoders, models

    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], model.unk_id, model.byte_fallback)
    else:
        ids = {p: i for i, (p, _, kind) in enumerate(model.pieces)}
        joinable = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind == NORMAL}
        unknown = model.pieces[model.unk_id][0]
        core = models.BPE(ids, _merges(model, joinable), unk_token=unknown, fuse_unk=True, byte_fallback=model.byte_fallback)
    tokenizer = Tokenizer(core)
    tokenizer.add_tokens([AddedToken(p, normalized=False) for p, _, kind in model.pieces if kind == USER])
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
    return tokenizer


def normalizer(model: Model):
    """Function from a text to its normal form, with plain spaces instead of markers."""
    from tokenizers import normalizers

    mapped = normalizers.Precompiled(model.charsmap) if model.charsmap else None

    def run(text: str) -> str:
        text = mapped.normalize_str(text) if mapped else text
        if model.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        return (" " if model.dummy_prefix and text else "") + text

    return run


def _separable(model: Model) -> bool:
    """No piece has a marker after another character, so nothing is joined across the start of a gap."""
    return not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, kind in model.pieces if kind in (NORMAL, USER))


class Codec:
    """Encoder and decoder of one model; every distinct piece of text is encoded, decoded and compared once."""

    def __init__(self, file: str, threads: int, parity: bool):
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        with open(file, "rb") as f:
            self.model = parse_model(f.read())
        self.tokenizer, self.normal = build(self.model), normalizer(self.model)
        self.plain = not self.model.charsmap and not self.model.squeeze
        self.fallback = np.array([kind == BYTE for _, _, kind in self.model.pieces])
        self.other = None
        if parity:
            import sentencepiece

            self.other = sentencepiece.SentencePieceProcessor(model_file=file)
        white = np.zeros(256, bool)
        if _separable(self.model):
            white[0x20] = True
        self.cached = CachedWords(self._encode, white, with_gap=True)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids, and two numbers before them: whether decoding gives the text again, and whether both libraries agree."""
        out, sizes = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for x in range(0, len(texts), PART_TEXTS):
            part = texts[x : x + PART_TEXTS]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([t.replace(" ", MARK) for t in part], add_special_tokens=False)]
            again = self.tokenizer.decode_batch(ids, skip_special_tokens=False)
            same = [True] * len(part)
            if self.other is not None:
                # The other library puts the space before a text itself; a text after the first has one.
                prefix = self.model.dummy_prefix
                told = self.other.encode([t[1:] if prefix and t[:1] == " " else t for t in part], num_threads=1)
                same = [a == b or (prefix and t[:1] != " ") for a, b, t in zip(ids, told, part)]
            rows = [[int(a == t.replace(MARK, " ")), int(s), *e] for e, a, t, s in zip(ids, again, part, same)]
            sizes.append(np.fromiter(map(len, rows), np.int64, len(rows)))
            # Python's lists of a part go before the next one.
            out.append(np.fromiter(itertools.chain.from_iterable(rows), np.uint32, int(sizes[-1].sum())))
        return np.concatenate(out), np.concatenate(sizes)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, ids per document, decodes to its text, both libraries agree)."""
        data, offsets = W.column_bytes(column)
        raw = data.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:])]
        normal = [self.normal(t).encode() for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in normal])]).astype(np.int64)
        data = np.frombuffer(b"".join(normal), np.uint8)
        ids, n, good, same = self._split(*self.cached(data, offsets))
        if self.other is not None and not self.plain:
            # Pieces come after the normaliser, so only whole texts show whether it is right.
            to = np.cumsum(n)
            same &= np.array([ids[b - k : b].tolist() == self.other.encode(t) for t, b, k in zip(texts, to, n)], bool)
        return ids, n, good, same

    def _split(self, ids: np.ndarray, n: np.ndarray):
        # The two marks of each piece stand where the cache put them; their places follow from the pieces' sizes.
        pieces, docs = self.cached.sizes_of, self.cached.docs_of
        at = np.cumsum(pieces) - pieces
        inside = np.ones(len(ids), bool)
        inside[at] = False
        inside[at + 1] = False
        per = np.diff(docs)
        some = np.flatnonzero(per)
        good, same = np.ones(len(n), bool), np.ones(len(n), bool)
        if len(some):
            good[some] = np.logical_and.reduceat(ids[at] > 0, docs[:-1][some])
            same[some] = np.logical_and.reduceat(ids[at + 1] > 0, docs[:-1][some])
        return ids[inside], n - 2 * per, good, same


def codec(file: str, threads: int = 2, parity: bool = True) -> Codec:
    """The codec of a model file, made once per Python process."""
    return once(("pieces", file, threads, parity), lambda: Codec(file, threads, parity))


def _encoded(file: str, threads: int, parity: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(file, threads, parity)
        for whole in batches:
            for batch in W.slices(whole, "text", SLICE_BYTES):
                ids, n, good, same = made.encode(batch.column(1))
                to = np.cumsum(n)
                wide = ids.astype("<u4")
                crc = [zlib.crc32(wide[a:b]) for a, b in zip(to - n, to)]
                spelt = np.concatenate([[0], np.cumsum(made.fallback[np.minimum(ids, len(made.fallback) - 1)])])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], to]), pa.int32()), pa.array(ids, pa.int32())),
                        pa.array(n, pa.int64()),
                        pa.array(crc, pa.int64()),
                        pa.array(spelt[to] - spelt[to - n], pa.int64()),
                        pa.array(good),
                        pa.array(same),
                    ],
                    names=["id", "ids", "n_tokens", "ids_crc32", "n_byte_tokens", "round_trip", "parity"],
                )

    return run


def encode(docs: DataFrame, file: str, doc_id: str = "doc_id", text: str = "text", threads: int = 2, parity: bool = True) -> DataFrame:
    """Per row: its id, ids, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), n_byte_tokens,
    round_trip (decoding gives the normal form of the text again) and parity (the sentencepiece library gives the same ids;
    where the model maps characters or squeezes spaces, for the whole text as it came).

    Whole texts of any length; a null text counts as empty, and an empty one has no ids.  An empty table gives no rows.  Rows that repeat an id are rows of
    their own.  `file` is a model file that every executor has at this path.
    """
    docs = require(docs, doc_id, text).toDF("id", "text")
    schema = f"id {docs.schema['id'].dataType.simpleString()}, ids array<int>, n_tokens long, ids_crc32 long, n_byte_tokens long, round_trip boolean, parity boolean"
    return docs.mapInArrow(lean(_encoded(file, threads, parity)), schema).withColumnRenamed("id", doc_id)


def _decoded(file: str, threads: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(file, threads, False)
        for t in batches:
            texts = made.tokenizer.decode_batch([x or [] for x in t.column(1).to_pylist()], skip_special_tokens=False)
            if made.model.dummy_prefix:
                texts = [x[1:] if x[:1] == " " else x for x in texts]
            yield pa.RecordBatch.from_arrays([t.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return run


def decode(rows: DataFrame, file: str, doc_id: str = "doc_id", ids: str = "ids", threads: int = 2) -> DataFrame:
    """Per row: its id and the text of its ids; null ids count as none."""
    rows = require(rows, doc_id, ids).toDF("id", "ids")
    schema = f"id {rows.schema['id'].dataType.simpleString()}, text string"
    return rows.mapInArrow(lean(_decoded(file, threads)), schema).withColumnRenamed("id", doc_id)

