"""Packing by power-of-two decomposition."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .arrow import map_columns, utf8_bytes
from .characters import find, lowered
from .words import word_hashes, word_spans

#: The pre-tokenizer's pattern of the word vocabulary, and the id that ends a document.
PIECES = regex.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
END_ID = 2


def pre_tokenize(words: str) -> list[str]:
    """Pieces of words with a line feed after each; the line feeds stay as pieces."""
    return find(PIECES, lowered(words))


def word_pieces(words: list[bytes], special: dict[str, int]) -> list[str]:
    """Pieces of runs without ASCII white space, with a line feed after each run; special tokens are pieces."""
    text = (b"\n".join(words) + b"\n").decode()
    if "<|" not in text:
        return pre_tokenize(text)
    out: list[str] = []
    for part in regex.split("(" + "|".join(map(regex.escape, special)) + ")", text):
        out += [part] if part in special else pre_tokenize(part)
    return out


def encode_words(words: list[bytes], encoder: bpe.PairIndexBPE) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words in turn, number of ids of each); each distinct piece is encoded once."""
    number: dict[str, int] = {"\n": 0}
    flat = np.array([number.setdefault(p, len(number)) for p in word_pieces(words, encoder.special)], np.int64)
    tokens = [p for p in number if p in encoder.special]
    plain = [p for p in number if p != "\n" and p not in encoder.special]
    ids, counts = encoder.encode([p.encode() for p in plain])
    # The table of pieces: plain ones, then one id for each special token met, then the line feed.
    ids = np.r_[ids, np.array([encoder.special[p] for p in tokens], np.int32)]
    counts = np.r_[counts, np.ones(len(tokens), np.int64), 0]
    place = np.empty(len(number), np.int64)
    place[[number[p] for p in [*plain, *tokens, "\n"]]] = np.arange(len(number))
    piece_ids, piece_counts = bpe.gather(ids, counts, place[flat])
    return piece_ids, np.diff(np.cumsum(piece_counts)[flat == 0], prepend=0)


_known: dict[str, bpe.KnownWords] = {}


def batch_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in turn, number of ids of each text); each distinct word is encoded once.

    Words are told apart by a 64-bit hash, and a second one checks that each is the word whose ids
    it gets; should two words ever share the first, every word of the part is encoded by itself.
    A-Z fold where the vocabulary lower-cases anyway; runs that hold ``<`` keep their case, as
    special tokens do.
    """
    encoder, known = bpe.model(path), _known.setdefault(path, bpe.KnownWords())
    data, offsets = utf8_bytes(texts)
    text, starts, ends = word_spans(data, offsets)
    hashes, checks = (word_hashes(data, starts, ends, salt=k) for k in (0, 1))
    if (data == ord("<")).any():
        marks = np.cumsum(np.r_[0, data == ord("<")])
        has = marks[ends] > marks[starts]
        hashes[has], checks[has] = (word_hashes(data, starts[has], ends[has], lower=False, salt=k) for k in (0, 1))

    def encoded(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        return encode_words([raw[a:b] for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)], encoder)

    out, lengths = known.encoded(hashes, checks, encoded)
    return out, np.bincount(text, weights=lengths, minlength=len(texts)).astype(np.int64)


def binary_lengths(n: int, longest: int) -> list[int]:
    """n as lengths: the longest as often as it fits, then the set bits of the rest, large first."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, longest: int = 4096) -> DataFrame:
    """Cut each document into pieces of power-of-two lengths; each piece is a sequence of its own.

    A document's ids, with ``end_id`` after them, are split by the binary form of their number
    (pieces of ``longest`` first). Sequences of one length form a bucket, so a batch takes equal
    lengths, no sequence crosses documents, and none needs padding. No shuffle: ids of sequences
    are dealt by partition and row of the scan, so a task that runs again deals the same ones.

    Returns per piece: id, ``start``, ``length`` (also the bucket), ``ids`` (binary, little-endian
    unsigned 32-bit), ``doc_tokens``, ``sequence_id``, ``offset`` (always 0).
    Null and empty texts: one piece that holds ``end_id`` only. Repeated rows and null ids: each row
    is packed as a document of its own. Other columns are ignored. An empty table gives no rows.
    """
    if longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")

    def cut(ids: pa.Array, texts: pa.Array) -> dict:
        tokens, counts = batch_ids(texts, vocabulary)
        ends = np.cumsum(counts)
        raw = tokens.astype("<u4").tobytes()
        mark = int(end_id).to_bytes(4, "little")
        row, start, length, body, total = [], [], [], [], []
        for k, (a, n) in enumerate(zip((ends - counts).tolist(), counts.tolist(), strict=True)):
            whole = raw[4 * a : 4 * (a + n)] + mark
            at = 0
            for size in binary_lengths(n + 1, longest):
                row.append(k)
                start.append(at)
                length.append(size)
                body.append(whole[4 * at : 4 * (at + size)])
                total.append(n + 1)
                at += size
        return {"id": ids.take(pa.array(row, pa.int64())), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids": pa.array(body, pa.binary()), "doc_tokens": pa.array(total, pa.int64())}

    kind = docs.schema[id_col].dataType.simpleString()
    pieces = map_columns(docs.select(id_col, text_col), cut, f"id {kind}, start long, length long, ids binary, doc_tokens long", at_once=16 << 20)
    return pieces.select(F.col("id").alias(id_col), "start", "length", "ids", "doc_tokens", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
