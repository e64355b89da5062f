"""Byte-level BPE encoding and decoding by an index of pair occurrences."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .arrow import map_columns, utf8_bytes
from .characters import END, LETTER, SPACE, classes
from .words import word_hashes

#: Fixed value: letters that a lone apostrophe takes.
CONTRACTIONS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


def character_classes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the first bytes of the characters of UTF-8 text, their classes)."""
    first = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[first]
    table = classes()
    out = table[lead]
    long = np.flatnonzero(lead >= 0x80)
    if len(long):
        padded, at, head = np.r_[data, np.zeros(3, np.uint8)], first[long], lead[long].astype(np.int64)
        two, three, four = (padded[at + k].astype(np.int64) & 0x3F for k in (1, 2, 3))
        points = np.where(head < 0xE0, (head & 0x1F) << 6 | two, np.where(head < 0xF0, (head & 0x0F) << 12 | two << 6 | three, (head & 0x07) << 18 | two << 12 | three << 6 | four))
        out[long] = table[np.minimum(points, END)]
    return first, out


def pieces(data: np.ndarray, offsets: np.ndarray, special: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, the number from 0 of the special token that the piece is, or -1) of the pieces of all texts, in turn.

    The pieces are the matches of ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``
    between special tokens, found from runs of characters of one class: a run of white space gives
    its last character up, a space to the run after it; a lone apostrophe takes its contraction.
    """
    size = len(data)
    if not size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Texts and special tokens begin and end parts, which nothing crosses.
    part = np.zeros(size + 1, bool)
    part[offsets] = True
    tokens: list[tuple[int, int, int]] = []
    raw = data.tobytes()
    if special and any(t in raw for t in special):
        begins = np.unique(offsets)
        for m in re.finditer(b"|".join(map(re.escape, special)), raw):
            if begins[np.searchsorted(begins, m.start(), side="right")] >= m.end():  # within one text
                tokens.append((m.start(), m.end(), special.index(m[0])))
                part[[m.start(), m.end()]] = True
    first, kinds = character_classes(data)
    starts = part[first]
    new = starts | np.r_[True, kinds[1:] != kinds[:-1]]
    last = np.r_[new[1:], True]
    closes = np.r_[starts[1:], True]  # the part ends after this character
    space = kinds == SPACE
    # The last white space before something else begins a piece, and unless it is a space, so does what follows.
    gives = space & last & ~closes
    joined = gives & (data[first] == 32)
    begin = new | gives
    begin[1:] &= ~(joined[:-1] & ~starts[1:])
    # Contractions: the apostrophe begins a piece, is alone in its run, and letters follow.
    lone = np.flatnonzero(begin & new & last & ~closes & (data[first] == 39))
    lone = lone[kinds[lone + 1] == LETTER]
    if len(lone):
        padded = np.r_[data, np.zeros(2, np.uint8)]
        one, two = padded[first[lone] + 1], padded[first[lone] + 2]
        within = np.r_[new, [True, True]][lone + 2] == False  # noqa: E712 - the second letter is of the same run
        for word in CONTRACTIONS:
            hit = one == word[0]
            if len(word) == 2:
                hit &= within & (two == word[1])
            begin[lone[hit] + 1] = False
            after = lone[hit] + 1 + len(word)
            begin[after[after < len(begin)]] = True
    at = first[begin]
    ends, which = np.r_[at[1:], size], np.full(len(at), -1, np.int64)
    if tokens:
        keep = np.ones(len(at), bool)
        for a, b, k in tokens:
            low, high = np.searchsorted(at, [a, b])
            keep[low + 1 : high] = False
            ends[low], which[low] = b, k
        at, ends, which = at[keep], ends[keep], which[keep]
    return at, ends, which


_known: dict[str, bpe.KnownWords] = {}


def batch_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in turn, number of ids of each text); each distinct piece is encoded once."""
    model, known = bpe.model(path), _known.setdefault(path, bpe.KnownWords())
    data, offsets = utf8_bytes(texts)
    starts, ends, special = pieces(data, offsets, [t.encode() for t in model.special])
    tokens = np.array([*model.special.values()], np.int32)

    def encoded(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        plain = special[some] < 0
        ids, counts = model.encode([raw[a:b] for a, b in zip(starts[some[plain]].tolist(), ends[some[plain]].tolist(), strict=True)])
        place = np.empty(len(some), np.int64)
        place[np.r_[np.flatnonzero(plain), np.flatnonzero(~plain)]] = np.arange(len(some))
        return bpe.gather(np.r_[ids, tokens[special[some[~plain]]]], np.r_[counts, np.ones(int((~plain).sum()), np.int64)], place)

    hashes, checks = (word_hashes(data, starts, ends, lower=False, salt=k) for k in (0, 1))
    out, lengths = known.encoded(hashes, checks, encoded)
    text = np.searchsorted(offsets, starts, side="right") - 1
    return out, np.bincount(text, weights=lengths, minlength=len(offsets) - 1).astype(np.int64)


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit numbers."""
    ids, counts = batch_ids(pa.array(texts, pa.string()), path)
    raw, ends = ids.astype("<u4").tobytes(), 4 * np.cumsum(counts)
    return [raw[a:b] for a, b in zip((ends - 4 * counts).tolist(), ends.tolist(), strict=True)]


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's ids, as the vocabulary's own library gives them without extra special tokens.

    Within a batch of a partition, the distinct pieces are merged together: a pair index holds all
    positions of each mergeable pair and active ranks are applied in ascending order. No shuffle.
    Returns id and ``ids`` (array of int). A special token's string in a text is that token.
    Null and empty texts: no ids. Repeated rows and null ids stay rows of their own. Other columns
    are ignored. An empty table gives no rows.
    """

    def run(ids: pa.Array, texts: pa.Array) -> dict:
        values, counts = batch_ids(texts, vocabulary)
        ends = np.cumsum(np.r_[0, counts])
        return {"id": ids, "ids": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.astype(np.int32)))}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_columns(docs.select(id_col, text_col), run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids; bytes that aren't UTF-8 become replacement characters. Null ids: an empty text."""

    def run(ids: pa.Array, *others: pa.Array) -> dict:
        token = bpe.model(vocabulary).token_bytes.__getitem__
        tokens = ids.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)).tolist()
        texts, at = [], 0
        for end in ends:  # a text at a time, so only one is held as a list
            texts.append(b"".join(map(token, tokens[at:end].tolist())).decode("utf-8", "replace"))
            at = end
        return {out_col: pa.array(texts, pa.string())} | {f"c{k}": x for k, x in enumerate(others)}

    rest = [c for c in encoded.columns if c != out_col]
    kinds = [encoded.schema[c].dataType.simpleString() for c in rest]
    out = map_columns(encoded.select(F.col(ids_col).alias("_ids"), *rest), run, ", ".join([f"{out_col} string", *(f"c{k} {t}" for k, t in enumerate(kinds))]))
    return out.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(rest)), out_col)
