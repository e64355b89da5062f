"""Words of whole columns of text at once: spans and 64-bit hashes of the UTF-8 bytes."""

from __future__ import annotations

import numpy as np

#: An odd constant that sets lanes apart, and the bytes of a lane that belong to a word with so many left.
STEP = 0x9E3779B97F4A7C15
KEPT_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, start, end) of each maximal run without space or tab..carriage return bytes."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~IS_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True  # a text begins here, so no word crosses this point
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first))
    ends = np.flatnonzero(before & (~inside | first))
    return np.searchsorted(offsets, starts, side="right") - 1, starts, ends


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each word; with ``lower``, A-Z count as a-z. Hashes of another ``salt`` are independent.

    A word's lanes of eight bytes are mixed, each with its place, before they are summed, so no
    relation between the bytes of two words carries over to their sums.
    """
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = LOWER[data] if lower else data
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    length = (ends - starts).astype(np.int64)
    first = lanes[starts] & KEPT_BYTES[np.minimum(length, 8)]
    out = mix(mix(first + np.uint64((salt * 2 + 1) * STEP & (1 << 64) - 1)) + np.uint64(STEP))
    long = np.flatnonzero(length > 8)
    if len(long):
        more = (length[long] - 1) // 8
        owner = np.repeat(long, more)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(more) - more, more) + 1
        rest = lanes[starts[owner] + 8 * place] & KEPT_BYTES[np.minimum(length[owner] - 8 * place, 8)]
        mixed = mix(mix(rest + np.uint64((salt * 2 + 1) * STEP & (1 << 64) - 1)) + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(STEP))
        out[long] += np.add.reduceat(mixed, np.cumsum(more) - more)
    return mix(out + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct hashes, an index of each in the input, the number of each input hash among them)."""
    order = np.argsort(hashes)
    ordered = hashes[order]
    first = np.ones(len(hashes), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    which = np.empty(len(hashes), np.int64)
    which[order] = np.cumsum(first) - 1
    return ordered[first], order[first], which
