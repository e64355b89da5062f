"""Byte pair encoding of many words at once, by an index of pair occurrences.

All distinct words of a partition's batch are laid out in one array of symbols. An index maps each
mergeable pair, by its rank, to all its positions. Active ranks are applied in ascending order; a
merge rewrites its positions and enters the newly adjacent pairs under their own ranks. Words are
independent, and a new pair's rank is never below the rank that made it, so the result is the
same as merging each word's lowest rank first.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable

import numpy as np

from .arrow import ragged
from .words import distinct


def byte_characters() -> list[str]:
    """The printable stand-in for each byte in byte-level vocabularies: printable bytes stand for themselves, the others follow from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class PairIndexBPE:
    """``encode(words)``: ids of byte strings; ``token_bytes``: bytes of each id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        chars = byte_characters()
        back = {c: b for b, c in enumerate(chars)}
        self.special = {x["content"]: x["id"] for x in whole["added_tokens"]}
        self.first = np.array([vocab[c] for c in chars], np.int32)
        self.last = np.array([vocab[c + suffix] for c in chars], np.int32)
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        order = np.argsort(keys)
        self.keys, self.ranks, self.left, self.made = keys[order], order.astype(np.int32), keys // self.size, made
        self.right = keys % self.size
        self.token_bytes = [b""] * self.size
        for token, i in vocab.items():
            body = token[: -len(suffix)] if suffix and token.endswith(suffix) else token
            self.token_bytes[i] = bytes(back[c] for c in body)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in turn, number of ids of each word)."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(lengths)
        symbols = self.first[data]
        filled = lengths > 0
        symbols[ends[filled] - 1] = self.last[data[ends[filled] - 1]]
        n = len(symbols)
        following = np.arange(1, n + 1, dtype=np.int64)
        following[ends[filled] - 1] = -1
        before = np.arange(-1, n - 1, dtype=np.int64)
        before[(ends - lengths)[filled]] = -1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(positions: np.ndarray) -> None:
            ranks = self._rank(symbols[positions], symbols[following[positions]])
            keep = ranks >= 0
            positions, ranks = positions[keep], ranks[keep]
            if not len(ranks):
                return
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for rank, some in zip(ranks[np.r_[0, cuts]].tolist(), np.split(positions, cuts), strict=True):
                if rank not in index:
                    index[rank] = []
                    heapq.heappush(active, rank)
                index[rank].append(some)

        enter(np.flatnonzero(following >= 0))
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            a, b = self.left[rank], self.right[rank]
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            after = following[at]
            valid = (symbols[at] == a) & (after >= 0) & (symbols[after] == b)
            at, after = at[valid], after[valid]
            if a == b and len(at) > 1:
                at = np.unique(at)  # of overlapping occurrences in a run, every second one counts
                run = np.r_[True, at[1:] != following[at[:-1]]]
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 0]
                after = following[at]
            if not len(at):
                continue
            beyond = following[after]
            symbols[at] = self.made[rank]
            symbols[after] = -1
            following[at] = beyond
            more = beyond >= 0
            before[beyond[more]] = at[more]
            left = before[at]
            enter(np.concatenate([left[left >= 0], at[following[at] >= 0]]))
        alive = symbols >= 0
        counts = np.zeros(len(words), np.int64)
        if n:
            counts[filled] = np.add.reduceat(alive, (ends - lengths)[filled])
        return symbols[alive], counts


class KnownWords:
    """Encodings by 64-bit hash of the words that a worker has met, in arrays.

    Begins anew beyond ``most`` words, which bounds its memory; a batch's own words are always known.
    ``checks`` has an independent hash of each word, by which a chance collision shows.
    """

    def __init__(self, most: int = 1_000_000):
        self.most = most
        self.hashes, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.counts, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def missing(self, hashes: np.ndarray) -> np.ndarray:
        """Which of the sorted, distinct ``hashes`` aren't known."""
        if not len(self.hashes):
            return np.ones(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return self.hashes[at] != hashes

    def learn(self, hashes: np.ndarray, checks: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        hashes, checks, counts, ids = np.r_[self.hashes, hashes], np.r_[self.checks, checks], np.r_[self.counts, counts], np.r_[self.ids, ids]
        order = np.argsort(hashes, kind="stable")
        self.ids, self.counts = gather(ids, counts, order)
        self.hashes, self.checks = hashes[order], checks[order]

    def encoded(self, hashes: np.ndarray, checks: np.ndarray, encode: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in turn, number of ids of each). ``encode`` does the same for words by their numbers; should two words ever share a hash, it encodes them all."""
        found, some, which = distinct(hashes)
        new = self.missing(found)
        if self.full(int(new.sum())):
            self.clear()
            new[:] = True
        if new.any():
            self.learn(found[new], checks[some[new]], *encode(some[new]))
        at = np.searchsorted(self.hashes, found)[which]
        if (self.checks[at] == checks).all():
            return gather(self.ids, self.counts, at)
        return encode(np.arange(len(hashes)))

    def full(self, more: int) -> bool:
        return len(self.hashes) + more > self.most

    def clear(self) -> None:
        self.__init__(self.most)


_models: dict[str, PairIndexBPE] = {}


def model(path: str) -> PairIndexBPE:
    """The model of a vocabulary file; a worker loads each once."""
    if path not in _models:
        _models[path] = PairIndexBPE(path)
    return _models[path]


def gather(ids: np.ndarray, counts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The encodings of the words numbered ``which``, in turn, and their lengths."""
    starts = np.cumsum(counts) - counts
    return ids[ragged(starts[which], counts[which])], counts[which]
