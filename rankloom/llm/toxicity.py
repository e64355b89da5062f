"""Toxicity: a noisy-channel decoder restores disguised words, then a learned word list scores the text."""

from __future__ import annotations

from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import add_columns, map_columns, ragged, utf8_bytes
from .quality import labelled_sample, remainder
from .words import word_hashes, word_spans

#: The letters that a sign may stand for in disguised writing.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
#: Signs that may stand between the letters of a spaced word.
BETWEEN = ".-_*"

#: Letters are 1 to 26, all other letters 27, and 0 stands for the border of a word.
SYMBOLS = 28
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123] = _CLASS[65:91] = np.arange(1, 27)
_CLASS[128:] = 27
_IS_LETTER = _CLASS > 0
_IS_SIGN = np.zeros(256, bool)
_IS_SIGN[[ord(c) for c in LEET]] = True
_IS_BETWEEN = np.zeros(256, bool)
_IS_BETWEEN[[ord(c) for c in BETWEEN]] = True


# --- the character language model -------------------------------------------------------------


def trigram_counts(texts: pa.Array) -> np.ndarray:
    """How often each three neighbouring symbols occur in whole texts; a border stands at both ends of a text."""
    data, offsets = utf8_bytes(texts)
    symbols = np.zeros(len(data) + 2 * len(texts), np.int64)
    at = np.arange(len(data)) + 2 * np.repeat(np.arange(len(texts)), np.diff(offsets)) + 1
    symbols[at] = _CLASS[data]
    if len(symbols) < 3:
        return np.zeros(SYMBOLS**3, np.int64)
    return np.bincount((symbols[:-2] * SYMBOLS + symbols[1:-1]) * SYMBOLS + symbols[2:], minlength=SYMBOLS**3)


def language_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log probabilities of a symbol after two others, [a, b, c], from all texts.

    Each batch counts its own texts; the counts of a trigram are summed by Spark, so at most
    28^3 sums reach the driver at any size of the corpus.
    """

    def run(texts: pa.Array) -> dict:
        counts = trigram_counts(texts)
        some = np.flatnonzero(counts)
        return {"trigram": some.astype(np.int32), "n": counts[some]}

    rows = map_columns(docs.select(text_col), run, "trigram int, n long").groupBy("trigram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(SYMBOLS**3)
    counts[rows["trigram"]] = rows["n"]
    return smooth(counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS))


def smooth(counts: np.ndarray) -> np.ndarray:
    """Trigrams backed off to bigrams and single symbols, as log probabilities."""
    one = (counts.sum((0, 1)) + 1) / (counts.sum() + SYMBOLS)
    two = counts.sum(0)
    two = (two + 5 * one) / (two.sum(1, keepdims=True) + 5)
    return np.log((counts + 5 * two) / (counts.sum(2, keepdims=True) + 5))


# --- the decoder ------------------------------------------------------------------------------


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Readings of a token's places, each with the channel's log probability.

    A sign reads as any of its letters, or as nothing between letters; a run of one letter of
    three or more reads as one or two of it; other letters read as themselves.
    """
    out: list[list[tuple[str, float]]] = []
    k = 0
    while k < len(token):
        c = token[k]
        end = k
        while end < len(token) and token[end] == c:
            end += 1
        run = end - k
        if c in LEET:
            readings = [(x, -1.0) for x in LEET[c]] + [("", -3.0)]
            out += [readings] * min(run, 2)
        elif run >= 3:
            out.append([(c, -1.0), (c + c, -1.5)])
        elif c in BETWEEN or c == " ":
            out.append([("", -0.5)])
        else:
            out += [[(c, 0.0)]] * run
        k = end
    return out


def symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27


def restore(token: str, model: np.ndarray) -> str:
    """The most probable letters behind a token: Viterbi over its lattice, with two symbols as the state.

    The best path into each pair of last symbols is kept, which is exact for a trigram model. Where
    all paths meet in one state, what lies before is settled and let go, so memory follows the
    longest uncertain stretch, not the token.
    """
    steps: list[list[tuple[int, str]]] = []  # for each state after each place: where it came from, and what was read
    scores = {(0, 0): 0.0}
    out: list[str] = []

    def settle(at: int) -> None:
        read = []
        for step in reversed(steps):
            at, letters = step[at]
            read.append(letters)
        out.extend(reversed(read))
        steps.clear()

    for readings in lattice(token):
        best: dict[tuple[int, int], tuple[float, int, str]] = {}
        for came, ((a, b), total) in enumerate(scores.items()):
            for letters, chance in readings:
                x, y, value = a, b, total + chance
                for c in letters:
                    s = symbol(c)
                    value += model[x, y, s]
                    x, y = y, s
                if (x, y) not in best or value > best[x, y][0]:
                    best[x, y] = value, came, letters
        scores = {state: value for state, (value, _, _) in best.items()}
        steps.append([(came, letters) for _, came, letters in best.values()])
        if len(scores) == 1:
            settle(0)
    states = [*scores]
    settle(max(range(len(states)), key=lambda k: scores[states[k]] + model[states[k][0], states[k][1], 0]))
    return "".join(out)


def disguised(data: np.ndarray, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, str]]:
    """(text, token) of what may be disguised: words with letters and signs in any places, with a letter three times in a row, with signs between single letters, and rows of single letters."""
    if not len(starts):
        return []
    n = len(data)
    letter, sign, between = _IS_LETTER[data], _IS_SIGN[data], _IS_BETWEEN[data]
    ahead = lambda x, k: np.r_[x[k:], np.zeros(min(k, n), bool)][:n]
    letters = np.r_[0, np.cumsum(letter, dtype=np.int64)]
    signed = np.unique(np.searchsorted(starts, np.flatnonzero(sign), side="right") - 1)
    signed = signed[letters[ends[signed]] > letters[starts[signed]]]
    same = np.zeros(n, bool)
    same[:-2] = letter[:-2] & (data[:-2] == data[1:-1]) & (data[:-2] == data[2:])
    marks = same & (data < 128)
    marks |= letter & ahead(between, 1) & ahead(letter, 2) & ahead(between, 3) & ahead(letter, 4)
    found = np.union1d(signed, np.searchsorted(starts, np.flatnonzero(marks), side="right") - 1)
    raw = data.tobytes()
    out = [(int(text[k]), raw[starts[k] : ends[k]].decode("utf-8", "ignore").lower()) for k in found.tolist()]
    # Rows of three or more single letters, perhaps signs among them.
    single = (ends - starts == 1) & (letter[starts] | sign[starts])
    run = np.flatnonzero(single)
    if len(run):
        cut = np.flatnonzero((np.diff(run) > 1) | (np.diff(text[run]) > 0)) + 1
        for group in np.split(run, cut):
            if len(group) >= 3:
                out.append((int(text[group[0]]), raw[starts[group[0]] : ends[group[-1]]].decode("utf-8", "ignore").lower()))
    return out


def readings(token: str, model: np.ndarray) -> list[str]:
    """What may stand behind a token. Signs at its end may be letters or punctuation: it is read with and without them, and what stands there anyway is left out."""
    core = token.strip("".join(c for c in set(token) if not c.isalnum() and c not in "@$!|+"))
    short = core.rstrip("".join(c for c in set(core) if not c.isalnum() and c != "@"))
    read = [restore(x, model) for x in dict.fromkeys((core, short))]
    return [x for x in dict.fromkeys(read) if x and x not in (core, short)]


# --- words and their list ---------------------------------------------------------------------

#: Lengths in bytes of the word beginnings that count beside whole words.
STEMS = (4, 5, 6, 7)
#: A mark is dense in a text that has it twice or more, and at least once in so many words.
DENSE_TIMES, DENSE_SHARE = 2, 0.01
#: Marks that each toxic text of the sample should have in the list, where it can.
COVER = 3


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of maximal runs of letters."""
    inside = np.r_[_IS_LETTER[data], False]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.r_[False, inside[:-1]]
    starts, ends = np.flatnonzero(inside & (~before | first)), np.flatnonzero(before & (~inside | first))
    return np.searchsorted(offsets, starts, side="right") - 1, starts, ends


def marks_of(data: np.ndarray, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each run of letters as a whole word and as its beginnings; A-Z count as a-z."""
    texts, hashes = [text], [word_hashes(data, starts, ends)]
    for k in STEMS:
        long = ends - starts > k
        texts.append(text[long])
        hashes.append(word_hashes(data, starts[long], starts[long] + k) ^ np.uint64(k))
    return np.concatenate(texts), np.concatenate(hashes)


def marks_behind(tokens: list[str], read: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(place of a token, hash) of the marks that readings have beyond those of the token as it stands; of several readings, the one with most of a mark counts."""
    strings = [x for t, r in zip(tokens, read, strict=True) for x in (t, *r)]
    token = np.repeat(np.arange(len(tokens)), [1 + len(r) for r in read])
    stands = np.r_[True, token[1:] != token[:-1]]
    data, offsets = utf8_bytes(pa.array(strings))
    string, hashes = marks_of(data, *letter_runs(data, offsets))
    if not len(string):
        return np.zeros(0, np.int64), hashes
    order = np.lexsort((string, hashes, token[string]))
    string, hashes = string[order], hashes[order]
    owner = token[string]
    new = np.r_[True, (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])]
    first = np.flatnonzero(new | np.r_[True, string[1:] != string[:-1]])
    times = np.diff(np.r_[first, len(string)])
    group = np.searchsorted(first, np.flatnonzero(new))
    own = stands[string[first]]
    more = np.maximum.reduceat(np.where(own, 0, times), group) - np.add.reduceat(np.where(own, times, 0), group)
    more = np.maximum(more, 0)
    return np.repeat(owner[new], more), np.repeat(hashes[new], more)


def marks(texts: pa.Array, model: np.ndarray, restored: dict[str, list[str]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, list[str]]]:
    """(text, hash) of the words of the texts and of what was restored, words of each text, and the restored words by text."""
    data, offsets = utf8_bytes(texts)
    runs = letter_runs(data, offsets)
    at, hashes = marks_of(data, *runs)
    words_of = np.bincount(runs[0], minlength=len(texts))
    known = {} if restored is None else restored
    more: dict[int, list[str]] = {}
    owners: dict[str, list[int]] = {}
    for k, token in disguised(data, *word_spans(data, offsets)):
        if token not in known:
            known[token] = readings(token, model)
        if known[token]:
            more.setdefault(k, []).extend(known[token])
            owners.setdefault(token, []).append(k)
    if owners:
        token, extra = marks_behind([*owners], [known[t] for t in owners])
        sizes = np.array([len(x) for x in owners.values()])
        places = np.concatenate([*owners.values()])
        at = np.r_[at, places[ragged((np.cumsum(sizes) - sizes)[token], sizes[token])]]
        hashes = np.r_[hashes, np.repeat(extra, sizes[token])]
    return at, hashes, words_of, more


@dataclass
class WordList:
    """Sorted hashes of telling words and beginnings, with the share of toxic texts among those that have them, and among those where they are dense."""

    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    shares: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))
    rest: float = 0.0

    def score(self, at: np.ndarray, hashes: np.ndarray, words_of: np.ndarray) -> np.ndarray:
        """For each text the chance that any of its distinct marks tells true."""
        clean = np.full(len(words_of), np.log1p(-min(self.rest, 0.99)))
        if len(self.hashes) and len(hashes):
            place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            hit = self.hashes[place] == hashes
            keys, times = np.unique(at[hit] * len(self.hashes) + place[hit], return_counts=True)
            text, mark = keys // len(self.hashes), keys % len(self.hashes)
            share = np.where(dense(times, words_of[text]), self.shares[mark].max(1), self.shares[mark, 0])
            np.add.at(clean, text, np.log1p(-share))
        return -np.expm1(clean)


def dense(times: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (times >= DENSE_TIMES) & (times >= DENSE_SHARE * words)


def learn(docs: DataFrame, labels: DataFrame, allowed: Column, model: np.ndarray, label: str = "toxic", most: int = 20_000, least: int = 6, share: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> WordList:
    """A word list from a bounded sample of labelled rows.

    Spark counts in how many sampled texts, and toxic ones, each mark occurs, and is dense. Marks
    of at least ``least`` toxic texts and a smoothed share of ``share`` come to the driver with the
    toxic texts that have them, bounded by the sample. From these, the mark that covers most of the
    texts that lack marks is taken again and again, until none covers ``least``; a text lacks marks
    until it has ``COVER``. So words that only stand beside telling ones hardly enter.
    """
    sample = labelled_sample(docs, labels, label, allowed, most, id_col, text_col)

    def run(texts: pa.Array, flags: pa.Array) -> dict:
        at, hashes, words_of, _ = marks(texts, model)
        order = np.lexsort((hashes, at))
        at, hashes = at[order], hashes[order]
        first = np.ones(len(at), bool)
        first[1:] = (at[1:] != at[:-1]) | (hashes[1:] != hashes[:-1])
        times = np.diff(np.r_[np.flatnonzero(first), len(at)])
        sums = np.bincount(at, weights=(hashes >> np.uint64(11)).astype(float), minlength=len(texts))
        at, hashes = at[first], hashes[first]
        tells = flags.to_numpy(zero_copy_only=False) > 0
        many = dense(times, words_of[at])
        return {"text": pa.array(np.r_[sums[at], sums[at[many]]]), "mark": pa.array(np.r_[hashes, hashes[many]].view(np.int64)), "dense": pa.array(np.r_[np.zeros(len(at), bool), np.ones(many.sum(), bool)]), "toxic": pa.array(np.r_[tells[at], tells[at[many]]])}

    # A text is known by the sum of its marks' hashes, so exact copies count once.
    rows = map_columns(sample.select(text_col, F.col("label").cast("int")), run, "text double, mark long, dense boolean, toxic boolean").distinct().persist()
    try:
        counts = rows.groupBy("mark", "dense").agg(F.count("*").alias("n"), F.sum(F.col("toxic").cast("long")).alias("bad"))
        good = counts.where((F.col("bad") >= least) & ((F.col("bad") + 0.5) / (F.col("n") + 1) >= share))
        pairs = rows.where("toxic").join(good, ["mark", "dense"]).select("mark", "dense", "text", "n", "bad").toPandas()
        toxic = rows.where("toxic").select("text").distinct().count()
        total = rows.select("text").distinct().count()
    finally:
        rows.unpersist()
    covers = {k: set(g["text"]) for k, g in pairs.groupby(["mark", "dense"])}
    shares = {(m, d): (b + 0.5) / (n + 1) for m, d, n, b in pairs[["mark", "dense", "n", "bad"]].drop_duplicates().itertuples(index=False)}
    chosen: dict[int, list[float]] = {}
    taken: list[set[float]] = []
    lacks = dict.fromkeys(set(pairs["text"]), COVER)
    open_texts = {k: set(s) for k, s in covers.items()}
    while open_texts:
        best = max(open_texts, key=lambda k: (len(open_texts[k]) * (shares[k] - 0.5), -k[0], k[1]))
        if len(open_texts.pop(best)) < least:
            break
        own = covers[best]
        if any(len(own & t) >= 0.9 * len(own) and len(t) <= 1.5 * len(own) for t in taken):
            continue  # another spelling of a mark that is in the list
        chosen.setdefault(best[0], [0.0, 0.0])[int(best[1])] = shares[best]
        taken.append(own)
        full = set()
        for t in own:
            lacks[t] -= 1
            if lacks[t] == 0:
                full.add(t)
        open_texts = {k: left for k, s in open_texts.items() if len(left := s - full) >= least}
    covered = set().union(*taken)
    hashes = np.array([*chosen], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    rest = (toxic - len(covered)) / max(1, total - len(covered)) if total else 0.0
    return WordList(hashes[order], np.array([*chosen.values()]).reshape(-1, 2)[order], rest)


#: Restored tokens that a worker keeps at most, of one model; beyond, it begins anew.
KEPT = 50_000
_restored: dict[bytes, dict[str, list[str]]] = {}


def _kept(key: bytes) -> dict[str, list[str]]:
    """What the worker has restored with the model of this key; what it restored with others goes."""
    if key not in _restored or len(_restored[key]) > KEPT:
        _restored.clear()
        _restored[key] = {}
    return _restored[key]


def score(docs: DataFrame, model: np.ndarray, words: WordList, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``score`` and ``restored`` (what the decoder read behind disguised tokens) of every text.

    Null and empty texts get the score of texts without a telling word. Repeated rows and null
    ids stay rows of their own; other columns are ignored. An empty table gives no rows.
    """
    key = sha256(model.tobytes()).digest()

    def run(ids: pa.Array, texts: pa.Array) -> dict:
        at, hashes, words_of, more = marks(texts, model, _kept(key))
        return {"id": ids, "score": words.score(at, hashes, words_of), "restored": pa.array([more.get(k, []) for k in range(len(texts))], pa.list_(pa.string()))}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_columns(docs.select(id_col, text_col), run, f"id {kind}, score double, restored array<string>").withColumnRenamed("id", id_col)


def flag(docs: DataFrame, model: np.ndarray, words: WordList, threshold: float, text_col: str = "text") -> DataFrame:
    """``docs`` with ``predicted`` as last column: 1 where the score reaches the threshold.

    No join, so rows stay as they are: repeated rows, null ids and all columns; where ``docs`` has
    a column of that name, the last one is ``_predicted``. Null and empty texts are scored like
    others. An empty table gives no rows.
    """
    key = sha256(model.tobytes()).digest()

    def run(texts: pa.Array) -> dict:
        at, hashes, words_of, _ = marks(texts, model, _kept(key))
        return {"predicted": (words.score(at, hashes, words_of) >= threshold).astype(np.int32)}

    return add_columns(docs, [text_col], run, "predicted int")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", folds: int = 3, held_out: int = 1) -> DataFrame:
    """Model and word list from the tables, then every row's id, held_out, score, predicted and restored.

    The language model counts all texts; labels of the held-out fold are never read. Without
    toxic labels no word tells and all scores are 0.
    """
    fold = remainder(F.col(id_col), folds)
    model = language_model(docs, text_col)
    words = learn(docs, labels, fold != held_out, model, id_col=id_col, text_col=text_col)
    scored = score(docs, model, words, id_col, text_col)
    return scored.select(id_col, F.coalesce(fold == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "restored")
