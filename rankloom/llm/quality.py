"""Quality classifier: a generalised additive model with pairwise interactions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import add_columns, map_columns, utf8_bytes
from .words import word_hashes, word_spans

FEATURES = ("log_chars", "log_words", "mean_word", "sd_word", "upper", "symbols", "digits", "marks", "bars", "ends_odd", "repeats", "double_repeats", "distinct", "distinct_per_root", "short_words", "long_words", "sentence_ends", "commas", "lines", "non_ascii", "capital_words")

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_HIGH = np.zeros(256, bool)
_HIGH[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#$%&*@^~<>{}[]\\_=+`|/")] = True


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text, from whole texts; null and empty texts have zeros."""
    data, offsets = utf8_bytes(texts)
    size = np.diff(offsets).astype(float)
    n = len(size)

    bytes_of = np.array([np.bincount(data[a:b], minlength=256) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]).reshape(n, 256)

    def count(table: np.ndarray) -> np.ndarray:
        return bytes_of[:, table].sum(1).astype(float)

    def of(*chars: str) -> np.ndarray:
        table = np.zeros(256, bool)
        table[[ord(c) for c in chars]] = True
        return count(table)

    text, starts, ends = word_spans(data, offsets)
    words = np.bincount(text, minlength=n).astype(float)
    hashes = word_hashes(data, starts, ends)
    length = (ends - starts).astype(float)
    per_word = lambda x: np.bincount(text, weights=x, minlength=n)
    some, chars = np.maximum(words, 1), np.maximum(size, 1)
    mean = per_word(length) / some
    same = np.zeros(len(text), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    twice = np.zeros(len(text), bool)
    twice[2:] = (hashes[2:] == hashes[:-2]) & (text[2:] == text[:-2])
    order = np.lexsort((hashes, text))
    new = np.ones(len(text), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (text[order][1:] != text[order][:-1])
    distinct = np.bincount(text[order], weights=new, minlength=n)
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    first = data[starts] if len(starts) else np.zeros(0, np.uint8)
    odd = ~(_LETTER | _HIGH | _DIGIT)[last] & ~np.isin(last, list(b".,;:?!\"')"))
    letters = np.maximum(count(_LETTER), 1)
    out = [
        np.log1p(size), np.log1p(words), mean, np.sqrt(np.maximum(per_word(length**2) / some - mean**2, 0)), count(_UPPER) / letters, count(_SYMBOL) / chars, count(_DIGIT) / chars,
        of("!") / some, of("|") / some, per_word(odd) / some, per_word(same) / some, per_word(twice) / some, distinct / some, distinct / np.sqrt(some),
        per_word(length <= 2) / some, per_word(length >= 12) / some, of(".", "?") / some, of(",") / some, of("\n") / some, count(_HIGH) / chars, per_word(_UPPER[first]) / some,
    ]
    return np.column_stack(out)


@dataclass
class Additive:
    """Lookup tables: by bins of each feature, and by coarser bins of pairs of features."""

    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities, by adding up looked-up values."""
        total = np.full(len(x), self.start)
        for j, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += table[np.searchsorted(cuts, x[:, j], side="right")]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _best_cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """(gain, last bin on the left) of the best split of bins with gradient and curvature sums."""
    if len(g) < 2:
        return 0.0, -1
    left, weight = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    all_g, all_h = g.sum(), h.sum()
    gain = left**2 / (weight + ridge) + (all_g - left) ** 2 / (all_h - weight + ridge) - all_g**2 / (all_h + ridge)
    k = int(np.argmax(gain))
    return float(gain[k]), k


def _shallow(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """Leaf values by bin of a tree with two levels of splits."""
    out = np.empty(len(g))
    _, k = _best_cut(g, h, ridge)
    for a, b in ((0, k + 1), (k + 1, len(g))):
        if a < b:
            _, m = _best_cut(g[a:b], h[a:b], ridge)
            for c, d in ((a, a + m + 1), (a + m + 1, b)):
                if c < d:
                    out[c:d] = g[c:d].sum() / (h[c:d].sum() + ridge)
    return out


def _shallow_pair(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """Leaf values of a tree that splits the first feature, then each side by the second."""
    out = np.empty(g.shape)
    _, k = _best_cut(g.sum(1), h.sum(1), ridge)
    for a, b in ((0, k + 1), (k + 1, len(g))):
        if a < b:
            gs, hs = g[a:b].sum(0), h[a:b].sum(0)
            _, m = _best_cut(gs, hs, ridge)
            for c, d in ((0, m + 1), (m + 1, len(gs))):
                if c < d:
                    out[a:b, c:d] = gs[c:d].sum() / (hs[c:d].sum() + ridge)
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.1, bins: int = 48, pair_bins: int = 12, pairs: int = 6, pair_rounds: int = 40, ridge: float = 2.0) -> Additive:
    """Boost shallow trees, one feature at a time in a cycle, then the pairs with the largest remaining gain."""
    n, m = x.shape
    rate_of_ones = (y.sum() + 1) / (n + 2)
    start = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    cuts = [_edges(x[:, j], bins) for j in range(m)]
    coarse = [_edges(x[:, j], pair_bins) for j in range(m)]
    at = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)]
    rough = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(coarse)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    total = np.full(n, start)

    def sums(where: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return np.bincount(where, weights=y - p, minlength=size), np.bincount(where, weights=p * (1 - p), minlength=size)

    for _ in range(rounds):
        for j in range(m):
            step = rate * _shallow(*sums(at[j], len(tables[j])), ridge)
            tables[j] += step
            total += step[at[j]]
    ranked = []
    for a in range(m):
        for b in range(a + 1, m):
            g, h = (s.reshape(len(coarse[a]) + 1, -1) for s in sums(rough[a] * (len(coarse[b]) + 1) + rough[b], (len(coarse[a]) + 1) * (len(coarse[b]) + 1)))
            ranked.append((float((_shallow_pair(g, h, ridge) * g).sum()), a, b))
    chosen = [(a, b) for gain, a, b in sorted(ranked, reverse=True)[:pairs] if gain > 0]
    pair_tables = [np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for a, b in chosen]
    for _ in range(pair_rounds):
        for table, (a, b) in zip(pair_tables, chosen, strict=True):
            where = rough[a] * table.shape[1] + rough[b]
            g, h = (s.reshape(table.shape) for s in sums(where, table.size))
            step = rate * _shallow_pair(g, h, ridge)
            table += step
            total += step.ravel()[where]
    return Additive(cuts, tables, coarse, chosen, pair_tables, start)


def remainder(id_col: Column, mod: int) -> Column:
    """CRC-32 of an id as text, modulo ``mod``; null for null ids."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(mod))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, label) of about ``most`` labelled rows that ``allowed`` (on the id) admits, drawn by a hash of the id.

    Of several labels of one id the larger counts, of several texts the last in their order. The
    drawn ids, about ``most``, are few enough to broadcast.
    """
    one = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & allowed).groupBy(id_col).agg(F.max(label).alias("label"))
    total = one.count()
    share = min(1.0, most / max(total, 1))
    drawn = one.where(F.shiftrightunsigned(F.xxhash64(id_col), 1) < min(int(share * 2**63), 2**63 - 1))
    met = docs.select(id_col, text_col).join(F.broadcast(drawn), id_col)
    return met.groupBy(id_col, "label").agg(F.max(F.coalesce(text_col, F.lit(""))).alias(text_col)).select(id_col, text_col, "label")


def train(docs: DataFrame, labels: DataFrame, allowed: Column, label: str = "quality", most: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> Additive | None:
    """A model from a bounded sample of labelled rows; None unless both labels occur.

    Only the sample's features, some 21 numbers a row, come to the driver.
    """
    sample = labelled_sample(docs, labels, label, allowed, most, id_col, text_col)

    def run(texts: pa.Array, marks: pa.Array) -> dict:
        x = features(texts)
        return {"x": pa.array(list(x), pa.list_(pa.float64())), "label": marks}

    rows = map_columns(sample.select(text_col, F.col("label").cast("int")), run, "x array<double>, label int").toPandas()
    if rows["label"].nunique() < 2:
        return None
    order = np.lexsort(np.vstack(rows["x"]).T)  # the order of rows, and so the model, doesn't hang on the order of tasks
    return fit(np.vstack(rows["x"])[order], (rows["label"] > 0).to_numpy(float)[order])


def score(docs: DataFrame, model: Additive | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and ``score``, the probability of label 1, of every text, by additions of looked-up values.

    Without a model every score is 0.5. Null and empty texts have zeros as features and are scored
    like others. Repeated rows and null ids stay rows of their own; other columns are ignored.
    """

    def run(ids: pa.Array, texts: pa.Array) -> dict:
        x = features(texts)
        return {"id": ids, "score": np.full(len(x), 0.5) if model is None else model.score(x)}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_columns(docs.select(id_col, text_col), run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def flag(docs: DataFrame, model: Additive | None, threshold: float, text_col: str = "text") -> DataFrame:
    """``docs`` with ``predicted`` as last column: 1 where the score reaches the threshold.

    No join, so rows stay as they are: repeated rows, null ids and all columns; where ``docs`` has
    a column of that name, the last one is ``_predicted``. Null and empty texts are scored like
    others. An empty table gives no rows.
    """

    def run(texts: pa.Array) -> dict:
        x = features(texts)
        value = np.full(len(x), 0.5) if model is None else model.score(x)
        return {"predicted": (value >= threshold).astype(np.int32)}

    return add_columns(docs, [text_col], run, "predicted int")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_out: int = 0) -> DataFrame:
    """Train on labels outside the held-out fold, then score every row: id, held_out, score, predicted."""
    fold = remainder(F.col(id_col), folds)
    scored = score(docs, train(docs, labels, fold != held_out, id_col=id_col, text_col=text_col), id_col, text_col)
    return scored.select(id_col, F.coalesce(fold == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
