"""Similarity digests of texts from improbable features.

A feature is a window of 32 bytes. How probable it is, is told by its entropy: ``rarity`` counts
the entropies of all windows of a corpus, and the rarer an entropy, the better its rank. Of each run
of 32 neighbouring windows the best one (the leftmost, on a tie) gets a vote; windows with 8 votes or
more are the features of a text (a text without such has one all the same, and short texts have all
of their windows of 8 bytes besides). They are inserted, in the order of the text, into a chain of Bloom
filters of 2,048 bits, five bits a feature and 160 features a filter.

Two digests are as like as the filters of the shorter chain are, on average, like their best
counterparts in the other chain. Two filters are as like as their common bits are, on a scale from
what the best of so many filters of so many bits shares by chance (0) to the bits of the smaller one
(1).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import add_columns, ragged, utf8_bytes
from .words import word_hashes

WINDOW = 32
VOTES = 8
#: Texts under 128 bytes have few windows to choose from; all of their windows of 8 bytes are features as well.
SHORT, SMALL = 128, 8
#: Entropies are told apart in steps of 1/200 bit; below 2 bits a window says too little to be a feature.
STEPS, LEAST = 200, 2
BINS = 5 * STEPS + 1
BITS, HASHES, FEATURES = 2048, 5, 160
#: c * log2(c) of a byte that a window has c times, in 2^-20 bits a window.
TERM = np.round(np.arange(WINDOW + 1) * np.log2(np.maximum(np.arange(WINDOW + 1), 1)) / WINDOW * (1 << 20)).astype(np.int64)
#: Bytes that are looked at together.
AT_ONCE = 1 << 20


def entropies(data: np.ndarray) -> np.ndarray:
    """The bin of the entropy of each window of ``data``, by the window's first byte.

    As a window moves on by a byte, one count falls and one rises, so its entropy is a running sum.
    How often a byte stands among its 31 neighbours on either side is counted by comparing the data
    with itself, moved by 1 to 31 bytes.
    """
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int16)
    before, behind, same = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8), np.empty(len(data), bool)
    for lag in range(1, WINDOW):
        hit = same[: len(data) - lag]
        np.equal(data[lag:], data[:-lag], out=hit)
        before[lag:] += hit.view(np.uint8)
        behind[:-lag] += hit.view(np.uint8)
    rise = TERM[1:] - TERM[:-1]
    first = TERM[np.bincount(data[:WINDOW], minlength=256)].sum()
    change = rise[before[WINDOW:]] - rise[behind[: n - 1]]
    total = np.concatenate([[first], first + np.cumsum(change)])
    bits = 5 * (1 << 20) - total
    return (bits * STEPS >> 20).clip(0, BINS - 1).astype(np.int16)


def windows_of(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of each text; windows that cross the end of a text belong to none."""
    return offsets[:-1], np.maximum(np.diff(offsets) - WINDOW + 1, 0)


def rarity(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The rank of each entropy bin, from counts of all windows of all texts; 0 is the rarest.

    Null and empty texts have no windows; without any window ranks follow the bins. The counts are a
    table of about a thousand rows at any size of the corpus, summed by Spark.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BINS, np.int64)
        for batch in batches:
            for data, offsets in pieces(batch.column(0)):
                starts, n = windows_of(offsets)
                counts += np.bincount(entropies(data)[ragged(starts, n)], minlength=BINS)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used])], names=["bin", "n"])

    found = docs.select(F.col(text).cast("string")).mapInArrow(run, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(BINS, np.int64)
    for row in found:
        counts[row["bin"]] = row["n"]
    ranks = np.empty(BINS, np.int64)
    ranks[np.argsort(counts, kind="stable")] = np.arange(BINS)
    return ranks


def pieces(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and offsets of runs of whole texts, about ``AT_ONCE`` bytes together."""
    data, offsets = utf8_bytes(texts)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + AT_ONCE, side="right")) - 1)
        yield data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def _select(data: np.ndarray, offsets: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the features of all texts, in order."""
    starts, n = windows_of(offsets)
    owner, at = np.repeat(np.arange(len(n)), n), ragged(starts, n)
    bins = entropies(data)[at]
    worst = np.int64(BINS)
    rank = np.where(bins >= LEAST * STEPS, ranks[bins], worst)
    # Runs of windows may hang over the ends of a text, so its first and last windows have as many votes to win. Between texts stand 31 windows of no text.
    room = n + (WINDOW - 1) * (n > 0)
    base = np.cumsum(room) - room + (WINDOW - 1)
    place = base[owner] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    total = int(room.sum()) + WINDOW - 1
    none = np.int64(1 << 62)
    key = np.full(total, none)
    key[place] = rank << np.int64(40) | place
    best = key
    for step in (1, 2, 4, 8, 16):
        best = np.minimum(best[:-step], best[step:])
    won = best[best < none] & np.int64((1 << 40) - 1)
    votes = np.bincount(won, minlength=total)[place]
    chosen = (votes >= VOTES) & (rank < worst)
    # A text without such a window has the one with most votes, or all of the text if no window says enough.
    lone = np.bincount(owner[chosen], minlength=len(n)) == 0
    good = np.flatnonzero(lone[owner] & (rank < worst))
    if len(good):
        order = good[np.lexsort((at[good], -votes[good], owner[good]))]
        first = np.r_[True, owner[order][1:] != owner[order][:-1]]
        chosen[order[first]] = True
        lone[owner[order[first]]] = False
    size = np.diff(offsets)
    whole = np.flatnonzero((lone & (size >= SHORT)) | ((size > 0) & (size < SMALL)))
    small = np.where(size < SHORT, np.maximum(size - SMALL + 1, 0), 0)
    pieces = ragged(offsets[:-1], small)
    who = np.concatenate([owner[chosen], whole, np.repeat(np.arange(len(n)), small)])
    begin = np.concatenate([at[chosen], offsets[whole], pieces])
    end = np.concatenate([at[chosen] + WINDOW, offsets[whole + 1], pieces + SMALL])
    order = np.lexsort((end, begin, who))
    return who[order], begin[order], end[order]


def digests(data: np.ndarray, offsets: np.ndarray, ranks: np.ndarray) -> list[np.ndarray]:
    """The chain of filters of each text, as rows of 64-bit words; an empty text has no filter."""
    n = len(offsets) - 1
    who, begin, end = _select(data, offsets, ranks)
    value = word_hashes(data, begin, end, lower=False)
    # A feature counts once a text.
    order = np.lexsort((np.arange(len(value)), value, who))
    again = np.zeros(len(value), bool)
    again[order[1:]] = (value[order][1:] == value[order][:-1]) & (who[order][1:] == who[order][:-1])
    who, value = who[~again], value[~again]
    count = np.bincount(who, minlength=n)
    filters = -(-count // FEATURES)
    nth = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
    row = (np.cumsum(filters) - filters)[who] + nth // FEATURES
    bits = np.zeros((int(filters.sum()), BITS), np.uint8)
    for k in range(HASHES):
        bits[row, (value >> np.uint64(11 * k) & np.uint64(BITS - 1)).astype(np.int64)] = 1
    packed = np.packbits(bits, axis=1, bitorder="little").view("<u8")
    return np.split(packed, np.cumsum(filters)[:-1]) if n else []


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Of two chains, from 0 to 1; two empty chains are alike, an empty and another one are not."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(b) < len(a) or (len(a) == len(b) and a.tobytes() > b.tobytes()):
        a, b = b, a
    of_b = np.bitwise_count(b).sum(1).astype(np.float64)
    spread = np.sqrt(2 * np.log(len(b)))  # the best of so many tries by chance, in standard deviations
    total = 0.0
    for x in a:
        of_a = float(np.bitwise_count(x).sum())
        common = np.bitwise_count(b & x).sum(1).astype(np.float64)
        chance = of_a * of_b / BITS
        chance += spread * np.sqrt(chance * (1 - of_b / BITS))
        total += float(((common - chance) / np.maximum(np.minimum(of_a, of_b) - chance, 1e-9)).clip(0, 1).max())
    return total / len(a)


def write(chain: np.ndarray) -> str:
    """A chain as text: the number of filters and their bits in base 64."""
    return f"{len(chain)}:{base64.b64encode(chain.tobytes()).decode()}"


def read(told: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(told.split(":", 1)[1]), "<u8").reshape(-1, BITS // 64)


def fingerprints(docs: DataFrame, ranks: np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` with column ``fingerprint``, the digest of the whole text; null counts as empty, equal texts have equal ones.

    Rows stay where they are: nothing is shuffled. Where the name is taken, it gets underscores
    before it. Very long texts take some 40 bytes of memory for each of theirs while they are read.
    """
    def run(texts: pa.Array) -> dict:
        return {"fingerprint": [write(c) for data, offsets in pieces(texts) for c in digests(data, offsets, ranks)]}

    return add_columns(docs, [text], run, "fingerprint string", AT_ONCE)


def _bucketed(docs: DataFrame, buckets: int) -> DataFrame:
    """``docs`` with ``bucket``: ranges of ids, larger ids first; rows without id come last."""
    bounds = docs.select(F.col("id").cast("double").alias("x")).where("x is not null").approxQuantile("x", [k / buckets for k in range(1, buckets)], 1 / (4 * buckets)) if buckets > 1 else []
    if not bounds:
        return docs.withColumn("bucket", F.when(F.col("id").isNull(), 2).otherwise(1))
    splits = [-float("inf"), *sorted(set(bounds)), float("inf")]
    placed = Bucketizer(splits=splits, inputCol="_x", outputCol="_b").transform(docs.withColumn("_x", F.coalesce(F.col("id").cast("double"), F.lit(0.0))))
    return placed.withColumn("bucket", F.when(F.col("id").isNull(), len(splits)).otherwise(len(splits) - 1 - F.col("_b")).cast("int")).drop("_x", "_b")


def _in_turn(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, tail, id, text), each bucket in one partition and in order, with the document that follows its last one behind it, marked as ``tail``.

    Order is that of descending id (rows without id last), of rows with one id that of a hash of
    their texts; after the last document comes the first. Only the first document's id and hash of
    each bucket reach the driver, not a text.
    """
    placed = _bucketed(docs, buckets).withColumns({"down": F.coalesce(F.bitwise_not("id"), F.lit((1 << 63) - 1)), "mark": F.xxhash64("text")})
    heads = sorted(tuple(r) for r in placed.groupBy("bucket").agg(F.min(F.struct("down", "mark")).alias("h")).select("bucket", "h.down", "h.mark").collect())
    # The first of a bucket follows the last of the bucket before, the first of all the last of all.
    follows = [(*head, heads[k - 1][0]) for k, head in enumerate(heads)]
    extra = docs.sparkSession.createDataFrame(follows, "bucket int, down long, mark long, goes_to int")
    met = placed.join(F.broadcast(extra), ["bucket", "down", "mark"], "left")  # one row a bucket
    own = F.struct("bucket", F.lit(False).alias("tail"))
    places = F.when(F.col("goes_to").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("goes_to").alias("bucket"), F.lit(True).alias("tail"))))
    dealt = met.select(F.explode(places).alias("p"), "down", "mark", "id", "text").select("p.bucket", "p.tail", "down", "mark", "id", "text")
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "tail", "down", "mark", "text").select("bucket", "tail", "id", "text")


def edited(text: str, after: str) -> str:
    """``text`` with its last third replaced by the beginning of ``after``, as long if there is so much."""
    k = len(text) // 3
    return text[: len(text) - k] + after[:k]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Lists of (id, text, next text) of about ``AT_ONCE`` characters, from rows in turn."""
    held, size, last, answered = [], 0, None, True
    for batch in batches:
        for bucket, tail, i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = text or ""
            if last is not None and last[0] == bucket and not answered:
                held.append((last[1], last[2], text))
                size += len(text) + len(last[2])
                if size > AT_ONCE:
                    yield held
                    held, size = [], 0
            # Rows equal to the head of a bucket all follow its predecessor; the first answers.
            last, answered = (bucket, i, text), tail
    if held:
        yield held


def compared(docs: DataFrame, ranks: np.ndarray, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Digest of each text and of its edited text (``edited`` by the next document, descending id), and how like they are.

    Columns: the id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and
    near_next (likeness to the next document's). Null texts count as empty ones, rows without id
    come last; of rows with one id those of equal texts are neighbours. A single document follows
    itself. Texts are shuffled once, into ranges of ids, so no task gets more than a share of them.
    """
    spark = docs.sparkSession
    wanted = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    buckets = min(8 * int(spark.conf.get("spark.sql.shuffle.partitions")), 4096)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _pairs(batches):
            changed = [edited(t, after) for _, t, after in rows]
            texts = [x for (_, t, after), c in zip(rows, changed, strict=True) for x in (t, c, after)]
            different = {t: k for k, t in enumerate(dict.fromkeys(texts))}
            chains = [c for data, offsets in pieces(pa.array(list(different), pa.large_string())) for c in digests(data, offsets, ranks)]
            told = [[chains[different[x]] for x in texts[3 * k : 3 * k + 3]] for k in range(len(rows))]
            yield pa.RecordBatch.from_pydict(
                {
                    "id": pa.array([r[0] for r in rows], pa.int64()),
                    "n_chars": pa.array([len(r[1]) for r in rows], pa.int64()),
                    "edited_sha256": [hashlib.sha256(c.encode()).hexdigest() for c in changed],
                    "fingerprint": [write(c[0]) for c in told],
                    "edited_fingerprint": [write(c[1]) for c in told],
                    "near_edited": [likeness(c[0], c[1]) for c in told],
                    "near_next": [likeness(c[0], c[2]) for c in told],
                }
            )

    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _in_turn(wanted, buckets).mapInArrow(run, schema).withColumnRenamed("id", id_col)
