"""Importance resampling of documents towards a target distribution, over hashed word n-grams.

Each document is normalised to its words with one space between them. One scan keeps the CRC-32
register at every byte; the CRC of any n-gram follows from the registers at its two ends, as a
register shifted by the n-gram's length, by multiplication in GF(2), cancels what stands before it.
So n-grams of all orders come from one scan, and no n-gram is ever built as a string.

N-grams fall into buckets by their CRC. A bucket's gain is the logarithm of how much more frequent
it is in the target than in the corpus; a document's weight is the mean gain of its n-grams; weights
with Gumbel noise from a hash of the id are ranked, which draws documents without replacement.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow import ragged, utf8_bytes
from .shared import durable
from .words import LOWER

POLYNOMIAL = 0xEDB88320
LANE = 512
#: Bytes of text that are scanned together.
AT_ONCE = 4 << 20
IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True


@cache
def byte_table() -> np.ndarray:
    """The register after one byte, by the byte xor the lowest byte of the register."""
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, x >> np.uint32(1) ^ np.uint32(POLYNOMIAL), x >> np.uint32(1))
    return x


@cache
def shift_table(power: int) -> np.ndarray:
    """Four tables, one for each byte of a register, whose sum is the register 2^power zero bytes later."""
    x = np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * 8)[:, None]
    if power == 0:
        return byte_table()[x & 255] ^ x >> np.uint32(8)
    half = shift_table(power - 1)
    return apply(half, apply(half, x))


def apply(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    return table[0][x & 255] ^ table[1][x >> np.uint32(8) & 255] ^ table[2][x >> np.uint32(16) & 255] ^ table[3][x >> np.uint32(24)]


def shifted(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each register so many zero bytes later."""
    x = x.astype(np.uint32)
    for power in range(int(n.max(initial=0)).bit_length()):
        moved = np.flatnonzero(n >> power & 1)
        x[moved] = apply(shift_table(power), x[moved])
    return x


def running(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The register, from zero at the beginning of ``data``, before each of the bytes ``at``.

    The data is cut into lanes of 512 bytes, which are scanned side by side; a lane's begin is the
    end of the one before, shifted, plus what the lane itself adds.
    """
    lanes = len(data) // LANE + 1
    columns = np.zeros((lanes, LANE), np.uint8)
    columns.reshape(-1)[: len(data)] = data
    columns = np.ascontiguousarray(columns.T)
    seen = np.zeros((LANE + 1, lanes), np.uint32)
    table = byte_table()
    for k in range(LANE):
        seen[k + 1] = table[(seen[k] ^ columns[k]) & 255] ^ seen[k] >> np.uint32(8)
    t = [row.tolist() for row in shift_table(LANE.bit_length() - 1)]
    begins, now = np.zeros(lanes, np.uint32), 0
    for k, added in enumerate(seen[LANE].tolist()):
        begins[k] = now
        now = t[0][now & 255] ^ t[1][now >> 8 & 255] ^ t[2][now >> 16 & 255] ^ t[3][now >> 24] ^ added
    lane, inside = at // LANE, at % LANE
    return seen[inside, lane] ^ shifted(begins[lane], inside)


def ngram_crcs(data: np.ndarray, offsets: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text of each n-gram, its CRC-32, number of words of each text) of all runs of 1 to ``longest`` words."""
    low = LOWER[data]
    inside = np.zeros(len(low) + 1, bool)
    inside[:-1] = IS_WORD[low]
    cut = np.zeros(len(low) + 1, bool)
    cut[offsets] = True
    before = np.r_[False, inside[:-1]]
    starts, ends = np.flatnonzero(inside & (~before | cut)), np.flatnonzero(before & (~inside | cut))
    owner = np.searchsorted(offsets, starts, side="right") - 1
    words = np.bincount(owner, minlength=len(offsets) - 1)
    length = ends - starts
    first = np.cumsum(length + 1) - length - 1
    normal = np.full(int(length.sum()) + len(length), 32, np.uint8)
    normal[ragged(first, length)] = low[ragged(starts, length)]
    at_start, at_end = running(normal, first), running(normal, first + length)
    who, crcs = [], []
    for n in range(1, longest + 1):
        k = np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1 :])
        last = k + n - 1
        span = first[last] + length[last] - first[k]
        crcs.append(shifted(at_start[k] ^ np.uint32(0xFFFFFFFF), span) ^ at_end[last] ^ np.uint32(0xFFFFFFFF))
        who.append(owner[k])
    return np.concatenate(who), np.concatenate(crcs), words


def _parts(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole texts, about ``AT_ONCE`` bytes together."""
    data, offsets = utf8_bytes(texts)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + AT_ONCE, side="right")) - 1)
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = 10_000, longest: int = 2) -> DataFrame:
    """(bucket, n) of all n-grams of all texts, repeats counted; buckets without any are left out. Null and empty texts have none.

    A task sums its own counts first, so it sends one row a bucket at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, data, offsets in _parts(batch.column(0)):
                counts += np.bincount(ngram_crcs(data, offsets, longest)[1] % np.uint32(buckets), minlength=buckets)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used])], names=["bucket", "n"])

    return docs.select(F.col(text).cast("string")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = 10_000) -> DataFrame:
    """(bucket, gain) of every bucket from two tables of counts: 1000 times the logarithm of the smoothed odds, floored."""
    spark = corpus.sparkSession
    both = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = both.join(corpus.select("bucket", F.col("n").alias("s")), "bucket", "left").join(target.select("bucket", F.col("n").alias("t")), "bucket", "left").fillna(0)
    sums = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    odds = ((F.col("t") + 1.0) * (F.col("all_s") + float(buckets))) / ((F.col("s") + 1.0) * (F.col("all_t") + float(buckets)))
    return both.join(F.broadcast(sums), how="cross").select("bucket", F.floor(1000 * F.log(odds)).cast("long").alias("gain"))  # one row of sums


def weigh(docs: DataFrame, gain: DataFrame, id_col: str = "doc_id", text: str = "text", buckets: int = 10_000, longest: int = 2) -> DataFrame:
    """(id, n_words, n_features, weight) of every row: weight is the mean gain, floored, 0 without n-grams.

    The gains, a table of so many buckets, go to all tasks; rows aren't shuffled. Null texts count
    as empty ones.
    """
    by_bucket = np.zeros(buckets, np.int64)
    for row in gain.collect():  # one row a bucket
        by_bucket[row["bucket"]] = row["gain"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in _parts(batch.column(1)):
                who, crcs, words = ngram_crcs(data, offsets, longest)
                features = np.bincount(who, minlength=len(words))
                total = np.zeros(len(words), np.int64)
                np.add.at(total, who, by_bucket[crcs % np.uint32(buckets)])
                weight = np.where(features > 0, total // np.maximum(features, 1), 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(words)), pa.array(words.astype(np.int64)), pa.array(features.astype(np.int64)), pa.array(weight)], names=["id", "n_words", "n_features", "weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text).cast("string")).mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long").withColumnRenamed("id", id_col)


def noise(id_col: str, seed: int) -> Column:
    """Gumbel noise of a row, in thousandths, from a hash of the seed and the id; rows without id share the noise of an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def draw(weighed: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, id_col: str = "doc_id") -> DataFrame:
    """``weighed`` with score and rank: 1, 2, 3, ... by descending score, ties by smaller id, of the drawn ``percent`` of the rows of ``least_words`` words or more; null for all others.

    Ranks need no sort of all rows in one place: rows are counted by score, which is a whole number
    within some 100,000 (logarithms of counts and of 32-bit hashes bound it), sums of these counts
    tell how many rows are better, and only rows of one score are put in order. Rows that share id
    and score get consecutive ranks in any order.
    """
    scored = durable(weighed.withColumn("score", F.col("weight") + noise(id_col, seed)))
    fit = F.col("n_words") >= least_words
    by_score = scored.where(fit).groupBy("score").agg(F.count("*").alias("n"))
    better = F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1))
    every = F.sum("n").over(Window.partitionBy(F.lit(0)))
    places = by_score.select("score", F.coalesce(better, F.lit(0)).alias("better"), F.floor(every * percent / 100).alias("most"))
    met = scored.join(F.broadcast(places.where("better < most")), "score", "left")  # one row a score: bounded as said above
    candidate = fit & F.col("better").isNotNull()
    rank = F.col("better") + F.row_number().over(Window.partitionBy("score").orderBy(F.col(id_col).asc_nulls_last()))
    drawn = met.where(candidate).withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= F.col("most"), F.col("rank")).cast("long"))
    rest = met.where(~candidate | candidate.isNull()).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select(*weighed.columns, "score", "rank")
