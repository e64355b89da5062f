"""Phrase collocations from FM-indexes over word ids, one for each shard of a language's texts.

A shard is some million words of one language. Its text is a row of word ids, with 0 between
pieces, of which two Burrows-Wheeler transforms are kept: of the row and of the reversed row. As
phrases have five words at most, suffixes are sorted by five words only; that is enough for every
step below. An interval of suffixes stands for a phrase, one in each transform, of equal length.
A phrase is extended by a word on its right by a step in the reversed transform, and on its left by
one in the other; the other interval follows from how many of the words met are smaller.

Phrases grow a word at a time, in all shards alike. A shard sends the phrases of n + 1 words whose
first and last n words are both frequent in the corpus; counts are summed across shards; what is
frequent goes back to the shards that hold it and is extended next. So a shard neither needs a
table of all phrases nor sends those that can't be frequent, and no count is cut or estimated.
The indexes are a table bucketed by shard, which no round shuffles.

A phrase is known by the shard and interval where it is found first, and by its first and last
n - 1 words, which are phrases in turn; so nothing is told apart by a hash.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrow import ragged, releasing, utf8_bytes
from .shared import durable, scratch, shared_folder
from .words import LOWER, mix

#: Words that a shard holds before it is closed (a text isn't split), and shards of a task.
SHARD_WORDS = 2 << 20
SHARDS_A_TASK = 1 << 12
DEPTH = 5
#: Turns in which pairs of words, by far the most candidates, are counted, so that only one turn's part lies on the disks at a time.
TURNS = 8
#: Turns in which single words are counted.
WORD_TURNS = 4
#: Bytes of input, by the plan's estimate, that a task makes shards of: enough to fill shards of several languages.
TASK_BYTES = 64 << 20
PIECE_END = np.zeros(256, bool)
PIECE_END[[*b".,;:!?\n\x0b\x0c\r"]] = True
GAP = PIECE_END.copy()
GAP[[9, 32]] = True


def tokenised(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(different words, word numbers of all texts from 1 with a 0 before each piece), A-Z lower-cased."""
    data, offsets = utf8_bytes(texts)
    low = LOWER[data]
    inside = np.zeros(len(low) + 1, bool)
    inside[:-1] = ~GAP[low]
    cut = np.zeros(len(low) + 1, bool)
    cut[offsets] = True
    before = np.r_[False, inside[:-1]]
    starts, ends = np.flatnonzero(inside & (~before | cut)), np.flatnonzero(before & (~inside | cut))
    length = ends - starts
    bounds = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(low[ragged(starts, length)])).dictionary_encode()
    # Two words are of one piece if no end of a piece, nor of a text, lies between them.
    passed = np.cumsum(np.r_[False, PIECE_END[low]] | cut)
    piece = passed[starts] if len(starts) else np.zeros(0, np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = piece[1:] != piece[:-1]
    row = np.zeros(len(starts) + int(new.sum()), np.int32)
    row[np.arange(len(starts)) + np.cumsum(new)] = words.indices.to_numpy().astype(np.int32) + 1
    return words.dictionary, row


def transforms(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before each suffix, suffixes in the order of their first five words, of the row and of the reversed row. The row begins and ends with 0."""
    return _transform(row), _transform(row[::-1])


def _transform(row: np.ndarray) -> np.ndarray:
    first = row.astype(np.int64)
    moved = lambda x, by: np.concatenate([x[by:], np.zeros(min(by, len(x)), np.int64)])
    two = _ranked(first * (first.max(initial=0) + 1) + moved(first, 1))
    four = _ranked(two * (two.max(initial=0) + 1) + moved(two, 2))
    order = _sorted(four * (first.max(initial=0) + 1) + moved(first, 4))[0]
    return row[order - 1]


def _sorted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, keys in that order), on ties by place; sorting keys with their places in the low bits is quicker than ``argsort``."""
    bits = np.int64(len(keys)).item().bit_length()
    if int(keys.max(initial=0)) >> (63 - bits):
        order = np.argsort(keys, kind="stable")
        return order, keys[order]
    both = np.sort(keys << bits | np.arange(len(keys)))
    return both & ((1 << bits) - 1), both >> bits


def _ranked(keys: np.ndarray) -> np.ndarray:
    order, ordered = _sorted(keys)
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(np.r_[False, ordered[1:] != ordered[:-1]])
    return out


def planes(row: np.ndarray) -> bytes:
    """Whole numbers as all their lowest bytes, then all second ones and so on, which compresses better; before them a byte that tells how many planes there are."""
    width = max(1, -(-int(row.max(initial=0)).bit_length() // 8))
    return bytes([width]) + np.ascontiguousarray(row.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :width].T).tobytes()


def from_planes(data: pa.Buffer) -> np.ndarray:
    data = np.frombuffer(data, np.uint8)
    out = np.zeros(((len(data) - 1) // int(data[0]), 4), np.uint8)
    out[:, : data[0]] = data[1:].reshape(int(data[0]), -1).T
    return out.view("<i4").ravel()


def extend(transform: np.ndarray, lo: np.ndarray, other: np.ndarray, n: np.ndarray, phrase: np.ndarray, turn: int = 0, turns: int = 1) -> dict[str, np.ndarray]:
    """All extensions of the given phrases by the words that ``transform`` has in their intervals ``lo`` to ``lo + n``; of several turns, each extends the phrases that hash to it.

    Gives, by extension: ``at``, the interval's begin in this transform; ``other``, in the other
    one; ``n``; ``grown``, the phrase extended; ``met``, the given phrase that the extension has at
    its other end. Extensions of which that isn't among the given phrases are left out, as are
    those by the end of a piece.
    """
    order = np.argsort(lo)
    lo, other, n, phrase = lo[order], other[order], n[order], phrase[order]
    size = np.int64(len(transform))
    top = np.int64(transform.max(initial=0)) + 1
    now = np.flatnonzero(mix(phrase.astype(np.int64).view(np.uint64)) % np.uint64(turns) == turn)
    keys, counts = np.unique(np.repeat(np.arange(len(now)), n[now]) * top + transform[ragged(lo[now], n[now])], return_counts=True)
    which, word = keys // top, keys % top
    smaller = np.cumsum(counts) - counts
    smaller -= (np.cumsum(n[now]) - n[now])[which]
    which = now[which]
    # Occurrences of each word in order of place: how many precede an interval is a search in them.
    steps = np.sort(transform.astype(np.int64) * size + np.arange(size))
    at = np.searchsorted(steps, word * size + lo[which])
    holder = np.searchsorted(lo, at, side="right") - 1
    known = (word > 0) & (holder >= 0) & (at < lo[holder] + n[holder])
    which, holder = which[known], holder[known]
    return {"at": at[known], "other": other[which] + smaller[known], "n": counts[known], "grown": phrase[which], "met": phrase[holder]}


def _shards(docs: DataFrame, size: int) -> DataFrame:
    """(lang, text) as indexes: shard, lang, words with their counts and the begins of their intervals, n_words, forward, backward."""

    def close(lang: str, shard: int, parts: list[tuple[pa.Array, np.ndarray]]) -> pa.RecordBatch:
        every = pa.chunked_array([d for d, _ in parts]).combine_chunks().dictionary_encode()
        number = np.concatenate([[0], every.indices.to_numpy() + 1]).astype(np.int32)
        rows, at = [], 0
        for words, row in parts:
            rows.append(np.where(row > 0, number[np.where(row > 0, row + at, 0)], 0))
            at += len(words)
        row = np.concatenate([*rows, np.zeros(1, np.int32)]).astype(np.int32)
        counts = np.bincount(row, minlength=len(every.dictionary) + 1)
        # Frequent words get small numbers, which compress better.
        order = np.argsort(-counts[1:], kind="stable")
        number = np.zeros(len(counts), np.int32)
        number[1 + order] = np.arange(1, len(counts))
        row, counts = number[row], counts[np.r_[0, 1 + order]]
        forward, backward = transforms(row)
        return pa.RecordBatch.from_pydict(
            {
                "shard": pa.array([shard], pa.int32()),
                "lang": [lang],
                "words": pa.array([every.dictionary.take(pa.array(order)).to_pylist()], pa.list_(pa.string())),
                "counts": pa.array([counts[1:]], pa.list_(pa.int32())),
                "begins": pa.array([np.cumsum(counts)[:-1]], pa.list_(pa.int32())),
                "n_words": pa.array([len(row) - counts[0]], pa.int64()),
                "forward": pa.array([planes(forward)], pa.binary()),
                "backward": pa.array([planes(backward)], pa.binary()),
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() * SHARDS_A_TASK
        open_parts: dict[str, list] = {}
        held: dict[str, int] = {}
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                texts = batch.column(1).filter(pc.equal(langs.indices, k))
                each = max(1, -(-texts.nbytes // (4 << 20)))  # runs of some 4 MB
                for at in range(0, len(texts), step := max(1, -(-len(texts) // each))):
                    words, row = tokenised(texts.slice(at, step))
                    open_parts.setdefault(lang, []).append((words, row))
                    held[lang] = held.get(lang, 0) + len(row)
                    if held[lang] >= size:
                        yield close(lang, shard, open_parts.pop(lang))
                        held[lang] = 0
                        shard += 1
        for lang, parts in open_parts.items():
            yield close(lang, shard, parts)
            shard += 1

    return docs.mapInArrow(releasing(run), "shard int, lang string, words array<string>, counts array<int>, begins array<int>, n_words long, forward binary, backward binary")


#: Of phrases of a length: place (shard and begin of the interval in the forward transform), begin in the backward one, occurrences in the shard.
FOUND = "first long, last long, place long, back int, n int"


def _next(index: DataFrame, frequent: DataFrame, rightward: bool, turn: int = 0, turns: int = 1) -> DataFrame:
    """Phrases one word longer than the frequent ones: first and last (the phrases that they begin and end with), place, back, n. Of several turns, each gives the extensions of the phrases that hash to it."""

    def run(key: tuple, shard: pa.Table, given: pa.Table) -> pa.Table:
        if not shard.num_rows or not given.num_rows:
            return pa.table({c: pa.array([], t) for c, t in (("first", pa.int64()), ("last", pa.int64()), ("place", pa.int64()), ("back", pa.int32()), ("n", pa.int32()))})
        transform = from_planes(shard["index"][0].as_buffer())
        front, back, n, phrase = (given[c].to_numpy() for c in ("front", "back", "n", "phrase"))
        here, there = (back, front) if rightward else (front, back)
        x = extend(transform, here.astype(np.int64), there.astype(np.int64), n.astype(np.int64), phrase, turn, turns)
        front, back = (x["other"], x["at"]) if rightward else (x["at"], x["other"])
        first, last = (x["grown"], x["met"]) if rightward else (x["met"], x["grown"])
        place = np.int64(key[0].as_py()) << np.int64(32) | front
        return pa.table({"first": first, "last": last, "place": place, "back": back.astype(np.int32), "n": x["n"].astype(np.int32)})

    stored = index.select("shard", F.col("backward" if rightward else "forward").alias("index"))
    asked = frequent.select(F.shiftright("place", 32).cast("int").alias("shard"), F.col("place").bitwiseAND(0xFFFFFFFF).alias("front"), "back", "n", "phrase")
    return stored.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(run, FOUND)


def _frequent(found: DataFrame, keys: list[str], least: int) -> DataFrame:
    """The rows of phrases that have ``least`` occurrences in all shards together, with ``f``, their number, and ``phrase``, the first place. A phrase has one row a shard."""
    every = Window.partitionBy(*keys)
    return found.withColumns({"f": F.sum(F.col("n").cast("long")).over(every), "phrase": F.min("place").over(every)}).where(F.col("f") >= least)


def mine(docs: DataFrame, least: int = 100, most: int = 2_000, longest: int = DEPTH, text: str = "text", lang: str = "lang", shard_words: int = SHARD_WORDS) -> DataFrame:
    """The ``most`` best phrases of 2 to ``longest`` words of each language: lang, rank, phrase, a, l, r, n, score.

    A is lower-cased to Z; texts are split at sentence marks and line ends into pieces, and those at
    spaces and tabs into words; a phrase lies within a piece. ``a`` counts a phrase of ``least``
    occurrences or more, n all words of the language, l and r the two parts of the cut with the
    lowest floor(1000 * a * n / (l * r)), the score (the first such cut, on a tie). Phrases that
    always stand within one longer phrase are left out. Order is by score, then a, both descending,
    then by the phrase's bytes. Null languages are ``und``; null and empty texts have no words, so
    empty tables give no rows. Other columns take no part. A text is held in memory whole, and so is
    a shard of some two million words.
    """
    if not 2 <= longest <= DEPTH:
        raise ValueError(f"phrases have 2 to {DEPTH} words")
    spark = docs.sparkSession
    name, folder = f"phrases_{uuid.uuid4().hex}", f"{shared_folder(spark)}/phrases-{uuid.uuid4().hex}"
    wanted = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    size = int(str(wanted._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    buckets = max(1, min(wanted.rdd.getNumPartitions(), max(3 * spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES)), 20_000))
    wanted = wanted.coalesce(buckets)
    _shards(wanted, shard_words).write.option("path", folder).option("compression", "zstd").bucketBy(buckets, "shard").saveAsTable(name)
    with dropped(spark, name, folder), scratch(spark, "levels") as (keep, drop):
        index = spark.table(name)
        sums = durable(index.groupBy("lang").agg(F.sum("n_words").alias("all_words")))
        one = index.select("lang", "shard", F.explode(F.arrays_zip("words", "counts", "begins")).alias("x"))
        place = F.shiftleft(F.col("shard").cast("long"), 32) + F.col("x.begins")
        found = one.select("lang", F.col("x.words").alias("word"), place.alias("place"), F.col("x.begins").alias("back"), F.col("x.counts").alias("n"))
        words = _frequent(found, ["lang", "word"], least)
        level = keep(*(words.where(F.pmod(F.xxhash64("word"), F.lit(WORD_TURNS)) == turn) for turn in range(WORD_TURNS)))
        own = F.col("phrase") == F.col("place")
        known = keep(level.where(own).select("phrase", "lang", F.array("word").alias("words"), "f", F.array().cast("array<long>").alias("heads"), F.array().cast("array<long>").alias("tails")))
        out = []
        for length in range(2, longest + 1):
            turns = TURNS if length == 2 else 1
            shorter = level
            level = keep(*(_frequent(_next(index, shorter, length % 2 == 0, turn, turns), ["first", "last"], least) for turn in range(turns)))
            drop(shorter)
            longer = keep(_told(level.where(own), known))
            if length > 2:
                out.append(_open(known, longer))
            known = longer
        out.append(known)
        phrases = out[0]
        for more in out[1:]:
            phrases = phrases.unionByName(more)
        phrases = durable(phrases.drop("first", "last"))
    return _ranked_phrases(phrases.join(F.broadcast(sums), "lang"), most)  # one row a language


@contextmanager
def dropped(spark: SparkSession, table: str, folder: str) -> Iterator[None]:
    """At the end the table goes, and the folder of its files."""
    try:
        yield
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _told(found: DataFrame, shorter: DataFrame) -> DataFrame:
    """Phrases with their words, and the counts of all their beginnings and endings, shortest cut first."""
    a = shorter.select(F.col("phrase").alias("first"), "lang", F.col("words").alias("w"), F.col("f").alias("f_first"), "heads")
    b = shorter.select(F.col("phrase").alias("last"), F.element_at("words", -1).alias("word"), F.col("f").alias("f_last"), "tails")
    met = found.select("phrase", "first", "last", "f").join(a, "first").join(b, "last")
    return met.select("phrase", "first", "last", "lang", F.array_append("w", F.col("word")).alias("words"), "f", F.array_append("heads", F.col("f_first")).alias("heads"), F.array_prepend("tails", F.col("f_last")).alias("tails"))


def _open(phrases: DataFrame, longer: DataFrame) -> DataFrame:
    """Phrases that no phrase of one word more accompanies wherever they stand."""
    closing = longer.select(F.explode(F.array("first", "last")).alias("phrase"), "f").distinct()
    return phrases.join(closing, ["phrase", "f"], "left_anti")


def _ranked_phrases(phrases: DataFrame, most: int) -> DataFrame:
    # Counts of 18 digits and products of 38 hold any corpus.
    whole = "cast({} as decimal(18,0))".format
    score = f"({whole('f')} * {whole('all_words')} * 1000BD) div ({whole('c.heads')} * {whole('c.tails')})"
    cuts = F.expr(f"array_min(transform(arrays_zip(heads, tails), (c, k) -> struct({score} as score, k, c.heads as l, c.tails as r)))")
    best = phrases.select("lang", F.concat_ws(" ", "words").alias("phrase"), F.col("f").alias("a"), F.col("all_words").alias("n"), cuts.alias("x"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    flat = best.select("lang", "phrase", "a", F.col("x.l").alias("l"), F.col("x.r").alias("r"), "n", F.col("x.score").alias("score"))
    return flat.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
