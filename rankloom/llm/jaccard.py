"""N-gram Jaccard self-join by vertical partitioning of the global n-gram order.

Texts become sets of hashed word n-grams. One order of all n-grams, rare ones first, is fixed from
counts over the whole corpus, and cut into fragments of about equal weight. Texts with equal sets
are one node. Nodes that share an n-gram of their prefixes (the first n-grams in the order, as
many as two linked sets can't both avoid) are candidates. To measure a pair, each node's set falls
into one segment a fragment, overlaps of segments are counted for each fragment by itself, and the
partial counts are summed per pair.

Groups of near copies would have a square number of pairs, of which components need few. So
candidates come in two steps. In the first, each prefix n-gram offers two pivots: the node with
most n-grams behind it, and the one with fewest before it. A node is measured against the few
pivots that it can share most with, so there are as few pairs a node, and the links join nodes to
components. What is then left are pairs of different components. Two bounds on what a pair can
share discard most of them before a set is fetched: the places of the shared n-gram, and sketches
of parity bits, in which sets that differ in d n-grams differ in d bits at most. Both bounds are
exact in that no link is lost.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow import map_columns, ragged, releasing, utf8_bytes
from .components import components
from .shared import durable, fresh, scratch
from .words import mix, word_hashes, word_spans

#: Buckets of the counts that order n-grams; their ranks are broadcast, 2 bytes each.
BUCKET_BITS = 22
#: Fragments of the global order.
FRAGMENTS = 4
#: 64-bit words of a set's sketch.
SKETCH = [f"s{k}" for k in range(8)]


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct n-grams of each text, sorted by both; a text with fewer words has all its words as one."""
    data, offsets = utf8_bytes(texts)
    text, starts, ends = word_spans(data, offsets)
    hashes = word_hashes(data, starts, ends)
    counts = np.bincount(text, minlength=len(texts))
    out = np.zeros(len(hashes), np.uint64)
    for k in range(words):  # each place of an n-gram has a multiplier of its own
        out[: max(0, len(hashes) - k)] += mix(hashes[k:] + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1))
    place = np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts)
    full = place + words <= counts[text]
    short = np.flatnonzero((counts > 0) & (counts < words))
    grams, owner = [mix(out[full])], [text[full]]
    if len(short):
        first = (np.cumsum(counts) - counts)[short]
        whole = np.zeros(len(short), np.uint64)
        for k in range(words - 1):
            has = counts[short] > k
            whole[has] += mix(hashes[first[has] + k] + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1))
        grams.append(mix(whole + counts[short].astype(np.uint64) + np.uint64(77)))
        owner.append(short)
    owner, grams = np.concatenate(owner), np.concatenate(grams)
    order = np.argsort(grams)
    order = order[np.argsort(owner[order].astype(np.uint16 if len(texts) < 1 << 16 else np.int64), kind="stable")]
    owner, grams = owner[order], grams[order]
    keep = np.ones(len(owner), bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (grams[1:] != grams[:-1])
    return owner[keep], grams[keep]


def signatures(owner: np.ndarray, grams: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(size, 64-bit signature) of each of n sets; equal sets have equal ones, an empty set has 0."""
    sizes = np.bincount(owner, minlength=n)
    sums = np.zeros((2, n), np.uint64)
    filled = sizes > 0
    if len(owner):
        first = (np.cumsum(sizes) - sizes)[filled]
        sums[0, filled] = np.add.reduceat(grams, first)
        sums[1, filled] = np.add.reduceat(mix(grams ^ np.uint64(0x5851F42D4C957F2D)), first)
    return sizes, np.where(filled, mix(sums[0] ^ mix(sums[1] + sizes.astype(np.uint64))), 0).astype(np.int64)


def prefix_length(sizes: np.ndarray, percent: int) -> np.ndarray:
    """N-grams of a set, first in the order, that two linked sets can't both avoid sharing."""
    return sizes - -(-percent * sizes // 100) + 1


def sketches(owner: np.ndarray, grams: np.ndarray, n: int) -> np.ndarray:
    """Parity bits of each of n sets: bit h is set if an odd number of n-grams fall on it; one row of 64-bit words a set."""
    bits = 64 * len(SKETCH)
    counts = np.bincount(owner * bits + (grams & np.uint64(bits - 1)).astype(np.int64), minlength=n * bits)
    return np.packbits((counts & 1).astype(np.uint8).reshape(n, bits), axis=1).view("<i8") if n else np.zeros((0, len(SKETCH)), np.int64)


#: Buckets whose counts travel together, and tasks whose counts meet first.
BLOCK, TOGETHER = 1 << 14, 256


def sign_and_count(docs: DataFrame, words: int) -> DataFrame:
    """One pass over (id, key, text): per text (id, key, n, node, sketch), and per task rows (block, counts) of how many of its sets hold an n-gram of each bucket of hashes.

    Null and empty texts have n 0 and node 0. An empty table gives no rows of texts.
    """
    size = 1 << BUCKET_BITS
    names = ["id", "key", "n", "node", *SKETCH]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int32)
        for batch in batches:
            step = max(1, batch.num_rows // max(1, batch.nbytes >> 22))
            for at in range(0, batch.num_rows, step):
                ids, keys, texts = batch.slice(at, step).columns
                owner, grams = shingle_sets(texts, words)
                np.add.at(total, bucket_of(grams), np.int32(1))
                sizes, marks = signatures(owner, grams, len(texts))
                bits = sketches(owner, grams, len(texts))
                columns = [ids, keys, pa.array(sizes.astype(np.int64)), pa.array(marks), *(pa.array(np.ascontiguousarray(bits[:, k])) for k in range(len(SKETCH)))]
                yield pa.record_batch([*columns, pa.nulls(len(ids), pa.int32()), pa.nulls(len(ids), pa.binary())], names=[*names, "block", "counts"])
        blocks = [b for b in range(size // BLOCK) if total[b * BLOCK : (b + 1) * BLOCK].any()]
        packed = [zlib.compress(total[b * BLOCK : (b + 1) * BLOCK].astype("<i4").tobytes(), 1) for b in blocks]
        yield pa.record_batch([*(pa.nulls(len(blocks), pa.int64()) for _ in names), pa.array(blocks, pa.int32()), pa.array(packed, pa.binary())], names=[*names, "block", "counts"])

    return docs.mapInArrow(releasing(run), ", ".join(f"{c} long" for c in names) + ", block int, counts binary")


def merged(parts: DataFrame, kind: str, length: int, merge: np.ufunc) -> DataFrame:
    """Rows (block, counts) of compressed arrays as one row a block, merged in two steps: a group holds the arrays of some tasks, never of all."""

    def add(key: tuple, group: pa.Table) -> pa.Table:
        total = np.zeros(length, kind)
        for x in group["counts"]:
            merge(total, np.frombuffer(zlib.decompress(x.as_py()), kind), out=total)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    some = parts.select("block", "counts", (F.spark_partition_id() / F.lit(TOGETHER)).cast("int").alias("_tasks"))
    some = some.groupBy("block", "_tasks").applyInArrow(add, "block int, counts binary")
    return some.groupBy("block").applyInArrow(add, "block int, counts binary")


def bucket_ranks(counted: DataFrame) -> np.ndarray:
    """The sums of all tasks' counts as 16-bit ranks, 1000 for each doubling; 8 MB at any size of the corpus."""
    out = np.zeros(1 << BUCKET_BITS, np.uint16)
    for row in merged(counted.where("block is not null"), "<i4", BLOCK, lambda a, b, out: np.minimum(a.astype(np.int64) + b, 2**31 - 1, out=out, casting="unsafe")).toLocalIterator():
        out[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = np.round(1000 * np.log2(1.0 + np.frombuffer(zlib.decompress(row["counts"]), "<i4")))
    return out


def bucket_of(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def in_order(owner: np.ndarray, grams: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sets with their n-grams in the global order: rare buckets first, then by hash."""
    order = np.argsort(ranks[bucket_of(grams)], kind="stable")  # ties stay in order of hash
    order = order[np.argsort(owner[order].astype(np.uint16 if len(owner) and owner[-1] < 1 << 16 else np.int64), kind="stable")]
    return owner[order], grams[order]


def cuts_of(ranks: np.ndarray) -> np.ndarray:
    """Where the global order is cut: fragments of about equal numbers of n-grams, each cut as rank and bucket in one number."""
    order = np.argsort(ranks, kind="stable")
    weight = np.cumsum(np.exp2(ranks[order] / 1000.0) - 1)
    at = np.searchsorted(weight, weight[-1] * np.arange(1, FRAGMENTS) / FRAGMENTS)
    at = order[np.minimum(at, len(order) - 1)]
    return ranks[at].astype(np.int64) << BUCKET_BITS | at


def fragment_of(grams: np.ndarray, ranks: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The fragment of the global order that each n-gram falls into."""
    bucket = bucket_of(grams)
    return np.searchsorted(cuts, ranks[bucket].astype(np.int64) << BUCKET_BITS | bucket, side="left").astype(np.int32)


#: Bits of the filter that names the texts to cut, 2 MB in all, and bytes that travel together.
FILTER_BITS, PART = 24, 1 << 17


def row_filter(ids: DataFrame) -> np.ndarray:
    """A bit for each hash of ``ids`` (id), as packed bytes of one size whatever their number."""
    whole = 1 << FILTER_BITS - 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(whole * 8, bool)
        for batch in batches:
            bits[_bit(batch.column(0).to_numpy())] = True
        parts = np.packbits(bits).reshape(-1, PART)
        some = np.flatnonzero(parts.any(1))
        yield pa.record_batch({"block": pa.array(some.astype(np.int32)), "counts": pa.array([zlib.compress(parts[k].tobytes(), 1) for k in some], pa.binary())})

    out = np.zeros(whole, np.uint8)
    for row in merged(ids.mapInArrow(releasing(run), "block int, counts binary"), "u1", PART, np.bitwise_or).toLocalIterator():
        out[row["block"] * PART : (row["block"] + 1) * PART] = np.frombuffer(zlib.decompress(row["counts"]), np.uint8)
    return out


def _bit(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def segments_of(docs: DataFrame, wanted: np.ndarray, words: int, ranks: np.ndarray) -> DataFrame:
    """(node, fragment, grams) of the texts of (id, key, text) whose id the filter holds; others may slip in, none is left out.

    Texts stay where they are: the filter goes to them.
    """
    cuts = cuts_of(ranks)

    def cut(ids: pa.Array, texts: pa.Array) -> dict:
        at = _bit(ids.to_numpy())
        held = np.flatnonzero(wanted[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1)
        texts = texts.take(pa.array(held))
        owner, grams = shingle_sets(texts, words)
        _, marks = signatures(owner, grams, len(texts))
        parts = fragment_of(grams, ranks, cuts)
        order = np.lexsort((parts, owner))
        owner, grams, parts = owner[order], grams[order].view(np.int64), parts[order]
        first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (parts[1:] != parts[:-1])]) if len(owner) else np.zeros(0, np.int64)
        ends = np.r_[first, len(owner)].astype(np.int32)
        return {"node": marks[owner[first]], "fragment": parts[first], "grams": pa.ListArray.from_arrays(pa.array(ends), pa.array(grams))}

    return map_columns(docs.select("id", "text"), cut, "node long, fragment int, grams array<long>")


def may_link(a: str, b: str, percent: int) -> Column:
    """Whether the sketches of two sets allow a link: sets of n_a and n_b n-grams that share s differ in n_a + n_b - 2 s, and their parity bits in no more."""
    apart = sum((F.bit_count(F.col(f"{c}{a}").bitwiseXOR(F.col(f"{c}{b}"))) for c in SKETCH), F.lit(0))
    return (F.col(f"n{a}") + F.col(f"n{b}") - apart) * (100 + percent) >= 2 * percent * (F.col(f"n{a}") + F.col(f"n{b}"))


def measure(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, percent: int, ranks: np.ndarray) -> DataFrame:
    """Those of the distinct ``pairs`` (a, b: nodes, n_a, n_b: sizes) that are linked, by overlaps of each fragment counted by itself and summed per pair.

    ``nodes`` has the id of one text of each node; only these of ``docs`` are cut into segments.
    No pairs give no links.
    """

    def segments(side: str) -> DataFrame:
        """Segments of the nodes on one side; of stars, one side has few."""
        ids = nodes.join(pairs.select(F.col(side).alias("node")).distinct(), "node", "left_semi").select("id")
        return segments_of(docs, row_filter(ids), words, ranks).toDF(side, "fragment", f"grams_{side}")

    # A fragment that one of them has nothing in adds nothing, so it needs no row.
    partial = pairs.join(segments("a"), "a").join(segments("b"), ["b", "fragment"]).select("a", "b", "n_a", "n_b", "fragment", F.size(F.array_intersect("grams_a", "grams_b")).alias("shared"))
    # A segment that copies have left twice counts once.
    whole = partial.groupBy("a", "b", "n_a", "n_b", "fragment").agg(F.max("shared").alias("shared")).groupBy("a", "b", "n_a", "n_b").agg(F.sum("shared").alias("shared"))
    return whole.where(F.col("shared") * (100 + percent) >= percent * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def _linked(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Per row of (id, key, text): id, key, n, and the node that names its component."""
    with scratch(docs.sparkSession, "links") as (keep, drop):
        return _linked_in(keep, drop, docs, words, percent)


def _linked_in(keep: Callable[[DataFrame], DataFrame], drop: Callable[[DataFrame], None], docs: DataFrame, words: int, percent: int) -> DataFrame:
    both = keep(sign_and_count(docs, words))
    told = both.where("block is null")
    signed, ranks = durable(told.select("id", "key", "n", "node")), bucket_ranks(both)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # of equal texts, a task tells one
        for batch in batches:
            step = max(1, batch.num_rows // max(1, batch.nbytes >> 22))
            for at in range(0, batch.num_rows, step):
                texts = batch.column(0).slice(at, step)
                owner, grams = shingle_sets(texts, words)
                sizes, marks = signatures(owner, grams, len(texts))
                first = np.zeros(len(texts), bool)
                first[np.unique(marks, return_index=True)[1]] = True
                new = first & np.array([m not in done for m in marks.tolist()], bool)
                done = set() if len(done) > 1 << 18 else done
                done.update(marks[new].tolist())
                owner, grams = in_order(owner, grams, ranks)
                taken = np.where((sizes > 0) & new, prefix_length(sizes, percent), 0)
                ends = np.cumsum(sizes)
                where = ragged(ends - sizes, taken)
                places = where - np.repeat(ends - sizes, taken) + 1
                # A bucket that was counted once holds an n-gram of one text, which nobody shares.
                common = ranks[bucket_of(grams[where])] > 1000
                where, places = where[common], places[common]
                yield pa.record_batch({"gram": pa.array(grams[where].view(np.int64)), "node": pa.array(marks[owner[where]]), "n": pa.array(sizes[owner[where]].astype(np.int32)), "place": pa.array(places.astype(np.int32))})

    # A prefix n-gram matters only if two nodes have it. Both sides of the join need all columns, so
    # they read one shuffle; a semi-join would be pushed below it.
    held = docs.select("text").mapInArrow(releasing(prefixes), "gram long, node long, n int, place int").repartition("gram")
    shared = held.groupBy("gram").agg(F.max("node").alias("high"), F.min("node").alias("low"), F.max("n").alias("n"), F.max("place").alias("place")).where("high <> low and n > 0 and place > 0").select("gram")
    rows = keep(held.join(shared, "gram").select("gram", "node", "n", "place").distinct())
    nodes = told.where("n > 0").groupBy("node").agg(F.min("id").alias("id"), F.min("n").alias("n"), *(F.min(c).alias(c) for c in SKETCH))
    nodes = keep(nodes.join(rows.select("node").distinct(), "node", "left_semi"))
    drop(both)

    # The first n-gram that linked sets share has room behind it for all that they must share.
    def room(a: str, b: str, n_a: str, n_b: str) -> Column:
        return (1 + F.least(F.col(n_a) - F.col(a), F.col(n_b) - F.col(b))) * (100 + percent) >= percent * (F.col(n_a) + F.col(n_b))

    def side(name: str) -> DataFrame:
        return nodes.select(F.col("node").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in ("n", *SKETCH)))

    def stars() -> DataFrame:
        """Three pairs a node at most: with the pivots that it may link with, of the three that it shares most prefix n-grams with."""
        most = F.max(F.struct((F.col("n") - F.col("place")).alias("behind"), "node", "n", "place"))
        least = F.min(F.struct("place", "n", "node"))
        of = lambda x: F.struct(f"{x}.node", f"{x}.n", f"{x}.place")
        picked = rows.groupBy("gram").agg(most.alias("most"), least.alias("least")).select("gram", F.array_distinct(F.array(of("most"), of("least"))).alias("pivots"))
        offers = rows.join(picked, "gram").select("node", "n", "place", F.explode("pivots").alias("pivot"))
        offers = offers.where((F.col("node") != F.col("pivot.node")) & room("pivot.place", "place", "pivot.n", "n"))
        offers = offers.groupBy(F.col("node").alias("b"), F.col("pivot.node").alias("a")).agg(F.count("*").alias("grams"))
        nth = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("grams"), "a"))
        able = offers.withColumn("nth", nth).where("nth <= 3").join(side("b"), "b").join(side("a"), "a").where(may_link("_a", "_b", percent))
        # Of two nodes that are each other's pivots, one tells.
        pairs = able.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("n_a")).otherwise(F.col("n_b")).alias("n_a"), F.when(F.col("a") < F.col("b"), F.col("n_b")).otherwise(F.col("n_a")).alias("n_b"))
        return durable(pairs.select("a", "b", "n_a", "n_b").distinct())

    def rooted(roots: DataFrame) -> DataFrame:
        """Rows whose n-gram different components share, with their roots."""
        named = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).repartition("gram")
        mixed = named.groupBy("gram").agg(F.max("root").alias("high"), F.min("root").alias("low"), *(F.max(c).alias(f"most_{c}") for c in ("node", "n", "place")))
        return keep(named.join(mixed.where("high <> low and most_node is not null and most_n > 0 and most_place > 0").select("gram"), "gram"))

    roots = components(measure(stars(), docs, nodes, words, percent, ranks))
    tied = lambda roots: roots.select(F.col("node").alias("a"), F.col("root").alias("b"))

    # What the stars left open. The smaller set needs only its indexing prefix here; that is asked
    # of the pair, not of the side, so both sides read one shuffle.
    open_rows = rooted(roots)
    drop(rows)
    named = open_rows.drop("n").join(nodes.select("node", "n", *SKETCH), "node").repartition("gram")
    left, right = (named.toDF(*(f"{c}_{x}" for c in named.columns)) for x in "ab")
    smaller = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("node_a") < F.col("node_b")))
    indexed = (F.col("n_a") - F.col("place_a") + 1) * (100 + percent) >= percent * (F.col("n_a") + F.least("n_a", "n_b"))
    fits = (F.col("gram_a") == F.col("gram_b")) & (F.col("root_a") != F.col("root_b")) & smaller & indexed & room("place_a", "place_b", "n_a", "n_b") & may_link("_a", "_b", percent)
    open_pairs = durable(left.join(right, fits).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), "n_a", "n_b").distinct())
    if not open_pairs.isEmpty():
        roots = components(tied(roots).union(measure(open_pairs, docs, nodes, words, percent, ranks)))
    return signed.select("id", "key", "n", "node").join(roots, "node", "left").select("id", "key", "n", F.coalesce("root", "node").alias("root"))


def link(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_shingles`` (set size), ``component_id`` (least id that links reach, itself included).

    A-Z count as a-z; words are runs without space or tab..carriage return; n-grams are ``words``
    words in a row. Two texts link when 100 * intersection >= ``percent`` * union. Null and empty
    texts have empty sets and link with nothing. Rows without id link with nothing and have no
    component. Repeated rows are a row each; of repeated ids, each row counts with its own text.
    N-grams and sets are told apart by 64-bit hashes. Other columns are ignored. An empty table
    gives no rows. The id must be a whole number.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.lit(0).cast("long").alias("key"), F.col(text_col).alias("text"))
    linked = _linked(plain.where("id is not null"), words, percent)
    # One row a component is all that is joined back; the least id is found before rows meet.
    least = linked.where("n > 0").groupBy("root").agg(F.min("id").alias("component_id"))
    out = linked.join(least, "root", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    alone = map_columns(plain.where("id is null").select("text"), lambda texts: {"n": np.bincount(shingle_sets(texts, words)[0], minlength=len(texts)).astype(np.int64)}, "n long")
    none = F.lit(None).cast("long")
    return out.union(alone.select(none, "n", none))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is the first of its component, by id and then by a hash of the text; others go.

    Rows are told apart by id and text, so ids may repeat. Of rows that repeat both, one stays.
    Rows without id come last of their component. Null and empty texts all stay. Other columns stay
    as they are, whatever their names. An empty table gives no rows.
    """
    number, key = fresh(docs.columns, "number", "key")
    marked = docs.withColumn(number, F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1))).withColumn(key, F.xxhash64(F.col(text_col)))
    linked = _linked(marked.select(F.col(number).alias("id"), F.col(key).alias("key"), F.col(text_col).alias("text")), words, percent)
    first = linked.where("n > 0").groupBy("root").agg(F.min(F.struct("id", "key")).alias("first")).select(F.col("first.id").alias(number), F.col("first.key").alias(key))
    kept = marked.join(first, [number, key], "left_semi").dropDuplicates([number, key])
    wordless = marked.where(~F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return kept.select(*docs.columns).union(wordless.select(*docs.columns))
