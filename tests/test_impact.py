"""Search from impact-ordered blocks: the rows of the plain search, from fewer blocks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from rankloom.operators import bm25, impact


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    rare = [f"rare{k}" for k in range(60)]
    rows = [(k, " ".join(rng.choices(["common", "often", "sometimes", *rare], [30, 12, 4, *[1] * 60], k=rng.randrange(0, 40)))) for k in range(1500)]
    rows += [(5000 + k, "common common rare1") for k in range(40)] + [(6000, None), (6001, "")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def rows_of(df):
    return sorted(map(tuple, df.select("qid", "doc_id", "score", "rank").collect()))


QUERIES = ["common", "common rare1", "rare2 rare3 often", "common common often sometimes rare4", "rare5", "unknown", "", None, "unknown rare6 common", "common often sometimes"]


@pytest.mark.parametrize(("size", "k"), [(16, 5), (64, 10), (4096, 10), (16, 5000)])
def test_rows_equal_those_of_the_plain_search(spark, corpus, size, k):
    asked = spark.createDataFrame(list(enumerate(QUERIES)), "qid long, query string")
    index = bm25.build(corpus)
    found = impact.search(impact.blocks(index, size=size), asked, k)
    assert rows_of(found.hits) == rows_of(bm25.search(index, asked, k))
    reads = {r["qid"]: (r["read"], r["blocks"]) for r in found.reads.collect()}
    assert set(reads) == {0, 1, 2, 3, 4, 8, 9}
    if (size, k) == (16, 5):
        assert reads[1][0] < reads[1][1] / 4 and reads[8][0] < reads[8][1] / 4 and sum(r for r, _ in reads.values()) < sum(n for _, n in reads.values()) / 2
    if k == 5000:
        assert all(r == n for r, n in reads.values())


def test_blocks_are_of_bounded_size_whatever_the_word(spark, corpus, tmp_path):
    index = bm25.build(corpus)
    made = impact.blocks(index, levels=4, size=32)
    assert made.heads.agg(F.max("n")).first()[0] < 3 * 32 and made.heads.agg(F.sum("n")).first()[0] == index.postings.count()
    made.save(str(tmp_path))
    again = impact.Blocks.load(spark, str(tmp_path))
    asked = spark.createDataFrame([(1, "i", "common rare7")], "qid long, intent string, query string")
    assert impact.search(again, asked, 3, ("qid", "intent")).hits.collect() == impact.search(made, asked, 3, ("qid", "intent")).hits.collect()
    none = impact.blocks(bm25.build(spark.createDataFrame([], "doc_id long, text string")))
    assert impact.search(none, asked, 3).hits.collect() == []
