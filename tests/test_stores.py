"""Versions, leases, the growing index and the vector store."""

from __future__ import annotations

import os
import threading

import pytest
from pyspark.sql import functions as F

from rankloom.operators import bm25
from rankloom.operators.segments import GrowingIndex
from rankloom.sources.vectors import VectorStore
from rankloom.sources.versions import Folder, Held, Lease, Lost


def test_of_two_runs_one_wins_and_a_stale_lease_is_taken_over(spark, tmp_path):
    now = [1000.0]
    folder = Folder(spark, f"{tmp_path}/run")
    lease = lambda who: Lease(folder, who, 60.0, lambda: now[0])
    first, second = lease("first").take(), lease("second")
    with pytest.raises(Held, match="first"):
        second.take()
    now[0] += 50
    first.renew()
    now[0] += 50
    with pytest.raises(Held):
        second.take()
    first.check()
    now[0] += 20
    second.take()
    assert second.fence == first.fence + 1
    for late in (first.check, first.renew):
        with pytest.raises(Lost):
            late()
    first.release()  # does nothing to what isn't its own
    second.check()
    second.release()
    third = lease("third").take()
    assert third.fence == 3
    now[0] += 61
    with pytest.raises(Lost):
        third.check()


def test_one_of_many_that_try_at_once_takes_the_lease(spark, tmp_path):
    folder, won = Folder(spark, f"{tmp_path}/run"), []

    def attempt(k):
        try:
            Lease(folder, f"w{k}").take()
            won.append(k)
        except Held:
            pass

    threads = [threading.Thread(target=attempt, args=(k,)) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1
    assert folder.create("x", {"a": 1}) and not folder.create("x", {"a": 2}) and folder.read("x") == {"a": 1}


def test_versions_are_made_once_and_half_written_ones_do_not_count(spark, tmp_path):
    folder = Folder(spark, f"{tmp_path}/v")
    assert folder.current() == (0, {})
    folder.commit(1, {"n": 1})
    folder.commit(2, {"n": 2})
    with pytest.raises(Lost):
        folder.commit(2, {"n": 3})
    with open(f"{tmp_path}/v/_versions/000000000003.json", "w") as f:
        f.write('{"n":')
    assert folder.current() == (2, {"n": 2})


DOCS = [(1, "vốn điều lệ của công ty"), (2, "thuế của công ty công ty"), (3, ""), (4, None), (5, "hợp đồng lao động"), (6, "thuế thuế vốn")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def same(a: bm25.Index, b: bm25.Index):
    assert sorted(map(tuple, a.postings.select("term", "doc_id", "tf", "dl").collect())) == sorted(map(tuple, b.postings.select("term", "doc_id", "tf", "dl").collect()))
    assert sorted(map(tuple, a.terms.collect())) == sorted(map(tuple, b.terms.collect()))
    assert tuple(a.stats.first()) == tuple(b.stats.first())


def test_an_index_that_grew_is_one_built_afresh(spark, tmp_path):
    index = GrowingIndex(spark, f"{tmp_path}/index")
    assert index.load().stats.first()["n"] == 0 and index.update() == 0
    index.update(frame(spark, DOCS[:3]))
    index.update(frame(spark, [(2, "lao động mới"), DOCS[3], DOCS[4]]), frame(spark, [(1, None), (5, None), (99, None)]))
    index.update(removed=frame(spark, [(3, None)]))
    index.update(frame(spark, [DOCS[5], (3, "công ty")]))
    final = frame(spark, [(2, "lao động mới"), DOCS[3], DOCS[4], DOCS[5], (3, "công ty")])
    same(index.load(expected=5), bm25.build(final))
    asked = spark.createDataFrame([(1, "công ty lao động thuế")], "qid long, query string")
    before = bm25.search(bm25.build(final), asked, 5).collect()
    assert bm25.search(index.load(), asked, 5).collect() == before
    index.compact()
    assert len(index.segments()) == 1
    same(index.load(), bm25.build(final))


def test_stale_and_torn_indexes_are_told_or_built_again(spark, tmp_path):
    index = GrowingIndex(spark, f"{tmp_path}/index")
    index.update(frame(spark, DOCS[:3]))
    with pytest.raises(ValueError, match="3 documents instead of 6"):
        index.load(expected=6)
    same(index.load(expected=6, docs=frame(spark, DOCS)), bm25.build(frame(spark, DOCS)))
    number = index.folder.current()[0]
    with pytest.raises(ValueError, match="repeat"):
        index.update(frame(spark, [(7, "a b"), (7, "c d")]))
    assert index.folder.current()[0] == number and index.problems() == []
    part = f"{tmp_path}/index/{index.segments()[0]['name']}/postings"
    for name in os.listdir(part):
        os.remove(f"{part}/{name}")
    assert index.problems()
    with pytest.raises(ValueError):
        index.load()
    same(index.load(docs=frame(spark, DOCS)), bm25.build(frame(spark, DOCS)))


def test_a_saved_index_of_another_size_is_refused(spark, tmp_path):
    bm25.build(frame(spark, DOCS)).save(str(tmp_path))
    assert bm25.Index.load(spark, str(tmp_path), expected=6).stats.first()["n"] == 6
    with pytest.raises(ValueError, match="6 documents"):
        bm25.Index.load(spark, str(tmp_path), expected=7)


def vectors(spark, rows):
    return spark.createDataFrame([(i, [float(x), 1.0], h, "b", "m") for i, x, h in rows], "id string, v array<double>, hash string, backend string, model string")


def held(store, version=None):
    return sorted((r["id"], r["v"][0], r["hash"]) for r in store.read(version).collect())


def test_vectors_change_by_bucket_and_old_versions_stay(spark, tmp_path):
    store = VectorStore(spark, f"{tmp_path}/v").create(2, "dot", buckets=4)
    first = store.upsert(vectors(spark, [(f"i{k}", k, "h") for k in range(20)]))
    files = dict(store.settings()["files"])
    assert len(held(store)) == 20 and store.settings()["count"] == 20
    assert store.upsert(vectors(spark, [("i3", 99, "h")])) == first  # the same hash, backend and model
    second = store.upsert(vectors(spark, [("i3", 99, "new"), ("i4", 4, "h")]))
    assert second == first + 1 and ("i3", 99.0, "new") in held(store) and ("i3", 3.0, "h") in held(store, first) and len(held(store)) == 20
    assert sum(files[b] != f for b, f in store.settings()["files"].items()) == 1
    third = store.remove(spark.createDataFrame([("i5",), ("nobody",)], "id string"))
    assert len(held(store)) == 19 and len(held(store, second)) == 20
    wanted = store.read().select("id", "hash")
    assert store.verify(wanted) == [] and store.verify(wanted.where("id <> 'i7'")) == ["19 vectors are stored, 18 are wanted"]
    assert store.verify(wanted.withColumn("hash", F.when(F.col("id") == "i1", "x").otherwise(F.col("hash")))) == ["1 vectors are missing or stale"]
    assert {r["id"] for r in store.stale(wanted.withColumn("backend", F.lit("b")).withColumn("model", F.when(F.col("id") == "i2", "other").otherwise("m"))).collect()} == {"i2"}
    store.vacuum(keep=1)
    assert len(held(store)) == 19 and store.folder.versions() == [third]
    with pytest.raises(ValueError):
        store.read(second)


@pytest.mark.parametrize("rows", [[("a", 1, "h"), ("a", 2, "h")], [("a", float("nan"), "h")], [("a", 1, None)], [(None, 1, "h")]])
def test_failed_updates_leave_the_old_version_readable(spark, tmp_path, rows):
    store = VectorStore(spark, f"{tmp_path}/v").create(2, buckets=3)
    store.upsert(vectors(spark, [("x", 1, "h"), ("y", 2, "h")]))
    with pytest.raises(ValueError):
        store.upsert(vectors(spark, [("x", 5, "new"), *rows]))
    assert held(store) == [("x", 1.0, "h"), ("y", 2.0, "h")]


def test_an_update_that_was_not_written_whole_is_not_committed(spark, tmp_path, monkeypatch):
    store = VectorStore(spark, f"{tmp_path}/v").create(2, buckets=3)
    store.upsert(vectors(spark, [("x", 1, "h")]))
    whole = VectorStore._rows

    def torn(self, version, only=None):
        rows = whole(self, version, only)
        return rows.where("hash <> 'new'")  # what was written isn't found when it is read again

    monkeypatch.setattr(VectorStore, "_rows", torn)
    with pytest.raises(RuntimeError, match="fresh vectors are missing"):
        store.upsert(vectors(spark, [("x", 5, "new")]))
    monkeypatch.undo()
    assert held(store) == [("x", 1.0, "h")] and store.upsert(vectors(spark, [("x", 5, "new")])) and held(store) == [("x", 5.0, "new")]


def test_stores_are_created_once_for_one_size_and_distance(spark, tmp_path):
    store = VectorStore(spark, f"{tmp_path}/v")
    with pytest.raises(ValueError, match="no vector store"):
        store.read()
    store.create(2, "dot")
    store.upsert(vectors(spark, [("x", 1, "h")]))
    assert held(store.create(2, "dot")) == [("x", 1.0, "h")]
    for dim, distance in ((3, "dot"), (2, "cosine"), (2, "hamming")):
        with pytest.raises(ValueError):
            store.create(dim, distance)
    assert held(store.create(3, "cosine", force=True)) == [] and store.settings()["dim"] == 3
    with pytest.raises(Held):
        Lease(store.folder, "other").take()
        store.upsert(vectors(spark, [("x", 1, "h")]))
