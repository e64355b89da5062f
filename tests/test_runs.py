"""Ordered result files, snapshots and comparisons of runs."""

from __future__ import annotations

import json
import os
import zipfile

import pytest

from rankloom.plans import snapshots
from rankloom.sources import results, tables


def rows_of(spark, n):
    """Questions whose order is neither that of ids nor that of their text."""
    return spark.createDataFrame([(k, str((k * 37) % n), f"câu \"hỏi\"\n{k}", None if k == 3 else "Điều 1", [], ["l|n|Điều 1"]) for k in range(n)], "position long, id string, question string, answer string, relevant_docs array<string>, relevant_articles array<string>").repartition(7)


@pytest.mark.parametrize("n", [0, 1, 200])
def test_results_keep_the_questions_order(spark, tmp_path, n):
    path = results.write_results(rows_of(spark, n), str(tmp_path))
    found = json.loads(zipfile.ZipFile(path).read("results.json"))
    assert [r["id"] for r in found] == [str((k * 37) % n) for k in range(n)] and [list(r) for r in found[:1]] == [list(results.FIELDS)] * min(n, 1)
    assert found == json.load(open(f"{tmp_path}/results.json")) and sorted(x for x in os.listdir(tmp_path) if not x.startswith(".")) == ["results.json", "results.zip"]
    assert list(results.rows_of_zip(path)) == found
    wanted = [str((k * 37) % n) for k in range(n)]
    assert results.zip_problems(path, wanted) == (["row 4: no answer"] if n > 3 else [])
    if n > 3:
        assert "instead of" in results.zip_problems(path, wanted[::-1])[-1] and "ends before id x" in results.zip_problems(path, [*wanted, "x"])[-1]
        results.write_results(rows_of(spark, 2), str(tmp_path))
        assert len(json.load(open(f"{tmp_path}/results.json"))) == 2


def test_zips_that_are_torn_or_hold_more(tmp_path):
    def made(**entries):
        path = f"{tmp_path}/{len(os.listdir(tmp_path))}.zip"
        with zipfile.ZipFile(path, "w") as z:
            for name, text in entries.items():
                z.writestr(name.replace("_", "."), text)
        return path

    assert results.zip_problems(made(results_json="[]\n", other="")) == ["unexpected entries ['results.json', 'other']"]
    assert "isn't whole" in results.zip_problems(made(results_json='[{"id":1}\n'))[-1]
    assert "isn't a list" in results.zip_problems(made(results_json='{"id":1}\n'))[-1]
    assert results.zip_problems(made(results_json="[]\n")) == []


def test_order_of_a_file_of_questions(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"id": i, "question": f"q{i}"} for i in ("9", "10", "2")]))
    asked = tables.in_order(tables.read_questions(spark, str(tmp_path / "q.json"))).withColumnRenamed("id", "qid")
    items = spark.createDataFrame([("2", "l|n|Điều 1", 1)], "qid string, article string, position int")
    path = results.write_results(results.result_rows(items, asked), str(tmp_path / "out"))
    assert [r["id"] for r in results.rows_of_zip(path)] == ["9", "10", "2"]


def test_snapshots_of_a_phase(spark, tmp_path):
    asked = spark.createDataFrame([(1, "a"), (2, "b")], "qid long, question string")
    lists = [(1, 0, ["l|n|A", "l|n|D", ""]), (1, 1, ["m|n|D", "l|n|A", "l|n|E"]), (2, 0, ["x|n|B"])]
    rankings = spark.createDataFrame([(q, i, a, k + 1) for q, i, found in lists for k, a in enumerate(found)], "qid long, intent_index int, article string, rank int")
    rows = {r["id"]: r for r in snapshots.snapshot(asked, rankings, 3).collect()}
    assert rows[1]["relevant_articles"] == ["l|n|A", "m|n|D", "l|n|D", "l|n|E"] and rows[1]["relevant_docs"] == ["l|n", "m|n"] and rows[1]["answer"] == ""
    assert [len(r["relevant_articles"]) for r in snapshots.snapshot(asked, rankings, 1).orderBy("id").collect()] == [2, 1]
    path = snapshots.write_snapshot(snapshots.snapshot(asked, rankings, 3), str(tmp_path), "intents")
    assert results.zip_problems(path, [1, 2]) == []
    assert tuple(spark.read.json(f"{tmp_path}/summary").select("phase", "questions", "least", "most", "mean").first()) == ("intents", 2, 1, 4, 2.5)
    with pytest.raises(Exception, match="question 2"):
        snapshots.snapshot(asked, rankings.where("qid = 1"), 3).collect()
    cache = spark.createDataFrame([(1, 0, [("old",)], 1), (1, 0, [("l|n|A",), ("l|n|C",)], 2), (2, 0, [], 1)], "qid long, intent_index int, ranked_articles array<struct<article:string>>, at long")
    assert sorted(map(tuple, snapshots.ranked_replies(cache).collect())) == [(1, 0, "l|n|A", 1), (1, 0, "l|n|C", 2)]


def test_two_runs_side_by_side(spark):
    probe = lambda rows: spark.createDataFrame(rows, "qid long, top1 double")
    old = probe([(k, float(k)) for k in range(11)])
    assert snapshots.threshold(old).first()["line"] == 1.0 and snapshots.threshold(probe([])).first()["line"] == 0.0
    new = probe([(0, 0.5), (1, 9.0), (2, 1.0), (3, 3.0), (99, 0.1)])
    told = {r["qid"]: (r["old_gap"], r["new_gap"], r["change"]) for r in snapshots.compared_probes(old, new).collect()}
    assert told[0] == (True, True, "both") and told[1] == (True, False, "closed") and told[2] == (False, True, "opened") and told[3] == (False, False, "none")
    assert told[99] == (None, True, None) and told[10] == (False, None, None)
    runs = lambda rows: spark.createDataFrame(rows, "qid long, doc_id long, rank int")
    rows = {r["qid"]: tuple(r)[1:] for r in snapshots.compared_runs(runs([(1, 5, 1), (1, 6, 2), (1, 7, 3), (2, 5, 1)]), runs([(1, 6, 1), (1, 8, 2), (1, 7, 9), (3, 1, 1)]), ["qid"], "doc_id").collect()}
    assert rows == {1: (2, 1, 1, False, 6), 2: (0, 1, 0, False, 0), 3: (0, 0, 1, False, 0)}
