"""Readers, writers, workflow and stream on small files."""

from __future__ import annotations

import json
import zipfile

import pytest

from rankloom.operators import bm25
from rankloom.plans import retrieve, stages
from rankloom.sources import jsonl, results, settings, tables
from rankloom.streaming import questions as stream


def test_jsonl_is_tolerant_and_the_last_line_wins(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"id": "1", "v": 1}\n\nbroken {\n[1]\n{"id": "1", "v": 2}\n{"v": 3}\n{"id": "2", "v": null}\n', encoding="utf-8")
    rows = jsonl.read(spark, str(tmp_path / "log.jsonl"), "id string, v int", ["id", "v"], ["id"])
    assert [(r["id"], r["v"]) for r in rows.collect()] == [("1", 2)]
    left = jsonl.todo(spark.createDataFrame([("1",), ("2",)], "id string"), rows, ["id"])
    assert [r["id"] for r in left.collect()] == ["2"]


@pytest.mark.parametrize("shape", ["object", "list"])
def test_corpus_as_object_or_list(spark, tmp_path, shape):
    articles = [{"chunk_id": "a", "law_id": "1/2020/QH", "content": "x", "khoan_list": [{"id": "1", "text": "t"}]}, {"chunk_id": "b"}]
    (tmp_path / "c.json").write_text(json.dumps({"version": "2.0", "articles": articles} if shape == "object" else articles), encoding="utf-8")
    rows = tables.read_corpus(spark, str(tmp_path / "c.json")).orderBy("chunk_id").collect()
    assert [r["chunk_id"] for r in rows] == ["a", "b"] and rows[0]["khoan_list"][0]["text"] == "t"


def test_questions_are_checked(spark, tmp_path):
    write = lambda rows: (tmp_path / "q.json").write_text(json.dumps(rows), encoding="utf-8")
    write([{"id": 1, "question": "a"}, {"id": 2, "question": "b"}])
    assert tables.read_questions(spark, str(tmp_path / "q.json"), 2).count() == 2
    for bad in ([{"id": 1, "question": "a"}, {"id": 1, "question": "b"}], [{"id": 1, "question": " "}]):
        write(bad)
        with pytest.raises(ValueError):
            tables.read_questions(spark, str(tmp_path / "q.json"))


def test_status_table(spark, tmp_path):
    (tmp_path / "s.csv").write_text("law_id,effective_class_as_of\n'01/2020/QH,\n02/2020/QH,expired_before_as_of\n,x\n", encoding="utf-8")
    assert sorted(map(tuple, tables.read_status(spark, str(tmp_path / "s.csv")).collect())) == [("01/2020/QH", "unknown"), ("02/2020/QH", "expired_before_as_of")]


def test_repeated_keys_are_an_error(spark):
    with pytest.raises(ValueError):
        tables.unique(spark.createDataFrame([(1,), (1,)], "k int"), ["k"])


def test_settings(monkeypatch):
    monkeypatch.setenv("SECRET_KEY", "k")
    made = settings.build(settings.Settings, settings.expanded({"models": {"backend": "remote", "endpoint": "http://x", "api_key": "${SECRET_KEY}", "odd": 1}, "unknown": {}}))
    assert made.models.api_key == "k" and made.problems() == []
    assert settings.build(settings.Settings, settings.expanded({"models": {"backend": "remote", "api_key": "${NOT_SET_ANYWHERE}"}})).problems()


def test_results_and_zip(spark, tmp_path):
    items = spark.createDataFrame([(2, "l|n|Điều 1", 1), (2, "m|n|Điều 2", 2), (2, "l|n|Điều 3", 3)], "qid long, article string, position int")
    asked = spark.createDataFrame([(1, "a"), (2, "b")], "qid long, question string")
    path = results.write_results(results.result_rows(items, asked), str(tmp_path))
    assert results.zip_problems(path) == []
    rows = json.loads(zipfile.ZipFile(path).read("results.json"))
    assert [r["id"] for r in rows] == [1, 2] and rows[0]["relevant_docs"] == [] and rows[1]["relevant_docs"] == ["l|n", "m|n"] and len(rows[1]["relevant_articles"]) == 3


def test_vector_updates(spark):
    schema = "id long, hash string, backend string, model string"
    stored = spark.createDataFrame([(1, "a", "x", "m"), (2, "b", "x", "m")], schema)
    wanted = spark.createDataFrame([(1, "a", "x", "m"), (2, "B", "x", "m"), (3, "c", "x", "m")], schema)
    fresh = results.stale(wanted, stored)
    assert sorted(r["id"] for r in fresh.collect()) == [2, 3]
    assert results.missing(wanted, results.upserted(stored, fresh)).count() == 0


def test_workflow_resumes_and_fails_on_problems(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"công ty số {i} vốn điều lệ", f"l|n|Điều {i}") for i in range(20)], "doc_id long, text string, article string")
    asked = spark.createDataFrame([(1, "vốn điều lệ. công ty số 3"), (2, "không khớp gì cả")], "qid long, query string")
    made = stages.run(spark, retrieve.workflow(), str(tmp_path / "t"), {"documents": docs, "questions": asked})
    rows = {r["id"]: r for r in made["results"].collect()}
    assert rows.keys() == {1, 2} and rows[1]["relevant_articles"] and rows[1]["relevant_docs"] == ["l|n"]

    def never(*_):
        raise AssertionError("ran again")

    again = [stages.Stage(s.name, never, s.problems) for s in retrieve.workflow()]
    assert stages.run(spark, again, str(tmp_path / "t"), {"documents": docs, "questions": asked})["results"].count() == 2
    with pytest.raises(RuntimeError):
        stages.run(spark, [stages.Stage("bad", lambda s, t: t["questions"], lambda df, t: ["wrong"])], str(tmp_path / "b"), {"questions": asked})


def test_manifest_accepts_named_changes_only():
    old = stages.Manifest({"code": "1", "data": "1"})
    assert old.refused({"code": "2", "data": "1"}) == ["code"]
    assert old.refused({"code": "2", "data": "1"}, {"code"}) == []


def test_stream_searches_each_question_once(spark, tmp_path):
    bm25.build(spark.createDataFrame([(1, "vốn điều lệ"), (2, "thuế")], "doc_id long, text string")).save(str(tmp_path / "index"))
    (tmp_path / "in").mkdir()
    for name in ("a", "b"):
        (tmp_path / "in" / f"{name}.json").write_text('{"qid": 1, "query": "vốn"}\n' + ('{"qid": 2, "query": "thuế"}\n' if name == "b" else ""), encoding="utf-8")
        stream.answer_stream(spark, str(tmp_path / "in"), str(tmp_path / "index"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted((r["qid"], r["doc_id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 1), (2, 2)]


def test_stages_follow_their_inputs_and_tell_their_status(spark, tmp_path):
    """A table is made again when what it was made from has changed, and only then; problems block after all passes."""
    made, waits, folder = [], [], str(tmp_path / "w")
    steps = [stages.Stage("one", lambda s, t: made.append("one") or t["in"]), stages.Stage("two", lambda s, t: made.append("two") or t["one"].groupBy().count())]
    first, second = (spark.createDataFrame([(k,) for k in rows], "a long") for rows in ((1, 2), (1, 3)))
    stages.run(spark, steps, folder, {"in": first})
    stages.run(spark, steps, folder, {"in": first.orderBy("a", ascending=False)})
    assert made == ["one", "two"] and stages.statuses(spark, steps, folder) == {"one": "complete", "two": "complete"}
    stages.run(spark, steps, folder, {"in": second})
    assert made == ["one", "two"] * 2
    stages.run(spark, steps, folder, {"in": second}, settings={"depth": 5})
    assert made == ["one", "two"] * 3
    bad = stages.Stage("bad", lambda s, t: made.append("bad") or t["in"], lambda df, t: ["wrong"], passes=3)
    with pytest.raises(RuntimeError, match="wrong"):
        stages.run(spark, [bad, *steps], folder, {"in": second}, sleep=waits.append, wait=40)
    assert made[-3:] == ["bad"] * 3 and waits == [40, 60] and stages.statuses(spark, [bad, *steps], folder)["bad"] == "blocked"


def test_command_line(spark, tmp_path, capsys):
    from rankloom.__main__ import main

    spark.createDataFrame([(1, "vốn điều lệ công ty", "1|L|Điều 1"), (2, "thuế", "2|L|Điều 2")], "doc_id long, text string, article string").write.parquet(str(tmp_path / "d"))
    spark.createDataFrame([(7, "vốn công ty. thuế nào?")], "qid long, query string").write.parquet(str(tmp_path / "q"))
    assert main(["list"]) == 0 and "bm25_topk" in capsys.readouterr().out
    assert main(["workflow", str(tmp_path / "d"), str(tmp_path / "q"), str(tmp_path / "o")]) == 0 and "results: complete" in capsys.readouterr().out
    assert set(spark.read.parquet(str(tmp_path / "o/results")).first()["relevant_articles"]) == {"1|L|Điều 1", "2|L|Điều 2"}


def test_question_of_its_own(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"id": 1, "question": "gì"}')
    (tmp_path / "two.json").write_text('[{"id": 1, "question": "gì"}, {"id": 2, "question": "nào"}]')
    (tmp_path / "none.json").write_text('[{"id": 1, "question": " "}]')
    assert tables.read_question(spark, str(tmp_path / "one.json")).count() == 1
    for name in ("two", "none"):
        with pytest.raises(ValueError):
            tables.read_question(spark, str(tmp_path / f"{name}.json"))


def test_corpus_report_and_vector_store(spark, tmp_path):
    from rankloom.sources import artifacts

    rows = spark.createDataFrame([("a", 1), ("b", 2)], "tier string, n int")
    assert "| a | 1 |" in artifacts.report({"Tiers": rows.orderBy("tier")})
    artifacts.write_corpus(rows, str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "c")).count() == 2
    good = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, v array<double>")
    assert artifacts.checked_store(good, 2).count() == 2
    for bad in (good.union(good.limit(1)), good.union(spark.createDataFrame([(3, [1.0])], good.schema))):
        with pytest.raises(Exception, match="bad vector"):
            artifacts.checked_store(bad, 2).collect()
    ranked = spark.createDataFrame([(1, 0, [("b ", None, 0.5), ("a", 2, 0.1), ("", 1, 1.0), ("c", 2, 0.1)])], "id long, intent_index int, ranked_articles array<struct<article:string,rank:int,rrf_score:double>>")
    assert [r["article"] for r in artifacts.ranked_hits(ranked).orderBy("position").collect()] == ["a", "c", "b"]
