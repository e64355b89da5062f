"""The batch workflow from questions to checked answers: models that fail, changes that are accepted, what a run would do."""

from __future__ import annotations

import json
import os

import pytest

from rankloom.plans import retrieve, stages
from rankloom.sources.results import zip_problems


class Flaky:
    """An answering client that fails at each question the first time, and writes down what it was asked."""

    def __init__(self, folder, fails=True):
        self.folder, self.fails = str(folder), fails

    def __call__(self, prompt):
        name = f"{self.folder}/{abs(hash(prompt.split(chr(10))[0])) % 10**12}"
        again = os.path.exists(name)
        with open(name, "a") as f:
            f.write("x")
        if self.fails and not again:
            raise ConnectionError("503")
        return retrieve.quoted(prompt)

    def asked(self):
        return sum(len(open(f"{self.folder}/{n}").read()) for n in os.listdir(self.folder))


TEXTS = ["vốn điều lệ của công ty", "mức phạt tiền đối với hành vi gian lận", "thuế thu nhập của công ty", "hợp đồng lao động", "điều kiện đăng ký kinh doanh"]


@pytest.fixture
def inputs(spark):
    docs = spark.createDataFrame([(k, f"{TEXTS[k % 5]} số {k}", f"{k % 3 + 1:02d}/2020/QH14|Luật {k % 3}|Điều {k}") for k in range(30)], "doc_id long, text string, article string")
    asked = spark.createDataFrame([(1, 3, "vốn điều lệ của công ty là gì. điều kiện đăng ký kinh doanh"), (2, 2, "hợp đồng lao động gồm những gì"), (3, 1, "không khớp")], "qid long, position long, query string")
    classes = spark.createDataFrame([("02/2020/QH14", "expired_before_as_of")], "law_id string, class string")
    return {"documents": docs, "questions": asked, "statuses": classes}


def test_questions_become_checked_answers_in_their_order(spark, tmp_path, inputs):
    (tmp_path / "asked").mkdir()
    client = Flaky(tmp_path / "asked")
    steps = retrieve.workflow(models=retrieve.Models(answer=client, ledgers=str(tmp_path / "ledgers")))
    waits = []
    made = stages.run(spark, steps, str(tmp_path / "t"), inputs, sleep=waits.append)
    assert client.asked() == 6 and waits == [5.0]  # each question failed once, and none was asked again
    rows = {r["id"]: r for r in made["results"].collect()}
    assert rows.keys() == {1, 2, 3} and [r["position"] for r in made["results"].orderBy("position").collect()] == [1, 2, 3]
    for r in rows.values():
        assert r["answer"].startswith("Theo Điều") and r["relevant_articles"] and not any(a.startswith("02/") for a in r["relevant_articles"])
        assert set(r["relevant_docs"]) == {a.rsplit("|", 1)[0] for a in r["relevant_articles"]}
    kept = {s: {(r["qid"], r["article"]) for r in made[s].select("qid", "article").collect()} for s in ("candidates", "selected", "cleaned", "together", "gated", "final")}
    assert kept["selected"] <= kept["candidates"] and kept["cleaned"] <= kept["selected"] and kept["gated"] <= kept["together"] <= kept["cleaned"] and kept["gated"] <= kept["final"] <= kept["cleaned"]
    assert retrieve.Models(ledgers=str(tmp_path / "ledgers")).ledger("answer").finished(spark).count() == 3  # the ledger outlives the tables


def test_a_stage_whose_models_stay_away_blocks_the_run(spark, tmp_path, inputs):
    def down(prompt):
        raise ConnectionError("503")

    steps = retrieve.workflow(models=retrieve.Models(answer=down))
    with pytest.raises(RuntimeError, match="3 questions have no answer"):
        stages.run(spark, steps, str(tmp_path / "t"), inputs, sleep=lambda s: None)
    assert stages.statuses(spark, steps, str(tmp_path / "t"))["answers"] == "blocked" and stages.statuses(spark, steps, str(tmp_path / "t"))["results"] == "pending"


def test_changes_are_told_and_accepted_by_name(spark, tmp_path):
    made = []
    steps = [stages.Stage("one", lambda s, t: made.append("one") or t["a"]), stages.Stage("two", lambda s, t: made.append("two") or t["one"].join(t["b"], "k"))]
    frame = lambda *rows: spark.createDataFrame([(k,) for k in rows], "k long")
    folder = str(tmp_path / "w")
    first = {"a": frame(1, 2), "b": frame(1)}
    assert set(stages.preflight(spark, steps, folder, first).values()) == {"made: there is no table"}
    stages.run(spark, steps, folder, first, settings={"depth": 1})
    assert stages.preflight(spark, steps, folder, first, {"depth": 1}) == {"one": "kept", "two": "kept"} and made == ["one", "two"]
    assert stages.preflight(spark, steps, folder, first, {"depth": 2})["one"] == "made: settings changed"
    assert set(stages.preflight(spark, steps, folder, first, {"depth": 2}, {"settings"}).values()) == {"kept"}
    other = first | {"b": frame(2)}
    told = stages.preflight(spark, steps, folder, other, {"depth": 1})
    assert told["one"].startswith("made: b changed") and "one" in told["two"]
    stages.run(spark, steps, folder, other, settings={"depth": 2}, accepted={"b", "settings"})
    assert made == ["one", "two"]
    noted = json.loads(spark.read.text(f"{folder}/_manifest/one").first()["value"])
    assert noted["history"][0]["accepted"] == ["b", "settings"]
    assert stages.preflight(spark, steps, folder, other, {"depth": 2}) == {"one": "kept", "two": "kept"}
    stages.run(spark, steps, folder, first, settings={"depth": 2})
    assert made == ["one", "two"] * 2

    def broken(s, t):
        raise ValueError("no")

    with pytest.raises(ValueError):
        stages.run(spark, [stages.Stage("three", broken)], folder, first)
    assert stages.statuses(spark, [stages.Stage("three", broken)], folder) == {"three": "failed"}


def test_files_are_told_apart_without_being_read(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    one = stages.stamp(spark.read.parquet(path))
    assert stages.stamp(spark.read.parquet(path)) == one != stages.stamp(spark.read.parquet(path).where("id > 1"))
    spark.range(6).write.mode("overwrite").parquet(path)
    assert stages.stamp(spark.read.parquet(path)) != one
    assert stages.stamp(spark.range(3)) == stages.stamp(spark.range(3).orderBy("id", ascending=False)) != stages.stamp(spark.range(4))


def test_commands_of_index_package_and_preflight(spark, tmp_path, inputs, capsys):
    from rankloom.__main__ import main

    for name in ("documents", "questions"):
        inputs[name].write.parquet(str(tmp_path / name))
    docs, questions, out = (str(tmp_path / n) for n in ("documents", "questions", "out"))
    assert main(["index", docs, str(tmp_path / "index")]) == 0 and "30 documents" in capsys.readouterr().out
    spark.createDataFrame([(99, "một văn bản mới", "09/2020/QH14|Luật|Điều 1")], "doc_id long, text string, article string").write.mode("append").parquet(docs)
    assert main(["index", docs, str(tmp_path / "index")]) == 0 and "31 documents" in capsys.readouterr().out
    assert main(["workflow", docs, questions, out, "--preflight"]) == 0 and "results: made" in capsys.readouterr().out
    assert main(["workflow", docs, questions, out, "--threads", "4"]) == 0 and "results: complete" in capsys.readouterr().out
    assert main(["workflow", docs, questions, out, "--preflight"]) == 0 and "results: kept" in capsys.readouterr().out
    assert main(["package", f"{out}/results", str(tmp_path / "zip")]) == 0
    assert zip_problems(str(tmp_path / "zip/results.zip"), [3, 2, 1]) == []
