"""Calls of models: several at once, within a rate, written down chunk by chunk, and never made twice."""

from __future__ import annotations

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from rankloom.operators import analysis, collective, generate, verify
from rankloom.sources import calls
from rankloom.sources.calls import Ledger, Pace, PerThread, Workers


class Counted:
    """A client that writes down each payload it is asked, and may end its process at one of them."""

    def __init__(self, folder, dies_at=None, fails_at=None, wait=0.0):
        self.folder, self.dies_at, self.fails_at, self.wait = str(folder), dies_at, fails_at, wait

    def __call__(self, payload):
        begin = time.time()
        time.sleep(self.wait)
        with open(f"{self.folder}/{threading.get_ident()}-{os.getpid()}", "a") as f:
            f.write(f"{payload} {begin} {time.time()}\n")
        if payload == self.dies_at:
            os._exit(1)
        if payload == self.fails_at:
            raise ConnectionError("connection reset")
        return f"<{payload}>"

    def asked(self):
        return [line.split() for name in os.listdir(self.folder) for line in open(f"{self.folder}/{name}")]


def rows_of(spark, n, partitions=2):
    return spark.range(n).select("id", F.concat(F.lit("p"), "id").alias("payload")).repartition(partitions)


def replies(df):
    return {r["id"]: r["reply"] for r in df.collect()}


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "asked").mkdir()
    return tmp_path


def test_calls_overlap_in_order_and_equal_those_made_one_by_one(spark, folder):
    slow = Counted(folder / "asked", wait=0.05)
    many = calls.ask(rows_of(spark, 60, 1), F.col("payload"), slow, workers=Workers(threads=8)).collect()
    spans = sorted((float(b), float(e)) for _, b, e in slow.asked())
    assert max(sum(b <= x < e for b, e in spans) for x, _ in spans) > 1
    assert spans[-1][1] - spans[0][0] < 60 * 0.05
    one = calls.ask(rows_of(spark, 60, 1), F.col("payload"), Counted(folder / "asked")).collect()
    assert many == one and [r["reply"] for r in many] == [f"<{r['payload']}>" for r in many]


def test_a_window_bounds_what_is_under_way():
    from concurrent.futures import ThreadPoolExecutor

    taken, done = [], []

    def items():
        for k in range(20):
            taken.append(k)
            yield k

    with ThreadPoolExecutor(3) as pool:
        for item, result in calls.in_flight(pool, lambda x: x * x, items(), 4):
            done.append(item)
            assert result == item * item and len(taken) - len(done) <= 5
    assert done == list(range(20))


def test_calls_keep_a_pace_that_tasks_share():
    now = [0.0]
    waits = []
    pace = Pace(4.0, lambda: now[0], lambda s: waits.append(s) or now.__setitem__(0, now[0] + s))
    for _ in range(5):
        pace.wait()
    assert waits == [0.25] * 4 and now[0] == 1.0
    assert Workers(rate=12.0, tasks=3).pace().gap == 0.25 and Workers().pace().gap == 0
    with pytest.raises(ValueError):
        Workers(rate=1.0)


def test_each_thread_has_its_own_client(spark):
    class Own:
        def __init__(self):
            self.thread = threading.get_ident()

        def __call__(self, payload):
            return str(self.thread == threading.get_ident())

    assert set(replies(calls.ask(rows_of(spark, 40), F.col("payload"), PerThread(Own), workers=Workers(threads=4))).values()) == {"True"}


def test_a_killed_stage_asks_only_what_is_left(spark, folder):
    ledger = Ledger(str(folder / "ledger"), "draft", chunk=5)
    rows = rows_of(spark, 100, 1).orderBy("id").coalesce(1)
    dying = Counted(folder / "asked", dies_at="p57")
    with pytest.raises(Exception):
        calls.ask(rows, F.col("payload"), dying, ledger=ledger)
    kept = ledger.finished(spark).count()
    first = len(dying.asked())
    assert first - kept <= 5 + 1 + 2 and kept % 5 == 0 and kept >= 50
    well = Counted(folder / "asked")
    assert replies(calls.ask(rows, F.col("payload"), well, ledger=ledger)) == {k: f"<p{k}>" for k in range(100)}
    assert len(well.asked()) - first == 100 - kept
    again = calls.ask(rows, F.col("payload"), well, ledger=ledger)
    assert replies(again) == replies(again) and len(well.asked()) - first == 100 - kept  # neither a third run nor a second reading asks


def test_ledgers_ask_failed_calls_again_and_equal_payloads_once(spark, folder):
    ledger = Ledger(str(folder / "ledger"), "s", chunk=3)
    rows = rows_of(spark, 12).withColumn("payload", F.when(F.col("id") < 10, F.concat(F.lit("p"), F.col("id") % 4)))
    failing = Counted(folder / "asked", fails_at="p2")
    got = {r["id"]: (r["reply"], r["error"]) for r in calls.ask(rows, F.col("payload"), failing, when=F.col("id") != 0, ledger=ledger).collect()}
    assert got[11] == (None, None) and got[2][0] is None and "reset" in got[2][1] and got[5] == ("<p1>", None)
    assert len(failing.asked()) == 4
    got = replies(calls.ask(rows, F.col("payload"), Counted(folder / "asked"), ledger=ledger))
    assert got[6] == "<p2>" and got[0] == "<p0>" and len(failing.asked()) == 5
    other = Ledger(str(folder / "ledger"), "s", settings="another model")
    calls.ask(rows.where("id = 1"), F.col("payload"), Counted(folder / "asked"), ledger=other).collect()
    assert len(failing.asked()) == 6
    files = sum(n.endswith(".parquet") and not n.startswith(".") for n in os.listdir(ledger.path))
    before = ledger.replies(spark).orderBy("digest").collect()
    ledger.compact(spark)
    assert ledger.replies(spark).orderBy("digest").collect() == before
    assert sum(n.endswith(".parquet") and not n.startswith(".") for n in os.listdir(ledger.path)) < files
    assert calls.ask(rows.where("id < 0"), F.col("payload"), failing, ledger=Ledger(str(folder), "none")).collect() == []


def test_a_task_that_is_tried_again_keeps_what_it_committed(spark, folder, monkeypatch):
    """An earlier attempt's chunks count; this is done by a context that says so, as a local session tries once only."""
    ledger = Ledger(str(folder / "ledger"), "s", chunk=2)

    class Context:
        attempt = 0

        def partitionId(self):
            return 3

        def attemptNumber(self):
            return Context.attempt

    monkeypatch.setattr(calls.TaskContext, "get", staticmethod(lambda: Context()))
    import pandas as pd

    frame = pd.DataFrame({"digest": list("abcde"), "payload": list("abcde")})
    client = Counted(folder / "asked")
    task = ledger._asker(client, Workers(), "run")
    assert [f["n"][0] for f in task(iter([frame.head(3)]))] == [3]
    Context.attempt = 1
    assert [f["n"][0] for f in task(iter([frame]))] == [2] and sorted(x[0] for x in client.asked()) == list("abcde")
    assert ledger.finished(spark).count() == 5


def test_stages_of_models_use_ledgers(spark, folder):
    ledger = Ledger(str(folder / "ledger"), "all")
    client = Counted(folder / "asked")
    jobs = spark.createDataFrame([(k, f"s{k}", "q", f"prompt{k}", [], []) for k in range(6)], f"qid long, signature string, question string, prompt string, articles {generate.FIELDS}, labels array<string>")
    told = generate.answer(jobs, client, ledger=ledger)
    assert {r["qid"]: r["answer"] for r in told.collect()} == {k: f"<prompt{k}>" for k in range(6)}
    told.collect()
    assert len(client.asked()) == 6
    questions = spark.createDataFrame([(1, "câu hỏi"), (2, None)], "qid long, query string")
    for _ in range(2):
        rows = {r["qid"]: r for r in analysis.analyse(questions, ledger=ledger, workers=Workers(threads=2)).collect()}
        assert rows[1]["intents"] == ["câu hỏi"] and rows[1]["error"] is None and rows[2]["query"] == "" and "rewrite" in rows[2]["error"]
    candidates = spark.createDataFrame([(q, p, "điều kiện", "Luật", "l", f"a{q}{p}", "điều kiện" if p % 2 else "x") for q in (1, 2) for p in range(1, 11)], "qid long, position int, question string, law_type string, law_name string, article string, content string")
    plain = sorted((r["qid"], r["selected"], r["path"], r["failed"]) for r in collective.select_together(candidates).collect())
    assert plain == sorted((r["qid"], r["selected"], r["path"], r["failed"]) for r in collective.select_together(candidates, ledger=ledger, workers=Workers(threads=3)).collect())


def test_strict_selection_leaves_out_what_cannot_be_read(spark):
    candidates = spark.createDataFrame([(q, p, f"hỏi {q}", "Luật", "l", f"a{q}{p}", "nội dung") for q in (1, 2, 3) for p in range(1, 4)], "qid long, position int, question string, law_type string, law_name string, article string, content string")

    def client(payload):
        if "hỏi 1" in payload:
            return '{"selected_article_keys": ["A2"], "confidence": "high"}'
        return '{"selected_article_ids": ["A1"]}' if "hỏi 2" in payload else "no json"

    lenient = {r["qid"]: r["selected"] for r in verify.selected(verify.ask(verify.prompts(candidates), client)).collect()}
    assert lenient == {1: ["a12"], 2: ["a21"], 3: None}
    assert {r["qid"]: r["selected"] for r in verify.selected(verify.ask(verify.prompts(candidates), client), strict=True).collect()} == {1: ["a12"]}
    assert {r["qid"] for r in collective.select_together(candidates, client, strict=True).collect()} == {1}
    repaired = collective.select_together(candidates, client, repair=lambda shown: '{"selected_article_keys": ["A3"]}', strict=True)
    assert {r["qid"]: r["selected"] for r in repaired.collect()} == {1: ["a12"], 2: ["a23"], 3: ["a33"]}
