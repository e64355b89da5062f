"""One question reads little and gets the batch's row."""

from __future__ import annotations

from rankloom.plans import retrieve, serve, stages

TEXTS = ["vốn điều lệ của công ty", "mức phạt tiền đối với hành vi gian lận", "thuế thu nhập của công ty", "hợp đồng lao động", "điều kiện đăng ký kinh doanh"]
ASKED = ["vốn điều lệ của công ty là gì. điều kiện đăng ký kinh doanh", "hợp đồng lao động gồm những gì", "không khớp", ""]


def test_a_question_alone_gets_the_row_of_the_batch(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"{TEXTS[k % 5]} số {k}", f"{k % 3 + 1:02d}/2020/QH14|Luật {k % 3}|Điều {k}") for k in range(60)], "doc_id long, text string, article string")
    asked = spark.createDataFrame(list(enumerate(ASKED)), "qid long, query string")
    steps = retrieve.workflow(depth=8, intent_depth=3, listed=10)
    made = stages.run(spark, steps, str(tmp_path / "t"), {"documents": docs, "questions": asked})
    serve.prepare(made, str(tmp_path / "s"), buckets=16, groups=8)
    batch = {r["id"]: r for r in made["results"].collect()}
    settings = {"depth": 8, "intent_depth": 3, "listed": 10}
    for qid in (0,):
        reply = serve.Server(spark, str(tmp_path / "s"), settings=settings).ask(qid, ASKED[qid])
        assert reply.row == batch[qid]
        for name in ("postings", "terms", "documents"):
            read, every = reply.files[name]
            assert read < every, name
    few = serve.Server(spark, str(tmp_path / "s"), probes=2, settings=settings).ask(1, ASKED[1])
    assert few.files["vectors"][0] < few.files["vectors"][1] and few.row["relevant_articles"] and few.row["answer"].startswith("Theo")
