"""Operators on small frames: cases that the reference's own tests care about, closed forms, ties and edges."""

from __future__ import annotations

import itertools
import json
import math
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from rankloom.functions import text as T
from rankloom.operators import answers, bm25, citations, corpus, dense, features, fusion, rules, verify


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expression(F.col("c")).alias("o")).first()["o"]


DOCS = [(1, "vốn điều lệ của công ty"), (2, "thuế của công ty công ty"), (3, ""), (4, None), (5, "hợp đồng lao động")]


def test_bm25_formula_multiplicity_and_ties(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    index = bm25.build(docs)
    stats = index.stats.first()
    sizes = {1: 6, 2: 6, 3: 0, 4: 0, 5: 4}
    assert stats["n"] == 5 and stats["avgdl"] == pytest.approx(sum(sizes.values()) / 5)
    queries = spark.createDataFrame([(1, "công công ty"), (2, "không khớp nào"), (3, "")], "qid long, query string")
    got = {(r["qid"], r["doc_id"]): (r["score"], r["rank"]) for r in bm25.search(index, queries, 10).collect()}
    assert {q for q, _ in got} == {1}
    idf = math.log((5 - 2 + 0.5) / (2 + 0.5) + 1)
    part = lambda tf, dl: idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / stats["avgdl"]))
    assert got[1, 1][0] == pytest.approx(3 * part(1, 6), abs=1e-8)
    assert got[1, 2] == (pytest.approx(3 * part(2, 6), abs=1e-8), 1)
    assert bm25.search(index, queries, 1).count() == 1


def test_bm25_of_no_documents(spark):
    index = bm25.build(spark.createDataFrame([], "doc_id long, text string"))
    assert bm25.search(index, spark.createDataFrame([(1, "a b")], "qid long, query string"), 5).count() == 0


def test_bm25_index_survives_a_round_trip(spark, tmp_path):
    index = bm25.build(spark.createDataFrame(DOCS, "doc_id long, text string"))
    index.save(str(tmp_path))
    queries = spark.createDataFrame([(1, "hợp đồng")], "qid long, query string")
    assert bm25.search(bm25.Index.load(spark, str(tmp_path)), queries, 3).collect() == bm25.search(index, queries, 3).collect()


def test_composed_and_decomposed_texts_have_equal_tokens(spark):
    text = "Điều kiện thành lập công ty"
    both = [one(spark, unicodedata.normalize(form, text), T.tokens) for form in ("NFC", "NFD")]
    prints = {one(spark, unicodedata.normalize(form, text), T.fingerprint) for form in ("NFC", "NFD")}
    assert len(prints) == 1
    assert both[0] == both[1] == ["điều", "kiện", "thành", "lập", "công", "ty"]
    assert one(spark, None, T.tokens) == [] and one(spark, "\u212b \u1100\u1161", T.nfc) == "\u00c5 \uac00"


def test_search_finds_decomposed_texts_and_queries(spark):
    """Rankings don't depend on the form of texts or of queries."""
    texts = ["Điều kiện thành lập công ty cổ phần", "Xử phạt vi phạm hành chính"]
    rankings = set()
    for of_text, of_query in itertools.product(("NFC", "NFD"), repeat=2):
        docs = spark.createDataFrame([(i, unicodedata.normalize(of_text, t)) for i, t in enumerate(texts)], "doc_id long, text string")
        asked = spark.createDataFrame([(1, unicodedata.normalize(of_query, "thành lập công ty"))], "qid long, query string")
        for index in (bm25.build(docs), bm25.build(docs, only=bm25.words_of(asked))):
            rankings.add(str([(r["doc_id"], r["score"], r["rank"]) for r in bm25.search(index, asked, 5).collect()]))
    assert len(rankings) == 1 and rankings.pop().startswith("[(0,")


def test_rrf_by_formula_and_first_seen(spark):
    schema = "qid long, doc_id string, rank int"
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], schema)
    b = spark.createDataFrame([(1, "y", 1), (1, "x", 2), (1, "z", 3)], schema)
    rows = fusion.rrf([a, b]).orderBy("rank").collect()
    assert [r["doc_id"] for r in rows] == ["x", "y", "z"]
    assert rows[0]["score"] == pytest.approx(1 / 61 + 1 / 62, abs=1e-9) and rows[2]["score"] == pytest.approx(1 / 63, abs=1e-9)
    assert fusion.rrf([a.limit(0), b.limit(0)]).count() == 0


def test_round_robin_takes_first_hits_of_all_intents_first(spark):
    hits = spark.createDataFrame([(1, 0, "A", 1), (1, 0, "B", 2), (1, 0, "C", 3), (1, 1, "D", 1), (1, 1, "A", 2), (1, 1, "E", 3)], "qid long, intent_index int, doc_id string, rank int")
    assert [r["doc_id"] for r in fusion.round_robin(hits).orderBy("position").collect()] == ["A", "D", "B", "C", "E"]


def test_tiers_keep_their_order_and_ignore_intents_beyond_the_count(spark):
    schema = "qid long, intent_index int, doc_id string, rank int"
    fused = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "qid long, doc_id string, rank int")
    again = spark.createDataFrame([(1, 0, "b", 1), (1, 0, "c", 2), (1, 1, "x", 1)], schema)
    raw = spark.createDataFrame([(1, 0, "d", 1), (1, 0, "a", 2)], schema)
    asked = spark.createDataFrame([(1, 1)], "qid long, num_intents int")
    rows = fusion.tiered_union(fused, again, raw, asked, (12, 5, 5)).orderBy("position").collect()
    assert [(r["doc_id"], r["tier"]) for r in rows] == [("a", 1), ("b", 1), ("c", 2), ("d", 3)]


def test_dense_search_against_plain_python(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(5)]) for i in range(60)] + [(60, [0.0] * 5), (61, [float("nan")] * 5), (62, None), (63, [1.0])]
    vectors = spark.createDataFrame(rows, "id long, v array<double>")
    queries = vectors.where("id < 4").select(F.col("id").alias("qid"), "v")
    plain = {i: v for i, v in rows[:61]}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    size = lambda a: math.sqrt(dot(a, a)) or 1
    measures = {"dot": dot, "euclid": lambda a, b: -math.dist(a, b), "cosine": lambda a, b: dot(a, b) / size(a) / size(b)}
    for name, measure in measures.items():
        got = {}
        for r in dense.top_k(queries, vectors, 7, name, block=16, query_block=2).orderBy("qid", "rank").collect():
            got.setdefault(r["qid"], []).append(r["id"])
        for q in range(4):
            assert got[q] == sorted(plain, key=lambda i: (-round(measure(plain[q], plain[i]), 6), i))[:7], name


def test_vectors_are_normalised_and_validated(spark):
    assert one(spark, [3.0, 4.0], dense.l2_normalize, "array<float>") == pytest.approx([0.6, 0.8])
    assert one(spark, [0.0, 0.0], dense.l2_normalize, "array<float>") == [0.0, 0.0]
    for value, ok in (([1.0, 2.0], True), ([1.0], False), ([1.0, float("nan")], False), ([1.0, float("inf")], False), (None, False), ([1.0, None], False)):
        assert one(spark, value, lambda c: dense.is_valid(c, 2), "array<float>") is ok


def test_mock_score_is_a_share_of_six_digits(spark):
    import hashlib

    query, text = "q" * 50, "Điều 5 " * 40
    row = spark.createDataFrame([(query, text)], "q string, t string").select(features.mock_score(F.col("q"), F.col("t")).alias("s")).first()
    assert row["s"] == int(hashlib.sha1(f"{query[:40]}||{text[:120]}".encode()).hexdigest()[:6], 16) / 0xFFFFFF


def test_selection_with_pins_and_cap(spark):
    scored = spark.createDataFrame([(1, "a", 2.0, 1, 0.9, 1), (1, "b", 3.0, 1, 0.5, 1), (1, "c", 1.0, 2, 0.1, 1)], "qid long, doc_id string, score double, best_rank int, best_score double, num_intents int")
    pins = spark.createDataFrame([(1, "c", 1)], "qid long, doc_id string, pin int")
    rows = features.select(scored, pins, F.lit(2)).orderBy("output_rank").collect()
    assert [(r["doc_id"], r["selected"]) for r in rows] == [("c", True), ("b", True), ("a", False)]
    assert [features_cap for features_cap in (one(spark, n, features.adaptive_cap, "int") for n in (1, 3, 9))] == [10, 15, 20]


TEXT = "Điều 1. Phạm vi 1. Một. 2. Hai. Điều 2. của Luật này Điều 3. Đối tượng dài Điều 2. Lùi lại Điều 3a. Bổ sung Điều 3. Lặp Điều 10. Cuối"


def test_markers_boundaries_and_articles(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, None), (3, "không có"), (4, "")], "doc_id long, text string")
    kept = [r["number"] for r in corpus.boundaries(corpus.marked(docs)).orderBy("id", "pos").collect()]
    assert kept == ["1", "3", "3a", "10"]
    rows = corpus.articles(corpus.marked(docs)).collect()
    first = next(r for r in rows if r["number"] == "Điều 1")
    assert first["title"] == "Phạm vi" and [(c["id"], c["text"][:3]) for c in first["clauses"][:2]] == [("1", "Một"), ("2", "Hai")]
    assert {r["number"] for r in rows} == {"Điều 1", "Điều 3", "Điều 3a", "Điều 10"}


def test_boundaries_equal_a_loop_on_random_numbers(spark):
    rng = random.Random(5)
    rows, want = [], []
    for doc in range(200):
        last = (0, "")
        for pos in range(rng.randint(0, 8)):
            now = rng.randint(0, 4), rng.choice(["", "a", "b"])
            rows.append((doc, "", pos, f"{now[0]}{now[1]}", *now, 0))
            if now[0] > last[0] or (now[0] == last[0] and now[1] and now[1] > last[1]):
                want.append((doc, pos))
                last = now
    marks = {doc: [r[2:] for r in rows if r[0] == doc] for doc in range(200)}
    found = spark.createDataFrame([(doc, "", m) for doc, m in marks.items()], f"id long, text string, marks array<{corpus.MARK}>")
    assert sorted((r["id"], r["pos"]) for r in corpus.boundaries(found).collect()) == sorted(want)


def test_titles_excerpts_and_prefixes(spark):
    assert one(spark, "x" * 50 + " " + "y" * 200, T.title_of) == "x" * 50
    assert one(spark, "a " + "y" * 300, T.title_of) == "a " + "y" * 178
    long = "đầu " + "x" * 500 + " cuối"
    cut = one(spark, long, lambda c: T.excerpt(c, 100))
    assert len(cut) <= 100 and cut.startswith("đầu") and cut.endswith("cuối") and "[...]" in cut
    assert one(spark, "ngắn", lambda c: T.excerpt(c, 100)) == "ngắn" and one(spark, None, lambda c: T.excerpt(c, 9)) == ""
    strip = lambda name, kind: one(spark, name, lambda c: T.strip_type(c, F.lit(kind)))
    assert strip("LUẬT Doanh nghiệp", "Luật") == "Doanh nghiệp" and strip("Luật", "Luật") == "Luật" and strip("Bộ luật Dân sự", "Bộ luật") == "Dân sự"
    assert one(spark, "điều lệ", T.upper_first) == "Điều lệ"


def test_reference_decoders_differ_only_by_separators(spark):
    ref = "01/2020/QH|Luật A|B|Điều 5"
    assert one(spark, ref, T.doc_of) == "01/2020/QH|Luật A" and one(spark, ref, T.doc_before_last) == "01/2020/QH|Luật A|B"
    assert one(spark, "x", T.doc_of) == "x" and one(spark, "x", T.doc_or_empty) == "" and one(spark, "a|b", T.lookup_key) is None
    assert tuple(one(spark, f" {ref} ", T.lookup_key)) == ("01/2020/QH", "Điều 5")


def test_html_loses_scripts_comments_and_tags(spark):
    page = "<p>A&amp;B<script>x</p></script><!-- c --><b>d</b>\n<style>p{}</style>&copy;&lt;"
    assert one(spark, page, T.html_text) == "A&B d ©<"
    assert one(spark, None, T.html_text) == ""


GATE = [
    ("Thủ tục đăng ký?", "Luật A", "Mức phạt tiền", "", True, "generic_penalty_level_not_requested"),
    ("Mức phạt bao nhiêu?", "Luật A", "MỨC PHẠT TIỀN", "", True, ""),
    ("Thủ tục đăng ký?", "Luật A", "Biện pháp cưỡng chế", "", True, "coercion_not_requested_with_alternative"),
    ("Thủ tục đăng ký?", "Luật A", "Biện pháp cưỡng chế", "", False, ""),
    ("Công ty còn nợ thuế?", "Luật A", "Biện pháp cưỡng chế", "", True, ""),
    ("Thủ tục đăng ký?", "Nghị định xử phạt vi phạm hành chính", "Vi phạm quy định về hồ sơ", "", True, "specific_penalty_not_requested_with_alternative"),
    ("Bị xử lý như thế nào?", "Nghị định xử phạt vi phạm hành chính", "Vi phạm quy định về hồ sơ", "", True, ""),
    ("Thủ tục đăng ký?", "Luật A", "Vi phạm quy định về hồ sơ", "Phạt tiền từ 1 đến 2", True, "specific_penalty_not_requested_with_alternative"),
    ("Thủ tục đăng ký?", "Luật A", "Điều khoản chung", "phạt tiền", True, ""),
    ("Ai có quyền?", "Luật A", "Thẩm quyền xử phạt", "", True, ""),
]


def test_gate_reasons(spark):
    rows = spark.createDataFrame([(i, *g) for i, g in enumerate(GATE)], "i int, q string, law string, title string, content string, alt boolean, want string")
    got = rows.select("i", "want", rules.enforcement_reason(F.col("q"), F.col("law"), F.col("title"), F.col("content"), F.col("alt")).alias("got")).collect()
    assert [(r["i"], r["got"]) for r in got] == [(r["i"], r["want"]) for r in got]


def test_guard_keeps_the_last_and_fallback_keeps_all(spark):
    rows = spark.createDataFrame([(1, 1, True), (1, 2, True), (2, 1, True), (2, 2, False), (3, 1, None)], "qid long, position int, drop boolean")
    assert sorted((r["qid"], r["position"]) for r in rules.guarded_drop(rows, ["qid"], F.col("drop"), "position").collect()) == [(1, 2), (2, 2), (3, 1)]
    assert sorted((r["qid"], r["position"]) for r in rules.never_empty(rows, ["qid"], ~F.col("drop")).collect()) == [(1, 1), (1, 2), (2, 2), (3, 1)]


def test_rescue_equals_a_loop(spark):
    rng = random.Random(9)
    rows = []
    for i in range(300):
        pick = lambda n: [str(x) for x in rng.sample(range(8), rng.randint(0, n))]
        rows.append((i, pick(3), [pick(4) for _ in range(rng.randint(0, 4))], pick(6)))
    frame = spark.createDataFrame(rows, "i int, final array<string>, intents array<array<string>>, survivors array<string>")
    got = {r["i"]: r["o"] for r in frame.select("i", rules.rescued(F.col("final"), F.col("intents"), F.col("survivors"), 2).alias("o")).collect()}
    for i, final, intents, survivors in rows:
        now = list(final)
        for ranking in intents:
            if ranking and not set(ranking[:2]) & set(now) and ranking[0] in survivors and ranking[0] not in now:
                now.append(ranking[0])
        assert got[i] == now


@pytest.mark.parametrize(
    ("reply", "strict", "want"),
    [
        ('{"selected_article_keys": ["A1", "A2", "A1"], "confidence": "High"}', False, (["A1", "A2"], "high")),
        ('```json\n{"selected_article_ids": ["A2"]}\n```', False, (["A2"], "low")),
        ('{"selected_article_ids": ["A2"]}', True, (None, "low")),
        ('{"selected_article_keys": ["A9"]}', False, (None, "low")),
        ('text {"selected_article_keys": []} more', False, ([], "low")),
        ('"selected_article_keys": ["A1", "A3', False, (["A1", "A3"], "low")),
        ('"selected_article_keys": ["A1"', True, (None, "low")),
        ("", False, (None, "low")),
    ],
)
def test_replies(reply, strict, want):
    assert verify.parse_selection(reply, ["A1", "A2", "A3"], strict) == want


def test_selection_runs_in_batches_and_isolates_failures(spark):
    rows = [(q, p, f"câu hỏi {q}", "Luật", "A", f"bài {p} " + ("câu hỏi" if p == 8 else "khác"), f"l|A|Điều {p}") for q in (1, 2) for p in range(1, 9)]
    candidates = spark.createDataFrame(rows, "qid long, position int, question string, law_type string, law_name string, content string, article string")
    batches = verify.prompts(candidates)
    assert batches.count() == 4

    def client(payload: str) -> str:
        data = json.loads(payload)
        if data["question"].endswith("2") and len(data["candidate_articles"]) == 6:
            raise RuntimeError("down")
        return json.dumps({"selected_article_keys": [c["key"] for c in data["candidate_articles"] if "câu" in c["content"]], "confidence": "high"})

    told = {r["qid"]: r for r in verify.selected(verify.ask(batches, client)).collect()}
    assert told[1]["selected"] == ["l|A|Điều 8"] and told[1]["parse_failures"] == 0 and told[1]["confidence"] == "high"
    assert told[2]["selected"] == ["l|A|Điều 8"] and told[2]["parse_failures"] == 1 and told[2]["confidence"] == "low"


def test_fallbacks(spark):
    rows = [(None, False), ([], False), (["c"], True), (["c"], False)]
    frame = spark.createDataFrame([(i, c, t, list("abcdef")) for i, (c, t) in enumerate(rows)], "i int, chosen array<string>, technical boolean, all array<string>")
    got = [r["o"] for r in frame.orderBy("i").select(verify.with_fallback(F.col("chosen"), F.col("all"), F.col("technical"), F.lit(True)).alias("o")).collect()]
    assert got == [list("abcde"), list("abc"), list("cabde"), ["c", "a"]]
    assert one(spark, ["d", "b"], lambda c: verify.collective_fallback(c, F.array(*map(F.lit, "abcd"))), "array<string>") == ["b", "d"]
    assert one(spark, [], lambda c: verify.collective_fallback(c, F.array(*map(F.lit, "abcd"))), "array<string>") == ["a"]


ARTICLES = [("Điều 5", "59/2020/QH14"), ("Điều 17", "01/2021/NĐ-CP")]


@pytest.mark.parametrize(
    ("answer", "ok", "part"),
    [
        ("Theo Điều 5 Luật 59/2020/QH14, được phép.", True, "ok"),
        ("Theo 59/2020/QH14 (Điều 5) được phép.", True, "ok"),
        ("Theo Điều 5 Luật 59/2020/QH14. Khoản 2 Điều 17 nêu rõ.", True, "ok"),
        ("Theo Điều 6 Luật 59/2020/QH14.", False, "not present"),
        ("Theo Điều 5 Nghị định 01/2021/NĐ-CP.", False, "Điều 5 (01/2021/NĐ-CP)"),
        ("Theo Điều 99.", False, "unqualified"),
        ("Theo Điều 5.", False, "fully qualified"),
        ("Không có căn cứ.", False, "does not contain"),
        ("", False, "empty"),
    ],
)
def test_citations(spark, answer, ok, part):
    rows = spark.createDataFrame([(answer, ARTICLES)], "a string, articles array<struct<number:string,law_id:string>>")
    told = rows.select(citations.check(F.col("a"), F.col("articles")).alias("c")).first()["c"]
    assert told["ok"] is ok and part in told["detail"]


def by_definition(text, laws):
    """(number, law) of each mention: of all laws between which and the mention neither a clause ends nor another mention stands, the one with the least (side, distance)."""
    mentions = [(m.start(), m.end(), m[1].lower()) for m in re.finditer(r"\bĐiều\s+(\d+[a-zđ]?)", text, re.IGNORECASE)]
    ends = [m.start() for m in re.finditer(r"[\n;]|\.(?=\s|$)", text)]
    ids = [(m.start(), m.end(), re.sub(r"\s+", "", m[0]).upper()) for m in re.finditer(r"\d+ */ *(?:\d{4} */ *)?[A-ZĐa-zđ][\w\-]*", text)]
    ids = [x for x in ids if x[2] in laws or re.fullmatch(r"\d{1,4}/(?:\d{4}/)?[A-ZĐ][A-ZĐ0-9\-]*", x[2])]
    out = []
    for start, end, number in mentions:
        best = None
        for low, high, law in ids:
            between = (high, start) if high <= start else (end, low)
            if between[1] - between[0] > 100 or any(between[0] <= e < between[1] for e in ends) or any(between[0] <= m[0] < between[1] for m in mentions):
                continue
            opened = text[:start].rstrip().endswith("(")
            key = ((high <= start) != opened, between[1] - between[0], law)
            best = min(best or key, key)
        out.append((number, best and best[2]))
    return out


def test_citations_by_definition(spark):
    rng = random.Random(4)
    parts = ["Điều 5", "điều 17a", "Điều  6", "59/2020/QH14", "01 / 2021 / NĐ-CP", "7/x", "12/QĐ", "(", ")", ".", ". ", ";", "\n", " và ", "3.5", "Luật " * 25, ", theo ", "1/Điều 9", ""]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(600)] + [None, "Điều 5" * 400]
    laws = ["7/X", "59/2020/QH14"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    for r in rows.select("k", citations.cited(F.coalesce("t", F.lit("")), F.array(*map(F.lit, laws))).alias("c")).collect():
        assert [tuple(x) for x in r["c"]] == by_definition(texts[r["k"]] or "", laws), texts[r["k"]]


EVIDENCE_TYPE = "array<struct<law_id:string,number:string,title:string,content:string>>"


@pytest.mark.parametrize(
    ("answer", "title", "content", "faulty"),
    [
        ("Theo Điều 5 Luật 59/2020/QH14.", "Vốn", "", False),
        ("Theo Điều 8 Luật 59/2020/QH14.", "Vốn", "Thực hiện theo Điều 8 của Luật này.", False),
        ("Theo Điều 9 Luật 59/2020/QH14.", "Vốn", "Thực hiện theo Điều 8 của Luật này.", True),
        ("Theo Điều 3 Luật 59/2020/QH14.", "Điều 3 Vốn", "", False),
        ("Theo Điều 5a Luật 59/2020/QH14.", "Vốn", "Điều 5. Nội dung", True),
        ("Theo Điều 99 Luật khác (99/2099/QH99).", "Vốn", "Tham chiếu Điều 99 Luật khác 99/2099/QH99.", False),
        ("Theo Điều 99 Luật khác (99/2099/QH99).", "Vốn", "Tham chiếu Điều 99 Luật khác." + " x" * 200 + " 99/2099/QH99", True),
        ("Theo Điều 99 Luật khác (99/2099/QH99).", "Vốn", None, True),
        ("Theo Điều 99.", "Vốn", "", False),
        ("Theo quy định pháp luật.", "Vốn", "", False),
        (" ", "Vốn", "", True),
        (None, None, None, True),
    ],
)
def test_answers_that_must_be_made_again(spark, answer, title, content, faulty):
    rows = spark.createDataFrame([(answer, [("59/2020/QH14", "Điều 5", title, content)])], f"a string, e {EVIDENCE_TYPE}")
    told = rows.select(citations.fault(F.col("a"), F.col("e")).alias("f")).first()["f"]
    assert (told is not None) is faulty and (not faulty or told in (citations.EMPTY,) or "not present" in told)


def test_result_row_problems(spark):
    good = ("1", "q", "Điều 5", ["l|n"], ["l|n|Điều 5"])
    rows = [good, ("2", None, "Điều 5", ["l|n"], ["l|n|Điều 5"]), ("x", "q", "không", ["l"], ["l|n|5"]), ("3", "q", "Điều 1", [], []), ("3", "q", "Điều 1", [], [])]
    found = sorted((r["id"], r["problem"]) for r in answers.problems(spark.createDataFrame(rows, "id string, question string, answer string, relevant_docs array<string>, relevant_articles array<string>")).collect())
    assert found == [("2", "missing field"), ("3", "id is repeated"), ("3", "id is repeated"), ("x", "answer cites no article"), ("x", "bad article reference"), ("x", "bad document reference"), ("x", "id is not an integer")]


# --- models: clients, analysis, generation, collective selection ------------------------------


def test_retries_transient_errors_only():
    from rankloom.sources import clients

    waits, calls = [], []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise ConnectionError("connection reset by peer")
        return x + 1

    assert clients.Retrying(flaky, sleep=waits.append, base=1.0, longest=1.5)(1) == 2 and waits == [1.0, 1.5]
    logins = []
    with pytest.raises(ValueError):
        clients.Retrying(lambda: (_ for _ in ()).throw(ValueError("bad request 400")), sleep=waits.append)()
    with pytest.raises(RuntimeError):
        clients.Retrying(lambda: (_ for _ in ()).throw(RuntimeError("401 UNAUTHENTICATED")), attempts=2, sleep=waits.append, refresh=lambda: logins.append(1))()
    expired = type("Expired", (Exception,), {"code": 401})
    with pytest.raises(expired):
        clients.Retrying(lambda: (_ for _ in ()).throw(expired("no login")), attempts=3, sleep=waits.append, refresh=lambda: logins.append(1))()
    assert logins == [1, 1, 1] and clients.may_retry(RuntimeError("429 rate")) and not clients.may_retry(RuntimeError("401"))


def test_embeddings_and_pair_scores(spark):
    from rankloom.sources import clients

    rows = spark.createDataFrame([(1, "Điều kiện", "chủ đề", ["một ý", "hai"])], "qid long, query string, topic string, intents array<string>")
    told = clients.embed_analysis(rows, clients.HashEmbedder(8)).orderBy("kind", "position").collect()
    assert [(r["kind"], r["position"]) for r in told] == [("intent", 0), ("intent", 1), ("query", 0), ("topic", 0)]
    assert all(math.isclose(sum(x * x for x in r["embedding"]), 1) for r in told)
    both = [clients.embed(spark.createDataFrame([(unicodedata.normalize(f, "thành lập"),)], "t string"), F.col("t"), clients.HashEmbedder(8)).first()["embedding"] for f in ("NFC", "NFD")]
    assert both[0] == both[1]
    pairs = spark.createDataFrame([(k, "a b", "a c" if k % 2 else None) for k in range(70)], "in0 int, q string, t string").coalesce(1)
    scored = clients.pair_scores(pairs, F.col("q"), F.col("t"), size=32)
    assert scored.columns == ["in0", "q", "t", "score"] and {r["in0"]: r["score"] for r in scored.collect()} == {k: 0.5 * (k % 2) for k in range(70)}
    assert [clients.as_score(x) for x in (1, "2.5", {"score": 3}, [[4.0]], {"relevance_score": [5]})] == [1, 2.5, 3, 4, 5]
    with pytest.raises(Exception, match="1 answers to 2 inputs"):
        clients.pair_scores(pairs.limit(2), F.col("q"), F.col("t"), lambda p: [1.0]).collect()


def test_analysis_salvages_repairs_and_refuses(spark):
    from rankloom.operators import analysis

    assert analysis.read_intents('```json\n{"intents": ["x", "Y", "X ", "", "z"]}\n```') == ["x", "Y", "z"] and analysis.read_intents("no") == []
    assert analysis.read_rewrite('says {"rewritten_query": "a\\"b", "topic_description": "t", oops') == ('a"b', "t") and analysis.read_rewrite('{"rewritten_query": "a"}') is None

    def client(kind, query):
        if query == "down":
            raise OSError("gone")
        if query == "broken" and kind == "rewrite":
            return "nothing"
        return json.dumps({"rewritten_query": f"{kind} {query}", "topic_description": "t", "intents": [query, query.upper(), "more"]})

    asked = spark.createDataFrame([(1, "fine"), (2, "broken"), (3, "down")], "qid long, query string")
    lenient = {r["qid"]: r for r in analysis.analyse(asked, client).collect()}
    assert (lenient[1]["rewritten"], lenient[1]["intents"], lenient[1]["error"]) == ("rewrite fine", ["fine", "more"], None)
    assert (lenient[2]["rewritten"], lenient[2]["topic"]) == ("broken", "") and lenient[3]["intents"] == ["down"] and "gone" in lenient[3]["error"]
    strict = {r["qid"]: r["rewritten"] for r in analysis.analyse(asked, client, strict=True).collect()}
    assert strict == {1: "rewrite fine", 2: "repair broken"}


EVIDENCE = [{"law_id": "1/2020/QH14", "law_type": "Luật", "law_name": "Doanh nghiệp", "number": "Điều 5", "title": "T", "content": "Nội dung."}]


def test_one_repair_of_unsupported_citations(spark):
    from rankloom.operators import generate

    good, bad = "Theo Điều 5 Luật 1/2020/QH14.", "Theo Điều 99 Luật 1/2020/QH14."

    def client(prompt):
        if prompt == "down":
            raise OSError("gone")
        if prompt.startswith("{"):
            data = json.loads(prompt)
            return "" if data["prompt"] == "empty" else f"Theo {data['allowed_citations'][0]}."
        return good if prompt == "good" else bad

    rows = [(k, f"s{k}", "q", p, [tuple(EVIDENCE[0].values())], ["Điều 5 (1/2020/QH14)"]) for k, p in enumerate(("good", "bad", "empty", "down"))]
    jobs = spark.createDataFrame(rows, f"qid long, signature string, question string, prompt string, articles {generate.FIELDS}, labels array<string>")
    told = {r["qid"]: r for r in generate.answer(jobs, client).collect()}
    assert (told[0]["answer"], told[0]["repaired"]) == (good, False) and (told[1]["answer"], told[1]["repaired"]) == ("Theo Điều 5 (1/2020/QH14).", True)
    assert told[2]["answer"] is None and "empty" in told[2]["error"] and "gone" in told[3]["error"]
    assert {r["qid"] for r in generate.answer(jobs, client, strict=True).collect()} == {0, 1}
    cache = spark.createDataFrame([(0, "s0", good, False), (1, "old", good, False), (2, "s2", bad, True), (3, "s3", bad, None)], "qid long, signature string, answer string, repaired boolean")
    assert {r["qid"] for r in generate.cached(jobs, cache).collect()} == {0, 2}


def test_parts_cards_and_answers_without_search(spark):
    from rankloom.operators import generate

    part = one(spark, "**Kết luận**\n- Được phép.\n\n**Căn cứ**\nĐiều 5", generate.parts)
    assert (part["conclusion"], part["has_conclusion"]) == ("Được phép.", True) and "Được phép" not in part["analysis"] and "Điều 5" in part["analysis"]
    assert one(spark, None, generate.parts)["has_conclusion"] is False
    asked = spark.createDataFrame([(1, " chào ", "small_talk"), (2, "thời tiết", "out_of_scope"), (3, "luật", "legal")], "qid long, question string, route string")
    told = {r["qid"]: r for r in generate.without_search(asked, lambda q: f"{q}!").collect()}
    assert set(told) == {1, 2} and told[1]["answer"] == "chào!" and told[2]["answer"] == generate.OUTSIDE and told[2]["relevant_articles"] == []
    answers_ = spark.createDataFrame([(1, "a")], "qid long, answer string")
    refs = spark.createDataFrame([(1, 2, "x"), (1, 1, "y")], "qid long, position int, article string")
    known = spark.createDataFrame([("x", "law", "Điều 1", "t", "c" * 400)], "article string, law_name string, number string, title string, content string")
    shown = generate.cards(answers_, refs, known).first()
    assert [(c["article"], len(c["preview"])) for c in shown["cards"]] == [("x", 280)] and shown["warnings"] == ["unknown article y"]


def test_collective_rounds_repair_and_fallback(spark):
    from rankloom.operators import collective

    rows = [(q, p, f"q{q}", "Luật", "n", f"{q}-{p}", "keep" if p % 3 == 0 else "drop") for q, n in ((1, 1), (2, 4), (3, 14), (4, 3), (5, 9)) for p in range(n)]
    candidates = spark.createDataFrame(rows, "qid long, position int, question string, law_type string, law_name string, article string, content string")

    def client(payload):
        data = json.loads(payload)
        if data["question"] == "q4":
            return "not json"
        if data["question"] == "q5":
            raise OSError("gone")
        keys = [c["key"] for c in data["candidate_articles"] if c["content"] == "keep"]
        return json.dumps({"selected_article_keys": keys if len(data["candidate_articles"]) != 5 else keys[1:], "confidence": "high"})

    plain = {r["qid"]: r for r in collective.select_together(candidates, client).collect()}
    assert (plain[1]["selected"], plain[1]["path"]) == (["1-0"], "skipped") and (plain[2]["selected"], plain[2]["path"]) == (["2-0", "2-3"], "direct")
    assert plain[3]["path"] == "rounds" and plain[3]["selected"] == ["3-3", "3-6", "3-9", "3-12"] and not plain[3]["failed"]
    assert (plain[4]["selected"], plain[4]["failed"]) == (["4-0"], True) and (plain[5]["selected"], plain[5]["failed"]) == (["5-0"], True)
    repaired = collective.select_together(candidates.where("qid = 4"), client, repair=lambda p: json.dumps({"selected_article_keys": json.loads(p)["allowed_keys"][1:2]})).first()
    assert (repaired["selected"], repaired["failed"]) == (["4-1"], False)
