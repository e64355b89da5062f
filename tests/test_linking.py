"""Answers as segments with their citations linked."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from rankloom.operators import linking

ARTICLES = [("59/2020/QH14", "Doanh nghiệp", "Điều 5"), ("01/2021/NĐ-CP", "Đăng ký doanh nghiệp chi tiết", "Điều 5"), ("45/2019/QH14", "Bộ luật Lao động", "Điều 17a")]
TYPE = "array<struct<law_id:string,law_name:string,number:string>>"


def shown(spark, answer, articles=ARTICLES):
    row = spark.createDataFrame([(answer, articles)], f"a string, x {TYPE}").select(linking.blocks(F.col("a"), F.col("x")).alias("b")).first()
    return [[(s["kind"], s["text"], s["article"] if s["kind"] == "citation" else s["level"]) for s in line] for line in row["b"]]


@pytest.mark.parametrize(
    ("answer", "expected"),
    [
        ("Theo Điều 5 thì được.", [("text", "Theo ", None), ("citation", "Điều 5", 1), ("text", " thì được.", None)]),
        ("Theo khoản 2 Điều 5 Nghị định 01/2021/NĐ-CP, được.", [("text", "Theo ", None), ("citation", "khoản 2 Điều 5 Nghị định 01/2021/NĐ-CP", 2), ("text", ", được.", None)]),
        ("Điều 5 về đăng ký, doanh nghiệp, chi tiết", [("citation", "Điều 5", 2), ("text", " về đăng ký, doanh nghiệp, chi tiết", None)]),
        ("Luật Doanh nghiệp (Điều 5) quy định", [("citation", "Luật Doanh nghiệp (Điều 5)", 1), ("text", " quy định", None)]),
        ("Điều 17a Bộ luật Lao động và Điều 99", [("citation", "Điều 17a Bộ luật Lao động", 3), ("text", " và ", None), ("text", "Điều 99", None)]),
        ("## **Kết luận**", [("heading", "Kết luận", 2)]),
        ("2. xem `Điều 5` và **đậm**", [("bullet", "2. ", None), ("text", "xem ", None), ("citation", "Điều 5", 1), ("text", " và ", None), ("bold", "đậm", None)]),
        ("* [nguồn](http://x) [A1] <b>đúng</b>", [("bullet", "• ", None), ("text", "nguồn đúng", None)]),
    ],
)
def test_lines(spark, answer, expected):
    assert shown(spark, answer) == [expected]


def test_empty_and_many_lines_lose_nothing(spark):
    assert shown(spark, None) == [[("text", "", None)]] == shown(spark, "")
    assert shown(spark, "Điều 5", None) == [[("text", "Điều 5", None)]] and shown(spark, "Điều 5", []) == [[("text", "Điều 5", None)]]
    text = "Theo Điều 5 và Luật Doanh nghiệp, điểm a khoản 3 Điều 17a.\r\n\r\nHết (Điều 5)" + " rất dài" * 3000
    lines = shown(spark, text)
    assert ["".join(s[1] for s in line) for line in lines] == re.split(r"\r\n", text) and len(lines) == 3
    assert [s[2] for line in lines for s in line if s[0] == "citation"] == [1, 3, 1]
