"""Very long texts stay cheap: no operator slows down more than in proportion."""

import time

import pytest

from colloquy.llm import common as C
from colloquy.llm import defects, leak, lookalike, pii

UNITS = ["订单物流退款", "paper order ", "1380083302", "a-", "a@", "王李张", "寄到 12号 ", " at ", "1.", "a", "Ab "]


@pytest.mark.parametrize("unit", UNITS)
def test_long_texts(unit):
    text = (unit * 100_000)[:100_000]
    matcher = leak.Matcher([(1, "订单物流退款发票尺寸颜色质量客服地址电话")])
    for work in (lambda: pii.spans(text), lambda: defects.features(text[:500], text), lambda: list(matcher.find([C.fold(text)], 0.4)), lambda: C.grams3(C.fold(text)), lambda: lookalike.skeleton(text)):
        began = time.time()
        work()
        assert time.time() - began < 5


def test_long_text_in_canonical_form(spark):
    text = "订单,paper " * 20_000 + "рaper​"
    df = spark.createDataFrame([(1, text), (2, text.replace("р", "p").replace("​", ""))], "doc_id long, text string")
    got = {r["doc_id"]: r["canonical"] for r in lookalike.canonical_texts(df).collect()}
    assert got[1] == got[2]
