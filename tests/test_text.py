import pytest
from pyspark.sql import functions as F

from gapscope.operators import shortqa as Q


def _one(spark, col_fn, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(col_fn("x").alias("y")).first().y


@pytest.mark.parametrize("text,choice", [
    ("The answer is B.", "B"), ("  A", "A"), ("ABC", "A"), ("是A。", ""), ("xyz", ""), ("(C) because", "C"),
    ("E", "E"), ("Answer:\nD", "D"),
])
def test_extract_choice(spark, text, choice):
    assert _one(spark, Q.extract_choice, text) == choice


@pytest.mark.parametrize("gen,ans", [
    ("Answer: Paris. It is the capital", "Paris"),
    ("assistant：  “Beijing”\nmore text", "Beijing"),
    ("3.14 is pi", "3"),
    ("  multiple   spaces  here!", "multiple spaces here"),
    ("", ""),
])
def test_short_answer(spark, gen, ans):
    assert _one(spark, Q.short_answer, gen) == ans


@pytest.mark.parametrize("ans,idk", [("", True), ("I don't know", True), ("not  sure", True), ("我不知道", True),
                                     ("unknown", True), ("knot sure", False), ("Paris", False)])
def test_is_abstention(spark, ans, idk):
    assert _one(spark, Q.is_abstention, ans) == idk


def test_match_any(spark):
    df = spark.createDataFrame([
        ("Paris", ["paris"], "entity"), ("", ["x"], "entity"), ("Rome", ["paris"], None),
        ("China and Nepal", ["zz"], "pair"), ("中国和尼泊尔", ["zz"], "pair"), ("china nepal", ["zz"], "entity"),
        ("october 1st", ["October 1"], "set_any"),
    ], "a string, g array<string>, t string")
    got = [r.m for r in df.select(Q.match_any("a", "g", "t").alias("m")).collect()]
    assert got == [True, True, False, True, True, False, True]
    got2 = [r.m for r in df.select(Q.match_any("a", "g", "t", empty_matches=False).alias("m")).collect()]
    assert got2[1] is False


def test_qa_did_missing_cell_is_zero(spark):
    cells = spark.createDataFrame([("m", "global__en", 0.8, 0.1), ("m", "global__zh", 0.6, 0.2),
                                   ("m", "local_cn__zh", 0.5, 0.3)],
                                  "model string, cell string, accuracy double, hallucination_like_rate double")
    r = Q.qa_did(cells).first()
    assert r.did_accuracy == pytest.approx((0.8 - 0.6) - (0.0 - 0.5))
    assert r.cells_present == "global__en,global__zh,local_cn__zh"


def test_gold_strips_all_white_space(spark):
    from gapscope.operators.scoring import normalize_gold
    df = spark.createDataFrame([("\u00a0a\u3000",), (" b\n",), ("\u2003c d\u2028",)], "answer string")
    assert [r.g for r in df.select(normalize_gold().alias("g")).collect()] == ["A", "B", "C D"]
