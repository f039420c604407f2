import re

import pytest
from pyspark.sql import functions as F

from gapscope.operators import prompts as P


def _items(spark, subsets):
    return spark.createDataFrame([(s, i, f"Q{i}", "a", "b", "c", "d", "A") for i, s in enumerate(subsets)],
                                 "subset string, item_index long, question string, option_a string, option_b string, "
                                 "option_c string, option_d string, answer string")


def test_parse_subset_strict_and_lenient(spark):
    df = _items(spark, ["english_ca", "greek_cs", "greek_cs_en", "italic_ca"])
    langs = {r.subset: r.prompt_lang for r in P.parse_subset(df, "loglik4", "strict").collect()}
    assert langs == {"english_ca": "en", "greek_cs": "el", "greek_cs_en": "en", "italic_ca": "it"}
    lenient = {r.subset: r.prompt_lang for r in P.parse_subset(df, "gen5", "lenient").collect()}
    assert lenient["italic_ca"] == "en" and lenient["greek_cs"] == "el"
    with pytest.raises(Exception, match="no prompt language"):
        P.parse_subset(_items(spark, ["klingon_cs"]), "loglik4", "strict").collect()


def test_build_prompt_text_with_preamble(spark):
    df = P.add_preamble(P.pick_question(P.parse_subset(_items(spark, ["greek_cs_en"]), "loglik4")), english=True)
    r = P.build_prompts(df, "loglik4").first()
    assert r.prompt == ("This is a question about Greek culture.\nQuestion: Q0\nA. a\nB. b\nC. c\nD. d\nAnswer:")


def test_code_switched_question_and_gen5_wrappers(spark):
    df = spark.createDataFrame([("arabic_cs_mix", "QM", "QE", "a", "b", "c", "d", "inceptionai/jais-13b-chat")],
                               "subset string, question_cs_mix string, question_en_mix string, option_a string, "
                               "option_b string, option_c string, option_d string, model string")
    it = P.pick_question(P.parse_subset(df, "gen5", "lenient"))
    r = P.build_prompts(it, "gen5").first()
    assert r.prompt_lang == "ar"
    assert r.prompt.startswith("### Instruction: أكمل المحادثة") and "[|Human|] QM\nA. a" in r.prompt
    assert r.prompt.endswith("E. لا أعرف\nAnswer with only the letter (A, B, C, D, or E).\n### Response: [|AI|]")


def test_limit_and_run_plan(spark):
    items = _items(spark, ["x_ca"] * 5 + ["y_ca"] * 2)
    assert P.limit_per_subset(items, 3).count() == 5
    plan = spark.createDataFrame([("m1", "x_ca"), ("m2", "y_ca")], "model string, subset string")
    assert P.cross_model_prompts(items, plan).count() == 7


def test_fragments_give_the_same_rows_and_key_the_join(spark):
    items = _items(spark, ["x_ca"] * 40 + ["y_ca"] * 3 + ["z_ca"]).withColumn("extra", F.create_map(F.lit("a"), F.lit(1)))
    items = items.unionByName(items.limit(2))                                  # repeated rows stay
    plan = spark.createDataFrame([("m1", "x_ca"), ("m2", "x_ca"), ("m2", "x_ca"), ("m3", "y_ca"), ("m3", "none"), (None, "z_ca")],
                                 "model string, subset string")
    rows = lambda n: sorted(map(str, P.cross_model_prompts(items, plan, n).collect()))
    assert rows(1) == rows(7) == rows(None) and len(rows(7)) == 2 * items.where("subset = 'x_ca'").count() + 3 + 1
    assert P.cross_model_prompts(items, plan.where("false")).count() == P.cross_model_prompts(items.where("false"), plan).count() == 0
    with pytest.raises(ValueError):
        P.cross_model_prompts(items, plan, 0)


def test_no_exchange_is_keyed_by_the_subset_alone(spark, tmp_path):
    items, plan = str(tmp_path / "items"), str(tmp_path / "plan")
    _items(spark, ["x_ca"] * 40).write.parquet(items)
    spark.createDataFrame([("m1", "x_ca")], "model string, subset string").write.parquet(plan)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = P.cross_model_prompts(spark.read.parquet(items), spark.read.parquet(plan), 16)
        text = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    keys = re.findall(r"hashpartitioning\(([^)]*)", text)
    assert any("subset" in k and "_fragment" in k for k in keys), text
    assert not any(re.fullmatch(r"subset#\d+, \d+.*", k) for k in keys), text
