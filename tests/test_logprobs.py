import math

import pytest
from pyspark.sql import functions as F

from gapscope.operators import logprobs as L


def _tokens(spark, bad_model=False):
    rows = []
    for m in ["m1", "m2"]:
        for i, letter in enumerate("ABCD"):
            rows.append((m, " ", letter, [i]))
            rows.append((m, "", letter, [4 + i] if not (m == "m2" and letter == "C") else [4, 9]))
    if bad_model:
        rows += [("m3", " ", x, [1, 2]) for x in "ABCD"]
    return spark.createDataFrame(rows, "model string, prefix string, letter string, token_ids array<int>")


def test_log_softmax(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "x array<double>")
    lp = df.select(L.log_softmax("x").alias("lp")).first().lp
    assert sum(math.exp(v) for v in lp) == pytest.approx(1.0)
    assert lp[2] - lp[1] == pytest.approx(1.0)


def test_resolve_variants(spark):
    v = L.resolve_variants(_tokens(spark), "all")
    got = sorted((r.model, r.prefix) for r in v.select("model", "prefix").distinct().collect())
    assert got == [("m1", ""), ("m1", " "), ("m2", " ")]      # m2's "" prefix has a two-token letter
    first = L.resolve_variants(_tokens(spark), "first").select("model", "prefix").distinct().collect()
    assert sorted((r.model, r.prefix) for r in first) == [("m1", " "), ("m2", " ")]
    with pytest.raises(Exception, match="no single-token answer letters"):
        L.resolve_variants(_tokens(spark, bad_model=True), "all").collect()


def test_argmax_tie_goes_to_earliest_prefix(spark):
    logits = [0.0] * 10
    logits[1] = 5.0      # " B"
    logits[5] = 5.0      # "B" (same log-prob, later prefix)
    resp = spark.createDataFrame([("m1", "s", 0, "B", logits)],
                                 "model string, subset string, pos long, gold string, logits array<double>")
    r = L.score_logprobs(resp, L.resolve_variants(_tokens(spark), "all")).first()
    assert (r.argmax_prefix, r.pred, r.argmax_token_id) == (" ", "B", 1)
    assert r.argmax_is_top1 and r.argmax_is_top5
    assert r.gold_prob == pytest.approx(math.exp(5) / (math.exp(5) + 3))


def test_five_letters_can_be_scored(spark):
    letters = list("ABCDE")
    tokens = spark.createDataFrame([("m", p, c, [i + (5 if p else 0)]) for p in ("", " ") for i, c in enumerate(letters)],
                                   "model string, prefix string, letter string, token_ids array<int>")
    logits = spark.createDataFrame([("m", "s", 0, "A", [1.0, 0.0, 0.0, 0.0, 9.0] + [0.5] * 7)], "model string, subset string, pos long, gold string, logits array<double>")
    five = L.score_logprobs(logits, L.resolve_variants(tokens, "first", letters)).first()
    assert five.pred in ("A", "B", "C", "D", "E") and L.resolve_variants(tokens, "all", letters).count() == 10
    assert L.score_logprobs(logits, L.resolve_variants(tokens, "all", letters)).first().pred == "E"
    assert L.score_logprobs(logits, L.resolve_variants(tokens, "all")).first().pred == "A"
    top = [(t.rank, t.token_id) for t in five.top_tokens]
    assert top == [(1, 4), (2, 0), (3, 5), (4, 6), (5, 7)]


def test_no_row_with_logits_is_shuffled(spark):
    import re

    from gapscope.plans.catalog import QUERIES
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for name, scans in (("argmax_option", 1), ("probe_rates", 1), ("worst_cases", 2)):
            plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
            exchanges = [line for line in plan.splitlines() if re.search(r"\bExchange ", line)]
            assert exchanges and not any("logits" in line or "embedding" in line for line in exchanges)
            assert len(re.findall(r"Scan parquet .*ReadSchema: struct<[^>]*embedding", plan)) == scans
            for line, following in zip(plan.splitlines(), plan.splitlines()[1:]):
                assert not (re.search(r"\bExchange ", line) and re.search(r"Project \[.*embedding#\d+ AS logits", following))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_resolved_models(spark):
    got = {r.model: ([(v.prefix, v.letter, v.token_id) for v in r.variants], r.used_prefix) for r in L.resolve_models(_tokens(spark)).collect()}
    assert got["m1"] == ([(" ", c, i) for i, c in enumerate("ABCD")] + [("", c, 4 + i) for i, c in enumerate("ABCD")], " ")
    assert got["m2"] == ([(" ", c, i) for i, c in enumerate("ABCD")], " ")
    with pytest.raises(Exception, match="no single-token answer letters"):
        L.resolve_models(_tokens(spark, bad_model=True)).collect()
