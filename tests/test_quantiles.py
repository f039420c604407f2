"""Exact quantiles by narrowing, and chunked logits, against plain computations."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapscope.functions.quantiles import order_statistics, quantiles
from gapscope.operators import logprobs as L


def test_quantiles_of_skewed_groups(spark):
    r = random.Random(2)
    groups = {"big": [r.gauss(0, 1) for _ in range(3000)], "same": [2.5] * 40, "one": [7.0], None: [1.0, 2.0, 4.0],
              "wide": [-1.7e308, 1.7e308, 0.0, 1e-300, 5e-324], "close": [1.0 + k * 2.0 ** -52 for k in range(9)] + [1e9]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("big", None), ("empty", None), ("one", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = {x.g: x for x in quantiles(df, ["g"], "v", {"a": 0.1, "m": 0.5, "z": 0.99}).collect()}
    assert got.keys() == groups.keys()
    for g, vs in groups.items():
        assert (got[g].n, got[g].min, got[g].max) == (len(vs), min(vs), max(vs))
        for name, q in (("a", 0.1), ("m", 0.5), ("z", 0.99)):
            s, at = sorted(vs), q * (len(vs) - 1)
            low, high = s[int(np.floor(at))], s[int(np.ceil(at))]
            assert got[g][name] == pytest.approx(low + (high - low) * (at - np.floor(at)), rel=1e-12)


def test_order_statistics_of_few_buckets(spark):
    values = [((i * 7919) % 1009) / 8 for i in range(1009)]
    df = spark.createDataFrame([("x", v) for v in values], "g string, v double")
    wanted = spark.createDataFrame([("x", k) for k in (0, 1, 500, 1008)] + [("none", 0)], "g string, k long")
    got = {r.k: r.value for r in order_statistics(df, ["g"], "v", wanted, buckets=4).collect()}
    assert got == {k: sorted(values)[k] for k in (0, 1, 500, 1008)}


def test_chunked_logits_equal_whole_rows(spark):
    r = np.random.default_rng(3)
    logits = [(i, [float(x) for x in r.normal(scale=s, size=n)]) for i, (n, s) in enumerate([(50, 1), (1, 1), (33, 400), (64, 0)])]
    df = spark.createDataFrame(logits, "id long, logits array<double>")
    chunks = L.to_chunks(df.select("id", F.posexplode("logits").alias("token_id", "logit")), ["id"], 8)
    assert chunks.agg(F.max(F.size("tokens"))).first()[0] == 8
    lp = {(x.id, x.token_id): x.log_prob for x in L.chunked_log_softmax(chunks, ["id"]).collect()}
    top = sorted((x.id, x.rank, x.token_id) for x in L.chunked_top_k(chunks, ["id"], 5).collect())
    plain = df.withColumn("lp", L.log_softmax("logits"))
    assert top == sorted((x.id, x.rank, x.token_id) for x in plain.select("id", F.inline(L.top_k_tokens("lp", 5))).collect())
    for row in plain.collect():
        assert [lp[row.id, k] for k in range(len(row.lp))] == pytest.approx(row.lp, abs=1e-9)
