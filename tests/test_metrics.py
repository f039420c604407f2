import math

import pytest
from pyspark.sql import functions as F

from gapscope.operators import metrics as M
from gapscope.operators.scoring import score_choice
from tests.conftest import rows


def _resp(spark, data):
    return spark.createDataFrame(data, "model string, subset string, gold string, pred string")


def test_subset_metrics_rules(spark):
    df = _resp(spark, [
        ("m", "s1", "A", "A"), ("m", "s1", "B", "E"), ("m", "s1", "C", ""), ("m", "s1", "D", None),
        ("m", "s2", "A", "E"), ("m", "s2", "B", "E"),          # nothing attempted -> cond_acc 0.0
    ])
    out = {r["subset"]: r for r in M.subset_metrics(score_choice(df)).collect()}
    s1 = out["s1"]
    assert (s1.n, s1.n_correct, s1.n_abstained, s1.n_conf_wrong) == (4, 1, 1, 2)  # '' and null are conf-wrong
    assert s1.accuracy == 0.25 and s1.abstain_rate == 0.25 and s1.conf_err_rate == 0.5
    assert s1.cond_acc == pytest.approx(1 / 3)
    assert out["s2"].cond_acc == 0.0
    assert M.metric_identity_check(M.subset_metrics(score_choice(df))).count() == 0


def _long(spark, data):
    df = spark.createDataFrame(data, "model string, country string, subset string, value double")
    return M.with_subset_parts(df.withColumn("metric", F.lit("accuracy")))


def test_gap_example_and_missing(spark):
    long = _long(spark, [
        ("m/a", "China", "english_ca", 0.71), ("m/a", "China", "chinese_ca", 0.66),
        ("m/a", "China", "chinese_cs", 0.58), ("m/a", "China", "chinese_cs_en", 0.55),
        ("m/b", "USA", "english_ca", 0.5), ("m/b", "USA", "chinese_ca", 0.4),   # b lacks chinese_cs*
        ("m/a", "China", "greek_ca", 0.3),                                     # greek incomplete anywhere
    ])
    g = {r["model"]: r for r in M.accuracy_gaps(long).collect()}
    assert set(r["locale"] for r in M.accuracy_gaps(long).collect()) == {"chinese"}
    a = g["m/a"]
    assert round(a.global_gap, 4) == -0.05 and round(a.local_gap, 4) == 0.03 and round(a.knowledge_gap, 4) == 0.08
    assert g["m/b"].local_gap is None and g["m/b"].knowledge_gap is None
    assert g["m/b"].global_gap == pytest.approx(-0.1)


def test_hallucination_gap(spark):
    df = spark.createDataFrame([("m", "c", "hindi_cs", 0.2), ("m", "c", "hindi_cs_en", 0.35)],
                               "model string, country string, subset string, value double")
    long = M.with_subset_parts(df.withColumn("metric", F.lit("conf_err_rate")))
    r = M.hallucination_gap(long).collect()
    assert len(r) == 1 and r[0].hall_gap == pytest.approx(0.15)


def test_drop_low_models(spark):
    df = spark.createDataFrame([("a", "x_ca", "0.1"), ("a", "y_ca", "0.3"), ("b", "x_ca", "0.1"),
                                ("c", "x_ca", "n/a"), ("c", "y_ca", None)],
                               "model string, subset string, value string")
    long = df.withColumns({"metric": F.lit("accuracy"), "country": F.lit("U")})
    kept = {r.model for r in M.drop_low_models(long, 0.25).collect()}
    assert kept == {"a"}
    rep = M.drop_low_report(long, 0.25).first()
    assert (rep.removed, rep.kept) == (2, 1)
    assert {r.model for r in M.drop_low_models(long, 0.0).collect()} == {"a", "b"}   # all-missing row removed


def test_gap_plans_run_nothing_until_asked(spark):
    long = _long(spark, [("m", "c", "english_ca", 0.5), ("m", "c", "greek_ca", 0.4), ("m", "c", "greek_cs", 0.3),
                         ("m", "c", "greek_cs_en", 0.2), ("m", "c", "hindi_ca", 0.2), ("m", "c", "hindi_cs", None), ("m", "c", "hindi_cs_en", 0.1)])
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("gap-plan", "no job while planning")
    out = M.accuracy_gaps(long)
    assert not tracker.getJobIdsForGroup("gap-plan")
    assert [r.locale for r in out.collect()] == ["greek"]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
