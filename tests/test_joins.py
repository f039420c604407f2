from pyspark.sql import functions as F

from gapscope.operators import joins as J
from tests.conftest import rows

SC = "file string, model string, subset string, metric string, value double, pos long"


def test_overlay_overrides_all_keys_and_ignores_orphans(spark):
    base = spark.createDataFrame([("f1", "m1", "english_ca", "accuracy", 0.5, 0),
                                  ("f1", "m1", "chinese_cs", "accuracy", 0.4, 1)], SC)
    over = spark.createDataFrame([("f1", "m1", "chinese_cs", "accuracy", 0.9, 0),
                                  ("f2", "m2", "english_ca", "accuracy", 0.1, 0)], SC)
    out = rows(J.overlay_scores(base, over), "file", "subset", "value")
    assert out == [("f1", "chinese_cs", 0.9), ("f1", "english_ca", 0.5)]


def test_upsert_scores_idempotent(spark):
    old = spark.createDataFrame([("f", "m", "a_ca", "accuracy", 0.1, 0), ("f", "m", "a_cs", "accuracy", 0.2, 1)], SC)
    new = spark.createDataFrame([("f", "m", "a_cs", "accuracy", 0.7, 0)], SC)
    once = J.upsert_scores(old, new)
    twice = J.upsert_scores(once, new)
    assert rows(once) == rows(twice)
    assert dict(rows(once, "subset", "value")) == {"a_ca": 0.1, "a_cs": 0.7}


def test_upsert_predictions_drops_all_old_records(spark):
    S = "model string, subset string, item long"
    old = spark.createDataFrame([("m", "x_cs", 1), ("m", "x_cs", 2), ("m", "y_cs", 1)], S)
    new = spark.createDataFrame([("m", "x_cs", 9)], S)
    assert rows(J.upsert_predictions(old, new)) == [("m", "x_cs", 9), ("m", "y_cs", 1)]


def test_split_covers_input(spark):
    df = spark.createDataFrame([("f", "m", s, "accuracy", 0.1, 0) for s in
                                ["a_ca", "a_cs", "a_cs_en", "english_ca"]], SC)
    sp = J.split_by_suffix(df)
    assert sp.count() == df.count()
    assert rows(sp.where("side = 'cs_en'"), "subset") == [("a_cs_en",)]


def test_merge_cs_en_scores_keeps_en_only_locale(spark):
    cs = spark.createDataFrame([("f", "m", "greek_cs", "accuracy", 0.5, 0)], SC)
    en = spark.createDataFrame([("f", "m", "greek_cs_en", "accuracy", 0.6, 0),
                                ("f", "m", "hindi_cs_en", "accuracy", 0.7, 1)], SC)
    out = rows(J.merge_cs_en_scores(cs, en), "subset", "value")
    assert out == [("greek_cs", 0.5), ("greek_cs_en", 0.6), ("hindi_cs_en", 0.7)]
    # with a ref file restricting to greek
    ref = spark.createDataFrame([("f", "m", "greek_cs", "accuracy", 0.0, 0)], SC)
    assert rows(J.merge_cs_en_scores(cs, en, ref), "subset") == [("greek_cs",), ("greek_cs_en",)]


def test_merge_cs_en_predictions_drops_en_only(spark):
    P = "file string, model string, subset string, pos long"
    cs = spark.createDataFrame([("f", "m", "greek_cs", 0), ("f", "m", "greek_cs", 1)], P)
    en = spark.createDataFrame([("f", "m", "greek_cs_en", 0), ("f", "m", "hindi_cs_en", 1)], P)
    out = J.merge_cs_en_predictions(cs, en).orderBy("file", "group_pos", "side", "pos")
    assert [(r.subset, r.side) for r in out.collect()] == [("greek_cs", 0), ("greek_cs", 0), ("greek_cs_en", 1)]


def test_attach_ca(spark):
    S = "file string, model string, subset string, value double"
    cs = spark.createDataFrame([("f", "m", "greek_cs", 0.5), ("f", "m", "greek_cs_en", 0.6),
                                ("f", "m", "greek_ca", 0.1), ("f", "m", "other_key", 0.9)], S)
    ca = spark.createDataFrame([("f", "m", "greek_ca", 0.8), ("f", "m", "english_ca", 0.7),
                                ("f", "m", "hindi_ca", 0.3)], S)
    out = dict(rows(J.attach_ca(cs, ca), "subset", "value"))
    assert out == {"english_ca": 0.7, "greek_ca": 0.8, "greek_cs": 0.5, "greek_cs_en": 0.6}


def test_model_names_come_from_the_base_file(spark):
    base = spark.createDataFrame([("f", "m/base", "greek_cs", "accuracy", 0.5, 3), ("f", "m/base", "hindi_cs", "accuracy", 0.4, 1)], SC)
    other = spark.createDataFrame([("f", "local/m", "greek_cs_en", "accuracy", 0.6, 0), ("f", "local/m", "hindi_cs_en", "accuracy", 0.7, 2),
                                   ("f", "local/m", "korean_cs_en", "accuracy", 0.1, 1), ("f", "local/m", "greek_cs", "accuracy", 0.9, 5)], SC)
    assert {r.model for r in J.overlay_scores(base, other).collect()} == {"m/base"}
    out = J.merge_cs_en_scores(base, other.where("subset <> 'greek_cs'")).orderBy("file", "metric", "group_side", "group_pos", "side", "pos").collect()
    assert [r.subset for r in out] == ["hindi_cs", "hindi_cs_en", "greek_cs", "greek_cs_en", "korean_cs_en"]
    assert {r.model for r in out} == {"m/base"}


def test_overlay_of_staged_columns_is_not_broadcast(spark):
    # compressed columns look small: a broadcast would bring all keys of the files to the driver
    from gapscope.session import staged
    side = lambda n: staged(spark.range(n).selectExpr("'f' || id % 50 AS file", "'m' || id % 50 AS model", "'accuracy' AS metric",
                                                      "'s' || floor(id / 50) AS subset", "id / 7 AS value"))
    base, over = side(1000), side(400)
    out = J.overlay_scores(base, over.withColumn("value", F.lit(9.0)).withColumn("model", F.lit("x")))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and plan.count("SortMergeJoin") >= 2
    got = rows(out, "file", "model", "subset", "value")
    assert len(got) == 1000 and sum(r[-1] == 9.0 for r in got) == 400 and all(r[1] == "m" + r[0][1:] for r in got)
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
