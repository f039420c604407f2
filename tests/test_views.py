import pytest
from pyspark.sql import functions as F

from gapscope import dims as D
from gapscope.operators import gapstats as A
from gapscope.operators import ranking as K
from gapscope.operators import reshape as R
from tests.conftest import rows

GL = ("model string, country string, locale string, english_ca double, local_ca double, local_cs double, "
      "cs_en double, global_gap double, local_gap double, knowledge_gap double")


def _gl(spark, data):
    return spark.createDataFrame([(m, c, l, None, None, None, None, g, lg, k) for m, c, l, g, lg, k in data], GL)


def test_native_gaps_default_and_multi(spark):
    gl = _gl(spark, [("m1", "Southeast Asian", "hindi", 0.1, 0.2, 0.1), ("m2", "USA", "greek", 0.3, 0.1, -0.2),
                     ("m3", "China", "chinese", 0.0, 0.1, 0.1)])
    out = A.native_gaps(gl, D.dim_country_native(spark))
    langs = {}
    for r in out.collect():
        langs.setdefault(r.model, []).append(r.language)
    assert sorted(langs["m1"]) == sorted(["chinese", "hindi", "indonesian", "korean"])
    assert sorted(langs["m2"]) == sorted(D.DEFAULT_NATIVE_LOCALES)        # unmapped: 5, not indonesian
    assert langs["m3"] == ["chinese"]
    m2_greek = [r for r in out.collect() if r.model == "m2" and r.language == "greek"][0]
    assert m2_greek.knowledge_gap == -0.2
    assert [r for r in out.collect() if r.model == "m2" and r.language == "hindi"][0].global_gap is None


def test_home_locale_cells(spark):
    gl = _gl(spark, [("m", "Qatar", "arabic", 0.1, 0.2, 0.1), ("m", "Qatar", "greek", 0.1, 0.2, 0.1)])
    home = {(r.locale, r.gap): r.is_home for r in A.home_locale_cells(gl, D.dim_home_locale(spark)).collect()}
    assert home[("arabic", "global_gap")] and not home[("greek", "knowledge_gap")]


def test_extreme_models_nulls_and_dedupe(spark):
    data = [(f"m{i}", "X", "greek", 0.0, 0.0, float(i)) for i in range(4)] + [("mz", "X", "greek", 0.0, 0.0, None)]
    out = K.extreme_models(_gl(spark, data), k=3)
    got = {r.model: (r.is_top, r.is_bottom) for r in out.collect()}
    assert "mz" not in got
    assert got["m3"] == (True, False) and got["m0"] == (False, True) and got["m1"] == (True, True)
    ranked = K.rank_in_locale(out).collect()
    assert [r.model for r in ranked] == ["m3", "m2", "m1", "m0"]


def test_gap_extent_ignores_missing(spark):
    gl = _gl(spark, [("a", "X", "greek", -0.5, None, 0.9), ("b", "X", "greek", None, 0.2, None)])
    r = A.gap_extent(gl).first()
    assert (r.min_global_gap, r.max_local_gap, r.min_all_gaps, r.max_all_gaps) == (-0.5, 0.2, -0.5, 0.9)


def test_order_rows_unknown_last(spark):
    wide = spark.createDataFrame([("zz-unknown", "U"), ("b", "U"), ("a", "U")], "model string, country string")
    dim = spark.createDataFrame([("b", 0), ("a", 1)], "model string, model_ord int")
    assert [r.model for r in R.order_rows(wide, dim).collect()] == ["b", "a", "zz-unknown"]


def test_order_columns_policies(spark):
    wide = spark.createDataFrame([("m", "c", 1.0, 2.0, 3.0, 4.0, 5.0)],
                                 "model string, country string, zulu_x double, greek_cs double, english_ca double, "
                                 "greek_ca double, hindi_cs_en double")
    assert R.order_columns(wide, "canonical").columns == ["model", "country", "english_ca", "greek_ca", "greek_cs",
                                                          "hindi_cs_en", "zulu_x"]
    # triplet: a lone <x>_cs_en has prefix <x>_cs and is dropped; unknown names dropped
    assert R.order_columns(wide, "triplet").columns == ["model", "country", "english_ca", "greek_ca", "greek_cs"]


def test_coverage_and_densify(spark):
    long = spark.createDataFrame([("m", "english_ca", "accuracy", 0.5)], "model string, subset string, metric string, value double")
    assert rows(R.coverage_gaps(long, ["english_ca", "greek_ca"]), "model", "subset") == [("m", "greek_ca")]
    gl = _gl(spark, [("m", "X", "greek", 0.1, 0.1, 0.0)])
    d = R.densify_profile(gl, ["greek", "hindi"])
    assert rows(d, "locale", "knowledge_gap") == [("greek", 0.0), ("hindi", None)]


def test_box_stats_match_pandas(spark):
    import pandas as pd
    vals = [0.1, 0.4, 0.2, 0.9, 0.5]
    gl = _gl(spark, [(f"m{i}", "X", "greek", 0.0, 0.0, v) for i, v in enumerate(vals)])
    r = A.gap_box_stats(gl).first()
    s = pd.Series(vals)
    assert (r.q25, r.median, r.q75) == pytest.approx((s.quantile(.25), s.median(), s.quantile(.75)))
