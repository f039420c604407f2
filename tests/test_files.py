import json
import os
import tempfile

import pytest
from pyspark.sql import types as T

from gapscope.sources import files as S
from tests.conftest import rows


def _write(path, name, obj):
    with open(os.path.join(path, name), "w", encoding="utf-8") as f:
        json.dump(obj, f, ensure_ascii=False, indent=2)


def test_read_scores_reference_layout(spark):
    d = tempfile.mkdtemp()
    _write(d, "m__a_accuracy.json", {"model": "m/a", "accuracy": {"english_ca": 0.71, "chinese_ca": 0.66},
                                     "abstain_rate": {"english_ca": 0.1},
                                     "option_ids_by_prefix": {" ": {"A": 1}}})
    _write(d, "m__b_accuracy.json", {"model": "m/b", "accuracy": {"greek_cs": 0.5}})
    _write(d, "m__b_predictions.json", {"model": "m/b", "predictions": []})      # not matched by the glob
    out = rows(S.read_scores(spark, d).where("subset is not null"), "file", "model", "metric", "subset", "value")
    assert out == [("m__a_accuracy.json", "m/a", "abstain_rate", "english_ca", 0.1),
                   ("m__a_accuracy.json", "m/a", "accuracy", "chinese_ca", 0.66),
                   ("m__a_accuracy.json", "m/a", "accuracy", "english_ca", 0.71),
                   ("m__b_accuracy.json", "m/b", "accuracy", "greek_cs", 0.5)]


def test_read_scores_no_files_is_an_error(spark):
    with pytest.raises(Exception):
        S.read_scores(spark, tempfile.mkdtemp()).collect()


def test_read_predictions_reference_layout(spark):
    d = tempfile.mkdtemp()
    _write(d, "m__a_predictions.json", {"model": "m/a", "predictions": [
        {"subset": "greek_cs", "extracted_answer": "B", "gold_answer": "B", "correct": True},
        {"subset": "greek_cs_en", "extracted_answer": "", "gold_answer": "A", "correct": False}]})
    rec = T.StructType([T.StructField("subset", T.StringType()), T.StructField("extracted_answer", T.StringType()),
                        T.StructField("gold_answer", T.StringType()), T.StructField("correct", T.BooleanType())])
    out = rows(S.read_predictions(spark, d, rec), "model", "pos", "subset", "correct")
    assert out == [("m/a", 0, "greek_cs", True), ("m/a", 1, "greek_cs_en", False)]


def test_read_probe_skips_summaries_and_incomplete_files(spark):
    d = tempfile.mkdtemp()
    _write(d, "summary.json", {"model": "x", "subsets": {"s": {"n_samples": 9}}})
    _write(d, "no_subsets.json", {"model": "y"})
    _write(d, "m.json", {"model": "m", "prefix_used_for_scoring": " ", "subsets": {
        "greek_cs": {"lang": "el", "n_samples": 2, "top1_is_answer_letter_variant_count": 1,
                     "top1_is_answer_letter_variant_rate": 0.5,
                     "records": [{"gold_answer": "A", "top1_is_answer_letter_variant": True,
                                  "top_k_tokens": [{"rank": 1, "token_id": 5, "log_prob": -0.1}]},
                                 {"gold_answer": "B", "top1_is_answer_letter_variant": False, "top_k_tokens": []}]}}})
    rates, records = S.read_probe(spark, d)
    assert rows(rates, "model", "subset", "n_samples", "top1_is_letter_rate") == [("m", "greek_cs", 2, 0.5)]
    assert rows(records, "model", "pos", "top1_is_letter") == [("m", 0, True), ("m", 1, False)]


def test_wide_csv_and_qa_roundtrip(spark):
    d = tempfile.mkdtemp()
    wide = spark.createDataFrame([("m", "USA", 0.5, None)], "model string, country string, english_ca double, x_cs double")
    S.write_wide_csv(wide, d + "/w")
    back = S.read_wide_csv(spark, d + "/w").first()
    assert (back.model, back.english_ca, back.x_cs) == ("m", 0.5, None)
    with open(d + "/qa.jsonl", "w", encoding="utf-8") as f:
        f.write(json.dumps({"id": "1", "category": "global", "lang": "zh", "question": "q", "answers": ["a"]}) + "\n")
        f.write(json.dumps({"id": "2", "category": "local_cn", "lang": "en", "question": "q", "answers": ["b"],
                            "answer_type": "pair"}) + "\n")
    assert rows(S.read_qa(spark, d + "/qa.jsonl"), "id", "answer_type") == [("1", "entity"), ("2", "pair")]


def test_publish_config_keeps_other_configs(spark):
    d = tempfile.mkdtemp() + "/pub"
    mk = lambda cfg, n: spark.createDataFrame([(cfg, "test", i) for i in range(n)], "config string, split string, i int")
    S.publish_config(mk("a", 2), d)
    S.publish_config(mk("b", 3), d)
    S.publish_config(mk("a", 1), d)          # republish a: replaces a only
    got = dict(rows(S.read_source(spark, d).groupBy("config").count(), "config", "count"))
    assert got == {"a": 1, "b": 3}


def test_read_scores_keeps_files_with_bad_or_no_values_and_raises_on_cut_files(spark):
    d = tempfile.mkdtemp()
    _write(d, "a_accuracy.json", {"model": "a", "accuracy": {"english_ca": "n/a", "chinese_ca": 0.4}})
    _write(d, "b_accuracy.json", {"model": "b", "accuracy": {}})
    got = rows(S.read_scores(spark, d, metrics=["accuracy"]), "model", "subset", "value")
    assert got == [("a", "chinese_ca", 0.4), ("a", "english_ca", None), ("b", None, None)]
    with open(os.path.join(d, "c_accuracy.json"), "w") as f:
        f.write('{"model": "c", "accuracy": {"english_ca": 0.')
    with pytest.raises(Exception):
        S.read_scores(spark, d, metrics=["accuracy"]).collect()


def test_process_results_keeps_every_subset_and_file(spark):
    from gapscope.plans.process import process_results, write_results
    d, out_dir = tempfile.mkdtemp(), tempfile.mkdtemp()
    _write(d, "a_accuracy.json", {"model": "m", "accuracy": {"english_ca": 0.5, "chinese_cs_mix": 0.3}, "conf_err_rate": {"english_ca": 0.1}})
    _write(d, "b_accuracy.json", {"model": "m", "accuracy": {"english_ca": 0.7}})
    _write(d, "c_accuracy.json", {"model": "none", "accuracy": {}})
    dims = spark.createDataFrame([("m", "USA")], "model string, country string")
    out = process_results(spark, d, dims, metrics=["accuracy", "conf_err_rate"])
    acc = out["accuracy"]
    assert acc.columns == ["file", "model", "country", "english_ca", "chinese_cs_mix"]
    assert [tuple(r) for r in acc.collect()] == [("a_accuracy.json", "m", "USA", 0.5, 0.3), ("b_accuracy.json", "m", "USA", 0.7, None),
                                                 ("c_accuracy.json", "none", "Unknown", None, None)]
    assert out["accuracy_filtered"].count() == 2 and out["accuracy_filtered"].columns == acc.columns
    write_results(out, out_dir)
    assert S.read_wide_csv(spark, f"{out_dir}/accuracy", keys=("file", "model", "country")).count() == 3


def test_probe_round_trip_of_whole_cells(spark, tmp_path):
    import random

    import duckdb

    import __spark_entry__ as E
    r = random.Random(5)
    data = [(i, [r.gauss(0, 1) for _ in range(12)], i // 1500) for i in range(2400)]
    spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    said = lambda row: tuple(round(v, 8) if isinstance(v, float) else v for v in row)
    for name, n in (("read_probe_all", 6), ("read_probe_records", 5 * 2400)):
        df = E.queries()[name](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({E.oracle_sql()[name]})").fetchall()
        got = [tuple(x) for x in df.collect()]
        assert len(got) == n and sorted(map(said, got)) == sorted(map(said, want))
        if name == "read_probe_all":
            assert sorted((x[0], x[1], x[2]) for x in got) == [(m, s, k) for m, k in (("E0", 500), ("E1", 300)) for s in ("chinese_ca", "chinese_cs", "chinese_cs_en")]


def test_write_by_model_by_size_splits_a_hot_model(spark, tmp_path):
    recs = spark.range(40_000).selectExpr("CASE WHEN id % 10 < 8 THEN 'org/hot' ELSE 'm' || (id % 10) END AS model", "id AS item",
                                          "sha2(CAST(id AS string), 256) AS pred")
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        S.write_by_model(recs.repartition(8), str(tmp_path / "out"), files_per_model=None)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    files = {d: sum(f.startswith("part-") for f in os.listdir(tmp_path / "out" / d)) for d in os.listdir(tmp_path / "out") if d.startswith("slug=")}
    assert set(files) == {"slug=org__hot", "slug=m8", "slug=m9"} and files["slug=org__hot"] > 2 and files["slug=m8"] <= 2
    back = spark.read.json(str(tmp_path / "out"))
    assert back.count() == 40_000 and back.where("slug = 'org__hot'").count() == 32_000


def test_a_new_folder_is_written_without_moves_by_the_driver(spark, tmp_path):
    df = spark.createDataFrame([(f"m{k % 5}", k) for k in range(20)], "model string, n int")
    path = str(tmp_path / "new")
    S.write_by_model(df, path, mode="errorifexists", files_per_model=None)
    assert rows(spark.read.json(path), "model", "n") == rows(df, "model", "n")
    assert sorted(x for x in os.listdir(path) if x.startswith("slug=")) == [f"slug=m{k}" for k in range(5)]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        S.write_by_model(df, path, mode="errorifexists")


def test_buckets_bound_the_folders_and_read_the_same(spark, tmp_path):
    docs = spark.createDataFrame([(f"org/m{k}" if k else None, {"greek_cs": k / 100, "english_ca": 0.5}) for k in range(60)],
                                 "model string, accuracy map<string,double>")
    for name, buckets in (("each", False), ("buckets", True)):
        S.write_by_model(docs, str(tmp_path / name), mode="errorifexists", buckets=buckets)
    count = lambda name, what: sum(f.startswith(what) for _, dirs, files in os.walk(tmp_path / name) for f in dirs + files)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert (count("each", "slug="), count("each", "part-")) == (60, 60)
    assert 1 < count("buckets", "bucket=") <= n and count("buckets", "part-") <= n
    read = lambda name: rows(S.read_scores(spark, str(tmp_path / name), layout="partitioned", metrics=["accuracy", "cond_acc"]))
    assert read("buckets") == read("each") and len(read("each")) == 60 * 3
    with pytest.raises(ValueError):
        S.write_by_model(docs, str(tmp_path / "buckets"), buckets=True)


def _result_tables(spark, path, models=60):
    """lineitem, supplier and nation with a base and an overlay answer in every subset of every model."""
    flags = {1: "A"}
    li = [(m * 100 + n, n * 4 + m % 3, m, n, float(m + n + k), flags.get(n, "ANR"[k]), "FO"[(m + n + k) % 2], k)
          for m in range(models) for n in range(1, 8) for k in range(3)]
    spark.createDataFrame(li, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, "
                              "l_linestatus string, k int").drop("k").write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(m, m % 5) for m in range(models)], "s_suppkey long, s_nationkey int").write.parquet(f"{path}/supplier.parquet")
    spark.createDataFrame([(k, f"N{k}") for k in range(5)], "n_nationkey int, n_name string").write.parquet(f"{path}/nation.parquet")


def test_score_documents_of_a_batch_do_not_make_a_folder_a_model(spark, tmp_path):
    from gapscope.plans.process import _dump
    _result_tables(spark, str(tmp_path))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for path in _dump(spark, str(tmp_path)):
        d = path.removeprefix("file:")
        assert len([x for x in os.listdir(d) if "=" in x]) <= n
        assert spark.read.json(path).select("slug").distinct().count() == 60


@pytest.mark.parametrize("name", ["process_results", "process_results_tables"])
def test_process_results_equal_their_sql(spark, tmp_path, name):
    import duckdb

    import __spark_entry__ as E
    _result_tables(spark, str(tmp_path))
    con = duckdb.connect()
    for t in ("lineitem", "supplier", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    df = E.queries()[name](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({E.oracle_sql()[name]})").fetchall()
    said = lambda t: tuple((v is not None, round(v, 8) if isinstance(v, float) else v) for v in t)
    assert sorted(map(said, df.collect())) == sorted(map(said, want)) and len(want) > 300
