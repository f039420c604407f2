"""Result files: runs kept apart, damage reported, large documents read by records."""

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapscope.plans.process import process_results
from gapscope.sources import files as S

REC = T.StructType([T.StructField("subset", T.StringType()), T.StructField("text", T.StringType()),
                    T.StructField("log_probs", T.MapType(T.StringType(), T.DoubleType())), T.StructField("correct", T.BooleanType())])


def _doc(path, model, n, indent=2):
    recs = [{"subset": f"s{i % 3}", "text": "a\n    {b\"}" * (i % 4), "log_probs": {"A": -0.5, "B": i / 2}, "correct": i % 2 == 0} for i in range(n)]
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"model": model, "predictions": recs}, f, indent=indent, ensure_ascii=False)
    return recs


def test_two_runs_of_a_model_stay_apart(spark, tmp_path):
    subsets = ["english_ca", "greek_ca", "greek_cs", "greek_cs_en"]
    for name, values in (("a", [0.1, 0.2, 0.2, 0.1]), ("b", [0.5, 0.6, 0.9, 0.1])):
        with open(tmp_path / f"{name}_accuracy.json", "w") as f:
            json.dump({"model": "m", "accuracy": dict(zip(subsets, values)), "conf_err_rate": dict(zip(subsets, values))}, f)
    dims = spark.createDataFrame([("m", "USA")], "model string, country string")
    out = process_results(spark, str(tmp_path), dims, metrics=["accuracy", "conf_err_rate"], threshold=0.5)
    assert [r.file for r in out["accuracy_filtered"].collect()] == ["b_accuracy.json"]
    gaps = [(r.file, round(r.local_gap, 9)) for r in out["accuracy_gaps"].where("locale = 'greek'").collect()]
    assert gaps == [("b_accuracy.json", 0.8)]
    hall = {r.file: round(r.hall_gap, 9) for r in out["hall_gaps"].where("locale = 'greek'").collect()}
    assert hall == {"a_accuracy.json": -0.1, "b_accuracy.json": -0.8}
    assert tuple(out["report"].first()) == (2, 16, 1, 1)


def test_records_of_documents(spark, tmp_path):
    whole = {m: _doc(tmp_path / f"{m}_predictions.json", m, n) for m, n in (("a", 50), ("b", 1), ("c", 0))}
    records, report = S.prediction_records(spark, str(tmp_path), REC)
    got = sorted((r.model, r.subset, r.text, json.dumps(r.log_probs), r.correct) for r in records.collect())
    assert got == sorted((m, r["subset"], r["text"], json.dumps(r["log_probs"]), r["correct"]) for m, recs in whole.items() for r in recs)
    plain = S.read_predictions(spark, str(tmp_path), REC).drop("pos", "log_probs")
    assert records.drop("log_probs").exceptAll(plain).count() == plain.exceptAll(records.drop("log_probs")).count() == 0
    assert sorted(tuple(r) for r in report.collect()) == [("a_predictions.json", "a", 50, 0, True), ("b_predictions.json", "b", 1, 0, True),
                                                          ("c_predictions.json", "c", 0, 0, True)]


def test_a_large_document_is_read_by_many_tasks(spark, tmp_path):
    _doc(tmp_path / "big_predictions.json", "big", 5000)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", os.path.getsize(tmp_path / "big_predictions.json") // 5)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        records, report = S.prediction_records(spark, str(tmp_path), REC)
        assert spark.read.option("lineSep", S.RECORD_BEGIN).text(str(tmp_path)).rdd.getNumPartitions() >= 5
        assert records.count() == 5000 and tuple(report.first())[2:] == (5000, 0, True)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])


@pytest.mark.parametrize("cut", ["head", "record", "between", "tail"])
def test_cut_documents_raise_or_are_listed(spark, tmp_path, cut):
    _doc(tmp_path / "good_predictions.json", "good", 4)
    _doc(tmp_path / "cut_predictions.json", "cut", 4)
    text = (tmp_path / "cut_predictions.json").read_text()
    ends = [i for i in range(len(text)) if text.startswith(S.RECORD_END, i)]
    at = {"head": 8, "record": ends[1] - 20, "between": ends[1] + len(S.RECORD_END), "tail": ends[-1] + len(S.RECORD_END)}[cut]
    (tmp_path / "cut_predictions.json").write_text(text[:at])
    records, report = S.prediction_records(spark, str(tmp_path), REC, damaged="report")
    by = {r.file: r for r in report.collect()}
    assert by["good_predictions.json"].complete and not by["cut_predictions.json"].complete
    assert by["cut_predictions.json"].n_bad == (1 if cut == "record" else 0)
    kept = {r.model: r["count"] for r in records.groupBy("model").count().collect()}
    assert kept["good"] == 4 and kept.get("cut", 0) == {"head": 0, "record": 1, "between": 2, "tail": 4}[cut]
    for df in S.prediction_records(spark, str(tmp_path), REC):
        with pytest.raises(Exception, match="damaged"):
            df.collect()
    with pytest.raises(Exception):
        S.read_predictions(spark, str(tmp_path), REC).collect()


def test_cut_probe_and_qa_files_raise(spark, tmp_path):
    os.makedirs(tmp_path / "p")
    (tmp_path / "p" / "a.json").write_text('{"model": "m", "subsets": {"greek_cs": {"lang": "el", "n_samp')
    for df in S.read_probe(spark, str(tmp_path / "p")):
        with pytest.raises(Exception):
            df.collect()
    (tmp_path / "qa.jsonl").write_text('{"id": "1", "lang": "zh", "answers": ["a"]}\n{"id": "2", "answ')
    with pytest.raises(Exception):
        S.read_qa(spark, str(tmp_path / "qa.jsonl")).select(F.max("id")).collect()
    with pytest.raises(Exception):
        S.read_qa(spark, str(tmp_path / "qa.jsonl")).collect()
