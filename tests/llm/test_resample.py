"""Target resampling: the draw against plain Python, brackets that miss, ties, edge rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gapscope.llm import catalog, resample

SF = "/root/testdata/sf0.001"


def brute(docs, target, buckets, max_run, seed, min_words, percent):
    """(id, n_words, n_features, weight, score, rank) by plain lists."""
    def feats(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return w, [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(1, max_run + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(feats(x)[1])
    for x in target:
        t.update(feats(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    out = []
    for i, x in docs:
        w, f = feats(x)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32))), None])
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0]))
    for rank, r in enumerate(able[:percent * len(able) // 100], 1):
        r[5] = rank
    key = lambda r: tuple((x is not None, x) for x in r)
    return sorted((tuple(r) for r in out), key=key)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, x) for x in r))


def test_query_on_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = [(a, c, d, e, f) for a, _, c, d, e, f in brute(docs, target, 10_000, 1, 2024, 20, 10)]
    assert got(catalog.QUERIES["op13_target_resample"](spark, SF)) == want


@pytest.mark.parametrize("max_run,percent", [(1, 10), (2, 35), (3, 100)])
def test_edge_rows(spark, max_run, percent):
    text = "Aa bb9 Öß cc-dd \x00 ee" * 3
    rows = [(i, f"{text} w{i % 3}", 1) for i in range(40)] + [(7, text, 2), (7, text, 2), (None, text, 1), (None, text, 1)]
    rows += [(50, None, 1), (51, "", 1), (52, "  \t\x0b-- ", 1), (53, "x" * 500_000, 1), (54, "long text " * 60_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rank int")
    target = spark.createDataFrame([("aa w1 w1 öß",), (None,), ("",)], "text string")
    found = resample.resample(docs, target, percent=percent, min_words=5, buckets=97, max_run=max_run, seed=5)
    want = brute([r[:2] for r in rows], ["aa w1 w1 öß", None, ""], 97, max_run, 5, 5, percent)
    # repeated rows are alike, so that a sorted list does not tell which one of them has which rank
    assert found.columns == ["id", "n_words", "n_features", "weight", "score", "rank"] and got(found) == want


def test_brackets_are_validated_and_widened(spark):
    rows = [(i, 100 if i % 3 else i) for i in range(2000)]
    scores = spark.createDataFrame(rows, "id long, score long")
    high_to_low = sorted((s for _, s in rows), reverse=True)
    for k in (1, 2, 700, 1500, 1999, 2000):
        for margin in (1e-4, 0.01, 1.0):
            low, high, above = resample.bracket(scores, k, len(rows), margin)
            assert (low is None or low <= high_to_low[k - 1]) and (high is None or high >= high_to_low[k - 1])
            assert above == sum(high is not None and s > high for s in high_to_low) < k


def test_ties_are_cut_by_id(spark):
    scored = spark.createDataFrame([(i, 5, 30) for i in range(100)], "id long, score long, n long").withColumn("at", 1000 - F.col("id"))
    kept = resample.draw(scored, 37, F.lit(True)).where("rank is not null")
    assert sorted((r.rank, r.id) for r in kept.collect()) == [(i + 1, i) for i in range(37)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert resample.resample(none, some).count() == 0 and resample.resample(none, none).count() == 0
    assert got(resample.resample(some, none, min_words=1, percent=100)) == brute([(1, "a b c")], [], 10_000, 1, 2024, 1, 100)
