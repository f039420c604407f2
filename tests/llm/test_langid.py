"""Nearest-centroid language ID: held-out accuracy, rejection, edge cases."""

import math
import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from gapscope.llm import catalog, langid

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_split(spark):
    got = catalog.QUERIES["op8_nearest_centroid"](spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text").toPandas()
    both = got.merge(docs, on="doc_id")
    assert len(got) == len(docs)
    assert (both.held_out == both.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    tested = both[both.held_out & (both.text.str.len() > 40)]
    assert (tested.lang_pred == tested.lang).mean() > 0.97
    assert set(both.lang_pred) <= set(docs.lang) | {"und"} and both.score.between(0, 1).all()
    assert not both[both.text.str.len() > 40].rejected.any()


def corpus(spark):
    r = random.Random(3)
    say = lambda letters: " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 6))) for _ in range(30))
    rows = [(i, say("abcd") if i % 2 else say("wxyz"), "ab" if i % 2 else "wx", 1) for i in range(60)]
    rows += [(100, None, "ab", 1), (101, "", "wx", 1), (102, "123 $%& ²", None, 1), (None, say("abcd"), None, None),
             (103, "日本語の文章", "ab", 1), (3, rows[3][1], "ab", 1), (104, say("wxyz") * 3000, None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")


def test_edge_rows(spark):
    docs = corpus(spark)
    model = langid.fit(docs.where("lang is not null"))
    got = [(r.doc.doc_id, r.lang_pred, r.rejected, r.score, r.doc.score) for r in langid.predict(docs, model).collect()]
    by = {g[0]: g for g in got}
    assert len(got) == 67 and by[1][1] == "ab" and by[2][1] == "wx" and by[None][1] == "ab" and by[104][1] == "wx"
    assert all(by[i][1:4] == ("und", True, 0.0) for i in (100, 101, 102))
    kept = langid.keep_recognised(docs)
    assert kept.columns == docs.columns and kept.count() == 64 - 0
    assert sum(r.doc_id == 3 for r in kept.collect()) == 2


def test_no_training_rows_and_empty_table(spark):
    docs = corpus(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(docs)).collect()} == {"und"}
    assert langid.keep_recognised(docs.where("false")).count() == 0


def plain_grams(text):
    """Buckets of the 1- to 3-byte grams, one by one."""
    clean = "".join(c if ord(c) > 127 or c.isalpha() else " " for c in text.lower())
    b = (" " + " ".join(clean.split()) + " ").encode()
    mix, out = (2654435761, 2246822519, 3266489917), Counter()
    for n in (1, 2, 3):
        for i in range(len(b) - n + 1):
            key = int.from_bytes(b[i:i + n], "big")
            out[((key + n) * mix[n - 1] % 2 ** 32) >> 19] += 1
    return out


def test_counts_vectors_and_cosines_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 3 = 0 OR text IS NULL").select("doc_id", "lang", "text")
    model = langid.fit(docs)
    rows = docs.collect()
    # idf of all training rows, not of the centroids' sample
    train = [r for r in rows if r.lang is not None]
    df = Counter()
    for r in train:
        df.update(set(plain_grams(r.text or "")))
    idf = [math.log((1 + len(train)) / (1 + df[d])) + 1 for d in range(langid.DIMS)]
    assert max(abs(a - b) for a, b in zip(idf, model.idf.tolist())) < 1e-5
    centres = [[(d, x) for d, x in enumerate(c.tolist()) if x] for c in model.centres]
    assert all(abs(sum(x * x for _, x in c) - 1) < 1e-4 for c in centres) and model.langs == sorted(model.langs)
    got = {r.doc.doc_id: r for r in langid.predict(docs, model).collect()}
    for r in rows[:120]:
        v = {d: (1 + math.log(n)) * idf[d] for d, n in plain_grams(r.text or "").items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        cos = [sum(x * v.get(d, 0) for d, x in c) / norm for c in centres]
        best, said = max(cos), got[r.doc_id]
        if not r.text or not any(c.isalpha() for c in r.text):
            assert (said.lang_pred, said.score, said.rejected) == ("und", 0.0, True)
            continue
        assert abs(said.score - min(1, max(0, best))) < 1e-4 and said.rejected == (1 - said.score > langid.MAX_DISTANCE)
        assert said.lang_pred in {lang for lang, c in zip(model.langs, cos) if c > best - 1e-4}
