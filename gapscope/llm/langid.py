"""Language identification by nearest centroid over TF-IDF character n-grams.

A text is lower-cased; digits, punctuation and white space become one space; the
1- to 3-byte grams of its UTF-8 form are hashed to ``DIMS`` buckets.  A vector is
(1 + ln tf) * idf, normalised; idf comes from the document counts of *all*
training rows.  Each language has up to ``CLUSTERS`` centroids, found by spherical
k-means on a bounded sample (``SAMPLE_PER_LANG`` rows of least id hash; the bound is
a parameter, everything else covers all rows).  A text gets the language of the
centroid of greatest cosine; the cosine is its score.

Rejection: a text is rejected if it is null or has no letter (``und``, score 0), or
if its distance (1 - cosine) to the nearest centroid passes ``MAX_DISTANCE``.

Empty texts are texts without a letter.  Rows with null language are predicted,
never trained on; without any training row every text is ``und``.  Ties between
centroids go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapscope.llm.common import arrow_pass, pieces

DIMS = 1 << 13
CLUSTERS = 3
SAMPLE_PER_LANG = 1500
ROUNDS = 8
MAX_DISTANCE = 0.9
BATCH = 256

_LETTER = regex.compile(r"\p{L}")
_BREAKS = str.maketrans({c: " " for c in map(chr, range(128)) if not c.isalpha()})
_MIX = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


def grams(text: str) -> np.ndarray:
    """Buckets of all 1-, 2- and 3-byte grams of the normalised text."""
    b = np.frombuffer(f" {' '.join(text.lower().translate(_BREAKS).split())} ".encode(), np.uint8).astype(np.uint32)
    out, key = [], np.zeros(len(b), np.uint32)
    for n in (1, 2, 3):
        if len(b) < n:
            break
        key = (key[:len(b) - n + 1] << np.uint32(8)) | b[n - 1:]
        out.append((key + np.uint32(n)) * _MIX[n - 1] >> np.uint32(32 - 13))
    return np.concatenate(out)


def counts(text: str) -> np.ndarray:
    return np.bincount(grams(text), minlength=DIMS)


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF rows."""
    v = np.zeros((len(texts), DIMS), np.float32)
    for i, t in enumerate(texts):
        c = counts(t)
        at = np.flatnonzero(c)
        v[i, at] = (1 + np.log(c[at])) * idf[at]
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, norm, out=v, where=norm > 0)


def _cluster(v: np.ndarray, clusters: int, rounds: int) -> np.ndarray:
    """Centroids of spherical k-means with farthest-point seeds."""
    seeds = [v.sum(axis=0) / max(1e-12, float(np.linalg.norm(v.sum(axis=0))))]
    centres = np.stack([v[int(np.argmax(v @ seeds[0]))]])
    while len(centres) < min(clusters, len(v)):
        best = (v @ centres.T).max(axis=1)
        if best.min() > 0.999:
            break
        centres = np.vstack([centres, v[int(np.argmin(best))]])
    for _ in range(rounds):
        own = np.argmax(v @ centres.T, axis=1)
        sums = np.stack([v[own == k].sum(axis=0) if (own == k).any() else centres[k] for k in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres.astype(np.float32)


class Model:
    """idf, and for each centroid its language and vector."""

    def __init__(self, idf: np.ndarray, langs: list[str], centres: np.ndarray):
        self.idf, self.langs, self.centres = idf, langs, centres

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores and rejections."""
        has = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if self.langs else []
        lang, score, out = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        if has:
            cos = vectors([texts[i] for i in has], self.idf) @ self.centres.T
            best = np.argmax(cos, axis=1)
            top = np.clip(cos[np.arange(len(has)), best].astype(np.float64), 0, 1)
            for i, k in zip(has, best.tolist()):
                lang[i] = self.langs[k]
            score[has], out[has] = top, 1 - top > MAX_DISTANCE
        return lang, score, out


def _texts(df: DataFrame, text_col: str, *more: Column) -> DataFrame:
    return df.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"), *more)


def _document_counts(train: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """In how many training texts each bucket occurs; DIMS + 1 rows reach the driver."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMS + 1, np.int64), 0
        for b in pieces(batches, BATCH):
            for t in b.column(0):
                df[:DIMS] += counts(t.as_py()) > 0
            n += b.num_rows
        df[DIMS] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], ["dim", "n"])

    total = np.zeros(DIMS + 1, np.int64)
    for r in arrow_pass(_texts(train, text_col), "dim int, n long", of).groupBy("dim").agg(F.sum("n").alias("n")).toLocalIterator():
        total[r.dim] = r.n
    return total[:DIMS], int(total[DIMS])


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", clusters: int = CLUSTERS,
        sample_per_lang: int = SAMPLE_PER_LANG) -> Model:
    """Learn from the rows of ``train`` with a language (one small model per language reaches the driver)."""
    train = train.select(F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id")).where("lang is not null")
    df, n = _document_counts(train, "t")
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    # the bounded sample: a share of each language's rows by hash, then the rows of least hash
    sizes = {r.lang: r.n for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model(idf, [], np.zeros((0, DIMS), np.float32))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 1.5 * sample_per_lang / n + 100 / n))])
    hashed = train.where(F.col("t").isNotNull()).select("lang", "t", F.xxhash64("id", "t").alias("h"))
    near = hashed.where(F.pmod("h", F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    order = Window.partitionBy("lang").orderBy("h", "t")
    sample = near.withColumn("at", F.row_number().over(order)).where(F.col("at") <= sample_per_lang).select("lang", "t")

    def centroids(group: pa.Table) -> pa.Table:
        texts = sorted(t for t in group.column("t").to_pylist() if _LETTER.search(t))
        centres = _cluster(vectors(texts, idf), clusters, ROUNDS) if texts else []
        lang = group.column("lang")[0].as_py()
        return pa.table({"lang": pa.array([lang] * len(centres), pa.string()), "centre": pa.array([c.tobytes() for c in centres], pa.binary())})

    found = sample.groupBy("lang").applyInArrow(centroids, "lang string, centre binary").collect()
    found = sorted((r.lang, bytes(r.centre)) for r in found)
    centres = np.stack([np.frombuffer(c, np.float32) for _, c in found]) if found else np.zeros((0, DIMS), np.float32)
    return Model(idf, [lang for lang, _ in found], centres)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` as one struct ``doc`` with ``lang_pred``, ``score``, ``rejected`` beside it."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)      # DIMS floats for each centroid
    row = docs.select(F.struct("*").alias("doc"), F.col(text_col).cast("string").alias("t"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, BATCH):
            lang, score, out = shared.value.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang), pa.array(score), pa.array(out)], ["doc", "lang_pred", "score", "rejected"])

    kind = row.schema["doc"].dataType.simpleString()
    return arrow_pass(row, f"doc {kind}, lang_pred string, score double, rejected boolean", of)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def keep_recognised(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language the model learned from their labels recognises."""
    found = predict(docs, fit(docs))
    return found.where(~F.col("rejected")).select("doc.*")
