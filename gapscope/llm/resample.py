"""Importance resampling towards a target distribution.

Every text is a bag of hashed features: the runs of 1 to ``max_run`` consecutive words
(letters A-Z lower-cased, digits and all other characters beyond ASCII are word
characters), joined by one space, repeats counted.  The counts of all features of the
documents and of the target, by bucket, give one integer gain a bucket; these gains are
an array of ``buckets`` numbers, and a document's weight is the sum of the array's
entries at its features.  A Gumbel term that depends on seed and id alone is added, so
that the highest scores are a weighted draw without replacement.

The cutoff of the draw comes from a mergeable quantile sketch: two of its quantiles
bracket the wanted position, exact counts of the rows above and within the bracket
validate it (else it is widened), and only the rows of the bracket are sorted, by range
over all tasks, to find the row at the position.  The rows drawn are then ranked the
same way.  No step holds more than ``buckets`` numbers outside the tables.

Null and empty texts have no feature: weight 0.  A null id is hashed as an empty one and
sorts after all ids.  Rows of equal score and id (repeated rows) are separate documents
and stand in the order of the written scores.  An empty table gives an empty table;
without target texts every gain follows from counts of zero.  Other columns of the
input, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapscope.functions.indexing import index_within
from gapscope.llm.common import arrow_pass, pieces, staged

BUCKETS = 10_000
MAX_RUN = 1
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
#: Half width of the first bracket, in shares of the rows.
MARGIN = 0.005
BATCH = 256
ENTRIES = 200_000

_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


class _Buckets(dict):
    """Buckets of words; a dictionary that only saves work and is emptied when full."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        at = zlib.crc32(feature) % self.buckets
        if len(feature) < 100:
            if len(self) >= ENTRIES:
                self.clear()
            self[feature] = at
        return at


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORD_BYTES).split()


def features(found: list[bytes], max_run: int, bucket_of: _Buckets) -> np.ndarray:
    """Buckets of all runs of 1 to ``max_run`` words."""
    at = [np.fromiter(map(bucket_of.__getitem__, found), np.int64, len(found))]
    for n in range(2, max_run + 1):
        runs = (b" ".join(found[i:i + n]) for i in range(len(found) - n + 1))
        at.append(np.fromiter((zlib.crc32(r) % bucket_of.buckets for r in runs), np.int64, max(0, len(found) - n + 1)))
    return np.concatenate(at)


def _bytes(df: DataFrame, text_col: str, *more: Column) -> DataFrame:
    return df.select(F.col(text_col).cast("string").cast("binary").alias("t"), *more)


def bucket_counts(texts: DataFrame, text_col: str, buckets: int = BUCKETS, max_run: int = MAX_RUN) -> np.ndarray:
    """How many features of all texts fall into each bucket; ``buckets`` numbers reach the driver."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, bucket_of = np.zeros(buckets, np.int64), _Buckets(buckets)
        for b in pieces(batches, BATCH):
            for t in b.column(0):
                total += np.bincount(features(words(t.as_py()), max_run, bucket_of), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in arrow_pass(_bytes(texts, text_col), "bucket int, n long", of).groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.bucket] = r.n
    return out


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log ratio of smoothed shares, rounded down, by bucket."""
    m = len(documents)
    big_s, big_t = float(documents.sum() + m), float(target.sum() + m)
    return np.array([floor(1000 * log((float(t) + 1) * big_s / ((float(s) + 1) * big_t))) for s, t in zip(documents.tolist(), target.tolist())], np.int64)


def gumbel(id_col: str, seed: int) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weigh(docs: DataFrame, gain: np.ndarray, text_col: str = "text", id_col: str = "doc_id", max_run: int = MAX_RUN,
          seed: int = SEED) -> DataFrame:
    """(id, n_words, n_features, weight, score) of every row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket_of = _Buckets(len(gain))
        for b in pieces(batches, BATCH):
            n_words, n_features, weight = [], [], []
            for t in b.column(0):
                found = words(t.as_py())
                at = features(found, max_run, bucket_of)
                n_words.append(len(found))
                n_features.append(len(at))
                weight.append(int(gain.take(at).sum()))
            yield pa.RecordBatch.from_arrays([b.column(1), *(pa.array(x, pa.int64()) for x in (n_words, n_features, weight))],
                                             ["id", "n_words", "n_features", "weight"])

    row = _bytes(docs, text_col, F.col(id_col).alias("id"))
    kind = row.schema["id"].dataType.simpleString()
    weighed = arrow_pass(row, f"id {kind}, n_words long, n_features long, weight long", of)
    return weighed.withColumn("score", F.col("weight") + gumbel("id", seed))


def _order() -> list[Column]:
    return [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("at")]


def bracket(scores: DataFrame, k: int, n: int, margin: float = MARGIN) -> tuple[int, int, int]:
    """(low, high, rows above high): the k-th highest of ``n`` scores lies from low to high, by exact counts."""
    while True:
        share = 1 - k / n
        ends = F.array(F.lit(max(0.0, share - margin)), F.lit(min(1.0, share + margin)))
        low, high = scores.agg(F.percentile_approx("score", ends, F.lit(max(100, round(20 / margin))))).first()[0]
        low = None if margin >= 1 else low                         # the whole range: always valid
        high = None if margin >= 1 else high
        up = F.lit(False) if high is None else F.col("score") > high
        reach = F.lit(True) if low is None else F.col("score") >= low
        above, least = scores.agg(F.count_if(up), F.count_if(reach)).first()
        if above < k <= least:
            return low, high, above
        margin = min(1.0, margin * 4)


def draw(scored: DataFrame, k: int, eligible: Column, margin: float = MARGIN) -> DataFrame:
    """``scored`` (written; columns score, id, at among others) with ``rank`` 1..k of its k best eligible rows, else null."""
    able = scored.where(eligible)
    n = able.count()
    k = min(k, n)
    none = scored.withColumn("rank", F.lit(None).cast("long"))
    if k <= 0:
        return none
    low, high, above = bracket(able, k, n, margin)
    within = able.select("score", "id", "at")
    if low is not None:
        within = within.where(F.col("score") >= low)
    if high is not None:
        within = within.where(F.col("score") <= high)
    last = index_within(within, [], _order()).where(F.col("idx") == k - above - 1).first()
    same = F.col("id").eqNullSafe(F.lit(last.id))
    before = F.col("id").isNotNull() if last.id is None else F.coalesce(F.col("id") < F.lit(last.id), F.lit(False))
    drawn = eligible & ((F.col("score") > last.score) | ((F.col("score") == last.score) & (before | (same & (F.col("at") <= last["at"])))))
    ranked = index_within(scored.where(drawn), [], _order()).withColumn("rank", (F.col("idx") + 1).cast("long")).drop("idx")
    return ranked.unionByName(none.where(~F.coalesce(drawn, F.lit(False))))


def resample(docs: DataFrame, target: DataFrame, text_col: str = "text", id_col: str = "doc_id", target_col: str = "text",
             percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, max_run: int = MAX_RUN,
             seed: int = SEED) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every row of ``docs``: rank 1.. for the ``percent`` of the
    documents of at least ``min_words`` words that are drawn, null for all others."""
    gain = gains(bucket_counts(docs, text_col, buckets, max_run), bucket_counts(target, target_col, buckets, max_run))
    scored = staged(weigh(docs, gain, text_col, id_col, max_run, seed).withColumn("at", F.monotonically_increasing_id()), "resample-scores")
    eligible = F.col("n_words") >= min_words
    k = percent * scored.where(eligible).count() // 100
    return draw(scored, k, eligible).drop("at")


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))"

#: CRC-32 byte by byte over a table of 256 entries; logarithms in doubles as above.
ORACLE = rf"""
WITH tab AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t
  FROM range(256) r(i)
), d AS (SELECT doc_id, {_WORDS} AS w FROM documents
), b AS (SELECT {_WORDS} AS w FROM benchmark
), u AS (SELECT DISTINCT w FROM (SELECT w FROM d UNION ALL SELECT w FROM b)
), h AS (
  SELECT w, xor(list_reduce(list_transform(range(CAST(length(hex(w)) / 2 AS BIGINT)), lambda i: CAST('0x' || substr(hex(w), 2 * i + 1, 2) AS BIGINT)),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % {BUCKETS} AS bucket
  FROM u, tab
), s AS (SELECT bucket, count(*) AS s FROM d JOIN h USING (w) GROUP BY bucket
), t AS (SELECT bucket, count(*) AS t FROM b JOIN h USING (w) GROUP BY bucket
), n AS (SELECT (SELECT count(*) FROM d) AS big_s, (SELECT count(*) FROM b) AS big_t
), g AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * CAST(big_s + {BUCKETS} AS DOUBLE)
    / ((CAST(coalesce(s, 0) AS DOUBLE) + 1) * CAST(big_t + {BUCKETS} AS DOUBLE)))) AS BIGINT) AS gain
  FROM (SELECT unnest(range({BUCKETS})) AS bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), n
), w AS (SELECT doc_id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM d JOIN h USING (w) JOIN g USING (bucket) GROUP BY doc_id
), x AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM documents LEFT JOIN w USING (doc_id)
), r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM x WHERE n_features >= {MIN_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {PERCENT} * n // 100 THEN rank END AS rank
FROM x LEFT JOIN r USING (doc_id)
"""
