"""Stupid-backoff scores of documents from n-gram counts of all documents.

    S(w | context) = c(context w) / c(context)   if c(context w) >= MIN_COUNT (1 for single words)
                     BACKOFF * S(w | shorter context)   otherwise;   c(w) / N for single words

A document's score is the sum of ln S over its words (runs of letters, digits and
underscores, lower-cased); n-grams do not reach over documents.

The n-grams are exploded in packed form.  Documents are dealt into *chunks* of about
``CHUNK_WORDS`` words, each staged once as word codes.  A chunk sends its distinct n-grams
(hash and count; one entry per n-gram and chunk, however common it is) to the
table partition of the hash's upper bits; the partition adds up the counts of all
chunks, which is the n-gram count table, and joins them back to each chunk's
entries; the chunk then looks up its n-grams and sums per document.  Everything that
moves is proportional to the distinct n-grams of chunks; no n-gram, word or document gathers
in one task beyond one entry per chunk, and nothing is broadcast but N.

Hashes have ``HASH_BITS`` bits (two n-grams of one order share a hash with a chance
of 2^-56 a pair).  Null and empty texts, and texts without words, score 0.0 with 0
words; repeated rows are counted and scored one by one; null ids stay null; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapscope.llm.common import arrow_pass, pieces, staged
from gapscope.llm.words import word_hashes
from gapscope.session import ship_package

ORDER = 3
BACKOFF = 0.4
MIN_COUNT = 2
HASH_BITS = 56
CHUNK_WORDS = 3 << 19
PARTITION_ENTRIES = 1 << 19
BATCH = 256

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


# ---------------------------------------------------------------- packed arrays

def pack(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


# ---------------------------------------------------------------- n-grams of a chunk

def ngram_hashes(words: np.ndarray, codes: np.ndarray, starts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each n-gram that lies in one document: position of its last word, hash."""
    h = words[codes]
    key = h.copy()
    n = len(codes)
    for _ in range(order - 1):
        # the key of the shorter n-gram that ends one word before, then this word
        key[1:] = ((key[:-1] ^ (key[:-1] >> np.uint64(31))) * _MULTIPLY) + h[1:]
    key = (key ^ (key >> np.uint64(29))) * _MULTIPLY
    at = np.flatnonzero(np.arange(n) - starts >= order - 1)
    return at, key[at] >> np.uint64(64 - HASH_BITS)


def _starts(sizes: np.ndarray) -> np.ndarray:
    """For each word the position where its document begins."""
    return np.repeat(np.cumsum(sizes) - sizes, sizes)


def _chunks(docs: DataFrame, id_col: str, text_col: str, chunk_words: int) -> DataFrame:
    """Staged rows (chunk, ids, sizes, words, codes)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        ids, hashes, held = [], [], 0

        def closed() -> pa.RecordBatch:
            words, codes, counts = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
            # common words get small codes: their upper byte planes are all but empty
            order = np.argsort(-counts, kind="stable")
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            words, codes = words[order], place[codes]
            columns = [pa.array([part << 32 | number]), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(h) for h in hashes]], pa.list_(pa.int64())),
                       pa.array([pack(words)], pa.binary()), pa.array([pack(codes)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["chunk", "ids", "sizes", "words", "codes"])

        for b in pieces(batches, BATCH):
            for i, t in zip(b.column(0), b.column(1)):
                ids.append(i.as_py())
                hashes.append(word_hashes(t.as_py()))
                held += len(hashes[-1])
                if held >= chunk_words:
                    yield closed()
                    ids, hashes, held, number = [], [], 0, number + 1
        if ids:
            yield closed()

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    return staged(arrow_pass(narrow, "chunk long, ids array<long>, sizes array<long>, words binary, codes binary", of), "ngram-chunks")


def _requests(chunks: DataFrame, order: int, bits: int) -> DataFrame:
    """(n, part, chunk, hashes, counts): each chunk's distinct n-grams, cut by the hashes' upper bits."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1):
            chunk, sizes = b.column(0)[0].as_py(), b.column(1)[0].values.to_numpy()
            words, codes = unpack(b.column(2)[0].as_py(), np.uint64), unpack(b.column(3)[0].as_py(), np.uint32)
            starts = _starts(sizes)
            for n in range(1, order + 1):
                kinds, counts = np.unique(ngram_hashes(words, codes, starts, n)[1], return_counts=True)
                if not len(kinds):
                    continue
                part = (kinds >> np.uint64(HASH_BITS - bits)).astype(np.int64)
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)]))
                pairs = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(pairs), n, np.int32)), pa.array(part[cuts[:-1]]), pa.array(np.full(len(pairs), chunk)),
                     pa.array([pack_sorted(kinds[a:z]) for a, z in pairs], pa.binary()), pa.array([pack(counts[a:z].astype(np.uint32)) for a, z in pairs], pa.binary())],
                    ["n", "part", "chunk", "hashes", "counts"])

    return arrow_pass(chunks.select("chunk", "sizes", "words", "codes"), "n int, part long, chunk long, hashes binary, counts binary", of)


def _replies(requests: DataFrame) -> DataFrame:
    """(chunk, n, part, totals): the count table of each hash partition, joined back to the entries of each chunk."""

    def of(group: pa.Table) -> pa.Table:
        asked = [unpack_sorted(h.as_py()) for h in group.column("hashes")]
        counts = [unpack(c.as_py(), np.uint32) for c in group.column("counts")]
        table, at = np.unique(np.concatenate(asked), return_inverse=True)
        totals = np.bincount(at, weights=np.concatenate(counts).astype(np.float64), minlength=len(table)).astype(np.uint64)
        ends = np.cumsum([len(a) for a in asked])
        return pa.table({"chunk": group.column("chunk"), "n": group.column("n"), "part": group.column("part"),
                         "totals": pa.array([pack(totals[at[e - len(a):e]]) for a, e in zip(asked, ends.tolist())], pa.binary())})

    return requests.groupBy("n", "part").applyInArrow(of, "chunk long, n int, part long, totals binary")


def scores(chunks: DataFrame, replies: DataFrame, total: int, order: int, min_count: int, backoff: float, id_col: str) -> DataFrame:
    def of(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [id_col, "n_words", "n_backoffs", "log_score"]
        if not left.num_rows:
            return pa.table({k: pa.array([], pa.float64() if k == "log_score" else pa.int64()) for k in names})
        sizes = left.column("sizes")[0].values.to_numpy()
        words, codes = unpack(left.column("words")[0].as_py(), np.uint64), unpack(left.column("codes")[0].as_py(), np.uint32)
        starts = _starts(sizes)
        right = right.sort_by([("n", "ascending"), ("part", "ascending")])
        which = right.column("n").to_numpy()
        logs, steps, below = np.zeros(len(codes)), np.zeros(len(codes), np.int64), None
        for n in range(1, order + 1):
            at, h = ngram_hashes(words, codes, starts, n)
            if not len(at):
                break
            known = np.concatenate([unpack(right.column("totals")[int(k)].as_py(), np.uint64) for k in np.flatnonzero(which == n)])
            _, place = np.unique(h, return_inverse=True)
            count = np.zeros(len(codes))
            count[at] = known[place]
            if n == 1:
                logs[at] = np.log(count[at] / total)
            else:
                seen = count[at] >= min_count
                # the context is the n-gram of the order below that ends one word earlier
                logs[at] = np.where(seen, np.log(count[at] / below[at - 1]), logs[at] + np.log(backoff))
                steps[at] = np.where(seen, 0, steps[at] + 1)
            below = count
        of_doc = np.repeat(np.arange(len(sizes)), sizes)
        return pa.table({id_col: left.column("ids")[0].values, "n_words": pa.array(sizes),
                         "n_backoffs": pa.array(np.bincount(of_doc, weights=steps, minlength=len(sizes)).astype(np.int64)),
                         "log_score": pa.array(np.bincount(of_doc, weights=logs, minlength=len(sizes)))})

    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(of, f"{id_col} long, n_words long, n_backoffs long, log_score double")


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, min_count: int = MIN_COUNT,
                    backoff: float = BACKOFF, chunk_words: int = CHUNK_WORDS, partition_entries: int = PARTITION_ENTRIES) -> DataFrame:
    """(id, n_words, n_backoffs, log_score): the score of every document under the counts of all of them."""
    ship_package(docs.sparkSession)
    chunks = _chunks(docs, id_col, text_col, chunk_words)
    total = chunks.select(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).first().n or 0
    bits = max(0, min(30, int(total // partition_entries).bit_length()))
    replies = _replies(_requests(chunks, order, bits))
    return scores(chunks, replies, max(1, total), order, min_count, backoff, id_col)


#: The production scores for DuckDB, rounded.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+') AS ws FROM documents
), w AS (SELECT r, unnest(ws) AS w3, unnest(generate_series(1, len(ws))) AS i FROM d
), g AS (SELECT r, w3, lag(w3) OVER (PARTITION BY r ORDER BY i) AS w2, lag(w3, 2) OVER (PARTITION BY r ORDER BY i) AS w1 FROM w
), c1 AS (SELECT w3, count(*) AS n FROM g GROUP BY w3
), c2 AS (SELECT w2, w3, count(*) AS n FROM g WHERE w2 IS NOT NULL GROUP BY w2, w3
), c3 AS (SELECT w1, w2, w3, count(*) AS n FROM g WHERE w1 IS NOT NULL GROUP BY w1, w2, w3
), s AS (
  SELECT g.r, CASE WHEN c3.n >= {MIN_COUNT} THEN ln(c3.n / x2.n) WHEN c2.n >= {MIN_COUNT} THEN ln(c2.n / x1.n)
                   ELSE ln(c1.n / (SELECT count(*) FROM g)) END AS l,
         CASE WHEN coalesce(c3.n, 0) >= {MIN_COUNT} THEN 0 ELSE (g.w1 IS NOT NULL)::INT END
         + CASE WHEN greatest(coalesce(c3.n, 0), coalesce(c2.n, 0)) >= {MIN_COUNT} THEN 0 ELSE (g.w2 IS NOT NULL)::INT END AS steps
  FROM g JOIN c1 ON c1.w3 = g.w3 LEFT JOIN c2 ON c2.w2 = g.w2 AND c2.w3 = g.w3 LEFT JOIN c3 ON c3.w1 = g.w1 AND c3.w2 = g.w2 AND c3.w3 = g.w3
  LEFT JOIN c1 x1 ON x1.w3 = g.w2 LEFT JOIN c2 x2 ON x2.w2 = g.w1 AND x2.w3 = g.w2
), t AS (SELECT r, count(*) AS n_words, CAST(sum(steps) AS BIGINT) AS n_backoffs, sum(l) + sum(steps) * ln({BACKOFF}) AS score FROM s GROUP BY r
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_backoffs, 0) AS n_backoffs, round(coalesce(score, 0), 6) AS log_score FROM d LEFT JOIN t USING (r)
"""
