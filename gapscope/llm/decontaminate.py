"""Benchmark decontamination by spaced-seed hashing.

A seed is the hash of the words under a fixed mask; positions the mask ignores may
hold any word.  Seeds of training texts are joined with the seeds of benchmark
items; around each hit the two texts are laid over each other on the hit's
diagonal, and the overlap counts if some window of ``WINDOW`` words on it (the whole
item, if shorter) has at least ``SIMILARITY`` equal words.

The masks lose nothing: any 13 words with up to 2 substitutions hold a match of one
of ``MASKS``, and for items of 5 to 12 words, which may differ in 1 (from 10 words
on: 2), one of ``SHORT_MASKS``.  Items under ``MIN_WORDS`` words must occur with all
words equal, and those under ``PHRASE_WORDS`` words, which clean texts hold by chance,
overlap only with a text that has no other words.  In scripts without blanks
each letter counts as a word.  Items without any word overlap with nothing.

The benchmark is read in slices of at most ``SLICE_WORDS`` words, each broadcast
(about 60 bytes a word) to one pass over the training texts; a small benchmark is
one slice, a large one several passes of the same bound.

Null and empty texts overlap with nothing; repeated rows each get their own result;
null ids stay null; an empty benchmark or an empty table gives no overlaps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapscope.llm.common import arrow_pass, pieces
from gapscope.llm.words import forget, unit_hashes, unit_sql

MASKS = ("11010111", "11110011")
SHORT_MASKS = ("111", "11011")
WINDOW = 13
SIMILARITY = 0.8
MIN_WORDS = 5
PHRASE_WORDS = 3
SLICE_WORDS = 500_000
BATCH = 128
MATCHES = 1 << 21

_ODD = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1) ^ (i << 33) | 1) & (1 << 64) - 1 for i in range(64)], np.uint64)


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """The seed at each position where the mask fits."""
    n = len(words) - len(mask) + 1
    out = np.zeros(max(0, n), np.uint64)
    for k, at in enumerate(i for i, c in enumerate(mask) if c == "1"):
        out += words[at:at + n] * _ODD[k] if n > 0 else 0
    return out ^ (out >> np.uint64(29))


def needed(n: int, similarity: float = SIMILARITY) -> int:
    """Equal words that a window of ``n`` words needs."""
    return -int(-n * similarity // 1)


class Slice:
    """Benchmark items with their seeds, and a bitmap that most seeds of other texts miss."""

    def __init__(self, items: list[tuple[object, np.ndarray]], window: int = WINDOW):
        self.ids, self.words, self.window = [i for i, _ in items], [w for _, w in items], window
        self.tables = []
        self.whole: dict[bytes, list[int]] = {}
        for k, w in enumerate(self.words):
            if 0 < len(w) < PHRASE_WORDS:
                self.whole.setdefault(w.tobytes(), []).append(k)
        exact = [(("1" * n,), lambda w, n=n: len(w) == n) for n in range(PHRASE_WORDS, MIN_WORDS)]
        for masks, chosen in ((MASKS, lambda w: len(w) >= window), (SHORT_MASKS, lambda w: MIN_WORDS <= len(w) < window), *exact):
            for mask in masks:
                found = [(seeds(w, mask), k) for k, w in enumerate(self.words) if chosen(w)]
                found = [(s, k) for s, k in found if len(s)]
                if not found:
                    continue
                seed = np.concatenate([s for s, _ in found])
                item = np.concatenate([np.full(len(s), k) for s, k in found])
                pos = np.concatenate([np.arange(len(s)) for s, _ in found])
                order = np.argsort(seed, kind="stable")
                shift = np.uint64(64 - min(26, max(12, int(len(seed)).bit_length() + 5)))
                bitmap = np.zeros(1 << (64 - int(shift)), bool)
                bitmap[seed >> shift] = True
                self.tables.append((mask, seed[order], item[order], pos[order], shift, bitmap))

    def hits(self, words: np.ndarray, spans: np.ndarray) -> np.ndarray:
        """Distinct (text, item, diagonal) of all seed matches; the diagonal is text minus item position."""
        out = []
        reach = max((len(w) for w in self.words), default=0)
        width = int(np.diff(spans).max(initial=0)) + reach + 1
        for mask, seed, item, pos, shift, bitmap in self.tables:
            s = seeds(words, mask)
            at = np.flatnonzero(bitmap[s >> shift])
            low, high = np.searchsorted(seed, s[at], "left"), np.searchsorted(seed, s[at], "right")
            at, low, n = at[high > low], low[high > low], (high - low)[high > low]
            # repetitive texts and items match many times on one diagonal: a bounded number of matches at once
            for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(np.cumsum(n) // MATCHES)) + 1):
                if not len(part):
                    continue
                m = n[part]
                of = np.repeat(low[part] - np.cumsum(m) + m, m) + np.arange(m.sum())
                text = np.searchsorted(spans, at[part], "right") - 1
                diagonal = np.repeat(at[part] - spans[text], m) - pos[of] + reach
                out.append(np.unique((np.repeat(text, m) * len(self.words) + item[of]) * width + diagonal))
        found = np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)
        both, diagonal = np.divmod(found, width)
        return np.stack([both // len(self.words), both % len(self.words), diagonal - reach], axis=1)

    def overlap(self, words: np.ndarray, item: int, diagonals: np.ndarray) -> tuple[int, int, int]:
        """The greatest (equal words, from, to) of the text's parts under windows that are similar enough, else zeros."""
        own, best = self.words[item], (0, 0, 0)
        size = min(self.window, len(own))
        block = max(1, (1 << 20) // len(own))
        for low in range(0, len(diagonals), block):
            at = diagonals[low:low + block, None] + np.arange(len(own))
            inside = (at >= 0) & (at < len(words))
            same = inside & (words[np.clip(at, 0, len(words) - 1)] == own)
            total = np.zeros((len(at), len(own) + 1), np.int64)
            np.cumsum(same, axis=1, out=total[:, 1:])
            good = total[:, size:] - total[:, :-size] >= needed(size)
            good &= inside[:, :len(own) - size + 1] & inside[:, size - 1:]
            rows = np.flatnonzero(good.any(axis=1))
            if len(rows):
                first, last = good[rows].argmax(axis=1), len(own) - good[rows, ::-1].argmax(axis=1)
                n, start = total[rows, last] - total[rows, first], at[rows, 0]
                top = np.lexsort((start + last, start + first, n))[-1]
                best = max(best, (int(n[top]), int((start + first)[top]), int((start + last)[top])))
        return best

    def scan(self, words: np.ndarray, spans: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, equal words, from, to), the best diagonal for each text and item.

        ``words`` holds many texts end to end, text k at ``spans[k]:spans[k + 1]``.
        """
        found = self.hits(words, spans)
        cuts = np.flatnonzero(np.any(found[1:, :2] != found[:-1, :2], axis=1)) + 1
        for part in np.split(found, cuts) if len(found) else ():
            k, item = int(part[0, 0]), int(part[0, 1])
            n, a, b = self.overlap(words[int(spans[k]):int(spans[k + 1])], item, part[:, 2])
            if n:
                yield k, item, n, a, b
        if self.whole:
            lengths = np.diff(spans)
            for k in np.flatnonzero((lengths > 0) & (lengths < PHRASE_WORDS)).tolist():
                for item in self.whole.get(words[int(spans[k]):int(spans[k + 1])].tobytes(), ()):
                    yield k, item, int(lengths[k]), 0, int(lengths[k])


def slices(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", words: int = SLICE_WORDS) -> Iterator[Slice]:
    """The benchmark in id order, at most ``words`` words (and one item) at a time."""
    items, held = [], 0
    rows = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).orderBy("id", "t")
    for r in rows.toLocalIterator():
        w = unit_hashes(r.t).copy()
        if not len(w):
            continue
        if items and held + len(w) > words:
            yield Slice(items)
            items, held = [], 0
        items.append((r.id, w))
        held += len(w)
    if items:
        yield Slice(items)


def _scanned(part: Slice, texts: pa.Array) -> Iterator[tuple[int, int, int, int, int]]:
    hashes = [unit_hashes(t.as_py()) for t in texts]
    spans = np.concatenate(([0], np.cumsum([len(h) for h in hashes])))
    words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return part.scan(words, spans)


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
             item_text_col: str = "text", slice_words: int = SLICE_WORDS) -> DataFrame:
    """(id, item id, equal words, word positions from and to) of every text and item that overlap."""
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType
    schema = f"{id_col} {kind}, {item_col} {item_kind.simpleString()}, n_equal long, word_from long, word_to long"
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    out = spark.createDataFrame([], schema)
    from pyspark.sql.pandas.types import to_arrow_type
    arrow_kind = to_arrow_type(item_kind)
    for part in slices(benchmark, item_col, item_text_col, slice_words):
        shared = spark.sparkContext.broadcast(part)

        def of(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches, BATCH):
                found = list(_scanned(shared.value, b.column(1)))
                if found:
                    k, item, n, at, to = (list(x) for x in zip(*found))
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(k)), pa.array([shared.value.ids[i] for i in item], arrow_kind),
                         pa.array(n, pa.int64()), pa.array(at, pa.int64()), pa.array(to, pa.int64())],
                        [id_col, item_col, "n_equal", "word_from", "word_to"])
            forget()

        out = out.unionByName(arrow_pass(narrow, schema, of))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", slice_words: int = SLICE_WORDS) -> DataFrame:
    """The rows of ``docs`` that overlap with no benchmark item: one map pass a slice, no shuffle."""
    spark, kind = docs.sparkSession, None
    row = docs.select(F.struct("*").alias("doc"), F.col(text_col).cast("string").alias("t"))
    kind = row.schema["doc"].dataType.simpleString()
    for part in slices(benchmark, words=slice_words):
        shared = spark.sparkContext.broadcast(part)

        def of(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches, BATCH):
                dirty = {k for k, *_ in _scanned(shared.value, b.column(1))}
                clean = pa.array([k not in dirty for k in range(b.num_rows)], pa.bool_())
                yield b.filter(clean)
            forget()

        row = arrow_pass(row, f"doc {kind}, t string", of)
    return row.select("doc.*")


#: All windows of all diagonals for DuckDB: equal words of text and item, counted on each diagonal.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {unit_sql('text')} AS ws FROM documents
), b AS (SELECT row_number() OVER () AS k, item_id, {unit_sql('text')} AS ws FROM benchmark
), it AS (SELECT *, len(ws) AS n, least({WINDOW}, len(ws)) AS size, CAST(ceil(round(least({WINDOW}, len(ws)) * {SIMILARITY}, 6)) AS BIGINT) AS need
          FROM b WHERE len(ws) > 0
), dw AS (SELECT r, unnest(ws) AS word, unnest(generate_series(0, len(ws) - 1)) AS i FROM d
), iw AS (SELECT k, need, unnest(ws) AS word, unnest(generate_series(0, n - 1)) AS j FROM it
), m AS (SELECT dw.r, iw.k, dw.i - iw.j AS diag, list(iw.j) AS js FROM dw JOIN iw ON iw.word = dw.word GROUP BY dw.r, iw.k, diag, iw.need HAVING count(*) >= iw.need
), win AS (SELECT m.*, it.size, it.need, unnest(generate_series(greatest(0, -diag), least(it.n, len(d.ws) - diag) - it.size)) AS j0
           FROM m JOIN it ON it.k = m.k JOIN d ON d.r = m.r
           WHERE it.n >= {PHRASE_WORDS} OR len(d.ws) = it.n
), seg AS (SELECT r, k, diag, js, min(j0) AS a, max(j0) + max(size) AS z FROM win
           WHERE len(list_filter(js, lambda x: x >= j0 AND x < j0 + size)) >= need GROUP BY r, k, diag, js
), res AS (SELECT r, k, len(list_filter(js, lambda x: x >= a AND x < z)) AS n_equal, diag + a AS word_from, diag + z AS word_to FROM seg
), best AS (SELECT *, row_number() OVER (PARTITION BY r, k ORDER BY n_equal DESC, word_from DESC, word_to DESC) AS place FROM res)
SELECT d.doc_id, b.item_id, CAST(n_equal AS BIGINT) AS n_equal, CAST(word_from AS BIGINT) AS word_from, CAST(word_to AS BIGINT) AS word_to
FROM best JOIN d USING (r) JOIN b USING (k) WHERE place = 1
"""
