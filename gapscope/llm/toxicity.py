"""Toxicity of texts after a noisy-channel restoration of disguised words.

Restoration.  Characters become 64 symbols: a boundary, a-z, digit, and 36 classes of
other letters by code point.  A trigram model of these symbols (interpolated, runs of
boundaries as one) is counted over all texts given.  Spans that could be disguised
words are found in the whole text: letters beside look-alike digits and signs, a letter
three times in a row, chains of single characters with one separator between them.  Each span is a
lattice: a run of one character stands for itself, for the letters it looks like
(``LOOKS``), for one or two of them where it is three or longer, and a separator of a
chain may be dropped; each disguise has a cost (``COSTS``, in nats).  Viterbi over the
last two symbols finds the reading of least total cost under model and costs; all other
text has one reading, itself.  Decided prefixes are written out as the search goes, so a
span may be of any length.

Scores.  Features are the hashed 4- to 7-symbol pieces of words, with their boundaries,
that occur in the restored text.  The labelled sample (``SAMPLE`` rows of a label at most, of least
id hash: a documented bound) gives the ``FEATURES`` pieces that go most with label 1, by
the log-likelihood ratio of their document counts, and a logistic regression over them,
each row weighted for the rows of its label that it stands for.

Null texts are read as empty, which have no piece: they get the regression's constant.
A document's label is the greatest of its label rows; null labels and ids count for
nothing.  Without rows of both labels every score is the share of label 1 (0 without
labels).  Repeated rows and ties are scored alike.  Empty tables give empty results.
Extra columns, whatever their names, are carried in ``doc`` and not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapscope.llm.common import arrow_pass, pieces, staged

#: Letters that a sign or digit can stand for.  Fixed values.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
         "!": "i", "|": "il", "+": "t", "€": "e", "£": "l"}
SEPARATORS = " .-_*"
#: Costs in nats: a look-alike, a shortened run, a dropped separator of a chain, a kept one.
COSTS = {"look": 1.0, "run": 1.0, "gap": 0.5, "kept": 2.0}
SYMBOLS = 64
PRIOR = 20.0
PIECES = (4, 5, 6, 7)
BUCKET_BITS = 20
FEATURES = 2000
SAMPLE = 20_000
ROUNDS = 400
PENALTY = 0.1
BATCH = 128
FLUSH = 512
ENTRIES = 50_000


def _symbol(c: str) -> int:
    low = c.lower()[0]
    return ord(low) - 96 if "a" <= low <= "z" else 27 if c.isdigit() else 28 + ord(low) % 36 if low.isalpha() else 0


#: Marks of a code point: letter, look-alike, part of a token, separator, look-alike that is no digit.
_LETTER, _LOOK, _INSIDE, _GAP, _SIGN = 1, 2, 4, 8, 16


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Symbol and marks of every code point of the basic plane; the last entry stands for all beyond."""
    symbols = np.array([0 if 0xD800 <= c < 0xE000 else _symbol(chr(c)) for c in range(1 << 16)], np.uint8)
    symbols[-1] = 0
    marks = np.where(symbols > 0, _INSIDE, 0) | np.where((symbols > 0) & (symbols != 27), _LETTER, 0)
    for chars, mark in ((LOOKS, _LOOK | _INSIDE), (SEPARATORS, _GAP), ([c for c in LOOKS if not c.isdigit()], _SIGN)):
        marks[[ord(c) for c in chars]] |= mark
    return symbols, marks.astype(np.uint8)


def _points(text: str) -> np.ndarray:
    return np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), (1 << 16) - 1)


def symbols_of(text: str) -> np.ndarray:
    """Symbols with one boundary at each end and for each run of other characters."""
    p = _points(text)
    s = np.zeros(len(p) + 2, np.int64)
    s[1:-1] = _tables()[0][p]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] > 0) | (s[:-1] > 0)
    return s[keep]


class CharModel:
    """Costs (negative log probabilities) of a symbol after two others."""

    def __init__(self, counts: np.ndarray):
        n = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(np.float64)
        n2, n1 = n.sum(axis=0), n.sum(axis=(0, 1))
        p1 = (n1 + 1) / (n1.sum() + SYMBOLS)
        p2 = (n2 + PRIOR * p1) / (n2.sum(axis=1, keepdims=True) + PRIOR)
        p3 = (n + PRIOR * p2[None]) / (n.sum(axis=2, keepdims=True) + PRIOR)
        self.cost = (-np.log(p3)).ravel().astype(np.float32)
        self._list, self._seen = None, {}

    def __getstate__(self):
        return {"cost": self.cost, "_list": None, "_seen": {}}

    def costs(self) -> list[float]:
        if self._list is None:
            self._list = self.cost.tolist()
        return self._list

    def read(self, span: str, chain: bool) -> str:
        """The reading of least cost of a span; ``chain``: separators may be dropped."""
        key = (span, chain)
        found = self._seen.get(key)
        if found is None:
            found = decode(span, chain, self.costs())
            if len(span) < 100:
                if len(self._seen) >= ENTRIES:
                    self._seen.clear()
                self._seen[key] = found
        return found


def _runs(span: str) -> list[tuple[str, int]]:
    out, at = [], 0
    low = [c.lower() if len(c.lower()) == 1 else c for c in span]
    while at < len(low):
        end = at + 1
        while end < len(low) and low[end] == low[at]:
            end += 1
        out.append((low[at], end - at))
        at = end
    return out


def edges(char: str, length: int, chain: bool) -> list[tuple[list[int], str, float]]:
    """What a run can stand for: (symbols, text, cost)."""
    sym = _symbol(char)
    gap = chain and char in SEPARATORS
    out = [([sym] * length if sym else [0], char * length, COSTS["kept"] if gap else 0.0)]
    letters = [(x, COSTS["look"]) for x in LOOKS.get(char, "")] + ([(char, 0.0)] if sym and sym != 27 else [])
    for x, cost in letters:
        copies = {1, 2} if length > 2 else {length} if cost else set()
        out += [([_symbol(x)] * k, x * k, cost + (COSTS["run"] if k < length else 0.0)) for k in sorted(copies)]
    if gap:
        out.append(([], "", COSTS["gap"] * length))
    return out


def decode(span: str, chain: bool, cost: list[float]) -> str:
    """Viterbi over the lattice of ``span``; states are the last two symbols."""
    states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
    written: list[str] = []
    for step, (char, length) in enumerate(_runs(span), 1):
        now: dict[int, tuple[float, tuple | None]] = {}
        for syms, text, price in edges(char, length, chain):
            for state, (c, back) in states.items():
                c += price
                for s in syms:
                    if s or state & 63:                     # boundaries in a row are one
                        c += cost[state << 6 | s]
                        state = (state << 6 | s) & 4095
                old = now.get(state)
                if old is None or c < old[0]:
                    now[state] = (c, (back, text))
        states = now
        if step % FLUSH == 0:
            states = _write_decided(states, written)
    best = min(states, key=lambda s: states[s][0] + (cost[s << 6] if s & 63 else 0.0))
    written.extend(_path(states[best][1])[1])
    return "".join(written)


def _path(node: tuple | None) -> tuple[list[tuple], list[str]]:
    nodes = []
    while node is not None:
        nodes.append(node)
        node = node[0]
    nodes.reverse()
    return nodes, [n[1] for n in nodes]


def _write_decided(states: dict, written: list[str]) -> dict:
    """Write out what all paths have in common and cut it off their heads."""
    paths = {s: _path(back) for s, (_, back) in states.items()}
    first = next(iter(paths.values()))[0]
    same = 0
    while same < len(first) and all(same < len(p[0]) and p[0][same] is first[same] for p in paths.values()):
        same += 1
    written.extend(n[1] for n in first[:same])
    made: dict[int, tuple] = {}                              # shared nodes stay shared
    out = {}
    for s, (c, _) in states.items():
        back = None
        for node in paths[s][0][same:]:
            back = made.setdefault(id(node), (back, node[1]))
        out[s] = (c, back)
    return out


def spans(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, chain) of the parts of a text that could be disguised words, in order."""
    symbols, marks = (t[_points(text)] for t in _tables())
    letter, look, inside = ((marks & m) > 0 for m in (_LETTER, _LOOK, _INSIDE))
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    start, end = edge[::2], edge[1::2]                       # tokens
    if not len(start):
        return []
    beside = np.flatnonzero((look[1:] & letter[:-1]) | (letter[1:] & look[:-1]))
    same = np.flatnonzero(letter[2:] & (symbols[2:] == symbols[1:-1]) & (symbols[2:] == symbols[:-2]))
    odd = np.unique(np.searchsorted(start, np.concatenate([beside, same]), "right") - 1)
    # chains: tokens of one character, one separator apart, three or more, two letters at least; a sign that ends a token is no part
    ending = ((marks & _SIGN) > 0) & ~np.append(inside[1:], False) & np.append(False, inside[:-1])
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside & ~ending, [False]])))
    first, last = edge[::2], edge[1::2]
    one = np.flatnonzero(last - first == 1)
    found = []
    if len(one) > 2:
        sep = np.append((marks & _GAP) > 0, False)
        linked = (np.diff(one) == 1) & (first[one[1:]] - last[one[:-1]] == 1) & sep[last[one[:-1]]]
        cut = np.concatenate([[0], np.flatnonzero(~linked) + 1, [len(one)]])
        found = [(int(first[one[a]]), int(last[one[b - 1]]), True) for a, b in zip(cut[:-1], cut[1:])
                 if b - a > 2 and letter[first[one[a:b]]].sum() > 1]
    if found:
        taken = np.zeros(len(marks), bool)
        for a, b, _ in found:
            taken[a:b] = True
        odd = [t for t in odd if not taken[start[t]:end[t]].any()]
    found += [(int(start[t]), int(end[t]), False) for t in odd]
    return sorted(found)


def restore(text: str, model: CharModel) -> tuple[str, int]:
    """The restored text and how many spans changed."""
    out, at, changed = [], 0, 0
    for a, b, chain in spans(text):
        span = text[a:b]
        read = model.read(span, chain)
        if read != span.lower():
            out += [text[at:a], read]
            at, changed = b, changed + 1
    return ("".join(out) + text[at:], changed) if changed else (text, 0)


def pieces_of(text: str, among: np.ndarray | None = None) -> np.ndarray:
    """Distinct buckets of the word pieces of a text; ``among``: only those that it marks."""
    s = symbols_of(text).astype(np.uint64)
    found, whole, key = [], np.ones(max(0, len(s) - 2), bool), s
    for n in range(2, PIECES[-1] + 1):
        if len(s) < n:
            break
        key = key[:-1] << np.uint64(6) | s[n - 1:]
        if n > 2:                                            # no boundary but at the ends
            whole = whole[:len(key)] & (s[n - 2:-1] > 0)
        if n in PIECES:
            bucket = (key[whole] * np.uint64(8) + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BUCKET_BITS)
            found.append(bucket if among is None else bucket[among[bucket]])
    return np.unique(np.concatenate(found)).astype(np.int64) if found else np.zeros(0, np.int64)


def fit_characters(docs: DataFrame, text_col: str = "text") -> CharModel:
    """The character model of all texts; at most 64^3 counts reach the driver."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS ** 3, np.int64)
        for b in pieces(batches, BATCH):
            s = [symbols_of(t) for t in b.column(0).to_pylist() if t]
            if s:
                codes = np.concatenate([x[:-2] << 12 | x[1:-1] << 6 | x[2:] for x in s if len(x) > 2] or [np.zeros(0, np.int64)])
                total += np.bincount(codes, minlength=SYMBOLS ** 3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["code", "n"])

    counts = np.zeros(SYMBOLS ** 3, np.int64)
    found = arrow_pass(docs.select(F.col(text_col).cast("string").alias("t")), "code int, n long", of)
    for r in found.groupBy("code").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.code] = r.n
    return CharModel(counts)


class Model:
    """Chosen buckets, their weights and the constant."""

    def __init__(self, chars: CharModel, buckets: np.ndarray, weights: np.ndarray, constant: float):
        self.chars, self.constant = chars, constant
        self.weight, self.chosen = np.zeros(1 << BUCKET_BITS, np.float32), np.zeros(1 << BUCKET_BITS, bool)
        self.weight[buckets], self.chosen[buckets] = weights, True

    def score(self, text: str) -> float:
        x = self.constant + float(self.weight[pieces_of(text, self.chosen)].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(x, -500, 500))))


def _regress(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """Penalised logistic regression over sparse 0/1 rows by accelerated gradient steps, scaled by coordinate."""
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate(rows) if len(row) else np.zeros(0, np.int64)
    weight = weight / weight.sum()
    base = float(np.log((weight * y).sum() / (weight * (1 - y)).sum()))
    w, b, first, second = np.zeros(n), base, np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, ROUNDS + 1):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(row, w[col], minlength=len(rows)), -500, 500)))
        e = weight * (p - y)
        g = np.append(np.bincount(col, e[row], minlength=n) + PENALTY / len(rows) * w, e.sum())
        first, second = .9 * first + .1 * g, .99 * second + .01 * g * g
        step = .05 * (first / (1 - .9 ** t)) / (np.sqrt(second / (1 - .99 ** t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def fit(docs: DataFrame, labels: DataFrame, chars: CharModel, text_col: str = "text", id_col: str = "doc_id", label_id_col: str = "doc_id",
        label_col: str = "toxic", sample: int = SAMPLE, features: int = FEATURES) -> Model:
    """Learn from the documents of ``docs`` that have a label."""
    labels = (labels.select(F.col(label_id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
              .groupBy("id").agg(F.max("y").alias("y")))
    sizes = {r.y: r.n for r in labels.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    least = Window.partitionBy("y").orderBy("h", "id")
    share = F.when(F.col("y") == 1, min(1.0, (1.5 * sample + 100) / sizes.get(1, 1))).otherwise(min(1.0, (1.5 * sample + 100) / sizes.get(0, 1)))
    chosen = (labels.withColumn("h", F.xxhash64("id")).where(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30))
              .withColumn("at", F.row_number().over(least)).where(F.col("at") <= sample).select("id", "y"))
    # at most 2 x sample rows of two numbers
    shared = docs.sparkSession.sparkContext.broadcast(chars)

    def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, BATCH):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([restore(t, shared.value)[0] for t in b.column(1).to_pylist()], pa.string())], ["y", "t"])

    rows = (docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
            .join(F.broadcast(chosen), "id").select("y", "t"))
    texts = staged(arrow_pass(rows, "y int, t string", restored), "toxicity-sample")
    counts = {r.y: r.n for r in texts.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    if not n0 or not n1:
        all_rows = sizes.get(0, 0) + sizes.get(1, 0)
        known = sizes.get(1, 0) / all_rows if all_rows else 0.0
        return Model(chars, np.zeros(0, np.int64), np.zeros(0), float(np.log(max(known, 1e-300)) - np.log1p(-min(known, 1 - 1e-16))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << BUCKET_BITS), np.int32)
        for b in pieces(batches, BATCH):
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen[y, pieces_of(t)] += 1
        at = np.flatnonzero(seen.sum(axis=0))
        for a in range(0, len(at), 50_000):
            part = at[a:a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *(pa.array(seen[y, part].astype(np.int64)) for y in (0, 1))], ["bucket", "c0", "c1"])

    c0, c1 = F.col("c0"), F.col("c1")
    part = lambda n, expected: F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)
    seen, all_n = c0 + c1, float(n0 + n1)
    ratio = (part(c1, seen * n1 / all_n) + part(c0, seen * n0 / all_n) + part(n1 - c1, (all_n - seen) * n1 / all_n) + part(n0 - c0, (all_n - seen) * n0 / all_n))
    best = (arrow_pass(texts, "bucket int, c0 long, c1 long", count).groupBy("bucket").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
            .where(c1 * n0 > c0 * n1).orderBy(ratio.desc(), "bucket").limit(features).select("bucket"))
    buckets = np.array(sorted(r.bucket for r in best.collect()), np.int64)
    place = np.full(1 << BUCKET_BITS, -1, np.int32)
    place[buckets] = np.arange(len(buckets))
    spot = docs.sparkSession.sparkContext.broadcast(place)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, BATCH):
            at = [spot.value[pieces_of(t, spot.value >= 0)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at, pa.list_(pa.int32()))], ["y", "at"])

    per_row = {0: sizes[0] / n0, 1: sizes[1] / n1}

    def regress(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group.column("y").to_pylist(), map(tuple, group.column("at").to_pylist())))
        y = np.array([r[0] for r in rows], float)
        w, b = _regress([np.array(r[1], np.int64) for r in rows], y, np.where(y > 0, per_row[1], per_row[0]), len(buckets))
        return pa.table({"w": pa.array([w.tolist()], pa.list_(pa.float64())), "b": pa.array([float(b)])})

    # one bounded group: 2 x sample rows of at most ``features`` numbers
    found = arrow_pass(texts, "y int, at array<int>", vectors).withColumn("one", F.lit(0)).groupBy("one").applyInArrow(regress, "w array<double>, b double").first()
    return Model(chars, buckets, np.array(found.w), found.b)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` as one struct ``doc`` with ``restored`` text, number of ``changes`` and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)      # 64^3 and 2^20 floats
    row = docs.select(F.struct("*").alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, BATCH):
            read = [restore(t, shared.value.chars) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([r[0] for r in read], pa.string()), pa.array([r[1] for r in read], pa.int32()),
                 pa.array([shared.value.score(r[0]) for r in read], pa.float64())], ["doc", "restored", "changes", "score"])

    kind = row.schema["doc"].dataType.simpleString()
    return arrow_pass(row, f"doc {kind}, restored string, changes int, score double", of)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
