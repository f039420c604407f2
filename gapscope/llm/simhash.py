"""SimHash near-duplicates with a Gray-order hierarchical index.

``fingerprints``: 64-bit SimHash of each text.  A-Z are lower-cased, words are
runs of bytes other than space and 0x09-0x0D, features are word shingles
(repeats included; fewer words than a shingle: the whole sequence), hashed with
XXH64 (seed 42); a bit is 1 if it is set in over half the hashes.  A text
without words, or a null one, has fingerprint zero.

``link_components``: distinct fingerprints that differ in at most ``distance``
bits are linked, and linked ones form components.

* *Dealing out.*  The 64 bits are cut into blocks; two fingerprints within the
  distance agree in all but ``distance`` blocks, so each fingerprint goes to the
  group of every choice of agreeing blocks (more, smaller blocks as the table
  grows).  A group above ``GROUP_ROWS`` is dealt over pairs of chunks: every
  two members still meet in a task, and no task holds more than two chunks.
* *Searching a group.*  Its fingerprints are sorted by Gray rank, so neighbours
  share bits.  Nodes of ``FANOUT`` children keep the bit pattern that all below
  share; a child stores only the bits its parent has not.  A query walks down
  adding the differences on each level's bits, and drops a whole subtree as
  soon as the sum passes the distance, or once all of it has joined the
  query's component.
* A group returns a spanning forest (fewer links than members), never all its
  pairs; the components of all forests are those of all links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapscope.functions.components import components
from gapscope.llm.common import arrow_pass, pieces, shuffle_partitions, staged

SHINGLE = 4
DISTANCE = 4
SEED = 42
FANOUT = 8
QUERIES_AT_ONCE = 256
GROUP_ROWS = 20_000
BITS_AT_ONCE = 1 << 16


# ---------------------------------------------------------------- fingerprints

def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text as an unsigned integer."""
    words = (text or "").encode().lower().split()       # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts[:len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist())]
    h = np.array(hashes, np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), BITS_AT_ONCE):
        part = h[at:at + BITS_AT_ONCE]
        ones += np.add.reduce(np.unpackbits(part.view(np.uint8), bitorder="little").reshape(len(part), 64), axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): one row per row of ``docs``; ``fp`` is the fingerprint as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1000):
            fp = np.array([simhash(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["id", "fp"])

    return arrow_pass(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")), f"id {kind}, fp long", of)


# ---------------------------------------------------------------- the index

def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each code word in the reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Nodes over Gray-sorted distinct fingerprints, level 0 the fingerprints themselves."""

    def __init__(self, fps: np.ndarray):
        self.fps = fps[np.argsort(gray_rank(fps), kind="stable")]
        pattern, mask = self.fps, np.full(len(self.fps), ~np.uint64(0))
        self.patterns, self.masks = [pattern], []
        while len(pattern) > 1:
            first = np.arange(0, len(pattern), FANOUT)
            lead = np.repeat(pattern[first], np.diff(np.append(first, len(pattern))))
            shared = np.bitwise_and.reduceat(mask & ~(pattern ^ lead), first)
            above = np.repeat(shared, np.diff(np.append(first, len(pattern))))
            self.masks.append(mask & ~above)           # what a node adds to its parent's bits
            pattern, mask = pattern[first] & shared, shared
            self.patterns.append(pattern)
        self.masks.append(mask)

    def components(self, distance: int) -> np.ndarray:
        """For each position the least position that links of ``distance`` bits reach."""
        n = len(self.fps)
        label = np.arange(n)
        for at in range(0, n, QUERIES_AT_ONCE):
            q = np.arange(at, min(n, at + QUERIES_AT_ONCE))
            a, b = self._near(q, label, distance)
            label = _joined(label, a, b)
        return label

    def _near(self, queries: np.ndarray, label: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """Links from queries to later positions of other components."""
        uniform = [label]                               # the one component below a node, or -1
        for level in range(1, len(self.patterns)):
            first = np.arange(0, len(uniform[-1]), FANOUT)
            low, high = np.minimum.reduceat(uniform[-1], first), np.maximum.reduceat(uniform[-1], first)
            uniform.append(np.where(low == high, low, -1))
        top = len(self.patterns) - 1
        q, node = queries, np.zeros(len(queries), np.int64)
        diff = np.bitwise_count((self.fps[q] ^ self.patterns[top][0]) & self.masks[top][0]).astype(np.int16)
        span = FANOUT ** top
        for level in range(top, -1, -1):
            if level < top:
                span //= FANOUT
                children = node[:, None] * FANOUT + np.arange(FANOUT)
                ok = children < len(self.patterns[level])
                q, diff, node = np.repeat(q, FANOUT)[ok.ravel()], np.repeat(diff, FANOUT)[ok.ravel()], children[ok]
                diff = diff + np.bitwise_count((self.fps[q] ^ self.patterns[level][node]) & self.masks[level][node])
            keep = (diff <= distance) & ((node + 1) * span - 1 > q) & (uniform[level][node] != label[q])
            q, node, diff = q[keep], node[keep], diff[keep]
        return q, node


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the links (a, b): minima spread over the links until stable."""
    if not len(a):
        return label
    root = np.arange(len(label))
    x, y = label[a], label[b]
    while True:
        low = np.minimum(root[x], root[y])
        if (root[x] == root[y]).all():
            return root[label]
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while (root[root] != root).any():
            root = root[root]


# ---------------------------------------------------------------- linking

def block_plan(n: int, distance: int = DISTANCE) -> list[tuple[tuple[int, int], ...]]:
    """For each group family the bit ranges (from, to) that its members agree in."""
    for blocks in range(distance + 1, 3 * distance + 1):
        cuts = [64 * i // blocks for i in range(blocks + 1)]
        agree = blocks - distance
        bits = min(sum(sorted(cuts[i + 1] - cuts[i] for i in range(blocks))[:agree]), 62)
        if n <= (1 << bits) * 4096:
            break
    ranges = [(cuts[i], cuts[i + 1]) for i in range(blocks)]
    return list(combinations(ranges, agree))


def _mask(ranges: tuple[tuple[int, int], ...]) -> int:
    m = sum(((1 << (to - at)) - 1) << at for at, to in ranges)
    return m - (1 << 64) if m >> 63 else m


def _forests(distance: int):
    """Spanning forests of the groups in a task's rows, which come sorted by group."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None                                    # rows of the group that may go on
        for b in batches:
            now = np.stack([b.column(i).to_numpy() for i in range(4)]) if b.num_rows else None
            if now is None:
                continue
            held = now if held is None else np.concatenate([held, now], axis=1)
            new = np.flatnonzero((held[:3, 1:] != held[:3, :-1]).any(axis=0)) + 1
            if len(new):
                done, held = held[:, :new[-1]], held[:, new[-1]:]
                yield from links(done)
        if held is not None:
            yield from links(held)

    def links(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        cut = np.flatnonzero((rows[:3, 1:] != rows[:3, :-1]).any(axis=0)) + 1
        edges = np.concatenate(([0], cut, [rows.shape[1]]))
        out = []
        for at, to in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if to - at < 2:
                continue
            index = GrayIndex(rows[3, at:to].view(np.uint64))
            label = index.components(distance)
            at_ = np.flatnonzero(label != np.arange(len(label)))
            if len(at_):
                out.append((index.fps[at_].view(np.int64), index.fps[label[at_]].view(np.int64)))
        if out:
            a, b = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return of


def link_components(fps: DataFrame, distance: int = DISTANCE, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(node, root) for every fingerprint of the distinct ``fps`` (column ``fp``) that is not its component's root."""
    spark = fps.sparkSession
    families = block_plan(fps.count(), distance)
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_mask(r))) for r in families])).alias("family", "key"))
    sizes = keyed.groupBy("family", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_rows)
    large = staged(sizes.select("family", "key", F.ceil(F.col("n") / group_rows).cast("long").alias("chunks")), "simhash-large")
    if large.isEmpty():
        dealt = keyed.withColumn("part", F.lit(0).cast("long"))
    else:
        # chunk pairs (i, j), i < j: a member of chunk c takes part in every pair that has c
        chunk = F.pmod(F.xxhash64("fp", "family"), F.col("chunks"))
        pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda j: F.when(
            j != chunk, F.least(j, chunk) * F.col("chunks") + F.greatest(j, chunk)))
        dealt = keyed.join(large, ["family", "key"], "left").select("fp", "family", "key", F.explode(F.when(
            F.coalesce("chunks", F.lit(1)) < 2, F.array(F.lit(0).cast("long"))).otherwise(F.array_compact(pair))).alias("part"))
    rows = dealt.select(F.col("family").cast("long").alias("family"), "key", "part", "fp")
    rows = rows.repartition(shuffle_partitions(spark), "family", "key", "part").sortWithinPartitions("family", "key", "part")
    return components(arrow_pass(rows, "a long, b long", _forests(distance)), lambda df: staged(df, "simhash-links"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    distance: int = DISTANCE) -> DataFrame:
    """One row per row of ``docs``: id, ``fp`` (signed long), ``component`` (least id reachable).

    Null ids are never a component's name: their rows take the least id they
    reach, or null.  Repeated rows give repeated results; an empty table none.
    """
    prints = staged(fingerprints(docs, id_col, text_col, shingle), "simhash-prints")
    distinct = staged(prints.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    roots = link_components(distinct.select("fp"), distance)
    labelled = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    names = labelled.groupBy("root").agg(F.min("least").alias("component"))
    of_fp = labelled.join(names, "root").select("fp", "component")
    return prints.join(of_fp, "fp").select(F.col("id").alias(id_col), "fp", "component")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The rows of ``docs`` without all but one document of each component (the one of least id).

    Rows of one ``doc_id`` and one text are one document: one of them stays.  Rows of one id
    and different texts are different documents, each in the component of its text.  A row
    without an id gets a number from its text above 2^62, so it yields to rows with ids.
    """
    own = F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), own).alias("key"), F.xxhash64(F.lit("text"), text).alias("digest"),
                        F.struct("*").alias("doc"))
    found = near_duplicates(keyed.select(F.struct("key", "digest").alias("row"), F.col("doc.text").alias("text")), "row", "text", shingle, distance)
    found = staged(found, "simhash-found")
    gone = found.where("row <> component").select("row.key", "row.digest").distinct()
    kept = keyed.join(gone, ["key", "digest"], "left_anti")
    if not found.groupBy("row.key", "row.digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        kept = kept.dropDuplicates(["key", "digest"])
    return kept.select("doc.*")
