"""Exact top-k inner products by best-first search in M-trees.

Vectors become integers, floor(scale * x).  With M2 the greatest squared length, an
object x gets one more coordinate sqrt(M2 - |x|^2) and a query the coordinate 0: the
Euclidean distance of the two is sqrt(|q|^2 + M2 - 2 q.x), so the nearest objects are
those of greatest inner product, in a real metric.

Equal vectors are one object with its k + 1 least ids (one id may be the query's own).
Objects are dealt to shards around pivots (a bounded sample), large ones in chunks,
so a shard has at most about ``SHARD_ROWS`` objects.  Each shard is an M-tree in pages of
``PAGE`` entries: routing object, covering radius, distance to the parent's routing
object.  A search takes the page of least bound first; |d(q, parent) - d(entry, parent)|
- radius, made of stored distances, decides whether an entry's own distance is computed
at all.  Queries go in blocks first to the shard of their nearest pivot, which gives each a bound on
its k-th distance, then with that bound to all shards, where a task keeps its trees and the queries
pass by.  Scores are exact integers,
and bounds are compared with a margin above rounding, so ties are kept.

Null vectors, vectors with null or non-finite components and null ids take no part;
repeated rows (same id, same vector) count once; vectors of another length than the
query's are no candidates; a query without candidates has no rows; empty tables give none.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapscope.llm.common import arrow_pass, pieces, shuffle_partitions, staged

PAGE = 256
SHARD_ROWS = 8192
MAX_PIVOTS = 1024
QUERY_BLOCK = 256
HELD_BYTES = 1 << 26        # of the trees a task holds at once, one at least
MARGIN = 1e-9


class MTree:
    """A bulk-loaded M-tree over distinct integer vectors with their extra coordinate."""

    FIELDS = ("objects", "extra", "first", "entry_object", "entry_child", "entry_radius", "entry_parent")

    def __init__(self, objects: np.ndarray, extra: np.ndarray, first=None, entry_object=None, entry_child=None, entry_radius=None, entry_parent=None):
        self.objects, self.extra, self.real = objects, extra, None
        self.first, self.entry_object, self.entry_child, self.entry_radius, self.entry_parent = first, entry_object, entry_child, entry_radius, entry_parent

    @classmethod
    def build(cls, objects: np.ndarray, extra: np.ndarray, page: int = PAGE) -> MTree:
        tree = cls(objects, extra)
        pages: list[list[tuple[int, int, float, float]]] = [[]]
        r = np.random.default_rng(len(objects))
        # (page to fill, its members, distances to the page's routing object)
        todo = [(0, np.arange(len(objects)), np.zeros(len(objects)))]
        while todo:
            at, members, above = todo.pop()
            if len(members) <= page:
                pages[at] = [(int(o), -1, 0.0, float(d)) for o, d in zip(members, above)]
                continue
            n = min(page, -(-len(members) // page))
            routes = r.choice(len(members), max(2, n), replace=False)
            d = np.stack([tree.between(int(members[k]), members) for k in routes])
            own = np.argmin(d, axis=0)
            if np.bincount(own).max() == len(members):
                own = np.arange(len(members)) % len(routes)     # no distance tells them apart
            for k, route in enumerate(routes):
                inside = np.flatnonzero(own == k)
                if len(inside):
                    pages.append([])
                    pages[at].append((int(members[route]), len(pages) - 1, float(d[k, inside].max()), float(above[route])))
                    todo.append((len(pages) - 1, members[inside], d[k, inside]))
        flat = [e for p in pages for e in p]
        tree.first = np.cumsum([0] + [len(p) for p in pages]).astype(np.int64)
        tree.entry_object, tree.entry_child = (np.array([e[k] for e in flat], np.int64) for k in (0, 1))
        tree.entry_radius, tree.entry_parent = (np.array([e[k] for e in flat], np.float64) for k in (2, 3))
        return tree

    def between(self, a: int, others: np.ndarray) -> np.ndarray:
        x, y = self.objects[a].astype(np.float64), self.objects[others].astype(np.float64)
        return np.sqrt(((y - x) ** 2).sum(axis=1) + (self.extra[others] - self.extra[a]) ** 2)

    def _real(self) -> np.ndarray:
        """The entries' objects, page by page: a page is read in one piece."""
        if self.real is None:
            self.real = self.objects[self.entry_object].astype(np.float64)
        return self.real

    def search(self, q: np.ndarray, k: int, m2: int, bound: float = np.inf) -> tuple[np.ndarray, np.ndarray, int]:
        """Objects whose score no k others beat, their scores, and how many distances were computed."""
        square = int(q @ q) + m2
        # below 2^53 all sums are whole numbers that a double holds exactly, and products run in BLAS
        exact = m2 < 1 << 53 and int(q @ q) < 1 << 53
        point = q.astype(np.float64) if exact else q
        found: list[tuple[int, int]] = []           # (score, object) of all within the bound when met
        best: list[int] = []                        # heap of the k greatest scores
        heap = [(0.0, 0, np.inf)]                   # (least distance inside, page, distance to its routing object)
        computed = 0
        while heap:
            least, page, above = heapq.heappop(heap)
            if least > bound:
                break
            lo, hi = self.first[page], self.first[page + 1]
            entries = np.arange(lo, hi)
            if above < np.inf:                      # the stored distances speak first
                entries = entries[np.abs(above - self.entry_parent[lo:hi]) - self.entry_radius[lo:hi] <= bound]
            if not len(entries):
                continue
            objects = self.entry_object[entries]
            if exact:
                scores = (self._real()[lo:hi] if len(entries) == hi - lo else self._real()[entries]) @ point
            else:
                scores = self.objects[objects] @ point
            computed += len(entries)
            d = np.sqrt(np.maximum(0, square - 2 * scores).astype(np.float64))
            if self.entry_child[lo] < 0:
                near = np.flatnonzero(d <= bound)
                if len(near) > k and len(best) == k:      # all but the greatest fall out one by one anyway
                    near = near[scores[near] >= best[0]]
                for s, o in zip(scores[near].astype(np.int64).tolist(), objects[near].tolist()):
                    if len(best) < k:
                        heapq.heappush(best, s)
                    elif s > best[0]:
                        heapq.heapreplace(best, s)
                    elif s < best[0]:
                        continue
                    found.append((s, o))
                if len(best) == k:
                    bound = min(bound, margin(square - 2 * best[0]))
            else:
                for e, x in zip(entries.tolist(), d.tolist()):
                    low = max(0.0, x - self.entry_radius[e])
                    if low <= bound:
                        heapq.heappush(heap, (low, int(self.entry_child[e]), x))
        worst = best[0] if len(best) == k else -(1 << 62)
        kept = [(s, o) for s, o in found if s >= worst]
        return np.array([o for _, o in kept], np.int64), np.array([s for s, _ in kept], np.int64), computed

    def row(self) -> dict[str, bytes]:
        return {f: getattr(self, f).tobytes() for f in self.FIELDS}

    @classmethod
    def of_row(cls, row: dict[str, bytes], dim: int) -> MTree:
        kinds = (np.int64, np.float64, np.int64, np.int64, np.int64, np.float64, np.float64)
        parts = [np.frombuffer(row[f], kind) for f, kind in zip(cls.FIELDS, kinds)]
        return cls(parts[0].reshape(-1, dim), *parts[1:])


def margin(square: float) -> float:
    """A distance a little above sqrt(square), beyond what rounding can take away."""
    return float(np.sqrt(max(0.0, float(square)))) * (1 + MARGIN) + MARGIN


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, v): distinct rows with finite vectors, components floor(scale * x) as long."""
    v = F.col(vec_col).cast("array<double>")
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vectors.where(usable & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("v")).distinct()


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _shards(objects: DataFrame, m2: int, dim: int, n: int, shard_rows: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Staged trees (shard, home, vids, tree fields) of one vector length; pivots and their extra coordinates."""
    spark = objects.sparkSession
    want = min(MAX_PIVOTS, max(1, n // shard_rows))
    picked = objects.select("v", F.xxhash64("vid").alias("h")).orderBy("h").limit(want).collect()
    pivots = np.array([r.v for r in picked], np.int64)
    extra = np.sqrt(np.maximum(0, m2 - (pivots * pivots).sum(axis=1)).astype(np.float64))
    shared = spark.sparkContext.broadcast((pivots, extra))

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, e = shared.value
        for b in pieces(batches, 1024):
            v = _matrix(b.column(1))
            x = np.sqrt(np.maximum(0, m2 - (v * v).sum(axis=1)).astype(np.float64))
            near = np.argmax(2 * (v @ p.T) + 2 * x[:, None] * e[None] - ((p * p).sum(axis=1) + e * e)[None], axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near.astype(np.int64))], ["vid", "v", "home"])

    dealt = arrow_pass(objects.select("vid", "v"), "vid long, v array<long>, home long", home)
    dealt = staged(dealt, "mtree-dealt")
    sizes = dealt.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("long").alias("chunks"))
    # one row a pivot: shards are numbered through from 0
    sizes = sizes.withColumn("start", F.sum("chunks").over(Window.orderBy("home")) - F.col("chunks"))
    keyed = dealt.join(sizes, "home").withColumn("chunk", F.pmod(F.xxhash64("vid"), F.col("chunks")))
    keyed = keyed.withColumn("shard", F.col("start") + F.col("chunk"))

    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by("vid")
        v = _matrix(group.column("v").combine_chunks())
        tree = MTree.build(v, np.sqrt(np.maximum(0, m2 - (v * v).sum(axis=1)).astype(np.float64)))
        fields = {k: pa.array([x], pa.binary()) for k, x in tree.row().items()}
        return pa.table({**{k: group.column(k)[:1] for k in ("shard", "home", "chunk")},
                         "vids": pa.array([group.column("vid").to_pylist()], pa.list_(pa.int64())), **fields})

    schema = "shard long, home long, chunk long, vids array<long>, " + ", ".join(f"{f} binary" for f in MTree.FIELDS)
    return staged(keyed.groupBy("shard").applyInArrow(build, schema), "mtree-shards"), pivots, extra


def _searched(queries: DataFrame, trees: DataFrame, tiles: int, dim: int, k: int, m2: int) -> DataFrame:
    """(qid, vid, score): the best of each query in the trees of its tile.

    ``queries`` are (tile, vid, v, bound), ``trees`` (tile, vids, tree fields).  A task takes the trees of a tile, then its
    queries as they come: nothing is joined, so neither side can be broadcast, and a task holds one tile's trees.
    """
    spark = queries.sparkSession
    kinds = {"tile": "int", "asks": "boolean", "vid": "long", "v": "array<long>", "bound": "double", "vids": "array<long>", **{f: "binary" for f in MTree.FIELDS}}
    both = [df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(kind).alias(c) for c, kind in kinds.items()])
            for df in (queries.withColumn("asks", F.lit(True)), trees.withColumn("asks", F.lit(False)))]
    n = min(tiles, shuffle_partitions(spark))
    dealt = both[0].unionByName(both[1]).repartitionById(n, F.pmod("tile", F.lit(n))).sortWithinPartitions("tile", "asks")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for b in pieces(batches, QUERY_BLOCK):
            tile = b.column("tile").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(tile)) + 1).tolist(), len(tile)]
            for lo, hi in zip(cuts, cuts[1:]):
                if tile[lo] != at:
                    at, held = tile[lo], []
                run = b.slice(lo, hi - lo)
                for row in run.filter(pc.invert(run.column("asks"))).to_pylist():
                    held.append((MTree.of_row(row, dim), np.array(row["vids"], np.int64)))
                asks = run.filter(run.column("asks"))
                out = [_best(held, v, bound, k, m2) for v, bound in zip(_matrix(asks.column("v")) if len(asks) else (), asks.column("bound").to_pylist())]
                if sum(len(vids) for vids, _ in out):
                    qids = np.repeat(asks.column("vid").to_numpy(), [len(vids) for vids, _ in out])
                    yield pa.RecordBatch.from_arrays([pa.array(qids), *(pa.array(np.concatenate([o[c] for o in out])) for c in (0, 1))], ["qid", "vid", "score"])

    return arrow_pass(dealt, "qid long, vid long, score long", of)


def _best(held: list[tuple[MTree, np.ndarray]], q: np.ndarray, bound: float, k: int, m2: int) -> tuple[np.ndarray, np.ndarray]:
    """Vids and scores of the objects in the trees that no k others beat; more than k only by ties."""
    vids, scores = np.empty(0, np.int64), np.empty(0, np.int64)
    square = int(q @ q) + m2
    for tree, names in held:
        objects, more, _ = tree.search(q, k, m2, bound)
        vids, scores = np.concatenate([vids, names[objects]]), np.concatenate([scores, more])
        if len(scores) >= k:
            worst = int(np.partition(scores, len(scores) - k)[len(scores) - k])
            vids, scores = vids[scores >= worst], scores[scores >= worst]
            bound = min(bound, margin(square - 2 * worst))
    return vids, scores


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256,
          shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` greatest inner products of each row where ``is_query`` holds.

    ``is_query`` is a condition on a column named ``id``.  Ties go to the smaller id.
    """
    spark = vectors.sparkSession
    rows = staged(integer_vectors(vectors, id_col, vec_col, scale), "mtree-rows")
    # the k + 1 least ids of equal vectors: a group limit keeps a common vector from gathering
    order = Window.partitionBy("v").orderBy("id")
    least = rows.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1)
    objects = least.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("dim", F.size("v"))
    objects = staged(objects.withColumn("vid", F.monotonically_increasing_id()), "mtree-objects")
    # merge: as compressed columns the objects look small enough to broadcast
    asked = staged(rows.where(is_query).join(objects.select("v", "vid").hint("merge"), "v").select("id", F.col("vid").alias("qid")), "mtree-asked")
    queries = objects.select("vid", "v", "dim").join(asked.select(F.col("qid").alias("vid")).distinct(), "vid", "left_semi")
    square = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    out = spark.createDataFrame([], "qid long, vid long, score long")
    for dim, m2, n in objects.groupBy("dim").agg(F.max(square).alias("m2"), F.count(F.lit(1)).alias("n")).where("dim > 0").collect():
        trees, pivots, extra = _shards(objects.where(F.col("dim") == dim), m2, dim, n, shard_rows)
        out = out.unionByName(_answers(queries.where(F.col("dim") == dim), trees, pivots, extra, dim, k, m2))
    listed = out.join(objects.select("vid", "ids").hint("merge"), "vid").select("qid", "score", F.explode("ids").alias("id"))
    best = Window.partitionBy("qid").orderBy(F.col("score").desc(), "id")
    listed = listed.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k + 1)
    listed = listed.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))).alias("best"))
    answers = asked.join(listed, "qid").select(F.col("id").alias("query_id"), F.posexplode(
        F.slice(F.filter("best", lambda b: b["id"] != F.col("id")), 1, k)).alias("at", "b"))
    return answers.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.id").alias(id_col), (-F.col("b.s")).alias("score"))


def _answers(queries: DataFrame, trees: DataFrame, pivots: np.ndarray, extra: np.ndarray, dim: int, k: int, m2: int) -> DataFrame:
    spark = queries.sparkSession
    shared = spark.sparkContext.broadcast((pivots, extra))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, e = shared.value
        for b in pieces(batches, 1024):
            home = np.argmax(2 * (_matrix(b.column(1)) @ p.T) - ((p * p).sum(axis=1) + e * e)[None], axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(home.astype(np.int64))], ["vid", "v", "home"])

    homes = arrow_pass(queries.select("vid", "v"), "vid long, v array<long>, home long", near)
    spread = staged(homes.withColumn("part", F.pmod(F.xxhash64("vid"), F.lit(1 << 20))), "mtree-queries")
    fields = ["vids", *MTree.FIELDS]
    # a tile of the first search: a block of the queries around one pivot, and that pivot's tree; a row a pivot at most
    total = spread.groupBy("home").agg(F.count(F.lit(1)).alias("asked"), F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("n"))
    total = total.withColumn("start", (F.sum("n").over(Window.orderBy("home")) - F.col("n")).cast("int"))
    tiles, asked = total.agg(F.sum("n"), F.sum("asked")).first()
    if tiles is None:
        return spark.createDataFrame([], "qid long, vid long, score long")
    total = F.broadcast(total)
    part_of = lambda n: F.floor(F.col("part") * n / (1 << 20)).cast("int")
    first = spread.join(total, "home").select((F.col("start") + part_of(F.col("n"))).alias("tile"), "vid", "v", F.lit(float("inf")).alias("bound"))
    at_home = trees.where("chunk = 0").join(total, "home").select(F.explode(F.sequence("start", F.expr("start + n - 1"))).alias("tile"), *fields)
    # the (k + 1)-th score at home bounds the search elsewhere
    nth = Window.partitionBy("qid").orderBy(F.col("score").desc(), "vid")
    met = staged(_searched(first, at_home, tiles, dim, k + 1, m2), "mtree-home").withColumn("at", F.row_number().over(nth)).where(F.col("at") == k + 1)
    own = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    distance = F.sqrt(F.greatest(F.lit(0).cast("long"), own + F.lit(m2) - 2 * F.col("score")).cast("double")) * (1 + 4 * MARGIN) + 4 * MARGIN
    bounded = spread.join(met.select(F.col("qid").alias("vid"), "score"), "vid", "left").withColumn(
        "bound", F.when(F.col("score").isNotNull(), distance).otherwise(float("inf")))
    # a tile of the second: a pack of trees and a slice of all queries.  A query is sent once for each pack, a tree once for
    # each slice; there are slices only where packs are too few for the tasks
    shards, most = trees.agg(F.max("shard") + 1, F.max(F.length("objects"))).first()
    tasks = shuffle_partitions(spark)
    packs = max(min(shards, tasks), -(-shards // max(1, HELD_BYTES // (2 * most))))
    slices = max(1, min(-(-tasks // packs), -(-asked // QUERY_BLOCK)))
    whole = bounded.withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(packs - 1)))).select(
        (F.col("pack") * slices + part_of(slices)).alias("tile"), "vid", "v", "bound")
    packed = trees.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).select(
        (F.pmod("shard", F.lit(packs)).cast("int") * slices + F.col("slice")).alias("tile"), *fields)
    return _searched(whole, packed, packs * slices, dim, k + 1, m2)
