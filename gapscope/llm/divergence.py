"""Divergence of sources: how far each source of a language is from the others, and by which terms.

A term is a run of ASCII letters and characters beyond ASCII, only A-Z lower-cased.  A
language keeps the terms that occur in at least ``MIN_DOCS`` of its documents (V of them).
A group (language, source) or a language with N occurrences of kept terms gives a term
p = 1 + floor(10^9 (count + 2) / (N + 2V)), and two such p, q differ by
f = floor((p - q)^2 / (p + q)), all in exact integers.

The matrix of groups by terms is mostly zeros.  Its columns are dealt to tiles of about
``TILE`` terms, its rows to blocks of ``ROWS`` groups, and every tile of a block becomes a
forest of quadtrees (each square quadrant has four children; a bit a child says whether
it holds any count, and the children present stand in order, found by rank).  The trees
of two blocks, or a block's own twice, are walked jointly from the roots: a quadrant
that is zero on both sides has one f for each pair of groups, so it is priced by its
width alone; what remains are the leaves where one of the two counts is not zero.  Terms
that no group of the two blocks has in a tile are never visited: pairs are completed by
their number, and so are groups without any term.  The same leaves against the language's
own counts give the terms that a source uses more.

Null text, language and source are read as ''.  Repeated rows are separate documents.
Every group is compared, also one without terms; a language without kept terms gives
value 0 for all its pairs.  Ties rank by UTF-8 bytes.  An empty table gives no rows.
Other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapscope.llm.common import arrow_pass, pieces, staged
from gapscope.session import ship_package

MIN_DOCS = 10
TOP = 10
SCALE = 1_000_000_000
#: Terms of a tile, rows of a block, (term, group) entries that a counting task holds, leaves met at a time.
TILE = 4096
ROWS = 64
ENTRIES = 400_000
LEAVES = 1 << 20
BATCH = 256

_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TERM_BYTES).split()


def share(count: np.ndarray, total, v: int) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / (total + 2v)) by long division, which keeps within 64 bits."""
    rest, by, out = count + 2, total + 2 * v, np.zeros(len(count), np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // by
        rest = rest % by
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


class QuadForest:
    """Quadtrees over the squares of a matrix of 2^depth rows, from its nonzero cells.

    ``bits[j]`` has four entries for every node of level j; ``ranks[j]`` counts the
    children present, which is their place in level j + 1.  The values of the last
    level stand in ``values``; ``roots[block]`` is the root of a square, or -1.
    """

    def __init__(self, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, depth: int, blocks: int):
        z = cols >> depth
        for j in range(depth - 1, -1, -1):                 # the bits of row and column in turn
            z = z << 2 | (rows >> j & 1) << 1 | cols >> j & 1
        order = np.argsort(z, kind="stable")
        z, self.values = z[order], values[order]
        self.rows, self.cols = rows[order], cols[order]
        level = [np.unique(z >> 2 * (depth - j)) for j in range(depth + 1)]
        self.bits, self.ranks = [], []
        for j in range(depth):
            has = np.zeros(4 * len(level[j]), bool)
            has[4 * np.searchsorted(level[j], level[j + 1] >> 2) + (level[j + 1] & 3)] = True
            self.bits.append(has)
            self.ranks.append(np.cumsum(has) - 1)
        self.roots = np.full(blocks, -1, np.int64)
        self.roots[level[0]] = np.arange(len(level[0]))

    def child(self, j: int, node: np.ndarray, quadrant: int) -> np.ndarray:
        """The node of level j + 1 in a quadrant of ``node``, -1 where there are only zeros."""
        if not len(self.bits[j]):
            return np.full(len(node), -1, np.int64)
        at = 4 * np.maximum(node, 0) + quadrant
        return np.where((node >= 0) & self.bits[j][at], self.ranks[j][at], -1)


def joint(one: QuadForest, two: QuadForest, depth: int, width: int, blocks: range, n_one: int, n_two: int, same: bool
          ) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Walk two forests over the same columns.

    Returns the number of columns that are zero on both sides of each pair of rows, from
    the quadrants where that is so, and the leaves left: (row, row, leaf, leaf), a leaf -1
    where that side is zero.  ``same``: rows of one block, only pairs in order are met.
    """
    at = np.arange(blocks.start, blocks.stop, dtype=np.int64)
    a, b, col = one.roots[at], two.roots[at], at
    ra, rb = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    zero = np.zeros((1, 1), np.int64)
    for j in range(depth + 1):
        side = 1 << depth - j
        dead = (a < 0) & (b < 0)
        if dead.any():
            wide = np.clip(width - col[dead] * side, 0, side)
            zero += np.bincount(ra[dead] << j | rb[dead], weights=wide, minlength=1 << 2 * j).astype(np.int64).reshape(zero.shape)
            a, b, ra, rb, col = (x[~dead] for x in (a, b, ra, rb, col))
        if j == depth:
            break
        zero = zero.repeat(2, axis=0).repeat(2, axis=1)
        half, parts = side >> 1, []
        for c in (0, 1):
            kids = [(one.child(j, a, 2 * x + c), two.child(j, b, 2 * x + c)) for x in (0, 1)]
            new_col = col << 1 | c
            for x in (0, 1):
                for y in (0, 1):
                    na, nb = ra << 1 | x, rb << 1 | y
                    keep = (na * half < n_one) & (nb * half < n_two) & (new_col * half < width)
                    if same:
                        keep &= na <= nb if half > 1 else na < nb
                    parts.append([v[keep] for v in (kids[x][0], kids[y][1], na, nb, new_col)])
        a, b, ra, rb, col = (np.concatenate(v) for v in zip(*parts))
    return zero[:n_one, :n_two], (ra, rb, a, b)


def tile_pairs(cells: tuple[dict, dict], totals: tuple[np.ndarray, np.ndarray], v: int, width: int, same: bool) -> tuple[np.ndarray, QuadForest]:
    """Sum of f over the ``width`` columns of a tile for each pair of rows of two blocks, and the first block's forest.

    ``cells``: rows, cols, counts of each block; ``totals``: N of their rows.
    """
    n_one, n_two = len(totals[0]), len(totals[1])
    depth = max(1, int(max(n_one, n_two) - 1).bit_length())
    blocks = -(-width // (1 << depth))
    forest = [QuadForest(c["rows"], c["cols"], c["counts"], depth, blocks) for c in (cells[:1] if same else cells)]
    one, two = forest[0], forest[-1]
    p = [share(t.values, n[t.rows], v) for t, n in zip((one, two), totals)]
    p0 = [share(np.zeros(len(n), np.int64), n, v) for n in totals]
    out = np.zeros((n_one, n_two), np.int64)
    none = divergence(p0[0][:, None], p0[1][None, :])
    step = max(1, LEAVES >> 3 * depth)
    for first in range(0, blocks, step):
        zero, (ra, rb, a, b) = joint(one, two, depth, width, range(first, min(blocks, first + step)), n_one, n_two, same)
        out += zero * none
        if len(a):
            pa_ = np.where(a >= 0, p[0][np.maximum(a, 0)] if len(p[0]) else 0, p0[0][ra])
            pb_ = np.where(b >= 0, p[1][np.maximum(b, 0)] if len(p[1]) else 0, p0[1][rb])
            # sums of f stay far below 2^53, so that adding them as doubles is exact
            out += np.bincount(ra * n_two + rb, weights=divergence(pa_, pb_), minlength=n_one * n_two).astype(np.int64).reshape(out.shape)
    return out, one


def _of_tile(cells: pa.Table, groups: pa.Table) -> pa.Table:
    """Pair sums and leading terms of one tile and pair of blocks."""
    out = {"a": [], "b": [], "value": [], "cols": [], "term": []}
    if cells.num_rows and groups.num_rows:
        column = cells.column("term").combine_chunks().dictionary_encode()
        names = column.dictionary.to_pylist()
        order = sorted(range(len(names)), key=names.__getitem__)
        place = np.empty(len(names), np.int64)
        place[order] = np.arange(len(names))
        col = place[column.indices.to_numpy(zero_copy_only=False)]
        row, n = (cells.column(x).to_numpy() for x in ("idx", "n"))
        g = {x: groups.column(x).to_numpy() for x in ("row", "total")}
        first, second = (cells.column(x)[0].as_py() for x in ("first", "second"))
        v, all_n = (groups.column(x)[0].as_py() for x in ("v", "lang_total"))
        sides, totals = [], []
        for block in (first, second):
            of, mine = g["row"] // ROWS == block, row // ROWS == block
            n_of = np.zeros(int((g["row"][of] % ROWS).max()) + 1, np.int64)
            n_of[g["row"][of] % ROWS] = g["total"][of]
            totals.append(n_of)
            sides.append({"rows": row[mine] % ROWS, "cols": col[mine], "counts": n[mine]})
        same = first == second
        sums, tree = tile_pairs((sides[0], sides[1]), (totals[0], totals[1]), v, len(names), same)
        a, b = np.triu_indices(len(totals[0]), 1) if same else (x.ravel() for x in np.indices(sums.shape))
        out["a"], out["b"] = (a + first * ROWS).tolist(), (b + second * ROWS).tolist()
        out["value"], out["cols"], out["term"] = sums[a, b].tolist(), [len(names)] * len(a), [None] * len(a)
        if same:
            of_lang = np.zeros(len(names), np.int64)
            of_lang[col] = cells.column("lang_n").to_numpy()
            p = share(tree.values, totals[0][tree.rows], v)
            q = share(of_lang, all_n, v)[tree.cols]
            f = divergence(p, q)
            best = np.lexsort((tree.cols, -f, tree.rows))
            best = best[(p > q)[best]]
            start = np.searchsorted(tree.rows[best], tree.rows[best])
            best = best[np.arange(len(best)) - start < TOP]
            out["a"] += (tree.rows[best] + first * ROWS).tolist()
            out["b"] += [-1] * len(best)
            out["value"] += f[best].tolist()
            out["cols"] += [0] * len(best)
            out["term"] += [names[order[c]] for c in tree.cols[best].tolist()]
    lang = cells.column("lang")[0] if cells.num_rows else None
    return pa.table({"lang": pa.array([lang and lang.as_py()] * len(out["a"]), pa.string()), **{k: pa.array(out[k], pa.int64()) for k in ("a", "b", "value", "cols")},
                     "term": pa.array(out["term"], pa.string())})


def term_counts(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(lang, source, term, n occurrences, df documents), counted by dictionaries in the tasks before the shuffle."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    row = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).cast("binary").alias("t"))

    def emit(n: dict, df: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), found in n.items():
            words, k = list(found), len(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), pa.array(words, pa.binary()).cast(pa.string()),
                 pa.array(found.values(), pa.int64()), pa.array(map(df[lang, source].__getitem__, words), pa.int64())],
                ["lang", "source", "term", "n", "df"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df, held = defaultdict(Counter), defaultdict(Counter), 0
        for b in pieces(batches, BATCH):
            for lang, source, t in zip(*(c.to_pylist() for c in b.columns)):
                if found := terms(t):
                    here = n[lang, source]
                    held -= len(here)
                    here.update(found)
                    df[lang, source].update(set(found))
                    held += len(here)
            if held > ENTRIES:
                yield from emit(n, df)
                n, df, held = defaultdict(Counter), defaultdict(Counter), 0
        yield from emit(n, df)

    counted = arrow_pass(row, "lang string, source string, term string, n long, df long", of)
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                      min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, part, item, value, rank): all other sources of the language, and the leading terms of the source."""
    spark = docs.sparkSession
    of_term = Window.partitionBy("lang", "term")
    kept = (term_counts(docs, text_col, lang_col, source_col)
            .withColumns({"lang_df": F.sum("df").over(of_term), "lang_n": F.sum("n").over(of_term), "head": F.min("source").over(of_term) == F.col("source")})
            .where(F.col("lang_df") >= min_docs).select("lang", "source", "term", "n", "lang_n", "head"))
    kept = staged(kept, "divergence-counts")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if("head").alias("heads"))
    groups = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source")).distinct().join(totals, ["lang", "source"], "left")
    of_lang = Window.partitionBy("lang")
    groups = staged(groups.select(
        "lang", "source", F.coalesce("total", F.lit(0)).cast("long").alias("total"),
        (F.row_number().over(of_lang.orderBy("source")) - 1).cast("long").alias("idx"), F.count(F.lit(1)).over(of_lang).alias("n_groups"),
        F.coalesce(F.sum("heads").over(of_lang), F.lit(0)).cast("long").alias("v"),
        F.coalesce(F.sum("total").over(of_lang), F.lit(0)).cast("long").alias("lang_total")), "divergence-groups")

    # each cell goes to its block's meeting with every block of the language
    n_tiles = F.greatest(F.lit(1), F.ceil(F.col("v") / TILE)).cast("long")
    block = F.expr(f"idx div {ROWS}")
    meetings = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n_groups - 1) div {ROWS}"))).alias("other")
    pair = [F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second")]
    cells = (kept.join(groups.select("lang", "source", "idx", "n_groups", "v"), ["lang", "source"])
             .select("lang", F.pmod(F.xxhash64("term"), n_tiles).alias("tile"), "idx", "term", "n", "lang_n", block.alias("block"), meetings)
             .select("lang", "tile", *pair, "idx", "term", "n", "lang_n"))
    rows = (groups.where("v > 0").select("lang", F.col("idx").alias("row"), "total", "v", "lang_total", block.alias("block"), n_tiles.alias("tiles"), meetings)
            .select("lang", "row", "total", "v", "lang_total", *pair, F.explode(F.expr("sequence(0L, tiles - 1)")).alias("tile")))
    ship_package(spark)
    key = ["lang", "tile", "first", "second"]
    met = staged(cells.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(
        _of_tile, "lang string, a long, b long, value long, cols long, term string"), "divergence-tiles")

    # pairs: what the tiles met, and for all other terms the f of two zero counts
    sums = met.where("term is null").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("cols").alias("cols"))
    zero = F.when(F.col("v") > 0, F.expr(f"1 + {2 * SCALE}L div (total + 2 * v)"))
    named = groups.select("lang", "source", "idx", "v", zero.alias("p"))
    left = named.select("lang", F.col("source").alias("one"), F.col("idx").alias("a"), "v", F.col("p").alias("pa"))
    right = named.select("lang", F.col("source").alias("two"), F.col("idx").alias("b"), F.col("p").alias("pb"))
    pairs = left.join(right, "lang").where("a < b").join(sums, ["lang", "a", "b"], "left").withColumn(
        "value", F.expr("coalesce(value, 0L) + coalesce((v - coalesce(cols, 0L)) * ((pa - pb) * (pa - pb) div (pa + pb)), 0L)"))
    both = pairs.select("lang", "value", F.explode(F.array(F.struct(F.col("one").alias("source"), F.col("two").alias("item")),
                                                         F.struct(F.col("two").alias("source"), F.col("one").alias("item")))).alias("s")).select(
        "lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")
    leading = met.where("term is not null").join(groups.select("lang", F.col("idx").alias("a"), "source"), ["lang", "a"]).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    place = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(place))
    return ranked(both).unionByName(ranked(leading).where(F.col("rank") <= TOP))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents
), w AS (SELECT doc, lang, source, unnest(words) AS term FROM d
), k AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT doc) >= {MIN_DOCS}
), c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY lang, source, term
), l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang
), g AS (SELECT lang, source, coalesce(t.total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (
  SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source) t USING (lang, source)
), p AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    CAST(1 + CAST({SCALE} AS HUGEINT) * (coalesce(c.n, 0) + 2) // CAST(g.total + 2 * l.v AS HUGEINT) AS BIGINT) AS p,
    CAST(1 + CAST({SCALE} AS HUGEINT) * (k.n + 2) // CAST(l.total + 2 * l.v AS HUGEINT) AS BIGINT) AS q
  FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), s AS (
  SELECT x.lang, x.source, y.source AS item, CAST(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS BIGINT) AS value
  FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY x.lang, x.source, y.source
), pairs AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(s.value, 0) AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source
), ahead AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM ahead)
)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= {TOP}
"""
