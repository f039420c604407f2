"""The Rasch fit of parts too large for a task: examinees in chunks, items in a table beside them.

A chunk holds all responses of some examinees of one part as packed arrays and stays where it
was dealt; only rows of its items travel.  Every step sends each chunk what is known of its
items, the chunk works out what follows for its examinees, and sends back sums per item.  So
a step moves rows by the number of (chunk, item) pairs, not by the number of responses.

The steps are those of ``irt.rasch_fit``: trim extremes round by round, split by connection,
keep the largest strongly connected block, alternate.  Given the items, each examinee's theta
is solved within its chunk; then every b makes one damped Newton step.  A theta never moves
further than the items it met, so the largest step of a b bounds those of the thetas.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapscope.functions.components import components
from gapscope.operators.rasch_task import STEP_CLIP, _connected, _spread
from gapscope.session import reliable_checkpoint, ship_package

CHUNK_ROWS = 2_000_000           # responses that a chunk holds, about
THETA_STEPS = 100                # Newton steps of a theta within a step of the items, at most

PACKED = "chunk string, items array<string>, e binary, i binary, y binary"
NAMED = PACKED + ", nodes array<string>, models array<string>, subsets array<string>"


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, list]:
    coded = column.combine_chunks().dictionary_encode(null_encoding="encode")
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def _pack_group(group: pa.Table) -> pa.Table:
    """A chunk's responses (chunk, model, subset, i, y) as one row; cells are in examinee order, items in key order."""
    (m, models), (s, subsets), (i, items) = (_codes(group.column(c)) for c in ("model", "subset", "i"))
    pairs, e = np.unique(m * len(subsets) + s, return_inverse=True)
    names: dict[str, int] = {}
    first, place = [], []
    for p in pairs.tolist():
        model, subset = models[p // len(subsets)], subsets[p % len(subsets)]
        name = "|".join(x for x in (model if model is None else re.sub(r"([\\|])", r"\\\\\1", model), subset) if x is not None)
        if name not in names:
            names[name] = len(first)
            first.append((model, subset))
        place.append(names[name])
    e = np.array(place, np.int64)[e]
    order = np.array(sorted(range(len(items)), key=lambda k: items[k].encode()), np.int64)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    y = group.column("y").combine_chunks().fill_null(0).to_numpy(zero_copy_only=False)
    by = np.argsort(e, kind="stable")
    cells = [x[by].astype(t).tobytes() for x, t in ((e, np.int32), (rank[i], np.int32), (y, np.int8))]
    text = pa.list_(pa.string())
    return pa.table({"chunk": pa.array([group.column("chunk")[0].as_py()]), "items": pa.array([[items[k] for k in order.tolist()]], text),
                   **{c: pa.array([x], pa.binary()) for c, x in zip("eiy", cells)}, "nodes": pa.array([list(names)], text),
                   "models": pa.array([[x[0] for x in first]], text), "subsets": pa.array([[x[1] for x in first]], text)})


@dataclass
class Chunk:
    """A chunk's cells and what was sent of its items (arrays by place, ``blank`` where nothing was)."""

    name: str
    items: pa.Array
    e: np.ndarray
    i: np.ndarray
    y: np.ndarray
    sent: dict

    @property
    def n_e(self) -> int:
        return int(self.e.max()) + 1 if len(self.e) else 0

    def cells(self, keep: np.ndarray) -> pa.Table:
        return pa.table({"chunk": pa.array([self.name]), "items": pa.ListArray.from_arrays(pa.array([0, len(self.items)], pa.int32()), self.items),
                       **{c: pa.array([x[keep].tobytes()], pa.binary()) for c, x in zip("eiy", (self.e, self.i, self.y))}})


class Chunks:
    """Packed chunks, kept by the executors, and the (item, chunk, place) rows that tell which chunk needs which item."""

    def __init__(self, packed: DataFrame, count: int, route: DataFrame | None = None) -> None:
        self.count = count
        self.packed = packed.repartition(count, "chunk").persist()
        self.own_route = route is None
        self.route = self.packed.select("chunk", F.posexplode("items").alias("k", "i")).repartition(count, "i").persist() if route is None else route

    def exchange(self, state: DataFrame, blank: dict, step: Callable[[Chunk], pa.Table], schema: str) -> DataFrame:
        """``step`` on every chunk, with the rows of ``state`` (i and the columns of ``blank``) of its items."""
        sent = state.join(self.route, "i").select(F.col("chunk").alias("to"), "k", *blank)

        def run(chunk: pa.Table, rows: pa.Table) -> pa.Table:
            items = chunk.column("items").combine_chunks().flatten()
            e, i, y = (np.frombuffer(chunk.column(c)[0].as_py(), t) for c, t in zip("eiy", (np.int32, np.int32, np.int8)))
            k, got = rows.column("k").to_numpy(), {}
            for c, v in blank.items():
                got[c] = np.full(len(items), v, object if isinstance(v, str) else type(v))
                got[c][k] = rows.column(c).to_numpy()
            return step(Chunk(chunk.column("chunk")[0].as_py(), items, e, i, y, got))

        left = self.packed.select("chunk", "items", "e", "i", "y")
        return left.groupBy("chunk").cogroup(sent.groupBy("to")).applyInArrow(run, schema)

    def kept(self, state: DataFrame, blank: dict, keep: Callable[[Chunk], np.ndarray]) -> Chunks:
        """The same chunks with the cells that ``keep`` chooses."""
        return Chunks(self.exchange(state, blank, lambda c: c.cells(keep(c)), PACKED), self.count, self.route)

    def names(self) -> DataFrame:
        """(chunk, at, node, model, subset): the examinees of the chunks as first packed."""
        zipped = F.arrays_zip(F.col("nodes").alias("node"), F.col("models").alias("model"), F.col("subsets").alias("subset"))
        return self.packed.select("chunk", F.posexplode(zipped).alias("at", "x")).select("chunk", "at", "x.node", "x.model", "x.subset")

    def drop(self) -> None:
        self.packed.unpersist()
        if self.own_route:
            self.route.unpersist()


def pack(placed: DataFrame, sizes: DataFrame) -> Chunks:
    """Chunks of responses (part, e, model, subset, i, y); ``sizes``: (part, n), an examinee keeps to one part."""
    ship_package(placed.sparkSession)
    dealt = sizes.select("part", F.ceil(F.col("n") / F.lit(CHUNK_ROWS)).alias("chunks"))
    count = int(dealt.agg(F.sum("chunks")).first()[0])
    chunk = F.concat("part", F.lit("#"), F.pmod(F.xxhash64("e"), F.col("chunks")).cast("string"))
    rows = placed.where("i IS NOT NULL").join(F.broadcast(dealt), "part").select(chunk.alias("chunk"), "model", "subset", "i", "y")
    return Chunks(rows.groupBy("chunk").applyInArrow(_pack_group, NAMED), max(2 * count, 4))


# ---------------------------------------------------------------------------
# steps within a chunk
# ---------------------------------------------------------------------------

def _sums(c: Chunk, e: np.ndarray, i: np.ndarray, y: np.ndarray, extra: int = 0) -> pa.Table:
    """(i, s, n) per item of the cells; a row without item carries ``extra``."""
    s, n = np.bincount(i, y, len(c.items)).astype(np.int64), np.bincount(i, minlength=len(c.items))
    k = np.flatnonzero(n)
    of = pa.concat_arrays([c.items.take(pa.array(k)), pa.nulls(1, pa.string())])
    return pa.table({"i": of, "s": pa.array(np.append(s[k], extra)), "n": pa.array(np.append(n[k], 0).astype(np.int64))})


def _extreme(e: np.ndarray, y: np.ndarray, n_e: int) -> tuple[np.ndarray, np.ndarray]:
    s, n = np.bincount(e, y, n_e), np.bincount(e, minlength=n_e)
    return (n > 0) & ((s == 0) | (s == n)), s > 0


def _replayed(c: Chunk, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(live cells, round in which an examinee went or -1, whether all its answers were right) after ``rounds`` of trimming."""
    at, n_e = np.arange(len(c.e)), c.n_e
    lost, right = np.full(n_e, -1), np.zeros(n_e, bool)
    for r in range(rounds):
        bad, some = _extreme(c.e[at], c.y[at], n_e)
        lost[bad], right[bad] = r, some[bad]
        at = at[~bad[c.e[at]] & (c.sent["round"][c.i[at]] != r)]
    return at, lost, right


def _trim_round(at: int) -> Callable[[Chunk], pa.Table]:
    def step(c: Chunk) -> pa.Table:
        live, _, _ = _replayed(c, at)
        return _sums(c, c.e[live], c.i[live], c.y[live], int(_extreme(c.e[live], c.y[live], c.n_e)[0].sum()))
    return step


def _trim_lost(rounds: int) -> Callable[[Chunk], pa.Table]:
    def step(c: Chunk) -> pa.Table:
        _, lost, right = _replayed(c, rounds)
        k = np.flatnonzero(lost >= 0)
        return pa.table({"chunk": pa.array([c.name] * len(k), pa.string()), "at": pa.array(k.astype(np.int32)),
                       "reason": pa.array(np.where(right[k], "all_right", "all_wrong").tolist(), pa.string()), "round": pa.array(lost[k].astype(np.int32))})
    return step


def _links(c: Chunk) -> pa.Table:
    """Each item beside the least item that the chunk's own cells connect it with."""
    n_i, k = len(c.items), np.unique(c.i)
    root = _connected(n_i + c.n_e, c.i, c.e.astype(np.int64) + n_i)
    return pa.table({"i": c.items.take(pa.array(k)), "root": c.items.take(pa.array(root[k]))})


def _closure(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Nodes (items, then examinees) that the marked items reach, and that reach them, within the chunk."""
    n_i = len(c.items)
    e, i, none = c.e.astype(np.int64) + n_i, c.i.astype(np.int64), np.zeros(c.n_e, bool)
    u, v = np.where(c.y == 1, e, i), np.where(c.y == 1, i, e)
    return _spread(np.concatenate([c.sent["f"], none]), u, v), _spread(np.concatenate([c.sent["b"], none]), v, u)


def _reach(c: Chunk) -> pa.Table:
    ahead, behind = (x[:len(c.items)] for x in _closure(c))
    k = np.flatnonzero((ahead & ~c.sent["f"]) | (behind & ~c.sent["b"]))
    return pa.table({"i": c.items.take(pa.array(k)), "f": pa.array(ahead[k]), "b": pa.array(behind[k])})


def _stay(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(cells of the pivots' blocks, the blocks' examinees)."""
    both = np.logical_and(*_closure(c))
    stay_e = both[len(c.items):]
    return stay_e[c.e] & both[c.i], stay_e


def _component_of(c: Chunk) -> tuple[list, np.ndarray, np.ndarray]:
    """(component names, each item's component, each examinee's: -1 without cells)."""
    names, of_i = np.unique(c.sent["part"].astype(str), return_inverse=True)
    of_e = np.full(c.n_e, -1)
    of_e[c.e] = of_i[c.i]
    return names.tolist(), of_i, of_e


def _block_sizes(c: Chunk) -> pa.Table:
    cells, stay = _stay(c)
    names, of_i, of_e = _component_of(c)
    count = lambda codes: np.bincount(codes, minlength=len(names)).astype(np.int64)
    return pa.table({"part": pa.array(names, pa.string()), "n_e": pa.array(count(of_e[of_e >= 0])),
                     "stay_e": pa.array(count(of_e[(of_e >= 0) & stay])), "cells": pa.array(count(of_i[c.i[cells]]))})


def _separated(c: Chunk) -> pa.Table:
    stay, of = _stay(c)[1], np.zeros(c.n_e, bool)
    of[c.e] = c.sent["plain"][c.i]
    k = np.flatnonzero(of & ~stay)
    return pa.table({"chunk": pa.array([c.name] * len(k), pa.string()), "at": pa.array(k.astype(np.int32))})


def _others(c: Chunk) -> pa.Table:
    """Responses of the components that are not fitted here."""
    at = np.flatnonzero(~c.sent["plain"][c.i])
    return pa.table({"chunk": pa.array([c.name] * len(at), pa.string()), "at": pa.array(c.e[at]), "i": c.items.take(pa.array(c.i[at])), "y": pa.array(c.y[at].astype(np.int32))})


def _thetas(c: Chunk, tol: float) -> tuple[np.ndarray, ...]:
    """(examinees, their cells' codes, theta, score, n): each theta solves its score equation with the items' b."""
    who = np.flatnonzero(np.bincount(c.e, minlength=c.n_e))
    e = np.searchsorted(who, c.e)
    s, n, b = np.bincount(e, c.y, len(who)), np.bincount(e, minlength=len(who)), c.sent["b"][c.i]
    theta = np.log(s / (n - s)) + np.bincount(e, b, len(who)) / n
    for _ in range(THETA_STEPS):
        p = 1 / (1 + np.exp(b - theta[e]))
        step = np.clip((s - np.bincount(e, p, len(who))) / np.bincount(e, p * (1 - p), len(who)), -STEP_CLIP, STEP_CLIP)
        theta = theta + step
        if not len(who) or abs(step).max() < tol:
            break
    return who, e, theta, s.astype(np.int64), n


def _item_step(tol: float) -> Callable[[Chunk], pa.Table]:
    def step(c: Chunk) -> pa.Table:
        _, e, theta, _, _ = _thetas(c, tol)
        x = theta[e] - c.sent["b"][c.i]
        p = 1 / (1 + np.exp(-x))
        g, h = np.bincount(c.i, p, len(c.items)), np.bincount(c.i, p * (1 - p), len(c.items))
        k = np.unique(c.i)
        nll = float((np.logaddexp(0, x) - c.y * x).sum())
        of = pa.concat_arrays([c.items.take(pa.array(k)), pa.nulls(1, pa.string())])
        return pa.table({"i": of, "e": pa.array(np.append(g[k], nll)), "h": pa.array(np.append(h[k], 0.0))})
    return step


def _theta_rows(tol: float) -> Callable[[Chunk], pa.Table]:
    def step(c: Chunk) -> pa.Table:
        who, _, theta, s, n = _thetas(c, tol)
        names, _, of_e = _component_of(c)
        return pa.table({"chunk": pa.array([c.name] * len(who), pa.string()), "at": pa.array(who.astype(np.int32)),
                       "component": pa.array([names[k] for k in of_e[who].tolist()], pa.string()), "value": pa.array(theta),
                       "score": pa.array(s), "n": pa.array(n.astype(np.int64))})
    return step


# ---------------------------------------------------------------------------
# the fit
# ---------------------------------------------------------------------------

def trim(chunks: Chunks) -> tuple[DataFrame, DataFrame, int]:
    """(items that stay (i, s, n), items that went (i, reason, round), rounds): as ``irt.trim_extremes``."""
    gone = chunks.packed.sparkSession.createDataFrame([], "i string, reason string, round int")
    at = 0
    while True:
        sums = chunks.exchange(gone.select("i", "round"), {"round": -1}, _trim_round(at), "i string, s long, n long")
        sums = reliable_checkpoint(sums.groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")))
        bad = sums.where("i IS NOT NULL AND (s = 0 OR s = n)")
        if bad.isEmpty() and sums.where("i IS NULL AND s > 0").isEmpty():
            return sums.where("i IS NOT NULL"), gone, at
        gone = reliable_checkpoint(gone.unionByName(bad.select(
            "i", F.when(F.col("s") == 0, "all_wrong").otherwise("all_right").alias("reason"), F.lit(at).alias("round"))))
        at += 1


def blocks(chunks: Chunks, items: DataFrame) -> DataFrame:
    """(i, part, f, b) of trimmed items: connected component, reached from its pivot, reaching it."""
    linked = components(chunks.exchange(items.select("i").limit(0), {}, _links, "i string, root string"))
    parted = reliable_checkpoint(items.join(linked.withColumnRenamed("node", "i"), "i", "left").select("i", "s", "n", F.coalesce("root", "i").alias("part")))
    pivot = F.max_by("i", F.struct(F.least(F.col("s"), F.col("n") - F.col("s")), "i")).alias("i")
    flags = reliable_checkpoint(parted.groupBy("part").agg(pivot).select("i", F.lit(True).alias("f"), F.lit(True).alias("b")))
    either = lambda df: reliable_checkpoint(df.groupBy("i").agg(F.bool_or("f").alias("f"), F.bool_or("b").alias("b")))
    while True:
        new = either(chunks.exchange(flags, {"f": False, "b": False}, _reach, "i string, f boolean, b boolean"))
        if new.isEmpty():
            off = F.lit(False)
            return reliable_checkpoint(parted.join(flags, "i", "left").select("i", "part", F.coalesce("f", off).alias("f"), F.coalesce("b", off).alias("b")))
        flags = either(flags.unionByName(new))


def fit(chunks: Chunks, tol: float, max_iter: int, ended: Callable[[list], bool]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None, list]:
    """(examinees, items, excluded, responses left over, log).

    Examinees (node, model, subset, component, score, n, value), items (node, component, score, n,
    value).  Left over, as (e, model, subset, i, y), are trimmed components whose pivot's block is
    not surely the largest or is complete; the caller fits them.  ``log`` ends when
    ``ended`` says so or with ``max_iter`` steps.
    """
    names = chunks.names()
    items, gone, rounds = trim(chunks)
    removed, blank = gone.select("i", "round"), {"round": -1}
    lost = chunks.exchange(removed, blank, _trim_lost(rounds), "chunk string, at int, reason string, round int").join(names, ["chunk", "at"])
    excluded = gone.select(F.lit("i").alias("kind"), F.col("i").alias("node"), "reason", "round").unionByName(
        lost.select(F.lit("e").alias("kind"), "node", "reason", "round"))

    def live(c: Chunk) -> np.ndarray:
        keep = np.zeros(len(c.e), bool)
        keep[_replayed(c, rounds)[0]] = True
        return keep
    trimmed = chunks.kept(removed, blank, live)

    reached = blocks(trimmed, items)
    met = F.col("f") & F.col("b")
    of_e = trimmed.exchange(reached, {"part": "", "f": False, "b": False}, _block_sizes, "part string, n_e long, stay_e long, cells long")
    of_e = of_e.groupBy("part").agg(*[F.sum(c).alias(c) for c in ("n_e", "stay_e", "cells")])
    sizes = of_e.join(reached.groupBy("part").agg(F.count(F.lit(1)).alias("n_i"), F.count_if(met).alias("stay_i"), F.min(F.when(met, F.col("i"))).alias("component")), "part")
    # more than half of a component's nodes are its largest block for sure; a complete block collapses to score groups elsewhere
    plain = F.expr("2 * (stay_e + stay_i) > n_e + n_i AND cells < stay_e * stay_i")
    state = reliable_checkpoint(reached.join(sizes.select("part", "component", plain.alias("plain")), "part").select("i", "f", "b", "plain", F.col("component").alias("part")))
    flags = {"f": False, "b": False, "plain": False}
    apart = trimmed.exchange(state, flags, _separated, "chunk string, at int").join(names, ["chunk", "at"])
    excluded = excluded.unionByName(state.where(F.col("plain") & ~met).select(F.lit("i").alias("kind"), F.col("i").alias("node")).unionByName(
        apart.select(F.lit("e").alias("kind"), "node")).select("kind", "node", F.lit("quasi_separated").alias("reason"), F.lit(None).cast("int").alias("round")))
    excluded = reliable_checkpoint(excluded)
    rest = None
    if not state.where("NOT plain").isEmpty():
        rest = reliable_checkpoint(trimmed.exchange(state.select("i", "plain"), {"plain": False}, _others, "chunk string, at int, i string, y int")
                                   .join(names, ["chunk", "at"]).select(F.col("node").alias("e"), "model", "subset", "i", "y"))

    chosen = state.where(F.col("plain") & met)
    kept = trimmed.kept(chosen.select("i", "f", "b", "plain"), flags, lambda c: _stay(c)[0])
    sums = kept.exchange(chosen.select("i").limit(0), {}, lambda c: _sums(c, c.e, c.i, c.y), "i string, s long, n long")
    sums = sums.where("i IS NOT NULL").groupBy("i").agg(F.sum("s").alias("score"), F.sum("n").alias("n"))
    b = reliable_checkpoint(sums.join(chosen.select("i", F.col("part").alias("component")), "i").select(
        "i", "component", "score", "n", (-F.log(F.col("score") / (F.col("n") - F.col("score")))).alias("b"), F.lit(0.0).alias("step"), F.lit(0.0).alias("nll")))
    trimmed.drop()
    inner = max(tol * 1e-3, 1e-12)
    clipped = F.greatest(F.lit(-STEP_CLIP), F.least(F.lit(STEP_CLIP), (F.col("e") - F.col("score")) / F.col("h")))
    log: list = []
    fitted = not b.isEmpty()
    while fitted and len(log) < max_iter:
        st = kept.exchange(b.select("i", "b"), {"b": 0.0}, _item_step(inner), "i string, e double, h double").groupBy("i").agg(F.sum("e").alias("e"), F.sum("h").alias("h"))
        # the row without item has the loss; it goes with the items to be computed once
        new = reliable_checkpoint(st.join(b.drop("step", "nll"), "i", "left").select(
            "i", "component", "score", "n", (F.col("b") + clipped).alias("b"), F.when(F.col("i").isNotNull(), F.abs(clipped)).alias("step"), F.when(F.col("i").isNull(), F.col("e")).alias("nll")))
        at = new.agg(F.max("step").alias("step"), F.sum("nll").alias("nll")).first()
        b = new.where("i IS NOT NULL")
        log.append({"iter": len(log), "max_step": float(at.step or 0.0), "nll": float(at.nll or 0.0)})
        if ended(log):
            break
    of = kept.exchange(b.select("i", "b", F.col("component").alias("part")), {"b": 0.0, "part": ""}, _theta_rows(inner),
                       "chunk string, at int, component string, value double, score long, n long")
    theta = reliable_checkpoint(of.join(names, ["chunk", "at"]).select("node", "model", "subset", "component", "score", "n", "value"))
    items_out = b.select(F.col("i").alias("node"), "component", "score", "n", F.col("b").alias("value"))
    kept.drop()
    chunks.drop()
    return theta, items_out, excluded, rest, log
