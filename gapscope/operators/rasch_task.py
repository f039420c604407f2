"""The Rasch fit of connected components that fit a task: one Arrow group each, arrays inside.

The steps are those of ``irt.rasch_fit``: trim extremes, split by connection, keep the
largest strongly connected block, collapse complete blocks, alternate damped Newton steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from gapscope.session import ship_package

STEP_CLIP = 1.0                  # damping: |Newton step| <= 1 logit


def _spread(mark: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Nodes reached from the marked ones along edges u -> v."""
    while True:
        new = v[mark[u] & ~mark[v]]
        if not len(new):
            return mark
        mark[new] = True


def _connected(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Least node of each node's undirected component."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, u, root[v])
        np.minimum.at(new, v, root[u])
        new = new[new]
        if (new == root).all():
            return root
        root = new


#: Links that a task holds before it replaces them by fewer.
LINKS_HELD = 1_000_000


def _fewer(links: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Every node of the links (a, b) beside the least node (in byte order) that they connect it with."""
    table = pa.Table.from_batches(links)
    names = pa.chunked_array([*table.column("a").chunks, *table.column("b").chunks], pa.string()).combine_chunks()
    names = pa.concat_arrays(names.chunks) if isinstance(names, pa.ChunkedArray) else names
    coded = names.dictionary_encode()
    order = pc.sort_indices(coded.dictionary.cast(pa.binary())).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    nodes, code = coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy()]
    root = _connected(len(order), code[:len(table)], code[len(table):])
    k = np.flatnonzero(root != np.arange(len(root)))
    return pa.RecordBatch.from_arrays([nodes.take(pa.array(root[k])), nodes.take(pa.array(k))], ["a", "b"])


def connected_within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of a task as links of each node to the least one it is connected with; the same components, fewer rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= LINKS_HELD:
            yield _fewer(held)
            held, n = [], 0
    if held:
        yield _fewer(held)


def strong_labels(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Label of each node's strongly connected component (own number for single nodes)."""
    label, part, fresh = np.arange(n), np.zeros(n, np.int64), 1
    while True:
        alive = part >= 0
        inner = (part[u] == part[v]) & alive[u]
        u, v = u[inner], v[inner]
        both = np.minimum(np.bincount(u, minlength=n), np.bincount(v, minlength=n))
        part[both == 0] = -1
        alive = part >= 0
        if not alive.any():
            return label
        order = np.lexsort((-both, part))
        order = order[alive[order]]
        pivot = order[np.concatenate([[True], part[order][1:] != part[order][:-1]])]
        inner = alive[u] & alive[v]
        u, v = u[inner], v[inner]
        ahead, behind = np.zeros(n, bool), np.zeros(n, bool)
        ahead[pivot] = behind[pivot] = True
        ahead, behind = _spread(ahead, u, v), _spread(behind, v, u)
        met = ahead & behind
        of_part = np.zeros(fresh + 1, np.int64)
        of_part[part[pivot]] = pivot
        label[met] = of_part[part[met]]
        rest = alive & ~met
        _, part_new = np.unique(part[rest] * 4 + ahead[rest] * 2 + behind[rest], return_inverse=True)
        part[met] = -1
        part[rest] = part_new
        fresh = int(part_new.max()) + 1 if rest.any() else 1


def _newton(e: np.ndarray, i: np.ndarray, we: np.ndarray, wi: np.ndarray, es: np.ndarray, en: np.ndarray, is_: np.ndarray, in_: np.ndarray,
            me: np.ndarray, mi: np.ndarray, tol: float, max_iter: int, rule: str) -> tuple[np.ndarray, np.ndarray, bool]:
    """Thetas and bs of the keys of cells (e, i) with weights; es of en right, me how many nodes a key stands for."""
    theta, b, log = np.log(es / (en - es)), -np.log(is_ / (in_ - is_)), []
    for _ in range(max_iter):
        x = theta[e] - b[i]
        p = 1 / (1 + np.exp(-x))
        if rule == "loss":
            log.append({"nll": float((we * wi * np.logaddexp(0, x)).sum() - (me * es * theta).sum() + (mi * is_ * b).sum())})
        dt = np.clip((es - np.bincount(e, wi * p, len(es))) / np.bincount(e, wi * p * (1 - p), len(es)), -STEP_CLIP, STEP_CLIP)
        theta = theta + dt
        p = 1 / (1 + np.exp(b[i] - theta[e]))
        db = np.clip((np.bincount(i, we * p, len(is_)) - is_) / np.bincount(i, we * p * (1 - p), len(is_)), -STEP_CLIP, STEP_CLIP)
        b = b + db
        if max(abs(dt).max(), abs(db).max()) < tol:
            return theta, b, True
        if rule == "loss":
            from gapscope.operators.irt import rasch_converged
            if rasch_converged(log):
                return theta, b, True
    return theta, b, False


def _block(e: np.ndarray, i: np.ndarray, y: np.ndarray, tol: float, max_iter: int, rule: str) -> tuple:
    """Fit of one strongly connected block; complete blocks on score groups."""
    (ue, e), (ui, i) = np.unique(e, return_inverse=True), np.unique(i, return_inverse=True)
    es, en = np.bincount(e, y), np.bincount(e).astype(float)
    is_, in_ = np.bincount(i, y), np.bincount(i).astype(float)
    if len(y) == len(ue) * len(ui):
        (ge, ke, me), (gi, ki, mi) = (np.unique(s, return_inverse=True, return_counts=True) for s in (es, is_))
        ce, ci = (x.ravel() for x in np.indices((len(ge), len(gi))))
        theta, b, ok = _newton(ce, ci, me[ce], mi[ci], ge, np.full(len(ge), float(len(ui))), gi, np.full(len(gi), float(len(ue))), me, mi, tol, max_iter, rule)
        theta, b = theta[ke], b[ki]
    else:
        one = np.ones(len(y))
        theta, b, ok = _newton(e, i, one, one, es, en, is_, in_, np.ones(len(ue)), np.ones(len(ui)), tol, max_iter, rule)
    return (ue, theta, es, en), (ui, b, is_, in_), ok


def _fit_group(group: pa.Table, tol: float, max_iter: int, rule: str) -> pa.Table:
    """All outputs of the connected component in ``group`` (part, e, i, y)."""
    out = []
    coded = []
    for c in ("e", "i"):
        names = group.column(c).combine_chunks().dictionary_encode()
        order = np.array(sorted(range(len(names.dictionary)), key=lambda k, d=names.dictionary.to_pylist(): d[k].encode()), np.int64)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        coded.append((place[names.indices.to_numpy(zero_copy_only=False)], [names.dictionary[int(k)].as_py() for k in order]))
    (e, e_names), (i, i_names) = coded
    y, n_i = group.column("y").to_numpy().astype(float), len(i_names)
    name = lambda k: ("i", i_names[k]) if k < n_i else ("e", e_names[k - n_i])
    at = 0
    while len(y):                                             # items are nodes 0.., examinees come after them
        gone = []
        for k, x in (("e", e), ("i", i)):
            s, n = np.bincount(x, y), np.bincount(x)
            bad = np.flatnonzero((n > 0) & ((s == 0) | (s == n)))
            out += [(k, (e_names if k == "e" else i_names)[j], None, None, None, None, "all_wrong" if s[j] == 0 else "all_right", at) for j in bad.tolist()]
            gone.append(np.isin(x, bad))
        if not (gone[0] | gone[1]).any():
            break
        left = ~(gone[0] | gone[1])
        e, i, y, at = e[left], i[left], y[left], at + 1
        # an item or examinee that lost its last answer is neither fitted nor extreme: it has no row, as in the joins
    if len(y):
        n = n_i + len(e_names)
        part = _connected(n, i, e + n_i)
        beats = (np.where(y > 0, e + n_i, i), np.where(y > 0, i, e + n_i))
        label = strong_labels(n, *beats)
        nodes = np.unique(np.concatenate([i, e + n_i]))
        least = np.full(n, n)
        np.minimum.at(least, label[nodes], nodes)
        size = np.bincount(label[nodes], minlength=n)
        for p in np.unique(part[nodes]).tolist():
            mine = nodes[part[nodes] == p]
            best = min(np.unique(label[mine]).tolist(), key=lambda k: (-size[k], least[k]))
            stay = np.zeros(n, bool)
            if size[best] > 1:
                stay[mine[label[mine] == best]] = True
            out += [(*name(k), None, None, None, None, "quasi_separated", None) for k in mine[~stay[mine]].tolist()]
            rows = stay[e + n_i] & stay[i]
            if rows.any():
                (ue, theta, es, en), (ui, b, is_, in_), ok = _block(e[rows], i[rows], y[rows], tol, max_iter, rule)
                component, why = i_names[int(ui[0])], None if ok else "not_converged"
                for k, who, names, value, s, m in (("e", ue, e_names, theta, es, en), ("i", ui, i_names, b, is_, in_)):
                    out += [(k, names[j], component, float(v), int(a), int(c), why, None) for j, v, a, c in zip(who.tolist(), value, s, m)]
    cols = list(zip(*out)) or [[]] * 8
    kinds = [pa.string(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.string(), pa.int32()]
    return pa.table({c: pa.array(list(x), t) for c, x, t in zip(("kind", "node", "component", "value", "score", "n", "reason", "round"), cols, kinds)})


def in_tasks(placed: DataFrame, tol: float, max_iter: int, rule: str) -> DataFrame:
    """(kind, node, component, value, score, n, reason, round) of responses (part, e, i, y), one task group a part."""
    ship_package(placed.sparkSession)
    return placed.groupBy("part").applyInArrow(
        lambda group: _fit_group(group, tol, max_iter, rule),
        "kind string, node string, component string, value double, score long, n long, reason string, round int")
