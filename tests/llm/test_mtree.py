"""M-tree search against brute force."""

import math

import numpy as np
import pytest

from gapscope.llm import catalog, mtree


def brute(rows, k=5):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok[i] = np.array([math.floor(256 * x) for x in v], np.int64)
    out = []
    for q in (i for i in ok if i % 50 == 0):
        best = sorted((-int(ok[q] @ v), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("n", [1, 2, 40, 700])
def test_tree_search(n):
    r = np.random.default_rng(n)
    x = np.unique(r.integers(-40, 40, (n, 6)) + r.integers(0, 2, (n, 1)) * 100, axis=0)
    m2 = int((x * x).sum(axis=1).max())
    tree = mtree.MTree.build(x, np.sqrt((m2 - (x * x).sum(axis=1)).astype(float)), page=8)
    tree = mtree.MTree.of_row(tree.row(), 6)
    saved = 0
    for q in r.integers(-60, 60, (30, 6)):
        objects, scores, computed = tree.search(q, 3, m2)
        s = x @ q
        worst = np.sort(s)[::-1][:3][-1]
        assert sorted(objects.tolist()) == np.flatnonzero(s >= worst).tolist() and (s[objects] == scores).all()
        saved += len(x) - computed
    assert n < 700 or saved > 0


def test_query_matches_brute_force(spark, tmp_path):
    r = np.random.default_rng(7)
    rows = [(i, [float(f) for f in np.round(r.normal(0, 1, 8) + 2 * (i % 4 == 0), 2)]) for i in range(300)]
    rows += [(300 + i, rows[10][1]) for i in range(60)] + [(400, None), (450, [1.0, None] + [0.0] * 6), (500, [float("nan")] * 8), (550, [float("inf")] * 8),
             (600, [1.0, 2.0]), (601, [2.0, 1.0]), (602, [2.0, 1.0]), (650, [5.0]), (None, [1.0] * 8), (7, rows[7][1]), (700, [0.0] * 8)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, score int, vid int").repartition(4)
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want = brute(single)
    got = catalog.QUERIES["op5_mtree_topk"](spark, str(tmp_path))
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == want
    from pyspark.sql import functions as F
    small = mtree.top_k(df, F.col("id") % 50 == 0, shard_rows=60)
    assert sorted(map(tuple, small.collect())) == want


def test_empty_table(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert mtree.top_k(df, F.col("id") % 50 == 0).count() == 0


def test_best_of_several_trees_keeps_ties():
    r = np.random.default_rng(3)
    x = np.unique(r.integers(-3, 4, (900, 5)), axis=0)
    m2 = int((x * x).sum(axis=1).max())
    parts = np.array_split(r.permutation(len(x)), 5)
    held = [(mtree.MTree.build(x[p], np.sqrt((m2 - (x[p] * x[p]).sum(axis=1)).astype(float)), page=8), p) for p in parts]
    for q in r.integers(-3, 4, (40, 5)):
        vids, scores = mtree._best(held, q, np.inf, 4, m2)
        worst = np.sort(x @ q)[::-1][3]
        assert sorted(vids.tolist()) == np.flatnonzero(x @ q >= worst).tolist() and (scores == x[vids] @ q).all()


@pytest.mark.parametrize("held, block", [(1, 3), (1 << 26, 3), (1 << 26, 256)])
def test_queries_pass_by_the_trees_and_meet_them_in_no_join(spark, monkeypatch, held, block):
    from pyspark.sql import functions as F
    r = np.random.default_rng(11)
    rows = [(i, [float(f) for f in np.float32(r.normal(0, 1, 6) + 3 * (i % 3 == 0))]) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    monkeypatch.setattr(mtree, "HELD_BYTES", held, raising=False)
    monkeypatch.setattr(mtree, "QUERY_BLOCK", block)
    searched, plain = [], mtree.arrow_pass
    monkeypatch.setattr(mtree, "arrow_pass", lambda d, *a: searched.append(d) or plain(d, *a))
    got = sorted(map(tuple, mtree.top_k(df, F.col("id") % 50 == 0, shard_rows=40).collect()))
    assert got == brute(rows)
    last = [d for d in searched if "entry_child" in d.columns][-1]
    lines = last._jdf.queryExecution().executedPlan().toString().splitlines()
    at = lambda what: [n for n, line in enumerate(lines) if what in line]
    # queries times shards are dealt out as they are, never the side of a join, which could be broadcast from the driver
    assert at("Generate explode") and min(at("Generate explode")) < min(at("Join") or [len(lines)])
