"""Source divergence: the joint tree walk and the whole operator against plain loops."""

import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from gapscope.llm import divergence


def p_of(count, total, v):
    return 1 + 10 ** 9 * (count + 2) // (total + 2 * v)


def f_of(p, q):
    return (p - q) ** 2 // (p + q)


def brute(rows, min_docs, top=10):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in text or "")))
            for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df, by = Counter(), defaultdict(Counter)
        for x, source, words in docs:
            if x == lang:
                df.update(set(words))
                by[source].update(words)
        kept = [t for t in df if df[t] >= min_docs]
        v = len(kept)
        n = {s: sum(c[t] for t in kept) for s, c in by.items()}
        p = {s: {t: p_of(c[t], n[s], v) for t in kept} for s, c in by.items()}
        q = {t: p_of(sum(c[t] for c in by.values()), sum(n.values()), v) for t in kept}
        for s in by:
            pairs = sorted(((sum(f_of(p[s][t], p[o][t]) for t in kept), o) for o in by if o != s), key=lambda x: (-x[0], x[1].encode()))
            lead = sorted(((f_of(p[s][t], q[t]), t) for t in kept if by[s][t] and p[s][t] > q[t]), key=lambda x: (-x[0], x[1].encode()))[:top]
            for part, found in (("pair", pairs), ("term", lead)):
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("n_one,n_two,width,density", [(1, 1, 5, .5), (2, 2, 40, .1), (20, 20, 333, .05), (7, 64, 100, .3), (64, 3, 130, .01), (33, 33, 64, 1.0)])
def test_joint_walk(n_one, n_two, width, density):
    r = np.random.default_rng(n_one * width)
    same = n_one == n_two
    counts = [(r.random((n, width)) < density) * r.integers(1, 50, (n, width)) for n in (n_one, n_two)]
    counts[1] = counts[0] if same else counts[1]
    totals = [c.sum(axis=1) for c in counts]
    cells = []
    for c in counts:
        at = r.permutation(np.flatnonzero(c))
        cells.append({"rows": at // width, "cols": at % width, "counts": c.ravel()[at]})
    got, _ = divergence.tile_pairs(tuple(cells), tuple(totals), width + 3, width, same)
    for a in range(n_one):
        for b in range(a + 1 if same else 0, n_two):
            want = sum(f_of(p_of(int(counts[0][a, t]), int(totals[0][a]), width + 3), p_of(int(counts[1][b, t]), int(totals[1][b]), width + 3)) for t in range(width))
            assert got[a, b] == want


def test_zero_quadrants_are_not_visited():
    # two rows that share nothing but a corner of 1024 columns: the walk ends at a few leaves
    cells = {"rows": np.array([0, 15]), "cols": np.array([0, 1023]), "counts": np.array([4, 5])}
    tree = divergence.QuadForest(cells["rows"], cells["cols"], cells["counts"], 4, 64)
    zero, (ra, rb, a, b) = divergence.joint(tree, tree, 4, 1024, range(64), 16, 16, True)
    assert len(a) == 2 * 15 and (tree.roots >= 0).sum() == 2
    assert [zero[i, j] + ((ra == i) & (rb == j)).sum() for i, j in combinations(range(16), 2)] == [1024] * 120


def test_long_division_is_exact_beyond_64_bits():
    n = np.array([0, 1, 9_000_000_000, 8_999_999_999_999])
    assert divergence.share(n, 9_000_000_000_000, 10 ** 6).tolist() == [p_of(int(x), 9_000_000_000_000, 10 ** 6) for x in n]


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("sources,min_docs", [(3, 2), (70, 3)])
def test_operator_against_plain_loops(spark, monkeypatch, sources, min_docs):
    monkeypatch.setattr(divergence, "TILE", 16)
    r = random.Random(sources)
    words = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"] + ["Äpfel", "äpfel", "ÄPFEL", "日本", "x-y"]
    rows = [(" ".join(r.choice(words[:r.choice((5, 105))]) for _ in range(r.randint(0, 30))), r.choice(["de", "en"]), f"s{r.randrange(sources)}") for _ in range(300)]
    rows += [(None, "de", "quiet"), ("", "de", None), (None, None, None), ("12 34 !?", "fr", "a"), ("once", "fr", "b"), ("A a A" * 3, None, "s1")]
    rows += [rows[0]] * 5 + [("very long " * 50_000, "en", "s0")] * 3
    docs = spark.createDataFrame([(*x, 1, "y") for x in rows], "text string, lang string, source string, idx int, term string")
    assert found(divergence.source_divergence(docs, min_docs=min_docs)) == brute(rows, min_docs)


def test_empty_table(spark):
    assert divergence.source_divergence(spark.createDataFrame([], "text string, lang string, source string")).count() == 0
