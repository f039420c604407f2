"""Stupid-backoff scores against plain counting."""

import random
import re
from collections import Counter
from math import log

import numpy as np
import pytest

from gapscope.llm import backoff, catalog


def brute(texts, order=3, min_count=2, factor=0.4):
    docs = [re.findall(r"\w+", (t or "").lower()) for t in texts]
    c = Counter(tuple(d[i:i + n]) for d in docs for n in range(1, order + 1) for i in range(len(d) - n + 1))
    total = sum(map(len, docs))
    out = []
    for d in docs:
        score, steps = 0.0, 0
        for i in range(len(d)):
            for n in range(min(order, i + 1), 0, -1):
                gram = tuple(d[i - n + 1:i + 1])
                if n == 1 or c[gram] >= min_count:
                    score += log(c[gram] / (c[gram[:-1]] if n > 1 else total))
                    break
                score, steps = score + log(factor), steps + 1
        out.append((len(d), steps, score))
    return out


def texts():
    r = random.Random(4)
    words = ["".join(r.choice("abcé") for _ in range(r.randint(1, 3))) for _ in range(40)]
    out = [None, "", " .,! ", "one", "Two, two TWO!", "x" * 5000]
    out += [" ".join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(120)]
    return out + out[5:9] + [" ".join(r.choice(words) for _ in range(30_000))]


@pytest.mark.parametrize("options", [{}, {"chunk_words": 50, "partition_entries": 40}, {"order": 1}, {"order": 5, "min_count": 1, "backoff": 0.3, "chunk_words": 700}])
def test_scores_match_plain_counting(spark, options):
    rows = [(i if i else None, t, 1) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, chunk int").repartition(4)
    want = brute([t for _, t, _ in rows], options.get("order", 3), options.get("min_count", 2), options.get("backoff", 0.4))
    got = {r.doc_id or 0: r for r in backoff.score_documents(docs, **options).collect()}
    assert len(got) == len(rows)
    for i, (n, steps, score) in enumerate(want):
        assert (got[i].n_words, got[i].n_backoffs) == (n, steps) and got[i].log_score == pytest.approx(score, rel=1e-9, abs=1e-9)


def test_query_and_empty_table(spark, tmp_path):
    rows = list(enumerate(texts()[:40]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.doc_id, r.n_words, r.n_backoffs) for r in catalog.QUERIES["op3_stupid_backoff"](spark, str(tmp_path)).collect())
    assert got == [(i, n, s) for i, (n, s, _) in enumerate(brute([t for _, t in rows]))]
    assert backoff.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_packed_arrays():
    r = np.random.default_rng(2)
    for n in (0, 1, 1000):
        x = np.sort(r.integers(0, 1 << 56, n, dtype=np.uint64))
        assert (backoff.unpack_sorted(backoff.pack_sorted(x)) == x).all() and (backoff.unpack(backoff.pack(x), np.uint64) == x).all()
