"""SimHash groups against brute force over all pairs."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gapscope.functions.components import components
from gapscope.llm import catalog, simhash


def plain(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps, distance=4):
    label = list(range(len(fps)))
    def find(i):
        while label[i] != i:
            i = label[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return [find(i) for i in range(len(fps))]


def corpus():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeéß") for _ in range(r.randint(1, 5)))
    texts = [None, "", " \t\n", "one", "One TWO three", "a\x1cb c\xa0d e f g"]
    for _ in range(25):
        base = [word() for _ in range(r.randint(40, 200))]
        for _ in range(r.randint(1, 5)):
            copy = list(base)
            for _ in range(r.randint(0, 2)):
                copy[r.randrange(len(copy))] = word()
            texts.append(" ".join(copy).upper() if r.random() < .2 else "\n".join(copy))
    return texts + texts[6:12] + ["long " * 70_000 + "tail"]


def test_query_matches_brute_force(spark, tmp_path):
    texts = corpus()
    rows = [(3 * i % len(texts) if len(texts) % 3 else i, t, "x") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in catalog.QUERIES["op10_simhash_gray"](spark, str(tmp_path)).collect()}
    fps = [plain(t) for _, t, _ in rows]
    label = groups(fps)
    least = {}
    for (i, *_), g in zip(rows, label):
        least[g] = min(least.get(g, i), i)
    assert got == {i: (f"{f:016x}", least[g]) for (i, *_), f, g in zip(rows, fps, label)}
    assert len(set(label)) < len(texts) - 20


@pytest.mark.parametrize("n", [1, 2, 9, 300, 3000])
def test_index_components(n):
    r = np.random.default_rng(n)
    seeds = r.integers(0, 1 << 63, max(1, n // 20), dtype=np.uint64)
    fps = seeds[r.integers(0, len(seeds), n)]
    for _ in range(3):
        fps = fps ^ (np.uint64(1) << r.integers(0, 64, n).astype(np.uint64))
    fps = np.unique(fps)
    index = simhash.GrayIndex(fps)
    d = np.bitwise_count(index.fps[:, None] ^ index.fps[None, :]) <= 4
    want = np.arange(len(fps))
    while True:
        new = np.where(d, want[None, :], len(fps)).min(axis=1)
        if (new == want).all():
            break
        want = new
    assert (index.components(4) == want).all()


def test_large_groups_are_dealt_over_chunk_pairs(spark):
    r = np.random.default_rng(1)
    fps = np.unique(np.concatenate([r.integers(0, 1 << 13, 400), r.integers(0, 1 << 62, 100)]))
    df = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    want = {(x.node, x.root) for x in simhash.link_components(df).collect()}
    assert {(x.node, x.root) for x in simhash.link_components(df, group_rows=60).collect()} == want
    label = groups([int(x) for x in fps])
    assert {(int(fps[i]), int(fps[g])) for i, g in enumerate(label) if i != g} == want


def test_block_plans_cover_all_pairs_within_distance():
    for n in (10, 1 << 30, 1 << 45):
        masks = [simhash._mask(x) & (1 << 64) - 1 for x in simhash.block_plan(n)]
        r = random.Random(n)
        for _ in range(300):
            flips = sum(1 << b for b in r.sample(range(64), 4))
            assert any(not flips & m for m in masks)


def test_components_of_a_long_chain_and_a_hub(spark):
    e = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1300)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, **{i: 1000 for i in range(1001, 1300)}}


def test_keep_one(spark):
    rows = [(4, "the same words stand here", "x"), (2, "the same words stand here", "y"), (2, "the same words stand here", "y"),
            (9, "quite another text of words", None), (None, "the same words stand here", "z"), (None, "alone of all and without id", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone string")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.gone) for r in kept.collect()) == [("2", "y"), ("9", None), ("None", "w")]
    assert simhash.keep_one(docs.where(F.lit(False))).count() == 0


def test_keep_one_with_one_id_for_two_texts(spark):
    rows = [(1, "the same words stand here", "a"), (5, "the same words stand here", "b"), (5, "quite another text of words", "c"),
            (7, "a third one without any copy", "d"), (7, "and yet a fourth, which differs", "e"), (8, None, "f"), (8, "", "f")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, name string"))
    assert sorted(r.name for r in kept.collect()) == ["a", "c", "d", "e", "f"]
