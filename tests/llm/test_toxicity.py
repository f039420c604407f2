"""Noisy-channel toxicity: readings against all paths of the lattice, restored words, held-out accuracy, edge rows."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapscope.llm import catalog, toxicity

SF = "/root/testdata/sf0.1"


def model_of(texts):
    counts = np.zeros(64 ** 3, np.int64)
    for t in texts:
        s = toxicity.symbols_of(t).tolist()
        for a, b, c in zip(s, s[1:], s[2:]):
            counts[a << 12 | b << 6 | c] += 1
    return toxicity.CharModel(counts)


WORDS = "the idiot was here and there a moron is not the stupid one who reads worthless trash in this house of loss".split()
MODEL = model_of([" ".join(random.Random(i).choices(WORDS, k=200)) for i in range(20)])


def cost_of(symbols):
    a = b = 0
    total = 0.0
    for s in symbols:
        if s or b:
            total += float(MODEL.cost[a << 12 | b << 6 | s])
            a, b = b, s
    return total + (float(MODEL.cost[a << 12 | b << 6]) if b else 0.0)


@pytest.mark.parametrize("span,chain", [("1d10t", False), ("m0r0nnn", False), ("i d i 0 t", True), ("s.t.u.p.1.d", True), ("!!d!!", False),
                                        ("w0rthl3$s", False), ("aaa111", False), ("7r@5h", False), ("---", True)])
def test_reading_is_the_best_of_all_paths(span, chain):
    best = min((sum(e[2] for e in path) + cost_of([s for e in path for s in e[0]]), "".join(e[1] for e in path))
               for path in itertools.product(*(toxicity.edges(c, n, chain) for c, n in toxicity._runs(span))))
    got = toxicity.decode(span, chain, MODEL.costs())
    symbols = [(p, "".join(e[1] for e in p)) for p in itertools.product(*(toxicity.edges(c, n, chain) for c, n in toxicity._runs(span)))]
    own = min(sum(e[2] for e in p) + cost_of([s for e in p for s in e[0]]) for p, text in symbols if text == got)
    assert own == pytest.approx(best[0], abs=1e-4)


@pytest.mark.parametrize("text,want", [
    ("You 1d10t, go", "You idiot, go"), ("an idiooooot", "an idiot"), ("such i d i o t here", "such idiot here"), ("m.o.r.o.n!", "moron!"),
    ("w0rthl3ss tr@sh", "worthless trash"), ("$tupid", "stupid"), ("the stupid idiot!", "the stupid idiot!"), ("in 1999 and 2024", "in 1999 and 2024"),
    ("", ""), ("日本語 ÄÖ", "日本語 ÄÖ"), ("a\x00b 😀😀😀 c", "a\x00b 😀😀😀 c"), ("A. B. C.", "A. B. C."), ("loss of a house", "loss of a house")])
def test_restored_words(text, want):
    assert toxicity.restore(text, MODEL)[0] == want


def test_long_spans_are_read_whole_and_alike():
    span = "1d10t" * 3
    long = toxicity.decode(span * 2000, False, MODEL.costs())
    assert len(long) >= 2000 * len(span) // 2 and long.count("idiot") > 2000
    assert toxicity.restore("x " + "a1" * 100_000 + " 1d10t", MODEL)[0].endswith(" idiot")
    assert toxicity.restore("1" * 300_000 + "a", MODEL)[0]


def test_pieces_do_not_cross_words():
    whole = set(toxicity.pieces_of("stupid moron").tolist())
    assert whole == set(toxicity.pieces_of("moron").tolist()) | set(toxicity.pieces_of("STUPID").tolist())
    assert len(toxicity.pieces_of("")) == len(toxicity.pieces_of("! ?")) == 0


def test_held_out_split_and_accuracy(spark):
    got = catalog.QUERIES["op12_channel_toxicity"](spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count() and got.score.between(0, 1).all()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    assert (got.predicted == (got.score >= 0.3)).all()
    tested = got.merge(labels, on="doc_id").query("held_out")
    assert tested[tested.predicted == 1].toxic.mean() > 0.85 and tested[tested.toxic == 1].predicted.mean() > 0.75
    order = tested.score.rank()
    n1, n0 = tested.toxic.sum(), (tested.toxic == 0).sum()
    assert (order[tested.toxic == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) > 0.93


def corpus(spark):
    r = random.Random(5)
    rows = []
    for i in range(400):
        words = r.choices(["house", "tree", "reads", "water", "stone", "and", "the"], k=30)
        if i % 4 == 0:
            words[r.randrange(30)] = r.choice(["idiot", "moron"])
        rows.append((i, " ".join(words), i % 4 == 0, "x"))
    rows += [(900, "the house and 1d10t water", None, "x"), (901, "the m o r o n reads", None, None), (902, None, None, "x"), (903, "", None, "x"),
             (None, "the tree", None, "x"), (904, "stone " * 100_000 + "idiooot", None, "x"), (5, rows[5][1], None, "x"), (5, rows[5][1], None, "x")]
    docs = spark.createDataFrame([(a, b, d, 1) for a, b, _, d in rows], "doc_id long, text string, toxic string, y int")
    labels = spark.createDataFrame([(a, int(c)) for a, _, c, _ in rows if c is not None] + [(7, None), (None, 1), (3, 0), (3, 0)], "doc_id long, toxic int")
    return docs, labels


def test_disguised_words_are_scored_as_restored(spark):
    docs, labels = corpus(spark)
    model = toxicity.fit(docs, labels, toxicity.fit_characters(docs))
    rows = toxicity.predict(docs, model).collect()
    assert len(rows) == 408
    by = {r.doc.doc_id: r for r in rows}
    assert all(by[i].score > 0.3 and by[i].changes == 1 for i in (900, 901, 904)) and by[900].restored == "the house and idiot water"
    assert all((r.score >= 0.3) == (r.doc.doc_id % 4 == 0) for r in rows if r.doc.doc_id is not None and r.doc.doc_id < 400)
    assert by[902].score == by[903].score < 0.3 and by[None].score < 0.3 and by[902].restored == "" and by[5].doc.toxic == "x"


def test_one_label_none_and_empty_tables(spark):
    docs, labels = corpus(spark)
    chars = toxicity.fit_characters(docs)
    one = toxicity.predict(docs, toxicity.fit(docs, labels.where("toxic = 1"), chars))
    assert {round(r.score, 6) for r in one.collect()} == {1.0}
    none = toxicity.predict(docs, toxicity.fit(docs, labels.where("false"), chars))
    assert all(r.score < 1e-200 for r in none.collect())
    empty = docs.where(F.lit(False))
    assert toxicity.predict(empty, toxicity.fit(empty, labels, toxicity.fit_characters(empty))).count() == 0
