"""Spaced-seed overlaps against every diagonal of every text and item."""

import random
import re
from itertools import combinations

import duckdb

from gapscope.llm import catalog, decontaminate as dc


def units(text):
    """Words, in Han and kana text (the unspaced scripts used here) single letters."""
    return re.findall(r"[\u3040-\u30ff\u4e00-\u9fff]|[^\W\u3040-\u30ff\u4e00-\u9fff]+", (text or "").lower())


def brute(text, item):
    a, b = units(text), units(item)
    if len(b) < dc.PHRASE_WORDS:
        return bool(b) and a == b
    size = min(dc.WINDOW, len(b))
    return any(sum(a[i + k] == b[j + k] for k in range(size)) >= 0.8 * size - 1e-9
               for i in range(len(a) - size + 1) for j in range(len(b) - size + 1))


def test_masks_meet_every_allowed_placing_of_substitutions():
    def met(masks, n, wrong):
        return any(all(not (m[p - o] == "1") for p in wrong if 0 <= p - o < len(m)) for m in masks for o in range(n - len(m) + 1))
    for n in range(dc.MIN_WORDS, dc.WINDOW + 1):
        masks = dc.MASKS if n == dc.WINDOW else dc.SHORT_MASKS
        assert all(met(masks, n, w) for w in combinations(range(n), n - dc.needed(n)))


def data():
    r = random.Random(11)
    words = ["".join(r.choice("abcdefgé") for _ in range(r.randint(1, 4))) for _ in range(60)]
    say = lambda n: [r.choice(words) for _ in range(n)]
    items = [say(n) for n in (4, 5, 6, 9, 10, 12, 13, 14, 25, 59)]
    texts = [None, "", "  ", "!!!"]
    for _ in range(150):
        t, item = say(r.randint(5, 90)), list(r.choice(items))
        cut = r.randint(0, 2) and item[:r.randint(3, len(item))] or item
        for _ in range(r.randint(0, 3)):
            cut[r.randrange(len(cut))] = "other"
        at = r.randint(0, len(t))
        texts.append(", ".join(t[:at] + cut + t[at:]).upper())
    texts += [" ".join(items[-1]), " ".join(items[-1]), " ".join(say(60_000) + items[-2])]
    return [(i, " ".join(x)) for i, x in enumerate(items)] + [(50, None), (51, "")], texts


def test_query_and_filter_match_brute_force(spark, tmp_path):
    items, texts = data()
    docs = spark.createDataFrame([(i if i else None, t, i) for i, t in enumerate(texts)], "doc_id long, text string, doc int").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    want = {(i, k) for i, t in enumerate(texts[:-1]) for k, x in items if brute(t, x)} | {(len(texts) - 1, 8)}
    got = catalog.QUERIES["op4_spaced_seeds"](spark, str(tmp_path)).collect()
    got_last = {(r.doc_id, r.item_id) for r in got if r.doc_id == len(texts) - 1}
    assert {(r.doc_id, r.item_id) for r in got if r.doc_id != len(texts) - 1} | {(len(texts) - 1, 8)} == want and (len(texts) - 1, 8) in got_last
    assert len(got) == len({(r.doc_id, r.item_id) for r in got}) and len(want) > 60
    assert {(r.doc_id, r.item_id) for r in dc.overlaps(docs, bench, slice_words=30).collect()} == {(r.doc_id, r.item_id) for r in got}
    kept = dc.drop_contaminated(docs, bench, slice_words=70)
    dirty = {r.doc_id for r in got}
    assert kept.columns == docs.columns
    assert sorted(r.doc for r in kept.collect()) == [i for i in range(len(texts)) if i not in dirty]


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "x")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert dc.overlaps(docs, bench).count() == 0 and dc.drop_contaminated(docs, bench).count() == 1
    bench = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    assert dc.overlaps(docs.where("false"), bench).count() == 0 and dc.drop_contaminated(docs.where("false"), bench).count() == 0


SHORT = ["Who was Confucius?", "孔子是谁?", "故宫位于中国哪一座城市的中心?", "yes", "Not sure", "Where is it now?", "", None, "...", "カタカナx"]
HOSTS = ["They asked who was Confucius, then left", "who was the Confucius", "他问孔子是谁。", "孔子说谁是", "请问故宫位于中国哪一座城市的中心呢",
         "请问故宫位于中国哪一座镇子的中心呢", "请问故宫在于美国哪个村子的旁边呢", "yes", "YES!", "yes it is", "not  sure", "I am not sure", "where is it",
         "but where is it, now and here", "カ タ カ ナ x", "カタカナ xy", None, "", "...", "yes"]


def test_short_items_and_scripts_without_blanks(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(HOSTS)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(list(enumerate(SHORT)), "item_id long, text string")
    want = {(i, k) for i, t in enumerate(HOSTS) for k, x in enumerate(SHORT) if brute(t, x)}
    rows = dc.overlaps(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want and len(rows) == len(want) == 11
    assert {r.doc_id for r in dc.drop_contaminated(docs, bench).collect()} == set(range(len(HOSTS))) - {i for i, _ in want}
    docs.write.parquet(str(tmp_path / "documents"))
    bench.write.parquet(str(tmp_path / "benchmark"))
    with duckdb.connect() as con:
        for name in ("documents", "benchmark"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
        assert sorted(con.execute(dc.ORACLE).fetchall()) == sorted(tuple(r) for r in rows)


def test_repetitive_text_and_items(spark):
    docs = spark.createDataFrame([(1, "spam " * 80_000), (2, "spam " * 10 + "egg")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "spam " * 40), (2, "spam " * 30 + "egg"), (3, "spam " * 3)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_equal, r.word_to - r.word_from) for r in dc.overlaps(docs, bench).collect()}
    assert got == {(1, 1): (40, 40), (1, 2): (30, 30), (1, 3): (3, 3), (2, 3): (3, 3)}
