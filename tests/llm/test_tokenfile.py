"""Token files against the library's ids; the coder's round trip, checkpoints and checksums."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gapscope.llm import catalog, rans, tokenfile

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 3000), st.integers(1, 70_000), st.integers(0, 1 << 30), st.sampled_from([(64, 4, 3), (500, 8, 2), (1 << 16, 64, 256)]))
def test_round_trip(n, kinds, seed, shape):
    r = np.random.default_rng(seed)
    ids = np.minimum(r.geometric(min(1, 5 / kinds), n), kinds).astype(np.uint32) + np.uint32(r.choice([0, (1 << 32) - 70_001]))
    block, lanes, step = shape
    assert (rans.decode_segment(rans.encode_segment(ids, block, lanes, step)) == ids).all()


def test_coding_is_close_to_the_entropy_and_damage_is_found():
    r = np.random.default_rng(1)
    ids = np.minimum(r.zipf(1.5, 400_000), 5000).astype(np.uint32)
    data = rans.encode_segment(ids)
    p = np.bincount(ids) / len(ids)
    entropy = -(p[p > 0] * np.log2(p[p > 0])).sum() * len(ids) / 8
    assert len(data) < 1.1 * entropy + 8 * 5000
    for at in (len(data) // 2, len(data) - 3):
        with pytest.raises(ValueError):
            rans.decode_segment(data[:at] + bytes([data[at] ^ 1]) + data[at + 1:])
    with pytest.raises(ValueError):
        rans.decode_segment(b"other" + data)


def texts():
    r = random.Random(8)
    out = [None, "", " ", "\n", "A b", "x <|endoftext|> y <|STARTOFTEXT|><|startoftext|>", "don't we'LL it's 'S", "Été déjà ÀÉÎ ÿ ß µ ª º × ÷", "a\x1cb\x85c\xa0d\te\r\nf",
           "İstanbul ΣΑΣ ς ſ K", "é é̂ ́x  ̈y", "Word. word, WORD!!! word### (word) 123 4.5", "日本 語😀", "long " * 30_000, "ab" * 500]
    alphabet = "abcdeinrstÉéñß  \n.,'!?0123<|>日́\t"
    out += ["".join(r.choice(alphabet) for _ in range(r.randint(1, 60))) for _ in range(800)]
    return out + ["".join(chr(r.choice([r.randint(1, 0x24f), r.randint(0x250, 0xd7ff)])) for _ in range(20)) for _ in range(300)]


def test_ids_match_the_library(library):
    own = tokenfile.LibraryIds(open(PATH, encoding="utf-8").read())
    assert own.by_stretch
    for t in texts():
        assert np.frombuffer(own.encode(t), "<u4").tolist() == library.encode(t or "", add_special_tokens=False).ids, repr(t)
    for c in map(chr, [*range(1, 0x500), *range(0x2000, 0x2070), 0x3000, 0xfeff]):
        t = f"a{c}B {c} 1{c}{c}. x{c}."
        assert np.frombuffer(own.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, hex(ord(c))


def test_other_tokenizers_go_text_by_text():
    own = tokenfile.LibraryIds(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
    assert not own.by_stretch and len(own.encode("two words")) == 8


def test_query(spark, tmp_path, library):
    rows = [(7 * i % 101, t, i) for i, t in enumerate(texts()[:101])]
    spark.createDataFrame(rows, "doc_id long, text string, range int").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    want, start = [], 0
    for i, t, _ in sorted(rows, key=lambda r: r[0]):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, catalog.QUERIES["op1_rans_tokens"](spark, str(tmp_path)).collect())) == want


def test_many_segments_odd_ids_and_no_rows(spark, tmp_path, library):
    rows = [(None, "no id"), (None, "no id"), (3, "b c"), (3, "b c"), (3, "other"), (-5, "x " * 500)] + [(100 + i, "some words here") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tokenfile.write_token_files(docs, str(tmp_path / "a"), PATH, segment_tokens=40)
    got = sorted(tokenfile.read_token_files(spark, str(tmp_path / "a"), with_ids=True).collect(), key=lambda r: r.start)
    assert [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got[:-1]]))
    assert [r.doc_id for r in got] == [None, None, -5, 3, 3, 3] + list(range(100, 150))
    assert got[-1].ids == library.encode("some words here").ids + [1]
    assert spark.read.parquet(str(tmp_path / "a")).count() > 5
    tokenfile.write_token_files(docs.where("false"), str(tmp_path / "b"), PATH)
    assert tokenfile.read_token_files(spark, str(tmp_path / "b")).count() == 0
