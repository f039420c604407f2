"""Per-prefix BPE against the tokenizers library, decoding against the text."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer as Library

from gapscope.llm import bpe, catalog

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Library.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def texts():
    r = random.Random(2)
    out = [None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a \n b", "\n\na b\n", "it's we'll I'd 'S x's", "tab\tand nbsp   em　",
           "<|endoftext|>", "x <|endoftext|> y<|endoftext|><|endoftext|>", "<|endoftext", "aaaaaaaaaaaaaaaaaaaaaaaaaaa", "日本語 テキスト 😀😀👩‍👩‍👧", "\x00\x01\x1c\x1f\x85x",
           "é ́ x́", "1234567 12,345.67 ½²", "The 1st!!! ###$$$ ... --- ====== ", "ab" * 5000, " " * 3000 + "x", "word " * 4000]
    alphabet = "aeinorst  \n.,'!?0123éßñ日́\t  "
    out += ["".join(r.choice(alphabet) for _ in range(r.randint(1, 80))) for _ in range(1500)]
    out += ["".join(chr(r.choice([r.randint(1, 0x2ff), r.randint(0x300, 0xd7ff), r.randint(0x1f300, 0x1f9ff)])) for _ in range(20)) for _ in range(300)]
    return out + out[:20]


def test_ids_and_text_match_the_library(library):
    own = bpe.Tokenizer(open(PATH, encoding="utf-8").read())
    import numpy as np
    for t in texts():
        ids = np.frombuffer(own.encode(t), "<u4").tolist()
        assert ids == library.encode(t or "", add_special_tokens=False).ids, repr(t)
        assert own.decode(ids) == (t or "") == library.decode(ids, skip_special_tokens=False)


def test_every_white_space_and_letter_class_cuts_alike(library):
    own = bpe.Tokenizer(open(PATH, encoding="utf-8").read())
    import numpy as np
    for c in map(chr, [*range(1, 0x500), *range(0x2000, 0x2070), 0x3000, 0xfeff]):
        t = f"a{c}b {c} 1{c}{c}."
        assert np.frombuffer(own.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, hex(ord(c))


def test_vocabulary_tokens_encode_as_themselves_and_bad_bytes_decode(library):
    own = bpe.Tokenizer(open(PATH, encoding="utf-8").read())
    for i in random.Random(4).sample(sorted(own.vocabulary.tokens), 4000):
        if own.vocabulary.tokens[i]:
            got = own.vocabulary.encode(own.vocabulary.tokens[i])
            assert (got == [i]) == own.vocabulary.whole(i)
    r = random.Random(9)
    for _ in range(300):
        ids = [r.randrange(60_000) for _ in range(r.randint(0, 12))]
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_query(spark, tmp_path, library):
    rows = [(i if i != 5 else None, t, [1]) for i, t in enumerate(texts()[:60])]
    spark.createDataFrame(rows, "doc_id long, text string, ids array<int>").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog.QUERIES["op2_prefix_bpe"](spark, str(tmp_path)).collect()
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encoded_and_decoded(docs, PATH).count() == 0
