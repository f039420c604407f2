"""The pipeline against plain Python, stage by stage on its own input."""

import hashlib
import os
import sys

import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(__file__))

from test_decontaminate import brute as overlaps  # noqa: E402
from test_secrets import TEXTS as SECRETS  # noqa: E402
from test_secrets import brute as spans_of  # noqa: E402
from test_simhash import groups, plain  # noqa: E402

import corpus_pipeline as cp  # noqa: E402
from gapscope.llm import langid  # noqa: E402
from gapscope.llm.common import table  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Short documents of the smallest tables, copies, secrets, leaks and odd rows; two extra columns."""
    at = str(tmp_path_factory.mktemp("docs"))
    items = table(spark, SF, "benchmark").limit(3).collect()
    docs = [tuple(r) for r in table(spark, SF, "documents").where("length(text) < 1500").orderBy("doc_id").limit(50).collect()]
    n = max(r[0] for r in docs)
    docs += [(n + 10 + i, f"{docs[i][1]} {t}", "en", "s", None) for i, t in enumerate(SECRETS) if t and len(t) < 2000]
    docs += [(n + 50 + i, r[1] + " .", r[2], r[3], r[4]) for i, r in enumerate(docs[:20])]
    docs += [(n + 90 + i, f"{docs[i][1]} {items[0].text}", "en", "s", 1) for i in range(2)]
    docs += [(n + 100, None, None, None, None), (n + 101, "", "en", None, 0), (n + 102, "12 34", "en", None, 0), docs[3]]
    spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, lang string, source string, n_chars long, doc string, score int"
                          ).repartition(4).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items).write.parquet(f"{at}/benchmark.parquet")
    return at


def redact(text):
    out, at = "", 0
    for s, _, e in sorted(sum(spans_of(text), [])):
        out += text[at:s] + "[secret]" if s >= at else ""
        at = max(at, e)
    return out + text[at:]


def test_run_matches_plain_python(spark, folder):
    docs = table(spark, folder, "documents")
    items = [r.text for r in table(spark, folder, "benchmark").collect()]
    rows = docs.orderBy("doc_id").collect()
    _, _, out = langid.fit(docs).predict([r.text for r in rows])
    rows = list({r.doc_id: r for r, gone in zip(rows, out) if not gone}.values())
    label = groups([plain(r.text) for r in rows])
    rows = [r for i, r in enumerate(rows) if label[i] == i]
    clean = [r for r in rows if not any(overlaps(r.text, t) for t in items)]
    assert 40 < len(clean) < len(rows) < docs.count() - 10
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for r in clean:
        text = redact(r.text)
        ids = library.encode(text, add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), ids, hashlib.sha256(text.encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.token_ids, r.decoded_sha256) for r in cp.run(spark, folder).collect()}
    assert got == want
    assert sum("[secret]" in redact(r.text) for r in clean) >= 5


def test_stages_keep_columns_and_take_an_empty_table(spark, folder):
    docs = table(spark, folder, "documents").where("false")
    for name, stage in cp.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0
        if name != "tokens":
            assert out.columns == docs.columns, name
