"""A few registered queries against their DuckDB oracles at sf0.001 (the full
sweep is tools/check_oracle.py)."""

import duckdb
import pytest

import __spark_entry__ as E
from gapscope.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
NAMES = ["accuracy_gaps", "merge_cs_en_scores", "argmax_option", "parse_labels", "add_item_index",
         "qa_did", "cross_model_prompts", "irt_responses"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _norm(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    assert sorted(ocols) == cols
    idx = [ocols.index(c) for c in cols]
    want = sorted(tuple(_norm(r[i]) for i in idx) for r in cur.fetchall())
    assert got == want
