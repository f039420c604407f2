import os
import subprocess
import sys

import __spark_entry__ as E


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["model", "country", "locale", "global_gap", "local_gap", "knowledge_gap"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 100


def test_the_rest_works_without_the_optional_subpackage():
    code = ("import sys; sys.modules['ahocorasick'] = sys.modules['regex'] = None; import __spark_entry__ as E; "
            "assert 'accuracy_gaps' in E.queries() and not any(k.startswith('op') and k[2].isdigit() for k in E.queries())")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
