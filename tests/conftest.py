import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from gapscope.session import build_session
    s = build_session(master="local[4]", app="gapscope-tests", shuffle_partitions=4)
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gapscope-test-ckpt-"))
    yield s
    s.stop()


def rows(df, *cols):
    """Sorted list of tuples (order-insensitive comparisons)."""
    cols = cols or df.columns
    key = lambda t: tuple((v is not None, v) for v in t)  # noqa: E731  nulls first
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key)
