import tempfile

from pyspark.sql import functions as F

from gapscope.operators import build as Bd
from gapscope.plans.io import REPLY_SCHEMA
from gapscope.streaming.ingest import ingest_results_stream, read_ingested
from tests.conftest import rows


def test_stream_equals_batch_and_replay_is_idempotent(spark):
    base = tempfile.mkdtemp(prefix="gapscope-stream-")
    src, tgt, ck = f"{base}/src", f"{base}/tgt", f"{base}/ck"
    data = [(i, "c" + str(i % 3), i % 2, '{"culturally_dependent": %d}' % (i % 2) if i % 5 else "junk")
            for i in range(60)]
    df = spark.createDataFrame(data, REPLY_SCHEMA)
    df.repartition(3).write.json(src)
    tr = lambda b: Bd.parse_labels(b).drop("reply", "expected")
    ingest_results_stream(spark, src, tgt, ck, REPLY_SCHEMA, transform=tr, max_files_per_trigger=1).awaitTermination()
    streamed = read_ingested(spark, tgt, ["pos"], mode="key")
    batch = tr(df)
    assert rows(streamed, "pos", "claude_cs", "parse_ok") == rows(batch, "pos", "claude_cs", "parse_ok")
    # restart: nothing new -> same result; a new file with a changed reply -> latest wins
    ingest_results_stream(spark, src, tgt, ck, REPLY_SCHEMA, transform=tr).awaitTermination()
    spark.createDataFrame([(1, "c1", 0, '{"culturally_dependent": 0}')], REPLY_SCHEMA).write.mode("append").json(src)
    ingest_results_stream(spark, src, tgt, ck, REPLY_SCHEMA, transform=tr).awaitTermination()
    out = dict(rows(read_ingested(spark, tgt, ["pos"], mode="key"), "pos", "claude_cs"))
    assert out[1] == 0 and len(out) == 60


def test_group_mode_replaces_rerun_subsets(spark):
    base = tempfile.mkdtemp(prefix="gapscope-stream-")
    tgt = f"{base}/t"
    S = "model string, subset string, item long, batch_id long"
    spark.createDataFrame([("m", "a_cs", 1, 0), ("m", "a_cs", 2, 0), ("m", "b_cs", 1, 0), ("m", "a_cs", 7, 1)], S) \
        .write.partitionBy("batch_id").parquet(tgt)
    got = rows(read_ingested(spark, tgt, ["model", "subset"], mode="group"), "subset", "item")
    assert got == [("a_cs", 7), ("b_cs", 1)]


def test_keyed_state_emits_changes_and_reads_the_newest_snapshot(spark):
    import os

    from gapscope.streaming.keyed import compact, ingest_keyed, read_keyed
    base = tempfile.mkdtemp(prefix="gapscope-keyed-")
    src, tgt, ck = f"{base}/src", f"{base}/tgt", f"{base}/ck"
    reply = lambda v: '{"culturally_dependent": %d}' % v

    def land(*data):
        spark.createDataFrame(list(data), REPLY_SCHEMA).coalesce(1).write.mode("append").json(src)
        ingest_keyed(spark, src, tgt, ck, REPLY_SCHEMA, ["pos"], transform=lambda b: Bd.parse_labels(b).drop("reply", "expected")).awaitTermination()

    changes = lambda: spark.read.parquet(f"{tgt}/changes").groupBy("batch_id").count().collect()
    now = lambda: dict(rows(read_keyed(spark, tgt, ["pos"]), "pos", "claude_cs"))
    land(*[(i, "c", 0, reply(i % 2)) for i in range(20)], (None, "c", 0, reply(1)))
    assert now() == {**{i: i % 2 for i in range(20)}, None: 1}
    # the same rows again and one change: one row is emitted, by a restarted stream
    land(*[(i, "c", 0, reply(i % 2 if i != 3 else 0)) for i in range(20)])
    assert now()[3] == 0 and sorted(r["count"] for r in changes()) == [1, 21]
    upto = compact(spark, tgt, ["pos"])
    land((4, "c", 0, reply(1)), (50, "d", 0, reply(1)))
    assert now() == {**{i: i % 2 for i in range(20)}, None: 1, 3: 0, 4: 1, 50: 1}
    plan = read_keyed(spark, tgt, ["pos"])._jdf.queryExecution().toString()
    assert "upto" in plan and "batch_id#" in plan and sorted(os.listdir(f"{tgt}/snapshot"))[-1] == f"upto={upto}"
    # a replayed batch: the last commit is lost, the batch runs again on the state before it
    last = max(int(f) for f in os.listdir(f"{ck}/commits") if f.isdigit())
    before = now()
    for name in (str(last), f".{last}.crc"):
        if os.path.exists(f"{ck}/commits/{name}"):
            os.remove(f"{ck}/commits/{name}")
    ingest_keyed(spark, src, tgt, ck, REPLY_SCHEMA, ["pos"], transform=lambda b: Bd.parse_labels(b).drop("reply", "expected")).awaitTermination()
    assert now() == before and len(changes()) == 3


def test_a_bucket_of_keys_is_one_state_value_and_only_changes_are_emitted():
    import pandas as pd

    from gapscope.streaming.keyed import NewestRow

    class State:
        value, calls = None, 0

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls, self.value = self.calls + 1, value
    state = State()
    rows_of = NewestRow()
    rows_of.newest = state
    call = lambda *parts: [tuple(r) for df in rows_of.handleInputRows((7,), iter(pd.DataFrame(p, columns=["key_text", "row_text"]) for p in parts), None)
                           for r in df.itertuples(index=False)]
    assert call([("a", "1"), ("b", "1")], [("a", "3"), ("a", "2"), ("c", "1")]) == [("a", "3"), ("b", "1"), ("c", "1")]
    assert state.calls == 2                                     # for three keys
    assert call([("a", "3"), ("b", "1")]) == []
    assert call([("b", "0"), ("d", "1")]) == [("b", "0"), ("d", "1")]
    assert call([("c", "1"), ("a", "3"), ("d", "1")]) == []
