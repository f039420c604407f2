"""S11 with keyed state: the newest row of a key lives in the state store, readers never scan the history.

Each micro-batch of new files goes through ``transformWithState``: a key's newest row is kept
in state, and only rows that change it are emitted.  Keys are dealt into ``KEY_BUCKETS`` buckets by hash, and a
bucket's keys are one state value, so that a batch calls the store by buckets and not by keys.  The changes of a batch are one
``changes/batch_id=N`` folder (written with dynamic overwrite, so a replayed batch
rewrites exactly its folder).  ``compact`` folds all changes so far into one
``snapshot/upto=N`` folder; a read takes the newest snapshot and the changes after it.

A later batch wins over an earlier one; of equal keys within a batch the greatest row by
its JSON text wins, as in ``read_ingested``.  Null keys are a key of their own.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gapscope.session import ship_package

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Buckets of keys in the state store; a checkpoint keeps the number that it began with.
KEY_BUCKETS = 16_384


class NewestRow(StatefulProcessor):
    """Keeps the newest row of a bucket's keys and emits those that change; keys and rows are JSON texts, so nulls need no care."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", T.StructType([T.StructField("rows", T.StringType())]))

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        best: dict[str, str] = {}
        for part in rows:
            for k, r in zip(part["key_text"].tolist(), part["row_text"].tolist()):
                if k not in best or r > best[k]:
                    best[k] = r
        old = self.newest.get()
        known = json.loads(old[0]) if old is not None else {}
        changed = {k: r for k, r in best.items() if known.get(k) != r}
        if changed:
            self.newest.update((json.dumps(known | changed),))
            yield pd.DataFrame({"key_text": list(changed), "row_text": list(changed.values())})

    def close(self) -> None:
        pass


def ingest_keyed(spark: SparkSession, source_dir: str, target_dir: str, checkpoint: str, schema: T.StructType, keys: list[str],
                 transform: Callable[[DataFrame], DataFrame] | None = None, max_files_per_trigger: int | None = None, available_now: bool = True):
    """Start the stream: JSON files in ``source_dir`` -> ``transform`` -> newest rows by ``keys`` -> changes."""
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    rows = reader.json(source_dir)
    rows = transform(rows) if transform is not None else rows
    value = T.StructType([f for f in rows.schema.fields if f.name not in keys])
    key = T.StructType([rows.schema[k] for k in keys])
    text = lambda cols: F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    changed = rows.select(text(keys).alias("key_text"), text(value.fieldNames()).alias("row_text")).withColumn(
        "bucket", F.pmod(F.xxhash64("key_text"), F.lit(KEY_BUCKETS))).groupBy("bucket").transformWithStateInPandas(
        NewestRow(), "key_text string, row_text string", "Update", "None")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        out = batch.select(F.from_json("key_text", key).alias("k"), F.from_json("row_text", value).alias("r")).select("k.*", "r.*", F.lit(batch_id).cast("long").alias("batch_id"))
        (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{target_dir}/changes"))

    w = changed.writeStream.outputMode("update").foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def _snapshots(spark: SparkSession, target_dir: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{target_dir}/snapshot")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_keyed(spark: SparkSession, target_dir: str, keys: list[str]) -> DataFrame:
    """The current row of every key: the newest snapshot and the changes after it."""
    changes, old = spark.read.parquet(f"{target_dir}/changes"), _snapshots(spark, target_dir)
    if old is None:
        later, base = changes, None
    else:
        upto = old.agg(F.max("upto")).first()[0]              # a partition column: no rows are read
        later = changes.where(F.col("batch_id") > upto)
        base = old.where(F.col("upto") == upto).withColumnRenamed("upto", "batch_id")
    rows = later if base is None else base.unionByName(later)
    cols = [c for c in rows.columns if c not in (*keys, "batch_id")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch_id").alias("_r"))
    return newest.select(*keys, "_r.*")


def compact(spark: SparkSession, target_dir: str, keys: list[str]) -> int:
    """Fold all changes so far into a new snapshot; its batch number is returned."""
    upto = int(spark.read.parquet(f"{target_dir}/changes").agg(F.max("batch_id")).first()[0])
    now = read_keyed(spark, target_dir, keys)
    (now.withColumn("upto", F.lit(upto).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("upto").parquet(f"{target_dir}/snapshot"))
    return upto
