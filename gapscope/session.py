"""Session helpers: one place for the engine settings every job relies on."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "gapscope",
                  shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Session with AQE, skew-join handling and no web UI.

    ``shuffle_partitions`` is the *initial* partition count; AQE coalesces small
    partitions at run time and splits skewed ones, so on a cluster this can be
    set for the biggest stage (e.g. input bytes / 128 MB).
    """
    b = (SparkSession.builder
         .master(master or os.environ.get("SPARK_MASTER", "local[*]"))
         .appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g")))
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for reliable checkpoints and intermediate tables.

    Uses the directory already set on the context or ``spark.checkpoint.dir``.
    Only an in-process session (``local`` / ``local[n]``: tests, the bench) may
    fall back to a fresh scratch folder; with executors of their own a
    machine-local folder would not survive the loss of one, so an unset
    directory is an error there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="gapscope-ckpt-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the checkpoint folder for tables a job writes and reads back."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df: DataFrame) -> DataFrame:
    """``df`` written once as columns to the shared folder and read back: for wide text rows, far smaller than a checkpoint."""
    path = scratch_path(df.sparkSession, f"staged-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Make ``gapscope`` importable on executors (Python UDF workers).

    Zips the package once per SparkContext and adds it with ``addPyFile``,
    the same as ``--py-files`` would; a no-op when already shipped.
    """
    sc = spark.sparkContext
    if getattr(sc, "_gapscope_shipped", False):
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="gapscope-pyfiles-")), "gapscope.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    sc._gapscope_shipped = True
