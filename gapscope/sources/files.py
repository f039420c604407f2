"""Result-file sources and sinks.

Two layouts are read: the study's own (one ``<slug>_accuracy.json`` /
``<slug>_predictions.json`` document per model, read with ``multiLine``,
one task per file) and ours (JSON Lines partitioned by ``slug=``, written
by Spark's committer, any number of tasks per model).  Everything is read
with explicit schemas; ``_metadata.file_name`` keeps the file as a join key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapscope.dims import METRICS
from gapscope.functions.names import model_slug, qa_slug

SCORE_MAPS = METRICS + ["argmax_is_top1_rate", "argmax_is_top5_rate"]

SCORE_SCHEMA = T.StructType(
    [T.StructField("model", T.StringType())]
    + [T.StructField(m, T.MapType(T.StringType(), T.StringType())) for m in SCORE_MAPS]
    + [T.StructField("option_ids_by_prefix", T.MapType(T.StringType(), T.MapType(T.StringType(), T.IntegerType())))])

QA_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("category", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("question", T.StringType()),
    T.StructField("answers", T.ArrayType(T.StringType())), T.StructField("answer_type", T.StringType())])

PROBE_SKIP = ["summary.json", "model_prefix_summary.json"]


def _file_col() -> F.Column:
    return F.col("_metadata.file_name")


# ---------------------------------------------------------------------------
# S1 read_scores, S2 read_predictions, S3 read_probe, S4 read_qa, S5 read_wide_csv, S6 read_source
# ---------------------------------------------------------------------------

def read_scores(spark: SparkSession, path: str, layout: str = "files", metrics=SCORE_MAPS) -> DataFrame:
    """Score files -> long (file, model, metric, subset, value).

    layout 'files': ``<path>/*_accuracy.json`` documents (error when none match);
    layout 'partitioned': JSON Lines under ``<path>/slug=<slug>/``, or under ``<path>/bucket=<n>/`` with
    the slug in each line (file = slug).

    A document that is not valid JSON raises (``FAILFAST``).  Values are read as
    text and cast one by one: one that is no number is null, its neighbours stay.
    A file without any value of a metric keeps one row with null subset and value.
    """
    reader = spark.read.option("mode", "FAILFAST")
    if layout == "files":
        raw = (reader.schema(SCORE_SCHEMA).option("multiLine", True).json(f"{path.rstrip('/')}/*_accuracy.json")
               .withColumn("file", _file_col()))
    else:
        schema = T.StructType([*SCORE_SCHEMA.fields, T.StructField("slug", T.StringType())])
        raw = (reader.schema(schema).json(path)
               .withColumn("file", F.col("slug")))
    per_metric = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("values")) for m in metrics])
    return (raw.select("file", "model", F.explode(per_metric).alias("m"))
            .select("file", "model", F.col("m.metric").alias("metric"), F.explode_outer("m.values").alias("subset", "value"))
            .withColumn("value", F.expr("try_cast(value AS double)")))


def read_predictions(spark: SparkSession, path: str, record_schema: T.StructType, layout: str = "files"
                     ) -> DataFrame:
    """Prediction records, one row each, with file and model; a damaged file raises.

    'files' reads a document in one task; large pretty-printed documents are read
    by many tasks with ``prediction_records``, which also can list damage instead.
    """
    reader = spark.read.option("mode", "FAILFAST")
    if layout == "files":
        schema = T.StructType([T.StructField("model", T.StringType()),
                               T.StructField("predictions", T.ArrayType(record_schema))])
        raw = (reader.schema(schema).option("multiLine", True)
               .json(f"{path.rstrip('/')}/*_predictions.json").withColumn("file", _file_col()))
        return raw.select("file", "model", F.posexplode("predictions").alias("pos", "r")).select(
            "file", "model", "pos", "r.*")
    schema = T.StructType([T.StructField("model", T.StringType()), *record_schema.fields,
                           T.StructField("slug", T.StringType())])
    return reader.schema(schema).json(path).withColumnRenamed("slug", "file")


#: How a pretty-printed prediction file (two spaces a level) begins and ends a record.
RECORD_BEGIN, RECORD_END = "\n    {", "\n    }"


def prediction_records(spark: SparkSession, path: str, record_schema: T.StructType, damaged: str = "error") -> tuple[DataFrame, DataFrame]:
    """S2 for documents of any size: (records, report).

    A pretty-printed document is cut where its records begin, so that a file is read by
    as many tasks as its size asks for; a line break within a string is escaped, which
    makes the cut safe.  Records are (file, model, record fields); the report has a row per
    file: records, records that are no JSON of ``record_schema``, and whether the
    document is ``complete`` (has its head with a model, and its end).

    ``damaged='error'``: a broken record raises when it is read, an incomplete document when
    the report or any record of it is; ``'report'``: good records are kept and the report tells.
    """
    cut = (spark.read.option("lineSep", RECORD_BEGIN).text(f"{path.rstrip('/')}/*_predictions.json")
           .select(_file_col().alias("file"), "value", F.col("_metadata.file_block_start").alias("block")))
    is_head = F.col("value").startswith("{")
    body = F.concat(F.lit("{"), F.regexp_extract("value", r"(?s)^(.*\n    \})", 1))
    parsed = F.from_json(body, T.StructType([*record_schema.fields, T.StructField("_bad", T.StringType())]),
                         {"columnNameOfCorruptRecord": "_bad"})
    rows = cut.where(~is_head).select(
        "file", parsed.alias("r"), (F.length(body) == 1).alias("open"),
        F.col("value").rlike(r"(?s)\n    \}\s*\][^\[\]]*\}\s*$").alias("end"))
    bad = F.col("open") | F.col("r._bad").isNotNull() | F.col("r").isNull()
    model = F.get_json_object(F.concat(F.regexp_replace("value", r'(?s),\s*"predictions"\s*:\s*\[.*$', ""), F.lit("}")), "$.model")
    empty = F.col("value").rlike(r'(?s)"predictions"\s*:\s*\[\s*\]\s*[,}].*\}?\s*$') & F.col("value").rlike(r"(?s)\}\s*$")
    heads = cut.where(is_head).select("file", model.alias("model"), empty.alias("empty"))
    per_file = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n_records"), F.count_if(bad).alias("n_bad"), F.bool_or("end").alias("ended"))
    report = (cut.select("file").distinct().join(heads, "file", "left").join(per_file, "file", "left")
              .select("file", "model", F.coalesce("n_records", F.lit(0)).alias("n_records"), F.coalesce("n_bad", F.lit(0)).alias("n_bad"),
                      (F.col("model").isNotNull() & F.coalesce(F.col("ended"), F.col("empty"), F.lit(False))).alias("complete")))
    if damaged == "error":
        whole = F.col("complete") & (F.col("n_bad") == 0)
        report = report.withColumn("complete", F.when(whole, True).otherwise(F.raise_error(F.concat(F.lit("damaged document "), "file")).cast("boolean")))
    good = rows.where(~bad) if damaged == "report" else rows.withColumn(
        "r", F.when(~bad, F.col("r")).otherwise(F.raise_error(F.concat(F.lit("damaged record in "), "file")).cast(rows.schema["r"].dataType)))
    of_file = report.where("complete") if damaged == "error" else report
    records = good.join(of_file.select("file", "model"), "file").select("file", "model", *[f"r.`{f.name}`" for f in record_schema.fields])
    return records, report


def probe_schema() -> T.StructType:
    token = T.StructType([T.StructField(n, t) for n, t in [
        ("rank", T.IntegerType()), ("token_id", T.IntegerType()), ("token_str", T.StringType()),
        ("token_repr", T.StringType()), ("log_prob", T.DoubleType()), ("prob", T.DoubleType()),
        ("is_answer_letter_variant", T.BooleanType())]])
    record = T.StructType([
        T.StructField("prompt_tail", T.StringType()), T.StructField("gold_answer", T.StringType()),
        T.StructField("top_k_tokens", T.ArrayType(token)),
        T.StructField("top1_is_answer_letter_variant", T.BooleanType()),
        T.StructField("top1_matches_used_prefix", T.BooleanType()),
        T.StructField("pred_under_used_prefix", T.StringType()),
        T.StructField("option_logp_used_prefix", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("option_logp_all_variants", T.MapType(T.StringType(), T.MapType(T.StringType(), T.DoubleType())))])
    subset = T.StructType([
        T.StructField("lang", T.StringType()), T.StructField("n_samples", T.IntegerType()),
        T.StructField("top1_is_answer_letter_variant_count", T.IntegerType()),
        T.StructField("top1_is_answer_letter_variant_rate", T.DoubleType()),
        T.StructField("top1_matches_used_prefix_count", T.IntegerType()),
        T.StructField("top1_matches_used_prefix_rate", T.DoubleType()),
        T.StructField("records", T.ArrayType(record))])
    return T.StructType([
        T.StructField("model", T.StringType()), T.StructField("prefix_used_for_scoring", T.StringType()),
        T.StructField("option_ids_used", T.MapType(T.StringType(), T.IntegerType())),
        T.StructField("all_letter_variants", T.MapType(T.StringType(), T.MapType(T.StringType(), T.IntegerType()))),
        T.StructField("all_letter_variants_raw_keys", T.ArrayType(T.StringType())),
        T.StructField("subsets", T.MapType(T.StringType(), subset))])


def read_probe(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """S3: probe files -> (per (model, subset) rates, per record rows).

    The two summary files are skipped by name; files without ``model`` or
    ``subsets`` are skipped; a document that is not valid JSON raises.  ``multi_line`` reads pretty-printed one-document
    files; Spark-written probe documents are JSON Lines (``multi_line=False``).
    """
    raw = (spark.read.option("mode", "FAILFAST").schema(probe_schema()).option("multiLine", multi_line).json(f"{path.rstrip('/')}/*.json")
           .withColumn("file", _file_col())
           .where(~F.col("file").isin(PROBE_SKIP) & F.col("model").isNotNull() & F.col("subsets").isNotNull()))
    cells = raw.select("file", "model", "prefix_used_for_scoring", F.explode("subsets").alias("subset", "s"))
    rates = cells.select("file", "model", "prefix_used_for_scoring", "subset", "s.lang", "s.n_samples",
                         F.col("s.top1_is_answer_letter_variant_count").alias("top1_is_letter_count"),
                         F.col("s.top1_is_answer_letter_variant_rate").alias("top1_is_letter_rate"),
                         "s.top1_matches_used_prefix_count", "s.top1_matches_used_prefix_rate")
    records = cells.select("model", "subset", F.posexplode("s.records").alias("pos", "r")).select(
        "model", "subset", "pos", F.col("r.top1_is_answer_letter_variant").alias("top1_is_letter"),
        F.col("r.top_k_tokens").alias("top_tokens"), "r.gold_answer", "r.pred_under_used_prefix", "r.prompt_tail")
    return rates, records


def read_qa(spark: SparkSession, path: str) -> DataFrame:
    """JSON Lines QA items; ``answer_type`` defaults to 'entity'; a line that is not valid JSON raises."""
    return (spark.read.option("mode", "FAILFAST").schema(QA_SCHEMA).json(path)
            .withColumn("answer_type", F.coalesce("answer_type", F.lit("entity"))))


def read_wide_csv(spark: SparkSession, path: str, keys=("model", "country")) -> DataFrame:
    """CSV with header; score columns -> double (non-numeric -> null)."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(*keys, *[F.expr(f"try_cast(`{c}` AS double)").alias(c)
                               for c in raw.columns if c not in keys])


def read_source(spark: SparkSession, path: str, split: str | None = "test", configs: list[str] | None = None
                ) -> DataFrame:
    """A source benchmark stored as parquet partitioned by config/split;
    the filters prune partitions (only the listed configs / split are read)."""
    df = spark.read.parquet(path)
    if split is not None:
        df = df.where(F.col("split") == split)
    if configs:
        df = df.where(F.col("config").isin(configs))
    return df


# ---------------------------------------------------------------------------
# S7 write_wide_csv, S8 write_by_model, S12 publish_config
# ---------------------------------------------------------------------------

def write_wide_csv(df: DataFrame, path: str, single_file: bool = True) -> None:
    """CSV with header.  A wide score table has one row per model, so a
    single output file is bounded by the model count; the rows are gathered by
    a shuffle of their own, so what computes them keeps its tasks."""
    out = df.repartition(1) if single_file else df
    out.write.mode("overwrite").option("header", True).csv(path)


def scores_to_documents(long: DataFrame, metrics=METRICS) -> DataFrame:
    """Long scores -> one record per model with a subset->value map per metric.

    Each map holds one model's subsets (bounded by the subset dimension)."""
    per = long.groupBy("model", "metric").agg(F.map_from_entries(F.collect_list(F.struct("subset", "value")))
                                              .alias("values"))
    return per.groupBy("model").pivot("metric", list(metrics)).agg(F.first("values"))


def write_by_model(df: DataFrame, path: str, kind: str = "mcq", mode: str = "overwrite",
                   files_per_model: int | None = 1, buckets: bool = False) -> None:
    """One folder per model, ``slug=<slug>``; MCQ slug '/'->'__', QA slug
    runs of other characters -> '_'.  Dynamic partition overwrite replaces
    only the models present in ``df``.

    Rows are clustered by (slug, salt) first, so each model folder is written
    by ``files_per_model`` tasks instead of every task opening a file in
    every folder; a salt > 1 spreads a hot model's records over several
    tasks (use it for prediction records, keep 1 for per-model documents).
    ``files_per_model=None`` leaves the tasks to the sizes at run time: a model's rows
    beyond ``spark.sql.adaptive.advisoryPartitionSizeInBytes`` are written by several
    tasks and small models share one, so that no count has to be known.

    A new ``path`` is best written with ``mode='errorifexists'``: its tasks put their folders in
    place themselves, while a dynamic overwrite leaves the driver to move them one by one.

    ``buckets=True``, for one small document a model: the folders are ``bucket=<hash of the slug>``, one for each
    shuffle partition, and each line has its ``slug``, so that the folders and files to make, list and open do not grow
    with the models.  Only for a new ``path``: to replace a model would replace its bucket.
    """
    if buckets and (mode == "overwrite" or files_per_model != 1):
        raise ValueError("buckets are for a new path and one document a model")
    slug = model_slug("model") if kind == "mcq" else qa_slug("model")
    out = df.withColumn("slug", slug)
    # an explicit partition count: AQE would otherwise coalesce a small
    # shuffle into one task that writes every model folder serially
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if files_per_model is None:
        out = out.hint("rebalance", F.col("slug"))
    elif files_per_model > 1:
        salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(files_per_model))
        out = out.repartition(n, "slug", salt)
    else:
        out = out.repartition(n, "slug")
    if buckets:
        out = out.withColumn("bucket", F.pmod(F.hash("slug"), F.lit(n)))      # as repartition deals the slugs
    writer = out.write.mode(mode).partitionBy("bucket" if buckets else "slug")
    if mode == "overwrite":
        writer = writer.option("partitionOverwriteMode", "dynamic")
    else:
        writer = writer.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    writer.json(path)


def publish_config(df: DataFrame, path: str, config: str = "config") -> None:
    """Write named configs; other configs already in ``path`` are kept."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(config).parquet(path))
