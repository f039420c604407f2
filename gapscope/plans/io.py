"""File round trips and the streaming ingest, checked against SQL on the source tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapscope.operators import build as Bd
from gapscope.operators import logprobs as L
from gapscope.operators.joins import upsert_predictions
from gapscope.operators.metrics import long_scores
from gapscope.operators.prompts import limit_per_subset
from gapscope.operators.reshape import to_wide
from gapscope.plans.benchmark import PARSE_SQL, REPLIES
from gapscope.plans.gapviews import SUBS, _WIDE_SQL
from gapscope.plans.logits import LP_CTES, R9
from gapscope.plans.registry import register, with_ctes
from gapscope.plans.scores import scored_responses
from gapscope.plans.sqlparts import BASE_CTES
from gapscope.session import scratch_path
from gapscope.sources import bindings as B
from gapscope.sources import files as S
from gapscope.streaming.ingest import ingest_results_stream, read_ingested
from gapscope.streaming.keyed import compact, ingest_keyed, read_keyed


def _scratch(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def _long(spark, sf_dir):
    return long_scores(scored_responses(spark, sf_dir), B.dim_model(spark, sf_dir))


@register("read_scores", with_ctes(BASE_CTES, """
SELECT replace(model, '/', '__') AS file, model, metric, subset, value FROM lg"""))
def q_read_scores(spark, sf_dir):
    path = _scratch(spark, "scores")
    S.write_by_model(S.scores_to_documents(_long(spark, sf_dir)), path, mode="errorifexists")
    return S.read_scores(spark, path, layout="partitioned", metrics=["accuracy", "abstain_rate",
                                                                    "conf_err_rate", "cond_acc"])


PRED_RECORD = T.StructType([T.StructField(n, t) for n, t in [
    ("subset", T.StringType()), ("item", T.LongType()), ("gold", T.StringType()), ("pred", T.StringType()),
    ("batch", T.StringType()), ("pos", T.LongType())]])


@register("read_predictions", with_ctes(BASE_CTES, """
SELECT replace(model, '/', '__') AS file, model, subset, item, gold, pred, batch, pos FROM r"""))
def q_read_predictions(spark, sf_dir):
    path = _scratch(spark, "predictions")
    recs = B.responses(spark, sf_dir).select("model", *PRED_RECORD.fieldNames())
    S.write_by_model(recs, path, mode="errorifexists", files_per_model=None)
    return S.read_predictions(spark, path, PRED_RECORD, layout="partitioned")


@register("upsert_predictions_files", with_ctes(BASE_CTES, """
SELECT model, subset, item, gold, pred, batch, pos FROM r WHERE batch = 'base'
  AND (model, subset) NOT IN (SELECT model, subset FROM r WHERE batch = 'overlay' AND kind = 'cs_en')
UNION ALL SELECT model, subset, item, gold, pred, batch, pos FROM r WHERE batch = 'overlay' AND kind = 'cs_en'"""))
def q_upsert_predictions_files(spark, sf_dir):
    """S10 on files: the re-run's records replace the stored ones per (model, subset)."""
    path = _scratch(spark, "upsert")
    r = B.responses(spark, sf_dir).select("model", *PRED_RECORD.fieldNames())
    S.write_by_model(r.where(F.col("batch") == "base"), path, mode="errorifexists", files_per_model=None)
    old = S.read_predictions(spark, path, PRED_RECORD, layout="partitioned").drop("file")
    new = r.where((F.col("batch") == "overlay") & F.col("subset").endswith("_cs_en"))
    return upsert_predictions(old, new)


@register("wide_csv_roundtrip", with_ctes(BASE_CTES, _WIDE_SQL + "SELECT * FROM w"))
def q_wide_csv_roundtrip(spark, sf_dir):
    path = _scratch(spark, "wide")
    S.write_wide_csv(to_wide(_long(spark, sf_dir), "accuracy", SUBS), path)
    return S.read_wide_csv(spark, path)


@register("read_qa", with_ctes({"gen": B.GENERATIONS_SQL}, """
SELECT id, category, lang, generation AS question, answers, answer_type FROM gen"""))
def q_read_qa(spark, sf_dir):
    path = _scratch(spark, "qa")
    g = B.generations(spark, sf_dir).select(
        "id", "category", "lang", F.col("generation").alias("question"), "answers",
        F.when(F.col("answer_type") != "entity", F.col("answer_type")).alias("answer_type"))
    g.write.mode("overwrite").json(path)
    return S.read_qa(spark, path)


@register("publish_config", """
SELECT d.doc_id AS pos, d.text AS question, s[1] AS option_a, s[2] AS option_b, s[3] AS option_c, s[4] AS option_d,
       substr('ABCD', CAST(d.doc_id % 4 + 1 AS INTEGER), 1) AS answer, d.source AS config, 'test' AS split
FROM (SELECT *, string_split(text, '. ') AS s FROM documents) d WHERE len(s) = 4""")
def q_publish_config(spark, sf_dir):
    """S12 + S6: publish normalised configs, read them back with partition pruning."""
    from gapscope.plans.benchmark import _el_source
    path = _scratch(spark, "published")
    S.publish_config(Bd.normalize_source(_el_source(spark, sf_dir), "el"), path)
    return S.read_source(spark, path, split="test")


@register("read_probe", with_ctes(LP_CTES, """
, lim AS (SELECT * FROM flags QUALIFY row_number() OVER (PARTITION BY model, subset ORDER BY pos) <= 100)
SELECT model, subset, count(*) AS n_samples, count(*) FILTER (WHERE top1_is_letter) AS top1_is_letter_count
FROM lim GROUP BY model, subset"""))
def q_read_probe(spark, sf_dir):
    """S3: probe documents (first 100 items per subset, as the probe runs) written and read back."""
    path = _scratch(spark, "probe")
    tokens = B.letter_tokens(spark, sf_dir)
    used = L.resolve_variants(tokens, "first").select("model", "prefix").distinct()
    sc = L.score_logprobs(B.logits(spark, sf_dir).withColumn("item_index", F.col("pos")),
                          L.resolve_variants(tokens, "all"), used_prefix=used)
    sc = limit_per_subset(sc, 100, keys=("model", "subset"))
    rec = F.struct(F.col("gold").alias("gold_answer"),
                   F.transform("top_tokens", lambda t: F.struct(
                       t["rank"].alias("rank"), t["token_id"].alias("token_id"), t["log_prob"].alias("log_prob"),
                       t["prob"].alias("prob"))).alias("top_k_tokens"),
                   F.col("top1_is_letter").alias("top1_is_answer_letter_variant"),
                   "top1_matches_used_prefix", "pred_under_used_prefix")
    cells = sc.groupBy("model", "used_prefix", "subset").agg(
        F.count(F.lit(1)).cast("int").alias("n_samples"),
        F.count_if("top1_is_letter").cast("int").alias("top1_is_answer_letter_variant_count"),
        F.sort_array(F.collect_list(F.struct("pos", rec.alias("r")))).alias("recs"))   # <= 100 per cell
    cells = cells.withColumn("records", F.transform("recs", lambda x: x["r"]))
    docs = cells.groupBy("model", "used_prefix").agg(F.map_from_entries(F.collect_list(F.struct(
        "subset", F.struct("n_samples", "top1_is_answer_letter_variant_count", "records")))).alias("subsets"))
    docs = docs.select("model", F.col("used_prefix").alias("prefix_used_for_scoring"), "subsets")
    # one JSON document per model file, as the probe writes them
    docs.repartition("model").write.mode("overwrite").json(path)
    rates, _records = S.read_probe(spark, path, multi_line=False)
    return rates.select("model", "subset", F.col("n_samples").cast("long").alias("n_samples"),
                        F.col("top1_is_letter_count").cast("long").alias("top1_is_letter_count"))


#: Positions that the records of one probe document cover at most.
PROBE_PART = 1000


def _probe_all(spark, sf_dir):
    """S3: every record of the probe, in several documents per cell, written and read back."""
    path = _scratch(spark, "probe-all")
    tokens = B.letter_tokens(spark, sf_dir)
    used = L.resolve_variants(tokens, "first").select("model", "prefix").distinct()
    sc = L.score_logprobs(B.logits(spark, sf_dir), L.resolve_variants(tokens, "all"), used_prefix=used)
    # the binding has no prompts: the position stands in for the prompt's tail
    rec = F.struct(F.col("pos").cast("string").alias("prompt_tail"), F.col("gold").alias("gold_answer"),
                   F.transform("top_tokens", lambda t: F.struct(
                       t["rank"].alias("rank"), t["token_id"].alias("token_id"), t["log_prob"].alias("log_prob"),
                       t["prob"].alias("prob"))).alias("top_k_tokens"),
                   F.col("top1_is_letter").alias("top1_is_answer_letter_variant"),
                   "top1_matches_used_prefix", "pred_under_used_prefix")
    cells = sc.groupBy("model", "used_prefix", "subset", F.floor(F.col("pos") / PROBE_PART).alias("part")).agg(
        F.count(F.lit(1)).cast("int").alias("n_samples"),
        F.count_if("top1_is_letter").cast("int").alias("top1_is_answer_letter_variant_count"),
        F.count_if("top1_matches_used_prefix").cast("int").alias("top1_matches_used_prefix_count"),
        F.sort_array(F.collect_list(F.struct("pos", rec.alias("r")))).alias("recs"))   # <= PROBE_PART, pos is unique
    docs = cells.select("model", F.col("used_prefix").alias("prefix_used_for_scoring"), F.create_map("subset", F.struct(
        "n_samples", "top1_is_answer_letter_variant_count", "top1_matches_used_prefix_count",
        F.transform("recs", lambda x: x["r"]).alias("records"))).alias("subsets"))
    docs.write.mode("overwrite").json(path)
    return S.read_probe(spark, path, multi_line=False)


@register("read_probe_all", with_ctes(LP_CTES, "SELECT * FROM pr"))
def q_read_probe_all(spark, sf_dir):
    """S3: the rates of whole cells, added up over the documents of each cell."""
    rates, _records = _probe_all(spark, sf_dir)
    out = rates.groupBy("model", "subset").agg(*[F.sum(c).alias(c) for c in (
        "n_samples", "top1_is_letter_count", "top1_matches_used_prefix_count")])
    return out.select("model", "subset", "n_samples",
                      "top1_is_letter_count", (F.col("top1_is_letter_count") / F.col("n_samples")).alias("top1_is_letter_rate"),
                      "top1_matches_used_prefix_count",
                      (F.col("top1_matches_used_prefix_count") / F.col("n_samples")).alias("top1_matches_used_prefix_rate"))


@register("read_probe_records", with_ctes({**LP_CTES, "up": """
SELECT pos, substr('ABCD', CAST(token_id + 1 AS INTEGER), 1) AS pred_used FROM (
  SELECT *, row_number() OVER (PARTITION BY pos ORDER BY x DESC, token_id) AS r FROM t3 WHERE token_id < 4) z WHERE r = 1"""}, f"""
SELECT f.model, f.subset, f.pos, f.gold, up.pred_used, f.top1_is_letter, CAST(lp.rnk AS INTEGER) AS rank, lp.token_id,
       round(lp.log_prob, {R9}) AS log_prob, round(exp(lp.log_prob), {R9}) AS prob
FROM flags f JOIN up ON up.pos = f.pos JOIN lp ON lp.pos = f.pos AND lp.rnk <= 5"""))
def q_read_probe_records(spark, sf_dir):
    """S3: the records of whole cells, one row per top token."""
    _rates, records = _probe_all(spark, sf_dir)
    rows = records.select("model", "subset", F.col("prompt_tail").cast("long").alias("pos"), F.col("gold_answer").alias("gold"),
                          F.col("pred_under_used_prefix").alias("pred_used"), "top1_is_letter", F.explode_outer("top_tokens").alias("t"))
    return rows.select("model", "subset", "pos", "gold", "pred_used", "top1_is_letter", "t.rank", "t.token_id",
                       F.round("t.log_prob", R9).alias("log_prob"), F.round("t.prob", R9).alias("prob"))


REPLY_SCHEMA = T.StructType([T.StructField("pos", T.LongType()), T.StructField("config", T.StringType()),
                             T.StructField("expected", T.IntegerType()), T.StructField("reply", T.StringType())])


@register("ingest_results_stream", with_ctes(REPLIES, PARSE_SQL + "SELECT pos, config, claude_cs, parse_ok FROM parsed"))
def q_ingest_results_stream(spark, sf_dir):
    """Replies land as several JSON files; a file stream labels them batch by batch."""
    src, tgt, ck = _scratch(spark, "replies"), _scratch(spark, "labels"), _scratch(spark, "labels-ckpt")
    B.label_replies(spark, sf_dir).repartition(4).write.mode("overwrite").json(src)
    q = ingest_results_stream(spark, src, tgt, ck, REPLY_SCHEMA,
                              transform=lambda b: Bd.parse_labels(b).drop("reply", "expected"),
                              max_files_per_trigger=1)
    q.awaitTermination()
    return read_ingested(spark, tgt, ["pos"], mode="key").select("pos", "config", "claude_cs", "parse_ok")


@register("ingest_keyed_state", with_ctes(REPLIES, PARSE_SQL + "SELECT pos, config, claude_cs, parse_ok FROM parsed"))
def q_ingest_keyed_state(spark, sf_dir):
    """S11 with keyed state: half of the replies land twice; the second landing changes nothing, then a snapshot is read."""
    src, tgt, ck = _scratch(spark, "replies"), _scratch(spark, "newest"), _scratch(spark, "newest-ckpt")
    label = lambda b: Bd.parse_labels(b).drop("reply", "expected")
    replies = B.label_replies(spark, sf_dir)
    for part in (replies, replies.where(F.col("pos") % 2 == 0)):
        part.write.mode("append").json(src)
        ingest_keyed(spark, src, tgt, ck, REPLY_SCHEMA, ["pos"], transform=label).awaitTermination()
    compact(spark, tgt, ["pos"])
    return read_keyed(spark, tgt, ["pos"]).select("pos", "config", "claude_cs", "parse_ok")
