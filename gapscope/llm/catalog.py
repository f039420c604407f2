"""The registered queries of the training-data operators (one ``opN_<name>`` each)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapscope.llm import backoff, bpe, decontaminate, divergence, langid, maintext, mtree, resample, secrets, simhash, tokenfile, toxicity, warc
from gapscope.llm.common import fresh_path, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def op7_secret_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.span_text(F.col("base")), 256).alias("base_sha256"),
        secrets.span_text(F.concat("base", "linked")).alias("spans"),
        F.size("linked").cast("long").alias("n_linked"))


QUERIES["op7_secret_linking"] = op7_secret_linking
ORACLES["op7_secret_linking"] = secrets.ORACLE


def op10_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


QUERIES["op10_simhash_gray"] = op10_simhash_gray


def op8_nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out())
    model = langid.fit(docs.where("not held_out"))
    found = langid.predict(docs.select("doc_id", "held_out", "text"), model, "text")
    return found.select("doc.doc_id", "doc.held_out", "lang_pred", "score", "rejected")


QUERIES["op8_nearest_centroid"] = op8_nearest_centroid


def op4_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES["op4_spaced_seeds"] = op4_spaced_seeds
ORACLES["op4_spaced_seeds"] = decontaminate.ORACLE


def op2_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded_and_decoded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES["op2_prefix_bpe"] = op2_prefix_bpe


def op1_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    tokenfile.write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return tokenfile.read_token_files(spark, path)


QUERIES["op1_rans_tokens"] = op1_rans_tokens


def op5_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


QUERIES["op5_mtree_topk"] = op5_mtree_topk
ORACLES["op5_mtree_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.x) = len(q.x)
  WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""


def op6_min_cut_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.extract(table(spark, sf_dir, "pages"))


QUERIES["op6_min_cut_text"] = op6_min_cut_text


def op9_revisit_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(warc.records_of_pages(table(spark, sf_dir, "pages")))
    return found.select("record_id", "url", "target_id", "state", warc.header_text(F.col("headers")).alias("headers"),
                        F.col("payload.digest").alias("payload_digest"), F.col("payload.n_chars").alias("payload_chars"))


QUERIES["op9_revisit_asof"] = op9_revisit_asof
ORACLES["op9_revisit_asof"] = warc.ORACLE


def op3_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = backoff.score_documents(table(spark, sf_dir, "documents"))
    return found.withColumn("log_score", F.round("log_score", 6))


QUERIES["op3_stupid_backoff"] = op3_stupid_backoff
ORACLES["op3_stupid_backoff"] = backoff.ORACLE


def op13_target_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


QUERIES["op13_target_resample"] = op13_target_resample
ORACLES["op13_target_resample"] = resample.ORACLE


def op11_source_quadtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


QUERIES["op11_source_quadtree"] = op11_source_quadtree
ORACLES["op11_source_quadtree"] = divergence.ORACLE


def op12_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", toxicity.held_out())
    seen = docs.where("not held_out")
    model = toxicity.fit(seen, table(spark, sf_dir, "labels").where(~toxicity.held_out()), toxicity.fit_characters(seen))
    found = toxicity.predict(docs, model)
    return found.select("doc.doc_id", "doc.held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "changes")


QUERIES["op12_channel_toxicity"] = op12_channel_toxicity
