"""Merge / split / upsert queries: the lineitem batches stand in for result folders.

``l_linestatus`` F is the base run and O the overlay or re-run; each model's
metrics of one batch form one result file ``<model>_accuracy.json``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapscope.operators import joins as J
from gapscope.operators.metrics import METRICS, subset_metrics
from gapscope.operators.reshape import order_columns, to_wide
from gapscope.plans.gapviews import SUBS
from gapscope.plans.registry import register, with_ctes
from gapscope.plans.scores import scored_responses
from gapscope.plans.sqlparts import BASE_CTES
from gapscope.sources import bindings as B

BL_CTES = {
    **BASE_CTES,
    "mb": """
SELECT *, n_correct / n AS accuracy, n_abstained / n AS abstain_rate, n_conf_wrong / n AS conf_err_rate,
       CASE WHEN n_correct + n_conf_wrong > 0 THEN n_correct / (n_correct + n_conf_wrong)
            ELSE CAST(0 AS DOUBLE) END AS cond_acc
FROM (SELECT model, subset, batch, min(pos) AS pos, count(*) AS n,
             count(*) FILTER (WHERE pred = gold) AS n_correct,
             count(*) FILTER (WHERE pred = 'E') AS n_abstained,
             count(*) FILTER (WHERE pred <> gold AND pred <> 'E') AS n_conf_wrong
      FROM r GROUP BY model, subset, batch) c""",
    "bl": " UNION ALL ".join(
        f"SELECT model || '_accuracy.json' AS file, model, subset, batch, pos, '{m}' AS metric, {m} AS value FROM mb"
        for m in METRICS),
}


def batch_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, model, subset, batch, pos, metric, value): one score file per (model, batch)."""
    sc = scored_responses(spark, sf_dir)
    m = subset_metrics(sc, keys=("model", "subset", "batch"), extra={"pos": F.min("pos")})
    return (m.unpivot(["model", "subset", "batch", "pos"], METRICS, "metric", "value")
            .withColumn("file", F.concat("model", F.lit("_accuracy.json")))
            .select("file", "model", "subset", "batch", "pos", "metric", "value"))


def _side(spark, sf_dir, batch):
    return batch_long(spark, sf_dir).where(F.col("batch") == batch).drop("batch")


@register("overlay_scores", with_ctes({k: BL_CTES[k] for k in ("r", "mb", "bl")}, """
, base AS MATERIALIZED (SELECT file, model, subset, pos, metric, value FROM bl WHERE batch = 'base')
, o AS (SELECT file, model, subset, pos, metric, value FROM bl
        WHERE batch = 'overlay' AND file IN (SELECT file FROM base))
SELECT b.* FROM base b LEFT JOIN (SELECT file, metric, subset, 1 AS hit FROM o) k
  ON k.file = b.file AND k.metric = b.metric AND k.subset = b.subset WHERE k.hit IS NULL
UNION ALL SELECT * FROM o""", once=("mb", "bl")))
def q_overlay_scores(spark, sf_dir):
    base = _side(spark, sf_dir, "base")
    # another run's files name the model differently; the base file's name stays
    overlay = _side(spark, sf_dir, "overlay").withColumn("model", F.concat(F.lit("local/"), "model"))
    return J.overlay_scores(base, overlay)


@register("upsert_scores", with_ctes(BL_CTES, """
, old AS (SELECT file, model, subset, pos, metric, value FROM bl WHERE batch = 'base')
, new AS (SELECT file, model, subset, pos, metric, value FROM bl WHERE batch = 'overlay' AND right(subset, 3) = '_cs')
SELECT * FROM old WHERE (model, subset, metric) NOT IN (SELECT model, subset, metric FROM new)
UNION ALL SELECT * FROM new"""))
def q_upsert_scores(spark, sf_dir):
    old = _side(spark, sf_dir, "base")
    new = _side(spark, sf_dir, "overlay").where(F.col("subset").endswith("_cs"))
    return J.upsert_scores(old, new)


@register("upsert_predictions", with_ctes(BASE_CTES, """
, old AS (SELECT * FROM r WHERE batch = 'base')
, new AS (SELECT * FROM r WHERE batch = 'overlay' AND kind = 'cs_en')
SELECT * FROM old WHERE (model, subset) NOT IN (SELECT model, subset FROM new)
UNION ALL SELECT * FROM new"""))
def q_upsert_predictions(spark, sf_dir):
    r = B.responses(spark, sf_dir)
    return J.upsert_predictions(r.where(F.col("batch") == "base"),
                                r.where((F.col("batch") == "overlay") & (F.col("kind") == "cs_en")))


_CA_SUBS = [s for s in SUBS if s.endswith("_ca")]
_CS_SUBS = ["english_ca"] + [s for s in SUBS if not s.endswith("_ca")]


def _wide_sql(name, batch, subs):
    cols = ", ".join(f"max(CASE WHEN subset = '{x}' THEN value END) AS {x}" for x in subs)
    return {name: f"""
SELECT b.model, coalesce(dm.country, 'Unknown') AS country, {cols}
FROM bl b LEFT JOIN dm ON dm.model = b.model
WHERE batch = '{batch}' AND metric = 'accuracy' GROUP BY b.model, dm.country"""}


@register("merge_wide", with_ctes({**BL_CTES, **_wide_sql("l", "base", _CS_SUBS),
                                   **_wide_sql("rr", "overlay", _CA_SUBS)}, f"""
SELECT l.*, {', '.join(f'rr.{x}' for x in _CA_SUBS if x != 'english_ca')}
FROM l LEFT JOIN rr ON rr.model = l.model AND rr.country = l.country"""))
def q_merge_wide(spark, sf_dir):
    from gapscope.operators.metrics import with_country
    bl = with_country(batch_long(spark, sf_dir), B.dim_model(spark, sf_dir))
    left = to_wide(bl.where(F.col("batch") == "base"), "accuracy", _CS_SUBS)
    right = to_wide(bl.where(F.col("batch") == "overlay"), "accuracy", _CA_SUBS)
    return order_columns(J.merge_wide(left, right), "triplet")


_STRIP = "regexp_replace({c}, '_cs(_en)?$', '')"


@register("merge_cs_en_scores", with_ctes(BL_CTES, f"""
, c AS (SELECT file, model, subset, metric, value, pos, 0 AS side FROM bl
        WHERE batch = 'base' AND right(subset, 6) <> '_cs_en')
, e AS (SELECT file, model, subset, metric, value, pos, 1 AS side FROM bl
        WHERE batch = 'overlay' AND right(subset, 6) = '_cs_en' AND file IN (SELECT file FROM c))
, paired AS (SELECT * FROM e WHERE (file, metric, subset) IN (
      SELECT file, metric, {_STRIP.format(c='subset')} || '_cs_en' FROM c WHERE right(subset, 3) = '_cs'
      UNION SELECT file, metric, subset FROM c))
, en_only AS (SELECT * FROM e WHERE (file, metric, {_STRIP.format(c='subset')}) NOT IN (
      SELECT file, metric, {_STRIP.format(c='subset')} FROM c))
SELECT * FROM c WHERE (file, metric, subset) NOT IN (SELECT file, metric, subset FROM paired)
UNION ALL SELECT * FROM paired UNION ALL SELECT * FROM en_only"""))
def q_merge_cs_en_scores(spark, sf_dir):
    bl = batch_long(spark, sf_dir)
    cs = bl.where((F.col("batch") == "base") & ~F.col("subset").endswith("_cs_en")).drop("batch")
    en = bl.where((F.col("batch") == "overlay") & F.col("subset").endswith("_cs_en")).drop("batch")
    en = en.withColumn("model", F.concat(F.lit("local/"), "model"))
    return J.merge_cs_en_scores(cs, en, ref=cs).drop("group_side", "group_pos")


@register("merge_cs_en_predictions", with_ctes(BASE_CTES, f"""
, c AS (SELECT model AS file, * FROM r WHERE batch = 'base' AND kind <> 'cs_en')
, e AS (SELECT model AS file, * FROM r WHERE batch = 'overlay' AND kind = 'cs_en')
, g AS (SELECT file, subset, min(pos) AS group_pos FROM c GROUP BY file, subset)
SELECT c.*, g.group_pos, c.subset AS group_subset, 0 AS side FROM c JOIN g ON g.file = c.file AND g.subset = c.subset
UNION ALL
SELECT e.*, g.group_pos, g.subset AS group_subset, 1 AS side
FROM e JOIN g ON g.file = e.file AND g.subset = {_STRIP.format(c='e.subset')} || '_cs'
WHERE (e.file, {_STRIP.format(c='e.subset')}) IN (SELECT file, {_STRIP.format(c='subset')} FROM c)"""))
def q_merge_cs_en_predictions(spark, sf_dir):
    r = B.responses(spark, sf_dir).withColumn("file", F.col("model"))
    cs = r.where((F.col("batch") == "base") & (F.col("kind") != "cs_en"))
    en = r.where((F.col("batch") == "overlay") & (F.col("kind") == "cs_en"))
    return J.merge_cs_en_predictions(cs, en, ref=cs)


@register("split_by_suffix", with_ctes(BL_CTES, """
SELECT *, CASE WHEN right(subset, 6) = '_cs_en' THEN 'cs_en' ELSE 'cs' END AS side FROM bl"""))
def q_split_by_suffix(spark, sf_dir):
    return J.split_by_suffix(batch_long(spark, sf_dir))


@register("extract_ca", with_ctes(BL_CTES, "SELECT * FROM bl WHERE right(subset, 3) = '_ca'"))
def q_extract_ca(spark, sf_dir):
    return J.extract_ca(batch_long(spark, sf_dir))


@register("attach_ca", with_ctes(BL_CTES, """
, cs AS (SELECT * FROM bl WHERE batch = 'base' AND metric = 'accuracy')
, ca AS (SELECT * FROM bl WHERE batch = 'overlay' AND metric = 'accuracy' AND right(subset, 3) = '_ca')
, langs AS (SELECT DISTINCT split_part(subset, '_', 1) AS lang FROM cs WHERE right(subset, 3) = '_cs')
, allowed_ca AS (SELECT lang || '_ca' AS subset FROM langs WHERE lang || '_ca' IN (SELECT subset FROM ca)
                 UNION SELECT 'english_ca')
, allowed_cs AS (SELECT s AS subset FROM (SELECT lang || '_cs' AS s FROM langs UNION ALL
                 SELECT lang || '_cs_en' FROM langs) x WHERE s IN (SELECT subset FROM cs))
, files AS (SELECT DISTINCT file, model FROM cs)
, both_ AS (SELECT ca.file, f.model, ca.subset, ca.value, 0 AS prio FROM ca JOIN files f ON f.file = ca.file
            WHERE ca.subset IN (SELECT subset FROM allowed_ca)
            UNION ALL SELECT file, model, subset, value, 1 FROM cs
            WHERE subset IN (SELECT subset FROM allowed_ca UNION SELECT subset FROM allowed_cs))
SELECT file, model, subset, arg_min(value, prio) AS value FROM both_ GROUP BY file, model, subset"""))
def q_attach_ca(spark, sf_dir):
    bl = batch_long(spark, sf_dir).where(F.col("metric") == "accuracy")
    cs = bl.where(F.col("batch") == "base")
    ca = bl.where((F.col("batch") == "overlay") & F.col("subset").endswith("_ca"))
    return J.attach_ca(cs, ca)
