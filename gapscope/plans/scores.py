"""Queries over the responses binding: metrics, long table, gaps (§7.4 rows 1-4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapscope.operators import metrics as M
from gapscope.operators.scoring import score_choice
from gapscope.plans.registry import register, with_ctes
from gapscope.plans.sqlparts import BASE_CTES, GAP_LOCALES_SQL, gaps_sql
from gapscope.sources import bindings as B


def scored_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_choice(B.responses(spark, sf_dir))


def long_table(spark: SparkSession, sf_dir: str, metrics=M.METRICS) -> DataFrame:
    return M.long_scores(scored_responses(spark, sf_dir), B.dim_model(spark, sf_dir), metrics)


@register("subset_metrics", with_ctes(BASE_CTES, "SELECT * FROM mw"))
def q_subset_metrics(spark, sf_dir):
    return M.subset_metrics(scored_responses(spark, sf_dir))


@register("long_scores", with_ctes(BASE_CTES, "SELECT * FROM lg"))
def q_long_scores(spark, sf_dir):
    return long_table(spark, sf_dir)


@register("accuracy_gaps", with_ctes({**BASE_CTES, **gaps_sql()}, """
SELECT model, country, locale, global_gap, local_gap, knowledge_gap FROM gl"""))
def q_accuracy_gaps(spark, sf_dir):
    return M.accuracy_gaps(long_table(spark, sf_dir, ["accuracy"]))


@register("gaps_long", with_ctes({**BASE_CTES, **gaps_sql()}, "SELECT * FROM gl"))
def q_gaps_long(spark, sf_dir):
    return M.gaps_long(long_table(spark, sf_dir, ["accuracy"]))


@register("hallucination_gap", with_ctes(BASE_CTES, """
, s AS (SELECT * FROM lg WHERE metric = 'conf_err_rate' AND locale IN (""" + GAP_LOCALES_SQL + """))
, both_ AS (SELECT locale FROM s WHERE kind IN ('cs','cs_en') GROUP BY locale HAVING count(DISTINCT kind) = 2)
, per AS (SELECT model, country, locale,
                 max(CASE WHEN kind = 'cs' THEN value END) AS conf_err_cs,
                 max(CASE WHEN kind = 'cs_en' THEN value END) AS conf_err_cs_en
          FROM s GROUP BY model, country, locale)
SELECT m.model, m.country, b.locale, p.conf_err_cs, p.conf_err_cs_en,
       p.conf_err_cs_en - p.conf_err_cs AS hall_gap
FROM (SELECT DISTINCT model, country FROM s) m CROSS JOIN both_ b
LEFT JOIN per p ON p.model = m.model AND p.country = m.country AND p.locale = b.locale
"""))
def q_hallucination_gap(spark, sf_dir):
    return M.hallucination_gap(long_table(spark, sf_dir, ["conf_err_rate"]))


@register("metric_identity_check", with_ctes(BASE_CTES, """
, g AS (SELECT model, subset, pred, CASE WHEN item % 50 = 0 THEN 'E' ELSE gold END AS gold FROM r)
SELECT model, subset, count(*) FILTER (WHERE pred = gold) + count(*) FILTER (WHERE pred = 'E')
       + count(*) FILTER (WHERE pred <> gold AND pred <> 'E') - count(*) AS residual
FROM g GROUP BY model, subset HAVING residual <> 0"""))
def q_metric_identity_check(spark, sf_dir):
    # items whose gold answer is the abstain letter break the identity
    gold = F.when(F.col("item") % 50 == 0, "E").otherwise(F.col("gold"))
    return M.metric_identity_check(M.subset_metrics(score_choice(B.responses(spark, sf_dir).withColumn("gold", gold))))


@register("drop_low_models", with_ctes(BASE_CTES, """
SELECT model, country, subset, locale, kind, metric, value FROM lg
WHERE metric = 'accuracy' AND model IN (
  SELECT model FROM lg WHERE metric = 'accuracy' GROUP BY model
  HAVING bool_or(coalesce(TRY_CAST(value AS DOUBLE) >= 0.36, false)))"""))
def q_drop_low_models(spark, sf_dir):
    return M.drop_low_models(long_table(spark, sf_dir, ["accuracy"]), threshold=0.36)
