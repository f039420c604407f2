"""Composite queries: the end-to-end result processing and small lookups."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapscope.dims import METRICS, literal_array
from gapscope.operators import joins as J
from gapscope.operators import metrics as M
from gapscope.operators import reshape as R
from gapscope.operators.build import translation_coverage
from gapscope.operators.scoring import score_choice
from gapscope.plans.benchmark import TRANSLATED_SQL, q_apply_translations
from gapscope.plans.merges import BL_CTES, batch_long
from gapscope.plans.registry import register, with_ctes
from gapscope.plans.scores import scored_responses
from gapscope.plans.sqlparts import BASE_CTES, GAP_LOCALES_SQL, gaps_sql
from gapscope.plans.text import q_
from gapscope.session import scratch_path, staged
from gapscope.sources import bindings as B
from gapscope.sources import files as S
from gapscope.sources.tables import table


def process_results(spark: SparkSession, results_dir: str, dim_model: DataFrame, ca_dir: str | None = None,
                    metrics=METRICS, threshold: float = 0.0, layout: str = "files",
                    subsets: list[str] | None = None) -> dict[str, DataFrame]:
    """Score files -> per-metric wide tables, hallucination gaps, filtered
    accuracy and accuracy gaps, as one plan over one long table.

    S1 read (+ J1 overlay of the CA folder) -> J8 country -> R1/R2/R3 wide per
    metric -> G2 on conf_err_rate -> G3 on accuracy -> G1 from the filtered
    accuracy.  Every score file is read once, into one staged long table from which
    every output derives, and all outputs keep the runs of a model apart: one row per
    file, also for a file without a value.  A wide table has a column for every subset
    of the files: canonical ones first, then others by name (or ``subsets``).
    ``report`` counts the files read, their values, and the files that G3 kept and
    removed.
    """
    base = S.read_scores(spark, results_dir, layout=layout, metrics=list(metrics))
    if ca_dir is not None:
        # the overlay meets both sides twice
        base = J.overlay_scores(staged(base), staged(S.read_scores(spark, ca_dir, layout=layout, metrics=list(metrics))))
    keys = ("file", "model", "country")
    by_file = staged(M.with_subset_parts(M.with_country(base, dim_model)).select(*keys, "subset", "locale", "kind", "metric", "value"))
    subs = subsets or R.present_subsets(by_file)
    wide = lambda rows, m: R.order_columns(R.to_wide(rows, m, subs, keys), "canonical", keys).orderBy("model", "file")
    out = {m: wide(by_file, m) for m in metrics}
    if "conf_err_rate" in metrics:
        out["hall_gaps"] = M.hallucination_gap(by_file, keys=keys)
    if "accuracy" in metrics:
        kept = M.drop_low_models(by_file, threshold, keys=("file", "model"))
        out["accuracy_filtered"] = wide(kept, "accuracy")
        out["accuracy_gaps"] = M.accuracy_gaps(kept, keys=keys)
        value = F.expr("try_cast(value AS double)")
        per_file = by_file.groupBy("file").agg(
            F.count("value").alias("n_values"),
            F.bool_or((F.col("metric") == "accuracy") & F.coalesce(value >= F.lit(threshold), F.lit(False))).alias("k"))
        out["report"] = per_file.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("n_values"), F.lit(0)).alias("n_values"),
                                     F.count_if("k").alias("kept"), F.count_if(~F.col("k")).alias("removed"))
    return out


def write_results(tables: dict[str, DataFrame], path: str) -> None:
    """One CSV folder per result table of ``process_results``."""
    for name, df in tables.items():
        S.write_wide_csv(df, f"{path.rstrip('/')}/{name}", single_file=False)


def _dump(spark, sf_dir, metrics=("accuracy",)):
    """Base batch as score documents, one a model; overlay batch as the CA folder."""
    run = uuid.uuid4().hex[:12]
    base_dir, ca_dir = scratch_path(spark, f"res-{run}"), scratch_path(spark, f"ca-{run}")
    bl = batch_long(spark, sf_dir).where(F.col("metric").isin(*metrics))
    S.write_by_model(S.scores_to_documents(bl.where(F.col("batch") == "base"), list(metrics)), base_dir, mode="errorifexists", buckets=True)
    S.write_by_model(S.scores_to_documents(bl.where(F.col("batch") == "overlay"), list(metrics)), ca_dir, mode="errorifexists", buckets=True)
    return base_dir, ca_dir


_MERGED = {
    "ob": "SELECT * FROM bl WHERE batch = 'base' AND metric = 'accuracy'",
    "oo": "SELECT * FROM bl WHERE batch = 'overlay' AND metric = 'accuracy'",
    "lg2": f"""
SELECT m.model, coalesce(dm.country, 'Unknown') AS country, m.subset,
       regexp_extract(m.subset, '^(.+?)_(cs_en|cs|ca)$', 1) AS locale,
       regexp_extract(m.subset, '^(.+?)_(cs_en|cs|ca)$', 2) AS kind, 'accuracy' AS metric, m.value
FROM (SELECT model, subset, value FROM ob b WHERE NOT EXISTS (
        SELECT 1 FROM oo WHERE oo.model = b.model AND oo.subset = b.subset)
      UNION ALL SELECT model, subset, value FROM oo WHERE model IN (SELECT model FROM ob)) m
LEFT JOIN dm ON dm.model = m.model""",
}


@register("process_results", with_ctes({**BL_CTES, **_MERGED, **gaps_sql(source="lg2")}, """
SELECT model, country, locale, global_gap, local_gap, knowledge_gap FROM gl"""))
def q_process_results(spark, sf_dir):
    base_dir, ca_dir = _dump(spark, sf_dir)
    out = process_results(spark, base_dir, B.dim_model(spark, sf_dir), ca_dir=ca_dir, metrics=["accuracy"],
                          layout="partitioned")
    return out["accuracy_gaps"].drop("file")


_WHOLE = {
    # merged values of all four metrics, then the model's run kept or not
    "mg": """
SELECT b.model, b.subset, b.metric, b.value FROM bl b WHERE b.batch = 'base' AND NOT EXISTS (
  SELECT 1 FROM bl o WHERE o.batch = 'overlay' AND o.model = b.model AND o.subset = b.subset AND o.metric = b.metric)
UNION ALL SELECT model, subset, metric, value FROM bl
WHERE batch = 'overlay' AND model IN (SELECT model FROM bl WHERE batch = 'base')""",
    "kp": "SELECT model FROM mg WHERE metric = 'accuracy' GROUP BY model HAVING bool_or(value >= 0.45)",
}


@register("process_results_tables", with_ctes({**BL_CTES, **_WHOLE}, """
SELECT t.part, t.model, t.country, t.place, round(t.value, 9) AS value FROM (
  SELECT metric AS part, mg.model, coalesce(dm.country, 'Unknown') AS country, subset AS place, value FROM mg LEFT JOIN dm ON dm.model = mg.model
  UNION ALL
  SELECT 'accuracy_filtered', mg.model, coalesce(dm.country, 'Unknown'), subset, value FROM mg LEFT JOIN dm ON dm.model = mg.model
  WHERE metric = 'accuracy' AND mg.model IN (SELECT model FROM kp)
  UNION ALL
  SELECT 'hall_gaps', a.model, coalesce(dm.country, 'Unknown'), regexp_extract(a.subset, '^(.+?)_cs$', 1), b.value - a.value
  FROM mg a JOIN mg b ON a.model = b.model AND b.subset = a.subset || '_en' AND a.metric = 'conf_err_rate' AND b.metric = 'conf_err_rate'
  LEFT JOIN dm ON dm.model = a.model WHERE right(a.subset, 3) = '_cs' AND regexp_extract(a.subset, '^(.+?)_cs$', 1) IN (""" + GAP_LOCALES_SQL + """)
  UNION ALL
  SELECT 'report_' || what, '', '', '', n FROM (
    SELECT 'kept' AS what, CAST(count(*) AS DOUBLE) AS n FROM kp UNION ALL SELECT 'files', count(DISTINCT model) FROM mg
    UNION ALL SELECT 'n_values', count(value) FROM mg
    UNION ALL SELECT 'removed', count(DISTINCT model) FROM mg WHERE model NOT IN (SELECT model FROM kp)) r
) t WHERE t.value IS NOT NULL"""))
def q_process_results_tables(spark, sf_dir):
    """All outputs of G4 over the four metrics: wide tables, filter, hallucination gaps and the report, as one long table."""
    base_dir, ca_dir = _dump(spark, sf_dir, METRICS)
    out = process_results(spark, base_dir, B.dim_model(spark, sf_dir), ca_dir=ca_dir, threshold=0.45, layout="partitioned")
    keys = ["model", "country"]
    rows = []
    for part in [*METRICS, "accuracy_filtered"]:
        cells = out[part].drop("file")
        rows.append(cells.unpivot(keys, [c for c in cells.columns if c not in keys], "place", "value").withColumn("part", F.lit(part)))
    rows.append(out["hall_gaps"].select(*keys, F.col("locale").alias("place"), F.col("hall_gap").alias("value"), F.lit("hall_gaps").alias("part")))
    counts = out["report"].select([F.col(c).cast("double").alias(c) for c in out["report"].columns])
    rows.append(counts.unpivot([], counts.columns, "what", "value").select(
        F.lit("").alias("model"), F.lit("").alias("country"), F.lit("").alias("place"), "value", F.concat(F.lit("report_"), "what").alias("part")))
    order = ["part", *keys, "place", "value"]
    whole = rows[0].select(order)
    for r in rows[1:]:
        whole = whole.unionByName(r.select(order))
    return whole.where("value IS NOT NULL").withColumn("value", F.round("value", 9))


@register("with_country", with_ctes(BASE_CTES, """
SELECT DISTINCT r.model, coalesce(dm.country, 'Unknown') AS country FROM r LEFT JOIN dm ON dm.model = r.model"""))
def q_with_country(spark, sf_dir):
    models = B.responses(spark, sf_dir).select("model").distinct()
    return M.with_country(models, B.dim_model(spark, sf_dir))


@register("with_short_name", """
SELECT p_partkey, p_brand || '/' || name AS model,
       replace(replace(replace(replace(replace(replace(name, 'Meta-Llama-', 'Llama-'), '-Instruction', '-it'),
               '-Instruct', '-it'), '-Chat', '-chat'), '-Base', '-base'), '-v1.5', '') AS short
FROM (SELECT p_partkey, p_brand, ['Meta-Llama-', ''][p_partkey % 2 + 1] || p_name
             || ['-Instruction', '-Instruct', '-Chat', '-Base', '-v1.5', ''][p_partkey % 6 + 1] AS name FROM part) p""")
def q_with_short_name(spark, sf_dir):
    p = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_name")
    at = lambda parts: F.element_at(literal_array(parts), (F.col("p_partkey") % len(parts) + 1).cast("int"))
    name = F.concat(at(["Meta-Llama-", ""]), "p_name", at(["-Instruction", "-Instruct", "-Chat", "-Base", "-v1.5", ""]))
    return J.with_short_name(p.select("p_partkey", F.concat_ws("/", F.col("p_brand"), name).alias("model")))


@register("with_short_name_lookup", with_ctes(BASE_CTES, """
SELECT DISTINCT r.model, coalesce(s.s_name, r.model) AS short
FROM r LEFT JOIN supplier s ON r.model = 'S' || CAST(s.s_suppkey AS VARCHAR)"""))
def q_with_short_name_lookup(spark, sf_dir):
    dim = table(spark, sf_dir, "supplier", "s_suppkey", "s_name").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("model"), F.col("s_name").alias("short"))
    return J.with_short_name(B.responses(spark, sf_dir).select("model").distinct(), dim)


@register("drop_low_report", with_ctes(BASE_CTES, """
, per AS (SELECT model, bool_or(coalesce(value >= 0.36, false)) AS k FROM lg WHERE metric = 'accuracy' GROUP BY model)
SELECT count(*) FILTER (WHERE NOT k) AS removed, count(*) FILTER (WHERE k) AS kept FROM per"""))
def q_drop_low_report(spark, sf_dir):
    from gapscope.plans.scores import long_table
    return M.drop_low_report(long_table(spark, sf_dir, ["accuracy"]), 0.36)


@register("score_choice", with_ctes({"r": B.RESPONSES_SQL}, """
SELECT model, subset, item, pos, pred = gold AS correct, pred = 'E' AS abstained,
       pred <> gold AND pred <> 'E' AS conf_wrong FROM r"""))
def q_score_choice(spark, sf_dir):
    return scored_responses(spark, sf_dir).select("model", "subset", "item", "pos", "correct", "abstained",
                                                  "conf_wrong")


@register("translation_coverage", f"SELECT config, parse_status, count(*) AS n FROM ({TRANSLATED_SQL}) t GROUP BY config, parse_status")
def q_translation_coverage(spark, sf_dir):
    return translation_coverage(q_apply_translations(spark, sf_dir))
