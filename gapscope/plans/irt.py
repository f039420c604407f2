"""Rasch (1PL) queries over the IRT binding."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapscope.operators import irt as M
from gapscope.operators.metrics import accuracy_gaps
from gapscope.plans.registry import register, with_ctes
from gapscope.plans.scores import long_table
from gapscope.plans.sqlparts import BASE_CTES, gaps_sql
from gapscope.sources import bindings as B

IR_CTES = {
    "sc": B.IRT_SCORED_SQL,
    "ir": """
SELECT model, subset,
       CASE WHEN right(subset, 3) = '_ca' THEN 'ca::' || CAST(item AS VARCHAR)
            ELSE 'cs::' || regexp_extract(subset, '^(.+?)_(cs_en|cs)$', 1) || '::' || CAST(item AS VARCHAR) END
         AS item_key,
       CAST(correct AS INTEGER) AS y
FROM sc""",
}

#: A sparser design (an item for every 10 parts), in which answers separate some models and items from the rest.
SPARSE_CTES = {"sc": B.irt_scored_sql(10), "ir": IR_CTES["ir"]}


def _resp(spark, sf_dir):
    return M.irt_responses(B.irt_scored(spark, sf_dir))


def _fit(spark, sf_dir) -> M.RaschFit:
    return M.rasch_fit(_resp(spark, sf_dir))


@register("irt_responses", with_ctes(IR_CTES, "SELECT * FROM ir"))
def q_irt_responses(spark, sf_dir):
    return _resp(spark, sf_dir)


@register("irt_components", with_ctes(IR_CTES, """
, kc AS (SELECT item_key, regexp_extract(item_key, '^(ca|cs::.+?)::', 1) AS kcomp FROM ir GROUP BY item_key)
, cm AS (SELECT kcomp, min(item_key) AS component FROM kc GROUP BY kcomp)
SELECT kc.item_key AS node, 'i' AS kind, cm.component FROM kc JOIN cm ON cm.kcomp = kc.kcomp
UNION ALL
SELECT DISTINCT ir.model || '|' || ir.subset, 'e', cm.component
FROM ir JOIN kc ON kc.item_key = ir.item_key JOIN cm ON cm.kcomp = kc.kcomp"""))
def q_irt_components(spark, sf_dir):
    return M.irt_components(_resp(spark, sf_dir))


@register("irt_component_report", with_ctes(IR_CTES, """
, kc AS (SELECT item_key, regexp_extract(item_key, '^(ca|cs::.+?)::', 1) AS kcomp FROM ir GROUP BY item_key)
, lk AS (SELECT DISTINCT a.item_key AS x, b.item_key AS y FROM ir a JOIN ir b ON a.model = b.model AND a.subset = b.subset)
, walk AS (
  WITH RECURSIVE w(x, y) AS (SELECT x, y FROM lk UNION SELECT w.x, lk.y FROM w JOIN lk ON w.y = lk.x)
  SELECT x AS item_key, min(y) AS component FROM w GROUP BY x)
, pairs AS (SELECT component, kcomp AS key_component, count(*) AS n_items FROM walk JOIN kc USING (item_key) GROUP BY component, kcomp)
SELECT component, key_component, n_items, count(*) OVER (PARTITION BY key_component) AS n_observed, count(*) OVER (PARTITION BY component) AS n_key,
       CASE WHEN count(*) OVER (PARTITION BY key_component) > 1 THEN 'split' WHEN count(*) OVER (PARTITION BY component) > 1 THEN 'merged' ELSE 'ok' END AS status
FROM pairs"""))
def q_irt_component_report(spark, sf_dir):
    return M.component_report(M.irt_components(_resp(spark, sf_dir)))


@register("rasch_nll", with_ctes(IR_CTES, """
, te AS (SELECT model, subset, (sum(y) - count(*) / 2) / count(*) AS theta FROM ir GROUP BY model, subset)
, bi AS (SELECT item_key, (count(*) / 2 - sum(y)) / count(*) AS b FROM ir GROUP BY item_key)
, d AS (SELECT ir.y, te.theta - bi.b AS x FROM ir JOIN te ON te.model = ir.model AND te.subset = ir.subset
        JOIN bi ON bi.item_key = ir.item_key)
SELECT round(sum(greatest(x, 0) + ln(1 + exp(-abs(x))) - y * x), 6) AS nll, count(*) AS n FROM d"""))
def q_rasch_nll(spark, sf_dir):
    r = _resp(spark, sf_dir)
    theta = r.groupBy("model", "subset").agg(
        ((F.sum("y") - F.count(F.lit(1)) / 2) / F.count(F.lit(1))).alias("theta"))
    b = r.groupBy("item_key").agg(((F.count(F.lit(1)) / 2 - F.sum("y")) / F.count(F.lit(1))).alias("b"))
    return M.rasch_nll(r, theta, b).select(F.round("nll", 6).alias("nll"), "n")


@register("rasch_fit")
def q_rasch_fit(spark, sf_dir):
    return _fit(spark, sf_dir).theta.withColumn("theta", F.round("theta", 6))


@register("rasch_items")
def q_rasch_items(spark, sf_dir):
    return _fit(spark, sf_dir).b.withColumn("b", F.round("b", 6))


@register("rasch_excluded")
def q_rasch_excluded(spark, sf_dir):
    return _fit(spark, sf_dir).excluded


@register("rasch_blocks", with_ctes(SPARSE_CTES, """
, nd AS (SELECT DISTINCT 'e' AS kind, model || '|' || subset AS node, '~' || model || '|' || subset AS id FROM ir
         UNION ALL SELECT DISTINCT 'i', item_key, 'i' || item_key FROM ir)
, bt AS (SELECT DISTINCT CASE WHEN y = 1 THEN '~' || model || '|' || subset ELSE 'i' || item_key END AS u,
                CASE WHEN y = 1 THEN 'i' || item_key ELSE '~' || model || '|' || subset END AS v FROM ir)
, reach AS MATERIALIZED (
  WITH RECURSIVE r(u, v) AS (SELECT u, v FROM bt UNION SELECT r.u, bt.v FROM r JOIN bt ON r.v = bt.u) SELECT u, v FROM r)
, block AS MATERIALIZED (SELECT a.u AS id, min(a.v) AS block FROM reach a JOIN reach b ON a.u = b.v AND a.v = b.u GROUP BY a.u)
-- what trimming leaves: a node between two cycles
, live AS MATERIALIZED (SELECT id FROM nd WHERE id IN (SELECT v FROM reach WHERE u IN (SELECT id FROM block))
          AND id IN (SELECT u FROM reach WHERE v IN (SELECT id FROM block)))
, lk AS (SELECT u AS a, v AS b FROM bt WHERE u IN (SELECT id FROM live) AND v IN (SELECT id FROM live))
, both_ways AS (SELECT a, b FROM lk UNION SELECT b, a FROM lk)
, walk AS MATERIALIZED (
  WITH RECURSIVE w(a, b) AS (SELECT a, b FROM both_ways UNION SELECT w.a, l.b FROM w JOIN both_ways l ON w.b = l.a) SELECT a AS id, min(b) AS part FROM w GROUP BY a)
, sized AS (SELECT part, block, count(*) AS n FROM walk JOIN block USING (id) GROUP BY part, block)
, chosen AS (SELECT part, arg_min(block, struct_pack(n := -n, block := block)) AS block FROM sized GROUP BY part)
SELECT nd.kind, nd.node, CASE WHEN c.block IS NULL THEN 'quasi_separated' ELSE 'estimated' END AS state, substr(c.block, 2) AS component
FROM walk JOIN nd USING (id) LEFT JOIN block USING (id) LEFT JOIN chosen c ON c.part = walk.part AND c.block = block.block"""))
def q_rasch_blocks(spark, sf_dir):
    """Which models and items of the sparse design have a finite estimate, and on which scale."""
    fit = M.rasch_fit(M.irt_responses(B.irt_scored(spark, sf_dir, parts_per_item=10)))
    e = fit.theta.select(F.lit("e").alias("kind"), F.concat_ws("|", "model", "subset").alias("node"), F.lit("estimated").alias("state"), "component")
    i = fit.b.select(F.lit("i").alias("kind"), F.col("item_key").alias("node"), F.lit("estimated").alias("state"), "component")
    out = fit.excluded.where("reason = 'quasi_separated'").select("kind", "node", F.col("reason").alias("state"), F.lit(None).cast("string").alias("component"))
    return e.unionByName(i).unionByName(out)


@register("theta_gaps")
def q_theta_gaps(spark, sf_dir):
    return M.theta_gaps(_fit(spark, sf_dir).theta, B.dim_model(spark, sf_dir))


@register("theta_gaps_standardized")
def q_theta_gaps_standardized(spark, sf_dir):
    return M.theta_gaps_standardized(_fit(spark, sf_dir).theta, B.dim_model(spark, sf_dir))


@register("item_characteristics")
def q_item_characteristics(spark, sf_dir):
    f = _fit(spark, sf_dir)
    return M.item_characteristics(_resp(spark, sf_dir), f.theta, f.b)


@register("accuracy_vs_theta")
def q_accuracy_vs_theta(spark, sf_dir):
    f = _fit(spark, sf_dir)
    acc = accuracy_gaps(long_table(spark, sf_dir))
    return M.accuracy_vs_theta(acc, M.theta_gaps(f.theta, B.dim_model(spark, sf_dir)))


# closed-form parameters: what the views of a fit compute, comparable with SQL
_CLOSED = {
    "te": "SELECT model, subset, (sum(y) - count(*) / 2) / count(*) AS theta FROM ir GROUP BY model, subset",
    "bi": "SELECT item_key, (count(*) / 2 - sum(y)) / count(*) AS b FROM ir GROUP BY item_key",
}


def _closed(spark, sf_dir):
    r = _resp(spark, sf_dir)
    half = F.count(F.lit(1)) / 2
    theta = r.groupBy("model", "subset").agg(((F.sum("y") - half) / F.count(F.lit(1))).alias("theta"))
    b = r.groupBy("item_key").agg(((half - F.sum("y")) / F.count(F.lit(1))).alias("b"))
    return r, theta, b


@register("theta_gaps_closed_form", with_ctes({**IR_CTES, **_CLOSED}, """
, loc AS (SELECT DISTINCT regexp_extract(subset, '^(.+?)_cs$', 1) AS locale FROM te WHERE right(subset, 3) = '_cs')
, ok AS (SELECT locale FROM loc WHERE locale || '_ca' IN (SELECT subset FROM te) AND locale || '_cs_en' IN (SELECT subset FROM te)
         AND 'english_ca' IN (SELECT subset FROM te))
SELECT m.model, ok.locale, round(ca.theta - en.theta, 9) AS global_gap, round(cs.theta - ce.theta, 9) AS local_gap,
       round((cs.theta - ce.theta) - (ca.theta - en.theta), 9) AS knowledge_gap
FROM (SELECT DISTINCT model FROM te) m CROSS JOIN ok
LEFT JOIN te en ON en.model = m.model AND en.subset = 'english_ca'
LEFT JOIN te ca ON ca.model = m.model AND ca.subset = ok.locale || '_ca'
LEFT JOIN te cs ON cs.model = m.model AND cs.subset = ok.locale || '_cs'
LEFT JOIN te ce ON ce.model = m.model AND ce.subset = ok.locale || '_cs_en'"""))
def q_theta_gaps_closed_form(spark, sf_dir):
    _, theta, _ = _closed(spark, sf_dir)
    return M.theta_gaps(theta).select("model", "locale", *[F.round(c, 9).alias(c) for c in ("global_gap", "local_gap", "knowledge_gap")])


@register("accuracy_vs_theta_closed_form", with_ctes({**BASE_CTES, **gaps_sql(), **IR_CTES, **_CLOSED}, """
, ta AS (SELECT model, locale FROM (SELECT DISTINCT model FROM te) CROSS JOIN (
           SELECT DISTINCT regexp_extract(subset, '^(.+?)_cs$', 1) AS locale FROM te WHERE right(subset, 3) = '_cs') l
         WHERE locale || '_ca' IN (SELECT subset FROM te) AND locale || '_cs_en' IN (SELECT subset FROM te))
, th AS (SELECT m.model, m.locale, ca.theta - en.theta AS gg, cs.theta - ce.theta AS lg
FROM ta m LEFT JOIN te en ON en.model = m.model AND en.subset = 'english_ca'
LEFT JOIN te ca ON ca.model = m.model AND ca.subset = m.locale || '_ca'
LEFT JOIN te cs ON cs.model = m.model AND cs.subset = m.locale || '_cs'
LEFT JOIN te ce ON ce.model = m.model AND ce.subset = m.locale || '_cs_en')
SELECT g.model, g.country, g.locale, round(g.global_gap, 9) AS acc_global_gap, round(g.local_gap, 9) AS acc_local_gap,
       round(g.knowledge_gap, 9) AS acc_knowledge_gap, round(gg, 9) AS theta_global_gap, round(lg, 9) AS theta_local_gap,
       round(lg - gg, 9) AS theta_knowledge_gap
FROM gl g LEFT JOIN th ON th.model = g.model AND th.locale = g.locale"""))
def q_accuracy_vs_theta_closed_form(spark, sf_dir):
    _, theta, _ = _closed(spark, sf_dir)
    both = M.accuracy_vs_theta(accuracy_gaps(long_table(spark, sf_dir)), M.theta_gaps(theta))
    return both.select("model", "country", "locale", *[F.round(c, 9).alias(c) for c in both.columns[3:]])


@register("item_characteristics_closed_form", with_ctes({**IR_CTES, **_CLOSED}, """
, w AS (SELECT min(theta) AS lo, (max(theta) - min(theta)) / 10 AS width FROM te)
, d AS (SELECT ir.item_key, ir.y, te.theta, bi.b, least(CAST(floor((te.theta - w.lo) / w.width) AS INTEGER), 9) AS ability_bin
        FROM ir JOIN te ON te.model = ir.model AND te.subset = ir.subset JOIN bi ON bi.item_key = ir.item_key CROSS JOIN w)
SELECT item_key, ability_bin, count(*) AS n, round(avg(y), 9) AS observed, round(avg(1 / (1 + exp(b - theta))), 9) AS predicted
FROM d GROUP BY item_key, ability_bin"""))
def q_item_characteristics_closed_form(spark, sf_dir):
    r, theta, b = _closed(spark, sf_dir)
    return M.item_characteristics(r, theta, b).select(
        "item_key", "ability_bin", "n", F.round("observed", 9).alias("observed"), F.round("predicted", 9).alias("predicted"))


@register("rasch_residuals", with_ctes(IR_CTES, """
SELECT what, CAST(0 AS DOUBLE) AS largest FROM (VALUES ('examinee'), ('item'), ('component mean')) t(what)"""))
def q_rasch_residuals(spark, sf_dir):
    """The fit's own conditions: sums of answers equal sums of probabilities, thetas of a component mean 0."""
    fit, r = _fit(spark, sf_dir), _resp(spark, sf_dir)
    d = r.join(fit.theta.select("model", "subset", "theta"), ["model", "subset"]).join(fit.b.select("item_key", "b"), "item_key")
    off = F.abs(F.sum(F.col("y") - M.sigmoid(F.col("theta") - F.col("b")))).alias("off")
    parts = [("examinee", d.groupBy("model", "subset").agg(off)), ("item", d.groupBy("item_key").agg(off)),
             ("component mean", fit.theta.groupBy("component").agg(F.abs(F.avg("theta")).alias("off")))]
    rows = [df.agg(F.round(F.max("off"), 3).alias("largest")).select(F.lit(w).alias("what"), "largest") for w, df in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])
