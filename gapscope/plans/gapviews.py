"""Queries over the (model, locale) gap table and the wide score table."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapscope import dims as D
from gapscope.functions.quantiles import quantiles
from gapscope.operators import gapstats as A
from gapscope.operators import ranking as K
from gapscope.operators import reshape as R
from gapscope.operators.metrics import gaps_long
from gapscope.plans.registry import register, with_ctes
from gapscope.plans.scores import long_table, scored_responses
from gapscope.plans.sqlparts import BASE_CTES, gaps_sql
from gapscope.sources import bindings as B
from gapscope.sources.tables import table

GL = {**BASE_CTES, **gaps_sql()}
LOCS = B.BIND_LOCALES[1:]                       # the binding's gap locales
SUBS = [s for s in D.canonical_subsets() if D.split_subset_name(s)[0] in B.BIND_LOCALES]
GAPS = ["global_gap", "local_gap", "knowledge_gap"]
DEC = 10   # means of doubles: compared after rounding (summation order differs by engine)


def _gl(spark, sf_dir):
    return gaps_long(long_table(spark, sf_dir, ["accuracy"]))


def _sql_list(xs):
    return ", ".join(f"'{x}'" for x in xs)


@register("gap_by_country_locale", with_ctes(GL, f"""
SELECT country, locale, {', '.join(f'round(avg({g}), {DEC}) AS {g}' for g in GAPS)}
FROM gl GROUP BY country, locale"""))
def q_gap_by_country_locale(spark, sf_dir):
    return A.gap_by_country_locale(_gl(spark, sf_dir), decimals=DEC)


@register("gap_by_locale", with_ctes(GL, f"""
SELECT locale, {', '.join(f'round(avg({g}), {DEC}) AS {g}' for g in GAPS)} FROM gl GROUP BY locale"""))
def q_gap_by_locale(spark, sf_dir):
    return A.gap_by_locale(_gl(spark, sf_dir), decimals=DEC)


@register("country_order", with_ctes(GL, f"""
SELECT country, round(avg(knowledge_gap), {DEC}) AS mean_knowledge_gap FROM gl GROUP BY country"""))
def q_country_order(spark, sf_dir):
    return A.country_order(_gl(spark, sf_dir), decimals=DEC)


@register("model_order", with_ctes(GL, f"""
SELECT model, round(avg(knowledge_gap), {DEC}) AS mean_knowledge_gap FROM gl GROUP BY model"""))
def q_model_order(spark, sf_dir):
    return A.model_order(_gl(spark, sf_dir), decimals=DEC)


@register("gap_extent", with_ctes(GL, """
SELECT min(global_gap) AS min_global_gap, max(global_gap) AS max_global_gap,
       min(local_gap) AS min_local_gap, max(local_gap) AS max_local_gap,
       min(least(global_gap, local_gap, knowledge_gap)) AS min_all_gaps,
       max(greatest(global_gap, local_gap, knowledge_gap)) AS max_all_gaps
FROM gl"""))
def q_gap_extent(spark, sf_dir):
    return A.gap_extent(_gl(spark, sf_dir))


@register("locale_centroid", with_ctes(GL, f"""
SELECT locale, round(avg(global_gap), {DEC}) AS global_gap, round(avg(local_gap), {DEC}) AS local_gap
FROM gl GROUP BY locale"""))
def q_locale_centroid(spark, sf_dir):
    return A.locale_centroid(_gl(spark, sf_dir), decimals=DEC)


@register("row_mean", with_ctes(GL, f"""
SELECT model, country, round(avg(knowledge_gap), {DEC}) AS mean_knowledge_gap FROM gl GROUP BY model, country"""))
def q_row_mean(spark, sf_dir):
    return A.row_mean(_gl(spark, sf_dir), decimals=DEC)


@register("distinct_countries", with_ctes(BASE_CTES, """
SELECT coalesce(dm.country, 'Unknown') AS country, min(r.pos) AS first_pos
FROM r LEFT JOIN dm ON r.model = dm.model GROUP BY 1"""))
def q_distinct_countries(spark, sf_dir):
    from gapscope.operators.metrics import with_country
    resp = with_country(B.responses(spark, sf_dir).select("model", "pos"), B.dim_model(spark, sf_dir))
    return A.distinct_countries(resp, "pos")


@register("gap_box_stats", with_ctes(GL, f"""
SELECT locale, country, count(knowledge_gap) AS n, min(knowledge_gap) AS min,
       round(quantile_cont(knowledge_gap, 0.25), {DEC}) AS q25,
       round(quantile_cont(knowledge_gap, 0.5), {DEC}) AS median,
       round(quantile_cont(knowledge_gap, 0.75), {DEC}) AS q75, max(knowledge_gap) AS max
FROM gl WHERE knowledge_gap IS NOT NULL GROUP BY locale, country"""))
def q_gap_box_stats(spark, sf_dir):
    out = A.gap_box_stats(_gl(spark, sf_dir))
    return out.withColumns({c: F.round(c, DEC) for c in ("q25", "median", "q75")})


@register("score_quantiles", """
SELECT l_returnflag, l_linestatus, count(*) AS n, min(v) AS min, round(quantile_cont(v, 0.01), 6) AS q01, round(quantile_cont(v, 0.5), 6) AS median,
       round(quantile_cont(v, 0.999), 6) AS q999, max(v) AS max
FROM (SELECT l_returnflag, l_linestatus, CAST(l_extendedprice * (1 - l_discount) AS DOUBLE) AS v FROM lineitem) t GROUP BY l_returnflag, l_linestatus""")
def q_score_quantiles(spark, sf_dir):
    """Exact quantiles of few, large groups."""
    li = table(spark, sf_dir, "lineitem", "l_returnflag", "l_linestatus", "l_extendedprice", "l_discount")
    v = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("double")
    out = quantiles(li.select("l_returnflag", "l_linestatus", v.alias("v")), ["l_returnflag", "l_linestatus"], "v",
                    {"q01": 0.01, "median": 0.5, "q999": 0.999})
    return out.withColumns({c: F.round(c, 6) for c in ("q01", "median", "q999")})


@register("home_locale_cells", with_ctes({**GL, "home": "SELECT * FROM (VALUES " + ", ".join(
    f"('{c}', '{loc}')" for c, loc in (
        (c, {D.LOCALE_INFO[x][0].upper(): x for x in D.GAP_LOCALES}[lab])
        for c, lab in D.HOME_LOCALE_LABEL.items())) + ") t(country, home_locale)"}, """
SELECT c.model, c.country, c.locale, c.gap, c.value, coalesce(h.home_locale = c.locale, false) AS is_home
FROM (SELECT model, country, locale, 'global_gap' AS gap, global_gap AS value FROM gl
      UNION ALL SELECT model, country, locale, 'local_gap', local_gap FROM gl
      UNION ALL SELECT model, country, locale, 'knowledge_gap', knowledge_gap FROM gl) c
LEFT JOIN home h ON h.country = c.country"""))
def q_home_locale_cells(spark, sf_dir):
    return A.home_locale_cells(_gl(spark, sf_dir), D.dim_home_locale(spark))


_NATIVE_VALUES = ", ".join(f"('{c}', [{_sql_list(ls)}])" for c, ls in D.COUNTRY_NATIVE_LOCALES.items())


@register("native_gaps", with_ctes({**GL, "nat": f"SELECT * FROM (VALUES {_NATIVE_VALUES}) t(country, langs)"}, f"""
, wanted AS (
  SELECT m.model, m.country, unnest(coalesce(n.langs, [{_sql_list(D.DEFAULT_NATIVE_LOCALES)}])) AS language
  FROM (SELECT DISTINCT model, country FROM gl) m LEFT JOIN nat n ON n.country = m.country)
SELECT w.model, w.country, w.language, g.global_gap, g.local_gap, g.knowledge_gap
FROM wanted w LEFT JOIN gl g ON g.model = w.model AND g.locale = w.language"""))
def q_native_gaps(spark, sf_dir):
    return A.native_gaps(_gl(spark, sf_dir), D.dim_country_native(spark))


_EXTREME_SQL = """
, t AS (SELECT locale, model, country, knowledge_gap,
               row_number() OVER (PARTITION BY locale ORDER BY knowledge_gap DESC, model) AS rt,
               row_number() OVER (PARTITION BY locale ORDER BY knowledge_gap ASC, model) AS rb
        FROM gl WHERE knowledge_gap IS NOT NULL)
, x AS (SELECT locale, model, country, knowledge_gap, rt <= 3 AS is_top, rb <= 3 AS is_bottom
        FROM t WHERE rt <= 3 OR rb <= 3)
"""


@register("extreme_models", with_ctes(GL, _EXTREME_SQL + "SELECT * FROM x"))
def q_extreme_models(spark, sf_dir):
    return K.extreme_models(_gl(spark, sf_dir), k=3)


@register("rank_in_locale", with_ctes(GL, _EXTREME_SQL + """
SELECT *, row_number() OVER (PARTITION BY locale ORDER BY knowledge_gap DESC, model) AS rank_key FROM x"""))
def q_rank_in_locale(spark, sf_dir):
    return K.rank_in_locale(K.extreme_models(_gl(spark, sf_dir), k=3))


_MEAN_EXPR = ("(" * len(LOCS) + "CAST(0 AS DOUBLE)" + "".join(f" + coalesce({x}, 0))" for x in LOCS)
              + " / nullif(" + " + ".join(f"CAST({x} IS NOT NULL AS INTEGER)" for x in LOCS) + ", 0)")


@register("sorted_heatmap", with_ctes(GL, f"""
, w AS (SELECT model, country, {', '.join(f"max(CASE WHEN locale = '{x}' THEN knowledge_gap END) AS {x}" for x in LOCS)}
        FROM gl GROUP BY model, country)
SELECT *, {_MEAN_EXPR} AS kg_mean FROM w"""))
def q_sorted_heatmap(spark, sf_dir):
    return K.sorted_heatmap(_gl(spark, sf_dir), LOCS)


_WIDE_SQL = f"""
, w AS (SELECT model, country, {', '.join(f"max(CASE WHEN subset = '{x}' THEN value END) AS {x}" for x in SUBS)}
        FROM lg WHERE metric = 'accuracy' GROUP BY model, country)
"""


@register("to_wide", with_ctes(BASE_CTES, _WIDE_SQL + "SELECT * FROM w"))
def q_to_wide(spark, sf_dir):
    return R.order_columns(R.to_wide(long_table(spark, sf_dir), "accuracy", SUBS), "canonical")


@register("sort_models", with_ctes(BASE_CTES, _WIDE_SQL + "SELECT * FROM w"))
def q_sort_models(spark, sf_dir):
    return K.sort_models(R.to_wide(long_table(spark, sf_dir), "accuracy", SUBS))


def _model_order(spark, sf_dir):
    sup = table(spark, sf_dir, "supplier", "s_suppkey")
    return sup.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("model"),
                      F.col("s_suppkey").alias("model_ord"))


@register("order_rows", with_ctes(BASE_CTES, _WIDE_SQL + """
SELECT w.*, s.s_suppkey AS model_ord FROM w LEFT JOIN supplier s ON w.model = 'S' || CAST(s.s_suppkey AS VARCHAR)"""))
def q_order_rows(spark, sf_dir):
    wide = R.order_columns(R.to_wide(long_table(spark, sf_dir), "accuracy", SUBS), "canonical")
    return R.order_rows(wide, _model_order(spark, sf_dir))


@register("order_columns", with_ctes(BASE_CTES, _WIDE_SQL + "SELECT * FROM w"))
def q_order_columns(spark, sf_dir):
    wide = R.to_wide(long_table(spark, sf_dir), "accuracy", SUBS)
    return R.order_columns(wide, "triplet")


@register("select_scores", with_ctes(BASE_CTES, _WIDE_SQL + "SELECT model, country, " + ", ".join(
    x for x in SUBS if x.endswith("_ca")) + " FROM w"))
def q_select_scores(spark, sf_dir):
    return R.select_scores(R.to_wide(long_table(spark, sf_dir), "accuracy", SUBS), suffix="_ca")


@register("densify_profile", with_ctes(GL, f"""
SELECT m.model, m.country, l.locale, g.knowledge_gap
FROM (SELECT DISTINCT model, country FROM gl) m
JOIN (SELECT unnest([{_sql_list(D.GAP_LOCALES)}]) AS locale) l ON true
LEFT JOIN gl g ON g.model = m.model AND g.locale = l.locale"""))
def q_densify_profile(spark, sf_dir):
    return R.densify_profile(_gl(spark, sf_dir), D.GAP_LOCALES)


@register("gap_summary_wide", with_ctes(GL, "SELECT model, country, " + ", ".join(
    f"round(avg(CASE WHEN locale = '{x}' THEN {g} END), {DEC}) AS {g}__{x}"
    for g, x in sorted((g, x) for g in GAPS for x in LOCS)) + " FROM gl GROUP BY model, country"))
def q_gap_summary_wide(spark, sf_dir):
    out = R.gap_summary_wide(_gl(spark, sf_dir), LOCS)
    return out.withColumns({c: F.round(c, DEC) for c in out.columns if "__" in c})


@register("melt_gaps", with_ctes(GL, f"""
, m AS (SELECT locale, round(avg(global_gap), {DEC}) AS global_gap, round(avg(local_gap), {DEC}) AS local_gap
        FROM gl GROUP BY locale)
SELECT locale, 'global_gap' AS metric, global_gap AS value FROM m
UNION ALL SELECT locale, 'local_gap', local_gap FROM m"""))
def q_melt_gaps(spark, sf_dir):
    return R.melt_gaps(A.gap_by_locale(_gl(spark, sf_dir), decimals=DEC))


_PANEL_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"('{m}', {i}, CAST({lo} AS DOUBLE), CAST({hi} AS DOUBLE))"
    for i, (m, (lo, hi, _c)) in enumerate(D.METRIC_PANELS.items())) + ") t(metric, panel_ord, vmin, vmax)"
_SUBDIM_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"('{s}', {i}, '{D.split_subset_name(s)[0]}')" for i, s in enumerate(SUBS)) + ") t(subset, subset_ord, col_group)"


@register("metric_matrix", with_ctes({**BASE_CTES, "p": _PANEL_SQL, "sd": _SUBDIM_SQL}, """
SELECT lg.metric, p.panel_ord, lg.model, lg.country, lg.subset, sd.subset_ord, sd.col_group, lg.value,
       (lg.value - p.vmin) / (p.vmax - p.vmin) AS norm_value
FROM lg JOIN p ON p.metric = lg.metric JOIN sd ON sd.subset = lg.subset"""))
def q_metric_matrix(spark, sf_dir):
    return R.metric_matrix(long_table(spark, sf_dir), D.dim_panel(spark), D.dim_subset(spark, SUBS))


_PANEL_HOME_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"('{c}', '{loc}')" for c in D.PANEL_HOME_COUNTRIES
    for loc in [next(x for x in D.GAP_LOCALES if D.LOCALE_INFO[x][0].upper() == D.HOME_LOCALE_LABEL[c])]) + ") t(country, home)"


@register("metric_panels", with_ctes({**BASE_CTES, "p": _PANEL_SQL, "sd": _SUBDIM_SQL, "h": _PANEL_HOME_SQL}, """
, c AS (SELECT lg.metric, p.panel_ord, lg.model, lg.country, lg.subset, sd.subset_ord, sd.col_group, lg.value,
               (lg.value - p.vmin) / (p.vmax - p.vmin) AS norm_value
        FROM lg JOIN p ON p.metric = lg.metric JOIN sd ON sd.subset = lg.subset)
, o AS (SELECT model, CAST(row_number() OVER (ORDER BY model) - 1 AS INTEGER) AS model_ord FROM (SELECT DISTINCT model FROM c WHERE panel_ord = 0))
SELECT c.*, o.model_ord, coalesce(h.home || '_cs' = c.subset, false) AS is_home_cs
FROM c LEFT JOIN o ON o.model = c.model LEFT JOIN h ON h.country = c.country"""))
def q_metric_panels(spark, sf_dir):
    cells = R.metric_matrix(long_table(spark, sf_dir), D.dim_panel(spark), D.dim_subset(spark, SUBS))
    return R.panel_rows(cells, D.dim_panel_home(spark))


@register("coverage_gaps", with_ctes(BASE_CTES, f"""
SELECT m.model, e.subset
FROM (SELECT DISTINCT model FROM lg WHERE metric = 'accuracy') m
JOIN (SELECT unnest([{_sql_list(SUBS)}]) AS subset) e ON true
WHERE (e.subset = 'chinese_cs' AND CAST(substr(m.model, 2) AS BIGINT) % 5 = 0) OR
  NOT EXISTS (SELECT 1 FROM lg WHERE lg.metric = 'accuracy' AND lg.model = m.model AND lg.subset = e.subset)"""))
def q_coverage_gaps(spark, sf_dir):
    # every fifth model has not run one subset
    ran = ~((F.col("subset") == "chinese_cs") & (F.substring("model", 2, 18).cast("long") % 5 == 0))
    return R.coverage_gaps(long_table(spark, sf_dir).where(ran), SUBS)
