"""Log-prob scoring queries over the logits binding (embeddings)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapscope.operators import logprobs as L
from gapscope.operators import ranking as K
from gapscope.operators.metrics import top_rank_rates
from gapscope.plans.registry import register, with_ctes
from gapscope.sources import bindings as B

R9 = 9    # exp/ln results compared after rounding (libm vs JVM may differ in the last ulp)
DEC = 10

LP_CTES = {
    "e": B.LOGITS_SQL,
    "t": """SELECT model, subset, pos, gold, generate_subscripts(logits, 1) - 1 AS token_id,
                   CAST(unnest(logits) AS DOUBLE) AS x FROM e""",
    "t2": "SELECT *, max(x) OVER (PARTITION BY pos) AS m FROM t",
    "t3": "SELECT *, m + ln(sum(exp(x - m)) OVER (PARTITION BY pos)) AS lse FROM t2",
    "lp": """SELECT model, subset, pos, gold, token_id, x - lse AS log_prob,
                    row_number() OVER (PARTITION BY pos ORDER BY x DESC, token_id) AS rnk FROM t3""",
    # argmax over the 8 variants: ids 0-3 (" " prefix) precede ids 4-7 ("" prefix)
    "am": """SELECT model, subset, pos, gold, token_id AS argmax_token_id,
                    CASE WHEN token_id < 4 THEN ' ' ELSE '' END AS argmax_prefix,
                    substr('ABCD', CAST(token_id % 4 + 1 AS INTEGER), 1) AS pred
             FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY x DESC, token_id) AS r
                   FROM t3 WHERE token_id < 8) z WHERE r = 1""",
    "top": "SELECT pos, token_id, rnk FROM lp WHERE rnk <= 5",
    "flags": """SELECT am.*, t1.token_id = am.argmax_token_id AS argmax_is_top1,
                       EXISTS (SELECT 1 FROM top WHERE top.pos = am.pos AND top.token_id = am.argmax_token_id)
                         AS argmax_is_top5,
                       t1.token_id < 8 AS top1_is_letter, t1.token_id < 4 AS top1_matches_used_prefix
                FROM am JOIN top t1 ON t1.pos = am.pos AND t1.rnk = 1""",
    "pr": """SELECT model, subset, count(*) AS n_samples,
                    count(*) FILTER (WHERE top1_is_letter) AS top1_is_letter_count,
                    count(*) FILTER (WHERE top1_is_letter) / count(*) AS top1_is_letter_rate,
                    count(*) FILTER (WHERE top1_matches_used_prefix) AS top1_matches_used_prefix_count,
                    count(*) FILTER (WHERE top1_matches_used_prefix) / count(*) AS top1_matches_used_prefix_rate
             FROM flags GROUP BY model, subset""",
}


def _scored(spark, sf_dir, responses=None):
    return L.score_models(B.logits(spark, sf_dir) if responses is None else responses, L.resolve_models(B.letter_tokens(spark, sf_dir)))


@register("log_softmax", with_ctes(LP_CTES, f"""
SELECT model, subset, pos, token_id, round(log_prob, {R9}) AS log_prob FROM lp"""))
def q_log_softmax(spark, sf_dir):
    df = B.logits(spark, sf_dir).withColumn("lp", L.log_softmax("logits"))
    return df.select("model", "subset", "pos", F.posexplode("lp").alias("token_id", "log_prob")).withColumn(
        "log_prob", F.round("log_prob", R9))


@register("top_k_tokens", with_ctes(LP_CTES, f"""
SELECT model, subset, pos, CAST(rnk AS INTEGER) AS rank, token_id, round(log_prob, {R9}) AS log_prob,
       round(exp(log_prob), {R9}) AS prob FROM lp WHERE rnk <= 5"""))
def q_top_k_tokens(spark, sf_dir):
    df = B.logits(spark, sf_dir).withColumn("top", L.top_k_tokens(L.log_softmax("logits"), 5))
    return df.select("model", "subset", "pos", F.inline("top")).withColumns(
        {"log_prob": F.round("log_prob", R9), "prob": F.round("prob", R9)})


_KEYS = ["model", "subset", "pos"]


def _chunks(spark, sf_dir):
    """The logits as one row a token, then in chunks of 24 tokens."""
    tokens = B.logits(spark, sf_dir).select(*_KEYS, F.posexplode("logits").alias("token_id", "logit"))
    return L.to_chunks(tokens, _KEYS, 24)


@register("log_softmax_chunked", with_ctes(LP_CTES, f"""
SELECT model, subset, pos, token_id, round(log_prob, {R9}) AS log_prob FROM lp"""))
def q_log_softmax_chunked(spark, sf_dir):
    return L.chunked_log_softmax(_chunks(spark, sf_dir), _KEYS).withColumn("log_prob", F.round("log_prob", R9))


@register("top_k_tokens_chunked", with_ctes(LP_CTES, f"""
SELECT model, subset, pos, CAST(rnk AS INTEGER) AS rank, token_id, round(log_prob, {R9}) AS log_prob,
       round(exp(log_prob), {R9}) AS prob FROM lp WHERE rnk <= 5"""))
def q_top_k_tokens_chunked(spark, sf_dir):
    return L.chunked_top_k(_chunks(spark, sf_dir), _KEYS, 5).withColumns({"log_prob": F.round("log_prob", R9), "prob": F.round("prob", R9)})


@register("resolve_variants_all", """
SELECT 'E' || CAST(label AS VARCHAR) AS model, v.prefix, v.letter, v.token_id
FROM (SELECT DISTINCT label FROM embeddings) m,
     (SELECT CASE WHEN i < 4 THEN ' ' ELSE '' END AS prefix, substr('ABCD', CAST(i % 4 + 1 AS INTEGER), 1) AS letter,
             CAST(i AS INTEGER) AS token_id FROM range(8) r(i)) v""")
def q_resolve_variants_all(spark, sf_dir):
    return L.resolve_variants(B.letter_tokens(spark, sf_dir), "all").select("model", "prefix", "letter", "token_id")


@register("resolve_variants_first", """
SELECT 'E' || CAST(label AS VARCHAR) AS model, ' ' AS prefix, substr('ABCD', CAST(i + 1 AS INTEGER), 1) AS letter,
       CAST(i AS INTEGER) AS token_id
FROM (SELECT DISTINCT label FROM embeddings) m, range(4) r(i)""")
def q_resolve_variants_first(spark, sf_dir):
    return L.resolve_variants(B.letter_tokens(spark, sf_dir), "first").select("model", "prefix", "letter", "token_id")


@register("argmax_option", with_ctes(LP_CTES, """
SELECT model, subset, pos, gold, argmax_prefix, pred, argmax_token_id, pred = gold AS correct FROM am"""))
def q_argmax_option(spark, sf_dir):
    return _scored(spark, sf_dir).select("model", "subset", "pos", "gold", "argmax_prefix", "pred",
                                         "argmax_token_id", (F.col("pred") == F.col("gold")).alias("correct"))


@register("argmax_rank_flags", with_ctes(LP_CTES, """
SELECT model, subset, pos, argmax_token_id, argmax_is_top1, argmax_is_top5 FROM flags"""))
def q_argmax_rank_flags(spark, sf_dir):
    return _scored(spark, sf_dir).select("model", "subset", "pos", "argmax_token_id", "argmax_is_top1",
                                         "argmax_is_top5")


@register("top_rank_rates", with_ctes(LP_CTES, """
SELECT model, subset, count(*) AS n,
       count(*) FILTER (WHERE argmax_is_top1) / count(*) AS argmax_is_top1_rate,
       count(*) FILTER (WHERE argmax_is_top5) / count(*) AS argmax_is_top5_rate
FROM flags GROUP BY model, subset"""))
def q_top_rank_rates(spark, sf_dir):
    return top_rank_rates(_scored(spark, sf_dir))


@register("gold_option_prob", with_ctes(LP_CTES, f"""
, opts AS (SELECT am.pos, am.gold, lp.token_id, lp.log_prob FROM am JOIN lp ON lp.pos = am.pos
           AND lp.token_id BETWEEN (CASE WHEN am.argmax_prefix = ' ' THEN 0 ELSE 4 END)
                               AND (CASE WHEN am.argmax_prefix = ' ' THEN 3 ELSE 7 END))
, o2 AS (SELECT *, max(log_prob) OVER (PARTITION BY pos) AS mx FROM opts)
SELECT pos, gold, round(sum(CASE WHEN substr('ABCD', CAST(token_id % 4 + 1 AS INTEGER), 1) = gold
                                 THEN exp(log_prob - mx) END) / sum(exp(log_prob - mx)), {R9}) AS gold_prob
FROM o2 GROUP BY pos, gold"""))
def q_gold_option_prob(spark, sf_dir):
    return _scored(spark, sf_dir).select("pos", "gold", F.round("gold_prob", R9).alias("gold_prob"))


@register("compare_used_vs_any_letter", with_ctes(LP_CTES, """
, used AS (SELECT pos, substr('ABCD', CAST(token_id + 1 AS INTEGER), 1) AS pred_under_used_prefix
           FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY x DESC, token_id) AS r
                 FROM t3 WHERE token_id < 4) z WHERE r = 1)
SELECT f.model, f.subset, f.pos, f.top1_is_letter, f.top1_matches_used_prefix, u.pred_under_used_prefix
FROM flags f JOIN used u ON u.pos = f.pos"""))
def q_compare_used_vs_any_letter(spark, sf_dir):
    return _scored(spark, sf_dir).select("model", "subset", "pos", "top1_is_letter", "top1_matches_used_prefix",
                                         "pred_under_used_prefix")


@register("probe_rates", with_ctes(LP_CTES, "SELECT * FROM pr"))
def q_probe_rates(spark, sf_dir):
    return L.probe_rates(_scored(spark, sf_dir))


@register("matrix_means", with_ctes(LP_CTES, f"""
SELECT subset AS key, round(avg(top1_is_letter_rate), {DEC}) AS mean_rate, 'subset' AS axis FROM pr GROUP BY subset
UNION ALL
SELECT model, round(avg(top1_is_letter_rate), {DEC}), 'model' FROM pr GROUP BY model"""))
def q_matrix_means(spark, sf_dir):
    return L.matrix_means(L.probe_rates(_scored(spark, sf_dir)), decimals=DEC)


@register("prefix_histogram", """
SELECT ' ' AS prefix, count(DISTINCT label) AS n_models FROM embeddings""")
def q_prefix_histogram(spark, sf_dir):
    used = L.resolve_variants(B.letter_tokens(spark, sf_dir), "first").select("model", "prefix").distinct()
    return L.prefix_histogram(used)


@register("overall_stats", with_ctes(LP_CTES, """
SELECT count(DISTINCT model) AS n_models, count(DISTINCT subset) AS n_subsets, count(*) AS n_pairs FROM pr"""))
def q_overall_stats(spark, sf_dir):
    return L.overall_stats(L.probe_rates(_scored(spark, sf_dir)))


@register("worst_cases", with_ctes(LP_CTES, f"""
, worst AS (SELECT model, subset, top1_is_letter_rate FROM pr
            ORDER BY top1_is_letter_rate, model, subset LIMIT 15)
, recs AS (SELECT f.model, f.subset, w.top1_is_letter_rate, f.pos,
                  row_number() OVER (PARTITION BY f.model, f.subset ORDER BY f.pos) AS r
           FROM flags f JOIN worst w ON w.model = f.model AND w.subset = f.subset WHERE NOT f.top1_is_letter)
SELECT recs.model, recs.subset, recs.top1_is_letter_rate, recs.pos, CAST(lp.rnk AS INTEGER) AS rank,
       lp.token_id, round(lp.log_prob, {R9}) AS log_prob
FROM recs JOIN lp ON lp.pos = recs.pos AND lp.rnk <= 5 WHERE recs.r <= 3"""))
def q_worst_cases(spark, sf_dir):
    # the first pass needs the rates only; the second scores the rows of the worst cells alone
    worst = K.worst_cells(L.probe_rates(_scored(spark, sf_dir)), n=15)
    rows = B.logits(spark, sf_dir).join(F.broadcast(worst), ["model", "subset"])
    out = K.worst_records(_scored(spark, sf_dir, rows), per_cell=3, tokens=5)
    return out.withColumn("log_prob", F.round("log_prob", R9))
