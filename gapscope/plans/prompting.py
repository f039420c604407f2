"""Prompt-table queries over benchmark items and the lineitem run plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapscope import dims as D
from gapscope.dims import literal_array
from gapscope.operators import prompts as P
from gapscope.operators.scoring import normalize_gold
from gapscope.plans.registry import register, with_ctes
from gapscope.plans.scores import scored_responses
from gapscope.plans.text import q_
from gapscope.sources import bindings as B
from gapscope.sources.tables import table

NL = "chr(10)"


def _values(rows, cols):
    body = ", ".join("(" + ", ".join("NULL" if v is None else (q_(v) if isinstance(v, str) else str(v))
                                     for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) t({', '.join(cols)})"


LOC_SQL = _values([(loc, *D.LOCALE_INFO[loc]) for loc in D.GAP_LOCALES],
                  ["locale", "lang", "culture", "native_preamble"])
TPL4_SQL = _values([(k, q, a) for k, (q, a) in D.PROMPT_LABELS.items()], ["lang", "q_label", "a_label"])
TPL_GEN5_SQL = _values([(k, q, i, a, e) for k, (q, i, a, e) in D.GEN5_LABELS.items()],
                       ["lang", "q_label", "instruction", "a_label", "idk_option"])

# items with subset parts and the loglik4 prompt language (strict: every binding locale has a template)
ITEMS_CTES = {
    "pi": B.PROMPT_ITEMS_SQL,
    "loc": LOC_SQL,
    "ps": """
SELECT pi.*, regexp_extract(subset, '^(.+?)_(cs_en|cs|ca)$', 1) AS locale,
       regexp_extract(subset, '^(.+?)_(cs_en|cs|ca)$', 2) AS kind FROM pi""",
    "pl": """
SELECT ps.*, CASE WHEN ps.subset = 'english_ca' OR ps.kind = 'cs_en' THEN 'en' ELSE loc.lang END AS prompt_lang,
       loc.culture, loc.native_preamble
FROM ps LEFT JOIN loc ON loc.locale = ps.locale""",
}


def _items(spark, sf_dir):
    return B.prompt_items(spark, sf_dir)


@register("parse_subset", with_ctes(ITEMS_CTES, "SELECT DISTINCT subset, locale, kind, prompt_lang FROM pl"))
def q_parse_subset(spark, sf_dir):
    return P.parse_subset(_items(spark, sf_dir).select("subset").distinct(), "loglik4", "strict").select(
        "subset", "locale", "kind", "prompt_lang")


@register("add_preamble", with_ctes(ITEMS_CTES, """
SELECT item_id, subset, CASE WHEN kind = 'cs_en' THEN 'This is a question about ' || culture || ' culture.'
                             WHEN kind = 'cs' THEN native_preamble END AS preamble FROM pl"""))
def q_add_preamble(spark, sf_dir):
    it = P.parse_subset(_items(spark, sf_dir), "loglik4", "strict")
    return P.add_preamble(it, english=True, native=True).select("item_id", "subset", "preamble")


def _loglik4_prompt_sql(pre: bool) -> str:
    p = (f"coalesce(CASE WHEN kind = 'cs_en' THEN 'This is a question about ' || culture || ' culture.' "
         f"WHEN kind = 'cs' THEN native_preamble END || {NL}, '') || ") if pre else ""
    return (f"{p}t.q_label || question || {NL} || 'A. ' || option_a || {NL} || 'B. ' || option_b || {NL} || "
            f"'C. ' || option_c || {NL} || 'D. ' || option_d || {NL} || t.a_label")


@register("build_prompts", with_ctes({**ITEMS_CTES, "t": TPL4_SQL}, f"""
SELECT pl.item_id, pl.subset, pl.prompt_lang, {_loglik4_prompt_sql(True)} AS prompt
FROM pl JOIN t ON t.lang = pl.prompt_lang"""))
def q_build_prompts(spark, sf_dir):
    it = P.pick_question(P.parse_subset(_items(spark, sf_dir), "loglik4", "strict"))
    it = P.add_preamble(it, english=True, native=True)
    return P.build_prompts(it, "loglik4").select("item_id", "subset", "prompt_lang", "prompt")


@register("build_prompts_gen5", with_ctes({**ITEMS_CTES, "t": TPL_GEN5_SQL}, f"""
SELECT pl.item_id, pl.subset, coalesce(t.lang, 'en') AS prompt_lang,
       t2.q_label || question || {NL} || 'A. ' || option_a || {NL} || 'B. ' || option_b || {NL} ||
       'C. ' || option_c || {NL} || 'D. ' || option_d || {NL} || 'E. ' || t2.idk_option || {NL} ||
       t2.instruction || {NL} || t2.a_label AS prompt
FROM pl LEFT JOIN t ON t.lang = pl.prompt_lang
JOIN t t2 ON t2.lang = coalesce(t.lang, 'en')"""))
def q_build_prompts_gen5(spark, sf_dir):
    it = P.pick_question(P.parse_subset(_items(spark, sf_dir), "gen5", "lenient"))
    return P.build_prompts(it, "gen5").select("item_id", "subset", "prompt_lang", "prompt")


TPL5_SQL = _values([(k, q, a, e) for k, (q, a, e) in D.LOGLIK5_LABELS.items()], ["lang", "q_label", "a_label", "idk_option"])
TPL_GEN4_SQL = _values([(k, q, i, a) for k, (q, i, a) in D.GEN4_LABELS.items()], ["lang", "q_label", "instruction", "a_label"])
_LINES = " || ".join(f"{NL} || '{x}. ' || option_{x.lower()}" for x in "ABCD")

#: One run of each kind: a base model, and the instruct models with a wrapper of their own.
WRAPPED = ["org/base-model", D.JAIS_CHAT_MODELS[0], D.ACEGPT_CHAT_MODELS[0]]


@register("build_prompts_loglik5", with_ctes({**ITEMS_CTES, "t": TPL5_SQL}, f"""
SELECT pl.item_id, pl.subset, pl.prompt_lang,
       t.q_label || question || {_LINES} || {NL} || 'E. ' || t.idk_option || {NL} || t.a_label AS prompt
FROM pl JOIN t ON t.lang = pl.prompt_lang"""))
def q_build_prompts_loglik5(spark, sf_dir):
    it = P.pick_question(P.parse_subset(_items(spark, sf_dir), "loglik5", "strict"))
    return P.build_prompts(it, "loglik5").select("item_id", "subset", "prompt_lang", "prompt")


@register("build_prompts_gen4", with_ctes({**ITEMS_CTES, "t": TPL_GEN4_SQL}, f"""
SELECT pl.item_id, pl.subset, t2.lang AS prompt_lang,
       t2.q_label || question || {_LINES} || {NL} || t2.instruction || {NL} || t2.a_label AS prompt
FROM pl LEFT JOIN t ON t.lang = pl.prompt_lang JOIN t t2 ON t2.lang = coalesce(t.lang, 'en')"""))
def q_build_prompts_gen4(spark, sf_dir):
    it = P.pick_question(P.parse_subset(_items(spark, sf_dir), "gen4", "lenient"))
    return P.build_prompts(it, "gen4").select("item_id", "subset", "prompt_lang", "prompt")


def _wrapped_sql(letters: str, five: bool) -> str:
    more = f" || {NL} || 'E. ' || t2.idk_option" if five else ""
    jais = lambda text: f"replace({q_(text)}, '{{Question}}', question || {_LINES}{more} || {NL} || 'Answer with only the letter {letters}.')"
    body = f"t2.q_label || question || {_LINES}{more} || {NL} || t2.instruction"
    return f"""
SELECT m.model, pl.item_id, pl.subset,
       CASE WHEN m.model = '{WRAPPED[1]}' THEN CASE WHEN t2.lang = 'ar' THEN {jais(D.JAIS_PROMPT_AR)} ELSE {jais(D.JAIS_PROMPT_EN)} END
            WHEN m.model = '{WRAPPED[2]}' THEN '<User>: ' || {body} || ' <Assistant>: '
            ELSE {body} || {NL} || t2.a_label END AS prompt
FROM pl LEFT JOIN t ON t.lang = pl.prompt_lang JOIN t t2 ON t2.lang = coalesce(t.lang, 'en')
CROSS JOIN (SELECT unnest([{", ".join(q_(m) for m in WRAPPED)}]) AS model) m"""


def _wrapped(spark, sf_dir, style):
    it = P.pick_question(P.parse_subset(_items(spark, sf_dir), style, "lenient"))
    runs = it.withColumn("model", F.explode(literal_array(WRAPPED)))
    return P.build_prompts(runs, style).select("model", "item_id", "subset", "prompt")


@register("build_prompts_wrapped4", with_ctes({**ITEMS_CTES, "t": TPL_GEN4_SQL}, _wrapped_sql("(A, B, C, or D)", False)))
def q_build_prompts_wrapped4(spark, sf_dir):
    return _wrapped(spark, sf_dir, "gen4")


@register("build_prompts_wrapped5", with_ctes({**ITEMS_CTES, "t": TPL_GEN5_SQL}, _wrapped_sql("(A, B, C, D, or E)", True)))
def q_build_prompts_wrapped5(spark, sf_dir):
    return _wrapped(spark, sf_dir, "gen5")


@register("cross_model_prompts", with_ctes({**ITEMS_CTES, "t": TPL4_SQL, "rp": B.RUN_PLAN_SQL}, f"""
SELECT rp.model, pl.subset, pl.item_id, {_loglik4_prompt_sql(False)} AS prompt, pl.answer AS gold
FROM rp JOIN pl ON pl.subset = rp.subset JOIN t ON t.lang = pl.prompt_lang"""))
def q_cross_model_prompts(spark, sf_dir):
    out = P.build_prompt_table(_items(spark, sf_dir), B.run_plan(spark, sf_dir), "loglik4")
    return out.select("model", "subset", "item_id", "prompt", F.col("answer").alias("gold"))


@register("limit_per_subset", with_ctes(ITEMS_CTES, """
SELECT item_id, subset FROM (
  SELECT item_id, subset, row_number() OVER (PARTITION BY subset ORDER BY item_id) AS rn FROM pi) x
WHERE rn <= 2"""))
def q_limit_per_subset(spark, sf_dir):
    it = _items(spark, sf_dir).withColumnRenamed("item_id", "item_index")
    return P.limit_per_subset(it, 2).select(F.col("item_index").alias("item_id"), "subset")


_KW = " OR ".join(f"contains(lower(name), {q_(k)})" for k in D.INSTRUCT_KEYWORDS)
# part names with the endings of model names, by part key
_ENDINGS = ["-Instruct", "-7B-Chat", "-it", "-base", "-v1.5"]
_NAMED = "(SELECT p_partkey, p_name || [" + ", ".join(q_(e) for e in _ENDINGS) + "][p_partkey % 5 + 1] AS name FROM part)"


@register("flag_instruct", f"""
SELECT p_partkey, name, ({_KW}) OR name IN ({', '.join(q_(m) for m in D.INSTRUCT_MODEL_OVERRIDES)}) AS is_instruct
FROM {_NAMED} p""")
def q_flag_instruct(spark, sf_dir):
    p = table(spark, sf_dir, "part", "p_partkey", "p_name")
    named = p.select("p_partkey", F.concat("p_name", F.element_at(literal_array(_ENDINGS), (F.col("p_partkey") % 5 + 1).cast("int"))).alias("name"))
    return named.select("p_partkey", "name", P.flag_instruct("name").alias("is_instruct"))


@register("normalize_gold", f"""
SELECT item_id, upper(replace(regexp_replace(chr(160) || chr(12288) || ' ' || text || chr(10) || chr(8195),
                                     '^[\\s\\x{{A0}}\\x{{2003}}\\x{{3000}}]+|[\\s\\x{{A0}}\\x{{2003}}\\x{{3000}}]+$', '', 'g'),
                              'ß', 'SS')) AS gold  -- full case mapping as in Python / the JVM
FROM benchmark""")
def q_normalize_gold(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark", "item_id", "text")
    raw = F.concat(F.lit("\u00a0\u3000 "), F.col("text"), F.lit("\n\u2003"))
    return b.select("item_id", normalize_gold(raw).alias("gold"))


@register("assemble_responses", with_ctes({"r": B.RESPONSES_SQL}, """
SELECT r.model, r.subset, r.item, p.p_name, p.p_brand, p.p_type, r.pred, r.gold,
       r.pred = r.gold AS correct, r.pred = 'E' AS abstained
FROM r JOIN part p ON p.p_partkey = r.item"""))
def q_assemble_responses(spark, sf_dir):
    sc = scored_responses(spark, sf_dir)
    items = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type")
    return sc.join(items, sc.item == items.p_partkey).select(
        "model", "subset", "item", "p_name", "p_brand", "p_type", "pred", "gold", "correct", "abstained")
