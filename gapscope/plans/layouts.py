"""Source-layout, code-switched and five-option queries.

Source tables in each layout are made from ``documents`` by integer rules, so that every
filter of a layout keeps some rows and drops some.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gapscope.dims import literal_array
from gapscope.operators import build as Bd
from gapscope.operators import logprobs as L
from gapscope.operators import prompts as P
from gapscope.operators.metrics import subset_metrics
from gapscope.operators.scoring import score_choice
from gapscope.plans.logits import LP_CTES
from gapscope.plans.registry import register, with_ctes
from gapscope.sources import bindings as B
from gapscope.sources.tables import table

OUT = ["doc_id", "question", "option_a", "option_b", "option_c", "option_d", "answer", "config"]


def _docs(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "doc_id", "source")
    return d.withColumns({"split": F.when(F.col("doc_id") % 5 == 0, "dev").otherwise("test"),
                          "n": F.col("doc_id").cast("string")})


def _text(prefix: str):
    return F.concat(F.lit(prefix), F.col("n"))


def _choose(values: list[str], by: int):
    return F.element_at(literal_array(values), (F.col("doc_id") % by + 1).cast("int"))


def _list_sql(values: list[str], by: int) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][doc_id % {by} + 1]"


@register("normalize_source_ar", """
SELECT doc_id, 'q' || doc_id AS question, 'a' || doc_id AS option_a, 'b' || doc_id AS option_b, 'c' || doc_id AS option_c,
       'd' || doc_id AS option_d, substr('ABCD', CAST(doc_id % 4 + 1 AS INTEGER), 1) AS answer, source AS config, 'l' || doc_id AS "Level"
FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND doc_id % 6 <> 0""")
def q_normalize_source_ar(spark, sf_dir):
    d = _docs(spark, sf_dir)
    src = d.select("doc_id", "split", F.col("source").alias("config"), _text("q").alias("Question"), _text("a").alias("Option 1"),
                   F.when(F.col("doc_id") % 7 != 0, _text("b")).alias("Option 2"), _text("c").alias("Option 3"), _text("d").alias("Option 4"),
                   F.when(F.col("doc_id") % 6 == 0, _text("e")).alias("Option 5"),
                   F.substring(F.lit("ABCD"), (F.col("doc_id") % 4 + 1).cast("int"), F.lit(1)).alias("Answer Key"), _text("l").alias("Level"))
    return Bd.normalize_source(src, "ar").select(*OUT, "Level")


_DOMAINS = [*Bd.HINDI_DOMAINS, "Mathematics"]


@register("normalize_source_hi", f"""
SELECT doc_id, 'q' || doc_id AS question, 'a' || doc_id AS option_a, 'b' || doc_id AS option_b, 'c' || doc_id AS option_c,
       'd' || doc_id AS option_d, substr('ABCD', CAST(doc_id % 4 + 1 AS INTEGER), 1) AS answer, {_list_sql(_DOMAINS, 5)} AS config
FROM documents WHERE doc_id % 5 NOT IN (0, 4) AND doc_id % 3 <> 0""")
def q_normalize_source_hi(spark, sf_dir):
    src = _docs(spark, sf_dir).select("doc_id", "split", _text("q").alias("question"), *[_text(c).alias(f"option{i}") for i, c in enumerate("abcd", 1)],
                                      F.concat(F.lit("option"), (F.col("doc_id") % 4 + 1).cast("string")).alias("target"),
                                      _choose(_DOMAINS, 5).alias("domain"), (F.col("doc_id") % 3 == 0).alias("is_translated"))
    return Bd.normalize_source(src, "hi").select(OUT)


_SUBJECTS = [*Bd.INDONESIAN_SUBJECTS, "Physics"]


@register("normalize_source_id", f"""
SELECT doc_id, 'q' || doc_id AS question, 'it''s ' || doc_id AS option_a, 'say "' || doc_id || '"' AS option_b,
       'x' || chr(160) || 'y' || doc_id AS option_c, 'both '' and "' AS option_d, 'A' AS answer, {_list_sql(_SUBJECTS, 12)} AS config
FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 12 <> 11 AND doc_id % 7 <> 0""")
def q_normalize_source_id(spark, sf_dir):
    whole = F.concat(F.lit('["A. it\'s '), F.col("n"), F.lit("\", 'B. say \""), F.col("n"), F.lit("\"', 'C. x\\xa0y"), F.col("n"), F.lit("', 'D. both \\' and \"']"))
    src = _docs(spark, sf_dir).select("doc_id", "split", _text("q").alias("question"), F.lit("A").alias("answer"),
                                      F.when(F.col("doc_id") % 7 != 0, whole).otherwise("['A. one', 'B. two']").alias("options"),
                                      _choose(_SUBJECTS, 12).alias("subject"))
    return Bd.normalize_source(src, "id").select(OUT)


@register("normalize_source_it", """
SELECT doc_id, 'q' || doc_id AS question FROM documents WHERE doc_id % 3 <> 2""")
def q_normalize_source_it(spark, sf_dir):
    src = _docs(spark, sf_dir).select("doc_id", _text("q").alias("question"), _choose(["Culture and Commonsense", " CULTURE AND COMMONSENSE　", "science"], 3).alias("macro_category"))
    return Bd.normalize_source(src, "it").select("doc_id", "question")


@register("normalize_source_zh", """
SELECT doc_id, 'q' || doc_id AS question, 'a' || doc_id AS option_a, 'b' || doc_id AS option_b, 'c' || doc_id AS option_c,
       'd' || doc_id AS option_d, 'B' AS answer, source AS config FROM documents WHERE doc_id % 5 <> 0""")
def q_normalize_source_zh(spark, sf_dir):
    src = _docs(spark, sf_dir).select("doc_id", "split", F.col("source").alias("config"), _text("q").alias("Question"),
                                      *[_text(c.lower()).alias(c) for c in "ABCD"], F.lit("B").alias("Answer"))
    return Bd.normalize_source(src, "zh").select(OUT)


@register("pick_question", """
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'greek_cs_mix' WHEN 1 THEN 'greek_en_mix' ELSE 'greek_cs' END AS subset,
       CASE doc_id % 3 WHEN 1 THEN 'en' ELSE 'el' END AS prompt_lang,
       CASE doc_id % 3 WHEN 0 THEN 'mixed ' WHEN 1 THEN 'english ' ELSE 'plain ' END || doc_id AS question_text FROM documents""")
def q_pick_question(spark, sf_dir):
    src = _docs(spark, sf_dir).select("doc_id", _choose(["greek_cs_mix", "greek_en_mix", "greek_cs"], 3).alias("subset"), _text("plain ").alias("question"),
                                      _text("mixed ").alias("question_cs_mix"), _text("english ").alias("question_en_mix"))
    return P.pick_question(P.parse_subset(src, "loglik4", "strict")).select("doc_id", "subset", "prompt_lang", "question_text")


# ---------------------------------------------------------------------------
# Five options: even models know " A".." E" as single tokens 10-14, odd ones only "A".."E" as 20-24
# ---------------------------------------------------------------------------

FIVE = list("ABCDE")


def _five_tokens(spark, sf_dir):
    models = B.logits(spark, sf_dir).select("model").distinct()
    even = F.substring("model", 2, 9).cast("int") % 2 == 0
    spaced = lambda i: F.when(even, F.array(F.lit(10 + i))).otherwise(F.array(F.lit(8), F.lit(20 + i)))
    enc = F.array(*[F.struct(F.lit(" ").alias("prefix"), F.lit(c).alias("letter"), spaced(i).alias("token_ids")) for i, c in enumerate(FIVE)],
                  *[F.struct(F.lit("").alias("prefix"), F.lit(c).alias("letter"), F.array(F.lit(20 + i)).alias("token_ids")) for i, c in enumerate(FIVE)])
    return models.select("model", F.inline(enc))


def _scored_five(spark, sf_dir):
    return L.score_logprobs(B.logits(spark, sf_dir), L.resolve_variants(_five_tokens(spark, sf_dir), "first", FIVE))


FIVE_CTES = {**LP_CTES, "f5": """
SELECT model, subset, pos, gold, substr('ABCDE', CAST(token_id - base + 1 AS INTEGER), 1) AS pred, CASE WHEN base = 10 THEN ' ' ELSE '' END AS argmax_prefix
FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY x DESC, token_id) AS r
      FROM (SELECT *, CASE WHEN CAST(substr(model, 2) AS INTEGER) % 2 = 0 THEN 10 ELSE 20 END AS base FROM t3) b
      WHERE token_id BETWEEN base AND base + 4) z WHERE r = 1"""}


@register("resolve_variants_five", """
SELECT 'E' || CAST(label AS VARCHAR) AS model, CASE WHEN label % 2 = 0 THEN ' ' ELSE '' END AS prefix,
       substr('ABCDE', CAST(i + 1 AS INTEGER), 1) AS letter, CAST(CASE WHEN label % 2 = 0 THEN 10 ELSE 20 END + i AS INTEGER) AS token_id
FROM (SELECT DISTINCT label FROM embeddings) m, range(5) r(i)""")
def q_resolve_variants_five(spark, sf_dir):
    return L.resolve_variants(_five_tokens(spark, sf_dir), "first", FIVE).select("model", "prefix", "letter", "token_id")


@register("argmax_option_five", with_ctes(FIVE_CTES, "SELECT model, subset, pos, gold, argmax_prefix, pred FROM f5"))
def q_argmax_option_five(spark, sf_dir):
    return _scored_five(spark, sf_dir).select("model", "subset", "pos", "gold", "argmax_prefix", "pred")


@register("subset_metrics_five", with_ctes(FIVE_CTES, """
SELECT model, subset, count(*) FILTER (WHERE pred = gold) / count(*) AS accuracy, count(*) FILTER (WHERE pred = 'E') / count(*) AS abstain_rate,
       count(*) FILTER (WHERE pred <> gold AND pred <> 'E') / count(*) AS conf_err_rate,
       CASE WHEN count(*) FILTER (WHERE pred <> 'E') = 0 THEN 0.0
            ELSE count(*) FILTER (WHERE pred = gold) / count(*) FILTER (WHERE pred <> 'E') END AS cond_acc
FROM f5 GROUP BY model, subset"""))
def q_subset_metrics_five(spark, sf_dir):
    scored = score_choice(_scored_five(spark, sf_dir))
    return subset_metrics(scored).select("model", "subset", "accuracy", "abstain_rate", "conf_err_rate", "cond_acc")


@register("prefix_histogram_five", """
SELECT CASE WHEN label % 2 = 0 THEN ' ' ELSE '' END AS prefix, count(DISTINCT label) AS n_models FROM embeddings GROUP BY 1""")
def q_prefix_histogram_five(spark, sf_dir):
    used = L.resolve_variants(_five_tokens(spark, sf_dir), "first", FIVE).select("model", "prefix").distinct()
    return L.prefix_histogram(used)
