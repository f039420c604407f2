"""Generated-text scoring queries: choice extraction, short answers, QA cells and DiD."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapscope.operators import shortqa as Q
from gapscope.operators.prompts import qa_prompt
from gapscope.plans.registry import register, with_ctes
from gapscope.sources import bindings as B
from gapscope.sources.tables import table


def q_(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


WS, NW = Q.WS, Q.NOT_WORD
TRIM = Q._cls(Q.TRIM_CHARS)


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, {q_(f'^{WS}+|{WS}+$')}, '', 'g')"


def norm_sql(x: str) -> str:
    s = strip_sql(x)
    s = f"regexp_replace({s}, {q_(f'^{TRIM}+|{TRIM}+$')}, '', 'g')"
    return f"regexp_replace({s}, {q_(f'{WS}+')}, ' ', 'g')"


def short_answer_sql(x: str) -> str:
    g = strip_sql(x)
    g = strip_sql(f"regexp_replace({g}, {q_(f'(?i)^(assistant|answer){WS}*[:：]{WS}*')}, '')")
    first = strip_sql(f"regexp_extract({g}, {q_('^[^' + Q.LINE_BREAK[1:-1] + ']*')}, 0)")
    first = strip_sql(f"regexp_extract({first}, {q_('^[^' + Q.SENTENCE_END + ']*')}, 0)")
    return norm_sql(first)


def idk_sql(x: str) -> str:
    a = strip_sql(x)
    en = Q.IDK_EN.replace(r"\s", WS)
    return (f"({a} = '' OR regexp_matches({a}, {q_(f'(?i)(?:^|{NW})(?:{en})(?:$|{NW})')})"
            f" OR regexp_matches({a}, {q_(Q.IDK_ZH)}) OR lower({a}) IN ('idk', 'unknown'))")


def match_sql(ans: str, golds: str, atype: str) -> str:
    a = f"lower({norm_sql(ans)})"
    g = f"lower({norm_sql('g')})"
    hit = f"len(list_filter({golds}, lambda g: {g} <> '' AND (contains({a}, {g}) OR contains({g}, {a})))) > 0"
    pair = (f"((contains({a}, 'china') AND contains({a}, 'nepal')) OR "
            f"(contains({ans}, '中国') AND contains({ans}, '尼泊尔')))")
    return f"coalesce(({hit}) OR (coalesce({atype}, 'entity') = 'pair' AND {pair}), false)"


GEN = {"gen": B.GENERATIONS_SQL}
SCORED_SQL = {**GEN, "sa": f"SELECT *, {short_answer_sql('generation')} AS answer_extracted FROM gen",
              "sc": f"""SELECT *, {match_sql('answer_extracted', 'answers', 'answer_type')} AS correct,
                               {idk_sql('answer_extracted')} AS is_idk FROM sa""",
              "scored": "SELECT *, NOT correct AND NOT is_idk AS hallucination_like FROM sc"}
CELLS_SQL = {**SCORED_SQL, "cells": """
SELECT model, category, lang, count(*) AS n, count(*) FILTER (WHERE correct) / count(*) AS accuracy,
       count(*) FILTER (WHERE hallucination_like) / count(*) AS hallucination_like_rate,
       category || '__' || lang AS cell
FROM scored GROUP BY model, category, lang"""}


def _scored(spark, sf_dir):
    return Q.score_short_answers(B.generations(spark, sf_dir))


@register("extract_choice", f"""
SELECT conv_id, turn, CASE WHEN regexp_extract(t, {q_(f'(?:^|{NW})([ABCDE])(?:$|{NW})')}, 1) <> ''
                           THEN regexp_extract(t, {q_(f'(?:^|{NW})([ABCDE])(?:$|{NW})')}, 1)
                           WHEN substr(t, 1, 1) IN ('A', 'B', 'C', 'D', 'E') THEN substr(t, 1, 1) ELSE '' END AS choice
FROM (SELECT conv_id, turn, {strip_sql('text')} AS t FROM conversations WHERE role = 'assistant') c""")
def q_extract_choice(spark, sf_dir):
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return c.where(F.col("role") == "assistant").select("conv_id", "turn", Q.extract_choice("text").alias("choice"))


@register("short_answer", with_ctes(SCORED_SQL, "SELECT id, answer_extracted FROM sa"))
def q_short_answer(spark, sf_dir):
    return B.generations(spark, sf_dir).select("id", Q.short_answer("generation").alias("answer_extracted"))


@register("is_abstention", with_ctes(SCORED_SQL, "SELECT id, answer_extracted, is_idk FROM sc"))
def q_is_abstention(spark, sf_dir):
    return _scored(spark, sf_dir).select("id", "answer_extracted", "is_idk")


@register("match_any", with_ctes(SCORED_SQL, "SELECT id, answer_type, correct FROM sc"))
def q_match_any(spark, sf_dir):
    return _scored(spark, sf_dir).select("id", "answer_type", "correct")


@register("hallucination_like", with_ctes(SCORED_SQL, """
SELECT id, model, category, lang, correct, is_idk, hallucination_like FROM scored"""))
def q_hallucination_like(spark, sf_dir):
    return _scored(spark, sf_dir).select("id", "model", "category", "lang", "correct", "is_idk",
                                         "hallucination_like")


@register("qa_cells", with_ctes(CELLS_SQL, "SELECT * FROM cells"))
def q_qa_cells(spark, sf_dir):
    return Q.qa_cells(_scored(spark, sf_dir))


def _cell_sql(c, m):
    return f"coalesce(max(CASE WHEN cell = '{c}' THEN {m} END), CAST(0 AS DOUBLE))"


@register("qa_did", with_ctes(CELLS_SQL, "SELECT model, " + ", ".join(
    f"({_cell_sql('global__en', m)} - {_cell_sql('global__zh', m)}) - "
    f"({_cell_sql('local_cn__en', m)} - {_cell_sql('local_cn__zh', m)}) AS did_{m}"
    for m in ("accuracy", "hallucination_like_rate"))
    + ", array_to_string(list_sort(list(DISTINCT cell)), ',') AS cells_present FROM cells GROUP BY model"))
def q_qa_did(spark, sf_dir):
    return Q.qa_did(Q.qa_cells(_scored(spark, sf_dir)))


@register("qa_prompt", """
SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0
    THEN '请用简短短语回答。如果不确定，请回答“不知道”，不要猜测。' || chr(10) || '问题：' || text || chr(10) || '答案：'
    ELSE 'Answer with a short phrase. If you are not sure, say "I don''t know." Do not guess.' || chr(10)
         || 'Question: ' || text || chr(10) || 'Answer:' END AS prompt
FROM conversations WHERE role = 'user'""")
def q_qa_prompt(spark, sf_dir):
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").where(F.col("role") == "user")
    lang = F.when(F.col("conv_id") % 2 == 0, "zh").otherwise("en")
    return c.select("conv_id", "turn", qa_prompt(lang, F.col("text")).alias("prompt"))
