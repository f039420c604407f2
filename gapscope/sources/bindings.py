"""Bindings: the driver's TPC-H-ish tables as the study's canonical tables.

Each binding is pure integer/string arithmetic on the source columns, so the
same rows can be produced in SQL; the ``*_SQL`` constants are the DuckDB twins
used by the oracle queries (one CTE body each).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapscope.dims import literal_array
from gapscope.sources.tables import table


# Fixed values of the bindings (FIXTURES.md part B).
BIND_LOCALES = ["english", "chinese", "arabic", "greek", "hindi", "indonesian", "korean"]
BIND_COUNTRIES = ["USA", "China", "UAE", "Greece", "India", "Southeast Asian",
                  "South Korea", "France", "Multilingual"]
BIND_KIND_BY_FLAG = {"A": "ca", "N": "cs", "R": "cs_en"}


def _case_sql(expr: str, values: list[str], base: int = 0) -> str:
    parts = " ".join(f"WHEN {i + base} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {expr} {parts} END"


# ---------------------------------------------------------------------------
# responses: one scored-choice row per lineitem row
# ---------------------------------------------------------------------------

def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, subset, locale, kind, item, gold, pred, batch, pos) from lineitem.

    ``pos`` = (l_orderkey, l_linenumber) packed into one long: a stable
    first-appearance order for operators that need one.
    """
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey",
               "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus")
    locale = F.try_element_at(literal_array(BIND_LOCALES), F.col("l_linenumber"))
    kind = (F.when(F.col("l_returnflag") == "A", "ca")
            .when(F.col("l_returnflag") == "N", "cs")
            .when(F.col("l_returnflag") == "R", "cs_en"))
    df = li.select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("model"),
        locale.alias("locale"), kind.alias("kind"),
        F.col("l_partkey").alias("item"),
        F.substring(F.lit("ABCD"), (F.col("l_partkey") % 4 + 1).cast("int"), 1).alias("gold"),
        F.substring(F.lit("ABCDE"), (F.col("l_quantity").cast("bigint") % 5 + 1).cast("int"), 1)
         .alias("pred"),
        F.when(F.col("l_linestatus") == "F", "base").otherwise("overlay").alias("batch"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"),
    )
    df = df.where(F.col("locale").isNotNull() & F.col("kind").isNotNull()
                  & ((F.col("locale") != "english") | (F.col("kind") == "ca")))
    return df.withColumn("subset", F.concat_ws("_", "locale", "kind"))


RESPONSES_SQL = f"""
SELECT * , locale || '_' || kind AS subset FROM (
  SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS model,
         {_case_sql('l_linenumber', BIND_LOCALES, 1)} AS locale,
         CASE l_returnflag WHEN 'A' THEN 'ca' WHEN 'N' THEN 'cs' WHEN 'R' THEN 'cs_en' END AS kind,
         l_partkey AS item,
         substr('ABCD', CAST(l_partkey % 4 + 1 AS INTEGER), 1) AS gold,
         substr('ABCDE', CAST(CAST(l_quantity AS BIGINT) % 5 + 1 AS INTEGER), 1) AS pred,
         CASE WHEN l_linestatus = 'F' THEN 'base' ELSE 'overlay' END AS batch,
         l_orderkey * 8 + l_linenumber AS pos
  FROM lineitem) r
WHERE locale IS NOT NULL AND kind IS NOT NULL AND (locale <> 'english' OR kind = 'ca')
"""


def dim_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, country): supplier's nation key -> country of origin.

    ``s_nationkey`` is the nation's key, so the nation table is not joined:
    a plain projection of supplier keeps Catalyst's size estimate small (an
    inner join's estimate is the product of both sides and would block the
    broadcast of this dimension).
    """
    sup = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    country = F.element_at(literal_array(BIND_COUNTRIES), (F.col("s_nationkey") % 9 + 1).cast("int"))
    return sup.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("model"),
                      country.alias("country"))


DIM_MODEL_SQL = f"""
SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS model,
       {_case_sql('n_nationkey % 9', BIND_COUNTRIES)} AS country
FROM supplier JOIN nation ON s_nationkey = n_nationkey
"""


# ---------------------------------------------------------------------------
# logits: one response per embeddings row, the 64 floats are the logits
# ---------------------------------------------------------------------------

BIND_LOGIT_SUBSETS = ["chinese_ca", "chinese_cs", "chinese_cs_en"]


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, subset, pos, gold, logits array<float>) from embeddings."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    return e.select(
        F.concat(F.lit("E"), F.col("label").cast("string")).alias("model"),
        F.element_at(literal_array(BIND_LOGIT_SUBSETS), (F.col("vec_id") % 3 + 1).cast("int")).alias("subset"),
        F.col("vec_id").alias("pos"),
        F.substring(F.lit("ABCD"), (F.col("vec_id") % 4 + 1).cast("int"), 1).alias("gold"),
        F.col("embedding").alias("logits"))


LOGITS_SQL = """
SELECT 'E' || CAST(label AS VARCHAR) AS model,
       CASE vec_id % 3 WHEN 0 THEN 'chinese_ca' WHEN 1 THEN 'chinese_cs' ELSE 'chinese_cs_en' END AS subset,
       vec_id AS pos, substr('ABCD', CAST(vec_id % 4 + 1 AS INTEGER), 1) AS gold, embedding AS logits
FROM embeddings
"""


def letter_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, prefix, letter, token_ids): encodings of prefix+letter per model.

    Vocabulary rule of the binding: ids 0-3 are " A".." D", ids 4-7 are
    "A".."D"; "\\n"+letter encodes to two tokens (newline id 8, then the letter),
    so that prefix never works.
    """
    models = logits(spark, sf_dir).select("model").distinct()
    enc = F.array(
        *[F.struct(F.lit(" ").alias("prefix"), F.lit(L).alias("letter"), F.array(F.lit(i)).alias("token_ids"))
          for i, L in enumerate("ABCD")],
        *[F.struct(F.lit("").alias("prefix"), F.lit(L).alias("letter"), F.array(F.lit(4 + i)).alias("token_ids"))
          for i, L in enumerate("ABCD")],
        *[F.struct(F.lit("\n").alias("prefix"), F.lit(L).alias("letter"),
                   F.array(F.lit(8), F.lit(4 + i)).alias("token_ids")) for i, L in enumerate("ABCD")])
    return models.select("model", F.inline(enc))


# ---------------------------------------------------------------------------
# items (documents + labels), label replies (events)
# ---------------------------------------------------------------------------

def items(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """(pos, config, split, strat, question, claude_cs [, extra document columns]).

    config = lang, strat = source, position = doc_id, question = text,
    claude_cs = labels.quality (null for unlabelled documents).
    """
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source", *extra)
    lab = table(spark, sf_dir, "labels", "doc_id", "quality")
    return docs.join(lab, "doc_id", "left").select(
        F.col("doc_id").alias("pos"), F.col("lang").alias("config"), F.lit("test").alias("split"),
        F.col("source").alias("strat"), F.col("text").alias("question"),
        F.col("quality").alias("claude_cs"), *extra)


ITEMS_SQL = """
SELECT d.doc_id AS pos, d.lang AS config, 'test' AS split, d.source AS strat, d.text AS question,
       l.quality AS claude_cs
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
"""


def label_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, config, expected, reply): JSON label replies, some fenced, some junk."""
    ev = table(spark, sf_dir, "events", "event_id", "event_type", "props")
    n = (F.get_json_object("props", "$.k").cast("int") % 2)
    body = F.concat(F.lit('{"culturally_dependent": '), n.cast("string"), F.lit("}"))
    reply = (F.when(F.col("event_id") % 17 == 0, F.lit("oops"))
             .when(F.col("event_id") % 5 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
             .otherwise(body))
    return ev.select(F.col("event_id").alias("pos"), F.col("event_type").alias("config"),
                     n.alias("expected"), reply.alias("reply"))


LABEL_REPLIES_SQL = """
SELECT event_id AS pos, event_type AS config, CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 AS expected,
       CASE WHEN event_id % 17 = 0 THEN 'oops'
            WHEN event_id % 5 = 0 THEN '```json' || chr(10) || '{"culturally_dependent": '
                 || CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 AS VARCHAR) || '}' || chr(10) || '```'
            ELSE '{"culturally_dependent": ' || CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 AS VARCHAR)
                 || '}' END AS reply
FROM events
"""


# ---------------------------------------------------------------------------
# generations (conversations), prompt items (benchmark), run plan (lineitem)
# ---------------------------------------------------------------------------

def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short-answer responses: assistant turns of conversations.

    (id, model, category, lang, question, generation, answers, answer_type)
    """
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    a = c.where(F.col("role") == "assistant")
    answers = F.when(F.col("conv_id") % 3 == 0, F.array(F.substring("text", 1, 3))).otherwise(
        F.array(F.lit("zzz")))
    atype = F.when(F.col("conv_id") % 7 == 0, "pair").when(F.col("conv_id") % 7 == 1, "set_any")
    return a.select(
        F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.concat(F.lit("M"), (F.col("turn") % 2).cast("string")).alias("model"),
        F.when(F.floor(F.col("conv_id") / 2) % 2 == 0, "global").otherwise("local_cn").alias("category"),
        F.when(F.col("conv_id") % 2 == 0, "zh").otherwise("en").alias("lang"),
        F.col("text").alias("generation"), answers.alias("answers"),
        F.coalesce(atype, F.lit("entity")).alias("answer_type"))


GENERATIONS_SQL = """
SELECT CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS id,
       'M' || CAST(turn % 2 AS VARCHAR) AS model,
       CASE WHEN (conv_id // 2) % 2 = 0 THEN 'global' ELSE 'local_cn' END AS category,
       CASE WHEN conv_id % 2 = 0 THEN 'zh' ELSE 'en' END AS lang,
       text AS generation,
       CASE WHEN conv_id % 3 = 0 THEN [substr(text, 1, 3)] ELSE ['zzz'] END AS answers,
       coalesce(CASE WHEN conv_id % 7 = 0 THEN 'pair' WHEN conv_id % 7 = 1 THEN 'set_any' END, 'entity')
         AS answer_type
FROM conversations WHERE role = 'assistant'
"""


def prompt_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, subset, question, option_a..d, answer) from benchmark."""
    b = table(spark, sf_dir, "benchmark", "item_id", "text")
    locale = F.element_at(literal_array(BIND_LOCALES), (F.col("item_id") % 7 + 1).cast("int"))
    kind = F.when(locale == "english", F.lit("ca")).otherwise(
        F.element_at(literal_array(["ca", "cs", "cs_en"]), (F.col("item_id") % 3 + 1).cast("int")))
    opts = [F.substring("text", 8 * n + 1, 8).alias(c) for n, c in
            enumerate(["option_a", "option_b", "option_c", "option_d"], 1)]
    return b.select("item_id", F.concat_ws("_", locale, kind).alias("subset"), F.col("text").alias("question"),
                    *opts, F.substring(F.lit("ABCD"), (F.col("item_id") % 4 + 1).cast("int"), 1).alias("answer"))


PROMPT_ITEMS_SQL = f"""
SELECT item_id, locale || '_' || kind AS subset, question, option_a, option_b, option_c, option_d, answer FROM (
  SELECT item_id, {_case_sql('item_id % 7', BIND_LOCALES)} AS locale,
         CASE WHEN item_id % 7 = 0 THEN 'ca' ELSE CASE item_id % 3 WHEN 0 THEN 'ca' WHEN 1 THEN 'cs' ELSE 'cs_en' END END
           AS kind,
         text AS question, substr(text, 9, 8) AS option_a, substr(text, 17, 8) AS option_b,
         substr(text, 25, 8) AS option_c, substr(text, 33, 8) AS option_d,
         substr('ABCD', CAST(item_id % 4 + 1 AS INTEGER), 1) AS answer
  FROM benchmark) b
"""


def run_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, subset): which model was run on which subset (from responses)."""
    return responses(spark, sf_dir).select("model", "subset").distinct()


RUN_PLAN_SQL = "SELECT DISTINCT model, subset FROM (" + RESPONSES_SQL + ") rr"


# ---------------------------------------------------------------------------
# IRT responses: every supplier is a model; a subset's benchmark has an item for every 50 parts, 40 at least
# ---------------------------------------------------------------------------

def irt_scored(spark: SparkSession, sf_dir: str, parts_per_item: int = 50) -> DataFrame:
    """(model, subset, item, correct): one row per (model, subset, item), taken
    from the lineitem row with the smallest (l_orderkey, l_partkey, l_quantity)
    (a ``min_by`` aggregate: partial on the map side, no window)."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
               "l_quantity", "l_returnflag")
    items = max(40, table(spark, sf_dir, "part", "p_partkey").count() // parts_per_item)
    locale = F.try_element_at(literal_array(BIND_LOCALES), F.col("l_linenumber"))
    kind = (F.when(F.col("l_returnflag") == "A", "ca").when(F.col("l_returnflag") == "N", "cs")
            .when(F.col("l_returnflag") == "R", "cs_en"))
    gold = F.substring(F.lit("ABCD"), (F.col("l_partkey") % 4 + 1).cast("int"), 1)
    pred = F.substring(F.lit("ABCDE"), (F.col("l_quantity").cast("bigint") % 5 + 1).cast("int"), 1)
    df = li.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("model"),
                   locale.alias("locale"), kind.alias("kind"), (F.col("l_partkey") % items).alias("item"),
                   (pred == gold).alias("correct"), "l_orderkey", "l_partkey", "l_quantity")
    df = df.where(F.col("locale").isNotNull() & F.col("kind").isNotNull()
                  & ((F.col("locale") != "english") | (F.col("kind") == "ca")))
    df = df.withColumn("subset", F.concat_ws("_", "locale", "kind"))
    return df.groupBy("model", "subset", "item").agg(
        F.min_by("correct", F.struct("l_orderkey", "l_partkey", "l_quantity")).alias("correct"))


def irt_scored_sql(parts_per_item: int = 50) -> str:
    return f"""
SELECT model, subset, item, correct FROM (
  SELECT *, row_number() OVER (PARTITION BY model, subset, item ORDER BY l_orderkey, l_partkey, l_quantity) AS rn
  FROM (
    SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS model,
           {_case_sql('l_linenumber', BIND_LOCALES, 1)} || '_' ||
           CASE l_returnflag WHEN 'A' THEN 'ca' WHEN 'N' THEN 'cs' WHEN 'R' THEN 'cs_en' END AS subset,
           {_case_sql('l_linenumber', BIND_LOCALES, 1)} AS locale, l_returnflag,
           l_partkey % greatest(40, (SELECT count(*) FROM part) // {parts_per_item}) AS item,
           substr('ABCDE', CAST(CAST(l_quantity AS BIGINT) % 5 + 1 AS INTEGER), 1)
             = substr('ABCD', CAST(l_partkey % 4 + 1 AS INTEGER), 1) AS correct,
           l_orderkey, l_partkey, l_quantity
    FROM lineitem) x
  WHERE locale IS NOT NULL AND subset IS NOT NULL AND (locale <> 'english' OR l_returnflag = 'A')) y
WHERE rn = 1
"""


IRT_SCORED_SQL = irt_scored_sql()
