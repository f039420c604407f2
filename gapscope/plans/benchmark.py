"""Benchmark-construction queries over documents / labels / events."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapscope.operators import build as Bd
from gapscope.operators.joins import union_all
from gapscope.plans.registry import register, with_ctes
from gapscope.sources import bindings as B
from gapscope.sources.tables import table

ITEMS = {"it": B.ITEMS_SQL}
REPLIES = {"rp": B.LABEL_REPLIES_SQL}

# DuckDB twin of parse_labels (JSON truthiness of the key; failures -> 0)
PARSE_SQL = r"""
, t0 AS (SELECT *, regexp_replace(reply, '^\s+|\s+$', '', 'g') AS t FROM rp)
, t1 AS (SELECT *, CASE WHEN contains(t, '```') AND regexp_extract(t, '(?s)\{.*?\}', 0) <> ''
                        THEN regexp_extract(t, '(?s)\{.*?\}', 0) ELSE t END AS j FROM t0)
, t2 AS (SELECT *, CASE WHEN json_valid(j) THEN json_type(j) = 'OBJECT' ELSE false END AS parse_ok FROM t1)
, t3 AS (SELECT *, CASE WHEN parse_ok THEN json_extract(j, '$.culturally_dependent') END AS f FROM t2)
, parsed AS (
  SELECT pos, config, expected, parse_ok,
         CASE WHEN NOT parse_ok OR f IS NULL THEN 0
              WHEN json_type(f) = 'NULL' THEN 0
              WHEN json_type(f) = 'BOOLEAN' THEN CASE WHEN CAST(f AS VARCHAR) = 'true' THEN 1 ELSE 0 END
              WHEN json_type(f) = 'VARCHAR' THEN CASE WHEN length(json_extract_string(f, '$')) > 0 THEN 1 ELSE 0 END
              WHEN json_type(f) IN ('ARRAY', 'OBJECT') THEN CASE WHEN CAST(f AS VARCHAR) IN ('[]', '{}') THEN 0 ELSE 1 END
              ELSE CASE WHEN CAST(f AS DOUBLE) <> 0 THEN 1 ELSE 0 END END AS claude_cs
  FROM t3)
"""


def _parsed(spark, sf_dir):
    return Bd.parse_labels(B.label_replies(spark, sf_dir))


@register("parse_labels", with_ctes(REPLIES, PARSE_SQL + "SELECT pos, config, expected, claude_cs, parse_ok FROM parsed"))
def q_parse_labels(spark, sf_dir):
    return _parsed(spark, sf_dir).select("pos", "config", "expected", "claude_cs", "parse_ok")


@register("label_rate", with_ctes(REPLIES, PARSE_SQL + """
SELECT config, count(*) AS n, CAST(sum(claude_cs) AS BIGINT) AS n_cultural, sum(claude_cs) / count(*) AS share,
       count(*) FILTER (WHERE NOT parse_ok) AS n_parse_failed
FROM parsed GROUP BY config"""))
def q_label_rate(spark, sf_dir):
    return Bd.label_rate(_parsed(spark, sf_dir))


@register("add_item_index", with_ctes(ITEMS, """
SELECT pos, config, split, row_number() OVER (PARTITION BY config, split ORDER BY pos) - 1 AS CEB_index,
       config AS CEB_config FROM it"""))
def q_add_item_index(spark, sf_dir):
    it = B.items(spark, sf_dir).select("pos", "config", "split")
    return Bd.add_item_index(it).select("pos", "config", "split", "CEB_index", "CEB_config")


@register("patch_item_index", with_ctes(ITEMS, """
, idx AS (SELECT pos, question, row_number() OVER (PARTITION BY config, split ORDER BY pos) - 1 AS CEB_index,
                 config AS CEB_config FROM it)
, dim AS (SELECT question, arg_max(CEB_index, pos) AS CEB_index, arg_max(CEB_config, pos) AS CEB_config
          FROM idx GROUP BY question)
SELECT l.pos, l.config, coalesce(d.CEB_index, -1) AS CEB_index, coalesce(d.CEB_config, '') AS CEB_config
FROM (SELECT * FROM it WHERE claude_cs IS NOT NULL) l LEFT JOIN dim d ON d.question = l.question"""))
def q_patch_item_index(spark, sf_dir):
    # the index and the lookup move a 256-bit digest of the question, not its text
    it = B.items(spark, sf_dir).withColumn("digest", F.sha2(F.col("question").cast("binary"), 256))
    bench = Bd.add_item_index(it.select("pos", "config", "split", "digest"))
    labeled = it.where(F.col("claude_cs").isNotNull()).select("pos", "config", "digest")
    return Bd.patch_item_index(labeled, bench, on="digest").select("pos", "config", "CEB_index", "CEB_config")


@register("filter_labeled", with_ctes(ITEMS, "SELECT pos, config, split, claude_cs FROM it WHERE claude_cs = 1"))
def q_filter_labeled(spark, sf_dir):
    return Bd.filter_labeled(B.items(spark, sf_dir).select("pos", "config", "split", "claude_cs"))


@register("kept_share", with_ctes(ITEMS, """
SELECT config, split, count(*) AS n, count(*) FILTER (WHERE claude_cs = 1) AS n_kept,
       count(*) FILTER (WHERE claude_cs = 1) * CAST(100 AS DOUBLE) / count(*) AS kept_pct
FROM it WHERE claude_cs IS NOT NULL GROUP BY config, split"""))
def q_kept_share(spark, sf_dir):
    it = B.items(spark, sf_dir).where(F.col("claude_cs").isNotNull())
    return Bd.kept_share(it)


LITE_MAX = 100   # cap per config for the sampled (CS) side


_QUOTA_SQL = f"""
, c AS (SELECT config, strat, count(*) AS n FROM it GROUP BY config, strat)
, tt AS (SELECT config, sum(n) AS total FROM c GROUP BY config)
, q AS (SELECT c.config, c.strat, c.n, tt.total,
               CASE WHEN tt.total <= {LITE_MAX} THEN c.n
                    ELSE greatest(1, CAST(round_even(c.n / tt.total * {LITE_MAX}, 0) AS BIGINT)) END AS quota
        FROM c JOIN tt ON tt.config = c.config)
"""


@register("sample_proportionally", with_ctes(ITEMS, _QUOTA_SQL + """
SELECT config, strat, n AS n_before, quota, least(quota, n) AS n_after FROM q"""))
def q_sample_proportionally(spark, sf_dir):
    it = B.items(spark, sf_dir).select("pos", "config", "strat")
    quotas = Bd.stratum_quotas(it, LITE_MAX, "strat", by=["config"])
    sampled = Bd.sample_proportionally(it, LITE_MAX, strat="strat", by=["config"])
    counts = Bd.before_after_counts(it, sampled, ["config", "strat"])
    return counts.join(quotas.select("config", "strat", "quota"), ["config", "strat"]).select(
        "config", "strat", "n_before", "quota", "n_after")


_INT_HASH = "(pos * 2654435761 + 12345) % 4294967296"


@register("sample_rows", with_ctes(ITEMS, _QUOTA_SQL + f"""
SELECT it.pos, it.config, it.strat FROM (
  SELECT pos, config, strat, row_number() OVER (PARTITION BY config, strat ORDER BY {_INT_HASH}, pos) AS rn FROM it) it
JOIN q ON q.config = it.config AND q.strat = it.strat WHERE rn <= quota"""))
def q_sample_rows(spark, sf_dir):
    """The rows that the sample keeps, under an order that SQL can state too."""
    it = B.items(spark, sf_dir).select("pos", "config", "strat")
    spread = F.shiftleft(F.expr(_INT_HASH) - (1 << 31), 32)
    return Bd.sample_proportionally(it, LITE_MAX, strat="strat", by=["config"], hashed=spread)


@register("assemble_lite", with_ctes(ITEMS, """
, cs AS (SELECT * FROM it WHERE claude_cs = 1)
, c AS (SELECT config, strat, count(*) AS n FROM cs GROUP BY config, strat)
, tt AS (SELECT config, sum(n) AS total FROM c GROUP BY config)
, q AS (SELECT c.config, c.strat, c.n,
               CASE WHEN tt.total <= 100 THEN c.n
                    ELSE greatest(1, CAST(round_even(c.n / tt.total * 100, 0) AS BIGINT)) END AS quota
        FROM c JOIN tt ON tt.config = c.config)
SELECT config, strat, 'cs' AS part, least(quota, n) AS n FROM q
UNION ALL SELECT config, strat, 'ca', count(*) FROM it WHERE claude_cs = 0 GROUP BY config, strat"""))
def q_assemble_lite(spark, sf_dir):
    it = B.items(spark, sf_dir).select("pos", "config", "strat", "claude_cs")
    cs = it.where(F.col("claude_cs") == 1).withColumn("part", F.lit("cs"))
    ca = it.where(F.col("claude_cs") == 0).withColumn("part", F.lit("ca"))
    lite = Bd.assemble_lite(cs, ca, max_samples=LITE_MAX, strat="strat")
    return lite.groupBy("config", "strat", "part").agg(F.count(F.lit(1)).alias("n"))


@register("profile_configs", """
SELECT lang AS config, source AS split, count(*) AS n FROM documents GROUP BY ROLLUP (lang, source)""")
def q_profile_configs(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "lang", "source")
    return Bd.profile_configs(d.select(F.col("lang").alias("config"), F.col("source").alias("split")))


_DOMAINS = ["src0", "src1", "src2", "src3"]


@register("profile_domains", f"""
SELECT source AS domain, lang AS split, count(*) AS n FROM documents
WHERE source IN ({', '.join(repr(x) for x in _DOMAINS)})
GROUP BY GROUPING SETS ((source, lang), (source))""")
def q_profile_domains(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "lang", "source")
    return Bd.profile_domains(d.select(F.col("source").alias("domain"), F.col("lang").alias("split")), _DOMAINS)


@register("option_length_histogram", """
SELECT lang AS subject, CAST(len(string_split(text, '. ')) AS INTEGER) AS n_options, count(*) AS n
FROM documents GROUP BY GROUPING SETS ((1, 2), (2))""")
def q_option_length_histogram(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "lang", "text")
    return Bd.option_length_histogram(d.select(F.col("lang").alias("subject"),
                                               F.split("text", r"\. ").alias("options")))


@register("select_configs_like", """
SELECT source AS config, count(*) AS n FROM documents WHERE contains(lower(source), 'src1') GROUP BY source""")
def q_select_configs_like(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "source").withColumnRenamed("source", "config")
    return Bd.select_configs_like(d, "SRC1").groupBy("config").agg(F.count(F.lit(1)).alias("n"))


def _agnostic_source(spark, sf_dir):
    it = B.items(spark, sf_dir)
    return it.where(F.col("claude_cs").isNotNull()).select(
        "pos", F.col("config").alias("lang"), "split",
        F.when(F.col("claude_cs") == 1, "CS").otherwise("CA").alias("cultural_sensitivity_label"))


_CA_MAP_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in Bd.ca_config_map().items()) \
    + ") t(code, ca_config)"


@register("select_culture_agnostic", with_ctes({**ITEMS, "cm": _CA_MAP_SQL}, """
SELECT it.pos, it.config AS lang, it.split, 'CA' AS cultural_sensitivity_label, cm.ca_config
FROM it JOIN cm ON cm.code = it.config WHERE it.claude_cs = 0 AND it.split = 'test'"""))
def q_select_culture_agnostic(spark, sf_dir):
    return Bd.select_culture_agnostic(_agnostic_source(spark, sf_dir))


def _el_source(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return d.select(F.col("doc_id").alias("pos"), F.col("text").alias("question"),
                    F.split("text", r"\. ").alias("choices"), (F.col("doc_id") % 4).alias("answer"),
                    F.col("source").alias("config"), F.lit("test").alias("split"))


def _ko_source(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    parts = F.split("text", r"\. ")
    return d.select(F.col("doc_id").alias("pos"), F.col("text").alias("question"),
                    *[F.try_element_at(parts, F.lit(i + 1)).alias(c) for i, c in enumerate("ABCD")],
                    (F.col("doc_id") % 4 + 1).alias("answer"), F.col("source").alias("config"),
                    F.lit("test").alias("split"))


_EL_SQL = """
SELECT d.doc_id AS pos, d.text AS question, s[1] AS option_a, s[2] AS option_b, s[3] AS option_c, s[4] AS option_d,
       substr('ABCD', CAST(d.doc_id % 4 + 1 AS INTEGER), 1) AS answer, d.source AS config, 'test' AS split
FROM (SELECT *, string_split(text, '. ') AS s FROM documents) d WHERE len(s) = 4"""
_KO_SQL = """
SELECT d.doc_id AS pos, d.text AS question, s[1] AS option_a, s[2] AS option_b, s[3] AS option_c, s[4] AS option_d,
       substr('ABCD', CAST(d.doc_id % 4 + 1 AS INTEGER), 1) AS answer, d.source AS config, 'test' AS split
FROM (SELECT *, string_split(text, '. ') AS s FROM documents) d"""


@register("normalize_source", _EL_SQL)
def q_normalize_source(spark, sf_dir):
    return Bd.normalize_source(_el_source(spark, sf_dir), "el")


@register("union_parts", f"SELECT *, 'el' AS part FROM ({_EL_SQL}) a UNION ALL SELECT *, 'ko' AS part FROM ({_KO_SQL}) b")
def q_union_parts(spark, sf_dir):
    el = Bd.normalize_source(_el_source(spark, sf_dir), "el").withColumn("part", F.lit("el"))
    ko = Bd.normalize_source(_ko_source(spark, sf_dir), "ko").withColumn("part", F.lit("ko"))
    return union_all([el, ko])


def _translation_replies(spark, sf_dir):
    """Replies for the items: sentences upper-cased as the 'translation'; every
    7th reply carries a stray inner quote and a raw newline (repairable), every
    11th is a refusal without JSON (unrepairable)."""
    d = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("_parts", F.split("text", r"\. "))
    parts = F.col("_parts")
    fields = F.struct(F.upper("text").alias("question"),
                      *[F.upper(F.coalesce(F.try_element_at(parts, F.lit(i + 1)), F.lit(""))).alias(f)
                        for i, f in enumerate(["option_a", "option_b", "option_c", "option_d"])])
    d = d.withColumn("_js", F.to_json(fields))          # staged: referenced by two branches below
    broken = F.regexp_replace("_js", r'^\{"question":"', '{"question":"say "hi"\n ')
    reply = (F.when(F.col("doc_id") % 11 == 0, F.lit("I cannot translate this item."))
             .when(F.col("doc_id") % 7 == 0, F.concat(F.lit("```json\n"), broken, F.lit("\n```")))
             .otherwise(F.concat(F.lit("Here you go: "), F.col("_js"))))
    return d.select(F.col("doc_id").alias("pos"), reply.alias("reply"))


_UP = "upper(replace({c}, 'ß', 'SS'))"          # full case mapping as in the JVM
TRANSLATED_SQL = f"""
SELECT pos, CASE WHEN pos % 11 = 0 THEN question
                 WHEN pos % 7 = 0 THEN 'say ''hi''' || chr(10) || ' ' || {_UP.format(c='question')} ELSE {_UP.format(c='question')} END AS question,
       {', '.join(f"CASE WHEN pos % 11 = 0 THEN {c} ELSE {_UP.format(c=c)} END AS {c}" for c in ('option_a', 'option_b', 'option_c', 'option_d'))},
       answer, config, split,
       CASE WHEN pos % 11 = 0 THEN 'failed' WHEN pos % 7 = 0 THEN 'repaired' ELSE 'ok' END AS parse_status
FROM ({_EL_SQL}) e"""


@register("apply_translations", TRANSLATED_SQL)
def q_apply_translations(spark, sf_dir):
    el = Bd.normalize_source(_el_source(spark, sf_dir), "el")
    return Bd.apply_translations(el, _translation_replies(spark, sf_dir), key="pos")
