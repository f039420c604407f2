"""Prompt tables (P-series): items x run plan joined to broadcast template dims.

One job, ``build_prompt_table``: subset -> (locale, kind, prompt language),
optional culture preamble, the style's template, and the per-model chat
wrapper.  Items meet models through the *run plan* (which model runs which
subset) — an equi-join on subset, not a cross product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapscope import dims as D
from gapscope.functions.names import col_

MIX_RE = r"^(.+?)_(cs_mix|en_mix)$"
SUBSET_RE = r"^(.+?)_(cs_en|cs|ca)$"


def _locale_dim(spark) -> DataFrame:
    return F.broadcast(D.dim_locale(spark))  # literal dim (19 rows)


def parse_subset(df: DataFrame, style: str = "loglik4", mode: str = "strict", subset: str = "subset") -> DataFrame:
    """Subset -> (locale, kind, prompt_lang).

    ``_cs_en`` and the baseline are English; ``<locale>_ca|_cs`` use the
    locale's language when the style has a template for it.  Otherwise
    strict mode raises, lenient mode falls back to English.  Mix form:
    ``_en_mix`` -> English, ``_cs_mix`` -> the locale's language.
    """
    spark = df.sparkSession
    langs = [r for r in _style_langs(style)]
    mix = F.regexp_extract(col_(subset), MIX_RE, 2)
    is_mix = mix != ""
    locale = F.when(is_mix, F.regexp_extract(col_(subset), MIX_RE, 1)).otherwise(
        F.regexp_extract(col_(subset), SUBSET_RE, 1))
    kind = F.when(is_mix, mix).otherwise(F.regexp_extract(col_(subset), SUBSET_RE, 2))
    out = df.withColumns({"locale": locale, "kind": kind})
    loc = _locale_dim(spark).select(F.col("locale").alias("_loc"), F.col("lang").alias("_lang"))
    out = out.join(loc, out["locale"] == loc["_loc"], "left").drop("_loc")
    native = F.when(F.col("_lang").isin(langs), F.col("_lang"))
    english = (F.col(subset) == D.BASELINE_SUBSET) | (F.col("kind") == "cs_en") | (F.col("kind") == "en_mix")
    wants_native = F.col("kind").isin("ca", "cs", "cs_mix")
    lang = F.when(english, F.lit("en")).when(wants_native & native.isNotNull(), native)
    if mode == "strict":
        lang = lang.otherwise(F.raise_error(F.concat(F.lit("no prompt language for subset "), F.col(subset))))
    else:
        lang = lang.otherwise(F.lit("en"))
    return out.withColumn("prompt_lang", lang).drop("_lang")


def _style_langs(style: str) -> list[str]:
    return list({"loglik4": D.PROMPT_LABELS, "loglik5": D.LOGLIK5_LABELS,
                 "gen4": D.GEN4_LABELS, "gen5": D.GEN5_LABELS}[style])


def pick_question(df: DataFrame) -> DataFrame:
    """Code-switched question column by subset suffix (plain ``question`` otherwise)."""
    q = F.col("question") if "question" in df.columns else F.lit(None).cast("string")
    if "question_en_mix" in df.columns:
        q = F.when(F.col("kind") == "en_mix", F.col("question_en_mix")).otherwise(q)
    if "question_cs_mix" in df.columns:
        q = F.when(F.col("kind") == "cs_mix", F.col("question_cs_mix")).otherwise(q)
    return df.withColumn("question_text", q)


def add_preamble(df: DataFrame, english: bool = False, native: bool = False) -> DataFrame:
    """Culture preamble; English one for ``_cs_en``/``_en_mix`` (flag ``english``),
    native one for ``_cs``/``_cs_mix`` (flag ``native``); first non-null wins."""
    loc = _locale_dim(df.sparkSession).select(F.col("locale").alias("_pl"), "culture", "native_preamble")
    out = df.join(loc, df["locale"] == loc["_pl"], "left")
    en = F.when(F.lit(english) & F.col("kind").isin("cs_en", "en_mix"),
                F.concat(F.lit("This is a question about "), F.col("culture"), F.lit(" culture.")))
    nat = F.when(F.lit(native) & F.col("kind").isin("cs", "cs_mix"), F.col("native_preamble"))
    return out.withColumn("preamble", F.coalesce(en, nat)).drop("_pl", "culture", "native_preamble")


def flag_instruct(model="model") -> Column:
    """Keyword in the lower-cased id, or an override id."""
    low = F.lower(col_(model))
    hit = F.lit(False)
    for kw in D.INSTRUCT_KEYWORDS:
        hit = hit | low.contains(kw)
    return hit | col_(model).isin(D.INSTRUCT_MODEL_OVERRIDES)


def _options_block(q: Column, five: bool) -> Column:
    parts = [q, F.lit("\nA. "), F.col("option_a"), F.lit("\nB. "), F.col("option_b"),
             F.lit("\nC. "), F.col("option_c"), F.lit("\nD. "), F.col("option_d")]
    if five:
        parts += [F.lit("\nE. "), F.col("idk_option")]
    return F.concat(*parts)


def build_prompts(df: DataFrame, style: str = "loglik4") -> DataFrame:
    """Prompt text per row (needs prompt_lang, question_text, options, preamble, model flags).

    loglik styles: [preamble\\n] label question, A-D(-E) lines, answer label.
    gen styles add the instruction line; instruct models in the Jais / AceGPT
    sets get their fixed wrappers (other chat templates are per-model
    tokenizer logic and stay outside).
    """
    tpl = F.broadcast(D.dim_template(df.sparkSession, style))  # literal dim (<= 20 rows)
    out = df.join(tpl, df["prompt_lang"] == tpl["lang"], "left").drop("lang")
    five = style.endswith("5")
    body = _options_block(F.concat(F.col("q_label"), F.col("question_text")), five)
    if style.startswith("loglik"):
        pre = F.when(F.col("preamble").isNotNull(), F.concat(F.col("preamble"), F.lit("\n"))).otherwise(F.lit("")) \
            if "preamble" in df.columns else F.lit("")
        text = F.concat(pre, body, F.lit("\n"), F.col("a_label"))
    else:
        text = F.concat(body, F.lit("\n"), F.col("instruction"), F.lit("\n"), F.col("a_label"))
        letters = "(A, B, C, D, or E)" if five else "(A, B, C, or D)"
        plain = F.concat(_options_block(F.col("question_text"), five),
                         F.lit(f"\nAnswer with only the letter {letters}."))
        jais = F.when(F.col("prompt_lang") == "ar", F.lit(D.JAIS_PROMPT_AR)).otherwise(F.lit(D.JAIS_PROMPT_EN))
        jais_text = F.replace(jais, F.lit("{Question}"), plain)
        ace = F.concat(F.lit("<User>: "), body, F.lit("\n"), F.col("instruction"), F.lit(" <Assistant>: "))
        if "model" in df.columns:
            instruct = F.col("is_instruct") if "is_instruct" in df.columns else flag_instruct("model")
            text = (F.when(instruct & F.col("model").isin(D.JAIS_CHAT_MODELS), jais_text)
                    .when(instruct & F.col("model").isin(D.ACEGPT_CHAT_MODELS), ace)
                    .otherwise(text))
    return out.withColumn("prompt", text).drop("q_label", "instruction", "a_label", "idk_option")


def limit_per_subset(items: DataFrame, n: int, order: str = "item_index", keys=("subset",)) -> DataFrame:
    """First n items of each subset (``row_number() <= n`` -> WindowGroupLimit,
    so each map task forwards at most n rows per subset)."""
    w = Window.partitionBy(*keys).orderBy(order)
    return items.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


#: Fragments of a subset's items, at most; the run plan is copied to that many.
MAX_FRAGMENTS = 64


def _meet(run_plan: DataFrame, items: DataFrame, fragments: int | None) -> DataFrame:
    """Run plan and items of a subset, joined by fragment and replicate.

    The items of each subset are dealt to ``fragments`` pieces by their hash and the
    run plan's rows are copied to every piece, so that the join is keyed by (subset, piece):
    the few subsets use all tasks, and one that holds a third of the items is in no single
    one.  The copies are ``fragments`` times the run plan (a row a model and subset); items are
    sent once.  ``fragments`` is by default the session's shuffle partitions, ``MAX_FRAGMENTS``
    at most; 1 joins on the subset alone.
    """
    if fragments is None:
        fragments = min(MAX_FRAGMENTS, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if fragments < 1:
        raise ValueError(f"fragments must be at least 1, not {fragments}")
    # maps cannot be hashed; any columns that tell most items apart will do
    told = [F.col(f"`{f.name}`") for f in items.schema if "map<" not in f.dataType.simpleString()]
    name = "_fragment"
    while name in items.columns:
        name += "_"
    cut = items.withColumn(name, F.pmod(F.xxhash64(*told), F.lit(fragments)).cast("int"))
    copies = run_plan.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(fragments - 1))))
    return copies.join(cut, ["subset", name]).drop(name)


def cross_model_prompts(items: DataFrame, run_plan: DataFrame, fragments: int | None = None) -> DataFrame:
    """Every model of the run plan x every item of the subsets it runs."""
    return _meet(run_plan.select("model", "subset").distinct(), items, fragments)


def build_prompt_table(items: DataFrame, run_plan: DataFrame, style: str = "loglik4",
                       preamble_en: bool = False, preamble_native: bool = False,
                       limit: int | None = None, mode: str = "strict",
                       fragments: int | None = None) -> DataFrame:
    """P1-P9 as one plan: (model, subset, item, prompt, gold)."""
    it = limit_per_subset(items, limit) if limit is not None else items
    it = pick_question(parse_subset(it, style, mode))
    if style.startswith("loglik"):
        it = add_preamble(it, preamble_en, preamble_native)
    plan = run_plan.select("model", "subset").distinct().withColumn("is_instruct", flag_instruct("model"))
    return build_prompts(_meet(plan, it, fragments), style)


def qa_prompt(lang="lang", question="question") -> Column:
    """Short-answer prompt with the abstain instruction (zh / en)."""
    zi, zq, za = D.QA_INSTRUCTION["zh"]
    ei, eq, ea = D.QA_INSTRUCTION["en"]
    return F.when(col_(lang) == "zh", F.concat(F.lit(f"{zi}\n{zq}"), col_(question), F.lit(f"\n{za}"))) \
        .otherwise(F.concat(F.lit(f"{ei}\n{eq}"), col_(question), F.lit(f"\n{ea}")))
