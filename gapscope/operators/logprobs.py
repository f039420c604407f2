"""Scoring from logits / log-probabilities (C1-C6, C10, C16; A2, A3, A6-A8).

A response row carries its last-position logits as an array (vocab-sized).
Everything per response is an array expression evaluated inside the row
(no shuffle, whole-stage codegen): log-softmax, top-k, argmax over the
model's answer-token variants.  The only join is response x per-model
variant list (models, not responses, so it is small; AQE broadcasts it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapscope.dims import literal_array
from gapscope.functions.names import col_

LETTERS = ["A", "B", "C", "D"]
PREFIXES_ALL = [" ", ""]            # 8-variant scoring tries these two
PREFIXES_FIRST = [" ", "", "\n"]    # 5-option scoring and the probe: first that works


def log_softmax(logits="logits") -> Column:
    """``x - logsumexp(x)`` per row.

    logsumexp is one streaming pass (running max ``m`` and rescaled sum
    ``s``), and the subtraction pairs each element with the row constant via
    ``zip_with(x, array_repeat(lse))``: a lambda that referenced an outer
    computed value would re-evaluate it for every element (quadratic).
    """
    x = F.transform(col_(logits), lambda v: v.cast("double"))
    return F.zip_with(x, F.array_repeat(_log_sum_exp(x), F.size(x)), lambda v, c: v - c)


def _log_sum_exp(x: Column) -> Column:
    return F.aggregate(
        x, F.struct(F.lit(float("-inf")).alias("m"), F.lit(0.0).alias("s")),
        lambda a, v: F.when(v > a["m"], F.struct(v.alias("m"), (a["s"] * F.exp(a["m"] - v) + 1).alias("s")))
        .otherwise(F.struct(a["m"].alias("m"), (a["s"] + F.exp(v - a["m"])).alias("s"))),
        lambda a: a["m"] + F.log(a["s"]))


def top_k_tokens(log_probs="log_probs", k: int = 5) -> Column:
    """array<struct<rank, token_id, log_prob, prob>> of the k best tokens.

    Ties go to the lower token id.  One pass over the vocab array that keeps k
    entries; only a token above the least of them makes these few be sorted anew.
    """
    entry = "struct<lp:double,neg_id:int>"
    keyed = F.transform(col_(log_probs), lambda v, i: F.struct(v.cast("double").alias("lp"), (-i).alias("neg_id")))
    best = F.aggregate(
        keyed, F.array().cast(f"array<{entry}>"),
        lambda kept, x: F.when((F.size(kept) < k) | (x > F.element_at(kept, -1)),
                               F.slice(F.sort_array(F.array_append(kept, x), asc=False), 1, k)).otherwise(kept))
    return F.transform(best, lambda s, i: F.struct(
        (i + 1).alias("rank"), (-s["neg_id"]).alias("token_id"),
        s["lp"].alias("log_prob"), F.exp(s["lp"]).alias("prob")))


# ---------------------------------------------------------------------------
# C1 / C2 over chunks of a vocabulary: no row holds all of a response's logits
# ---------------------------------------------------------------------------

CHUNK = 4096                        # tokens of a chunk


def to_chunks(tokens: DataFrame, keys: list[str], size: int = CHUNK) -> DataFrame:
    """(keys, chunk, tokens array<struct<token_id, logit>>) from one row per token (keys, token_id, logit)."""
    return tokens.groupBy(*keys, F.expr(f"token_id div {size}").alias("chunk")).agg(
        F.array_sort(F.collect_list(F.struct("token_id", F.col("logit").cast("double").alias("logit")))).alias("tokens"))


def _partial(tokens: str = "tokens") -> Column:
    """(max, sum of exp of the distances to it) of a chunk."""
    return F.aggregate(
        F.transform(tokens, lambda t: t["logit"]), F.struct(F.lit(float("-inf")).alias("m"), F.lit(0.0).alias("s")),
        lambda a, v: F.when(v > a["m"], F.struct(v.alias("m"), (a["s"] * F.exp(a["m"] - v) + 1).alias("s")))
        .otherwise(F.struct(a["m"].alias("m"), (a["s"] + F.exp(v - a["m"])).alias("s"))))


def chunk_norms(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lse): the chunks' partials merged; two numbers a chunk are sent."""
    parts = chunks.select(*keys, _partial().alias("p")).groupBy(*keys).agg(F.collect_list("p").alias("ps"))
    most = F.array_max(F.transform("ps", lambda p: p["m"]))
    return parts.withColumn("most", most).select(*keys, (F.col("most") + F.log(F.aggregate(
        F.zip_with("ps", F.array_repeat("most", F.size("ps")), lambda p, m: p["s"] * F.exp(p["m"] - m)),
        F.lit(0.0), lambda a, x: a + x))).alias("lse"))


def chunked_log_softmax(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """C1 in long form: (keys, token_id, log_prob)."""
    return chunks.join(chunk_norms(chunks, keys), keys).select(*keys, "lse", F.inline("tokens")).select(
        *keys, "token_id", (F.col("logit") - F.col("lse")).alias("log_prob"))


def chunked_top_k(chunks: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """C2 from chunks: (keys, rank, token_id, log_prob, prob); k entries and two numbers a chunk are sent."""
    best = F.slice(F.sort_array(F.transform("tokens", lambda t: F.struct(t["logit"].alias("x"), (-t["token_id"]).alias("neg_id"))), asc=False), 1, k)
    of = chunks.select(*keys, _partial().alias("p"), best.alias("best"))
    merged = of.groupBy(*keys).agg(F.collect_list("p").alias("ps"), F.slice(F.sort_array(F.flatten(F.collect_list("best")), asc=False), 1, k).alias("top"))
    most = F.array_max(F.transform("ps", lambda p: p["m"]))
    lse = F.col("most") + F.log(F.aggregate(F.zip_with("ps", F.array_repeat("most", F.size("ps")), lambda p, m: p["s"] * F.exp(p["m"] - m)),
                                            F.lit(0.0), lambda a, x: a + x))
    ranked = merged.withColumn("most", most).withColumn("lse", lse).select(*keys, "lse", F.posexplode("top").alias("at", "t"))
    lp = F.col("t.x") - F.col("lse")
    return ranked.select(*keys, (F.col("at") + 1).alias("rank"), (-F.col("t.neg_id")).alias("token_id"), lp.alias("log_prob"), F.exp(lp).alias("prob"))


# ---------------------------------------------------------------------------
# C3 / C4 resolve_variants
# ---------------------------------------------------------------------------

def resolve_variants(tokens: DataFrame, mode: str = "all", letters: list[str] = LETTERS) -> DataFrame:
    """Working answer-token variants per model.

    ``tokens``: (model, prefix, letter, token_ids array<int>) — the encoding
    of ``prefix + letter``.  A prefix works iff every one of ``letters`` encodes
    to one token (five letters for the form with an abstain option).  mode 'all': every working prefix of (" ", ""); mode 'first': the
    first working prefix of (" ", "", "\\n").  A model with no working prefix
    raises at run time.
    Returns (model, prefix, prefix_ord, letter, letter_ord, token_id).
    """
    order = PREFIXES_ALL if mode == "all" else PREFIXES_FIRST
    pord = F.array_position(literal_array(order), F.col("prefix")) - 1
    lord = F.array_position(literal_array(letters), F.col("letter")) - 1
    t = tokens.withColumns({"prefix_ord": pord, "letter_ord": lord}).where(
        (F.col("prefix_ord") >= 0) & (F.col("letter_ord") >= 0))
    per = t.groupBy("model", "prefix", "prefix_ord").agg(
        (F.max(F.size("token_ids")) == 1).alias("single"),
        F.countDistinct("letter").alias("n_letters"))
    ok = per.where(F.col("single") & (F.col("n_letters") == len(letters)))
    if mode == "first":
        ok = ok.groupBy("model").agg(F.min("prefix_ord").alias("prefix_ord"))
    chosen = t.join(ok.select("model", "prefix_ord"), ["model", "prefix_ord"]).select(
        "model", "prefix", "prefix_ord", "letter", "letter_ord", F.element_at("token_ids", 1).alias("token_id"))
    # a model with no working prefix fails loudly when the result is computed
    missing = tokens.select("model").distinct().join(ok.select("model"), "model", "left_anti")
    guard = missing.select(
        "model", F.lit(None).cast("string").alias("prefix"), F.lit(None).cast("int").alias("prefix_ord"),
        F.lit(None).cast("string").alias("letter"), F.lit(None).cast("int").alias("letter_ord"),
        F.raise_error(F.concat(F.lit("no single-token answer letters for "), F.col("model")))
        .cast("int").alias("token_id"))
    return chosen.unionByName(guard)


def variant_arrays(variants: DataFrame) -> DataFrame:
    """(model, variants array<struct<prefix_ord, letter_ord, prefix, letter, token_id>>)."""
    return variants.groupBy("model").agg(F.sort_array(F.collect_list(F.struct(
        "prefix_ord", "letter_ord", "prefix", "letter", "token_id"))).alias("variants"))


# ---------------------------------------------------------------------------
# score_logprobs
# ---------------------------------------------------------------------------

def resolve_models(tokens: DataFrame, letters: list[str] = LETTERS) -> DataFrame:
    """C3 and C4 at once: (model, variants, used_prefix), one row a model from one pass over the token table.

    A prefix works if each of ``letters`` is one token after it.  ``variants`` has the
    letters of all working prefixes of the 'all' order, ``used_prefix`` is the first
    working one of the 'first' order.  A model without any fails when the result is read.
    """
    entry = F.struct("prefix", "letter", "token_ids")
    # prefixes x letters: a few entries a model
    per = tokens.where(F.col("letter").isin(letters)).groupBy("model").agg(F.collect_set(entry).alias("t"))

    def works(prefix: str) -> Column:
        mine = F.filter("t", lambda x: x["prefix"] == prefix)
        return F.forall(mine, lambda x: F.size(x["token_ids"]) == 1) & (F.size(F.array_distinct(F.transform(mine, lambda x: x["letter"]))) == len(letters))

    def of(prefix: str, at: int) -> Column:
        found = F.transform(F.filter("t", lambda x: x["prefix"] == prefix), lambda x: F.struct(
            F.lit(at).alias("prefix_ord"), (F.array_position(literal_array(letters), x["letter"]) - 1).cast("int").alias("letter_ord"),
            x["prefix"].alias("prefix"), x["letter"].alias("letter"), F.element_at(x["token_ids"], 1).alias("token_id")))
        return F.when(works(prefix), found).otherwise(F.filter(found, lambda x: F.lit(False)))

    first = F.coalesce(*[F.when(works(p), F.lit(p)) for p in PREFIXES_FIRST])
    missing = F.raise_error(F.concat(F.lit("no single-token answer letters for "), F.col("model")))
    return per.select("model", F.sort_array(F.concat(*[of(p, at) for at, p in enumerate(PREFIXES_ALL)])).alias("variants"),
                      F.coalesce(first, missing.cast("string")).alias("used_prefix"))


def response_scalars(responses: DataFrame, token_ids: Column, top: int = 5) -> DataFrame:
    """Each response without its logits: log-sum-exp, the ``top`` tokens (C2) and the logits of ``token_ids``.

    Everything is computed inside the row that was read; no row with a vocabulary-sized
    array is shuffled after this.
    """
    x = F.transform("logits", lambda v: v.cast("double"))
    df = responses.withColumn("_lse", _log_sum_exp(x)).withColumn("top_tokens", top_k_tokens("logits", top))
    df = df.withColumn("_ids", token_ids).withColumn("letter_logits", F.map_from_entries(F.transform("_ids", lambda t: F.struct(
        t.alias("token_id"), F.try_element_at("logits", t + 1).cast("double").alias("logit")))))
    # top tokens come with logits; the row constant turns them into log-probabilities
    lse = F.array_repeat("_lse", F.size("top_tokens"))
    return df.withColumn("top_tokens", F.zip_with("top_tokens", lse, lambda t, c: F.struct(
        t["rank"].alias("rank"), t["token_id"].alias("token_id"), (t["log_prob"] - c).alias("log_prob"),
        F.exp(t["log_prob"] - c).alias("prob")))).drop("logits", "_ids")


def score_models(responses: DataFrame, resolved: DataFrame, top: int = 5) -> DataFrame:
    """C5, C6, C10, C16 in one job over a logits table.

    ``responses``: (model, subset, pos, gold, logits); ``resolved``: (model, variants,
    used_prefix or null).  The answer letters' token ids of all models (a scalar subquery)
    pick a few logits of each row; the rows meet their model only after that.

    Adds ``top_tokens`` (C2, flagged ``is_letter``), ``argmax_prefix``/``pred``/``argmax_token_id`` (C5,
    ties -> earliest (prefix, letter)), ``argmax_is_top1/5`` (C6), ``gold_prob`` (C10: softmax over the
    letters of the argmax prefix) and the probe flags of C16.
    """
    ids = resolved.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(
        F.transform("variants", lambda v: v["token_id"]))))).alias("ids")).scalar()
    df = response_scalars(responses, ids, top).join(resolved, "model")
    scored = F.transform("variants", lambda v: F.struct(
        F.element_at("letter_logits", v["token_id"]).alias("x"), (-(v["prefix_ord"] * 100 + v["letter_ord"])).alias("neg_ord"),
        v["prefix"].alias("prefix"), v["letter"].alias("letter"), v["token_id"].alias("token_id"), (-v["letter_ord"]).alias("neg_letter")))
    df = df.withColumn("_scored", scored).withColumn("_best", F.array_max("_scored"))
    df = df.withColumns({"argmax_prefix": F.col("_best.prefix"), "pred": F.col("_best.letter"), "argmax_token_id": F.col("_best.token_id")})
    # C2 flag: is each top token one of the model's answer-letter variants
    df = df.withColumn("top_tokens", F.transform("top_tokens", lambda t: t.withField(
        "is_letter", F.exists("variants", lambda v: v["token_id"] == t["token_id"]))))
    top_ids = F.transform("top_tokens", lambda s: s["token_id"])
    top1 = F.element_at(top_ids, 1)
    same_prefix = F.filter("_scored", lambda v: v["prefix"] == F.col("argmax_prefix"))
    mx = F.col("_best.x")                                       # the best letter has the greatest logit of its prefix
    denom = F.aggregate(F.transform(same_prefix, lambda s: F.exp(s["x"] - mx)), F.lit(0.0), lambda a, b: a + b)
    gold_x = F.try_element_at(F.filter(same_prefix, lambda s: s["letter"] == F.col("gold")), F.lit(1))["x"]
    used = F.filter("_scored", lambda v: v["prefix"] == F.col("used_prefix"))
    best_used = F.array_max(F.transform(used, lambda v: F.struct(v["x"].alias("x"), v["neg_letter"].alias("neg_ord"), v["letter"].alias("letter"))))
    df = df.withColumns({
        "argmax_is_top1": top1 == F.col("argmax_token_id"),
        "argmax_is_top5": F.array_contains(top_ids, F.col("argmax_token_id")),
        "gold_prob": F.exp(gold_x - mx) / denom,
        "top1_is_letter": F.exists("variants", lambda v: v["token_id"] == top1),
        "top1_matches_used_prefix": F.exists(used, lambda v: v["token_id"] == top1),
        "pred_under_used_prefix": best_used["letter"]})
    return df.drop("_best", "_scored", "_lse", "letter_logits")


def score_logprobs(responses: DataFrame, variants: DataFrame, used_prefix: DataFrame | None = None,
                   top: int = 5) -> DataFrame:
    """``score_models`` for a variant table (C3 or C4) and, for the probe flags, (model, prefix) as ``used_prefix``."""
    resolved = variant_arrays(variants)
    if used_prefix is None:
        resolved = resolved.withColumn("used_prefix", F.lit(None).cast("string"))
    else:
        resolved = resolved.join(used_prefix.select("model", F.col("prefix").alias("used_prefix")), "model", "left")
    return score_models(responses, resolved, top)


def probe_rates(scored: DataFrame, keys=("model", "subset")) -> DataFrame:
    """A3: n, counts and rates of top-1-is-a-letter and top-1-matches-used-prefix."""
    n = F.count(F.lit(1))
    return scored.groupBy(*keys).agg(
        n.alias("n_samples"),
        F.count_if("top1_is_letter").alias("top1_is_letter_count"),
        (F.count_if("top1_is_letter") / n).alias("top1_is_letter_rate"),
        F.count_if("top1_matches_used_prefix").alias("top1_matches_used_prefix_count"),
        (F.count_if("top1_matches_used_prefix") / n).alias("top1_matches_used_prefix_rate"))


def matrix_means(rates: DataFrame, rate_col: str = "top1_is_letter_rate", decimals: int | None = None) -> DataFrame:
    """Mean rate per subset over its models, and per model over its subsets
    (``axis`` = 'subset' | 'model'); models worst first."""
    def mean():
        m = F.avg(rate_col)
        return (F.round(m, decimals) if decimals is not None else m).alias("mean_rate")
    by_subset = rates.groupBy(F.col("subset").alias("key")).agg(mean()).withColumn("axis", F.lit("subset"))
    by_model = rates.groupBy(F.col("model").alias("key")).agg(mean()).withColumn("axis", F.lit("model"))
    return by_subset.unionByName(by_model).orderBy("axis", "mean_rate", "key")


def prefix_histogram(used_prefix: DataFrame) -> DataFrame:
    """Number of models per chosen prefix, descending."""
    return used_prefix.groupBy("prefix").agg(F.countDistinct("model").alias("n_models")).orderBy(
        F.desc("n_models"), "prefix")


def overall_stats(rates: DataFrame) -> DataFrame:
    """Number of models, distinct subsets and (model, subset) pairs."""
    return rates.agg(F.countDistinct("model").alias("n_models"), F.countDistinct("subset").alias("n_subsets"),
                     F.count(F.lit(1)).alias("n_pairs"))
