"""Per-(model, subset) metrics, the long score table and gap metrics.

Everything here is a hash aggregate (partial on the map side, final after the
shuffle) over a response table, followed by operations on the *aggregated*
table whose size is models x subsets, independent of how many items were
answered.  Skew: a hot model or subset only makes one partial-aggregate key
hot, which map-side combining absorbs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapscope.dims import BASELINE_SUBSET, GAP_LOCALES, KINDS, METRICS, UNKNOWN_COUNTRY, literal_array
from gapscope.functions.names import subset_kind, subset_locale

COUNT_COLS = ["n", "n_correct", "n_abstained", "n_conf_wrong"]

# ---------------------------------------------------------------------------
# A1 subset_metrics, A2 top_rank_rates
# ---------------------------------------------------------------------------

def subset_metrics(scored: DataFrame, keys=("model", "subset"), extra: dict | None = None) -> DataFrame:
    """accuracy, abstain_rate, conf_err_rate, cond_acc per key from C9 flags.

    Integer counts first, one division each (exact, engine independent).
    ``cond_acc`` is 0.0 when nothing was attempted.  ``extra`` adds more
    aggregate columns to the same pass (name -> aggregate expression).
    """
    keys = list(keys)
    extra = extra or {}
    agg = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("correct")).alias("n_correct"),
        F.count_if(F.col("abstained")).alias("n_abstained"),
        F.count_if(F.col("conf_wrong")).alias("n_conf_wrong"),
        *[e.alias(k) for k, e in extra.items()],
    )
    attempted = F.col("n_correct") + F.col("n_conf_wrong")
    return agg.select(
        *keys, *COUNT_COLS, *extra.keys(),
        (F.col("n_correct") / F.col("n")).alias("accuracy"),
        (F.col("n_abstained") / F.col("n")).alias("abstain_rate"),
        (F.col("n_conf_wrong") / F.col("n")).alias("conf_err_rate"),
        F.when(attempted > 0, F.col("n_correct") / attempted).otherwise(F.lit(0.0)).alias("cond_acc"),
    )


def top_rank_rates(scored: DataFrame, keys=("model", "subset")) -> DataFrame:
    """Mean of the argmax_is_top1 / argmax_is_top5 flags per key."""
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        (F.count_if("argmax_is_top1") / F.count(F.lit(1))).alias("argmax_is_top1_rate"),
        (F.count_if("argmax_is_top5") / F.count(F.lit(1))).alias("argmax_is_top5_rate"),
    )


def round_metrics(df: DataFrame, decimals: int = 4, cols=METRICS) -> DataFrame:
    """Display/file rounding as the result files store it (a separate step)."""
    return df.withColumns({c: F.round(c, decimals) for c in cols if c in df.columns})


# ---------------------------------------------------------------------------
# Long score table (model, country, subset, locale, kind, metric, value)
# ---------------------------------------------------------------------------

def scores_long(metrics_wide: DataFrame, metrics=METRICS) -> DataFrame:
    """Unpivot per-subset metric columns into (model, subset, metric, value)."""
    return (metrics_wide
            .unpivot(["model", "subset"], list(metrics), "metric", "value")
            .withColumn("value", F.col("value").cast("double")))


def with_subset_parts(df: DataFrame) -> DataFrame:
    return df.withColumns({"locale": subset_locale("subset"), "kind": subset_kind("subset")})


def with_country(df: DataFrame, dim_model: DataFrame, default: str = UNKNOWN_COUNTRY) -> DataFrame:
    """Model -> country of origin, default 'Unknown'.

    ``dim_model`` is a data-derived table, so no broadcast hint: Catalyst
    broadcasts it when its estimated size is under
    ``spark.sql.autoBroadcastJoinThreshold`` and AQE re-checks the real size;
    beyond that it is a sort-merge join.  Join *after* aggregating to
    (model, subset) so the big side is already small.
    """
    dm = dim_model.select("model", F.col("country").alias("_country"))
    out = df.join(dm, "model", "left").withColumn("country", F.coalesce("_country", F.lit(default)))
    return out.drop("_country")


def long_scores(scored: DataFrame, dim_model: DataFrame, metrics=METRICS) -> DataFrame:
    """Scored responses -> canonical long table (only the listed metrics are unpivoted)."""
    wide = subset_metrics(scored)
    return with_subset_parts(with_country(scores_long(wide, metrics), dim_model)).select(
        "model", "country", "subset", "locale", "kind", "metric", "value")


# ---------------------------------------------------------------------------
# G1 accuracy_gaps / R6 gaps_long, G2 hallucination_gap
# ---------------------------------------------------------------------------

def _locale_rows(long: DataFrame, metric: str, baseline: str, locales: list[str],
                 required: tuple[str, ...] = ("base", "ca", "cs", "cs_en"), keys: tuple[str, ...] = ("model", "country")) -> DataFrame:
    """One row per (``keys``, locale): baseline + the locale's three scores, for
    the locales whose ``required`` columns exist for some model.

    One pivot over explicit subset values (a shuffle of the already aggregated
    scores) and an ``explode`` of all locales' cells.  Which locales count is a
    second aggregate of the same scores to the set of subsets that have a value
    (at most the listed ones), exploded to the valid locales; nothing runs
    before the result is asked for and nothing is kept in memory.
    """
    subsets = [baseline] + [f"{loc}_{k}" for loc in locales for k in KINDS]
    s = long.where(F.col("metric") == metric).select(*keys, "subset", "value")
    wide = s.groupBy(*keys).pivot("subset", subsets).agg(F.first("value"))
    present = s.where(F.col("subset").isin(subsets) & F.col("value").isNotNull()).agg(F.collect_set("subset").alias("seen"))
    needed = {loc: [baseline if r == "base" else f"{loc}_{r}" for r in required] for loc in locales}
    valid = present.select(F.explode(F.array_compact(F.array(*[
        F.when(F.forall(literal_array(names), lambda n: F.array_contains("seen", n)), F.lit(loc))
        for loc, names in needed.items()]))).alias("locale"))
    cells = F.array(*[F.struct(F.lit(loc).alias("locale"), F.col(f"{loc}_ca").alias("local_ca"),
                               F.col(f"{loc}_cs").alias("local_cs"), F.col(f"{loc}_cs_en").alias("cs_en"))
                      for loc in locales])
    return wide.select(*keys, F.col(baseline).alias("english_ca"), F.explode(cells).alias("c")) \
        .select(*keys, "c.locale", "english_ca", "c.local_ca", "c.local_cs", "c.cs_en") \
        .join(valid, "locale", "left_semi")


def gaps_long(long: DataFrame, metric: str = "accuracy", baseline: str = BASELINE_SUBSET,
              locales: list[str] = GAP_LOCALES, keys: tuple[str, ...] = ("model", "country")) -> DataFrame:
    """R6 + G1: one row per (model, locale) with the 4 scores and 3 gaps.

    global = ca - baseline, local = cs - cs_en, knowledge = local - global,
    computed from unrounded parts.  A locale is present when its three
    subsets and the baseline exist for some model; a model missing one of
    them gets null gaps (missing propagates).
    """
    out = _locale_rows(long, metric, baseline, locales, keys=keys)
    g = F.col("local_ca") - F.col("english_ca")
    loc = F.col("local_cs") - F.col("cs_en")
    return out.select(*keys, "locale", "english_ca", "local_ca", "local_cs", "cs_en",
                      g.alias("global_gap"), loc.alias("local_gap"), (loc - g).alias("knowledge_gap"))


def accuracy_gaps(long: DataFrame, metric: str = "accuracy", baseline: str = BASELINE_SUBSET,
                  keys: tuple[str, ...] = ("model", "country")) -> DataFrame:
    """G1: (model, country, locale, global_gap, local_gap, knowledge_gap); ``keys`` may carry the file of a run."""
    return gaps_long(long, metric, baseline, keys=keys).select(
        *keys, "locale", "global_gap", "local_gap", "knowledge_gap")


def hallucination_gap(long: DataFrame, metric: str = "conf_err_rate", baseline: str = BASELINE_SUBSET,
                      locales: list[str] = GAP_LOCALES, keys: tuple[str, ...] = ("model", "country")) -> DataFrame:
    """conf_err(cs_en) - conf_err(cs) per (model, locale), where both subsets exist."""
    out = _locale_rows(long, metric, baseline, locales, required=("cs", "cs_en"), keys=keys)
    return out.select(*keys, "locale", F.col("local_cs").alias("conf_err_cs"),
                      F.col("cs_en").alias("conf_err_cs_en"),
                      (F.col("cs_en") - F.col("local_cs")).alias("hall_gap"))


# ---------------------------------------------------------------------------
# G3 drop_low_models, G5 metric_identity_check
# ---------------------------------------------------------------------------

def drop_low_models(long: DataFrame, threshold: float = 0.0, metric: str = "accuracy", keys: tuple[str, ...] = ("model",)) -> DataFrame:
    """Keep a model if ANY of its subset scores >= threshold (``keys``: a run of it, such as file and model).

    Non-numeric values count as missing (``try_cast``); a model whose scores
    are all missing is removed.  Returns the kept long rows of ``metric``.
    """
    s = long.where(F.col("metric") == metric)
    v = F.expr("try_cast(value AS double)")
    keep = (s.groupBy(*keys).agg(F.bool_or(F.coalesce(v >= F.lit(threshold), F.lit(False))).alias("k"))
            .where("k").select(*keys))
    return s.join(keep, list(keys), "left_semi")


def drop_low_report(long: DataFrame, threshold: float = 0.0, metric: str = "accuracy") -> DataFrame:
    """How many models G3 removed and kept (one row)."""
    s = long.where(F.col("metric") == metric)
    v = F.expr("try_cast(value AS double)")
    per = s.groupBy("model").agg(F.bool_or(F.coalesce(v >= F.lit(threshold), F.lit(False))).alias("k"))
    return per.agg(F.count_if(~F.col("k")).alias("removed"), F.count_if("k").alias("kept"))


def metric_identity_check(metrics_wide: DataFrame, tol: float = 1e-9) -> DataFrame:
    """Cells violating conf_err = 1 - accuracy - abstain (holds iff gold is never E).

    With the integer counts present the check is exact; otherwise it compares
    the rates within ``tol``.
    """
    if set(COUNT_COLS) <= set(metrics_wide.columns):
        resid = F.col("n_correct") + F.col("n_abstained") + F.col("n_conf_wrong") - F.col("n")
        bad = resid != 0
    else:
        resid = F.col("conf_err_rate") - (F.lit(1.0) - F.col("accuracy") - F.col("abstain_rate"))
        bad = F.abs(resid) > tol
    return metrics_wide.where(bad).select("model", "subset", resid.alias("residual"))
