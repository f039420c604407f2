"""Merges, splits and upserts of score and prediction tables.

Score tables are long: ``(file, model, subset, metric, value)`` where ``file``
is the result file a row came from (one file per model and run).  Prediction
tables are ``(file, model, subset, pos, ...)`` with ``pos`` the record's
position in its file.  Every merge is a semi/anti/outer equi-join on
(file, subset) keys plus a union, so nothing is keyed by row position and
nothing needs a global order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapscope.functions.names import strip_cs_suffix


def union_all(parts: list[DataFrame]) -> DataFrame:
    """UNION ALL by column name; missing columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


# ---------------------------------------------------------------------------
# S9 upsert_scores, S10 upsert_predictions, J1 overlay_scores
# ---------------------------------------------------------------------------

def upsert_scores(old: DataFrame, new: DataFrame, keys=("model", "subset", "metric")) -> DataFrame:
    """The new value of a key wins, all other old keys are kept (idempotent)."""
    keys = list(keys)
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def upsert_predictions(old: DataFrame, new: DataFrame, keys=("model", "subset")) -> DataFrame:
    """Drop *all* old records of any re-run (model, subset), then append."""
    keys = list(keys)
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def overlay_scores(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """Every key of an overlay file overrides the base file of the same name.

    Overlay files without a base file are ignored; the model is the base file's.
    """
    # merge: both sides grow with the files, and as compressed columns they look small enough to broadcast
    o = overlay.drop("model").join(base.select("file", "model").distinct().hint("merge"), "file")
    keys = ["file", "metric", "subset"]
    return base.join(o.select(*keys).hint("merge"), keys, "left_anti").unionByName(o.select(*base.columns))


# ---------------------------------------------------------------------------
# J2 attach_ca
# ---------------------------------------------------------------------------

def attach_ca(cs: DataFrame, ca: DataFrame, baseline: str = "english_ca") -> DataFrame:
    """Add CA scores to CS score files (one metric).

    Kept subsets: the baseline, ``<lang>_ca`` for each ``<lang>`` that has a
    ``<lang>_cs`` key and a CA value in some CA file, and ``<lang>_cs`` /
    ``<lang>_cs_en`` of the CS files.  For a kept CA key the CA file of the
    same name wins; other keys of the CS files are dropped.  The subset lists
    are distinct-subset aggregates (bounded by the subset dimension); AQE
    turns their joins into broadcasts at run time.
    """
    lang = F.split(F.col("subset"), "_").getItem(0)
    langs = cs.where(F.col("subset").endswith("_cs")).select(lang.alias("lang")).distinct()
    allowed_ca = (langs.select(F.concat("lang", F.lit("_ca")).alias("subset"))
                  .join(ca.select("subset").distinct(), "subset", "left_semi")
                  .unionByName(cs.sparkSession.createDataFrame([(baseline,)], "subset string")))
    allowed_cs = (langs.select(F.explode(F.array(F.concat("lang", F.lit("_cs")),
                                                 F.concat("lang", F.lit("_cs_en")))).alias("subset"))
                  .join(cs.select("subset").distinct(), "subset", "left_semi"))
    allowed = allowed_ca.unionByName(allowed_cs).distinct()
    files = cs.select("file", "model").distinct()
    from_ca = (ca.join(allowed_ca.distinct(), "subset", "left_semi").select("file", "subset", "value")
               .join(files, "file").withColumn("_prio", F.lit(0)))
    from_cs = (cs.join(allowed, "subset", "left_semi").select("file", "model", "subset", "value")
               .withColumn("_prio", F.lit(1)))
    both = from_ca.unionByName(from_cs)
    return both.groupBy("file", "model", "subset").agg(F.min_by("value", "_prio").alias("value"))


# ---------------------------------------------------------------------------
# J3 merge_wide
# ---------------------------------------------------------------------------

def merge_wide(left: DataFrame, right: DataFrame, drop: str = "english_ca") -> DataFrame:
    """Left join on (model, country); the right side's ``drop`` column is dropped."""
    r = right.drop(drop) if drop in right.columns else right
    return left.join(r, ["model", "country"], "left")


# ---------------------------------------------------------------------------
# J4 merge_cs_en_scores, J5 merge_cs_en_predictions
# ---------------------------------------------------------------------------

def _restrict(df: DataFrame, ref: DataFrame | None) -> DataFrame:
    if ref is None:
        return df
    allowed = ref.select("file", strip_cs_suffix("subset").alias("_base")).distinct()
    return (df.withColumn("_base", strip_cs_suffix("subset"))
            .join(allowed, ["file", "_base"], "left_semi").drop("_base"))


def merge_cs_en_scores(cs: DataFrame, en: DataFrame, ref: DataFrame | None = None) -> DataFrame:
    """Per file, CS keys plus EN's ``_cs_en`` keys; EN-only locales kept.

    Files come from ``ref`` (or CS); a file in neither side is skipped.  With
    ``ref`` both sides are limited to the locales of the ref file.  A
    ``<x>_cs_en`` key from EN wins when CS has ``<x>_cs`` or the key itself;
    any other EN key is added only when CS has no key of its locale.

    One pass: both sides are unioned and every row is judged against the
    flags of its (file, metric, locale) group — a window over groups of a
    handful of rows (one per kind and side), so no group can be large.
    (file, metric, group_side, group_pos, side, pos) is the merged file's order:
    each CS locale's rows, then its EN row; locales that only EN has come last.
    """
    files = (ref if ref is not None else cs).select("file").distinct()
    cols = ["file", "model", "subset", "metric", "value", "pos"]
    c = _restrict(cs.join(files, "file", "left_semi"), ref).select(*cols, F.lit(0).alias("side"))
    e = _restrict(en.join(files, "file", "left_semi"), ref).select(*cols, F.lit(1).alias("side"))
    # the CS file names the model; a file that only EN has keeps EN's
    named = cs.groupBy("file").agg(F.min("model").alias("_model"))
    e = e.join(named, "file", "left").withColumn("model", F.coalesce("_model", "model")).drop("_model")
    u = c.unionByName(e).withColumn("_b", strip_cs_suffix("subset"))
    w = Window.partitionBy("file", "metric", "_b")
    is_cs = F.col("side") == 0
    twin = F.concat("_b", F.lit("_cs_en"))
    flag = lambda cond: F.max(cond.cast("int")).over(w) == 1
    u = u.withColumns({
        "_cs_any": flag(is_cs),
        "_cs_pair": flag(is_cs & ((F.col("subset") == F.concat("_b", F.lit("_cs"))) | (F.col("subset") == twin))),
        "_en_twin": flag(~is_cs & (F.col("subset") == twin)),
        # where the locale's rows stand in the merged file: its first CS position; EN-only locales follow
        "group_side": F.min("side").over(w),
        "group_pos": F.coalesce(F.min(F.when(is_cs, F.col("pos"))).over(w), F.min("pos").over(w)),
    })
    is_twin = F.col("subset").endswith("_cs_en") & (F.col("subset") == twin)
    keep = (F.when(is_cs, ~(is_twin & F.col("_en_twin")))
            .otherwise(F.when(is_twin, F.col("_cs_pair") | ~F.col("_cs_any")).otherwise(~F.col("_cs_any"))))
    return u.where(keep).select(*cols, "side", "group_side", "group_pos")


def merge_cs_en_predictions(cs: DataFrame, en: DataFrame, ref: DataFrame | None = None) -> DataFrame:
    """Per file, each CS subset's records followed by its EN twin's records.

    EN records whose ``<x>_cs`` subset is not in the CS file are dropped
    (unlike J4).  ``group_pos`` is the first CS position of the group, so
    ordering by (file, group_pos, side, pos) gives the merged file order.
    """
    files = (ref if ref is not None else cs).select("file").distinct()
    c = _restrict(cs.join(files, "file", "left_semi"), ref)
    e = _restrict(en.join(files, "file", "left_semi"), ref)
    groups = c.groupBy("file", "subset").agg(F.min("pos").alias("group_pos"))
    cg = c.join(groups, ["file", "subset"]).withColumn("group_subset", F.col("subset")).withColumn("side", F.lit(0))
    eg = (e.withColumn("group_subset", F.concat(strip_cs_suffix("subset"), F.lit("_cs")))
          .join(groups.withColumnRenamed("subset", "group_subset"), ["file", "group_subset"])
          .withColumn("side", F.lit(1)))
    return cg.unionByName(eg)


# ---------------------------------------------------------------------------
# J6 split_by_suffix, J7 extract_ca
# ---------------------------------------------------------------------------

def split_by_suffix(df: DataFrame, suffix: str = "_cs_en") -> DataFrame:
    """Tag each row with its side; write once with ``partitionBy('side')``."""
    return df.withColumn("side", F.when(F.col("subset").endswith(suffix), F.lit("cs_en")).otherwise(F.lit("cs")))


def extract_ca(df: DataFrame) -> DataFrame:
    """Keep only ``_ca`` subsets (a metric with no such key disappears)."""
    return df.where(F.col("subset").endswith("_ca"))


# ---------------------------------------------------------------------------
# J9 with_short_name
# ---------------------------------------------------------------------------

def with_short_name(df: DataFrame, dim_short: DataFrame | None = None, model: str = "model") -> DataFrame:
    """Figure label of a model.  With ``dim_short`` (model, short): table
    lookup, the id itself when absent; without it: the rule chain (last path
    segment and fixed replacements)."""
    from gapscope.functions.names import short_model_name
    if dim_short is None:
        return df.withColumn("short", short_model_name(model))
    d = dim_short.select(F.col("model").alias("_m"), F.col("short").alias("_s"))
    return (df.join(d, df[model] == d["_m"], "left")
            .withColumn("short", F.coalesce("_s", F.col(model))).drop("_m", "_s"))
