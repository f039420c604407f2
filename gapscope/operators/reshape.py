"""Reshaping between the long score table and its wide/report forms (R-series).

Pivots always get their value list explicitly (no extra job to discover
values, and a stable schema).  Densifying uses ``explode`` of a literal list,
never a cross join of two data-sized tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapscope.dims import canonical_subsets, literal_array

GAPS = ["global_gap", "local_gap", "knowledge_gap"]


def to_wide(long: DataFrame, metric: str, subsets: list[str], keys=("model", "country")) -> DataFrame:
    """(keys, one column per subset) of ``metric``, missing -> null.

    ``subsets`` are the columns: pass ``present_subsets`` for all that occur.
    """
    s = long.where(F.col("metric") == metric)
    return s.groupBy(*keys).pivot("subset", subsets).agg(F.max("value"))


def present_subsets(long: DataFrame) -> list[str]:
    """All subset names of a long table: the value discovery of a pivot, one name a subset."""
    return [r.subset for r in long.select("subset").where("subset is not null").distinct().orderBy("subset").collect()]


def order_columns(wide: DataFrame, policy: str = "canonical", keys=("model", "country"),
                  canonical: list[str] | None = None) -> DataFrame:
    """R2: column order policies (a projection; no data movement).

    canonical: key columns, canonical subsets present, then unknown ones sorted.
    in_place:  canonical subsets present, unknown ones where they were.
    triplet:   keys, then ``<prefix>_{ca,cs,cs_en}`` by first appearance of the
               prefix; columns outside the pattern are dropped.
    """
    keys = list(keys)
    canon = canonical or canonical_subsets()
    rest = [c for c in wide.columns if c not in keys]
    if policy == "canonical":
        known = [c for c in canon if c in rest]
        cols = keys + known + sorted(c for c in rest if c not in known)
    elif policy == "in_place":
        known = [c for c in canon if c in rest]
        cols = keys + known + [c for c in rest if c not in known]
    elif policy == "triplet":
        # prefix = name up to its last '_' (so a lone '<x>_cs_en' has prefix
        # '<x>_cs' and is dropped unless '<x>_ca' or '<x>_cs' exists)
        keys = keys + [c for c in ("english_ca",) if c in rest and c not in keys]
        others = [c for c in rest if c not in keys]
        prefixes = list(dict.fromkeys(c.rsplit("_", 1)[0] for c in others))
        cols = keys + [f"{p}_{k}" for p in prefixes for k in ("ca", "cs", "cs_en") if f"{p}_{k}" in others]
    else:
        raise ValueError(f"unknown policy {policy}")
    return wide.select(*cols)


def order_rows(df: DataFrame, dim_model_order: DataFrame) -> DataFrame:
    """Canonical model order, unknown models last (by id).

    The ordinal is kept as ``model_ord`` (null for unknown models).
    """
    return (df.join(dim_model_order.select("model", "model_ord"), "model", "left")
            .orderBy(F.asc_nulls_last("model_ord"), "model"))


def select_scores(wide: DataFrame, models: list[str] | None = None,
                  columns: list[str] | None = None, suffix: str | None = None,
                  keys=("model", "country")) -> DataFrame:
    """Keep chosen models, and chosen columns or the columns with a suffix."""
    out = wide.where(F.col("model").isin(models)) if models else wide
    cols = [c for c in out.columns if c not in keys]
    if columns is not None:
        cols = [c for c in columns if c in out.columns]
    if suffix is not None:
        cols = [c for c in cols if c.endswith(suffix)]
    return out.select(*keys, *cols)


def densify_profile(gl: DataFrame, locales: list[str], col: str = "knowledge_gap") -> DataFrame:
    """Every model x every listed locale, missing -> null."""
    models = gl.select("model", "country").distinct()
    frame = models.withColumn("locale", F.explode(literal_array(locales)))
    return frame.join(gl.select("model", "locale", col), ["model", "locale"], "left")


def gap_summary_wide(gl: DataFrame, locales: list[str]) -> DataFrame:
    """Rows (model, country), columns ``<gap>__<locale>`` sorted, mean on duplicates."""
    aggs = [F.avg(g).alias(g) for g in GAPS]
    wide = gl.groupBy("model", "country").pivot("locale", locales).agg(*aggs)
    cols = sorted((g, loc) for g in GAPS for loc in locales)
    return wide.select("model", "country", *[F.col(f"{loc}_{g}").alias(f"{g}__{loc}") for g, loc in cols])


def melt_gaps(by_locale: DataFrame) -> DataFrame:
    """(locale, metric, value) of the two mean gaps of A10."""
    return by_locale.unpivot(["locale"], ["global_gap", "local_gap"], "metric", "value")


def metric_matrix(long: DataFrame, dim_panel: DataFrame, dim_subset: DataFrame) -> DataFrame:
    """Heat-map cells of the panel metrics over the listed subsets.

    Value normalised into the panel range ``(v - vmin) / (vmax - vmin)``;
    cells carry their panel, column position and column group (locale).
    Text labels are a display step (``format_string('%.2f', value)``).
    """
    cells = long.join(dim_panel, "metric").join(
        dim_subset.select("subset", "subset_ord", F.col("locale").alias("col_group")), "subset")
    return cells.select(
        "metric", "panel_ord", "model", "country", "subset", "subset_ord", "col_group", "value",
        ((F.col("value") - F.col("vmin")) / (F.col("vmax") - F.col("vmin"))).alias("norm_value"))


def panel_rows(cells: DataFrame, dim_home: DataFrame) -> DataFrame:
    """R11 + J10 on metric panels: the cells of ``metric_matrix`` with the rows' order and the home cell marked.

    All panels show the models of the first one in its order (``model_ord`` from 0, by
    name; null for a model that the first panel lacks); ``is_home_cs`` marks the
    ``_cs`` cell of the home locale of the model's country.
    """
    # a row a model: small beside the cells
    first = cells.where(F.col("panel_ord") == 0).select("model").distinct().select(
        F.col("model").alias("_model"), (F.row_number().over(Window.orderBy("model")) - 1).alias("model_ord"))
    home = dim_home.select(F.col("country").alias("_country"), F.concat("home_locale", F.lit("_cs")).alias("_home"))
    out = cells.join(first, cells["model"] == first["_model"], "left").join(home, cells["country"] == home["_country"], "left")
    return out.withColumn("is_home_cs", F.coalesce(F.col("_home") == F.col("subset"), F.lit(False))).drop("_model", "_country", "_home")


def coverage_gaps(long: DataFrame, expected_subsets: list[str], metric: str = "accuracy") -> DataFrame:
    """(model, subset) cells that a complete table would have but this one lacks."""
    s = long.where(F.col("metric") == metric)
    frame = (s.select("model").distinct()
             .withColumn("subset", F.explode(literal_array(expected_subsets))))
    return frame.join(s.select("model", "subset"), ["model", "subset"], "left_anti")
