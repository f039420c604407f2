"""Summaries of the (model, locale) gap table (A9-A17) and its views.

The gap table has one row per (model, locale): its size is models x locales,
not responses, so every aggregate here is a small hash aggregate.  Sort
orders are returned as explicit ordinal columns where the order *is* the
result (rows of a DataFrame carry no order of their own).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapscope.dims import DEFAULT_NATIVE_LOCALES, literal_array
from gapscope.functions.quantiles import quantiles

GAPS = ["global_gap", "local_gap", "knowledge_gap"]


def _means(keys, gl: DataFrame, decimals: int | None) -> DataFrame:
    out = gl.groupBy(*keys).agg(*[F.avg(g).alias(g) for g in GAPS])
    if decimals is not None:
        out = out.withColumns({g: F.round(g, decimals) for g in GAPS})
    return out


def gap_by_country_locale(gl: DataFrame, decimals: int | None = None) -> DataFrame:
    """Mean of the three gaps per (country, locale), nulls skipped."""
    return _means(["country", "locale"], gl, decimals).orderBy("country", "locale")


def gap_by_locale(gl: DataFrame, decimals: int | None = None) -> DataFrame:
    """A10: mean of the three gaps per locale, knowledge gap descending."""
    return _means(["locale"], gl, decimals).orderBy(F.desc("knowledge_gap"), "locale")


def _order_by_mean(gl: DataFrame, key: str, decimals: int | None) -> DataFrame:
    m = F.avg("knowledge_gap")
    out = gl.groupBy(key).agg((F.round(m, decimals) if decimals is not None else m).alias("mean_knowledge_gap"))
    return out.orderBy(F.desc_nulls_last("mean_knowledge_gap"), key)


def country_order(gl: DataFrame, decimals: int | None = None) -> DataFrame:
    """Countries by mean knowledge gap, descending."""
    return _order_by_mean(gl, "country", decimals)


def model_order(gl: DataFrame, decimals: int | None = None) -> DataFrame:
    """Models by mean knowledge gap, descending."""
    return _order_by_mean(gl, "model", decimals)


def gap_extent(gl: DataFrame) -> DataFrame:
    """Axis limits of the scatter plus one min/max over all gap cells."""
    least = F.least(*[F.col(g) for g in GAPS])       # least/greatest skip nulls
    most = F.greatest(*[F.col(g) for g in GAPS])
    return gl.agg(F.min("global_gap").alias("min_global_gap"), F.max("global_gap").alias("max_global_gap"),
                  F.min("local_gap").alias("min_local_gap"), F.max("local_gap").alias("max_local_gap"),
                  F.min(least).alias("min_all_gaps"), F.max(most).alias("max_all_gaps"))


def locale_centroid(gl: DataFrame, decimals: int | None = None) -> DataFrame:
    """Mean (global_gap, local_gap) per locale."""
    out = gl.groupBy("locale").agg(F.avg("global_gap").alias("global_gap"), F.avg("local_gap").alias("local_gap"))
    if decimals is not None:
        out = out.withColumns({c: F.round(c, decimals) for c in ("global_gap", "local_gap")})
    return out


def row_mean(gl: DataFrame, col: str = "knowledge_gap", decimals: int | None = None) -> DataFrame:
    """Per-model mean over its locale cells, missing skipped."""
    m = F.avg(col)
    return gl.groupBy("model", "country").agg(
        (F.round(m, decimals) if decimals is not None else m).alias(f"mean_{col}"))


def distinct_countries(df: DataFrame, order_col: str) -> DataFrame:
    """Distinct countries with their first-appearance position."""
    return (df.groupBy("country").agg(F.min(order_col).alias("first_pos"))
            .orderBy("first_pos", "country"))


def gap_box_stats(gl: DataFrame, col: str = "knowledge_gap") -> DataFrame:
    """Quartiles (linear interpolation), min, max, n per (locale, country).

    Exact order statistics by histogram narrowing: no task holds a group's values.
    """
    out = quantiles(gl, ["locale", "country"], col, {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return out.select("locale", "country", "n", "min", "q25", "median", "q75", "max")


# ---------------------------------------------------------------------------
# J10 home_locale_cells, J11 native_gaps
# ---------------------------------------------------------------------------

def home_locale_cells(gl: DataFrame, dim_home: DataFrame) -> DataFrame:
    """One row per (model, gap, locale) with ``is_home`` from the country map."""
    cells = gl.unpivot(["model", "country", "locale"], GAPS, "gap", "value")
    home = dim_home.select("country", "home_locale")
    out = cells.join(home, "country", "left")
    return out.select("model", "country", "locale", "gap", "value",
                      F.coalesce(F.col("home_locale") == F.col("locale"), F.lit(False)).alias("is_home"))


def native_gaps(gl: DataFrame, dim_native: DataFrame,
                default_locales: list[str] = DEFAULT_NATIVE_LOCALES) -> DataFrame:
    """Each model's gaps in its country's native locale(s).

    One-to-many: country -> array of locales (unmapped -> ``default_locales``),
    exploded, then a left join to the gap table so absent locales give nulls.
    """
    models = gl.select("model", "country").distinct()
    nat = dim_native.select("country", "native_locales")
    wanted = (models.join(nat, "country", "left")
              .select("model", "country",
                      F.explode(F.coalesce("native_locales", literal_array(default_locales))).alias("language")))
    g = gl.select("model", F.col("locale").alias("language"), *GAPS)
    return wanted.join(g, ["model", "language"], "left").select("model", "country", "language", *GAPS)
