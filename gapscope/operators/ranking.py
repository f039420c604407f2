"""Sort, rank and top-k (K-series).

Per-group top-k uses ``row_number() <= k`` so Catalyst plans a
``WindowGroupLimit`` before the shuffle: each map task forwards at most k
rows per group, so a hot group costs k rows of shuffle, not its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def extreme_models(gl: DataFrame, k: int = 3, col: str = "knowledge_gap") -> DataFrame:
    """K1: per locale the k largest and k smallest ``col`` (nulls excluded).

    A model in both lists appears once; ties are broken by model id.
    """
    g = gl.where(F.col(col).isNotNull())
    top = (g.withColumn("_r", F.row_number().over(
        Window.partitionBy("locale").orderBy(F.desc(col), "model"))).where(F.col("_r") <= k)
        .select("locale", "model", "country", col, F.lit(True).alias("is_top")))
    bottom = (g.withColumn("_r", F.row_number().over(
        Window.partitionBy("locale").orderBy(F.asc(col), "model"))).where(F.col("_r") <= k)
        .select("locale", "model", "country", col, F.lit(False).alias("is_top")))
    both = top.unionByName(bottom)
    # dedupe by (locale, model), top first: at most 2k rows per locale
    return (both.groupBy("locale", "model", "country", col)
            .agg(F.max("is_top").alias("is_top"), F.min("is_top").alias("_b"))
            .select("locale", "model", "country", col, "is_top",
                    (~F.col("_b") | ~F.col("is_top")).alias("is_bottom")))


def rank_in_locale(selection: DataFrame, col: str = "knowledge_gap") -> DataFrame:
    """K2: rank (method 'first', descending) within locale; sort locale, value desc."""
    w = Window.partitionBy("locale").orderBy(F.desc(col), "model")
    return selection.withColumn("rank_key", F.row_number().over(w)).orderBy("locale", F.desc(col), "model")


def sorted_heatmap(gl: DataFrame, locales: list[str], col: str = "knowledge_gap") -> DataFrame:
    """K4: model x locale matrix of ``col`` with the row mean; country asc, mean desc."""
    wide = (gl.groupBy("model", "country").pivot("locale", locales).agg(F.first(col)))
    mean = F.aggregate(F.array(*[F.col(loc) for loc in locales]),
                       F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")),
                       lambda acc, x: F.when(x.isNull(), acc).otherwise(
                           F.struct((acc["s"] + x).alias("s"), (acc["n"] + 1).alias("n"))),
                       lambda acc: F.when(acc["n"] > 0, acc["s"] / acc["n"]))
    return wide.withColumn("kg_mean", mean).orderBy("country", F.desc_nulls_last("kg_mean"), "model")


def sort_models(df: DataFrame) -> DataFrame:
    """K5: order by country, model."""
    return df.orderBy("country", "model")


def worst_cells(rates: DataFrame, n: int = 15, rate_col: str = "top1_is_letter_rate") -> DataFrame:
    """The n lowest (model, subset) cells by ``rate_col``: a global top-n, no full sort."""
    return rates.orderBy(F.asc(rate_col), "model", "subset").limit(n).select("model", "subset", rate_col)


def worst_cases(rates: DataFrame, records: DataFrame, n: int = 15, per_cell: int = 3,
                tokens: int = 5, rate_col: str = "top1_is_letter_rate") -> DataFrame:
    """K3: the n lowest (model, subset) cells by ``rate_col``; for each, the first
    ``per_cell`` records whose top-1 token is not a letter, with their top tokens.

    The n cells come from a global top-n (TakeOrdered, n rows to the driver
    plan, no full sort); records are joined to them so only those cells' rows reach the
    per-cell window.  A caller whose records are costly to score joins them to
    ``worst_cells`` before scoring and goes on with ``worst_records``.
    """
    return worst_records(records.join(F.broadcast(worst_cells(rates, n, rate_col)), ["model", "subset"]), per_cell, tokens, rate_col)


def worst_records(records: DataFrame, per_cell: int = 3, tokens: int = 5, rate_col: str = "top1_is_letter_rate") -> DataFrame:
    """The second half of K3: of scored records of the worst cells (with ``rate_col``), the first ``per_cell`` a cell."""
    recs = records.where(~F.col("top1_is_letter"))
    w = Window.partitionBy("model", "subset").orderBy("pos")
    recs = recs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_cell)
    return (recs.select("model", "subset", rate_col, "pos",
                        F.posexplode(F.slice("top_tokens", 1, tokens)).alias("_i", "tok"))
            .select("model", "subset", rate_col, "pos", (F.col("_i") + 1).alias("rank"),
                    F.col("tok.token_id").alias("token_id"), F.col("tok.log_prob").alias("log_prob")))
