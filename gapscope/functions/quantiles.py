"""Exact order statistics of groups of any size by repeated histogram narrowing.

Every wanted position starts with its group's range of values.  A pass counts the values
within the range by ``BUCKETS`` buckets of equal width, with each bucket's least and
greatest value; the bucket that holds the position becomes the next range, from its least
to its greatest value.  As the least and the greatest value of a range fall into different
buckets, every pass narrows every open range, and a position is found when both ends are
equal.  A pass shuffles at most ``BUCKETS`` rows a position and task; no task holds the
values of a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapscope.session import reliable_checkpoint

BUCKETS = 1024


def order_statistics(values: DataFrame, groups: list[str], col: str, wanted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(groups, k, value): the k-th least value (from 0) of ``col`` for every (groups, k) of ``wanted``.

    ``values`` is read once a pass (write or checkpoint it); nulls and NaNs are no values.
    """
    x = values.select(*groups, F.col(col).cast("double").alias("_x")).where("_x is not null and not isnan(_x)")
    span = x.groupBy(*groups).agg(F.min("_x").alias("lo"), F.max("_x").alias("hi"))
    now = reliable_checkpoint(_meet(wanted.select(*groups, "k").distinct(), span, groups).withColumn("at", F.col("k")))
    found = now.where("lo = hi")
    while True:
        open_ = now.where("lo < hi")
        if open_.isEmpty():
            return found.select(*groups, "k", F.col("lo").alias("value"))
        rows = _meet(x, open_, groups).where("_x between lo and hi")
        # by halves where the width of a range passes the greatest double
        width = F.col("hi") - F.col("lo")
        share = F.when(width == float("inf"), (F.col("_x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)).otherwise(
            (F.col("_x") - F.col("lo")) / width)
        counts = rows.groupBy(*groups, "k", "at", F.least(F.floor(share * buckets), F.lit(buckets - 1)).alias("b")).agg(
            F.count(F.lit(1)).alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi"))
        up_to = F.sum("n").over(Window.partitionBy(*groups, "k").orderBy("b"))
        now = reliable_checkpoint(counts.withColumn("before", up_to - F.col("n")).where("before <= at and at < before + n").select(
            *groups, "k", "lo", "hi", (F.col("at") - F.col("before")).alias("at")))
        found = found.unionByName(now.where("lo = hi"))


def _meet(one: DataFrame, two: DataFrame, groups: list[str]) -> DataFrame:
    """Join on groups, nulls being a group of their own; columns of ``two`` beside the groups are added."""
    renamed = two.select(*[F.col(g).alias(f"_of_{n}") for n, g in enumerate(groups)], *[c for c in two.columns if c not in groups])
    on = [one[g].eqNullSafe(renamed[f"_of_{n}"]) for n, g in enumerate(groups)] or [F.lit(True)]
    return one.join(renamed, on).drop(*[f"_of_{n}" for n in range(len(groups))])


def quantiles(values: DataFrame, groups: list[str], col: str, shares: dict[str, float]) -> DataFrame:
    """(groups, n, min, one column for each of ``shares``, max): linear interpolation between neighbours."""
    kept = reliable_checkpoint(values.select(*groups, F.col(col).cast("double").alias("_v")).where("_v is not null and not isnan(_v)"))
    sizes = reliable_checkpoint(kept.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("min"), F.max("_v").alias("max")))
    place = {name: F.lit(q) * (F.col("n") - 1) for name, q in shares.items()}
    ends = F.array(*[f(p).cast("long") for p in place.values() for f in (F.floor, F.ceil)])
    found = order_statistics(kept, groups, "_v", sizes.select(*groups, F.explode(ends).alias("k")))
    at = found.groupBy(*groups).agg(F.map_from_entries(F.collect_list(F.struct("k", "value"))).alias("at"))
    out = _meet(sizes, at, groups)

    def between(p):
        low, high = F.element_at("at", F.floor(p).cast("long")), F.element_at("at", F.ceil(p).cast("long"))
        return low + (high - low) * (p - F.floor(p))

    return out.select(*groups, "n", "min", *[between(p).alias(name) for name, p in place.items()], "max")
