"""Position within a group without putting the group in one task.

``row_number().over(Window.partitionBy(g).orderBy(o))`` hashes every row of a
group to one task; when one config holds a third of the data that task sorts
a third of the data.  ``index_within`` computes the same 0-based position from

1. a range repartition on (g, o) — a hot group is spread over many tasks,
   each holding a contiguous key range, sorted within the partition;
2. the row's offset inside its partition (``monotonically_increasing_id``
   minus the partition's base);
3. a tiny table of per-(group, partition) counts (at most partitions +
   groups rows) turned into running offsets with a window over *that* table;
4. a join of the rows to their (group, partition) offset.

The order columns must be a total order within the group (add a unique
tiebreaker).  The range-partitioned, locally numbered frame is written once
to the shared checkpoint folder and both the count table and the final join
read that copy: range bounds come from a sample whose input partitions AQE
may shape differently in two separate evaluations, so recomputing it per
branch could place a row in different partitions.  Pass only the columns
the caller needs (the copy is as wide as the input).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapscope.session import reliable_checkpoint


def index_within(df: DataFrame, group_cols: list[str], order_cols: list, name: str = "idx",
                 num_partitions: int | None = None) -> DataFrame:
    """Add ``name`` = 0-based position of each row within its group by order."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in group_cols] + [F.col(c) if isinstance(c, str) else c for c in order_cols]
    staged = reliable_checkpoint(
        df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_local", F.monotonically_increasing_id() - F.shiftleft(F.col("_pid").cast("long"), 33)))
    counts = staged.groupBy(*group_cols, "_pid").agg(F.min("_local").alias("_first"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    o = offsets.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group_cols)],
                       F.col("_pid").alias("_opid"), "_first", "_off")
    cond = [staged[c].eqNullSafe(o[f"_g{i}"]) for i, c in enumerate(group_cols)] + [staged["_pid"] == o["_opid"]]
    out = staged.join(o, cond)
    return out.withColumn(name, F.col("_off") + F.col("_local") - F.col("_first")).drop(
        "_pid", "_local", "_first", "_off", "_opid", *[f"_g{i}" for i in range(len(group_cols))])
