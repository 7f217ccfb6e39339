"""Positions in a total order without pulling a group (or everything) into one task.

``row_number()`` over a window without ``partitionBy`` sorts the whole input in a
single task, and over ``partitionBy(g)`` it sorts each group in one task, which breaks
when one group holds a third of the rows. ``rank_rows`` range-partitions on
``(group, order)``, numbers rows inside each sorted partition, and adds the count of
same-group rows in earlier partitions. The offsets table has one row per (group,
partition) pair present, i.e. at most ``partitions + groups`` rows; the join to it is
left to AQE (broadcast when its measured size is small).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LOCAL_BITS = 33   # monotonically_increasing_id = partition index << 33 | row in partition


def rank_rows(df: DataFrame, order_by: Sequence[Column], partition_by: Sequence[str] = (),
              rank_col: str = "rank", num_partitions: int | None = None) -> DataFrame:
    """Add a 1-based ``rank_col``: position of the row in ``order_by`` within its
    ``partition_by`` group. ``order_by`` must be a total order (end with a unique key)
    for the numbering to be deterministic.

    The numbered rows are read twice (counts and the final join), and two independently
    planned range shuffles may sample different bounds, so they are written once to the
    shared checkpoint folder; this runs the input's plan while the query is built. Pass
    the key and order columns only and join wide columns back on the key."""
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in partition_by] + list(order_by)
    tagged = (df.repartitionByRange(n, *keys)
                .sortWithinPartitions(*keys)
                .withColumn("_rid", F.monotonically_increasing_id())
                .withColumn("_pid", F.shiftright("_rid", _LOCAL_BITS))
                .withColumn("_loc", F.col("_rid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)))
                .checkpoint(eager=True))
    counts = tagged.groupBy(*partition_by, "_pid").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_loc").alias("_lo"))
    w = Window.partitionBy(*partition_by).orderBy("_pid") if partition_by else Window.orderBy("_pid")
    offsets = counts.withColumn(
        "_off", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    o = offsets.select(*[F.col(c).alias(f"_g_{c}") for c in partition_by],
                       F.col("_pid").alias("_opid"), "_off", "_lo")
    cond = [F.col("_pid") == F.col("_opid")] + [F.col(c).eqNullSafe(F.col(f"_g_{c}"))
                                                  for c in partition_by]
    joined = tagged.join(o, on=cond, how="inner")
    return joined.select(*[F.col(c) for c in df.columns],
                         (F.col("_off") + F.col("_loc") - F.col("_lo") + 1).alias(rank_col))
