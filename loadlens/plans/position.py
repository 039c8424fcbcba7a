"""Row positions over a whole table without sorting it in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadlens.sources.store import stored

# A generated row id holds the partition above this many bits.
_ROW_BITS = 33


def with_position(
    df: DataFrame, order_by: Sequence[str], group: Sequence[str] = (),
    position: str = "position", total: str = "total",
) -> DataFrame:
    """Add the 0-based position of each row in its group, and the group's row count.

    The table is range-partitioned on group and order, whose bounds Spark samples,
    so a hot group, hour or timestamp spreads over as many tasks as it needs as
    long as the order tells its rows apart.  The sorted rows are written once to the
    shared folder, each with its partition and place; that fixes the bounds for
    the counts and the rows alike.  Offsets are one row per partition and group.
    """
    keys = [*group, *order_by]
    placed = stored(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id() % (1 << _ROW_BITS)))
    counts = placed.groupBy("_part", *group).agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_row").alias("_first"))
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(counts.select(
        F.col("_part").alias("_p"), *[F.col(g).alias(f"_g_{g}") for g in group],
        (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(whole).alias(total)))
    same = [F.col("_part") == F.col("_p")] + [
        F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group]
    return (
        placed.join(offsets, same)
        .withColumn(position, F.col("_row") + F.col("_shift"))
        .drop("_part", "_row", "_p", "_shift", *[f"_g_{g}" for g in group])
    )
