"""Global positions of rows in an order, without a single task for all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firnline.session import cut_lineage


def with_positions(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """``df`` with the position (long, from 0) of each row in the order of the columns ``order``; and ``n_rows``.

    Rows are dealt by range and sorted within their partition; the partitions'
    sizes give the offsets. The sorted rows are written to the shared folder
    first, so that the ranges are drawn once. ``order`` should end with columns
    that break ties, which also split a hot leading value over partitions.
    """
    placed = (df.repartitionByRange(*order).sortWithinPartitions(*order)
              .withColumn("_part", F.spark_partition_id())
              .withColumn("_seq", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    placed = cut_lineage(placed)
    # One row for each partition.
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    every = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(every), F.lit(0).cast("long")).alias("_offset"),
                           F.sum("_n").over(Window.partitionBy()).alias("n_rows"))
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + F.col("_seq")).drop("_part", "_seq", "_offset")
