"""Processing order: kind rank and a distributed total numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmere.session import cut

#: Order in which the kinds of source are processed (fixed values).
KIND_ORDER = ("timeline", "archive", "trash", "reel", "video_metadata", "photo_metadata", "album_metadata", "checkin_metadata", "sharing_link_metadata")


def kind_rank(kind: Column) -> Column:
    """Place of a source kind in the processing order; unknown kinds come last."""
    rank = F.lit(len(KIND_ORDER) - 1)
    for i, name in reversed(list(enumerate(KIND_ORDER))):
        rank = F.when(kind == name, i).otherwise(rank)
    return rank


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Numbers all rows from 1 in a total order, without gathering them in one task.

    Rows are range-partitioned and sorted; the offset of a partition is the number of rows before it, summed over one
    row per partition.
    """
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return placed.withColumn("_k", within).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + F.col("_k")).drop("_part", "_k", "_offset")
