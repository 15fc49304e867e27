"""Occurrence slots, cardinality tests, first and last values, change flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmere.session import cut


def occurrence_slots(df: DataFrame, keys: list[str], order: list[str], name: str = "occurrence") -> DataFrame:
    """Numbers the rows of each key from 1 in a total order. Rows with a null in the keys form a key of their own.

    A key of any size is spread over range partitions: rows are numbered within (partition, key), and the rows of a key
    in earlier partitions are added. A key goes on only from one partition to the next ones, so two keys and their
    counts per partition tell the offsets.
    """
    placed = cut(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    counts = placed.groupBy("_part", *keys).agg(F.count("*").alias("_n"))
    ends = counts.groupBy("_part").agg(F.min(F.struct(*keys, "_n")).alias("first"), F.max(F.struct(*keys, "_n")).alias("last")).collect()
    offsets, carried, seen = [], None, 0
    for row in sorted(ends, key=lambda r: r["_part"]):
        first, last = tuple(row.first[k] for k in keys), tuple(row.last[k] for k in keys)
        if first == carried:
            offsets.append((row["_part"], seen))
        seen = row.last["_n"] + (seen if first == last == carried else 0)
        carried = last
    within = F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order))
    numbered = placed.withColumn(name, within)
    if offsets:
        # The offset is for the first key of the partition alone.
        starts = {row["_part"]: tuple(row.first[k] for k in keys) for row in ends}
        schema = T.StructType([T.StructField("_part", T.IntegerType()), *[T.StructField(f"_start_{i}", df.schema[k].dataType) for i, k in enumerate(keys)], T.StructField("_offset", T.LongType())])
        table = df.sparkSession.createDataFrame([(part, *starts[part], offset) for part, offset in offsets], schema)
        goes_on = F.col("_offset").isNotNull()
        for i, k in enumerate(keys):
            goes_on = goes_on & F.col(k).eqNullSafe(F.col(f"_start_{i}"))
        numbered = numbered.join(F.broadcast(table), "_part", "left").withColumn(name, F.col(name) + F.when(goes_on, F.col("_offset")).otherwise(0))
    return numbered.select(*df.columns, name)


def free_slot(used: Column, preferred: Column) -> Column:
    """The preferred slot if it is free, else the lowest free one. ``used``: array of taken slots."""
    lowest = F.element_at(F.array_except(F.sequence(F.lit(1), F.size(used) + 1), used), 1)
    return F.when(F.array_contains(used, preferred), lowest).otherwise(preferred)


def used_slots(df: DataFrame, keys: list[str], slot: str) -> DataFrame:
    """Taken slots of each key, in order: keys, used. Slots are distinct within a key, so the list is as long as the key has rows."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_set(slot)).alias("used"))


def only_match(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """The pairs whose left side has exactly one partner. ``pairs`` may repeat a pair. An aggregation with two buffers per left side."""
    ends = pairs.groupBy(left).agg(F.min(right).alias(right), F.max(right).alias("_max"))
    return ends.where(F.col(right) == F.col("_max")).select(left, right)


def first_known(column: Column | str, order: Column | str) -> Column:
    """Aggregate: the earliest value that is not null."""
    column = F.col(column) if isinstance(column, str) else column
    return F.min_by(column, F.when(column.isNotNull(), F.col(order) if isinstance(order, str) else order))


def last_known(column: Column | str, order: Column | str) -> Column:
    """Aggregate: the latest value that is not null."""
    column = F.col(column) if isinstance(column, str) else column
    return F.max_by(column, F.when(column.isNotNull(), F.col(order) if isinstance(order, str) else order))


def changed_from_previous(columns: list[str], keys: list[str], order: list[Column | str]) -> Column:
    """Whether any column differs, nulls included, from the row before it of the same key; true for the first."""
    window = Window.partitionBy(*keys).orderBy(*order)
    differs = F.row_number().over(window) == 1
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.lag(c).over(window))
    return differs
