"""Shredding of deeply nested records into an adjacency table and flat entity tables.

Every value of a nested column becomes one row ``(record, node, parent, label, ordinal, kind, scalar)``: the node is
named by its path from the record, the parent by the path less its last step. The expressions are generated from the
schema, so that the walk runs inside the JVM and one input row yields its nodes without a shuffle. Entity tables are
pivoted from the adjacency table by joining each object node with its scalar children; that is a grouping by
``(record, object)`` with map-side combining, because all nodes of a record leave the same task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE_TYPE = "array<struct<node:string,parent:string,label:string,ordinal:int,kind:string,scalar:string>>"


def _entry(node: Column, parent: Column, label: Column, ordinal: Column, kind: str, scalar: Column) -> Column:
    return F.struct(
        node.alias("node"), parent.alias("parent"), label.alias("label"), ordinal.cast("int").alias("ordinal"),
        F.lit(kind).alias("kind"), scalar.cast("string").alias("scalar"),
    )


def _walk(value: Column, dtype: T.DataType, node: Column, parent: Column, label: Column, ordinal: Column) -> Column:
    """Array of the nodes at and below ``value``; empty where it is null."""
    none = F.lit(None).cast("string")
    if isinstance(dtype, T.StructType):
        parts = [F.array(_entry(node, parent, label, ordinal, "object", none))]
        scalars = [f for f in dtype.fields if not isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))]
        nested = [f for f in dtype.fields if isinstance(f.dataType, (T.StructType, T.ArrayType))]
        if scalars:
            parts.append(
                F.filter(
                    F.array(*[_entry(F.concat(node, F.lit(f".{f.name}")), node, F.lit(f.name), F.lit(None), "scalar", value.getField(f.name)) for f in scalars]),
                    lambda e: e.getField("scalar").isNotNull(),
                )
            )
        parts += [_walk(value.getField(f.name), f.dataType, F.concat(node, F.lit(f".{f.name}")), node, F.lit(f.name), F.lit(None)) for f in nested]
        body = F.concat(*parts)
    elif isinstance(dtype, T.ArrayType):
        below = F.flatten(
            F.transform(
                value,
                lambda x, i: _walk(x, dtype.elementType, F.concat(node, F.lit("["), i.cast("string"), F.lit("]")), node, label, i),
            )
        )
        body = F.concat(F.array(_entry(node, parent, label, ordinal, "array", none)), below)
    else:
        body = F.array(_entry(node, parent, label, ordinal, "scalar", value))
    return F.when(value.isNull(), F.array().cast(NODE_TYPE)).otherwise(body)


def shred(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Adjacency table of the nested ``columns``: key, node, parent, label, ordinal, kind, scalar.

    Nulls (columns, elements, fields) leave no node, but ordinals count them. Empty arrays leave an ``array`` node, an
    object of nulls only an ``object`` node. Rows repeated under one key give repeated nodes; entity tables absorb
    them. Other columns, of whatever name, are ignored. Null keys are kept as null.
    """
    schema = df.schema
    lists = [_walk(F.col(f"`{c}`"), schema[c].dataType, F.lit(c), F.lit(""), F.lit(c), F.lit(None)) for c in columns]
    return df.select(F.col(f"`{key}`").alias("record"), F.inline(F.concat(*lists) if len(lists) > 1 else lists[0]))


def filled_objects(nodes: DataFrame, called: Callable[[Column], Column] | None = None, where: str | None = None) -> DataFrame:
    """The object nodes with at least one non-null child: record, node. Repeated nodes come out once.

    Joins object nodes with their children by grouping on ``(record, object)``; both buffers are booleans, so the
    grouping is a hash aggregation that combines before the shuffle, and what is shuffled is one row per object.
    ``called`` renames nodes before they are grouped (nodes of one name count as one), ``where`` is a pattern for the
    names of the objects asked for; both are applied before the shuffle.
    """
    as_object = F.struct(F.col("node").alias("node"), F.lit(True).alias("own"))
    as_child = F.struct(F.col("parent").alias("node"), F.lit(False).alias("own"))
    roles = F.when(F.col("kind") == "object", F.array(as_object, as_child)).otherwise(F.array(as_child))
    rows = nodes.select("record", F.inline(roles)).where(F.col("node") != "")
    if where is not None:
        rows = rows.where(F.col("node").rlike(where))
    return (
        rows.groupBy("record", (called(F.col("node")) if called else F.col("node")).alias("node"))
        .agg(F.max("own").alias("is_object"), F.max(~F.col("own")).alias("has_child"))
        .where("is_object AND has_child")
        .select("record", "node")
    )


def entity_table(nodes: DataFrame, label: str, fields: dict[str, str], where: str | None = None) -> DataFrame:
    """Entity table of the objects called ``label``: record, node, parent, ordinal and the typed ``fields`` (name -> type).

    Pivots scalar children over their object node by conditional aggregation with map-side combining. A scalar that
    doesn't fit its type becomes null. ``where`` is a pattern for the objects' nodes; what belongs to others is left out
    before the shuffle.
    """
    scalar = F.col("kind") == "scalar"
    rows = nodes.where(((F.col("kind") == "object") & (F.col("label") == label)) | (scalar & F.col("label").isin(*fields)))
    if where is not None:
        rows = rows.where(F.when(scalar, F.col("parent")).otherwise(F.col("node")).rlike(where))
    wide = rows.groupBy("record", F.when(scalar, F.col("parent")).otherwise(F.col("node")).alias("node")).agg(
        F.max(F.when(~scalar, F.col("parent"))).alias("parent"),
        F.max(F.when(~scalar, F.col("ordinal"))).alias("ordinal"),
        F.max(~scalar).alias("_is_object"),
        *[F.max(F.when(scalar & (F.col("label") == f), F.col("scalar"))).alias(f"f_{f}") for f in fields],
    )
    return wide.where("_is_object").select("record", "node", "parent", "ordinal", *[F.expr(f"try_cast(`f_{f}` AS {t})").alias(f) for f, t in fields.items()])
