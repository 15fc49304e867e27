"""Inserts, updates and assertions as joins: the tables are immutable, each operator gives the new snapshot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert_or_ignore(target: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """Target and the first incoming row of each key that target lacks.

    Rows with a null in the keys are never equal to anything and are all kept, as in a unique index.
    """
    columns = target.columns
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    chosen = incoming.where(known).groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("row")).select("row.*")
    fresh = chosen.join(target.select(*keys), keys, "left_anti").select(*columns)
    return target.unionByName(fresh).unionByName(incoming.where(~known).select(*columns))


def conditional_update(target: DataFrame, updates: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Target with ``columns`` from ``updates`` (unique per key) where any differs, nulls included; ``updated`` tells which."""
    renamed = updates.select(*keys, *[F.col(c).alias(f"new_{c}") for c in columns], F.lit(True).alias("_hit"))
    joined = target.join(renamed, keys, "left")
    differs = F.coalesce(F.col("_hit"), F.lit(False)) & reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"new_{c}")) for c in columns])
    rest = [c for c in target.columns if c not in columns]
    return joined.select(*rest, *[F.when(differs, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in columns], differs.alias("updated"))


def identity_conflicts(records: DataFrame, keys: list[str], owner: str) -> DataFrame:
    """Keys that more than one owner claims: keys, owners. One aggregation instead of a self-join."""
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return records.where(known).groupBy(*keys).agg(F.count_distinct(owner).alias("owners")).where("owners > 1")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose reference has no parent; null references are no orphans."""
    return child.where(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys without nulls that occur more than once: keys, n."""
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return df.where(known).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows per check that break it: name, n. As in SQL, a check that is null holds. One pass, whatever the number of checks."""
    counted = df.agg(*[F.count_if(~F.coalesce(c, F.lit(True))).alias(name) for name, c in checks.items()])
    pairs = F.array(*[F.struct(F.lit(name).alias("name"), F.col(name).alias("n")) for name in checks])
    return counted.select(F.inline(pairs))


def touch(target: DataFrame, seen: DataFrame, keys: list[str], first: str, last: str) -> DataFrame:
    """Target with the times at which its keys were first and last seen, after one more look.

    ``target``: keys, ``first``, ``last``; ``seen``: keys, ``at`` (a key may come often). A key that target lacks is
    added; of a known one ``last`` moves on, never back. Rows with a null in the keys are left out of ``seen``.
    """
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    looked = seen.where(known).groupBy(*keys).agg(F.min("at").alias("_first"), F.max("at").alias("_last"))
    rest = [c for c in target.columns if c not in (*keys, first, last)]
    joined = target.join(looked, keys, "full")
    return joined.select(*keys, *rest, F.coalesce(first, "_first").alias(first), F.greatest(last, "_last").alias(last)).select(*target.columns)
