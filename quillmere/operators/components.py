"""Connected components of records that share keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.session import keep, skew_safe_lookup

#: Rounds of plain spreading before labels also jump.
JUMP_AFTER = 3
#: Rows of one key beyond which its label is spread over several tasks.
HOT_ROWS = 200_000


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 200, distinct: bool = False) -> DataFrame:
    """Component of every record: record, order, label, the smallest ``order`` of its component.

    ``nodes``: record, order (unique longs). ``edges``: record, key; a key joins its records, null keys join nothing.
    Labels spread over keys; after ``JUMP_AFTER`` rounds they also jump to the label of the record they name, so the
    rounds grow with the logarithm of the longest path. Keys of one record are dropped first; keys of any size spread
    their label through a salted lookup. ``distinct`` tells that the edges are a written table without repeats and nulls.
    ``max_rounds`` guards against a defect only: a path of 2^100 records would need fewer.
    """
    if not distinct:
        edges = keep(edges.where("key IS NOT NULL").distinct())
    sizes = edges.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    salts = F.greatest(F.ceil(F.col("size") / F.lit(HOT_ROWS)), F.lit(1)).cast("int")
    linked = skew_safe_lookup(edges, sizes, ["key"], "size", "record", HOT_ROWS)
    # Every row knows how large its key is, so the rounds need no list of hot keys.
    linked = keep(linked.select("key", "record", "size", F.pmod(F.xxhash64("record"), salts).cast("int").alias("salt")))
    labels = keep(nodes.join(linked.select("record").distinct(), "record").select("record", "order", F.col("order").alias("label")))
    changed = labels
    for done in range(max_rounds):
        # Only what changed in the round before can lower a key, and only lowered keys can change a record.
        lowest = linked.select("key", "record", "size").join(changed.select("record", "label"), "record").groupBy("key").agg(F.min("label").alias("low"), F.max("size").alias("size"))
        spread = lowest.select("key", "low", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
        best = linked.select("key", "record", "salt").join(spread, ["key", "salt"]).groupBy("record").agg(F.min("low").alias("low"))
        if done < JUMP_AFTER:
            changed = keep(labels.join(best, "record").where("low < label").select("record", F.col("low").alias("label")))
            if not changed.limit(1).count():
                break
            labels = keep(labels.join(changed.withColumnRenamed("label", "new"), "record", "left").select("record", "order", F.coalesce("new", "label").alias("label")))
            continue
        after = labels.join(best, "record", "left").select("record", "order", F.col("label").alias("old"), F.least("label", "low").alias("label"))
        jump = after.select(F.col("order").alias("label"), F.col("label").alias("further"))
        after = keep(after.join(jump, "label").select("record", "order", "old", F.least("label", "further").alias("label")))
        changed = after.where("label <> old").select("record", "label")
        labels = after.select("record", "order", "label")
        if not changed.limit(1).count():
            break
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(labels.select("record", "label"), "record", "left").select("record", "order", F.coalesce("label", "order").alias("label"))
