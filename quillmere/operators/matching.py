"""Resolution of records to entities by a cascade of rules, set by set.

Every rule is a join on equal keys: overlaps are joins on exploded keys, and "exactly one candidate" is an aggregation
with two buffers, so a timestamp that a tenth of all records share never yields all pairs of its records. The strict
order of rules becomes a minimum over ranks. This is the one-pass cascade, in which a record doesn't take its entity out
of the others' reach; :mod:`quillmere.plans.inventory` runs the sequential one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.operators.windows import only_match
from quillmere.session import keep

RULES = ("M01", "M02", "M03", "M04", "M05", "M06", "M07", "M08", "M09")


def by_key(records: DataFrame, entities: DataFrame, keys: list[str]) -> DataFrame:
    """Records and the entity of their key (the smallest, if several have it): record, entity. Null keys match nothing."""
    owner = entities.groupBy(*keys).agg(F.min("entity").alias("entity"))
    return records.select("record", *keys).join(owner, keys).select("record", "entity")


def by_overlap(records: DataFrame, entities: DataFrame, keys: str) -> DataFrame:
    """Records and their only entity of the same time that shares an element of the array ``keys``: record, entity."""
    left = records.select("record", "ts", F.explode(F.array_distinct(keys)).alias("key"))
    right = entities.select("entity", "ts", F.explode(F.array_distinct(keys)).alias("key"))
    # Per (time, key) no more than two entities need to be known to tell one from several.
    ends = right.groupBy("ts", "key").agg(F.min("entity").alias("low"), F.max("entity").alias("high"))
    pairs = left.join(ends, ["ts", "key"]).select("record", F.explode(F.array("low", "high")).alias("entity"))
    return only_match(pairs, "record", "entity")


def sole(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The keys that one row alone has, and that row's ``name``. Combines on the map side, so a key that many share costs nothing."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(name).alias(name)).where("n = 1").drop("n")


def by_text(records: DataFrame, entities: DataFrame) -> DataFrame:
    """Records and their only entity of the same time and text, where no other record of the run has both: record, entity."""
    ends = entities.where("text <> ''").groupBy("ts", "text").agg(F.min("entity").alias("low"), F.max("entity").alias("high")).where("low = high")
    return sole(records.where("text <> ''"), ["ts", "text"], "record").join(ends, ["ts", "text"]).select("record", F.col("low").alias("entity"))


def by_time(records: DataFrame, entities: DataFrame) -> DataFrame:
    """Records and the only entity of their time, where no other record of the run has it and no evidence contradicts."""
    ends = entities.groupBy("ts").agg(F.min("entity").alias("entity"), F.max("entity").alias("_high")).where("entity = _high").select("ts", "entity")
    pairs = sole(records, ["ts"], "record").join(ends, "ts").join(records.select("record", "media", "urls"), "record")
    pairs = pairs.join(entities.select("entity", F.col("media").alias("_media"), F.col("urls").alias("_urls")), "entity")

    def contradicts(a: str, b: str):
        return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)

    return pairs.where(~(contradicts("media", "_media") | contradicts("urls", "_urls"))).select("record", "entity")


def time_counts(records: DataFrame) -> DataFrame:
    """Records of the run per time: ts, n."""
    return records.groupBy("ts").agg(F.count("*").alias("n"))


def time_text_counts(records: DataFrame) -> DataFrame:
    """Records of the run per time and text, empty texts aside: ts, text, n."""
    return records.where("text <> ''").groupBy("ts", "text").agg(F.count("*").alias("n"))


def cascade(records: DataFrame, entities: DataFrame) -> DataFrame:
    """Best rule of every record: record, rule, rank, entity.

    ``records``: record, authoritative, id, url, fp, slot, ts, text, media, urls; ``entities``: the same with entity in
    place of record. Arrays must not be null. Records no rule matches are created (M08) or, if not authoritative,
    skipped (M09). Both are read by every rule, so they are written once.
    """
    records, entities = keep(records), keep(entities)
    hits = [
        by_key(records, entities, ["id"]),
        by_key(records, entities, ["url"]),
        by_key(records, entities, ["fp", "slot"]),
        by_overlap(records, entities, "media"),
        by_overlap(records, entities, "urls"),
        by_text(records, entities),
        by_time(records, entities),
    ]
    union = None
    for rank, hit in enumerate(hits, 1):
        part = hit.select("record", F.lit(rank).alias("rank"), "entity")
        union = part if union is None else union.unionByName(part)
    best = union.groupBy("record").agg(F.min(F.struct("rank", "entity")).alias("best"))
    joined = records.select("record", "authoritative").join(best, "record", "left")
    rank = F.coalesce(F.col("best.rank"), F.when(F.col("authoritative"), 8).otherwise(9))
    return joined.select("record", F.format_string("M%02d", rank).alias("rule"), rank.alias("rank"), F.col("best.entity").alias("entity"))
