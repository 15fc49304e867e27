"""Duplicates hidden by formatting differences.

Records are canonicalized field by field (case, white space, invisible characters, punctuation, order of array
elements and of URL parameters), hashed to 128 bits and counted with map-side combining. A second, independent 64-bit
hash travels with the first; hashes that disagree on it are collisions, and both hashes together are the group key, so
a collision of the first splits into its true groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.session import cut, skew_safe_lookup

#: White space, separators, punctuation, control and format characters, and the marks and fillers that have no width.
DISREGARDED = r"[\s\p{Z}\p{P}\p{Cc}\p{Cf}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{3164}\x{FFA0}\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}]+"
_UNIT, _RECORD = "\u0001", "\u0002"


def caseless(text: Column) -> Column:
    """Text without letter case; upper before lower case, and the sharp s as its capitals are written."""
    return F.replace(F.lower(F.upper(text)), F.lit("ß"), F.lit("ss"))


def canonical_text(text: Column) -> Column:
    """Text without case, white space, invisible characters and punctuation; null counts as empty."""
    return caseless(F.regexp_replace(F.coalesce(text, F.lit("")), DISREGARDED, ""))


def canonical_list(values: Column) -> Column:
    """Canonical elements in sorted order, as one string; a null list counts as empty, null elements as empty text."""
    return F.array_join(F.array_sort(F.transform(F.coalesce(values, F.array().cast("array<string>")), canonical_text)), _UNIT)


def canonical_url(url: Column) -> Column:
    """Canonical address with its parameters in sorted order."""
    url = F.coalesce(url, F.lit(""))
    front = F.substring_index(url, "#", 1)
    base = F.substring_index(front, "?", 1)
    query, fragment = F.substring(front, F.length(base) + 2, F.length(front)), F.substring(url, F.length(front) + 2, F.length(url))
    params = F.array_join(F.array_sort(F.filter(F.transform(F.split(query, "[&;]"), canonical_text), lambda p: p != "")), "&")
    # A question mark with nothing behind it is mere punctuation.
    return F.when((F.instr(url, "?") == 0) | (params == ""), canonical_text(url)).otherwise(F.concat_ws("?", canonical_text(base), params, canonical_text(fragment)))


def canonical_urls(urls: Column) -> Column:
    """Canonical addresses in sorted order, as one string."""
    return F.array_join(F.array_sort(F.transform(F.coalesce(urls, F.array().cast("array<string>")), canonical_url)), _UNIT)


def canonical_keys(df: DataFrame, key: str, texts: list[str], lists: list[str] = (), urls: list[str] = ()) -> DataFrame:
    """Key and hashes of every distinct record: record, h128, h64.

    Records whose fields are all empty are left out. Rows repeated under one key count once (identical rows have
    identical hashes; if rows of one key differ, the smallest hash stands). Rows with a null key are left out.
    """
    parts = [canonical_text(F.col(f"`{c}`")) for c in texts] + [canonical_list(F.col(f"`{c}`")) for c in lists] + [canonical_urls(F.col(f"`{c}`")) for c in urls]
    canon = F.concat_ws(_RECORD, *parts)
    hashed = (
        df.select(F.col(f"`{key}`").alias("record"), canon.alias("canon"))
        .where(F.col("record").isNotNull() & (F.translate("canon", _UNIT + _RECORD, "") != ""))
        .select("record", F.md5("canon").alias("h128"), F.xxhash64("canon").alias("h64"))
    )
    return hashed.groupBy("record").agg(F.min(F.struct("h128", "h64")).alias("h")).select("record", "h.h128", "h.h64")


def collapse(keys: DataFrame) -> DataFrame:
    """One row per group of like records: h128, h64, keep (the smallest key), copies, collided.

    ``collided`` tells that another group shares the 128-bit hash. Counts combine on the map side, so a group of any
    size reaches the reducers as one row per map task.
    """
    groups = keys.groupBy("h128", "h64").agg(F.min("record").alias("keep"), F.count("*").alias("copies"))
    rivals = groups.groupBy("h128").agg(F.count("*").alias("_n")).where("_n > 1").select("h128", F.lit(True).alias("collided"))
    return groups.join(rivals, "h128", "left").withColumn("collided", F.coalesce("collided", F.lit(False)))


def duplicates(keys: DataFrame, hot_rows: int = 200_000) -> DataFrame:
    """Membership: keep, record for each record other than the smallest of its group."""
    groups = keys.groupBy("h128", "h64").agg(F.min("record").alias("keep"), F.count("*").alias("copies")).where("copies > 1")
    joined = skew_safe_lookup(keys, groups, ["h128", "h64"], "copies", "record", hot_rows)
    return joined.where("record <> keep").select("keep", "record")


def format_keys_of_records(records: DataFrame) -> DataFrame:
    """The hashes of normalized records over post text, media references and external addresses, kept in the shared folder."""
    return cut(canonical_keys(records, "source_record_id", ["normalized_post_text"], ["normalized_media_references"], ["normalized_external_urls"]))
