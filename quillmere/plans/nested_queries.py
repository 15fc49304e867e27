"""Queries of problem 2 (deeply nested records)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.operators.shredding import entity_table, filled_objects, shred
from quillmere.session import load

_STEP = r"attachments\[(\d+)\]\.data\[(\d+)\]"


def _timeline_nodes(spark: SparkSession, base: str) -> DataFrame:
    return shred(load(spark, base, "timeline_records"), "source_record_id", ["data", "attachments"])


def _attachment_path(node):
    """``attachments[0].data[1].attachments[2].data[0]...`` -> ``0.1/2.0``."""
    firsts, seconds = F.regexp_extract_all(node, F.lit(_STEP), 1), F.regexp_extract_all(node, F.lit(_STEP), 2)
    return F.array_join(F.zip_with(firsts, seconds, lambda a, d: F.concat(a, F.lit("."), d)), "/")


def _details(spark: SparkSession, base: str) -> DataFrame:
    return shred(load(spark, base, "normalized_records"), "source_record_id", ["media_details"])


def _last(node):
    return F.regexp_extract(node, r"\[(\d+)\]$", 1)


def _above(path):
    """The path less its last step; nothing at the top."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit(""))


#: Nodes of the objects that are items.
_ITEMS = r"\.(?:media|external_context|place|exif_data\[\d+\])$|^data\[\d+\]$"


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    """Every filled object of the nested columns with its kind, path and parent path."""
    # A media object may carry exif lists of two kinds, whose elements share a path and count as one.
    one_list = lambda node: F.when(F.instr(node, "exif_data") > 0, F.replace(node, F.lit("video_metadata"), F.lit("photo_metadata"))).otherwise(node)
    found = filled_objects(_timeline_nodes(spark, base), one_list, _ITEMS)
    label = F.regexp_extract("node", r"\.(media|external_context|place)$", 1)
    kind = F.when(label != "", label).when(F.col("node").startswith("data["), F.lit("post")).otherwise(F.lit("exif"))
    found = found.select("record", kind.alias("item_kind"), _attachment_path(F.col("node")).alias("_path"), _last("node").alias("_last"))
    item_path = (
        F.when(F.col("item_kind") == "post", F.concat(F.lit("d"), F.col("_last")))
        .when(F.col("item_kind") == "exif", F.concat(F.col("_path"), F.lit("/e"), F.col("_last")))
        .otherwise(F.col("_path"))
    )
    found = found.select("record", "item_kind", item_path.alias("item_path"))
    found = found.select("record", "item_kind", "item_path", _above("item_path").alias("parent_path"))
    details = filled_objects(_details(spark, base))
    details = details.select("record", F.lit("media_detail").alias("item_kind"), F.concat(F.lit("m"), _last("node")).alias("item_path"), F.lit("").alias("parent_path"))
    return found.unionByName(details).withColumnRenamed("record", "source_record_id").select("source_record_id", "item_kind", "item_path", "parent_path")


def _attached(spark: SparkSession, base: str, label: str, fields: dict[str, str]) -> DataFrame:
    table = entity_table(_timeline_nodes(spark, base), label, fields, rf"\.{label}$").withColumn("item_path", _attachment_path(F.col("node")))
    return table.select(F.col("record").alias("source_record_id"), "item_path", _above("item_path").alias("parent_path"), *fields)


def p2_media(spark: SparkSession, base: str) -> DataFrame:
    """Entity table of the media objects, each with its record and the path of its parent object."""
    return _attached(spark, base, "media", {"uri": "string", "creation_timestamp": "bigint", "description": "string"})


def p2_external_context(spark: SparkSession, base: str) -> DataFrame:
    """Entity table of the linked pages, each with its record and the path of its parent object."""
    return _attached(spark, base, "external_context", {"url": "string", "name": "string", "source": "string"})


def p2_place(spark: SparkSession, base: str) -> DataFrame:
    """Entity table of the attached places, each with its record and the path of its parent object."""
    return _attached(spark, base, "place", {"name": "string", "location": "string", "id": "string"})


def p2_exif(spark: SparkSession, base: str) -> DataFrame:
    """Entity table of the exif elements, of photo and video lists, each with its record and the path of its media object."""
    fields = {"taken_timestamp": "bigint", "iso": "int", "camera_make": "string", "upload_timestamp": "bigint", "rotation": "int"}
    table = entity_table(_timeline_nodes(spark, base), "exif_data", fields, r"\.exif_data\[\d+\]$").withColumn("parent_path", _attachment_path(F.col("node")))
    of = F.when(F.instr("node", "video_metadata") > 0, "video").otherwise("photo")
    return table.select(F.col("record").alias("source_record_id"), F.concat("parent_path", F.lit("/e"), "ordinal").alias("item_path"), "parent_path", of.alias("list_kind"), *fields)


def p2_post(spark: SparkSession, base: str) -> DataFrame:
    """Entity table of the post objects, each with its record."""
    table = entity_table(shred(load(spark, base, "timeline_records"), "source_record_id", ["data"]), "data", {"post": "string"})
    return table.select(F.col("record").alias("source_record_id"), F.concat(F.lit("d"), "ordinal").alias("item_path"), F.lit("").alias("parent_path"), F.sha2("post", 256).alias("post_sha256"))


def p2_media_detail(spark: SparkSession, base: str) -> DataFrame:
    """Entity table of the media details, each with its record."""
    fields = {"normalized_reference": "string", "media_type": "string", "creation_timestamp": "bigint", "metadata_json": "string"}
    table = entity_table(_details(spark, base), "media_details", fields)
    return table.select(F.col("record").alias("source_record_id"), F.concat(F.lit("m"), "ordinal").alias("item_path"), F.lit("").alias("parent_path"), *fields)


_LEVELS = """
WITH t AS (SELECT DISTINCT source_record_id, data, attachments FROM timeline_records),
a1 AS (SELECT source_record_id, '' AS up, i - 1 AS a, j - 1 AS d, attachments[i].data[j] AS x
       FROM t, LATERAL (SELECT unnest(range(1, len(attachments) + 1)) AS i), LATERAL (SELECT unnest(range(1, len(attachments[i].data) + 1)) AS j)),
a2 AS (SELECT source_record_id, up || a || '.' || d || '/' AS up, i - 1 AS a, j - 1 AS d, x.attachments[i].data[j] AS x
       FROM a1, LATERAL (SELECT unnest(range(1, len(x.attachments) + 1)) AS i), LATERAL (SELECT unnest(range(1, len(x.attachments[i].data) + 1)) AS j)),
a3 AS (SELECT source_record_id, up || a || '.' || d || '/' AS up, i - 1 AS a, j - 1 AS d, x.attachments[i].data[j] AS x
       FROM a2, LATERAL (SELECT unnest(range(1, len(x.attachments) + 1)) AS i), LATERAL (SELECT unnest(range(1, len(x.attachments[i].data) + 1)) AS j)),
e AS (SELECT source_record_id, up || a || '.' || d AS path, rtrim(up, '/') AS parent, x.media AS media, x.external_context AS ec, x.place AS place FROM a1
      UNION ALL SELECT source_record_id, up || a || '.' || d, rtrim(up, '/'), x.media, x.external_context, x.place FROM a2
      UNION ALL SELECT source_record_id, up || a || '.' || d, rtrim(up, '/'), x.media, x.external_context, x.place FROM a3)
"""

P2_FOUND_SQL = (
    _LEVELS
    + """
SELECT source_record_id, 'media' AS item_kind, path AS item_path, parent AS parent_path FROM e
WHERE media.uri IS NOT NULL OR media.creation_timestamp IS NOT NULL OR media.description IS NOT NULL OR media.media_metadata IS NOT NULL
UNION ALL SELECT source_record_id, 'external_context', path, parent FROM e WHERE ec.url IS NOT NULL OR ec.name IS NOT NULL OR ec.source IS NOT NULL
UNION ALL SELECT source_record_id, 'place', path, parent FROM e WHERE place.name IS NOT NULL OR place.location IS NOT NULL OR place.id IS NOT NULL
UNION ALL SELECT DISTINCT source_record_id, 'exif', path || '/e' || (k - 1), path
  FROM (SELECT *, media.media_metadata.photo_metadata.exif_data AS q FROM e), LATERAL (SELECT unnest(range(1, len(q) + 1)) AS k)
  WHERE q[k].taken_timestamp IS NOT NULL OR q[k].iso IS NOT NULL OR q[k].camera_make IS NOT NULL
UNION ALL SELECT DISTINCT source_record_id, 'exif', path || '/e' || (k - 1), path
  FROM (SELECT *, media.media_metadata.video_metadata.exif_data AS q FROM e), LATERAL (SELECT unnest(range(1, len(q) + 1)) AS k)
  WHERE q[k].upload_timestamp IS NOT NULL OR q[k].rotation IS NOT NULL
UNION ALL SELECT source_record_id, 'post', 'd' || (i - 1), '' FROM t, LATERAL (SELECT unnest(range(1, len(data) + 1)) AS i) WHERE data[i].post IS NOT NULL
UNION ALL SELECT source_record_id, 'media_detail', 'm' || (i - 1), ''
  FROM (SELECT DISTINCT source_record_id, media_details AS q FROM normalized_records), LATERAL (SELECT unnest(range(1, len(q) + 1)) AS i)
  WHERE q[i].normalized_reference IS NOT NULL OR q[i].media_type IS NOT NULL OR q[i].creation_timestamp IS NOT NULL OR q[i].metadata_json IS NOT NULL
"""
)

P2_MEDIA_SQL = _LEVELS + "SELECT source_record_id, path AS item_path, parent AS parent_path, media.uri AS uri, media.creation_timestamp AS creation_timestamp, media.description AS description FROM e WHERE media IS NOT NULL"
P2_CONTEXT_SQL = _LEVELS + "SELECT source_record_id, path AS item_path, parent AS parent_path, ec.url AS url, ec.name AS name, ec.source AS source FROM e WHERE ec IS NOT NULL"
P2_PLACE_SQL = _LEVELS + "SELECT source_record_id, path AS item_path, parent AS parent_path, place.name AS name, place.location AS location, place.id AS id FROM e WHERE place IS NOT NULL"
P2_EXIF_SQL = (
    _LEVELS
    + """
SELECT source_record_id, path || '/e' || (k - 1) AS item_path, path AS parent_path, 'photo' AS list_kind, q[k].taken_timestamp AS taken_timestamp, q[k].iso AS iso, q[k].camera_make AS camera_make,
  CAST(NULL AS BIGINT) AS upload_timestamp, CAST(NULL AS INTEGER) AS rotation
  FROM (SELECT *, media.media_metadata.photo_metadata.exif_data AS q FROM e), LATERAL (SELECT unnest(range(1, len(q) + 1)) AS k) WHERE q[k] IS NOT NULL
UNION ALL SELECT source_record_id, path || '/e' || (k - 1), path, 'video', NULL, NULL, NULL, q[k].upload_timestamp, q[k].rotation
  FROM (SELECT *, media.media_metadata.video_metadata.exif_data AS q FROM e), LATERAL (SELECT unnest(range(1, len(q) + 1)) AS k) WHERE q[k] IS NOT NULL
"""
)
P2_POST_SQL = """
SELECT source_record_id, 'd' || (i - 1) AS item_path, '' AS parent_path, sha256(data[i].post) AS post_sha256
FROM (SELECT DISTINCT source_record_id, data FROM timeline_records), LATERAL (SELECT unnest(range(1, len(data) + 1)) AS i) WHERE data[i] IS NOT NULL
"""
P2_DETAIL_SQL = """
SELECT source_record_id, 'm' || (i - 1) AS item_path, '' AS parent_path, q[i].normalized_reference AS normalized_reference, q[i].media_type AS media_type, q[i].creation_timestamp AS creation_timestamp, q[i].metadata_json AS metadata_json
FROM (SELECT DISTINCT source_record_id, media_details AS q FROM normalized_records), LATERAL (SELECT unnest(range(1, len(q) + 1)) AS i) WHERE q[i] IS NOT NULL
"""

QUERIES = {f.__name__: f for f in (p2_found, p2_media, p2_external_context, p2_place, p2_exif, p2_post, p2_media_detail)}
ORACLE = {
    "p2_found": P2_FOUND_SQL, "p2_media": P2_MEDIA_SQL, "p2_external_context": P2_CONTEXT_SQL, "p2_place": P2_PLACE_SQL,
    "p2_exif": P2_EXIF_SQL, "p2_post": P2_POST_SQL, "p2_media_detail": P2_DETAIL_SQL,
}
