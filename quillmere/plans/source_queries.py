"""Queries that run the shipped readers, normalizers and import steps over the driver's tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.plans import inventory
from quillmere.plans.nested_queries import _LEVELS
from quillmere.session import load
from quillmere.sources import discovery
from quillmere.sources.records import NORMALIZERS, FileError, RecordError, file_records

# --- discovery -------------------------------------------------------------------------------------------------------


def _files(spark: SparkSession, base: str) -> DataFrame:
    files = load(spark, base, "source_files").dropDuplicates(["source_file_id"])
    return files.select("source_file_id", F.col("import_run_id").alias("collection"), F.col("export_root_number").alias("root_number"), "relative_path", F.col("source_kind").alias("kind"), "size_bytes", "sha256")


_SEQUENCE_SQL = r"CASE WHEN {0} IN ('timeline', 'album_metadata') THEN coalesce(try_cast(nullif(regexp_extract(relative_path, '(?:^|/|_)([0-9]+)\.json$', 1), '') AS BIGINT), 9007199254740991) ELSE 9007199254740991 END"
_KIND_RANK_SQL = """CASE {0} WHEN 'timeline' THEN 0 WHEN 'archive' THEN 1 WHEN 'trash' THEN 2 WHEN 'reel' THEN 3 WHEN 'video_metadata' THEN 4 WHEN 'photo_metadata' THEN 5
  WHEN 'album_metadata' THEN 6 WHEN 'checkin_metadata' THEN 7 ELSE 8 END"""


def numbered_files(spark: SparkSession, base: str) -> DataFrame:
    """The number in the name of every file, or the last place for files without one."""
    return _files(spark, base).select("source_file_id", discovery.sequence_of(F.col("relative_path"), F.col("kind")).alias("sequence"))


NUMBERED_FILES_SQL = f"SELECT DISTINCT source_file_id, {_SEQUENCE_SQL.format('source_kind')} AS sequence FROM source_files"


def file_order(spark: SparkSession, base: str) -> DataFrame:
    """The place of every file in the processing order of its run."""
    return discovery.in_order(_files(spark, base)).select("source_file_id", F.col("place").cast("long").alias("place"))


FILE_ORDER_SQL = f"""SELECT source_file_id, row_number() OVER (PARTITION BY import_run_id ORDER BY {_KIND_RANK_SQL.format("source_kind")}, {_SEQUENCE_SQL.format("source_kind")}, export_root_number, relative_path) AS place
FROM (SELECT DISTINCT source_file_id, import_run_id, export_root_number, relative_path, source_kind FROM source_files)"""


def collection_fingerprint(spark: SparkSession, base: str) -> DataFrame:
    """The fingerprint of every run's files."""
    files = _files(spark, base).withColumn("sequence", discovery.sequence_of(F.col("relative_path"), F.col("kind")))
    return discovery.collection_fingerprints(files).withColumnRenamed("collection", "import_run_id")


COLLECTION_FINGERPRINT_SQL = f"""
WITH f AS (SELECT DISTINCT source_file_id, import_run_id, export_root_number, relative_path, source_kind, {_SEQUENCE_SQL.format("source_kind")} AS sequence, size_bytes, sha256 FROM source_files),
d AS (SELECT *, '{{"relativePath":"' || relative_path || '","sourceKind":"' || source_kind || '","sequence":' || sequence || ',"sizeBytes":' || size_bytes || ',"sha256":"' || sha256 || '"}}' AS j FROM f),
r AS (SELECT import_run_id, export_root_number, '[' || string_agg(j, ',' ORDER BY relative_path, sha256) || ']' AS files FROM d GROUP BY 1, 2),
h AS (SELECT *, sha256(files) AS root FROM r)
SELECT import_run_id, sha256('{{"fingerprintVersion":1,"rootCount":' || count(*) || ',"roots":[' || string_agg('{{"rootFingerprint":"' || root || '","files":' || files || '}}', ',' ORDER BY root, export_root_number) || ']}}') AS fingerprint
FROM h GROUP BY 1"""

# --- readers ---------------------------------------------------------------------------------------------------------


def file_reading(spark: SparkSession, base: str) -> DataFrame:
    """Every reel and video file as its reader sees it: the code of the failure, or none, and the records of whole files."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, kind, content in zip(batch["export_file_id"], batch["source_kind"], batch["content"]):
                try:
                    rows.append((name, None, sum(1 for _ in file_records(content.encode(), kind, ""))))
                except FileError as e:
                    rows.append((name, e.code, None))
            yield pd.DataFrame(rows, columns=["export_file_id", "code", "records"]).astype({"records": "Int64"})

    files = load(spark, base, "export_files").select("export_file_id", "source_kind", F.coalesce("content", F.lit("")).alias("content")).dropDuplicates(["export_file_id"])
    return files.mapInPandas(read, "export_file_id long, code string, records long")


_WRAPPED = "CASE source_kind WHEN 'reel' THEN json_extract(j, '$.lasso_videos_v2') ELSE json_extract(j, '$.videos_v2') END"
_FILES_SQL = f"""
WITH f AS (SELECT DISTINCT export_file_id, source_kind, CASE WHEN json_valid(content) THEN content END AS j FROM export_files),
g AS (SELECT *, CASE json_type(j) WHEN 'ARRAY' THEN j WHEN 'OBJECT' THEN {_WRAPPED} END AS a FROM f),
r AS (SELECT export_file_id, source_kind, i - 1 AS record_index, json_extract(a, '$[' || (i - 1) || ']') AS e FROM g, LATERAL (SELECT unnest(range(1, CAST(json_array_length(a) AS BIGINT) + 1)) AS i) WHERE json_type(a) = 'ARRAY')
"""
FILE_READING_SQL = _FILES_SQL + """SELECT export_file_id, CASE WHEN j IS NULL THEN 'JSON_INVALID' WHEN json_type(a) = 'ARRAY' THEN NULL ELSE 'RECORD_UNSUPPORTED' END AS code,
  CASE WHEN json_type(a) = 'ARRAY' THEN CAST(json_array_length(a) AS BIGINT) END AS records FROM g"""

# --- normalizers -----------------------------------------------------------------------------------------------------

_NORMAL = "parse_status string, external_id string, created_timestamp long, post_type string, text_sha256 string, media_references array<string>"


def _normalized(rows: DataFrame, keys: str) -> DataFrame:
    """Rows (keys, kind, raw: a JSON text) through the normalizer of their kind."""
    names = [k.split()[0] for k in keys.split(", ")]

    def normalize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib
        import json

        for batch in batches:
            out = []
            for row in batch[[*names, "kind", "raw"]].itertuples(index=False):
                value = json.loads(row.raw)
                try:
                    n = NORMALIZERS[row.kind](value)
                    text = n["normalized_post_text"]
                    out.append((*row[: len(names)], "parsed", n["external_id"], n["created_timestamp"], n["post_type"], None if text is None else hashlib.sha256(text.encode()).hexdigest(), n["media_references"]))
                except RecordError:
                    out.append((*row[: len(names)], "partial" if isinstance(value, dict) else "unsupported", None, None, None, None, None))
            yield pd.DataFrame(out, columns=[*names, *[c.split()[0] for c in _NORMAL.split(", ")]]).astype({"created_timestamp": "Int64"})

    return rows.mapInPandas(normalize, f"{keys}, {_NORMAL}").withColumn("media_sha256", F.when(F.size("media_references") > 0, F.sha2(F.array_join("media_references", "|"), 256))).drop("media_references")


def timeline_normalizer(spark: SparkSession, base: str) -> DataFrame:
    """Every raw timeline record through the timeline normalizer."""
    raw = F.to_json(F.struct(F.col("record_timestamp").alias("timestamp"), "fbid", "post_url", "url", "title", "data", "attachments"))
    records = load(spark, base, "timeline_records").dropDuplicates(["source_record_id"]).select("source_record_id", F.lit("timeline").alias("kind"), raw.alias("raw"))
    return _normalized(records, "source_record_id long")


_REFERENCE = "nullif(regexp_replace(regexp_replace(replace({0}, '\\', '/'), '^\\./+', ''), '/{{2,}}', '/', 'g'), '')"
_KIND = r"""CASE WHEN m.media_metadata.video_metadata IS NOT NULL THEN 'video' WHEN m.media_metadata.photo_metadata IS NOT NULL THEN 'photo'
  WHEN regexp_matches(lower(regexp_extract(coalesce(m.uri, ''), '^([^?#]*)', 1)), '\.(mp4|mov|m4v|avi|webm)$') THEN 'video'
  WHEN regexp_matches(lower(regexp_extract(coalesce(m.uri, ''), '^([^?#]*)', 1)), '\.(jpg|jpeg|png|gif|webp|heic|heif)$') THEN 'photo' ELSE 'unknown' END"""
TIMELINE_NORMALIZER_SQL = (
    _LEVELS
    + f""", m AS (SELECT source_record_id, list(DISTINCT k) AS kinds, list_sort(list_distinct(list(ref) FILTER (WHERE ref IS NOT NULL))) AS refs FROM
  (SELECT source_record_id, {_KIND} AS k, {_REFERENCE.format("m.uri")} AS ref FROM (SELECT source_record_id, media AS m FROM e WHERE media IS NOT NULL)) GROUP BY 1),
x AS (SELECT source_record_id, bool_or(place IS NOT NULL) AS place, bool_or(coalesce(regexp_matches(ec.url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+'), false)) AS link FROM e GROUP BY 1),
s AS (SELECT DISTINCT source_record_id, record_timestamp, nullif(fbid, '') AS fbid, list_filter(list_transform(coalesce(data, []), lambda d: d.post), lambda p: p IS NOT NULL)[1] AS post FROM timeline_records)
SELECT source_record_id, CASE WHEN record_timestamp >= 0 THEN 'parsed' ELSE 'partial' END AS parse_status, CASE WHEN record_timestamp >= 0 THEN fbid END AS external_id,
  CASE WHEN record_timestamp >= 0 THEN record_timestamp END AS created_timestamp,
  CASE WHEN record_timestamp >= 0 THEN CASE WHEN len(kinds) > 0 THEN CASE WHEN link OR len(kinds) > 1 OR list_contains(kinds, 'unknown') THEN 'mixed' ELSE kinds[1] END
    WHEN link THEN 'link' WHEN place THEN 'check_in' WHEN post IS NOT NULL THEN 'text' ELSE 'unknown' END END AS post_type,
  CASE WHEN record_timestamp >= 0 THEN sha256(nfc_normalize(replace(replace(post, chr(13) || chr(10), chr(10)), chr(13), chr(10)))) END AS text_sha256,
  CASE WHEN record_timestamp >= 0 AND len(refs) > 0 THEN sha256(array_to_string(refs, '|')) END AS media_sha256
FROM s LEFT JOIN m USING (source_record_id) LEFT JOIN x USING (source_record_id)"""
)


def export_normalizer(spark: SparkSession, base: str) -> DataFrame:
    """Every record of the readable reel and video files through reader and normalizer."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for batch in batches:
            rows = []
            for name, kind, content in zip(batch["export_file_id"], batch["source_kind"], batch["content"]):
                try:
                    rows += [(name, i, kind, json.dumps(v)) for i, v in enumerate(list(file_records(content.encode(), kind, "")))]
                except FileError:
                    continue
            yield pd.DataFrame(rows, columns=["export_file_id", "record_index", "kind", "raw"])

    files = load(spark, base, "export_files").where("content IS NOT NULL").select("export_file_id", "source_kind", "content").dropDuplicates(["export_file_id"])
    records = files.mapInPandas(split, "export_file_id long, record_index long, kind string, raw string")
    return _normalized(records, "export_file_id long, record_index long").drop("post_type", "media_sha256")


EXPORT_NORMALIZER_SQL = (
    _FILES_SQL
    + """, t AS (SELECT *, CASE source_kind WHEN 'reel' THEN json_extract(e, '$.timestamp') ELSE json_extract(e, '$.creation_timestamp') END AS t,
    CASE source_kind WHEN 'reel' THEN list_filter(json_extract(e, '$.data[*].post'), lambda x: json_type(x) = 'VARCHAR')[1] ELSE json_extract(e, '$.description') END AS post FROM r),
o AS (SELECT *, json_type(e) = 'OBJECT' AND coalesce(json_type(t) IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND CAST(t AS DOUBLE) >= 0 AND CAST(t AS DOUBLE) = floor(CAST(t AS DOUBLE)), false)
    AND (source_kind = 'reel' OR coalesce(json_type(json_extract(e, '$.uri')) = 'VARCHAR', false)) AS ok FROM t)
SELECT export_file_id, record_index, CASE WHEN ok THEN 'parsed' WHEN json_type(e) = 'OBJECT' THEN 'partial' ELSE 'unsupported' END AS parse_status,
  CASE WHEN ok AND source_kind = 'reel' AND json_type(json_extract(e, '$.fbid')) = 'VARCHAR' THEN nullif(json_extract_string(e, '$.fbid'), '') END AS external_id,
  CASE WHEN ok THEN CAST(CAST(t AS DOUBLE) AS BIGINT) END AS created_timestamp,
  CASE WHEN ok AND json_type(post) = 'VARCHAR' THEN sha256(nfc_normalize(replace(replace(json_extract_string(post, '$'), chr(13) || chr(10), chr(10)), chr(13), chr(10)))) END AS text_sha256 FROM o"""
)

# --- steps of validation and import ----------------------------------------------------------------------------------


def _validated(spark: SparkSession, base: str) -> DataFrame:
    """The records in the columns of the validation: one file per source file, every unparsed record an error."""
    records = load(spark, base, "source_records").distinct()
    error = F.when(F.col("parse_status") != "parsed", F.concat(F.lit("RECORD_"), F.upper("parse_status")))
    return records.select(
        F.lit(1).alias("root_number"), F.col("source_file_id").cast("string").alias("relative_path"), F.lit("timeline").alias("kind"), F.col("source_record_id").alias("record_index"), "parse_status",
        F.col("semantic_fingerprint").alias("fingerprint"), "created_timestamp", error.alias("error_code"),
    )


_STATUSES = ("parsed", "partial", "unsupported", "failed")


def file_validation(spark: SparkSession, base: str) -> DataFrame:
    """What the validation finds in every file."""
    return inventory.file_validation(_validated(spark, base)).select(F.col("relative_path").cast("long").alias("source_file_id"), "examined", *_STATUSES, "fingerprinted", F.col("first").alias("first_ts"), F.col("last").alias("last_ts"), "errors")


_PER_FILE_SQL = f"""SELECT source_file_id, count(*) AS examined, {", ".join(f"count_if(parse_status = '{s}') AS {s}" for s in _STATUSES)}, count(semantic_fingerprint) AS fingerprinted,
  min(created_timestamp) AS first_ts, max(created_timestamp) AS last_ts, count_if(parse_status <> 'parsed') AS errors FROM (SELECT DISTINCT * FROM source_records) GROUP BY 1"""


def validation_summary(spark: SparkSession, base: str) -> DataFrame:
    """The validation over all files."""
    totals = inventory.validation_totals(inventory.file_validation(_validated(spark, base)))
    return totals.withColumnsRenamed({"first": "first_ts", "last": "last_ts"})


VALIDATION_SUMMARY_SQL = f"""SELECT count(*) AS files, {", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("examined", *_STATUSES, "fingerprinted", "errors"))}, min(first_ts) AS first_ts, max(last_ts) AS last_ts,
  CASE WHEN sum(failed) > 0 THEN 'failed' WHEN sum(errors) > 0 THEN 'completed_with_errors' ELSE 'completed' END AS status FROM ({_PER_FILE_SQL})"""


def _entities(spark: SparkSession, base: str) -> DataFrame:
    """Normalized records in the columns of entities that have relations."""
    kind = lambda x: F.when(x.source_name.isNull(), "external").otherwise("source")
    links = F.transform("external_links", lambda x: F.struct(x.original_url.alias("original"), x.normalized_url.alias("normalized"), x.source_name.alias("source"), kind(x).alias("type")))
    records = load(spark, base, "normalized_records").dropDuplicates(["source_record_id"])
    return records.select(F.col("source_record_id").alias("entity_id"), F.col("normalized_media_references").alias("media"), links.alias("links"), F.array(F.sha2("place_name", 256)).alias("places"))


def link_bridge(spark: SparkSession, base: str) -> DataFrame:
    """The links of every record in order."""
    links = inventory.relations(_entities(spark, base))["entity_links"]
    return links.select(F.col("entity_id").alias("source_record_id"), F.col("ordinal").cast("long").alias("ordinal"), F.coalesce("normalized", F.lit("")).alias("url"), F.col("type").alias("link_type"))


LINK_BRIDGE_SQL = """SELECT DISTINCT source_record_id, i - 1 AS ordinal, coalesce(l[i].normalized_url, '') AS url, CASE WHEN l[i].source_name IS NULL THEN 'external' ELSE 'source' END AS link_type
FROM (SELECT source_record_id, external_links AS l FROM normalized_records), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)"""


def media_bridge(spark: SparkSession, base: str) -> DataFrame:
    """The media of every record in order, by their key."""
    media = inventory.relations(_entities(spark, base))["entity_media"]
    return media.select(F.col("entity_id").alias("source_record_id"), F.col("ordinal").cast("long").alias("ordinal"), "reference_key")


MEDIA_BRIDGE_SQL = """SELECT source_record_id, i - 1 AS ordinal, sha256(lower(m[i])) AS reference_key
FROM (SELECT DISTINCT source_record_id, normalized_media_references AS m FROM normalized_records), LATERAL (SELECT unnest(range(1, len(m) + 1)) AS i)"""


def _attached(spark: SparkSession, base: str) -> DataFrame:
    """Media references of the records in the columns of the import, in order of their ids."""
    kinds = load(spark, base, "source_records").select("source_record_id", F.col("source_kind").alias("kind")).distinct()
    records = load(spark, base, "normalized_records").dropDuplicates(["source_record_id"]).join(kinds, "source_record_id")
    rows = records.select("source_record_id", "kind", "post_type", "media_details", F.posexplode("normalized_media_references").alias("ordinal", "reference"))
    detail = F.get(F.filter("media_details", lambda d: d.normalized_reference == F.col("reference")), F.lit(0))
    rows = rows.withColumn("d", detail)
    return rows.select(
        F.col("source_record_id").cast("string").alias("record_id"), F.col("source_record_id").alias("seq"), "kind", F.col("post_type").alias("type"), "ordinal", "reference", F.col("d").isNotNull().alias("has_detail"),
        F.col("d.media_type").alias("detail_type"), F.col("d.creation_timestamp").alias("detail_created"), F.col("d.metadata_json").alias("detail_metadata"),
    )


_ATTACHED_SQL = """
WITH a AS (SELECT source_record_id, kind, post_type, i - 1 AS ordinal, m[i] AS reference, list_filter(coalesce(d, []), lambda x: x.normalized_reference = m[i])[1] AS d
  FROM (SELECT DISTINCT ON (source_record_id) source_record_id, post_type, normalized_media_references AS m, media_details AS d FROM normalized_records)
  JOIN (SELECT DISTINCT source_record_id, source_kind AS kind FROM source_records) USING (source_record_id), LATERAL (SELECT unnest(range(1, len(m) + 1)) AS i)),
b AS (SELECT *, lower(reference) AS k, (source_record_id, ordinal) AS o, kind IN ('video_metadata', 'photo_metadata', 'album_metadata') AND d IS NOT NULL AS over FROM a WHERE reference IS NOT NULL)
"""


def media_dimension(spark: SparkSession, base: str) -> DataFrame:
    """The media dimension after all records in order of their ids."""
    media, _ = inventory.media_dimension(spark.createDataFrame([], inventory.MEDIA), _attached(spark, base).where("reference IS NOT NULL"))
    return media.select("reference_key", "reference", "media_type", F.col("created").alias("created_ts"), F.sha2("metadata", 256).alias("metadata_sha256"))


MEDIA_DIMENSION_SQL = (
    _ATTACHED_SQL
    + """SELECT sha256(k) AS reference_key, arg_min(reference, o) AS reference,
  CASE WHEN bool_or(over) THEN arg_max({'v': d.media_type}, o) FILTER (WHERE over).v ELSE CASE WHEN arg_min(coalesce(post_type, ''), o) IN ('photo', 'video') THEN arg_min(post_type, o) ELSE 'unknown' END END AS media_type,
  (arg_max({'v': d.creation_timestamp}, o) FILTER (WHERE over)).v AS created_ts, sha256((arg_max({'v': d.metadata_json}, o) FILTER (WHERE over)).v) AS metadata_sha256 FROM b GROUP BY k"""
).replace("arg_max({'v': d.media_type}, o) FILTER (WHERE over).v", "(arg_max({'v': d.media_type}, o) FILTER (WHERE over)).v")


def state_evidence(spark: SparkSession, base: str) -> DataFrame:
    """What archive and trash records say about their posts."""
    kinds = load(spark, base, "source_records").select(F.col("source_record_id").alias("record_id"), F.col("source_kind").alias("kind")).distinct()
    observed = load(spark, base, "post_observations").select(F.col("source_record_id").alias("record_id"), F.col("post_id").alias("entity_id")).distinct()
    return inventory.state_evidence(observed.join(kinds, "record_id")).withColumnsRenamed({"record_id": "source_record_id", "entity_id": "post_id"})


STATE_EVIDENCE_SQL = """SELECT DISTINCT o.post_id, o.source_record_id, CASE r.source_kind WHEN 'trash' THEN 'trash' ELSE 'archived' END AS state, true AS confirmed
FROM post_observations o JOIN source_records r USING (source_record_id) WHERE r.source_kind IN ('archive', 'trash')"""


def place_dimension(spark: SparkSession, base: str) -> DataFrame:
    """The place dimension: every place under the name that the first record gives it."""
    named = load(spark, base, "normalized_records").select(F.col("source_record_id").cast("string").alias("record_id"), F.lower("place_name").alias("place_reference"), "place_name", F.col("source_record_id").alias("seq"))
    return inventory.place_dimension(spark.createDataFrame([], inventory.PLACE), named).select("place_key", F.sha2("place_name", 256).alias("name_sha256"), F.sha2("metadata", 256).alias("metadata_sha256"))


PLACE_DIMENSION_SQL = """SELECT sha256(lower(place_name)) AS place_key, sha256(arg_min(place_name, source_record_id)) AS name_sha256, sha256(min(lower(place_name))) AS metadata_sha256
FROM normalized_records WHERE place_name IS NOT NULL GROUP BY lower(place_name)"""

QUERIES = {
    f.__name__: f
    for f in (
        numbered_files, file_order, collection_fingerprint, file_reading, timeline_normalizer, export_normalizer, file_validation, validation_summary, link_bridge, media_bridge, media_dimension, state_evidence, place_dimension,
    )
}
ORACLE = {
    "numbered_files": NUMBERED_FILES_SQL, "file_order": FILE_ORDER_SQL, "collection_fingerprint": COLLECTION_FINGERPRINT_SQL, "file_reading": FILE_READING_SQL, "timeline_normalizer": TIMELINE_NORMALIZER_SQL,
    "export_normalizer": EXPORT_NORMALIZER_SQL, "file_validation": _PER_FILE_SQL, "validation_summary": VALIDATION_SUMMARY_SQL, "link_bridge": LINK_BRIDGE_SQL, "media_bridge": MEDIA_BRIDGE_SQL,
    "media_dimension": MEDIA_DIMENSION_SQL, "state_evidence": STATE_EVIDENCE_SQL, "place_dimension": PLACE_DIMENSION_SQL,
}
