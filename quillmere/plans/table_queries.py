"""One query per operator over the driver's tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.functions import canonical as C
from quillmere.operators import matching as M
from quillmere.operators import upsert as U
from quillmere.operators import windows as W
from quillmere.plans.inventory import capped_errors as capped
from quillmere.session import keep, load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return register


def _long(column):
    return column.cast("long")


# --- scalars and hashes ----------------------------------------------------------------------------------------------


@_query(r"SELECT doc_id, sha256(nfc_normalize(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)))) AS fingerprint FROM documents")
def text_fingerprint(spark, base):
    return load(spark, base, "documents").select("doc_id", F.sha2(C.normal_text(F.col("text")), 256).alias("fingerprint"))


@_query(
    """SELECT event_id, sha256('{"created_timestamp":' || CAST(floor(epoch(ts)) AS BIGINT) || ',"identity_version":1,"normalized_place_reference_when_available":null,"normalized_post_text":"'
    || event_type || '","sorted_normalized_external_urls":[],"sorted_normalized_media_references":[]}') AS fingerprint FROM events"""
)
def semantic_fingerprint(spark, base):
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return load(spark, base, "events").select("event_id", C.fingerprint_column(seconds, F.col("event_type"), empty, empty, none).alias("fingerprint"))


_URL_SQL = r"""CASE WHEN regexp_matches({0}, '^https?://[A-Za-z0-9.-]+[^#]*') THEN lower(regexp_extract({0}, '^(https?://[^/?#]+)', 1))
  || CASE WHEN regexp_extract({0}, '^https?://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract({0}, '^https?://[^/?#]+([^?#]*)', 1) END
  || regexp_extract({0}, '^[^?#]*([?][^#]*)?', 1) END"""


@_query(f"SELECT DISTINCT source_record_id, {_URL_SQL.format('direct_post_url')} AS url FROM normalized_records")
def url_normalize(spark, base):
    return load(spark, base, "normalized_records").select("source_record_id", C.normal_url(F.col("direct_post_url")).alias("url")).distinct()


@_query(
    r"""SELECT source_record_id, i - 1 AS ordinal, lower(nullif(regexp_replace(regexp_replace(replace(m[i], '\', '/'), '^\./+', ''), '/{2,}', '/', 'g'), '')) AS media_key
    FROM (SELECT DISTINCT source_record_id, normalized_media_references AS m FROM normalized_records), LATERAL (SELECT unnest(range(1, len(m) + 1)) AS i)"""
)
def media_key(spark, base):
    records = load(spark, base, "normalized_records").select("source_record_id", "normalized_media_references").distinct()
    exploded = records.select("source_record_id", F.posexplode("normalized_media_references").alias("ordinal", "reference"))
    return exploded.select("source_record_id", _long(F.col("ordinal")).alias("ordinal"), C.media_match_key(C.media_reference(F.col("reference"))).alias("media_key"))


_KIND_SQL = r"""CASE WHEN regexp_matches(lower(regexp_extract({0}, '^([^?#]*)', 1)), '\.(mp4|mov|m4v|avi|webm)$') THEN 'video'
  WHEN regexp_matches(lower(regexp_extract({0}, '^([^?#]*)', 1)), '\.(jpg|jpeg|png|gif|webp|heic|heif)$') THEN 'photo' ELSE 'unknown' END"""


@_query(
    f"""SELECT media_kind, count(*) AS n FROM (SELECT {_KIND_SQL.format('m')} AS media_kind FROM (SELECT unnest(normalized_media_references) AS m
    FROM (SELECT DISTINCT source_record_id, normalized_media_references FROM normalized_records))) GROUP BY 1"""
)
def media_kind(spark, base):
    records = load(spark, base, "normalized_records").select("source_record_id", "normalized_media_references").distinct()
    return records.select(F.explode("normalized_media_references").alias("reference")).select(C.media_kind(F.col("reference")).alias("media_kind")).groupBy("media_kind").agg(F.count("*").alias("n"))


@_query(
    f"""SELECT DISTINCT source_record_id, CASE WHEN len(k) > 0 AND (len(l) > 0 OR len(list_distinct(k)) > 1 OR list_contains(k, 'unknown')) THEN 'mixed'
      WHEN len(k) > 0 THEN CASE WHEN list_contains(k, 'video') THEN 'video' ELSE 'photo' END
      WHEN len(l) > 0 THEN 'link' WHEN place_name IS NOT NULL THEN 'check_in' WHEN normalized_post_text IS NOT NULL THEN 'text' ELSE 'unknown' END AS derived_type
    FROM (SELECT source_record_id, place_name, normalized_post_text, coalesce(external_links, []) AS l,
      list_transform(coalesce(normalized_media_references, []), lambda m: {_KIND_SQL.format('m')}) AS k FROM normalized_records)"""
)
def post_type(spark, base):
    kinds = F.transform(F.coalesce("normalized_media_references", F.array().cast("array<string>")), C.media_kind)
    has_link = F.coalesce(F.size("external_links") > 0, F.lit(False))
    records = load(spark, base, "normalized_records")
    return records.select("source_record_id", C.post_type(kinds, has_link, F.col("place_name").isNotNull(), F.col("normalized_post_text").isNotNull()).alias("derived_type")).distinct()


@_query("SELECT DISTINCT source_record_id, list_filter(list_transform(coalesce(data, []), lambda x: x.post), lambda p: p IS NOT NULL)[1] AS post FROM timeline_records")
def first_text_pick(spark, base):
    picked = F.filter(F.transform(F.coalesce("data", F.array().cast("array<struct<post:string>>")), lambda x: x.post), lambda p: p.isNotNull())
    return load(spark, base, "timeline_records").select("source_record_id", F.get(picked, F.lit(0)).alias("post")).distinct()


@_query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) BETWEEN 0 AND 9007199254740991")
def json_extract_props(spark, base):
    value = F.expr("try_cast(get_json_object(props, '$.k') AS BIGINT)")
    return load(spark, base, "events").select("event_id", value.alias("k")).where(F.col("k").between(0, 9007199254740991))


@_query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || '000Z' AS iso FROM events")
def iso_timestamp(spark, base):
    return load(spark, base, "events").select("event_id", C.iso_utc(F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("iso"))


@_query("SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_partkey))), ',') AS parts FROM lineitem GROUP BY 1")
def sorted_distinct(spark, base):
    parts = load(spark, base, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("p"))
    return parts.select("l_orderkey", F.array_join(F.transform(F.array_sort("p"), lambda x: x.cast("string")), ",").alias("parts"))


# --- occurrence slots and windows ------------------------------------------------------------------------------------

_RECORDS_SQL = "(SELECT DISTINCT * FROM source_records)"


def _records(spark, base) -> DataFrame:
    return load(spark, base, "source_records").distinct()


@_query(
    f"""SELECT source_record_id, row_number() OVER (PARTITION BY import_run_id, r.source_kind, semantic_fingerprint ORDER BY raw_sha256, record_index, source_record_id) AS occurrence
    FROM {_RECORDS_SQL} r JOIN (SELECT DISTINCT source_file_id, import_run_id FROM source_files) f USING (source_file_id) WHERE semantic_fingerprint IS NOT NULL"""
)
def occurrence_slot(spark, base):
    files = load(spark, base, "source_files").select("source_file_id", "import_run_id").distinct()
    records = _records(spark, base).where("semantic_fingerprint IS NOT NULL").join(files, "source_file_id")
    numbered = W.occurrence_slots(records, ["import_run_id", "source_kind", "semantic_fingerprint"], ["raw_sha256", "record_index", "source_record_id"])
    return numbered.select("source_record_id", _long(F.col("occurrence")).alias("occurrence"))


@_query(
    """SELECT l_orderkey, CASE WHEN list_contains(used, 2) THEN list_filter(range(1, len(used) + 2), lambda s: NOT list_contains(used, s))[1] ELSE 2 END AS slot
    FROM (SELECT l_orderkey, list_distinct(list(CAST(l_linenumber AS BIGINT))) AS used FROM lineitem GROUP BY 1)"""
)
def free_slot(spark, base):
    used = W.used_slots(load(spark, base, "lineitem"), ["l_orderkey"], "l_linenumber")
    return used.select("l_orderkey", _long(W.free_slot(F.col("used"), F.lit(2))).alias("slot"))


@_query(
    """SELECT user_id, arg_min(props, event_id) FILTER (WHERE value > 50) AS first_large, arg_max(event_type, event_id) FILTER (WHERE event_type <> 'view') AS last_other FROM events GROUP BY 1"""
)
def coalesce_merge(spark, base):
    events = load(spark, base, "events")
    first = W.first_known(F.when(F.col("value") > 50, F.col("props")), "event_id")
    last = W.last_known(F.when(F.col("event_type") != "view", F.col("event_type")), "event_id")
    return events.groupBy("user_id").agg(first.alias("first_large"), last.alias("last_other"))


@_query(
    """SELECT event_id, coalesce(event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1, true) AS changed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""
)
def change_flags(spark, base):
    return load(spark, base, "events").select("event_id", W.changed_from_previous(["event_type"], ["user_id"], ["ts", "event_id"]).alias("changed"))


@_query(
    """SELECT source_record_id, row_number() OVER (ORDER BY CASE source_kind WHEN 'timeline' THEN 0 WHEN 'archive' THEN 1 WHEN 'trash' THEN 2 WHEN 'reel' THEN 3 WHEN 'video_metadata' THEN 4
    WHEN 'photo_metadata' THEN 5 WHEN 'album_metadata' THEN 6 WHEN 'checkin_metadata' THEN 7 ELSE 8 END, semantic_fingerprint, raw_sha256, source_record_id) AS processing_seq
    FROM (SELECT DISTINCT * FROM source_records) WHERE parse_status = 'parsed'"""
)
def processing_order(spark, base):
    from quillmere.operators.ordering import kind_rank, numbered

    records = _records(spark, base).where("parse_status = 'parsed'").select("source_record_id", kind_rank(F.col("source_kind")).alias("rank"), "semantic_fingerprint", "raw_sha256")
    return numbered(records, ["rank", "semantic_fingerprint", "raw_sha256", "source_record_id"], "processing_seq").select("source_record_id", "processing_seq")


# --- counts and aggregations -----------------------------------------------------------------------------------------


@_query("SELECT created_timestamp, count(*) AS n FROM (SELECT DISTINCT * FROM source_records) WHERE parse_status = 'parsed' GROUP BY 1")
def timestamp_counts(spark, base):
    return M.time_counts(_records(spark, base).where("parse_status = 'parsed'").withColumnRenamed("created_timestamp", "ts")).withColumnRenamed("ts", "created_timestamp")


@_query(
    """SELECT created_timestamp, sha256(normalized_post_text) AS text_hash, count(*) AS n FROM (SELECT DISTINCT source_record_id, created_timestamp, normalized_post_text FROM normalized_records)
    WHERE normalized_post_text <> '' GROUP BY created_timestamp, normalized_post_text"""
)
def timestamp_text_counts(spark, base):
    records = load(spark, base, "normalized_records").select("source_record_id", F.col("created_timestamp").alias("ts"), F.col("normalized_post_text").alias("text")).distinct()
    return M.time_text_counts(records).select(F.col("ts").alias("created_timestamp"), F.sha2("text", 256).alias("text_hash"), "n")


@_query(
    """SELECT count(*) AS examined, count_if(match_status = 'matched') AS matched, count_if(match_status = 'created') AS created, count_if(match_status = 'skipped') AS skipped,
    count_if(match_status = 'pending') AS pending, count_if(parse_status <> 'parsed') AS errors, count_if(facebook_post_id IS NULL) AS missing_ids FROM (SELECT DISTINCT * FROM source_records)"""
)
def status_counts(spark, base):
    status = [F.count_if(F.col("match_status") == s).alias(s) for s in ("matched", "created", "skipped", "pending")]
    return _records(spark, base).agg(F.count("*").alias("examined"), *status, F.count_if(F.col("parse_status") != "parsed").alias("errors"), F.count_if(F.col("facebook_post_id").isNull()).alias("missing_ids"))


@_query(
    """SELECT count(DISTINCT o.post_id) AS updated_posts FROM post_observations o JOIN source_records r USING (source_record_id) JOIN source_files f USING (source_file_id)
    WHERE r.match_status = 'matched' AND o.changed_canonical_post = 1"""
)
def distinct_updated(spark, base):
    observed = load(spark, base, "post_observations").where("changed_canonical_post = 1").select("post_id", "source_record_id")
    matched = load(spark, base, "source_records").where("match_status = 'matched'").select("source_record_id", "source_file_id")
    files = load(spark, base, "source_files").select("source_file_id")
    return observed.join(matched, "source_record_id").join(files, "source_file_id").agg(F.count_distinct("post_id").alias("updated_posts"))


@_query("SELECT min(created_timestamp) AS first_ts, max(created_timestamp) AS last_ts FROM source_records")
def ts_range(spark, base):
    return load(spark, base, "source_records").agg(F.min("created_timestamp").alias("first_ts"), F.max("created_timestamp").alias("last_ts"))


@_query("SELECT post_type, count(*) AS n FROM posts GROUP BY 1")
def type_counts(spark, base):
    return load(spark, base, "posts").groupBy("post_type").agg(F.count("*").alias("n"))


@_query("SELECT match_rule, count(*) AS n FROM (SELECT DISTINCT * FROM post_observations) GROUP BY 1")
def rule_counts(spark, base):
    return load(spark, base, "post_observations").distinct().groupBy("match_rule").agg(F.count("*").alias("n"))


@_query("SELECT 'posts' AS name, count(*) AS n FROM posts UNION ALL SELECT 'source_files', count(*) FROM source_files UNION ALL SELECT 'import_runs', count(*) FROM import_runs UNION ALL SELECT 'documents', count(*) FROM documents")
def table_counts(spark, base):
    parts = [load(spark, base, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in ("posts", "source_files", "import_runs", "documents")]
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


@_query(
    """SELECT source_file_id, any_value(f.source_kind) AS source_kind, count(r.source_record_id) AS error_count FROM (SELECT DISTINCT source_file_id, source_kind FROM source_files) f
    LEFT JOIN (SELECT DISTINCT source_record_id, source_file_id FROM source_records WHERE parse_status <> 'parsed') r USING (source_file_id) GROUP BY 1"""
)
def errors_per_file(spark, base):
    errors = load(spark, base, "source_records").where("parse_status <> 'parsed'").select("source_record_id", "source_file_id").distinct().groupBy("source_file_id").agg(F.count("*").alias("n"))
    files = load(spark, base, "source_files").select("source_file_id", "source_kind").distinct()
    return files.join(errors, "source_file_id", "left").select("source_file_id", "source_kind", F.coalesce("n", F.lit(0)).alias("error_count"))


@_query(
    """SELECT r.source_record_id, r.record_index, r.parse_status, f.relative_path FROM (SELECT DISTINCT * FROM source_records) r
    LEFT JOIN (SELECT DISTINCT source_file_id, relative_path FROM source_files) f USING (source_file_id) WHERE r.parse_status <> 'parsed' ORDER BY r.source_record_id LIMIT 100"""
)
def issues_top100(spark, base):
    issues = _records(spark, base).where("parse_status <> 'parsed'").select("source_record_id", "source_file_id", "record_index", "parse_status").orderBy("source_record_id").limit(100)
    files = load(spark, base, "source_files").select("source_file_id", "relative_path").distinct()
    return issues.join(files, "source_file_id", "left").select("source_record_id", "record_index", "parse_status", "relative_path")


@_query(
    """SELECT source_file_id, total, total > 100 AS truncated, least(total, 100) AS retained FROM (SELECT source_file_id, count(*) AS total
    FROM (SELECT DISTINCT * FROM source_records) WHERE parse_status <> 'parsed' GROUP BY 1)"""
)
def capped_errors(spark, base):
    totals = _records(spark, base).where("parse_status <> 'parsed'").groupBy("source_file_id").agg(F.count("*").alias("total"))
    return totals.select("source_file_id", "total", (F.col("total") > 100).alias("truncated"), F.least(F.col("total"), F.lit(100).cast("long")).alias("retained"))


@_query(
    """SELECT source_file_id, record_index, parse_status FROM (SELECT source_file_id, record_index, parse_status,
    row_number() OVER (PARTITION BY source_file_id ORDER BY record_index NULLS FIRST, parse_status) AS n
    FROM (SELECT DISTINCT * FROM source_records) WHERE parse_status <> 'parsed') WHERE n <= 100"""
)
def retained_errors(spark, base):
    bad = _records(spark, base).where("parse_status <> 'parsed'")
    errors = bad.select(F.lit(0).alias("root_number"), F.col("source_file_id").alias("relative_path"), "record_index", F.col("parse_status").alias("error_code"))
    return capped(errors).select(F.col("relative_path").alias("source_file_id"), "record_index", F.col("code").alias("parse_status"))


@_query(
    """SELECT c_custkey, max(CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 0 END) AS state_rank, bool_or(o_orderstatus IN ('F', 'O')) AS confirmed FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1"""
)
def state_precedence(spark, base):
    rank = F.when(F.col("o_orderstatus") == "F", 2).when(F.col("o_orderstatus") == "O", 1).otherwise(0)
    orders = load(spark, base, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(rank).alias("state_rank"), F.max(F.col("o_orderstatus").isin("F", "O")).alias("confirmed"))
    return orders.join(load(spark, base, "customer").select("c_custkey"), "c_custkey", "left_semi")


@_query("SELECT source_kind, export_root_number, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM (SELECT DISTINCT * FROM source_files) GROUP BY 1, 2")
def files_per_kind(spark, base):
    return load(spark, base, "source_files").distinct().groupBy("source_kind", "export_root_number").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


@_query("SELECT import_run_id, CAST(round(epoch_ms(completed_at_utc) - epoch_ms(started_at_utc)) AS BIGINT) AS duration_ms FROM import_runs WHERE completed_at_utc IS NOT NULL")
def run_durations(spark, base):
    runs = load(spark, base, "import_runs").where("completed_at_utc IS NOT NULL")
    millis = [F.unix_millis(F.col(c).cast("timestamp")) for c in ("completed_at_utc", "started_at_utc")]
    return runs.select("import_run_id", (millis[0] - millis[1]).alias("duration_ms"))


# --- joins and matching ----------------------------------------------------------------------------------------------


def _content(spark, base) -> DataFrame:
    empty = F.array().cast("array<string>")
    return load(spark, base, "normalized_records").select(
        F.col("source_record_id").alias("record"), C.whole_id(F.col("facebook_post_id")).alias("id"), C.plain_url(F.when(F.col("direct_post_url").rlike("/posts/[0-9]+"), F.col("direct_post_url"))).alias("url"),
        F.col("semantic_fingerprint").alias("fp"), F.col("created_timestamp").alias("ts"), F.col("normalized_post_text").alias("text"),
        F.coalesce(F.transform("normalized_media_references", C.media_match_key), empty).alias("media"), F.coalesce("normalized_external_urls", empty).alias("urls"),
    ).dropDuplicates(["record"])


def _pending(spark, base, content: DataFrame | None = None) -> DataFrame:
    """Pending records with their content."""
    pending = load(spark, base, "source_records").where("match_status = 'pending'").select(F.col("source_record_id").alias("record"), "source_kind").distinct()
    content = _content(spark, base) if content is None else content
    return content.join(pending, "record").withColumn("authoritative", F.col("source_kind").isin("timeline", "archive", "trash", "reel"))


def _incoming(spark, base, content: DataFrame | None = None) -> DataFrame:
    """Pending records with their content and occurrence number."""
    return W.occurrence_slots(_pending(spark, base, content), ["source_kind", "fp"], ["record"], "slot")


def _entities(spark, base, content: DataFrame | None = None) -> DataFrame:
    """Known posts with the content of the record that created them."""
    creating = load(spark, base, "post_observations").where("match_rule = 'M08'").groupBy("post_id").agg(F.min("source_record_id").alias("record"))
    posts = load(spark, base, "posts").select("post_id", F.col("occurrence_slot").alias("slot")).distinct()
    return posts.join(creating, "post_id").join(_content(spark, base) if content is None else content, "record").withColumnRenamed("post_id", "entity").drop("record")


_CASCADE_SQL = r"""
WITH content AS (SELECT DISTINCT ON (source_record_id) source_record_id AS record,
    CASE WHEN regexp_matches(facebook_post_id, '^[0-9]{12,}$') AND replace(facebook_post_id, left(facebook_post_id, 1), '') <> '' THEN facebook_post_id END AS id,
    CASE WHEN regexp_matches(direct_post_url, '/posts/[0-9]+') THEN direct_post_url END AS url, semantic_fingerprint AS fp, created_timestamp AS ts, normalized_post_text AS text,
    list_transform(coalesce(normalized_media_references, []), lambda m: lower(m)) AS media, coalesce(normalized_external_urls, []) AS urls FROM normalized_records),
inc AS (SELECT c.*, source_kind IN ('timeline', 'archive', 'trash', 'reel') AS authoritative, row_number() OVER (PARTITION BY source_kind, fp ORDER BY record) AS slot
  FROM content c JOIN (SELECT DISTINCT source_record_id AS record, source_kind FROM source_records WHERE match_status = 'pending') USING (record)),
ent AS (SELECT post_id AS entity, occurrence_slot AS slot, c.* EXCLUDE (record) FROM (SELECT DISTINCT post_id, occurrence_slot FROM posts)
  JOIN (SELECT post_id, min(source_record_id) AS record FROM post_observations WHERE match_rule = 'M08' GROUP BY 1) USING (post_id) JOIN content c USING (record)),
m1 AS (SELECT record, min(entity) AS entity FROM inc JOIN ent USING (id) GROUP BY 1),
m2 AS (SELECT record, min(entity) AS entity FROM inc JOIN ent USING (url) GROUP BY 1),
m3 AS (SELECT record, min(entity) AS entity FROM inc JOIN ent USING (fp, slot) GROUP BY 1),
m4 AS (SELECT record, min(entity) AS entity FROM (SELECT record, ts, unnest(media) AS k FROM inc) JOIN (SELECT entity, ts, unnest(media) AS k FROM ent) USING (ts, k) GROUP BY 1 HAVING count(DISTINCT entity) = 1),
m5 AS (SELECT record, min(entity) AS entity FROM (SELECT record, ts, unnest(urls) AS k FROM inc) JOIN (SELECT entity, ts, unnest(urls) AS k FROM ent) USING (ts, k) GROUP BY 1 HAVING count(DISTINCT entity) = 1),
m6 AS (SELECT i.record, min(entity) AS entity FROM inc i JOIN (SELECT ts, text FROM inc WHERE text <> '' GROUP BY 1, 2 HAVING count(*) = 1) USING (ts, text) JOIN ent e USING (ts, text) GROUP BY 1 HAVING count(DISTINCT entity) = 1),
m7 AS (SELECT i.record, e.entity FROM inc i JOIN (SELECT ts FROM inc GROUP BY 1 HAVING count(*) = 1) USING (ts) JOIN (SELECT ts FROM ent GROUP BY 1 HAVING count(*) = 1) USING (ts) JOIN ent e USING (ts)
  WHERE NOT ((len(i.media) > 0 AND len(e.media) > 0 AND NOT list_has_any(i.media, e.media)) OR (len(i.urls) > 0 AND len(e.urls) > 0 AND NOT list_has_any(i.urls, e.urls)))),
cascade AS (SELECT inc.record, CASE WHEN m1.entity IS NOT NULL THEN 1 WHEN m2.entity IS NOT NULL THEN 2 WHEN m3.entity IS NOT NULL THEN 3 WHEN m4.entity IS NOT NULL THEN 4 WHEN m5.entity IS NOT NULL THEN 5
    WHEN m6.entity IS NOT NULL THEN 6 WHEN m7.entity IS NOT NULL THEN 7 WHEN authoritative THEN 8 ELSE 9 END AS rank,
    coalesce(m1.entity, m2.entity, m3.entity, m4.entity, m5.entity, m6.entity, m7.entity) AS entity
  FROM inc LEFT JOIN m1 USING (record) LEFT JOIN m2 USING (record) LEFT JOIN m3 USING (record) LEFT JOIN m4 USING (record) LEFT JOIN m5 USING (record) LEFT JOIN m6 USING (record) LEFT JOIN m7 USING (record))
"""


def _cascade(spark, base) -> DataFrame:
    content = keep(_content(spark, base))  # both sides hold the same contents, which are worked out once
    return M.cascade(_incoming(spark, base, content), _entities(spark, base, content))


@_query(_CASCADE_SQL + "SELECT record, 'M0' || rank AS rule, rank, entity FROM cascade")
def match_cascade(spark, base):
    return _cascade(spark, base)


@_query(_CASCADE_SQL + "SELECT 'M0' || rank AS rule, count(*) AS n FROM cascade GROUP BY 1")
def match_rule_counts(spark, base):
    return _cascade(spark, base).groupBy("rule").agg(F.count("*").alias("n"))


@_query(_CASCADE_SQL + "SELECT record, entity FROM m1")
def m01_id_match(spark, base):
    return M.by_key(_pending(spark, base), _entities(spark, base), ["id"])


@_query(_CASCADE_SQL + "SELECT record, entity FROM m2")
def m02_url_match(spark, base):
    return M.by_key(_pending(spark, base), _entities(spark, base), ["url"])


@_query(_CASCADE_SQL + "SELECT record, entity FROM m3")
def m03_slot_match(spark, base):
    return M.by_key(_incoming(spark, base), _entities(spark, base), ["fp", "slot"])


@_query(_CASCADE_SQL + "SELECT record, entity FROM m4")
def m04_media_overlap(spark, base):
    return M.by_overlap(_pending(spark, base), _entities(spark, base), "media")


@_query(_CASCADE_SQL + "SELECT record, entity FROM m5")
def m05_url_overlap(spark, base):
    return M.by_overlap(_pending(spark, base), _entities(spark, base), "urls")


@_query(_CASCADE_SQL + "SELECT record, entity FROM m6")
def m06_text_match(spark, base):
    return M.by_text(_pending(spark, base), _entities(spark, base))


@_query(_CASCADE_SQL + "SELECT record, entity FROM m7")
def m07_sole_timestamp(spark, base):
    return M.by_time(_pending(spark, base), _entities(spark, base))


_ORDERS_SQL = """WITH b AS (SELECT o_orderkey, o_orderdate, list_distinct(list(l_partkey)) AS parts FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
x AS (SELECT o_orderkey, o_orderdate, unnest(parts) AS part FROM b WHERE o_orderkey % 3 = 0), y AS (SELECT o_orderkey AS entity, o_orderdate, unnest(parts) AS part FROM b WHERE o_orderkey % 3 <> 0)
SELECT o_orderkey AS record, min(entity) AS entity FROM x JOIN y USING (o_orderdate, part) GROUP BY 1 HAVING count(DISTINCT entity) = 1"""


@_query(_ORDERS_SQL)
def part_overlap(spark, base):
    """Orders of every third key are the incoming side, all others the known one: a split into two roles, not a sample."""
    parts = load(spark, base, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_partkey").alias("parts"))
    orders = load(spark, base, "orders").join(parts, "o_orderkey").select("o_orderkey", F.col("o_orderdate").alias("ts"), "parts")
    left = orders.where("o_orderkey % 3 = 0").withColumnRenamed("o_orderkey", "record")
    return M.by_overlap(left, orders.where("o_orderkey % 3 <> 0").withColumnRenamed("o_orderkey", "entity"), "parts")


@_query("SELECT post_id FROM posts p WHERE NOT EXISTS (SELECT 1 FROM post_observations o WHERE o.post_id = p.post_id AND o.match_rule <> 'M08')")
def unmatched_anti(spark, base):
    later = load(spark, base, "post_observations").where("match_rule <> 'M08'").select("post_id")
    return load(spark, base, "posts").select("post_id").join(later, "post_id", "left_anti")


@_query("SELECT post_id FROM posts p WHERE EXISTS (SELECT 1 FROM post_observations o WHERE o.post_id = p.post_id AND o.match_rule <> 'M08')")
def matched_semi(spark, base):
    later = load(spark, base, "post_observations").where("match_rule <> 'M08'").select("post_id")
    return load(spark, base, "posts").select("post_id").join(later, "post_id", "left_semi")


# --- inserts, updates, assertions ------------------------------------------------------------------------------------


@_query("SELECT l_orderkey, l_linenumber, count(DISTINCT l_suppkey) AS owners FROM lineitem WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT l_suppkey) > 1")
def identity_conflict(spark, base):
    return U.identity_conflicts(load(spark, base, "lineitem"), ["l_orderkey", "l_linenumber"], "l_suppkey")


@_query(
    """WITH d AS (SELECT doc_id, sha256(text) AS fp FROM documents WHERE text IS NOT NULL), t AS (SELECT doc_id, fp FROM d WHERE doc_id % 2 = 0),
    i AS (SELECT min(doc_id) AS doc_id, fp FROM d WHERE doc_id % 2 = 1 AND fp NOT IN (SELECT fp FROM t) GROUP BY fp) SELECT * FROM t UNION ALL SELECT doc_id, fp FROM i"""
)
def insert_or_ignore(spark, base):
    """Even ids are the table, odd ids arrive: a split into two roles, not a sample."""
    docs = load(spark, base, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("fp"))
    return U.insert_or_ignore(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), ["fp"], ["doc_id"])


@_query(
    """SELECT p_partkey, coalesce(s.top, p_size) AS p_size, s.top IS NOT NULL AND s.top IS DISTINCT FROM p_size AS updated FROM part
    LEFT JOIN (SELECT l_partkey, max(l_linenumber) AS top FROM lineitem GROUP BY 1) s ON l_partkey = p_partkey"""
)
def conditional_update(spark, base):
    newest = load(spark, base, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_linenumber").alias("p_size"))
    return U.conditional_update(load(spark, base, "part").select("p_partkey", "p_size"), newest, ["p_partkey"], ["p_size"])


@_query(
    """SELECT post_id, coalesce(first_collected_at_utc, a) AS first_at, greatest(last_collected_at_utc, b) AS last_at FROM posts FULL JOIN
    (SELECT post_id, min(matched_at_utc) AS a, max(matched_at_utc) AS b FROM post_observations WHERE post_id IS NOT NULL GROUP BY 1) USING (post_id)"""
)
def touch_update(spark, base):
    posts = load(spark, base, "posts").select("post_id", F.col("first_collected_at_utc").alias("first_at"), F.col("last_collected_at_utc").alias("last_at"))
    seen = load(spark, base, "post_observations").select("post_id", F.col("matched_at_utc").alias("at"))
    return U.touch(posts, seen, ["post_id"], "first_at", "last_at")


@_query(
    """SELECT (SELECT count(*) FROM orders o WHERE o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey)) AS orphan_orders,
    (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS duplicate_orders,
    (SELECT count(*) FROM (SELECT DISTINCT * FROM post_observations) o WHERE NOT EXISTS (SELECT 1 FROM posts p WHERE p.post_id = o.post_id)) AS orphan_observations"""
)
def integrity_check(spark, base):
    orders, customers = load(spark, base, "orders"), load(spark, base, "customer")
    observed = load(spark, base, "post_observations").distinct()
    parts = {
        "orphan_orders": U.orphans(orders, customers, "o_custkey", "c_custkey"),
        "duplicate_orders": U.duplicate_keys(orders, ["o_orderkey"]),
        "orphan_observations": U.orphans(observed, load(spark, base, "posts"), "post_id", "post_id"),
    }
    counted = None
    for name, df in parts.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        counted = one if counted is None else counted.unionByName(one)
    return counted.agg(*[F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in parts])


@_query(
    """SELECT 'document' AS kind, doc_id AS key, sha256(text) AS fp FROM documents UNION ALL SELECT 'event', event_id, sha256(event_type) FROM events UNION ALL SELECT 'post', post_id, semantic_fingerprint FROM posts"""
)
def kind_union(spark, base):
    documents = load(spark, base, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("key"), F.sha2("text", 256).alias("fp"))
    events = load(spark, base, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("key"), F.sha2("event_type", 256).alias("fp"))
    posts = load(spark, base, "posts").select(F.lit("post").alias("kind"), F.col("post_id").alias("key"), F.col("semantic_fingerprint").alias("fp"))
    return documents.unionByName(events).unionByName(posts)


@_query(
    """SELECT unnest(['kind', 'parse_status', 'time_range', 'hash_length', 'fingerprint_of_parsed']) AS name,
    unnest([count_if(source_kind NOT IN ('timeline', 'archive', 'trash', 'reel', 'video_metadata', 'photo_metadata', 'album_metadata', 'checkin_metadata', 'sharing_link_metadata')),
      count_if(parse_status NOT IN ('parsed', 'partial', 'unsupported', 'failed')), count_if(NOT created_timestamp BETWEEN 0 AND 9007199254740991), count_if(length(raw_sha256) <> 64),
      count_if(parse_status = 'parsed' AND semantic_fingerprint IS NULL)]) AS n FROM source_records"""
)
def check_constraints(spark, base):
    from quillmere.operators.ordering import KIND_ORDER

    checks = {
        "kind": F.col("source_kind").isin(*KIND_ORDER),
        "parse_status": F.col("parse_status").isin("parsed", "partial", "unsupported", "failed"),
        "time_range": F.col("created_timestamp").between(0, 2**53 - 1),
        "hash_length": F.length("raw_sha256") == 64,
        "fingerprint_of_parsed": ~((F.col("parse_status") == "parsed") & F.col("semantic_fingerprint").isNull()),
    }
    return U.violations(load(spark, base, "source_records"), checks)


@_query(
    """SELECT import_run_id, max(CASE parse_status WHEN 'failed' THEN 2 WHEN 'partial' THEN 1 ELSE 0 END) AS severity, count(*) AS files
    FROM (SELECT DISTINCT * FROM source_files) GROUP BY 1"""
)
def run_status(spark, base):
    severity = F.when(F.col("parse_status") == "failed", 2).when(F.col("parse_status") == "partial", 1).otherwise(0)
    return load(spark, base, "source_files").distinct().groupBy("import_run_id").agg(F.max(severity).alias("severity"), F.count("*").alias("files"))


@_query(
    """SELECT run_no, o.match_rule, count(*) AS n FROM (SELECT DISTINCT source_record_id, match_rule FROM post_observations) o
    JOIN (SELECT DISTINCT source_record_id, source_file_id FROM source_records) r USING (source_record_id) JOIN (SELECT DISTINCT source_file_id, import_run_id FROM source_files) f USING (source_file_id)
    JOIN import_runs USING (import_run_id) GROUP BY 1, 2"""
)
def rules_per_run(spark, base):
    observed = load(spark, base, "post_observations").select("source_record_id", "match_rule").distinct()
    records = load(spark, base, "source_records").select("source_record_id", "source_file_id").distinct()
    files = load(spark, base, "source_files").select("source_file_id", "import_run_id").distinct()
    runs = load(spark, base, "import_runs").select("import_run_id", "run_no")
    joined = observed.join(records, "source_record_id").join(files, "source_file_id").join(runs, "import_run_id")
    return joined.groupBy("run_no", "match_rule").agg(F.count("*").alias("n"))
