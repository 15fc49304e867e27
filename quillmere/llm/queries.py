"""Queries of the corpus problems (all but 2 and 3) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm import contamination, encoding, format_dedup, fusion, incremental_dedup, packing, pii, reading_level
from quillmere.session import keep, load

# --- 1: best representative of each duplicate group -----------------------------------------------------------------


def _post_claims(spark: SparkSession, base: str) -> DataFrame:
    observed = load(spark, base, "post_observations").select(
        F.col("post_id").alias("group"), F.col("source_record_id").alias("record"), F.col("match_rule").alias("source"), F.col("match_rank").alias("rank"), F.col("matched_at_utc").cast("timestamp").alias("seen")
    )
    records = load(spark, base, "normalized_records").withColumnRenamed("source_record_id", "record")
    ids, urls, names = fusion.usable_id(F.col("facebook_post_id")), fusion.usable_url(F.col("direct_post_url")), fusion.usable_name(F.col("place_name"))
    return fusion.claims(observed, records, {"facebook_post_id": (ids, ids), "direct_post_url": (urls, fusion.url_key(urls)), "place_name": (names, F.lower(names))})


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    """Per post and field the record of the most probable value, where the newest claim of all says it and is of an unmatched rank."""
    fused, _, _ = fusion.fuse(_post_claims(spark, base))
    return fusion.undisputed(fused).where("agrees").select(F.col("group").alias("post_id"), F.col("field").alias("field_name"), F.col("record").alias("source_record_id"))


def p1_representative(spark: SparkSession, base: str) -> DataFrame:
    """Per post observed in several records: the most probable value of each field, with its posterior and record."""
    fused, _, _ = fusion.fuse(_post_claims(spark, base))
    return fused.select(F.col("group").alias("post_id"), F.col("field").alias("field_name"), F.col("best.value").alias("value"), F.round("posterior", 4).alias("posterior"), F.col("best.record").alias("source_record_id"), "values")


P1_FOUND_SQL = r"""
WITH o AS (SELECT DISTINCT post_id, source_record_id, match_rank, matched_at_utc FROM post_observations),
s AS (SELECT post_id FROM o GROUP BY 1 HAVING count(DISTINCT source_record_id) > 1),
v AS (SELECT source_record_id, 'facebook_post_id' AS field_name, trim(facebook_post_id) AS v FROM normalized_records
        WHERE regexp_matches(trim(facebook_post_id), '^[0-9]{12,}$') AND length(replace(trim(facebook_post_id), left(trim(facebook_post_id), 1), '')) > 0
      UNION SELECT source_record_id, 'direct_post_url', direct_post_url FROM normalized_records
        WHERE regexp_matches(trim(direct_post_url), '(?i)^https?://[^/?#\s]+\.[^/?#\s]+/([^?#\s]*/)?[^/?#\s]*[0-9][^/?#\s]*/?([?#]\S*)?$')
      UNION SELECT source_record_id, 'place_name', place_name FROM normalized_records
        WHERE regexp_matches(place_name, '[\p{L}\p{N}]') AND lower(trim(place_name)) NOT IN
          ('', '-', '--', 'n/a', 'na', 'none', 'null', 'nil', 'undefined', 'unknown', '?', 'nan', '(no place)', 'no place', '(none)', '(unknown)', '(null)', 'tbd', '0', '#')),
c AS (SELECT o.*, field_name, max(matched_at_utc) OVER w AS last_at, min(match_rank) OVER w AS top_rank FROM o JOIN s USING (post_id) JOIN v USING (source_record_id)
      WINDOW w AS (PARTITION BY post_id, field_name))
SELECT post_id, field_name, min(source_record_id) AS source_record_id FROM c WHERE matched_at_utc = last_at AND match_rank = top_rank GROUP BY 1, 2
"""

# --- 4 and 6: text fields -------------------------------------------------------------------------------------------


def _posts(spark: SparkSession, base: str) -> DataFrame:
    """Each post text of the timeline records."""
    posts = load(spark, base, "timeline_records").select(F.col("source_record_id").alias("record"), F.posexplode("data").alias("position", "d"))
    return posts.select("record", F.lit("post").alias("field"), "position", F.col("d.post").alias("text"))


def _titles(spark: SparkSession, base: str) -> DataFrame:
    return load(spark, base, "timeline_records").select(F.col("source_record_id").alias("record"), F.lit("title").alias("field"), F.lit(0).alias("position"), F.col("title").alias("text"))


def _masked(spark: SparkSession, base: str) -> DataFrame:
    fields = _posts(spark, base).unionByName(_titles(spark, base))
    proposed = keep(pii.propose(fields, pii.learn_names(fields)))
    return pii.find(proposed, pii.learn(proposed))


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    """The types of personal data in each post and title."""
    return _masked(spark, base).select(F.col("record").alias("source_record_id"), F.col("field").alias("field_name"), F.explode("kinds").alias("entity_type")).distinct()


def p4_masked(spark: SparkSession, base: str) -> DataFrame:
    """Posts and titles with personal data, typed placeholders in its place."""
    return _masked(spark, base).select(F.col("record").alias("source_record_id"), F.col("field").alias("field_name"), "position", "masked")


def _text_fields(spark: SparkSession, base: str) -> DataFrame:
    places = load(spark, base, "normalized_records").select(F.col("source_record_id").alias("record"), F.lit("place_name").alias("field"), F.lit(0).alias("position"), F.col("place_name").alias("text"))
    return _posts(spark, base).unionByName(_titles(spark, base)).unionByName(places)


def _restored(spark: SparkSession, base: str) -> DataFrame:
    fields = _text_fields(spark, base).where(encoding.beyond_ascii(F.col("text")))
    return encoding.restore_fields(fields, encoding.train_on(fields))


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    """The garbled fields with the hash of their restored text, or an empty one where characters are lost."""
    digest = F.when(F.col("restored").isNull(), F.lit("")).otherwise(F.sha2("restored", 256))
    return _restored(spark, base).select(F.col("record").alias("source_record_id"), F.col("field").alias("field_name"), digest.alias("restored_sha256"))


def p6_restored(spark: SparkSession, base: str) -> DataFrame:
    """The garbled fields with the chain of wrong decodings found in them and their restored text (null where lost)."""
    return _restored(spark, base).select(F.col("record").alias("source_record_id"), F.col("field").alias("field_name"), "chain", "restored")


# --- 5: new batches against all history -----------------------------------------------------------------------------


def _batches(spark: SparkSession, base: str) -> DataFrame:
    """The parsed records with their run, exact keys and batch: 0 for what the index holds, 1 for the pending runs, which arrive together."""
    files = load(spark, base, "source_files").select("source_file_id", "import_run_id").dropDuplicates(["source_file_id"])
    runs = load(spark, base, "import_runs").select("import_run_id", F.col("run_no").alias("run"), F.when(F.col("status") == "running", 1).otherwise(0).alias("batch")).dropDuplicates(["import_run_id"])
    records = load(spark, base, "source_records").where("parse_status = 'parsed'").select(
        F.col("source_record_id").alias("record"), "source_file_id", "semantic_fingerprint", "raw_sha256", fusion.usable_id(F.col("facebook_post_id")).alias("post_key")
    )
    return records.join(files, "source_file_id").join(runs, "import_run_id")


def _contents(spark: SparkSession, base: str) -> DataFrame:
    return load(spark, base, "normalized_records").select(
        F.col("source_record_id").alias("record"), F.col("created_timestamp").alias("ts"), F.col("normalized_post_text").alias("text"), F.col("normalized_media_references").alias("media"), F.col("normalized_external_urls").alias("links")
    )


def _first_deliveries(spark: SparkSession, base: str) -> DataFrame:
    """Each pending record with the record of its class's first run: record, run, first_record, first_run."""
    classed = incremental_dedup.repeats(_batches(spark, base), _contents(spark, base), ["semantic_fingerprint", "raw_sha256", "post_key"])
    (run, record), (first_run, first_record) = incremental_dedup.split_order(F.col("order")), incremental_dedup.split_order(F.col("label"))
    runs = load(spark, base, "import_runs").where("status = 'running'").select(F.col("run_no").alias("run")).distinct()
    spread = classed.select(record.alias("record"), run.alias("run"), first_record.alias("first_record"), first_run.alias("first_run"))
    return spread.join(runs, "run", "left_semi")


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    """Every pending record of a post that an earlier run delivered, with the post's record of its first run."""
    found = _first_deliveries(spark, base).where("first_run < run")
    return found.select(F.least("record", "first_record").alias("source_record_id_a"), F.greatest("record", "first_record").alias("source_record_id_b"))


def p5_split(spark: SparkSession, base: str) -> DataFrame:
    """Every pending record, whether it is new or repeats an earlier run, and the record it repeats."""
    repeated = F.col("first_run") < F.col("run")
    return _first_deliveries(spark, base).select(F.col("record").alias("source_record_id"), "run", F.when(repeated, "repeat").otherwise("new").alias("kind"), F.when(repeated, F.col("first_record")).alias("repeats"))


# --- 7: duplicates hidden by formatting differences -----------------------------------------------------------------


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    """Every record that differs only in form from one of a smaller id, with the smallest such id."""
    keys = format_dedup.format_keys_of_records(load(spark, base, "normalized_records"))
    return format_dedup.duplicates(keys).select(F.col("keep").alias("keep_id"), F.col("record").alias("source_record_id"))


def p7_copies(spark: SparkSession, base: str) -> DataFrame:
    """Every distinct record by its smallest id, with the number of copies and whether its 128-bit hash collided."""
    keys = format_dedup.format_keys_of_records(load(spark, base, "normalized_records"))
    return format_dedup.collapse(keys).select(F.col("keep").alias("keep_id"), "copies", "collided")


_P7_CANON = r"""
WITH c AS (
  SELECT DISTINCT source_record_id,
    replace(lower(upper(regexp_replace(coalesce(normalized_post_text, ''), '[\s\p{Z}\p{P}\p{Cc}\p{Cf}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{3164}\x{FFA0}\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}]+', '', 'g'))), 'ß', 'ss') AS t,
    list_sort(list_transform(coalesce(normalized_media_references, []), lambda x: lower(upper(regexp_replace(coalesce(x, ''), '[\s\p{Z}\p{P}\p{Cc}\p{Cf}]+', '', 'g'))))) AS m,
    list_sort(list_transform(coalesce(normalized_external_urls, []), lambda x: lower(upper(regexp_replace(split_part(coalesce(x, ''), '?', 1), '[\s\p{Z}\p{P}\p{Cc}\p{Cf}]+', '', 'g')))
      || '?' || array_to_string(list_sort(list_transform(string_split_regex(CASE WHEN instr(x, '?') > 0 THEN substr(x, instr(x, '?') + 1) ELSE '' END, '[&;]'),
          lambda p: lower(upper(regexp_replace(p, '[\s\p{Z}\p{P}\p{Cc}\p{Cf}]+', '', 'g'))))), '&'))) AS u
  FROM normalized_records),
k AS (SELECT source_record_id, t || chr(2) || array_to_string(m, chr(1)) || chr(2) || array_to_string(u, chr(1)) AS k
      FROM c WHERE t <> '' OR array_to_string(m, '') <> '' OR replace(array_to_string(u, ''), '?', '') <> '')
"""
P7_FOUND_SQL = _P7_CANON + "SELECT * FROM (SELECT min(source_record_id) OVER (PARTITION BY k) AS keep_id, source_record_id FROM k) WHERE keep_id <> source_record_id"
P7_COPIES_SQL = _P7_CANON + "SELECT min(source_record_id) AS keep_id, count(*) AS copies, false AS collided FROM k GROUP BY k"

# --- 8: containers of fixed capacity ---------------------------------------------------------------------------------

CAPACITY = 2048


def p8_packed(spark: SparkSession, base: str) -> DataFrame:
    """Every speech, or piece of one longer than a container, with its tokens, container and position."""
    documents = load(spark, base, "documents").select(F.col("doc_id").alias("doc"), "text")
    return packing.pack(packing.token_counts(documents), CAPACITY).withColumnRenamed("doc", "doc_id")


def p8_fill(spark: SparkSession, base: str) -> DataFrame:
    """Containers, tokens and the share of room used."""
    packed = p8_packed(spark, base).groupBy("container").agg(F.sum("length").alias("used"))
    return packed.agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"), F.round(F.sum("used") / (F.count("*") * CAPACITY), 4).alias("share_used"))


# --- 9: evaluation texts leaking into training text -----------------------------------------------------------------


def _leaks(spark: SparkSession, base: str) -> DataFrame:
    documents = load(spark, base, "documents").select(F.col("doc_id").alias("doc"), "text")
    return contamination.leaks(documents, load(spark, base, "eval_items").select(F.col("item_id").alias("item"), "text"))


def p9_found(spark: SparkSession, base: str) -> DataFrame:
    """The speeches that hold a passage of an evaluation item."""
    return _leaks(spark, base).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p9_items(spark: SparkSession, base: str) -> DataFrame:
    """The evaluation items that leaked, with the number of speeches and the most words found in one."""
    return _leaks(spark, base).groupBy(F.col("item").alias("item_id")).agg(F.count("*").alias("speeches"), F.max("words").alias("most_words"))


# --- 10: reading level ----------------------------------------------------------------------------------------------


def _levels(spark: SparkSession, base: str) -> DataFrame:
    documents = load(spark, base, "documents").select(F.col("doc_id").alias("doc"), "text")
    return reading_level.levels(documents, load(spark, base, "reading_labels").withColumnRenamed("doc_id", "doc"))


def p10_found(spark: SparkSession, base: str) -> DataFrame:
    """The reading band of every English speech of at least 60 words."""
    return _levels(spark, base).select(F.col("doc").alias("doc_id"), "band")


def p10_profile(spark: SparkSession, base: str) -> DataFrame:
    """Speeches and words per source and reading band."""
    levels = _levels(spark, base).select(F.col("doc").alias("doc_id"), "band")
    return load(spark, base, "documents").select("doc_id", "source", "n_chars").join(levels, "doc_id").groupBy("source", "band").agg(F.count("*").alias("speeches"), F.sum("n_chars").alias("chars"))


QUERIES = {
    "p1_found": p1_found,
    "p1_representative": p1_representative,
    "p4_found": p4_found,
    "p4_masked": p4_masked,
    "p5_found": p5_found,
    "p5_split": p5_split,
    "p6_found": p6_found,
    "p6_restored": p6_restored,
    "p7_found": p7_found,
    "p7_copies": p7_copies,
    "p8_packed": p8_packed,
    "p8_fill": p8_fill,
    "p9_found": p9_found,
    "p9_items": p9_items,
    "p10_found": p10_found,
    "p10_profile": p10_profile,
}
ORACLE = {
    "p1_found": P1_FOUND_SQL,
    "p7_found": P7_FOUND_SQL,
    "p7_copies": P7_COPIES_SQL,
}
