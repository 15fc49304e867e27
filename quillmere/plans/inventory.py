"""The inventory: validation of export roots, import runs into a store, and their reports."""

from __future__ import annotations

import datetime as dt
import os
import resource
import uuid
from dataclasses import asdict
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmere.operators.ordering import KIND_ORDER, kind_rank
from quillmere.operators.resolution import DECISION, ENTITY, MAX_BLOCK, resolve_blocks
from quillmere.operators.upsert import duplicate_keys, insert_or_ignore, orphans, touch, violations
from quillmere.session import cut
from quillmere.sources.discovery import Collection, DiscoveryError, discover, spark_hashes
from quillmere.sources.records import MEDIA_KINDS, RECORDS, read_records
from quillmere.sources.store import Store, writer

ERROR_CAP = 100

RECORD_TABLE = f"run_id string, record_id string, {RECORDS}"
OBSERVATION = "run_id string, record_id string, entity_id string, rule string, rank int, changed boolean, matched_at string"
EVIDENCE = "run_id string, record_id string, entity_id string, state string, confirmed boolean, observed_at string"
ERROR = "run_id string, relative_path string, root_number int, record_index long, code string"
MEDIA = "reference_key string, reference string, media_type string, created long, metadata string"
PLACE_LINK = "entity_id string, place_key string, first_collected string, last_collected string"
PLACE = "place_key string, place_name string, metadata string"
FILE = "run_id string, root_number int, relative_path string, kind string, sequence long, size_bytes long, sha256 string, parse_status string, records long, errors long"
PROFILE = "profile_id string, created_at string"
COLLECTION = "profile_id string, collection_id string, root_count int, first_seen_at string"
RUN = "run_id string, collection_id string, started_at string, completed_at string, status string, examined long, matched long, created long, updated long, ambiguous long, skipped long, errors long"


def _now() -> str:
    return dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"


def _iso(seconds: int | None) -> str | None:
    return None if seconds is None else dt.datetime.fromtimestamp(seconds, dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.000Z")


# --- validation ------------------------------------------------------------------------------------------------------


def file_validation(records: DataFrame) -> DataFrame:
    """Per file: examined, parsed, fingerprinted, partial, unsupported, failed, first and last time, errors."""
    counted = [F.count_if(F.col("parse_status") == s).alias(s) for s in ("parsed", "partial", "unsupported", "failed")]
    return records.groupBy("root_number", "relative_path", "kind").agg(
        F.count("record_index").alias("examined"), *counted, F.count("fingerprint").alias("fingerprinted"), F.min("created_timestamp").alias("first"), F.max("created_timestamp").alias("last"), F.count("error_code").alias("errors")
    )


def validation_totals(files: DataFrame) -> DataFrame:
    """One row over the files of :func:`file_validation`: sums, first and last time, and the worst status of any file."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("examined", "parsed", "fingerprinted", "partial", "unsupported", "failed", "errors")]
    worst = F.max(F.when(F.col("failed") > 0, 2).when(F.col("errors") > 0, 1).otherwise(0))
    status = F.when(worst == 2, "failed").when(worst == 1, "completed_with_errors").otherwise("completed")
    return files.agg(F.count("*").alias("files"), *sums, F.min("first").alias("first"), F.max("last").alias("last"), status.alias("status"))


def capped_errors(records: DataFrame, cap: int = ERROR_CAP) -> DataFrame:
    """The first ``cap`` errors of each file, by place in the file."""
    order = Window.partitionBy("root_number", "relative_path").orderBy(F.col("record_index").asc_nulls_first(), "error_code")
    return records.where("error_code IS NOT NULL").select("root_number", "relative_path", "record_index", "error_code").withColumn("n", F.row_number().over(order)).where(F.col("n") <= cap).select("root_number", "relative_path", "record_index", F.col("error_code").alias("code"))


def validate_collection(spark: SparkSession, roots: list[str]) -> dict:
    """Reads the timeline files of the roots and reports on them; discovery errors become part of the report."""
    report = {"report_schema_version": 1, "mode": "validate", "status": "failed", "files": [], "errors": [], "summary": {}}
    try:
        collection = discover(roots, hashes=spark_hashes(spark))
    except DiscoveryError as e:
        return report | {"errors": [{"code": e.code, "root_number": e.root_number}]}
    records = cut(read_records(spark, collection))
    per_file = cut(file_validation(records))
    files, totals = {(r.root_number, r.relative_path): r.asDict() for r in per_file.collect()}, validation_totals(per_file).first()
    errors = [r.asDict() for r in capped_errors(records).orderBy("root_number", "relative_path", F.col("record_index").asc_nulls_first()).collect()]
    empty = {"examined": 0, "parsed": 0, "partial": 0, "unsupported": 0, "failed": 0, "fingerprinted": 0, "first": None, "last": None, "errors": 0}
    for f in collection.files:
        row = {**empty, **files.get((f.root_number, f.relative_path), {})}
        own = [e for e in errors if (e["root_number"], e["relative_path"]) == (f.root_number, f.relative_path)]
        status = "failed" if row["failed"] else "completed_with_errors" if row["errors"] else "completed"
        report["files"].append({**{k: row[k] for k in empty if k not in ("first", "last", "failed")}, "root_number": f.root_number, "relative_path": f.relative_path, "size_bytes": f.size_bytes, "sha256": f.sha256, "status": status, "earliest_utc": _iso(row["first"]), "latest_utc": _iso(row["last"]), "retained_errors": own, "errors_truncated": row["errors"] > len(own)})
    report["status"] = totals.status
    report["summary"] = {k: totals[k] for k in ("examined", "parsed", "fingerprinted", "partial", "unsupported", "errors")} | {"files": len(collection.files), "roots": collection.root_count, "collection_fingerprint": collection.fingerprint, "earliest_utc": _iso(totals["first"]), "latest_utc": _iso(totals["last"])}
    report["errors"] = errors
    return report


# --- import ----------------------------------------------------------------------------------------------------------


def _with_ids(records: DataFrame, run_id: str) -> DataFrame:
    identified = F.sha2(F.concat_ws("|", F.lit(run_id), F.col("root_number").cast("string"), "relative_path", F.coalesce(F.col("record_index").cast("string"), F.lit("-"))), 256)
    return records.select(F.lit(run_id).alias("run_id"), F.substring(identified, 1, 32).alias("record_id"), "*")


def media_dimension(known: DataFrame, attached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New media dimension and the records that changed it: record_id.

    ``attached``: record_id, seq (processing order over the run), kind, type (of the post), reference, detail type,
    created and metadata. The first record to name a reference inserts it; records of media kinds overwrite its values,
    and change it where any differs from what the one before them left.
    """
    keyed = attached.withColumn("reference_key", F.sha2(F.lower("reference"), 256))
    plain = F.when(F.col("type").isin("photo", "video"), F.col("type")).otherwise("unknown")
    first = Window.partitionBy("reference_key").orderBy("seq", "ordinal")
    old = known.select("reference_key", F.struct("media_type", "created", "metadata").alias("old"), F.col("reference").alias("old_reference"))
    overwrites = F.col("kind").isin(*MEDIA_KINDS) & F.col("has_detail")
    state = F.struct(F.col("detail_type").alias("media_type"), F.col("detail_created").alias("created"), F.col("detail_metadata").alias("metadata"))
    inserted = F.struct(plain.alias("media_type"), F.lit(None).cast("long").alias("created"), F.lit(None).cast("string").alias("metadata"))
    rows = keyed.join(old, "reference_key", "left").withColumn("new", F.col("old").isNull() & (F.row_number().over(first) == 1))
    rows = rows.withColumn("after", F.when(overwrites, state).when(F.col("new"), inserted))
    before = F.coalesce(F.last("after", ignorenulls=True).over(first.rowsBetween(Window.unboundedPreceding, -1)), F.col("old"))
    rows = rows.withColumn("touched", F.col("new") | (overwrites & ~F.col("after").eqNullSafe(before)))
    changed = rows.where("touched").select("record_id").distinct()
    latest = rows.groupBy("reference_key").agg(
        F.coalesce(F.max_by("after", F.when(F.col("after").isNotNull(), F.struct("seq", "ordinal"))), F.first("old")).alias("s"), F.coalesce(F.first("old_reference"), F.min_by("reference", F.struct("seq", "ordinal"))).alias("reference")
    )
    touched = latest.select("reference_key", "reference", "s.media_type", "s.created", "s.metadata")
    return known.join(touched.select("reference_key"), "reference_key", "left_anti").select("reference_key", "reference", "media_type", "created", "metadata").unionByName(touched), changed


def _attached(records: DataFrame, decided: DataFrame) -> DataFrame:
    """Media references of matched and created records, with the details of media records and their processing order."""
    seq = F.struct(kind_rank(F.col("kind")).alias("k"), F.col("fingerprint"), F.col("raw_sha256"), F.col("relative_path"), F.col("record_index"), F.col("record_id"))
    rows = records.join(decided.where("match_status IN ('matched', 'created')").select("record_id"), "record_id")
    rows = rows.select("record_id", "kind", F.col("post_type").alias("type"), seq.alias("seq"), "media_details", F.posexplode("media_references").alias("ordinal", "reference"))
    detail = F.get(F.filter("media_details", lambda d: d.reference == F.col("reference")), F.lit(0))
    return rows.withColumn("d", detail).select("record_id", "kind", "type", "seq", "ordinal", "reference", F.col("d").isNotNull().alias("has_detail"), F.col("d.media_type").alias("detail_type"), F.col("d.created").alias("detail_created"), F.col("d.metadata").alias("detail_metadata"))


def import_collection(spark: SparkSession, roots: list[str], store_folder: str, profile: str = "default", max_block: int = MAX_BLOCK) -> dict:
    """Imports all source kinds of the roots into the store and reports on the run.

    A run is one commit: it shows wholly or, if it fails, only its header, records, files and errors. A run fails where a
    file can't be read, or where resolving or writing breaks off (``DATABASE_WRITE_FAILED``). Repeating it changes nothing.
    """
    collection = discover(roots, all_kinds=True, hashes=spark_hashes(spark))
    with writer(store_folder):
        return _import(spark, collection, Store(spark, store_folder), profile, max_block)


def _import(spark: SparkSession, collection: Collection, store: Store, profile: str, max_block: int) -> dict:
    run_id, started = uuid.uuid4().hex, _now()
    records = cut(_with_ids(read_records(spark, collection), run_id))
    errors = records.where("error_code IS NOT NULL").select("run_id", "relative_path", "root_number", "record_index", F.col("error_code").alias("code"))
    failed = records.where("parse_status = 'failed'").limit(1).count() > 0
    entities = store.read("entities", ENTITY).where(F.col("profile_id") == profile)
    decided = spark.createDataFrame([], DECISION)
    if not failed:
        try:
            decided, conflicts = _resolved(spark, store, records, entities, profile, run_id, started, max_block)
            errors = errors.unionByName(conflicts)
        except Exception:  # noqa: BLE001 - whatever broke the run is told by its code, and nothing of it shows
            failed = True
            store.discard()
            errors = errors.unionByName(spark.createDataFrame([(run_id, None, None, None, "DATABASE_WRITE_FAILED")], errors.schema))
    errors = cut(errors)
    metrics = _metrics(records, decided, errors)
    status = "failed" if failed else "completed_with_errors" if metrics["errors"] else "completed"
    files = {(r.root_number, r.relative_path): r for r in file_validation(records).collect()}
    file_rows = []
    for f in collection.files:
        r = files.get((f.root_number, f.relative_path))
        state = "failed" if r and r.failed else "partial" if r and r.errors else "completed"
        file_rows.append((run_id, f.root_number, f.relative_path, f.kind, f.sequence, f.size_bytes, f.sha256, state, r.examined if r else 0, r.errors if r else 0))
    completed = _now()
    run = (run_id, collection.fingerprint, started, completed, status, *[metrics[k] for k in ("examined", "matched", "created", "updated", "ambiguous", "skipped", "errors")])
    store.write("records", records.select(*[c.split(" ")[0] for c in ("run_id", "record_id")], *[c for c in records.columns if c not in ("run_id", "record_id")]))
    store.write("errors", errors)
    store.write("files", spark.createDataFrame(file_rows, FILE))
    store.write("runs", spark.createDataFrame([run], RUN))
    # Profile and collection are there once, whoever names them first.
    for table, schema, keys, row in (("profiles", PROFILE, ["profile_id"], (profile, started)), ("collections", COLLECTION, ["profile_id", "collection_id"], (profile, collection.fingerprint, collection.root_count, started))):
        known = store.read(table, schema)
        added = insert_or_ignore(known, spark.createDataFrame([row], schema), keys, keys)
        store.write(table, cut(added), replace=True)
    store.commit()
    return _report(store, collection, run, metrics, files, errors, profile)


def place_dimension(known: DataFrame, named: DataFrame) -> DataFrame:
    """Known places and the new ones of ``named`` (record_id, place_reference, place_name, seq); the first record to name a place names it."""
    new = named.where("place_reference IS NOT NULL").groupBy(F.sha2("place_reference", 256).alias("place_key"))
    rows = new.agg(F.min_by("place_name", F.struct("seq", "record_id")).alias("place_name"), F.min("place_reference").alias("metadata"))
    return known.unionByName(rows.join(known.select("place_key"), "place_key", "left_anti"))


def state_evidence(kept: DataFrame) -> DataFrame:
    """What archive and trash records say about their entity: record_id, entity_id, state, confirmed. ``kept``: record_id, entity_id, kind."""
    state = F.when(F.col("kind") == "trash", "trash").otherwise("archived")
    return kept.where("kind IN ('archive', 'trash')").select("record_id", "entity_id", state.alias("state"), F.lit(True).alias("confirmed"))


def _resolved(spark: SparkSession, store: Store, records: DataFrame, entities: DataFrame, profile: str, run_id: str, started: str, max_block: int) -> tuple[DataFrame, DataFrame]:
    """Decisions and conflicts of a run; the tables they change are written, to be shown by the commit."""
    others = store.read("entities", ENTITY).where(F.col("profile_id") != profile)
    media, places = store.read("media", MEDIA), store.read("places", PLACE)
    parsed = records.where("parse_status = 'parsed'")
    decided, entities = resolve_blocks(parsed, entities, profile, started, max_block)
    media, media_changed = media_dimension(media, _attached(parsed, decided))
    media, media_changed = cut(media), cut(media_changed)
    taken = decided.where("match_status IN ('matched', 'created') AND kind = 'checkin_metadata'").select("record_id")
    places = cut(place_dimension(places, parsed.join(taken, "record_id").select("record_id", "place_reference", "place_name", F.struct("fingerprint", "raw_sha256").alias("seq"))))
    decided = cut(decided.join(media_changed.withColumn("_m", F.lit(True)), "record_id", "left").withColumn("changed", (F.col("changed") | F.coalesce("_m", F.lit(False))) & F.col("match_status").isin("matched", "created")).drop("_m"))
    conflicts = decided.where("match_status = 'ambiguous'").select(F.lit(run_id).alias("run_id"), F.lit(None).cast("string").alias("relative_path"), F.lit(None).cast("int").alias("root_number"), F.lit(None).cast("long").alias("record_index"), F.lit("IDENTITY_CONFLICT").alias("code"))
    now = F.lit(_now())
    kept = decided.where("match_status IN ('matched', 'created')")
    store.write("observations", kept.select(F.lit(run_id).alias("run_id"), "record_id", "entity_id", "rule", "rank", "changed", now.alias("matched_at")))
    store.write("evidence", state_evidence(kept).select(F.lit(run_id).alias("run_id"), "*", now.alias("observed_at")))
    store.write("entities", entities.unionByName(others), replace=True)
    store.write("media", media, replace=True)
    store.write("places", places, replace=True)
    visits = parsed.where("kind = 'checkin_metadata' AND place_reference IS NOT NULL").join(kept.select("record_id", "entity_id"), "record_id")
    visits = visits.select("entity_id", F.sha2("place_reference", 256).alias("place_key"), now.alias("at"))
    store.write("place_links", touch(store.read("place_links", PLACE_LINK), visits, ["entity_id", "place_key"], "first_collected", "last_collected"), replace=True)
    return decided, conflicts


def _metrics(records: DataFrame, decided: DataFrame, errors: DataFrame) -> dict:
    grouped = decided.groupBy("match_status", "rule").agg(F.count("*").alias("n")).collect()
    status = lambda s: sum(r.n for r in grouped if r.match_status == s)
    rules: dict[str, int] = {}
    for r in grouped:
        if r.match_status != "ambiguous" and r.rule != "M09":
            rules[r.rule] = rules.get(r.rule, 0) + r.n
    placed, bad = F.col("record_index").isNotNull(), F.col("error_code").isNotNull()
    read = records.agg(F.count_if(placed).alias("examined"), F.count_if(placed & bad).alias("bad"), F.count_if(placed & bad & F.col("kind").isin(*KIND_ORDER[4:])).alias("bad_enrichment")).first()
    if unmatched := status("skipped") + read.bad_enrichment:
        rules["M09"] = unmatched
    return {
        "examined": read.examined,
        "matched": status("matched"),
        "created": status("created"),
        "updated": decided.where("match_status = 'matched' AND changed").select("entity_id").distinct().count(),
        "ambiguous": status("ambiguous"),
        "skipped": status("skipped") + read.bad,
        "errors": errors.count(),
        "rules": dict(sorted(rules.items())),
    }


def integrity(store: Store) -> str:
    """``ok``, or the names of the assertions that fail: unique keys, references, and the checks of ranges, enumerations and pairs."""
    entities = store.read("entities", ENTITY)
    checks = {
        "entity_id": duplicate_keys(entities, ["entity_id"]),
        "external_id": duplicate_keys(entities, ["profile_id", "external_id"]),
        "address": duplicate_keys(entities, ["profile_id", "normalized_url"]),
        "slot": duplicate_keys(entities, ["profile_id", "fingerprint", "slot"]),
        "observed_entity": orphans(store.read("observations", OBSERVATION), entities, "entity_id", "entity_id"),
        "evidence_entity": orphans(store.read("evidence", EVIDENCE), entities, "entity_id", "entity_id"),
    }
    records, safe = store.read("records", RECORD_TABLE), 2**53 - 1
    rules = (
        (entities, {
            "entity_time": F.col("ts").between(0, safe), "entity_slot": F.col("slot") >= 1, "entity_state": F.col("state").isin("active", "archived", "trash"), "entity_state_status": F.col("state_status").isin("derived", "confirmed"),
            "entity_type": F.col("type").isin("text", "photo", "video", "mixed", "link", "check_in", "reel", "unknown"), "entity_fingerprint": F.length("fingerprint") == 64, "entity_addresses": F.col("direct_url").isNull() == F.col("normalized_url").isNull(),
        }),
        (records, {
            "record_kind": F.col("kind").isin(*KIND_ORDER), "record_status": F.col("parse_status").isin("parsed", "partial", "unsupported", "failed"), "record_time": F.col("created_timestamp").between(0, safe),
            "record_error": (F.col("parse_status") == "parsed") == F.col("error_code").isNull(), "record_hashes": (F.col("parse_status") != "parsed") | ((F.length("raw_sha256") == 64) & (F.length("fingerprint") == 64)),
            "record_json": F.col("raw_json").isNull() | F.try_parse_json("raw_json").isNotNull(),
        }),
        (store.read("runs", RUN), {"run_status": F.col("status").isin("completed", "completed_with_errors", "failed"), "run_times": F.col("completed_at") >= F.col("started_at")}),
    )
    broken = [df.limit(1).select(F.lit(name).alias("name")) for name, df in checks.items()]
    broken += [violations(df, rule).where("n > 0").select("name") for df, rule in rules]
    found = reduce(DataFrame.unionByName, broken)
    return ",".join(sorted(r.name for r in found.collect())) or "ok"


def bridges(store: Store) -> dict[str, DataFrame]:
    """Relations of the entities of a store: media, links and places, with ordinals."""
    return relations(store.read("entities", ENTITY))


def relations(entities: DataFrame) -> dict[str, DataFrame]:
    """Relations of entities (entity_id, media, links, places): one table each, with ordinals."""
    return {
        "entity_media": entities.select("entity_id", F.posexplode("media").alias("ordinal", "reference")).select("entity_id", "ordinal", F.sha2(F.lower("reference"), 256).alias("reference_key")),
        "entity_links": entities.select("entity_id", F.posexplode("links").alias("ordinal", "link")).select("entity_id", "ordinal", "link.*"),
        "entity_places": entities.select("entity_id", F.explode("places").alias("place_key")),
    }


def _report(store: Store, collection: Collection, run: tuple, metrics: dict, files: dict, errors: DataFrame, profile: str) -> dict:
    """The report of a run: counts, codes and relative places, never content."""
    entities = store.read("entities", ENTITY).where(F.col("profile_id") == profile)
    total = entities.agg(
        F.count("*").alias("n"), F.min("ts").alias("earliest"), F.max("ts").alias("latest"), F.count_if(F.col("external_id").isNull()).alias("no_id"), F.count_if(F.col("direct_url").isNull()).alias("no_url"),
        F.sum(F.size("media")).alias("media"), F.sum(F.size("links")).alias("links"), F.sum(F.size("places")).alias("places"),
    ).first()
    issues = [r.asDict() for r in errors.select("code", "root_number", "relative_path", "record_index").orderBy("root_number", "relative_path", "record_index").limit(ERROR_CAP).collect()]
    per_kind = {k: sum(f.kind == k for f in collection.files) for k in KIND_ORDER}
    started, completed = (dt.datetime.fromisoformat(x.replace("Z", "+00:00")) for x in run[2:4])
    size = sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(store.folder) for f in names)
    return {
        "report_schema_version": 2, "mode": "import", "status": run[4], "run_id": run[0], "collection_id": run[1], "started_at_utc": run[2], "completed_at_utc": run[3],
        "duration_ms": int((completed - started).total_seconds() * 1000), "peak_rss_bytes": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024, "store_size_bytes": size,
        "root_count": collection.root_count, "collection_fingerprint": collection.fingerprint, "files_per_kind": per_kind,
        "records_examined": metrics["examined"], "records_matched": metrics["matched"], "posts_added": metrics["created"], "posts_updated": metrics["updated"], "records_ambiguous": metrics["ambiguous"],
        "records_skipped": metrics["skipped"], "error_count": metrics["errors"], "integrity": integrity(store), "canonical_posts": total.n, "earliest_post_utc": _iso(total.earliest), "latest_post_utc": _iso(total.latest),
        "missing_ids": total.no_id, "missing_direct_urls": total.no_url, "missing_audience": total.n, "media_records": store.read("media", MEDIA).count(), "entity_media": total.media or 0, "link_records": total.links or 0,
        "place_records": store.read("places", PLACE).count(), "entity_places": total.places or 0,
        "post_type_counts": {r.type: r["count"] for r in entities.groupBy("type").count().orderBy("type").collect()}, "match_rule_counts": metrics["rules"],
        "error_code_counts": {r.code: r["count"] for r in errors.groupBy("code").count().orderBy("code").collect()},
        "files": [{k: v for k, v in asdict(f).items() if k != "path"} | {"records": files[key].examined if (key := (f.root_number, f.relative_path)) in files else 0, "errors": files[key].errors if key in files else 0} for f in collection.files],
        "issues": issues, "issues_truncated": metrics["errors"] > len(issues),
    }
