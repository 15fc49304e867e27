"""End-to-end imports over written exports."""

import json
import os

import pytest
from pyspark.sql import functions as F

from quillmere.cli import main, summary
from quillmere.operators.resolution import ENTITY
from quillmere.plans.inventory import bridges, import_collection, validate_collection
from quillmere.sources.discovery import DiscoveryError, discover
from quillmere.sources.store import Store, StoreLocked, writer

POSTS = "your_facebook_activity/posts"
TIMELINE = POSTS + "/your_posts__check_ins__photos_and_videos_{}.json"
DAY = 86400
T0 = 1704067200


def export(root, files):
    for path, value in files.items():
        full = root / path
        full.parent.mkdir(parents=True, exist_ok=True)
        full.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(root)


def text(ts, words, **more):
    return {"timestamp": ts, "data": [{"post": words}], **more}


def media(uri, **more):
    return {"data": [{"media": {"uri": uri, **more}}]}


def link(url, name=None):
    return {"data": [{"external_context": {"url": url} | ({"name": name} if name else {})}]}


def base_records():
    return [
        text(T0, "plain words"),
        text(T0 + DAY, "with a link", attachments=[link("https://example.com/a", "A site")]),
        text(T0 + 2 * DAY, "with a photo", attachments=[media("photos/a.jpg")]),
    ]


def test_repeat_changes_nothing(spark, tmp_path):
    root, store = export(tmp_path / "e", {TIMELINE.format(1): base_records()}), str(tmp_path / "s")
    first = import_collection(spark, [root], store)
    assert (first["status"], first["posts_added"], first["match_rule_counts"], first["integrity"]) == ("completed", 3, {"M08": 3}, "ok")
    assert first["post_type_counts"] == {"link": 1, "photo": 1, "text": 1}
    second = import_collection(spark, [root], store)
    assert (second["posts_added"], second["posts_updated"], second["match_rule_counts"], second["canonical_posts"]) == (0, 0, {"M03": 3}, 3)
    assert (second["media_records"], second["link_records"]) == (1, 1)
    held = Store(spark, store)
    assert held.read("records", "run_id string").count() == 6 and held.read("observations", "run_id string").count() == 6
    assert {n: df.count() for n, df in bridges(held).items()} == {"entity_media": 1, "entity_links": 1, "entity_places": 0}


def test_identical_posts_keep_slots(spark, tmp_path):
    root, store = export(tmp_path / "e", {TIMELINE.format(1): [text(T0, "same")] * 2}), str(tmp_path / "s")
    import_collection(spark, [root], store)
    slots = lambda: {r.entity_id: r.slot for r in Store(spark, store).read("entities", ENTITY).collect()}
    before = slots()
    assert sorted(before.values()) == [1, 2]
    again = import_collection(spark, [root], store)
    assert again["match_rule_counts"] == {"M03": 2} and slots() == before


def test_moves_between_files_and_absence(spark, tmp_path):
    store = str(tmp_path / "s")
    import_collection(spark, [export(tmp_path / "a", {TIMELINE.format(1): base_records()})], store)
    ids = {r.entity_id for r in Store(spark, store).read("entities", ENTITY).collect()}
    moved = export(tmp_path / "b", {TIMELINE.format(1): base_records()[:1], TIMELINE.format(2): base_records()[1:]})
    report = import_collection(spark, [moved], store)
    assert report["posts_added"] == 0 and {r.entity_id for r in Store(spark, store).read("entities", ENTITY).collect()} == ids
    fewer = import_collection(spark, [export(tmp_path / "c", {TIMELINE.format(1): base_records()[:1]})], store)
    assert fewer["canonical_posts"] == 3


def test_rule_ladder(spark, tmp_path):
    store = str(tmp_path / "s")
    old = [
        text(T0, "one", fbid="9001"),
        text(T0 + DAY, "two", post_url="https://social.example/p/2"),
        {"timestamp": T0 + 2 * DAY, "attachments": [media("m/Photo.JPG")]},
        {"timestamp": T0 + 3 * DAY, "attachments": [link("https://news.example/x#top")]},
        text(T0 + 4 * DAY, "five"),
        {"timestamp": T0 + 5 * DAY, "attachments": [{"data": [{"place": {"name": "Quay"}}]}]},
    ]
    new = [
        text(T0, "one changed", fbid="9001"),
        text(T0 + DAY, "two changed", post_url="https://social.example/p/2#c"),
        text(T0 + 2 * DAY, "caption", attachments=[media("m/photo.jpg")]),
        text(T0 + 3 * DAY, "comment", attachments=[link("https://news.example/x")]),
        text(T0 + 4 * DAY, "five", attachments=[{"data": [{"place": {"name": "Here"}}]}]),
        text(T0 + 5 * DAY, "at last"),
    ]
    import_collection(spark, [export(tmp_path / "a", {TIMELINE.format(1): old})], store)
    report = import_collection(spark, [export(tmp_path / "b", {TIMELINE.format(1): new})], store)
    assert report["match_rule_counts"] == {f"M0{k}": 1 for k in (1, 2, 4, 5, 6, 7)} and report["posts_updated"] == 6


def test_ambiguous_times_are_not_matched(spark, tmp_path):
    store = str(tmp_path / "s")
    import_collection(spark, [export(tmp_path / "a", {TIMELINE.format(1): [text(T0, "a"), text(T0, "b")]})], store)
    report = import_collection(spark, [export(tmp_path / "b", {TIMELINE.format(1): [text(T0, "c"), text(T0, "d")]})], store)
    assert report["match_rule_counts"] == {"M08": 2} and report["canonical_posts"] == 4


def test_states_and_reels(spark, tmp_path):
    store = str(tmp_path / "s")
    labelled = {"timestamp": T0, "fbid": "77", "label_values": [{"label": "Message", "value": "gone"}, {"label": "URL", "href": "https://social.example/p/77"}]}
    files = {
        TIMELINE.format(1): [text(T0, "gone"), text(T0 + DAY, "clip", attachments=[media("v/clip.mp4")])],
        POSTS + "/archive.json": [labelled],
        POSTS + "/trash.json": labelled,
        "your_facebook_activity/reels/your_reels.json": {"lasso_videos_v2": [text(T0 + DAY, "other words", attachments=[media("v/clip.mp4")]), text(T0 + 9 * DAY, "new reel")]},
    }
    report = import_collection(spark, [export(tmp_path / "e", files)], store)
    assert report["match_rule_counts"] == {"M01": 1, "M03": 1, "M04": 1, "M08": 3} and report["post_type_counts"] == {"reel": 2, "text": 1}
    gone = Store(spark, store).read("entities", ENTITY).where("external_id = '77'").first()
    assert (gone.state, gone.state_status, gone.direct_url) == ("trash", "confirmed", "https://social.example/p/77")
    assert Store(spark, store).read("evidence", "state string").count() == 2
    assert import_collection(spark, [str(tmp_path / "e")], store)["posts_updated"] == 0


def test_enrichment_kinds(spark, tmp_path):
    store = str(tmp_path / "s")
    shot = {"uri": "photos/a.jpg", "creation_timestamp": T0 + 2 * DAY, "media_metadata": {"photo_metadata": {"exif_data": []}}}
    lone = {"uri": "photos/z.jpg", "creation_timestamp": T0 + 50 * DAY}
    visit = {"timestamp": T0, "fbid": "55", "label_values": [{"label": "Message", "value": "plain words"}, {"label": "Location", "value": "Quay"}]}
    shared = {"timestamp": T0 + DAY, "fbid": "66", "label_values": [{"label": "URL", "value": "https://example.com/a"}]}
    files = {
        TIMELINE.format(1): base_records(),
        POSTS + "/your_uncategorized_photos.json": {"other_photos_v2": [shot, lone]},
        POSTS + "/your_videos.json": {"videos_v2": []},
        POSTS + "/album/0.json": {"name": "Al", "cover_photo": {"uri": "photos/q.jpg"}, "photos": [lone | {"uri": "photos/q.jpg"}, 5]},
        POSTS + "/check-ins.json": [visit],
        POSTS + "/content_sharing_links_you_have_created.json": [shared],
    }
    report = import_collection(spark, [export(tmp_path / "e", files)], store)
    assert report["status"] == "completed_with_errors" and report["error_code_counts"] == {"RECORD_UNSUPPORTED": 1}
    assert report["canonical_posts"] == 3 and report["match_rule_counts"]["M09"] == 3 and (report["place_records"], report["entity_places"]) == (1, 1)
    shared_post = Store(spark, store).read("entities", ENTITY).where("external_id = '66'").first()
    assert shared_post.direct_url is None and len(shared_post.links) == 2
    photo = Store(spark, store).read("media", "reference string, media_type string, created long").first()
    assert (photo.media_type, photo.created) == ("photo", T0 + 2 * DAY)
    repeat = import_collection(spark, [str(tmp_path / "e")], store)
    assert (repeat["posts_added"], repeat["posts_updated"]) == (0, 0)
    assert "albums: 2 records in 1 files, 1 errors" in summary(report)


def test_broken_file_fails_the_run_and_keeps_the_rest(spark, tmp_path):
    store = str(tmp_path / "s")
    import_collection(spark, [export(tmp_path / "a", {TIMELINE.format(1): base_records()})], store)
    report = import_collection(spark, [export(tmp_path / "b", {TIMELINE.format(1): "[{\"timestamp\": 1}, "})], store)
    assert (report["status"], report["error_code_counts"], report["canonical_posts"]) == ("failed", {"JSON_INVALID": 1}, 3)


def test_a_run_that_breaks_off_is_recorded(spark, tmp_path, monkeypatch):
    """Neither posts nor observations of a broken run show, its header, files, records and code do, and the next run is as if it had not been."""
    from quillmere.plans import inventory

    root, store = export(tmp_path / "e", {TIMELINE.format(1): base_records()}), str(tmp_path / "s")
    with monkeypatch.context() as m:
        m.setattr(inventory, "resolve_blocks", lambda *args: (_ for _ in ()).throw(RuntimeError("disk full")))
        report = import_collection(spark, [root], store)
    assert (report["status"], report["error_code_counts"], report["records_examined"], report["canonical_posts"], report["posts_added"]) == ("failed", {"DATABASE_WRITE_FAILED": 1}, 3, 0, 0)
    held = Store(spark, store)
    assert (held.read("runs", "status string").first().status, held.read("records", "run_id string").count(), held.read("observations", "run_id string").count()) == ("failed", 3, 0)
    assert "disk full" not in json.dumps(report)
    assert import_collection(spark, [root], store)["posts_added"] == 3 and import_collection(spark, [root], store)["match_rule_counts"] == {"M03": 3}
    assert (Store(spark, store).read("profiles", "profile_id string").count(), Store(spark, store).read("collections", "collection_id string").count()) == (1, 1)


def test_place_links_and_checks(spark, tmp_path):
    """A repeated visit moves the end of a place link; a store whose values break a rule is told by its name."""
    from quillmere.plans.inventory import PLACE_LINK, integrity

    checkin = {"timestamp": T0, "fbid": "9", "label_values": [{"label": "Location", "value": "Quay"}]}
    root, store = export(tmp_path / "e", {TIMELINE.format(1): [text(T0, "x", fbid="9")], POSTS + "/check-ins.json": [checkin]}), str(tmp_path / "s")
    seen = []
    for _ in range(2):
        assert import_collection(spark, [root], store)["integrity"] == "ok"
        seen.append(Store(spark, store).read("place_links", PLACE_LINK).collect())
    assert len(seen[0]) == len(seen[1]) == 1 and seen[0][0].first_collected == seen[1][0].first_collected and seen[0][0].last_collected < seen[1][0].last_collected
    held = Store(spark, store)
    entities = held.read("entities", ENTITY)
    held.write("entities", entities.withColumn("state", F.lit("gone")).withColumn("slot", F.lit(0)).unionByName(entities), replace=True)
    held.commit()
    assert integrity(Store(spark, store)) == "entity_id,entity_slot,entity_state,external_id"


def test_files_are_read_as_streams():
    import io

    from quillmere.sources.records import FileError, file_records

    values = [{"a": "é" * 40, "n": -1.5e3}, 7, None, "x]y,", [1, [2]], True, {}, 120]
    for text_ in (json.dumps(values, ensure_ascii=False), " \n[ ]", "[ 1 , 23 ]", "\ufeff" + json.dumps(values, indent=1)):
        want = json.loads(text_.lstrip("\ufeff"))
        for chunk in (1, 2, 3, 7, 64, 1 << 20):
            assert list(file_records(io.BytesIO(text_.encode()), "timeline", "", chunk)) == want
    for bad, some in (("[1, 2", 1), ("[1 2]", 1), ("[1] x", 1), ("[", 0), ("[1,]", 1), ("", 0), ("[1, {\"a\": }]", 1)):
        for chunk in (1, 4, 1 << 20):
            got = []
            with pytest.raises(FileError) as e:
                for value in file_records(io.BytesIO(bad.encode()), "timeline", "", chunk):
                    got.append(value)
            assert e.value.code == "JSON_INVALID" and len(got) >= some
    held = []

    class Endless(io.RawIOBase):
        """A long array of which the reader must not hold more than a record and two chunks."""

        def __init__(self):
            self.sent = 0

        def read(self, n=-1):
            held.append(n)
            if self.sent == 20_000:
                return b""
            self.sent += 1
            return (b"[" if self.sent == 1 else b"") + b'{"k": "' + b"v" * 50 + (b'"}]' if self.sent == 20_000 else b'"},')

    assert sum(1 for _ in file_records(Endless(), "timeline", "", 64)) == 20_000 and max(held) < 1000


def test_hashes_and_fingerprints_of_executors(spark, tmp_path):
    from quillmere.sources.discovery import as_rows, collection_fingerprints, spark_hashes

    roots = [export(tmp_path / n, {TIMELINE.format(k): [k, n] for k in range(1, 1 + size)}) for n, size in (("a", 3), ("b", 1), ("c", 12))]
    known = {}
    for name, chosen in (("abc", roots), ("ca", [roots[2], roots[0]]), ("b", roots[1:2])):
        there, here = discover(chosen, hashes=spark_hashes(spark)), discover(chosen)
        assert there == here
        known[name] = here
    rows = [(name, f["root_number"], f["relative_path"], f["kind"], f["sequence"], f["size_bytes"], f["sha256"]) for name, c in known.items() for f in as_rows(c)]
    files = spark.createDataFrame(rows, "collection string, root_number int, relative_path string, kind string, sequence long, size_bytes long, sha256 string").repartition(5)
    assert {r.collection: r.fingerprint for r in collection_fingerprints(files).collect()} == {n: c.fingerprint for n, c in known.items()}
    assert collection_fingerprints(files.limit(0)).count() == 0


def test_store_migrations(spark, tmp_path):
    from quillmere.sources import store as S

    fresh = S.migrate({})
    assert fresh["schema_version"] == S.SCHEMA_VERSION and [m["version"] for m in fresh["migrations"]] == sorted(S.MIGRATIONS) and S.migrate(dict(fresh)) == fresh
    old = {"schema_version": 1, "tables": {"runs": ["runs/x"]}}
    moved = S.migrate(old)
    assert moved["tables"] == {"runs": ["runs/x"], "profiles": [], "collections": []} and [m["version"] for m in moved["migrations"]] == [1, 2]
    for bad in ({"schema_version": 99}, {"schema_version": "1"}, {"schema_version": 2, "migrations": [{"version": 2}]}):
        with pytest.raises(ValueError):
            S.migrate(bad)


def test_written_tables_are_cleared(spark, tmp_path):
    from quillmere import session

    with session.cleared(spark):
        outer = session.keep(spark.range(3))
        with session.cleared(spark):
            folder = session.keep(spark.range(5)).inputFiles()[0]
        assert not os.path.exists(folder.removeprefix("file://")) and outer.count() == 3
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):

        class Elsewhere:
            master = "spark://host:7077"

            def getCheckpointDir(self):
                return None

        session.ensure_checkpoint_dir(type("S", (), {"sparkContext": Elsewhere(), "conf": {}})())


def test_validation(spark, tmp_path):
    secret = "SENTINEL-WORDS"
    root = export(tmp_path / "e", {TIMELINE.format(1): [None, {"data": [{"post": secret}]}, text(T0, secret)], TIMELINE.format(2): [None] * 150, TIMELINE.format(10): "{}"})
    report = validate_collection(spark, [root])
    first, second, tenth = report["files"]
    assert [f["relative_path"][-7:] for f in report["files"]] == ["_1.json", "_2.json", "10.json"]
    assert (first["examined"], first["parsed"], first["partial"], first["unsupported"]) == (3, 1, 1, 1)
    assert (second["errors"], len(second["retained_errors"]), second["errors_truncated"]) == (150, 100, True)
    assert tenth["status"] == "failed" and report["status"] == "failed" and secret not in json.dumps(report)
    assert validate_collection(spark, [str(tmp_path / "none")])["errors"] == [{"code": "EXPORT_ROOT_NOT_FOUND", "root_number": 1}]


def test_discovery(tmp_path):
    a = export(tmp_path / "a", {TIMELINE.format(k): [] for k in (10, 2, 1)} | {POSTS + "/album/10.json": [], POSTS + "/album/2.json": []})
    b = export(tmp_path / "b", {TIMELINE.format(1): [1]})
    assert [f.sequence for f in discover([a]).files] == [1, 2, 10]
    assert [f.sequence for f in discover([a], True).files if f.kind == "album_metadata"] == [2, 10]
    assert discover([a, b]).fingerprint == discover([b, a]).fingerprint != discover([a]).fingerprint
    for roots, code in (([], "EXPORT_ROOT_NOT_FOUND"), ([str(tmp_path / "x")], "EXPORT_ROOT_NOT_FOUND"), ([export(tmp_path / "c", {"x.json": []})], "SOURCE_FILE_MISSING")):
        with pytest.raises(DiscoveryError) as e:
            discover(roots)
        assert e.value.code == code
    os.symlink(tmp_path / "b" / TIMELINE.format(1), tmp_path / "a" / TIMELINE.format(99))
    with pytest.raises(DiscoveryError) as e:
        discover([a])
    assert e.value.code == "SOURCE_FILE_READ_FAILED"


def test_lock(tmp_path):
    with writer(str(tmp_path)):
        with pytest.raises(StoreLocked) as e, writer(str(tmp_path)):
            pass
        assert e.value.status == "active"
    for content, status in (('{"host": "elsewhere", "pid": 1}', "remote"), ("x", "invalid")):
        (tmp_path / "LOCK").write_text(content)
        with pytest.raises(StoreLocked) as e, writer(str(tmp_path)):
            pass
        assert e.value.status == status


def test_large_blocks_are_streamed_with_the_same_results(spark, tmp_path):
    shared = [text(T0, f"note {k % 7}", attachments=[media(f"photos/{k}.jpg")]) for k in range(12)] + [text(T0, "plain"), text(T0, "plain")]
    first = export(tmp_path / "a", {TIMELINE.format(1): shared + base_records()[1:]})
    second = export(tmp_path / "b", {TIMELINE.format(1): shared[3:] + [text(T0, "more")], POSTS + "/archive.json": [text(T0, "note 1", attachments=[media("photos/1.jpg")])]})
    seen = []
    for name, most in (("gathered", 200_000), ("streamed", 3)):
        store, reports = str(tmp_path / name), []
        for root in (first, second):
            reports.append(import_collection(spark, [root], store, max_block=most))
        entities = Store(spark, store).read("entities", ENTITY).drop("entity_id", "first_collected", "last_collected").toJSON().collect()
        kept = ("status", "records_examined", "records_matched", "posts_added", "posts_updated", "records_ambiguous", "records_skipped", "canonical_posts", "match_rule_counts", "integrity")
        seen.append(([{k: r[k] for k in kept} for r in reports], sorted(entities)))
    assert seen[0] == seen[1] and seen[0][0][0]["records_examined"] == 16


def test_order_of_records_does_not_matter(spark, tmp_path):
    rows = base_records() + [text(T0, "plain words"), text(T0, "more"), text(T0 + DAY, "x", fbid="123")]
    found = []
    for name, order in (("a", rows), ("b", rows[::-1])):
        import_collection(spark, [export(tmp_path / name, {TIMELINE.format(1): order})], str(tmp_path / f"s{name}"))
        held = Store(spark, str(tmp_path / f"s{name}")).read("entities", ENTITY)
        found.append(sorted(held.select("ts", F.coalesce("text", F.lit("")), "slot", "type").collect()))
    assert found[0] == found[1]


def test_command_line_needs_a_mode(tmp_path):
    assert main(["--export-path", str(tmp_path)]) == 1 and main([]) == 1


def test_command_line_and_stream(spark, tmp_path):
    from quillmere.streaming.watch import watch

    good = export(tmp_path / "a", {TIMELINE.format(1): base_records()})
    partly = export(tmp_path / "b", {TIMELINE.format(1): [None, text(T0 + 99, "x")]})
    report = tmp_path / "report.json"
    assert main(["--export-path", good, "--validate-only", "--report-path", str(report)]) == 0 and json.loads(report.read_text())["status"] == "completed"
    assert main(["--export-path", partly, "--validate-only"]) == 2 and main(["--export-path", str(tmp_path / "none"), "--validate-only"]) == 1
    (tmp_path / "arrivals").mkdir()
    (tmp_path / "arrivals" / "1.txt").write_text(f"{good}\n\n{good}\n")
    watch(spark, str(tmp_path / "arrivals"), str(tmp_path / "s"), str(tmp_path / "cp")).awaitTermination()
    (tmp_path / "arrivals" / "2.txt").write_text(partly)
    watch(spark, str(tmp_path / "arrivals"), str(tmp_path / "s"), str(tmp_path / "cp")).awaitTermination()
    store = Store(spark, str(tmp_path / "s"))
    assert store.read("runs", "run_id string").count() == 2 and store.read("entities", ENTITY).count() == 4
    assert main(["--export-path", good, "--store-path", str(tmp_path / "s")]) == 0
    assert json.loads((tmp_path / "s" / "last-import-report.json").read_text())["match_rule_counts"] == {"M03": 3}
