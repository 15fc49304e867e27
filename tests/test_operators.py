"""Core operators on small tables: scalars, windows, upserts, matching, shredding, drift, components."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmere.functions import canonical as C
from quillmere.operators import matching, schema_drift, shredding, upsert, windows
from quillmere.operators.components import components
from quillmere.operators.ordering import numbered
from quillmere.sources import records as R


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


# --- scalars ---------------------------------------------------------------------------------------------------------


def test_golden_fingerprint():
    expected = "bfa46a3b0802cb0ca1943bbe7e457d4175715c0a5fd03ed1491f08e5d3197630"
    assert C.fingerprint(1704067200, "Stable fixture", ["media/photo.jpg"], ["https://example.com/sample"], None) == expected
    assert C.fingerprint(1, None, [], [], None) != C.fingerprint(1, "", [], [], None)


def test_scalar_columns(spark):
    df = spark.createDataFrame([("Café\r\nLine 2\rLine 3  ", ".\\Media\\Photos////Sample.JPG", 1704067200), (None, "", None), ("plain", "./", 0)], "t string, m string, s long")
    got = df.select(C.normal_text(F.col("t")), C.media_reference(F.col("m")), C.media_match_key(C.media_reference(F.col("m"))), C.iso_utc(F.col("s"))).collect()
    assert tuple(got[0]) == ("Café\nLine 2\nLine 3  ", "Media/Photos/Sample.JPG", "media/photos/sample.jpg", "2024-01-01T00:00:00.000Z")
    assert tuple(got[1]) == (None, None, None, None) and tuple(got[2])[:2] == ("plain", None)


URLS = {
    "HTTPS://Example.COM:443/a/%2F?b=2&a=1#private": "https://example.com/a/%2F?b=2&a=1",
    "not an absolute URL": None, "": None, None: None, "http://": None, "mailto:a@b.c": None,
    "http://A.example": "http://a.example/", "http://a.example:8080/x": "http://a.example:8080/x", "https://a.example/./b/../c": "https://a.example/c",
    "https://münchen.example/é?q=é": "https://xn--mnchen-3ya.example/%C3%A9?q=%C3%A9", " http://a.example/b c ": "http://a.example/b%20c",
}


def test_addresses(spark):
    assert {u: C.parse_url(u) for u in URLS} == URLS
    got = spark.createDataFrame([(u,) for u in URLS], "u string").select("u", C.normal_url(F.col("u"))).collect()
    assert {r[0]: r[1] for r in got} == URLS
    plain = spark.createDataFrame([(u,) for u in URLS], "u string").select("u", C.plain_url(F.col("u"))).collect()
    assert all(r[1] is None or r[1] == URLS[r[0]] for r in plain) and sum(r[1] is not None for r in plain) >= 3


def test_canonical_json():
    assert C.canonical_json({"z": 1, "a": {"y": True, "b": None}}) == '{"a":{"b":null,"y":true},"z":1}'
    assert C.canonical_json([1.0, 1e21, 1e-7, 0.1, -0.0, 2**53 + 1, "é"]) == '[1,1e+21,1e-7,0.1,0,9007199254740992,"é"]'
    assert list(json.loads(C.canonical_json({"ﬁ": 1, "\U0001f600": 2}))) == ["\U0001f600", "ﬁ"]
    for bad in (float("nan"), {1, 2}):
        with pytest.raises((ValueError, TypeError)):
            C.canonical_json(bad)


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers(-(2**53), 2**53) | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x), max_leaves=12))
def test_canonical_json_round_trip(value):
    text = C.canonical_json(value)
    assert C.canonical_json(json.loads(text)) == text


# --- normalizers -----------------------------------------------------------------------------------------------------


def test_normalizers_reject_and_derive():
    for bad in (None, [], {}, {"timestamp": "5"}, {"timestamp": -1}, {"timestamp": True}, {"timestamp": 1.5}, {"timestamp": 2**60}):
        with pytest.raises(R.RecordError):
            R.normalize_activity(bad)
    nested = {"timestamp": 5.0, "attachments": [{"data": [{"attachments": [{"data": [{"media": {"uri": "b.mp4"}}]}]}, {"media": {"uri": "a.jpg"}}, None]}]}
    made = R.normalize_activity(nested)
    assert made["media_references"] == ["a.jpg", "b.mp4"] and made["post_type"] == "mixed" and made["created_timestamp"] == 5
    swapped = R.normalize_activity({"attachments": [{"data": [{"media": {"uri": "a.jpg"}}, {"media": {"uri": "b.mp4"}}]}], "timestamp": 5})
    assert swapped["fingerprint"] == made["fingerprint"] and swapped["raw_sha256"] != made["raw_sha256"]
    assert R.normalize_activity({"timestamp": 1, "data": [{"post": None}, {"post": ""}]})["post_text"] == ""
    assert R.normalize_activity({"timestamp": 1, "attachments": [{"data": [{"media": {}}]}]})["post_type"] == "mixed"
    state = R.normalize_state({"timestamp": 1, "fbid": "7", "label_values": [{"label": "x", "deep": [{"uri": "p/q.png"}]}]})
    assert state["media_references"] == ["p/q.png"] and state["external_id"] == "7"
    checkin = R.normalize_checkin({"timestamp": 1, "fbid": "7", "label_values": []})
    assert checkin["post_type"] == "check_in" and checkin["place_reference"] == '{"location":null,"name":null,"place_tags":[]}'
    link = R.normalize_sharing_link({"timestamp": 1, "fbid": "7", "label_values": [{"label": "URL", "href": "https://a.example/x"}]})
    assert link["external_urls"] == ["https://a.example/x"] and link["direct_post_url"] is None
    with pytest.raises(R.RecordError):
        R.normalize_sharing_link({"timestamp": 1, "fbid": "7", "label_values": []})
    assert R.normalize_media({"uri": "v.mov", "creation_timestamp": 3, "description": "d"})["post_type"] == "video"


def test_array_reader():
    assert list(R.elements(' [1, {"a": [2]} , "x"] ')) == [1, {"a": [2]}, "x"] and list(R.elements("[]")) == []
    for bad in ("[1", "[1 2]", "[1,]", "[1] x"):
        with pytest.raises(ValueError):
            list(R.elements(bad))


# --- windows, upserts, ordering, components --------------------------------------------------------------------------


def test_slots_and_values(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, "x"), ("a", 3, None), ("b", 4, None), (None, 5, "y")], "k string, i int, v string")
    assert rows(windows.occurrence_slots(df, ["k"], ["i"]), "i", "occurrence") == [(1, 1), (2, 2), (3, 3), (4, 1), (5, 1)]
    got = df.groupBy("k").agg(windows.first_known("v", "i").alias("f"), windows.last_known("v", "i").alias("l")).collect()
    assert {r.k: (r.f, r.l) for r in got} == {"a": ("x", "x"), "b": (None, None), None: ("y", "y")}
    flags = df.select("i", windows.changed_from_previous(["v"], ["k"], ["i"]).alias("c"))
    assert rows(flags, "i", "c") == [(1, True), (2, True), (3, True), (4, True), (5, True)]
    slots = spark.createDataFrame([([1, 2, 4],), ([],), ([2],)], "u array<int>")
    assert [r[0] for r in slots.select(windows.free_slot(F.col("u"), F.lit(2))).collect()] == [3, 2, 1]


def test_slots_of_hot_keys(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 3 == 0, F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("k"), F.when(F.col("id") % 11 == 0, F.lit(None)).otherwise(F.col("id") % 2).alias("j"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = windows.occurrence_slots(df.repartition(6), ["k", "j"], ["id"]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    seen = {}
    for r in sorted(got, key=lambda r: r.id):
        seen[r.k, r.j] = seen.get((r.k, r.j), 0) + 1
        assert r.occurrence == seen[r.k, r.j]
    assert windows.occurrence_slots(df.limit(0), ["k"], ["id"]).count() == 0


def test_upserts(spark):
    target = spark.createDataFrame([(1, "a"), (2, None)], "id int, k string")
    incoming = spark.createDataFrame([(3, "a"), (5, "b"), (4, "b"), (6, None)], "id int, k string")
    assert rows(upsert.insert_or_ignore(target, incoming, ["k"], ["id"]).select("id"), "id") == [(1,), (2,), (4,), (6,)]
    updates = spark.createDataFrame([(1, None), (2, None)], "id int, k string")
    assert rows(upsert.conditional_update(target, updates, ["id"], ["k"]), "id", "updated") == [(1, True), (2, False)]
    assert upsert.orphans(incoming, target, "k", "k").count() == 2 and upsert.duplicate_keys(incoming, ["k"]).count() == 1
    assert upsert.identity_conflicts(incoming, ["k"], "id").collect()[0].owners == 2
    assert upsert.insert_or_ignore(target.limit(0), incoming.limit(0), ["k"], ["id"]).count() == 0


def test_numbering_is_total(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("a"), F.col("id").alias("b"))
    got = numbered(df, ["a", "b"], "n").collect()
    assert [r.n for r in sorted(got, key=lambda r: (r.a, r.b))] == list(range(1, 1001))


def test_components_match_union_find(spark):
    random.seed(7)
    edges = [(random.randrange(200), random.randrange(150)) for _ in range(220)] + [(k, 1000 + k) for k in range(60)] + [(k + 1, 1000 + k) for k in range(60)] + [(5, None)]
    parent = {i: i for i in range(200)}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    owner = {}
    for r, k in edges:
        if k is not None:
            if k in owner:
                a, b = find(r), find(owner[k])
                parent[max(a, b)] = min(a, b)
            owner[k] = r
    nodes = spark.range(200).select(F.col("id").alias("record"), F.col("id").alias("order"))
    got = components(nodes, spark.createDataFrame(edges, "record long, key long")).collect()
    assert {r.record: r.label for r in got} == {i: find(i) for i in range(200)}
    assert components(nodes, spark.createDataFrame([], "record long, key long")).where("label <> order").count() == 0


# --- matching --------------------------------------------------------------------------------------------------------


def test_cascade_ranks_and_cardinality(spark):
    schema = "record long, authoritative boolean, id string, url string, fp string, slot int, ts long, text string, media array<string>, urls array<string>"
    records = spark.createDataFrame(
        [
            (1, True, "i", None, "f1", 1, 10, "t", [], []), (2, True, None, "u", "f2", 1, 11, "t", [], []), (3, True, None, None, "f3", 2, 12, "t", [], []), (4, True, None, None, "x", 1, 20, None, ["m", "n"], []),
            (5, True, None, None, "x", 2, 21, None, [], ["l"]), (6, True, None, None, "x", 3, 22, "same", [], []), (7, True, None, None, "x", 4, 23, None, [], []), (8, True, None, None, "x", 5, 24, "", [], []),
            (9, False, None, None, "x", 6, 99, None, [], []), (10, True, None, None, "x", 7, 30, None, ["p"], []), (11, True, None, None, "x", 8, 31, None, ["other"], []),
        ],
        schema,
    )
    entities = spark.createDataFrame(
        [
            (101, True, "i", None, "z", 1, 0, None, [], []), (102, True, None, "u", "z", 1, 0, None, [], []), (103, True, None, None, "f3", 2, 0, None, [], []), (104, True, None, None, "z", 1, 20, None, ["n", "m"], []),
            (105, True, None, None, "z", 1, 21, None, [], ["l"]), (106, True, None, None, "z", 1, 22, "same", [], []), (116, True, None, None, "z", 1, 22, "else", [], []), (107, True, None, None, "z", 1, 23, None, [], []),
            (110, True, None, None, "z", 1, 30, None, ["p"], []), (111, True, None, None, "z", 1, 30, None, ["p"], []), (112, True, None, None, "z", 1, 31, None, ["q"], []),
        ],
        schema.replace("record", "entity"),
    )
    got = {r.record: (r.rule, r.entity) for r in matching.cascade(records, entities).collect()}
    assert got == {1: ("M01", 101), 2: ("M02", 102), 3: ("M03", 103), 4: ("M04", 104), 5: ("M05", 105), 6: ("M06", 106), 7: ("M07", 107), 8: ("M08", None), 9: ("M09", None), 10: ("M08", None), 11: ("M08", None)}


# --- problem 2: shredding --------------------------------------------------------------------------------------------

SHAPE = "id long, node string, a array<struct<n:string,record:int,kids:array<struct<x:int,y:struct<z:string>>>>>"


def nested(spark, data):
    return spark.createDataFrame(data, SHAPE)


def brute(value, path, parent):
    if value is None:
        return []
    if isinstance(value, dict):
        out = [(path, parent, "object", None)]
        for k, v in value.items():
            out += brute(v, f"{path}.{k}", path)
        return out
    if isinstance(value, list):
        out = [(path, parent, "array", None)]
        for i, v in enumerate(value):
            out += brute(v, f"{path}[{i}]", path)
        return out
    return [(path, parent, "scalar", str(value))]


def test_shred_matches_brute_force(spark):
    data = [
        (1, "clash", [{"n": "a", "record": 1, "kids": [{"x": 1, "y": {"z": "q"}}, None, {"x": None, "y": {"z": None}}]}, None, {"n": None, "record": None, "kids": None}]),
        (2, None, []), (3, None, None), (4, None, [{"n": "", "record": None, "kids": []}]), (None, None, [{"n": "k" * 50000, "record": 0, "kids": None}]),
    ]
    got = rows(shredding.shred(nested(spark, data), "id", ["a"]).na.fill({"record": -1, "scalar": "\0"}), "record", "node", "parent", "kind", "scalar")
    want = sorted((-1 if i is None else i, n, p, k, "\0" if s is None else s) for i, _, a in data for n, p, k, s in brute(a, "a", ""))
    assert got == want
    filled = rows(shredding.filled_objects(shredding.shred(nested(spark, data * 2), "id", ["a"])).where("record = 1"), "node")
    assert filled == [("a[0]",), ("a[0].kids[0]",), ("a[0].kids[0].y",), ("a[0].kids[2]",)]
    kids = shredding.entity_table(shredding.shred(nested(spark, data * 2), "id", ["a"]), "kids", {"x": "int"}).where("record = 1")
    assert rows(kids, "node", "parent", "ordinal") == [("a[0].kids[0]", "a[0].kids", 0), ("a[0].kids[2]", "a[0].kids", 2)]
    assert shredding.filled_objects(shredding.shred(nested(spark, []), "id", ["a"])).count() == 0


# --- problem 3: drift ------------------------------------------------------------------------------------------------


def drift(spark, contents, group="g"):
    data = [(i, group, "reel", None if i == 0 else i, "fbid", c if c is None or isinstance(c, str) else json.dumps(c)) for i, c in enumerate(contents)]
    return spark.createDataFrame(data, "file long, group string, kind string, exported_at long, key_field string, content string")


def found(spark, contents):
    return sorted((r.file, r.kind, r.path) for r in schema_drift.changes(drift(spark, contents)).collect())


def test_drift_kinds(spark):
    one = {"v2": [{"fbid": "1", "a": {"b": "x"}, "t": 5, "gone": "g1", "flag": True}, {"fbid": "2", "a": {"b": "y"}, "t": 6, "gone": "g2"}]}
    two = {"v3": [{"fbid": 1, "a": {"c": "x"}, "t": 5.5, "new": ["n"]}, {"fbid": 2, "a": {"c": "y"}, "t": 6}, 7, {"fbid": 3, "flag": None}]}
    got = found(spark, [one, '{"v2": [', two, two])
    assert got == [(2, "added", "new[]"), (2, "removed", "flag"), (2, "removed", "gone"), (2, "renamed", "$.v3"), (2, "renamed", "a.c"), (2, "retyped", "fbid"), (2, "retyped", "t")]


def test_drift_edges(spark):
    assert found(spark, [None, "", "nul", "[1", '[NaN]']) == [] and found(spark, []) == []
    assert found(spark, [[{"fbid": "1", "p": "v"}], {"w": [{"fbid": "1", "q": ["v"]}]}]) == [(1, "added", "$.w"), (1, "renamed", "q[]")]
    assert found(spark, [[{"fbid": "1", "p": "v"}], [{"fbid": "1", "q": "other"}]]) == [(1, "added", "q"), (1, "removed", "p")]
    assert found(spark, [[], [{"fbid": "1"}]]) == [(1, "added", "fbid")]
    moved = found(spark, [[{"fbid": "1", "place": "Quay"}], [{"fbid": "1", "location": {"name": "Quay"}}]])
    assert moved == [(1, "renamed", "location.name")]
    repeated = drift(spark, [[{"fbid": "1"}], [{"fbid": "1", "x": 1}]])
    assert schema_drift.changes(repeated.unionByName(repeated)).count() == 1


def steps(old, new):
    read = [schema_drift.read_file(json.dumps(x), "fbid") for x in (old, new)]
    return {(c.step, c.old_path, c.path) for c in schema_drift.compare(*read)}


def test_scripts_relabel_and_move():
    old = [{"fbid": str(k), "a": f"x{k}", "m": f"y{k}", "z": f"w{k}", "box": {"p": k, "q": -k}} for k in range(4)]
    new = [{"fbid": str(k), "y": f"x{k}", "b": f"y{k}", "z": f"w{k}", "crate": {"p": k, "q": -k}} for k in range(4)]
    # Names that cross in order of label, and an inner node under another name.
    assert steps(old, new) == {("relabel", "a", "y"), ("relabel", "m", "b"), ("relabel", "box.p", "crate.p"), ("relabel", "box.q", "crate.q")}
    inner = [{"fbid": str(k), "a": f"x{k}", "box": {"p": k, "m": f"y{k}"}, "z": f"w{k}"} for k in range(4)]
    assert ("move", "m", "box.m") in steps([r | {"box": {"p": k}} for k, r in enumerate(old)], inner)
    # One constant that two old fields share: the field with more to show for it is the one renamed.
    two = steps([{"fbid": str(k), "c": "same", "d": f"v{k}" if k else "same"} for k in range(1)] + [{"fbid": "9", "d": "other"}], [{"fbid": "0", "e": {"d": "same"}}, {"fbid": "9", "e": {"d": "other"}}])
    assert two == {("delete", None, "c"), ("relabel", "d", "e.d")}


def test_the_script_decides(spark, monkeypatch):
    old, new = [{"fbid": "1", "a": "x", "s": 1}, {"fbid": "2", "a": "y", "s": 2}], [{"fbid": "1", "b": "x", "s": 1}, {"fbid": "2", "b": "y", "s": 2}]
    assert steps(old, new) == {("relabel", "a", "b")}
    monkeypatch.setattr(schema_drift, "edit_distance", lambda *args, **kwargs: (0.0, []))
    assert steps(old, new) != {("relabel", "a", "b")} and any(step == "delete" for step, _, _ in steps(old, new))


def test_assignment_against_brute_force():
    import itertools

    rng = random.Random(3)
    for _ in range(60):
        costs = {(p, q): rng.uniform(0.1, 1.9) for p in "abcd" for q in "wxyz" if rng.random() < 0.6}
        best = 0.0
        for chosen in itertools.product(*[[None, *"wxyz"]] * 4):
            named = [c for c in chosen if c]
            if len(named) == len(set(named)) and all((p, q) in costs for p, q in zip("abcd", chosen) if q):
                best = max(best, sum(2 - costs[p, q] for p, q in zip("abcd", chosen) if q))
        saved, pairs = schema_drift.assign(costs) if costs else (0.0, {})
        assert abs(saved - best) < 1e-9 and abs(sum(2 - costs[x] for x in pairs.items()) - best) < 1e-9


def test_types_are_reconciled(spark):
    assert [schema_drift.common_type(set(f)) for f in (["integer", "string:integer"], ["integer", "fraction"], ["string:integer"], ["boolean", "string:boolean"], ["integer", "string"], ["boolean", "integer"])] == [
        "integer", "fraction", "string", "boolean", "string", "string",
    ]
    versions = [[{"fbid": "1", "t": 5, "f": True, "x": 1}], [{"fbid": "1", "t": "7", "f": "false", "x": 1.5, "l": [1, 2]}]]
    files = drift(spark, versions)
    got = {r.file: json.loads(r.typed) for r in schema_drift.consistent_table(files, schema_drift.changes(files)).collect()}
    assert got == {0: {"fbid": "1", "t": 5, "f": True, "x": 1.0}, 1: {"fbid": "1", "t": 7, "f": False, "x": 1.5, "l[]": [1, 2]}}


def test_neighbours_of_a_large_group(spark):
    files = spark.range(3000).select(F.col("id").alias("file"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 5).cast("string"))).alias("group"), (-F.col("id")).alias("exported_at"))
    got = {r.file: r.before for r in schema_drift.neighbours(files).collect()}
    data, last, want = sorted(files.collect(), key=lambda r: (r.group, r.exported_at)), None, {}
    for r in data:
        want[r.file] = last.file if last and last.group == r.group else None
        last = r
    assert got == want


def test_consistent_table(spark):
    versions = [[{"fbid": str(k), "old": f"v{k}"} for k in range(3)], [{"fbid": str(k), "new": f"v{k}"} for k in range(3)]]
    files = drift(spark, versions + versions[1:]).unionByName(drift(spark, versions, "h").withColumn("file", F.col("file") + 10))
    table = schema_drift.consistent_table(files, schema_drift.changes(files))
    assert table.count() == 15 and {tuple(sorted(r.fields)) for r in table.collect()} == {("fbid", "new")}


def test_consistent_table_compiles_renames_seen_once(spark):
    versions = [[{"fbid": str(k), "old": f"v{k}"} for k in range(3)], [{"fbid": str(k), "new": f"v{k}"} for k in range(3)]]
    both = [{"fbid": "8", "new": "n", "old": "o"}]
    files = drift(spark, versions).unionByName(drift(spark, [both], "h").withColumn("file", F.col("file") + 10))
    rows = schema_drift.consistent_table(files, schema_drift.changes(files)).collect()
    assert {tuple(sorted(r.fields)) for r in rows if r.file < 10} == {("fbid", "new")}
    # Where both paths stand in one record, neither value is lost.
    assert [r.fields for r in rows if r.file == 10] == [{"fbid": "8", "new": "n", "old": "o"}]
    assert schema_drift.canonical_fields({"a": "1", "b": "2", "c": "3"}, {"a": "c", "b": "c", "c": "c"}) == {"c": "3", "a": "1", "b": "2"}


@settings(max_examples=40, deadline=None)
@given(st.sets(st.sampled_from("a b c a.b a.c b.a c.d.e c.d.f".split()), max_size=6), st.sets(st.sampled_from("a b c a.b a.c b.a c.d.e c.d.f".split()), max_size=6))
def test_edit_distance_is_a_distance(x, y):
    def distance(p, q):
        left, right = schema_drift.Tree(p), schema_drift.Tree(q)
        return schema_drift.edit_distance(left, right, lambda a, b: 0.0 if (left.labels[a], left.paths[a]) == (right.labels[b], right.paths[b]) else 2.5)[0]

    assert distance(x, x) == 0 and distance(x, y) == distance(y, x) and (distance(x, y) > 0) == (x != y)
