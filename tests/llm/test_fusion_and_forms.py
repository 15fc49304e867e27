"""Problems 1 and 7: fusion with copy detection, duplicates hidden by formatting."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from quillmere.llm import format_dedup, fusion

OBS = "group long, record long, source string, rank int, seen timestamp, value string"
REC = "record long, value string, group string, claims string, best string"


def at(k):
    return f"2024-01-01 00:{k // 60:02d}:{k % 60:02d}"


def claimed(spark, observations, records):
    o = spark.createDataFrame([(g, r, s, k, None if t is None else at(t), "clash") for g, r, s, k, t in observations], OBS.replace("timestamp", "string")).withColumn("seen", F.to_timestamp("seen"))
    v = fusion.usable_name(F.col("value"))
    r = spark.createDataFrame([(i, x, "clash", "clash", "clash") for i, x in records], REC)
    return fusion.claims(o, r, {"name": (v, F.lower(v))})


def test_newest_and_unmatched_claims(spark):
    random.seed(3)
    observations, records = [], {}
    for g in range(200):
        for k in range(random.randint(1, 6)):
            r, rank = len(records), random.randint(1, 8)
            records[r] = random.choice(["Quay", "Bank", "Vale", "N/A", "", None, "-"])
            observations.append((g, r, f"M0{rank}", rank, g * 10 + random.randint(0, 5)))
    repeated = observations + observations[::3]
    fused, accuracy, _ = fusion.fuse(claimed(spark, repeated, list(records.items()) * 2))
    got = {(x.group, x.record) for x in fusion.undisputed(fused).collect()}
    want, groups = set(), defaultdict(set)
    for o in observations:
        groups[o[0]].add(o)
    for g, own in groups.items():
        if len(own) > 1:
            ok = [o for o in own if records[o[1]] in ("Quay", "Bank", "Vale")]
            best = [o[1] for o in ok if o[4] == max(x[4] for x in ok) and o[3] == min(x[3] for x in ok)]
            want |= {(g, min(best))} if best else set()
    assert got == want and all(0 < a < 1 for a in accuracy.values())
    # Every claimed value has a posterior: the fused one is claimed in its group.
    assert all(r.best.value in {records[o[1]] for o in groups[r.group]} and 0 < r.posterior < 1 for r in fused.collect())


def test_copied_votes_are_discounted(spark):
    says = F.array(F.lit("B"), F.lit("C"))
    score = lambda dependence: spark.range(1).select(fusion._score(says, dict.fromkeys("ABC", 0.8), dependence, 20, 0.8, 0.1)).first()[0]
    one = spark.range(1).select(fusion._score(F.array(F.lit("B")), dict.fromkeys("ABC", 0.8), {}, 20, 0.8, 0.1)).first()[0]
    assert one < score({("B", "C"): 1.0}) < score({}) < score({("B", "C"): 0.0}) == 2 * one


def test_dependence_shows_in_shared_false_values(spark):
    observations, records, n = [], [], 0
    for g in range(150):
        true, false = f"true {g}", f"false {g}"
        wrong = g % 3 == 0
        for source, rank, value in (("A", 1, true), ("B", 2, true), ("E", 5, true), ("C", 3, false if wrong else true), ("D", 4, false if wrong else true)):
            records.append((n, value))
            observations.append((g, n, source, rank, 5 - rank))
            n += 1
    _, accuracy, dependence = fusion.fuse(claimed(spark, observations, records))
    assert accuracy["A"] > accuracy["C"] and dependence["C", "D"] > 0.9 and dependence.get(("A", "C"), 0.1) < 0.1


def test_shared_true_values_are_no_evidence(spark):
    observations = [(g, 3 * g + k, s, k + 1, k) for g in range(100) for k, s in enumerate("ABC")]
    _, _, dependence = fusion.fuse(claimed(spark, observations, [(o[1], f"true {o[0]}") for o in observations]))
    assert dependence == {}


def test_fusion_beats_newest_and_majority(spark):
    """Five independent sources, a bad one and two that copy it, in groups of several records a source, with mixed times."""
    rng = random.Random(11)
    rate = {"A": 0.9, "B": 0.8, "C": 0.75, "D": 0.7, "W": 0.65, "X": 0.45}
    observations, records, truth, n = [], {}, {}, 0
    for g in range(600):
        truth[g] = f"true {g}"
        said = {s: truth[g] if rng.random() < a else f"false {g} {rng.randint(0, 9)}" for s, a in rate.items()}
        said |= {s: said["X"] if rng.random() < 0.9 else (truth[g] if rng.random() < 0.6 else f"false {g} {rng.randint(0, 9)}") for s in ("Y", "Z")}
        for s in rng.sample(sorted(said), rng.randint(5, 8)):
            for _ in range(rng.randint(1, 2)):
                records[n] = said[s]
                observations.append((g, n, s, "ABCDWXYZ".index(s) + 1, rng.randint(0, 3000)))
                n += 1
    fused, accuracy, dependence = fusion.fuse(claimed(spark, observations, list(records.items())))
    by_group = defaultdict(list)
    for g, r, s, _, t in observations:
        by_group[g].append((t, records[r]))
    share = lambda chosen: sum(chosen[g] == truth[g] for g in truth) / len(truth)
    fusion_share = share({r.group: r.best.value for r in fused.collect()})
    newest = share({g: max(own)[1] for g, own in by_group.items()})
    majority = share({g: max(Counter(v for _, v in own).items(), key=lambda x: x[1])[0] for g, own in by_group.items()})
    print("fusion", fusion_share, "newest", newest, "majority", majority)
    assert fusion_share > majority + 0.03 and fusion_share > newest + 0.1
    assert min(accuracy[s] for s in "ABCDW") > max(accuracy[s] for s in "XYZ")
    copiers = [d for (a, b), d in dependence.items() if a in "XYZ" and b in "XYZ"]
    others = [d for (a, b), d in dependence.items() if a in "ABCDW" or b in "ABCDW"]
    no_copies = fusion.fuse(claimed(spark, observations, list(records.items())), copy_rate=0.0001, prior_copy=0.0001)[0]
    print("without copy detection", share({r.group: r.best.value for r in no_copies.collect()}))
    assert min(copiers) > 0.9 and max(others) < 0.5


def test_fusion_edges(spark):
    assert fusion.fuse(claimed(spark, [], []))[0].count() == 0
    nulls = [(None, 1, "A", 1, 1), (1, None, "A", 1, 1), (1, 1, None, None, None), (1, 2, "A", 1, 1)]
    fused, _, _ = fusion.fuse(claimed(spark, nulls, [(1, "Quay"), (2, None), (None, "x")]))
    assert [(r.group, r.best.record) for r in fused.collect()] == [(1, 1)]
    long = "w" * 100_000
    fused, _, _ = fusion.fuse(claimed(spark, [(1, 1, "A", 1, 1), (1, 2, "A", 1, 1)], [(1, long), (2, long)]))
    assert fused.first().best.record == 1


def test_usable_values(spark):
    ids = {"1015921707996929": True, "000000000000000": False, "1.015E+15": False, "10150022...": False, " 1015921707996929 ": True, "N/A": False, "": False, None: False, "12345": False}
    urls = {"https://social.example/user1/posts/12": True, "https://m.social.example/u/posts/9?ref=share": True, "https://social.example/": False, "https://social.example/permalink/undefined": False, "#": False, "http://": False, "about:blank": False, "null": False, None: False}
    names = {"Café Ondine": True, "CafÃ©": True, "Unknown": False, "(no place)": False, "-": False, " ": False, "​": False, None: False, "N/A": False, "7": True}
    for cases, test in ((ids, fusion.usable_id), (urls, fusion.usable_url), (names, fusion.usable_name)):
        df = spark.createDataFrame([(k,) for k in cases], "v string").select("v", test(F.col("v")).isNotNull().alias("ok"))
        assert {r.v: r.ok for r in df.collect()} == cases


FORMS = "record long, text string, media array<string>, urls array<string>, h128 string, canon string, copies string"


def forms(spark, data):
    df = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in data], FORMS)
    return format_dedup.canonical_keys(df, "record", ["text"], ["media"], ["urls"])


def test_forms(spark):
    url = "https://a.example/x?b=2&a=1"
    data = [
        (5, "Half-finished Café!", ["m/b.jpg", "M/A.jpg"], [url]),
        (3, "  half finished CAFÉ​ ", ["m/a.JPG", "m/b.jpg"], ["HTTPS://a.example/x/?a=1&b=2"]),
        (4, "half finished café", ["m/b.jpg"], [url]),
        (6, None, None, None), (7, "", [], []), (8, " ​…", None, [None]), (9, None, ["m/b.jpg"], None), (10, "", ["m-b.jpg"], []), (None, "x", None, None),
        (11, "Straße", None, None), (12, "STRASSE", None, None), (13, "a" * 200_000, None, None), (14, "A" * 200_000, None, None), (15, "$5", None, None), (16, "5", None, None),
        (17, None, None, ["http://b.example/?"]), (18, None, None, ["http://b.example"]), (19, None, None, ["http://b.example/?x=1#f"]), (20, None, None, ["HTTP://b.example?x=1#F"]),
    ]
    keys = forms(spark, data + data[:3])
    got = sorted((r.keep, r.record) for r in format_dedup.duplicates(keys, hot_rows=1).collect())
    assert got == [(3, 5), (9, 10), (11, 12), (13, 14), (17, 18), (19, 20)] and got == sorted((r.keep, r.record) for r in format_dedup.duplicates(keys).collect())
    copies = {r.keep: (r.copies, r.collided) for r in format_dedup.collapse(keys).collect()}
    assert copies == {3: (2, False), 4: (1, False), 9: (2, False), 11: (2, False), 13: (2, False), 15: (1, False), 16: (1, False), 17: (2, False), 19: (2, False)}
    assert forms(spark, []).count() == 0 and format_dedup.duplicates(forms(spark, [])).count() == 0


def test_collisions_split(spark):
    keys = spark.createDataFrame([(1, "h", 1), (2, "h", 2), (3, "h", 1)], "record long, h128 string, h64 long")
    assert sorted((r.keep, r.copies, r.collided) for r in format_dedup.collapse(keys).collect()) == [(1, 2, True), (2, 1, True)]
    assert [(r.keep, r.record) for r in format_dedup.duplicates(keys).collect()] == [(1, 3)]
