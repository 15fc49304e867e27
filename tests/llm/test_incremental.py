"""Problem 5: batches against history, beside brute force."""

import random

import pytest
from pyspark.sql import functions as F

from quillmere.llm import incremental_dedup as inc

RECORDS = "record long, run int, fp string, sha string, fid string, doc string, node string"
TEXTS = "record long, text string, media array<string>, links array<string>, ts long, sig string, key string"


def tables(spark, data):
    records = spark.createDataFrame([(r, run, fp, sha, fid, "clash", "clash") for r, run, fp, sha, fid, *_ in data], RECORDS)
    texts = spark.createDataFrame([(r, t, m, k, ts, "clash", "clash") for r, _, _, _, _, t, m, k, ts in data], TEXTS)
    return records, texts


def classes(spark, data):
    records, texts = tables(spark, data)
    got = inc.repeats(records, texts, ["fp", "sha", "fid"])
    _, first = inc.split_order(F.col("label"))
    return {r.record: r.first for r in got.select("record", first.alias("first")).collect()}


def sentence(rnd, n):
    return " ".join(rnd.choice("lamp kite boat river stone garden music paper window summer winter market ladder puzzle violin bridge".split()) + str(rnd.randrange(40)) for _ in range(n))


def changed(rnd, text):
    words = text.split()
    words[rnd.randrange(len(words))] = "altered"
    return rnd.choice([" ".join(words).upper(), "  ".join(words) + " 🎉", ", ".join(words) + "!"])


def brute(data):
    parent = {d[0]: d[0] for d in data}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def triples(t):
        w = ["^", *[x for x in "".join(c for c in (t or "").lower() if c.isalnum() or c.isspace()).split()], "$"]
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else set()

    def same(a, b):
        if any(x is not None and x == y for x, y in zip(a[2:5], b[2:5])):
            return True
        names = lambda m: sorted(x.rsplit("/", 1)[-1].lower() for x in m or [])
        if names(a[6]) != names(b[6]) or sorted(a[7] or []) != sorted(b[7] or []) or a[8] is None or b[8] is None or abs(a[8] - b[8]) > inc.APART_SECONDS:
            return False
        x, y = triples(a[5]), triples(b[5])
        if not x and not y:
            return bool(a[6] or a[7])
        return len(x & y) >= inc.SIMILARITY * len(x | y)

    order = {d[0]: (d[1], d[0]) for d in data}
    for i, a in enumerate(data):
        for b in data[:i]:
            if same(a, b):
                x, y = find(a[0]), find(b[0])
                if x != y:
                    low, high = sorted((x, y), key=order.get)
                    parent[high] = low
    return {d[0]: find(d[0]) for d in data}


def test_classes_match_brute_force(spark):
    rnd = random.Random(9)
    data = []
    for k in range(240):
        text, ts = sentence(rnd, rnd.randint(6, 30)), rnd.choice([1_000_000, rnd.randrange(10**6) * 500])
        media = rnd.choice([None, [], [f"a/p{k}.jpg"]])
        data.append((k, rnd.randint(1, 6), f"f{k}", f"s{k}", rnd.choice([None, f"i{k}"]), text, media, [], ts))
        kind = rnd.randrange(6)
        if kind < 5:
            moved = None if media is None else [m.replace("a/", "b/") for m in media]
            other = [f"a/q{k}.jpg"] if kind == 3 else moved
            later = ts + (rnd.randint(-20_000, 20_000) if kind != 4 else 400_000)
            data.append((1000 + k, rnd.randint(1, 6), f"f{k}" if kind == 0 else f"g{k}", f"t{k}", data[-1][4] if kind == 1 else None, changed(rnd, text) if kind else text, other, [], later))
    data += [(5000, 1, None, None, None, None, None, None, None), (5001, 2, None, None, None, "", [], [], 5), (5002, 2, None, None, None, None, ["x/z.png"], None, 7), (5003, 3, None, None, None, "", ["y/z.png"], [], 8), (5004, 3, "f0", None, None, "w " * 30_000, None, None, 9)]
    rnd.shuffle(data)
    assert classes(spark, data + data[::7]) == brute(data)


def test_batches_one_by_one_match_brute_force(spark):
    """Runs accepted one after the other, of which later ones connect classes of earlier ones."""
    rnd = random.Random(4)
    data = []
    for k in range(60):
        text, ts = sentence(rnd, rnd.randint(8, 20)), rnd.randrange(10**6) * 500
        for j in range(rnd.randint(1, 5)):
            shared = f"s{k}-{rnd.randrange(4)}" if rnd.random() < 0.5 else f"x{k}-{j}"
            data.append((100 * k + j, rnd.randint(1, 5), f"f{k}-{j // 2}", shared, f"i{k}" if rnd.random() < 0.2 else None, changed(rnd, text) if rnd.random() < 0.6 else sentence(rnd, 9), None, None, ts + rnd.randint(-9000, 9000)))
    records, texts = tables(spark, data + data[::5])
    got = inc.repeats(records.withColumn("batch", F.col("run")), texts, ["fp", "sha", "fid"])
    _, first = inc.split_order(F.col("label"))
    assert {r.record: r.first for r in got.select("record", first.alias("first")).collect()} == brute(data)


def test_batch_work_does_not_grow_with_history(spark, monkeypatch):
    """What a batch canonicalizes, tokenizes and compares is the same beside ten times the history; accepting it twice changes nothing."""
    rnd = random.Random(2)
    far = [(k, 1, f"f{k}", f"s{k}", None, sentence(rnd, 12), None, None, 10**6 * (k + 1)) for k in range(300)]
    near = [(1000 + k, 1, f"g{k}", f"t{k}", None, sentence(rnd, 12), None, None, 1000 + k) for k in range(20)]
    new = [(2000 + k, 2, f"h{k}", f"u{k}", None, changed(rnd, near[k][5]), None, None, 1000 + k) for k in range(20)]
    seen = []
    real = {name: getattr(inc, name) for name in ("documents", "_verified")}
    monkeypatch.setattr(inc, "documents", lambda held: seen.append(("tokenized", held.count())) or real["documents"](held))
    monkeypatch.setattr(inc, "_verified", lambda pairs, t: seen.append(("compared", pairs.count())) or real["_verified"](pairs, t))
    work, classes_ = [], []
    for history in (near, near + far):
        index = inc.Index(spark)
        index.accept(inc.staged(*tables(spark, history), ["fp", "sha", "fid"]), 1)
        seen.clear()
        for _ in range(2):
            index.accept(inc.staged(*tables(spark, new), ["fp", "sha", "fid"]), 2)
        work.append(list(seen))
        again = inc.Index(spark, index.folder)
        rows = [tuple(r) for r in again.classes().collect()]
        assert len(rows) == len(set(rows)) == len(history) + len(new)
        classes_.append({inc_record & ((1 << 44) - 1): label & ((1 << 44) - 1) for _, inc_record, label in rows})
    assert work[0] == work[1] and work[0][: len(work[0]) // 2] == work[0][len(work[0]) // 2 :]
    assert all(c[2000 + k] == 1000 + k for c in classes_ for k in range(20))


def test_copies_are_not_paired(spark):
    """Many posts of one text in one span: two are posted, all are one class, and so is a changed one near enough to any."""
    same = [(k, 1, f"f{k}", f"s{k}", None, "the same words every minute of the day again", None, None, 21600 * 5 + 60 * k) for k in range(300)]
    other = [(900, 2, "g", "t", None, "the same words every minute of the day anew", None, None, 21600 * 5 - 21600), (901, 2, "h", "u", None, "the same words every minute of the day anew", None, None, 21600 * 5 - 21601)]
    assert inc.documents(inc.contents(tables(spark, same)[1])).count() == 2
    assert classes(spark, same + other) == brute(same + other)


def test_ids_that_do_not_fit_are_an_error(spark):
    with pytest.raises(Exception, match="record ids"):
        classes(spark, [(1 << 44, 1, "f", None, None, "x", None, None, 1)])


def test_empty(spark):
    records, texts = tables(spark, [])
    assert inc.repeats(records, texts, ["fp", "sha", "fid"]).count() == 0


def test_index_grows_by_batches(spark, tmp_path):
    rnd = random.Random(1)
    old = [(k, 1, None, None, None, sentence(rnd, 12), None, None, 1000 + k) for k in range(50)]
    new = [(100 + k, 2, None, None, None, changed(rnd, old[k][5]) if k < 20 else sentence(rnd, 12), None, None, 1000 + k) for k in range(40)]
    folder = str(tmp_path / "index")
    held = [inc.contents(tables(spark, x)[1]) for x in (old, new)]
    docs = [inc.documents(h) for h in held]
    counts = inc.rarity(docs[0])
    inc.append(folder, inc.postings(docs[0], counts))
    batch = inc.postings(docs[1], counts)
    links = inc.probe(batch, spark.read.parquet(folder), docs[0].unionByName(docs[1]))
    names = {r.doc: r.record for h in held for r in h.collect()}
    assert sorted(tuple(sorted((names[r.a], names[r.b]))) for r in links.collect()) == [(k, 100 + k) for k in range(20)]
    inc.append(folder, batch)
    assert spark.read.parquet(folder).count() == inc.postings(docs[0], counts).count() + batch.count()
