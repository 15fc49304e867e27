"""Deduplicating new batches against all history.

An inverted index of rare-token prefixes, partitioned by token and kept in a folder (:class:`Index`). Contents (canonical
words, media files, links, time of creation) are documents; their tokens are word triples, and their prefix are the rarest
``n - ceil(t n) + 1`` of them, so that two documents of Jaccard similarity ``t`` or more share a prefix token. Posting
lists are keyed by (token, signature of media and links, block of time), because contents with other files or links, or
created further apart, are other posts.

A batch is canonicalized and tokenized, probes the lists with its own prefixes, filters by length and time, verifies the
overlap on whole token sets, and appends its postings. What was accepted before is neither canonicalized nor tokenized nor
compared with itself again: of the index a batch reads the postings of its tokens, the token sets of its candidates and
the classes of its keys. Token rarity is counted once, over the documents of the first batch, in ``DF_BUCKETS`` counters
(hashing and ageing only change the order of tokens, and every order is a valid one), a fixed size, which is broadcast.

Equal words, files and links within one span of ``APART_SECONDS`` need no comparison: they share a key, and only the
first and the last of them in each batch are posted. Whatever is similar to any of them and near enough in time is near
enough to one of these two, so no link is lost and copies are never paired.

Records that share a key, or whose documents are linked, form one class, named by its first record in order of arrival.
A batch that connects classes of history appends a merge; history is not rewritten.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm.format_dedup import canonical_list, canonical_urls, caseless
from quillmere.operators.components import components
from quillmere.session import ensure_checkpoint_dir, keep

DF_BUCKETS = 1 << 18
SIMILARITY = 0.45
APART_SECONDS = 6 * 3600
#: Length of a block of time, in multiples of the longest distance: the longer, the fewer postings are listed twice.
BLOCK = 10
_ID_BITS = 44
#: Partitions of the posting lists by token.
PARTS = 16


def file_names(references: Column) -> Column:
    """The files of a post without their folders, in canonical form and sorted order."""
    return canonical_list(F.transform(references, lambda r: F.element_at(F.split(r, r"[/\\]"), -1)))


def words(text: Column) -> Column:
    """Words in canonical form: lower case, without punctuation, symbols and invisible characters; none for null."""
    letters = F.regexp_replace(caseless(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\s\p{Z}]+", "")
    return F.filter(F.split(letters, r"[\s\p{Z}]+"), lambda w: w != "")


def contents(records: DataFrame, apart: int = APART_SECONDS) -> DataFrame:
    """Document of every record: record, doc, sig, ts, same, h (hashes of the words).

    ``records``: record, text, media, links, ts; records with none of the three contents are left out. Records of equal
    words, files, links and time have one document; a null time equals a null time only. ``same`` is the key that equal
    contents of one span of time share; a document without time is its own.
    """
    canon = records.select("record", "ts", F.concat_ws("\u0002", file_names(F.col("media")), canonical_urls(F.col("links"))).alias("s"), words(F.col("text")).alias("w"))
    canon = canon.where((F.size("w") > 0) | (F.translate("s", "\u0001\u0002?", "") != ""))
    hashed = canon.select("record", "ts", F.xxhash64("s").alias("sig"), F.xxhash64(F.array_join("w", "")).alias("t"), F.transform("w", lambda x: F.hash(x)).alias("h"))
    doc = F.xxhash64("sig", "t", "ts")
    same = F.coalesce(F.xxhash64(F.lit("same"), F.col("sig"), F.col("t"), F.when(F.col("ts").isNotNull(), F.floor(F.col("ts") / apart))), doc)
    return hashed.select("record", doc.alias("doc"), "sig", "ts", F.when(F.col("ts").isNull(), doc).otherwise(same).alias("same"), "h")


def documents(held: DataFrame) -> DataFrame:
    """The documents to be posted: doc, sig, ts, same, tokens (distinct hashes of three neighbouring words, ends included).

    Of equal contents in one span of time these are the first and the last. A column ``node`` (any record of the
    document) comes out as well.
    """
    extra = ["node"] if "node" in held.columns else []
    whole = F.struct("doc", "sig", "ts", "h", *extra)
    ends = held.groupBy("same").agg(F.min_by(whole, F.struct("ts", "doc")).alias("a"), F.max_by(whole, F.struct("ts", "doc")).alias("b"))
    posted = F.when(F.col("a.doc") == F.col("b.doc"), F.array("a")).otherwise(F.array("a", "b"))
    distinct = ends.select("same", F.inline(posted)).select("doc", "sig", "ts", "same", *extra, F.concat(F.array(F.lit(1)), "h", F.array(F.lit(2))).alias("p"))
    triples = F.transform(F.sequence(F.lit(0), F.size("p") - 3), lambda i: F.hash(F.get("p", i), F.get("p", i + 1), F.get("p", i + 2)))
    return distinct.select("doc", "sig", "ts", "same", *extra, F.when(F.size("p") > 2, F.array_distinct(triples)).otherwise(F.array().cast("array<int>")).alias("tokens"))


def rarity(docs: DataFrame) -> np.ndarray:
    """Document counts of token buckets over all documents: ``DF_BUCKETS`` counters."""
    rows = docs.select(F.explode("tokens").alias("t")).groupBy(F.pmod("t", F.lit(DF_BUCKETS)).alias("b")).count().toPandas()
    counts = np.zeros(DF_BUCKETS, dtype=np.int64)
    counts[rows["b"].to_numpy(dtype=np.int64)] = rows["count"].to_numpy(dtype=np.int64)
    return counts


def postings(docs: DataFrame, counts: np.ndarray, similarity: float = SIMILARITY, apart: int = APART_SECONDS) -> DataFrame:
    """Postings of the rare prefixes: key, doc, ts, n, token. A document without words posts its signature alone, one without time nothing.

    A document near the end of its block of time is listed in the next block as well, so that two documents at most
    ``apart`` seconds apart meet in one of them.
    """
    table = docs.sparkSession.sparkContext.broadcast(counts)

    @F.pandas_udf("array<int>")
    def prefix(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        df = table.value
        for batch in batches:
            out = []
            for tokens in batch:
                t = np.asarray(tokens, dtype=np.int64)
                size = len(t) - math.ceil(similarity * len(t)) + 1
                out.append(t[np.lexsort((t, df[t % DF_BUCKETS]))][:size].astype(np.int32) if len(t) else t.astype(np.int32))
            yield pd.Series(out)

    length = F.lit(apart * BLOCK)
    docs = docs.where("ts IS NOT NULL")
    block, late = F.floor(F.col("ts") / length), F.pmod(F.col("ts"), length) >= length - apart
    blocks = F.when(late, F.array(block, block + 1)).otherwise(F.array(block))
    rows = docs.select("doc", "sig", "ts", F.size("tokens").alias("n"), F.when(F.size("tokens") > 0, prefix("tokens")).otherwise(F.array(F.lit(0))).alias("p"), blocks.alias("blocks"))
    listed = rows.select("doc", "sig", "ts", "n", F.explode("blocks").alias("block"), "p").select("doc", "sig", "ts", "n", "block", F.explode("p").alias("token"))
    return listed.select(F.xxhash64("token", "sig", "block").alias("key"), "doc", "ts", "n", "token")


def probe(batch: DataFrame, index: DataFrame, docs: DataFrame, similarity: float = SIMILARITY, apart: int = APART_SECONDS, extra: list[str] = ()) -> DataFrame:
    """Verified links between documents of a batch and of the index (which may be or hold the batch): a, b.

    ``batch`` and ``index`` are postings, ``docs`` holds the token sets of both, and ``extra`` columns that come out for
    both sides. Each unordered pair comes out once. If batch and index are the same postings, they are shuffled once.
    """
    columns = ["key", "doc", "ts", "n"]
    pairs = _candidates(batch.select(*columns), index.select(*columns), similarity, apart, batch is index)
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    sets = docs.select("doc", "tokens", *extra)
    sides = [sets.withColumnsRenamed({"doc": x, "tokens": f"t{x}"} | {c: f"{c}_{x}" for c in extra}) for x in "ab"]
    pairs = pairs if batch is index else pairs.distinct()
    return _verified(pairs.join(sides[0], "a").join(sides[1], "b"), similarity).select("a", "b", *[f"{c}_{x}" for c in extra for x in "ab"])


def _candidates(left: DataFrame, right: DataFrame, similarity: float, apart: int, same: bool = False) -> DataFrame:
    """Pairs of documents that share postings and pass the filters of length, time and count: a, b. ``same``: of one table, each once.

    What two similar documents share lies in both prefixes or beyond the end of the one that ends first in the order of
    rarity; so they share at least their least overlap less the longer rest in their prefixes.
    """
    n, m = F.col("l.n"), F.col("r.n")
    joined = left.alias("l").join(right.alias("r"), "key").where(
        ((F.col("l.doc") < F.col("r.doc")) if same else (F.col("l.doc") != F.col("r.doc"))) & (F.abs(F.col("l.ts") - F.col("r.ts")) <= apart) & (F.least(n, m) >= F.ceil(F.greatest(n, m) * similarity))
    )
    shared = joined.groupBy(F.col("l.doc").alias("a"), F.col("r.doc").alias("b")).agg(F.count("*").alias("c"), F.max(n).alias("n"), F.max(m).alias("m"))
    least = F.ceil((F.col("n") + F.col("m")) * similarity / (1 + similarity) - 1e-9)
    rest = F.ceil(F.greatest("n", "m") * similarity) - 1
    return shared.where(F.col("c") >= least - rest).select("a", "b")


def _verified(pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose token sets ``ta`` and ``tb`` are similar enough."""
    common = F.size(F.array_intersect("ta", "tb"))
    return pairs.where(common >= similarity * (F.size("ta") + F.size("tb") - common))


def append(index_folder: str, new: DataFrame, mode: str = "append") -> None:
    """Adds postings to an index kept in a folder, partitioned by a part of the token."""
    new.withColumn("part", F.pmod("token", F.lit(PARTS))).write.mode(mode).partitionBy("part").parquet(index_folder)


def staged(records: DataFrame, texts: DataFrame, exact_keys: list[str]) -> DataFrame:
    """Rows that :meth:`Index.accept` takes: record, order, node, keys and the document of each record.

    ``records``: record, run (int) and the ``exact_keys`` columns, null where not usable; ``texts``: record, text, media,
    links, ts. Rows repeated under one record count once; texts of other records are disregarded; extra columns of
    ``records`` other than ``batch`` are dropped. The order of a record is its run, then its id, which must lie between 0
    and 2^44; other ids are an error, never a wrong order. Records of one value of the first exact key are one node of
    the components, so that mere repeats cost nothing there.
    """
    fits = F.col("record").between(0, (1 << _ID_BITS) - 1)
    order = F.when(fits, F.shiftleft(F.col("run").cast("long"), _ID_BITS) + F.col("record")).otherwise(F.raise_error(F.lit(f"record ids must lie below 2^{_ID_BITS}")).cast("long"))
    hashes = [F.when(F.col(k).isNotNull(), F.xxhash64(F.lit(k), F.col(k))).alias(k) for k in exact_keys]
    batch = [F.col("batch") if "batch" in records.columns else F.lit(0).alias("batch")]
    rows = records.where("record IS NOT NULL").select("record", order.alias("order"), *batch, *hashes)
    rows = rows.groupBy("record").agg(F.min("order").alias("order"), F.min("batch").alias("batch"), *[F.min(k).alias(k) for k in exact_keys])
    node = F.coalesce(exact_keys[0], F.xxhash64(F.lit("record"), F.col("record")))
    rows = rows.select("record", "order", "batch", node.alias("node"), F.array_compact(F.array(*exact_keys[1:])).alias("keys"))
    return rows.join(contents(texts), "record", "left")


class Index:
    """What was accepted so far, as tables in a folder that all executors reach, one part per batch.

    ``postings`` (key, doc, ts, n, token), ``docs`` (doc, sig, ts, same, node, tokens), ``keys`` (key, label: the class that a key leads
    to), ``merges`` (label, into), ``accepted`` (record, order, label) and ``rarity``. Accepting a batch again under its
    number replaces its parts, so a batch that broke off is simply repeated.
    """

    SCHEMAS = {
        "postings": "key long, doc long, ts long, n int, token int, batch int, part int",
        "docs": "doc long, sig long, ts long, same long, node long, tokens array<int>, batch int",
        "keys": "key long, label long, batch int",
        "merges": "label long, into long, batch int",
        "accepted": "record long, order long, label long, batch int",
    }

    def __init__(self, spark: SparkSession, folder: str | None = None, similarity: float = SIMILARITY, apart: int = APART_SECONDS):
        self.spark, self.folder = spark, folder or f"{ensure_checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"
        self.similarity, self.apart = similarity, apart
        self._counts: np.ndarray | None = None
        self._merged = False
        try:
            self._remember(spark.read.parquet(f"{self.folder}/rarity").toPandas())
            self._merged = bool(self.table("merges").limit(1).count())
        except AnalysisException:
            pass

    def _remember(self, rows: pd.DataFrame) -> None:
        counts = np.zeros(DF_BUCKETS, dtype=np.int64)
        counts[rows["b"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
        self._counts = counts

    def table(self, name: str) -> DataFrame:
        """A table over all batches accepted so far."""
        return self.spark.read.schema(self.SCHEMAS[name]).parquet(f"{self.folder}/{name}")

    def _write(self, name: str, rows: DataFrame, batch: int) -> DataFrame:
        folder = f"{self.folder}/{name}/batch={batch}"
        rows.write.mode("overwrite").parquet(folder)
        return self.spark.read.schema(rows.schema).parquet(folder)

    def _resolved(self, rows: DataFrame) -> DataFrame:
        """Rows with their ``label`` led through all merges. Merges name labels that were current, so chains are as long as batches that merged them."""
        while self._merged:
            merges = self.table("merges").select("label", "into").groupBy("label").agg(F.min("into").alias("into"))
            rows = keep(rows.join(merges, "label", "left").withColumn("moved", F.col("into").isNotNull()).withColumn("label", F.coalesce("into", "label")).drop("into"))
            if not rows.where("moved").limit(1).count():
                return rows.drop("moved")
            rows = rows.drop("moved")
        return rows

    def accept(self, rows: DataFrame, batch: int) -> None:
        """Checks a batch of :func:`staged` rows (written ones, they are read twice) against all accepted ones and itself, and adds it."""
        first = self._counts is None
        docs = documents(rows.where("doc IS NOT NULL").select("doc", "sig", "ts", "same", "h", "node"))
        if not first:
            docs = docs.join(self.table("docs").where(F.col("batch") != batch).select("doc"), "doc", "left_anti")
        docs = self._write("docs", docs, batch)
        if first:
            b = F.pmod("t", F.lit(DF_BUCKETS)).alias("b")
            docs.select(F.explode("tokens").alias("t")).groupBy(b).agg(F.count("*").alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/rarity")
            self._remember(self.spark.read.parquet(f"{self.folder}/rarity").toPandas())
        # The batch's own part, so that a batch accepted again replaces it.
        append(f"{self.folder}/postings/batch={batch}", postings(docs, self._counts, self.similarity, self.apart), "overwrite")
        own = self.table("postings").where(F.col("batch") == batch)
        # A link is an edge from a record of the one document, which is always a new one, to the key of the other.
        links = probe(own, own, docs, self.similarity, self.apart, ["node", "same"]).select(F.col("node_a").alias("record"), F.col("same_b").alias("key"))
        if not first:
            links = links.union(self._probe_history(own, docs, batch).select("node_a", "same_b"))

        narrow = rows.select("record", "order", "node", "keys", "same")
        edges = narrow.select(F.col("node").alias("record"), F.explode(F.array_compact(F.array_append("keys", F.col("same")))).alias("key"))
        nodes = narrow.groupBy(F.col("node").alias("record")).agg(F.min("order").alias("order"))
        edges = keep(edges.unionByName(links).distinct())
        known = None
        graph = edges
        if not first:
            # The classes that the batch's keys and nodes lead to take part as one node each. A node is a key as well.
            nodes = keep(nodes)
            held = self.table("keys").where(F.col("batch") != batch).select("key", "label")
            own_keys = nodes.select("record", F.col("record").alias("key"))
            wanted = edges.select("key").union(own_keys.select("key")).distinct()
            known = keep(self._resolved(wanted.join(held, "key")).distinct())
            standing = F.xxhash64(F.lit("class"), F.col("label"))
            graph = edges.unionByName(own_keys.join(known.select("key"), "key", "left_semi").select("record", "key")).unionByName(known.select(standing.alias("record"), "key"))
            nodes = nodes.unionByName(known.select(standing.alias("record"), F.col("label").alias("order")).distinct())
        classed = keep(components(nodes, graph, distinct=True))

        labels = classed.select(F.col("record").alias("node"), "label")
        self._write("accepted", narrow.select("record", "order", "node").distinct().join(labels, "node").select("record", "order", "label"), batch)
        # All records of a key are of one class, so any of them tells the key's.
        led = edges.groupBy("key").agg(F.min("record").alias("record")).join(classed.select("record", "label"), "record").select("key", "label")
        led = led.union(labels)
        if known is not None:
            led = led.join(known.select("key"), "key", "left_anti")
            into = known.select("label", F.xxhash64(F.lit("class"), F.col("label")).alias("record")).distinct().join(classed.select("record", F.col("label").alias("into")), "record")
            merges = self._write("merges", into.where("into <> label").select("label", "into"), batch)
            self._merged = self._merged or bool(merges.limit(1).count())
        self._write("keys", led, batch)

    def _probe_history(self, own: DataFrame, sets: DataFrame, batch: int) -> DataFrame:
        """Verified links between new documents and those of earlier batches: node_a (of the new one), same_b."""
        columns = ["key", "doc", "ts", "n"]
        parts = [r.part for r in own.select("part").distinct().collect()]
        history = self.table("postings").where((F.col("batch") != batch) & F.col("part").isin(parts))
        pairs = keep(_candidates(own.select(*columns), history.select(*columns), self.similarity, self.apart))
        both = pairs.join(sets.select(F.col("doc").alias("a"), F.col("node").alias("node_a"), F.col("tokens").alias("ta")), "a")
        old = self.table("docs").where(F.col("batch") != batch).select(F.col("doc").alias("b"), F.col("same").alias("same_b"), F.col("tokens").alias("tb"))
        return _verified(both.join(old, "b"), self.similarity)

    def classes(self) -> DataFrame:
        """Class of every accepted record: record, order, label."""
        return self._resolved(self.table("accepted").select("record", "order", "label"))


def repeats(records: DataFrame, texts: DataFrame, exact_keys: list[str]) -> DataFrame:
    """Class of every record: record, order, label, from a new index that accepts the ``batch`` column's batches in order.

    Arguments as for :func:`staged`; without a column ``batch`` all records are one batch.
    """
    index = Index(records.sparkSession)
    folder = f"{index.folder}/staged"
    rows = staged(records, texts, exact_keys)
    rows.write.partitionBy("batch").parquet(folder)
    rows = index.spark.read.schema(rows.schema).parquet(folder)
    for (batch,) in sorted(rows.select("batch").distinct().collect()):
        index.accept(rows.where(F.col("batch") == batch), batch)
    return index.classes() if index._counts is not None else index.spark.createDataFrame([], "record long, order long, label long")


def split_order(order: Column) -> tuple[Column, Column]:
    """Run and record of an order."""
    return F.shiftright(order, _ID_BITS).cast("int"), order.bitwiseAND(F.lit((1 << _ID_BITS) - 1))
