"""Filling fixed-capacity containers with items of varying length.

Shortest-pack-first packing over the histogram of lengths: lengths are placed longest first; of the packs that have room
the one with most room is extended, and counts of packing patterns are updated, never single packs. The histogram has at
most ``capacity`` entries whatever the number of items, so this runs on the driver in time bounded by the capacity.

Items meet their places by rank: every item has a rank among the items of its length, and every pattern owns an interval
of the ranks of each of its lengths. Ranks are made without gathering a length in one task: items are numbered within
(part, length), and offsets come from the counts of those groups. Parts are hashes of the documents, their number follows
from the number of items, so the same items always get the same places, however the input was split.

An item longer than the capacity is cut into full containers and a rest, which is packed as an item. Items of length 0
take no room and go to container 0. Null items have length 0.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmere.session import cut

#: Splitting pattern of the byte-level tokenizer (a fixed value of the public vocabulary).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Items to a part of the numbering.
PART_ROWS = 1_000_000
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, tokenizer_path: str = TOKENIZER) -> DataFrame:
    """Tokens of every document: doc, length. ``documents``: doc, text. The vocabulary file lies at the path on every executor."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _encoding(tokenizer_path)
        for texts in batches:
            yield pd.Series([len(encoding.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return documents.select("doc", count("text").alias("length"))


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Packing patterns of the lengths 1 to ``capacity``: (number of packs, lengths in them)."""
    open_packs: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    done: list[tuple[int, tuple[int, ...]]] = []
    rooms: list[int] = []  # rooms of the open packs, ascending

    def push(room: int, n: int, pack: tuple[int, ...]) -> None:
        if room == 0:
            done.append((n, pack))
            return
        if not open_packs.get(room):
            rooms.insert(int(np.searchsorted(rooms, room)), room)
        open_packs.setdefault(room, []).append((n, pack))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if not 1 <= length <= capacity:
            raise ValueError("lengths must lie between 1 and the capacity")
        while left > 0:
            room = rooms[-1] if rooms else 0
            if room < length:
                # None has room: the rest of this length opens packs, and shares them as far as it fits.
                fit = capacity // length
                packs, rest = divmod(left, fit)
                if packs:
                    push(capacity - length * fit, packs, (length,) * fit)
                if rest:
                    push(capacity - length * rest, 1, (length,) * rest)
                break
            n, pack = open_packs[room].pop()
            if not open_packs[room]:
                rooms.pop()
            used = min(n, left)
            if n > used:
                push(room, n - used, pack)
            push(room - length, used, (*pack, length))
            left -= used
    return done + [p for packs in open_packs.values() for p in packs]


def _intervals(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[int, np.ndarray]:
    """Per length the intervals of ranks: columns first rank, first container, position."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    container = 0
    for n, pack in patterns:
        for position, length in enumerate(pack):
            first = used.get(length, 0)
            rows.setdefault(length, []).append((first, container, position))
            used[length] = first + n
        container += n
    return {length: np.array(r, dtype=np.int64) for length, r in rows.items()}


def ranked(items: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Adds to durable ``items`` (doc, piece, length) their rank among the items of one length, from 0."""
    parts = max(1, -(-items.count() // part_rows))
    placed = items.withColumn("part", F.pmod(F.xxhash64("doc", "piece"), F.lit(parts)))
    counts = placed.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    numbered = placed.withColumn("number", F.row_number().over(Window.partitionBy("part", "length").orderBy("doc", "piece")) - 1)
    return numbered.join(offsets, ["part", "length"]).withColumn("rank", F.col("offset") + F.col("number")).drop("part", "offset", "number")


def pack(lengths: DataFrame, capacity: int) -> DataFrame:
    """Assignment of documents to containers: doc, piece, length, container, position.

    ``lengths``: doc, length. Pieces of documents beyond the capacity are numbered from 0 in order of the text; other
    documents have the one piece 0. Repeated documents are items of their own.
    """
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    size = F.coalesce(F.col("length"), F.lit(0)).cast("long")
    pieces = lengths.select("doc", size.alias("total"), F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(size / F.lit(capacity)), F.lit(1)).cast("long") - 1)).alias("piece"))
    pieces = pieces.select("doc", "piece", F.least(F.col("total") - F.col("piece") * capacity, F.lit(capacity).cast("long")).alias("length"))
    items = cut(ranked(cut(pieces)))
    histogram = {r.length: r["count"] for r in items.where("length > 0").groupBy("length").count().collect()}
    table = items.sparkSession.sparkContext.broadcast(_intervals(pack_histogram(histogram, capacity)))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        intervals = table.value
        for batch in batches:
            container, position = np.zeros(len(batch), dtype=np.int64), np.zeros(len(batch), dtype=np.int64)
            lengths_, ranks = batch["length"].to_numpy(), batch["rank"].to_numpy()
            for length in np.unique(lengths_):
                if length > 0:
                    rows = intervals[int(length)]
                    where = np.flatnonzero(lengths_ == length)
                    k = np.searchsorted(rows[:, 0], ranks[where], side="right") - 1
                    container[where] = rows[k, 1] + ranks[where] - rows[k, 0]
                    position[where] = rows[k, 2]
            yield batch[["doc", "piece", "length"]].assign(container=container, position=position)

    return items.mapInPandas(place, "doc long, piece long, length long, container long, position long")
