"""Discovery of the source files of one or more export roots, and their collection fingerprint."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmere.operators.ordering import KIND_ORDER, kind_rank

# The layout of an export.
POSTS_FOLDER = "your_facebook_activity/posts"
ALBUM_FOLDER = "your_facebook_activity/posts/album"
REELS_FILE = "your_facebook_activity/reels/your_reels.json"
TIMELINE_NAME = re.compile(r"your_posts__check_ins__photos_and_videos_(\d+)\.json")
ALBUM_NAME = re.compile(r"(\d+)\.json")
STATE_NAMES = {
    "archive.json": "archive",
    "trash.json": "trash",
    "your_videos.json": "video_metadata",
    "your_uncategorized_photos.json": "photo_metadata",
    "check-ins.json": "checkin_metadata",
    "content_sharing_links_you_have_created.json": "sharing_link_metadata",
}
#: Sequence of files without a number.
LAST = 2**53 - 1


class DiscoveryError(Exception):
    """Discovery failed; ``code`` is EXPORT_ROOT_NOT_FOUND, SOURCE_FILE_MISSING or SOURCE_FILE_READ_FAILED."""

    def __init__(self, code: str, message: str, root_number: int | None = None):
        super().__init__(message)
        self.code, self.root_number = code, root_number


@dataclass(frozen=True)
class SourceFile:
    path: str
    root_number: int
    relative_path: str
    kind: str
    sequence: int
    size_bytes: int
    sha256: str


@dataclass(frozen=True)
class Collection:
    root_count: int
    fingerprint: str
    files: tuple[SourceFile, ...]


def _inside(root: str, path: str, number: int) -> str:
    real = os.path.realpath(path)
    if os.path.commonpath([root, real]) != root or real == root:
        raise DiscoveryError("SOURCE_FILE_READ_FAILED", f"A file of export root {number} lies outside the root.", number)
    return real


def _listed(folder: str, number: int) -> list[os.DirEntry] | None:
    try:
        with os.scandir(folder) as entries:
            return sorted(entries, key=lambda e: e.name)
    except FileNotFoundError:
        return None
    except OSError as e:
        raise DiscoveryError("SOURCE_FILE_READ_FAILED", f"A folder of export root {number} can't be read.", number) from e


def _wanted(root: str, number: int, all_kinds: bool) -> list[tuple[str, str, str, int]]:
    """(path, relative path, kind, sequence) of the files of a root; none without the posts folder."""
    entries = _listed(os.path.join(root, POSTS_FOLDER), number)
    if entries is None:
        return []
    found = []
    for e in (e for e in entries if e.is_file()):
        m = TIMELINE_NAME.fullmatch(e.name)
        if m:
            found.append((e.path, "timeline", int(m[1]), POSTS_FOLDER))
        elif all_kinds and e.name in STATE_NAMES:
            found.append((e.path, STATE_NAMES[e.name], LAST, POSTS_FOLDER))
    if all_kinds:
        for e in _listed(os.path.join(root, ALBUM_FOLDER), number) or []:
            m = ALBUM_NAME.fullmatch(e.name)
            if e.is_file() and m:
                found.append((e.path, "album_metadata", int(m[1]), ALBUM_FOLDER))
        reels = os.path.join(root, REELS_FILE)
        if os.path.isfile(reels):
            found.append((reels, "reel", LAST, os.path.dirname(REELS_FILE)))
    return [(real := _inside(root, path, number), f"{folder}/{os.path.basename(path if kind == 'album_metadata' else real)}", kind, sequence) for path, kind, sequence, folder in found]


def _hash(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def by_file(spark: SparkSession, files: pd.DataFrame) -> DataFrame:
    """Rows about files, spread over tasks: one file to a task up to 10,000 tasks."""
    return spark.createDataFrame(files).repartition(max(1, min(len(files), 10_000)), "path")


def spark_hashes(spark: SparkSession) -> Callable[[list[str]], dict[str, str]]:
    """Hashes files on the executors, chunk by chunk; as the ``hashes`` of :func:`discover`."""

    def hashes(paths: list[str]) -> dict[str, str]:
        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield batch.assign(sha256=[_hash(p) if os.access(p, os.R_OK) else None for p in batch["path"]])

        rows = by_file(spark, pd.DataFrame({"path": paths})).mapInPandas(each, "path string, sha256 string").collect() if paths else []
        return {r.path: r.sha256 for r in rows if r.sha256 is not None}

    return hashes


class RootHash:
    """Hash of the files of one root, given in order of their relative paths; nothing but the hash is held."""

    def __init__(self):
        self._hash, self._first = hashlib.sha256(b"["), True

    @staticmethod
    def described(relative_path: str, kind: str, sequence: int, size_bytes: int, sha256: str) -> str:
        return json.dumps({"relativePath": relative_path, "sourceKind": kind, "sequence": sequence, "sizeBytes": size_bytes, "sha256": sha256}, separators=(",", ":"), ensure_ascii=False)

    def add(self, *file) -> None:
        self._hash.update((("" if self._first else ",") + self.described(*file)).encode())
        self._first = False

    def hexdigest(self) -> str:
        done = self._hash.copy()
        done.update(b"]")
        return done.hexdigest()


class CollectionHash:
    """Hash of the roots of a collection, given in order of their fingerprints, each with its files in order."""

    def __init__(self, root_count: int):
        self._hash, self._root, self._roots = hashlib.sha256(f'{{"fingerprintVersion":1,"rootCount":{root_count},"roots":['.encode()), None, 0

    def root(self, fingerprint: str) -> None:
        self._hash.update((("" if not self._roots else "]},") + f'{{"rootFingerprint":"{fingerprint}","files":[').encode())
        self._roots, self._first = self._roots + 1, True

    def add(self, *file) -> None:
        self._hash.update((("" if self._first else ",") + RootHash.described(*file)).encode())
        self._first = False

    def hexdigest(self) -> str:
        done = self._hash.copy()
        done.update(("]}]}" if self._roots else "]}").encode())
        return done.hexdigest()


def collection_fingerprint(root_count: int, files: list[SourceFile]) -> str:
    """Hash of the files of all roots that doesn't depend on the order of roots."""
    roots = []
    for number in range(1, root_count + 1):
        own = [(f.relative_path, f.kind, f.sequence, f.size_bytes, f.sha256) for f in sorted(files, key=lambda f: f.relative_path) if f.root_number == number]
        root = RootHash()
        for f in own:
            root.add(*f)
        roots.append((root.hexdigest(), own))
    whole = CollectionHash(root_count)
    for fingerprint, own in sorted(roots, key=lambda r: r[0]):
        whole.root(fingerprint)
        for f in own:
            whole.add(*f)
    return whole.hexdigest()


def collection_fingerprints(files: DataFrame) -> DataFrame:
    """Fingerprint of every collection: collection, fingerprint; equal to :func:`collection_fingerprint` of its files.

    ``files``: collection, root_number, relative_path, kind, sequence, size_bytes, sha256, each file once. Roots without
    files are unknown here. Files are sorted by Spark and stream through the hashes, so no root or collection is gathered.
    """
    columns = ["relative_path", "kind", "sequence", "size_bytes", "sha256"]

    def roots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, root = None, None
        for batch in batches:
            done = []
            for collection, number, *file in batch[["collection", "root_number", *columns]].itertuples(index=False):
                if (collection, number) != at:
                    done += [(*at, root.hexdigest())] if at else []
                    at, root = (collection, number), RootHash()
                root.add(*_plain(file))
            yield pd.DataFrame(done, columns=["collection", "root_number", "root"])
        if at:
            yield pd.DataFrame([(*at, root.hexdigest())], columns=["collection", "root_number", "root"])

    def wholes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, in_root, whole = None, None, None
        for batch in batches:
            done = []
            for collection, count, fingerprint, number, *file in batch[["collection", "roots", "root", "root_number", *columns]].itertuples(index=False):
                if collection != at:
                    done += [(at, whole.hexdigest())] if whole else []
                    at, in_root, whole = collection, None, CollectionHash(int(count))
                if (fingerprint, number) != in_root:
                    in_root = (fingerprint, number)
                    whole.root(fingerprint)
                whole.add(*_plain(file))
            yield pd.DataFrame(done, columns=["collection", "fingerprint"])
        if whole:
            yield pd.DataFrame([(at, whole.hexdigest())], columns=["collection", "fingerprint"])

    per_root = files.repartition("collection", "root_number").sortWithinPartitions("collection", "root_number", "relative_path", "sha256").mapInPandas(roots, "collection string, root_number int, root string")
    counted = per_root.join(per_root.groupBy("collection").agg(F.count("*").alias("roots")), "collection")
    placed = files.join(counted, ["collection", "root_number"])
    return placed.repartition("collection").sortWithinPartitions("collection", "root", "root_number", "relative_path", "sha256").mapInPandas(wholes, "collection string, fingerprint string")


def _plain(file: list) -> tuple:
    path, kind, sequence, size, sha256 = file
    return path, kind, int(sequence), int(size), sha256


def sequence_of(path: Column, kind: Column) -> Column:
    """The number of a numbered file (timeline and album files), else ``LAST``; numbers beyond a long count as last."""
    number = F.regexp_extract(path, r"(?:^|/|_)([0-9]+)\.json$", 1)
    return F.when(kind.isin("timeline", "album_metadata"), F.coalesce(number.try_cast("long"), F.lit(LAST))).otherwise(F.lit(LAST))


def in_order(files: DataFrame, collection: str = "collection") -> DataFrame:
    """Files with their place in processing order within their collection: kind, number, root, path (column ``place``)."""
    order = Window.partitionBy(collection).orderBy(kind_rank(F.col("kind")), sequence_of(F.col("relative_path"), F.col("kind")), "root_number", "relative_path")
    return files.withColumn("place", F.row_number().over(order))


def discover(roots: list[str], all_kinds: bool = False, hashes: Callable[[list[str]], dict[str, str]] | None = None) -> Collection:
    """The source files of the roots in processing order: kind, number, root, path.

    ``hashes`` gives the hashes of paths that can be read, such as :func:`spark_hashes`; without it they are made here.
    """
    if not roots:
        raise DiscoveryError("EXPORT_ROOT_NOT_FOUND", "No export root was given.")
    wanted = []
    for number, given in enumerate(roots, 1):
        root = os.path.realpath(given)
        if not os.path.isdir(root):
            raise DiscoveryError("EXPORT_ROOT_NOT_FOUND", f"Export root {number} is no folder.", number)
        wanted += [(number, *w) for w in _wanted(root, number, all_kinds)]
    known = hashes([path for _, path, *_ in wanted]) if hashes else {}
    files: list[SourceFile] = []
    for number, path, relative, kind, sequence in wanted:
        try:
            files.append(SourceFile(path, number, relative, kind, sequence, os.path.getsize(path), known.get(path) or _hash(path)))
        except OSError as e:
            raise DiscoveryError("SOURCE_FILE_READ_FAILED", f"A file of export root {number} can't be read.", number) from e
    if not files:
        raise DiscoveryError("SOURCE_FILE_MISSING", "The export roots hold no supported file.")
    files.sort(key=lambda f: (KIND_ORDER.index(f.kind), f.sequence, f.root_number, f.relative_path))
    return Collection(len(roots), collection_fingerprint(len(roots), files), tuple(files))


def as_rows(collection: Collection) -> list[dict]:
    """The files as plain rows."""
    return [asdict(f) for f in collection.files]
