"""The inventory on disk: immutable parquet parts, one manifest that is swapped by rename, one writer at a time."""

from __future__ import annotations

import contextlib
import datetime as dt
import json
import os
import socket
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

#: Steps from one version of the store to the next, by number: name, and what it does to the manifest.
MIGRATIONS: dict[int, tuple[str, Callable[[dict], None]]] = {
    1: ("tables", lambda manifest: manifest.setdefault("tables", {})),
    2: ("profiles and collections", lambda manifest: [manifest["tables"].setdefault(t, []) for t in ("profiles", "collections")]),
}
SCHEMA_VERSION = max(MIGRATIONS)


def migrate(manifest: dict) -> dict:
    """The manifest at the newest version: every step that it lacks, in order of number, each noted with its time.

    A manifest of a later version than this code knows, or one whose noted steps have gaps, is refused.
    """
    version = manifest.get("schema_version", 0)
    if not isinstance(version, int) or version > SCHEMA_VERSION:
        raise ValueError(f"the store has schema version {version}, this code knows {SCHEMA_VERSION}")
    noted = manifest.setdefault("migrations", [{"version": v, "name": MIGRATIONS[v][0], "applied_at": None} for v in range(1, version + 1)])
    if [m["version"] for m in noted] != list(range(1, version + 1)):
        raise ValueError("the store's migrations have gaps")
    for number in sorted(v for v in MIGRATIONS if v > version):
        name, step = MIGRATIONS[number]
        step(manifest)
        noted.append({"version": number, "name": name, "applied_at": dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")})
        manifest["schema_version"] = number
    return manifest


class StoreLocked(RuntimeError):
    """Another process holds, or held, the store; ``status`` is active, stale, remote or invalid."""

    def __init__(self, status: str):
        super().__init__(f"the store is locked ({status})")
        self.status = status


def _lock_status(path: str) -> str:
    try:
        with open(path) as f:
            held = json.load(f)
        host, pid = held["host"], int(held["pid"])
    except (OSError, ValueError, KeyError, TypeError):
        return "invalid"
    if host != socket.gethostname():
        return "remote"
    try:
        os.kill(pid, 0)
    except ProcessLookupError:
        return "stale"
    except PermissionError:
        pass
    return "active"


@contextlib.contextmanager
def writer(folder: str) -> Iterator[None]:
    """The only writer of a store. A lock that is there is never cleared, only reported."""
    os.makedirs(folder, exist_ok=True)
    path, token = os.path.join(folder, "LOCK"), uuid.uuid4().hex
    try:
        handle = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
    except FileExistsError:
        raise StoreLocked(_lock_status(path)) from None
    with os.fdopen(handle, "w") as f:
        json.dump({"host": socket.gethostname(), "pid": os.getpid(), "token": token}, f)
    try:
        yield
    finally:
        with contextlib.suppress(OSError, ValueError, KeyError):
            with open(path) as f:
                mine = json.load(f)["token"] == token
            if mine:
                os.unlink(path)


class Store:
    """Tables of a folder. ``append`` tables gather parts, ``replace`` tables have one; a commit shows all or nothing.

    A store of an earlier version is migrated when it is opened, and keeps the new version with the next commit.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        manifest: dict = {}
        path = os.path.join(folder, "MANIFEST.json")
        if os.path.exists(path):
            with open(path) as f:
                manifest = json.load(f)
        self.manifest = migrate(manifest)
        self.pending: dict[str, list[str]] = {}

    def read(self, table: str, schema: str) -> DataFrame:
        """The table, empty if there is none."""
        parts = self.manifest["tables"].get(table)
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[os.path.join(self.folder, p) for p in parts])

    def write(self, table: str, df: DataFrame, replace: bool = False) -> None:
        """Writes a part, to be shown by the next commit."""
        part = f"{table}/{uuid.uuid4().hex}"
        df.write.parquet(os.path.join(self.folder, part))
        self.pending[table] = [part] if replace else self.manifest["tables"].get(table, []) + [part]

    def discard(self) -> None:
        """Forgets all pending parts."""
        self.pending = {}

    def commit(self) -> None:
        """Shows all pending parts at once."""
        self.manifest["tables"] |= self.pending
        self.pending = {}
        replace_json(os.path.join(self.folder, "MANIFEST.json"), self.manifest)


def replace_json(path: str, value) -> None:
    """Writes JSON to a file that is there whole or not at all."""
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(temporary, "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, ensure_ascii=False)
        f.write("\n")
    os.replace(temporary, path)
