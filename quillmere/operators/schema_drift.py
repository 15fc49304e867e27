"""Schemas that drift between files.

Files are JSON texts: an array of records, or an object that wraps it. Each file's schema is a tree (objects, arrays,
scalar leaves with a type). The schemas of neighbouring files of a group are compared by tree edit distance
(Zhang-Shasha), and the least-cost script is the report: a leaf it keeps stands, one it relabels is renamed, one it
deletes is removed and one it adds is new, unless a last step of the script turns a deletion and an addition into a move.

Relabelling and moving are open to leaves whose values stand unchanged in the records common to both files, and cost the
less, the more distinct values and records show it; other leaves can only be deleted and added. The trees are ordered by
label, but a new node stands where the node stood whose values it holds, so that renames don't cross. Relabels are given
up for moves where that makes the script cheaper.

The scripts of all files, compiled into one mapping of paths to canonical paths and one type per canonical path, are the
projection that reads every file into one table.

Neighbours are found on file metadata alone, by a range partitioning that splits groups of any size; only the last row
of each partition reaches the driver. Contents meet by two equi-joins on unique file ids.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.session import cut, keep

#: Costs of a script: a deletion or an addition, relabelling an inner node, moving on top of relabelling, and what is never done.
DELETE = ADD = 1.0
RELABEL_INNER, MOVE, NEVER = 0.5, 0.1, 1e6


def _reject(token: str):
    raise ValueError(token)


def parse(content: str | None):
    """The JSON value, or a ValueError; constants that JSON lacks are errors."""
    if content is None:
        raise ValueError("null content")
    return json.loads(content, parse_constant=_reject)


def readable(content: str | None) -> bool:
    """Whether the content is valid JSON."""
    try:
        parse(content)
    except (ValueError, RecursionError):
        return False
    return True


def _kind(value) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "integer"
    return "fraction" if isinstance(value, float) else "string"


def scalars(value, path: str = "") -> Iterator[tuple[str, object]]:
    """Every non-null scalar with its path (``a.b``, arrays as ``a[].b``)."""
    stack = [(path, value)]
    while stack:
        at, v = stack.pop()
        if isinstance(v, dict):
            stack += [(f"{at}.{k}" if at else k, x) for k, x in reversed(v.items())]
        elif isinstance(v, list):
            stack += [(f"{at}[]", x) for x in reversed(v)]
        elif v is not None:
            yield at, v


@dataclass
class FileSchema:
    """What a file tells: wrapper keys, type of each field, values of each field by record key."""

    wrappers: set[str] = field(default_factory=set)
    types: dict[str, str] = field(default_factory=dict)
    values: dict[str, dict[str, tuple]] = field(default_factory=dict)
    records: list[tuple[str | None, dict[str, tuple]]] = field(default_factory=list)


def read_file(content: str, key_field: str) -> FileSchema:
    """Schema and values of a readable file.

    The type of a field is that of most of its values; integers among fractions count as fractions. Records that aren't
    objects are left out; records without a key count for the schema only. Of two records with one key the last counts.
    """
    root, out = parse(content), FileSchema()
    lists = [(None, root)] if isinstance(root, list) else list(root.items()) if isinstance(root, dict) else []
    seen: dict[str, Counter] = {}
    for wrapper, value in lists:
        if not isinstance(value, list):
            continue
        if wrapper is not None:
            out.wrappers.add(wrapper)
        for record in value:
            if not isinstance(record, dict):
                continue
            fields: dict[str, list] = {}
            for path, v in scalars(record):
                fields.setdefault(path, []).append((_kind(v), v))
                seen.setdefault(path, Counter())[_kind(v)] += 1
            key = record.get(key_field)
            key = None if key is None or isinstance(key, (dict, list)) else str(key)
            record_values = {p: tuple(v) for p, v in fields.items()}
            out.records.append((key, record_values))
            if key is not None:
                out.values[key] = record_values
    for path, kinds in seen.items():
        if set(kinds) == {"integer", "fraction"}:
            out.types[path] = "fraction"
        else:
            out.types[path] = min(kinds, key=lambda k: (-kinds[k], k))
    return out


# --- tree edit distance ---------------------------------------------------------------------------------------------


class Tree:
    """Ordered schema tree in postorder: labels, leaf paths (null for inner nodes), leftmost leaves, key roots.

    Siblings are ordered by label; ``places`` gives nodes (by path) the place of another label.
    """

    def __init__(self, paths: set[str], places: dict[str, str] | None = None):
        self._places = places or {}
        root: dict = {}
        for path in paths:
            node = root
            for step in path.split("."):
                node = node.setdefault(step, {})
            node[""] = path
        self.labels: list[str] = []
        self.paths: list[str | None] = []
        self.left: list[int] = []
        self._add("", "", root)
        roots = {}
        for i, left in enumerate(self.left):
            roots[left] = i
        self.key_roots = sorted(roots.values())

    def _add(self, label: str, path: str, node: dict) -> int:
        first = None
        below = [(f"{path}.{step}" if path else step, step) for step in node if step]
        for at, step in sorted(below, key=lambda x: (self._places.get(x[0], x[1]), x[1])):
            left = self._add(step, at, node[step])
            first = left if first is None else first
        here = len(self.labels)
        self.labels.append(label)
        self.paths.append(node.get(""))
        self.left.append(here if first is None else first)
        return self.left[-1]


def edit_distance(old: Tree, new: Tree, relabel, delete=None, add=None) -> tuple[float, list[tuple[int, int]]]:
    """Zhang-Shasha: least cost and the pairs of nodes that a least-cost script keeps or relabels.

    ``relabel`` gives the cost for two nodes, ``delete`` and ``add`` for one (1 where not given).
    """
    gone = [delete(a) if delete else DELETE for a in range(len(old.labels))]
    come = [add(b) if add else ADD for b in range(len(new.labels))]
    dist = [[0.0] * len(come) for _ in gone]
    swap = [[0.0] * len(come) for _ in gone]

    def forests(i: int, j: int, fill: bool) -> list[list[float]]:
        """Costs between the forests that end at each node under i and j."""
        li, lj = old.left[i], new.left[j]
        above = [0.0]
        for b in range(lj, j + 1):
            above.append(above[-1] + come[b])
        table = [above]
        for a in range(li, i + 1):
            row, whole, base = [above[0] + gone[a]], old.left[a] == li, table[old.left[a] - li]
            for b in range(lj, j + 1):
                y = b - lj + 1
                cost = min(above[y] + gone[a], row[y - 1] + come[b])
                if whole and new.left[b] == lj:
                    if fill:
                        swap[a][b] = relabel(a, b)
                    cost = min(cost, above[y - 1] + swap[a][b])
                    dist[a][b] = cost
                else:
                    cost = min(cost, base[new.left[b] - lj] + dist[a][b])
                row.append(cost)
            table.append(row)
            above = row
        return table

    for i in old.key_roots:
        for j in new.key_roots:
            forests(i, j, True)
    pairs: list[tuple[int, int]] = []
    todo = [(len(gone) - 1, len(come) - 1)]
    while todo:
        i, j = todo.pop()
        li, lj, table = old.left[i], new.left[j], forests(i, j, False)
        x, y = i - li + 1, j - lj + 1
        while x and y:
            a, b = li + x - 1, lj + y - 1
            if old.left[a] == li and new.left[b] == lj:
                if table[x][y] == table[x - 1][y - 1] + swap[a][b]:
                    pairs.append((a, b))
                    x, y = x - 1, y - 1
                    continue
            elif table[x][y] == table[old.left[a] - li][new.left[b] - lj] + dist[a][b]:
                todo.append((a, b))
                x, y = old.left[a] - li, new.left[b] - lj
                continue
            x, y = (x - 1, y) if table[x][y] == table[x - 1][y] + gone[a] else (x, y - 1)
    return dist[-1][-1], pairs


def assign(costs: dict[tuple[str, str], float]) -> tuple[float, dict[str, str]]:
    """Pairs of most saving, where a pair saves what it costs less than a deletion and an addition (shortest augmenting paths)."""
    left, right = sorted({p for p, _ in costs}), sorted({q for _, q in costs})
    if len(costs) == 1:
        ((pair, cost),) = costs.items()
        return DELETE + ADD - cost, dict([pair])
    n, m = len(left), len(right) + len(left)  # a column of its own for every row that stays alone
    weight = [[min(0.0, costs.get((p, q), 0.0) - DELETE - ADD if (p, q) in costs else 0.0) for q in right] + [0.0] * n for p in left]
    u, v, owner = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, way, done = [float("inf")] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while True:
            done[j0] = True
            i0, delta, j1 = owner[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not done[j]:
                    slack = weight[i0 - 1][j - 1] - u[i0] - v[j]
                    if slack < least[j]:
                        least[j], way[j] = slack, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if done[j]:
                    u[owner[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0] = owner[way[j0]]
            j0 = way[j0]
    pairs = {left[owner[j] - 1]: right[j - 1] for j in range(1, len(right) + 1) if owner[j] and (left[owner[j] - 1], right[j - 1]) in costs}
    return sum(DELETE + ADD - costs[pair] for pair in pairs.items()), pairs


def agreement(old: FileSchema, new: FileSchema, gone: set[str], come: set[str]) -> dict[tuple[str, str], tuple[int, int]]:
    """Pairs of a removed and an added path under which the values of common records stand unchanged.

    Gives the number of distinct values and of records that agree; pairs with a common record that disagrees are left out.
    """
    common = old.values.keys() & new.values.keys()
    left: dict[str, dict[str, tuple]] = {p: {} for p in gone}
    right: dict[str, dict[str, tuple]] = {p: {} for p in come}
    for key in common:
        for side, paths, values in ((left, gone, old.values[key]), (right, come, new.values[key])):
            for p in paths & values.keys():
                side[p][key] = values[p]
    found = {}
    for p, a in left.items():
        for q, b in right.items():
            both = a.keys() & b.keys()
            if both and all(a[k] == b[k] for k in both) and 2 * len(both) >= max(len(a), len(b)):
                found[p, q] = (len({a[k] for k in both}), len(both))
    return found


@dataclass(frozen=True)
class Change:
    """One step of a script; ``step`` is relabel, move, delete, add or retype."""

    kind: str
    path: str
    old_path: str | None = None
    step: str = ""
    old_type: str | None = None
    new_type: str | None = None


def _similar(a: str, b: str) -> float:
    x, y = set(a.lower().replace("_", " ").replace(".", " ").split()), set(b.lower().replace("_", " ").replace(".", " ").split())
    return (len(x & y) / max(1, len(x | y)) + (0.5 if a.rsplit(".", 1)[-1] == b.rsplit(".", 1)[-1] else 0.0)) / 1.5


def _costs(agree: dict[tuple[str, str], tuple[int, int]]) -> dict[tuple[str, str], float]:
    """Cost of relabelling each agreeing pair, from 0.1 to 1: few distinct values, few records and unlike names make it dear."""
    most = max((n for _, n in agree.values()), default=1)
    return {pair: 0.1 + 0.3 * (3 - min(d, 3)) + 0.2 * (1 - n / most) + 0.1 * (1 - _similar(*pair)) for pair, (d, n) in agree.items()}


def _renamed_step(p: str, q: str) -> tuple[str, str] | None:
    """The node of q and the label it had in p, where the paths differ in one step only."""
    x, y = p.split("."), q.split(".")
    differ = [k for k, (a, b) in enumerate(zip(x, y)) if a != b]
    return (".".join(y[: differ[0] + 1]), x[differ[0]]) if len(x) == len(y) and len(differ) == 1 else None


@dataclass(frozen=True)
class Script:
    """What a least-cost script does to the leaves."""

    cost: float
    kept: set[str]
    relabelled: dict[str, str]
    moved: dict[str, str]
    deleted: set[str]
    added: set[str]


def edit_script(old_paths: set[str], new_paths: set[str], costs: dict[tuple[str, str], float]) -> Script:
    """Least-cost script between two schemas; ``costs`` holds the pairs of leaves that may be relabelled or moved."""
    places: dict[str, str] = {}
    for p, q in sorted(costs, key=lambda pq: (costs[pq], pq)):
        step = _renamed_step(p, q)
        if step and step[0] not in places and step[1] not in places.values():
            places[step[0]] = step[1]
    before, after = Tree(old_paths), Tree(new_paths, places)
    # A path that both have is the same field: no script gives it up.
    stay = float(len(before.labels) + len(after.labels))

    def script(barred: set[tuple[str, str]]) -> Script:
        def relabel(a: int, b: int) -> float:
            p, q = before.paths[a], after.paths[b]
            if p is None and q is None:
                return 0.0 if before.labels[a] == after.labels[b] else RELABEL_INNER
            if p is None or q is None or (p, q) in barred:
                return NEVER
            return 0.0 if p == q else costs.get((p, q), NEVER)

        total, pairs = edit_distance(before, after, relabel, lambda a: stay if before.paths[a] in new_paths else DELETE, lambda b: stay if after.paths[b] in old_paths else ADD)
        mapped = {before.paths[a]: after.paths[b] for a, b in pairs if before.paths[a] is not None and after.paths[b] is not None}
        deleted, added = old_paths - mapped.keys(), new_paths - set(mapped.values())
        moves = {(p, q): c + MOVE for (p, q), c in costs.items() if p in deleted and q in added}
        saved, moved = assign(moves) if moves else (0.0, {})
        same = {p for p, q in mapped.items() if p == q}
        return Script(total - saved, same, {p: q for p, q in mapped.items() if p != q}, moved, deleted - moved.keys(), added - set(moved.values()))

    best, barred = script(set()), set()
    for p, q in sorted(best.relabelled.items(), key=lambda pq: -costs[pq]):
        cheaper = any((a == p) != (b == q) and c + MOVE < costs[p, q] for (a, b), c in costs.items())
        if cheaper and (other := script(barred | {(p, q)})).cost < best.cost - 1e-9:
            best = other
            barred.add((p, q))
    return best


def compare(old: FileSchema, new: FileSchema) -> list[Change]:
    """The changes from one file to the next: the steps of the least-cost script, and the kept fields of another type."""
    before, after = set(old.types), set(new.types)
    script = edit_script(before, after, _costs(agreement(old, new, before - after, after - before)))
    changes = []
    for step, pairs in (("relabel", script.relabelled), ("move", script.moved)):
        changes += [Change("renamed", q, p, step, old.types[p], new.types[q]) for p, q in pairs.items()]
    changes += [Change("removed", p, None, "delete", old.types[p]) for p in script.deleted]
    changes += [Change("added", q, None, "add", None, new.types[q]) for q in script.added]
    changes += [Change("retyped", p, None, "retype", old.types[p], new.types[p]) for p in script.kept if old.types[p] != new.types[p]]
    # The wrapper is the root of its records: among several, the least-cost pairing is that in order.
    lost, won = sorted(old.wrappers - new.wrappers), sorted(new.wrappers - old.wrappers)
    for a, b in zip(lost, won):
        changes.append(Change("renamed", f"$.{b}", f"$.{a}", "relabel"))
    changes += [Change("removed", f"$.{a}", None, "delete") for a in lost[len(won) :]] + [Change("added", f"$.{b}", None, "add") for b in won[len(lost) :]]
    return sorted(changes, key=lambda c: (c.kind, c.path))


# --- over tables of files -------------------------------------------------------------------------------------------


def readable_files(files: DataFrame) -> DataFrame:
    """Distinct files whose content is valid JSON. ``files``: file, group, exported_at, key_field, content.

    Rows repeated under one file count once; null files are left out.
    """

    @F.pandas_udf("boolean")
    def is_readable(contents: pd.Series) -> pd.Series:
        return contents.map(readable)

    known = files.where("file IS NOT NULL AND content IS NOT NULL").dropDuplicates(["file"])
    return known.where(is_readable("content"))


def neighbours(files: DataFrame) -> DataFrame:
    """Each file with the file before it in its group: file, before (null for the first).

    Order: exported_at (nulls first), then file. ``files``: file, group, exported_at.
    """
    order = ["group", "exported_at", "file"]
    ordered = cut(files.select(*order).repartitionByRange(*order).sortWithinPartitions(*order))

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for batch in batches:
            before = []
            for part, group, name in zip(batch["part"], batch["group"], batch["file"]):
                before.append(last[1] if last and last[0] == group else None)
                last = (group, name)
            yield batch.assign(before=pd.array(before, dtype="Int64"))[["part", "group", "file", "before"]]

    linked = keep(ordered.withColumn("part", F.spark_partition_id()).select("part", "group", "file").mapInPandas(link, "part int, group string, file long, before long"))
    ends = ordered.select(F.spark_partition_id().alias("part"), "group", "exported_at", "file").groupBy("part").agg(
        F.max_by(F.struct("group", "file"), F.struct("group", "exported_at", "file")).alias("last"), F.min_by(F.struct("group", "file"), F.struct("group", "exported_at", "file")).alias("first")
    )
    carried, last = {}, None
    for row in sorted(ends.collect(), key=lambda r: r.part):
        if last and last.group == row.first.group:
            carried[row.first.file] = last.file
        last = row.last
    if not carried:
        return linked.select("file", "before")
    table = files.sparkSession.createDataFrame(list(carried.items()), "file long, carried long")
    return linked.join(F.broadcast(table), "file", "left").select("file", F.coalesce("before", "carried").alias("before"))


def changes(files: DataFrame) -> DataFrame:
    """Changes of every readable file against the readable file before it: file, kind, path, old_path, step, old_type, new_type.

    ``files``: file, group, exported_at, key_field (the field that names a record), content.
    """
    good = keep(readable_files(files))
    pairs = neighbours(good).where("before IS NOT NULL")
    contents = good.select("file", "key_field", "content")
    both = pairs.join(contents, "file").join(contents.select(F.col("file").alias("before"), F.col("content").alias("content_before")), "before")

    def diff(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, key, old, new in zip(batch["file"], batch["key_field"], batch["content_before"], batch["content"]):
                rows += [(name, c.kind, c.path, c.old_path, c.step, c.old_type, c.new_type) for c in compare(read_file(old, key), read_file(new, key))]
            yield pd.DataFrame(rows, columns=["file", "kind", "path", "old_path", "step", "old_type", "new_type"])

    schema = "file long, kind string, path string, old_path string, step string, old_type string, new_type string"
    return both.select("file", "key_field", "content_before", "content").mapInPandas(diff, schema)


def compile_projection(renames: list[tuple[str, str, str, int]]) -> dict[tuple[str, str], str]:
    """(kind, path) -> canonical path, from all renames (kind, old, new, times): the spelling that most renames lead to.

    The number of distinct renames is bounded by the number of distinct paths, not of files.
    """
    parent: dict[tuple[str, str], tuple[str, str]] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    weight: Counter = Counter()
    for kind, old, new, times in renames:
        parent[find((kind, old))] = find((kind, new))
        weight[kind, new] += times
        weight[kind, old] += 0
    best: dict[tuple[str, str], tuple] = {}
    for node in weight:
        root, rank = find(node), (-weight[node], node[1])
        if root not in best or rank < best[root]:
            best[root] = rank
    return {node: best[find(node)][1] for node in weight}


def canonical_fields(values: dict[str, str], names: dict[str, str]) -> dict[str, str]:
    """The values of a record under canonical paths (``names``: path -> canonical path, others stay).

    No value is lost: where several paths of a record lead to one canonical path, that path itself comes first, then the
    first in order, and the others stay under their own paths, which no path leads to.
    """
    out: dict[str, str] = {}
    for path in sorted(values, key=lambda p: (names.get(p, p) != p, p)):
        name = names.get(path, path)
        out[path if name in out else name] = values[path]
    return out


_INTEGER, _FRACTION = re.compile(r"-?(?:0|[1-9][0-9]{0,18})"), re.compile(r"-?(?:0|[1-9][0-9]{0,18})\.[0-9]+(?:[eE][+\-]?[0-9]+)?")


def _form(kind: str, value) -> str:
    """The type of a value, or what a string could be read as (``string:integer`` and the like)."""
    if kind != "string":
        return kind
    if _INTEGER.fullmatch(value):
        return "string:integer"
    if _FRACTION.fullmatch(value):
        return "string:fraction"
    return "string:boolean" if value in ("true", "false") else "string"


def common_type(forms: set[str]) -> str:
    """The one type of a field over all files, from all forms of its values.

    Strings stay strings unless other files hold another type that every one of them can be read as; integers among
    fractions are fractions; what fits nothing together is a string.
    """
    plain = {f for f in forms if ":" not in f}
    read = plain | {f.split(":")[1] for f in forms - plain}
    if not plain or "string" in plain or len(read) == 1:
        return "string" if not plain or "string" in plain else read.pop()
    return "fraction" if read == {"integer", "fraction"} else "string"


def as_type(value, to: str):
    """The value under a type that :func:`common_type` gave for it."""
    if to == "string":
        return value if isinstance(value, str) else json.dumps(value)
    if to == "boolean":
        return value == "true" if isinstance(value, str) else value
    return int(value) if to == "integer" else float(value)


def consistent_table(files: DataFrame, changed: DataFrame) -> DataFrame:
    """Every record of every readable file under canonical paths: file, kind, record_key, fields (path -> text), typed.

    ``files`` as for :func:`changes`, with ``kind``. Every reported rename is compiled, however seldom it occurs. A path
    has one type over all files of its kind (:func:`common_type`); ``fields`` holds the values as text and ``typed`` the
    record as a JSON object of the values in those types, in order of path. Lists of scalars are lists there.
    Only the distinct renames and the distinct forms of each path reach the driver: the size of the schema, not of the data.
    """
    kinds = files.select("file", "kind").dropDuplicates(["file"]).withColumnRenamed("kind", "file_kind")
    seen = changed.where("kind = 'renamed' AND path NOT LIKE '$.%'").join(kinds, "file").groupBy("file_kind", "old_path", "path").count()
    mapping = compile_projection([(r.file_kind, r.old_path, r.path, r["count"]) for r in seen.collect()])
    by_kind: dict[str, dict[str, str]] = {}
    for (of_kind, path), name in mapping.items():
        by_kind.setdefault(of_kind, {})[path] = name
    table = files.sparkSession.sparkContext.broadcast(by_kind)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, kind, key, content in zip(batch["file"], batch["kind"], batch["key_field"], batch["content"]):
                for record_key, values in read_file(content, key).records:
                    under = canonical_fields({p: p for p in values}, table.value.get(kind, {}))
                    rows.append((name, kind, record_key, [{"path": q, "forms": sorted({_form(t, v) for t, v in values[p]}), "value": json.dumps([v for _, v in values[p]], ensure_ascii=False)} for q, p in under.items()]))
            yield pd.DataFrame(rows, columns=["file", "kind", "record_key", "fields"])

    good = readable_files(files).select("file", "kind", "key_field", "content")
    projected = keep(good.mapInPandas(project, "file long, kind string, record_key string, fields array<struct<path:string,forms:array<string>,value:string>>"))
    forms = projected.select("kind", F.inline("fields")).select("kind", "path", F.explode("forms").alias("form")).distinct()
    held: dict[tuple[str, str], set[str]] = {}
    for r in forms.collect():
        held.setdefault((r.kind, r.path), set()).add(r.form)
    types = files.sparkSession.sparkContext.broadcast({at: common_type(f) for at, f in held.items()})

    def typed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, objects = [], []
            for kind, fields in zip(batch["kind"], batch["fields"]):
                values = {f["path"]: [as_type(v, types.value[kind, f["path"]]) for v in json.loads(f["value"])] for f in fields}
                single = {p: v[0] if len(v) == 1 else v for p, v in sorted(values.items())}
                texts.append([(p, v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)) for p, v in single.items()])
                objects.append(json.dumps(single, ensure_ascii=False))
            yield batch[["file", "kind", "record_key"]].assign(fields=texts, typed=objects)

    schema = "file long, kind string, record_key string, fields array<struct<path:string,value:string>>, typed string"
    return projected.mapInPandas(typed, schema).withColumn("fields", F.map_from_entries("fields"))
