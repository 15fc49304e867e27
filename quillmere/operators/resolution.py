"""Sequential resolution of records to entities, block by block.

The cascade is sequential: a matched entity leaves the reach of later records of its kind, and updates change what later
records see. Records and entities that share no time, id, address or fingerprint, directly or through others, never see
each other, so blocks of connected ones are resolved in parallel, each in processing order. A block of more than
``MAX_BLOCK`` rows isn't gathered: its rows are sorted by Spark and streamed through one task, which holds the block's
entities only. Both ways take the same decisions; candidates are looked up by key, so a time that many share costs no scan.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.functions.canonical import IDENTITY_VERSION, digest
from quillmere.operators.components import components
from quillmere.operators.ordering import KIND_ORDER, kind_rank
from quillmere.session import cut

MAX_BLOCK = 200_000
ENRICHMENT = frozenset(KIND_ORDER[4:])

ENTITY = (
    "entity_id string, profile_id string, external_id string, direct_url string, normalized_url string, ts long, type string, text string, source_name string, source_url string, "
    "state string, state_status string, fingerprint string, slot int, identity_version int, media array<string>, links array<struct<original:string,normalized:string,source:string,type:string>>, "
    "places array<string>, first_collected string, last_collected string"
)
#: Columns of a record that the decisions read.
READ = (
    "record_id", "kind", "relative_path", "record_index", "raw_sha256", "external_id", "direct_post_url", "normalized_direct_post_url", "created_timestamp", "post_type", "post_text", "normalized_post_text",
    "media_references", "media_keys", "links", "external_urls", "place_reference", "source_name", "source_url", "fingerprint",
)
DECISION = "record_id string, kind string, entity_id string, rule string, rank int, match_status string, changed boolean, sequence long"


@dataclass
class Entity:
    """State of an entity while its block is resolved."""

    entity_id: str
    profile_id: str
    external_id: str | None
    direct_url: str | None
    normalized_url: str | None
    ts: int
    type: str
    text: str | None
    source_name: str | None
    source_url: str | None
    state: str
    state_status: str
    fingerprint: str
    slot: int
    identity_version: int
    media: list = field(default_factory=list)
    links: list = field(default_factory=list)
    places: list = field(default_factory=list)
    first_collected: str | None = None
    last_collected: str | None = None

    def media_keys(self) -> set[str]:
        return {m.lower() for m in self.media}

    def urls(self) -> set[str]:
        return {link["normalized"] for link in self.links}


@dataclass
class Block:
    """Entities of one block in order, and where to find them.

    Ids, addresses and slots are known of all entities; times, media, links and texts of the free ones, those that no
    record of the kind at hand has taken. An entity changes only when it is taken, so it is listed anew with the next kind.
    """

    profile: str
    now: str
    entities: list[Entity] = field(default_factory=list)
    ids: dict = field(default_factory=dict)
    slots: dict = field(default_factory=dict)
    free: dict = field(default_factory=dict)
    listed: dict = field(default_factory=dict)
    taken: dict = field(default_factory=dict)
    places: dict = field(default_factory=dict)
    kind: str | None = None
    occurrences: Counter = field(default_factory=Counter)
    decided: int = 0

    def add(self, e: Entity) -> None:
        self.places[id(e)] = len(self.entities)
        self.entities.append(e)
        self.own(e)
        self.slots.setdefault(e.fingerprint, {}).setdefault(e.slot, set()).add(self.places[id(e)])
        self.release(e)

    def own(self, e: Entity) -> None:
        """The first entity in order owns an id and an address."""
        at = self.places[id(e)]
        for key in (("external_id", e.external_id), ("normalized_url", e.normalized_url)):
            if key[1] is not None:
                self.ids[key] = min(at, self.ids.get(key, at))

    def release(self, e: Entity) -> None:
        keys = {("slot", e.fingerprint, e.slot), ("time", e.ts)} | {("media", e.ts, m) for m in e.media_keys()} | {("link", e.ts, u) for u in e.urls()}
        if e.text is not None:
            keys.add(("text", e.ts, normal(e.text)))
        at = self.places[id(e)]
        self.listed[at] = keys
        for key in keys:
            self.free.setdefault(key, set()).add(at)

    def take(self, e: Entity) -> None:
        at = self.places[id(e)]
        self.taken[at] = e
        for key in self.listed.pop(at, ()):
            self.free[key].discard(at)
            if not self.free[key]:
                del self.free[key]

    def only(self, keys: list[tuple]) -> Entity | None:
        """The only free entity listed under any of the keys."""
        found: set[int] = set()
        for key in keys:
            listed = self.free.get(key, ())
            if len(listed) > 1:
                return None
            found.update(listed)
            if len(found) > 1:
                return None
        return self.entities[found.pop()] if found else None

    def match(self, r: dict, occurrence: int, time_alone: bool, text_alone: bool) -> tuple[str, int, Entity | None]:
        """Rule, rank and entity; no entity for records that no rule matches.

        ``time_alone``, ``text_alone``: no other record of the run has the time, or the time and text.
        """
        enriching = r["kind"] in ENRICHMENT
        for rule, attribute, value in (("M01", "external_id", r["external_id"]), ("M02", "normalized_url", r["normalized_direct_post_url"])):
            at = self.ids.get((attribute, value)) if value is not None else None
            if at is not None:
                return rule, int(rule[2]), self.entities[at]
        same = self.free.get(("slot", r["fingerprint"], occurrence))
        if same:
            return "M03", 3, self.entities[min(same)]
        ts, text = r["created_timestamp"], r["normalized_post_text"]
        keys, urls = set(r["media_keys"]), set(r["external_urls"])
        tests = (
            ("M04", [("media", ts, k) for k in keys]),
            ("M05", [("link", ts, u) for u in urls]),
            ("M06", [("text", ts, text)] if text and (enriching or text_alone) else []),
        )
        for rule, wanted in tests:
            hit = self.only(wanted)
            if hit:
                return rule, int(rule[2]), hit
        e = self.only([("time", ts)])
        if e and (enriching or time_alone):
            against = (keys and e.media_keys() and not keys & e.media_keys()) or (urls and e.urls() and not urls & e.urls())
            if not against:
                return "M07", 7, e
        return ("M09", 9, None) if enriching else ("M08", 8, None)

    def create(self, r: dict, occurrence: int) -> Entity:
        used = self.slots.get(r["fingerprint"], {})
        slot = occurrence
        if slot in used:
            slot = next(s for s in range(1, len(used) + 2) if s not in used)
        stated = {"archive": "archived", "trash": "trash"}.get(r["kind"])
        # The id is derived from what is unique about the entity at its creation, so a repeated run gives the same one.
        made = Entity(
            digest(f"{self.profile}|{r['fingerprint']}|{slot}|{r['record_id']}")[:32], self.profile, r["external_id"], r["direct_post_url"], r["normalized_direct_post_url"], r["created_timestamp"], r["post_type"],
            r["post_text"], r["source_name"], r["source_url"], stated or "active", "confirmed" if stated else "derived", r["fingerprint"], slot, IDENTITY_VERSION,
            first_collected=self.now, last_collected=self.now,
        )
        self.attach(made, r)
        self.add(made)
        return made

    def update(self, e: Entity, r: dict) -> bool | None:
        """Merges a record into an entity; whether it changed, or null if another entity owns the new fingerprint and slot."""
        enriching, keeps = r["kind"] in ENRICHMENT, e.type == "reel" and r["kind"] != "reel"
        keeps_identity = keeps or enriching
        identity = (e.text, e.fingerprint, e.identity_version) if keeps_identity else (r["post_text"], r["fingerprint"], IDENTITY_VERSION)
        if identity[1] != e.fingerprint:
            if self.slots.get(identity[1], {}).get(e.slot):
                return None
            at, old = self.places[id(e)], self.slots[e.fingerprint]
            old[e.slot].discard(at)
            if not old[e.slot]:
                del old[e.slot]
            self.slots.setdefault(identity[1], {}).setdefault(e.slot, set()).add(at)
        before = self.compared(e)
        e.text, e.fingerprint, e.identity_version = identity
        e.external_id = r["external_id"] if e.external_id is None else e.external_id
        e.direct_url = r["direct_post_url"] if e.direct_url is None else e.direct_url
        e.normalized_url = r["normalized_direct_post_url"] if e.normalized_url is None else e.normalized_url
        self.own(e)
        if not keeps and not enriching and r["post_type"] != "unknown":
            e.type = r["post_type"]
        e.source_name = e.source_name if r["source_name"] is None else r["source_name"]
        e.source_url = e.source_url if r["source_url"] is None else r["source_url"]
        if r["kind"] == "trash":
            e.state = "trash"
        elif r["kind"] == "archive" and e.state != "trash":
            e.state = "archived"
        if r["kind"] in ("archive", "trash"):
            e.state_status = "confirmed"
        e.last_collected = self.now
        changed = before != self.compared(e)
        return self.attach(e, r) or changed

    @staticmethod
    def compared(e: Entity) -> tuple:
        return (e.external_id, e.direct_url, e.normalized_url, e.type, e.text, e.source_name, e.source_url, e.state, e.state_status, e.fingerprint, e.identity_version)

    def attach(self, e: Entity, r: dict) -> bool:
        """Adds media, links and, for check-ins, the place; whether anything is new."""
        size = len(e.media) + len(e.links) + len(e.places)
        known = e.media_keys()
        for reference in r["media_references"]:
            if reference.lower() not in known:
                known.add(reference.lower())
                e.media.append(reference)
        pairs = {(link["original"], link["type"]) for link in e.links}
        for link in r["links"]:
            kind = "external" if link["source"] is None else "source"
            if (link["original"], kind) not in pairs:
                pairs.add((link["original"], kind))
                e.links.append({"original": link["original"], "normalized": link["normalized"], "source": link["source"], "type": kind})
        if r["kind"] == "checkin_metadata" and r["place_reference"] is not None and (place := digest(r["place_reference"])) not in e.places:
            e.places.append(place)
        return len(e.media) + len(e.links) + len(e.places) > size

    def decide(self, r: dict, time_alone: bool, text_alone: bool) -> dict:
        """Decision on the next record in processing order."""
        if r["kind"] != self.kind:
            self.kind, self.occurrences = r["kind"], Counter()
            for e in self.taken.values():
                self.release(e)
            self.taken.clear()
        self.occurrences[r["fingerprint"]] += 1
        occurrence = self.occurrences[r["fingerprint"]]
        rule, rank, entity = self.match(r, occurrence, time_alone, text_alone)
        changed, status = False, "skipped"
        if rule == "M08":
            entity, changed, status = self.create(r, occurrence), True, "created"
            self.take(entity)
        elif entity is not None:
            self.take(entity)
            merged = self.update(entity, r)
            changed, status = bool(merged), "ambiguous" if merged is None else "matched"
        self.decided += 1
        return {"record_id": r["record_id"], "kind": r["kind"], "entity_id": entity.entity_id if entity else None, "rule": rule, "rank": rank, "match_status": status, "changed": changed, "sequence": self.decided - 1}


def normal(text: str) -> str:
    """Normal form of an entity's text."""
    import unicodedata

    return unicodedata.normalize("NFC", text.replace("\r\n", "\n").replace("\r", "\n"))


def resolve(records: list[dict], entities: list[Entity], profile: str, now: str) -> tuple[list[dict], list[Entity]]:
    """Decisions on the records of one block in processing order, and its entities afterwards."""
    order = {k: i for i, k in enumerate(KIND_ORDER)}
    records = sorted(records, key=lambda r: (order[r["kind"]], r["fingerprint"], r["raw_sha256"], r["relative_path"], r["record_index"], r["record_id"]))
    block = Block(profile, now)
    for e in entities:
        block.add(e)
    times = Counter(r["created_timestamp"] for r in records)
    texts = Counter((r["created_timestamp"], r["normalized_post_text"]) for r in records)
    decisions = [block.decide(r, times[r["created_timestamp"]] == 1, texts[r["created_timestamp"], r["normalized_post_text"]] == 1) for r in records]
    return decisions, block.entities


def resolve_blocks(records: DataFrame, entities: DataFrame, profile: str, now: str, max_block: int = MAX_BLOCK) -> tuple[DataFrame, DataFrame]:
    """Decisions and new entities of a run.

    ``records``: record_id and the normalized columns with kind, relative_path and record_index, parsed ones only;
    ``entities``: schema ``ENTITY``. Entities that no record touches come back as they are.
    """
    from pyspark.sql import types as T

    both = records.select(F.concat(F.lit("r"), "record_id").alias("record"), F.col("created_timestamp").alias("ts"), "external_id", F.col("normalized_direct_post_url").alias("url"), "fingerprint").unionByName(
        entities.select(F.concat(F.lit("e"), "entity_id").alias("record"), "ts", "external_id", F.col("normalized_url").alias("url"), "fingerprint")
    )
    both = cut(both)
    keys = {"ts": F.col("ts").cast("string"), "external_id": F.col("external_id"), "url": F.col("url"), "fingerprint": F.col("fingerprint")}
    edges = None
    for name, value in keys.items():
        part = both.where(value.isNotNull()).select("record", F.xxhash64(F.lit(name), value).alias("key"))
        edges = part if edges is None else edges.unionByName(part)
    blocks = cut(components(both.select("record", F.xxhash64("record").alias("order")), edges).select("record", F.col("label").alias("block")))
    # At most rows / max_block of them.
    large = [r.block for r in blocks.groupBy("block").count().where(F.col("count") > max_block).collect()]
    placed_records = records.withColumn("record", F.concat(F.lit("r"), "record_id")).join(blocks, "record").drop("record")
    of_entities = blocks.select("record", F.col("block").alias("at"))
    placed_entities = entities.withColumn("record", F.concat(F.lit("e"), "entity_id")).join(of_entities, "record").drop("record")
    entity_type = T._parse_datatype_string(ENTITY)
    decision_type = T._parse_datatype_string(DECISION)
    result = T.StructType([T.StructField("decisions", T.ArrayType(decision_type)), T.StructField("entities", T.ArrayType(entity_type))])
    names = [f.name for f in entity_type.fields]

    def as_record(row: dict) -> dict:
        r = {k: _plain(v) for k, v in row.items()}
        return r | {c: r[c] or [] for c in ("media_keys", "external_urls", "media_references", "links")}

    def as_entity(row: dict, prefix: str = "") -> Entity:
        e = {k: _plain(row[prefix + k]) for k in names}
        return Entity(**e | {c: list(e[c] or []) for c in ("media", "links", "places")})

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, block = None, None

        def ended() -> Iterator[pd.DataFrame]:
            after = block.entities if block else []
            for i in range(0, len(after), 1000):
                yield pd.DataFrame({"decisions": [[]], "entities": [[{n: getattr(e, n) for n in names} for e in after[i : i + 1000]]]})

        for batch in batches:
            decisions = []
            for row in batch.to_dict("records"):
                if row["block"] != at:
                    yield from ended()
                    at, block = row["block"], Block(profile, now)
                if row["_rank"] < 0:
                    block.add(as_entity(row, "_e_"))
                else:
                    decisions.append(block.decide(as_record(row), row["_times"] == 1, row["_texts"] == 1))
            yield pd.DataFrame({"decisions": [decisions], "entities": [[]]})
        yield from ended()

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Resolves blocks that fit in memory, one after the other; rows of a block follow each other."""
        at, left, right = None, [], []
        decisions: list[dict] = []
        after: list[dict] = []

        def ended() -> None:
            done, entities_ = resolve(left, right, profile, now)
            decisions.extend(done)
            after.extend({n: getattr(e, n) for n in names} for e in entities_)

        for batch in batches:
            for row in batch.to_dict("records"):
                if row["block"] != at:
                    if left or right:
                        ended()
                    at, left, right = row["block"], [], []
                if row["_rank"] < 0:
                    right.append(as_entity(row, "_e_"))
                else:
                    left.append(as_record(row))
            if len(decisions) + len(after) > 5000:
                yield pd.DataFrame({"decisions": [decisions], "entities": [after]})
                decisions, after = [], []
        if left or right:
            ended()
        yield pd.DataFrame({"decisions": [decisions], "entities": [after]})

    order = ["block", "_rank", "_e_entity_id", "fingerprint", "raw_sha256", "relative_path", "record_index", "record_id"]
    rows = placed_records.withColumn("_rank", kind_rank(F.col("kind"))).select("block", "_rank", *[c for c in READ if c in placed_records.columns])
    first = placed_entities.select(F.col("at").alias("block"), F.lit(-1).alias("_rank"), *[F.col(n).alias(f"_e_{n}") for n in names])

    def laid_out(some: DataFrame, known: DataFrame) -> DataFrame:
        return some.unionByName(known, allowMissingColumns=True).repartition("block").sortWithinPartitions(*order)

    if not large:
        done = cut(laid_out(rows, first).mapInPandas(gather, result))
    else:
        hot = F.broadcast(records.sparkSession.createDataFrame([(b,) for b in large], "block long"))
        gathered = laid_out(rows.join(hot, "block", "left_anti"), first.join(hot, "block", "left_anti")).mapInPandas(gather, result)
        # A time's records share their block, so the run's counts are the block's.
        times = records.groupBy(F.col("created_timestamp").alias("_ts")).agg(F.count("*").alias("_times"))
        texts = records.groupBy(F.col("created_timestamp").alias("_ts"), F.col("normalized_post_text").alias("_text")).agg(F.count("*").alias("_texts"))
        counted = rows.join(hot, "block", "left_semi")
        counted = counted.join(times, F.col("created_timestamp").eqNullSafe(F.col("_ts")), "left").drop("_ts")
        counted = counted.join(texts, F.col("created_timestamp").eqNullSafe(F.col("_ts")) & F.col("normalized_post_text").eqNullSafe(F.col("_text")), "left").drop("_ts", "_text")
        done = cut(gathered.unionByName(laid_out(counted, first.join(hot, "block", "left_semi")).mapInPandas(stream, result)))
    return done.select(F.inline("decisions")), done.select(F.inline("entities"))


def _plain(value):
    """Python values of what Arrow and pandas hand over; missing values are null."""
    if hasattr(value, "tolist") and not isinstance(value, str):
        value = value.tolist()
    if isinstance(value, list):
        return [_plain(v) for v in value]
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, float) and value != value or value is pd.NA or value is pd.NaT:
        return None
    return int(value) if isinstance(value, float) and value == int(value) else value
