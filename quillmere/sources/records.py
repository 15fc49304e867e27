"""Records of source files: reading, shape checks and normalization of the nine source kinds to one row type."""

from __future__ import annotations

import codecs
import io
import json
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from quillmere.functions.canonical import PHOTO_EXTENSIONS, VIDEO_EXTENSIONS, canonical_json, digest, fingerprint, parse_url
from quillmere.sources.discovery import Collection, as_rows, by_file

SAFE = 2**53 - 1
#: Keys under which an object wraps its records (fixed values).
WRAPPERS = {"reel": "lasso_videos_v2", "video_metadata": "videos_v2", "photo_metadata": "other_photos_v2"}
ENRICHMENT = frozenset({"video_metadata", "photo_metadata", "album_metadata", "checkin_metadata", "sharing_link_metadata"})
MEDIA_KINDS = frozenset({"video_metadata", "photo_metadata", "album_metadata"})

NORMALIZED = (
    "external_id string, direct_post_url string, normalized_direct_post_url string, created_timestamp long, post_type string, post_text string, normalized_post_text string, "
    "media_references array<string>, media_details array<struct<reference:string,media_type:string,created:long,metadata:string>>, media_keys array<string>, "
    "links array<struct<original:string,normalized:string,source:string>>, external_urls array<string>, place_reference string, place_name string, "
    "source_name string, source_url string, raw_sha256 string, fingerprint string"
)
RECORDS = f"relative_path string, root_number int, kind string, record_index long, parse_status string, error_code string, raw_json string, {NORMALIZED}"


class RecordError(ValueError):
    """A record that can't be normalized."""


class FileError(ValueError):
    """A file that can't be read; ``code`` tells why."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


def _is_time(value) -> bool:
    """A whole number within the safe range that isn't negative; booleans and strings aren't numbers."""
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return False
    return value == int(value) and 0 <= value <= SAFE if value == value and abs(value) != float("inf") else False


def _objects(value) -> list[dict]:
    return [x for x in value if isinstance(x, dict)] if isinstance(value, list) else []


def _text(value) -> str | None:
    return value if isinstance(value, str) else None


def _attached(record: dict) -> list[dict]:
    """Items of the attachments at any depth, each before what it holds."""
    items, stack = [], [iter(_objects(record.get("attachments")))]
    while stack:
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
        elif "\0item" in step:
            items.append(step["\0item"])
            stack.append(iter(_objects(step["\0item"].get("attachments"))))
        else:
            stack.append(iter([{"\0item": x} for x in _objects(step.get("data"))]))
    return items


def media_kind(media: dict) -> str:
    """``video``, ``photo`` or ``unknown``: from the metadata, else from the extension."""
    meta = media.get("media_metadata")
    for kind in ("video", "photo"):
        if isinstance(meta, dict) and isinstance(meta.get(f"{kind}_metadata"), dict):
            return kind
    uri = _text(media.get("uri")) or ""
    path = uri.split("?", 1)[0].split("#", 1)[0].lower()
    extension = path.rpartition(".")[2] if "." in path else ""
    return "video" if extension in VIDEO_EXTENSIONS else "photo" if extension in PHOTO_EXTENSIONS else "unknown"


def media_reference(value: str) -> str | None:
    """Slashes one way and single, no leading ``./``; null where nothing is left."""
    value = value.replace("\\", "/")
    if value.startswith("./"):
        value = value[1:].lstrip("/")
    while "//" in value:
        value = value.replace("//", "/")
    return value or None


def _type_of(kind: str, kinds: set[str], link: bool, place: bool, text: bool) -> str:
    if kind == "reel":
        return "reel"
    if kinds:
        return "mixed" if link or len(kinds) > 1 or "unknown" in kinds else kinds.pop()
    return "link" if link else "check_in" if place else "text" if text else "unknown"


def _ordered(values) -> list[str]:
    return sorted(set(values), key=lambda s: s.encode("utf-16-be", "surrogatepass"))


def normalize_activity(value, kind: str = "timeline") -> dict:
    """A timeline or reel record, or any record brought to that shape."""
    import unicodedata

    if not isinstance(value, dict) or not _is_time(value.get("timestamp")):
        raise RecordError("no object with a valid timestamp")
    created = int(value["timestamp"])
    direct = _text(value.get("post_url")) if isinstance(value.get("post_url"), str) else _text(value.get("url"))
    normal_direct = parse_url(direct)
    text = next((d["post"] for d in _objects(value.get("data")) if isinstance(d.get("post"), str)), None)
    normal = None if text is None else unicodedata.normalize("NFC", text.replace("\r\n", "\n").replace("\r", "\n"))
    kinds: set[str] = set()
    references, details, links, places, names = [], [], [], [], []
    for item in _attached(value):
        media, context, place = item.get("media"), item.get("external_context"), item.get("place")
        if isinstance(media, dict):
            kinds.add(media_kind(media))
            reference = media_reference(media["uri"]) if isinstance(media.get("uri"), str) else None
            if reference is not None:
                made = media.get("creation_timestamp")
                whole = isinstance(made, (int, float)) and not isinstance(made, bool) and made == made and abs(made) <= SAFE and made == int(made)
                references.append(reference)
                details.append((reference, media_kind(media), int(made) if whole else None, canonical_json(media)))
        if isinstance(context, dict) and (url := parse_url(_text(context.get("url")))) is not None:
            source = _text(context.get("source"))
            links.append((context["url"], url, _text(context.get("name")) if source is None else source))
        if isinstance(place, dict):
            places.append(canonical_json(place))
            names.append(_text(place.get("name")) if isinstance(place.get("name"), str) else _text(place.get("location")))
    stored, unique_places = _ordered(references), _ordered(places)
    keys, urls = _ordered(r.lower() for r in stored), _ordered(u for _, u, _ in links)
    reference = None if not unique_places else unique_places[0] if len(unique_places) == 1 else canonical_json(unique_places)
    return {
        "external_id": value["fbid"] if isinstance(value.get("fbid"), str) and value["fbid"] else None,
        "direct_post_url": None if normal_direct is None else direct,
        "normalized_direct_post_url": normal_direct,
        "created_timestamp": created,
        "post_type": _type_of(kind, kinds, bool(links), bool(places), text is not None),
        "post_text": text,
        "normalized_post_text": normal,
        "media_references": stored,
        "media_details": details,
        "media_keys": keys,
        "links": links,
        "external_urls": urls,
        "place_reference": reference,
        "place_name": names[0] if names else None,
        "source_name": next((s for _, _, s in links if s is not None), None),
        "source_url": links[0][0] if links else None,
        "raw_sha256": digest(canonical_json(value)),
        "fingerprint": fingerprint(created, normal, keys, urls, reference),
    }


def _labelled(value: dict, label: str) -> dict:
    return next((x for x in _objects(value.get("label_values")) if x.get("label") == label), {})


def _address(entry: dict) -> str | None:
    return entry["href"] if isinstance(entry.get("href"), str) else _text(entry.get("value"))


def _identified(value, labels: bool = False) -> dict:
    if not isinstance(value, dict) or not _is_time(value.get("timestamp")) or not isinstance(value.get("fbid"), str) or not value["fbid"]:
        raise RecordError("no object with timestamp and id")
    if labels and not isinstance(value.get("label_values"), list):
        raise RecordError("no labels")
    return value


def _shaped(value: dict, items: list[dict] | None, text: str | None, url: str | None) -> dict:
    """A record in timeline shape."""
    out = {"timestamp": value["timestamp"], "fbid": value["fbid"]}
    if url is not None:
        out["post_url"] = url
    if text is not None:
        out["data"] = [{"post": text}]
    if items is not None:
        out["attachments"] = [{"data": items}]
    return out


def _media_below(value) -> list[dict]:
    """Objects with a string ``uri`` at any depth, each before what it holds."""
    found, stack = [], [value]
    while stack:
        v = stack.pop()
        if isinstance(v, dict):
            if isinstance(v.get("uri"), str):
                found.append(v)
            stack += reversed(v.values())
        elif isinstance(v, list):
            stack += reversed(v)
    return found


def normalize_state(value) -> dict:
    """An archive or trash record; its raw hash is that of the record as it came."""
    value = _identified(value)
    media = _media_below(value.get("label_values"))
    shaped = _shaped(value, [{"media": m} for m in media] if media else None, _text(_labelled(value, "Message").get("value")), _address(_labelled(value, "URL")))
    return normalize_activity(shaped) | {"raw_sha256": digest(canonical_json(value))}


def normalize_checkin(value) -> dict:
    """A check-in; it always has a place."""
    value = _identified(value)
    where, tags = _text(_labelled(value, "Location").get("value")), _labelled(value, "Place tags").get("dict")
    place = {"name": where, "location": where, "place_tags": tags if isinstance(tags, list) else []}
    items = [{"place": place}] + [{"media": m} for m in _objects(_labelled(value, "Photos").get("media"))]
    return normalize_activity(_shaped(value, items, _text(_labelled(value, "Message").get("value")), _address(_labelled(value, "URL"))))


def normalize_media(value) -> dict:
    """A video, photo or album record: the whole object is the media."""
    if not isinstance(value, dict) or not isinstance(value.get("uri"), str) or not _is_time(value.get("creation_timestamp")):
        raise RecordError("no object with uri and creation time")
    shaped = {"timestamp": value["creation_timestamp"], "attachments": [{"data": [{"media": value}]}]}
    if isinstance(value.get("description"), str):
        shaped["data"] = [{"post": value["description"]}]
    return normalize_activity(shaped)


def normalize_sharing_link(value) -> dict:
    """A sharing link: its address is an external link, never the direct one."""
    value = _identified(value, labels=True)
    url = _address(_labelled(value, "URL"))
    if url is None:
        raise RecordError("no labelled address")
    return normalize_activity(_shaped(value, [{"external_context": {"url": url}}], None, None))


NORMALIZERS = {
    "timeline": normalize_activity,
    "reel": lambda v: normalize_activity(v, "reel"),
    "archive": normalize_state,
    "trash": normalize_state,
    "video_metadata": normalize_media,
    "photo_metadata": normalize_media,
    "album_metadata": normalize_media,
    "checkin_metadata": normalize_checkin,
    "sharing_link_metadata": normalize_sharing_link,
}


#: Bytes that are read at a time.
CHUNK = 1 << 20
_SPACE = " \t\n\r"


class Characters:
    """The text of a byte stream, of which only what was not yet consumed is held."""

    def __init__(self, stream: BinaryIO, chunk: int = CHUNK):
        self._stream, self._chunk, self._decoder = stream, chunk, codecs.getincrementaldecoder("utf-8-sig")()
        self.text, self.at, self.ended = "", 0, False

    def more(self) -> bool:
        """Reads on, as much as is held at least; false at the end."""
        if self.ended:
            return False
        self.text, self.at = self.text[self.at :], 0
        read = self._stream.read(max(self._chunk, len(self.text)))
        self.ended = not read
        self.text += self._decoder.decode(read, self.ended)
        return True

    def peek(self) -> str:
        """The next character that isn't white space; empty at the end."""
        while True:
            while self.at < len(self.text):
                if self.text[self.at] not in _SPACE:
                    return self.text[self.at]
                self.at += 1
            if not self.more():
                return ""

    def rest(self) -> str:
        while self.more():
            pass
        return self.text[self.at :]

    def value(self, decoder: json.JSONDecoder):
        """The next JSON value. It is complete only if something follows it, as numbers have no end of their own."""
        self.peek()
        while True:
            try:
                value, end = decoder.raw_decode(self.text, self.at)
                if end < len(self.text) or self.ended:
                    self.at = end
                    return value
            except ValueError:
                if self.ended:
                    raise
            self.more()


def elements(characters: Characters | str) -> Iterator:
    """Elements of a root-level array, one at a time; a ValueError where the text is no valid array."""
    if isinstance(characters, str):
        characters = Characters(io.BytesIO(characters.encode("utf-8", "surrogatepass")))
    decoder = json.JSONDecoder()
    characters.peek()
    characters.at += 1
    if characters.peek() == "]":
        characters.at += 1
    else:
        while True:
            yield characters.value(decoder)
            after = characters.peek()
            characters.at += 1
            if after == "]":
                break
            if after != ",":
                raise ValueError("no comma between elements")
    if characters.peek():
        raise ValueError("text after the array")


def file_records(content: bytes | BinaryIO, kind: str, relative_path: str, chunk: int = CHUNK) -> Iterator:
    """The records of a file; a FileError for a file of another shape (RECORD_UNSUPPORTED) or that is no JSON (JSON_INVALID).

    A root-level array is read as a stream, of which one record and a chunk are held; objects that wrap records are read whole.
    """
    try:
        characters = Characters(io.BytesIO(content) if isinstance(content, bytes) else content, chunk)
        first = characters.peek()
        if first == "{" and kind in WRAPPERS | {"album_metadata": "", "trash": ""}:
            root = json.loads(characters.rest())
            if kind == "trash":
                yield root
                return
            records = root.get(WRAPPERS.get(kind, "photos"))
            if not isinstance(records, list):
                raise FileError("RECORD_UNSUPPORTED")
            if kind == "album_metadata":
                cover = root.get("cover_photo")
                cover = _text(cover.get("uri")) if isinstance(cover, dict) else None
                modified = root.get("last_modified_timestamp")
                for i, r in enumerate(records):
                    context = {
                        "source_relative_path": relative_path, "ordinal": i, "name": _text(root.get("name")), "description": _text(root.get("description")),
                        "last_modified_timestamp": int(modified) if _is_time(modified) else None, "is_cover": cover is not None and isinstance(r, dict) and r.get("uri") == cover,
                    }
                    yield r | {"source_album": context} if isinstance(r, dict) else r
                return
            yield from records
            return
        if first != "[":
            raise FileError("RECORD_UNSUPPORTED" if first else "JSON_INVALID")
        yield from elements(characters)
    except FileError:
        raise
    except (ValueError, RecursionError) as e:
        raise FileError("JSON_INVALID") from e


def _rows(content: bytes | BinaryIO, kind: str, relative_path: str, root_number: int) -> Iterator[dict]:
    base = {"relative_path": relative_path, "root_number": root_number, "kind": kind}
    index = -1
    try:
        for index, value in enumerate(file_records(content, kind, relative_path)):
            row = base | {"record_index": index, "raw_json": json.dumps(value, ensure_ascii=False, separators=(",", ":"))}
            try:
                yield row | {"parse_status": "parsed"} | NORMALIZERS[kind](value)
            except (RecordError, TypeError, ValueError):
                shape = isinstance(value, dict)
                yield row | {"parse_status": "partial" if shape else "unsupported", "error_code": "RECORD_PARTIAL" if shape else "RECORD_UNSUPPORTED"}
    except FileError as e:
        yield base | {"record_index": None, "parse_status": "failed", "error_code": e.code}


def read_records(spark: SparkSession, collection: Collection) -> DataFrame:
    """All records of a collection, one row each (schema ``RECORDS``), failures included.

    Files are read in parallel where their paths lie, on a file system that all executors share as discovery's does: one
    file to a task, as a stream, so that a file's size is bounded by neither memory nor the 2 GB of a cell. A failed file
    leaves one row without index. Dead letters keep their location, the report never shows their content.
    """
    columns = [c.split(" ")[0] for c in RECORDS.replace("struct<reference:string,media_type:string,created:long,metadata:string>", "s").replace("struct<original:string,normalized:string,source:string>", "s").split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, kind, relative, root in zip(batch["path"], batch["kind"], batch["relative_path"], batch["root_number"]):
                rows: list[dict] = []
                with open(path, "rb") as stream:
                    for row in _rows(stream, kind, relative, int(root)):
                        rows.append(row)
                        if len(rows) == 5000:
                            yield _frame(rows, columns)
                            rows = []
                if rows:
                    yield _frame(rows, columns)

    return by_file(spark, pd.DataFrame(as_rows(collection))[["path", "kind", "relative_path", "root_number"]]).mapInPandas(parse, RECORDS)


def _frame(rows: list[dict], columns: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame([[r.get(c) for c in columns] for r in rows], columns=columns, dtype=object)
    for c in ("record_index", "created_timestamp"):
        frame[c] = pd.array(frame[c], dtype="Int64")
    frame["root_number"] = frame["root_number"].astype("int32")
    names = {"media_details": ("reference", "media_type", "created", "metadata"), "links": ("original", "normalized", "source")}
    for c, keys in names.items():
        frame[c] = [None if v is None else [dict(zip(keys, x)) for x in v] for v in frame[c]]
    return frame
