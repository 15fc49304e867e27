"""Canonical forms and hashes of scalars: text, addresses, media references, JSON, fingerprints.

Built-in expressions wherever Spark has them; Arrow functions only for Unicode composition, full address parsing and
canonical JSON, each behind a built-in test that keeps plain values in the JVM.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import unicodedata
from decimal import Decimal
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

IDENTITY_VERSION = 1
#: Ports that an address of the scheme doesn't spell out (fixed values of the URL standard).
DEFAULT_PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21}
#: File extensions by kind of media (fixed values).
VIDEO_EXTENSIONS = ("mp4", "mov", "m4v", "avi", "webm")
PHOTO_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "webp", "heic", "heif")


@F.pandas_udf(T.StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def normal_text(text: Column) -> Column:
    """Line feeds for every kind of line end, composed characters; case and other white space stay. Null stays null.

    Only texts with characters beyond ASCII go through the Arrow function.
    """
    lines = F.regexp_replace(text, r"\r\n?", "\n")
    return F.when(lines.rlike(r"[^\x00-\x7F]"), _composed(F.when(lines.rlike(r"[^\x00-\x7F]"), lines))).otherwise(lines)


def media_reference(value: Column) -> Column:
    """Forward slashes, no leading ``./``, no doubled slashes; null where nothing is left."""
    slashes = F.regexp_replace(F.translate(value, "\\", "/"), r"^\./+", "")
    return F.nullif(F.regexp_replace(slashes, r"/{2,}", "/"), F.lit(""))


def media_match_key(value: Column) -> Column:
    """The form in which media references are compared."""
    return F.lower(value)


def media_kind(uri: Column) -> Column:
    """``video``, ``photo`` or ``unknown`` from the extension, query and fragment aside."""
    path = F.lower(F.regexp_extract(uri, r"^([^?#]*)", 1))
    return F.when(path.rlike(rf"\.({'|'.join(VIDEO_EXTENSIONS)})$"), "video").when(path.rlike(rf"\.({'|'.join(PHOTO_EXTENSIONS)})$"), "photo").otherwise("unknown")


def plain_url(url: Column) -> Column:
    """Normal form of an address that is plain: ASCII, with a scheme and host, no user, dot segments or unsafe characters.

    Scheme and host in lower case, default port and fragment dropped, ``/`` for an empty path. Null where the value is
    not such an address; :func:`normal_url` handles the rest.
    """
    parts = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([A-Za-z0-9.\-]+)(?::([0-9]+))?([^?#]*)(\?[^#]*)?(?:#.*)?$"
    scheme, host, port, path, query = (F.regexp_extract(url, parts, k) for k in range(1, 6))
    scheme = F.lower(scheme)
    default = F.lit(False)
    for name, number in DEFAULT_PORTS.items():
        default = default | ((scheme == name) & (port == str(number)))
    shown = F.when((port == "") | default, F.lit("")).otherwise(F.concat(F.lit(":"), port))
    special = scheme.isin(*DEFAULT_PORTS)
    is_plain = url.rlike(parts) & special & ~url.rlike(r"[\x00-\x20\x7F-\x{10FFFF}\"<>\\^`{|}']") & ~path.rlike(r"(?i)(^|/)(\.|%2e){1,2}(/|$)") & (path.rlike("^/") | (path == ""))
    is_plain = is_plain & ~host.rlike(r"(?i)^[0-9.]+$|(^|\.)xn--|\.[0-9]+$|(^|\.)0x[0-9a-f]*$|^\.|\.\.") & (F.length(port) <= 4) & ~port.rlike("^0")
    return F.when(is_plain, F.concat(scheme, F.lit("://"), F.lower(host), shown, F.when(path == "", F.lit("/")).otherwise(path), query))


_SCHEME = re.compile(r"^([A-Za-z][A-Za-z0-9+.\-]*):")
_PATH_SAFE = "/:@!$&'()*+,;=~-._%[]|^\\"


def parse_url(value: str | None) -> str | None:
    """Normal form of an absolute address after the rules of the URL standard, or null.

    Covers schemes of the web: surrounding controls and inner tabs and line ends dropped, backslashes read as slashes,
    scheme and host in lower case, IDNA hosts, default ports and fragments dropped, dot segments resolved, unsafe bytes
    percent-encoded. Other schemes need ``//`` and a host.
    """
    if value is None:
        return None
    text = re.sub(r"[\t\n\r]", "", value.strip("".join(map(chr, range(0x21)))))
    m = _SCHEME.match(text)
    if not m:
        return None
    scheme, rest = m[1].lower(), text[m.end() :].split("#", 1)[0]
    special = scheme in DEFAULT_PORTS
    if special:
        rest, q, query = rest.partition("?")
        rest = re.sub(r"^/*", "", rest.replace("\\", "/"))
    else:
        if not rest.startswith("//"):
            return None
        rest, q, query = rest[2:].partition("?")
    authority, slash, path = rest.partition("/")
    user, at, hostport = authority.rpartition("@")
    h = re.fullmatch(r"(\[[0-9A-Fa-f:.]+\]|[^:\[\]]*)(?::(\d*))?", hostport)
    if not h or not h[1]:
        return None
    host, port = h[1], h[2] or ""
    try:
        host = re.sub(r"%([0-9A-Fa-f]{2})", lambda x: chr(int(x[1], 16)), host) if special else host
        if not host.isascii():
            host = host.encode("idna").decode("ascii")
    except (UnicodeError, ValueError):
        return None
    host = host.lower()
    if special and re.search(r"[\x00-\x20\"#%/:<>?@\\^`{|}\x7f]", host.strip("[]").replace(":", "") if host.startswith("[") else host):
        return None
    if port:
        if int(port) > 65535:
            return None
        port = "" if DEFAULT_PORTS.get(scheme) == int(port) else f":{int(port)}"
    segments: list[str] = []
    steps = path.split("/")
    for k, step in enumerate(steps):
        plain = step.lower().replace("%2e", ".")
        if plain == "..":
            if segments:
                segments.pop()
            if k == len(steps) - 1:
                segments.append("")
        elif plain == ".":
            if k == len(steps) - 1:
                segments.append("")
        else:
            segments.append(quote(step, safe=_PATH_SAFE))
    shown = "/" + "/".join(segments) if slash or special else ""
    login = f"{quote(user, safe='%:!$&()*+,;=~-._')}@" if at and user else ""
    asked = "?" + quote(query, safe="/:@!$&()*+,;=~-._%?[]|^\\`{}" + ("" if special else "'")) if q else ""
    return f"{scheme}://{login}{host}{port}{shown}{asked}"


@F.pandas_udf(T.StringType())
def _parsed(urls: pd.Series) -> pd.Series:
    return urls.map(parse_url)


def normal_url(url: Column) -> Column:
    """Normal form of any absolute address; null where there is none. Plain addresses stay in the JVM."""
    plain = plain_url(url)
    return F.coalesce(plain, _parsed(F.when(plain.isNull() & url.rlike(r"^[\x00-\x20]*[A-Za-z][A-Za-z0-9+.\-]*:"), url)))


def sorted_distinct(values: Column) -> Column:
    """Distinct elements in order of their bytes."""
    return F.array_sort(F.array_distinct(values))


def iso_utc(seconds: Column) -> Column:
    """ISO time of Unix seconds, in UTC with milliseconds (session time zone UTC)."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _number(value: float | int | Decimal) -> str:
    """A number as a double in the shortest notation of ECMAScript."""
    if isinstance(value, int) and abs(value) <= 2**53:
        return str(value)
    x = float(value)
    if not math.isfinite(x):
        raise ValueError("canonical JSON has no such number")
    if x == 0:
        return "0"
    mantissa, _, e = repr(abs(x)).partition("e")
    whole, _, frac = mantissa.partition(".")
    frac = "" if frac == "0" else frac
    point = len(whole) + int(e or 0)
    figures = (whole + frac).lstrip("0")
    point -= len(whole + frac) - len((whole + frac).lstrip("0"))
    figures = figures.rstrip("0") or "0"
    k, sign = len(figures), "-" if x < 0 else ""
    if k <= point <= 21:
        return sign + figures + "0" * (point - k)
    if 0 < point <= 21:
        return f"{sign}{figures[:point]}.{figures[point:]}"
    if -6 < point <= 0:
        return f"{sign}0.{'0' * -point}{figures}"
    tail = f"e{'+' if point > 0 else '-'}{abs(point - 1)}"
    return sign + figures[0] + (f".{figures[1:]}" if k > 1 else "") + tail


def _utf16(text: str) -> bytes:
    return text.encode("utf-16-be", "surrogatepass")


def canonical_json(value) -> str:
    """JSON without white space, keys in order of their UTF-16 units, numbers as ECMAScript writes them."""
    if value is None or isinstance(value, (bool, str)):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, (int, float, Decimal)):
        return _number(value)
    if isinstance(value, list):
        return f"[{','.join(map(canonical_json, value))}]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical_json(value[k])}" for k in sorted(value, key=_utf16)) + "}"
    raise TypeError(f"canonical JSON has no {type(value).__name__}")


def digest(text: str) -> str:
    """SHA-256 of UTF-8, in hexadecimal."""
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def fingerprint(created: int, text: str | None, media_keys: list[str], urls: list[str], place: str | None) -> str:
    """Semantic fingerprint of a record: hash of canonical JSON of its six identifying values."""
    return digest(
        canonical_json(
            {
                "created_timestamp": created,
                "identity_version": IDENTITY_VERSION,
                "normalized_place_reference_when_available": place,
                "normalized_post_text": text,
                "sorted_normalized_external_urls": urls,
                "sorted_normalized_media_references": media_keys,
            }
        )
    )


def json_string(text: Column) -> Column:
    """A string as JSON writes it, quotation marks included; ``null`` for null."""
    return F.coalesce(F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1), F.lit("null"))


def fingerprint_column(created: Column, text: Column, media_keys: Column, urls: Column, place: Column) -> Column:
    """:func:`fingerprint` in the JVM, for values without control characters beyond tab and line ends."""

    def listed(values: Column) -> Column:
        return F.to_json(F.coalesce(values, F.array().cast("array<string>")))

    def text_or_null(value: Column) -> Column:
        return F.when(value.isNull(), F.lit("null")).otherwise(json_string(value))

    return F.sha2(
        F.concat(
            F.lit('{"created_timestamp":'), created.cast("string"), F.lit(f',"identity_version":{IDENTITY_VERSION},"normalized_place_reference_when_available":'), text_or_null(place),
            F.lit(',"normalized_post_text":'), text_or_null(text), F.lit(',"sorted_normalized_external_urls":'), listed(urls), F.lit(',"sorted_normalized_media_references":'), listed(media_keys), F.lit("}"),
        ),
        256,
    )


def post_type(kinds: Column, has_link: Column, has_place: Column, has_text: Column) -> Column:
    """Type of a record from its media kinds, links, place and text."""
    n = F.size(F.array_distinct(kinds))
    return (
        F.when((n > 0) & (has_link | (n > 1) | F.array_contains(kinds, "unknown")), "mixed")
        .when(n > 0, F.when(F.array_contains(kinds, "video"), "video").otherwise("photo"))
        .when(has_link, "link")
        .when(has_place, "check_in")
        .when(has_text, "text")
        .otherwise("unknown")
    )


def whole_id(value: Column) -> Column:
    """An external id where it is one: digits only, at least 12, not all alike; else null."""
    return F.when(value.rlike(r"^[0-9]{12,}$") & ~value.rlike(r"^([0-9])\1*$"), value)
