"""What image files say about themselves: orientation, capture data and place names, read from their bytes.

A bounded reader walks JPEG, PNG, WebP and HEIF carriers to their TIFF, XMP and IPTC blocks. Damaged files give
what could be read up to the damage; nothing is raised.
"""

from __future__ import annotations

import html
import re
import struct
import zlib

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from winnowlane.functions.capture import FIRST_YEAR, LAST_YEAR

# TIFF tags by the names used here, IPTC datasets, XMP properties.
TAGS = {0x010F: "make", 0x0110: "model", 0x0112: "orientation", 0x0132: "time3", 0x8769: "exif", 0x8825: "gps"}
EXIF_TAGS = {0x829A: "exposure", 0x829D: "f", 0x8827: "iso", 0x9003: "time1", 0x9004: "time2", 0x9010: "tz3", 0x9011: "tz1", 0x9012: "tz2", 0x920A: "fl", 0xA405: "fl35", 0xA433: "lens_make", 0xA434: "lens"}
GPS_TAGS = {1: "lat_ref", 2: "lat", 3: "lon_ref", 4: "lon"}
IPTC = {90: "city", 92: "sublocation", 95: "state", 101: "country"}
XMP = {"city": ("photoshop:City",), "state": ("photoshop:State",), "country": ("photoshop:Country",), "sublocation": ("Iptc4xmpCore:Location",)}
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
MOST_XMP, MOST_ENTRIES, MOST_TEXT = 256 * 1024, 512, 96

FIELDS = {"orientation": "int", "make": "string", "model": "string", "taken": "string", "taken_from": "string", "tz": "string", "fl": "double", "fl35": "double", "f": "double", "exposure": "double", "iso": "double", "lens_make": "string", "lens": "string", "lat": "double", "lon": "double", "city": "string", "state": "string", "country": "string", "sublocation": "string"}
_TYPES = {"int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType()}
SCHEMA = T.StructType([T.StructField(k, _TYPES[t]) for k, t in {"format": "string", **FIELDS, "err": "string"}.items()])
# EXIF orientation 1 to 8 as quarter turns clockwise and a mirror before them.
TURNS = {1: (0, False), 2: (0, True), 3: (2, False), 4: (2, True), 5: (3, True), 6: (1, False), 7: (1, True), 8: (3, False)}


def clean(s: str | None) -> str | None:
    if not isinstance(s, str):  # damaged files give text fields numbers
        return None
    return re.sub(r"\s+", " ", re.sub("[\x00-\x1f\x7f\ufffd]", "", s)).strip()[:MOST_TEXT] or None


def iso_time(raw: str | None) -> str | None:
    m = re.match(r"(\d{4})[:\-](\d\d)[:\-](\d\d)[ T](\d\d):(\d\d):(\d\d)", raw if isinstance(raw, str) else "")
    if not m:
        return None
    y, mo, d, h, mi, s = map(int, m.groups())
    return "{}-{}-{}T{}:{}:{}".format(*m.groups()) if FIRST_YEAR <= y <= LAST_YEAR and 1 <= mo <= 12 and 1 <= d <= 31 and h <= 23 and mi <= 59 and s <= 60 else None


class Tiff:
    """A TIFF block; reads out of bounds give nothing."""

    def __init__(self, data: bytes):
        self.data = data
        self.order = {b"II": "<", b"MM": ">"}.get(data[:2])

    def number(self, kind: str, at: int):
        size = struct.calcsize(kind)
        return struct.unpack_from(self.order + kind, self.data, at)[0] if 0 <= at <= len(self.data) - size else None

    def value(self, at: int):
        kind, count = self.number("H", at + 2), self.number("I", at + 4)
        size = SIZES.get(kind)
        if size is None or count is None or not 0 < count <= 65536:
            return None
        place = at + 8 if size * count <= 4 else self.number("I", at + 8)
        if place is None or place + size * count > len(self.data):
            return None
        if kind in (1, 2, 7):
            return self.data[place : place + count].split(b"\0")[0].decode("utf-8", "replace")
        if kind in (5, 10):
            pairs = [(self.number("Ii"[kind == 10], place + 8 * i), self.number("Ii"[kind == 10], place + 8 * i + 4)) for i in range(count)]
            return [a / b if a is not None and b else None for a, b in pairs]
        return [self.number({3: "H", 4: "I", 9: "i"}[kind], place + size * i) for i in range(count)]

    def folder(self, at: int | None, names: dict[int, str]) -> dict:
        out: dict = {}
        n = self.number("H", at) if at else None
        for i in range(min(n or 0, MOST_ENTRIES)):
            tag = self.number("H", at + 2 + 12 * i)
            if tag is None:
                break
            if tag in names:
                v = self.value(at + 2 + 12 * i)
                if v is not None:
                    out[names[tag]] = v
        return out


def _first(v):
    return v[0] if isinstance(v, list) and v else None if isinstance(v, list) else v


def _degrees(v, ref, negative: str, most: float) -> float | None:
    if not isinstance(v, list) or len(v) < 2 or None in v[:2]:
        return None
    x = v[0] + v[1] / 60 + ((v[2] or 0) / 3600 if len(v) > 2 else 0)
    x = -x if str(ref or "").upper().startswith(negative) else x
    return x if abs(x) <= most else None


def read_tiff(data: bytes, out: dict) -> None:
    t = Tiff(data)
    if t.order is None or t.number("H", 2) != 42:
        return
    top = t.folder(t.number("I", 4), TAGS)
    sub = t.folder(_first(top.get("exif")), EXIF_TAGS)
    gps = t.folder(_first(top.get("gps")), GPS_TAGS)
    for k in ("make", "model"):
        out.setdefault(k, clean(top.get(k)))
    for k in ("lens", "lens_make"):
        out.setdefault(k, clean(sub.get(k)))
    turn = _first(top.get("orientation"))
    if turn in TURNS:
        out.setdefault("orientation", turn)
    for source, key in (("original", "time1"), ("digitized", "time2"), ("file", "time3")):
        if when := iso_time(top.get(key) or sub.get(key)):
            out.setdefault("taken", when)
            out.setdefault("taken_from", source)
            zone = sub.get({"time1": "tz1", "time2": "tz2", "time3": "tz3"}[key])
            out.setdefault("tz", clean(zone) if isinstance(zone, str) and re.match(r"[+-]\d\d:\d\d", zone) else None)
            break
    for k, most in (("fl", 10000), ("fl35", 10000), ("f", 256), ("exposure", 86400), ("iso", 10_000_000)):
        x = _first(sub.get(k))
        if isinstance(x, (int, float)) and 0 < x <= most:
            out.setdefault(k, float(x))
    lat, lon = _degrees(gps.get("lat"), gps.get("lat_ref"), "S", 90), _degrees(gps.get("lon"), gps.get("lon_ref"), "W", 180)
    if lat is not None and lon is not None and (lat, lon) != (0, 0):
        out.setdefault("lat", lat)
        out.setdefault("lon", lon)


def read_xmp(data: bytes, out: dict) -> None:
    """Place names as attributes or elements; the first that is not empty holds."""
    text = data[:MOST_XMP].decode("utf-8", "replace")
    for k, names in XMP.items():
        for n in names:
            m = re.search(rf"""\b{n}\s*=\s*(?:"([^"]*)"|'([^']*)')""", text) or re.search(rf"<{n}\b[^>]*>([^<]*)</{n}>", text)
            if m and (v := clean(html.unescape(next(g for g in m.groups() if g is not None)))) and not out.get(k):
                out[k] = v


def read_iptc(data: bytes, out: dict) -> None:
    """Place names from record 2 of an information block; UTF-8, else windows-1252."""
    at = 0
    while at + 5 <= len(data) and data[at] == 0x1C:
        record, dataset, size = data[at + 1], data[at + 2], int.from_bytes(data[at + 3 : at + 5], "big")
        raw = data[at + 5 : at + 5 + size]
        if record == 2 and dataset in IPTC and not out.get(IPTC[dataset]):
            try:
                text = raw.decode("utf-8")
            except UnicodeDecodeError:
                text = raw.decode("cp1252", "replace")
            if v := clean(text):
                out[IPTC[dataset]] = v
        at += 5 + size


def _resources(data: bytes, out: dict) -> None:
    """Photoshop resources; number 0x0404 is the information block."""
    at = 0
    while at + 12 <= len(data) and data[at : at + 4] == b"8BIM":
        kind = int.from_bytes(data[at + 4 : at + 6], "big")
        name = data[at + 6] + 1
        at += 6 + name + name % 2
        size = int.from_bytes(data[at : at + 4], "big")
        if kind == 0x0404:
            read_iptc(data[at + 4 : at + 4 + size], out)
        at += 4 + size + size % 2


def _jpeg(data: bytes):
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if marker in (0xD9, 0xDA) or size < 2:
            return
        body = data[at + 4 : at + 2 + size]
        if marker == 0xE1 and body.startswith(b"Exif\0\0"):
            yield "tiff", body[6:]
        elif marker == 0xE1 and body.startswith(b"http://ns.adobe.com/xap/1.0/\0"):
            yield "xmp", body[29:]
        elif marker == 0xED and body.startswith(b"Photoshop 3.0\0"):
            yield "iptc", body[14:]
        at += 2 + size


def _png(data: bytes):
    at = 8
    while at + 8 <= len(data):
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if kind == b"eXIf":
            yield "tiff", body
        elif kind == b"iTXt" and body.startswith(b"XML:com.adobe.xmp\0") and len(body) > 20:
            packed, rest = body[18], body[20:].split(b"\0", 2)[-1]
            try:
                yield "xmp", zlib.decompressobj().decompress(rest, MOST_XMP) if packed else rest
            except zlib.error:
                pass
        elif kind == b"IEND":
            return
        at += 12 + size


def _webp(data: bytes):
    at = 12
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        body = data[at + 8 : at + 8 + size]
        if kind == b"EXIF":
            yield "tiff", body[6:] if body.startswith(b"Exif\0\0") else body
        elif kind == b"XMP ":
            yield "xmp", body
        at += 8 + size + size % 2


def _boxes(data: bytes, at: int, end: int):
    for _ in range(MOST_ENTRIES):
        if at + 8 > end:
            return
        size, kind, head = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8], 8
        if size == 1:
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        size = size or end - at
        if size < head or at + size > end:
            return
        yield kind, at + head, at + size
        at += size


def _heif(data: bytes):
    """Exif and XMP items, found by their types and their extents in the file."""
    for kind, a, b in _boxes(data, 0, len(data)):
        if kind != b"meta":
            continue
        inner = {k: (x, y) for k, x, y in _boxes(data, a + 4, b)}
        types: dict[int, bytes] = {}
        if b"iinf" in inner:
            x, y = inner[b"iinf"]
            for k, p, q in _boxes(data, x + (6 if data[x] == 0 else 8), y):
                if k == b"infe" and q - p >= 12 and data[p] >= 2:
                    wide = 2 if data[p] == 2 else 4
                    types[int.from_bytes(data[p + 4 : p + 4 + wide], "big")] = data[p + 6 + wide : p + 10 + wide]
        if b"iloc" in inner:
            x, y = inner[b"iloc"]
            version, sizes = data[x], int.from_bytes(data[x + 4 : x + 6], "big")
            widths = [sizes >> 12 & 15, sizes >> 8 & 15, sizes >> 4 & 15, sizes & 15 if version else 0]
            take = 4 if version == 2 else 2
            at, n = x + 6 + take, int.from_bytes(data[x + 6 : x + 6 + take], "big")

            def number(width: int) -> int:
                nonlocal at
                at += width
                return int.from_bytes(data[at - width : at], "big")

            for _ in range(min(n, MOST_ENTRIES)):
                if at >= y:
                    return
                item = number(take)
                # bytes that lie elsewhere than in the file itself are not looked for
                own = not version or number(2) & 15 == 0
                number(2)
                base, extents = number(widths[2]), number(2)
                for e in range(min(extents, MOST_ENTRIES)):
                    number(widths[3])
                    place, size = base + number(widths[0]), number(widths[1])
                    body = data[place : place + size]
                    if not own:
                        continue
                    if e == 0 and types.get(item) == b"Exif" and len(body) > 8:
                        yield "tiff", body[4 + int.from_bytes(body[:4], "big") :]
                    elif e == 0 and types.get(item) == b"mime":
                        yield "xmp", body
        turns = [(k, data[p]) for k, p, q in _boxes(data, *(inner.get(b"iprp") or (0, 0))) if k == b"ipco" for k, p, q in _boxes(data, p, q) if k in (b"irot", b"imir") and q > p]
        for k, v in turns:
            yield k.decode(), bytes([v])


def sniff(data: bytes) -> str | None:
    if data[:3] == b"\xff\xd8\xff":
        return "jpeg"
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return "png"
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "webp"
    if data[:4] == b"GIF8":
        return "gif"
    if data[4:8] == b"ftyp":
        return "avif" if data[8:12] in (b"avif", b"avis") else "heic"
    return None


WALKERS = {"jpeg": _jpeg, "png": _png, "webp": _webp, "heic": _heif, "avif": _heif}


def read(data: bytes | None) -> dict:
    """All FIELDS that a file has, its format, and err where it is no image or damaged."""
    data = bytes(data or b"")
    kind = sniff(data)
    out: dict = {"format": kind}
    if kind is None:
        return out | {"err": "unsupported"}
    late: list[tuple[str, bytes]] = []
    try:
        for what, body in WALKERS.get(kind, lambda _: ())(data):
            if what == "tiff":
                read_tiff(body, out)
            elif what == "xmp":
                read_xmp(body, out)
            else:
                late.append((what, body))
        # XMP names hold before IPTC's, so the latter come last
        for what, body in late:
            if what == "iptc":
                _resources(body, out)
            elif what == "irot" and "orientation" not in out:
                out["orientation"] = {0: 1, 1: 8, 2: 3, 3: 6}[body[0] & 3]
    except (struct.error, IndexError, ValueError, OverflowError) as e:
        out["err"] = str(e)[:200]
    return out


@pandas_udf(SCHEMA)
def capture_of(content: pd.Series) -> pd.DataFrame:
    """The metadata of each file's bytes; a row for every input."""
    rows = [read(c) for c in content]
    return pd.DataFrame([{k: r.get(k) for k in ("format", *FIELDS, "err")} for r in rows]).astype({"orientation": "Int32"})
