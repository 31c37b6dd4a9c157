"""Image files made from records, so that readers of metadata can be held against what was written. For queries and tests."""

from __future__ import annotations

import struct
import zlib
from fractions import Fraction
from html import escape

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# First bytes of formats.
JPEG, PNG, GIF = b"\xff\xd8\xff\xe0\x00\x02\xff\xd9", b"\x89PNG\r\n\x1a\n", b"GIF89a"
WEBP, HEIC = b"RIFF\x04\x00\x00\x00WEBP", b"\x00\x00\x00\x10ftypheic\x00\x00\x00\x00"
#: A small tree: what is read, what is skipped, and what is not to be seen.
FILES = [
    ("a/b/one.JPG", JPEG), ("a/two.png", PNG), ("three.webp", WEBP), ("a/four.heic", HEIC), ("a/five.gif", GIF), ("a/liar.png", JPEG), ("c/clip.mp4", b"\x00" * 20), ("c/note.txt", b"some text, no image"), ("c/empty.jpg", b""),
    ("a/.hidden.jpg", JPEG), (".cache/x.jpg", JPEG), ("_finalists_all/01_one.jpg", JPEG), ("_tagged_best/two.png", PNG), ("_sidecars/three.jpg", JPEG),
]
NAMES = {"city": ("photoshop:City", 90), "sublocation": ("Iptc4xmpCore:Location", 92), "state": ("photoshop:State", 95), "country": ("photoshop:Country", 101)}


def _entry(tag: int, value, order: str) -> tuple[int, int, int, bytes]:
    """Tag, type, count and bytes: text, a short (int), or rationals (a list)."""
    if isinstance(value, str):
        raw = value.encode() + b"\0"
        return tag, 2, len(raw), raw
    if isinstance(value, int):
        return tag, 3, 1, struct.pack(order + "H", value)
    parts = [Fraction(x).limit_denominator(1_000_000) for x in value]
    return tag, 5, len(parts), b"".join(struct.pack(order + "II", p.numerator, p.denominator) for p in parts)


def tiff(top: dict, exif: dict, gps: dict, order: str = "<") -> bytes:
    """A TIFF block of three folders, the first of which points to the others."""
    folders = [dict(top), exif, gps]
    for at, tag in ((1, 0x8769), (2, 0x8825)):
        if folders[at]:
            folders[0][tag] = None
    sizes = [2 + 12 * len(f) + 4 if f or i == 0 else 0 for i, f in enumerate(folders)]
    places = [8, 8 + sizes[0], 8 + sizes[0] + sizes[1]]
    free, body, heads = 8 + sum(sizes), b"", b""
    for i, f in enumerate(folders):
        if not sizes[i]:
            continue
        heads += struct.pack(order + "H", len(f))
        for tag in sorted(f):
            if f[tag] is None:
                heads += struct.pack(order + "HHII", tag, 4, 1, places[1 if tag == 0x8769 else 2])
                continue
            _, kind, count, raw = _entry(tag, f[tag], order)
            if len(raw) <= 4:
                heads += struct.pack(order + "HHI", tag, kind, count) + raw.ljust(4, b"\0")
            else:
                heads += struct.pack(order + "HHII", tag, kind, count, free + len(body))
                body += raw + b"\0" * (len(raw) % 2)
        heads += b"\0" * 4
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8) + heads + body


def block(r: dict) -> bytes:
    """A record's TIFF block; the byte order goes by its id."""
    some = lambda pairs: {t: v for t, v in pairs if v is not None and v != "" and v == v}
    rational = lambda x: [x] if x is not None and x == x and x > 0 else None
    whole = lambda x: int(x) if x is not None and x == x and x > 0 else None
    when = r["taken"] and r["taken"].replace("-", ":").replace("T", " ")
    top = some([(0x010F, r["make"]), (0x0110, r["model"]), (0x0112, int(r["id"] % 8) + 1)])
    exif = some([(0x9003, when), (0x9011, r["tz"] if when else None), (0x829A, rational(r["exposure"])), (0x829D, rational(r["f"])), (0x8827, whole(r["iso"])), (0x920A, rational(r["fl"])), (0xA405, whole(r["fl35"])), (0xA434, r["lens"])])
    gps = {}
    if r["lat"] is not None and r["lat"] == r["lat"]:
        gps = {1: "S" if r["lat"] < 0 else "N", 2: [abs(r["lat"]), 0, 0], 3: "W" if r["lon"] < 0 else "E", 4: [abs(r["lon"]), 0, 0]}
    return tiff(top, exif, gps, "<" if r["id"] % 2 else ">")


def xmp(r: dict) -> bytes:
    """Place names as attributes or as elements, by the record's id."""
    names = [(n, escape(r[k], quote=True)) for k, (n, _) in NAMES.items() if r[k]]
    if r["id"] % 3:
        return ("<x " + " ".join(f'{n}="{v}"' for n, v in names) + "/>").encode()
    return ("<x>" + "".join(f"<{n}>{v}</{n}>" for n, v in names) + "</x>").encode()


def iptc(r: dict) -> bytes:
    """Place names as a Photoshop resource."""
    sets = b"".join(b"\x1c\x02" + bytes([d]) + len(r[k].encode()).to_bytes(2, "big") + r[k].encode() for k, (_, d) in NAMES.items() if r[k])
    return b"8BIM\x04\x04\0\0" + len(sets).to_bytes(4, "big") + sets + b"\0" * (len(sets) % 2)


def _box(kind: bytes, body: bytes) -> bytes:
    return (len(body) + 8).to_bytes(4, "big") + kind + body


def heic(r: dict) -> bytes:
    """A HEIF file: a decoy item whose bytes lie elsewhere, an Exif item and an XMP item."""
    items = [(1, b"Exif", 1, b"\0" * 12), (2, b"Exif", 0, b"\0\0\0\x06Exif\0\0" + block(r)), (3, b"mime", 0, xmp(r))]
    info = b"".join(_box(b"infe", b"\x02\0\0\0" + i.to_bytes(2, "big") + b"\0\0" + kind + b"\0") for i, kind, _, _ in items)

    def meta(at: int) -> bytes:
        places = b""
        for i, _, construction, body in items:
            places += i.to_bytes(2, "big") + construction.to_bytes(2, "big") + b"\0\0" + (1).to_bytes(2, "big") + at.to_bytes(4, "big") + len(body).to_bytes(4, "big")
            at += len(body)
        iloc = _box(b"iloc", b"\x01\0\0\0\x44\0" + len(items).to_bytes(2, "big") + places)
        return _box(b"meta", b"\0\0\0\0" + _box(b"iinf", b"\0\0\0\0" + len(items).to_bytes(2, "big") + info) + iloc)

    head = _box(b"ftyp", b"heic\0\0\0\0")
    return head + meta(len(head) + len(meta(0)) + 8) + _box(b"mdat", b"".join(body for *_, body in items))


def image(r: dict) -> bytes:
    """A file without pixels: JPEG with XMP, PNG, WebP, JPEG with IPTC or HEIF, by the record's id."""
    kind, block_ = r["id"] % 5, block(r)
    segment = lambda marker, body: b"\xff" + bytes([marker]) + (len(body) + 2).to_bytes(2, "big") + body
    if kind == 0:
        return b"\xff\xd8" + segment(0xE1, b"Exif\0\0" + block_) + segment(0xE1, b"http://ns.adobe.com/xap/1.0/\0" + xmp(r)) + b"\xff\xd9"
    if kind == 1:
        packed = r["id"] // 5 % 2
        chunk = lambda name, body: len(body).to_bytes(4, "big") + name + body + zlib.crc32(name + body).to_bytes(4, "big")
        text = b"XML:com.adobe.xmp\0" + bytes([packed, 0]) + b"\0\0" + (zlib.compress(xmp(r)) if packed else xmp(r))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"eXIf", block_) + chunk(b"iTXt", text) + chunk(b"IEND", b"")
    if kind == 2:
        chunk = lambda name, body: name + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) % 2)
        inner = b"WEBP" + chunk(b"EXIF", b"Exif\0\0" + block_) + chunk(b"XMP ", xmp(r))
        return b"RIFF" + len(inner).to_bytes(4, "little") + inner
    if kind == 3:
        return b"\xff\xd8" + segment(0xE1, b"Exif\0\0" + block_) + segment(0xED, b"Photoshop 3.0\0" + iptc(r)) + b"\xff\xd9"
    return heic(r)


@pandas_udf(T.BinaryType())
def image_file(record: pd.DataFrame) -> pd.Series:
    """The file of each record, a struct of id, taken, tz, make, model, lens, fl35, fl, f, exposure, iso, lat, lon and place names."""
    return pd.Series([image(r) for r in record.astype(object).where(record.notna(), None).to_dict("records")])
