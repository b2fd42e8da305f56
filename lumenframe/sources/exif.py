"""Embedded metadata of JPEG, PNG, HEIC, CR3 and TIFF-like files, read with the standard library.

Tags come as a map of texts: rationals as ``a/b``, coordinates in degrees. Files of
other formats, and broken ones, give an empty map. Files are read by place: the directories, not the picture.
``exiftool`` is used where it is installed and asked for, one process a batch.
"""

from __future__ import annotations

import functools
import io
import json
import shutil
import struct
import subprocess
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame

#: Tag numbers and names.
TAGS = {
    0x0100: "ImageWidth", 0x0101: "ImageHeight", 0x010F: "Make", 0x0110: "Model", 0x0131: "Software", 0x0132: "DateTime", 0x013B: "Artist", 0x8298: "Copyright",
    0x829A: "ExposureTime", 0x829D: "FNumber", 0x8822: "ExposureProgram", 0x8827: "ISO", 0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized", 0x9204: "ExposureBias",
    0x9207: "MeteringMode", 0x9209: "Flash", 0x920A: "FocalLength", 0xA001: "ColorSpace", 0xA403: "WhiteBalance", 0xA405: "FocalLength35mm", 0xA431: "CameraSerialNumber",
    0xA433: "LensMake", 0xA434: "LensModel",
}
SUBDIRECTORY, GPS_DIRECTORY = 0x8769, 0x8825
#: Bytes and struct codes of the field types that are read.
KINDS = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 10: (8, "ii")}
LONGEST, LONGEST_TEXT = 64, 4096
#: Bytes that are read of a file at most.
MOST_READ = 1 << 20
#: Fixed value: the identifier of the box that holds a CR3 file's tags.
CR3 = bytes.fromhex("85c0b687820f11e08111f4ce462b6a48")


class Broken(Exception):
    """The file doesn't hold what it announces, or too much is asked of it."""



class Source:
    """A file read by place, at most ``limit`` bytes in all."""

    def __init__(self, file: BinaryIO, limit: int = MOST_READ):
        self.file, self.left = file, limit
        self.size = file.seek(0, 2)

    def read(self, at: int, size: int) -> bytes:
        """Exactly ``size`` bytes."""
        self.left -= size
        if size < 0 or at < 0 or at + size > self.size or self.left < 0:
            raise Broken
        self.file.seek(at)
        return self.file.read(size)

    def unpack(self, code: str, at: int) -> tuple:
        return struct.unpack(code, self.read(at, struct.calcsize(code)))


class Tiff:
    """Fields of the directories of a TIFF block that begins at ``base``."""

    def __init__(self, source: Source, base: int = 0):
        self.source, self.base = source, base
        self.order = {b"II": "<", b"MM": ">"}[source.read(base, 2)]

    def number(self, code: str, at: int) -> int:
        return self.source.unpack(self.order + code, self.base + at)[0]

    def directory(self, at: int) -> Iterator[tuple[int, object]]:
        count = self.number("H", at)
        for tag, kind, size, place in struct.iter_unpack(self.order + "HHI4s", self.source.read(self.base + at + 2, 12 * count)):
            if kind not in KINDS:
                continue
            width, code = KINDS[kind]
            taken = min(size, LONGEST_TEXT if code == "s" else LONGEST)
            offset = struct.unpack(self.order + "I", place)[0]
            try:
                raw = place[: width * taken] if width * size <= 4 else self.source.read(self.base + offset, width * taken)
            except Broken:  # a field that points outside; the others may be right
                continue
            if code == "s":
                yield tag, raw.split(b"\0")[0].decode("utf-8", "replace").strip()
            else:
                values = [f"{x[0]}/{x[1]}" if len(x) == 2 else x[0] for x in struct.iter_unpack(self.order + code, raw)]
                yield tag, values[0] if len(values) == 1 else values

    def first(self) -> dict[int, object]:
        return dict(self.directory(self.number("I", 4)))

    def tags(self) -> dict[str, str]:
        out: dict[str, str] = {}
        first = self.first()
        for fields in (first, dict(self.directory(first[SUBDIRECTORY])) if SUBDIRECTORY in first else {}):
            out |= named(fields)
        return out | (located(dict(self.directory(first[GPS_DIRECTORY]))) if GPS_DIRECTORY in first else {})


def named(fields: dict[int, object]) -> dict[str, str]:
    return {TAGS[tag]: str(value[0] if isinstance(value, list) else value) for tag, value in fields.items() if tag in TAGS and value not in ("", [])}


def located(fields: dict[int, object]) -> dict[str, str]:
    """Coordinates from the fields of a GPS directory."""
    found = {name: degrees(fields.get(at), fields.get(ref)) for name, ref, at in (("GPSLatitude", 1, 2), ("GPSLongitude", 3, 4))}
    return {name: repr(value) for name, value in found.items() if value is not None}


def degrees(parts: object, ref: object) -> float | None:
    if not isinstance(parts, list):
        return None
    try:
        numbers = [int(a) / int(b) for a, b in (str(x).split("/") for x in parts)]
    except (ValueError, ZeroDivisionError):
        return None
    value = sum(x / 60**k for k, x in enumerate(numbers[:3]))
    return -value if ref in ("S", "W") else value


def sized(width: int, height: int) -> dict[str, str]:
    return {"ImageWidth": str(width), "ImageHeight": str(height)}


def block_tags(source: Source, at: int) -> dict[str, str]:
    """Of a TIFF block within a file; none if it is broken, so that the rest of the file still counts."""
    try:
        return Tiff(source, at).tags()
    except (Broken, KeyError, struct.error, TypeError):
        return {}


def jpeg_tags(source: Source) -> dict[str, str]:
    """Of the segments before the picture's data; the picture's own size overrides that of the tags."""
    tags: dict[str, str] = {}
    at = 2
    while at + 4 <= source.size:
        mark, marker, length = source.unpack(">BBH", at)
        if mark != 0xFF or marker == 0xDA:
            break
        if marker == 0xE1 and length >= 16 and source.read(at + 4, 6) == b"Exif\0\0":
            tags = block_tags(source, at + 10) | tags
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = source.unpack(">HH", at + 5)
            tags |= sized(width, height)
        at += 2 + length
    return tags


def png_tags(source: Source) -> dict[str, str]:
    """Of the chunks; those of the picture's data are stepped over."""
    tags: dict[str, str] = {}
    at = 8
    while at + 12 <= source.size:
        length, kind = source.unpack(">I4s", at)
        if kind == b"IHDR":
            tags |= sized(*source.unpack(">II", at + 8))
        elif kind == b"eXIf":
            tags = block_tags(source, at + 8) | tags
        elif kind == b"IEND":
            break
        at += 12 + length
    return tags


def boxes(source: Source, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, first byte of the content, end) of the boxes between two places."""
    while at + 8 <= end:
        size, kind = source.unpack(">I4s", at)
        head = 8
        if size == 1:
            size, head = source.unpack(">Q", at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            return
        yield kind, at + head, at + size
        at += size


def inside(source: Source, path: list[bytes], at: int, end: int) -> Iterator[tuple[int, int]]:
    """(first byte, end) of the boxes that a path of types leads to."""
    for kind, lo, hi in boxes(source, at, end):
        if kind == path[0]:
            if len(path) == 1:
                yield lo, hi
            else:
                yield from inside(source, path[1:], lo, hi)


def item_places(source: Source, at: int, end: int) -> dict[int, list[tuple[int, int, int]]]:
    """By item: (method, offset, length) of its extents, from the content of an item location box."""
    version, sizes = source.read(at, 1)[0], source.unpack(">H", at + 4)[0]
    offset_size, length_size, base_size, index_size = sizes >> 12, sizes >> 8 & 15, sizes >> 4 & 15, sizes & 15 if version else 0
    at += 6

    def take(size: int) -> int:
        nonlocal at
        at += size
        return int.from_bytes(source.read(at - size, size), "big")

    wide = 4 if version == 2 else 2
    found: dict[int, list[tuple[int, int, int]]] = {}
    for _ in range(take(wide)):
        item = take(wide)
        method = take(2) & 15 if version else 0
        take(2)
        base = take(base_size)
        extents = []
        for _ in range(take(2)):
            take(index_size)
            offset = take(offset_size)
            extents.append((method, base + offset, take(length_size)))
        found[item] = extents
        if at >= end:
            break
    return found


def heif_tags(source: Source) -> dict[str, str]:
    """Of a picture in boxes (HEIC, AVIF): the item of type Exif, and the size of the largest picture."""
    tags: dict[str, str] = {}
    for lo, hi in inside(source, [b"meta"], 0, source.size):
        lo += 4
        exif = set()
        for at, end in inside(source, [b"iinf"], lo, hi):
            at += 6 if source.read(at, 1)[0] == 0 else 8
            for kind, first, _ in boxes(source, at, end):
                version = source.read(first, 1)[0]
                if kind == b"infe" and version >= 2:
                    item, _, name = source.unpack(">HH4s" if version == 2 else ">IH4s", first + 4)
                    exif |= {item} if name == b"Exif" else set()
        data = next(inside(source, [b"idat"], lo, hi), (0, 0))[0]
        for at, end in inside(source, [b"iloc"], lo, hi):
            for item, extents in item_places(source, at, end).items():
                if item in exif and extents:
                    method, offset, _ = extents[0]
                    start = offset + (data if method == 1 else 0)
                    tags |= block_tags(source, start + 4 + source.unpack(">I", start)[0])
        pictures = [source.unpack(">II", at + 4) for at, _ in inside(source, [b"iprp", b"ipco", b"ispe"], lo, hi)]
        if pictures:
            tags |= sized(*max(pictures, key=lambda x: x[0] * x[1]))
    return tags


def cr3_tags(source: Source) -> dict[str, str]:
    """Of a raw picture in boxes: a TIFF block each for the main, the exposure's and the place's directory."""
    tags: dict[str, str] = {}
    for lo, hi in inside(source, [b"moov", b"uuid"], 0, source.size):
        if source.read(lo, 16) == CR3:
            for kind, at, _ in boxes(source, lo + 16, hi):
                if kind in (b"CMT1", b"CMT2"):
                    tags |= named(Tiff(source, at).first())
                elif kind == b"CMT4":
                    tags |= located(Tiff(source, at).first())
    return tags


def read_tags(content: bytes | BinaryIO) -> dict[str, str]:
    """All tags of a file, which is read by place and only as far as they lie; an empty map for what is broken or not known."""
    try:
        source = Source(io.BytesIO(content) if isinstance(content, bytes) else content)
        head = source.read(0, min(16, source.size))
        if head[:2] in (b"II", b"MM"):
            return Tiff(source).tags()
        if head[:2] == b"\xff\xd8":
            return jpeg_tags(source)
        if head[:8] == b"\x89PNG\r\n\x1a\n":
            return png_tags(source)
        if head[4:8] == b"ftyp":
            return cr3_tags(source) if head[8:11] == b"crx" else heif_tags(source)
        return {}
    except (Broken, KeyError, struct.error, TypeError, RecursionError):
        return {}


@functools.lru_cache(maxsize=1)
def has_exiftool(timeout: float = 5) -> bool:
    if shutil.which("exiftool") is None:
        return False
    try:
        return subprocess.run(["exiftool", "-ver"], capture_output=True, timeout=timeout).returncode == 0
    except (OSError, subprocess.SubprocessError):
        return False


def _external(paths: list[str]) -> dict[str, dict[str, str]]:
    done = subprocess.run(["exiftool", "-json", "-G", "-n", *paths], capture_output=True, text=True)
    rows = json.loads(done.stdout or "[]")
    return {r["SourceFile"]: {k: str(v) for k, v in r.items() if k != "SourceFile"} for r in rows}


def with_tags(files: DataFrame, exiftool: bool = False, detailed: bool = True) -> DataFrame:
    """All columns of ``files`` and ``tags``. ``detailed``: a file without embedded tags has none, its size in pixels neither."""
    names = files.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            outside = _external(list(frame["path"])) if exiftool and len(frame) and has_exiftool() else {}
            found = []
            for path in frame["path"]:
                tags = outside.get(path, {})
                if not tags:
                    try:
                        with open(path, "rb") as file:
                            tags = read_tags(file)
                    except OSError:
                        tags = {}
                    if detailed and not set(tags) - {"ImageWidth", "ImageHeight"}:
                        tags = {}
                found.append(tags)
            yield frame[names].assign(tags=found)

    return files.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema) + ", tags map<string,string>")
