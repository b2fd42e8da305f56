"""Eight by eight grey values of JPEG pictures, for perceptual hashes, without an image library.

The mean of each block of 8 by 8 pixels is its first coefficient, so only those are decoded; the others are stepped
over by the lengths that their codes tell. Progressive pictures have all first coefficients in their first
scan. Means are averaged by area to 8 by 8. Where the tags hold a small picture of the same shape,
that one is taken.

A picture is read whole, and a step over a code takes under a microsecond: about two seconds for a large photograph without
a small picture, milliseconds with one. Other formats, arithmetic codes and broken pictures give None.
"""

from __future__ import annotations

import io
import re
from dataclasses import dataclass, field
from typing import BinaryIO

import numpy as np

from .exif import Broken, Source, Tiff

SIDE = 8
#: Tags of the small picture's place and length.
SMALL_AT, SMALL_LENGTH = 0x0201, 0x0202
#: How much the shapes of a picture and its small one may differ: some have bars at their sides.
SAME_SHAPE = 0.03
#: A code's entry: bits to step over, and how far among the coefficients.
END = 64


@dataclass
class Component:
    number: int
    h: int
    v: int
    quant: int
    dc: list[int] = field(default_factory=list)
    ac: list[int] = field(default_factory=list)


def lookup(counts: bytes, symbols: bytes, dc: bool) -> list[int]:
    """For each 16 bits that come next: of DC codes length << 8 | size, of AC codes bits to step over << 8 | step; -1 where no code fits."""
    table = [-1] * 65536
    code, k = 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            symbol = symbols[k]
            run, size = symbol >> 4, symbol & 15
            if dc:
                entry = length << 8 | symbol
            elif size:
                entry = length + size << 8 | run + 1
            else:
                entry = length << 8 | (16 if run == 15 else END)
            lo = code << 16 - length
            if symbol > 15 and dc or lo + (1 << 16 - length) > 65536:
                raise Broken
            table[lo : lo + (1 << 16 - length)] = [entry] * (1 << 16 - length)
            code, k = code + 1, k + 1
        code <<= 1
    return table


def windows(data: bytes) -> memoryview:
    """The 32 bits from each byte on."""
    b = np.frombuffer(data + b"\0" * 8, np.uint8).astype(np.uint32)
    return memoryview(np.ascontiguousarray(b[:-7] << 24 | b[1:-6] << 16 | b[2:-5] << 8 | b[3:-4]))


def decode_scan(parts: list[bytes], plan: list[tuple[int, Component]], units: int, interval: int, shift: int, progressive: bool) -> np.ndarray:
    """First coefficients of component 0's blocks, in the order of the scan. ``plan``: the (component's place, component) of each block of a unit."""
    out: list[int] = []
    done = 0
    for part in parts:
        data, bit, size = windows(part), 0, 8 * len(part) + 64
        before = [0] * (1 + max(place for place, _ in plan))
        for _ in range(min(interval or units, units - done)):
            for place, c in plan:
                if bit > size - 32:
                    raise Broken
                entry = c.dc[data[bit >> 3] >> 16 - (bit & 7) & 0xFFFF]
                if entry < 0:
                    raise Broken
                bit += entry >> 8
                if n := entry & 255:
                    value = data[bit >> 3] >> 32 - (bit & 7) - n & (1 << n) - 1
                    before[place] += value if value >> n - 1 else value - (1 << n) + 1
                    bit += n
                if not place:
                    out.append(before[0] << shift)
                if not progressive:
                    ac, k = c.ac, 1
                    while k < 64:
                        entry = ac[data[bit >> 3] >> 16 - (bit & 7) & 0xFFFF]
                        if entry < 0 or bit > size - 32:
                            raise Broken
                        bit += entry >> 8
                        k += entry & 255
            done += 1
    if done < units:
        raise Broken
    return np.array(out, np.int64)


def overlaps(size: int, blocks: int) -> np.ndarray:
    """How much of each eighth of ``size`` pixels lies in each block of 8."""
    edges = np.minimum(np.arange(blocks + 1) * 8, size)
    cells = np.arange(SIDE + 1) * size / SIDE
    lo, hi = np.maximum(edges[None, :-1], cells[:-1, None]), np.minimum(edges[None, 1:], cells[1:, None])
    return np.maximum(hi - lo, 0) * SIDE / size


def picture(source: Source, start: int, end: int) -> np.ndarray:
    """Grey values of the JPEG picture between two places."""
    quant: dict[int, int] = {}
    tables: dict[tuple[int, int], list[int]] = {}
    parts: list[Component] = []
    width = height = interval = 0
    progressive = False
    at = start + 2
    while at + 4 <= end:
        mark, marker, length = source.unpack(">BBH", at)
        if mark != 0xFF:
            raise Broken
        if marker == 0xFF:  # a fill byte
            at += 1
            continue
        body = source.read(at + 4, length - 2)
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                quant[body[k] & 15] = int.from_bytes(body[k + 1 : k + 2 + wide], "big")
                k += 1 + 64 * (1 + wide)
        elif marker == 0xC4:
            k = 0
            while k + 17 <= len(body):
                counts = body[k + 1 : k + 17]
                n = sum(counts)
                if k + 17 + n > len(body):
                    raise Broken
                tables[body[k] >> 4, body[k] & 15] = lookup(counts, body[k + 17 : k + 17 + n], not body[k] >> 4)
                k += 17 + n
        elif marker in (0xC0, 0xC1, 0xC2):
            progressive = marker == 0xC2
            height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            parts = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            if body[0] != 8 or not height or not width or any(not c.h or not c.v for c in parts):
                raise Broken
        elif 0xC3 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise Broken
        elif marker == 0xDD:
            interval = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            named = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            inside = [(k, c) for k, c in enumerate(parts) if c.number in named]
            first, low = body[1 + 2 * body[0]], body[3 + 2 * body[0]]
            coded = source.read(at + 2 + length, end - at - 2 - length)
            stop = re.search(rb"\xff[^\x00\xd0-\xd7\xff]", coded)
            if parts and inside and inside[0][0] == 0 and first == 0 and not low >> 4:
                for _, c in inside:
                    c.dc = tables[0, named[c.number] >> 4]
                    c.ac = [] if progressive else tables[1, named[c.number] & 15]
                pieces = [x.replace(b"\xff\x00", b"\xff") for x in re.split(rb"\xff+[\xd0-\xd7]", coded[: stop.start()] if stop else coded)]
                return means(decode(parts, inside, pieces, width, height, interval, low & 15, progressive), quant[parts[0].quant], width, height)
            if not stop:
                raise Broken
            at += 2 + length + stop.start()
            continue
        elif marker == 0xD9:
            break
        at += 2 + length
    raise Broken


def decode(parts: list[Component], inside: list[tuple[int, Component]], pieces: list[bytes], width: int, height: int, interval: int, shift: int, progressive: bool) -> np.ndarray:
    """First coefficients of component 0 as rows of blocks."""
    own, across, down = parts[0], max(c.h for c in parts), max(c.v for c in parts)
    if len(inside) == 1:  # blocks come row by row
        columns, rows = -(-(-(-width * own.h // across)) // 8), -(-(-(-height * own.v // down)) // 8)
        return decode_scan(pieces, [(0, own)], columns * rows, interval, shift, progressive).reshape(rows, columns)
    columns, rows = -(-width // (8 * across)), -(-height // (8 * down))
    plan = [(k, c) for k, c in inside for _ in range(c.h * c.v)]
    found = decode_scan(pieces, plan, columns * rows, interval, shift, progressive)
    return found.reshape(rows, columns, own.v, own.h).transpose(0, 2, 1, 3).reshape(rows * own.v, columns * own.h)


def means(first: np.ndarray, quant: int, width: int, height: int) -> np.ndarray:
    """Block means averaged by area to 8 by 8."""
    rows, columns = min(first.shape[0], -(-height // 8)), min(first.shape[1], -(-width // 8))
    grey = first[:rows, :columns] * quant / 8 + 128
    return overlaps(height, rows) @ grey @ overlaps(width, columns).T


def small_picture(source: Source) -> tuple[int, int] | None:
    """(first byte, end) of the picture in the tags, if it has the shape of the whole."""
    at, block, shape = 2, 0, None
    while at + 4 <= source.size and shape is None:
        mark, marker, length = source.unpack(">BBH", at)
        if mark != 0xFF or marker == 0xDA:
            return None
        if marker == 0xE1 and length >= 16 and source.read(at + 4, 6) == b"Exif\0\0":
            block = at + 10
        elif marker in (0xC0, 0xC1, 0xC2):
            shape = source.unpack(">HH", at + 5)
        at += 2 + length
    if not block or shape is None:
        return None
    tiff = Tiff(source, block)
    first = tiff.number("I", 4)
    following = tiff.number("I", first + 2 + 12 * tiff.number("H", first))
    fields = dict(tiff.directory(following)) if following else {}
    if not {SMALL_AT, SMALL_LENGTH} <= set(fields):
        return None
    start, at = block + fields[SMALL_AT], block + fields[SMALL_AT] + 2
    end = start + fields[SMALL_LENGTH]
    while at + 9 <= end:
        mark, marker, length = source.unpack(">BBH", at)
        if marker in (0xC0, 0xC1, 0xC2):
            own = source.unpack(">HH", at + 5)
            alike = abs(own[0] * shape[1] / (own[1] * shape[0]) - 1) <= SAME_SHAPE
            return (start, end) if alike else None
        if mark != 0xFF or marker == 0xDA:
            return None
        at += 2 + length
    return None


def grey_values(content: bytes | BinaryIO) -> list[float] | None:
    """64 grey values of a JPEG picture, row by row."""
    file = io.BytesIO(content) if isinstance(content, bytes) else content
    try:
        size = file.seek(0, 2)
        source = Source(file, 4 * size + 4096)
        if size < 4 or source.read(0, 2) != b"\xff\xd8":
            return None
        try:
            if small := small_picture(source):
                return [float(x) for x in picture(source, *small).ravel()]
        except (Broken, KeyError, IndexError, TypeError, ValueError, ZeroDivisionError):
            pass  # the whole picture may be right
        return [float(x) for x in picture(source, 0, size).ravel()]
    except (Broken, KeyError, IndexError, TypeError, ValueError, ZeroDivisionError, OSError):
        return None
