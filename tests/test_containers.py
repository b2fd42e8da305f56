"""Tags of each kind of container, from fixtures that are built here, and how much of a file is read."""

import io
import struct
import zlib

import pytest

from lumenframe.sources import exif
from lumenframe.sources.exif import read_tags
from test_operators import Z6, jpeg, tiff

TAGS = {"Make": "NIKON CORPORATION", "Model": "NIKON Z 6", "DateTime": "2023:12:01 10:30:00", "ExposureTime": "1/250", "FNumber": "28/10", "ISO": "400"}


def chunk(kind, data):
    return struct.pack(">I4s", len(data), kind) + data + struct.pack(">I", zlib.crc32(kind + data))


def png(width, height, block=None, after=False):
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0))
    tags = chunk(b"eXIf", block) if block else b""
    data = chunk(b"IDAT", b"x" * 100) * 3
    return b"\x89PNG\r\n\x1a\n" + head + (data + tags if after else tags + data) + chunk(b"IEND", b"")


def box(kind, content, large=False):
    return struct.pack(">I4sQ", 1, kind, 16 + len(content)) + content if large else struct.pack(">I4s", 8 + len(content), kind) + content


def full(kind, version, content):
    return box(kind, bytes([version, 0, 0, 0]) + content)


def heic(width, height, block, version=1, in_idat=False, large=False):
    """A thumbnail and a picture, and an Exif item in the data box or in idat."""
    item = struct.pack(">I", 6) + b"Exif\0\0" + block
    wide = "I" if version == 2 else "H"
    infos = full(b"infe", 2, struct.pack(">HH4s", 1, 0, b"hvc1") + b"\0") + full(b"infe", 2, struct.pack(">HH4s", 7, 0, b"Exif") + b"\0")
    sizes = box(b"iprp", box(b"ipco", full(b"ispe", 0, struct.pack(">II", 160, 120)) + full(b"ispe", 0, struct.pack(">II", width, height))))

    def meta(offset):
        rows = b""
        for number, at, length in ((1, 0, 10), (7, offset, len(item))):
            method = struct.pack(">H", 1 if in_idat and number == 7 else 0) if version else b""
            rows += struct.pack(">" + wide, number) + method + struct.pack(">HHII", 0, 1, at, length)
        places = full(b"iloc", version, struct.pack(">H", 0x4400) + struct.pack(">" + wide, 2) + rows)
        return full(b"meta", 0, full(b"hdlr", 0, b"\0" * 20) + full(b"iinf", 0, struct.pack(">H", 2) + infos) + places + sizes + (box(b"idat", item) if in_idat else b""))

    head = box(b"ftyp", b"heic\0\0\0\0mif1heic")
    at = 0 if in_idat else len(head) + len(meta(0)) + (16 if large else 8)
    return head + meta(at) + box(b"mdat", item + b"pixels" * 50, large)


def cr3(main, exposure, place=None):
    parts = box(b"CNCV", b"Canon") + box(b"CMT1", main) + box(b"CMT2", exposure) + (box(b"CMT4", place) if place else b"")
    other = box(b"uuid", b"\1" * 16 + b"something else")
    return box(b"ftyp", b"crx \0\0\0\1crx isom") + box(b"moov", other + box(b"uuid", exif.CR3 + parts) + box(b"trak", b"..")) + box(b"mdat", b"pixels" * 99)


def gps(order="<"):
    """A TIFF block whose first directory is one of a place: 48 30 0 N, 2 15 0 W."""
    ratios = struct.pack(order + "IIIIII", 48, 1, 30, 1, 0, 1), struct.pack(order + "IIIIII", 2, 1, 15, 1, 0, 1)
    entries = struct.pack(order + "HHI4s", 1, 2, 2, b"N\0\0\0") + struct.pack(order + "HHII", 2, 5, 3, 62) + struct.pack(order + "HHI4s", 3, 2, 2, b"W\0\0\0") + struct.pack(order + "HHII", 4, 5, 3, 86)
    return struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 8) + struct.pack(order + "H", 4) + entries + b"\0" * 4 + ratios[0] + ratios[1]


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize(
    "make",
    [
        lambda block: png(300, 200, block), lambda block: png(300, 200, block, after=True), lambda block: jpeg(300, 200, block), lambda block: heic(300, 200, block), lambda block: heic(300, 200, block, version=0),
        lambda block: heic(300, 200, block, version=2), lambda block: heic(300, 200, block, in_idat=True), lambda block: heic(300, 200, block, large=True),
    ],
)
def test_tags_and_size(make, order):
    assert read_tags(make(tiff(Z6, order))) == TAGS | {"ImageWidth": "300", "ImageHeight": "200"}


def test_cr3_has_a_block_for_each_directory():
    main, exposure = {k: Z6[k] for k in (0x010F, 0x0110, 0x0132)} | {0x0100: 6000, 0x0101: 4000}, {k: Z6[k] for k in (0x829A, 0x829D, 0x8827)}
    assert read_tags(cr3(tiff(main), tiff(exposure, ">"))) == TAGS | {"ImageWidth": "6000", "ImageHeight": "4000"}
    found = read_tags(cr3(tiff(main), tiff(exposure), gps()))
    assert (found["GPSLatitude"], found["GPSLongitude"]) == ("48.5", "-2.25")


def test_pictures_without_tags_have_their_size():
    assert read_tags(png(30, 20)) == {"ImageWidth": "30", "ImageHeight": "20"}
    assert read_tags(heic(30, 2000, b"no block")) == {"ImageWidth": "30", "ImageHeight": "2000"} and read_tags(cr3(b"", b"")) == {}


class Counting(io.BytesIO):
    """A file that counts what is read of it."""

    taken = 0

    def read(self, size=-1):
        out = super().read(size)
        self.taken += len(out)
        return out


@pytest.mark.parametrize("make", [lambda: tiff(Z6), lambda: jpeg(300, 200, tiff(Z6)), lambda: png(300, 200, tiff(Z6)), lambda: heic(300, 200, tiff(Z6)), lambda: cr3(tiff(Z6), tiff(Z6))])
def test_little_of_a_large_file_is_read(make):
    file = Counting(make() + b"\0" * 30_000_000)
    assert read_tags(file)["Model"] == "NIKON Z 6" and file.taken < 5000


def test_broken_files_give_what_is_right_or_nothing():
    whole = [tiff(Z6), jpeg(300, 200, tiff(Z6)), png(300, 200, tiff(Z6)), heic(300, 200, tiff(Z6)), cr3(tiff(Z6), tiff(Z6))]
    for content in whole:
        for cut in range(0, len(content), 7):
            for broken in (content[:cut], content[:cut] + b"\xff" * 9 + content[cut + 9 :], content[:cut] + b"\0" * 9 + content[cut + 9 :]):
                found = read_tags(broken)
                assert all(isinstance(x, str) for pair in found.items() for x in pair)
    loop = struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<H", 1) + struct.pack("<HHII", 0x8769, 4, 1, 8)
    assert read_tags(loop + b"\0" * 4) == {}


def test_a_directory_that_announces_too_much_is_bounded():
    huge = struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<H", 2) + struct.pack("<HHII", 0x010F, 2, 2**31, 38) + struct.pack("<HHII", 0x0110, 2, 4, 0x00434241) + b"\0" * 4
    file = Counting(huge + b"m" * 5_000_000)
    assert read_tags(file) == {"Make": "m" * exif.LONGEST_TEXT, "Model": "ABC"} and file.taken < 10_000
