"""Grey values of JPEG pictures, from an encoder that is written here for the purpose."""

import random
import struct

import numpy as np
import pytest

from lumenframe.sources.grey import grey_values
from test_operators import Z6, tiff

ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, (i % 8 if (i // 8 + i % 8) % 2 == 0 else i // 8)))
DCT = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(1 / 8) if u == 0 else 0.5) for x in range(8)] for u in range(8)])


class Bits:
    def __init__(self):
        self.text = []

    def put(self, value, size):
        if size:
            self.text.append(format(value, f"0{size}b"))

    def symbol(self, symbol, value, size):
        """Every code has eight bits, the symbol itself."""
        self.put(symbol, 8)
        self.put(value if value >= 0 else value + (1 << size) - 1, size)

    def done(self):
        text = "".join(self.text)
        text += "1" * (-len(text) % 8)
        return int(text, 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\0") if text else b""


def bits_of(value):
    return int(abs(value)).bit_length()


def blocks_of(plane, quant):
    h, w = plane.shape
    padded = np.pad(plane, ((0, -h % 8), (0, -w % 8)), mode="edge").astype(float) - 128
    rows, columns = padded.shape[0] // 8, padded.shape[1] // 8
    found = {}
    for i in range(rows):
        for j in range(columns):
            block = DCT @ padded[8 * i : 8 * i + 8, 8 * j : 8 * j + 8] @ DCT.T
            found[i, j] = np.rint(block / quant).astype(int).ravel()[ZIGZAG].tolist()
    return found, rows, columns


def jpeg(plane, quant=4, chroma=0, sampling=1, restart=0, progressive=False, apart=False, exif=None, wide=False):
    """A picture of one plane and ``chroma`` planes of noise; ``sampling``: blocks of the first a unit, across and down."""
    h, w = plane.shape
    rng = np.random.default_rng(1)
    size = 8 * sampling
    planes = [np.pad(plane, ((0, -h % size), (0, -w % size)), mode="edge") if chroma else plane]
    planes += [rng.integers(0, 255, (planes[0].shape[0] // sampling, planes[0].shape[1] // sampling)) for _ in range(chroma)]
    coded = [blocks_of(p, quant) for p in planes]
    order = []
    if not chroma or apart:
        order = [(0, (i, j)) for i in range(-(-h // 8)) for j in range(-(-w // 8))]
        units = [[x] for x in order]
    else:
        units = [[(0, (sampling * i + a, sampling * j + b)) for a in range(sampling) for b in range(sampling)] + [(k, (i, j)) for k in range(1, chroma + 1)] for i in range(coded[0][1] // sampling) for j in range(coded[0][2] // sampling)]
    data, writer, before = b"", Bits(), [0] * 4
    for n, unit in enumerate(units):
        if restart and n and n % restart == 0:
            data += writer.done() + bytes([0xFF, 0xD0 + (n // restart - 1) % 8])
            writer, before = Bits(), [0] * 4
        for k, at in unit:
            block = coded[k][0][at]
            first = block[0] >> 1 if progressive else block[0]
            writer.symbol(bits_of(first - before[k]), first - before[k], bits_of(first - before[k]))
            before[k] = first
            if not progressive:
                run = 0
                last = max((i for i in range(64) if block[i]), default=0)
                for value in block[1 : last + 1]:
                    if not value:
                        run += 1
                        continue
                    while run > 15:
                        writer.symbol(0xF0, 0, 0)
                        run -= 16
                    writer.symbol(run << 4 | bits_of(value), value, bits_of(value))
                    run = 0
                if last < 63:
                    writer.symbol(0, 0, 0)
    data += writer.done()
    segment = lambda marker, body: b"\xff" + bytes([marker]) + struct.pack(">H", 2 + len(body)) + body
    table = b"\x10" + struct.pack(">64H", *[quant] * 64) if wide else b"\0" + bytes([quant] * 64)
    symbols = bytes(range(255))
    n = 12
    parts = bytes([1 + chroma, 1, sampling << 4 | sampling if chroma else 0x11, 0]) + b"".join(bytes([2 + k, 0x11, 0]) for k in range(chroma))
    scan = bytes([1, 1, 0]) if not chroma or apart else bytes([1 + chroma]) + b"".join(bytes([1 + k, 0]) for k in range(1 + chroma))
    out = b"\xff\xd8" + (segment(0xE1, b"Exif\0\0" + exif) if exif else b"") + segment(0xDB, table) + segment(0xC2 if progressive else 0xC0, struct.pack(">BHH", 8, h, w) + parts)
    out += segment(0xC4, bytes([0]) + bytes([0] * 7 + [n] + [0] * 8) + symbols[:n]) + segment(0xC4, bytes([0x10]) + bytes([0] * 7 + [255] + [0] * 8) + symbols)
    out += (segment(0xDD, struct.pack(">H", restart)) if restart else b"") + segment(0xDA, scan + (bytes([0, 0, 1]) if progressive else bytes([0, 63, 0])))
    return out + data + b"\xff\xd9"


def scene(width, height, seed=0):
    """A smooth picture that looks the same at any size."""
    rng = random.Random(seed)
    y, x = np.mgrid[0:height, 0:width]
    y, x = (y + 0.5) / height, (x + 0.5) / width
    out = sum(rng.uniform(20, 50) * np.sin(rng.uniform(1, 9) * x + rng.uniform(1, 9) * y + rng.uniform(0, 6)) for _ in range(4))
    return np.clip(np.rint(128 + out), 0, 255)


def cells(plane):
    """Means of the eighths, exactly by area."""
    h, w = plane.shape
    fine = np.repeat(np.repeat(plane, 8, 0), 8, 1)
    return fine.reshape(8, h, 8, w).mean((1, 3))


@pytest.mark.parametrize("shape", [(64, 64), (120, 160), (33, 41), (8, 8), (5, 200)])
@pytest.mark.parametrize(
    "how",
    [{}, {"chroma": 2}, {"chroma": 2, "sampling": 2}, {"restart": 3}, {"chroma": 2, "sampling": 2, "restart": 2}, {"progressive": True}, {"chroma": 2, "sampling": 2, "progressive": True}, {"chroma": 2, "sampling": 2, "apart": True}, {"wide": True, "quant": 9}],
)
def test_grey_values_are_means_by_area(shape, how):
    plane = scene(shape[1], shape[0], 3)
    got = np.array(grey_values(jpeg(plane, **how))).reshape(8, 8)
    assert abs(got.mean() - plane.mean()) < 12
    # smaller pictures have blocks larger than cells
    assert min(shape) < 64 or np.abs(got - cells(plane)).max() < 2.5


def test_rescaled_pictures_have_equal_bits():
    same = 0
    for seed in range(12):
        bits = [np.array(grey_values(jpeg(scene(w, h, seed), quant=q))) for w, h, q in ((640, 480, 4), (320, 240, 12))]
        one, two = (b > b.mean() for b in bits)
        same += np.array_equal(one, two)
        assert (one != two).sum() <= 2
    assert same >= 8


def with_small(width, height, small):
    """Tags whose second directory has a small picture."""
    main = bytearray(tiff(Z6))
    first = 8 + 2 + 12 * len(Z6)
    main[first : first + 4] = struct.pack("<I", len(main))
    entries = struct.pack("<HHII", 0x0201, 4, 1, len(main) + 2 + 24 + 4) + struct.pack("<HHII", 0x0202, 4, 1, len(small))
    return bytes(main) + struct.pack("<H", 2) + entries + b"\0" * 4 + small


def test_a_small_picture_of_the_same_shape_is_taken():
    plane, other = scene(320, 240, 1), scene(160, 120, 2)
    taken = grey_values(jpeg(plane, exif=with_small(160, 120, jpeg(other))))
    assert np.abs(np.array(taken).reshape(8, 8) - cells(other)).max() < 3
    bars = grey_values(jpeg(plane, exif=with_small(160, 100, jpeg(scene(160, 100, 2)))))
    broken = grey_values(jpeg(plane, exif=with_small(160, 120, jpeg(other)[:-600])))
    for got in (bars, broken):
        assert np.abs(np.array(got).reshape(8, 8) - cells(plane)).max() < 3


def test_what_is_no_picture_has_no_values():
    whole = jpeg(scene(64, 48), chroma=2, sampling=2)
    assert grey_values(b"") is None and grey_values(b"text") is None and grey_values(b"\xff\xd8\xff\xd9") is None
    for cut in range(0, len(whole) - 2, 23):
        for content in (whole[:cut], whole[:cut] + b"\xff" + whole[cut + 1 :], whole[:cut] + b"\0\0\0" + whole[cut + 3 :]):
            got = grey_values(content)
            assert got is None or len(got) == 64 and all(np.isfinite(got))
