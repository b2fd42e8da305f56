"""Vectorised work on the bytes of many texts at once.

Texts of an Arrow batch are joined by line feeds, a bounded number of bytes at a
time, and handled as one array: words are found and hashed for all of them
together, without a Python step for each word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .common import long_rows

#: Bytes of text handled together; a longer text makes a chunk of its own.
CHUNK = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_rng = np.random.default_rng(20240517)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C13 | 3
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    """Tables of the powers of the base and of its inverse modulo 2**64."""
    global _powers, _inverse
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            size = max(n, 2 * len(_powers), CHUNK + 4096)
            one = np.ones(1, np.uint64)
            _powers = np.cumprod(np.concatenate([one, np.full(size - 1, _BASE, np.uint64)]))
            _inverse = np.cumprod(np.concatenate([one, np.full(size - 1, pow(_BASE, -1, 1 << 64), np.uint64)]))


#: A second hash, modulo a prime: the first, modulo a power of two, is blind to some regular words.
PRIME = (1 << 31) - 1
_VALUE = _rng.integers(1, PRIME, 256, dtype=np.int64)
_BASE2 = int(_rng.integers(1 << 20, PRIME - 1))
_powers2 = np.ones(1, np.int64)
_inverse2 = np.ones(1, np.int64)


def _grow2(n: int) -> None:
    """As ``_grow``, modulo the prime."""
    global _powers2, _inverse2
    while len(_powers2) < n:
        size = len(_powers2)
        _powers2 = np.concatenate([_powers2, _powers2 * pow(_BASE2, size, PRIME) % PRIME])
        _inverse2 = np.concatenate([_inverse2, _inverse2 * pow(_BASE2, -size, PRIME) % PRIME])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Chunk:
    """``data`` is a line feed, then each text and a line feed; ``first``: index of its first text in the batch."""

    first: int
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def lower(self) -> Chunk:
        return Chunk(self.first, _LOWER[self.data], self.start, self.end)

    def hashes(self) -> Hashes:
        return Hashes(self.data)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words, and the number of the text that each is in."""
        inside = ~_SPACE[self.data]
        edge = np.diff(inside.view(np.int8))
        starts, ends = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
        return starts, ends, np.searchsorted(self.start, starts, "right") - 1


class Hashes:
    """Hashes of all stretches of an array of bytes, from prefix sums."""

    def __init__(self, data: np.ndarray):
        self.data, self.sums2 = data, None
        _grow(len(data) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _powers[: len(data)])])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[ends] - self.sums[starts]) * _inverse[starts] + (ends - starts).astype(np.uint64))

    def sure(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """As ``of``, with a second hash of another kind mixed in, for where equal hashes are taken for equal bytes."""
        if self.sums2 is None:
            _grow2(len(self.data) + 1)
            self.sums2 = np.concatenate([np.zeros(1, np.int64), np.cumsum(_VALUE[self.data] * _powers2[: len(self.data)] % PRIME)])
        second = (self.sums2[ends] - self.sums2[starts]) % PRIME * _inverse2[starts] % PRIME
        with np.errstate(over="ignore"):
            return mix(self.of(starts, ends) + second.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def grams(self, n: int) -> np.ndarray:
        """Of the n bytes from each position on."""
        count = len(self.sums) - n
        with np.errstate(over="ignore"):
            return mix((self.sums[n:] - self.sums[:count]) * _inverse[:count] + np.uint64(n))


def chunks(texts: list[str | None], limit: int = CHUNK) -> Iterator[Chunk]:
    at = 0
    coded: list[bytes] = []
    held = 0
    for i, text in enumerate(texts):
        part = (text or "").encode("utf-8", "replace")
        if coded and held + len(part) > limit:
            yield _chunk(at, coded)
            at, coded, held = i, [], 0
        coded.append(part)
        held += len(part) + 1
    if coded:
        yield _chunk(at, coded)


def _chunk(first: int, coded: list[bytes]) -> Chunk:
    lengths = np.array([len(x) for x in coded], np.int64)
    start = 1 + np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    return Chunk(first, np.frombuffer(b"\n" + b"\n".join(coded) + b"\n", np.uint8), start, start + lengths)


def segment_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values[start:end] (along the first axis); 0 where that is empty."""
    out = np.zeros((len(starts), *values.shape[1:]), np.float64)
    full = np.flatnonzero(ends > starts)
    if len(full) and len(values):
        bounds = np.stack([starts[full], ends[full]], 1).ravel()
        padded = np.concatenate([values, np.zeros((1, *values.shape[1:]), values.dtype)])
        out[full] = np.add.reduceat(padded, bounds, axis=0)[::2]
    return out


def with_columns(df: DataFrame, text_col: str, added: StructType, make: Callable[[], Callable[[list[str | None]], list]]) -> DataFrame:
    """All columns of ``df`` (those named like an added one go) and the added ones.

    ``make()`` is called once a task and gives a function from texts to a list of
    arrays, one for each added field.
    """
    at = df.columns.index(text_col)
    kept = [i for i, c in enumerate(df.columns) if c not in added.names]
    schema = StructType([df.schema[i] for i in kept] + list(added))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            columns = [batch.column(i) for i in kept] + [x if isinstance(x, pa.Array) else pa.array(x) for x in work(batch.column(at).to_pylist())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return long_rows(df).mapInArrow(run, schema)
