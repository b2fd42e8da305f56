"""Packing documents into windows by best-fit decreasing.

Documents are tokenised and cut into full windows and a rest. Pieces are dealt by a
digest into groups; in each, longest first, a piece goes into the open window with
the least room that still holds it, found with a segment tree over the remaining
capacities. Each group's loss is its last windows, so groups are kept large.

Scale: tokenising is a narrow pass whose result (one short row a piece) is written
to the checkpoint folder, so that packing never tokenises again. The number
of groups follows the number of pieces; a packing task streams its sorted group and
holds open windows only. Hot sources do not matter, as groups are dealt by digest.

Edge cases: null and empty texts are one end token; documents of many windows are
cut; repeated rows are packed as often as they occur; an empty table gives an empty
result; extra columns are dropped, whatever their names.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, long_rows

WINDOW = 2048
END = 1
#: Pieces that a packing group holds about.
GROUP_PIECES = 50_000


@functools.lru_cache(maxsize=2)
def encoder(vocabulary: str, ranks: str | None, pattern: str | None):
    """A function from text to an array of ids, as ``tokenizers`` gives them without special tokens added.

    Where the same vocabulary is at hand as ranks, texts are encoded with those, which
    is faster and gives the same ids; texts that spell out an added token, and any on
    which the faster way fails, go to ``tokenizers`` itself.
    """
    import tokenizers

    exact = tokenizers.Tokenizer.from_file(vocabulary)
    slow = lambda text: np.array(exact.encode(text, add_special_tokens=False).ids, dtype="<u4")
    if not ranks:
        return slow
    import base64

    import tiktoken

    with open(ranks, "rb") as file:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    quick = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    with open(vocabulary, encoding="utf-8") as file:
        added = [x["content"] for x in json.load(file).get("added_tokens", [])]

    def encode(text: str) -> np.ndarray:
        if any(x in text for x in added):
            return slow(text)
        try:
            return quick.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
        except (ValueError, RuntimeError):
            return slow(text)

    return encode


class BestFit:
    """Open windows by remaining capacity, in a segment tree over 0..window."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.tree = bytearray(2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]
        self.window, self.made = window, 0

    def _mark(self, room: int, there: int) -> None:
        i = room + self.size
        self.tree[i] = there
        while i > 1:
            i >>= 1
            now = self.tree[2 * i] | self.tree[2 * i + 1]
            if self.tree[i] == now:
                return
            self.tree[i] = now

    def _tightest(self, need: int) -> int | None:
        """The least capacity of at least ``need`` that some open window has."""
        i = need + self.size
        if self.tree[i]:
            return need
        while i > 1:
            if not i & 1 and self.tree[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None

    def place(self, length: int) -> tuple[int, int]:
        """(window's number, offset in it)"""
        room = self._tightest(length)
        if room is None:
            number, room = self.made, self.window
            self.made += 1
        else:
            number = self.open[room].pop()
            if not self.open[room]:
                self._mark(room, 0)
        if left := room - length:
            self.open[left].append(number)
            if len(self.open[left]) == 1:
                self._mark(left, 1)
        return number, self.window - room


def cut(docs: DataFrame, vocabulary: str, ranks: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, and its ids if asked for."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, ranks, pattern)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.array([end], "<u4"))
                for start in range(0, len(ids), window):
                    part = ids[start : start + window]
                    rows.append((doc, start, len(part), zlib.crc32(part.tobytes()), len(ids), *([part.astype("i4")] * with_ids)))
                if len(rows) >= 10_000 or with_ids and len(rows) >= 500:
                    yield to_batch(rows)
                    rows = []
            if rows:
                yield to_batch(rows)

    def to_batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 5 + [pa.list_(pa.int32())] * with_ids
        return pa.RecordBatch.from_arrays([pa.array(list(col), kind) for col, kind in zip(zip(*rows), kinds)], names=names)

    return long_rows(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(pieces, schema)


def pack_pieces(pieces: DataFrame, window: int = WINDOW, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """All pieces (with doc_id, start and length of at most ``window``) with sequence_id and offset added."""
    groups = max(1, -(-pieces.count() // group_pieces))
    at = pieces.columns.index("length")
    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, first = BestFit(window), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [fit.place(n) for n in batch.column(at).to_pylist()]
            numbers = pa.array([first + n for n, _ in placed], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, numbers, pa.array([x for _, x in placed], pa.int64())], names=[*batch.schema.names, "sequence_id", "offset"])

    dealt = pieces.repartition(groups, F.xxhash64("doc_id", "start"))
    return dealt.sortWithinPartitions(F.desc("length"), "doc_id", "start").mapInArrow(fill, schema)


def pack(docs: DataFrame, vocabulary: str, ranks: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end: int = END, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row a piece with its place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return pack_pieces(durable(cut(docs, vocabulary, ranks, pattern, id_col, text_col, window, end)), window, group_pieces)


def sequences(docs: DataFrame, vocabulary: str, ranks: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end: int = END, pad: int = 0, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """The packed windows themselves: sequence_id, ids (of length ``window``), doc_ids and used (ids that are not padding)."""
    placed = pack_pieces(durable(cut(docs, vocabulary, ranks, pattern, id_col, text_col, window, end, with_ids=True)), window, group_pieces)
    rows = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("parts"), F.sum("length").alias("used"))
    ids = F.flatten(F.col("parts.ids"))
    return rows.select("sequence_id", F.concat(ids, F.array_repeat(F.lit(pad), (F.lit(window) - F.col("used")).cast("int"))).alias("ids"), F.col("parts.doc_id").alias("doc_ids"), "used")
