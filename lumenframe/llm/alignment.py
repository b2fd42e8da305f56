"""Cross-tokenizer alignment by a cogroup of postings.

A text is encoded by two tokenizers, A (byte-level BPE) and B (pieces). Byte offsets at which
tokens of both end cut them into groups; an A and a B token of one group are linked. The count of a
pair of ids is the number of documents that hold it linked.

Both tokenizers cut before a space that follows something else, so a text falls into
units there that can be encoded and aligned by themselves, with equal results (``UNSPLIT``
names the texts for which that isn't so: they are one unit). A worker remembers units that
it has met, and handles new ones of many texts together. Whether the bytes of the tokens equal those of
the text is checked for each unit.

The postings of a batch of documents, (A id, B id, document, multiplicity), are written once,
a row for each A id and batch. Counts of pairs are summed from them, and both are shuffled by A id
and sorted there: an A id's counts come first, which gives the most that any of its
pairs has, then its postings stream past and become contributions to documents, which are shuffled by the batch
that a document was in, and added up.

Scale: counts are combined before their shuffle, and an A id has no more of them than B has ids. An A
id of very many postings is dealt over several parts, each with all of its counts, so that no task gets a hot id
whole; sorting spills. A task holds one id's counts, a batch of postings, ``HELD`` contributions and about
``KNOWN`` units. Within a group, equal ids are counted before pairs are formed, in slices.

Edge cases: texts that are null or empty, and those whose tokens spell other bytes than a
space and the text, have no tokens: zeros, and an empty ``groups_sha256``; documents are rows,
so repeated rows and equal or null ids each count; an empty table gives an empty result; extra
columns pass through, and those named like an added column are replaced.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from .common import keep_row, long_rows, small_side, stored, unpack

#: Texts (after the added space) that can't be cut before each space: with runs of spaces, a space between other white space, or one at the end.
UNSPLIT = re.compile(r"  |\s \s| $")
#: Units that a worker remembers; an eighth of its pairs' number also.
KNOWN = 400_000
#: Texts aligned together.
TEXTS = 256
#: Links whose postings are sorted together, entries of one posting row, pairs formed together, and contributions held.
LINKS = 1 << 20
ROW = 4096
SLICE = 1 << 20
HELD = 1 << 20
#: An A id is dealt into parts of about this many postings, or an eighth of a task's share if that is more.
PART = 20_000
MOST_PART = 2_000_000
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
#: A pair of ids is one number below 2**PAIR_BITS: vocabularies of a million each fit.
PAIR_BITS = 40
EMPTY = np.zeros(0, np.int64)


@functools.lru_cache(maxsize=2)
def exact(vocabulary: str):
    """The tokenizer itself, which takes much memory and is seldom needed."""
    import tokenizers

    found = tokenizers.Tokenizer.from_file(vocabulary)
    found.encode_special_tokens = True
    return found


@functools.lru_cache(maxsize=2)
def encoders(vocabulary: str, ranks: str | None, pattern: str | None, pieces: str):
    """Of A and B: from a list of strings that begin with a space to lists of ids; and the bytes of each id."""
    import json

    import sentencepiece

    if ranks:
        import base64

        import tiktoken

        with open(ranks, "rb") as file:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        quick = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

        def encode_a(texts: list[str]) -> list[list[int]]:
            try:
                return [quick.encode_ordinary(x) for x in texts]
            except (ValueError, RuntimeError):
                return [exact(vocabulary).encode(x, add_special_tokens=False).ids for x in texts]
    else:

        def encode_a(texts: list[str]) -> list[list[int]]:
            return [exact(vocabulary).encode(x, add_special_tokens=False).ids for x in texts]

    # byte-level entries spell each byte as a printable character: those that are one stand for themselves, the rest follow from 256 on
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
    with open(vocabulary, encoding="utf-8") as file:
        entries = json.load(file)["model"]["vocab"]
    bytes_a = [b""] * (max(entries.values()) + 1)
    for entry, i in entries.items():
        bytes_a[i] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()

    model = sentencepiece.SentencePieceProcessor(model_file=pieces)

    def bytes_of(piece: str) -> bytes:
        spelled = re.fullmatch(r"<0x([0-9A-Fa-f]{2})>", piece)
        return bytes([int(spelled[1], 16)]) if spelled else piece.replace("▁", " ").encode()

    bytes_b = [bytes_of(model.id_to_piece(i)) for i in range(model.get_piece_size())]
    # the model adds the space that each string begins with
    return encode_a, lambda texts: model.encode([x[1:] for x in texts], num_threads=1), bytes_a, bytes_b


def pairs_of(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, size_b: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(group, pair, multiplicity) of all groups, a slice at a time; a pair is the number a * size_b + b."""
    # equal ids of a group are counted first, so that a long group isn't squared
    keys_a, times_a = np.unique(group_a << 32 | a, return_counts=True)
    keys_b, times_b = np.unique(group_b << 32 | b, return_counts=True)
    group = keys_a >> 32
    first = np.searchsorted(keys_b >> 32, group, "left")
    count = np.searchsorted(keys_b >> 32, group, "right") - first
    low = (1 << 32) - 1
    bounds = np.concatenate([[0], np.cumsum(count)])
    for start in range(0, bounds[-1], SLICE):
        at = np.arange(start, min(start + SLICE, bounds[-1]))
        i = np.searchsorted(bounds, at, "right") - 1
        j = first[i] + at - bounds[i]
        yield group[i], (keys_a[i] & low) * size_b + (keys_b[j] & low), times_a[i] * times_b[j]


def add_up(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, in order, with the sum of its times."""
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else EMPTY
    return keys[first], np.add.reduceat(times, first) if len(first) else EMPTY


class Aligner:
    """Units that have been met get numbers; by number: [n_a, n_b, n_groups, n_links], the spelled groups, and pairs from ``bounds[u]`` on."""

    def __init__(self, vocabulary: str, ranks: str | None, pattern: str | None, pieces: str):
        self.encode_a, self.encode_b, self.bytes_a, self.bytes_b = encoders(vocabulary, ranks, pattern, pieces)
        self.size_a, self.size_b = (np.array([len(x) for x in own], np.int64) for own in (self.bytes_a, self.bytes_b))
        # an id with what follows it: A's , or | and B's , or ;
        self.names = [str(i).encode() + mark for own, last in ((self.bytes_a, b"|"), (self.bytes_b, b";")) for mark in (b",", last) for i in range(len(own))]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.spelled: list[bytes | None] = []
        self.numbers, self.bounds, self.pairs, self.times = np.zeros((0, 4), np.int64), np.zeros(1, np.int64), EMPTY, EMPTY

    def learn(self, units: list[str], whole_texts: set[str]) -> None:
        """Number the units, all of them new; ``whole_texts``: those that are no unit of a split text."""
        # what can't stand in the middle of a string is encoded by itself: whole texts, and units of a space and more white space
        plain, odd = [], []
        for x in units:
            (odd if x in whole_texts or x[1:2].isspace() else plain).append(x)
        order = plain + odd
        strings = (["".join(plain)] if plain else []) + odd
        a, b = self.encode_a(strings), self.encode_b(strings)
        whole = lambda ids: np.array(list(chain.from_iterable(ids)), np.int64)
        if not self.equal("".join(strings), a, b):
            # the units whose bytes differ have no tokens, and are known as such
            strings = order
            a, b = self.encode_a(strings), self.encode_b(strings)
            right = [self.equal(x, [i], [j]) for x, i, j in zip(strings, a, b)]
            for x in [x for x, ok in zip(order, right) if not ok]:
                self.add([x], np.zeros((1, 4), np.int64), [None], np.zeros(1, np.int64), EMPTY, EMPTY)
            order, a, b = ([x for x, ok in zip(own, right) if ok] for own in (order, a, b))
        if not order:
            return
        a, b = whole(a), whole(b)
        ends = np.cumsum([len(x.encode()) for x in order])
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
        many_a, many_b = np.bincount(group_a), np.bincount(group_b)
        unit = np.searchsorted(ends, both)
        count = np.zeros((len(order), 4), np.int64)
        for k, x in enumerate((many_a, many_b, np.ones(len(both), np.int64), many_a * many_b)):
            np.add.at(count[:, k], unit, x)

        # tokens in the order in which they are spelled: a group's of A, then its of B
        before_a, before_b = np.cumsum(many_a) - many_a, np.cumsum(many_b) - many_b
        place_a, place_b = np.arange(len(a)) + before_b[group_a], np.arange(len(b)) + (before_a + many_a)[group_b]
        name = np.empty(len(a) + len(b), np.int64)
        last_a, last_b = np.append(group_a[1:] != group_a[:-1], True), np.append(group_b[1:] != group_b[:-1], True)
        name[place_a] = a + len(self.bytes_a) * last_a
        name[place_b] = b + 2 * len(self.bytes_a) + len(self.bytes_b) * last_b
        said = list(map(self.names.__getitem__, name.tolist()))
        cuts = [0, *np.cumsum(count[:, 0] + count[:, 1]).tolist()]
        spelled = [b"".join(said[i:j]) for i, j in zip(cuts, cuts[1:])]

        keys, times = EMPTY, EMPTY
        for group, pair, more in pairs_of(a, b, group_a, group_b, len(self.bytes_b)):
            keys, times = add_up(np.concatenate([keys, unit[group] << PAIR_BITS | pair]), np.concatenate([times, more]))
        self.add(order, count, spelled, np.bincount(keys >> PAIR_BITS, minlength=len(order)), keys & ((1 << PAIR_BITS) - 1), times)

    def equal(self, text: str, a: list[list[int]], b: list[list[int]]) -> bool:
        raw = text.encode()
        return all(b"".join([own[i] for i in chain.from_iterable(ids)]) == raw for own, ids in ((self.bytes_a, a), (self.bytes_b, b)))

    def add(self, units: list[str], numbers: np.ndarray, spelled: list[bytes | None], sizes: np.ndarray, pairs: np.ndarray, times: np.ndarray) -> None:
        self.known.update(zip(units, range(len(self.spelled), len(self.spelled) + len(units))))
        self.spelled += spelled
        self.numbers = np.concatenate([self.numbers, numbers])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(sizes)])
        self.pairs, self.times = np.concatenate([self.pairs, pairs]), np.concatenate([self.times, times])

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """[n_a, n_b, n_groups, n_links] and digest of each text, and (text, pair, times) of all."""
        if len(self.spelled) > KNOWN or len(self.pairs) > 8 * KNOWN:
            self.forget()
        split, whole_texts = [], set()
        for text in texts:
            if not text:
                split.append([])
            elif UNSPLIT.search(whole := " " + text):
                split.append([whole])
                whole_texts.add(whole)
            else:
                split.append([" " + x for x in text.split(" ")])
        if new := [x for x in dict.fromkeys(chain.from_iterable(split)) if x not in self.known]:
            self.learn(new, whole_texts)
        numbers, digests, used = np.zeros((len(texts), 4), np.int64), [], []
        for i, own in enumerate(split):
            own = [self.known[x] for x in own]
            said = [self.spelled[u] for u in own]
            if None in said:
                own = said = []
            digests.append(hashlib.sha256(b"".join(said)[:-1]).hexdigest() if own else "")
            used.append(np.array(own, np.int64))
            numbers[i] = self.numbers[used[-1]].sum(0)
        # a unit's pairs, for each text that has it, as often as it does
        doc = np.repeat(np.arange(len(texts)), [len(x) for x in used])
        key, often = add_up(doc * len(self.spelled) + np.concatenate([*used, EMPTY]), np.ones(len(doc), np.int64))
        doc, unit = key // max(1, len(self.spelled)), key % max(1, len(self.spelled))
        size = self.bounds[unit + 1] - self.bounds[unit]
        at = np.arange(size.sum()) + np.repeat(self.bounds[unit] - np.cumsum(size) + size, size)
        return numbers, digests, np.repeat(doc, size), self.pairs[at], self.times[at] * np.repeat(often, size)


@functools.lru_cache(maxsize=2)
def aligner_of(vocabulary: str, ranks: str | None, pattern: str | None, pieces: str) -> Aligner:
    """A worker keeps what it has met from task to task."""
    return Aligner(vocabulary, ranks, pattern, pieces)


def alignments(docs: DataFrame, vocabulary: str, ranks: str | None, pattern: str | None, pieces: str) -> DataFrame:
    """Rows of documents (row, own, numbers, sha) and of postings (base, a, b, docs, doc, times).

    ``docs``: rows of _row and _text. A document is ``row``, a number that a task gives it. A posting row
    has the B ids that are linked with ``a``, in how many documents of the batch each is, and for each of these
    in turn the document (``base`` + ``doc``) and how often.
    """
    kind = docs.schema["_row"].dataType
    schema = StructType.fromDDL("row long, n_a long, n_b long, n_groups long, n_links long, sha string, base long, a int, b array<int>, docs array<int>, doc array<int>, times array<int>")
    out = StructType([StructField("_row", kind), *schema])  # null in postings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, row = aligner_of(vocabulary, ranks, pattern, pieces), TaskContext.get().partitionId() << 33
        for batch in batches:
            first, base, links, held = row, row, 0, []
            numbers, digests = [], []
            for at in range(0, batch.num_rows, TEXTS):
                texts = batch.column(1).slice(at, TEXTS).to_pylist()
                own, shas, doc, pair, times = aligner.align(texts)
                numbers.append(own)
                digests += shas
                held.append((doc + row - base, pair, times))
                row += len(texts)
                links += len(pair)
                if links >= LINKS:
                    yield from postings(base, row - base, held, len(aligner.bytes_b))
                    base, links, held = row, 0, []
            yield from postings(base, row - base, held, len(aligner.bytes_b))
            columns = [batch.column(0), pa.array(np.arange(first, row)), *map(pa.array, np.concatenate(numbers).T), pa.array(digests, pa.string())]
            yield complete(batch.num_rows, dict(zip(out.names, columns)))

    def complete(size: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
        kinds = {"a": pa.int32(), "sha": pa.string(), "_row": arrow_kind} | {c: pa.list_(pa.int32()) for c in ("b", "docs", "doc", "times")}
        return pa.RecordBatch.from_arrays([columns.get(c, None) if c in columns else pa.nulls(size, kinds.get(c, pa.int64())) for c in out.names], names=out.names)

    def postings(base: int, size: int, held: list, size_b: int) -> Iterator[pa.RecordBatch]:
        doc, pair, times = (np.concatenate([x[k] for x in held] or [EMPTY]) for k in range(3))
        if not len(doc):
            return
        bits = size.bit_length()
        key, times = add_up(pair << bits | doc, times)
        doc, pair = key & ((1 << bits) - 1), key >> bits
        a, b = pair // size_b, pair % size_b
        # a row ends with its A id, and after ROW entries
        start = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        length = np.diff(np.append(start, len(a)))
        more = -(-length // ROW)
        start = np.repeat(start, more) + ROW * (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more))
        new_row = np.zeros(len(a), bool)
        new_row[start] = True
        run = np.flatnonzero(new_row | np.concatenate([[True], pair[1:] != pair[:-1]]))
        offsets = np.append(start, len(a)).astype(np.int32)
        run_offsets = np.searchsorted(run, offsets).astype(np.int32)
        lists = lambda at, values: pa.ListArray.from_arrays(pa.array(at), pa.array(values.astype(np.int32)))
        table = {
            "base": pa.array(np.full(len(start), base)), "a": pa.array(a[start].astype(np.int32)), "b": lists(run_offsets, b[run]),
            "docs": lists(run_offsets, np.diff(np.append(run, len(a)))), "doc": lists(offsets, doc), "times": lists(offsets, times),
        }
        yield complete(len(start), table)

    arrow_kind = to_arrow_type(kind)
    return long_rows(docs).mapInArrow(run, out)


def sums(number: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Exact sums of whole numbers by number."""
    out = np.zeros(size, np.int64)
    np.add.at(out, number, values)
    return out


def by_row(table: pa.Table) -> pa.Table:
    """The contributions of a batch's documents to (row, n_best, count_sum)."""
    row, best, total = (np.concatenate([x.values.to_numpy() for x in table[c].combine_chunks()]) for c in ("row", "n_best", "count_sum"))
    row, number = np.unique(row, return_inverse=True)
    return pa.table({"row": row, "n_best": sums(number, best, len(row)), "count_sum": sums(number, total, len(row))})


def contribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (a, part, base) to (base, row, n_best, count_sum), arrays of a batch's documents; an id's counts have a null base and come first."""
    ids, counts, most, here = None, None, 0, None
    held, size = [], 0

    def give() -> pa.RecordBatch:
        base, row, best, total = (np.concatenate([x[k] for x in held]) for k in range(4))
        row, first, number = np.unique(row, return_index=True, return_inverse=True)
        base = base[first]
        start = np.flatnonzero(np.concatenate([[True], base[1:] != base[:-1]]))
        offsets = pa.array(np.append(start, len(row)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (row, sums(number, best, len(row)), sums(number, total, len(row)))]
        return pa.RecordBatch.from_arrays([pa.array(base[start]), *lists], names=["base", "row", "n_best", "count_sum"])

    for batch in batches:
        a, part, base = batch.column("a").to_pylist(), batch.column("part").to_pylist(), batch.column("base").to_pylist()
        b, docs, doc, times = (batch.column(c) for c in ("b", "docs", "doc", "times"))
        for i in range(batch.num_rows):
            if (a[i], part[i]) != here:
                here, ids, counts, most = (a[i], part[i]), None, None, 0
            own = b[i].values.to_numpy()
            if base[i] is None:
                counts = batch.column("counts")[i].values.to_numpy()
                ids, most = own, counts.max()
                continue
            count = counts[np.searchsorted(ids, own)]
            count = np.repeat(count, docs[i].values.to_numpy())
            each = times[i].values.to_numpy().astype(np.int64)
            held.append((np.full(len(each), base[i]), base[i] + doc[i].values.to_numpy().astype(np.int64), np.where(count == most, each, 0), each * count))
            size += len(each)
            if size >= HELD:
                yield give()
                held, size = [], 0
    if held:
        yield give()


def align(docs: DataFrame, vocabulary: str, ranks: str | None, pattern: str | None, pieces: str, text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, and n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
    spark = docs.sparkSession
    rows = keep_row(docs).select("_row", F.col(f"_row.`{text_col}`").alias("_text"))
    made = stored(alignments(rows, vocabulary, ranks, pattern, pieces))
    posted = made.where("a is not null").select("a", "base", "b", "docs", "doc", "times")

    pairs = posted.select("a", F.explode(F.arrays_zip("b", "docs")).alias("x")).groupBy("a", "x.b").agg(F.sum("x.docs").alias("count"))
    by_id = pairs.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("b", "count"))).alias("x"), F.sum("count").alias("all"))
    by_id = stored(by_id.select("a", F.col("x.b").alias("b"), F.col("x.count").alias("counts"), "all"))
    total = by_id.agg(F.sum("all")).head()[0] or 0
    unit = min(max(PART, total // (8 * int(spark.conf.get("spark.sql.shuffle.partitions")))), MOST_PART)
    parts = F.ceil(F.col("all") / unit).cast("int")

    hot = small_side(by_id.where(F.col("all") > unit).select("a", parts.alias("parts")))
    dealt = posted.join(hot, "a", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("base"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
    each = by_id.select("a", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "b", "counts")
    both = dealt.unionByName(each, allowMissingColumns=True).repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("base"))
    given = both.mapInArrow(contribute, "base long, row array<long>, n_best array<long>, count_sum array<long>")
    found = given.groupBy("base").applyInArrow(by_row, "row long, n_best long, count_sum long")

    own = made.where("row is not null").join(found, "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    added = {c: F.col(c) for c in COLUMNS[:4]} | {c: zero(c) for c in COLUMNS[4:6]} | {"groups_sha256": F.col("sha")}
    return unpack(own, docs.columns, added)
