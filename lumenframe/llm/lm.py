"""Language-model scoring by online logistic context mixing.

A text is its words (ASCII lower case) and one end token. Each token is coded in binary
decisions. First, where the hash of the two tokens before it has a candidate (the
token that followed it most), one decision says whether that is it. If not, its
bytes follow, each along the path of a Huffman tree, so that frequent bytes take few
decisions. Every byte decision is predicted by several hashed contexts inside the token
(the last one, two and four bytes, and all of them), each with the log odds of the
bits counted there; a weight set, gated by which contexts have been seen and whether
the token begins, mixes them in the logistic domain. The candidate's decision is
predicted by the odds of its slot, under weights gated by how often that was seen.

What is learned online: the candidate's weights take a gradient step after every block
of TOKENS_A_BLOCK tokens of a text, each text from the shared start. Experts compete with
posterior weights that follow the text block by block: sharper and flatter variants
of the mix, the unigram model with the rest spelled out where a token holds no slot,
both behind the candidate's decision, the unigram model without it, and eight even
bits a byte. The weight sets of byte decisions stay as learned while a text is scored,
so that each distinct token is spelled once a batch.

The start is learned by online steps over a held-out share of the training texts: those
whose digest falls into one of FOLD parts, whatever their length, equal rows once. They are
dealt into groups of about GROUP_TEXTS; each group learns for itself, against
counts of the other texts, and weights are averaged by use. After that, tables count
all training texts. The sum of the decisions' costs is the text's bits; divided by its
bytes, bits per byte.

The base score is a smoothed unigram model over the same tokens.

Scale: one pass counts tokens and one followers of the training texts. Pairs of a
context and its follower are combined a bounded number at a time in a task, shuffled in
packed blocks, and summed over the corpus before any is compared or dropped, in parts
whose number grows with the tokens. Bit counts come from the distinct tokens alone.
Context tables, candidates, and the most frequent token of each of 2**SLOT_BITS slots
have fixed sizes; they are collected and broadcast. Base counts of tokens that hold no
slot are joined exactly. No text reaches the driver. Batches, chunks and partitions
change sums in their last digits only.

Edge cases: null and empty texts are one end token; without training texts counts are
0 and every decision costs about one bit; texts of null id are scored, and learned from
as the caller's flag says; repeated rows count each; an empty table gives an empty
result; extra columns do not matter, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, long_rows
from .textbatch import Chunk, Hashes, chunks, mix, segment_sums

SLOT_BITS = 20
FOLLOW_BITS = 18
CONTEXTS = (("two", 2, 18), ("three", 3, 20), ("five", 5, 21), ("all", 255, 22))
OFFSETS = np.cumsum([0] + [1 << b for _, _, b in CONTEXTS])
BLOCK = 1024
#: Follower slots are dealt out in 2**PART_BITS parts; a task combines about so many pairs before it hands them on.
PART_BITS, PAIRS = 12, 1 << 20
#: One of FOLD parts of the training texts teaches the weights, in groups of about so many texts.
FOLD, GROUP_TEXTS = 24, 250
PRIOR = 0.4
SCALE = 12.0
TEMPERATURES = (0.75, 1.0, 1.3)
SHARE = 0.02
TOKENS_A_BLOCK = 64
#: Step of the candidate's weights after a block, and what is added to the decisions that it is divided by.
STEP, CALM = 0.5, 4.0
CHUNK_BYTES = 1 << 20
END = np.uint64(0x5DEECE66D1234567)

#: Rough counts of bytes in text, for the shape of the code tree only; bytes not named count 1.
FREQUENT = dict(zip(b" etaoinsrhldcumfpgwybvkxjqz", [1900, 1240, 930, 800, 770, 730, 700, 650, 600, 500, 420, 390, 290, 280, 250, 230, 200, 190, 180, 160, 150, 110, 60, 30, 20, 15, 12])) | dict(zip(b".,\xc3!\n", [120, 90, 300, 20, 60]))


def code_tree() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each byte: the length of its code, its nodes and its bits."""
    heap = [(FREQUENT.get(s, 1), s, s) for s in range(256)]
    heapq.heapify(heap)
    made, children = 256, {}
    while len(heap) > 1:
        (n, _, a), (m, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        children[made] = (a, b)
        heapq.heappush(heap, (n + m, made, made))
        made += 1
    length, nodes, bits = np.zeros(256, np.int32), np.zeros((256, 64), np.int32), np.zeros((256, 64), np.int8)

    todo: list[tuple[int, list[tuple[int, int]]]] = [(heap[0][2], [])]
    while todo:
        k, path = todo.pop()
        if k < 256:
            length[k] = len(path)
            nodes[k, : len(path)], bits[k, : len(path)] = [x for x, _ in path], [x for _, x in path]
        else:
            todo += [(child, [*path, (k, bit)]) for bit, child in enumerate(children[k])]
    return length, nodes[:, : length.max()], bits[:, : length.max()]


LENGTH, NODES, BITS = code_tree()


def tokens(chunk: Chunk) -> tuple[Chunk, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-case chunk; starts, ends, hashes and texts of its tokens; the end token of a text stands at its bound."""
    chunk = chunk.lower()
    starts, ends, text = chunk.words()
    h = chunk.hashes().of(starts, ends)
    starts, ends, h = np.concatenate([starts, chunk.end]), np.concatenate([ends, chunk.end]), np.concatenate([h, np.full(len(chunk.end), END)])
    text = np.concatenate([text, np.arange(len(chunk.end))])
    order = np.argsort(text, kind="stable")
    return chunk, starts[order], ends[order], h[order], text[order]


def before(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Follower slots: a hash of the two tokens before each, in its text."""
    prev = np.concatenate([[np.uint64(0)], h[:-1]]) * np.concatenate([[False], text[1:] == text[:-1]])[: len(h)].astype(np.uint64)
    prev2 = np.concatenate([np.zeros(min(2, len(h)), np.uint64), h[:-2]]) * np.concatenate([np.zeros(min(2, len(h)), bool), text[2:] == text[:-2]]).astype(np.uint64)
    with np.errstate(over="ignore"):
        return (mix(prev * np.uint64(3) + mix(prev2 + np.uint64(7))) >> np.uint64(64 - FOLLOW_BITS)).astype(np.int64)


def stream(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens' bytes, each token with a closing blank (a line feed alone for the end token), and where each begins (with a final bound)."""
    length = ends - starts + 1
    bounds = np.concatenate([[0], np.cumsum(length)])
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - starts, length)
    out = data[np.minimum(at, len(data) - 1)]
    out[bounds[1:] - 1] = np.where(length == 1, 10, 32)
    return out, bounds


class Decisions:
    """All decisions of some tokens, one depth of the code tree after the other."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds = data, bounds
        begin = np.repeat(bounds[:-1], np.diff(bounds))
        at, hashes = np.arange(len(data)), Hashes(data)
        self.first = at == begin
        self.contexts = [hashes.of(np.maximum(begin, at - n), at) + np.uint64(k) for k, (_, n, _) in enumerate(CONTEXTS)]

    def __iter__(self) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
        """(positions, slots in the joined tables by context, bits)"""
        alive = np.arange(len(self.data))
        for depth in range(NODES.shape[1]):
            alive = alive[LENGTH[self.data[alive]] > depth]
            if not len(alive):
                return
            symbol = self.data[alive]
            node = NODES[symbol, depth].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            slots = []
            with np.errstate(over="ignore"):
                for (_, _, bits), offset, context in zip(CONTEXTS, OFFSETS, self.contexts):
                    slots.append((((context[alive] ^ node) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)).astype(np.int64) + offset)
            yield alive, slots, BITS[symbol, depth]


#: Bounds of how often a context slot was seen, by which weight sets are gated.
SEEN = (1, 3, 10, 50, 400)
GATES = 2 * (len(SEEN) + 1) ** 2 * 3


def gate(level: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Number of the weight set: by whether the token begins, and how often the three longest contexts were seen."""
    steps = len(SEEN) + 1
    return ((first * np.int64(steps) + level[-1]) * steps + level[-2]) * 3 + np.minimum(level[-3] // 2, 2)


def slot_values(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Log odds, and above them how often the slot was seen, in 16 bits."""
    level = np.searchsorted(np.array(SEEN), ones + zeros, "right").astype(np.int16)
    return (level << 8) | (log_odds(ones, zeros).astype(np.int16) & 255)


def looked_up(table: np.ndarray, slots: list[np.ndarray] | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds and levels as ``slot_values`` packed them."""
    found = table[np.asarray(slots)]
    return (found & 255).astype(np.uint8).view(np.int8).astype(np.float32) / np.float32(SCALE), (found >> 8).astype(np.int64)


@dataclass
class Model:
    table: np.ndarray
    followers: np.ndarray
    follow_odds: np.ndarray
    weights: np.ndarray
    follow_weights: np.ndarray

    def mixed(self, slots: list[np.ndarray], first: np.ndarray) -> np.ndarray:
        odds, level = looked_up(self.table, slots)
        g = gate(level, first)
        return (self.weights[:-1, g] * odds).sum(0) + self.weights[-1, g]

    def token_bits(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Bits of each token by expert, when it is spelled out."""
        symbols, bounds = stream(data, starts, ends)
        decisions = Decisions(symbols, bounds)
        cost = np.zeros((len(symbols), len(TEMPERATURES)), np.float32)
        for at, slots, bits in decisions:
            z = self.mixed(slots, decisions.first[at]) * (1 - 2 * bits).astype(np.float32)
            for m, t in enumerate(TEMPERATURES):
                cost[at, m] += np.logaddexp(0, t * z)
        by_token = segment_sums(cost, bounds[:-1], bounds[1:]) / np.log(2)
        return np.concatenate([by_token, 8.0 * np.diff(bounds)[:, None]], 1)

    def candidates(self, h: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each token: whether its slot has a candidate, whether that is it, the slot's log odds and its weight set."""
        slots = before(h, text)
        guess = self.followers[slots]
        odds, level = looked_up(self.follow_odds, slots)
        return guess != 0, (guess != 0) & (guess == h), odds.astype(np.float64), level


def blockwise(spelled: np.ndarray, base: np.ndarray, flags: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], weights: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Bits of each text (tokens start:end, at least one).

    ``spelled``: bits of each token by spelling expert, the last one even bits; ``base``:
    bits under the unigram model, with what it leaves to spelling; ``flags``: ``candidates``.
    Experts' posterior weights and each text's candidate weights move after every block.
    """
    there, hit, odds, level = flags
    plain, sets = np.stack([spelled[:, -1], base], 1), len(weights)
    behind = np.concatenate([spelled[:, :-1], base[:, None]], 1)
    experts = plain.shape[1] + behind.shape[1]
    blocks = -(-(end - start) // TOKENS_A_BLOCK)
    order = np.argsort(-blocks, kind="stable")
    weight = np.full((len(start), experts), -np.log2(experts))
    own = np.repeat(weights[None], len(start), 0)
    total = np.zeros(len(start))
    for j in range(int(blocks.max(initial=0))):
        who = order[: int(np.searchsorted(-blocks[order], -j, "left"))]
        lo = start[who] + j * TOKENS_A_BLOCK
        length = np.minimum(lo + TOKENS_A_BLOCK, end[who]) - lo
        first = np.cumsum(length) - length
        at = np.arange(length.sum()) + np.repeat(lo - first, length)
        doc = np.repeat(who, length)
        z = own[doc, level[at], 0] * odds[at] + own[doc, level[at], 1]
        flag = np.where(there[at], np.logaddexp(0, np.where(hit[at], -z, z)) / np.log(2), 0)
        cost = np.concatenate([flag[:, None] + np.where(hit[at][:, None], 0, behind[at]), plain[at]], 1)
        joint = weight[who] - np.add.reduceat(cost, first, axis=0)
        top = joint.max(1, keepdims=True)
        each = np.exp2(joint - top)
        whole = each.sum(1, keepdims=True)
        total[who] -= (top + np.log2(whole))[:, 0]
        weight[who] = np.log2((1 - SHARE) * each / whole + SHARE / experts)
        if j + 1 < blocks.max():
            cell = doc * sets + level[at]
            gap = np.where(there[at], hit[at] - 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0)
            calm = STEP / (np.bincount(cell, there[at], len(start) * sets) + CALM)
            own[..., 0] += (calm * np.bincount(cell, gap * odds[at], len(start) * sets)).reshape(-1, sets)
            own[..., 1] += (calm * np.bincount(cell, gap, len(start) * sets)).reshape(-1, sets)
    return total


def log_odds(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(SCALE * np.log((ones + PRIOR) / (zeros + PRIOR))), -127, 127).astype(np.int8)


def gathered(docs: DataFrame) -> DataFrame:
    """(text, held) rows -> tokens: key hash, word, n in all, m in texts that aren't held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(1).to_numpy(zero_copy_only=False)
            for c in chunks(batch.column(0).to_pylist(), CHUNK_BYTES):
                low, starts, ends, h, text = tokens(c)
                found, at, where, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                m = np.bincount(where, ~held[c.first + text], len(found)).astype(np.int64)
                data = low.data.tobytes()
                words = [data[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())]
                columns = [pa.array(found.view(np.int64)), pa.array(words, pa.binary()), pa.array(n.astype(np.int64)), pa.array(m)]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "word", "n", "m"])

    found = docs.select("text", "held").mapInArrow(run, "key long, word binary, n long, m long")
    return durable(found.groupBy("key", "word").agg(F.sum("n").alias("n"), F.sum("m").alias("m")))


def ranks(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words in order, and each word's place among them."""
    order = np.argsort(word)
    new = np.diff(word[order], prepend=word[order[:1]]) != 0
    place = np.empty(len(word), np.int64)
    place[order] = np.cumsum(new)
    return word[order[np.concatenate([[True], new[1:]])[: len(word)]]], place


def summed(slot: np.ndarray, word: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct (slot, word) in order, and the sums of the counts. Plain numbers sort much faster than two keys."""
    words, place = ranks(word)
    key = slot.astype(np.int64) * len(words) + place
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    at = order[first]
    return slot[at], word[at], *(np.add.reduceat(n[order], first) if len(first) else n for n in counts)


def commonest(slot_first: np.ndarray, word: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Of each slot, whose rows begin at ``slot_first``, the word of most hits (then of the greater hash as text), its hits, its place among equals, and all hits."""
    most = np.maximum.reduceat(n, slot_first)
    place = (word.byteswap() ^ np.uint64(1 << 63)).view(np.int64)
    tied = n == np.repeat(most, np.diff(np.append(slot_first, len(n))))
    top = np.maximum.reduceat(np.where(tied, place, np.iinfo(np.int64).min), slot_first)
    return [(top.view(np.uint64) ^ np.uint64(1 << 63)).byteswap().view(np.int64), most, top, np.add.reduceat(n, slot_first)]


def followed(docs: DataFrame, in_all: int) -> DataFrame:
    """Of each follower slot: key slot, word the commonest follower's hash, n its hits, m the hits of all; word0, n0 and m0 the same without the texts held out (``held``).

    Every pair counts, however batches fall. ``in_all``: tokens of the corpus, from which
    the number of parts follows, so that a part holds about PAIRS of them. A part has some slots and, of their
    followers, those with some first bits of the hash: the followers of a slot that is met all the time, such as the start
    of a text, are dealt over 2**word_bits parts, whose commonest are compared in the end.
    """
    all_bits = max(PART_BITS, int(in_all // PAIRS).bit_length())
    part_bits = min(FOLLOW_BITS, all_bits - all_bits // 4)
    word_bits = all_bits - part_bits
    within = FOLLOW_BITS - part_bits

    def packed(pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        slot, word, held = (np.concatenate(x) for x in zip(*pairs))
        words, place = ranks(word)
        part = (slot >> within << word_bits) | (word >> np.uint64(64 - word_bits) if word_bits else np.zeros(len(word), np.uint64)).astype(np.int64)
        # one number that sorts by part, slot and word, its last bit whether the text is held out
        key = np.sort((((part << within | slot & ((1 << within) - 1)) * len(words) + place) << 1) | held)
        first = np.flatnonzero(np.concatenate([[True], key[1:] >> 1 != key[:-1] >> 1]))
        n = np.diff(np.append(first, len(key)))
        m = n - np.add.reduceat(key & 1, first)
        key, place = np.divmod(key[first] >> 1, len(words))
        part, slot, word = key >> within, key & ((1 << within) - 1), words[place]
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        bounds = np.append(cuts, len(slot))
        blob = lambda x: pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer((bounds * x.itemsize).astype(np.int32)), pa.py_buffer(x)])
        columns = [pa.array(part[cuts]), blob(slot.astype(np.uint32)), blob(word), blob(n.astype(np.uint32)), blob(m.astype(np.uint32))]
        return pa.RecordBatch.from_arrays(columns, names=["part", "slot", "word", "n", "m"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, size = [], 0
        for batch in batches:
            held = batch.column(1).to_numpy(zero_copy_only=False)
            for c in chunks(batch.column(0).to_pylist(), CHUNK_BYTES):
                _, _, _, h, text = tokens(c)
                pairs.append((before(h, text), h, held[c.first + text]))
                size += len(h)
                if size >= PAIRS:
                    yield packed(pairs)
                    pairs, size = [], 0
        if size:
            yield packed(pairs)

    def best(rows: pa.Table) -> pa.Table:
        whole = lambda name, kind: np.frombuffer(b"".join(rows[name].to_pylist()), kind)
        slot, word, n, m = summed(whole("slot", np.uint32), whole("word", np.uint64), *(whole(x, np.uint32).astype(np.int64) for x in "nm"))
        first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        key = (rows["part"][0].as_py() >> word_bits << within) | slot[first].astype(np.int64)
        return pa.Table.from_arrays([pa.array(x) for x in (key, *commonest(first, word, n), *commonest(first, word, m))], names=["key", "word", "n", "place", "m", "word0", "n0", "place0", "m0"])

    pairs = docs.select("text", "held").mapInArrow(run, "part long, slot binary, word binary, n binary, m binary")
    parts = pairs.groupBy("part").applyInArrow(best, "key long, word long, n long, place long, m long, word0 long, n0 long, place0 long, m0 long")
    top = lambda k: F.max(F.struct(f"n{k}", f"place{k}", f"word{k}")).alias(f"top{k}")
    slots = parts.groupBy("key").agg(top(""), F.sum("m").alias("m"), top("0"), F.sum("m0").alias("m0"))
    return durable(slots.select("key", "top.word", "top.n", "m", "top0.word0", "top0.n0", "m0"))


def add_counts(cells: np.ndarray, words: list[bytes], n: np.ndarray) -> None:
    """Count the bits of tokens that occur n times each, in pairs of cells (zeros, ones)."""
    length = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(length + 1) - 1
    data, bounds = stream(np.frombuffer(b" ".join(words) + b" ", np.uint8), ends - length, ends)
    each = np.repeat(n.astype(np.float64), np.diff(bounds))
    for place, slots, bits in Decisions(data, bounds):
        for s in slots:
            np.add.at(cells, 2 * s + bits, each[place])


def bit_table(vocabulary: DataFrame, count_col: str) -> np.ndarray:
    """Log odds of the bits counted in every slot of the context tables, from (word, ``count_col``)."""
    size = int(OFFSETS[-1])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((size, 2))
        for whole in batches:
            for at in range(0, whole.num_rows, 50_000):
                batch = whole.slice(at, 50_000)
                add_counts(cells.reshape(-1), batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False))
        blocks = cells.reshape(-1, 2 * BLOCK)
        used = np.flatnonzero(blocks.any(1))
        for i in range(0, len(used), 256):
            part = used[i : i + 256]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([blocks[k].tobytes() for k in part], pa.binary())], names=["block", "cells"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[k] = sums.get(k, 0) + np.frombuffer(v, np.float64)
        if sums:
            cells = [slot_values(x[1::2], x[::2]).tobytes() for x in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(cells, pa.binary())], names=["block", "cells"])

    few = vocabulary.sparkSession.sparkContext.defaultParallelism
    rows = vocabulary.where(F.col(count_col) > 0).select("word", count_col).coalesce(few).mapInArrow(count, "block int, cells binary")
    table = np.zeros((size // BLOCK, BLOCK), np.int16)
    for row in rows.repartition("block").mapInArrow(total, "block int, cells binary").toLocalIterator():
        table[row["block"]] = np.frombuffer(row["cells"], np.int16)
    return table.reshape(-1)


def dense(rows: DataFrame, size: int) -> np.ndarray:
    """Rows of a slot and some whole numbers, one row a slot, as one array a number; they arrive in blocks, not row by row."""
    width = len(rows.columns) - 1

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            slot, *numbers = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
            order = np.argsort(slot, kind="stable")
            cuts = np.flatnonzero(np.diff(slot[order] // BLOCK, prepend=-1))
            for part in np.split(order, cuts[1:]) if len(order) else ():
                block = held.setdefault(int(slot[part[0]]) // BLOCK, np.zeros((width, BLOCK), np.int64))
                block[:, slot[part] % BLOCK] = [x[part] for x in numbers]
        keys = list(held)
        for i in range(0, len(keys), 64):
            part = keys[i : i + 64]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([held[k].tobytes() for k in part], pa.binary())], names=["block", "cells"])

    out = np.zeros((width, max(1, size // BLOCK), BLOCK), np.int64)
    dealt = rows.repartition(F.floor(F.col(rows.columns[0]) / BLOCK))
    for row in dealt.mapInArrow(gather, "block long, cells binary").toLocalIterator():
        out[:, row["block"]] = np.frombuffer(row["cells"], np.int64).reshape(width, BLOCK)
    return out.reshape(width, -1)[:, :size]


def follower_tables(found: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Of each slot (key, word, n, m) the commonest follower's hash, if it was seen more than once in all, and as ``slot_values`` how often it follows."""
    followers, n, m = dense(found.where("n > 1").select(F.col("key").alias("slot"), "word", "n", "m"), 1 << FOLLOW_BITS)
    return followers.view(np.uint64), slot_values(n.astype(float), (m - n).astype(float))


def sgd(w: np.ndarray, power: np.ndarray, x: np.ndarray, s: np.ndarray, y: np.ndarray, rate: float) -> None:
    """One step of the weight sets ``w`` (inputs by sets) over decisions: inputs x, set s, bit y."""
    gap = y - 1 / (1 + np.exp(-np.clip((w[:, s] * x).sum(0), -30, 30)))
    slope = np.stack([np.bincount(s, gap * x[d], w.shape[1]) for d in range(len(w))])
    power += slope * slope
    w += rate * slope / np.sqrt(power)


def learned(model: Model, texts: list[str], rounds: int = 2, rate: float = 0.05, step: int = 512, chunk_bytes: int = 1 << 17) -> list[tuple[np.ndarray, np.ndarray]]:
    """Weights after online gradient steps over the texts, a chunk of them at a time, and how often each set was used: of byte decisions and of candidates."""
    rng = np.random.default_rng(7)
    w, a = model.weights.astype(np.float64), model.follow_weights.T.copy()
    power, follow_power = np.full(w.shape, 1e-3), np.full(a.shape, 1e-3)
    used, follow_used = np.zeros(w.shape[1], np.int64), np.zeros(a.shape[1], np.int64)
    for r in range(rounds):
        for c in chunks(texts, chunk_bytes):
            low, starts, ends, h, text = tokens(c)
            there, hit, x, level = model.candidates(h, text)
            some = np.flatnonzero(there)
            for k in np.split(some, range(step, len(some), step)) if len(some) else ():
                sgd(a, follow_power, np.stack([x[k], np.ones(len(k))]), level[k], hit[k], rate)
            spelled = np.flatnonzero(~hit)
            decisions = Decisions(*stream(low.data, starts[spelled], ends[spelled]))
            odds, gates, bits = [np.zeros((len(CONTEXTS), 0), np.float32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int8)]
            for at, where, bit in decisions:
                found, seen = looked_up(model.table, where)
                odds.append(found)
                gates.append(gate(seen, decisions.first[at]))
                bits.append(bit)
            o, g, y = np.concatenate(odds, 1), np.concatenate(gates), np.concatenate(bits).astype(np.float64)
            if not r:
                used += np.bincount(g, minlength=len(used))
                follow_used += np.bincount(level[some], minlength=len(follow_used))
            order = rng.permutation(len(g))
            for k in np.split(order, range(step, len(order), step)) if len(order) else ():
                sgd(w, power, np.concatenate([o[:, k], np.ones((1, len(k)), np.float32)]), g[k], y[k], rate)
    return [(w, used), (a, follow_used)]


def learn_weights(model: Model, texts: DataFrame) -> None:
    """Set the start weights of ``model`` from the (text, digest) rows held out: groups learn apart, their weights are averaged by use."""
    groups = max(1, -(-texts.count() // GROUP_TEXTS))
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("digest", "ascending")])
        out = [np.concatenate([(w * used).ravel(), used.astype(float)]) for w, used in learned(shared.value, group["text"].to_pylist())]
        flat = np.concatenate(out)
        return pa.table({"k": np.arange(len(flat)), "v": flat})

    dealt = texts.select(F.coalesce("text", F.lit("")).alias("text"), "digest", F.pmod(F.shiftrightunsigned("digest", 8), F.lit(groups)).alias("part"))
    found = dealt.groupBy("part").applyInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    shared.destroy()
    if not found:
        return
    flat = np.zeros(len(found))
    flat[[r["k"] for r in found]] = [r["v"] for r in found]
    cut = model.weights.size + model.weights.shape[1]
    for part, start in ((flat[:cut], model.weights), (flat[cut:], model.follow_weights.T)):
        used = part[start.size :]
        start[:, used > 0] = part[: start.size].reshape(start.shape)[:, used > 0] / used[used > 0]


@dataclass
class Slots:
    """Of each slot the most frequent token: its hash, its base log10 probability, and its bits by expert when spelled out."""

    keys: np.ndarray
    base: np.ndarray
    bits: np.ndarray


def slot_table(vocabulary: DataFrame, model: Model, bottom: float) -> Slots:
    slot = F.shiftrightunsigned("key", 64 - SLOT_BITS)
    held = vocabulary.groupBy(slot.alias("slot")).agg(F.max(F.struct("n", "key", "word")).alias("top")).select("slot", "top.key", "top.n", "top.word")
    shared = vocabulary.sparkSession.sparkContext.broadcast(model)

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 20_000):
                batch = whole.slice(at, 20_000)
                words = batch.column(3).to_pylist()
                length = np.array([len(w) for w in words], np.int64)
                ends = np.cumsum(length + 1) - 1
                bits = shared.value.token_bits(np.frombuffer(b" ".join(words) + b" ", np.uint8), ends - length, ends)
                packed = np.ascontiguousarray(bits, np.float32).view(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(packed[:, 0]), pa.array(packed[:, 1])], names=["slot", "key", "n", "b1", "b2"])

    keys, n, *bits = dense(held.mapInArrow(spelled, "slot long, key long, n long, b1 long, b2 long"), 1 << SLOT_BITS)
    return Slots(keys, np.log10((n + 0.5) / bottom), np.ascontiguousarray(np.stack(bits, 1)).view(np.float32))


def fit(docs: DataFrame, learn: Column) -> tuple[Model, DataFrame]:
    """The model of the (id, text) rows where ``learn`` holds, and their (key, word, n): tokens' hashes, bytes and counts."""
    digest = F.xxhash64("id", "text")
    taught = docs.where(learn).select("text", digest.alias("digest"), (F.pmod(digest, F.lit(FOLD)) == 0).alias("held"))
    vocabulary = gathered(taught)
    in_all = vocabulary.agg(F.sum("n")).head()[0] or 0
    pairs = followed(taught, in_all)
    contexts = len(CONTEXTS)
    weights = np.full((contexts + 1, GATES), 1.0 / contexts, np.float32)
    weights[-1] = 0
    without = pairs.select("key", F.col("word0").alias("word"), F.col("n0").alias("n"), F.col("m0").alias("m"))
    model = Model(bit_table(vocabulary, "m"), *follower_tables(without), weights, np.tile([1.0, 0.0], (len(SEEN) + 1, 1)))
    learn_weights(model, taught.where("held").select("text", "digest").dropDuplicates(["digest"]))
    return Model(bit_table(vocabulary, "n"), *follower_tables(pairs), model.weights, model.follow_weights), vocabulary.select("key", "word", "n")


def score(table: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a text: doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    docs = long_rows(table).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), learn.alias("learn"))
    model, counts = fit(docs, F.coalesce("learn", F.lit(False)))
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).head()
    n_all, bottom = int(sums["n"]), max(0.5, float(sums["n"]) + 0.5 * (sums["v"] + 1))
    shared = table.sparkSession.sparkContext.broadcast((model, slot_table(counts, model, bottom)))
    counts = counts.select("key", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, top = shared.value
        number = TaskContext.get().partitionId() << 34
        for batch in batches:
            ids = batch.column(0)
            for c in chunks(batch.column(1).to_pylist(), CHUNK_BYTES):
                low, starts, ends, h, text = tokens(c)
                lo, hi = np.searchsorted(text, np.arange(len(c.start))), np.searchsorted(text, np.arange(len(c.start)), "right")
                found, at, where = np.unique(h, return_index=True, return_inverse=True)
                at_slot = (found >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
                own = top.keys[at_slot] == found.view(np.int64)
                spelled = top.bits[at_slot].astype(np.float64)
                spelled[~own] = mine.token_bits(low.data, starts[at[~own]], ends[at[~own]])
                new = np.log2(bottom / 0.5) + spelled[:, 1]
                base = np.where(own, -top.base[at_slot] * np.log2(10), new)
                total = blockwise(spelled[where], base[where], mine.candidates(h, text), mine.follow_weights, lo, hi)
                known = own[where]
                sure = segment_sums(np.where(known, top.base[at_slot][where], 0.0), lo, hi)
                n_sure = segment_sums(known.astype(np.float64), lo, hi)
                rest = np.flatnonzero(~known)
                pair = np.unique(np.stack([text[rest], where[rest]], 1), axis=0, return_counts=True) if len(rest) else (np.zeros((0, 2), int), np.zeros(0, int))
                cuts = np.searchsorted(pair[0][:, 0], np.arange(len(c.start) + 1))
                tail, times = found.view(np.int64)[pair[0][:, 1]], pair[1].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(number + np.arange(len(lo))), ids.slice(c.first, len(lo)), pa.array((hi - lo).astype(np.int64)), pa.array(n_sure.astype(np.int64)), pa.array(sure),
                        pa.array(-total * np.log10(2)), pa.array(total / np.maximum(c.end - c.start, 1)),
                        pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(tail)), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(times)),
                    ],
                    names=["row", "id", "n_tokens", "n_sure", "sure", "score", "bits_per_byte", "tail", "times"],
                )
                number += len(lo)

    scored = durable(docs.select("id", "text").mapInArrow(run, "row long, id long, n_tokens long, n_sure long, sure double, score double, bits_per_byte double, tail array<long>, times array<int>"))
    part = lambda n: F.log10((n + 0.5) / F.lit(bottom))
    rest = scored.select("row", F.inline(F.arrays_zip(F.col("tail").alias("key"), F.col("times").alias("times")))).toDF("row", "key", "times")
    n = F.coalesce("n", F.lit(0))
    rest = rest.join(counts, "key", "left").groupBy("row").agg(F.sum(F.col("times") * part(n)).alias("more"), F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("n_more"))
    out = scored.drop("tail", "times").join(rest, "row", "left")
    zero = F.lit(0)
    return out.select(
        F.col("id").alias("doc_id"), "n_tokens", (F.col("n_sure") + F.coalesce("n_more", zero)).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("sure") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score", "bits_per_byte",
    )
