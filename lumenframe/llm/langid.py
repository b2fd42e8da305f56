"""Language identification of words in code-switched text by a linear-chain CRF.

Words are labelled by a conditional random field. A word's features are its affixes
and byte n-grams (windows of two to four bytes that may begin or end at the word's
edge), itself, and the languages whose lexicon lists it; transitions between
neighbouring words' languages are learned with them. Training maximises the
conditional likelihood with forward-backward gradients. To see switches, training
chains are strung together from stretches of texts in different languages. A text's
language is the one with the largest sum of word posteriors.

Scale: the model, of fixed size, is learned on the driver from at most ``sample``
labelled texts, all different, of at most ``sample_chars`` characters, those with the
least digests, and ``LEAST_EACH`` of every language where that is more. What the driver
holds grows with the number of languages.
Labelling is a narrow pass over whole texts in Arrow batches. Chains are lines. Those of
a batch run in step, in stretches of ``STRETCH`` words; what a stretch passes on is a small
matrix, so that messages cross its bounds exactly, while memory and time are linear in
the text, however long its lines.

Edge cases: texts that are null or without a letter (of Unicode category L) are ``und``
with score 0.0; words without a letter have no say; without labelled rows everything is ``und``; ties go
to the first language by name; repeated rows get equal results; extra columns pass
through, and those named like an added column are replaced.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from .common import durable, small_side
from .textbatch import _SPACE, Chunk, chunks, segment_sums, with_columns

BITS = 16
GRAMS = (2, 3, 4)
STRETCH = 128
SAMPLE = 480
SAMPLE_CHARS = 4_000
#: Texts that each language has in the sample at least, if there are so many.
LEAST_EACH = 3
ROUNDS = 25
RATE = 0.3
LEXICON_COUNT, LEXICON_SHARE = 3, 0.6
UNDETERMINED = "und"


def folded(chunk: Chunk) -> Chunk:
    """Lower case for ASCII and for the two-byte letters of Latin-1."""
    low = chunk.lower()
    data = low.data.copy()
    wide = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    data[wide] += 0x20
    return Chunk(chunk.first, data, chunk.start, chunk.end)


@functools.lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Of each code point, whether it is a letter."""
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool)


def letter_starts(data: np.ndarray) -> np.ndarray:
    """Of each byte of UTF-8, whether a letter begins there."""
    out = (data | 0x20) - np.uint8(97) < 26
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first = data[lead].astype(np.int64)
        more = 1 + (first >= 0xE0) + (first >= 0xF0)
        code = first & (0x3F >> more)
        for k in (1, 2, 3):
            there = more >= k
            code[there] = code[there] << 6 | (data[lead[there] + k] & 0x3F)
        out[lead] = letters()[code]
    return out


class Words:
    """The words of a chunk: where they are, their hashes, chains and features."""

    def __init__(self, chunk: Chunk, bits: int):
        chunk = folded(chunk)
        self.data, self.hashes, self.bits = chunk.data, chunk.hashes(), bits
        self.starts, self.ends, self.text = chunk.words()
        self.count = len(self.starts)
        self.hash = self.hashes.of(self.starts, self.ends)
        self._numbers = None
        found = np.concatenate([[0], np.cumsum(letter_starts(self.data))])
        self.lettered = found[self.ends] > found[self.starts]

    def places(self) -> np.ndarray:
        """The place of each word in its chain, which is a line."""
        breaks = np.concatenate([[0], np.cumsum(self.data == 10)])[self.starts]
        fresh = np.concatenate([[True], breaks[1:] != breaks[:-1]])[: self.count]
        at = np.arange(self.count)
        return at - np.maximum.accumulate(np.where(fresh, at, 0))

    def emissions(self, table: np.ndarray) -> np.ndarray:
        """Sums of the rows of ``table`` over each word's hashed features."""
        whole, grams = self.numbers()
        out = table[whole].astype(np.float64)
        for n, numbers in zip(GRAMS, grams):
            out += segment_sums(table[numbers], self.starts - 1, np.maximum(self.ends + 2 - n, self.starts - 1))
        return out

    def numbers(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """Feature numbers of the words, and of the grams at each position."""
        if self._numbers is None:
            shift = np.uint64(64 - self.bits)
            self._numbers = (self.hash >> shift).astype(np.int32), [(self.hashes.grams(n) >> shift).astype(np.int32) for n in GRAMS]
        return self._numbers

    def feature_numbers(self) -> tuple[np.ndarray, np.ndarray]:
        """(word, feature) pairs, as ``emissions`` sums them."""
        whole, grams = self.numbers()
        who, what = [np.arange(self.count)], [whole]
        for n, numbers in zip(GRAMS, grams):
            lo, hi = self.starts - 1, np.maximum(self.ends + 2 - n, self.starts - 1)
            length = hi - lo
            owner = np.repeat(np.arange(self.count), length)
            at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + lo[owner]
            who.append(owner)
            what.append(numbers[at])
        return np.concatenate(who), np.concatenate(what)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray
    lexicon: np.ndarray
    listed: np.ndarray
    lexical: np.ndarray
    transition: np.ndarray
    opening: np.ndarray
    bits: int = BITS

    def word_scores(self, words: Words) -> np.ndarray:
        out = words.emissions(self.table)
        if len(self.lexicon):
            at = np.minimum(np.searchsorted(self.lexicon, words.hash), len(self.lexicon) - 1)
            known = self.lexicon[at] == words.hash
            out[known] += self.lexical[self.listed[at[known]]]
        return out * words.lettered[:, None]

    def posteriors(self, words: Words) -> np.ndarray:
        return forward_backward(self.word_scores(words), words.places(), self.transition, self.opening)[0]


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row (or matrix) by its sum, with a floor against underflow."""
    x = x + 1e-300
    return x / x.sum(tuple(range(1, x.ndim)), keepdims=True)


def messages(emit: np.ndarray, step: np.ndarray, opening: np.ndarray, first: np.ndarray, alive: list[int], fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What reaches each stretch from before (without its first word's emission) and from behind; stretches in order of length, ``fresh``: begins a line."""
    count, k = len(first), len(step)
    before, behind = np.tile(opening, (count, 1)), np.ones((count, k))
    if fresh.all():
        return before, behind
    across = np.eye(k) * emit[first][:, None]  # from what reaches a stretch to what its last word holds
    for t in range(1, len(alive)):
        n = alive[t]
        across[:n] = scaled((across[:n] @ step) * emit[first[:n] + t][:, None])
    text_order = np.argsort(first)
    nth = np.arange(count) - np.maximum.accumulate(np.where(fresh[text_order], np.arange(count), 0))
    turns = np.split(np.argsort(nth, kind="stable"), np.cumsum(np.bincount(nth))[:-1])
    for prior, now in zip([x - 1 for x in turns[1:]], turns[1:]):
        p, q = text_order[prior], text_order[now]
        before[q] = scaled(np.einsum("si,sij->sj", before[p], across[p]) @ step)
    for prior, now in zip([x - 1 for x in turns[:0:-1]], turns[:0:-1]):
        p, q = text_order[prior], text_order[now]
        behind[p] = scaled(np.einsum("sij,sj->si", across[q], behind[q]) @ step.T)
    return before, behind


def forward_backward(scores: np.ndarray, place: np.ndarray, transition: np.ndarray, opening: np.ndarray, stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors of all words, expected transitions and expected openings; ``place``: of a word in its chain."""
    count, k = scores.shape
    if not count:
        return np.zeros((0, k)), np.zeros((k, k)), np.zeros(k)
    first = np.flatnonzero(place % stretch == 0)
    length = np.diff(np.append(first, count))
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    alive = [int(np.searchsorted(-length, -t, "left")) for t in range(int(length[0]))]  # stretches of more than t words
    emit = np.exp(scores - scores.max(1, keepdims=True))
    step = np.exp(transition - transition.max())
    before, back = messages(emit, step, np.exp(opening - opening.max()), first, alive, place[first] == 0)
    ahead, behind = np.empty_like(emit), np.empty_like(emit)
    ahead[first] = now = scaled(before * emit[first])
    for t in range(1, len(alive)):
        rows = first[: alive[t]] + t
        ahead[rows] = now = scaled((now[: alive[t]] @ step) * emit[rows])
    for t in range(len(alive) - 1, -1, -1):
        rows = first[: alive[t]] + t
        if t + 1 < len(alive):
            m = alive[t + 1]
            back[:m] = scaled((back[:m] * emit[rows[:m] + 1]) @ step.T)
        behind[rows] = back[: alive[t]]
    post = scaled(ahead * behind)
    later = np.flatnonzero(place > 0)
    here, carried = ahead[later - 1], emit[later] * behind[later]
    moves = step * ((here / np.maximum(((here @ step) * carried).sum(1, keepdims=True), 1e-300)).T @ carried)
    return post, moves, post[place == 0].sum(0)


def strung(texts: list[str], labels: np.ndarray, seed: int) -> tuple[str, list[int]]:
    """Lines that take turns of a few words among texts of different languages, and each word's label."""
    rng = np.random.default_rng(seed)
    split = [x.split() for x in texts]
    lines, out = [], []
    for i, own in enumerate(split):
        other = int(rng.integers(len(split)))
        line: list[str] = []
        for w in own:
            line.append(w)
            out.append(labels[i])
            if rng.random() < 0.04 and split[other]:
                at, n = int(rng.integers(len(split[other]))), int(rng.integers(2, 9))
                part = split[other][at : at + n]
                line += part
                out += [labels[other]] * len(part)
        lines.append(" ".join(line))
    return "\n".join(lines), out


def train(texts: list[str], names: list[str], bits: int = BITS, rounds: int = ROUNDS, rate: float = RATE, seed: int = 5) -> Model:
    """Full-batch conditional maximum likelihood with AdaGrad steps."""
    langs = sorted(set(names))
    k = len(langs)
    labels = np.array([langs.index(x) for x in names], np.int64)
    model = Model(langs, np.zeros((1 << bits, k), np.float32), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((k, k)), np.zeros((k, k)), np.zeros(k), bits)
    if k == 0:
        return model
    line, marks = strung(texts, labels, seed)
    words = Words(next(chunks([line], 1 << 62)), bits)
    truth = np.array(marks, np.int64)[: words.count]
    seen, at, counts = np.unique(words.hash, return_inverse=True, return_counts=True)
    by = np.zeros((len(seen), k))
    np.add.at(by, (at, truth), 1)
    chosen = (counts >= LEXICON_COUNT) & (by.max(1) >= LEXICON_SHARE * counts)
    model.lexicon, model.listed = seen[chosen], by.argmax(1)[chosen]
    listed = np.full(len(seen), -1)
    listed[chosen] = model.listed
    listed = listed[at]
    who, what = words.feature_numbers()
    order = np.argsort(what, kind="stable")
    who, what = who[order], what[order]
    cuts = np.flatnonzero(np.concatenate([[True], what[1:] != what[:-1]]))
    used = what[cuts]
    place = words.places()
    wanted = np.zeros((words.count, k))
    wanted[np.arange(words.count), truth] = 1
    within = np.flatnonzero(place > 0)
    moved = np.zeros((k, k))
    np.add.at(moved, (truth[within - 1], truth[within]), 1)
    opened = np.bincount(truth[place == 0], minlength=k).astype(float)
    power = [np.full((len(used), k), 1e-6), np.full((k, k), 1e-6), np.full((k, k), 1e-6), np.full(k, 1e-6)]
    for _ in range(rounds):
        post, moves, opens = forward_backward(model.word_scores(words), place, model.transition, model.opening)
        gap = (wanted - post) * words.lettered[:, None]
        grads = [np.add.reduceat(gap[who], cuts, axis=0) - 0.1 * model.table[used], np.zeros((k, k)), moved - moves - 0.1 * model.transition, opened - opens - 0.1 * model.opening]
        for lang in range(k):
            grads[1][lang] = gap[listed == lang].sum(0) - 0.1 * model.lexical[lang]
        for g, p in zip(grads, power):
            p += g * g
        model.table[used] += rate * grads[0] / np.sqrt(power[0])
        model.lexical += rate * grads[1] / np.sqrt(power[1])
        model.transition += rate * grads[2] / np.sqrt(power[2])
        model.opening += rate * grads[3] / np.sqrt(power[3])
    return model


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS, **settings) -> Model:
    """Learn from a bounded sample of the labelled texts given, spread over all languages: those with the least digests; of a long one a piece, which begins where its digest says."""
    text = F.col(text_col)
    start = F.pmod(F.xxhash64(text), F.greatest(F.length(text) - sample_chars + 1, F.lit(1))) + 1
    rows = docs.select(F.substring(text, start.cast("int"), F.lit(sample_chars)).alias("_text"), F.col(lang_col).alias("_lang"))
    rows = rows.where(F.col("_lang").isNotNull() & F.col("_text").rlike("\\p{L}")).withColumn("_digest", F.xxhash64("_text"))
    distinct = durable(rows.select("_lang", "_digest").distinct())
    each = max(LEAST_EACH, sample // max(1, distinct.select("_lang").distinct().count()))
    nth = F.row_number().over(Window.partitionBy("_lang").orderBy("_digest"))
    chosen = distinct.withColumn("_nth", nth).where(F.col("_nth") <= each).select("_lang", "_digest")
    found = rows.join(small_side(durable(chosen)), ["_lang", "_digest"]).groupBy("_lang", "_digest").agg(F.min("_text").alias("_text")).orderBy("_lang", "_digest").collect()
    return train([r["_text"] for r in found], [r["_lang"] for r in found], **settings)


def label(docs: DataFrame, model: Model, text_col: str = "text", spans: bool = False) -> DataFrame:
    """All rows with lang_pred and score added; with ``spans`` also runs of words: (start, length, lang), counted in words."""
    added = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    if spans:
        run = StructType([StructField("start", LongType()), StructField("length", LongType()), StructField("lang", StringType())])
        added = added.add(StructField("runs", ArrayType(run)))

    def make():
        import pyarrow as pa

        def work(texts):
            pred, score, runs = [UNDETERMINED] * len(texts), np.zeros(len(texts)), [[] for _ in texts] if spans else None
            for c in chunks(texts, 1 << 20) if model.langs else ():
                words = Words(c, model.bits)
                post = model.posteriors(words)
                lo = np.searchsorted(words.text, np.arange(len(c.start)))
                hi = np.searchsorted(words.text, np.arange(len(c.start)), "right")
                votes = segment_sums(post * words.lettered[:, None], lo, hi)
                best, all_votes = votes.argmax(1), votes.sum(1)
                for j in np.flatnonzero(all_votes > 0):
                    i = c.first + j
                    pred[i], score[i] = model.langs[best[j]], min(1.0, votes[j, best[j]] / all_votes[j])
                    if spans:
                        own = post[lo[j] : hi[j]].argmax(1)
                        cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                        runs[i] = [{"start": int(a), "length": int(b - a), "lang": model.langs[own[a]]} for a, b in zip(cuts, np.append(cuts[1:], len(own)))]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("lang", pa.string())]))
            return [pa.array(pred, pa.string()), score, *([pa.array(runs, kind)] if spans else [])]

        return work

    return with_columns(docs, text_col, added, make)
