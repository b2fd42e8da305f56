"""Toxicity by multiple-instance learning.

A text is a bag of sentences, and only texts have labels. A sentence's score is logistic in
its features: which words and which character n-grams of its words (with their edges)
it has, hashed. A text is toxic unless all of its sentences are harmless and no chance
says otherwise, a noisy-or: 1 - (1 - leak) * product of (1 - sentence's score). The loss of
the text's label reaches each sentence through that product, so that training decides which
sentences are to blame, and scoring says where they are. The leak, a small constant, bounds what a
label can do that no sentence explains.

Learning is gradient descent over all sampled texts at once, with steps by feature (AdaGrad). Weights
are not negative, and a penalty on their size leaves those at zero that fewer than ``PENALTY`` texts
speak for; each pass takes in the features that some more speak for. The result does not depend on the
order of rows.

Scale: features of at most ``sample`` labelled rows, those with the least digests of their ids among
texts of up to ``MOST_BYTES`` bytes, are made by the executors; one task learns from them, and the
driver gets weights alone, whose number is fixed. Scoring is a narrow pass over whole texts.

Edge cases: null and empty texts, and those without words, have no sentences and get the leak as
score; without labelled rows no feature counts; labels other than 0 and 1 are
ignored; ids with contradicting labels count as label 1; repeated rows get equal scores; extra columns pass
through, and those named like an added column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from .common import keep_row, long_rows, unpack
from .textbatch import Chunk, Hashes, chunks, with_columns

BITS = 18
GRAMS = (3, 4, 5)
SAMPLE = 4000
MOST_BYTES = 1 << 18
PASSES = 3
ROUNDS = 60
RATE = 1.0
PENALTY = 0.25
#: Pairs of sentence and feature handled together in learning.
PAIRS = 1 << 20
CUT = 0.5
#: The chance that a text is toxic for no sentence of it, and the log odds of a sentence before learning.
LEAK = 0.01
START_BIAS = -6.0

_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?\n")] = True
#: Bytes of words: ASCII letters and digits, and all of other scripts.
_WORD = np.zeros(256, bool)
_WORD[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
_WORD[128:] = True
_BLANK = 32


@dataclass
class Bags:
    """A chunk's sentences that have words, and the features of each (with repeats): ``of`` is a sentence's number."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    of: np.ndarray
    features: np.ndarray


def bags(chunk: Chunk, bits: int = BITS, wanted: np.ndarray | None = None) -> Bags:
    """Sentences end at a full stop, an exclamation or question mark or a line feed; ``start`` and ``end`` are positions in the chunk.

    With ``wanted``, features that it does not mark are left out.
    """
    data = chunk.lower().data
    word = _WORD[data]
    # general punctuation, U+2000 to U+207F, in UTF-8
    marks = np.flatnonzero((data[:-2] == 0xE2) & ((data[1:-1] & 0xFE) == 0x80))
    for k in range(3):
        word[marks + k] = False
    plain = np.where(word, data, _BLANK).astype(np.uint8)
    edge = np.diff(word.view(np.int8))
    starts, ends = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    stops = np.flatnonzero(_ENDS[data])
    number, first = np.unique(np.searchsorted(stops, starts), return_index=True)

    hashes, shift = Hashes(plain), np.uint64(64 - bits)
    inside = np.concatenate([[0], np.cumsum(~word)])
    chars = np.append(np.flatnonzero((plain & 0xC0) != 0x80), len(data))
    found, places = [], []
    for n in (0, *GRAMS):
        lo, hi = (starts, ends) if n == 0 else (chars[:-n], chars[n:])
        if n:
            # only the first and the last character may be an edge
            whole = inside[chars[n - 1 : -1]] == inside[chars[1 : len(lo) + 1]]
            lo, hi = lo[whole], hi[whole]
        feature = (hashes.of(lo, hi) >> shift).astype(np.int64)
        if wanted is not None:
            some = np.flatnonzero(wanted[feature])
            feature, lo = feature[some], lo[some]
        found.append(feature)
        places.append(lo + (plain[lo] == _BLANK))
    place, feature = np.concatenate(places), np.concatenate(found)
    of = np.searchsorted(number, np.searchsorted(stops, place))
    return Bags(np.searchsorted(chunk.start, starts[first], "right") - 1, starts[first], stops[number], of, feature)


def distinct(of: np.ndarray, features: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The pairs, each once."""
    keys = np.unique(of.astype(np.int64) << bits | features)
    return keys >> bits, keys & ((1 << bits) - 1)


def softplus(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0) + np.log1p(np.exp(-np.abs(x)))


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    leak: float

    def sentences(self, chunk: Chunk) -> tuple[Bags, np.ndarray]:
        """The sentences of a chunk and their log odds."""
        bits = len(self.weights).bit_length() - 1
        own = bags(chunk, bits, self.weights != 0)
        of, features = distinct(own.of, own.features, bits)
        return own, self.bias + np.bincount(of, weights=self.weights[features], minlength=len(own.text))

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.empty(len(texts))
        for c in chunks(texts):
            own, odds = self.sentences(c)
            harmless = np.bincount(own.text, weights=-softplus(odds), minlength=len(c.start))
            out[c.first : c.first + len(harmless)] = harmless + np.log1p(-self.leak)
        return -np.expm1(out)


def blame(odds: np.ndarray, text_of: np.ndarray, toxic: np.ndarray, leak: float = LEAK) -> np.ndarray:
    """How the loss of its text grows with the log odds of each sentence."""
    with np.errstate(over="ignore"):
        harmless = np.bincount(text_of, weights=-softplus(odds), minlength=len(toxic)) + np.log1p(-leak)
        factor = np.where(toxic, -1 / np.expm1(-harmless), 1.0)
        return factor[text_of] / (1 + np.exp(-odds))


def train(labels: np.ndarray, text_of: np.ndarray, of: np.ndarray, features: np.ndarray, bits: int = BITS, passes: int = PASSES, rounds: int = ROUNDS, rate: float = RATE, penalty: float = PENALTY) -> Model:
    """``labels`` by text; ``text_of``: the text of each sentence; ``of`` and ``features``: pairs of sentence and feature, each once."""
    size = 1 << bits
    weights, bias = np.zeros(size), START_BIAS
    if not len(labels):
        return Model(weights, bias, LEAK)
    toxic = labels == 1
    seen = 1e-8
    for _ in range(rounds):  # first without features, so that none is moved by what all texts share
        slope = blame(np.full(len(text_of), bias), text_of, toxic).sum()
        seen += slope**2
        bias -= rate / np.sqrt(seen) * slope
    for _ in range(passes):
        parts = [slice(i, i + PAIRS) for i in range(0, len(of), PAIRS)]
        odds, slope = np.full(len(text_of), bias), np.zeros(size)
        for part in parts:
            odds += np.bincount(of[part], weights=weights[features[part]], minlength=len(text_of))
        by_sentence = blame(odds, text_of, toxic)
        for part in parts:
            slope += np.bincount(features[part], weights=by_sentence[of[part]], minlength=size)
        active = np.flatnonzero((weights > 0) | (-slope > penalty))
        number = np.full(size, -1, np.int32)
        number[active] = np.arange(len(active))
        some = np.flatnonzero(number[features] >= 0)
        row, column = of[some], number[features[some]]
        w, seen, seen_bias = weights[active], np.full(len(active), 1e-8), 1e-8
        for _ in range(rounds):
            by_sentence = blame(bias + np.bincount(row, weights=w[column], minlength=len(text_of)), text_of, toxic)
            slope = np.bincount(column, weights=by_sentence[row], minlength=len(active)) + penalty
            seen += slope**2
            w = np.maximum(w - rate / np.sqrt(seen) * slope, 0)
            slope = by_sentence.sum()
            seen_bias += slope**2
            bias -= rate / np.sqrt(seen_bias) * slope
        weights[active] = w
    return Model(weights, float(bias), LEAK)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, **settings) -> Model:
    """Learn from a bounded sample of the labelled rows given."""
    bits = settings.get("bits", BITS)
    rows = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("label"))
    rows = rows.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    short = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).where(F.octet_length("text") <= MOST_BYTES)
    found = short.join(F.broadcast(rows), "_id").select(F.xxhash64("_id").alias("h1"), F.xxhash64("text").alias("h2"), "label", "text")
    names = ["h1", "h2", "label", "of", "features"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(3).to_pylist()):
                pairs = [distinct(own.of, own.features, bits) for own in (bags(c, bits) for c in chunks([text]))]
                cells = [x.astype(np.int32) for x in pairs[0]]
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(i, 1) for k in range(3)] + [pa.array([x], pa.list_(pa.int32())) for x in cells], names=names)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, text_of, of, features, sentences = [], [], [], [], 0
        for batch in batches:
            for label, own, found in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4)):
                own, found = own.values.to_numpy(), found.values.to_numpy()
                count = int(own.max(initial=-1)) + 1
                text_of.append(np.full(count, len(marks), np.int32))
                of.append(own + sentences)
                features.append(found)
                marks.append(label)
                sentences += count
        whole = [np.concatenate(x) if x else np.zeros(0, np.int32) for x in (text_of, of, features)]
        model = train(np.array(marks, np.int32), *whole, **settings)
        some = np.flatnonzero(model.weights)
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (some, model.weights[some], model.bias, model.leak)], names=["place", "weight", "bias", "leak"])

    made = long_rows(found).mapInArrow(make, "h1 long, h2 long, label int, of array<int>, features array<int>")
    made = made.orderBy("h1", "h2").limit(sample)
    # coalesce: an empty sample has no partition
    row = made.coalesce(1).mapInArrow(learn, "place array<long>, weight array<double>, bias double, leak double").head()
    if row is None:
        return train(*[np.zeros(0, np.int64)] * 4, **settings)
    weights = np.zeros(1 << bits)
    weights[row["place"]] = row["weight"]
    return Model(weights, row["bias"], row["leak"])


def rate(docs: DataFrame, model: Model, text_col: str = "text", cut: float = CUT) -> DataFrame:
    """All rows with score (0 to 1) and predicted (1 if the score is at least ``cut``) added."""
    added = StructType([StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def work(texts):
            score = shared.value.score(texts)
            return [score, (score >= cut).astype(np.int32)]

        return work

    return with_columns(docs, text_col, added, make)


def offending(docs: DataFrame, model: Model, text_col: str = "text", cut: float = CUT) -> DataFrame:
    """A row for each sentence whose score is at least ``cut``: all columns, and sentence (its text), sentence_start (in characters) and sentence_score."""
    added = StructType([StructField("sentence", StringType()), StructField("sentence_start", LongType()), StructField("sentence_score", DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    floor = np.log(cut / (1 - cut))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1).to_pylist()):
                own, odds = shared.value.sentences(c)
                bad = np.flatnonzero(odds >= floor)
                if not len(bad):
                    continue
                chars = np.concatenate([[0], np.cumsum((c.data & 0xC0) != 0x80)])
                text = own.text[bad]
                said = [bytes(c.data[a : b + 1]).decode("utf-8", "replace").strip() for a, b in zip(own.start[bad], own.end[bad])]
                at = chars[own.start[bad]] - chars[c.start[text]]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text + c.first)), pa.array(said), pa.array(at), pa.array(1 / (1 + np.exp(-odds[bad])))], names=["_row", *added.names])

    rows = long_rows(keep_row(docs).select("_row", F.col(f"_row.`{text_col}`").alias("_text")))
    found = rows.mapInArrow(find, StructType([StructField("_row", rows.schema["_row"].dataType), *added]))
    return unpack(found, docs.columns, {c: F.col(c) for c in added.names})
