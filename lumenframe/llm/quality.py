"""Quality classifier: supervised subword embeddings.

A text is a bag of features: its words and the character n-grams of its words (with
their edges), hashed, and a mark for each word that repeats the one before. Each feature
has a learned vector; the mean of a text's vectors goes through a softmax over the two
labels. Vectors and output weights are learned together by stochastic gradient
descent in numpy.

Scale: the model is learned in one task from at most ``sample`` labelled rows, those with
the least digests of their ids: executors make their features, from whole texts, and the task gets
those. The driver gets the model alone. Its size is fixed. Since the output is linear in the mean, scoring needs one number a feature:
a narrow pass over whole texts, in Arrow batches, without a shuffle.

Edge cases: null and empty texts have no features and get the model's bias as score;
without labelled rows every score is 0.5; labels other than 0 and 1 are ignored; ids
with contradicting labels count as label 0; repeated rows get equal scores; extra
columns pass through, and those named like an added column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import long_rows
from .textbatch import _SPACE, Chunk, chunks, segment_sums, with_columns

BITS = 17
DIM = 8
GRAMS = (3, 4, 5)
SAMPLE = 3000
EPOCHS = 8
LEAST_STEPS = 20_000
RATE = 0.4
REACH = 1000.0
CUT = 0.3
SEED = 11


def folds(id_col: Column, n: int) -> Column:
    """crc32 of the id's text, modulo n."""
    return F.crc32(id_col.cast("string").cast("binary")) % n


def features(chunk: Chunk, bits: int = BITS) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Feature numbers and the positions that they begin at, by kind; the mark has the number after all hashes."""
    data, hashes, shift = chunk.data, chunk.hashes(), np.uint64(64 - bits)
    starts, ends, text = chunk.words()
    h = hashes.of(starts, ends)
    twice = np.flatnonzero((h[1:] == h[:-1]) & (text[1:] == text[:-1])) + 1
    numbers, places = [(h >> shift).astype(np.int32), np.full(len(twice), 1 << bits, np.int32)], [starts, starts[twice]]
    blank = np.concatenate([[0], np.cumsum(_SPACE[data])])
    chars = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    for n in GRAMS:
        lo, hi = chars[:-n], chars[n:]
        inner = blank[chars[n - 1 : -1]] == blank[chars[1 : len(lo) + 1]]  # only the first and the last character may be an edge
        lo, hi = lo[inner], hi[inner]
        numbers.append((hashes.of(lo, hi) >> shift).astype(np.int32))
        places.append(lo)
    return numbers, places


@dataclass
class Model:
    worth: np.ndarray
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.empty(len(texts))
        for c in chunks(texts):
            total, count = np.zeros(len(c.start)), np.zeros(len(c.start))
            for numbers, places in zip(*features(c)):
                lo, hi = np.searchsorted(places, c.start - 1), np.searchsorted(places, c.end)
                total += segment_sums(self.worth[numbers], lo, hi)
                count += hi - lo
            out[c.first : c.first + len(total)] = total / np.maximum(count, 1) + self.bias
        return 1 / (1 + np.exp(-out))


def train(texts: list[str], labels: np.ndarray, bits: int = BITS, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, reach: float = REACH, seed: int = SEED) -> Model:
    """Stochastic gradient descent, one text a step, with a falling rate.

    A vector moves by its share of the text, scaled up so that one step moves the
    mean about as far whether a text has few features or many (``reach`` at most). Few
    texts are passed more often, for ``LEAST_STEPS`` steps at least.
    """
    return train_bags([bag(text, bits) for text in texts], labels, bits, dim, epochs, rate, reach, seed)


def bag(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of a text and their shares."""
    numbers = np.concatenate([x for c in chunks([text]) for x in features(c, bits)[0]])
    found, counts = np.unique(numbers, return_counts=True)
    return found, (counts / max(1, counts.sum())).astype(np.float32)


def train_bags(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int = BITS, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, reach: float = REACH, seed: int = SEED) -> Model:
    """As ``train``, from the texts' features."""
    if not len(bags):
        return Model(np.zeros((1 << bits) + 1, np.float32), 0.0)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, ((1 << bits) + 1, dim)).astype(np.float32)
    out, bias = np.zeros((dim, 2), np.float32), np.log(np.bincount(labels, minlength=2) + 1.0).astype(np.float32)
    epochs = max(epochs, -(-LEAST_STEPS // len(bags)))
    steps, done = epochs * len(bags), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            found, share = bags[i]
            mean = share @ vectors[found]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            lr = rate * (1 - done / steps)
            back = out @ p
            out -= lr * np.outer(mean, p)
            bias -= lr * 0.1 * p
            vectors[found] -= (lr * min(reach, 0.5 / max(share @ share, 1e-6))) * np.outer(share, back)
            done += 1
    return Model(vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, **settings) -> Model:
    """Learn from a bounded sample of the labelled rows given."""
    rows = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("long").alias("_label"))
    rows = rows.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    found = texts.join(F.broadcast(rows), "_id").select(F.xxhash64("_id").alias("h1"), F.xxhash64("_text").alias("h2"), "_label", "_text")
    bits = settings.get("bits", BITS)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(3).to_pylist()):
                numbers, shares = bag(text, bits)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, 1) for k in range(3)), pa.array([numbers]), pa.array([shares])], names=["h1", "h2", "label", "numbers", "shares"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags, marks = [], []
        for batch in batches:
            bags += [(a.values.to_numpy(), b.values.to_numpy()) for a, b in zip(batch.column(3), batch.column(4))]
            marks += batch.column(2).to_pylist()
        model = train_bags(bags, np.array(marks, np.int64), **settings)
        yield pa.RecordBatch.from_arrays([pa.array([model.worth.tobytes()], pa.binary()), pa.array([model.bias])], names=["worth", "bias"])

    # whole texts become features where they lie; the learning task gets those alone
    made = long_rows(found).mapInArrow(make, "h1 long, h2 long, label long, numbers array<int>, shares array<float>").orderBy("h1", "h2").limit(sample)
    # coalesce: an empty sample has no partition
    model = made.coalesce(1).mapInArrow(learn, "worth binary, bias double").head()
    return Model(np.frombuffer(model["worth"], np.float32), model["bias"]) if model else train([], np.zeros(0, np.int64), **settings)


def rate(docs: DataFrame, model: Model, text_col: str = "text", cut: float = CUT) -> DataFrame:
    """All rows with score (0 to 1) and predicted (1 if the score is at least ``cut``) added."""
    added = StructType([StructField("score", DoubleType()), StructField("predicted", IntegerType())])

    def make():
        def work(texts):
            score = model.score(texts)
            return [score, (score >= cut).astype(np.int32)]

        return work

    return with_columns(docs, text_col, added, make)
