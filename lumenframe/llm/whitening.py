"""Embedding whitening by hierarchical SVD merging.

Vectors are scaled to whole numbers, x = floor(256 c), and each distinct one counts once.
A task reduces its vectors, a batch at a time, to a state: how many they are, their
sums, and all singular values and right singular vectors of the centred rows. Two states
merge into one: their scaled vectors are stacked, with one row more that corrects for the
difference of the means, and decomposed again. No dimension is dropped at any step, so
the last state has the singular values of all centred rows: their squares over n are the
eigenvalues of the covariance, and its vectors the eigenvectors.

Scale: distinct vectors are combined before the shuffle that makes them unique, so copies cost
nothing, and are written once as a table of small numbers. A state has at most d rows of d
numbers, whatever it stands for; states merge ``FAN`` at a time in a tree of tasks, and the
driver gets one state for each length of vector. Whitening is a narrow pass over all rows.

Edge cases: vectors that are null or hold null or non-finite entries are dropped; vectors of
different lengths are fitted apart, each length with its own list; empty vectors have no
components, so the query has no row of them; components of no variance (constant
dimensions, fewer distinct vectors than dimensions) have a null ``whitened``; rows of a null id and repeated
rows are kept; entries beyond 2**42 in size count as that; a ``deviation`` that no long holds is
null; an empty table gives an empty result; extra columns pass through ``whiten``, and
those named like an added column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import durable, keep_row, stored, unpack

SCALE = 256
#: Bound of a scaled entry, so that a batch's sums fit a long.
MOST = 1 << 50
#: Rows decomposed together, and states merged by one task.
BATCH = 4096
FAN = 8
TOP = 4
STATE = "node long, dim int, n long, sums array<decimal(38,0)>, values array<double>, vectors array<double>"


@dataclass
class State:
    """What is kept of n vectors: their exact sums, and the decomposition of the centred rows."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def decompose(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and right singular vectors, all of them."""
    return np.linalg.svd(rows, full_matrices=False)[1:]


def state_of(rows: np.ndarray) -> State:
    """Of whole numbers, one vector a row."""
    sums = [int(s) for s in rows.sum(0)]
    mean = np.array([s / len(rows) for s in sums])
    return State(len(rows), sums, *decompose(rows - mean))


def merge(a: State, b: State) -> State:
    """The state of both sets: stacked scaled vectors, and a row for the difference of the means."""
    between = np.sqrt(a.n / (a.n + b.n) * b.n) * (a.mean - b.mean)
    rows = np.concatenate([a.values[:, None] * a.vectors, b.values[:, None] * b.vectors, between[None]])
    return State(a.n + b.n, [x + y for x, y in zip(a.sums, b.sums)], *decompose(rows))


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length that a column of arrays has: positions in it, and their arrays as rows."""
    offsets = column.offsets.to_numpy()
    values, sizes = column.values.to_numpy(zero_copy_only=False), np.diff(offsets)
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield at, values[offsets[at][:, None] + np.arange(d)]


def to_batch(node: int, states: dict[int, State]) -> pa.RecordBatch:
    rows = [(node, d, s.n, [Decimal(x) for x in s.sums], s.values, s.vectors.ravel()) for d, s in states.items()]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.decimal128(38, 0)), pa.list_(pa.float64()), pa.list_(pa.float64())]
    names = ["node", "dim", "n", "sums", "values", "vectors"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)


def from_row(row: dict) -> State:
    return State(row["n"], [int(x) for x in row["sums"]], np.array(row["values"]), np.array(row["vectors"]).reshape(-1, row["dim"]))


def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's vectors to one state for each length."""
    states: dict[int, State] = {}
    for batch in batches:
        for _, rows in matrices(batch.column(0)):
            for i in range(0, len(rows), BATCH):
                own, d = state_of(rows[i : i + BATCH]), rows.shape[1]
                states[d] = merge(states[d], own) if d in states else own
    yield to_batch(TaskContext.get().partitionId(), states)


def merge_group(table: pa.Table) -> pa.Table:
    rows = table.sort_by("node").to_pylist()
    state = from_row(rows[0])
    for row in rows[1:]:
        state = merge(state, from_row(row))
    return pa.Table.from_batches([to_batch(rows[0]["node"] // FAN, {rows[0]["dim"]: state})])


@dataclass
class Whitening:
    """Of the vectors of one length. ``components``: unit eigenvectors as rows, by falling variance; ``variances``: of all of them."""

    n: int
    sums: list[int]
    mean: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    identity_error: float = 0.0

    @classmethod
    def of(cls, state: State, top: int) -> Whitening:
        variances = state.values**2 / state.n
        noise = state.values[0] * max(state.n, len(state.sums)) * np.finfo(float).eps if len(state.values) else 0.0
        variances[state.values <= noise] = 0.0
        dim = len(state.sums)
        vectors = np.zeros((min(top, dim), dim))
        found = state.vectors[:top]
        vectors[: len(found)] = found * np.sign(found[np.arange(len(found)), np.abs(found).argmax(1)])[:, None]
        return cls(state.n, state.sums, state.mean, vectors, np.append(variances, np.zeros(dim - len(variances))))

    @property
    def explained(self) -> np.ndarray:
        return self.variances[: len(self.components)] / (self.variances.sum() or 1.0)

    def whiten(self, rows: np.ndarray) -> np.ndarray:
        """Centred, projected and scaled; NaN for components without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(self.variances > 0, 1 / np.sqrt(self.variances), np.nan)[: len(self.components)]
        return (rows - self.mean) @ self.components.T * scale

    def deviation(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of (n x - S)**2, exact, and whether a long holds them."""
        if self.n * int(np.abs(rows).max(initial=0)) + max(map(abs, self.sums), default=0) < 1 << 62:
            from_mean = rows * self.n - np.array(self.sums, np.int64)
            # whole numbers below 2**63 are exact in 64 bits of mantissa
            out = (from_mean.astype(np.longdouble) ** 2).sum(1)
            fits = out < np.longdouble(2) ** 63
            return np.where(fits, out, 0).astype(np.int64), fits
        exact = [sum((int(x) * self.n - s) ** 2 for x, s in zip(row, self.sums)) for row in rows]
        return np.array([x if x < 1 << 63 else 0 for x in exact], np.int64), np.array([x < 1 << 63 for x in exact], bool)


def scaled(vector: str | Column) -> Column:
    """floor(256 c) of each entry, as longs."""
    return F.transform(vector, lambda c: F.greatest(F.least(F.floor(c.cast("double") * SCALE), F.lit(MOST)), F.lit(-MOST)))


def complete(vector: str | Column) -> Column:
    """Neither null nor with an entry that is null, infinite or not a number."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))), F.lit(False))


def fit(table: DataFrame, vector_col: str = "embedding", top: int = TOP) -> dict[int, Whitening]:
    """The whitening of the distinct scaled vectors, by their length."""
    vector = F.col(f"`{vector_col}`")
    distinct = stored(table.where(complete(vector) & (F.size(vector) > 0)).select(scaled(vector).alias("x")).distinct())
    states = durable(distinct.mapInArrow(reduce_rows, STATE))
    nodes = (states.agg(F.max("node")).head()[0] or 0) + 1
    while nodes > 1:
        states = states.groupBy("dim", F.floor(F.col("node") / FAN).alias("parent")).applyInArrow(merge_group, STATE)
        nodes = -(-nodes // FAN)
    found = {r["dim"]: Whitening.of(from_row(r.asDict()), top) for r in states.toLocalIterator()}
    for d, error in identity_errors(distinct, found).items():
        found[d].identity_error = error
    return found


def identity_errors(distinct: DataFrame, found: dict[int, Whitening]) -> dict[int, float]:
    """By length: the largest absolute entry of the whitened vectors' covariance minus the identity."""
    shared = distinct.sparkSession.sparkContext.broadcast(found)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, rows in matrices(batch.column(0)):
                w = np.nan_to_num(shared.value[rows.shape[1]].whiten(rows))
                w = np.concatenate([w, np.ones((len(w), 1))], 1)
                total[rows.shape[1]] = total.get(rows.shape[1], 0) + w.T @ w
        cells = [(d, i, j, x) for d, m in total.items() for (i, j), x in np.ndenumerate(m)]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*cells) if cells else [[]] * 4, [pa.int32()] * 3 + [pa.float64()])], names=["dim", "i", "j", "x"])

    out = {}
    rows = distinct.mapInArrow(products, "dim int, i int, j int, x double").groupBy("dim", "i", "j").agg(F.sum("x").alias("x")).collect()
    for d, w in found.items():
        k = len(w.components)
        m = np.zeros((k + 1, k + 1))
        for r in rows:
            if r["dim"] == d:
                m[r["i"], r["j"]] = r["x"] / w.n
        off = m[:k, :k] - np.outer(m[k, :k], m[k, :k]) - np.eye(k)
        some = np.flatnonzero(w.variances[:k] > 0)
        out[d] = float(np.abs(off[np.ix_(some, some)]).max(initial=0.0))
    return out


def whiten(table: DataFrame, model: dict[int, Whitening], vector_col: str = "embedding") -> DataFrame:
    """The rows with a complete vector, with n, deviation, identity_error and components (component, whitened, explained) added."""
    kind = StructType.fromDDL("n long, deviation long, identity_error double, components array<struct<component:int,whitened:double,explained:double>>")
    shared = table.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.num_rows
            n, deviation, fits, error, parts = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, bool), np.zeros(size), [[] for _ in range(size)]
            for at, rows in matrices(batch.column(1)):
                if (w := shared.value.get(rows.shape[1])) is None:
                    fits[at] = True
                    continue
                n[at], error[at] = w.n, w.identity_error
                deviation[at], fits[at] = w.deviation(rows)
                shares = [float(x) for x in w.explained]
                for i, values in zip(at, w.whiten(rows).tolist()):
                    parts[i] = [(k + 1, v if v == v else None, x) for k, (v, x) in enumerate(zip(values, shares))]
            cells = pa.array(parts, pa.list_(pa.struct([("component", pa.int32()), ("whitened", pa.float64()), ("explained", pa.float64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(deviation, mask=~fits), pa.array(error), cells], names=["_row", *kind.names])

    vector = F.col(f"_row.`{vector_col}`")
    rows = keep_row(table).where(complete(vector)).select("_row", scaled(vector).alias("_x"))
    schema = StructType([StructField("_row", rows.schema["_row"].dataType), *kind])
    return unpack(rows.mapInArrow(run, schema), table.columns, {c: F.col(c) for c in kind.names})
