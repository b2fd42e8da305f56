"""Embedding near-duplicates: a forest of random-projection trees with spill.

A tree splits the vectors again and again at the median of a random projection;
those within a margin of the cut go to both sides. Near vectors fall apart in one
tree, but hardly in all. Within a leaf all pairs are compared by cosine in double
precision, so that every link is verified and only recall is approximate.

The trees are learned on the driver from at most ``sample`` vectors, those with the
least digests, and every vector is sent down them. A leaf of more than ``unit_rows``
vectors is dealt into blocks by a digest, and each pair of blocks is a unit of its own,
so that all pairs of the leaf still meet and no task holds a whole hot leaf. A unit of
more than ``leaf_rows`` vectors is split on in its task, in the same way as a tree, before
any are compared; the parts are the places where vectors meet. A split is made only
where it spares comparisons: within a dense ball most vectors lie near any cut, both
sides would get nearly all of them, and the ball stays whole.

Scale: equal vectors are one class, with its number of copies, before anything else.
A compared row carries the places that its vector visits, so that a pair is counted in
the first place where it meets and in no other: places return a count and a local
component for each vector, never pairs, however dense a ball of near vectors is. A
task holds a unit, about ``unit_rows`` vectors, and compares it in blocks of rows; only
beyond ``MOST_BLOCKS`` blocks (51 million distinct vectors in one leaf) do units grow. A
ball that no cut divides costs the square of its distinct vectors in comparisons.
Components are formed from one edge a vector and place.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite values link
with nothing, as do vectors of different lengths; rows of a null id link with
nothing and have a null component; repeated rows are copies of each other; an empty table gives an
empty result; extra columns do not matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable
from .components import components

COSINE = 0.95
TREES = 6
LEAF_ROWS = 512
SPILL = 0.5
SAMPLE = 20_000
SAMPLE_VALUES = 4_000_000
SEED = 3
BLOCK = 1024
#: A unit has two blocks of a hot leaf.
UNIT_ROWS = 50_000
MOST_BLOCKS = 2048
#: A split must leave at most this share of the pairs to compare.
GAIN = 0.8
#: A place is its tree, leaf, unit and part, as bits of one number.
LEAF_BITS, UNIT_BITS, PART_BITS = 20, 22, 15


@dataclass
class Tree:
    """Inner nodes: direction, cut, and children; a child below 0 is leaf -1 - child."""

    directions: list[np.ndarray] = field(default_factory=list)
    cuts: list[float] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaves: int = 0


def in_range(rows: np.ndarray) -> np.ndarray:
    """Each row times a power of two, so that no square of it is too large or too small for a double; cosines stay the same."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(1, keepdims=True, initial=0))[1])


def unit(rows: np.ndarray) -> np.ndarray:
    rows = in_range(rows)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def margin(cosine: float, spill: float, dim: int) -> float:
    """Half the width of the overlap: ``spill`` standard deviations of what a projection moves between vectors at the threshold."""
    return spill * np.sqrt(max(0.0, 2 - 2 * cosine) / dim)


def grow(rows: np.ndarray, weight: float, leaf_rows: int, gap: float, rng: np.random.Generator, least: int = 16) -> Tree:
    """A tree over unit vectors that stand for ``weight`` vectors each."""
    tree = Tree()

    def node(own: np.ndarray) -> int:
        if len(own) * weight > leaf_rows and len(own) > least:
            direction = rng.standard_normal(rows.shape[1])
            direction /= np.linalg.norm(direction)
            at = rows[own] @ direction
            cut = float(np.median(at))
            low, high = own[at <= cut + gap], own[at > cut - gap]
            if len(low) ** 2 + len(high) ** 2 < GAIN * len(own) ** 2:
                k = len(tree.cuts)
                tree.directions.append(direction)
                tree.cuts.append(cut)
                tree.children.append([0, 0])
                tree.children[k] = [node(low), node(high)]
                return k
        tree.leaves += 1
        return -tree.leaves

    if node(np.arange(len(rows))) < 0:
        tree.leaves = 1
    return tree


def visit(tree: Tree, rows: np.ndarray, gap: float) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, indices of the vectors that reach it)"""
    todo = [(0 if tree.cuts else -1, np.arange(len(rows)))]
    while todo:
        k, own = todo.pop()
        if not len(own):
            continue
        if k < 0:
            yield -1 - k, own
            continue
        at = rows[own] @ tree.directions[k]
        todo += [(tree.children[k][0], own[at <= tree.cuts[k] + gap]), (tree.children[k][1], own[at > tree.cuts[k] - gap])]


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, padded by zeros, and their lengths."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), dim))
    out[np.arange(dim) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out, sizes


def units(names: np.ndarray, blocks: int) -> Iterator[tuple[int, np.ndarray]]:
    """(unit, indices of its vectors): one for each pair of blocks, or a single one."""
    if blocks < 2:
        yield 0, np.arange(len(names))
        return
    block = (names.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % blocks
    members = [np.flatnonzero(block == b) for b in range(blocks)]
    for a in range(blocks):
        for b in range(a + 1, blocks):
            if len(own := np.concatenate([members[a], members[b]])):
                yield a * blocks + b, own


def links_in_leaf(rows: np.ndarray, sizes: np.ndarray, copies: np.ndarray, names: np.ndarray, visited: list[list[int]], place: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """For each vector of a place: copies of those that it links with and meets here first, and the least name of its component here."""
    n, rows = len(rows), in_range(rows)
    norms = np.linalg.norm(rows, axis=1)
    counts, root = np.zeros(n, np.int64), np.arange(n)
    for a in range(0, n, BLOCK):
        for b in range(a, n, BLOCK):
            x, y = np.arange(a, min(a + BLOCK, n)), np.arange(b, min(b + BLOCK, n))
            near = ((rows[x] @ rows[y].T) >= cosine * np.outer(norms[x], norms[y])) & (sizes[x][:, None] == sizes[y][None])
            if a == b:
                np.fill_diagonal(near, False)
            left, right = near.any(1), near.any(0)
            if not left.any():
                continue
            x, y, near = x[left], y[right], near[np.ix_(left, right)]
            unite(root, x, y, near)
            near &= ~met_before(visited, x, y, place)
            counts[x] += near @ copies[y]
            if a != b:
                counts[y] += near.T @ copies[x]
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, root, names)
    return counts, least[root]


def unite(root: np.ndarray, x: np.ndarray, y: np.ndarray, near: np.ndarray) -> None:
    """Join the components that near pairs connect; ``root`` holds the least member of each."""
    while True:
        apart = near & (root[x][:, None] != root[y][None])
        some = np.flatnonzero(apart.any(1))
        if not len(some):
            return
        u, v = root[x[some]], root[y[apart[some].argmax(1)]]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while not np.array_equal(up := root[root], root):
            root[:] = up


def met_before(places: list[list[int]], x: np.ndarray, y: np.ndarray, here: int) -> np.ndarray:
    """Whether each pair shares a place that comes before ``here``."""
    earlier = [[k for k in places[i] if k < here] for i in (*x, *y)]
    number = {k: j for j, k in enumerate(sorted({k for own in earlier for k in own}))}
    there = np.zeros((len(earlier), len(number)), np.float32)
    for i, own in enumerate(earlier):
        there[i, [number[k] for k in own]] = 1
    return there[: len(x)] @ there[len(x) :].T > 0


def valid(vector: str) -> Column:
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, trees: int = TREES, leaf_rows: int = LEAF_ROWS, spill: float = SPILL, sample: int = SAMPLE, unit_rows: int = UNIT_ROWS) -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept."""
    every = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    rows = every.select("vec_id", "v", (valid("v") & F.col("vec_id").isNotNull()).alias("ok"), F.xxhash64("v").alias("h1"), F.xxhash64(F.lit("other"), "v").alias("h2"))
    classes = durable(rows.where("ok").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v")))
    facts = classes.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).head()
    dim = facts["dim"] or 1
    most = max(1, min(sample, SAMPLE_VALUES // dim))
    # Digests are uniform: the least ones lie below a bound, so that few rows leave each partition.
    share = min(1.0, (2 * most + 1000) / max(1, facts["n"]))
    low = classes if share == 1 else classes.where(F.col("h1") < int(share * 2**64) - 2**63)
    chosen = low.orderBy("h1", "h2").limit(most).select("v").toPandas()["v"]
    gap = margin(cosine, spill, dim)
    known = unit(np.array([np.pad(np.asarray(v, float), (0, dim - len(v))) for v in chosen])) if len(chosen) else np.zeros((0, dim))
    rng = np.random.default_rng(SEED)
    sc = table.sparkSession.sparkContext
    forest = sc.broadcast([grow(known, facts["n"] / max(1, len(known)), leaf_rows, gap, rng) for _ in range(trees)])

    def leaves(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        vectors = unit(matrix(batch.column(1), dim)[0])
        for t, tree in enumerate(forest.value):
            for leaf, own in visit(tree, vectors, gap):
                yield t << LEAF_BITS | leaf, own

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, int] = {}
        for batch in batches:
            for code, own in leaves(batch):
                found[code] = found.get(code, 0) + len(own)
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.int64())], names=["code", "n"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                names, who, units_of = batch.column(0).to_numpy(), [], []
                for code, own in leaves(batch):
                    for k, part in units(names[own], blocks.value.get(code, 1)):
                        who.append(own[part])
                        units_of.append(np.full(len(part), code << UNIT_BITS | k, np.int64))
                if who:
                    take = batch.take(pa.array(np.concatenate(who)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(units_of)), take.column(0), take.column(1)], names=["unit", "rep", "v"])

    def split(rows: pa.Table) -> pa.Table:
        """The places of a unit: itself, or the leaves of a tree of its own if it holds too many."""
        rows = rows.combine_chunks().sort_by("rep")
        names, code = rows["rep"].to_numpy(), rows["unit"][0].as_py()
        parts = [(0, np.arange(len(names)))]
        if len(names) > leaf_rows:
            vectors = unit(matrix(rows["v"], dim)[0])
            parts = list(visit(grow(vectors, 1.0, leaf_rows, gap, np.random.default_rng([SEED, code])), vectors, gap))
        own = np.concatenate([x for _, x in parts])
        return pa.table({"rep": names[own], "place": np.repeat([code << PART_BITS | k for k, _ in parts], [len(x) for _, x in parts])})

    def compare(leaf: pa.Table) -> pa.Table:
        leaf = leaf.combine_chunks().sort_by("rep")
        vectors, sizes = matrix(leaf["v"], dim)
        names, place = leaf["rep"].to_numpy(), leaf["place"][0].as_py()
        counts, least = links_in_leaf(vectors, sizes, leaf["copies"].to_numpy(), names, leaf["visited"].to_pylist(), place, cosine)
        some = np.flatnonzero((counts > 0) | (least != names))
        return pa.table({"rep": names[some], "links": counts[some], "least": least[some]}, schema=pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("least", pa.int64())]))

    kind = classes.schema["v"].dataType.simpleString()
    narrow = classes.select("rep", "v")
    # One row a leaf too large, and leaves are bounded by the sample; a forest learned from all vectors has none but dense ones.
    large = narrow.mapInArrow(measure, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).where(F.col("n") > unit_rows).collect()
    blocks = sc.broadcast({r["code"]: min(MOST_BLOCKS, -(-2 * r["n"] // unit_rows)) for r in large})
    routed = narrow.mapInArrow(route, f"unit long, rep long, v {kind}")
    visits = routed.groupBy("unit").applyInArrow(split, "rep long, place long").groupBy("rep").agg(F.sort_array(F.collect_list("place")).alias("places"))
    each = classes.select("rep", "copies", "v").join(visits, "rep").select("rep", "copies", "v", "places", F.posexplode("places").alias("at", "place"))
    each = each.select("place", "rep", "copies", "v", F.slice("places", F.lit(1), F.col("at") + 1).alias("visited"))
    found = durable(each.groupBy("place").applyInArrow(compare, "rep long, links long, least long"))
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("rep").alias("a"), F.col("least").alias("b")))
    per_class = (
        classes.select("h1", "h2", "rep", "copies").join(linked, "rep", "left").join(groups, F.col("rep") == F.col("node"), "left")
        .select("h1", "h2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component"), F.lit(True).alias("ok"))
    )
    joined = rows.select("vec_id", "ok", "h1", "h2").join(per_class, ["ok", "h1", "h2"], "left")
    component = F.coalesce("component", "vec_id")
    return joined.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
