"""Content fingerprints and duplicate classification against a catalog."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..durable import written
from ..functions import let

SIMILAR_SCORE = 0.9
#: Lookups of a value in all bands together.
MOST_PROBES = 20_000
#: Values are compared in blocks: in FEW_BLOCKS of at least LEAST_VALUES, or in as many of MOST_VALUES as there must be.
FEW_BLOCKS, LEAST_VALUES, MOST_VALUES = 8, 1 << 13, 1 << 17
#: Bands of so many bits are looked up in a table, and candidates spelled out about so many at a time.
TABLE_BITS, CANDIDATES = 20, 1 << 19


def fingerprints(files: DataFrame, content: str = "content") -> DataFrame:
    """With sha256 of the content; rows whose content is null are dropped."""
    return files.where(F.col(content).isNotNull()).withColumn("sha256", F.sha2(F.col(content).cast("binary"), 256))


def average_hash(pixels: Column) -> Column:
    """Hex text of the bits of 64 grey values, each 1 where it exceeds the mean; null unless there are 64."""
    grey = F.transform(pixels, lambda x: x.cast("double"))
    mean = lambda own: F.aggregate(own, F.lit(0.0), lambda acc, x: acc + x) / 64
    marks = let(grey, lambda own: let(mean(own), lambda m: F.array_join(F.transform(own, lambda x: F.when(x > m, "1").otherwise("0")), "")))
    half = lambda bits, at: F.lpad(F.lower(F.conv(F.substring(bits, at, 32), 2, 16)), 8, "0")
    return F.when(F.size(pixels) == 64, let(marks, lambda bits: F.concat(half(bits, 1), half(bits, 33))))


def within_batch(files: DataFrame) -> DataFrame:
    """status and existing_file by content alone: the first of equal files is new. Copies are aggregated, never gathered."""
    first = files.groupBy("sha256").agg(F.min_by("path", "seq").alias("_path"), F.min("seq").alias("_seq"))
    rows = files.join(first, files["sha256"].eqNullSafe(first["sha256"])).drop(first["sha256"])
    is_new = F.col("seq") == F.col("_seq")
    return rows.withColumns({"status": F.when(is_new, "new").otherwise("duplicate"), "existing_file": F.when(~is_new, F.col("_path"))}).drop("_path", "_seq")


def against_catalog(files: DataFrame, catalog: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """status, existing_file and similarity_score of files (path, mtime, size, sha256, perceptual).

    The same path and time is a duplicate of its record; without a record of equal size
    a file is new; an equal digest of equal size is a duplicate; an equal perceptual
    hash (any size) is similar; the rest is new. ``catalog``: id, source_path,
    file_mtime, file_size, sha256_hash, perceptual_hash. ``paths``: source_path and file_mtime of all files ever
    recorded, bucketed by both; without it, those of the catalog.

    Joins are by one table's key each: of a catalog that is bucketed by digest and paths bucketed by path and
    time, only distinct sizes and looks are shuffled.
    """
    seen = (catalog if paths is None else paths).groupBy(F.col("source_path").alias("path"), F.col("file_mtime").alias("mtime")).agg(F.first("source_path").alias("_seen"))
    sizes = catalog.select(F.col("file_size").alias("size"), F.lit(True).alias("_sized")).distinct()
    # a digest has one size but for collisions, so this map is small
    sized = catalog.groupBy(F.col("sha256_hash").alias("sha256"), F.col("file_size").alias("_size")).agg(F.min_by("source_path", "id").alias("_path"))
    digests = sized.where("_size is not null").groupBy("sha256").agg(F.map_from_entries(F.collect_list(F.struct("_size", "_path"))).alias("_paths"))
    looks = catalog.where("perceptual_hash is not null").groupBy(F.col("perceptual_hash").alias("perceptual")).agg(F.min_by("source_path", "id").alias("_alike"))
    rows = files.join(seen, ["path", "mtime"], "left").join(sizes, "size", "left").join(digests, "sha256", "left").join(looks, "perceptual", "left").withColumn("_same", F.try_element_at("_paths", F.col("size")))
    status = F.when(F.col("_seen").isNotNull(), "duplicate").when(F.col("_sized").isNull(), "new").when(F.col("_same").isNotNull(), "duplicate").when(F.col("_alike").isNotNull(), "similar").otherwise("new")
    existing = F.when(F.col("_seen").isNotNull(), F.col("_seen")).when(F.col("_sized").isNull(), None).otherwise(F.coalesce("_same", "_alike"))
    return rows.withColumns({"status": status, "existing_file": existing, "similarity_score": F.when(status == "similar", F.lit(SIMILAR_SCORE))}).drop("_seen", "_sized", "_same", "_alike", "_paths")


def new_files(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """Files that no record (or entry of the paths) has with the same path and time."""
    known = catalog.select(F.col("source_path").alias("path"), F.col("file_mtime").alias("mtime"))
    return files.join(known, ["path", "mtime"], "left_anti")


def duplicate_groups(files: DataFrame) -> DataFrame:
    return files.groupBy("sha256").agg(F.count("*").alias("copies"), F.min("path").alias("first_path")).where("copies > 1")


def bits64(text: Column) -> Column:
    """16 hex digits as a 64-bit number."""
    half = lambda at: F.conv(F.substring(text, at, 8), 16, 10).cast("bigint")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


def hamming(a: Column, b: Column) -> Column:
    """Bits that differ between two 16-digit hex hashes."""
    return F.bit_count(bits64(a).bitwiseXOR(bits64(b)))


def bands_of(distance: int, count: int) -> list[tuple[int, int, int]]:
    """(first bit, end, radius) of the bands in which ``count`` values are looked up.

    Cut into m bands, two values within ``distance`` bits differ in one band by at most its radius, if the radii add
    up to distance - m + 1. Fewer bands are wider, so that fewer values agree by chance, but larger radii mean
    more probes. The cut with the least of both is taken.
    """

    def cut(m: int) -> list[tuple[int, int, int]]:
        edges, spare = [64 * k // m for k in range(m + 1)], distance - m + 1
        return [(lo, hi, spare // m + (k < spare % m)) for k, (lo, hi) in enumerate(zip(edges, edges[1:]))]

    def probes(width: int, radius: int) -> int:
        return sum(comb(width, r) for r in range(radius + 1))

    def cost(bands: list[tuple[int, int, int]]) -> float:
        each = [(probes(hi - lo, r), hi - lo) for lo, hi, r in bands]
        return count * sum(n for n, _ in each) + count**2 / 2 * sum(n / 2**w for n, w in each)

    return min((cut(m) for m in range(1, distance + 2) if sum(probes(hi - lo, r) for lo, hi, r in cut(m)) <= MOST_PROBES), key=cost)


def block_pairs(x: np.ndarray, y: np.ndarray, bands: list[tuple[int, int, int]], distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of 64-bit numbers x and y the pairs that differ in a band by at most its radius, each at the first such band, and in all by at most ``distance``; a bounded number at a time.

    A value of y is posted under its bits in each band, and one of x looks, in each, under all bits within the radius.
    """
    masks = [np.uint64(((1 << (hi - lo)) - 1) << lo) for lo, hi, _ in bands]
    for k, (lo, hi, radius) in enumerate(bands):
        # in the order of keys, lookups lie close together
        x, y = (h[np.argsort(h & masks[k], kind="stable")] for h in (x, y))
        asked, posted = ((h & masks[k]) >> np.uint64(lo) for h in (x, y))
        edges = np.searchsorted(posted, np.arange((1 << (hi - lo)) + 1, dtype=np.uint64)) if hi - lo <= TABLE_BITS else None
        for flip in (sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(hi - lo), n)):
            probe = asked ^ np.uint64(flip)
            if edges is not None:
                at = probe.astype(np.int64)
                first, count = edges[at], edges[at + 1] - edges[at]
            else:
                first = np.searchsorted(posted, probe)
                count = np.searchsorted(posted, probe, "right") - first
            ends = np.cumsum(count)
            cuts = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(CANDIDATES, ends[-1], CANDIDATES)), [len(x)]])) if len(x) and ends[-1] else ()
            for i, j in zip(cuts, cuts[1:]):
                start = ends[i] - count[i]
                u, v = np.repeat(x[i:j], count[i:j]), y[np.repeat(first[i:j] - (ends[i:j] - count[i:j]), count[i:j]) + np.arange(start, ends[j - 1])]
                near = np.flatnonzero(np.bitwise_count(u ^ v) <= distance)
                for mask, (_, _, r) in zip(masks[:k], bands):
                    near = near[np.bitwise_count((u[near] ^ v[near]) & mask) > r]
                if len(near):
                    yield u[near], v[near]


def hamming_candidates(values: DataFrame, bands: list[tuple[int, int, int]], distance: int = 64, blocks: int = 1) -> DataFrame:
    """(x, y) of different 64-bit numbers (h, each once), x < y, that differ in a band by at most its radius and in all by at most ``distance``; each pair once.

    Values are dealt into blocks, and a task compares two of them (``block_pairs``): what it holds follows from the size of
    a block, and a value is sent once for each block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, block, h = (np.concatenate(column) for column in zip(*([x.to_numpy(zero_copy_only=False) for x in batch.columns] for batch in batches)))
        a, b = divmod(int(tile[0]), blocks)
        left, right = h[block == a].view(np.uint64), h[block == b].view(np.uint64)
        held, size = [], 0

        def given() -> pa.RecordBatch:
            u, v = (np.concatenate(side) for side in zip(*held))
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["x", "y"])

        for pair in block_pairs(left, right, bands, distance):
            u, v = (side.view(np.int64) for side in pair)
            # a block meets itself from both sides
            held.append((u[u < v], v[u < v]) if a == b else (u, v))
            size += len(held[-1][0])
            if size >= CANDIDATES:
                yield given()
                held, size = [], 0
        if size:
            yield given()

    own = values.select("h", F.pmod(F.xxhash64("h"), F.lit(blocks)).alias("block"))
    tiles = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda other: F.least("block", other) * blocks + F.greatest("block", other))
    dealt = own.select(F.explode(tiles).alias("tile"), "block", "h").repartition(2 * blocks * (blocks + 1), "tile")
    return dealt.groupBy("tile").applyInArrow(run, "x long, y long")


def numbers(hashes: DataFrame, hash_col: str) -> DataFrame:
    return hashes.where(F.length(hash_col) == 16).withColumn("h", bits64(F.col(hash_col)))


def near_values(values: DataFrame, distance: int) -> DataFrame:
    """(x, y, distance) of pairs of the numbers h, each once, within ``distance`` bits, x < y."""
    count = values.count()
    blocks = max(1, min(FEW_BLOCKS, count // LEAST_VALUES), -(-count // MOST_VALUES))
    near = hamming_candidates(values, bands_of(distance, max(1, count // blocks)), distance, blocks)
    return near.select("x", "y", F.bit_count(F.col("x").bitwiseXOR(F.col("y"))).cast("int").alias("distance"))


def hamming_groups(hashes: DataFrame, distance: int = 3, hash_col: str = "hash") -> DataFrame:
    """(x, y, distance) of pairs of different hash values, as 64-bit numbers, within ``distance`` bits, x < y.

    Values are made distinct and parsed to numbers first, so that copies cost nothing and a candidate is one exclusive
    or. Candidates come from lookups in bands (``bands_of``): of 64 random bits and a distance of 15, four bands of 16 bits
    and a radius of 3 leave one pair in 23.
    """
    return near_values(written(numbers(hashes, hash_col).select("h").distinct()), distance)


def hamming_pairs(hashes: DataFrame, distance: int = 3, id_col: str = "id", hash_col: str = "hash") -> DataFrame:
    """(a, b, distance) of all pairs of rows within ``distance`` bits, a < b: ``hamming_groups`` with its members spelled out.

    Equal hashes make pairs quadratic in their number; where that matters, take the groups.
    """
    rows = written(numbers(hashes, hash_col).select(F.col(id_col).alias("id"), "h"))
    left, right = rows.toDF("i", "x"), rows.toDF("j", "y")
    near = near_values(written(rows.select("h").distinct()), distance).join(left, "x").join(right, "y").select("i", "j", "distance")
    equal = left.join(right, (F.col("x") == F.col("y")) & (F.col("i") < F.col("j"))).select("i", "j", F.lit(0).alias("distance"))
    return near.union(equal).select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "distance")


def statistics(catalog: DataFrame) -> DataFrame:
    """One row: records, duplicate groups, records with a perceptual hash, devices."""
    twice = catalog.groupBy("sha256_hash").count().where("count > 1").agg(F.count("*").alias("duplicate_groups"))
    one = catalog.agg(F.count("*").alias("total_records"), F.count("perceptual_hash").alias("with_perceptual_hash"), F.count_distinct("device_code").alias("unique_devices"))
    return one.join(F.broadcast(twice))
