"""Mixing sources to target weights by systematic sampling.

Every document of a source expects ``target / source_size`` copies. The expected
copies are prefix-summed along the source, one random offset per source is added,
and a document is emitted once for every integer that its stretch of the sum
crosses. So each gets the floor or the ceiling of its expectation, and the words a
source contributes stay near its target: documents lie along the sum by size
class, so that long and short ones are thinned or repeated evenly.

Scale: a source may hold any share of the rows. Its prefix sum is taken on three
levels (size class, block, row), with about sqrt(rows) blocks of a keyed digest, so
that no window partition holds more than about sqrt(rows) rows. The result does not
depend on the number of blocks. Only DataFrame functions are used.

Edge cases: null text and text without words have size 0 and take 0 words; a null
source is a source of its own, last in order; repeated rows are documents of their
own; an empty table gives an empty result; extra columns pass through, and those
named like an added column are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, small_side, unpack, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
SEED = "mix-1"


def size_class(size: Column) -> Column:
    """Two leading decimal digits and the number of digits, ordered as the sizes are."""
    digits = F.length(size.cast("string"))
    lead = F.substring(size.cast("string"), 1, 2).cast("int")
    return digits * 100 + lead


def _coded(source: Column) -> Column:
    """A source as a key that is never null, so that windows and joins can share one partitioning."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source.cast("string")))


def _keyed(docs: DataFrame, carry: list[str], id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    col = lambda name: docs[f"`{name}`"]
    return docs.select(
        F.struct(*[col(c).alias(c) for c in carry]).alias("_row"),
        col(source_col).alias("_source"),
        _coded(col(source_col)).alias("_skey"),
        word_count(col(text_col)).alias("_size"),
        F.md5(F.concat(F.lit(seed), F.coalesce(col(id_col).cast("string"), F.lit("?"))).cast("binary")).alias("_key"),
        F.xxhash64(col(text_col)).alias("_tie"),
    ).withColumn("_class", size_class(F.col("_size")))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(_source, _size) rows -> one row a source: _source, source_size, target.

    Water filling in one pass: with sources ordered by cap / weight, the level seen
    from a source (what is left after all before it are full, by the weight that is
    left) says whether it is full as well.
    """
    table = sizes.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    every = W.partitionBy(F.lit(0))
    table = table.withColumn("_n", F.row_number().over(every.orderBy(F.col("_source").asc_nulls_last())))
    table = table.select(
        "_source", "source_size", (F.col("source_size") * cap).cast("double").alias("_cap"), F.sum("source_size").over(every).alias("_all"),
        F.get(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_n") - 1) % len(weights)).cast("int")).alias("_w"), "_n",
    )
    order = every.orderBy(F.col("_cap") / F.col("_w"), "_n")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    table = table.withColumns({
        "_level": (F.col("_all") * share - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))),
    })
    full = F.col("_cap") <= F.col("_level") * F.col("_w")
    level = F.min_by("_level", F.struct(F.col("_cap") / F.col("_w"), F.col("_n"))).over(every.orderBy(full).rangeBetween(W.currentRow, W.currentRow))
    return table.select("_source", "source_size", F.when(full, F.col("_cap")).otherwise(level * F.col("_w")).alias("target"))


def _with_copies(docs: DataFrame, carry: list[str], id_col: str, text_col: str, source_col: str, weights: tuple, share: float, cap: float, seed: str) -> DataFrame:
    rows = _keyed(docs, carry, id_col, text_col, source_col, seed)
    sizes = durable(rows.select("_source", "_skey", "_class", "_key", "_size"))
    hexes = max(1, math.ceil(math.log(max(sizes.count(), 1), 16) / 2))
    block = F.substring("_key", 1, hexes)

    blocks = sizes.groupBy("_skey", "_class", block.alias("_block")).agg(F.count("*").alias("_rows"))
    classes = blocks.groupBy("_skey", "_class").agg(F.sum("_rows").alias("_rows"))
    up_to = lambda *keys: W.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    classes = classes.select("_skey", "_class", F.coalesce(F.sum("_rows").over(up_to("_skey", "_class")), zero).alias("_base"))
    targets = source_targets(sizes, weights, share, cap).withColumn("_skey", _coded(F.col("_source"))).drop("_source")
    per_class = classes.join(small_side(targets), "_skey")
    blocks = blocks.withColumn("_base2", F.coalesce(F.sum("_rows").over(up_to("_skey", "_class", "_block")), zero))
    starts = blocks.join(per_class, ["_skey", "_class"]).select("_skey", "_class", "_block", (F.col("_base") + F.col("_base2")).alias("_start"), "source_size", "target")

    # the window and the join have the same keys: rows are shuffled once
    keys = ["_skey", "_class", "_block"]
    rows = rows.withColumn("_block", block)
    rows = rows.withColumn("_nth", F.row_number().over(W.partitionBy(*keys).orderBy("_key", "_tie")))
    rows = rows.join(starts, keys).withColumn("_rank", F.col("_start") + F.col("_nth"))

    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "/"), F.coalesce(F.col("_source"), F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    mark = lambda rank: F.floor(rate * rank + offset)
    return rows.withColumn("_copies", mark(F.col("_rank")) - mark(F.col("_rank") - 1))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED, carry: list[str] | None = None) -> DataFrame:
    """All rows with size, source_size, target, copies and taken (= copies * size) added; of their own columns those in ``carry`` (all) are kept."""
    carry = docs.columns if carry is None else carry
    rows = _with_copies(docs, carry, id_col, text_col, source_col, weights, share, cap, seed)
    added = {"size": F.col("_size"), "source_size": F.col("source_size"), "target": F.col("target"), "copies": F.col("_copies"), "taken": F.col("_copies") * F.col("_size")}
    return unpack(rows, carry, added)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """The mixed corpus: each document as often as it was drawn, with its own columns."""
    rows = _with_copies(docs, docs.columns, id_col, text_col, source_col, weights, share, cap, seed).where("_copies > 0")
    rows = rows.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int"))))
    return unpack(rows, docs.columns, {})
