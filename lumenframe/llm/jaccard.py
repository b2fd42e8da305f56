"""N-gram Jaccard self-join by grouped prefix join, and its connected components.

A document is the set of its distinct word shingles. Shingles are ordered by how
often the corpus has them (a sketch estimate, then their hash: any total order that
all documents share gives exact results). Two sets with Jaccard similarity t share k
shingles among the first n - ceil(t n) + k of each, so only documents that meet k
times in such prefixes need comparing; with k = 3, chance meetings are rare. Equal
sets are one class; classes with equal prefix and size are one group; groups meet in the postings of prefix shingles, and pass only if
their sizes and the positions of the shingle still allow t; then their members are
compared, on whole sets.

Components need no more than one link where many exist, so comparing takes two
rounds. First, each group meets only the leader of a posting (the group that has the
shingle earliest), and each member its group's. Then all pairs that still lie in
different components are compared, so that no link between different components is
lost: the result equals that of comparing all pairs.

Scale: two narrow passes over the text (sketch, prefixes) that shuffle a fixed-size
sketch and one row a document; postings that occur once are dropped before any join;
only sets that have a candidate are formed again for verification. Large groups of
exact copies are one class, large groups of near copies cost their number in the
first round; sets that share a common shingle but too little else are told apart by size and position
before any pair is spelled out (``open_pairs``). Verification is a join and an array intersection; a hot
leader is a skewed join side, which Spark splits.

Edge cases: texts with fewer words than a shingle are one shingle, the whole sequence;
null texts and texts without words have an empty set and link with nothing; rows of a
null id too, and keep a null component; repeated rows are in one class; an empty table gives
an empty result; extra columns do not matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import durable, keep_row, long_rows, small_side, unpack
from .components import components
from .textbatch import Chunk, chunks, mix

WORDS = 3
PERCENT = 90
#: Prefix shingles that a pair must share (or all that its similarity asks for, if fewer).
COMMON = 3
#: Cells of the sketch, as a power of two; a cell is four bytes, and 2**CELL_BITS of them reach driver and executors.
CELL_BITS = 20
BLOCK = 256
#: Bands of sizes for each factor of e.
BANDS = 30


def shingles(chunk: Chunk, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of a chunk's texts, and where each text's begin (with a final bound)."""
    chunk = chunk.lower()
    starts, ends, text = chunk.words()
    h = chunk.hashes().sure(starts, ends)
    count = np.bincount(text, minlength=len(chunk.start))
    first = np.concatenate([[0], np.cumsum(count)])
    out = mix(h)
    with np.errstate(over="ignore"):
        for k in range(1, n):
            out = mix(out[: len(out) - 1] * np.uint64(3) + h[k:]) if len(out) > 1 else out[:0]
        have = np.maximum(count - n + 1, 0)
        at = np.arange(have.sum()) - np.repeat(np.cumsum(have) - have, have) + np.repeat(first[:-1], have)
        full = out[at]
        short = np.flatnonzero((count > 0) & (count < n))
        whole = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            there = count[short] > k
            whole[there] = mix(whole[there] * np.uint64(3) + h[first[short[there]] + k] + np.uint64(k + 1))
    bounds = np.concatenate([[0], np.cumsum(have + ((count > 0) & (count < n)))])
    result = np.empty(bounds[-1], np.uint64)
    place = np.ones(bounds[-1], bool)
    place[bounds[short]] = False
    result[place], result[bounds[short]] = full, whole
    return result, bounds


def by_document(docs: DataFrame, id_col: str, text_col: str, words: int, schema: str, make: Callable[[], tuple[Callable, Callable]]) -> DataFrame:
    """``make()`` gives what a task does with (id, shingle hashes) and what it yields when a batch or all is done."""
    fields = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take, give = make()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for c in chunks(batch.column(1).to_pylist()):
                found, bounds = shingles(c, words)
                take(ids[c.first : c.first + len(c.start)], found, bounds)
                yield from give(False)
        yield from give(True)
        pa.default_memory_pool().release_unused()

    return long_rows(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, fields)


def sketch(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS, bits: int = CELL_BITS) -> np.ndarray:
    """How many shingles of the corpus fall into each of 2**bits cells."""

    def make():
        cells = np.zeros(1 << bits, np.uint32)

        def take(ids, found, bounds):
            np.add.at(cells, (found >> np.uint64(64 - bits)).astype(np.int64), 1)

        def give(done):
            if done:
                blocks = cells.reshape(-1, BLOCK)
                used = np.flatnonzero(blocks.any(1))
                for i in range(0, len(used), 1024):
                    part = used[i : i + 1024]
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([blocks[k].tobytes() for k in part], pa.binary())], names=["block", "cells"])

        return take, give

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[k] = sums.get(k, 0) + np.frombuffer(v, np.uint32).astype(np.uint64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.astype(np.uint64).tobytes() for x in sums.values()], pa.binary())], names=["block", "cells"])

    rows = by_document(docs, id_col, text_col, words, "block int, cells binary", make)
    rows = rows.repartition("block").mapInArrow(total, "block int, cells binary")
    out = np.zeros((1 << bits) // BLOCK * BLOCK, np.uint64).reshape(-1, BLOCK)
    for row in rows.toLocalIterator():
        out[row["block"]] = np.frombuffer(row["cells"], np.uint64)
    return np.minimum(out.ravel(), 0xFFFFFFFF).astype(np.uint32)


def prefixes(docs: DataFrame, cells: np.ndarray, id_col: str, text_col: str, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row a document: id, n (shingles), s1 and s2 (digests of the set), prefix."""
    bits = len(cells).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(cells)

    def make():
        order, rows = shared.value, []

        def take(ids, found, bounds):
            for i, doc in enumerate(ids):
                u = np.unique(found[bounds[i] : bounds[i + 1]])
                n = len(u)
                length = n - (percent * n + 99) // 100 + COMMON if n else 0
                first = np.argsort(order[(u >> np.uint64(64 - bits)).astype(np.int64)], kind="stable")[:length]
                spread = mix(u + np.uint64(1))
                rows.append((doc, n, np.add.reduce(spread).view(np.int64) if n else 0, np.bitwise_xor.reduce(spread).view(np.int64) if n else 0, u[first].view(np.int64)))

        def give(done):
            if len(rows) >= 2000 or done and rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(list(col), kind) for col, kind in zip(zip(*rows), kinds)], names=["id", "n", "s1", "s2", "prefix"])
                rows.clear()

        return take, give

    return by_document(docs, id_col, text_col, words, "id long, n long, s1 long, s2 long, prefix array<long>", make)


def sets_of(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS) -> DataFrame:
    """One row a document: id and the array of its distinct shingles."""

    def make():
        rows = []

        def take(ids, found, bounds):
            for i, doc in enumerate(ids):
                rows.append((doc, np.unique(found[bounds[i] : bounds[i + 1]]).view(np.int64)))

        def give(done):
            if len(rows) >= 500 or done and rows:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.list_(pa.int64()))], names=["id", "shingles"])
                rows.clear()

        return take, give

    return by_document(docs, id_col, text_col, words, "id long, shingles array<long>", make)


def verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of the (a, b) whose whole sets are similar enough; ``docs``: id, text."""
    needed = durable(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    sets = durable(sets_of(docs.join(small_side(needed), "id", "left_semi"), "id", "text", words))
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    both = left.join(small_side(pairs), "a").join(right, "b")
    common = F.size(F.array_intersect("x", "y"))
    alike = both.withColumn("_i", common).where((F.size("x") + F.size("y") - F.col("_i")) * percent <= F.col("_i") * 100)
    return durable(alike.select("a", "b").distinct())


def may_link(x: str, y: str, percent: int) -> Column:
    """Sizes, and what can precede and follow a shared shingle (one of the first COMMON), allow the similarity of two postings."""
    nx, ny, px, py = F.col(f"{x}.n"), F.col(f"{y}.n"), F.col(f"{x}.pos"), F.col(f"{y}.pos")
    return (F.least(nx, ny) * 100 >= F.greatest(nx, ny) * percent) & ((F.least(nx - px, ny - py) + COMMON - 1) * (100 + percent) >= (nx + ny) * percent)


def enough(most: Column, percent: int) -> Column:
    """Equal shingles that a pair needs among its prefixes; ``most``: the larger size."""
    return F.least(F.lit(COMMON), F.floor((most * percent + 99) / 100))


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def shared_postings(classes: DataFrame, joint: DataFrame, percent: int) -> DataFrame:
    """(token, pos, n, grp, head) of the groups, for the prefix shingles that may link two classes."""
    able = classes.where(F.col("n") * 100 >= (F.col("n") + 1) * percent)  # a smaller set is like no other but its equals
    groups = able.join(small_side(joint), ["n", "grp"], "left").where("head is null or head = rep")
    postings = groups.select("n", "grp", F.col("rep").alias("head"), F.coalesce("members", F.lit(1)).alias("members"), F.posexplode("prefix").alias("pos", "token"))
    met = postings.groupBy("token").agg(F.sum("members").alias("members"), F.count("*").alias("groups"), F.min("n").alias("least"), F.max("n").alias("most"), F.sum("n").alias("both"), F.min(F.col("n") - F.col("pos")).alias("left"))
    fits = (F.col("least") * 100 >= F.col("most") * percent) & ((F.col("left") + COMMON - 1) * (100 + percent) >= F.col("both") * percent)
    shared = met.where((F.col("members") > 1) & ((F.col("groups") != 2) | (F.col("members") > 2) | fits)).select("token")
    return durable(postings.join(small_side(shared), "token").select("token", "pos", "n", "grp", "head"))


def led_pairs(postings: DataFrame, classes: DataFrame, joint: DataFrame, percent: int) -> DataFrame:
    """First round: (a, b) of groups with the leaders of their postings, and of members with their group's head."""
    leaders = postings.groupBy("token").agg(F.min(F.struct("pos", "n", "head")).alias("lead")).select("token", "lead.pos", "lead.n", "lead.head")
    near = (F.col("x.token") == F.col("y.token")) & may_link("x", "y", percent) & (F.col("x.head") != F.col("y.head"))
    star = postings.alias("x").join(leaders.alias("y"), near).select(F.col("x.head").alias("a"), F.col("y.head").alias("b"), F.greatest("x.n", "y.n").alias("most"))
    star = star.groupBy("a", "b", "most").agg(F.count("*").alias("met")).where(F.col("met") >= enough(F.col("most"), percent)).select("a", "b")
    inner = classes.join(small_side(joint), ["n", "grp"]).where("rep != head").select(F.col("rep").alias("a"), F.col("head").alias("b"))
    return durable(ordered(star.union(inner)))


def band(size: Column) -> Column:
    """Sizes by their logarithm; each of the smaller ones has a band of its own."""
    return F.floor(F.log(size.cast("double")) * BANDS)


def open_pairs(postings: DataFrame, members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Second round: (a, b) of classes that still lie in different components and share enough. ``members``: n, grp, rep, comp.

    What precedes the first shingle that a pair shares can't be shared, so this shingle bounds how large its
    partner may be. A posting is laid only into the bands of sizes that its bound allows, and pairs are spelled
    out where the other one's size lies: sets of one size that have only their last prefix shingles in
    common, however many they are, never meet.
    """
    # a part: the members of a group that lie in one component; part is the least of them
    parts = durable(members.groupBy("n", "grp", "comp").agg(F.min("rep").alias("part")))
    met = postings.join(parts, ["n", "grp"]).select("token", "pos", "n", "comp", "part")

    def unlinked(rows: DataFrame) -> DataFrame:
        several = rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("token")
        return durable(rows.join(small_side(several), "token"))

    met = unlinked(met)
    able = met.groupBy("part", "n").agg(F.count("*").alias("met")).where(F.col("met") >= enough(F.col("n"), percent)).select("part")
    met = unlinked(met.join(small_side(able), "part").select("token", "pos", "n", "comp", "part"))
    # the sizes that a partner may have: from its similarity, and from what is left after this shingle; joins compare these plain numbers
    low, cap = F.floor((F.col("n") * percent + 99) / 100), F.floor((F.col("n") - F.col("pos")) * (100 + percent) / percent) - F.col("n")
    met = durable(met.select("token", "comp", "part", "n", low.alias("low"), cap.alias("cap"), band(F.col("n")).alias("band"), band(low).alias("from"), band(F.greatest(F.least(F.col("n"), cap), F.lit(1))).alias("to")))

    large = durable(met.where("low <= cap").select("token", "comp", "part", "n", "low", "cap", F.explode(F.sequence("from", "to")).alias("band")))
    small = met.where("n <= cap").select("token", "comp", "part", "n", "low", "cap", "band")
    # first components, by what the best of their parts allow, then parts
    reach = [F.max("cap").alias("cap"), F.min("low").alias("low"), F.min("n").alias("least"), F.max("n").alias("most")]
    one, two = (durable(rows.groupBy("token", "band", "comp").agg(*reach)).alias(name) for rows, name in ((large, "x"), (small, "y")))
    same = (F.col("x.token") == F.col("y.token")) & (F.col("x.band") == F.col("y.band"))
    able = (F.col("x.comp") != F.col("y.comp")) & (F.col("y.least") <= F.col("x.cap")) & (F.col("x.least") <= F.col("y.cap")) & (F.col("y.most") >= F.col("x.low")) & (F.col("y.least") <= F.col("x.most"))
    sides = durable(one.join(two, same & able).select("x.token", "x.band", F.col("x.comp").alias("c1"), F.col("y.comp").alias("c2")))
    spelled = sides.join(large.withColumnRenamed("comp", "c1"), ["token", "band", "c1"]).alias("x")
    fits = (F.col("y.n") <= F.col("x.n")) & (F.col("y.n") >= F.col("x.low")) & (F.col("y.n") <= F.col("x.cap")) & (F.col("x.n") <= F.col("y.cap"))
    cross = spelled.join(small.alias("y"), same & (F.col("x.c2") == F.col("y.comp")) & fits)
    cross = durable(cross.select(F.least("x.part", "y.part").alias("p"), F.greatest("x.part", "y.part").alias("q"), F.col("x.n").alias("most"))).distinct()
    # those that share enough of their whole prefixes
    prefix = lambda side: classes.select(F.col("rep").alias(side), F.col("prefix").alias(f"prefix_{side}"))
    shared = F.size(F.array_intersect("prefix_p", "prefix_q"))
    cross = durable(cross.join(prefix("p"), "p").join(prefix("q"), "q").where(shared >= enough(F.col("most"), percent)).select("p", "q").distinct())
    of_part = durable(members.join(parts, ["n", "grp", "comp"]).select("part", "rep"))
    one, two = of_part.toDF("p", "a"), of_part.toDF("q", "b")
    return ordered(cross.join(one, "p").join(two, "q").select("a", "b"))


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, cell_bits: int = CELL_BITS) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = durable(prefixes(docs, sketch(docs, "id", "text", words, cell_bits), "id", "text", words, percent))
    classes = rows.where("n > 0 and id is not null").groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"), F.first("prefix").alias("prefix"))
    classes = durable(classes.select("n", "s1", "s2", "rep", "prefix", F.xxhash64("n", "prefix").alias("grp")))
    joint = durable(classes.groupBy("n", "grp").agg(F.min("rep").alias("head"), F.count("*").alias("members")).where("members > 1"))
    postings = shared_postings(classes, joint, percent)
    first = led_pairs(postings, classes, joint, percent)

    known = components(verified(first, docs, words, percent))
    members = durable(classes.select("n", "grp", "rep").join(known, F.col("rep") == F.col("node"), "left").select("n", "grp", "rep", F.coalesce("component", "rep").alias("comp")))
    rest = durable(open_pairs(postings, members, classes, percent).join(first, ["a", "b"], "left_anti"))
    more = verified(rest, docs, words, percent)

    # what the second round links are components of the first
    comp_of = lambda side: members.select(F.col("rep").alias(side), F.col("comp").alias(f"comp_{side}"))
    merged = components(more.join(comp_of("a"), "a").join(comp_of("b"), "b"), "comp_a", "comp_b").toDF("comp", "into")
    per_class = classes.join(members.select("rep", "comp"), "rep").join(merged, "comp", "left").select("n", "s1", "s2", F.coalesce("into", "comp").alias("comp"))
    return rows.join(per_class, ["n", "s1", "s2"], "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("comp", "id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Of each component one document, that with the least id (of several texts under it, any, but always the same one); all rows of a null id.

    A document is an id and a text: texts under one id that are not alike all stay, and rows that repeat an id and
    a text become one, that with the least digest of its columns.
    """
    rows = keep_row(docs).select("_row", F.col(f"_row.`{id_col}`").cast("long").alias("_id"), F.col(f"_row.`{text_col}`").alias("_text"))
    rows = rows.withColumn("_node", F.when(F.col("_id").isNotNull(), F.xxhash64("_id", "_text")))
    nodes = rows.where("_node is not null")
    tag = F.xxhash64(F.lit("other"), "_text")
    own = nodes.groupBy("_node").agg(F.min("_id").alias("_id"), F.max("_id").alias("_last"), F.min(tag).alias("_lo"), F.max(tag).alias("_hi"), F.count("*").alias("_rows"))
    found = link_components(nodes.select("_node", "_text"), "_node", "_text", words, percent).select(F.col("doc_id").alias("_node"), "component_id").distinct()
    # a digest that stands for two documents decides nothing: both stay
    placed = durable(own.join(found, "_node").withColumn("_sure", (F.col("_id") == F.col("_last")) & (F.col("_lo") == F.col("_hi"))))
    best = placed.where("_sure").groupBy("component_id").agg(F.min(F.struct("_id", "_node")).alias("_best"))
    gone = small_side(placed.where("_sure").join(best, "component_id").where("_node != _best._node").select("_node"))
    again = small_side(placed.where("_rows > 1").select("_node"))
    kept = rows.join(gone, "_node", "left_anti")
    digest = F.xxhash64(*[F.col("_row")[c] for c in docs.columns])
    once = kept.join(again, "_node", "left_semi").groupBy("_id", "_text").agg(F.min_by("_row", digest).alias("_row"))
    return unpack(kept.join(again, "_node", "left_anti").select("_row").unionByName(once.select("_row")), docs.columns, {})
