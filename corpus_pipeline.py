"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; its
result is written and reread as the next one's ``docs``. All but the last return the
columns of ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import jaccard, mixing, packing, quality, rules
from lumenframe.llm.common import durable, read

#: Near copies; the defaults of ``jaccard`` are those of its own query.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def decided(docs: DataFrame, rate: Callable[[DataFrame], DataFrame], accepted: str) -> DataFrame:
    """The rows that ``rate`` finds ``accepted``, as they were: it sees ids and texts alone, so that no column's name clashes with its own."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    rows = rate(docs.select("doc_id", "text", F.struct(*others, F.lit(0)).alias("_others"))).where(accepted)
    return rows.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"_others.`{c}`") for c in docs.columns])


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. It learns from labelled ones outside its held-out fold."""
    fold = quality.folds(F.col("doc_id"), 5)
    model = quality.fit(docs.where(fold != 0), read(spark, sf_dir, "labels").where(fold != 0))
    return decided(docs, lambda rows: quality.rate(rows, model), "predicted = 1")


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and look like the trusted ones."""
    return decided(docs, lambda rows: rules.rate(rows, rules.trusted_ids(read(spark, sf_dir, "labels"))), "kept")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: Jaccard similarity of at least 0.8 over shingles of five words."""
    return jaccard.keep_one(docs, words=NEAR_WORDS, percent=NEAR_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix draws them."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in the sequences."""
    path = public_tokenizers.path
    return packing.pack(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", classify),
    ("quality rules", apply_rules),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack),
]

#: The classifier and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
