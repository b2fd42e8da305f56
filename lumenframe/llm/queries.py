"""The queries of this subpackage: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import alignment, jaccard, langid, licences, lm, mixing, packing, quality, rules, toxicity, urls, vectors, whitening
from .common import read


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path
    return packing.pack(read(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = quality.folds(F.col("doc_id"), 3)
    model = langid.fit(docs.where((fold != 1) & F.col("lang").isNotNull()))
    return langid.label(docs.select("doc_id", (fold == 1).alias("held_out"), "text"), model).drop("text")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.plan_mix(docs, carry=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    fold = quality.folds(F.col("doc_id"), 5)
    model = quality.fit(docs.where(fold != 0), read(spark, sf_dir, "labels").where(fold != 0))
    return quality.rate(docs.select("doc_id", (fold == 0).alias("held_out"), "text"), model).drop("text")


def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return rules.rate(docs, rules.trusted_ids(read(spark, sf_dir, "labels"))).drop("text")


def listed_domains(pages: DataFrame) -> DataFrame:
    """A dated list made from the hosts of the pages: about a quarter of their domains is added, removed and perhaps added again, on days that a digest of the name gives."""
    domain = F.array_join(F.slice(F.split(urls.host(F.col("url")), r"\."), -3, 3), ".")
    names = pages.select(domain.alias("pattern")).where("pattern is not null").distinct().withColumn("h", F.md5(F.col("pattern").cast("binary")))
    names = names.where("substr(h, 1, 1) < '4' or pattern = 'cheap-pills.example.net'")
    byte = lambda at: F.conv(F.substring("h", at, 2), 16, 10).cast("int")
    first, second = byte(3), byte(3) + byte(5) + 1
    steps = F.array(
        F.struct(F.lit("add").alias("action"), first.alias("day")),
        F.struct(F.lit("remove").alias("action"), second.alias("day")),
        F.struct(F.lit("add").alias("action"), F.when(F.substring("h", 7, 1) < "8", second + 30).alias("day")),
    )
    rows = names.select("pattern", F.when(F.substring("h", 8, 1) < "8", "spam").otherwise("adult").alias("category"), F.inline(steps))
    return rows.select("pattern", "category", "action", F.date_add(F.lit("2024-01-01").cast("date"), F.col("day")).alias("effective_at"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int"))
    return urls.judge(pages.withColumn("fetched_at", fetched), listed_domains(pages)).drop("url", "fetched_at")


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held = lambda: quality.folds(F.col("doc_id"), 5) == 1
    return lm.score(docs, ~held()).withColumn("held_out", held())


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    rows = whitening.whiten(table, whitening.fit(table))
    return rows.select("vec_id", "n", "deviation", "identity_error", F.inline("components")).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.align(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, path("piece_bpe_32k.model")).drop("text")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    fold = quality.folds(F.col("doc_id"), 5)
    model = toxicity.fit(docs.where(fold != 0), read(spark, sf_dir, "labels").where(fold != 0))
    return toxicity.rate(docs.select("doc_id", (fold == 0).alias("held_out"), "text"), model).drop("text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_langid": op2_langid,
        "op3_mixing": op3_mixing,
        "op4_quality": op4_quality,
        "op5_rules": op5_rules,
        "op6_urls": op6_urls,
        "op7_lm": op7_lm,
        "op8_licences": op8_licences,
        "op9_vectors": op9_vectors,
        "op10_jaccard": op10_jaccard,
        "op11_whitening": op11_whitening,
        "op12_alignment": op12_alignment,
        "op13_toxicity": op13_toxicity,
        "pipeline": corpus_pipeline.run,
    }
