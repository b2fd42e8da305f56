"""Filters and summaries of scanned files: (path, size, modified_time, file_type, extension, mime_type, seq)."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FileTypes
from ..functions import extension, parent

KINDS = ("raw", "jpeg", "video")
#: Extensions whose files have a perceptual hash.
HASHED = ("jpg", "jpeg", "png", "bmp", "tiff", "tif", "heic", "heif")


def file_type(ext: Column, types: FileTypes = FileTypes()) -> Column:
    """video before jpeg before raw where lists overlap; ``unknown`` for the rest."""
    low = F.lower(ext)
    return F.when(low.isin(types.video), "video").when(low.isin(types.jpeg), "jpeg").when(low.isin(types.raw), "raw").otherwise("unknown")


def mime_type(ext: Column) -> Column:
    known = {k[1:]: v for k, v in mimetypes.types_map.items()}
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in sorted(known.items()) for x in pair]), F.lower(ext))


def supported(files: DataFrame, types: FileTypes = FileTypes(), path: str = "path") -> DataFrame:
    return files.where(extension(F.col(path)).isin(types.all_extensions()))


def described(files: DataFrame, types: FileTypes = FileTypes()) -> DataFrame:
    """With extension, file_type, and mime_type where it isn't given."""
    ext = extension(F.col("path"))
    given = F.col("mime_type") if "mime_type" in files.columns else F.lit(None).cast("string")
    return files.withColumns({"extension": ext, "file_type": file_type(ext, types), "mime_type": F.coalesce(given, mime_type(ext))})


def images(files: DataFrame) -> DataFrame:
    return files.where(F.col("file_type").isin("raw", "jpeg"))


def hashable(files: DataFrame) -> DataFrame:
    return files.where(F.lower("extension").isin(*HASHED))


def by_size(files: DataFrame, least: int = 0, most: int | None = None) -> DataFrame:
    """Both ends inclusive."""
    return files.where((F.col("size") >= least) & (F.lit(True) if most is None else F.col("size") <= most))


def by_type(files: DataFrame, kinds: list[str]) -> DataFrame:
    return files.where(F.col("file_type").isin(*kinds))


def by_date(files: DataFrame, start: Column | None = None, end: Column | None = None, at: str = "modified_time") -> DataFrame:
    """Both ends inclusive and optional."""
    for bound, test in ((start, F.col(at).__ge__), (end, F.col(at).__le__)):
        files = files if bound is None else files.where(test(bound))
    return files


def per_type(files: DataFrame) -> DataFrame:
    """file_type, files and bytes of raw, jpeg and video, with zeros."""
    one = lambda k: F.struct(F.lit(k).alias("file_type"), F.count_if(F.col("file_type") == k).alias("files"), F.coalesce(F.sum(F.when(F.col("file_type") == k, F.col("size"))), F.lit(0)).cast("long").alias("bytes"))
    return files.agg(F.array(*map(one, KINDS)).alias("rows")).select(F.inline("rows"))


def totals(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("total_files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_size"), F.count_distinct(parent(F.col("path"))).alias("directories_scanned"))


def per_directory(files: DataFrame) -> DataFrame:
    """Files and bytes a directory; the listing itself is a sort of ``files`` by directory."""
    return files.groupBy(parent(F.col("path")).alias("directory")).agg(F.count("*").alias("files"), F.sum("size").cast("long").alias("bytes"))


def summary(files: DataFrame) -> DataFrame:
    """One row: count, bytes, first and last time, and the largest (last of equals) and smallest (first of equals) file."""
    size = F.struct("size", "seq")
    return files.agg(
        F.count("*").alias("total_files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_size"), F.min("modified_time").alias("earliest"), F.max("modified_time").alias("latest"),
        F.max_by("path", size).alias("largest"), F.max("size").alias("largest_size"), F.min_by("path", size).alias("smallest"), F.min("size").alias("smallest_size"),
    )


def value_counts(df: DataFrame, value: Column, order: str = "seq") -> DataFrame:
    """value, n, first_seq of values that are neither null nor empty."""
    return df.select(value.alias("value"), F.col(order).alias("_seq")).where("value is not null and cast(value as string) != ''").groupBy("value").agg(F.count("*").alias("n"), F.min("_seq").alias("first_seq"))


def sample_per_group(df: DataFrame, group: str, n: int, order: str = "seq") -> DataFrame:
    """The first ``n`` rows of each group."""
    from pyspark.sql import Window as W

    return df.withColumn("_nth", F.row_number().over(W.partitionBy(group).orderBy(order))).where(F.col("_nth") <= n).drop("_nth")
