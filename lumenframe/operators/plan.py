"""Ingest planning: which file goes where, and what that amounts to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import backup_path, event_date, organized_path, parent

FULL_CHECK_BELOW = 10 * 1024 * 1024


def operation(raw_only: bool, organized_only: bool) -> str:
    return "raw_backup_only" if raw_only else "organized_only" if organized_only else "both"


def plan(files: DataFrame, results: DataFrame, event: Column, archive: str, backup: str, raw_only: bool = False, organized_only: bool = False, root: Column | None = None, preserve: bool = True) -> DataFrame:
    """One row a planned file: seq, source_path, status, device_code, operation_type, dest_path, raw_backup_path.

    ``files``: seq, path, taken (text), modified_time, device_code; ``results``: path,
    status. Files without a result are new; duplicates are planned for a raw backup
    alone. ``root``: what backup paths are relative to; null or a file's own directory
    gives flat backups.
    """
    kind = operation(raw_only, organized_only)
    rows = files.drop("status").join(results.select("path", "status"), "path", "left").withColumn("status", F.coalesce("status", F.lit("new")))
    if not raw_only:
        rows = rows.where("status != 'duplicate'")
    device = F.coalesce("device_code", F.lit("Unknown"))
    day = event_date(F.col("taken"), F.col("modified_time"))
    dest = organized_path(F.lit(archive), day, event, device, F.col("path"))
    safe = backup_path(F.lit(backup), parent(F.col("path")) if root is None else root, F.col("path"), preserve)
    none = F.lit(None).cast("string")
    return rows.select(
        "seq", F.col("path").alias("source_path"), "status", device.alias("device_code"), F.lit(kind).alias("operation_type"),
        (none if raw_only else dest).alias("dest_path"), (none if organized_only else safe).alias("raw_backup_path"),
    )


def collisions(ops: DataFrame) -> DataFrame:
    """Destinations that several files share: dest_path, files."""
    return ops.where("dest_path is not null").groupBy("dest_path").agg(F.count("*").alias("files")).where("files > 1")


def numbered(ops: DataFrame) -> DataFrame:
    """Shared destinations made distinct: the second and later get _1, _2 before the extension."""
    from pyspark.sql import Window as W

    nth = F.row_number().over(W.partitionBy("dest_path").orderBy("seq")) - 1
    apart = F.regexp_replace(F.col("dest_path"), F.lit(r"^(.*?)(\.[^./]*)?$"), F.concat(F.lit("$1_"), nth.cast("string"), F.lit("$2")))
    return ops.withColumn("dest_path", F.when(nth > 0, apart).otherwise(F.col("dest_path")))


def breakdown(ops: DataFrame) -> DataFrame:
    """One row of counts by status and operation."""
    is_kind = lambda k: F.count_if(F.col("operation_type") == k)
    twice = F.count_if(F.col("status") == "duplicate")
    return ops.agg(
        F.count("*").alias("total_files"), twice.alias("duplicates"), (F.count("*") - twice).alias("new_files"),
        is_kind("raw_backup_only").alias("raw_only"), is_kind("organized_only").alias("organized_only"), is_kind("both").alias("both"),
    )


def per_device(ops: DataFrame) -> DataFrame:
    return ops.groupBy("device_code").agg(F.count("*").alias("files"))


def dry_run(ops: DataFrame, sizes: DataFrame, copy: bool = True) -> DataFrame:
    """What executing would report; ``sizes``: path, size. Duplicates count as processed."""
    rows = ops.join(sizes.select(F.col("path").alias("source_path"), "size"), "source_path", "left")
    n, zero = F.count("*"), F.lit(0).cast("long")
    backed = F.col("operation_type") != "organized_only"
    return rows.agg(
        n.alias("files_processed"), (n if copy else zero).alias("files_copied"), (zero if copy else n).alias("files_moved"), zero.alias("files_skipped"), F.count_if(F.col("status") == "duplicate").alias("duplicates_found"),
        F.count_if(backed).alias("files_backed_up"), F.coalesce(F.sum(F.when(backed, F.col("size"))), zero).cast("long").alias("backup_size"),
    )


def common_root(paths: DataFrame, path: str = "path", by: list[str] | None = None) -> DataFrame:
    """The longest directory prefix that all paths share, from the least and the greatest of them; for one file its parent."""
    parts = F.split(path, "/")
    ends = paths.groupBy(*(by or [])).agg(F.min(parts).alias("lo"), F.max(parts).alias("hi"))
    same = F.zip_with("lo", "hi", lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    length = F.when(first == 0, F.size("lo") - 1).otherwise(first - 1).cast("int")
    joined = F.array_join(F.slice("lo", F.lit(1), length), "/")
    return ends.select(*(by or []), F.when(F.length(joined) > 0, joined).otherwise("/").alias("root"))


def verified(pairs: DataFrame) -> DataFrame:
    """With ``intact``: equal sizes and, below 10 MiB, equal MD5. Columns: size and content of both sides (source_*, dest_*)."""
    sides = F.when(F.col("source_size").isNull() | (F.col("source_size") != F.col("dest_size")), False).when(F.col("source_size") >= FULL_CHECK_BELOW, True).otherwise(F.md5(F.col("source_content").cast("binary")) == F.md5(F.col("dest_content").cast("binary")))
    return pairs.withColumn("intact", F.coalesce(sides, F.lit(False)))
