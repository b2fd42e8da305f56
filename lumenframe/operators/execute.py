"""Carrying out a plan: copies and moves as an idempotent side effect of tasks.

A file is copied under a temporary name, verified, and renamed; one that is already
there intact is left alone, so that a repeated task does no harm. Where a repeated move finds no source, a target
of the size and digest that the plan carries is that earlier copy.

A run (``carry_out``) works from a plan that was written before any file was touched, and in steps, each of which ends with a
table of what it did: copies, then the caller's records, then, for a move, the removal of those sources whose copies the
first table has and that are still intact. A step whose table is complete isn't repeated; one that was cut
short, by a lost executor or a dead driver, is done again from the same plan. So whatever fails, a source is there until its
copies are verified and recorded.
"""

from __future__ import annotations

import hashlib
import os
import shutil
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import written
from .plan import FULL_CHECK_BELOW

SCHEMA = "source_path string, target string, kind string, size long, done boolean, error string"


def digest(path: str | Path) -> str:
    with open(path, "rb") as file:
        return hashlib.file_digest(file, "md5").hexdigest()


def intact(source: str | Path, dest: str | Path) -> bool:
    """Equal sizes and, below 10 MiB, equal MD5; False if either can't be read."""
    try:
        size = os.path.getsize(source)
        return size == os.path.getsize(dest) and (size >= FULL_CHECK_BELOW or digest(source) == digest(dest))
    except OSError:
        return False


def arrived(target: str, size: object, sha256: object) -> bool:
    """Whether the target is the file that the plan describes."""
    if not isinstance(sha256, str) or size is None or pd.isna(size):
        return False
    try:
        if os.path.getsize(target) != int(size):
            return False
        with open(target, "rb") as file:
            return hashlib.file_digest(file, "sha256").hexdigest() == sha256
    except OSError:
        return False


def put(source: str, target: str) -> str:
    """Copy one file; the error's text, or empty."""
    try:
        if not intact(source, target):
            Path(target).parent.mkdir(parents=True, exist_ok=True)
            part = f"{target}.part-{os.getpid()}"
            shutil.copy2(source, part)
            if not intact(source, part):
                os.unlink(part)
                return f"verification failed: {source}"
            os.replace(part, target)
        return ""
    except OSError as e:
        return f"{source}: {e}"


def _described(ops: DataFrame) -> DataFrame:
    """What tasks need of a plan; ``size`` and ``sha256`` of the sources where it has them."""
    known = [F.col(c).cast(kind) if c in ops.columns else F.lit(None).cast(kind).alias(c) for c, kind in (("size", "long"), ("sha256", "string"))]
    return ops.select("source_path", "dest_path", "raw_backup_path", *known)


def copies(ops: DataFrame, backup_enabled: bool = True) -> DataFrame:
    """One row a transfer: each file's backup, then its organised copy. Sources stay."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for op in frame.itertuples(index=False):
                there = os.path.exists(op.source_path)
                size = os.path.getsize(op.source_path) if there else None if pd.isna(op.size) else int(op.size)
                wanted = [(op.raw_backup_path, "backup")] if op.raw_backup_path else []
                wanted += [(op.dest_path, "organized")] if op.dest_path else []
                for target, kind in wanted:
                    error = "Raw backup is disabled" if kind == "backup" and not backup_enabled else "" if not there and arrived(target, op.size, op.sha256) else put(op.source_path, target)
                    rows.append((op.source_path, target, kind, size, not error, error or None))
            yield pd.DataFrame(rows, columns=["source_path", "target", "kind", "size", "done", "error"])

    return _described(ops).mapInPandas(run, SCHEMA)


def removals(ops: DataFrame, done: DataFrame) -> DataFrame:
    """Remove the sources of the plan all of whose transfers are done and whose targets are still there intact; one row a source with kind ``removed``."""
    whole = done.groupBy("source_path").agg(F.every("done").alias("_all")).where("_all").select("source_path")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for op in frame.itertuples(index=False):
                targets = [x for x in (op.raw_backup_path, op.dest_path) if x]
                error = ""
                try:
                    if os.path.exists(op.source_path):
                        if all(intact(op.source_path, x) for x in targets):
                            os.unlink(op.source_path)
                        else:
                            error = f"not removed, a copy isn't intact: {op.source_path}"
                    elif not all(arrived(x, op.size, op.sha256) for x in targets):
                        error = f"source and copy are gone: {op.source_path}"
                except OSError as e:
                    error = f"{op.source_path}: {e}"
                rows.append((op.source_path, None, "removed", None if pd.isna(op.size) else int(op.size), not error, error or None))
            yield pd.DataFrame(rows, columns=["source_path", "target", "kind", "size", "done", "error"])

    return _described(ops).join(whole, "source_path", "left_semi").mapInPandas(run, SCHEMA)


def execute(ops: DataFrame, copy: bool = True, backup_enabled: bool = True) -> DataFrame:
    """One row a transfer and, for a move, one a removed source. A move's copies are written as a table first: no source goes before."""
    done = copies(ops, backup_enabled)
    if copy:
        return done
    done = written(done)
    return done.unionAll(written(removals(ops, done)))


class Run:
    """The folder of one run: the tables of its steps, each complete or to be done (again)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def has(self, step: str) -> bool:
        return self._fs.exists(self._hadoop.Path(f"{self.path}/{step}/_SUCCESS"))

    def read(self, step: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{step}")

    def table(self, step: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The step's table; made and written if it isn't complete."""
        if not self.has(step):
            make().write.mode("overwrite").parquet(f"{self.path}/{step}")
        return self.read(step)


def carry_out(run: Run, record: Callable[[DataFrame, DataFrame], None], copy: bool = True, backup_enabled: bool = True) -> DataFrame:
    """All steps of a run whose ``plan`` is written: the transfers. ``record(plan, done)`` is called between copies and removals, again if the run is taken up again."""
    plan = run.read("plan")
    done = run.table("copies", lambda: copies(plan, backup_enabled))
    if not run.has("recorded"):
        record(plan, done)
        run.table("recorded", lambda: done.groupBy("kind", "done").count())
    return done if copy else done.unionAll(run.table("removals", lambda: removals(plan, done)))


def unfinished(spark: SparkSession, folder: str) -> list[Run]:
    """The runs below a folder that have a plan and not all of their steps."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [Run(spark, x.getPath().toString()) for x in fs.listStatus(path)] if fs.exists(path) else []
    last = lambda run: "recorded" if run.read("settings").head()["copy"] else "removals"
    return [x for x in found if x.has("plan") and x.has("settings") and not x.has(last(x))]


def outcome(transfers: DataFrame, copy: bool = True) -> DataFrame:
    """Totals of a run. The errors themselves are rows of the transfers (``errors``)."""
    own, saved = F.col("kind") == "organized", F.col("kind") == "backup"
    done = F.count_if(own & F.col("done"))
    zero = F.lit(0).cast("long")
    return transfers.agg(
        F.count_if(own).alias("files_processed"), (done if copy else zero).alias("files_copied"), (zero if copy else done).alias("files_moved"), F.count_if(own & ~F.col("done")).alias("files_skipped"),
        F.count_if(saved & F.col("done")).alias("files_backed_up"), F.count_if(saved & ~F.col("done")).alias("backup_skipped"), F.coalesce(F.sum(F.when(saved & F.col("done"), F.col("size"))), zero).alias("backup_size"),
        F.count("error").alias("error_count"),
    )


def errors(transfers: DataFrame) -> DataFrame:
    return transfers.where("error is not null").select("source_path", "kind", "error")
