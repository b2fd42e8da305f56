"""The persistent catalog: bucketed Parquet tables with a log of commits and last-write-wins upserts.

A table is a folder of data, whose files are bucketed by the table's key, and a log of numbered
snapshots. A snapshot names a generation of the data and the commits in it that count, oldest first. A put writes its own rows
alone, as one more commit of the generation, and then the next snapshot, which no other writer can have
written: that file is renamed into place only if it isn't there. A writer that loses the race
reads the new snapshot and tries again. A read takes the rows of the snapshot's commits and the last of each key; rows of
commits that no snapshot names, such as those of a writer that died, don't count. After ``COMPACT_AFTER`` commits
a put merges them into a new generation; the one before stays for those who still read it.

Since all files of a generation are bucketed by key, neither the merge on read nor a join by key
moves a row of the catalog. Snapshots carry the version of the schema that their data have; older ones are
brought up to date as they are read (``STEPS``).
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCHEMAS = {
    "file_records": "source_path string, dest_path string, raw_backup_path string, sha256_hash string, perceptual_hash string, file_size long, file_mtime long, created_date string, processed_date string, camera_model string, lens_model string, device_code string, operation_type string, processing_status string, id long",
    "file_paths": "source_path string, file_mtime long, sha256_hash string",
    "exif_cache": "file_path string, file_mtime long, exif_data string, created_date string",
    "directory_cache": "directory_path string, scan_timestamp string, file_count long, last_modified double",
    "directory_entries": "directory_path string, scan_timestamp string, last_modified double, names array<string>, folders array<string>",
}
KEYS = {"file_records": ["sha256_hash"], "file_paths": ["source_path", "file_mtime"], "exif_cache": ["file_path", "file_mtime"], "directory_cache": ["directory_path"], "directory_entries": ["directory_path"]}
COMPACT_AFTER = 20
BUCKETS = 16
ATTEMPTS = 20
#: Snapshots that stay in the log.
KEPT = 100


@dataclass(frozen=True)
class Step:
    """How a table's schema came from the version before: columns that got another name (old to new); those that are new are null in older data."""

    renamed: dict[str, str] = field(default_factory=dict)


#: By table, the steps to version 2, 3 and so on; ``SCHEMAS`` are those of the last.
STEPS: dict[str, list[Step]] = {}


@dataclass(frozen=True)
class Snapshot:
    version: int = 0
    data: str = ""
    commits: tuple[str, ...] = ()
    buckets: int = BUCKETS
    schema: int = 1
    columns: str = ""
    superseded: str = ""


def columns_of(ddl: str) -> list[tuple[str, str]]:
    """(name, type) of the columns of a schema."""
    return [tuple(part.strip().split(" ", 1)) for part in re.split(r",(?![^<]*>)", ddl)]


def conform(rows: DataFrame, ddl: str) -> DataFrame:
    """The columns of a schema in its order; those that ``rows`` lacks are null."""
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c) for c, kind in columns_of(ddl)])


def last_of(rows: DataFrame, key: list[str], order: str | Column) -> DataFrame:
    """The last row of each key; of equal last ones that with the greatest digest of its columns."""
    order = F.col(order) if isinstance(order, str) else order
    digest = F.xxhash64(*[F.col(c) for c in rows.columns])
    return rows.withColumn("_last", F.row_number().over(W.partitionBy(*key).orderBy(order.desc(), digest.desc()))).where("_last = 1").drop("_last")


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with their keys; of several new ones the last counts."""
    rows = last_of(new, key, order or F.lit(0)).select(*old.columns)
    return old.join(rows.select(*key), key, "left_anti").select(*old.columns).unionByName(rows)


def record(files: DataFrame) -> DataFrame:
    """Catalog rows of processed files, with the defaults of missing fields."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in files.columns else F.lit("")
    has = lambda c: F.col(c) if c in files.columns else F.lit(None).cast("string")
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    return files.select(
        F.col("path").alias("source_path"), has("dest_path").alias("dest_path"), has("raw_backup_path").alias("raw_backup_path"), F.col("sha256").alias("sha256_hash"), has("perceptual").alias("perceptual_hash"),
        F.col("size").alias("file_size"), F.col("mtime").alias("file_mtime"), F.date_format(F.timestamp_seconds("mtime"), "yyyy-MM-dd'T'HH:mm:ss").alias("created_date"), now.alias("processed_date"),
        text("camera_model").alias("camera_model"), text("lens_model").alias("lens_model"), text("device_code").alias("device_code"),
        F.when(has("dest_path").isNotNull(), "organized").otherwise("raw_backup").alias("operation_type"), F.lit("completed").alias("processing_status"), F.col("seq").alias("id"),
    )


def size_range(records: DataFrame, least: int, most: int) -> DataFrame:
    return records.where(F.col("file_size").between(least, most)).select("source_path", "sha256_hash", "perceptual_hash", "file_size", "file_mtime")


def by_hash(records: DataFrame, digests: DataFrame) -> DataFrame:
    """For each of the digests (sha256) that a record has, the record: the first by id, should several have it."""
    wanted = digests.select(F.col("sha256").alias("sha256_hash")).distinct()
    names = [c for c in records.columns if c != "sha256_hash"]
    first = records.join(wanted, "sha256_hash", "left_semi").groupBy("sha256_hash").agg(F.min_by(F.struct(*names), "id").alias("_first"))
    return first.select("sha256_hash", *[F.col("_first")[c].alias(c) for c in names])


def by_path(records: DataFrame, path: str, mtime: int) -> DataFrame:
    return records.where((F.col("source_path") == path) & (F.col("file_mtime") == mtime)).orderBy("id").limit(1)


def by_perceptual(records: DataFrame, looks: DataFrame) -> DataFrame:
    """All records with one of the perceptual hashes (perceptual)."""
    return records.join(looks.select(F.col("perceptual").alias("perceptual_hash")).distinct(), "perceptual_hash", "left_semi")


def directory_changed(directories: DataFrame, cache: DataFrame) -> DataFrame:
    """(directory_path, modified) with ``changed``: not cached, not readable, or newer than the cache."""
    known = cache.select("directory_path", "last_modified")
    return directories.join(known, "directory_path", "left").withColumn("changed", F.coalesce(F.col("modified") > F.col("last_modified"), F.lit(True))).drop("last_modified")


def unexpired(cache: DataFrame, stamp: str, days: int, cutoff: Column | None = None) -> DataFrame:
    """Rows whose text time ``stamp`` isn't before the cutoff (``days`` ago); none for 0 days."""
    if days == 0:
        return cache.limit(0)
    edge = F.date_format(F.current_timestamp() - F.make_interval(days=F.lit(days)), "yyyy-MM-dd'T'HH:mm:ss") if cutoff is None else cutoff
    return cache.where(F.col(stamp) >= edge)


def counts(records: DataFrame, exif: DataFrame, directories: DataFrame) -> DataFrame:
    """One row: rows of the three tables and the number of devices (an empty one counts)."""
    one = records.agg(F.count("*").alias("total_files"), F.count_distinct("device_code").alias("unique_devices"))
    return one.join(F.broadcast(exif.agg(F.count("*").alias("cached_exif_entries")))).join(F.broadcast(directories.agg(F.count("*").alias("cached_directories"))))


@dataclass
class Catalog:
    """Tables below ``root``; any file system that Spark reads. New tables get ``buckets`` buckets: as many as a large join has partitions."""

    spark: SparkSession
    root: str
    buckets: int = BUCKETS

    # files

    def _folder(self, table: str):
        """The table's file system and folder."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs, fs.makeQualified(folder)

    def _path(self, parent, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(parent, name)

    def _log(self, table: str) -> dict:
        """The snapshots' files by number."""
        fs, folder = self._folder(table)
        log = self._path(folder, "_log")
        paths = [x.getPath() for x in fs.listStatus(log)] if fs.exists(log) else []
        return {int(p.getName()[:-5]): p for p in paths if re.fullmatch(r"\d{20}\.json", p.getName())}

    def snapshot(self, table: str) -> Snapshot | None:
        """The last one; None where nothing was ever put."""
        found = self._log(table)
        if not found:
            return None
        stream = self._folder(table)[0].open(found[max(found)])
        try:
            read = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        return Snapshot(**read | {"commits": tuple(read["commits"])})

    def version(self, table: str) -> int | None:
        found = self._log(table)
        return max(found) if found else None

    def _commit(self, table: str, snapshot: Snapshot) -> bool:
        """Write the snapshot under its number; False if there is one of that number."""
        jvm, (fs, folder) = self.spark._jvm, self._folder(table)
        log = self._path(folder, "_log")
        fresh = self._path(log, f".{uuid.uuid4().hex}")
        stream = fs.create(fresh, True)
        stream.write(bytearray(json.dumps(asdict(snapshot)).encode()))
        stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(log.toUri(), self.spark._jsc.hadoopConfiguration())
        unless_there = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(fresh, self._path(log, f"{snapshot.version:020d}.json"), unless_there)
        except Py4JJavaError as e:
            fs.delete(fresh, False)
            if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                return False
            raise
        for number, path in self._log(table).items():
            if number <= snapshot.version - KEPT:
                fs.delete(path, False)
        return True

    # data

    def _bucketed(self, table: str, location: str, ddl: str, buckets: int) -> str:
        """The name of a new table over ``location``, so that Spark knows that its files are bucketed by key. Whoever asked drops it; the files stay."""
        name = f"lumenframe_{uuid.uuid4().hex}"
        key = ", ".join(f"`{c}`" for c in self._old_names(table, ddl))
        place = location.replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE {name} ({ddl}, _commit string) USING parquet CLUSTERED BY ({key}) INTO {buckets} BUCKETS LOCATION '{place}'")
        return name

    def _old_names(self, table: str, ddl: str) -> list[str]:
        """The key's columns as the schema ``ddl`` names them."""
        before = {new: old for step in STEPS.get(table, []) for old, new in step.renamed.items()}
        there = {c for c, _ in columns_of(ddl)}
        return [c if c in there else before[c] for c in KEYS[table]]

    def _write(self, table: str, rows: DataFrame, data: str, commit: str, buckets: int) -> int:
        """Add the rows to a generation as files of a commit that doesn't count yet; how many they are."""
        fs, folder = self._folder(table)
        ddl, seen = SCHEMAS[table], Observation()
        stage, target = self._path(folder, f"_put-{commit}"), self._path(folder, data)
        name = self._bucketed(table, stage.toString(), ddl, buckets)
        out = conform(rows, ddl).withColumn("_commit", F.lit(commit)).observe(seen, F.count(F.lit(1)).alias("rows"))
        try:
            out.repartition(buckets, *KEYS[table]).sortWithinPartitions(*KEYS[table]).write.insertInto(name)
        finally:
            self.spark.sql(f"DROP TABLE {name}")
        fs.mkdirs(target)
        for file in fs.listStatus(stage):
            if not file.getPath().getName().startswith(("_", ".")):
                fs.rename(file.getPath(), self._path(target, file.getPath().getName()))
        fs.delete(stage, True)
        return seen.get["rows"]

    def _rows(self, table: str, snapshot: Snapshot | None) -> DataFrame:
        if snapshot is None:
            return self.spark.createDataFrame([], SCHEMAS[table])
        location = self._path(self._folder(table)[1], snapshot.data).toString()
        name = self._bucketed(table, location, snapshot.columns, snapshot.buckets)
        rows = self.spark.table(name).where(F.col("_commit").isin(list(snapshot.commits)))
        self.spark.sql(f"DROP TABLE {name}")  # the rows have what they need of it
        if len(snapshot.commits) > 1:
            rows = last_of(rows, self._old_names(table, snapshot.columns), F.array_position(F.array(*map(F.lit, snapshot.commits)), F.col("_commit")))
        for step in STEPS.get(table, [])[snapshot.schema - 1 :]:
            rows = rows.withColumnsRenamed(step.renamed)
        return conform(rows, SCHEMAS[table])

    def read(self, table: str) -> DataFrame:
        """The table as its last snapshot has it, whatever is written later."""
        return self._rows(table, self.snapshot(table))

    def rewrite(self, table: str, change: Callable[[DataFrame], DataFrame]) -> None:
        """A new generation: what ``change`` makes of the rows, which keeps keys unique. Tried again if someone else wrote meanwhile."""
        for _ in range(ATTEMPTS):
            before = self.snapshot(table)
            commit = uuid.uuid4().hex
            after = Snapshot((before.version if before else 0) + 1, f"data-{commit}", (commit,), before.buckets if before else self.buckets, len(STEPS.get(table, [])) + 1, SCHEMAS[table], before.data if before else "")
            self._write(table, change(self._rows(table, before)), after.data, commit, after.buckets)
            fs, folder = self._folder(table)
            if self._commit(table, after):
                # the generation of the snapshot before stays for its readers, the one before that goes
                if before and before.superseded:
                    fs.delete(self._path(folder, before.superseded), True)
                return
            fs.delete(self._path(folder, after.data), True)
        raise RuntimeError(f"{table} is written by others all the time")

    def replace(self, table: str, rows: DataFrame) -> None:
        """All rows of a table anew; keys must be unique."""
        self.rewrite(table, lambda _: rows)

    def compact(self, table: str) -> None:
        self.rewrite(table, lambda rows: rows)

    def put(self, table: str, rows: DataFrame, order: str | None = None) -> None:
        """Upsert: write the rows alone (of several with one key the last by ``order``), as one more commit."""
        commit, written = uuid.uuid4().hex, None
        rows = last_of(rows, KEYS[table], order or F.lit(0))
        for _ in range(ATTEMPTS):
            before = self.snapshot(table)
            if before is None or len(before.commits) >= COMPACT_AFTER or before.schema <= len(STEPS.get(table, [])):
                if before is None and rows.isEmpty():
                    return
                return self.rewrite(table, lambda old: upsert(old, conform(rows, SCHEMAS[table]), KEYS[table]))
            if written != before.data:
                if not self._write(table, rows, before.data, commit, before.buckets):
                    return
                written = before.data
            if self._commit(table, replace(before, version=before.version + 1, commits=(*before.commits, commit))):
                return
        raise RuntimeError(f"{table} is written by others all the time")

    def expire(self, days: int = 30) -> None:
        for table, stamp in (("exif_cache", "created_date"), ("directory_cache", "scan_timestamp"), ("directory_entries", "scan_timestamp")):
            if self.version(table) is not None:
                self.rewrite(table, lambda rows, stamp=stamp: unexpired(rows, stamp, days))
