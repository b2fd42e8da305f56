"""Media files of a directory tree, hidden and empty ones too, as a batch and as a stream.

Spark's own file sources leave out names that begin with a dot or an underscore and
files without bytes; these list with the operating system. Executors must see the tree under the same
path.

``walk`` goes down the tree a level at a time: a frontier of directories is dealt to tasks, which list them, and
the folders that they find are the next frontier. The driver lists nothing. With a cache of what earlier walks
found, a directory that hasn't changed since isn't opened: its names come from the cache, and its
files' sizes and times are asked for as always. Changes within a directory's folders don't show in its
own time, so every directory's time is asked for.

``media`` is a streaming source: see ``MediaStreamReader``.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator
from datetime import datetime
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..config import FileTypes
from ..durable import written
from ..operators.scan import described

#: Files of a listed row; a directory of more entries isn't kept in the cache.
SLICE = 5000
#: Seconds that a directory must have been quiet before a listing of it may be trusted later.
SETTLED = 2.0
LISTING = "directory_path string, modified double, opened boolean, entries long, names array<string>, folders array<string>, files array<struct<path:string,size:long,modified_time:timestamp,error:string>>, error string"


def list_directory(path: str) -> tuple[list[str], list[str]]:
    """(names of what may be a file, paths of folders); links to folders are neither."""
    names, folders = [], []
    with os.scandir(path) as entries:
        for entry in entries:
            if entry.is_dir(follow_symlinks=False):
                folders.append(entry.path)
            else:
                names.append(entry.name)
    return names, folders


def stat_file(path: str) -> dict | None:
    """Size and time of a file; None where there is no regular one, the error where it can't be read."""
    try:
        if not os.path.isfile(path):
            return None
        stat = os.stat(path)
        return {"path": path, "size": stat.st_size, "modified_time": datetime.fromtimestamp(stat.st_mtime), "error": None}
    except OSError as e:
        return {"path": path, "size": None, "modified_time": None, "error": str(e)}


def extension_of(name: str) -> str:
    return os.path.splitext(name)[1][1:].lower()


def visited(wanted: set[str]):
    """What a task does with directories and what the cache has of them (last_modified, names, folders)."""

    def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                path = row.directory_path
                try:
                    modified = os.stat(path).st_mtime
                    opened = pd.isna(row.last_modified) or row.last_modified != modified
                    names, folders = list_directory(path) if opened else (list(row.names), list(row.folders))
                except OSError as e:
                    yield pd.DataFrame([(path, None, True, 0, [], [], [], str(e))], columns=columns)
                    continue
                if time.time() - modified < SETTLED:  # it may change again without another time
                    modified = -1.0
                count = len(names) + len(folders)
                for at in range(0, max(count, 1), SLICE):
                    own, below = names[at : at + SLICE], folders[max(0, at - len(names)) : max(0, at + SLICE - len(names))]
                    files = [f for f in (stat_file(os.path.join(path, x)) for x in own if not wanted or extension_of(x) in wanted) if f]
                    yield pd.DataFrame([(path, modified, opened, count, own, below, files, None)], columns=columns)

    columns = [part.split(" ")[0] for part in LISTING.split(", ")]
    return visit


def walk(spark: SparkSession, root: str, cache: DataFrame | None = None, wanted: list[str] | None = None, recursive: bool = True) -> DataFrame:
    """One row for each directory below ``root`` and ``SLICE`` entries of it (see ``LISTING``); ``opened``: it was listed now.

    ``cache``: directory_path, last_modified, names, folders. ``wanted``: extensions of the files to look at, none for all.
    """
    levels: list[DataFrame] = []
    frontier = spark.createDataFrame([(root,)], "directory_path string")
    unknown = [F.lit(None).cast(kind).alias(c) for c, kind in (("last_modified", "double"), ("names", "array<string>"), ("folders", "array<string>"))]
    while True:
        known = frontier.select("*", *unknown) if cache is None else frontier.join(cache.select("directory_path", "last_modified", "names", "folders"), "directory_path", "left")
        levels.append(written(known.mapInPandas(visited({x.lower() for x in wanted or []}), LISTING)))
        frontier = levels[-1].select(F.explode("folders").alias("directory_path")).repartition("directory_path")
        if not recursive or frontier.isEmpty():
            return reduce(DataFrame.unionAll, levels)


def numbered(files: DataFrame) -> DataFrame:
    """With ``seq``: the place of each row in the order of paths, from 1."""
    rows = written(files.orderBy("path").withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    # one number for each partition of the sort
    counts = rows.groupBy("_part").agg(F.count("*").alias("n"), F.min("_at").alias("first")).orderBy("_part").collect()
    before, starts = 0, []
    for r in counts:
        starts.append((r["_part"], before - r["first"] + 1))
        before += r["n"]
    start = F.broadcast(files.sparkSession.createDataFrame(starts, "_part int, _start long"))
    return rows.join(start, "_part").select((F.col("_start") + F.col("_at")).alias("seq"), *files.columns)


def found_files(listing: DataFrame, types: FileTypes = FileTypes()) -> DataFrame:
    """The files of a walk, with seq, type, extension, MIME type and mtime in whole seconds; ``error`` where one can't be read."""
    rows = numbered(listing.select(F.inline("files")))
    return described(rows, types).withColumn("mtime", F.floor(F.unix_micros("modified_time") / 1_000_000))


def scan(spark: SparkSession, path: str, types: FileTypes = FileTypes(), recursive: bool = True, cache: DataFrame | None = None) -> DataFrame:
    """Supported files of a directory tree, see ``found_files``."""
    return found_files(walk(spark, checked(path), cache, types.all_extensions(), recursive), types)


def checked(path: str) -> str:
    if not os.path.isdir(path):
        raise NotADirectoryError(path)
    return path


def entries(listing: DataFrame) -> DataFrame:
    """Rows for the catalog's ``directory_entries`` and ``directory_cache``: directories that were opened and whose listing can be trusted later."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("scan_timestamp")
    rows = listing.where(F.col("opened") & F.col("error").isNull() & (F.col("entries") <= SLICE) & (F.col("modified") >= 0))
    return rows.select("directory_path", now, F.size("files").cast("long").alias("file_count"), F.col("modified").alias("last_modified"), "names", "folders")


class Folder(InputPartition):
    def __init__(self, path: str, whole: bool, after: float, until: float):
        self.path, self.whole, self.after, self.until = path, whole, after, until


class MediaStreamReader(DataSourceStreamReader):
    """Files that came into the tree since the last batch, or were changed.

    Offsets are times. A file came when it or a folder that it lies in last changed its place, name or content as
    the system keeps it (ctime): copies that keep an old modification time, and trees that are moved in, count as new. A batch
    has the files that came after its start and up to its end, which lies ``settle`` seconds in the past. A file may
    come again, when its folder changes; streams drop those by path and time (``lumenframe.streaming``). The driver
    lists the root alone, tasks the trees below it.
    """

    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.settle = float(options.get("settle", "1"))
        self.wanted = {x for x in options.get("extensions", "").lower().split(",") if x}

    def initialOffset(self) -> dict:
        return {"until": 0.0}

    def latestOffset(self) -> dict:
        return {"until": time.time() - self.settle}

    def partitions(self, start: dict, end: dict) -> list[Folder]:
        below = sorted(list_directory(self.root)[1]) if os.path.isdir(self.root) else []
        return [Folder(self.root, False, start["until"], end["until"])] + [Folder(x, True, start["until"], end["until"]) for x in below]

    def commit(self, end: dict) -> None:
        pass

    def read(self, partition: Folder) -> Iterator[tuple]:
        # a folder's own time moves what lies in it: what came with it counts as come
        todo = [(partition.path, 0.0)]
        while todo:
            path, above = todo.pop()
            try:
                came = max(above, os.stat(path).st_ctime)
                names, folders = list_directory(path)
            except OSError:
                continue  # it went meanwhile
            if partition.whole:
                todo += [(x, came) for x in folders]
            for name in names:
                full = os.path.join(path, name)
                if self.wanted and extension_of(name) not in self.wanted or not (found := stat_file(full)) or found["error"]:
                    continue
                try:
                    at = max(came, os.stat(full).st_ctime)
                except OSError:
                    continue
                if partition.after < at <= partition.until:
                    yield full, found["size"], found["modified_time"]


class MediaSource(DataSource):
    """``spark.readStream.format("media")``; options ``path``, ``extensions`` (a comma-separated list, none for all) and ``settle``."""

    @classmethod
    def name(cls) -> str:
        return "media"

    def schema(self) -> str:
        return "path string, size long, modified_time timestamp"

    def streamReader(self, schema) -> MediaStreamReader:
        return MediaStreamReader(dict(self.options))


def stream(spark: SparkSession, path: str, types: FileTypes = FileTypes(), settle: float = 1.0) -> DataFrame:
    """A stream of the tree's supported files as they come, with mtime in whole seconds."""
    spark.dataSource.register(MediaSource)
    rows = spark.readStream.format("media").option("path", path).option("extensions", ",".join(types.all_extensions())).option("settle", str(settle)).load()
    return described(rows, types).withColumn("mtime", F.floor(F.unix_micros("modified_time") / 1_000_000))
