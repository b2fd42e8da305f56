"""The two entry points: analyse a directory, ingest a directory."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from importlib import import_module

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from .catalog import Catalog, record
from .config import FileTypes, IngestConfig, PeekConfig
from .durable import written
from .functions import decode, exif_timestamp, bias_label, safe_float, safe_int
from .operators import analysis, dedup, device, execute, metadata, plan, scan
from .sources.exif import with_tags
from .sources.media import checked, entries, found_files, walk
from .sources.media import scan as scan_directory


#: Groups of tags, in the order in which they are asked.
GROUPS = ("EXIF:", "Composite:", "File:", "MakerNotes:", "XMP:", "IPTC:", "QuickTime:")


def typed(rows: DataFrame) -> DataFrame:
    """Raw tags, bare or with the group that an external reader puts before them, as metadata columns."""
    tag = lambda name: F.coalesce(*[F.try_element_at("tags", F.lit(group + name)) for group in ("", *GROUPS)])
    text = {k: tag(k) for k in ("Make", "Model", "LensModel", "LensMake", "Software", "Artist", "Copyright", "ExposureTime")}
    number = {k: safe_float(tag(k)) for k in ("FNumber", "FocalLength", "GPSLatitude", "GPSLongitude")}
    whole = {k: safe_int(tag(k)).cast("int") for k in ("ISO", "ImageWidth", "ImageHeight")}
    named = {k: decode(k, safe_int(tag(k))) for k in ("ExposureProgram", "MeteringMode", "Flash", "WhiteBalance", "ColorSpace")}
    taken = F.coalesce(*[exif_timestamp(tag(k)) for k in ("DateTime", "DateTimeOriginal", "DateTimeDigitized")])
    return rows.withColumns(text | number | whole | named | {"DateTime": taken, "ExposureBias": bias_label(safe_float(tag("ExposureBias")))})


def scanned(spark: SparkSession, path: str, types: FileTypes, catalog: Catalog | None) -> DataFrame:
    """The supported files of a directory. With a catalog, directories that it knows unchanged aren't listed, and what was listed is put there."""
    if catalog is None:
        return scan_directory(spark, path, types).where("error is null")
    listing = walk(spark, checked(path), catalog.read("directory_entries"), types.all_extensions())
    fresh = entries(listing)
    catalog.put("directory_entries", fresh)
    catalog.put("directory_cache", fresh)
    return found_files(listing, types).where("error is null")


def tags_of(files: DataFrame, catalog: Catalog | None, exiftool: bool, detailed: bool) -> DataFrame:
    """With ``tags``, read through the catalog's cache, which gets those that it lacked. A cache has one way of reading: with the external tool or without."""
    read = lambda rows: with_tags(rows, exiftool, detailed)
    if catalog is None:
        return read(files)
    cache = catalog.read("exif_cache")
    rows = written(metadata.tagged(files, cache, read))
    catalog.put("exif_cache", metadata.cache_rows(rows, cache))
    return rows


def analyse(spark: SparkSession, path: str, types: FileTypes = FileTypes(), detailed: bool = True, exiftool: bool = False, catalog_root: str | None = None) -> DataFrame:
    """The one-row report of a directory; with ``catalog_root``, unchanged directories aren't listed and known files aren't opened again."""
    catalog = Catalog(spark, catalog_root) if catalog_root else None
    files = scanned(spark, path, types, catalog)
    meta = tags_of(scan.images(files).select("seq", "path", "mtime"), catalog, exiftool, False)
    # a file without embedded tags counts as one without metadata, its size in pixels alone doesn't
    known = F.size("tags") > 0 if not detailed else F.size(F.map_filter("tags", lambda k, _: ~k.isin("ImageWidth", "ImageHeight"))) > 0
    return analysis.report(files, typed(meta.where(known)), detailed)


def peek(files: DataFrame, settings: PeekConfig, describe: Callable[[str], str] | None = None) -> DataFrame:
    """A few files of each kind, the first by path: file_type, path, size, camera, taken, note.

    ``describe`` tells something of a picture from its path, in tasks; where it fails, the note is its error.
    """
    some = scan.sample_per_group(files.where(F.col("extension").isin(settings.supported_formats)), "file_type", settings.sample_count)
    rows = typed(with_tags(some.select("seq", "file_type", "path", "size"), detailed=False))
    rows = rows.select("seq", "file_type", "path", "size", analysis.camera(F.col("Make"), F.col("Model")).alias("camera"), F.date_format("DateTime", "yyyy-MM-dd").alias("taken"))

    def noted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            notes = []
            for path in frame["path"]:
                try:
                    notes.append(str(describe(path)))
                except Exception as e:  # whatever a describer raises is about one picture
                    notes.append(f"not described: {e}")
            yield frame.assign(note=notes)

    if describe is None:
        return rows.withColumn("note", F.lit(None).cast("string"))
    return rows.mapInPandas(noted, StructType([*rows.schema, StructField("note", StringType())]))


def describer(name: str) -> Callable[[str], str]:
    """The function that ``module:function`` names."""
    module, _, function = name.partition(":")
    return getattr(import_module(module), function)


def ingest(spark: SparkSession, source: str, event: str, config: IngestConfig, catalog_root: str, backup: str, dry_run: bool = False, copy: bool = True, raw_only: bool = False, organized_only: bool = False, exiftool: bool = False) -> tuple[DataFrame, DataFrame]:
    """(operations, outcome): scan, fingerprint, classify, plan, and unless it is a dry run carry out and record.

    Where the settings allow it, directories are listed and tags read through the catalog's caches; a dry run fills them, too.
    A run's plan and what its steps did are kept below ``_runs`` in the catalog: see ``resume``.
    """
    catalog = Catalog(spark, catalog_root)
    files = scanned(spark, source, config.file_types, catalog if config.performance.incremental_processing else None)
    files = tags_of(files, catalog if config.performance.cache_exif else None, exiftool, False)
    hashed = files.mapInPandas(_fingerprints, files.drop("tags").schema.add("sha256", "string").add("grey", ArrayType(DoubleType())).add("tags", files.schema["tags"].dataType))
    hashed = written(hashed.where("sha256 is not null").withColumn("perceptual", dedup.average_hash(F.col("grey"))).drop("grey"))
    known, paths = catalog.read("file_records"), catalog.read("file_paths")
    compared = dedup.against_catalog(dedup.within_batch(hashed).withColumnsRenamed({"status": "batch", "existing_file": "_first"}), known, paths)
    status = F.when(F.col("batch") == "duplicate", "duplicate").otherwise(F.col("status"))
    rows = compared.withColumns({"status": status, "existing_file": F.coalesce("existing_file", "_first")}).drop("_first")
    rows = rows.withColumns({"device_code": device.detect(F.col("tags"), config.devices)["device_code"], "taken": F.coalesce(*[F.try_element_at("tags", F.lit(k)) for k in ("DateTimeOriginal", "DateTime")])})
    rows = written(rows)
    root = plan.common_root(rows).head()["root"]
    kinds = {"raw_only": raw_only, "organized_only": organized_only}
    ops = plan.plan(rows, rows.select("path", "status"), F.lit(event), config.archive_root, backup, root=F.lit(root), preserve=config.raw_backup.preserve_structure, **kinds)
    if dry_run:
        return ops, plan.dry_run(ops, rows, copy)
    run = execute.Run(spark, f"{catalog_root}/_runs/{uuid.uuid4().hex}")
    run.table("plan", lambda: ops.join(rows.drop("seq", "status", "device_code").withColumnRenamed("path", "source_path"), "source_path"))
    run.table("settings", lambda: spark.createDataFrame([(copy, config.raw_backup.enabled or raw_only, event)], "copy boolean, backup boolean, event string"))
    done = _carry_out(run, catalog)
    return run.read("plan").select(*ops.columns), execute.outcome(done, copy)


def _carry_out(run: execute.Run, catalog: Catalog) -> DataFrame:
    settings = run.read("settings").head()

    def put(plan: DataFrame, done: DataFrame) -> None:
        moved = done.where("done").select("source_path").distinct()
        rows = record(plan.join(moved, "source_path", "left_semi").withColumnRenamed("source_path", "path"))
        catalog.put("file_records", rows, "id")
        catalog.put("file_paths", rows)

    return execute.carry_out(run, put, settings["copy"], settings["backup"])


def resume(spark: SparkSession, catalog_root: str) -> list[tuple[str, DataFrame]]:
    """Finish the runs that were cut short: (event, outcome) of each. Steps that were complete aren't repeated."""
    catalog = Catalog(spark, catalog_root)
    out = []
    for run in execute.unfinished(spark, f"{catalog_root}/_runs"):
        settings = run.read("settings").head()
        out.append((settings["event"], execute.outcome(_carry_out(run, catalog), settings["copy"])))
    return out


def _fingerprints(frames):
    """Digests of the files' bytes, and grey values of those that may have a perceptual hash; a file that can't be read has neither."""
    import hashlib

    from .sources.grey import grey_values

    for frame in frames:
        digests, greys = [], []
        for path, ext in zip(frame["path"], frame["extension"]):
            digest = grey = None
            try:
                with open(path, "rb") as file:
                    digest = hashlib.file_digest(file, "sha256").hexdigest()
                    grey = grey_values(file) if ext in scan.HASHED else None
            except OSError:
                pass
            digests.append(digest)
            greys.append(grey)
        yield frame.drop(columns=["tags"]).assign(sha256=digests, grey=greys, tags=frame["tags"])
