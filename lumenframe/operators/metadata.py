"""Normalised metadata: from raw tag maps, through the cache, with fallbacks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import extension, parse_datetime, safe_float, safe_int

#: Tags that may hold the time of a picture, the first present wins.
TIME_TAGS = ("EXIF:DateTimeOriginal", "EXIF:CreateDate", "EXIF:DateTime", "DateTimeOriginal", "CreateDate", "DateTime")
FIELDS = {
    "Make": "string", "Model": "string", "LensModel": "string", "DateTime": "string", "ISO": "bigint", "FNumber": "double", "ExposureTime": "string", "FocalLength": "double",
    "GPSLatitude": "double", "GPSLongitude": "double", "FileSize": "bigint", "FileType": "string", "ImageWidth": "bigint", "ImageHeight": "bigint",
}


def first_filled(tags: Column, *names: str) -> Column:
    """The first tag that is neither absent, empty nor zero."""
    some = [F.try_element_at(tags, F.lit(n)) for n in names]
    return F.coalesce(*[F.when((x != "") & F.coalesce(x.try_cast("double") != 0, F.lit(True)), x) for x in some])


def normalise(tags: Column) -> Column:
    """A raw tag map as a struct of fixed fields; coordinates only if both are there."""
    both = lambda name: (f"EXIF:{name}", name)
    text = lambda *names: F.coalesce(first_filled(tags, *names), F.lit(""))
    latitude, longitude = (safe_float(first_filled(tags, *both(n))) for n in ("GPSLatitude", "GPSLongitude"))
    there = latitude.isNotNull() & longitude.isNotNull()
    taken = F.coalesce(*[F.try_element_at(tags, F.lit(n)) for n in TIME_TAGS])
    values = {
        "Make": text(*both("Make")), "Model": text(*both("Model")), "LensModel": text("EXIF:LensModel", "LensModel", "EXIF:LensInfo", "LensInfo"), "DateTime": F.coalesce(parse_datetime(taken), F.lit("")),
        "ISO": safe_int(first_filled(tags, *both("ISO"))), "FNumber": safe_float(first_filled(tags, *both("FNumber"))), "ExposureTime": text(*both("ExposureTime")), "FocalLength": safe_float(first_filled(tags, *both("FocalLength"))),
        "GPSLatitude": F.when(there, latitude), "GPSLongitude": F.when(there, longitude), "FileSize": safe_int(first_filled(tags, "File:FileSize", "FileSize")), "FileType": text("File:FileType", "FileType"),
        "ImageWidth": safe_int(first_filled(tags, "EXIF:ImageWidth", "File:ImageWidth", "ImageWidth")), "ImageHeight": safe_int(first_filled(tags, "EXIF:ImageHeight", "File:ImageHeight", "ImageHeight")),
    }
    return F.struct(*[values[k].cast(kind).alias(k) for k, kind in FIELDS.items()])


def from_file(modified: Column, size: Column, path: Column) -> Column:
    """What the file system alone tells; without a time now, without a size 0."""
    known = {"DateTime": F.date_format(F.coalesce(modified, F.current_timestamp()), "yyyy-MM-dd'T'HH:mm:ss"), "FileSize": F.coalesce(size, F.lit(0)), "FileType": extension(path)}
    empty = {"string": F.lit("")}
    return F.struct(*[known.get(k, empty.get(kind, F.lit(None))).cast(kind).alias(k) for k, kind in FIELDS.items()])


def cached(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files (path, mtime) with the cached tag map: null on a miss, and where the text is no JSON object or an empty one."""
    tags = F.from_json("exif_data", "map<string,string>")
    known = cache.select(F.col("file_path").alias("path"), F.col("file_mtime").alias("mtime"), tags.alias("tags")).where(F.size("tags") > 0).dropDuplicates(["path", "mtime"])
    return files.join(known, ["path", "mtime"], "left")


def tagged(files: DataFrame, cache: DataFrame, reader: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All columns of ``files`` and ``tags``: from the cache where it knows the file at that time, else from ``reader``, which opens only the rest."""
    rows, names = cached(files, cache), files.columns
    known = rows.where("tags is not null").select(*names, "tags")
    return known.unionByName(reader(rows.where("tags is null").select(*names)).select(*names, "tags"))


def cache_rows(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """Cache entries of the rows (path, mtime, tags) that have tags and aren't in the cache as they are."""
    found = rows.where(F.size("tags") > 0).select(F.col("path").alias("file_path"), F.col("mtime").alias("file_mtime"), F.to_json("tags").alias("exif_data"))
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("created_date")
    return found.join(cache.select("file_path", "file_mtime", "exif_data"), found.columns, "left_anti").select("*", now)


def chosen(tags: Column) -> Column:
    """The metadata of a file (path, size, modified_time): from its tags, else from the file system."""
    return F.when(F.size(tags) > 0, normalise(tags)).otherwise(from_file(F.col("modified_time"), F.col("size"), F.col("path")))

