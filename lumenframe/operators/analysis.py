"""Statistics over metadata rows: histograms, ranges and the report.

Metadata columns: seq, Make, Model, LensModel, LensMake, Software, ExposureProgram,
MeteringMode, Flash, WhiteBalance, ColorSpace, ISO, FNumber, FocalLength,
ExposureTime, ExposureBias, ImageWidth, ImageHeight, GPSLatitude, GPSLongitude,
Artist, Copyright, DateTime; those that a table lacks count as null.

All histograms come from one unpivot and one shuffle: a row a (dimension, value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import aperture_label, area, aspect_ratio, focal_label, iso_label, resolution, shutter_label, strip

DETAILED = {"exposure_program": "ExposureProgram", "metering_mode": "MeteringMode", "flash": "Flash", "white_balance": "WhiteBalance", "color_space": "ColorSpace"}
TOP = 5


def _get(meta: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name).cast(kind) if name in meta.columns else F.lit(None).cast(kind)


def camera(make: Column, model: Column) -> Column:
    """``make model``, or the model alone; a make alone is no camera."""
    make, model = strip(make), strip(model)
    return F.when(model != "", F.when(make != "", F.concat_ws(" ", make, model)).otherwise(model))


def dimensions(meta: DataFrame, detailed: bool = True) -> dict[str, Column]:
    """Value columns (text) of the histograms, by dimension."""
    text = lambda name: strip(_get(meta, name))
    found = {
        "camera": camera(_get(meta, "Make"), _get(meta, "Model")),
        "lens": text("LensModel"),
        "lens_make": text("LensMake"),
        "software": text("Software"),
        "resolution": resolution(_get(meta, "ImageWidth", "int"), _get(meta, "ImageHeight", "int")),
        "aperture": _get(meta, "FNumber", "double").cast("string"),
        "iso": _get(meta, "ISO", "int").cast("string"),
        "focal_length": _get(meta, "FocalLength", "double").cast("int").cast("string"),
        "shutter": _get(meta, "ExposureTime"),
        "exposure_bias": _get(meta, "ExposureBias"),
    }
    return found | ({k: _get(meta, name) for k, name in DETAILED.items()} if detailed else {})


def histograms(meta: DataFrame, detailed: bool = True, only: list[str] | None = None) -> DataFrame:
    """dim, value, n, first_seq"""
    pairs = [F.struct(F.lit(k).alias("dim"), v.alias("value")) for k, v in dimensions(meta, detailed).items() if only is None or k in only]
    rows = meta.select("seq", F.inline(F.array(*pairs))).where("value is not null and value != ''")
    return rows.groupBy("dim", "value").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


def ranked(hist: DataFrame) -> DataFrame:
    """With ``place``: by count, then by first appearance, in each dimension."""
    return hist.withColumn("place", F.row_number().over(W.partitionBy("dim").orderBy(F.desc("n"), "first_seq")))


def top(hist: DataFrame, k: int = TOP) -> DataFrame:
    return ranked(hist).where(F.col("place") <= k)


def label(dim: Column, value: Column) -> Column:
    return (
        F.when(dim == "aperture", aperture_label(value.try_cast("double")))
        .when(dim == "iso", iso_label(value))
        .when(dim == "focal_length", focal_label(value.try_cast("int")))
        .when(dim == "shutter", shutter_label(value))
        .otherwise(value)
    )


def ranges(meta: DataFrame) -> DataFrame:
    """One row: least and most aperture, ISO, focal length and day; null where there is none."""
    span = lambda c, name: [F.min(c).alias(f"{name}_min"), F.max(c).alias(f"{name}_max")]
    day = F.date_format(_get(meta, "DateTime", "timestamp_ntz"), "yyyy-MM-dd")
    return meta.agg(*span(_get(meta, "FNumber", "double"), "aperture"), *span(_get(meta, "ISO", "int"), "iso"), *span(_get(meta, "FocalLength", "double"), "focal"), *span(day, "date"))


def presence(meta: DataFrame) -> DataFrame:
    """One row: files with both coordinates, with an artist, with a copyright."""
    filled = lambda name: F.coalesce(F.length(_get(meta, name)) > 0, F.lit(False))
    both = _get(meta, "GPSLatitude", "double").isNotNull() & _get(meta, "GPSLongitude", "double").isNotNull()
    return meta.agg(F.count_if(both).alias("files_with_gps"), F.count_if(filled("Artist")).alias("files_with_artist"), F.count_if(filled("Copyright")).alias("files_with_copyright"))


def top_resolutions(hist: DataFrame, k: int = 3) -> DataFrame:
    """The k most frequent resolutions and one row for all others: value, n, percent, place."""
    rows = ranked(hist.where("dim = 'resolution'")).withColumn("_part", F.least("place", F.lit(k + 1)))
    rows = rows.groupBy("_part").agg(F.min("value").alias("value"), F.sum("n").alias("n"), F.count("*").alias("members"), F.min("place").alias("place"))
    rows = rows.withColumn("all", F.sum("n").over(W.partitionBy(F.lit(0))))
    other = F.format_string("Other (%d resolutions)", "members")
    return rows.select(F.when(F.col("_part") > k, other).otherwise(F.col("value")).alias("value"), "n", (F.col("n") * 100 / F.col("all")).alias("percent"), F.col("_part").alias("place"))


def largest_resolutions(hist: DataFrame, k: int = 10) -> DataFrame:
    """The k largest resolutions by area, with aspect ratio and percent of all."""
    rows = hist.where("dim = 'resolution'").withColumn("all", F.sum("n").over(W.partitionBy(F.lit(0))))
    rows = rows.select("value", area(F.col("value")).alias("area"), aspect_ratio(F.col("value")).alias("aspect"), "n", (F.col("n") * 100 / F.col("all")).alias("percent"), "first_seq")
    return rows.orderBy(F.desc("area"), "first_seq").limit(k)


def most_frequent(hist: DataFrame) -> DataFrame:
    """The first of the most frequent values of each dimension: dim, value, n."""
    return hist.groupBy("dim").agg(F.max_by("value", F.struct("n", -F.col("first_seq"))).alias("value"), F.max("n").alias("n"))


def report(files: DataFrame, meta: DataFrame, detailed: bool = True) -> DataFrame:
    """The whole analysis as one row; all zero or empty where no file is an image."""
    from .scan import KINDS, totals, value_counts

    hist = ranked(histograms(meta, detailed))
    maps = hist.groupBy("dim").agg(
        F.map_from_entries(F.transform(F.sort_array(F.collect_list(F.struct("place", "value", "n"))), lambda x: F.struct(x["value"], x["n"]))).alias("counts"),
        F.transform(F.filter(F.sort_array(F.collect_list(F.struct("place", label(F.col("dim"), F.col("value")).alias("label"), "n"))), lambda x: x["place"] <= TOP), lambda x: F.struct(x["label"].alias("label"), x["n"].alias("n"))).alias("top"),
    )
    pick = lambda dim, what: F.max_by(what, F.when(F.col("dim") == dim, 1))
    names = {"camera": "cameras", "lens": "lenses", "lens_make": "lens_makes", "software": "software", "resolution": "resolutions", "exposure_program": "exposure_programs", "metering_mode": "metering_modes", "flash": "flash_usage", "white_balance": "white_balance", "color_space": "color_spaces", "exposure_bias": "exposure_compensation"}
    tops = {"aperture": "most_used_apertures", "iso": "most_used_isos", "focal_length": "most_used_focal_lengths", "shutter": "common_shutter_speeds"}
    wide = maps.agg(*[pick(d, "counts").alias(v) for d, v in names.items()], *[pick(d, "top").alias(v) for d, v in tops.items()])
    kinds = files.agg(
        F.count_if(F.col("file_type").isin("raw", "jpeg")).alias("_images"),
        F.create_map(*[x for k in KINDS for x in (F.lit(k), F.count_if(F.col("file_type") == k))]).alias("files_by_type"),
        F.create_map(*[x for k in KINDS for x in (F.lit(k), F.coalesce(F.sum(F.when(F.col("file_type") == k, F.col("size"))), F.lit(0)))]).alias("size_by_type"),
    )
    exts = value_counts(files, F.col("extension")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("value", "n")))).alias("file_extensions"))
    analysed = meta.agg(F.count("*").alias("image_files_analyzed"))
    one = totals(files)
    for part in (kinds, exts, analysed, ranges(meta), presence(meta), wide):
        one = one.join(F.broadcast(part))
    none = F.col("_images") == 0
    zero = {c: F.when(none, F.lit(0)).otherwise(F.col(c)) for c in ("total_files", "total_size", "directories_scanned", "image_files_analyzed")}
    rate = F.when(none, F.lit(0.0)).otherwise(F.col("image_files_analyzed") * 100 / F.col("_images"))
    return one.withColumn("success_rate", rate).withColumns(zero).drop("_images")
