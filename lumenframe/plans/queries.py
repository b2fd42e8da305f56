"""One query an operator over the stand-in tables: its DataFrame form and its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import catalog as c
from .. import functions as fn
from ..operators import analysis, dedup, device, execute, metadata, plan, scan
from . import views as v

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        FOUND[f.__name__] = (f, sql)
        return f

    return add


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in FOUND.items() if sql}


# Scans, filters and summaries of files


@query(f"WITH {v.SQL_FILES} SELECT path, extension, file_type FROM typed WHERE file_type <> 'unknown'")
def scan_supported(spark, sf):
    return scan.supported(v.files(spark, sf)).select("path", "extension", "file_type")


@query(f"WITH {v.SQL_FILES} SELECT k AS file_type, count(t.seq)::BIGINT AS files, coalesce(sum(size), 0)::BIGINT AS bytes FROM (VALUES ('raw'), ('jpeg'), ('video')) x(k) LEFT JOIN typed t ON k = file_type GROUP BY k")
def files_by_type(spark, sf):
    return scan.per_type(v.files(spark, sf))


@query(f"WITH {v.SQL_FILES} SELECT count(*) AS total_files, coalesce(sum(size), 0)::BIGINT AS total_size, count(DISTINCT parent) AS directories_scanned FROM files")
def scan_totals(spark, sf):
    return scan.totals(v.files(spark, sf))


@query(f"WITH {v.SQL_FILES} SELECT path, size FROM files WHERE size BETWEEN 500 AND 5000")
def filter_size(spark, sf):
    return scan.by_size(v.files(spark, sf), 500, 5000).select("path", "size")


@query(f"WITH {v.SQL_FILES} SELECT path, file_type FROM typed WHERE file_type IN ('raw', 'video')")
def filter_type(spark, sf):
    return scan.by_type(v.files(spark, sf), ["raw", "video"]).select("path", "file_type")


@query(f"WITH {v.SQL_FILES} SELECT path, mtime FROM files WHERE modified_time BETWEEN TIMESTAMP '2023-11-20 00:00:00' AND TIMESTAMP '2023-12-10 00:00:00'")
def filter_date(spark, sf):
    at = lambda text: F.lit(text).cast("timestamp")
    return scan.by_date(v.files(spark, sf), at("2023-11-20 00:00:00"), at("2023-12-10 00:00:00")).select("path", "mtime")


@query(f"WITH {v.SQL_FILES} SELECT path FROM typed WHERE file_type IN ('raw', 'jpeg')")
def filter_images(spark, sf):
    return scan.images(v.files(spark, sf)).select("path")


@query(f"WITH {v.SQL_FILES} SELECT path FROM files WHERE extension IN ('jpg', 'jpeg', 'png', 'bmp', 'tiff', 'tif', 'heic', 'heif')")
def filter_hashable(spark, sf):
    return scan.hashable(v.files(spark, sf)).select("path")


@query(f"WITH {v.SQL_FILES} SELECT parent AS directory, count(*) AS files, sum(size)::BIGINT AS bytes FROM files GROUP BY parent")
def group_by_directory(spark, sf):
    return scan.per_directory(v.files(spark, sf))


@query(f"""WITH {v.SQL_FILES} SELECT count(*) AS total_files, sum(size)::BIGINT AS total_size, epoch(min(modified_time))::BIGINT AS earliest, epoch(max(modified_time))::BIGINT AS latest,
    arg_max(path, (size, seq)) AS largest, max(size) AS largest_size, arg_min(path, (size, seq)) AS smallest, min(size) AS smallest_size FROM files""")
def summary_stats(spark, sf):
    rows = scan.summary(v.files(spark, sf))
    return rows.withColumns({k: F.unix_seconds(k) for k in ("earliest", "latest")})


@query(f"WITH {v.SQL_FILES} SELECT extension AS value, count(*) AS n, min(seq) AS first_seq FROM files GROUP BY extension")
def extension_hist(spark, sf):
    return scan.value_counts(v.files(spark, sf), F.col("extension"))


@query(r"""SELECT url, regexp_extract(url, '([^/]*)$', 1) AS name, CASE WHEN regexp_extract(url, '^(.*)/[^/]*$', 1) <> '' THEN regexp_extract(url, '^(.*)/[^/]*$', 1) WHEN starts_with(url, '/') THEN '/' ELSE '.' END AS parent,
    regexp_extract(regexp_extract(url, '([^/]*)$', 1), '^.+(\.[^.]+)$', 1) AS suffix FROM pages""")
def path_parts(spark, sf):
    url = F.col("url")
    return v.table(spark, sf, "pages").select("url", fn.file_name(url).alias("name"), fn.parent(url).alias("parent"), fn.suffix(fn.file_name(url)).alias("suffix"))


@query(f"""WITH {v.SQL_FILES} SELECT path, file_type FROM (SELECT *, row_number() OVER (PARTITION BY file_type ORDER BY seq) AS rn FROM typed WHERE extension IN ('jpg', 'jpeg', 'heic', 'nef', 'cr3', 'dng')) WHERE rn <= 5""")
def sample_per_type(spark, sf):
    some = v.files(spark, sf).where(F.col("extension").isin("jpg", "jpeg", "heic", "nef", "cr3", "dng"))
    return scan.sample_per_group(some, "file_type", 5).select("path", "file_type")


# Metadata: histograms, ranges, reports

HISTOGRAMS = """
dims AS (SELECT seq, 'camera' AS dim, Make || ' ' || Model AS value FROM meta UNION ALL SELECT seq, 'lens', LensModel FROM meta UNION ALL SELECT seq, 'lens_make', Model FROM meta UNION ALL SELECT seq, 'software', Make FROM meta
    UNION ALL SELECT seq, 'resolution', ImageWidth::VARCHAR || 'x' || ImageHeight::VARCHAR FROM meta WHERE ImageWidth <> 0 AND ImageHeight <> 0 UNION ALL SELECT seq, 'aperture', FNumber::VARCHAR FROM meta
    UNION ALL SELECT seq, 'iso', ISO::VARCHAR FROM meta UNION ALL SELECT seq, 'focal_length', trunc(FocalLength)::INT::VARCHAR FROM meta UNION ALL SELECT seq, 'shutter', ExposureTime FROM meta UNION ALL SELECT seq, 'exposure_bias', bias FROM meta),
hist AS (SELECT dim, value, count(*) AS n, min(seq) AS first_seq FROM dims WHERE value <> '' GROUP BY dim, value),
ranked AS (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY n DESC, first_seq) AS place FROM hist)"""
HIST = f"WITH {v.SQL_META}, {HISTOGRAMS} SELECT "


def _hist(spark, sf, only=None):
    return analysis.histograms(v.meta(spark, sf), detailed=False, only=only)


@query(HIST + "* FROM hist")
def fused_histograms(spark, sf):
    return _hist(spark, sf)


@query(HIST + "value, n FROM hist WHERE dim = 'camera'")
def camera_hist(spark, sf):
    return _hist(spark, sf, ["camera"]).select("value", "n")


@query(HIST + "value, n FROM hist WHERE dim = 'lens'")
def lens_hist(spark, sf):
    return _hist(spark, sf, ["lens"]).select("value", "n")


@query(HIST + "dim, value, n FROM hist WHERE dim IN ('lens_make', 'software')")
def maker_hist(spark, sf):
    return _hist(spark, sf, ["lens_make", "software"]).select("dim", "value", "n")


@query(HIST + "value, n FROM hist WHERE dim = 'resolution'")
def resolution_hist(spark, sf):
    return _hist(spark, sf, ["resolution"]).select("value", "n")


def _top(dim):
    def f(spark, sf):
        return analysis.top(_hist(spark, sf, [dim])).select("value", "n", F.col("place").cast("long").alias("place"))

    return f


for _name, _dim in (("top_apertures", "aperture"), ("top_isos", "iso"), ("top_focal", "focal_length"), ("top_shutter", "shutter")):
    FOUND[_name] = (_top(_dim), HIST + f"value, n, place FROM ranked WHERE dim = '{_dim}' AND place <= 5")


@query(HIST + "value, n, place FROM ranked WHERE dim = 'lens' AND place <= 10")
def top_lenses(spark, sf):
    return analysis.top(_hist(spark, sf, ["lens"]), 10).select("value", "n", F.col("place").cast("long").alias("place"))


@query(HIST + "dim, value, n FROM ranked WHERE place = 1")
def most_frequent(spark, sf):
    return analysis.most_frequent(_hist(spark, sf))


@query(HIST + """CASE WHEN p > 3 THEN 'Other (' || count(*) || ' resolutions)' ELSE min(value) END AS value, sum(n)::BIGINT AS n, sum(n)::BIGINT * 100 / (SELECT sum(n) FROM hist WHERE dim = 'resolution')::DOUBLE AS percent, p AS place
    FROM (SELECT *, least(place, 4) AS p FROM ranked WHERE dim = 'resolution') GROUP BY p""")
def resolution_top3_other(spark, sf):
    rows = analysis.top_resolutions(_hist(spark, sf, ["resolution"]))
    return rows.withColumn("place", F.col("place").cast("long"))


SIDES = "split_part(value, 'x', 1)::BIGINT AS w, split_part(value, 'x', 2)::BIGINT AS h"


@query(HIST + f"""value, w * h AS area, (w // gcd(w, h))::VARCHAR || ':' || (h // gcd(w, h))::VARCHAR AS aspect, n, n * 100 / (SELECT sum(n) FROM hist WHERE dim = 'resolution')::DOUBLE AS percent, first_seq
    FROM (SELECT *, {SIDES} FROM hist WHERE dim = 'resolution') ORDER BY w * h DESC, first_seq LIMIT 10""")
def resolution_by_area(spark, sf):
    return analysis.largest_resolutions(_hist(spark, sf, ["resolution"]))


@query(HIST + f"value, (w // gcd(w, h))::VARCHAR || ':' || (h // gcd(w, h))::VARCHAR AS aspect, w * h AS area FROM (SELECT *, {SIDES} FROM hist WHERE dim = 'resolution')")
def aspect_ratio(spark, sf):
    text = F.col("value")
    return _hist(spark, sf, ["resolution"]).select("value", fn.aspect_ratio(text).alias("aspect"), fn.area(text).alias("area"))


ENUMS = {"program": "ExposureProgram", "metering": "MeteringMode", "flash": "Flash", "balance": "WhiteBalance", "space": "ColorSpace"}


def _enum_sql(column: str) -> str:
    from ..functions.text import ENUMS as known

    names, other = known[ENUMS[column]]
    cases = " ".join(f"WHEN {k} THEN '{x}'" for k, x in names.items())
    return f"SELECT '{column}' AS dim, CASE {column} {cases} ELSE printf('{other}', {column}) END AS value FROM meta"


@query(f"WITH {v.SQL_META} SELECT dim, value, count(*) AS n FROM ({' UNION ALL '.join(map(_enum_sql, ENUMS))}) GROUP BY dim, value")
def mode_hists(spark, sf):
    pairs = [F.struct(F.lit(k).alias("dim"), fn.decode(tag, F.col(k)).alias("value")) for k, tag in ENUMS.items()]
    return v.meta(spark, sf).select(F.inline(F.array(*pairs))).groupBy("dim", "value").agg(F.count("*").alias("n"))


@query(f"""WITH {v.SQL_META} SELECT min(FNumber) AS aperture_min, max(FNumber) AS aperture_max, min(ISO) AS iso_min, max(ISO) AS iso_max, min(FocalLength) AS focal_min, max(FocalLength) AS focal_max,
    strftime(min(DateTime), '%Y-%m-%d') AS date_min, strftime(max(DateTime), '%Y-%m-%d') AS date_max FROM meta""")
def setting_ranges(spark, sf):
    return analysis.ranges(v.meta(spark, sf))


@query(f"""WITH {v.SQL_META} SELECT count(*) FILTER (lat IS NOT NULL AND lon IS NOT NULL) AS files_with_gps, count(*) FILTER (Artist <> '') AS files_with_artist, count(*) FILTER (Copyright <> '') AS files_with_copyright FROM meta""")
def gps_artist_counts(spark, sf):
    return analysis.presence(v.meta(spark, sf))


#: The maps and lists of the report, as one text each: value=n by place.
COUNTED = {"cameras": "camera", "lenses": "lens", "lens_makes": "lens_make", "software": "software", "resolutions": "resolution", "exposure_programs": "exposure_program", "metering_modes": "metering_mode", "flash_usage": "flash", "white_balance": "white_balance", "color_spaces": "color_space", "exposure_compensation": "exposure_bias"}
TOPS = {"most_used_apertures": ("aperture", "'f/' || printf('%.1f', value::DOUBLE)"), "most_used_isos": ("iso", "'ISO' || value"), "most_used_focal_lengths": ("focal_length", "value || 'mm'"), "common_shutter_speeds": ("shutter", "label")}
#: The exposure times of the stand-in table and their labels.
SQL_SHUTTER = "(SELECT *, CASE WHEN dim <> 'shutter' THEN NULL WHEN value LIKE '1/%' THEN value WHEN regexp_full_match(value, '[^/]*/[^/]*') THEN printf('%.2fs', split_part(value, '/', 1)::DOUBLE / split_part(value, '/', 2)::DOUBLE) WHEN try_cast(value AS DOUBLE) IS NULL THEN value WHEN value::DOUBLE >= 1 THEN printf('%.1fs', value::DOUBLE) ELSE '1/' || floor(1 / value::DOUBLE)::BIGINT END AS label FROM ranked)"
REPORT_TEXTS = ", ".join([f"(SELECT coalesce(string_agg(value || '=' || n, ',' ORDER BY value), '') FROM {'more' if d in analysis.DETAILED else 'hist'} WHERE dim = '{d}') AS {k}" for k, d in COUNTED.items()] + [f"(SELECT string_agg({text} || '=' || n, ',' ORDER BY place) FROM {SQL_SHUTTER} WHERE dim = '{d}' AND place <= 5) AS {k}" for k, (d, text) in TOPS.items()])


#: Tags that the stand-in table has as numbers, here as texts.
NUMBERED = {"exposure_program": "program", "metering_mode": "metering", "flash": "flash", "white_balance": "balance", "color_space": "space"}
MORE = "more AS (SELECT dim, value, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{d}' AS dim, 'no ' || {c} AS value FROM meta" for d, c in NUMBERED.items()) + ") GROUP BY ALL)"


@query(f"""WITH {v.SQL_META}, {HISTOGRAMS}, {MORE}, {v.SQL_FILES} SELECT f.*, m.*, {REPORT_TEXTS}, image_files_analyzed * 100 / images AS success_rate FROM (SELECT count(*) AS total_files, sum(size)::BIGINT AS total_size, count(DISTINCT parent) AS directories_scanned,
    count(*) FILTER (file_type = 'raw') AS raw_files, count(*) FILTER (file_type = 'jpeg') AS jpeg_files, count(*) FILTER (file_type = 'video') AS video_files, sum(size) FILTER (file_type = 'raw')::BIGINT AS raw_size, sum(size) FILTER (file_type = 'jpeg')::BIGINT AS jpeg_size, sum(size) FILTER (file_type = 'video')::BIGINT AS video_size,
    (SELECT string_agg(e, ',' ORDER BY e) FROM (SELECT extension || '=' || count(*) AS e FROM typed GROUP BY extension)) AS extensions FROM typed) f,
    (SELECT count(*) AS image_files_analyzed, min(ISO) AS iso_min, max(ISO) AS iso_max, min(FNumber) AS aperture_min, max(FNumber) AS aperture_max, min(FocalLength) AS focal_min, max(FocalLength) AS focal_max, strftime(min(DateTime), '%Y-%m-%d') AS date_min, strftime(max(DateTime), '%Y-%m-%d') AS date_max,
    count(*) FILTER (lat IS NOT NULL AND lon IS NOT NULL) AS files_with_gps, count(*) FILTER (Artist <> '') AS files_with_artist, count(*) FILTER (Copyright <> '') AS files_with_copyright FROM meta) m, (SELECT count(*)::DOUBLE AS images FROM typed WHERE file_type IN ('raw', 'jpeg')) i""")
def analysis_report(spark, sf):
    meta = v.meta(spark, sf).withColumns({analysis.DETAILED[d]: F.concat(F.lit("no "), F.col(c).cast("string")) for d, c in NUMBERED.items()})
    row = analysis.report(v.files(spark, sf), meta)
    pair = lambda name, n: F.concat(name, F.lit("="), n.cast("string"))
    counted = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(F.coalesce(F.col(c), F.create_map().cast("map<string,bigint>")))), lambda x: pair(x["key"], x["value"])), ",")
    listed = lambda c: F.array_join(F.transform(F.col(c), lambda x: pair(x["label"], x["n"])), ",")
    kinds, sizes = F.col("files_by_type"), F.col("size_by_type")
    plain = ["total_files", "total_size", "directories_scanned", "image_files_analyzed", "iso_min", "iso_max", "aperture_min", "aperture_max", "focal_min", "focal_max", "date_min", "date_max", "files_with_gps", "files_with_artist", "files_with_copyright", "success_rate"]
    by_type = [F.coalesce(m[k], F.lit(0)).cast("long").alias(f"{k}_{name}") for m, name in ((kinds, "files"), (sizes, "size")) for k in scan.KINDS]
    extensions = F.array_join(F.array_sort(F.transform(F.map_entries("file_extensions"), lambda x: pair(x["key"], x["value"]))), ",").alias("extensions")
    return row.select(*plain, *by_type, extensions, *[counted(c).alias(c) for c in COUNTED], *[listed(c).alias(c) for c in TOPS])


# Scalar functions


@query(f"""WITH t AS (SELECT doc_id, {v.sql_pick(v.TIMES, "doc_id")} AS raw FROM documents) SELECT doc_id, raw,
    coalesce(strftime(try_strptime(trim(raw), ['%Y:%m:%d %H:%M:%S', '%Y-%m-%d %H:%M:%S', '%Y:%m:%d', '%Y-%m-%d']), '%Y-%m-%dT%H:%M:%S'), trim(raw)) AS parsed FROM t""")
def parse_datetime(spark, sf):
    raw = v.pick(v.TIMES, F.col("doc_id"))
    return v.table(spark, sf, "documents").select("doc_id", raw.alias("raw"), fn.parse_datetime(raw).alias("parsed"))


@query(f"""WITH t AS (SELECT doc_id, {v.sql_pick(v.NUMBERS, "doc_id")} AS raw FROM documents), f AS (SELECT doc_id, raw, CASE WHEN contains(raw, '/')
    THEN try_cast(split_part(raw, '/', 1) AS DOUBLE) / nullif(try_cast(split_part(raw, '/', 2) AS DOUBLE), 0) ELSE try_cast(trim(raw) AS DOUBLE) END AS as_float FROM t)
    SELECT doc_id, raw, as_float, trunc(as_float)::BIGINT AS as_int FROM f""")
def safe_numbers(spark, sf):
    raw = v.pick(v.NUMBERS, F.col("doc_id"))
    return v.table(spark, sf, "documents").select("doc_id", raw.alias("raw"), fn.safe_float(raw).alias("as_float"), fn.safe_int(raw).alias("as_int"))


@query(f"""WITH {v.SQL_META}, p AS (SELECT seq, ExposureTime AS raw, try_cast(split_part(ExposureTime, '/', 1) AS DOUBLE) AS a, try_cast(split_part(ExposureTime, '/', 2) AS DOUBLE) AS b FROM meta) SELECT seq, raw,
    CASE WHEN raw = '' THEN 'Unknown' WHEN contains(raw, '/') THEN CASE WHEN a = 1 THEN '1/' || b::BIGINT WHEN b = 0 OR a IS NULL OR b IS NULL THEN raw ELSE printf('%.2fs', a / b) END
    WHEN a IS NULL OR a = 0 THEN raw WHEN a >= 1 THEN printf('%.1fs', a) ELSE '1/' || trunc(1 / a)::BIGINT END AS label FROM p""")
def shutter_label(spark, sf):
    return v.meta(spark, sf).select("seq", F.col("ExposureTime").alias("raw"), fn.shutter_label(F.col("ExposureTime")).alias("label"))


@query(f"WITH {v.SQL_META} SELECT seq, printf('f/%.1f', FNumber) AS aperture, 'ISO' || ISO AS iso, trunc(FocalLength)::INT || 'mm' AS focal, printf('%+.1f EV', lat / 10) AS bias FROM meta")
def setting_labels(spark, sf):
    return v.meta(spark, sf).select("seq", fn.aperture_label(F.col("FNumber")).alias("aperture"), fn.iso_label(F.col("ISO")).alias("iso"), fn.focal_label(F.col("FocalLength")).alias("focal"), fn.bias_label(F.col("GPSLatitude") / 10).alias("bias"))


@query("""SELECT s_suppkey, CASE WHEN s_nationkey % 4 < 2 THEN -1 ELSE 1 END * (s_nationkey::DOUBLE + (s_suppkey % 60)::DOUBLE / 60 + 30.0::DOUBLE / 3600) AS degrees FROM supplier""")
def gps_decimal(spark, sf):
    parts = F.array(F.col("s_nationkey").cast("double"), (F.col("s_suppkey") % 60).cast("double"), F.lit(30.0))
    return v.table(spark, sf, "supplier").select("s_suppkey", fn.gps_decimal(parts, v.pick(["S", "W", "N", "E"], F.col("s_nationkey"))).alias("degrees"))


@query(f"""WITH t AS (SELECT doc_id, {v.sql_pick(v.MODELS, "doc_id")} || CASE WHEN doc_id % 2 = 0 THEN '' ELSE ' ' || lang END AS model FROM documents),
    a AS (SELECT *, trim(regexp_replace(trim(model), '^({"|".join(device.VENDORS)})', '', 'i')) AS b FROM t)
    SELECT doc_id, model, rtrim(substr(trim(regexp_replace(regexp_replace(b, '[<>:"/\\\\|?*]', '_', 'g'), '[\\s_]+', '_', 'g'), '_'), 1, 50), '_') AS folder FROM a""")
def sanitize_folder(spark, sf):
    model = F.concat(v.pick(v.MODELS, F.col("doc_id")), F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.concat(F.lit(" "), "lang")))
    return v.table(spark, sf, "documents").select("doc_id", model.alias("model"), device.sanitised(model).alias("folder"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN b < 1024 THEN printf('%.1f B', b) WHEN b < 1048576 THEN printf('%.1f KB', b / 1024) WHEN b < 1073741824 THEN printf('%.1f MB', b / 1048576)
    WHEN b < 1099511627776 THEN printf('%.1f GB', b / 1073741824) ELSE printf('%.1f TB', b / 1099511627776) END AS size FROM (SELECT *, (l_extendedprice * l_quantity * l_quantity)::DOUBLE AS b FROM lineitem)""")
def human_size(spark, sf):
    size = F.col("l_extendedprice") * F.col("l_quantity") * F.col("l_quantity")
    return v.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", fn.human_size(size).alias("size"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN b < 1125899906842624 THEN printf('%.1f TB', b / 1099511627776) ELSE printf('%.1f PB', b / 1125899906842624) END AS size FROM (SELECT *, (l_extendedprice * 1e11::DOUBLE * (l_quantity + 1)) AS b FROM lineitem)""")
def human_size_large(spark, sf):
    size = F.col("l_extendedprice") * F.lit(1e11) * (F.col("l_quantity") + 1)
    return v.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", fn.human_size(size, "PB").alias("size"))


#: Which of the time tags a document has: bit k of its id stands for the k-th.
TIME_SQL = ", ".join(f"CASE WHEN (doc_id >> {k}) & 1 = 1 THEN '20{10 + k}:01:0' || (1 + doc_id % 9) || ' 10:00:00' END" for k in range(6))


@query(f"""SELECT doc_id, CASE WHEN t IS NULL THEN '' ELSE replace(substr(t, 1, 10), ':', '-') || 'T10:00:00' END AS taken FROM (SELECT doc_id, coalesce({TIME_SQL}) AS t FROM documents)""")
def first_present_time(spark, sf):
    day = lambda k: F.concat(F.lit(f"20{10 + k}:01:0"), (1 + F.col("doc_id") % 9).cast("string"), F.lit(" 10:00:00"))
    there = lambda k: F.shiftright("doc_id", k).bitwiseAND(F.lit(1)) == 1
    pairs = F.array(*[F.when(there(k), F.struct(F.lit(tag), day(k))) for k, tag in enumerate(metadata.TIME_TAGS)])
    return v.table(spark, sf, "documents").select("doc_id", metadata.normalise(F.map_from_entries(F.array_compact(pairs)))["DateTime"].alias("taken"))


@query(f"""SELECT doc_id, try_strptime(trim(raw), '%Y:%m:%d %H:%M:%S') AS taken FROM (SELECT doc_id, {v.sql_pick(v.TIMES, "doc_id")} AS raw FROM documents)""")
def exif_timestamp(spark, sf):
    return v.table(spark, sf, "documents").select("doc_id", fn.exif_timestamp(v.pick(v.TIMES, F.col("doc_id"))).alias("taken"))


# Fingerprints and duplicates


@query(f"WITH {v.SQL_FILES} SELECT path, sha256 FROM hashed")
def sha256_files(spark, sf):
    return dedup.fingerprints(v.files(spark, sf)).select("path", "sha256")


@query(f"WITH {v.SQL_FILES} SELECT sha256, count(*) AS copies, min(path) AS first_path FROM hashed GROUP BY sha256 HAVING count(*) > 1")
def dup_groups(spark, sf):
    return dedup.duplicate_groups(v.hashed(spark, sf))


BITS = """bits AS (SELECT vec_id AS id, array_to_string(list_transform(list_transform(embedding, lambda x: x::DOUBLE), lambda x: CASE WHEN x > list_sum(list_transform(embedding, lambda y: y::DOUBLE)) / 64 THEN '1' ELSE '0' END), '') AS b FROM embeddings)"""


@query(f"""WITH {BITS} SELECT id, array_to_string(list_transform(range(0, 16), lambda i: substr('0123456789abcdef', 1 + 8 * substr(b, 4 * i + 1, 1)::INT + 4 * substr(b, 4 * i + 2, 1)::INT + 2 * substr(b, 4 * i + 3, 1)::INT + substr(b, 4 * i + 4, 1)::INT, 1)), '') AS hash FROM bits""")
def average_hash(spark, sf):
    return v.pixels(spark, sf).select("id", "hash")


@query(f"WITH {BITS} SELECT x.id AS a, y.id AS b, hamming(x.b, y.b)::INT AS distance FROM bits x JOIN bits y ON x.id < y.id AND hamming(x.b, y.b) <= 15")
def hamming_pairs(spark, sf):
    return dedup.hamming_pairs(v.pixels(spark, sf), 15)


@query(f"""WITH {v.SQL_RECORDS} SELECT path, CASE WHEN s.source_path IS NOT NULL THEN 'duplicate' WHEN size NOT IN (SELECT file_size FROM records) THEN 'new' WHEN d.source_path IS NOT NULL THEN 'duplicate' WHEN p.path2 IS NOT NULL THEN 'similar' ELSE 'new' END AS status,
    CASE WHEN s.source_path IS NOT NULL THEN s.source_path WHEN size NOT IN (SELECT file_size FROM records) THEN NULL ELSE coalesce(d.source_path, p.path2) END AS existing_file
    FROM hashed h LEFT JOIN records s ON s.source_path = path AND s.file_mtime = mtime LEFT JOIN records d ON d.file_size = size AND d.sha256_hash = sha256
    LEFT JOIN (SELECT perceptual_hash, arg_min(source_path, id) AS path2 FROM records WHERE perceptual_hash IS NOT NULL GROUP BY perceptual_hash) p ON p.perceptual_hash = perceptual""")
def check_duplicate_catalog(spark, sf):
    return dedup.against_catalog(v.hashed(spark, sf), v.records(spark, sf)).select("path", "status", "existing_file")


@query(f"""WITH {v.SQL_FILES} SELECT path, CASE WHEN rn = 1 THEN 'new' ELSE 'duplicate' END AS status, CASE WHEN rn > 1 THEN first END AS existing_file
    FROM (SELECT path, row_number() OVER w AS rn, first_value(path) OVER w AS first FROM hashed WINDOW w AS (PARTITION BY sha256 ORDER BY seq))""")
def dedup_within_batch(spark, sf):
    return dedup.within_batch(v.hashed(spark, sf)).select("path", "status", "existing_file")


@query(f"WITH {v.SQL_RECORDS} SELECT path, mtime FROM files WHERE NOT EXISTS (SELECT 1 FROM records WHERE source_path = path AND file_mtime = mtime)")
def incremental_new_files(spark, sf):
    return dedup.new_files(v.files(spark, sf), v.records(spark, sf)).select("path", "mtime")


@query(f"""WITH {v.SQL_RECORDS} SELECT count(*) AS total_records, (SELECT count(*) FROM (SELECT sha256_hash FROM records GROUP BY 1 HAVING count(*) > 1)) AS duplicate_groups, count(perceptual_hash) AS with_perceptual_hash, count(DISTINCT device_code) AS unique_devices FROM records""")
def duplicate_statistics(spark, sf):
    return dedup.statistics(v.records(spark, sf))


# Catalog


@query(f"""WITH {v.SQL_RECORDS}, n AS (SELECT * FROM (SELECT path, sha256, size, row_number() OVER (PARTITION BY sha256 ORDER BY seq DESC) AS rn FROM hashed WHERE file_type = 'jpeg') WHERE rn = 1)
    SELECT source_path, sha256_hash, file_size FROM records WHERE sha256_hash NOT IN (SELECT sha256 FROM n) UNION ALL SELECT path, sha256, size FROM n""")
def catalog_upsert(spark, sf):
    new = v.hashed(spark, sf).where("file_type = 'jpeg'").select(F.col("path").alias("source_path"), F.col("sha256").alias("sha256_hash"), F.col("size").alias("file_size"), F.col("seq").alias("id"))
    old = v.records(spark, sf).select("source_path", "sha256_hash", "file_size")
    return c.upsert(old, new, ["sha256_hash"], "id")


@query(f"WITH {v.SQL_RECORDS} SELECT source_path, sha256_hash, perceptual_hash, file_size, file_mtime FROM records WHERE file_size BETWEEN 1500 AND 3500")
def catalog_size_range(spark, sf):
    return c.size_range(v.records(spark, sf), 1500, 3500)


@query(f"WITH {v.SQL_RECORDS} SELECT r.source_path, h.path FROM hashed h JOIN records r ON r.sha256_hash = h.sha256")
def catalog_lookup_hash(spark, sf):
    files = v.hashed(spark, sf)
    found = c.by_hash(v.records(spark, sf), files.where("sha256 is not null"))
    return files.join(found, F.col("sha256") == F.col("sha256_hash")).select("source_path", "path")


@query(f"WITH {v.SQL_RECORDS} SELECT perceptual_hash, count(*) AS n, arg_min(source_path, id) AS first_path FROM records WHERE perceptual_hash IN (SELECT perceptual FROM hashed) GROUP BY perceptual_hash")
def perceptual_lookup(spark, sf):
    found = c.by_perceptual(v.records(spark, sf), v.hashed(spark, sf))
    return found.groupBy("perceptual_hash").agg(F.count("*").alias("n"), F.min_by("source_path", "id").alias("first_path"))


@query(f"""WITH {v.SQL_RECORDS}, {v.SQL_CACHE} SELECT (SELECT count(*) FROM records) AS total_files, (SELECT count(DISTINCT device_code) FROM records) AS unique_devices, (SELECT count(*) FROM exif_cache) AS cached_exif_entries, (SELECT count(DISTINCT parent) FROM files) AS cached_directories""")
def catalog_stats(spark, sf):
    return c.counts(v.records(spark, sf), v.exif_cache(spark, sf), scan.per_directory(v.files(spark, sf)))


@query(f"""WITH {v.SQL_CACHE}, one AS (SELECT file_path, file_mtime, arg_max(exif_data, seq) AS d FROM exif_cache GROUP BY ALL), f AS (SELECT u::VARCHAR AS path, epoch_us(ts) // 1000000 + CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS mtime, event_id FROM (SELECT *, user_id AS u FROM events))
    SELECT event_id, json_extract_string(d, '$.k') AS k, d IS NOT NULL AS hit FROM f LEFT JOIN one ON path = file_path AND mtime = file_mtime""")
def exif_cache_probe(spark, sf):
    e = v.table(spark, sf, "events")
    shift = F.when(F.col("event_type") == "click", 1).otherwise(0)
    probe = e.select("event_id", F.col("user_id").cast("string").alias("path"), (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000) + shift).alias("mtime"))
    cache = c.last_of(v.exif_cache(spark, sf), ["file_path", "file_mtime"], "seq")
    return metadata.cached(probe, cache).select("event_id", F.try_element_at("tags", F.lit("k")).alias("k"), F.col("tags").isNotNull().alias("hit"))


DIRECTORIES = "d AS (SELECT parent, max(mtime)::DOUBLE AS modified, min(mtime)::DOUBLE AS oldest, count(*) AS n FROM files GROUP BY parent)"


@query(f"WITH {v.SQL_FILES}, {DIRECTORIES} SELECT parent AS directory_path, modified, CASE WHEN n > 20 THEN modified > oldest ELSE TRUE END AS changed FROM d")
def directory_changed(spark, sf):
    d = v.files(spark, sf).groupBy(fn.parent(F.col("path")).alias("directory_path")).agg(F.max("mtime").cast("double").alias("modified"), F.min("mtime").cast("double").alias("last_modified"), F.count("*").alias("n"))
    return c.directory_changed(d.select("directory_path", "modified"), d.where("n > 20").select("directory_path", "last_modified"))


@query(f"WITH {v.SQL_CACHE} SELECT seq, created_date FROM exif_cache WHERE created_date >= '2024-01-15T00:00:00'")
def cache_cleanup(spark, sf):
    return c.unexpired(v.exif_cache(spark, sf), "created_date", 30, F.lit("2024-01-15T00:00:00")).select("seq", "created_date")


# Devices


@query("""WITH t AS (SELECT p_partkey, p_type AS make, p_brand AS model, lower(p_type) AS mk, lower(p_brand) AS md FROM part),
    s AS (SELECT *, (contains(mk, 'tin')::INT + contains(md, '#1')::INT) / 2.0::DOUBLE AS tin, contains(mk, 'promo')::INT::DOUBLE AS promo, (contains(mk, 'economy')::INT + contains(md, 'brand#3')::INT) / 2.0::DOUBLE AS eco FROM t),
    b AS (SELECT *, list_max([{'s': tin, 'r': -1, 'p': 0, 'c': 'Tin'}, {'s': promo, 'r': 1, 'p': -1, 'c': 'Promo'}, {'s': eco, 'r': 0, 'p': -2, 'c': 'Economy'}]) AS best FROM s)
    SELECT p_partkey, CASE WHEN best.s > 0 THEN best.c WHEN model = 'Brand#11' THEN 'B11' WHEN contains(md, 'brand#11') OR contains('brand#11', md) THEN 'B11' WHEN contains(md, 'brand#2') THEN 'B2x' WHEN contains(md, 'steel') THEN 'Steel' ELSE model END AS device_code,
    CASE WHEN best.s > 0 THEN least(0.9::DOUBLE, best.s) WHEN model IN ('Brand#11', 'Brand#2') THEN 0.8::DOUBLE WHEN contains(md, 'brand#11') OR contains('brand#11', md) OR contains(md, 'brand#2') OR contains(md, 'steel') THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END AS confidence FROM b""")
def detect_device(spark, sf):
    tags = F.create_map(F.lit("make"), F.col("p_type"), F.lit("Model"), F.col("p_brand"))
    found = device.detect(tags, v.DEVICES)
    return v.table(spark, sf, "part").select("p_partkey", found.alias("d")).select("p_partkey", "d.device_code", "d.confidence")


MATCHES = """m AS (SELECT DISTINCT c_name AS model FROM customer UNION SELECT p_brand FROM part),
    r AS (SELECT s_suppkey AS place, substr(s_name, 15) AS name, 'S' || s_suppkey AS code FROM supplier UNION ALL SELECT 1000000 + min(p_partkey), 'the ' || upper(p_brand) || ' II', p_brand FROM part GROUP BY p_brand
          UNION ALL SELECT 2000000 + min(p_partkey), p_brand, 'own ' || p_brand FROM part WHERE p_size > 25 GROUP BY p_brand),
    x AS (SELECT model, place, code, CASE WHEN model = name THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END AS c FROM m JOIN r ON model = name OR contains(lower(model), lower(name)) OR contains(lower(name), lower(model)))"""


@query(f"WITH {MATCHES} SELECT model, arg_min(code, {{'c': -c, 'p': place}}) AS device_code, max(c) AS confidence FROM x GROUP BY model")
def match_models(spark, sf):
    part, supplier = v.table(spark, sf, "part"), v.table(spark, sf, "supplier")
    models = v.table(spark, sf, "customer").select(F.col("c_name").alias("model")).union(part.select("p_brand"))
    brand = lambda rows, at, name, code: rows.groupBy("p_brand").agg(F.min("p_partkey").alias("k")).select((F.col("k") + at).alias("place"), name.alias("name"), code.alias("device_code"))
    own = F.col("p_brand")
    mappings = supplier.select(F.col("s_suppkey").alias("place"), F.substring("s_name", 15, 100).alias("name"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("device_code"))
    mappings = mappings.union(brand(part, 1_000_000, F.concat(F.lit("the "), F.upper(own), F.lit(" II")), own)).union(brand(part.where("p_size > 25"), 2_000_000, own, F.concat(F.lit("own "), own)))
    return device.by_model(models, mappings)


CODES = "c AS (SELECT p_brand AS code FROM part UNION ALL SELECT p_name FROM part UNION ALL SELECT r_name FROM region), r AS (SELECT n_name AS code FROM nation UNION ALL SELECT r_name FROM region)"


def _codes(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Rules and ranks of a setting, from the tables."""
    column = lambda name, col: v.table(spark, sf, name).select(F.col(col).alias("code"))
    return column("part", "p_brand").union(column("part", "p_name")).union(column("region", "r_name")), column("nation", "n_name").union(column("region", "r_name"))


@query(f"WITH {CODES} SELECT DISTINCT code AS device FROM c")
def supported_devices(spark, sf):
    return device.supported_devices(_codes(spark, sf)[0])


@query(f"""WITH {CODES} SELECT 'unknown priority' AS issue, code AS subject FROM r WHERE code NOT IN (SELECT code FROM c) UNION ALL SELECT 'duplicate code', code FROM c GROUP BY code HAVING count(*) > 1
    UNION ALL SELECT 'altered folder', code FROM (SELECT DISTINCT code FROM c) WHERE contains(code, ' ')""")
def config_lint(spark, sf):
    return device.lint(*_codes(spark, sf))


# Planning


def _ops(spark, sf, **kinds):
    rows = v.orders_as_files(spark, sf)
    return plan.plan(rows, rows.where("status is not null"), F.col("event"), "/archive", "/backup", **kinds)


@query(f"WITH {v.SQL_OPS} SELECT seq, source_path, status, device_code, operation_type, dest_path, raw_backup_path FROM ops")
def plan_operations(spark, sf):
    return _ops(spark, sf)


@query(f"WITH {v.SQL_OPS} SELECT count(*) AS total_files, 0::BIGINT AS duplicates, count(*) AS new_files, 0::BIGINT AS raw_only, 0::BIGINT AS organized_only, count(*) AS both FROM ops")
def plan_breakdown(spark, sf):
    return plan.breakdown(_ops(spark, sf))


@query(f"WITH {v.SQL_OPS} SELECT count(*) AS total_files, count(*) FILTER (status = 'duplicate') AS duplicates, count(*) FILTER (status <> 'duplicate') AS new_files, count(*) AS raw_only, 0::BIGINT AS organized_only, 0::BIGINT AS both FROM o")
def plan_raw_only(spark, sf):
    return plan.breakdown(_ops(spark, sf, raw_only=True))


@query(f"WITH {v.SQL_OPS} SELECT device_code, count(*) AS files FROM ops GROUP BY device_code")
def plan_devices(spark, sf):
    return plan.per_device(_ops(spark, sf))


@query(f"""WITH {v.SQL_OPS} SELECT count(*) AS files_processed, count(*) AS files_copied, 0::BIGINT AS files_moved, 0::BIGINT AS files_skipped, 0::BIGINT AS duplicates_found, count(*) AS files_backed_up, sum(size)::BIGINT AS backup_size FROM ops""")
def dry_run_totals(spark, sf):
    return plan.dry_run(_ops(spark, sf), v.orders_as_files(spark, sf))


@query(f"WITH {v.SQL_OPS} SELECT dest_path, count(*) AS files FROM (SELECT regexp_replace(dest_path, '/[^/]*$', '/x') AS dest_path FROM ops) GROUP BY 1 HAVING count(*) > 1")
def plan_collisions(spark, sf):
    return plan.collisions(_ops(spark, sf).withColumn("dest_path", F.regexp_replace("dest_path", "/[^/]*$", "/x")))


@query("""SELECT count(*) FILTER (own) AS files_processed, count(*) FILTER (own AND done) AS files_copied, 0::BIGINT AS files_moved, count(*) FILTER (own AND NOT done) AS files_skipped, count(*) FILTER (NOT own AND done) AS files_backed_up,
    count(*) FILTER (NOT own AND NOT done) AS backup_skipped, sum(CASE WHEN NOT own AND done THEN size ELSE 0 END)::BIGINT AS backup_size, count(*) FILTER (NOT done) AS error_count FROM (SELECT l_returnflag <> 'R' AS own, l_quantity > 3 AS done, floor(l_extendedprice)::BIGINT AS size FROM lineitem)""")
def execution_totals(spark, sf):
    done = F.col("l_quantity") > 3
    rows = v.table(spark, sf, "lineitem").select(F.when(F.col("l_returnflag") == "R", "backup").otherwise("organized").alias("kind"), done.alias("done"), F.floor("l_extendedprice").cast("long").alias("size"), F.when(~done, "no room").alias("error"))
    return execute.outcome(rows)


@query(f"WITH {v.SQL_FILES} SELECT path, CASE WHEN starts_with(path, '/src0/') THEN '/b/' || substr(path, 7) ELSE '/b/' || name END AS backup FROM files")
def backup_path(spark, sf):
    return v.files(spark, sf).select("path", fn.backup_path(F.lit("/b"), F.lit("/src0"), F.col("path")).alias("backup"))


@query(f"WITH {v.SQL_FILES} SELECT split_part(path, '/', 2) AS source, CASE WHEN count(DISTINCT parent) = 1 THEN min(parent) ELSE '/' || split_part(min(path), '/', 2) END AS root FROM files GROUP BY 1")
def common_root(spark, sf):
    rows = v.files(spark, sf).withColumn("source", F.get(F.split("path", "/"), F.lit(1)))
    return plan.common_root(rows, by=["source"])


@query(f"""WITH {v.SQL_RECORDS} SELECT h.path, h.size = r.file_size AND md5(h.content) = md5(o.content) AS intact FROM hashed h JOIN records r ON h.perceptual = r.perceptual_hash JOIN hashed o ON o.seq = r.id""")
def verify_integrity(spark, sf):
    files = v.hashed(spark, sf)
    kept = v.records(spark, sf).join(files.select(F.col("seq").alias("id"), F.col("content").alias("dest_content")), "id")
    pairs = files.join(kept, F.col("perceptual") == F.col("perceptual_hash")).select("path", F.col("size").alias("source_size"), F.col("file_size").alias("dest_size"), F.col("content").alias("source_content"), "dest_content")
    return plan.verified(pairs).select("path", "intact")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE coalesce(nullif(p_type, ''), '') END AS Make, CASE WHEN p_size <> 0 THEN p_size::BIGINT END AS ISO,
    p_retailprice AS FNumber, CASE WHEN p_partkey % 3 = 0 THEN 1.5::DOUBLE END AS GPSLatitude FROM part""")
def exif_normalise(spark, sf):
    k = F.col("p_partkey")
    tags = F.map_from_arrays(F.array(*map(F.lit, ["EXIF:Make", "Make", "EXIF:ISO", "FNumber", "EXIF:GPSLatitude", "GPSLongitude"])), F.array(F.when(k % 3 == 0, F.col("p_brand")).otherwise(""), F.col("p_type"), F.col("p_size").cast("string"), F.col("p_retailprice").cast("string"), F.when(k % 3 == 0, "3/2").otherwise("0"), F.lit("8.25")))
    return v.table(spark, sf, "part").select("p_partkey", metadata.normalise(tags).alias("m")).select("p_partkey", "m.Make", "m.ISO", "m.FNumber", "m.GPSLatitude")


@query(f"""WITH {v.SQL_CACHE}, one AS (SELECT file_path, max(exif_data) AS d FROM exif_cache GROUP BY file_path), f AS (SELECT '/' || c_custkey || '.JPG' AS path, c_custkey::VARCHAR AS key, floor(abs(c_acctbal))::BIGINT AS size FROM customer)
    SELECT path, CASE WHEN d IS NULL THEN 'jpg' ELSE '' END AS FileType, CASE WHEN d IS NULL THEN size END AS FileSize, CASE WHEN d IS NULL THEN '2024-01-01T00:00:00' ELSE '' END AS DateTime FROM f LEFT JOIN one ON file_path = key""")
def exif_fallback(spark, sf):
    files = v.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("path"), F.lit(1).cast("long").alias("mtime"), F.floor(F.abs("c_acctbal")).cast("long").alias("size"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("modified_time"))
    cache = v.exif_cache(spark, sf).groupBy("file_path").agg(F.max("exif_data").alias("exif_data")).withColumn("file_mtime", F.lit(1).cast("long"))
    rows = metadata.cached(files, cache).withColumn("path", F.concat(F.lit("/"), "path", F.lit(".JPG")))
    return rows.select("path", metadata.chosen(F.col("tags")).alias("m")).select("path", "m.FileType", "m.FileSize", "m.DateTime")
