"""Stand-ins for media tables, made from the driver's tables: DataFrames, and the same as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DeviceMapping
from ..functions import extension
from ..operators.dedup import average_hash
from ..operators.scan import file_type

#: Extensions dealt to files, and exposure times to pictures.
EXTENSIONS = ["nef", "cr3", "dng", "JPG", "jpeg", "heic", "mp4", "mov", "txt", "png"]
EXPOSURES = ["1/250", "2", "30/4", "0.004", "1/60", "", "1/0", "abc"]
TIMES = ["2023:12:15 14:30:45", "2023-12-15 14:30:45", "2023:12:15", "2023-1-5", " 2024:2:3 4:5:6 ", "not a date"]
NUMBERS = ["42", "42.7", "100/1", "28/5", "invalid", "7/0", "-3.9", " 12 "]
MODELS = ["NIKON CORPORATION Z 6", "Canon EOS R5", "SONY A7R IV", "DJI AIR 2S", "FUJIFILM X-T4", "Camera/Model:2023*Test?", "Camera   Model///Test", "  ", "nikonos X"]

DEVICES = DeviceMapping(
    {"Brand#11": "B11", "Brand#2": "B2x", "STEEL": "Steel"},
    {"Tin": {"Make": "tin", "Model": "#1"}, "Promo": {"Make": "promo"}, "Economy": {"Make": "economy", "Model": "brand#3"}},
    ["Economy", "Tin", "Nowhere"],
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pick(values: list[str], at) -> Column:
    return F.get(F.array(*map(F.lit, values)), (at % len(values)).cast("int"))


def files(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    seq = F.col("doc_id")
    path = F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/IMG_"), F.lpad(seq.cast("string"), 6, "0"), F.lit("."), pick(EXTENSIONS, seq))
    rows = d.select(seq.alias("seq"), path.alias("path"), F.col("n_chars").alias("size"), (F.lit(1700000000) + seq * 3600).alias("mtime"), F.col("text").alias("content"))
    return rows.withColumns({"extension": extension(F.col("path")), "modified_time": F.timestamp_seconds("mtime"), "file_type": file_type(extension(F.col("path")))})


def hashed(spark: SparkSession, sf: str) -> DataFrame:
    # of the whole text, and equal for many that differ a little
    shape = F.concat(F.floor(F.length("content") / 8).cast("string"), F.lit("/"), F.floor(F.length(F.replace("content", F.lit("e"), F.lit(""))) / 4).cast("string"))
    look = F.when(F.col("extension").isin("jpg", "jpeg", "heic", "png"), F.substring(F.md5(shape.cast("binary")), 1, 16))
    return files(spark, sf).withColumns({"sha256": F.sha2("content", 256), "perceptual": look})


def records(spark: SparkSession, sf: str) -> DataFrame:
    """The catalog: files of labelled documents, the last of each content; times of every second source differ from the files'."""
    from ..catalog import last_of

    labelled = table(spark, sf, "labels").select(F.col("doc_id").alias("seq")).distinct()
    rows = hashed(spark, sf).join(labelled, "seq", "left_semi")
    shift = F.when(F.contains("path", F.lit("/src1")), 60).otherwise(0)
    rows = rows.select(
        F.col("path").alias("source_path"), F.col("sha256").alias("sha256_hash"), F.col("perceptual").alias("perceptual_hash"), F.col("size").alias("file_size"), (F.col("mtime") + shift).alias("file_mtime"),
        F.when(F.col("file_type") == "video", "").when(F.col("file_type") == "unknown", None).otherwise(F.col("file_type")).alias("device_code"), F.col("seq").alias("id"),
    )
    return last_of(rows, ["sha256_hash"], "id")


def meta(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    return p.select(
        k.alias("seq"), F.col("p_type").alias("Make"), F.col("p_brand").alias("Model"), F.col("p_name").alias("LensModel"), F.col("p_brand").alias("LensMake"), F.col("p_type").alias("Software"),
        (size * 100).cast("int").alias("ISO"), (F.lit(1.5) + k % 8).alias("FNumber"), (F.col("p_retailprice") / 10).alias("FocalLength"), pick(EXPOSURES, k).alias("ExposureTime"),
        (size * 100).cast("int").alias("ImageWidth"), F.when(size % 7 != 0, (size * 75).cast("int")).alias("ImageHeight"), F.make_timestamp(2000 + size % 20, 1 + k % 12, 1 + k % 28, k % 24, k % 60, F.lit(0)).cast("timestamp_ntz").alias("DateTime"),
        F.when(k % 3 == 0, size * 1.5).alias("GPSLatitude"), F.when(k % 2 == 0, -size * 2.0).alias("GPSLongitude"), F.when(k % 5 == 0, F.col("p_name")).alias("Artist"), F.when(k % 4 == 0, "").otherwise("c").alias("Copyright"),
        (k % 10).cast("int").alias("program"), (k % 8).cast("int").alias("metering"), (k % 26).cast("int").alias("flash"), (k % 3).cast("int").alias("balance"), pick(["1", "65535", "2"], k).cast("int").alias("space"), F.format_string("%+d.0 EV", (k % 5 - 2).cast("int")).alias("ExposureBias"),
    )


def exif_cache(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").cast("string").alias("file_path"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("file_mtime"), F.col("props").alias("exif_data"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("created_date"), F.col("event_id").alias("seq"))


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("px"), average_hash(F.col("embedding")).alias("hash"))


def orders_as_files(spark: SparkSession, sf: str) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    rows = o.join(c, o.o_custkey == c.c_custkey, "left")
    key = F.col("o_orderkey")
    return rows.select(
        key.alias("seq"), F.concat(F.lit("/cards/"), F.coalesce(F.col("c_nationkey").cast("string"), F.lit("x")), F.lit("/IMG_"), key.cast("string"), F.lit("."), pick(EXTENSIONS, key)).alias("path"),
        F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss").alias("taken"), F.col("o_orderdate").alias("modified_time"), F.col("c_mktsegment").alias("device_code"),
        F.when(F.col("o_orderstatus") == "F", "duplicate").when(F.col("o_orderstatus") == "P", "similar").alias("status"), F.col("o_orderpriority").alias("event"), F.floor("o_totalprice").cast("long").alias("size"),
    )


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in values) + "]"


def sql_pick(values: list[str], at: str) -> str:
    return f"({_list(values)})[({at} % {len(values)} + 1)::INT]"


SQL_FILES = f"""
files AS (SELECT *, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS extension, to_timestamp(mtime)::TIMESTAMP AS modified_time,
          regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent, regexp_extract(path, '([^/]*)$', 1) AS name
  FROM (SELECT doc_id AS seq, '/' || source || '/' || lang || '/IMG_' || lpad(doc_id::VARCHAR, 6, '0') || '.' || {sql_pick(EXTENSIONS, "doc_id")} AS path, n_chars AS size,
               1700000000 + doc_id * 3600 AS mtime, text AS content FROM documents)),
typed AS (SELECT *, CASE WHEN extension IN ('mp4', 'mov', 'avi', 'mkv') THEN 'video' WHEN extension IN ('jpg', 'jpeg', 'heic', 'heif') THEN 'jpeg'
          WHEN extension IN ('nef', 'cr3', 'cr2', 'arw', 'dng', 'orf', 'raf', 'rw2') THEN 'raw' ELSE 'unknown' END AS file_type FROM files),
hashed AS (SELECT *, sha256(content) AS sha256, CASE WHEN extension IN ('jpg', 'jpeg', 'heic', 'png') THEN substr(md5((length(content) // 8) || '/' || (length(replace(content, 'e', '')) // 4)), 1, 16) END AS perceptual FROM typed)"""

SQL_RECORDS = (
    SQL_FILES
    + """,
records AS (SELECT * EXCLUDE (rn) FROM (SELECT path AS source_path, sha256 AS sha256_hash, perceptual AS perceptual_hash, size AS file_size,
       mtime + CASE WHEN contains(path, '/src1') THEN 60 ELSE 0 END AS file_mtime, CASE file_type WHEN 'video' THEN '' WHEN 'unknown' THEN NULL ELSE file_type END AS device_code,
       seq AS id, row_number() OVER (PARTITION BY sha256 ORDER BY seq DESC) AS rn FROM hashed WHERE seq IN (SELECT doc_id FROM labels)) WHERE rn = 1)"""
)

SQL_META = f"""
meta AS (SELECT p_partkey AS seq, p_type AS Make, p_brand AS Model, p_name AS LensModel, (p_size * 100)::INT AS ISO, 1.5::DOUBLE + p_partkey % 8 AS FNumber, p_retailprice / 10 AS FocalLength,
    {sql_pick(EXPOSURES, "p_partkey")} AS ExposureTime, (p_size * 100)::INT AS ImageWidth, CASE WHEN p_size % 7 <> 0 THEN (p_size * 75)::INT END AS ImageHeight,
    make_timestamp(2000 + p_size % 20, 1 + p_partkey % 12, 1 + p_partkey % 28, p_partkey % 24, p_partkey % 60, 0) AS DateTime,
    CASE WHEN p_partkey % 3 = 0 THEN p_size * 1.5::DOUBLE END AS lat, CASE WHEN p_partkey % 2 = 0 THEN -p_size * 2.0::DOUBLE END AS lon,
    CASE WHEN p_partkey % 5 = 0 THEN p_name END AS Artist, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'c' END AS Copyright,
    (p_partkey % 10)::INT AS program, (p_partkey % 8)::INT AS metering, (p_partkey % 26)::INT AS flash, (p_partkey % 3)::INT AS balance, {sql_pick(["1", "65535", "2"], "p_partkey")}::INT AS space, printf('%+d.0 EV', p_partkey % 5 - 2) AS bias FROM part)"""

SQL_CACHE = """
exif_cache AS (SELECT user_id::VARCHAR AS file_path, epoch_us(ts) // 1000000 AS file_mtime, props AS exif_data, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS created_date, event_id AS seq FROM events)"""

SQL_OPS = f"""
o AS (SELECT o_orderkey AS seq, '/cards/' || coalesce(c_nationkey::VARCHAR, 'x') || '/IMG_' || o_orderkey::VARCHAR || '.' || {sql_pick(EXTENSIONS, "o_orderkey")} AS path, o_orderdate AS day,
    coalesce(c_mktsegment, 'Unknown') AS device_code, coalesce(CASE o_orderstatus WHEN 'F' THEN 'duplicate' WHEN 'P' THEN 'similar' END, 'new') AS status, o_orderpriority AS event, floor(o_totalprice)::BIGINT AS size
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
ops AS (SELECT seq, path AS source_path, status, device_code, 'both' AS operation_type, size,
    '/archive/' || strftime(day, '%Y') || '/' || strftime(day, '%Y-%m-%d') || '_' || event || '/' || device_code || '/' || regexp_extract(path, '([^/]*)$', 1) AS dest_path,
    '/backup/' || regexp_extract(path, '([^/]*)$', 1) AS raw_backup_path FROM o WHERE status <> 'duplicate')"""
