"""The catalog's log: what a put writes, crashes, writers at once, compaction, schema versions, joins without an exchange."""

import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lumenframe import catalog as c
from lumenframe.catalog import Catalog, Step
from lumenframe.operators import dedup, metadata

DIRECTORY = "directory_path string, scan_timestamp string, file_count long, last_modified double"
RECORD = "source_path string, sha256_hash string, perceptual_hash string, file_size long, file_mtime long, id long"


def directories(spark, *rows):
    return spark.createDataFrame([(p, "2024-01-01T00:00:00", n, 1.0) for p, n in rows], DIRECTORY)


def content(catalog, table="directory_cache"):
    return {r[0]: r["file_count"] for r in catalog.read(table).collect()}


def size(root):
    return sum(p.stat().st_size for p in Path(root).rglob("part-*"))


def test_no_table_is_left_in_the_session(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "it's a place"), 2)
    for k in range(2):
        catalog.put("directory_cache", directories(spark, ("/a", k)))
    rows = catalog.read("directory_cache")
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lumenframe_")]
    catalog.put("directory_cache", directories(spark, ("/a", 7)))
    assert [r["file_count"] for r in rows.collect()] == [1] and content(catalog) == {"/a": 7}


def test_a_put_writes_only_its_rows(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path), 4)
    catalog.put("directory_cache", spark.range(50_000).select(F.concat(F.lit("/dir/"), F.md5(F.col("id").cast("string"))).alias("directory_path"), F.lit("t").alias("scan_timestamp"), F.col("id").alias("file_count"), F.lit(1.0).alias("last_modified")))
    before = size(tmp_path)
    catalog.put("directory_cache", directories(spark, ("/new", 1)))
    assert before > 1_000_000 and size(tmp_path) - before < 20_000
    assert catalog.read("directory_cache").count() == 50_001


def test_the_last_put_of_a_key_counts_and_order_decides_within_one(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path), 3)
    assert content(catalog) == {} and catalog.version("directory_cache") is None
    catalog.put("directory_cache", directories(spark, ("/a", 1), ("/b", 2)))
    catalog.put("directory_cache", directories(spark, ("/b", 3), ("/b", 9), ("/b", 5), (None, 7)), "file_count")
    catalog.put("directory_cache", directories(spark, ("/c", 4)))
    assert content(catalog) == {"/a": 1, "/b": 9, "/c": 4, None: 7}
    version = catalog.version("directory_cache")
    catalog.put("directory_cache", directories(spark).limit(0))
    assert catalog.version("directory_cache") == version == 3
    rows = [("/x", "same", i, float(i % 7)) for i in range(40)]
    for k in range(2):  # without an order the same row wins, whatever the partitions
        catalog.put("directory_cache", spark.createDataFrame(rows[:: 1 - 2 * k], DIRECTORY).repartition(1 + 4 * k))
        if k == 0:
            first = content(catalog)["/x"]
    assert content(catalog)["/x"] == first


def test_a_writer_that_dies_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    catalog = Catalog(spark, str(tmp_path), 2)
    catalog.put("directory_cache", directories(spark, ("/a", 1)))

    def dies(*_):
        raise KeyboardInterrupt

    for call in (lambda: catalog.put("directory_cache", directories(spark, ("/a", 2), ("/b", 2))), lambda: catalog.compact("directory_cache")):
        with monkeypatch.context() as patch, pytest.raises(KeyboardInterrupt):
            patch.setattr(Catalog, "_commit", dies)  # its files are there, its snapshot isn't
            call()
        assert content(catalog) == {"/a": 1}
    catalog.put("directory_cache", directories(spark, ("/c", 3)))
    catalog.compact("directory_cache")
    assert content(catalog) == {"/a": 1, "/c": 3}


def test_a_snapshot_is_written_once(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path), 2)
    catalog.put("directory_cache", directories(spark, ("/a", 1)))
    now = catalog.snapshot("directory_cache")
    assert not catalog._commit("directory_cache", now) and catalog.snapshot("directory_cache") == now
    assert [p.name for p in (tmp_path / "directory_cache/_log").glob("*.json")] == [f"{1:020d}.json"]


def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    """Each loses a race on purpose: the other commits between its write and its commit."""
    catalog = Catalog(spark, str(tmp_path), 2)
    catalog.put("directory_cache", directories(spark, ("/a", 1)))
    commit, raced = Catalog._commit, []

    def late(self, table, snapshot):
        if len(raced) < 3:
            raced.append(1)
            other = [lambda: directories(spark, ("/b", 2)), None, lambda: directories(spark, ("/a", 9))][len(raced) - 1]
            with monkeypatch.context() as patch:
                patch.setattr(Catalog, "_commit", commit)
                catalog.compact(table) if other is None else catalog.put(table, other())
        return commit(self, table, snapshot)

    monkeypatch.setattr(Catalog, "_commit", late)
    catalog.put("directory_cache", directories(spark, ("/c", 3)))  # loses to a put, then to a compaction, then to a put
    assert len(raced) == 3 and content(catalog) == {"/a": 9, "/b": 2, "/c": 3}


def test_threads_at_once(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path), 2)
    work = [threading.Thread(target=lambda k=k: [catalog.put("directory_cache", directories(spark, (f"/{k}/{i}", i))) for i in range(2)]) for k in range(3)]
    for t in work:
        t.start()
    for t in work:
        t.join()
    assert content(catalog) == {f"/{k}/{i}": i for k in range(3) for i in range(2)}


def test_compaction_after_many_puts_keeps_readers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(c, "COMPACT_AFTER", 3)
    catalog = Catalog(spark, str(tmp_path), 2)
    for i in range(3):
        catalog.put("directory_cache", directories(spark, (f"/{i}", i), ("/x", i)))
    old = catalog.read("directory_cache")
    assert len(catalog.snapshot("directory_cache").commits) == 3
    catalog.put("directory_cache", directories(spark, ("/x", 99)))
    assert len(catalog.snapshot("directory_cache").commits) == 1
    assert content(catalog) == {"/0": 0, "/1": 1, "/2": 2, "/x": 99} and {r[0]: r[2] for r in old.collect()}["/x"] == 2
    for _ in range(3):
        catalog.compact("directory_cache")
    assert len(list((tmp_path / "directory_cache").glob("data-*"))) == 2 and len(content(catalog)) == 4


def test_expiry_rewrites_and_zero_days_leave_nothing(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path), 2)
    catalog.put("directory_cache", spark.createDataFrame([("/old", "2020-01-01T00:00:00", 1, 1.0), ("/new", "2999-01-01T00:00:00", 2, 1.0)], DIRECTORY))
    catalog.expire(30)
    assert content(catalog) == {"/new": 2}
    catalog.expire(0)
    assert content(catalog) == {}


def test_tables_of_two_schema_versions_read_as_one(spark, tmp_path, monkeypatch):
    catalog = Catalog(spark, str(tmp_path), 2)
    catalog.put("directory_cache", directories(spark, ("/a", 1), ("/b", 2)))
    catalog.put("directory_cache", directories(spark, ("/b", 3)))
    now = "folder string, scan_timestamp string, files long, last_modified double, owner string"
    monkeypatch.setitem(c.SCHEMAS, "directory_cache", now)
    monkeypatch.setitem(c.KEYS, "directory_cache", ["folder"])
    monkeypatch.setitem(c.STEPS, "directory_cache", [Step({"directory_path": "folder"}), Step({"file_count": "files"})])
    assert {(r.folder, r.files, r.owner) for r in catalog.read("directory_cache").collect()} == {("/a", 1, None), ("/b", 3, None)}
    catalog.put("directory_cache", spark.createDataFrame([("/b", 7, "me"), ("/c", 8, None)], "folder string, files long, owner string"))
    assert {(r.folder, r.files, r.owner) for r in catalog.read("directory_cache").collect()} == {("/a", 1, None), ("/b", 7, "me"), ("/c", 8, None)}
    assert catalog.snapshot("directory_cache").schema == 3


@pytest.fixture()
def shuffled(spark):
    """Joins that must not be broadcast."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def below_exchanges(df):
    """The text of the physical plan's parts that an exchange reads."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
    out, depth = [], None
    for line in plan:
        at = len(line) - len(line.lstrip(" :+-"))
        if depth is not None and at <= depth:
            depth = None
        if depth is not None:
            out.append(line)
        elif "Exchange" in line:
            depth = at
    return "\n".join(out)


def test_joins_with_the_catalog_do_not_shuffle_it(spark, tmp_path, shuffled):
    catalog = Catalog(spark, str(tmp_path), 8)
    records = [(f"/r{i}", f"s{i}", f"p{i}" if i % 2 else None, i % 5, i, i) for i in range(40)]
    for part in (records[:20], records[20:]):  # two commits, so that they are merged on read
        rows = spark.createDataFrame(part, RECORD)
        catalog.put("file_records", rows)
        catalog.put("file_paths", rows)
    files = spark.createDataFrame([("/r3", 3, 3, "zz", "p1"), ("/new", 1, 1, "s1", None), ("/new2", 1, 77, "s1", None), ("/new3", 1, 2, "q", "p5"), ("/new4", 1, 2, "q", "p4")], "path string, mtime long, size long, sha256 string, perceptual string")
    known, paths = catalog.read("file_records"), catalog.read("file_paths")
    out = dedup.against_catalog(files, known, paths)
    assert {r["path"]: (r["status"], r["existing_file"]) for r in out.collect()} == {"/r3": ("duplicate", "/r3"), "/new": ("duplicate", "/r1"), "/new2": ("new", None), "/new3": ("similar", "/r5"), "/new4": ("new", None)}
    # what is shuffled of the catalog are sizes and looks alone
    moved = below_exchanges(dedup.against_catalog(files, known, paths).select("path", "status", "existing_file"))
    scans = [line for line in moved.split("\n") if "FileScan parquet" in line]
    assert scans and not any("file_paths" in line for line in scans) and all(("file_size" in line) != ("sha256_hash" in line and "source_path" in line and "perceptual" not in line) or "perceptual" in line for line in scans)
    fresh = dedup.new_files(files, paths)
    assert {r["path"] for r in fresh.collect()} == {"/new", "/new2", "/new3", "/new4"} and "FileScan" not in below_exchanges(fresh)
    cache = spark.createDataFrame([("/r3", 3, '{"k": "v"}', "t"), ("/r4", 4, "no json", "t")], "file_path string, file_mtime long, exif_data string, created_date string")
    catalog.put("exif_cache", cache)
    catalog.put("exif_cache", cache)
    probe = metadata.cached(files, catalog.read("exif_cache"))
    assert {r["path"]: r["tags"] for r in probe.collect()}["/r3"] == {"k": "v"} and "FileScan" not in below_exchanges(probe)


def test_lookups_are_joins(spark):
    records = spark.createDataFrame([("/1", "a", "p", 5), ("/0", "a", "q", 2), ("/3", "b", "p", 1), ("/4", None, None, 0)], "source_path string, sha256_hash string, perceptual_hash string, id long")
    wanted = spark.createDataFrame([("a",), ("a",), ("zz",), (None,)], "sha256 string")
    assert [(r["sha256_hash"], r["source_path"], r["id"]) for r in c.by_hash(records, wanted).collect()] == [("a", "/0", 2)]
    looks = spark.createDataFrame([("p",), ("p",), (None,)], "perceptual string")
    assert sorted(r["source_path"] for r in c.by_perceptual(records, looks).collect()) == ["/1", "/3"]
