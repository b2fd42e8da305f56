"""The walk of a directory tree, its cache, the streaming source, and runs that are cut short."""

import os
import shutil
import time

import pytest
from pyspark.sql import functions as F

from lumenframe import config
from lumenframe.catalog import Catalog
from lumenframe.operators import execute
from lumenframe.pipeline import analyse, ingest, resume, scanned
from lumenframe.sources import media
from lumenframe.streaming import catalog_new_files, once

TYPES = config.FileTypes()


def touch(path, content=b"x", at=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content)
    if at:
        os.utime(path, (at, at))


def settle(root, at):
    for folder, _, _ in os.walk(root):
        os.utime(folder, (at, at))


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "src"
    for k in range(3):
        for j in range(2):
            touch(root / f"d{k}" / f"e{j}" / f"f{k}{j}.jpg", bytes([k, j]) * 10, 1_600_000_000 + k)
    touch(root / "z.jpg", b"zz", 1_600_000_000)
    touch(root / "notes.txt", b"no")
    os.symlink(root / "d0", root / "link")
    settle(root, 1_600_000_000)
    return root


def paths(rows, root):
    return {r["path"].removeprefix(f"{root}/") for r in rows.collect()}


def test_walk_equals_os_walk(spark, tree):
    listing = media.walk(spark, str(tree))
    want = {os.path.join(a, x) for a, _, names in os.walk(tree) for x in names if os.path.isfile(os.path.join(a, x))}
    got = listing.select(F.inline("files")).collect()
    assert {r["path"] for r in got} == want and all(r["size"] == os.path.getsize(r["path"]) for r in got)
    assert {r["directory_path"] for r in listing.collect()} == {a for a, _, _ in os.walk(tree)}
    files = media.scan(spark, str(tree)).orderBy("path").collect()
    assert [r["seq"] for r in files] == list(range(1, 8)) and media.scan(spark, str(tree), recursive=False).count() == 1
    with pytest.raises(NotADirectoryError):
        media.scan(spark, str(tree / "none"))


def test_large_directories_come_in_slices(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(media, "SLICE", 3)
    for k in range(10):
        touch(tmp_path / "many" / f"f{k}.jpg")
    for k in range(4):
        touch(tmp_path / "many" / f"sub{k}" / "g.jpg")
    listing = media.walk(spark, str(tmp_path / "many"))
    assert listing.where(F.col("directory_path") == str(tmp_path / "many")).count() == 5
    assert listing.select(F.inline("files")).count() == 14
    assert media.entries(listing.withColumn("modified", F.lit(1.0))).where(F.col("directory_path") == str(tmp_path / "many")).count() == 0


def test_a_second_scan_opens_changed_directories_only(spark, tree, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "catalog"), 2)
    first = scanned(spark, str(tree), TYPES, catalog)
    assert paths(first, tree) == {f"d{k}/e{j}/f{k}{j}.jpg" for k in range(3) for j in range(2)} | {"z.jpg"}
    touch(tree / "d1/e0/new.jpg")  # a changed directory
    (tree / "d2/e1/f21.jpg").write_bytes(b"longer than before")  # a file whose directory doesn't change
    shutil.rmtree(tree / "d0/e1")
    touch(tree / "d3/e9/deep.jpg")
    cache = catalog.read("directory_entries")
    listing = media.walk(spark, str(tree), cache, TYPES.all_extensions())
    opened = {r["directory_path"].removeprefix(str(tree)) for r in listing.where("opened").collect()}
    assert opened == {"", "/d0", "/d1/e0", "/d3", "/d3/e9"}
    second = scanned(spark, str(tree), TYPES, catalog)
    want = media.scan(spark, str(tree))
    assert sorted(map(tuple, second.drop("seq").collect()), key=str) == sorted(map(tuple, want.drop("seq").collect()), key=str)
    assert {r["path"]: r["size"] for r in second.collect()}[str(tree / "d2/e1/f21.jpg")] == 18
    assert catalog.read("directory_cache").count() >= 10


def test_a_directory_that_was_just_changed_is_opened_again(spark, tmp_path):
    touch(tmp_path / "src/a.jpg")
    catalog = Catalog(spark, str(tmp_path / "catalog"), 2)
    scanned(spark, str(tmp_path / "src"), TYPES, catalog)
    assert catalog.read("directory_entries").count() == 0


def test_analysis_through_the_catalog_gives_the_same_report(spark, tree, tmp_path):
    from test_operators import Z6, jpeg, tiff

    touch(tree / "d0/tagged.jpg", jpeg(300, 200, tiff(Z6)))
    touch(tree / "d0/bare.jpg", jpeg(40, 20))
    want = analyse(spark, str(tree)).drop("scan_time").head()
    root = str(tmp_path / "catalog")
    for _ in range(2):
        assert analyse(spark, str(tree), catalog_root=root).drop("scan_time").head() == want
    cached = {r["file_path"] for r in Catalog(spark, root).read("exif_cache").collect()}
    assert cached == {str(tree / "d0/tagged.jpg"), str(tree / "d0/bare.jpg")}
    entry = [(str(tree / "d0/tagged.jpg"), int((tree / "d0/tagged.jpg").stat().st_mtime), '{"Model": "from the cache"}', "2024-01-01T00:00:00")]
    Catalog(spark, root).put("exif_cache", spark.createDataFrame(entry, "file_path string, file_mtime long, exif_data string, created_date string"))
    assert analyse(spark, str(tree), catalog_root=root).head()["cameras"] == {"from the cache": 1}


def record_all(rows):
    return rows.select(F.col("path").alias("source_path"), "mtime", F.col("mtime").alias("file_mtime"), F.md5("path").alias("sha256_hash"), F.lit(1).alias("id"))


def test_a_stream_of_files_loses_none_and_repeats_none(spark, tree, tmp_path):
    catalog, seen = Catalog(spark, str(tmp_path / "catalog"), 2), []

    def collected(rows):
        out = record_all(rows)
        seen.extend(r["source_path"].removeprefix(f"{tree}/") for r in out.collect())
        return out

    def run():
        rows = once(media.stream(spark, str(tree), settle=0.0))
        catalog_new_files(rows, catalog, collected, str(tmp_path / "checkpoint")).awaitTermination()

    run()
    first = sorted(seen)
    assert first == sorted({f"d{k}/e{j}/f{k}{j}.jpg" for k in range(3) for j in range(2)} | {"z.jpg"})
    run()  # a restart without anything new
    assert sorted(seen) == first
    time.sleep(0.05)
    touch(tree / "d1/e0/late.jpg", at=1_500_000_000)  # older than all, but it came now
    away = tmp_path / "away"
    touch(away / "x/y/moved.jpg", at=1_400_000_000)
    settle(away, 1_400_000_000)
    shutil.move(str(away), str(tree / "d2/in"))  # a tree that is moved in
    run()
    assert sorted(seen) == sorted([*first, "d1/e0/late.jpg", "d2/in/x/y/moved.jpg"])
    run()
    assert len(seen) == len(first) + 2 and catalog.read("file_records").count() == 9


def test_offsets_of_the_stream(tree):
    reader = media.MediaStreamReader({"path": str(tree), "settle": "0", "extensions": "jpg"})
    start, end = reader.initialOffset(), reader.latestOffset()
    rows = [r for p in reader.partitions(start, end) for r in reader.read(p)]
    assert len(rows) == 7 and [r for p in reader.partitions(end, reader.latestOffset()) for r in reader.read(p)] == []


# Runs


class Cut(Exception):
    pass


@pytest.fixture
def moving(spark, tree, tmp_path):
    settings = config.IngestConfig(str(tmp_path / "archive"), raw_backup=config.RawBackupConfig(enabled=True))
    root = str(tmp_path / "catalog")
    return lambda: ingest(spark, str(tree), "Trip", settings, root, str(tmp_path / "backup"), copy=False), root


def contents(folder):
    return sorted(open(os.path.join(a, x), "rb").read() for a, _, names in os.walk(folder) for x in names if x.endswith(".jpg"))


@pytest.mark.parametrize("step", ["copies", "removals", "put"])
def test_a_move_that_is_cut_short_loses_nothing(spark, tree, tmp_path, moving, monkeypatch, step):
    """The driver dies in each step, some of whose work is done; nothing is lost, and resume finishes."""
    run, root = moving
    before = contents(tree)
    with monkeypatch.context() as patch, pytest.raises(Cut):
        if step == "put":
            put = Catalog.put

            def dies(self, table, rows, order=None):
                if table == "file_paths":
                    raise Cut
                put(self, table, rows, order)

            patch.setattr(Catalog, "put", dies)
        else:
            real = getattr(execute, step)

            def half(ops, *rest):
                real(ops.where(F.col("source_path").contains("/d0/")), *rest).collect()  # some are done, and no table says so
                raise Cut

            patch.setattr(execute, step, half)
        run()
    kept = contents(tree)
    assert kept == before if step != "removals" else len(kept) < len(before)
    assert len(execute.unfinished(spark, f"{root}/_runs")) == 1
    (event, outcome), *more = resume(spark, root)
    r = outcome.head()
    assert event == "Trip" and not more and (r["files_moved"], r["error_count"]) == (7, 0)
    assert contents(tree) == [] and contents(tmp_path / "archive") == contents(tmp_path / "backup") == before
    assert Catalog(spark, root).read("file_records").count() == 7 and Catalog(spark, root).read("file_paths").count() == 7
    assert resume(spark, root) == []


def test_a_move_whose_blocks_are_lost_loses_nothing(spark, tree, tmp_path, moving, monkeypatch):
    """All that executors hold goes between the steps of a move; the steps read tables alone."""
    run, root = moving
    before, real = contents(tree), execute.removals

    def forgetful(ops, done):
        out = real(ops, done)
        for rdd in spark.sparkContext._jsc.getPersistentRDDs().values():
            rdd.unpersist(True)
        spark.catalog.clearCache()
        return out

    monkeypatch.setattr(execute, "removals", forgetful)
    ops, outcome = run()
    assert ops.count() == 7 and outcome.head()["files_moved"] == 7 and contents(tree) == [] and contents(tmp_path / "archive") == before
    records = Catalog(spark, root).read("file_records")
    assert records.count() == 7 and records.where("sha256_hash is null or dest_path is null").count() == 0


def test_a_task_that_dies_is_repeated(spark, tree, tmp_path):
    """A copy's task fails once, after its first files: the next attempt finds them and reports all."""
    flag = tmp_path / "failed"
    rows = [(str(p), str(tmp_path / "out" / p.name), None) for p in sorted(tree.rglob("*.jpg"))]
    ops = spark.createDataFrame(rows, "source_path string, dest_path string, raw_backup_path string").coalesce(1)

    def once_broken(frames):
        for k, frame in enumerate(frames):
            yield frame
        if not flag.exists():
            flag.write_text("")
            raise RuntimeError("killed")

    done = execute.copies(ops).mapInPandas(once_broken, execute.SCHEMA)
    try:
        table = media.written(done)
    except Exception:  # local mode doesn't retry tasks
        table = media.written(done)
    assert table.count() == 7 and table.where("done").count() == 7 and len(contents(tmp_path / "out")) == 7


def test_a_source_stays_where_its_copy_is_broken(spark, tmp_path):
    touch(tmp_path / "a.jpg", b"a" * 50)
    ops = spark.createDataFrame([(str(tmp_path / "a.jpg"), str(tmp_path / "out/a.jpg"), None)], "source_path string, dest_path string, raw_backup_path string")
    done = media.written(execute.copies(ops))
    (tmp_path / "out/a.jpg").write_bytes(b"b" * 50)
    row = execute.removals(ops, done).head()
    assert not row["done"] and "isn't intact" in row["error"] and (tmp_path / "a.jpg").exists()


def test_a_rescaled_copy_is_similar(spark, tmp_path):
    """A smaller picture of a scene in the catalog: similar, as soon as a record has its size in bytes; another scene is new."""
    from test_grey import jpeg, scene

    def padded(content, size):
        return content + b"\0" * (size - len(content))

    touch(tmp_path / "one/a.jpg", padded(jpeg(scene(320, 240, 1), quant=4), 60_000))
    settings = config.IngestConfig(str(tmp_path / "archive"))
    run = lambda folder: ingest(spark, str(tmp_path / folder), "Trip", settings, str(tmp_path / "catalog"), str(tmp_path / "backup"), organized_only=True)
    run("one")
    records = Catalog(spark, str(tmp_path / "catalog")).read("file_records").collect()
    assert [len(r["perceptual_hash"]) for r in records] == [16]
    touch(tmp_path / "two/small.jpg", padded(jpeg(scene(160, 120, 1), quant=6), 60_000))
    touch(tmp_path / "two/other.jpg", padded(jpeg(scene(320, 240, 5), quant=4), 60_000))
    ops, _ = run("two")
    assert {os.path.basename(r["source_path"]): r["status"] for r in ops.collect()} == {"small.jpg": "similar", "other.jpg": "new"}
