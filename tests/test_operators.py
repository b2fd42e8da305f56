"""Operators over small tables and a real directory tree."""

import struct
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lumenframe import cli, config, report
from lumenframe.catalog import Catalog, directory_changed, unexpired, upsert
from lumenframe.operators import analysis, dedup, device, execute, metadata, plan, scan
from lumenframe.pipeline import analyse, ingest
from lumenframe.sources.exif import read_tags
from lumenframe.sources.media import scan as scan_directory


def tiff(fields, order="<"):
    """A TIFF block with one directory of texts, numbers and ratios."""
    head, data = struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 8), b""
    at = 8 + 2 + 12 * len(fields) + 4
    entries = b""
    for tag, value in sorted(fields.items()):
        if isinstance(value, str):
            kind, count, raw = 2, len(value) + 1, value.encode() + b"\0"
        elif isinstance(value, tuple):
            kind, count, raw = 5, 1, struct.pack(order + "II", *value)
        else:
            kind, count, raw = 3, 1, struct.pack(order + "HH", value, 0)
        if len(raw) <= 4:
            entries += struct.pack(order + "HHI", tag, kind, count) + raw.ljust(4, b"\0")
        else:
            entries += struct.pack(order + "HHII", tag, kind, count, at + len(data))
            data += raw + b"\0" * (len(raw) % 2)
    return head + struct.pack(order + "H", len(fields)) + entries + b"\0" * 4 + data


def jpeg(width, height, block=None):
    exif = b"" if block is None else b"\xff\xe1" + struct.pack(">H", 8 + len(block)) + b"Exif\0\0" + block
    return b"\xff\xd8" + exif + b"\xff\xc0" + struct.pack(">HBHHB", 8, 8, height, width, 0) + b"\xff\xda\0\2\xff\xd9"


Z6 = {0x010F: "NIKON CORPORATION", 0x0110: "NIKON Z 6", 0x0132: "2023:12:01 10:30:00", 0x829A: (1, 250), 0x829D: (28, 10), 0x8827: 400}


@pytest.fixture
def tree(tmp_path):
    files = {
        "image1.jpg": jpeg(300, 200, tiff(Z6)), "A.JPG": jpeg(300, 200, tiff(Z6, ">")), "copy of image1.jpg": jpeg(300, 200, tiff(Z6)), "_DSC0001.NEF": tiff({0x0110: "NIKON Z 6", 0x8827: 800}), ".hid.jpg": jpeg(100, 50),
        "empty.jpg": b"", "document.txt": b"text", "k=v/video1.mp4": b"fake video", "sub/a b#1.jpg": b"broken",
    }
    for name, content in files.items():
        path = tmp_path / "src" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    return tmp_path / "src"


def test_scan_keeps_what_file_sources_drop(spark, tree):
    rows = scan_directory(spark, str(tree)).collect()
    assert {Path(r["path"]).name: r["file_type"] for r in rows} == {"image1.jpg": "jpeg", "A.JPG": "jpeg", "copy of image1.jpg": "jpeg", "_DSC0001.NEF": "raw", ".hid.jpg": "jpeg", "empty.jpg": "jpeg", "video1.mp4": "video", "a b#1.jpg": "jpeg"}
    assert scan_directory(spark, str(tree), recursive=False).count() == 6
    assert {r["mime_type"] for r in rows if r["extension"] == "jpg"} == {"image/jpeg"}


def test_tags_of_both_byte_orders():
    for order in "<>":
        tags = read_tags(jpeg(300, 200, tiff(Z6, order)))
        assert tags == {"Make": "NIKON CORPORATION", "Model": "NIKON Z 6", "DateTime": "2023:12:01 10:30:00", "ExposureTime": "1/250", "FNumber": "28/10", "ISO": "400", "ImageWidth": "300", "ImageHeight": "200"}
    assert read_tags(b"") == read_tags(b"junk") == read_tags(b"\xff\xd8\xff\xe1\0\x10Exif\0\0II") == {}


def test_analysis_of_a_directory(spark, tree, capsys):
    row = analyse(spark, str(tree)).head()
    assert (row["total_files"], row["image_files_analyzed"]) == (8, 4)
    assert row["cameras"] == {"NIKON CORPORATION NIKON Z 6": 3, "NIKON Z 6": 1} and row["resolutions"] == {"300x200": 3}
    assert (row["iso_min"], row["iso_max"], row["date_min"]) == (400, 800, "2023-12-01")
    assert [tuple(x) for x in row["most_used_isos"]] == [("ISO400", 3), ("ISO800", 1)] and row["common_shutter_speeds"][0]["label"] == "1/250"
    for text in (report.human_readable(row), report.plain(row), report.one_line(row), report.as_json(row)):
        assert "NIKON" in text
    assert "3:2" in report.human_readable(row)
    assert cli.main(["analyze", str(tree), "--peek", "--exif-only"]) == 1 and cli.main(["analyze", str(tree / "nowhere")]) == 1


def test_peek_shows_samples_and_notes(spark, tree, capsys):
    from lumenframe.pipeline import describer, peek

    files = scan_directory(spark, str(tree)).where("error is null")
    rows = peek(files, config.PeekConfig(sample_count=2), describer("os.path:basename")).collect()
    got = [(r["file_type"], r["note"], r["camera"]) for r in sorted(rows, key=lambda r: r["seq"])]
    assert got == [("jpeg", ".hid.jpg", None), ("jpeg", "A.JPG", "NIKON CORPORATION NIKON Z 6"), ("raw", "_DSC0001.NEF", "NIKON Z 6")]
    failing = peek(files, config.PeekConfig(sample_count=1), lambda path: 1 / 0).collect()
    assert all(r["note"] == "not described: division by zero" for r in failing) and len(failing) == 2
    text = report.peek_text(rows)
    assert "A.JPG: jpeg" in text and "2023-12-01" in text


def test_report_without_images_is_empty(spark, tmp_path):
    (tmp_path / "v.mp4").write_bytes(b"x")
    row = analyse(spark, str(tmp_path)).head()
    assert row["total_files"] == 0 and row["image_files_analyzed"] == 0 and row["iso_min"] is None


def test_ingest_plans_copies_and_records(spark, tree, tmp_path):
    settings = config.IngestConfig(str(tmp_path / "archive"), devices=config.DeviceMapping({}, {"Z6": {"Model": "nikon z 6"}}, []), raw_backup=config.RawBackupConfig(enabled=True))
    run = lambda **k: ingest(spark, str(tree), "Trip", settings, str(tmp_path / "catalog"), str(tmp_path / "backup"), **k)
    _, counts = run(dry_run=True)
    assert counts.head()["files_processed"] == 7 and not (tmp_path / "archive").exists()
    _, outcome = run()
    r = outcome.head()
    assert (r["files_processed"], r["files_copied"], r["files_backed_up"], r["error_count"]) == (7, 7, 7, 0)
    assert (tmp_path / "archive/2023/2023-12-01_Trip/Z6/A.JPG").read_bytes() == (tree / "A.JPG").read_bytes()
    assert (tmp_path / "backup/k=v/video1.mp4").exists()
    records = Catalog(spark, str(tmp_path / "catalog")).read("file_records")
    assert records.count() == 7 and records.where("device_code = 'Z6'").count() == 3
    ops, _ = run(dry_run=True)
    assert ops.count() == 0


def test_ingest_takes_tags_from_the_cache(spark, tree, tmp_path):
    devices = config.DeviceMapping({}, {"Z6": {"Model": "nikon z 6"}, "OTHER": {"Model": "from the cache"}}, [])
    catalog, a = Catalog(spark, str(tmp_path / "catalog")), tree / "A.JPG"
    codes = lambda **k: {r["source_path"]: r["device_code"] for r in ingest(spark, str(tree), "Trip", config.IngestConfig(str(tmp_path / "archive"), devices=devices, **k), catalog.root, str(tmp_path / "backup"), dry_run=True)[0].collect()}
    assert codes()[str(a)] == "Z6"
    first = {r["file_path"]: r for r in catalog.read("exif_cache").collect()}
    assert first[str(a)]["file_mtime"] == int(a.stat().st_mtime) and "nikon z 6" in first[str(a)]["exif_data"].lower()
    version = catalog.version("exif_cache")
    assert codes()[str(a)] == "Z6" and catalog.version("exif_cache") == version
    entry = [(str(a), int(a.stat().st_mtime), '{"Model": "from the cache"}', "2024-01-01T00:00:00")]
    catalog.put("exif_cache", spark.createDataFrame(entry, catalog.read("exif_cache").schema))
    assert codes()[str(a)] == "OTHER"
    assert codes(performance=config.PerformanceConfig(cache_exif=False))[str(a)] == "Z6"


def test_transfers_can_be_repeated(spark, tmp_path):
    a, b = tmp_path / "a.jpg", tmp_path / "out/b.jpg"
    a.write_bytes(b"x" * 100)
    for _ in range(2):
        assert execute.put(str(a), str(b)) == "" and execute.intact(a, b)
    b.write_bytes(b"y" * 100)
    assert not execute.intact(a, b) and execute.put(str(a), str(b)) == "" and execute.intact(a, b)
    assert "nothing" in execute.put(str(tmp_path / "nothing"), str(b))
    ops = spark.createDataFrame([(str(a), str(tmp_path / "moved.jpg"), str(tmp_path / "saved.jpg"))], "source_path string, dest_path string, raw_backup_path string")
    r = execute.outcome(execute.execute(ops, copy=False), copy=False).head()
    assert (r["files_moved"], r["files_backed_up"], r["error_count"]) == (1, 1, 0) and not a.exists() and (tmp_path / "moved.jpg").exists()
    assert "Raw backup is disabled" in {r["error"] for r in execute.errors(execute.execute(ops, backup_enabled=False)).collect()}


def test_a_repeated_move_reports_what_the_first_did(spark, tmp_path):
    import hashlib

    rows = []
    for name in ("a", "b"):
        (tmp_path / f"{name}.jpg").write_bytes(name.encode() * 100)
        rows.append((str(tmp_path / f"{name}.jpg"), str(tmp_path / "out" / f"{name}.jpg"), None, 100, hashlib.sha256(name.encode() * 100).hexdigest()))
    ops = spark.createDataFrame(rows, "source_path string, dest_path string, raw_backup_path string, size long, sha256 string")
    moved = lambda: sorted(execute.execute(ops, copy=False).collect(), key=str)
    first = moved()
    assert not (tmp_path / "a.jpg").exists() and moved() == first and all(r["done"] for r in first) and len(first) == 4
    (tmp_path / "out/b.jpg").write_bytes(b"x" * 100)
    again = {r["source_path"][-5:]: r["done"] for r in moved() if r["kind"] == "organized"}
    assert again == {"a.jpg": True, "b.jpg": False}


def test_tags_with_groups_are_those_without(spark):
    from lumenframe.pipeline import typed

    bare = {"Make": "A", "Model": "B", "ISO": "100", "FNumber": "2.8", "ImageWidth": "10", "DateTimeOriginal": "2024:01:02 03:04:05"}
    grouped = {("File:" if k.startswith("Image") else "EXIF:") + k: x for k, x in bare.items()}
    a, b = typed(spark.createDataFrame([(bare,), (grouped,)], "tags map<string,string>")).drop("tags").collect()
    assert a == b and a["Make"] == "A" and a["ImageWidth"] == 10


def test_copies_of_a_hash_cost_nothing(spark):
    rows = [(k, "00000000000000ff") for k in range(3000)] + [(5000, "00000000000000fe"), (5001, "ffffffffffffffff"), (5002, None)]
    data = spark.createDataFrame(rows, "id long, hash string")
    assert {tuple(r) for r in dedup.hamming_groups(data).collect()} == {(0xFE, 0xFF, 1)}
    assert dedup.hamming_pairs(data).count() == 3000 * 2999 // 2 + 3000


def test_within_batch_takes_the_first(spark):
    rows = [(3, "c", "x"), (1, "a", "x"), (2, "b", "y"), (4, "d", None), (5, "e", None)]
    out = {r["path"]: (r["status"], r["existing_file"]) for r in dedup.within_batch(spark.createDataFrame(rows, "seq long, path string, sha256 string")).collect()}
    assert out == {"a": ("new", None), "b": ("new", None), "c": ("duplicate", "a"), "d": ("new", None), "e": ("duplicate", "d")}


def test_filters_are_inclusive(spark):
    rows = spark.createDataFrame([(100, "a"), (1000, "b"), (10000, "c")], "size long, path string")
    assert scan.by_size(rows, 500).count() == 2 and scan.by_size(rows, 500, 5000).count() == 1 and scan.by_size(rows, 100, 10000).count() == 3


def test_summary_ties_and_empty(spark):
    rows = spark.createDataFrame([(i, f"/d/{i}.jpg", s, "jpeg", "jpg") for i, s in enumerate([5, 9, 9, 5])], "seq long, path string, size long, file_type string, extension string").withColumn("modified_time", F.timestamp_seconds("seq"))
    r = scan.summary(rows).head()
    assert (r["largest"], r["smallest"], r["total_size"]) == ("/d/2.jpg", "/d/0.jpg", 28)
    r = scan.summary(rows.limit(0)).head()
    assert (r["total_files"], r["total_size"], r["largest"]) == (0, 0, None)
    assert [x["files"] for x in scan.per_type(rows).collect()] == [0, 4, 0]


def test_overlapping_extensions_go_to_video_first(spark):
    types = config.FileTypes(raw=["x", "y"], jpeg=[" .X", "z"], video=["Z"])
    got = spark.createDataFrame([("x",), ("y",), ("Z",), ("q",)], "e string").select(scan.file_type(F.col("e"), types)).collect()
    assert [r[0] for r in got] == ["jpeg", "raw", "video", "unknown"]


DEVICES = config.DeviceMapping(
    {"NIKON Z 6": "Z6", "Canon EOS R5": "R5"},
    {"Z6": {"Make": "NIKON CORPORATION", "Model": "NIKON Z 6"}, "Drone": {"Make": "DJI", "Model": "FC3582"}, "Generic": {"Make": "acme"}, "Specific": {"Make": "acme", "Model": "m1"}},
    ["Specific", "Z6", "Drone", "Generic"],
)


@pytest.mark.parametrize(
    "tags, code, confidence",
    [
        ({"Make": "NIKON CORPORATION", "Model": "NIKON Z 6"}, "Z6", 0.9), ({"make": "nikon corporation", "model": "nikon z 6"}, "Z6", 0.9), ({"Make": "DJI", "Model": "other"}, "Drone", 0.5), ({"Make": "Canon", "Model": "Canon EOS R5"}, "R5", 0.8),
        ({"Model": "Canon EOS R5 Mark II"}, "R5", 0.6), ({"Make": "?", "Model": "Some Camera Model/2023"}, "Some_Camera_Model_2023", 0.3), ({}, "Unknown", 0.1), ({"Make": "acme", "Model": "m1"}, "Specific", 0.9), ({"Camera Model": " Canon EOS R5 "}, "R5", 0.8),
    ],
)
def test_devices(spark, tags, code, confidence):
    rows = spark.createDataFrame([(tags,)], "tags map<string,string>")
    r = rows.select(device.detect(F.col("tags"), DEVICES).alias("d")).head()["d"]
    assert (r["device_code"], round(r["confidence"], 6)) == (code, confidence)


def test_device_lint(spark):
    odd = config.DeviceMapping({"A": "X", "B": "X", "C": "a/b"}, {"X": {"Make": "m"}}, ["X", "Nobody"])
    assert {tuple(r) for r in device.lint(device.codes_of(odd, spark), spark.createDataFrame([(x,) for x in odd.priority_rules], "code string")).collect()} == {("unknown priority", "Nobody"), ("duplicate code", "X"), ("altered folder", "a/b")}
    assert sorted(r["device"] for r in device.supported_devices(device.codes_of(odd, spark)).collect()) == ["X", "a/b"]


def test_classification_precedence(spark):
    catalog = spark.createDataFrame([(1, "/c/1", 10, 100, "s1", "p1"), (2, "/c/2", 10, 200, "s2", "p2"), (3, "/c/3", 10, 999, "s3", "p2")], "id long, source_path string, file_mtime long, file_size long, sha256_hash string, perceptual_hash string")
    files = spark.createDataFrame(
        [("/c/1", 10, 100, "zz", None), ("/n/1", 1, 55, "s1", "p1"), ("/n/2", 1, 100, "s1", None), ("/n/3", 1, 100, "x", "p2"), ("/n/4", 1, 100, "x", None), ("/c/1", 11, 77, "x", None)],
        "path string, mtime long, size long, sha256 string, perceptual string",
    )
    got = {(r["path"], r["mtime"]): (r["status"], r["existing_file"], r["similarity_score"]) for r in dedup.against_catalog(files, catalog).collect()}
    assert got == {("/c/1", 10): ("duplicate", "/c/1", None), ("/n/1", 1): ("new", None, None), ("/n/2", 1): ("duplicate", "/c/1", None), ("/n/3", 1): ("similar", "/c/2", 0.9), ("/n/4", 1): ("new", None, None), ("/c/1", 11): ("new", None, None)}


def test_hamming_pairs_equal_brute_force(spark):
    import random

    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(20)]
    values = base + [b ^ sum(1 << k for k in rng.sample(range(64), n)) for b in base for n in (0, 1, 3, 5, 9)]
    rows = spark.createDataFrame([(i, f"{v:016x}") for i, v in enumerate(values)] + [(999, None)], "id long, hash string")
    for d in (0, 3, 6, 15):
        want = {(i, j, (a ^ b).bit_count()) for i, a in enumerate(values) for j, b in enumerate(values) if i < j and (a ^ b).bit_count() <= d}
        assert {tuple(r) for r in dedup.hamming_pairs(rows, d).collect()} == want


def test_average_hash(spark):
    rows = spark.createDataFrame([([0.0] * 32 + [1.0] * 32,), ([1.0],), (None,)], "px array<double>")
    assert [r[0] for r in rows.select(dedup.average_hash(F.col("px"))).collect()] == ["00000000ffffffff", None, None]


def test_metadata_normalisation(spark):
    tags = {"EXIF:Make": "NIKON", "EXIF:DateTimeOriginal": "2023:12:15 14:30:45", "EXIF:ISO": "0", "ISO": "100", "EXIF:FNumber": "28/10", "EXIF:GPSLatitude": "48.5", "File:FileSize": "123"}
    m = spark.createDataFrame([(tags,)], "t map<string,string>").select(metadata.normalise(F.col("t")).alias("m")).head()["m"]
    assert (m["Make"], m["Model"], m["DateTime"], m["ISO"], m["FNumber"], m["GPSLatitude"], m["FileSize"]) == ("NIKON", "", "2023-12-15T14:30:45", 100, 2.8, None, 123)


def test_cache_misses(spark):
    files = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("a", 2)], "path string, mtime long")
    cache = spark.createDataFrame([("a", 1, '{"Make": "x"}'), ("b", 1, "no json"), ("c", 1, "{}")], "file_path string, file_mtime long, exif_data string")
    got = {(r["path"], r["mtime"]): r["tags"] for r in metadata.cached(files, cache).collect()}
    assert got == {("a", 1): {"Make": "x"}, ("b", 1): None, ("c", 1): None, ("a", 2): None}


def test_plan_kinds(spark):
    files = spark.createDataFrame([(1, "/s/a.jpg", "2023-12-01T10:30:00", "Z6"), (2, "/s/b.nef", None, None)], "seq long, path string, taken string, device_code string").withColumn("modified_time", F.lit("2020-01-02 00:00:00").cast("timestamp"))
    results = spark.createDataFrame([("/s/b.nef", "duplicate")], "path string, status string")
    make = lambda **k: plan.plan(files, results, F.lit("E"), "/r", "/b", **k).orderBy("seq").collect()
    assert [(r["dest_path"], r["raw_backup_path"]) for r in make()] == [("/r/2023/2023-12-01_E/Z6/a.jpg", "/b/a.jpg")]
    assert [(r["dest_path"], r["raw_backup_path"], r["device_code"]) for r in make(raw_only=True)] == [(None, "/b/a.jpg", "Z6"), (None, "/b/b.nef", "Unknown")]
    assert [r["raw_backup_path"] for r in make(organized_only=True)] == [None]
    same = spark.createDataFrame([(1, "/r/x.jpg"), (2, "/r/x.jpg"), (3, "/r/y")], "seq long, dest_path string")
    assert {r["dest_path"] for r in plan.numbered(same).collect()} == {"/r/x.jpg", "/r/x_1.jpg", "/r/y"} and plan.collisions(same).head()["files"] == 2


@pytest.mark.parametrize("paths, root", [(["/a/b/c.jpg", "/a/b/d/e.jpg"], "/a/b"), (["/a/b.jpg"], "/a"), (["/a/x", "/b/y"], "/"), (["/a/bc/x", "/a/b/y"], "/a"), (["/a/b/x", "/a/b/x"], "/a/b")])
def test_common_root(spark, paths, root):
    assert plan.common_root(spark.createDataFrame([(p,) for p in paths], "path string")).head()["root"] == root


def test_verification(spark):
    rows = [(5, 5, "hello", "hello"), (5, 5, "hello", "world"), (5, 6, "hello", "hello!"), (2**24, 2**24, None, None), (None, 5, "a", "a")]
    got = plan.verified(spark.createDataFrame(rows, "source_size long, dest_size long, source_content string, dest_content string"))
    assert [r["intact"] for r in got.collect()] == [True, False, False, True, False]


def test_catalog_versions(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    assert catalog.read("directory_cache").count() == 0 and catalog.version("directory_cache") is None
    rows = lambda *x: spark.createDataFrame(list(x), "directory_path string, scan_timestamp string, file_count long, last_modified double")
    catalog.put("directory_cache", rows(("/a", "2024-01-01", 1, 1.0), ("/b", "2024-01-01", 2, 2.0)))
    catalog.put("directory_cache", rows(("/b", "2099-01-01", 9, 3.0)))
    assert {(r[0], r[2]) for r in catalog.read("directory_cache").collect()} == {("/a", 1), ("/b", 9)}
    seen = spark.createDataFrame([("/a", 1.0), ("/b", 4.0), ("/c", 0.0)], "directory_path string, modified double")
    assert {r["directory_path"]: r["changed"] for r in directory_changed(seen, catalog.read("directory_cache")).collect()} == {"/a": False, "/b": True, "/c": True}
    catalog.expire(30)
    assert [r[0] for r in catalog.read("directory_cache").collect()] == ["/b"]
    assert unexpired(catalog.read("directory_cache"), "scan_timestamp", 0).count() == 0


def test_upsert_takes_the_last(spark):
    old = spark.createDataFrame([("k1", 1), ("k2", 2)], "k string, v int")
    new = spark.createDataFrame([("k2", 8, 1), ("k2", 9, 2), ("k3", 3, 3)], "k string, v int, seq int")
    assert {tuple(r) for r in upsert(old, new, ["k"], "seq").collect()} == {("k1", 1), ("k2", 9), ("k3", 3)}


@pytest.mark.parametrize("distance, bands", [(15, 4), (15, 8), (15, 16), (7, 3), (3, 4)])
def test_probing_finds_all_with_few_candidates(spark, monkeypatch, distance, bands):
    import random

    rng = random.Random(distance)
    values = {rng.getrandbits(64) for _ in range(600)}
    values |= {x ^ sum(1 << k for k in rng.sample(range(64), n)) for x in list(values)[:60] for n in (1, distance, distance + 1)} | {0, 2**64 - 1, 2**63}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    edges, spare = [64 * k // bands for k in range(bands + 1)], distance - bands + 1
    cut = [(lo, hi, spare // bands + (k < spare % bands)) for k, (lo, hi) in enumerate(zip(edges, edges[1:]))]
    rows = spark.createDataFrame([(signed(v),) for v in values], "h long")
    found = [tuple(r) for r in dedup.hamming_candidates(rows, cut).collect()]
    assert len(found) == len(set(found))
    near = {(x, y) for x, y in found if ((x ^ y) & (2**64 - 1)).bit_count() <= distance}
    order = sorted(map(signed, values))
    assert near == {(x, y) for i, x in enumerate(order) for y in order[i + 1 :] if ((x ^ y) & (2**64 - 1)).bit_count() <= distance}
    if (distance, bands) == (15, 4):
        assert len(found) * 20 < len(values) * (len(values) - 1) / 2


def brute_pairs(values):
    import numpy as np

    order = np.sort(values.view(np.int64))
    apart = np.bitwise_count(order.view(np.uint64)[:, None] ^ order.view(np.uint64)[None])
    at, to = np.nonzero(np.triu(apart <= 15, 1))
    return set(zip(order[at].tolist(), order[to].tolist()))


def test_blocks_of_values_are_compared_with_each_other(spark):
    """Lookups stay within tasks: 5,000 values would make 14 million rows if each were shuffled."""
    import numpy as np

    rng = np.random.default_rng(5)
    values = rng.integers(0, 2**64, 4000, np.uint64, endpoint=False)
    values = np.unique(np.concatenate([values, values[:1000] ^ (np.uint64(1) << rng.integers(0, 64, 1000, np.uint64))]))
    rows, want = spark.createDataFrame([(x,) for x in values.view(np.int64).tolist()], "h long"), brute_pairs(values)
    for blocks, bands in ((1, 4), (3, 4), (4, 6)):
        spare = 16 - bands
        cut = [(64 * k // bands, 64 * (k + 1) // bands, spare // bands + (k < spare % bands)) for k in range(bands)]
        found = [tuple(r) for r in dedup.hamming_candidates(rows, cut, 15, blocks).collect()]
        assert len(found) == len(want) and set(found) == want


def test_a_dense_block_is_spelled_out_in_pieces(monkeypatch):
    import numpy as np

    monkeypatch.setattr(dedup, "CANDIDATES", 1000)
    values = np.unique(np.random.default_rng(6).integers(0, 1 << 14, 700, np.uint64) | np.uint64(1 << 63))
    for bands in (dedup.bands_of(15, 500), dedup.bands_of(15, 10**7)):
        pieces = list(dedup.block_pairs(values, values, bands, 15))
        assert max(len(u) for u, _ in pieces) <= 1000 + len(values)
        found = [(a, b) for u, v in pieces for a, b in zip(u.view(np.int64).tolist(), v.view(np.int64).tolist()) if a < b]
        assert len(found) == len(set(found)) and set(found) == brute_pairs(values)
    assert not list(dedup.block_pairs(values[:0], values, bands, 15)) and not list(dedup.block_pairs(values, values[:0], bands, 15))


def test_bands_follow_the_number_of_values():
    for count in (10, 2000, 10**6, 10**9):
        bands = dedup.bands_of(15, count)
        assert sum(r for *_, r in bands) == 15 - len(bands) + 1 and bands[0][0] == 0 and bands[-1][1] == 64
    assert len(dedup.bands_of(15, 10**7)) == 4 and len(dedup.bands_of(15, 500)) > 4 and dedup.bands_of(0, 100) == [(0, 64, 0)]


def test_model_matching_equals_the_rules(spark):
    """The index against the compiled expression, with names of every length, several that fit and odd characters."""
    import random

    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcAB 1é") for _ in range(n)).strip()
    names = list(dict.fromkeys(x for x in (text(rng.randint(1, 6)) for _ in range(80)) if x))
    models = [text(rng.randint(1, 9)) for _ in range(150)] + names[:10] + ["", None, "%_", "a"]
    mapping = config.DeviceMapping({n: f"D{i}" for i, n in enumerate(names)}, {}, [])
    rows = spark.createDataFrame([(m,) for m in models], "model string")
    table = spark.createDataFrame([(i, n, f"D{i}") for i, n in enumerate(names)], "place long, name string, device_code string")
    got = {r["model"]: (r["device_code"], r["confidence"]) for r in device.by_model(rows, table).collect()}
    want = rows.select("model", device._by_model(F.coalesce("model", F.lit("")), mapping).alias("d")).where("d is not null").distinct().collect()
    assert got == {r["model"]: (r["d"]["device_code"], r["d"]["confidence"]) for r in want} and len(got) > 60


def test_ten_thousand_mappings_have_a_plan_of_the_same_size(spark):
    rows = spark.createDataFrame([("Model 77x",), ("none",)], "model string")
    size = []
    for n in (10, 10_000):
        table = spark.range(n).select(F.col("id").alias("place"), F.concat(F.lit("model "), F.col("id").cast("string")).alias("name"), F.concat(F.lit("D"), F.col("id").cast("string")).alias("device_code"))
        out = device.by_model(rows, table)
        size.append(len(out._jdf.queryExecution().optimizedPlan().toString().split("\n")))
        found = {r["model"]: r["device_code"] for r in out.collect()}
    assert size[0] == size[1] and found == {"Model 77x": "D7"}


def test_configuration(tmp_path, monkeypatch):
    monkeypatch.setenv("PHOTOS", "/photos")
    path = tmp_path / "c.yaml"
    config.write_example(path)
    monkeypatch.setenv("HOME", "/home/x")
    assert config.load(path).archive_root == "/home/x/Photos/Archive" and config.load(path).devices.priority_rules and set(config.load(path).devices.priority_rules) == {*config.load(path).devices.exif_identifiers, *config.load(path).devices.mappings.values()}
    assert config.expand("${PHOTOS}/$PHOTOS/${NOT_SET}") == "/photos//photos/${NOT_SET}"
    for bad in ({"llm": {"provider": "x"}}, {"peek": {"sample_count": 0}}, {"peek": {"max_resolution": 100}}, {"performance": {"batch_size": 0}}, {"file_types": {"raw": []}}, {"peek": {"include_visual_analysis": True}}, {"devices": {"exif_identifiers": {"A": {}}}}):
        with pytest.raises(ValueError):
            config.build(config.IngestConfig, {"archive_root": "/a"} | bad)
    with pytest.raises(config.ConfigurationError):
        config.load(tmp_path / "missing.yaml")


def test_streaming_records_new_files_once(spark, tmp_path):
    from lumenframe.streaming import catalog_new_files

    catalog = Catalog(spark, str(tmp_path / "catalog"))
    schema = "path string, mtime long, size long, sha256 string, seq long"
    from lumenframe.catalog import record

    for k in range(2):
        spark.createDataFrame([(f"/f{i}", 1, 10, f"s{i}", i) for i in range(k, k + 3)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        catalog_new_files(stream, catalog, record, str(tmp_path / "ck")).awaitTermination()
    assert sorted(r["source_path"] for r in catalog.read("file_records").collect()) == ["/f0", "/f1", "/f2", "/f3"]


def test_histograms_rank_by_count_then_first_seen(spark):
    rows = spark.createDataFrame([(1, "b", "m"), (2, "a", "m"), (3, "a", ""), (4, "b", None), (5, None, "m")], "seq long, Model string, Make string")
    got = [(r["value"], r["n"]) for r in analysis.ranked(analysis.histograms(rows, only=["camera"])).orderBy("place").collect()]
    assert got == [("m b", 1), ("m a", 1), ("a", 1), ("b", 1)]


def test_entry_and_queries_run(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1 and set(e.oracle_sql()) <= set(e.queries())
