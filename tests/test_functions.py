"""Scalar functions on the cases that fix their meaning."""

from datetime import date, datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenframe import functions as fn
from lumenframe.operators.device import sanitised
from lumenframe.report import human_size


@pytest.fixture(scope="module")
def apply(spark):
    def run(f, values, kind="string"):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
        return [r["x"] for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]

    return run


def test_parse_datetime(apply):
    texts = ["2023:12:15 14:30:45", "2023-12-15 14:30:45", "2023:12:15", "2023-12-15", " 2023:1:5 4:5:6 ", "not a date", "", None]
    assert apply(fn.parse_datetime, texts) == ["2023-12-15T14:30:45"] * 2 + ["2023-12-15T00:00:00"] * 2 + ["2023-01-05T04:05:06", "not a date", "", None]
    assert apply(fn.exif_timestamp, ["2023:12:15 14:30:45", "2023-12-15"]) == [datetime(2023, 12, 15, 14, 30, 45), None]


def test_numbers(apply):
    texts = ["42", "42.7", "100/1", "28/1", "2.8/1", "invalid", "7/0", "-3.9", "1/2/3", "", None, "1e3"]
    assert apply(fn.safe_float, texts) == [42, 42.7, 100, 28, 2.8, None, None, -3.9, None, None, None, 1000]
    assert apply(fn.safe_int, texts) == [42, 42, 100, 28, 2, None, None, -3, None, None, None, 1000]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-10**6, 10**6), st.integers(-10**4, 10**4)), min_size=1, max_size=30))
def test_ratios(apply, pairs):
    got = apply(fn.safe_int, [f"{a}/{b}" for a, b in pairs])
    assert got == [None if b == 0 else int(a / b) for a, b in pairs]


def test_shutter_labels(apply):
    texts = ["1/250", "2", "30/4", "0.004", "0.5", "", None, "1/0", "abc", "a/2", "1/2/3", "0"]
    assert apply(fn.shutter_label, texts) == ["1/250", "2.0s", "7.50s", "1/250", "1/2", "Unknown", "Unknown", "1/0", "abc", "a/2", None, "0"]


def test_labels_round_as_the_binary_value_lies(apply):
    values = [0.25, 0.35, 2.25, 1.8, 16.0, -0.3, 0.0]
    assert apply(fn.aperture_label, values, "double") == [f"f/{x:.1f}" for x in values]
    assert apply(fn.bias_label, values, "double") == [f"{x:+.1f} EV" for x in values]
    assert apply(fn.focal_label, [35.9, 50.0], "double") == ["35mm", "50mm"]


def test_sizes(apply):
    sizes = [0, 1023, 1024, 1536, 10**6, 10**9, 10**12, 2**50, 2**60]
    assert apply(fn.human_size, sizes, "long") == [human_size(x) for x in sizes]
    assert apply(lambda c: fn.human_size(c, "PB"), sizes, "long") == [human_size(x, "PB") for x in sizes]


def test_gps(apply):
    parts = [[48.0, 51.0, 30.0], [48.0], [], None]
    assert apply(lambda c: fn.gps_decimal(c, F.lit("S")), parts, "array<double>") == [-(48 + 51 / 60 + 30 / 3600), -48.0, None, None]
    assert apply(lambda c: fn.gps_decimal(c, F.lit(None).cast("string")), parts[:1], "array<double>") == [48 + 51 / 60 + 30 / 3600]


def test_enums(apply):
    assert apply(lambda c: fn.decode("Flash", c), [0, 16, 99, None], "int") == ["No flash", "No flash, compulsory", "Flash mode 99", None]
    assert apply(lambda c: fn.decode("ColorSpace", c), [1, 65535, 2], "int") == ["sRGB", "Uncalibrated", "Unknown (2)"]


def test_resolutions(apply):
    assert apply(fn.aspect_ratio, ["6048x4024", "1920x1080", "100x200", "axb", "1x2x3"]) == ["756:503", "16:9", "1:2", None, None]
    assert apply(fn.area, ["100x200", "bad"]) == [20000, 0]


def test_sanitised_folder_names(apply):
    cases = {"NIKON CORPORATION Z 6": "Z_6", "Canon EOS R5": "EOS_R5", "SONY A7R IV": "A7R_IV", "DJI AIR 2S": "AIR_2S", "FUJIFILM X-T4": "X-T4", "Camera/Model:2023*Test?": "Camera_Model_2023_Test", "Camera   Model///Test": "Camera_Model_Test", "nikonos X": "os_X", "": "", "  ": ""}
    assert apply(sanitised, list(cases)) == list(cases.values())
    assert len(apply(sanitised, ["A" * 60])[0]) == 50


def test_event_dates(apply):
    texts = ["2023-12-01T10:30:00", "2023:12:01 10:30:00", "2023-12-01", "2023-12-01 10:30:00", "junk", None]
    modified = F.lit("2020-02-03 04:05:06").cast("timestamp")
    assert apply(lambda c: fn.event_date(c, modified), texts) == [date(2023, 12, 1)] * 3 + [date(2020, 2, 3)] * 3


def test_paths(apply):
    paths = ["/a/b/IMG.JPG", "/x.nef", "bare.txt", "/a/.hidden", "/a/b.c/d", "/a/n."]
    assert apply(fn.file_name, paths) == ["IMG.JPG", "x.nef", "bare.txt", ".hidden", "d", "n."]
    assert apply(fn.parent, paths) == ["/a/b", "/", ".", "/a", "/a/b.c", "/a"]
    assert apply(fn.extension, paths) == ["jpg", "nef", "txt", "", "", ""]
    assert apply(fn.normalised_extension, [" .JPG ", "nef", "..x"]) == ["jpg", "nef", ".x"]
    to = lambda keep: lambda c: fn.backup_path(F.lit("/b"), F.lit("/a"), c, keep)
    assert apply(to(True), paths[:2]) == ["/b/b/IMG.JPG", "/b/x.nef"] and apply(to(False), paths[:1]) == ["/b/IMG.JPG"]
    day = F.lit("2023-12-01").cast("date")
    assert apply(lambda c: fn.organized_path(F.lit("/r"), day, F.lit("E"), F.lit("Z6"), c), paths[:1]) == ["/r/2023/2023-12-01_E/Z6/IMG.JPG"]
