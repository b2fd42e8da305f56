"""Parsing and labelling of metadata values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the numbers of enumerated tags mean, and the text for others.
ENUMS: dict[str, tuple[dict[int, str], str]] = {
    "ExposureProgram": ({0: "Not defined", 1: "Manual", 2: "Normal program", 3: "Aperture priority", 4: "Shutter priority", 5: "Creative program", 6: "Action program", 7: "Portrait mode", 8: "Landscape mode"}, "Unknown (%d)"),
    "MeteringMode": ({0: "Unknown", 1: "Average", 2: "Center-weighted average", 3: "Spot", 4: "Multi-spot", 5: "Pattern", 6: "Partial"}, "Unknown (%d)"),
    "Flash": ({0: "No flash", 1: "Flash fired", 5: "Flash fired, no return", 7: "Flash fired, return detected", 9: "Flash fired, compulsory", 16: "No flash, compulsory", 24: "No flash, auto", 25: "Flash fired, auto"}, "Flash mode %d"),
    "WhiteBalance": ({0: "Auto", 1: "Manual"}, "Unknown (%d)"),
    "ColorSpace": ({1: "sRGB", 65535: "Uncalibrated"}, "Unknown (%d)"),
}
#: Accepted timestamp layouts, in order.
LAYOUTS = ("yyyy:M:d H:m:s", "yyyy-M-d H:m:s", "yyyy:M:d", "yyyy-M-d")
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def fixed(value: Column, digits: int) -> Column:
    """Decimal text, halves rounded as the binary value lies."""
    return F.call_function("format_number", value.cast("double"), F.lit("0." + "0" * digits if digits else "0"))


def parse_datetime(text: Column) -> Column:
    """ISO-8601 text of the first layout that fits; other text stays, stripped."""
    iso = lambda bare, x: F.date_format(F.try_to_timestamp(bare, F.lit(x)), "yyyy-MM-dd'T'HH:mm:ss")
    return F.get(F.transform(F.array(strip(text)), lambda bare: F.coalesce(*[iso(bare, x) for x in LAYOUTS], bare)), F.lit(0))


def exif_timestamp(text: Column) -> Column:
    """``YYYY:MM:DD HH:MM:SS`` as a timestamp without zone, else null."""
    return F.try_to_timestamp(strip(text), F.lit("yyyy:M:d H:m:s")).cast("timestamp_ntz")


def _number(text: Column) -> Column:
    return strip(text).try_cast("double")


def safe_float(text: Column) -> Column:
    """A number, or ``a/b``, as a double; null for anything else and for b = 0."""
    parts = F.split(text, "/")
    return F.when(F.size(parts) == 2, F.try_divide(_number(F.get(parts, F.lit(0))), _number(F.get(parts, F.lit(1))))).otherwise(_number(text))


def safe_int(text: Column) -> Column:
    """As ``safe_float``, cut to an integer."""
    value = safe_float(text)
    return F.when(F.abs(value) < 9.2e18, value.try_cast("bigint"))


def gps_decimal(parts: Column, ref: Column) -> Column:
    """[degrees, minutes, seconds] as degrees, negative to the south and west; missing parts are 0, an empty array null."""
    part = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(0.0))
    value = part(0) + part(1) / 60 + part(2) / 3600
    return F.when(F.size(parts) > 0, F.when(F.coalesce(ref.isin("S", "W"), F.lit(False)), -value).otherwise(value))


def shutter_label(text: Column) -> Column:
    """``1/n`` or seconds; Unknown if empty; text that is no number stays; three parts or more give null."""
    parts = F.split(text, "/")
    a, b = _number(F.get(parts, F.lit(0))), _number(F.get(parts, F.lit(1)))
    ratio = F.try_divide(a, b)
    broken = F.when(b.isNull() | ratio.isNull(), text)
    one = _number(text)
    plain = F.when(one.isNull() | (one == 0), text).when(one >= 1, F.concat(fixed(one, 1), F.lit("s"))).otherwise(F.concat(F.lit("1/"), (1 / F.nullif(one, F.lit(0.0))).cast("bigint").cast("string")))
    return (
        F.when(text.isNull() | (text == ""), "Unknown")
        .when(F.size(parts) > 2, F.lit(None))
        .when(F.size(parts) == 2, F.when(a.isNull(), text).when(a == 1, F.when(b.isNull(), text).otherwise(F.concat(F.lit("1/"), b.cast("bigint").cast("string")))).otherwise(F.coalesce(broken, F.concat(fixed(ratio, 2), F.lit("s")))))
        .otherwise(plain)
    )


def aperture_label(value: Column) -> Column:
    return F.concat(F.lit("f/"), fixed(value, 1))


def iso_label(value: Column) -> Column:
    return F.concat(F.lit("ISO"), value.cast("string"))


def focal_label(value: Column) -> Column:
    return F.concat(value.cast("int").cast("string"), F.lit("mm"))


def bias_label(value: Column) -> Column:
    """Signed, with one decimal: ``+0.3 EV``."""
    text = fixed(value, 1)
    return F.concat(F.when(F.startswith(text, F.lit("-")), "").otherwise("+"), text, F.lit(" EV"))


def decode(tag: str, value: Column) -> Column:
    """The meaning of an enumerated tag's number."""
    names, other = ENUMS[tag]
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.when(value.isNotNull(), F.coalesce(F.try_element_at(table, value.cast("int")), F.format_string(other, value.cast("int"))))


def human_size(size: Column, cap: str = "TB") -> Column:
    """Base 1024 with one decimal; ``cap`` is the largest unit."""
    units = SIZE_UNITS[: SIZE_UNITS.index(cap) + 1]
    out = F.concat(fixed(size / 1024.0 ** (len(units) - 1), 1), F.lit(f" {units[-1]}"))
    for k in range(len(units) - 2, -1, -1):
        out = F.when(size < 1024.0 ** (k + 1), F.concat(fixed(size / 1024.0**k, 1), F.lit(f" {units[k]}"))).otherwise(out)
    return out


def event_date(taken: Column, modified: Column) -> Column:
    """The day of an event: ISO text with T, colon form or bare date, else the day of ``modified``, else today."""
    day = F.when(F.contains(taken, F.lit("T")), F.substring_index(taken, "T", 1)).otherwise(F.regexp_replace(taken, r"^([^:]*):([^:]*):", "$1-$2-"))
    good = F.when(F.contains(taken, F.lit("T")) | ~F.contains(taken, F.lit("-")) | F.regexp_like(taken, F.lit(r"^\d{4}-\d{2}-\d{2}$")), F.try_to_date(F.substring(day, 1, 10), "yyyy-MM-dd"))
    return F.coalesce(good, modified.cast("date"), F.current_date())
