"""Image sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def resolution(width: Column, height: Column) -> Column:
    """``WxH`` if both are known and not 0."""
    return F.when((width != 0) & (height != 0), F.concat(width.cast("string"), F.lit("x"), height.cast("string")))


def _sides(text: Column) -> tuple[Column, Column]:
    parts = F.split(text, "x")
    side = lambda i: F.when(F.size(parts) == 2, F.get(parts, F.lit(i)).try_cast("bigint"))
    return side(0), side(1)


def area(text: Column) -> Column:
    """Pixels of ``WxH``; 0 for other text."""
    width, height = _sides(text)
    return F.coalesce(width * height, F.lit(0).cast("bigint"))


def aspect_ratio(text: Column) -> Column:
    """``WxH`` in lowest terms, as ``w:h``; null for other text. Euclid's steps on 63-bit numbers are at most 92."""
    width, height = _sides(text)
    start = F.struct(width.alias("a"), height.alias("b"))
    step = lambda z, _: F.when(z["b"] == 0, z).otherwise(F.struct(z["b"].alias("a"), (z["a"] % F.nullif(z["b"], F.lit(0).cast("bigint"))).alias("b")))
    divisor = F.nullif(F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step)["a"], F.lit(0).cast("bigint"))
    whole = lambda n: (n / divisor).cast("bigint").cast("string")
    return F.concat(whole(width), F.lit(":"), whole(height))
