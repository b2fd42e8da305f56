"""Evaluating an expression once where it is used many times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` bound once (also inside lambdas)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
