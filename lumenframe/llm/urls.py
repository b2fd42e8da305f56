"""URL filter: captures against the list entries that were active when they were fetched.

Dated entries (a domain pattern, a category, add or remove) become validity
intervals: an addition holds until the next dated entry of its pattern and category.
The as-of join then asks of every capture which intervals hold its fetch time, for
its host or any parent domain of it.

Scale: hosts are far fewer than captures, so they are made distinct first (combined
before the shuffle), matched with the intervals by equality on each domain suffix,
and brought back as one array a host. Captures meet that array in one equi-join: a
hot host is a skewed join, which Spark splits, and the host side is broadcast only
where a count shows it to be small. Time is compared inside the array.

Edge cases: a null, empty or unparsable URL has a null host and matches nothing; a
null fetch time matches nothing; several entries of one pattern, category and time
count as one, a removal winning; entries with a null field are void; repeated
captures get equal results; extra columns pass through, and those named like an
added column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import keep_row, small_side, unpack

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host(url: Column) -> Column:
    """Lower-case host without port, user and final dot; null if there is none."""
    found = F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.$", "")
    return F.when(F.length(found) > 0, found)


def suffixes(name: Column) -> Column:
    """a.b.c -> [a.b.c, b.c, c]"""
    labels = F.split(name, r"\.")
    return F.transform(labels, lambda x, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, category, action, effective_at) -> (pattern, category, valid_from, valid_to), valid_to exclusive or null."""
    dated = entries.where("pattern is not null and category is not null and effective_at is not null and action in ('add', 'remove')")
    dated = dated.groupBy(F.lower("pattern").alias("pattern"), "category", "effective_at").agg(F.max("action").alias("action"))
    following = F.lead("effective_at").over(W.partitionBy("pattern", "category").orderBy("effective_at"))
    return dated.withColumn("valid_to", following).where("action = 'add'").select("pattern", "category", F.col("effective_at").alias("valid_from"), "valid_to")


def judge(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """All captures with host, blocked, pattern and category (of the longest active pattern), and n_active."""
    rows = keep_row(captures).select("_row", host(F.col(f"_row.`{url_col}`")).alias("_host"), F.col(f"_row.`{time_col}`").alias("_at"))
    hosts = rows.where("_host is not null").select("_host").distinct()
    per_host = (
        hosts.select("_host", F.explode(suffixes(F.col("_host"))).alias("pattern"))
        .join(small_side(intervals(entries)), "pattern")
        .groupBy("_host")
        .agg(F.collect_list(F.struct((-F.length("pattern")).alias("rank"), "category", "pattern", "valid_from", "valid_to")).alias("_spans"))
    )
    rows = rows.join(small_side(per_host), "_host", "left")
    active = F.filter("_spans", lambda s: (s["valid_from"] <= F.col("_at")) & (s["valid_to"].isNull() | (F.col("_at") < s["valid_to"])))
    rows = rows.select("_row", "_host", F.coalesce(active, F.array()).alias("_active")).withColumn("_best", F.array_min("_active"))
    added = {"host": F.col("_host"), "blocked": F.size("_active") > 0, "pattern": F.col("_best.pattern"), "category": F.col("_best.category"), "n_active": F.size("_active").cast("long")}
    return unpack(rows, captures.columns, added)
