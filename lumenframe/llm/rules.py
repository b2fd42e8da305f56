"""Quality rules: a hashed n-gram log-likelihood ratio over simple text statistics.

Two multinomials over hashed word n-grams are counted: one over all
documents (the raw corpus), one over the trusted ones. A document's score is the
mean, over its n-grams, of log p_trusted - log p_raw; below a fixed threshold it is
rejected. Additive smoothing keeps both defined. Documents that fail the base rules
(few words, mostly repeated three-word windows) are rejected whatever their score.

Scale: one pass counts both multinomials into ``buckets`` sums, combined before the
shuffle; the ratios (one double a bucket, a fixed size) come back to the second pass
as one array literal. No text is shuffled as long as the trusted ids take at most 32 MB, when they are
broadcast; beyond that the counting pass joins texts with them by id, which shuffles the texts once (the scoring
pass never does). Everything is DataFrame functions; per-document work stays inside the row, in O(n log n) for n
words.

Edge cases: null and empty texts have no words, score 0.0 and fail the base rules;
without any trusted document all scores are 0.0; repeated rows count each; a
document is trusted if one of its label rows says 1 and none says otherwise; extra
columns pass through, and those named like an added column are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RUN, keep_row, let, small_side, text_or_empty, unpack, without_spaces, words

BUCKETS = 1 << 16
#: Lengths of the n-grams: words, and pairs of them, so that the order of words counts.
ORDERS = (1, 2)
THRESHOLD = -0.1
SMOOTHING = 0.5
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def ngram_buckets(w: Column, buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS) -> Column:
    """Bucket numbers of a word array's n-grams of the given orders."""
    bucket = lambda *words_: F.pmod(F.xxhash64(*words_), F.lit(buckets)).cast("int")
    gram = lambda n: F.transform(F.slice(w, n, F.size(w)), lambda x, i: bucket(*[F.get(w, i + k) for k in range(n - 1)], x))
    return F.concat(*[gram(n) for n in orders])


def repeated_words(w: Column) -> Column:
    """Words that lie in a three-word window which the array holds at least twice.

    Windows are sorted by digest, so that equal ones meet; the positions of those
    with an equal neighbour are sorted in turn, and each covers three words or the
    distance to the next, whichever is less.
    """
    windows = F.transform(
        F.slice(w, 3, F.size(w)),
        lambda x, i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), x).alias("h"), i.alias("p")),
    )
    twin = lambda s, x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])
    places = let(F.sort_array(windows), lambda s: F.transform(F.filter(s, lambda x, i: F.coalesce(twin(s, x, i), F.lit(False))), lambda x: x["p"]))
    return let(F.sort_array(places), lambda p: F.aggregate(
        F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))),
        F.lit(0).cast("long"), lambda acc, n: acc + n,
    ))


def base_statistics(text: Column, w: Column) -> dict[str, Column]:
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(without_spaces(text)).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": F.when(F.size(w) > 3, repeated_words(w)).otherwise(F.lit(0).cast("long")),
    }


def bucket_ratios(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, buckets: int, smoothing: float, orders: tuple[int, ...] = ORDERS) -> DataFrame:
    """One row with ``ratios``: an array of log p_trusted - log p_raw by bucket."""
    ids = small_side(trusted.select(F.col(id_col).alias("_id")).distinct().withColumn("_trusted", F.lit(1)))
    flagged = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(ids, "_id", "left")
    grams = flagged.select("_trusted", words(F.col("_text")).alias("_w")).select("_trusted", F.explode(ngram_buckets(F.col("_w"), buckets, orders)).alias("b"))
    counts = grams.groupBy("b").agg(F.count("*").alias("raw"), F.count("_trusted").alias("good"))
    table = docs.sparkSession.range(0, buckets, 1, 1).join(counts, F.col("id") == F.col("b"), "left").select("id", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("good", F.lit(0)).alias("good"))
    whole = table.agg(F.sum("raw").alias("raw_all"), F.sum("good").alias("good_all"), F.sort_array(F.collect_list(F.struct("id", "raw", "good"))).alias("rows"))
    share = lambda n, total: F.log((n + F.lit(smoothing)) / (total + F.lit(smoothing * buckets)))
    ratio = F.transform("rows", lambda r: share(r["good"], F.col("good_all")) - share(r["raw"], F.col("raw_all")))
    return whole.select(F.when(F.col("good_all") > 0, ratio).otherwise(F.array_repeat(F.lit(0.0), buckets)).alias("ratios"))


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """Ids that are labelled good and never otherwise."""
    return labels.groupBy(id_col).agg(F.min(label_col).alias("_least")).where("_least = 1").select(id_col)


def rate(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, threshold: float = THRESHOLD, smoothing: float = SMOOTHING, orders: tuple[int, ...] = ORDERS) -> DataFrame:
    """All rows with the base statistics, base_failed, llr and kept added."""
    ratios = F.lit(np.array(bucket_ratios(docs, trusted, id_col, text_col, buckets, smoothing, orders).head()["ratios"]))
    text = text_or_empty(F.col(f"_row.`{text_col}`"))
    rows = keep_row(docs).select("_row", text.alias("_text")).withColumn("_w", words(F.col("_text")))
    grams = ngram_buckets(F.col("_w"), buckets, orders)
    score = F.aggregate(grams, F.lit(0.0), lambda acc, b: acc + F.get(ratios, b))
    n_grams = sum((F.greatest(F.size("_w") - (n - 1), F.lit(0)) for n in orders), F.lit(0))
    base = base_statistics(F.col("_text"), F.col("_w"))
    rows = rows.select("_row", *[v.alias(f"_{k}") for k, v in base.items()], F.when(n_grams > 0, score / n_grams).otherwise(F.lit(0.0)).alias("_llr"), F.monotonically_increasing_id().alias("_at"))
    n, repeats = F.col("_n_words"), F.col("_n_repeat_words")
    failed = (n < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n)
    added = {k: F.col(f"_{k}") for k in base} | {"base_failed": failed, "llr": F.col("_llr"), "kept": ~failed & (F.col("_llr") >= threshold) & (F.col("_at") >= 0)}  # _at, always true, keeps a later filter on "kept" above the work on words
    return unpack(rows, docs.columns, added)
