"""Embedding whitening, against numpy's eigenvectors and exact sums."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n string, _row string"


def brute(vectors):
    """By position: x, deviation and the whitened values; and n, explained."""
    x = [np.floor(256 * np.array(v, float)).astype(np.int64) for v in vectors]
    fit = np.unique(np.array(x), axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    white = [(row - sums / n) @ vectors[:, :4] / np.sqrt(values[:4]) for row in x]
    return n, [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x], white, values[:4] / values.sum()


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(2)
    base = rng.standard_normal((400, 6)) * [3, 2, 1.3, 0.8, 0.5, 0.2] + [10, -20, 0, 5, 0, 1]
    return np.concatenate([base, base[:50], base[:1].repeat(300, 0)]).astype(np.float32).tolist()


@pytest.mark.parametrize("parts, batch", [(1, 4096), (5, 7), (40, 4096)])
def test_whitening_equals_brute_force(spark, monkeypatch, vectors, parts, batch):
    monkeypatch.setattr(whitening, "BATCH", batch)
    table = spark.createDataFrame([(i, v, 0, "clash", "clash") for i, v in enumerate(vectors)], SCHEMA).repartition(parts)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        model = whitening.fit(table)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    out = whitening.whiten(table, model)
    assert out.columns == ["vec_id", "embedding", "label", "_row", "n", "deviation", "identity_error", "components"]
    n, deviation, white, explained = brute(vectors)
    rows = {r["vec_id"]: r for r in out.collect()}
    assert len(rows) == len(vectors)
    signs = np.sign([c["whitened"] for c in rows[0]["components"]]) * np.sign(white[0])
    for i, row in rows.items():
        assert row["n"] == n and row["deviation"] == deviation[i] and row["identity_error"] < 1e-9
        assert [c["component"] for c in row["components"]] == [1, 2, 3, 4]
        np.testing.assert_allclose([c["whitened"] for c in row["components"]], signs * white[i], atol=1e-8)
        np.testing.assert_allclose([c["explained"] for c in row["components"]], explained, rtol=1e-9)


def test_merging_keeps_all_dimensions():
    rng = np.random.default_rng(0)
    rows = rng.integers(-1000, 1000, (90, 5))
    one = whitening.state_of(rows)
    parts = [whitening.state_of(x) for x in (rows[:1], rows[1:3], rows[3:50], rows[50:])]
    merged = whitening.merge(whitening.merge(parts[0], parts[3]), whitening.merge(parts[1], parts[2]))
    assert merged.n == 90 and merged.sums == one.sums and merged.vectors.shape == (5, 5)
    np.testing.assert_allclose(merged.values, one.values, rtol=1e-12)
    np.testing.assert_allclose(np.abs(merged.vectors), np.abs(one.vectors), atol=1e-10)


def test_whitening_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [1.0, None]), (3, [1.0, nan]), (4, [inf, 1.0]), (5, []), (None, [0.5, -0.5]), (7, [0.25, 3.0]), (7, [0.25, 3.0]), (8, [-1.0, 2.0]), (9, [1.0, 2.0, 3.0]), (10, [3e38, -3e38, 1.0, 2.0, 5.0])]
    table = spark.createDataFrame([(i, v, 0, "", "") for i, v in rows], SCHEMA)
    got = whitening.whiten(table, whitening.fit(table)).collect()
    by = {(r["vec_id"], len(r["components"])): r for r in got}
    assert len(got) == 7 and {k for k, _ in by} == {5, None, 7, 8, 9, 10}
    assert by[5, 0]["components"] == [] and by[7, 2]["n"] == 3 and by[9, 3]["n"] == 1 and by[10, 4]["n"] == 1
    assert [c["whitened"] for c in by[9, 3]["components"][:1]] == [None] and by[9, 3]["deviation"] == 0
    assert whitening.whiten(table.limit(0), whitening.fit(table.limit(0))).count() == 0


def test_deviation_is_exact_or_null():
    state = whitening.state_of(np.array([[0, 1], [1 << 31, 5], [1 << 40, 7]]))
    model = whitening.Whitening.of(state, 2)
    rows = np.array([[0, 1], [whitening.MOST, 5], [(1 << 40) // 3, 4]])
    out, fits = model.deviation(rows)
    exact = [sum((3 * int(x) - s) ** 2 for x, s in zip(row, state.sums)) for row in rows]
    assert fits.tolist() == [x < 1 << 63 for x in exact]
    assert all(not ok or a == b for a, b, ok in zip(out.tolist(), exact, fits))


def test_equal_vectors_have_no_components_of_variance(spark):
    table = spark.range(20).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    model = whitening.fit(table)
    row = whitening.whiten(table, model).head()
    assert model[2].n == 1 and row["identity_error"] == 0 and [c["whitened"] for c in row["components"]] == [None, None]
