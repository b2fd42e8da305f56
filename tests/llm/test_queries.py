"""The registered queries: columns, types, folds and edge rows of their contracts."""

import random
import zlib

import pytest

from lumenframe.llm import queries

CONTRACT = {
    "op1_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op2_langid": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op3_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op4_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op5_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op6_urls": {"page_id": "bigint", "host": "string", "blocked": "boolean", "pattern": "string", "category": "string", "n_active": "bigint"},
    "op7_lm": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op8_licences": {"doc_id": "bigint", "licence": "string", "dice": "double", "n_matches": "bigint"},
    "op9_vectors": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op11_whitening": {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"},
    "op12_alignment": {"doc_id": "bigint", "n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint", "n_best": "bigint", "count_sum": "bigint", "groups_sha256": "string"},
    "op13_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op10_jaccard": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
}
HELD_OUT = {"op2_langid": (3, 1), "op4_quality": (5, 0), "op7_lm": (5, 1), "op13_toxicity": (5, 0)}
KEYS = {"op6_urls": "page_id", "op9_vectors": "vec_id", "op11_whitening": "vec_id"}
TEXTS = {0: None, 1: "", 2: " \n\t", 3: "½ ² ³ 12", 4: "one", 5: "word " * 3000}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    speech = {"en": "the house of the old man and the sea is where we live", "de": "das haus des alten mannes und das meer ist wo wir leben"}
    docs = [(i, TEXTS.get(i, f"{speech[lang]} {i} " * (2 + i % 5)), lang, None if i % 9 == 0 else "abc"[i % 3], "x") for i in range(90) for lang in [("en", "de")[i % 2]]]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, _row string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 9 == 0)) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    vectors = [(i, [float((i * k) % 7) - 3 for k in range(1, 7)], 0) for i in range(80)] + [(80, None, 0), (81, [1.0, None], 0), (82, [float("nan")] * 6, 0), (83, [0.0] * 6, 0)]
    spark.createDataFrame([v for v in vectors], "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    pages = [(i, f"https://w{i % 3}.site{i % 11}.example.net/{i}" if i % 13 else None, "<p>") for i in range(90)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    return at


@pytest.mark.parametrize("name", CONTRACT)
def test_columns_folds_and_edge_rows(spark, folder, name):
    out = queries.queries()[name](spark, folder)
    kinds = dict(out.dtypes)
    assert {c: kinds.get(c) for c in CONTRACT[name]} == CONTRACT[name]
    key = KEYS.get(name, "doc_id")
    found = out.collect()
    rows = {r[key]: r for r in found}
    if name == "op11_whitening":  # a row for each component; the empty vectors' rows are dropped
        assert sorted(rows) == [*range(80), 83] and len(found) == 4 * 81 and {r["component"] for r in found} == {1, 2, 3, 4}
        assert len({(r["n"], r["identity_error"]) for r in found}) == 1 and found[0]["identity_error"] < 1e-4
        return
    assert sorted(rows) == list(range(84 if key == "vec_id" else 90)) and out.count() == len(found) and (name == "op1_packing" or len(found) == len(rows))
    if name in HELD_OUT:
        mod, rest = HELD_OUT[name]
        assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % mod == rest) for k, r in rows.items())
        assert all(r["score"] <= 0 if name == "op7_lm" else 0 <= r["score"] <= 1 for r in found)
    if name == "op1_packing":
        whole = {k: sum(r["length"] for r in found if r["doc_id"] == k) for k in rows}
        assert all(whole[k] == rows[k]["doc_tokens"] for k in rows) and whole[0] == whole[1] == 1
        ends = sorted((r["sequence_id"], r["offset"], r["length"]) for r in found)
        assert all(b[1] == (a[1] + a[2] if a[0] == b[0] else 0) for a, b in zip(ends, ends[1:])) and all(x[1] + x[2] <= 2048 for x in ends)
    if name == "op2_langid":
        assert all(rows[k]["lang_pred"] == "und" for k in range(4))
    if name == "op3_mixing":
        assert rows[0]["size"] == 0 and rows[5]["size"] == 3000 and all(0 <= r["taken"] <= 2 * r["size"] for r in rows.values())
    if name == "op4_quality":
        assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows.values())
    if name == "op5_rules":
        assert all(rows[k]["base_failed"] and not rows[k]["kept"] for k in TEXTS)
    if name == "op6_urls":
        assert all((r["host"] is None) == (k % 13 == 0) and r["blocked"] == (r["n_active"] > 0) for k, r in rows.items())
    if name == "op7_lm":
        assert [rows[k]["n_tokens"] for k in range(6)] == [1, 1, 1, 5, 2, 3001] and all(r["n_known"] <= r["n_tokens"] for r in found)
    if name == "op8_licences":
        assert all(r["licence"] is None and r["n_matches"] == 0 for r in found)
    if name == "op9_vectors":
        assert all(rows[k]["n_links"] == 0 and rows[k]["kept"] for k in range(80, 84)) and all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found)
    if name == "op10_jaccard":
        assert [rows[k]["n_shingles"] for k in range(6)] == [0, 0, 0, 2, 1, 1] and all(rows[k]["component_id"] == k for k in range(6))
    if name == "op12_alignment":
        assert [rows[k]["n_a"] for k in (0, 1)] == [0, 0] and rows[0]["groups_sha256"] == "" and rows[5]["n_groups"] >= 3000 and all(r["n_best"] <= r["n_links"] <= r["count_sum"] for r in found)
    if name == "op13_toxicity":
        assert all(r["predicted"] == int(r["score"] >= 0.5) for r in found)


def clean(i):
    """Prose of words that clean documents share, in an order of its own."""
    rng = random.Random(i)
    return " ".join(rng.choice("the house of an old man and his sea is where we live when wind comes from over those hills".split()) for _ in range(90)) + "."


LONG = " ".join(clean(90 + k) for k in range(6))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Clean documents, junk, copies, rows of one id, nulls, and columns whose names clash with the stages' own."""
    at = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, clean(i), "en", "ab"[i % 2], "x") for i in range(60)] + [(100 + i, "$$$ buy now click here " * 30, "en", "a", "x") for i in range(60)]
    rows += [(200, clean(3), "en", "a", "x"), (200, clean(3), "en", "a", "x"), (7, clean(70), "en", "b", "x"), (300, None, None, None, None), (301, "", "en", "a", "x"), (None, clean(80), "en", None, "x"), (302, LONG, "en", "b", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score string").write.parquet(f"{at}/documents.parquet")
    labels = [(i, 1) for i in [*range(60), 302]] + [(100 + i, 0) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{at}/labels.parquet")
    return at


def test_the_pipeline_runs_over_odd_rows(spark, corpus):
    import corpus_pipeline

    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    kept = docs
    counts = []
    for name, stage in corpus_pipeline.STAGES[:3]:
        rows = stage(spark, kept, corpus)
        assert rows.dtypes == docs.dtypes, name
        kept = spark.createDataFrame(rows.collect(), docs.schema)
        assert kept.schema == docs.schema and {r["score"] for r in kept.collect()} <= {"x", None}, name
        counts.append(kept.count())
        assert counts[-1] >= 60, name
    texts = {(r["doc_id"], r["text"]) for r in kept.collect()}
    assert {(i, clean(i)) for i in range(60)} | {(7, clean(70)), (None, clean(80)), (302, LONG)} <= texts
    assert not any(i == 200 or 100 <= (i or 0) < 160 for i, _ in texts) and len(texts) == counts[-1]
    out = corpus_pipeline.run(spark, corpus)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns)
    packed = {r["doc_id"] for r in out.collect()}
    assert packed <= {i for i, _ in texts} and len(packed) > 20
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, corpus).count() == 0, name
