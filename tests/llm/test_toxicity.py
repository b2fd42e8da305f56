"""Multiple-instance learning of toxicity."""

import math
import re

import numpy as np
import pytest

from lumenframe.llm import toxicity
from lumenframe.llm.textbatch import chunks

SCHEMA = "doc_id long, text string, score string, _row string"
BAD = ("vorklat", "drumpfig")


def sentence(rng, bad=False):
    words = ["".join(rng.choice(list("aeioustrnl"), int(rng.integers(2, 8)))) for _ in range(int(rng.integers(3, 12)))]
    if bad:
        words[len(words) // 2] = BAD[int(rng.integers(2))] + str(rng.choice(["", "er", "s"]))
    return " ".join(words).capitalize()


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    out = []
    for i in range(700):
        toxic = i % 6 == 0
        own = [sentence(rng) for _ in range(int(rng.integers(1, 25)))]
        if toxic:
            own.insert(int(rng.integers(len(own) + 1)), sentence(rng, True))
        out.append((i, ". ".join(own) + ".\n", int(toxic)))
    return out


@pytest.fixture(scope="module")
def model(spark, texts):
    docs = spark.createDataFrame([(i, t, None, None) for i, t, _ in texts[:500]], SCHEMA)
    return toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in texts], "doc_id long, toxic int"))


def test_held_out_texts_are_told_apart(spark, texts, model):
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t, _ in texts[500:]], SCHEMA)
    out = toxicity.rate(docs, model)
    assert out.columns == ["doc_id", "text", "_row", "score", "predicted"]
    label = {i: y for i, _, y in texts}
    rows = out.collect()
    assert len(rows) == 200 and np.mean([r["predicted"] == label[r["doc_id"]] for r in rows]) > 0.97
    assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)


def test_offending_sentences_are_located(spark, texts, model):
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t, _ in texts[500:]], SCHEMA)
    rows = toxicity.offending(docs, model).collect()
    text = {i: t for i, t, _ in texts}
    bad = [any(b in r["sentence"].lower() for b in BAD) for r in rows]
    assert len(rows) > 25 and np.mean(bad) > 0.95
    for r in rows:
        assert text[r["doc_id"]][r["sentence_start"] :].startswith(r["sentence"])


def test_scores_equal_brute_force(model):
    """Sentences, words, n-grams and the noisy-or by plain string work, with the model's weights looked up by hash."""
    texts = ["", "...", "One two. Three!  four\nfive", "VORKLAT, you; “drumpfigs” said.\nÄh vorklater 日本 x?", "x" * 50 + " " + "y"]
    bits = len(model.weights).bit_length() - 1

    def features(words):
        out = set()
        for w in words:
            out.add(w)
            padded = f" {w} "
            out |= {padded[i : i + n] for n in toxicity.GRAMS for i in range(len(padded) - n + 1)}
        return out

    def number(gram):
        data = np.frombuffer(gram.encode(), np.uint8)
        return int(toxicity.Hashes(data).of(np.array([0]), np.array([len(data)]))[0] >> np.uint64(64 - bits))

    for text in texts:
        harmless = math.log1p(-model.leak)
        plain = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        for part in re.split(r"[.!?\n]", plain):
            words = re.findall(r"(?:[a-z0-9]|[^\x00-\x7f\u2000-\u207f])+", part)
            if words:
                odds = model.bias + sum(model.weights[i] for i in {number(g) for g in features(words)})
                harmless -= math.log1p(math.exp(odds)) if odds < 30 else odds
        assert model.score([text])[0] == pytest.approx(-math.expm1(harmless), abs=1e-12)


def test_blame_is_the_slope_of_the_loss():
    rng = np.random.default_rng(0)
    odds, text_of, toxic = rng.normal(-1, 1, 9), np.array([0, 0, 0, 1, 2, 2, 2, 2, 3]), np.array([True, False, True, False])

    def loss(odds):
        harmless = np.bincount(text_of, weights=-toxicity.softplus(odds), minlength=4) + np.log1p(-toxicity.LEAK)
        return -np.where(toxic, np.log(-np.expm1(harmless)), harmless).sum()

    slope = [(loss(odds + d) - loss(odds - d)) / 2e-5 for d in np.eye(9) * 1e-5]
    np.testing.assert_allclose(toxicity.blame(odds, text_of, toxic), slope, atol=1e-6)


def test_learning_does_not_depend_on_the_order_of_rows(spark, texts):
    labels = spark.createDataFrame([(i, y) for i, _, y in texts], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, t, None, None) for i, t, _ in texts[:200]], SCHEMA)
    a, b = toxicity.fit(docs.repartition(5), labels, rounds=10), toxicity.fit(docs.orderBy("text").coalesce(1), labels, rounds=10)
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_toxicity_edge_cases(spark, model):
    long = "plain words here " * 30_000
    rows = [(1, None, "", ""), (2, "", "", ""), (3, " \n..!", "", ""), (None, "x", "", ""), (5, long, "", ""), (5, long, "", ""), (6, long + ". vorklat drumpfig", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = toxicity.rate(docs, model).collect()
    score = {r["doc_id"]: r["score"] for r in got}
    assert len(got) == 7 and score[1] == score[2] == score[3] == pytest.approx(toxicity.LEAK) and score[5] < 0.5 < score[6]
    assert toxicity.rate(docs.limit(0), model).count() == 0 and toxicity.offending(docs.where("doc_id < 4"), model).count() == 0
    odd = spark.createDataFrame([(5, None), (5, 7), (6, 1), (6, 0), (None, 1)], "doc_id long, toxic int")
    assert isinstance(toxicity.fit(docs, odd, rounds=2), toxicity.Model)
    untaught = toxicity.fit(docs, odd.limit(0))
    assert not untaught.weights.any() and toxicity.rate(docs, untaught).count() == 7


def test_chunks_do_not_change_scores(texts, model):
    own = [t for _, t, _ in texts[:60]]
    whole = model.score(own)
    assert np.allclose(whole, [model.score([t])[0] for t in own]) and len(list(chunks(own))) == 1
