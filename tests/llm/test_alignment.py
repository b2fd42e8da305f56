"""Cross-tokenizer alignment, against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import alignment

PATH = public_tokenizers.path
FILES = (PATH("byte_bpe_50k.json"), PATH("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, PATH("piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string, n_a string, _row string, `a.b` int"
PROSE = "The anoner of thendly houses, was erwhation - and 4193 in the ÄÖÜ straße. " * 3
TEXTS = [
    None, "", " ", "  ", "\n", "one", " lead", "trail ", "two  spaces", "tab\tand\nline", "a\n b", "a \n b", "a\n \n b", "a \nb", "x  y z", "<|endoftext|> <s> </s> <unk> <0x41>",
    PROSE, PROSE, PROSE.upper(), "n" * 3000, "anan" * 500 + " xyxyz" * 200, "漢字 \U0001f600\U0001f468‍\U0001f469 ｆｕｌｌ ﬁ ½ é", "▁ under ▁▁score", "nul\x00byte", "don't won't I'll 'tis", "3.14159 100,000 $$$ ### !!!", "\r\n\r\n x \v\f y",
    "word " * 2000 + "end",
]


def brute(texts):
    """n_a, n_b, n_groups, n_links, n_best, count_sum and sha of each text, from the libraries' own results."""
    import sentencepiece
    import tokenizers

    exact = tokenizers.Tokenizer.from_file(FILES[0])
    exact.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=FILES[3])
    bytes_a = alignment.encoders(*FILES)[2]

    def piece(i):
        spelled = re.fullmatch(r"<0x(..)>", model.id_to_piece(i))
        return bytes.fromhex(spelled[1]) if spelled else model.id_to_piece(i).replace("▁", " ").encode()

    out, links = [], []
    for text in texts:
        whole = (" " + (text or "")).encode()
        a, b = (exact.encode(" " + text, add_special_tokens=False).ids, model.encode(text)) if text else ([], [])
        if not text or b"".join(bytes_a[i] for i in a) != whole or b"".join(map(piece, b)) != whole:
            out.append([0, 0, 0, 0, ""])
            links.append(Counter())
            continue
        ends_a, ends_b = np.cumsum([len(bytes_a[i]) for i in a]).tolist(), np.cumsum([len(piece(i)) for i in b]).tolist()
        both = sorted(set(ends_a) & set(ends_b))
        groups = defaultdict(lambda: ([], []))
        for side, ids, ends in ((0, a, ends_a), (1, b, ends_b)):
            for i, end in zip(ids, ends):
                groups[min(x for x in both if x >= end)][side].append(i)
        found = Counter((x, y) for g in groups.values() for x in g[0] for y in g[1])
        spelled = ";".join(",".join(map(str, groups[g][0])) + "|" + ",".join(map(str, groups[g][1])) for g in both)
        out.append([len(a), len(b), len(both), sum(found.values()), hashlib.sha256(spelled.encode()).hexdigest()])
        links.append(found)
    count = Counter(pair for own in links for pair in own)
    best = Counter()
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    return [(*row[:4], sum(n for p, n in own.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in own.items()), row[4]) for row, own in zip(out, links)]


@pytest.mark.parametrize("limits", [{}, {"LINKS": 50, "ROW": 3, "PART": 2, "MOST_PART": 5, "TEXTS": 2}])
def test_alignment_equals_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(alignment, name, value)
    texts = TEXTS + [f"{PROSE[i:]} {i} the {'of ' * i}" for i in range(12)]
    # ids that are null or equal are documents of their own; the second rows of each text repeat it
    rows = [(None if i % 7 == 0 else i % 20, t, "clash", "clash", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = alignment.align(docs, *FILES)
    assert out.columns == ["doc_id", "text", "_row", "a.b", *alignment.COLUMNS]
    got = {r["a.b"]: tuple(r[c] for c in alignment.COLUMNS) for r in out.collect()}
    want = brute(texts)
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        assert got[i] == want[i], text


@pytest.mark.parametrize("known", [3, 500_000])
def test_units_give_what_whole_texts_give(monkeypatch, known):
    monkeypatch.setattr(alignment, "KNOWN", known)
    aligner = alignment.Aligner(*FILES)
    texts = [t for t in TEXTS if t]
    for text in texts:
        numbers, digests, *_ = aligner.align([text])
        a, b = aligner.encode_a([" " + text])[0], aligner.encode_b([" " + text])[0]
        assert numbers[0][:2].tolist() in ([len(a), len(b)], [0, 0])


def test_a_group_of_many_tokens_is_counted_before_pairs_are_formed(monkeypatch):
    monkeypatch.setattr(alignment, "SLICE", 3)
    a, b = np.array([5, 5, 5, 7]), np.array([1, 1, 2])
    group = np.zeros(4, np.int64)
    got = [x for part in alignment.pairs_of(a, b, group, group[:3], 10) for x in zip(*(y.tolist() for y in part))]
    assert sorted(got) == [(0, 51, 6), (0, 52, 3), (0, 71, 2), (0, 72, 1)]


def test_alignment_of_nothing(spark):
    none = alignment.align(spark.createDataFrame([], SCHEMA), *FILES)
    assert none.count() == 0
    blank = alignment.align(spark.createDataFrame([(1, None, "", "", 1), (2, "", "", "", 1)], SCHEMA), *FILES)
    assert [tuple(r[c] for c in alignment.COLUMNS) for r in blank.collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_a_hot_id_is_dealt_over_parts(spark, monkeypatch):
    monkeypatch.setattr(alignment, "PART", 100)
    monkeypatch.setattr(alignment, "LINKS", 10)
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.lit("the the end").alias("text")).repartition(8)
    rows = alignment.align(docs, *FILES).distinct().drop("doc_id").distinct().collect()
    assert len(rows) == 1 and rows[0]["count_sum"] == 600 * rows[0]["n_links"] and rows[0]["n_best"] == rows[0]["n_links"]
