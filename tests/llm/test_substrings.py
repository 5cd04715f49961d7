"""Repeated substrings against a plain version."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from marketspark.llm import substrings


def brute(texts, length=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int)]))
        kept = bytes(b for b, g in zip(d, gone, strict=False) if not g)
        out.append((len(d), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def make_texts():
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdeé"), rng.integers(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    p = [prose(120) for _ in range(6)]
    texts = [None, "", "x" * 199, "x" * 200, "y" * 201, "z" * 900, prose(300), "ab" * 400, "\0" * 300 + prose(20)]
    for _ in range(25):
        a = p[rng.integers(0, 6)]
        s = rng.integers(0, 300)
        texts.append(prose(rng.integers(0, 60)) + a[s : s + rng.integers(150, 420)] + prose(rng.integers(0, 60)) + a[: rng.integers(0, 260)])
    base = prose(200)
    for _ in range(12):  # near copies
        i = rng.integers(0, len(base))
        texts.append(base[:i] + "#" + base[i + 1 :])
    return [*texts, base, base, texts[12]]


SCHEMA = "doc_id long, text string, key long, place string, spans string, packed string"


@pytest.mark.parametrize("split,hot", [(2048, 1000), (1, 1000), (3, 1 << 12)])
def test_repeats(spark, split, hot, monkeypatch):
    monkeypatch.setattr(substrings, "SPLIT", split)
    monkeypatch.setattr(substrings, "MOST_HOT", hot)  # with the last, every key is dealt to several parts
    texts = make_texts()
    rows = [(None if i == 20 else i % 40, t, 1, "x", "x", "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in substrings.remove_repeats(docs).drop("doc_id").collect())
    assert got == sorted(brute(texts))


def test_small_blocks_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK", 500)
    monkeypatch.setattr(substrings, "PIECE", 400)
    texts = make_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = sorted(tuple(r) for r in substrings.remove_repeats(docs).drop("doc_id").collect())
    assert got == sorted(brute(texts))


def test_bucket_of_many_different_runs(spark):
    rng = np.random.default_rng(8)
    noise = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    passage, other = noise(230), noise(205)
    texts = [noise(rng.integers(0, 80)) + passage + noise(rng.integers(0, 80)) for _ in range(2300)]
    texts += [t[:100] + "#" + t[101:] for t in texts[:300]] + [other + t[:150] for t in texts[:40]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = sorted(tuple(r) for r in substrings.remove_repeats(docs).drop("doc_id").collect())
    assert got == sorted(brute(texts))


def test_empty_table(spark):
    assert substrings.op10(spark.createDataFrame([], SCHEMA)).count() == 0


def test_cover():
    c = np.flatnonzero(substrings.COVER)
    assert {(int(a) - int(b)) % 7 for a in c for b in c} == set(range(7))
