"""Ranked search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from marketspark.llm import ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def plain(docs, items, k=10):
    held = [(d, c) for d, t in docs if (c := Counter(TERM.findall(low(t))))]
    n, total = len(held), sum(c.total() for _, c in held)
    df = Counter(w for _, c in held for w in c)
    out = []
    for item, text in set(items):
        asked, scores = Counter(TERM.findall(low(text))), []
        for d, c in held:
            m = 25 + 75 * c.total() * n // total
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w, q in asked.items())
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def texts(seed, n, vocabulary):
    rng = random.Random(seed)
    return [" ".join(f"w{int(rng.paretovariate(0.6)) % vocabulary}" for _ in range(rng.choice((0, 1, 5, 40, 400)))) for _ in range(n)]


ODD = [None, "", " -- ", "Ünï-CODE Élan élan", "W1 w1 W1", "w1_w2.w3 w1", "x" * 20000, "w1 " * 5000, "once only rareterm"]


@pytest.mark.parametrize(("vocabulary", "most_terms", "cells"), [(30, 4096, 1 << 23), (500, 20, 1 << 23), (500, 4096, 4000)])
def test_equal_to_scoring_all(spark, monkeypatch, vocabulary, most_terms, cells):
    monkeypatch.setattr(ranking, "CELLS", cells)
    all_texts = texts(1, 300, vocabulary)
    docs = [(i, t) for i, t in enumerate(all_texts + all_texts[:20] + ODD)] + [(5, all_texts[5]), (None, "w1 w2 w3"), (None, "w1 w2 w3")]
    items = [(i, t) for i, t in enumerate(texts(2, 12, vocabulary) + ["Élan w1 w1", None, "", "zzz", "rareterm w2", "w1"])] + [(3, "w4 w5"), (17, "w1")]
    d = spark.createDataFrame([(*x, 1, 2) for x in docs], "doc_id long, text string, n long, term long").repartition(3)
    b = spark.createDataFrame([(*x, 0) for x in items], "item_id long, text string, score long")
    got = ranking.rank(d, b, most_terms=most_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(docs, items)


@pytest.mark.parametrize(("docs", "items"), [([], [(1, "a")]), ([(1, "a")], []), ([(1, None), (2, "--")], [(1, "a")]), ([(1, "a")], [(1, None)])])
def test_empty(spark, docs, items):
    got = ranking.op13(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert got.collect() == [] and got.columns == ["item_id", "rank", "doc_id", "score"]


def test_reading_stops_early_and_strictly():
    rng = np.random.default_rng(3)
    n_docs, n_terms = 2000, 6
    tf = rng.integers(0, 4, (n_terms, n_docs)) * (rng.random((n_terms, n_docs)) < 0.5)
    tf[:, 7] = 400
    term, doc = np.nonzero(tf)
    n = np.maximum(tf.sum(0), 1) + 20
    lists = ranking.Lists(n, doc, term, tf[term, doc], n_terms, n_docs, int(n.sum()))
    w = np.array([9, 5, 4, 3, 2, 1])
    whole = (lists.impact.astype(np.int64) * w[:, None]).sum(0)
    docs, scores = lists.best(np.arange(n_terms), w, 0, 1)
    assert docs[scores.argmax()] == 7 and scores.max() == whole.max() and len(docs) < 10
    kth = int(np.sort(whole)[-10])
    docs, scores = lists.best(np.arange(n_terms), w, 0, 10)
    assert sorted(docs) == np.flatnonzero(whole >= kth).tolist()  # all ties of the tenth, too
    assert len(lists.best(np.arange(n_terms), w, int(whole.max()) + 1, 10)[0]) == 0
