"""The trigram model against a plain version."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marketspark.llm import language_model as lm

from . import brute


def plain(rows):
    """doc_id, text -> (held_out, n_tokens, n_known, N, base, score) with exact probabilities."""
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    docs = [(zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2, [*brute.words(low(t)), None]) for i, t in rows]
    uni, bi, tri = Counter(), Counter(), Counter()
    for held, w in docs:
        if not held:
            ctx = ["<s>", "<s>", *w]
            uni.update(w)
            bi.update(zip(ctx[1:], w))
            tri.update(zip(ctx, ctx[1:], w))
    n, v, d = sum(uni.values()), len(uni), 0.75
    c2, t2, c3, t3 = Counter(), Counter(), Counter(), Counter()
    for (b, _), c in bi.items():
        c2[b] += c
        t2[b] += 1
    for (a, b, _), c in tri.items():
        c3[a, b] += c
        t3[a, b] += 1
    out = []
    for held, w in docs:
        ctx, s, base = ["<s>", "<s>", *w], 0.0, 0.0
        for a, b, x in zip(ctx, ctx[1:], w):
            p = (max(uni[x] - d, 0) + d * v / (v + 1)) / n if n else 1
            if c2[b]:
                p = max(bi[b, x] - d, 0) / c2[b] + d * t2[b] / c2[b] * p
            if c3[a, b]:
                p = max(tri[a, b, x] - d, 0) / c3[a, b] + d * t3[a, b] / c3[a, b] * p
            s += math.log10(p)
            base += math.log10((uni[x] + 1) / (n + v + 1))
        out.append((held, len(w), sum(uni[x] > 0 for x in w), n, base, s))
    return out


def rows():
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcé"), rng.integers(1, 4))) for _ in range(40)]
    texts = [" ".join(rng.choice(words, rng.integers(0, 60))) for _ in range(60)]
    return [*enumerate([*texts, None, "", " \n", "The THE the", *texts[:5]]), (3, texts[3]), (None, texts[4])]


@pytest.mark.parametrize("partitions,hot", [(1, 2.0), (5, 2.0), (5, 0.02), (1, 0.2)])
def test_scores(spark, partitions, hot, monkeypatch):
    monkeypatch.setattr(lm, "HOT", hot)  # with small values, every frequent word is split
    data = rows()
    docs = spark.createDataFrame([(i, t, 1, "x", "x") for i, t in data], "doc_id long, text string, block long, words string, score string").repartition(partitions)
    got = sorted((tuple(r) for r in lm.op3(docs).collect()), key=str)
    want = sorted(((i, *p) for (i, _), p in zip(data, plain(data), strict=True)), key=str)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5]
        assert abs(g[5] - w[5]) < 1e-9 * (1 + abs(w[5]))
        assert abs(g[6] - w[6]) < 0.04 * w[2] + 1e-9  # codes have a step of an eighth of a bit
    assert abs(sum(g[6] for g in got) / sum(w[6] for w in want) - 1) < 0.01


def test_words_that_share_half_a_hash_stay_apart(spark):
    ids = [i for i in range(200) if brute.crc_bucket(i, 7) != 2][:61]
    data = [(i, "x w26041") for i in ids[:60]] + [(ids[60], "x w95849")]
    got = {r.doc_id: r.score for r in lm.op3(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    want = plain(data)
    assert all(abs(got[i] - w[5]) < 0.12 for (i, _), w in zip(data, want, strict=True))
    assert got[ids[60]] < got[ids[0]] - 1.5


def test_a_word_in_every_other_place(spark):
    data = [(i, "the a the b the c the d " * (1 + i % 3)) for i in range(40)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    made, old = [], lm.Hot
    try:
        lm.Hot = lambda rows: made.append(old(rows)) or made[-1]
        got = {r.doc_id: r.score for r in lm.op3(docs).collect()}
    finally:
        lm.Hot = old
    want = plain(data)
    assert made[0].parts.max() >= 7 and made[0].totals.max() == sum(4 * (1 + i % 3) for (i, _), w in zip(data, want, strict=True) if not w[0])
    assert all(abs(got[i] - w[5]) < 0.04 * w[1] for (i, _), w in zip(data, want, strict=True))


def test_packed_numbers():
    for x in ([], [0], [0, 0], [255, 256], [1 << 40, 0, 3]):
        assert lm.expand(lm.squeeze(np.array(x, np.int64)), len(x)).tolist() == x


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 300)), max_size=120), st.lists(st.tuples(st.integers(0, 6), st.integers(0, 400)), max_size=40), st.integers(1, 40))
def test_search_inside_a_context(children, asked, chunk):
    old, lm.CHUNK = lm.CHUNK, chunk
    try:
        have = np.array(sorted(set(children)), np.int64).reshape(-1, 2)
        parts = lm.load(np.frombuffer(lm.dump(lm.Level.build(have[:, 0], have[:, 1], 8)), np.uint8))
        ef = [lm.EliasFano(int(p[0][0]), int(p[0][1]), p[3], p[2], p[1]) for p in (parts[:4], parts[4:])]
        q = np.array(sorted([*asked, *map(tuple, have[::3].tolist())]), np.int64).reshape(-1, 2)
        place, found = lm.Level(*ef).find(q[:, 0], q[:, 1])
        known = {tuple(x): i for i, x in enumerate(have.tolist())}
        assert found.tolist() == [tuple(x) in known for x in q.tolist()]
        assert all(place[i] == known[tuple(x)] for i, x in enumerate(q.tolist()) if found[i])
    finally:
        lm.CHUNK = old


def test_empty_and_untrained(spark):
    schema = "doc_id long, text string"
    assert lm.op3(spark.createDataFrame([], schema)).count() == 0
    held = next(i for i in range(100) if brute.crc_bucket(i, 7) == 2)
    (r,) = lm.op3(spark.createDataFrame([(held, "a b")], schema)).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 3, 0, 0, 0.0, 0.0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**63), min_size=1, max_size=200), st.lists(st.integers(0, 2**63), max_size=50))
def test_elias_fano(values, asked):
    values = np.sort(np.array(values, np.uint64))
    ef = lm.EliasFano.of(values)
    assert (np.concatenate([ef.chunk(k) for k in range(len(ef.directory))]) == values).all()
    x = np.sort(np.array([*asked, *values[::3]], np.uint64))
    place, equal = ef.successor(x)
    assert (place == np.searchsorted(values, x)).all() and (equal == np.isin(x, values)).all()
    again = lm.load(np.frombuffer(lm.dump(ef.parts()), np.uint8))
    assert all((a == b).all() for a, b in zip(again, ef.parts(), strict=True))


def test_elias_fano_over_chunks(monkeypatch):
    monkeypatch.setattr(lm, "CHUNK", 16)
    rng = np.random.default_rng(0)
    values = np.sort(rng.integers(0, 1 << 62, 1000, dtype=np.uint64) >> rng.integers(0, 40, 1000, dtype=np.uint64))
    ef = lm.EliasFano.of(values)
    x = np.sort(np.concatenate([values[::2], rng.integers(0, 1 << 62, 500, dtype=np.uint64)]))
    place, equal = ef.successor(x)
    assert (place == np.searchsorted(values, x)).all() and (equal == np.isin(x, values)).all()
    i = np.sort(rng.integers(0, 1000, 300))
    assert (ef[i] == values[i]).all()
