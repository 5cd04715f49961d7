"""The Jaccard join against all pairs."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

from marketspark.llm import setjoin

from . import brute


def plain_set(text):
    w = brute.words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()


def plain(docs):
    sets, root = [plain_set(t) for _, t in docs], list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(docs)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(docs)), key=repr)


def corpus(seed):
    """Near copies around the threshold, chains of them, a common passage, texts of few words, odd rows."""
    rng = random.Random(seed)
    word = lambda n: f"w{rng.randrange(n)}"
    passage = [word(10**6) for _ in range(40)]
    texts = []
    for size in (9, 11, 12, 30, 70, 150, 400, 1500):
        base = [word(10**6) for _ in range(size)]
        for _ in range(6):
            texts.append(list(base))
            base = list(base)
            for _ in range(rng.randrange(1, 2 + size // 50)):  # a chain: each is near the one before
                base[rng.randrange(len(base))] = word(10**6)
    big = [word(10**6) for _ in range(120)]
    for _ in range(60):  # a group of near copies
        t = list(big)
        t[rng.randrange(120)] = word(10**6)
        texts.append(t)
    for n in (5, 20, 60, 300):  # texts that share only a passage
        texts += [passage + [word(10**6) for _ in range(n)] for _ in range(25)]
    texts += [[word(4) for _ in range(n)] for n in range(1, 40)]  # frequent shingles only
    rng.shuffle(texts)
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    n = len(docs)
    odd = [None, "", " \t\n", "one", "One", "two words", "a b c", "A  b\nc", "ü Ü é", "x " * 5000]
    return [*docs, *((n + i, t) for i, t in enumerate(odd)), docs[3], (None, docs[4][1]), (None, "no id at all here"), (n + 50, docs[5][1].upper())]


@pytest.mark.parametrize(("seed", "rare", "very", "chunk"), [(1, 32, 1024, 512), (2, 2, 6, 16)])
def test_no_link_is_lost(spark, seed, rare, very, chunk):
    docs = corpus(seed)
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, n long, a long").repartition(4)
    want = plain(docs)
    got = setjoin.join(df, chunk=chunk, rare=rare, very=very).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert len({w[2] for w in want}) < len(want) - 60


@pytest.mark.parametrize("docs", [[], [(1, None), (2, ""), (None, " ")], [(5, "a b c"), (4, "A B C")]])
def test_small_tables(spark, docs):
    got = setjoin.op12(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == plain(docs) and got.columns == ["doc_id", "n_shingles", "component_id"]


def test_linked_sets_share_a_signature():
    """For any class of each hash: sets at the threshold share a signature."""
    rng = np.random.default_rng(0)
    for trial in range(300):
        a = int(rng.integers(9, 1200))
        s = rng.integers(0, 2**64, 2 * a + 40, np.uint64)
        most = a // 9  # b has no more than so many others
        gone, new = (int(x) for x in rng.multinomial(int(a * 0.1) if trial % 2 else most, [0.5, 0.5]))
        x, y = np.unique(s[:a]), np.unique(np.concatenate([s[gone:a], s[a : a + new]]))
        both = len(np.intersect1d(x, y))
        if 100 * both < 90 * (len(x) + len(y) - both):
            continue
        n = lambda h: (2, 20, 40, 5000)[int(h >> 7) % 4] if trial % 3 else (2000 if int(h >> 7) % 50 else 2)
        found = []
        for z in (x, y):
            low = int(np.searchsorted(z, np.uint64(setjoin.REGION)))
            first = z[: setjoin.prefix_size(len(z), low)]
            counts = np.array([n(x) for x in first.tolist()])
            found.append(set(setjoin.signatures_of(len(z), low, np.arange(len(first)), first, counts).tolist()))
        assert found[0] & found[1], (trial, a)


@pytest.mark.parametrize("half", [0, 300])
def test_near_copies_of_which_few_link(spark, monkeypatch, half):
    """Large groups of near copies: right classes, and tables on the way that grow with the documents, not with their pairs."""
    rng = random.Random(half)
    base = [f"b{i}" for i in range(120)]
    docs = []
    for k in range(600):
        t = list(base)
        for _ in range(1 if k < half else 2):  # two sets of one word changed each link, others hardly ever
            t[rng.randrange(120)] = f"n{rng.randrange(10**6)}"
        docs.append((k, " ".join(t)))
    saved = {}

    def save(df, name, put=setjoin.save):
        out = put(df, name)
        saved[name] = max(saved.get(name, 0), out.count())
        return out

    monkeypatch.setattr(setjoin, "save", save)
    got = setjoin.op12(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))
    assert sorted(map(tuple, got.collect()), key=repr) == plain(docs)
    assert max(saved.values()) <= 8 * len(docs), saved


def test_common_passages_share_no_signature():
    """Sets of which a third is the same have no signature in common, so frequent shingles make no candidates."""
    rng = np.random.default_rng(1)
    common = rng.integers(0, 2**64, 100, np.uint64)
    seen = set()
    for _ in range(200):
        h = np.unique(np.concatenate([common, rng.integers(0, 2**64, 200, np.uint64)]))
        at = np.arange(setjoin.prefix_size(len(h), int(np.searchsorted(h, np.uint64(setjoin.REGION)))))
        first = h[at]
        own = set(setjoin.signatures_of(len(h), int(np.searchsorted(h, np.uint64(setjoin.REGION))), at, first, np.where(np.isin(first, common), 200, 1)).tolist())
        assert len(own & seen) <= 2
        seen |= own
