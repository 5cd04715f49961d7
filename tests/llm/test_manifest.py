"""The Merkle manifest against plain hashing."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from marketspark.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain(rows):
    """Rows as of op11, level by level."""
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, more=0: h(*map(enc, (r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1])))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
        return out

    def climb(path, i, new, siblings):
        for nodes in path[:-1]:
            run = nodes[i - i % 2 : i - i % 2 + 2]
            siblings += run[: i % 2] + run[i % 2 + 1 :]
            run[i % 2] = new
            new, i = h(*run), i // 2
        return new

    trees = defaultdict(list)
    for r in rows:
        trees[r[2]].append(r)
    names = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    for t in names:
        trees[t].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    built = {t: levels([leaf(r) for r in trees[t]]) for t in names}
    top = levels([built[t][-1][0] for t in names])
    out = []
    for k, t in enumerate(names):
        for i, r in enumerate(trees[t]):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            siblings = []
            folded = climb(top, k, climb(built[t], i, leaf(r, int(bad)), siblings), siblings)
            out.append((r[0], leaf(r), built[t][-1][0], top[-1][0], h(*siblings), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def rows(n):
    odd = [(None, "no id", "en", "a", 5), (None, "no id", "en", "a", 5), (None, None, None, None, None), (7, "", "", "", 0), (7, "", "", "", 0), (-3, "ü" * 9000, "en", None, 2**63 - 1), (8, "x", "zß", "b", None)]
    return [(i, f"text {i * i % 97}", ("en", "en", "en", "fr", None)[i % 5], f"s{i % 3}", i) for i in range(n)] + odd


@pytest.mark.parametrize(("n", "chunk"), [(300, 4), (60, 16), (40, 2048)])
def test_op11(spark, n, chunk):
    docs = [(*r, "own", "own") for r in rows(n)]
    got = manifest.op11(spark.createDataFrame(docs, SCHEMA).repartition(5), chunk, 50)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = plain([d[:5] for d in docs])
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert {w[6] for w in want} == {True, False}


@pytest.mark.parametrize("docs", [[], [(1, "one", "en", "a", 3)], [(None, None, None, None, None)]])
def test_small_tables(spark, docs):
    got = manifest.op11(spark.createDataFrame([(*d, "", "") for d in docs], SCHEMA))
    assert sorted(map(tuple, got.collect()), key=repr) == plain(docs)


def test_midstates_are_those_of_sha256():
    rng = np.random.default_rng(5)
    raw = rng.integers(0, 256, (7, 32), np.uint8)
    digests, states = manifest.grow(raw, 3)
    for below, above in zip(digests[:-1], digests[1:], strict=True):
        assert [x.tobytes().hex() for x in above] == [h(*(y.tobytes().hex() for y in below[i : i + 2])) for i in range(0, len(below), 2)]
    new = rng.integers(0, 256, (1, 32), np.uint8)
    # the second slot needs the kept state and no sibling's digest
    got = manifest.resume(new, np.array([True]), states[0][1:2], np.zeros((1, 32), np.uint8), np.array([True]))
    assert got[0].tobytes().hex() == h(raw[2].tobytes().hex(), new[0].tobytes().hex())
    assert bytes(manifest.INITIAL.astype(">u4").tobytes()).hex().startswith("6a09e667bb67ae85")


def test_fold_one_leaf_of_a_stored_manifest(spark):
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(50)]
    nodes = spark.createDataFrame([("=en", i, 50, d) for i, d in enumerate(leaves)], "tree string, idx long, n long, digest binary")
    chunks, roots = manifest.manifest(nodes, 8)
    new = hashlib.sha256(b"new").digest()
    one = spark.createDataFrame([("=en", 37, new, "mine")], "tree string, idx long, new binary, note string")
    r = manifest.fold(one, chunks, ["note"], 8).first()
    again, changed = manifest.manifest(spark.createDataFrame([("=en", i, 50, new if i == 37 else d) for i, d in enumerate(leaves)], nodes.schema), 8)
    assert r.note == "mine" and r.folded == changed.first().root != roots.first().root
