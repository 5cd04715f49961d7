"""The pipeline's stages against plain versions."""

from collections import Counter

import pytest

from marketspark.llm import simhash
from marketspark.llm.queries import queries

from . import brute


@pytest.fixture(scope="module")
def docs(spark):
    import os

    d = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(d):
        pytest.skip("no test tables")
    return spark.read.parquet(d)


def test_stages(spark, docs, tmp_path):
    import corpus_pipeline as p

    stages = dict(p.STAGES)
    assert [k for k, _ in p.STAGES] == ["quality rules", "near-duplicates", "personal data", "mixing", "packing"]

    def done(name, df):
        out = stages[name](spark, df, "")
        out.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    rows = docs.collect()
    good = done("quality rules", docs)
    kept = {r.doc_id for r in good.collect()}
    assert good.columns == docs.columns
    assert not any(r.doc_id in kept for r in rows if brute.quality(r.text)[5])
    assert len(kept) > 0.5 * sum(not brute.quality(r.text)[5] for r in rows)

    fps = [(r.doc_id, brute.simhash(r.text)) for r in good.collect()]
    want = {c for c in brute.components(fps)}
    single = done("near-duplicates", good.union(good.limit(3)))
    assert sorted(r.doc_id for r in single.collect()) == sorted(want) and single.columns == docs.columns

    clean = done("personal data", single)
    assert clean.count() == single.count() and clean.columns == docs.columns
    assert all(sum(brute.pii(r.text)[0]) == 0 for r in clean.collect())

    mix = done("mixing", clean)
    sizes, got = Counter(), Counter()
    for r in clean.collect():
        sizes[r.source] += len(brute.words(r.text))
    for r in mix.collect():
        got[r.source] += len(brute.words(r.text))
    assert all(abs(got[s] - t) <= 1 for s, t in brute.mix_targets(dict(sizes)).items()) and mix.columns == docs.columns

    pieces = done("packing", mix).collect()
    total = sum(r.length for r in pieces)
    assert sum(r.length for r in pieces if r.sequence_id < total // 2048) == total // 2048 * 2048
    assert len({(r.sequence_id, r.offset) for r in pieces}) == len(pieces)


def test_packed_pieces_hold_their_token_ids(spark):
    import zlib

    import corpus_pipeline as p

    rows = p.packed(spark, spark.createDataFrame([(i, "some words to pack " * 700) for i in range(3)], "doc_id long, text string"), "").collect()
    assert sum(r.length for r in rows) > 2048
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in rows)


def test_run_leaves_no_tables_of_earlier_stages(spark, tmp_path, monkeypatch):
    import os

    import corpus_pipeline as p
    from marketspark.llm import common

    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path))
    rows = p.run(spark, "/root/testdata/sf0.001")
    assert {r.doc_tokens > 0 and len(r.ids) == 4 * r.length for r in rows.collect()} == {True}
    left = sorted(n.rsplit("-", 1)[0] for n in os.listdir(tmp_path) if not n.startswith("."))
    assert left == ["marketspark-corpus-3", "marketspark-tokens"]


def test_own_columns_pass_all_stages(spark):
    """Columns with names that operators use for their own."""
    import corpus_pipeline as p

    names = ["n_words", "kept", "findings", "_row", "_text", "_pii_email", "fp", "size", "own", "taken", "base_failed", "_salt"]
    text = lambda i: f"mail me at user{i}@host.org now " + " ".join(f"word{i * 31 + j * j}" for j in range(40))
    docs = spark.createDataFrame([(i, text(i), "s", *(f"{n} {i}" for n in names)) for i in range(8)], ", ".join(f"`{c}` {t}" for c, t in [("doc_id", "long"), ("text", "string"), ("source", "string"), *((n, "string") for n in names)]))
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        rows = out.collect()
        assert {tuple(r[n] for n in names) for r in rows} == {tuple(f"{n} {i}" for n in names) for i in range(8)}, name
    assert p.carried(docs.select("doc_id", "text"), ["doc_id", "text"], lambda d: d).columns == ["doc_id", "text"]


def test_one_of_each_keeps_null_ids(spark):
    d = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (2, "q r s t u"), (1, "Q r s t u"), (1, "Q r s t u")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in simhash.one_of_each(d.coalesce(1)).collect()) == [(0, "a b c d"), (1, "Q r s t u")]


def test_every_operator_has_a_query():
    assert [k.split("_")[0] for k in queries()] == [f"op{i}" for i in range(1, 14)]
