"""Quality rules, SimHash, PII, mixing and packing against plain versions."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marketspark.llm import mixing, packing, pii, quality, simhash

from . import brute

BASE = "the quick brown fox jumps over the lazy dog while seven old wizards brew strong tea for a tired king of spades today"
TEXTS = [
    None,
    "",
    " \t\n",
    "one",
    "Two words",
    BASE,
    BASE.upper(),
    BASE + " again",
    (BASE + "\n") * 4,
    "a\nb\na\n\n\na\nb c\r\nb c\r",
    "x " * 300,
    " ".join(str(i * 7919) for i in range(20000)),
    "mail me: a.b+c@ex-am.ple.org_d@e.fr, @x.y a@b 1.2.3.4.5 300.1.1.1 host 10.0.0.255",
    "card 4111 1111 1111 1111 12/26 and 4111-1111-1111-1111 or 378282246310005; +49 (30) 1234-567. +1 é +33.1.22.33.44.55",
    "é ñ 🎈 4111111111111111 +4930123456789012345 tail 00000000000000",
    "IBAN GB82 WEST 1234 5698 7654 32 and DE89370400440532013000 ssn 123-45-6789, 987-65-4321",
    "a" * 50000 + "@" + "b." * 20000 + "1." * 3000 + "+" + "1 " * 5000,
    "#*$%&|<> " * 9 + "\x0b\x0c\x1c\x85  end",
    "1.2.3.4@host.com +12345678901@x.org 000000000018.1.1.1",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, findings string, size string, kept string, part string"


def table(spark, texts=TEXTS):
    rows = [(i, t, "en", None if i % 7 == 6 else f"s{i % 4}", 1, "x", "x", "x", "x", "x") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, *rows[3:9], (None, BASE, None, None, None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality_tells_thue_morse_words_apart(spark):
    """Polynomial hashes modulo 2**64 are equal for these, for every base."""
    for n in (10, 12):
        a = "".join("ab"[i.bit_count() % 2] for i in range(1 << n))
        b = a.translate(str.maketrans("ab", "ba"))
        texts = [f"{a}\n{b}", f"{a}\n{b}\n{a}", " ".join([*"stuvwxy", a, *"stuvwxy", b, *"stuvwxy"]), " ".join([*"stuvwxy", a] * 2)]
        got = quality.quality_rules(spark.createDataFrame([(t,) for t in texts], "text string")).select("text", *quality.COUNTS[:5], "base_failed").collect()
        assert sorted(map(tuple, got)) == sorted((t, *brute.quality(t)) for t in texts)


def test_quality(docs, empty):
    got = sorted(map(tuple, quality.quality_rules(docs).select("text", *quality.COUNTS[:5], "base_failed", "kept").collect()), key=str)
    want = sorted(((r.text, *brute.quality(r.text)) for r in docs.collect()), key=str)
    assert [g[:7] for g in got] == want
    assert all(not (g[6] and g[7]) for g in got)
    assert {g[0]: g[7] for g in got}[BASE] is True
    assert quality.op7(empty).count() == 0


def test_quality_slices_do_not_matter(docs, monkeypatch):
    rows = lambda: sorted(map(str, quality.op7(docs).collect()))
    whole = rows()
    import pyarrow as pa

    texts = pa.array([r.text for r in docs.collect()])
    one = quality.measure(texts)
    parts = [quality.measure(s) for s in quality.slices(texts, 1000)]
    for k in one:
        assert (one[k] == np.concatenate([p[k] for p in parts])).all()
    assert whole == rows()


def test_simhash(docs, empty):
    rows = docs.collect()
    fps = [(r.doc_id, brute.simhash(r.text)) for r in rows]
    want = sorted(((d, format(f, "016x"), c) for (d, f), c in zip(fps, brute.components(fps), strict=True)), key=str)
    assert sorted((tuple(r)[:3] for r in simhash.near_duplicates(docs).collect()), key=str) == want
    assert simhash.op1(empty).count() == 0


@pytest.mark.parametrize("chunk", [4, 16384])
def test_links_of_near_fingerprints(spark, chunk, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = [int(s) ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for s in seeds for k in (0, 1, 2, 3, 3, 4, 5, 6, 7) for _ in range(3)]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    rows = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in rows.join(simhash.classes(rows), "fp").collect()}
    assert got == dict(enumerate(brute.components(list(enumerate(fps)))))


def test_bit_slices():
    rng = np.random.default_rng(1)
    f = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    f[1::2] = f[::2] ^ (np.uint64(1) << rng.integers(0, 64, 150, dtype=np.uint64))
    a = simhash.planes(f)
    every = np.full(a.shape[1], 0xFFFFFFFFFFFFFFFF, np.uint64)
    for shift in (1, 2, 63, 64, 65, 200):
        for radius in range(4):
            got = set(simhash.within(a, every, shift, radius)) & set(range(300 - shift))
            assert got == {i for i in range(300 - shift) if (int(f[i]) ^ int(f[i + shift])).bit_count() <= radius}


def test_pii(docs, empty):
    got = sorted(((r.doc_id, [r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256) for r in pii.op4(docs).collect()), key=str)
    assert got == sorted(((r.doc_id, *brute.pii(r.text)) for r in docs.collect()), key=str)
    spans = {r.doc_id: r.spans for r in pii.op4(docs).collect()}
    assert "iban:5:32" in spans[15] and spans[15].count("iban") == 2 and spans[15].count("ssn") == 2
    assert pii.op4(empty).count() == 0


def test_redaction(spark):
    d = spark.createDataFrame([(1, "write a@b.cd or +49 30 1234567!"), (2, None), (3, "4111111111111111")], "doc_id long, text string")
    assert [r.text for r in pii.redact(d).orderBy("doc_id").collect()] == ["write [EMAIL] or [PHONE]!", None, "[CARD]"]


def test_mixing(spark, docs, empty):
    rows = mixing.op8(docs).collect()
    sizes = {}
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(brute.words(r.text))
    want = brute.mix_targets(sizes)
    taken, source = {}, {}
    for r in mixing.mix_sources(docs).collect():
        assert 0 <= r.taken <= 3 * r["size"] and abs(r.target - want[r.source]) < 1e-6
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    again = mixing.op8(docs.repartition(7)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = {}
    for r in mixed.collect():
        words[r.source] = words.get(r.source, 0) + len(brute.words(r.text))
    assert words == {s: n for s, n in taken.items() if s in words}
    assert mixing.op8(empty).count() == 0


def test_heavy_documents_come_first(spark):
    d = spark.range(4000).selectExpr("id doc_id", "if(id % 2 = 0, repeat('usual words here ', 100), repeat('a ', 300)) text", "if(id < 3000, 'c', if(id % 2 = 0, 'a', 'b')) source")
    rows = mixing.mix_sources(d).filter("source = 'c' and part > 0").collect()
    assert sum(r.doc_id % 2 == 0 for r in rows) > 0.53 * len(rows)


def _tokenizer():
    public = pytest.importorskip("public_tokenizers")
    return public.path("word_bpe_49k.json")


@pytest.mark.parametrize("window", [2048, 64, 7])
def test_packing(docs, empty, window):
    from tokenizers import Tokenizer

    path = _tokenizer()
    whole = Tokenizer.from_file(path)
    ids = {(r.doc_id, r.text): [*whole.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    by_id = {k[0]: v for k, v in ids.items()}
    pieces = sorted(packing.pack(docs, path, window, with_ids=True).collect(), key=lambda r: (r.sequence_id, r.offset))
    place = 0
    for p in pieces:
        want = by_id[p.doc_id]
        assert (p.sequence_id, p.offset) == divmod(place, window)
        assert np.frombuffer(p.ids, "<u4").tolist() == want[p.start : p.start + p.length] and p.doc_tokens == len(want)
        assert p.ids_crc32 == zlib.crc32(p.ids) and p.length > 0 and p.offset + p.length <= window
        place += p.length
    assert place == sum(len(by_id[r.doc_id]) for r in docs.collect())
    assert packing.pack(empty, path).count() == 0


def test_special_strings_and_odd_blanks():
    from tokenizers import Tokenizer

    path = _tokenizer()
    whole, fast = Tokenizer.from_file(path), packing.TextTokenizer(path)
    assert fast.by_words
    texts = ["a <|endoftext|> b", " <|startoftext|>x ", "ÉCOLE é é ́x", "a b　c\x1cd\te\r\nf", "it's 'll don't x'", "ΑΣ ΣΑΣ İ ß", "", " ", "\n", "🎈🎈 12345 ^^^^", "de$$$ Élève*** ÿÿ, ÀÖ×÷Øß. A_b __ <|x|> <|endoftext|>. `` ~{} l'été don't. a-b --- ...!? ñÑ|"]
    for remembered in (texts, texts[::-1]):
        ids, n = fast(pa.array(remembered), 1)
        for t, part in zip(remembered, np.split(ids, np.cumsum(n)[:-1]), strict=True):
            assert part.tolist() == [*whole.encode(t, add_special_tokens=False).ids, 1], t


LETTERS = st.sampled_from(list("abKZ éÉßÿ×÷ñ.,!_<|>'\n\t09\u0301\u3000Σİ🎈\x0b")) | st.sampled_from([" the ", "<|endoftext|>", "'s", " \n "])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.none() | st.lists(LETTERS, max_size=30).map("".join), max_size=6))
def test_ids_of_any_text(texts):
    path = _tokenizer()
    if path not in packing._encoders:
        packing._encoders[path] = packing.TextTokenizer(path)
    fast = packing._encoders[path]
    ids, n = fast(pa.array(texts, pa.string()), 1)
    assert len(n) == len(texts)
    for t, part in zip(texts, np.split(ids, np.cumsum(n)[:-1]), strict=True) if texts else ():
        assert part.tolist() == [*fast.inner.encode(t or "", add_special_tokens=False).ids, 1], t


def test_other_tokenizer_files_are_used_whole(docs):
    from tokenizers import Tokenizer

    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    rows = packing.tokenized(docs, path, 7).collect()
    want = sorted([*whole.encode(r.text or "", add_special_tokens=False).ids, 7] for r in docs.collect())
    assert sorted(np.frombuffer(r.ids, "<u4").tolist() for r in rows) == want
