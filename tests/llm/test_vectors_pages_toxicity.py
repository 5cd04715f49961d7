"""Neighbours against brute force, page text against expected text, toxicity on held-out rows."""

from html.parser import HTMLParser

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from marketspark.llm import htmltext, neighbours, toxicity


def brute(ids, x, top=5):
    x = np.asarray(x, float)
    out = {}
    for i in np.flatnonzero(np.asarray(ids) % 50 == 0):
        s = (x @ x[i]) / (np.linalg.norm(x, axis=1) * np.linalg.norm(x[i]))
        order = [j for j in np.lexsort((ids, -s.round(12))) if j != i][:top]
        out[ids[i]] = [ids[j] for j in order]
    return out


@pytest.mark.parametrize("cells,size", [(1024, 256), (3, 60)])
def test_neighbours(spark, cells, size, monkeypatch):
    monkeypatch.setattr(neighbours, "PART", 300)
    monkeypatch.setattr(neighbours, "MOST_CELLS", cells)  # with 3 cells of 500 vectors, each is divided
    monkeypatch.setattr(neighbours, "LIST_SIZE", size)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 8)).astype(np.float32)
    x[200:260] = x[7]  # a common vector: ties go to the smaller id
    bad = [None, [], [0.0] * 8, [1.0, None] + [1.0] * 6, [float("nan")] + [1.0] * 7, [1.0] * 7, [float("inf")] * 8]
    rows = [*((i, v.tolist(), 1, 1) for i, v in enumerate(x)), *((2000 + 50 * i, v, 1, 1) for i, v in enumerate(bad)), (3, x[3].tolist(), 1, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score int").repartition(5)
    got = {}
    for r in neighbours.op5(df).orderBy("query_id", "rank").collect():
        a, b = x[r.query_id].astype(float), x[r.vec_id].astype(float)
        assert abs(r.score - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-14 and r.rank == len(got.setdefault(r.query_id, [])) + 1
        got[r.query_id].append(r.vec_id)
    want = brute(list(range(1500)), x)
    same = {7, *range(200, 260)}  # of equal vectors, those with the smallest ids, in their order
    assert got[200] == [7, 201, 202, 203, 204] and got[250] == [7, 200, 201, 202, 203]
    assert all([j for j in ids if j in same] == sorted(j for j in ids if j in same) for ids in got.values())
    assert set(got) == set(want)
    hits = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    assert neighbours.op5(df.filter("vec_id < 3")).count() == 2
    assert neighbours.op5(df.limit(0)).count() == 0


def test_graph_search_follows_few_centroids():
    rng = np.random.default_rng(9)
    unit = lambda n: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(rng.normal(size=(n, 16)))
    by, x = neighbours.Centroids(unit(3000)), unit(200)
    lists, sim = by.search(x, neighbours.ASK_POOL)
    assert by.expanded < 200 * 2 * neighbours.ASK_POOL
    exact = np.argsort(-x @ by.c.T, axis=1)[:, : neighbours.ASK_POOL]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(lists, exact, strict=True)]) > 0.95 * neighbours.ASK_POOL
    assert (np.diff(sim, axis=1) <= 0).all()
    i, j = by.within(x, 1.1, 3000, 4)  # the pool grows as far as needed
    far = np.sqrt(2 - 2 * x @ by.c.T)
    want = (far <= 1.1 * far.min(1, keepdims=True)).sum()
    assert len(set(zip(i.tolist(), j.tolist(), strict=True))) == len(i) and 0.95 * want <= len(i) <= want


def found(spark, rows):
    got = {}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    for r in neighbours.op5(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    return got


def test_repeated_rows_take_no_ranks(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(100, 8)).astype(np.float32)
    x[51:57] = x[50] + np.float32(0.01) * np.arange(1, 7, dtype=np.float32)[:, None] * rng.normal(size=(6, 8)).astype(np.float32)
    want = brute(list(range(100)), x)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert found(spark, rows + rows[want[50][0] : want[50][0] + 1] * 9 + rows[50:51] * 9) == want
    assert len(set(found(spark, rows + [(want[50][0], (x[50] + np.float32(1e-4) * k).tolist()) for k in range(1, 9)])[50])) == 5


def test_every_query_gets_its_neighbours(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LIST_SIZE", 2)  # many vectors are the only ones of their list
    x = np.random.default_rng(6).normal(size=(600, 16)).astype(np.float32)
    x[51:53] = x[50]
    got, want = found(spark, [(i, v.tolist()) for i, v in enumerate(x)]), brute(list(range(600)), x)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert got[50] == want[50]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Menu {n}</a></li></ul></nav>
<div class="ad">Buy</div><header>Site</header><article><h1>Head {n}</h1><p><b>One &amp; <i>two</i>\n\t three{n}<br>four<p>five&nbsp;six</p><aside>no</aside><form>no</form><div class="comments"><p>no</p></div></article>
<div class="sidebar">no</div><footer>&copy; {n}</footer></body>"""


def test_page_text(spark):
    rows = [(i, "http://h.example/%d" % i, PAGE.format(n=i)) for i in range(6)]
    rows += [(10, None, None), (11, "odd", ""), (12, "http://h.example/z", "<p>no article <div>here"), (13, "http://u.example/", "<body><main>cut &am"), (0, "http://h.example/0", PAGE.format(n=0))]
    df = spark.createDataFrame([(*r, "x", "x") for r in rows], "page_id long, url string, html string, text string, host string")
    out = htmltext.op9(df).collect()
    got = {r.page_id: r.text for r in out}
    assert len(out) == 11 and got[2] == "Head 2 One & two three2 four five six"
    assert (got[10], got[11], got[13]) == ("", "", "cut &am") and got[12] in ("no article here", "here")
    assert all(r.n_chars == len(r.text) for r in out)
    assert htmltext.op9(df.limit(0)).count() == 0


def test_text_without_article_comes_from_the_varying_slot(spark):
    page = "<body><div class='top'>Same words here</div><div class='story'><p>{a}</p><p>{b}</p></div><div class='end'>Same end</div></body>"
    rows = [(i, "http://s.example/%d" % i, page.format(a=f"story {i} " * 5, b=f"more {i}")) for i in range(5)]
    got = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == " ".join(["story 3"] * 5) + " more 3"


def texts_of(spark, pages):
    rows = [(i, f"http://{host}.example/{i}", html) for i, (host, html) in enumerate(pages)]
    got = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    return [got[i] for i in range(len(rows))]


def test_layouts_keep_their_text(spark):
    cases = {
        "<body><div class='content-sidebar-wrap'><main><article><p>Real text {n}.</p></article></main></div></body>": "Real text {n}.",
        "<body><article><p>Start {n}.</p><section id='search-methods'><p>Body one {n}.</p></section></article></body>": "Start {n}. Body one {n}.",
        "<body><article><p>Start {n}, and much more of it.</p><h2 class='related-work'>Related {n}</h2><p class='share-price'>Price {n}</p></article></body>": "Start {n}, and much more of it. Related {n} Price {n}",
        "<body><div class='page sidebar-left'><div role='main'><p>Told {n}</p><div class='share-buttons'>Send {n}</div></div></div><aside><p>Other {n}</p></aside></body>": "Told {n}",
        "<body><article><p>Text {n} of the page</p><div id='comments'><article class='comment'><p>Reader {n} says a lot more than that</p></article></div></article></body>": "Text {n} of the page",
    }
    pages = [(f"l{i}", page.format(n=n)) for i, page in enumerate(cases) for n in range(6)]
    assert texts_of(spark, pages) == [want.format(n=n) for want in cases.values() for n in range(6)]


class Plain(HTMLParser):
    """Blocks of well-formed pages of div, p and article elements."""

    def __init__(self, page):
        super().__init__()
        self.at, self.blocks = [], []
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        self.at.append(tag + "".join(f".{v}" for k, v in attrs if k == "class"))

    def handle_endtag(self, tag):
        self.at.pop()

    def handle_data(self, data):
        self.blocks.append((tuple(self.at), tuple(data.split())))


def plain_texts(pages):
    """A second version from html, for such pages: every token's counts on all contents of its host, side by side."""
    parsed = [(host, html, [b for b in Plain(html).blocks if b[1]]) for host, html in pages]
    free = lambda blocks: [b for b in blocks if not {"div.ad", "div.footer"} & set(b[0]) and (("article" in b[0]) or not any("article" in p for p, _ in blocks))]
    signed = lambda html: xxhash.xxh64_intdigest(html) - (1 << 64) * (xxhash.xxh64_intdigest(html) >> 63)
    out = []
    for host, _, blocks in parsed:
        contents = {}
        for _, html, other in sorted((p for p in parsed if p[0] == host), key=lambda p: -signed(p[1])):
            contents[str([t for _, t in free(other)])] = other
        pages_of = []
        for other in contents.values():
            places, before = [], ()
            for path, words in other:
                fresh = [path[:k] for k in range(1, len(path)) if before[:k] != path[:k]]
                places += [(p, "") for p in fresh] + [(path, "")] + [(path, w) for w in words]
                before = path
            pages_of.append(places)
        tokens = {t for places in pages_of for t in places}
        vector = {t: tuple(places.count(t) for places in pages_of) for t in tokens}
        on = lambda t: sum(n > 0 for n in vector[t])
        valid = {t for t in tokens if on(t) >= max(4, 0.5 * len(pages_of))}
        held = {w for w in valid if w[1] and any(not e[1] and e[0] == w[0][: len(e[0])] and vector[e] == vector[w] for e in valid)}
        fixed = set()
        for w in held:
            same = sorted((v for v in valid if v[1] and vector[v] == vector[w]), key=lambda v: np.mean([p.index(v) for p in pages_of if v in p]))
            k = same.index(w)
            beside = [(same[j], same[j + 1]) for j in (k - 1, k) if 0 <= j < len(same) - 1]
            if all(p.index(a) < p.index(b) for a, b in beside for p in pages_of if a in p):
                fixed.add(w)
        whole = lambda b: all((b[0], w) in fixed for w in b[1])
        path_fixed = lambda path: all(whole(b) for b in blocks if b[0] == path)
        out.append(" ".join(" ".join(b[1]) for b in free(blocks) if not (whole(b) and ("article" not in b[0] or path_fixed(b[0])))))
    return out


def test_texts_match_a_plain_version(spark):
    rng = np.random.default_rng(11)
    pages = []
    for host in range(6):
        story = "article" if host % 2 else "div class='story'"
        for n in range(int(rng.integers(4, 14))):
            blocks = ["<div class='top'>Welcome here</div>", f"<p>news {n} {host}</p>"]
            blocks += [f"<p>more {rng.integers(0, 3)}</p>" for _ in range(rng.integers(0, 3))] + ["<p>See also</p>"] * (host % 3) + ["<div class='x2'>Read our guide</div>"] * (n % 4 > 0)
            blocks[1:] = [f"<{story}>", *blocks[1:], f"</{story.split()[0]}>"]
            blocks += ["<div class='box'>Always the same</div>"] * rng.integers(0, 3) + [f"<div class='note'>note {rng.integers(0, 2)}</div>"]
            blocks += [f"<div class='swap'>{' '.join(rng.permutation(['one', 'two']))}</div>", f"<div class='ad'>buy {n}</div>" if n % 2 else "<div class='footer'>end</div>"]
            pages += [(f"h{host}", "<body>" + "".join(blocks) + "</body>")] * int(1 + (n % 5 == 0))
    got, want = texts_of(spark, pages), plain_texts(pages)
    assert got == want
    assert any("Welcome" not in t for t in want) and any("one two" in t for t in want)


def test_chunks_of_contents_add_up():
    pages = [(mixed, htmltext.parse(f"<body><div class='top'>Same {'top' if n % 3 else 'bar'}</div><p>text {n} of all</p></body>")) for n, mixed in enumerate(range(1000, 1040))]
    total = lambda parts: {t: (n, v) for t, (n, v) in parts.items() if n >= 20}
    whole = total({(path, word): (n, v) for path, word, n, v, _ in htmltext.count_chunk(pages)})
    summed: dict = {}
    for at in range(0, 40, 8):
        for path, word, n, v, _ in htmltext.count_chunk(pages[at : at + 8]):
            old = summed.get((path, word), (0, 0))
            summed[path, word] = old[0] + n, old[1] ^ v
    assert total(summed) == whole and ("/body/div.top", "Same") in whole and whole["/body/div.top", "Same"] == whole["/body/div.top", ""] == whole["/body", ""]


def test_markup_that_keeps_its_text(spark):
    cases = {
        '<body><div style="overflow:hidden">In a div {n}</div></body>': "In a div {n}",
        '<body><p title="hidden gems">Found {n}</p></body>': "Found {n}",
        '<body><div data-hidden="0">Shown {n}</div><p hidden>Never</p><p aria-hidden="true">Not read</p></body>': "Shown {n}",
        "<html><head><title>T</title><body><p>No end of head {n}": "No end of head {n}",
        "<html><head><meta charset=utf-8>Words {n} end the head</html>": "Words {n} end the head",
        '<body><p>Before {n}</p><svg width="1" title="a>b"/><p>Behind {n}</p><svg><text>drawn</text></svg></body>': "Before {n} Behind {n}",
        "<body><ul><li>One {n}<li class=ad>Bought<li>Three {n}</ul><table><tr><td class=ad>No<td>Cell {n}<tr><td>Next {n}</table></body>": "One {n} Three {n} Cell {n} Next {n}",
        "<body><p class=ad>Bought<div>Told {n}</div></body>": "Told {n}",
        "<body><a title='x>y' href=z>Linked {n}</a> <b class='ad' hidden=>too</b></body>": "Linked {n} too",
    }
    pages = [(f"k{i}", page.format(n=n)) for i, page in enumerate(cases) for n in range(5)]
    assert texts_of(spark, pages) == [want.format(n=n) for want in cases.values() for n in range(5)]
    deep = htmltext.parse("<div>" * 3000 + "deep" + "</div>" * 3000)
    assert [b[1] for b in deep] == ["deep"] and len(deep[0][0]) <= 512 and set(htmltext.tokens_of(deep)) >= {(deep[0][0], "deep")}


def test_pages_without_a_host_have_no_template(spark):
    rows = [(i, None if i % 2 else "odd", f"<body><div>Same words</div><p>page {i}</p></body>") for i in range(8)]
    got = htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r.text for r in got) == [f"Same words page {i}" for i in range(8)]


def test_text_keeps_sibling_sections_and_copies(spark):
    page = "<body><div class='top'>Same words here</div><div class='lead'><p>{a}</p></div><div class='body'><p>{b}</p><p>last {b}</p></div><div class='end'>Same end</div><div class='ad'>{c}</div></body>"
    want = [f"lead {i} body {i} of the text last body {i} of the text" for i in range(6)]
    varied = [("v", page.format(a=f"lead {i}", b=f"body {i} of the text", c=i)) for i in range(6)]
    copies = [("v", page.format(a="lead 0", b="body 0 of the text", c=f"other {i}")) for i in range(6)]
    assert texts_of(spark, varied + copies) == want + want[:1] * 6
    plain = "<body><div class='story'><p>copied words</p></div></body>"
    other = "<body><div class='story'><p>other words</p></div></body>"
    assert texts_of(spark, [("w", plain), ("w", plain), ("w", other)]) == ["copied words", "copied words", "other words"]


def test_template_decides_inside_an_article(spark):
    page = "<body><article><h1>Head {n}</h1><p>Words {n}</p><p>Always said</p><div class='x1'>Read our <b>guide</b></div></article></body>"
    assert texts_of(spark, [("a", page.format(n=n)) for n in range(6)]) == [f"Head {n} Words {n} Always said" for n in range(6)]
    named = "<body><nav>Menu</nav><article><h1>Head {n}</h1><div class='search'><p>Body {n} about finding things</p></div><div class='comments'><p>Reader {n} says a lot more than the text itself does</p></div></article></body>"
    assert texts_of(spark, [("b", named.format(n=n)) for n in range(6)]) == [f"Head {n} Body {n} about finding things" for n in range(6)]
    small = "<body><article><p>Long text of page {n} for readers</p><div class='share'>Send {n}</div></article></body>"
    assert texts_of(spark, [("c", small.format(n=n)) for n in range(6)]) == [f"Long text of page {n} for readers" for n in range(6)]
    around = "<body><div class='with-sidebar'><article><p>Page {n}</p></article></div></body>"
    assert texts_of(spark, [("d", around.format(n=n)) for n in range(6)]) == [f"Page {n}" for n in range(6)]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 9))) for _ in range(800)]
    bad = ["scumbagz", "wretchling", "vilefoul"]
    docs, labels = [], []
    for i in range(1500):
        w = list(rng.choice(words, 60))
        toxic = int(i % 5 == 0)
        if toxic:
            for _ in range(4):
                w[rng.integers(0, 60)] = str(rng.choice(bad))
        docs.append((i, " ".join(w), "x"))
        labels.append((i, toxic, 1))
    docs += [(5000, None, "x"), (5001, "", "x"), (5002, " \n", "x"), (None, "a b", "x"), (3, docs[3][1], "x")]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame([*labels, (3, None, 1), (7, 0, 1)], "doc_id long, toxic int, quality int")


def test_toxicity(labelled):
    docs, labels = labelled
    rows = toxicity.op2(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    truth = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    held = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    assert sum(a == b for a, b in held) > 0.95 * len(held) and len(held) > 200
    assert all(r.predicted == 0 for r in rows if r.doc_id in (5000, 5001, 5002))


def test_toxicity_without_labels(labelled):
    docs, labels = labelled
    rows = toxicity.op2(docs.limit(5), labels.limit(0)).collect()
    assert len(rows) == 5 and len({r.score for r in rows}) == 1
    assert toxicity.op2(docs.limit(0), labels.limit(0)).count() == 0
    none = toxicity.op2(docs, labels.withColumn("toxic", F.lit(0))).collect()
    assert all(r.predicted == 0 for r in none)


def test_gains_match_a_plain_version(spark):
    """Windows, gains and the score of a text, a window at a time, with the model's own dictionaries."""
    import math

    import zstandard

    words = [f"w{i}x" for i in range(300)]
    ordinary = " ".join(words).encode()
    bad = b" stupidhead  nastyword  rottenegg "
    model = toxicity.Model(ordinary + b" " + toxicity.TAIL, ordinary + bad + b" " + toxicity.TAIL, [-3.0, 0.5, 0.25, 1.0, -0.1, 0.5], 3)
    texts = ["", "w1x w2x nastyword " + " ".join(words[5:30]), " ".join(words[:40]) + " rottenegg stupidhead"]
    both = model.compressors()
    for text in texts:
        split = text.split()
        plain = []
        for i in range(0, len(split), 8):
            window = (" " + " ".join(split[i : i + 8])).encode() + toxicity.PAD
            plain.append(len(both[0].compress(window)) - len(both[1].compress(window)))
            for c, d in zip(both, (model.ordinary, model.toxic), strict=True):
                back = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
                assert back.decompress(c.compress(window), max_output_size=1000) == window
        assert toxicity.gains(text.encode(), *both).tolist() == plain
    assert toxicity.gains(texts[0].encode(), *both).tolist() == [] and toxicity.gains(texts[1].encode(), *both)[0] >= 3
    z = lambda g: -3.0 + 0.5 * max(g, default=0) + 0.25 * (sorted(g)[-2] if len(g) > 1 else 0) + math.log1p(sum(x >= 3 for x in g)) - 0.1 * math.log1p(len(g)) + 0.5 * sum(x >= 3 for x in g) / math.sqrt(len(g) + 1)
    want = [1 / (1 + math.exp(-z([max(0, x) for x in toxicity.gains(t.encode(), *both).tolist()]))) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.score for r in toxicity.score(df, model, ["doc_id"]).orderBy("doc_id").collect()]
    assert np.allclose(got, want, rtol=1e-12)


def test_the_three_steps_of_a_search(spark, monkeypatch):
    """Lists, then the nearest cells, then all vectors in blocks: no query lacks neighbours, in cells that are divided or not."""
    monkeypatch.setattr(neighbours, "WIDE", 1)
    monkeypatch.setattr(neighbours, "PART", 40)  # 15 blocks
    x = np.random.default_rng(8).normal(size=(600, 16)).astype(np.float32)
    want = brute(list(range(600)), x)
    for most, size in ((1024, 2), (40, 3)):
        monkeypatch.setattr(neighbours, "MOST_CELLS", most)
        monkeypatch.setattr(neighbours, "LIST_SIZE", size)
        got = found(spark, [(i, v.tolist()) for i, v in enumerate(x)])
        assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    plan = neighbours.op5(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"))
    assert "CartesianProduct" not in plan._jdf.queryExecution().toString()


def test_graph_of_few_centroids():
    """The search has one form: with no more centroids than its pool, it finds all of them in order."""
    rng = np.random.default_rng(3)
    for k in (1, 2, 7, 30):
        c, x = neighbours._unit(rng.normal(size=(k, 8))), neighbours._unit(rng.normal(size=(20, 8)))
        lists, sim = neighbours.Centroids(c).search(x, 32)
        np.testing.assert_array_equal(lists, np.argsort(-x @ c.T, axis=1))
        np.testing.assert_allclose(sim, -np.sort(-x @ c.T, axis=1))
