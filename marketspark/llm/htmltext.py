"""Main text of web pages by template deduction from equivalence classes.

A page is a sequence of tokens: elements by their path, and words with the path of their element. A token's occurrence vector says how often it is on
each of a host's different contents; pages with the same body text are one content, so copies never become template. Tokens with the same vector are a
class. A class is valid on at least ``SUPPORT`` of the contents (``LEAST`` at least) and if it holds an element; its words must lie in such an element and stand
in the same order on all contents. Paths tell tokens apart, so valid classes nest as their elements do; together they are the host's template.
Text between its tokens are slots. A block all of whose words are template is fixed, outside an article by itself, inside one with all blocks of its
path; other blocks are slots, whole. A page gives the text of its slots, in page order.

Elements and class names are hints for choosing among slots: with an article or main element, its slots only; never those of menus, headers,
footers, sidebars, adverts, forms, scripts, styles and reader comments. A class name counts if all its parts are such words or words of layout: share-box
does, share-price does not. Weak ones (search, share, promo and the like) leave a slot out unless such slots hold most of the text; the others, unless an
article would be empty without them. A main element is never inside one.

A page is parsed once; its blocks are kept in a table for both steps. Contents are ranged by (host, hash), so a large host is spread over tasks, and
counted in chunks of ``CHUNK`` contents at most; a token on under an eighth of a chunk, or on one content of a chunk of more than three, is not counted there, since
template text is on half of all. Vectors are known by the exclusive or of 64-bit hashes of (content, count). A task holds one batch of pages or the tokens of one chunk.
A very long page is parsed as any other, and is a row of its own.

Null or empty html gives empty text. Markup is read as browsers do where that matters: end tags of head, paragraphs, items and cells are optional, attributes are read one after another; an
end tag closes the nearest open element of its name, others are ignored. Pages whose url is null or odd have no host, so no template. Equal rows get equal results. Of other
columns none is read, whatever its name.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _ODD, mix, salted, save

SUPPORT = 0.5
#: Least number of different contents that template text is on.
LEAST = 4
#: Characters of all hosts' templates, at most, that are sent to every task; more are joined by host, large hosts salted.
SENT = 32 << 20
#: Contents counted at once.
CHUNK = 512

_REST = r"(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+"
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(?:svg|math)\b{_REST}(?<=/)>|<(script|style|noscript|template|textarea|svg|math|iframe|select)\b{_REST}>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({_REST})(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S | re.I)
#: One attribute: its name, and its value if it has one.
ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
#: Elements that end an open paragraph; what an element of a name ends, and where the search for it ends.
_BLOCK = "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul"
_ENDS = {n: ({"p"}, {"button", "table", "td", "th", "caption", "object"}) for n in _BLOCK.split()}
_ENDS |= {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"})}
_ENDS |= {n: ({"td", "th"}, {"tr", "table"}) for n in ("td", "th")} | {"tr": ({"tr"}, {"table"})} | {n: ({"thead", "tbody", "tfoot"}, {"table"}) for n in ("thead", "tbody", "tfoot")}
#: Elements of a head; any other ends it.
_IN_HEAD = frozenset("title meta link base basefont".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold article text, and words in class, id or role that say so.
OUTSIDE = frozenset("nav aside form footer button head title menu dialog object".split())
CHROME = re.compile(r"ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|disqus|footer|masthead|menu|nav|navbar|navigation|newsletter|notices?|popup|promo\w*|related|replies|reply|respond|search|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widgets?")
#: Those of the words that may well name the text itself.
WEAK = re.compile(r"banner|notices?|popup|promo\w*|search|share|sharing|social|widgets?")
HEADER = frozenset(["header", "site-header", "page-header"])
#: Words of layout that may stand beside them in a class name.
LAYOUT = frozenset("site page main top bottom left right box bar block list lists item items link links btn button buttons form wrap wrapper container section area panel slot unit post posts articles stories content inner outer header body text primary secondary global media tools icons icon consent policy modal overlay signup thread count row col column group module region zone placeholder label title heading".split())
PARTS = re.compile(r"[\s_-]+")
SPACE = re.compile(r"\s+")
#: How surely a block is outside the text: no sign, a weak class word, another class word, its element.
FREE, HINTED, NAMED, SURE = range(4)


def named(words: str) -> int:
    """How surely class, id and role words put an element outside the text: FREE, HINTED or NAMED."""
    most = FREE
    for word in words.lower().split():
        parts = [p for p in PARTS.split(word) if p and not p.isdigit()]
        hits = [p for p in parts if CHROME.fullmatch(p)]
        if hits and all(p in LAYOUT for p in parts if p not in hits):
            most = max(most, HINTED if all(WEAK.fullmatch(p) for p in hits) else NAMED)
    return most


def attributes(text: str) -> dict[str, str]:
    """Names, in lower case, and values of a tag's attributes; of a repeated one the first."""
    out: dict[str, str] = {}
    for name, value in ATTR.findall(text):
        out.setdefault(name.lower(), value.strip("\"'"))
    return out


def parse(page: str) -> list[tuple[str, str, bool, int]]:
    """Text blocks in page order as (path, text, inside an article, how surely outside the text). Paths of over 512 characters are hashed."""
    blocks: list[tuple[str, str, bool, int]] = []
    stack: list[tuple[str, str, bool, int]] = []  # name, path, article, chrome
    parts: list[str] = []
    now = ("", "", False, FREE)

    def flush() -> None:
        text = SPACE.sub(" ", entities.unescape("".join(parts))).strip()
        parts.clear()
        if text:
            blocks.append((now[1], text, now[2], now[3]))

    opened: dict[str, int] = {}

    def end(closed: set[str], until: set[str]) -> None:
        nonlocal now
        if not any(opened.get(n) for n in closed):
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in closed:
                for gone in stack[i:]:
                    opened[gone[0]] -= 1
                del stack[i:]
                now = stack[-1] if stack else ("", "", False, FREE)
                break
            if stack[i][0] in until:
                break

    def say(text: str) -> None:
        if now[0] == "head" and text.strip():
            end({"head"}, set())
        parts.append(text)

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if name in INLINE:
            continue
        flush()
        if m[2]:
            end({name}, set())
            continue
        if name not in _IN_HEAD:
            end({"head"}, {"body"})
        if name in _ENDS:
            end(*_ENDS[name])
        attrs = attributes(m[4]) if m[4] else {}
        words = " ".join(attrs[k] for k in ("class", "id", "role") if k in attrs)
        article = now[2] or name in ("article", "main") or attrs.get("role") == "main"
        if name in OUTSIDE or "hidden" in attrs or attrs.get("aria-hidden") == "true" or (not article and name == "header"):
            chrome = SURE
        elif not words or name in ("article", "main", "body", "html"):
            chrome = FREE
        else:
            chrome = named(words)
            if not article and not HEADER.isdisjoint(words.lower().split()):
                chrome = NAMED
        if now[3] == SURE or not (name == "main" or attrs.get("role") == "main"):
            chrome = max(chrome, now[3])
        path = f"{now[1]}/{name}" + (f".{attrs['class']}" if attrs.get("class") else "")
        if len(path) > 512:
            path = "~" + xxhash.xxh64_hexdigest(path)
        if name not in VOID:
            stack.append((name, path, article, chrome))
            opened[name] = opened.get(name, 0) + 1
            now = stack[-1]
    if at < len(page):
        say(page[at:])
    flush()
    return blocks


def host_of(url: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit("")), F.lit(""))


Block = tuple[str, str, bool, int]


def tokens_of(blocks: list[Block], words_of: dict[str, set[str]] | None = None) -> dict[tuple[str, str], tuple[int, int]]:
    """Count and first place of each token (path, word) of a page; an element is its path with an empty word, once for each of its own blocks, or each run of blocks inside it. With ``words_of``, of each path these words only."""
    found: dict[tuple[str, str], tuple[int, int]] = {}
    place, last = 0, None

    def see(token: tuple[str, str]) -> None:
        nonlocal place
        n, first = found.get(token, (0, place))
        found[token] = n + 1, first
        place += 1

    for path, text, _, _ in blocks:
        parts = path.split("/")
        before = last.split("/") if last is not None else []
        same = 0
        while same < min(len(parts) - 1, len(before)) and parts[same] == before[same]:
            same += 1
        for k in range(max(same, 1), len(parts) - 1):
            see(("/".join(parts[: k + 1]), ""))
        if path:
            see((path, ""))
        last = path
        words = text.split(" ")
        few = words_of.get(path) if words_of is not None else None
        start = place
        for k, word in enumerate(words):
            if words_of is None or few and word in few:
                place = start + k
                see((path, word))
        place = start + len(words)
    return found


PARSED = [("host", "string"), ("content", "bigint"), ("own", "bigint"), ("packed", "binary")]


def packer() -> zstandard.ZstdCompressor:
    """Packs the blocks of a page, which are stored and sent so. Levels above 13 save 1 % of it at most, and the highest takes over twice the time of parsing."""
    return zstandard.ZstdCompressor(level=13)


def blocks_of(pages: DataFrame) -> DataFrame:
    """page_id, url and what :data:`PARSED` lists: content (a hash of the body text), own (of the page), and the page's blocks, packed, so that little is stored and sent."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    schema = T.StructType([*pages.select("page_id", "url").schema.fields, *(T.StructField(n, T._parse_datatype_string(t)) for n, t in PARSED)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = packer()
        for batch in batches:
            cols: list[list] = [[], [], []]
            for page in batch.column("html").to_pylist():
                blocks = parse(page or "")
                inside = any(article for _, _, article, chrome in blocks if chrome < SURE)
                body = "\n".join(text for _, text, article, chrome in blocks if article >= inside and chrome == FREE)
                row = signed(xxhash.xxh64_intdigest(body)), signed(xxhash.xxh64_intdigest(page or "")), pack.compress(json.dumps(list(zip(*blocks, strict=True)), ensure_ascii=False, separators=(",", ":")).encode())
                for c, x in zip(cols, row, strict=True):
                    c.append(x)
            kinds = [pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), batch.column("host"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[f.name for f in schema])

    return pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).mapInArrow(run, schema)


def _blocks(packed: bytes) -> list[Block]:
    return list(zip(*json.loads(zstandard.decompress(packed)), strict=True))


def _first_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows without those whose content a task has seen with a lower or the same ``own``; the lowest of all is never left out."""
    lowest: dict[tuple[str, int], int] = {}
    for batch in batches:
        keep = []
        for k, (host, content, own) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("host", "content", "own")), strict=True)):
            if own < lowest.get((host, content), 1 << 63):
                lowest[host, content] = own
                keep.append(k)
        yield batch.take(pa.array(keep, pa.int64()))


def count_chunk(pages: list[tuple[int, list[Block]]]) -> Iterator[tuple[str, str, int, int, bool]]:
    """Tokens of some contents of a host: path, word, contents, vector, and whether it keeps its order among the words of its vector."""
    on: dict[str, Counter[str]] = {}  # of each path its words, by contents
    for _, blocks in pages:
        own: dict[str, set[str]] = {}
        for path, text, _, _ in blocks:
            own.setdefault(path, set()).update(text.split(" "))
        for path, words in own.items():
            on.setdefault(path, Counter()).update(words)
    least = 1 if len(pages) <= 3 else max(2, len(pages) / 8)
    often = {path: {word for word, n in words.items() if n >= least} for path, words in on.items()}
    seen: dict[tuple[str, str], list[tuple[int, int, int]]] = {}
    for k, (_, blocks) in enumerate(pages):
        for token, (n, first) in tokens_of(blocks, often).items():
            seen.setdefault(token, []).append((k, n, first))
    classes: dict[int, list[tuple[tuple[str, str], np.ndarray]]] = {}
    of = np.array([content for content, _ in pages], np.int64).view(np.uint64)
    for token, rows in seen.items():
        if len(rows) >= least:
            at = np.array(rows, np.int64)
            vector = int(np.bitwise_xor.reduce(mix(of[at[:, 0]] + mix(at[:, 1].astype(np.uint64) * _ODD))).view(np.int64))
            classes.setdefault(vector, []).append((token, at[:, 2]))
    for vector, members in classes.items():
        words = sorted((m for m in members if m[0][1]), key=lambda m: (m[1].mean(), m[0]))
        places = np.array([m[1] for m in words])
        turned = (np.diff(places, axis=0) < 0).any(1) if len(words) > 1 else np.zeros(0, bool)
        bad = np.zeros(len(words) + 1, bool)
        bad[1:-1] = turned
        odd = {words[k][0] for k in range(len(words)) if bad[k] or bad[k + 1]}
        for token, first in members:
            yield *token, len(first), vector, token not in odd


COUNTED = "host string, path string, word string, n long, vector long, ordered boolean"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token counts of each chunk of contents of sorted rows, and the number of its contents as a token without path."""
    names = ["host", "path", "word", "n", "vector", "ordered"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]

    def out(host: str, chunk: list[tuple[int, list[Block]]]) -> pa.RecordBatch:
        rows = [(host, "", "", len(chunk), 0, True), *((host, *r) for r in count_chunk(chunk))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    host, chunk = "", []
    for batch in batches:
        for row in batch.to_pylist():
            if chunk and (row["host"] != host or len(chunk) == CHUNK and row["content"] != chunk[-1][0]):
                yield out(host, chunk)
                chunk = []
            host = row["host"]
            if not chunk or chunk[-1][0] != row["content"]:
                chunk.append((row["content"], _blocks(row["packed"])))
    if chunk:
        yield out(host, chunk)


def templates(parsed: DataFrame) -> DataFrame:
    """Valid classes of each host: host, ``of`` (its contents), n (those with the class), vector, elements (paths) and words (path, word).

    parsed: as of :func:`blocks_of`. A class has at most (tokens on a page) / ``SUPPORT`` tokens, and so have all of a host.
    """
    rows = parsed.filter("host <> ''").select("host", "content", "own", "packed")
    ranged = rows.mapInArrow(_first_seen, rows.schema).repartitionByRange("host", "content").sortWithinPartitions("host", "content", "own")
    counted = ranged.mapInArrow(_count, COUNTED)
    tokens = counted.groupBy("host", "path", "word").agg(F.sum("n").alias("n"), F.bit_xor("vector").alias("vector"), F.min("ordered").alias("ordered"))
    sizes = F.max(F.when((F.col("path") == "") & (F.col("word") == ""), F.col("n"))).over(Window.partitionBy("host"))
    often = tokens.filter(F.col("n") >= LEAST).withColumn("of", sizes).filter((F.col("path") != "") & (F.col("n") >= SUPPORT * F.col("of")))
    word = F.struct("path", "word")
    classes = often.groupBy("host", "of", "n", "vector").agg(F.array_sort(F.collect_list(F.when(F.col("word") == "", F.col("path")))).alias("elements"), F.array_sort(F.collect_list(F.when((F.col("word") != "") & F.col("ordered"), word))).alias("words"))
    inside = lambda w: F.exists("elements", lambda e: F.concat(w["path"], F.lit("/")).startswith(F.concat(e, F.lit("/"))))
    return classes.filter(F.size("elements") > 0).withColumn("words", F.filter("words", inside))


def fixed_words(classes: DataFrame) -> DataFrame:
    """For each host with a template: the array ``template`` of its words with their paths."""
    every = F.flatten(F.collect_list("words"))
    return classes.groupBy("host").agg(F.transform(every, lambda w: F.concat(w["path"], F.lit(" "), w["word"])).alias("template"))


def main_text(blocks: list[Block], template: frozenset[str]) -> str:
    """The text of a page's blocks that a host's template leaves open."""
    blocks = [b for b in blocks if b[3] < SURE]
    inside = any(article for _, _, article, _ in blocks)
    alone = [all(f"{path} {word}" in template for word in text.split(" ")) for path, text, _, _ in blocks]
    open_ = {b[0] for b, fixed in zip(blocks, alone, strict=True) if not fixed}
    slots = []
    for (path, text, article, chrome), fixed in zip(blocks, alone, strict=True):
        if article >= inside and not (fixed and (not article or path not in open_)):
            slots.append((text, chrome))
    mass = [sum(len(text) for text, chrome in slots if chrome == level) for level in (FREE, HINTED, NAMED)]
    most = HINTED if mass[HINTED] > mass[FREE] else FREE
    if inside and not mass[FREE] + mass[HINTED]:
        most = NAMED
    return " ".join(text for text, chrome in slots if chrome <= most)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of pages (page_id, url, html)."""
    parsed = save(blocks_of(pages), "page-blocks")
    found = save(fixed_words(templates(parsed)), "page-templates")
    size = found.agg(F.sum(F.length("host") + F.length(F.array_join("template", " ")) + 16 * F.size("template"))).first()[0] or 0
    if size <= SENT:
        joined = parsed.join(F.broadcast(found), "host", "left")
    else:
        sizes = parsed.groupBy("host").agg(F.count("*").alias("n"))
        joined = salted(parsed, sizes.join(found, "host"), ["host"], parsed.count(), ["own", "page_id"], "left")
    schema = T.StructType([*pages.select("page_id", "url").schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(_blocks(r["packed"]), frozenset(r["template"] or ())) for r in batch.select(["packed", "template"]).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "packed", "template").mapInArrow(run, schema)


def op9(pages: DataFrame) -> DataFrame:
    return extract(pages.select("page_id", "url", "html"))
