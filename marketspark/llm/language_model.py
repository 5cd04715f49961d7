"""A trigram language model in Elias-Fano tries, trained and queried by shards.

Tokens: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, then one end; two start marks stand before a text and are not counted.
Smoothing: absolute discounting, interpolated from trigrams down to single words and an unknown word:
P3 = a3 + b3 (a2 + b2 P1), with a = (c - D) / c(context), b = D types(context) / c(context) (a = 0, b = 1 if unseen), and
P1 = (max(c - D, 0) + D V / (V + 1)) / N.

Documents are read once into blocks of about ``BLOCK_TOKENS`` tokens. Words first get numbers: a shard counts the words whose 64-bit hash it owns,
in an Elias-Fano sequence of hashes, and gives small numbers to frequent ones. Then a block asks each shard once for every different
trigram it has, with its training counts besides, so counting and asking share one shuffle. Answers go back to the
blocks by another. All carry packed arrays, one entry for a word or trigram and block, so frequent ones don't gather in one
task; the number of shards follows the number of blocks, and a block sends to the shards of its own words only.

A shard's trie has the levels context word > next word, context word > word before, and both > next word, of the contexts that
end in its words. A level is an Elias-Fano sequence of word numbers, growing inside
a context's range and raised by the last value before the range, with a second such sequence of pointers to the ranges, and 8-bit
codes of log probabilities. Levels are mapped from a temporary file while a shard answers (a task's own, deleted with its answer); a lookup takes a
context's range from the pointers and is a successor search inside it.

A context word of over ``HOT`` shards' share of all training tokens is split: its trigrams go to several shards by the word before, and its bigrams, as
records of their own, by the next word. Its count is known from the words, its number of next words is summed from the
shards. At most as many words as shards, and no more than ``MOST_HOT``, are split.

A null text is empty: it has only its end. Without training rows N = V = 0 and every token has probability 1 by convention.
Equal rows get equal results.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, crc_bucket, mix, save

DISCOUNT = 0.75
BLOCK_TOKENS = 1 << 20
#: Blocks to a shard, about: a shard has the different trigrams of so many tokens as fit a task.
BLOCKS_PER_SHARD = 2
LEAST_SHARDS = 16
HOT = 2.0
MOST_HOT = 1 << 16
END = xxhash.xxh64_intdigest(b"\n")
START = xxhash.xxh64_intdigest(b" ")
STEPS = 8.0
CHUNK = 1 << 16


def encode(p: np.ndarray) -> np.ndarray:
    """8-bit codes of probabilities, an eighth of a bit a step; 255 is zero."""
    with np.errstate(divide="ignore"):
        code = np.rint(-np.log2(p) * STEPS)
    return np.where(p > 0, np.clip(code, 0, 254), 255).astype(np.uint8)


DECODE = np.where(np.arange(256) < 255, 2.0 ** (-np.arange(256) / STEPS), 0.0)


class EliasFano:
    """A growing sequence of unsigned numbers: low bytes as they are, high parts in unary, with a directory by chunks."""

    def __init__(self, n: int, low_bytes: int, lows: np.ndarray, highs: np.ndarray, directory: np.ndarray):
        self.n, self.low_bytes, self.lows, self.highs, self.directory = n, low_bytes, lows, highs, directory

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bytes = min(7, -(-max(0, (top // max(n, 1)).bit_length() - 1) // 8))
        lows = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(n, 8)[:, :low_bytes]).ravel()
        at = (values >> np.uint64(8 * low_bytes)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(at[-1]) + 8) // 8 * 8 if n else 8, bool)
        bits[at] = True
        return cls(n, low_bytes, lows, np.packbits(bits), at[::CHUNK].astype("<i8"))

    def chunk(self, k: int) -> np.ndarray:
        """Values k * CHUNK and on, up to the next chunk."""
        lo, hi = k * CHUNK, min(self.n, (k + 1) * CHUNK)
        first = int(self.directory[k])
        stop = int(self.directory[k + 1]) if k + 1 < len(self.directory) else 8 * len(self.highs)
        bits = np.unpackbits(self.highs[first // 8 : -(-stop // 8)])[first % 8 :]
        high = np.flatnonzero(bits)[: hi - lo] + first - np.arange(lo, hi)
        wide = np.zeros((hi - lo, 8), np.uint8)
        wide[:, : self.low_bytes] = self.lows[lo * self.low_bytes : hi * self.low_bytes].reshape(hi - lo, self.low_bytes)
        return wide.view("<u8").ravel() | (high.astype(np.uint64) << np.uint64(8 * self.low_bytes))

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """Values at growing places."""
        out = np.zeros(len(i), np.uint64)
        for k in np.unique(i // CHUNK).tolist():
            a, b = np.searchsorted(i, [k * CHUNK, (k + 1) * CHUNK])
            out[a:b] = self.chunk(k)[i[a:b] - k * CHUNK]
        return out

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For growing x: the place of the first value that is not smaller, and whether it is equal."""
        place, equal = np.full(len(x), self.n), np.zeros(len(x), bool)
        done = 0
        for k in range(len(self.directory)):
            if done == len(x):
                break
            values = self.chunk(k)
            stop = len(x) if k + 1 == len(self.directory) else int(np.searchsorted(x, values[-1], "right"))
            at = np.searchsorted(values, x[done:stop])
            place[done:stop] = at + k * CHUNK
            equal[done:stop] = (at < len(values)) & (values[np.minimum(at, len(values) - 1)] == x[done:stop])
            done = stop
        return place, equal

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bytes], "<i8"), self.directory, self.highs, self.lows]


class Level:
    """Children of numbered contexts: word numbers by context, and pointers to each context's range."""

    def __init__(self, ids: EliasFano, pointers: EliasFano):
        self.ids, self.pointers = ids, pointers

    @staticmethod
    def build(context: np.ndarray, ids: np.ndarray, n_contexts: int) -> list[np.ndarray]:
        """From growing context numbers, and ids that grow inside a context."""
        pointers = np.searchsorted(context, np.arange(n_contexts + 1))
        last = np.zeros(n_contexts, np.int64)
        full = np.flatnonzero(np.diff(pointers))
        last[full] = ids[pointers[full + 1] - 1]
        raised = ids + (np.cumsum(last) - last)[context]
        return [*EliasFano.of(raised.astype(np.uint64)).parts(), *EliasFano.of(pointers.astype(np.uint64)).parts()]

    def find(self, context: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of children, and whether they are there, for growing contexts. Only chunks that hold a range of an asked context are decoded."""
        place, found = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
        if not len(ids) or not self.ids.n:
            return place, found
        first = _group_starts(context)
        size = np.diff([*first, len(context)])
        asked = context[first]
        lo, hi = self.pointers[asked].astype(np.int64), self.pointers[asked + 1].astype(np.int64)
        base = np.where(lo > 0, self.ids[np.maximum(lo - 1, 0)], 0)
        lo, hi, key = np.repeat(lo, size), np.repeat(hi, size), np.repeat(base, size) + ids.astype(np.uint64)
        some = hi > lo
        need = np.zeros(len(self.ids.directory) + 1, np.int64)
        np.add.at(need, lo[some] // CHUNK, 1)
        np.add.at(need, (hi[some] - 1) // CHUNK + 1, -1)
        for k in np.flatnonzero(np.cumsum(need[:-1]) > 0).tolist():
            values = self.ids.chunk(k)
            start = k * CHUNK
            a, b = int(np.searchsorted(hi, start, "right")), int(np.searchsorted(lo, start + len(values), "left"))
            at = np.maximum(np.searchsorted(values, key[a:b]), lo[a:b] - start)
            ok = at < np.minimum(hi[a:b] - start, len(values))
            ok &= values[np.minimum(at, len(values) - 1)] == key[a:b]
            place[a:b][ok] = at[ok] + start
            found[a:b] |= ok
        return place, found


def dump(arrays: list[np.ndarray]) -> bytes:
    """Arrays one behind the other, each at a multiple of 8 bytes, behind a table of their sizes."""
    kinds = {"int64": 0, "uint8": 1}
    head = np.array([len(arrays), *(x for a in arrays for x in (kinds[a.dtype.name], a.nbytes))], "<i8")
    return b"".join([head.tobytes(), *(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays)])


def load(blob: np.ndarray) -> list[np.ndarray]:
    n = int(blob[:8].view("<i8")[0])
    head = blob[8 : 8 + 16 * n].view("<i8").reshape(n, 2)
    out, at = [], 8 + 16 * n
    for kind, size in head.tolist():
        out.append(blob[at : at + size].view(("<i8", np.uint8)[kind]))
        at += -(-size // 8) * 8
    return out


def _group_starts(*keys: np.ndarray) -> np.ndarray:
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


class Words:
    """Words of one shard, over mapped memory: hashes and running sums of their counts."""

    def __init__(self, blob: np.ndarray):
        a = load(blob)
        self.hashes, self.sums = (EliasFano(int(a[i][0]), int(a[i][1]), a[i + 3], a[i + 2], a[i + 1]) for i in (0, 4))

    @staticmethod
    def build(hashes: np.ndarray, counts: np.ndarray) -> bytes:
        return dump([*EliasFano.of(hashes).parts(), *EliasFano.of(np.cumsum(counts).astype(np.uint64)).parts()])

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and counts of growing hashes that are there."""
        place, known = self.hashes.successor(hashes)
        assert known.all()
        before = np.where(place > 0, self.sums[np.maximum(place - 1, 0)], 0)
        return place, (self.sums[place] - before.astype(np.uint64)).astype(np.int64)


class Trie:
    """The trigrams of one shard, over mapped memory. ctx: numbers of context words; code_*: a of an entry or b of a context."""

    def __init__(self, blob: np.ndarray):
        a = load(blob)
        ef = lambda i: EliasFano(int(a[4 * i][0]), int(a[4 * i][1]), a[4 * i + 3], a[4 * i + 2], a[4 * i + 1])
        self.ctx = ef(0)
        self.next2, self.before, self.next3 = (Level(ef(i), ef(i + 1)) for i in (1, 3, 5))
        self.code2, self.back2, self.code3, self.back3 = a[28:32]

    @staticmethod
    def build(v: np.ndarray, w1: np.ndarray, w3: np.ndarray, c: np.ndarray, hot: Hot) -> bytes:
        """From summed records, sorted by v, w1, w3. w1 is a word's number and one more; those of a split word with w1 = 0 are its bigrams."""
        first_v = _group_starts(v)
        ctx = v[first_v]
        number = np.repeat(np.arange(len(ctx)), np.diff([*first_v, len(v)]))
        hot_at, split = hot.find(ctx)
        two = np.flatnonzero(~split[number] | (w1 == 0))  # what the bigrams are summed from
        two = two[np.lexsort((w3[two], number[two]))]
        s2 = _group_starts(number[two], w3[two])
        c2 = np.add.reduceat(c[two], s2) if len(two) else c[:0]
        n2, w2 = number[two][s2], w3[two][s2]
        total = np.bincount(n2, c2, minlength=len(ctx))
        if split.any():
            total[split] = hot.totals[hot_at[split]]
        types2 = np.bincount(n2, minlength=len(ctx))
        three = np.flatnonzero(w1 > 0)
        n3, w1, w3, c = number[three], w1[three], w3[three], c[three]
        s1 = _group_starts(n3, w1)
        n1 = np.repeat(np.arange(len(s1)), np.diff([*s1, len(n3)]))
        c1, types3 = np.bincount(n1, c, minlength=len(s1)), np.bincount(n1, minlength=len(s1))
        levels = [*EliasFano.of(ctx.astype(np.uint64)).parts(), *Level.build(n2, w2, len(ctx)), *Level.build(n3[s1], w1[s1], len(ctx)), *Level.build(n1, w3, len(s1))]
        return dump([*levels, encode((c2 - DISCOUNT) / total[n2]), encode(DISCOUNT * types2 / np.maximum(total, 1)), encode((c - DISCOUNT) / c1[n1]), encode(DISCOUNT * types3 / np.maximum(c1, 1))])

    def ask(self, v: np.ndarray, w1: np.ndarray, w3: np.ndarray, split: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of records sorted by v, w1, w3: codes of a (without the single word's part) and of the single word's factor.

        Of a split word, trigrams give their own part only, and bigrams theirs.
        """
        a, b = np.zeros(len(v)), np.ones(len(v))
        if not len(v) or not self.ctx.n:
            return encode(a), encode(b)
        starts = _group_starts(v)
        number, seen = self.ctx.successor(v[starts].astype(np.uint64))
        size = np.diff([*starts, len(v)])
        number, seen = np.repeat(number, size), np.repeat(seen, size)
        i = np.flatnonzero(seen & ((w1 == 0) | ~split))
        i = i[np.lexsort((w3[i], number[i]))]
        place, found = self.next2.find(number[i], w3[i])
        a[i[found]] = DECODE[self.code2[place[found]]]
        plain = i[~split[i]]
        b[plain] = DECODE[self.back2[number[plain]]]
        i = np.flatnonzero(seen & (w1 > 0))
        ctx3, found = self.before.find(number[i], w1[i])
        i, ctx3 = i[found], ctx3[found]
        place, found = self.next3.find(ctx3, w3[i])
        a3 = np.zeros(len(i))
        a3[found] = DECODE[self.code3[place[found]]]
        b3 = DECODE[self.back3[ctx3]]
        a[i], b[i] = a3 + b3 * a[i], b3 * b[i]
        return encode(a), encode(b)


def mapped(blob: bytes) -> tuple[np.ndarray, str]:
    """A trie's bytes in a mapped temporary file, and the file's name; it is deleted when the shard has answered."""
    fd, path = tempfile.mkstemp(suffix=".trie")
    with os.fdopen(fd, "wb") as f:
        f.write(blob)
    return np.memmap(path, np.uint8, "r"), path


def squeeze(x: np.ndarray) -> bytes:
    """Unsigned numbers in as few bytes as the largest needs, a byte plane after the other, so that planes of zeros cost nothing once compressed."""
    wide = -(-int(x.max()).bit_length() // 8) if len(x) else 0
    return bytes([wide]) + np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].T).tobytes()


def expand(raw: bytes | memoryview, n: int | None = None) -> np.ndarray:
    """What :func:`squeeze` packed; ``n`` numbers, needed where all may be zero."""
    raw = np.frombuffer(raw, np.uint8)
    wide = int(raw[0])
    n = (len(raw) - 1) // wide if n is None else n
    out = np.zeros((n, 8), np.uint8)
    out[:, :wide] = raw[1:].reshape(wide, n).T
    return out.view("<u8").ravel().astype(np.int64)


BLOCK_SCHEMA = "block long, lengths binary, trained binary, tokens binary, words binary"


def blocks(docs: DataFrame, trained: F.Column) -> DataFrame:
    """Documents as blocks of token arrays: ids (doc_id), lengths, trained flags, token numbers and hashes of the block's words."""
    schema = docs.select(F.array("doc_id").alias("ids")).schema.simpleString()[7:-1].replace("ids:", "ids ") + ", " + BLOCK_SCHEMA

    def pack(ids: list, texts: list[list[bytes]], flags: list[bool], number: int) -> pa.RecordBatch:
        code: dict[bytes, int] = {}
        flat: list[int] = []
        for words in texts:
            for w in words:
                flat.append(code.setdefault(w, len(code)))
            flat.append(-1)
        t = np.array(flat, np.int64)
        end = len(code)
        t[t < 0] = end
        hashes = np.array([*(xxhash.xxh64_intdigest(w) for w in code), END], "<u8")
        rank = np.argsort(-np.bincount(t, minlength=end + 1), kind="stable")  # frequent words get small numbers
        back = np.empty_like(rank)
        back[rank] = np.arange(len(rank))
        lengths = np.array([len(w) + 1 for w in texts], "<i4")
        return pa.RecordBatch.from_arrays([pa.array([ids]), pa.array([number]), *(pa.array([x.tobytes()], pa.binary()) for x in (lengths, np.array(flags, np.uint8))), pa.array([squeeze(back[t])], pa.binary()), pa.array([hashes[rank].tobytes()], pa.binary())], names=["ids", "block", "lengths", "trained", "tokens", "words"])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, texts, flags, size = [], [], [], 0
        for batch in batches:
            for i, t, f in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), batch.column("_trained").to_pylist(), strict=True):
                words = t.as_py().lower().split()
                ids.append(i)
                texts.append(words)
                flags.append(f)
                size += len(words) + 1
                if size >= BLOCK_TOKENS:
                    yield pack(ids, texts, flags, number)
                    ids, texts, flags, size, number = [], [], [], 0, number + 1
        if ids:
            yield pack(ids, texts, flags, number)

    return docs.select("doc_id", "text", trained.alias("_trained")).mapInArrow(go, schema)


class Hot:
    """Split context words: their numbers, growing, and for each the number of its shards and its training count."""

    def __init__(self, rows: list[tuple[int, int, int]]):
        rows = sorted(rows)
        self.words, self.parts, self.totals = (np.array([r[k] for r in rows], np.int64) for k in range(3))

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each word among them, and whether it is one."""
        if not len(self.words):
            return np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return at, self.words[at] == words


def columns_of(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's lengths, trained flags and token numbers."""
    lengths = np.frombuffer(row["lengths"], "<i4").astype(np.int64)
    return lengths, np.frombuffer(row["trained"], np.uint8) > 0, expand(row["tokens"], int(lengths.sum()))


WORD_MESSAGE = "block long, shard int, place binary, words binary, counts binary"
WORD_ANSWER = "block long, place binary, numbers binary, counts binary, types long, frequent array<struct<number: bigint, n: bigint, start: boolean>>"


def word_questions(rows: DataFrame, n_shards: int) -> DataFrame:
    """The words of blocks by shard: places in the block, hashes and training counts. The start mark is the last word, with count 0."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths, flags, t = columns_of(row)
                words = np.append(np.frombuffer(row["words"], "<u8"), np.uint64(START))
                count = np.bincount(t[np.repeat(flags, lengths)], minlength=len(words))
                shard = (words % np.uint64(n_shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                first = _group_starts(shard[order])
                parts = np.split(order, first[1:])
                cols = [[row["block"]] * len(parts), shard[order[first]].tolist(), *([f(p) for p in parts] for f in (squeeze, lambda p: words[p].tobytes(), lambda p: squeeze(count[p])))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64(), pa.int32(), *[pa.binary()] * 3], strict=True)], names=[x.split()[0] for x in WORD_MESSAGE.split(", ")])

    return rows.select("block", "lengths", "trained", "tokens", "words").mapInArrow(go, WORD_MESSAGE)


def number_words(table: pa.Table, n_shards: int, least: float) -> pa.Table:
    """One shard: count its words in all blocks, number them by frequency, and answer each block. ``least``: the count of a frequent word."""
    words = [np.frombuffer(x.as_buffer(), "<u8") for x in table.column("words")]
    sizes = [len(x) for x in words]
    every = np.concatenate(words)
    counts = np.concatenate([expand(x.as_buffer(), n) for x, n in zip(table.column("counts"), sizes, strict=True)])
    hashes, at = np.unique(every, return_inverse=True)
    total = np.bincount(at, counts, minlength=len(hashes)).astype(np.int64)
    blob, path = mapped(Words.build(hashes, total))
    try:
        place, found = Words(blob).find(hashes)
    finally:
        os.unlink(path)
    number = np.empty(len(hashes), np.int64)
    number[np.argsort(-found, kind="stable")] = np.arange(len(hashes))
    number = number[place] * n_shards + table.column("shard")[0].as_py()
    frequent = [{"number": int(number[i]), "n": int(total[i]), "start": bool(hashes[i] == START)} for i in np.flatnonzero((total >= least) | (hashes == START))]
    types = np.zeros(len(table), np.int64)
    types[0] = (total > 0).sum()
    cut = np.cumsum(sizes)[:-1]
    kind = pa.list_(pa.struct([("number", pa.int64()), ("n", pa.int64()), ("start", pa.bool_())]))
    packed = [pa.array([squeeze(p) for p in np.split(x[at], cut)], pa.binary()) for x in (number, found)]
    return pa.table([table.column("block"), table.column("place"), *packed, pa.array(types), pa.array([frequent if i == 0 else [] for i in range(len(table))], kind)], names=["block", "place", "numbers", "counts", "types", "frequent"])


def numbers_of(replies: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Number and training count of every word of a block."""
    places = [expand(r["place"]) if len(r["place"]) > 1 else np.zeros(1, np.int64) for r in replies]
    out = np.zeros((2, sum(map(len, places))), np.int64)
    for r, at in zip(replies, places, strict=True):
        out[0, at], out[1, at] = expand(r["numbers"], len(at)), expand(r["counts"], len(at))
    return out[0], out[1]


class Block:
    """One block's tokens, and its records: different trigrams in order of (last context word, word before, word), and bigrams of split words.

    words: the numbers of its words, that of the start mark last.
    """

    def __init__(self, row: dict, words: np.ndarray, hot: Hot):
        self.lengths, self.flags, self.t = columns_of(row)
        self.words, n = words, len(words)
        self.first = first = np.cumsum(self.lengths) - self.lengths
        p1 = np.concatenate([[n - 1], self.t[:-1]])
        p1[first] = n - 1
        p2 = np.concatenate([[n - 1], p1[:-1]])
        p2[first] = n - 1
        pairs, pair = np.unique(p1 * n + p2, return_inverse=True)
        tri, self.inverse = np.unique(pair * n + self.t, return_inverse=True)
        pair = tri // n
        v, w1, w3 = pairs[pair] // n, pairs[pair] % n, tri % n
        self.hot_at, self.hot = hot.find(words)
        self.split = np.flatnonzero(self.hot[v])
        two, self.two = np.unique(v[self.split] * n + w3[self.split], return_inverse=True)
        self.n_tri = len(tri)
        self.v, self.w1, self.w3 = (np.concatenate(x) for x in ((v, two // n), (w1, np.full(len(two), n)), (w3, two % n)))
        self.parts = np.where(self.hot, hot.parts[self.hot_at], 1) if len(hot.parts) else np.ones(n, np.int64)

    def counts(self) -> np.ndarray:
        """Training counts of records."""
        tri = np.bincount(self.inverse[np.repeat(self.flags, self.lengths)], minlength=self.n_tri)
        two = np.bincount(self.two, tri[self.split], minlength=len(self.v) - self.n_tri).astype(np.int64)
        return np.concatenate([tri, two])

    def shards(self, n: int) -> np.ndarray:
        """Shard of each record."""
        other = np.where(self.w1 < len(self.words), self.w1, self.w3)
        return (self.words[self.v] + (mix(self.words.astype(np.uint64))[other] % self.parts[self.v].astype(np.uint64)).astype(np.int64)) % n


MESSAGE = "block long, shard int, v binary, v_n binary, w1 binary, w3 binary, c binary"
ANSWER = "block long, shard int, split array<long>, a binary, b binary"


def questions(rows: DataFrame, words: DataFrame, n_shards: int, hot: Hot) -> DataFrame:
    """What blocks ask of shards, with their training counts: numbers of context words v, v_n records for each, and w1 (one more; 0 for a bigram), w3 and c of these."""

    def go(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            b = Block(row, numbers_of(right.to_pylist())[0], hot)
            count, shard = b.counts(), b.shards(n_shards)
            order = np.argsort(shard, kind="stable")
            first = _group_starts(shard[order])
            before = np.append(b.words + 1, 0)
            for j in np.split(order, first[1:]):
                starts = _group_starts(b.v[j])
                out.append((row["block"], int(shard[j[0]]), squeeze(b.words[b.v[j][starts]]), squeeze(np.diff([*starts, len(j)])), squeeze(before[b.w1[j]]), squeeze(b.words[b.w3[j]]), squeeze(count[j])))
        cols = list(zip(*out, strict=True)) if out else [[]] * 7
        return pa.table([pa.array(c, k) for c, k in zip(cols, [pa.int64(), pa.int32(), *[pa.binary()] * 5], strict=True)], names=[x.split()[0] for x in MESSAGE.split(", ")])

    return rows.select("block", "lengths", "trained", "tokens").groupBy("block").cogroup(words.groupBy("block")).applyInArrow(go, MESSAGE)


def in_order(v: np.ndarray, w1: np.ndarray, w3: np.ndarray) -> np.ndarray:
    """The order by v, w1, w3."""
    n1, n3 = (int(x.max()) + 1 if len(x) else 1 for x in (w1, w3))
    if (int(v.max()) + 1 if len(v) else 1) * n1 * n3 < 1 << 63:
        return np.argsort((v * n1 + w1) * n3 + w3, kind="stable")
    return np.lexsort((w3, w1, v))


def answer(table: pa.Table, hot: Hot) -> pa.Table:
    """One shard: sum the counts of all blocks, build the trie, and answer each block in its own order."""
    packed = lambda c, n: [expand(x.as_buffer(), k) for x, k in zip(table.column(c), n, strict=True)]
    sizes = [expand(x.as_buffer()) for x in table.column("v_n")]  # no size is zero
    n_rec = [int(x.sum()) for x in sizes]
    v = np.concatenate([np.repeat(x, k) for x, k in zip(packed("v", [len(x) for x in sizes]), sizes, strict=True)])
    w1, w3, c = (np.concatenate(packed(x, n_rec)) for x in ("w1", "w3", "c"))
    order = in_order(v, w1, w3)
    v, w1, w3, c = v[order], w1[order], w3[order], c[order]
    first = _group_starts(v, w1, w3)
    of_rec = np.empty(len(order), np.int64)
    of_rec[order] = np.repeat(np.arange(len(first)), np.diff([*first, len(order)]))
    v, w1, w3, c = v[first], w1[first], w3[first], np.add.reduceat(c, first)
    seen = c > 0
    hot_at, split = hot.find(v)
    blob, path = mapped(Trie.build(v[seen], w1[seen], w3[seen], c[seen], hot))
    try:
        codes = Trie(blob).ask(v, w1, w3, split)
    finally:
        os.unlink(path)
    cut = np.cumsum(n_rec)[:-1]
    types = np.bincount(hot_at[seen & split & (w1 == 0)], minlength=len(hot.words)) if len(hot.words) else np.zeros(0, np.int64)
    a, b = (pa.array([p.tobytes() for p in np.split(x[of_rec], cut)], pa.binary()) for x in codes)
    return pa.table([table.column("block"), table.column("shard"), pa.array([types if i == 0 else [] for i in range(len(table))], pa.list_(pa.int64())), a, b], names=["block", "shard", "split", "a", "b"])


def training_size(rows: DataFrame) -> tuple[int, int]:
    """Numbers of training tokens and of training documents."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [np.frombuffer(a, "<i4").astype(np.int64)[np.frombuffer(f, np.uint8) > 0] for a, f in zip(batch.column("lengths").to_pylist(), batch.column("trained").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([int(x.sum()) for x in n], pa.int64()), pa.array([len(x) for x in n], pa.int64())], names=["tokens", "docs"])

    r = rows.select("lengths", "trained").mapInArrow(go, "tokens long, docs long").agg(F.sum("tokens"), F.sum("docs")).first()
    return r[0] or 0, r[1] or 0


def score(docs: DataFrame, trained: F.Column) -> DataFrame:
    """Train on the rows that ``trained`` marks and score all: doc_id, trained, n_tokens, n_known, train_tokens, base_score, score."""
    rows = save(blocks(docs, trained), "lm-blocks")
    n_shards = max(LEAST_SHARDS, -(-rows.count() // BLOCKS_PER_SHARD))
    n_train, n_docs = training_size(rows)
    least = max(1.0, n_train * HOT / min(n_shards, MOST_HOT))
    words = save(word_questions(rows, n_shards).groupBy("shard").applyInArrow(lambda table: number_words(table, n_shards, least), WORD_ANSWER), "lm-words")
    n_types = words.agg(F.sum("types")).first()[0] or 0
    frequent = [(r.number, n_docs if r.start else r.n) for r in words.select(F.explode("frequent").alias("f")).select("f.*").distinct().collect()]  # at most min(n_shards, MOST_HOT) / HOT + 1 words
    words = words.select("block", "place", "numbers", "counts")
    hot = Hot([(w, -(-n * n_shards // n_train), n) for w, n in frequent if n >= least])
    answers = save(questions(rows, words, n_shards, hot).groupBy("shard").applyInArrow(lambda table: answer(table, hot), ANSWER), "lm-answers")
    next_types = np.zeros(len(hot.words))
    for r in answers.select(F.posexplode("split").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect():  # a row for each split word
        next_types[r.i] = r.n
    back2 = DISCOUNT * next_types / np.maximum(hot.totals, 1)
    ids = rows.schema["ids"].dataType.elementType

    def finish(row: dict, replies: list[dict]) -> pa.RecordBatch:
        numbers, count = numbers_of([r for r in replies if r["place"] is not None])
        b = Block(row, numbers, hot)
        shard = b.shards(n_shards)
        a, back = np.zeros(len(b.v)), np.ones(len(b.v))
        order = np.argsort(shard, kind="stable")
        for r in replies:
            if r["place"] is None:
                i = order[slice(*np.searchsorted(shard, [r["shard"], r["shard"] + 1], sorter=order))]
                a[i], back[i] = DECODE[np.frombuffer(r["a"], np.uint8)], DECODE[np.frombuffer(r["b"], np.uint8)]
        i = b.split
        if len(i):
            a[i] += back[i] * a[b.n_tri :][b.two]
            back[i] *= back2[b.hot_at[b.v[i]]]
        if n_train:
            p1 = (np.maximum(count - DISCOUNT, 0) + DISCOUNT * n_types / (n_types + 1)) / n_train
            p = np.minimum(a[b.inverse] + back[b.inverse] * p1[b.t], 1.0)
        else:
            p = np.ones(len(b.t))
        base = np.log10((count + 1) / (n_train + n_types + 1))
        add = lambda x: np.add.reduceat(x, b.first)
        cols = [pa.array(~b.flags), pa.array(b.lengths), pa.array(add((count > 0)[b.t].astype(np.int64))), pa.array(np.full(len(b.first), n_train)), pa.array(add(base[b.t])), pa.array(add(np.log10(p)))]
        return pa.RecordBatch.from_arrays([row["ids"].values if isinstance(row["ids"], pa.ListScalar) else pa.array(row["ids"]), *cols], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [finish(r, right.to_pylist()) for r in left.to_pylist()]
        return pa.Table.from_batches([pa.RecordBatch.from_arrays([b.column(0).cast(pa_id), *b.columns[1:]], names=b.schema.names) for b in out], schema=None) if out else empty

    from pyspark.sql.pandas.types import to_arrow_type

    pa_id = to_arrow_type(ids)
    empty = pa.table([pa.array([], t) for t in (pa_id, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    schema = f"doc_id {ids.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    both = words.unionByName(answers.drop("split"), allowMissingColumns=True)
    return rows.drop("words").groupBy("block").cogroup(both.groupBy("block")).applyInArrow(join, schema)


def op3(docs: DataFrame) -> DataFrame:
    return score(docs.select("doc_id", "text"), crc_bucket(F.col("doc_id"), 7) != 2)
