"""Exact repeated substrings of at least ``LENGTH`` bytes, by difference-cover suffix sorting in blocks.

A window is a ``LENGTH``-byte string inside one document. Every byte of a window that also starts anywhere else, in the same
document or another, is removed; overlaps count, and windows are judged on the input.

1. Suffixes fall into content-defined buckets: a window belongs to the ``GRAM``-byte string inside it with the least hash, so
   equal windows meet in one bucket at one offset. A document's windows form runs, one per anchor.
2. A run whose anchor hash occurs nowhere else has no repeats. Runs of one anchor that are equal as a whole, by a 128-bit hash of all
   their bytes, repeat as a whole.
3. Only runs at the ends of repeats are left. Buckets with different runs are sorted one block at a time: suffixes are
   ordered by their first 8 bytes, and long ties are resolved by ranks of a difference-cover sample (mod 7) that was
   sorted before; for any two suffixes some shift below 7 puts both in the sample. This step compares bytes, not hashes.

Hot buckets. Anchors and runs that hold more than 1 / ``MOST_HOT`` of all rows (so at most ``MOST_HOT`` of them) are dealt to several parts in joins. A bucket of
over ``SPLIT`` different runs is dealt out before it is sorted: a run is cut into stretches of windows whose anchor offsets fall in one range of ``STEP``; all windows of
such a range share ``LENGTH - STEP + 1`` bytes around the anchor, and stretches go to a bucket of their own by these bytes. Equal windows
have equal offsets and equal shared bytes, so they still meet, and stretches equal as a whole are found by step 2 again. What is
left in one such bucket agrees in the shared bytes and differs in the few bytes around.

Memory of a task: about 80 bytes per byte of a 2 MB slice (a longer text is read in overlapping pieces), and blocks of
about ``BLOCK`` suffixes. Texts go through a shuffle compressed. A null text is empty; a text under ``LENGTH`` bytes has no
window. Equal rows are copies of each other, so such a text of ``LENGTH`` bytes or more is removed from both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BYTE, MOST_HOT, Rolling, as_bytes, discard, flat, mix, salted, save, slices

LENGTH = 200
GRAM = 40
PIECE = 1 << 22
BLOCK = 300_000
#: Different runs of a bucket that are sorted as one, and the range of anchor offsets of a stretch of a larger one.
SPLIT = 2048
STEP = 40
#: A perfect difference cover: every difference mod 7 occurs.
MOD, COVER = 7, np.array([True, True, False, True, False, False, False])
RUN = "key long, place long, h1 long, h2 long, h3 long"
BYTE2 = mix(BYTE)


def row_key(doc_id: object, text: bytes) -> int:
    """A row by id and content; equal rows share it, and their repeats too."""
    x = xxhash.xxh64_intdigest(text, xxhash.xxh64_intdigest(str(doc_id)))
    return x - (1 << 64) if x >> 63 else x


def pack_place(lo: np.ndarray, n: np.ndarray, off: np.ndarray) -> np.ndarray:
    """First window, number of windows less one, and the anchor's offset from the first window, in one number."""
    return (lo.astype(np.int64) << 20) | (n.astype(np.int64) << 10) | off.astype(np.int64)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    pad = -len(x) % width
    rows = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def runs(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """For concatenated texts: text number, first window, windows less one, anchor offset, anchor hash and two hashes of the whole of every run."""
    size = at[1:] - at[:-1]
    windows = np.maximum(size - LENGTH + 1, 0)
    if not windows.sum():
        return (*(np.zeros(0, np.int64),) * 4, *(np.zeros(0, np.uint64),) * 3)
    roll = Rolling(BYTE[data])
    p = np.arange(len(data) - GRAM + 1)
    grams = roll(p, p + GRAM)
    low = np.uint64((1 << 24) - 1)
    least = sliding_min((grams & ~low) | p.astype(np.uint64), LENGTH - GRAM + 1)
    doc = np.repeat(np.arange(len(size)), windows)
    j = np.repeat(at[:-1] - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    anchor = (least[j] & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(doc) != 0)]))
    last = np.concatenate([first[1:], [len(j)]]) - 1
    lo, hi, a = j[first], j[last], anchor[first]
    second = Rolling(BYTE2[data], 0xA0761D6478BD642F)
    return doc[first], lo - at[doc[first]], hi - lo, a - lo, grams[a], roll(lo, hi + LENGTH) ^ mix((a - lo).astype(np.uint64)), second(lo, hi + LENGTH)


def run_rows(docs: DataFrame) -> DataFrame:
    """The runs of all texts: key, place, anchor hash h1, and h2, h3 of the whole run."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            keys = np.array([row_key(i, t.as_py()) for i, t in zip(batch.column("doc_id").to_pylist(), texts, strict=True)], np.int64)
            done = 0
            for part in slices(texts, PIECE // 2):
                data, at = flat(part)
                for base in range(0, max(1, len(data) - LENGTH + 1), PIECE) if len(part) == 1 else (0,):
                    piece = (data[base : base + PIECE + LENGTH - 1], np.array([0, min(len(data) - base, PIECE + LENGTH - 1)])) if len(part) == 1 else (data, at)
                    doc, lo, n, off, *hashes = runs(*piece)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys[done + doc], pack_place(lo + base, n, off), *(h.view(np.int64) for h in hashes))], names=["key", "place", "h1", "h2", "h3"])
                done += len(part)

    return docs.select("doc_id", "text").mapInArrow(go, RUN)


def packed_texts(docs: DataFrame) -> DataFrame:
    """key, doc_id, n_bytes and the compressed text."""
    schema = T.StructType([T.StructField("key", T.LongType()), docs.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("packed", T.BinaryType())])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = as_bytes(batch.column("text")).to_pylist()
            ids = batch.column("doc_id")
            yield pa.RecordBatch.from_arrays([pa.array([row_key(i, t) for i, t in zip(ids.to_pylist(), texts, strict=True)], pa.int64()), ids, pa.array([len(t) for t in texts], pa.int64()), pa.array([press.compress(t) for t in texts], pa.binary())], names=["key", "doc_id", "n_bytes", "packed"])

    return docs.select("doc_id", "text").mapInArrow(go, schema)


def repeated_windows(data: np.ndarray, starts: np.ndarray, usable: np.ndarray) -> np.ndarray:
    """Which windows, given by their starts in a block of text, equal another one.

    usable: the places at which ``LENGTH - 6`` bytes of one run follow.
    """
    span = LENGTH - MOD + 1
    sample = np.flatnonzero(usable & COVER[np.arange(len(data)) % MOD][: len(usable)])
    rank = np.full(len(data) + MOD, -1, np.int64)
    if len(sample):
        strings = np.lib.stride_tricks.sliding_window_view(data, span)[sample].copy().view(f"S{span}").ravel()
        order = np.argsort(strings)
        s = strings[order]
        rank[sample[order]] = np.cumsum(np.concatenate([[0], s[1:] != s[:-1]]))
    words = np.lib.stride_tricks.sliding_window_view(data, 8)
    head = words[starts].copy().view(">u8").ravel()
    tail = words[starts + LENGTH - 8].copy().view(">u8").ravel()
    out = np.zeros(len(starts), bool)
    for shift in range(MOD):
        pick = np.flatnonzero(COVER[(starts + shift) % MOD])
        r = rank[starts[pick] + shift]
        pick = pick[np.bincount(r)[r] > 1] if len(r) else pick
        if not len(pick):
            continue
        r = rank[starts[pick] + shift]
        order = np.lexsort((tail[pick], r, head[pick]))
        k = pick[order]
        r = r[order]
        same = (r[1:] == r[:-1]) & (head[k[1:]] == head[k[:-1]]) & (tail[k[1:]] == tail[k[:-1]])
        out[k[1:][same]] = True
        out[k[:-1][same]] = True
    return out


def _spans(mask: np.ndarray, key: np.ndarray, lo: np.ndarray) -> pa.RecordBatch:
    """Runs of marked windows that follow each other, as rows of key, first and last window."""
    i = np.flatnonzero(mask)
    new = np.concatenate([[True], (np.diff(i) != 1) | (np.diff(key[i]) != 0) | (np.diff(lo[i]) != 1)])[: len(i)]
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(i)]]) - 1 if len(i) else first
    return pa.RecordBatch.from_arrays([pa.array(key[i][first]), pa.array(lo[i][first]), pa.array(lo[i][last])], names=["key", "lo", "hi"])


def _sorted_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats among the runs of whole buckets, for a partition sorted by bucket, key and place."""

    def block(rows: pa.Table) -> pa.RecordBatch:
        key, place = rows.column("key").to_numpy(), rows.column("place").to_numpy()
        again = np.flatnonzero((key[1:] == key[:-1]) & (place[1:] == place[:-1])) + 1  # from equal rows of the input
        if len(again):
            rows = rows.take(pa.array(np.delete(np.arange(len(key)), again)))
            key, place = np.delete(key, again), np.delete(place, again)
        data, at = flat(rows.column("bytes").combine_chunks())
        n = (place >> 10 & 1023) + 1
        usable = np.zeros(len(data) + 1, np.int32)
        np.add.at(usable, at[:-1], 1)
        np.add.at(usable, np.maximum(at[1:] - (LENGTH - MOD), at[:-1]), -1)
        row = np.repeat(np.arange(len(n)), n)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        mask = repeated_windows(data, at[row] + step, np.cumsum(usable[:-1]) > 0)
        return _spans(mask, key[row], (place >> 20)[row] + step)

    held, waiting = [], 0
    for batch in batches:
        held.append(batch)
        waiting += batch.num_rows
        if waiting * (LENGTH - GRAM) // 2 >= BLOCK:
            rows = pa.Table.from_batches(held)
            h = rows.column("bucket").to_numpy()
            cuts = np.flatnonzero(np.diff(h)) + 1
            done = 0
            while len(cuts) and cuts[-1] > done:  # whole buckets, about BLOCK suffixes at once
                ahead = cuts[cuts > done]
                end = int(ahead[max(0, np.searchsorted(ahead, done + 2 * BLOCK // (LENGTH - GRAM), "right") - 1)])
                yield block(rows.slice(done, end - done))
                done = end
            held, waiting = rows.slice(done).combine_chunks().to_batches(), len(rows) - done
    if waiting:
        yield block(pa.Table.from_batches(held))


def stretches(p: int, h1: int, text: bytes) -> Iterator[tuple[int, int, int, int, bytes]]:
    """A run cut by ranges of anchor offsets: bucket, h2, h3, place and bytes of each stretch."""
    lo, n, off = p >> 20, p >> 10 & 1023, p & 1023
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    for c in range((off - n) // STEP, off // STEP + 1):
        a, b = max(0, off - c * STEP - STEP + 1), min(n, off - c * STEP)
        part = text[lo + a : lo + b + LENGTH]
        shared = text[lo + off - c * STEP : lo + off - c * STEP - STEP + 1 + LENGTH]
        whole = xxhash.xxh3_128_intdigest(part, off - a)
        bucket = xxhash.xxh64_intdigest(shared, (h1 ^ c) & (1 << 64) - 1)
        yield signed(bucket), signed(whole >> 64), signed(whole & (1 << 64) - 1), (lo + a) << 20 | (b - a) << 10 | (off - a), part


def whole_spans(rows: DataFrame) -> DataFrame:
    lo, n = F.shiftright("place", 20), F.shiftright("place", 10).bitwiseAND(F.lit(1023).cast("long"))
    return rows.select("key", lo.alias("lo"), (lo + n).alias("hi"))


def repeats(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """key, lo, hi: first and last window of stretches that occur elsewhere."""
    every = save(run_rows(docs), "runs")
    total = every.count()
    anchors = save(every.groupBy("h1").agg(F.count("*").alias("n")).filter("n > 1"), "runs-anchors")
    rows = save(salted(every, anchors, ["h1"], total, ["key", "place"], most_hot=MOST_HOT).drop("n"), "runs-shared")
    discard(every, anchors)
    which = ["h1", "h2", "h3"]
    kinds = save(rows.groupBy(*which).agg(F.count("*").alias("n"), F.first("key").alias("key"), F.first("place").alias("place")), "runs-kinds")  # both of one row, any
    equal = salted(rows, kinds.filter("n > 1").select(*which, "n"), which, total, ["key", "place"], most_hot=MOST_HOT)
    mixed = kinds.groupBy("h1").agg(F.count("*").alias("n")).filter("n > 1")
    asked = salted(kinds.drop("n"), mixed, ["h1"], total, ["key", "place"], most_hot=MOST_HOT).select("h1", "key", "place", (F.col("n") > SPLIT).alias("split"))
    wanted = asked.groupBy("key").agg(F.collect_list(F.struct("h1", "split", "place")).alias("wanted"))  # at most the runs of one text
    fetched = texts.select("key", "packed").join(wanted, "key")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, last = zstandard.ZstdDecompressor(), None
        for batch in batches:
            out: list[tuple] = []
            for key, packed, want in zip(batch.column("key").to_pylist(), batch.column("packed").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                if key == last:  # an equal row
                    continue
                last, text = key, open_.decompress(packed)
                for w in want:
                    p = w["place"]
                    if w["split"]:
                        out.extend((bucket, h2, h3, key, place, part, True) for bucket, h2, h3, place, part in stretches(p, w["h1"], text))
                    else:
                        out.append((w["h1"], 0, 0, key, p, text[p >> 20 : (p >> 20) + (p >> 10 & 1023) + LENGTH], False))
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.binary()), pa.array(cols[6], pa.bool_())], names=["bucket", "h2", "h3", "key", "place", "bytes", "split"])

    parts = save(fetched.mapInArrow(fetch, "bucket long, h2 long, h3 long, key long, place long, bytes binary, split boolean"), "runs-bytes")
    cut, which = parts.filter("split"), ["bucket", "h2", "h3"]
    cut_kinds = cut.groupBy(*which).agg(F.count("*").alias("n"), F.first("key").alias("key"), F.first("place").alias("place"), F.first("bytes").alias("bytes"))
    cut_equal = salted(cut.select("key", "place", *which), cut_kinds.filter("n > 1").select(*which, "n"), which, total, ["key", "place"], most_hot=MOST_HOT)
    ready = parts.filter("not split").select("bucket", "key", "place", "bytes").unionByName(cut_kinds.select("bucket", "key", "place", "bytes"))
    found = ready.repartition("bucket").sortWithinPartitions("bucket", "key", "place").mapInArrow(_sorted_blocks, "key long, lo long, hi long")
    return whole_spans(equal).unionByName(whole_spans(cut_equal)).unionByName(found)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte ranges covered by stretches of windows, joined where they overlap or touch."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + LENGTH)
        else:
            out.append([lo, hi + LENGTH])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the bytes that stay (binary ``kept``)."""
    docs = docs.select("doc_id", "text")
    texts = packed_texts(docs)
    found = repeats(docs, texts).groupBy("key").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))  # equal rows share a key: each span once
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType()), *[T.StructField("kept", T.BinaryType())] * with_text])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            removed, n_spans, sha, left = [], [], [], []
            for packed, spans in zip(batch.column("packed").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                text = open_.decompress(packed)
                cut = merged([(s["lo"], s["hi"]) for s in spans or ()])
                at = [0, *(x for ab in cut for x in ab), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(at[::2], at[1::2], strict=True))
                removed.append(len(text) - len(kept))
                n_spans.append(len(cut))
                sha.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    left.append(kept)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string()), *[pa.array(left, pa.binary())] * with_text], names=[f.name for f in schema])

    return texts.join(found, "key", "left").select("doc_id", "n_bytes", "packed", "spans").mapInArrow(go, schema)


def op10(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs)


#: DuckDB. Every window of 200 bytes (400 hex digits, cut from pieces of 1024 starts) by its MD5; windows that occur twice, joined where they overlap or touch.
SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
pieces AS (SELECT r, c * 1024 AS base, substr(h, 2048 * c + 1, {2 * (1023 + LENGTH)}) AS piece FROM (SELECT r, h, unnest(range(length(h) // 2048 + 1)) AS c FROM d)),
windows AS MATERIALIZED (SELECT r, base + i AS i, md5(substr(piece, 2 * i + 1, {2 * LENGTH})) AS key FROM (SELECT *, unnest(range(length(piece) // 2 - {LENGTH - 1})) AS i FROM pieces)),
twice AS (SELECT r, i FROM windows JOIN (SELECT key FROM windows GROUP BY key HAVING count(*) > 1) USING (key)),
numbered AS (
  SELECT r, i, sum(opens) OVER (PARTITION BY r ORDER BY i) AS run
  FROM (SELECT r, i, CAST(i - lag(i, 1, -{LENGTH + 1}) OVER (PARTITION BY r ORDER BY i) > {LENGTH} AS BIGINT) AS opens FROM twice)),
runs AS (SELECT r, min(i) AS lo, max(i) + {LENGTH} AS hi FROM numbered GROUP BY r, run),
gaps AS (SELECT r, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS since FROM runs),
cut AS (
  SELECT r, sum(hi - lo) AS n_removed, count(*) AS n_spans, max(hi) AS last, string_agg(substr(h, 2 * since + 1, 2 * (lo - since)), '' ORDER BY lo) AS head
  FROM gaps JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut USING (r)
"""
