"""Near-duplicates by SimHash with bit-sliced comparison.

Fingerprint: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, 3-word shingles with repeats (fewer words: the whole
sequence), XXH64 with seed 42; a bit is 1 if set in over half the hashes. A text without words (null, empty) has
fingerprint zero and is linked like any other. Fingerprints link at ``RADIUS`` or fewer differing bits.

Candidates: the 64 bits form 5 blocks; of two fingerprints within 3 bits at least 2 blocks are equal, so each
distinct fingerprint goes to the 10 buckets of its block pairs (about 26 bits each) and no link is lost. A bucket
of more than ``CHUNK`` fingerprints is dealt out as pairs of chunks. Inside a bucket, bit planes are stored
vertically and the distances of 64 pairs a word are counted with carry-save adders; a block of lanes is
left as soon as all its distances exceed the radius. A bucket yields star edges, at most one a member, not pairs;
the classes are connected over all buckets by alternating large and small stars.
Exact copies meet in one fingerprint row before any comparison. Rows with null doc_id are kept; a class has the
smallest non-null doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, discard, save

RADIUS = 3
WIDTHS = (13, 13, 13, 13, 12)
CHUNK = 16384
LANES = 1 << 17
#: Words of 64 lanes that are compared, and given up, together.
BLOCK = 64
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: bytes, k: int = 3) -> list[int]:
    words = text.lower().split()  # bytes: only A-Z, and only the white space of the word rule
    if not words:
        return []
    if len(words) <= k:
        return [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: -k] + 1])
    return [h(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[k - 1 :].tolist(), strict=True)]


def fingerprints(texts: list[bytes], slab: int = 1 << 17) -> np.ndarray:
    """Fingerprints of texts, as unsigned 64-bit numbers; at most ``slab`` shingles are unpacked at once."""
    out = np.zeros(len(texts), np.uint64)
    for i, text in enumerate(texts):
        hashes = np.array(shingle_hashes(text), "<u8")
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), slab):
            bits = np.unpackbits(hashes[at : at + slab].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(0, dtype=np.int32)
        out[i] = np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]
    return out


def planes(fps: np.ndarray) -> np.ndarray:
    """64 x words: bit b of lane i is bit i % 64 of word i // 64 in row b."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    pad = -(-bits.shape[1] // 64) * 64 + 64
    wide = np.zeros((64, pad), np.uint8)
    wide[:, : bits.shape[1]] = bits
    return np.packbits(wide, axis=1, bitorder="little").view("<u8")


def within(a: np.ndarray, valid: np.ndarray, shift: int, radius: int) -> np.ndarray:
    """Lanes i, among the valid ones, whose distance to lane i + shift is at most the radius (up to 3)."""
    words, q, r = a.shape[1], shift // 64, np.uint64(shift % 64)
    out = np.zeros(words, np.uint64)
    for lo in range(0, words - q, BLOCK):
        hi = min(lo + BLOCK, words - q)
        live = valid[lo:hi].copy()
        if not live.any():
            continue
        ones, twos = np.zeros(hi - lo, np.uint64), np.zeros(hi - lo, np.uint64)
        for b in range(64):
            other = a[b, lo + q : hi + q]
            if r:
                up = np.zeros(hi - lo, np.uint64)
                up[: len(a[b, lo + q + 1 : hi + q + 1])] = a[b, lo + q + 1 : hi + q + 1]
                other = (other >> r) | (up << (np.uint64(64) - r))
            bit = a[b, lo:hi] ^ other
            carry = ones & bit
            ones ^= bit
            live &= ~(twos & carry)  # a fourth difference
            twos ^= carry
            if b % 8 == 7 and not live.any():
                break
        if radius < 3:
            live &= ~twos if radius < 2 else ~(twos & ones)
            live &= ~ones if radius < 1 else _FULL
        out[lo:hi] = live
    return np.flatnonzero(np.unpackbits(out.view(np.uint8), bitorder="little"))


def roots(fps: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For fingerprints sorted by group: the place of the first member of its linked class inside its group."""
    n = len(fps)
    label = np.arange(n)
    if n < 2:
        return label
    a = planes(fps)
    for shift in range(1, n):
        same = group[shift:] == group[:-shift]
        if not same.any():
            break
        same &= label[shift:] != label[:-shift]  # linked already
        mask = np.zeros(a.shape[1] * 64, np.uint8)
        mask[: n - shift] = same
        i = within(a, np.packbits(mask, bitorder="little").view("<u8"), shift, radius)
        j = i + shift
        while len(i):
            u, v = label[i], label[j]
            open_ = u != v
            i, j, u, v = i[open_], j[open_], u[open_], v[open_]
            np.minimum.at(label, np.maximum(u, v), np.minimum(u, v))
            while (label[label] != label).any():
                label = label[label]
    return label


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Star edges of the buckets of a partition that is sorted by bucket; a bucket is held until it is whole."""

    def out(group: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        big = np.diff(np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])))
        sizes = np.repeat(big, big)
        edges = []
        for over, most in ((1, 8), (8, 64), (64, 512), (512, len(fp))):  # buckets of like size share their lanes
            pick = np.flatnonzero((sizes > over) & (sizes <= most))
            if len(pick):
                label = roots(fp[pick].view(np.uint64), group[pick])
                far = np.flatnonzero(label != np.arange(len(pick)))
                edges.append(np.stack([fp[pick][far], fp[pick][label[far]]]))
        e = np.concatenate(edges, axis=1) if edges else np.zeros((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(e[0], e[1])), pa.array(np.minimum(e[0], e[1]))], names=["u", "v"])

    held_g, held_f = [], []
    waiting = 0
    for batch in batches:
        held_g.append(batch.column("bucket").to_numpy(zero_copy_only=False))
        held_f.append(batch.column("fp").to_numpy(zero_copy_only=False))
        waiting += batch.num_rows
        if waiting >= LANES:
            g, f = np.concatenate(held_g), np.concatenate(held_f)
            cut = int(np.searchsorted(g, g[-1])) if g[0] != g[-1] else 0
            if cut:
                yield out(g[:cut], f[:cut])
            held_g, held_f, waiting = [g[cut:]], [f[cut:]], len(g) - cut
    if waiting:
        yield out(np.concatenate(held_g), np.concatenate(held_f))


def bucket_keys(fp: F.Column) -> F.Column:
    """The block pairs of a fingerprint, as an array of bucket keys."""
    low = [sum(WIDTHS[:i]) for i in range(len(WIDTHS))]
    part = [F.shiftrightunsigned(fp, low[i]).bitwiseAND(F.lit((1 << w) - 1).cast("long")) for i, w in enumerate(WIDTHS)]
    return F.array(*(F.lit(k << 26).cast("long") + F.shiftleft(part[i], 13) + part[j] for k, (i, j) in enumerate(combinations(range(len(WIDTHS)), 2))))


def connect(edges: DataFrame) -> DataFrame:
    """Connected classes of edges (u > v): rows (u, v) with v the smallest member, for every u that is not smallest.

    Alternates large-star and small-star; every round is written to the shared folder. Hub nodes cost a partial
    minimum and a join that adaptive execution can split.
    """
    marks = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    e = save(edges.distinct(), "links")
    seen = marks(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        last, e = e, save(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).distinct(), "links")
        discard(last)
        now = marks(e)
        if now == seen:
            break
        seen = now
    return e


def fingerprint_rows(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and ``fp``, the fingerprint as a signed 64-bit number."""
    schema = docs.select(*keep).withColumn("fp", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = fingerprints(as_bytes(batch.column("_text")).to_pylist()).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(fp)], names=[*keep, "fp"])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def classes(rows: DataFrame) -> DataFrame:
    """For rows (doc_id, fp): rows (fp, root, component_id, n_docs) of the distinct fingerprints; root names the class."""
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n_docs"))
    distinct = save(distinct, "fingerprints")
    keyed = distinct.select("fp", F.explode(bucket_keys(F.col("fp"))).alias("key"))
    shares = keyed.groupBy("key").count().filter("count > 1").withColumn("chunks", F.ceil(F.col("count") / CHUNK).cast("int"))
    dealt = (
        keyed.join(shares.select("key", "chunks"), "key")  # buckets of one have no pair
        .withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("chunks") - 1), F.col("chunk")))))
        .select(F.xxhash64("key", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("bucket"), "fp")
    )
    edges = dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_stars, "u long, v long")
    labels = connect(edges)
    rooted = distinct.join(labels.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id", "n_docs")


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, and n_same (rows of that fingerprint)."""
    rows = save(fingerprint_rows(docs, ["doc_id"], text), "simhash")
    return rows.join(classes(rows), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", F.col("n_docs").alias("n_same"))


def one_of_each(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one row of each class of near-duplicates: that of the smallest doc_id, the first of equal ones.

    Rows are told apart by their place in the table, so ``docs`` should be a stored table (the same splits each time it is read).
    """
    placed = docs.withColumn("_row", F.monotonically_increasing_id())
    rows = save(fingerprint_rows(placed, ["doc_id", "_row"], text), "simhash")
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))
    of = rows.groupBy("fp").agg(best.alias("best")).join(classes(rows), "fp")
    stay = of.groupBy("root").agg(F.min("best")["_row"].alias("_row")).select("_row")
    return placed.join(stay, "_row", "left_semi").select(*docs.columns)


def op1(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs.select("doc_id", "text"))
