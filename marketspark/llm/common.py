"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule ``[^\x20\x09-\x0D]+``, as a character class for regular expressions.
WS = r"\x20\x09-\x0D"
WORD = rf"[^{WS}]+"

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_own_dir: list[str] = []
_made: list[DataFrame] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``). Where it is unset, a temporary one in local mode; an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return _own_dir[0]


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, survives lost executors.

    The table is deleted by :func:`discard`, or else when the session's driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/marketspark-{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    df.write.option("compression", "zstd").parquet(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    _made.append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete saved tables that nothing reads any more."""
    for df in tables:
        place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._saved_at)
        place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)
        _made[:] = [t for t in _made if t is not df]


def save_only(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """Save what ``make`` returns, and delete all tables that were saved on the way."""
    before = list(_made)
    out = save(make(), name)
    discard(*(t for t in list(_made) if t is not out and not any(t is b for b in before)))
    return out


#: Keys that are salted in a join, at most.
MOST_HOT = 1000


def salted(rows: DataFrame, counts: DataFrame, on: list[str], total: int, salt_by: list[str], how: str = "inner", most_hot: int = MOST_HOT) -> DataFrame:
    """Join of ``rows`` (``total`` of them) with ``counts``, one row for each key with its number of rows ``n``.

    Keys of over total / ``most_hot`` rows, so at most ``most_hot`` of them, are dealt to as many parts as they hold such shares.
    """
    parts = F.ceil(F.col("n") * most_hot / max(total, 1)).cast("int")
    few = F.broadcast(counts.withColumn("_parts", parts).filter("_parts > 1").select(*on, "_parts"))  # at most most_hot rows
    left = rows.join(few, on, "left").withColumn("_salt", F.when(F.col("_parts") > 1, F.pmod(F.xxhash64(*salt_by), F.col("_parts")).cast("int")).otherwise(0)).drop("_parts")
    right = counts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def word_count(text: Column) -> Column:
    """Number of words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_bucket(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def as_bytes(column: pa.Array) -> pa.Array:
    """A string column as UTF-8 bytes, null as empty."""
    return column.cast(pa.large_binary()).fill_null(b"")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of texts in one array, and the offsets of the texts in it."""
    column = as_bytes(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, most: int) -> list[pa.Array]:
    """Runs of rows whose texts hold about ``most`` bytes; a longer text is a run of its own."""
    column = as_bytes(column)
    out, first = [], 0
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        out.append(column.slice(first, last - first))
        first = last
    return out


def word_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word in concatenated texts."""
    n = len(data)
    ink = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before = np.concatenate([[False], ink[:-1]]) if n else ink
    after = np.concatenate([ink[1:], [False]]) if n else ink
    starts = np.flatnonzero(ink & (~before | edge[:-1]))
    ends = np.flatnonzero(ink & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(at, starts, "right") - 1


_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any ranges of a sequence of 64-bit symbols, from one running sum modulo 2**64."""

    def __init__(self, symbols: np.ndarray, base: int = 0xD6E8FEB86659FD93):
        with np.errstate(over="ignore"):
            n = len(symbols)
            self.down = np.cumprod(np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)) * np.uint64(base)
            up = np.cumprod(np.full(n + 1, base, np.uint64))
            self.sums = np.zeros(n + 1, np.uint64)
            np.cumsum(symbols * up[:n], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])


#: A random 64-bit symbol for each byte value.
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, slab: int = 1 << 20) -> np.ndarray:
    """64-bit hashes of disjoint ranges of bytes, in order.

    A range's hash sums a scrambled number for each byte and its place in the range. Unlike a polynomial modulo 2**64, which is
    equal for some different texts (Thue-Morse words) whatever its base, this has no structure in the places.
    """
    sums = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        for lo in range(0, len(data), slab):
            hi = min(lo + slab, len(data))
            own = np.zeros(hi - lo, np.int64)  # where each byte's range starts
            a, b = np.searchsorted(starts, [lo, hi])
            own[0] = starts[a - 1] if a else 0
            own[starts[a:b] - lo] = starts[a:b]
            np.maximum.accumulate(own, out=own)
            place = (np.arange(lo, hi) - own).astype(np.uint64)
            sums[lo + 1 : hi + 1] = mix(BYTE[data[lo:hi]] + place * _ODD)
        np.cumsum(sums, out=sums)
        return mix(sums[ends] - sums[starts] + (ends - starts).astype(np.uint64) * _ODD)


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.argsort(keys)
    same = np.diff(keys[order]) == 0
    out = np.zeros(len(keys), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n places lie in a run of ``length`` that begins at one of ``starts``."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + length, -1)
    return np.cumsum(step[:-1]) > 0
