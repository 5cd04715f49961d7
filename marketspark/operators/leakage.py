"""Keys, gaps and leaks of features against later rows, in one pass over the rows in key order.

Three tables meet in range partitions of (symbol, ts), a row for each key. A task reads a run of consecutive keys batch by batch, compares
each row with those up to ``ahead`` places later as matrices (features x base columns), and gives one row: counts, and the rows at both its edges.
One last task reads these, a row a partition and in order, and compares across the edges, so a series may span any number of partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketspark.functions.windows import finite

KEYS = ["symbol", "ts"]
REPORT = "check string, subject string, violations long, passed boolean"
EDGES = ("raw_head", "raw_tail", "x_head", "x_tail")
COUNTS = "part int, counts array<long>, " + ", ".join(f"{e}_names array<string>, {e} array<double>" for e in EDGES)


class Follow:
    """Calls ``count(k, earlier, later)`` with all rows that lie k = 1 ... ``reach`` places apart in one series; rows arrive in order."""

    def __init__(self, reach: int, width: int, count: Callable[[int, np.ndarray, np.ndarray], None]):
        self.reach, self.width, self.count = reach, width, count
        self.names, self.rows = np.empty(0, object), np.empty((0, width))
        self.head_names, self.head = self.names, self.rows

    def add(self, names: np.ndarray, rows: np.ndarray) -> None:
        room = self.reach - len(self.head_names)
        self.head_names, self.head = np.concatenate([self.head_names, names[:room]]), np.concatenate([self.head, rows[:room]])
        self._pairs(names, rows, len(self.names) + len(names))
        self._shift(names, rows)

    def join(self, head_names: np.ndarray, head: np.ndarray, tail_names: np.ndarray, tail: np.ndarray) -> None:
        """A later run whose own pairs are counted: only its first rows meet the rows so far."""
        self._pairs(head_names, head, len(self.names))
        self._shift(tail_names, tail)

    def _pairs(self, names: np.ndarray, rows: np.ndarray, stop: int) -> None:
        before = len(self.names)
        names, rows = np.concatenate([self.names, names]), np.concatenate([self.rows, rows])
        for k in range(1, self.reach + 1):
            lo, hi = max(0, before - k), min(stop, len(names) - k)
            if lo < hi:
                same = (names[lo:hi] == names[lo + k : hi + k]).astype(bool)
                self.count(k, rows[lo:hi][same], rows[lo + k : hi + k][same])

    def _shift(self, names: np.ndarray, rows: np.ndarray) -> None:
        self.names, self.rows = np.concatenate([self.names, names])[-self.reach :], np.concatenate([self.rows, rows])[-self.reach :]


class Tally:
    """The counts of a run of keys, as one vector that adds up over runs."""

    def __init__(self, features: int, base: int, ahead: int, lag: int, atol: float, rtol: float):
        self.future, self.equal, self.missing = np.zeros((base, features, ahead), np.int64), np.zeros(features, np.int64), np.zeros(features, np.int64)
        self.rest = np.zeros(5, np.int64)  # keys twice in raw, in x; rows on one side only; joined rows; pairs of rows of x

        def future(k: int, now: np.ndarray, later: np.ndarray) -> None:
            joined = now[:, 0] > 0
            f, b = now[joined, 1 : features + 1], later[joined, features + 1 :]
            with np.errstate(invalid="ignore"):
                for j in range(base):
                    self.future[j, :, k - 1] += (np.abs(f - b[:, j, None]) <= atol + rtol * np.abs(b[:, j, None])).sum(axis=0)

        def equal(k: int, now: np.ndarray, later: np.ndarray) -> None:
            if k == lag:
                self.rest[4] += len(now)
                self.equal += ((now == later) | (np.isnan(now) & np.isnan(later))).sum(axis=0)

        self.raw, self.x = Follow(ahead, 1 + features + base, future), Follow(lag, features, equal)

    def vector(self) -> np.ndarray:
        return np.concatenate([self.future.ravel(), self.equal, self.missing, self.rest])

    def add(self, vector: np.ndarray) -> None:
        a, b = self.future.size, self.equal.size
        self.future += vector[:a].reshape(self.future.shape)
        self.equal += vector[a : a + b]
        self.missing += vector[a + b : a + 2 * b]
        self.rest += vector[a + 2 * b :]


def scan(raw: DataFrame, x: DataFrame, y: DataFrame, features: list[str], base: list[str], ahead: int = 3, lag: int = 1, atol: float = 0.0, rtol: float = 0.0, share: float = 0.95) -> DataFrame:
    """Rows (check, subject, violations, passed):

    * ``unique_keys`` of raw, then of x: keys that come more than once;
    * ``complete``: missing, NaN or infinite values of each feature;
    * ``same_keys``: rows of x or y without a partner (one with NULL in its key has none);
    * ``future_fields``, only where found: a feature that equals (or comes as near as allowed to) a base column of 1 ... ``ahead`` rows later on nearly all rows of x that raw has;
    * ``lookahead``: a feature that equals itself ``lag`` rows later wherever there is such a row; missing values equal each other.

    Of several rows with one key, the least stands for it in the last two. Empty tables give counts of 0. Names may hold any characters.
    """
    if ahead < 1 or lag < 1:
        raise ValueError("ahead and lag must be positive")
    nf, nb = len(features), len(base)
    numbers = lambda names: F.array(*(F.col(f"`{c}`").cast("double") for c in names)).cast("array<double>")
    none = F.lit(None).cast("array<double>")
    rows = raw.select(*KEYS, F.lit(0).alias("_kind"), numbers(base).alias("_b"), none.alias("_f"))
    rows = rows.unionAll(x.select(*KEYS, F.lit(1), none, numbers(features))).unionAll(y.select(*KEYS, F.lit(2), none, none))
    n = [F.count_if(F.col("_kind") == k) for k in range(3)]
    gaps = F.array(*(F.count_if((F.col("_kind") == 1) & finite(F.col("_f")[i]).isNull()) for i in range(nf))).cast("array<long>")
    gone = lambda n: F.array(*[F.lit(float("nan"))] * n).cast("array<double>")
    parts = int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_key = rows.repartitionByRange(parts, *KEYS).groupBy(*KEYS).agg(n[0].alias("_raw"), n[1].alias("_x"), n[2].alias("_y"), gaps.alias("_gaps"), F.coalesce(F.min("_b"), gone(nb)).alias("_b"), F.coalesce(F.min("_f"), gone(nf)).alias("_f"))
    known = F.col("symbol").isNotNull() & F.col("ts").isNotNull()
    alone = F.when(~known | (F.col("_y") == 0), F.col("_x")).otherwise(0) + F.when(~known | (F.col("_x") == 0), F.col("_y")).otherwise(0)
    by_key = by_key.sortWithinPartitions(*KEYS).select(F.col("symbol").cast("string").alias("symbol"), "_raw", "_x", alone.alias("_alone"), (known & (F.col("_raw") > 0) & (F.col("_x") > 0)).alias("_joined"), "_gaps", "_b", "_f")

    def edge(name: str, names: np.ndarray, rows: np.ndarray) -> dict:
        return {f"{name}_names": pa.array([list(names)], pa.list_(pa.string())), name: pa.array([rows.ravel()], pa.list_(pa.float64()))}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, any_row = Tally(nf, nb, ahead, lag, atol, rtol), False
        for batch in batches:
            if not batch.num_rows:
                continue
            any_row = True
            name = batch.column("symbol").to_numpy(zero_copy_only=False)
            in_raw, in_x, alone, joined = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_raw", "_x", "_alone", "_joined"))
            matrix = lambda c, n, batch=batch: batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, n)
            b, f = matrix("_b", nb).astype(float), matrix("_f", nf).astype(float)
            tally.missing += matrix("_gaps", nf).sum(axis=0).astype(np.int64)
            tally.rest[:4] += [(in_raw > 1).sum(), (in_x > 1).sum(), alone.sum(), joined.sum()]
            tally.raw.add(name[in_raw > 0], np.column_stack([joined, f, b])[in_raw > 0])
            tally.x.add(name[in_x > 0], f[in_x > 0])
        if any_row:
            r, s = tally.raw, tally.x
            out = {"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "counts": pa.array([tally.vector()], pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_pydict(out | edge("raw_head", r.head_names, r.head) | edge("raw_tail", r.names, r.rows) | edge("x_head", s.head_names, s.head) | edge("x_tail", s.names, s.rows))

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(nf, nb, ahead, lag, atol, rtol)
        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] < 0:
                    continue
                tally.add(np.array(row["counts"], np.int64))
                for at, table in ((tally.raw, "raw"), (tally.x, "x")):
                    names = {end: row[f"{table}_{end}_names"] for end in ("head", "tail")}
                    rows = {end: np.array(row[f"{table}_{end}"], float).reshape(len(names[end]), at.width) for end in names}
                    at.join(np.array(names["head"], object), rows["head"], np.array(names["tail"], object), rows["tail"])
        twice_raw, twice_x, alone, joined, pairs = map(int, tally.rest)
        found = [("unique_keys", "symbol, ts", twice_raw), ("unique_keys", "symbol, ts", twice_x)]
        found += [("complete", f, int(v)) for f, v in zip(features, tally.missing, strict=True)]
        found.append(("same_keys", "symbol, ts", alone))
        found += [("future_fields", f"{f} = {b} + {k + 1}", int(v)) for j, b in enumerate(base) for i, f in enumerate(features) for k, v in enumerate(tally.future[j, i]) if v > 0 and v >= np.floor(share * joined)]
        found += [("lookahead", f, int(pairs > 0 and v == pairs)) for f, v in zip(features, tally.equal, strict=True)]
        yield pa.RecordBatch.from_pydict({"check": [c for c, _, _ in found], "subject": [s for _, s, _ in found], "violations": pa.array([v for *_, v in found], pa.int64()), "passed": [v == 0 for *_, v in found]})

    seed = raw.sparkSession.createDataFrame([(-1, *[None] * 9)], COUNTS)  # so that empty tables have a report
    return by_key.mapInArrow(count, COUNTS).unionAll(seed).repartition(1).sortWithinPartitions("part").mapInArrow(report, REPORT)
