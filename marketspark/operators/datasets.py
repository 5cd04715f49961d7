"""Splits, scaling, sequences and profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketspark.functions.quantiles import beside, quantiles
from marketspark.functions.windows import corr, finite, ratio
from marketspark.sources.scratch import keep

KEYS = ("symbol",)


def chronological(df: DataFrame, train: float = 0.70, upto: float = 0.85, panel: bool = False) -> DataFrame:
    """``fold``: train, val, test in time order, per symbol; with ``panel`` at dates that all symbols share."""
    if not 0 < train < upto < 1:
        raise ValueError("0 < train < upto < 1")
    name = lambda i, n: F.when(i <= F.floor(n * train), "train").when(i <= F.floor(n * upto), "val").otherwise("test")
    if panel:
        days = df.select("ts").distinct()
        days = days.select("ts", name(F.row_number().over(Window.orderBy("ts")), F.count("*").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("fold"))
        return df.join(days, "ts")
    w = Window.partitionBy(*KEYS)
    return df.withColumn("fold", name(F.row_number().over(w.orderBy("ts")), F.count("*").over(w)))


def fit_scaler(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: mean and population deviation of the train fold; a deviation of 0 counts as 1."""
    std = lambda c: F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)).otherwise(1.0)
    return df.filter("fold = 'train'").agg(*(F.avg(c).alias(f"_m_{c}") for c in columns), *(std(c).alias(f"_s_{c}") for c in columns))


def scale(df: DataFrame, scaler: DataFrame, columns: list[str], inverse: bool = False) -> DataFrame:
    wide = df.crossJoin(F.broadcast(scaler))  # one row
    f = (lambda c: F.col(c) * F.col(f"_s_{c}") + F.col(f"_m_{c}")) if inverse else (lambda c: (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}"))
    return wide.select(*(f(c).alias(c) if c in columns else F.col(c) for c in df.columns))


def sequences(df: DataFrame, columns: list[str], target: str, length: int = 60, keep_last: bool = False) -> DataFrame:
    """Overlapping windows of ``length`` rows per symbol and fold, at their end row; the last one of a fold is dropped unless kept."""
    w = Window.partitionBy(*KEYS, "fold").orderBy("ts")
    seq = F.collect_list(F.array(*(F.col(c).cast("float") for c in columns))).over(w.rowsBetween(-(length - 1), 0))
    out = df.withColumns({"sequence": seq, "_next": F.lead(F.lit(1)).over(w)}).filter(F.size("sequence") == length)
    if not keep_last:
        out = out.filter("_next = 1")
    return out.select(*KEYS, "ts", "fold", "sequence", F.col(target).alias("y"))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max: a row for each symbol and column. The quartiles are exact, and no symbol's values meet in one task."""
    stored = keep(df.select(*KEYS, *(F.col(c).cast("double").alias(c) for c in columns)), "described")
    long = stored.select(*KEYS, F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("x")) for c in columns))).alias("v")).select(*KEYS, "v.*")
    q = quantiles(long, (*KEYS, "column"), "x", (0.25, 0.5, 0.75)).drop("n")
    out = long.groupBy(*KEYS, "column").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    at = F.col("quantiles")
    return beside(out, q, (*KEYS, "column")).select(*KEYS, "column", "n", "mean", "std", "min", at[0].alias("q25"), at[1].alias("q50"), at[2].alias("q75"), "max")


def missing(df: DataFrame, columns: list[str], top: int | None = 10) -> DataFrame:
    one = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns), F.count("*").alias("_n"))
    out = one.select("_n", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in columns))).alias("v")).select("v.*", (F.col("_n") - F.col("v.missing")).alias("present"))
    return out.orderBy(F.desc("missing"), "column").limit(top) if top else out


#: Columns of a block, and pairs of blocks in one scan: a task holds six sums for each pair of columns, 50 MB at most.
BLOCK, PAIRS = 256, 16
_SUMS = 6


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a partition's rows (pair, salt, sums) by pair and salt."""
    total: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for pair, salt, sums in zip(*(batch.column(c).to_pylist() for c in ("pair", "salt", "sums")), strict=True):
            total[pair, salt] = total.get((pair, salt), 0) + np.frombuffer(sums)
    yield pa.RecordBatch.from_pydict({"pair": pa.array([k[0] for k in total], pa.int32()), "salt": pa.array([k[1] for k in total], pa.int32()), "sums": pa.array([v.tobytes() for v in total.values()], pa.binary())})


def correlations(df: DataFrame, columns: list[str], block: int = BLOCK) -> DataFrame:
    """All pairs of columns as rows (f1, f2, corr), over the rows where both have finite values; NULL where either doesn't vary.

    Columns are cut into blocks. A task adds up six matrix products for each pair of blocks: values, squares and masks of those that are there,
    so that each pair of columns has its own count, sums and squares. Tasks' sums meet in two steps, a row for each pair of blocks. One
    scan serves ``PAIRS`` pairs of blocks. Values are taken less the columns' means.
    """
    rows = df.select(*(finite(F.col(c).cast("double")).alias(f"c{i}") for i, c in enumerate(columns)))
    means = rows.agg(*(F.coalesce(F.avg(f"c{i}"), F.lit(0.0)).alias(f"m{i}") for i in range(len(columns)))).first()  # p numbers
    centre, starts = np.array(means, float), range(0, len(columns), block)
    pairs = [(a, b) for a in starts for b in starts if a <= b]
    kinds, out = "pair int, salt int, sums binary", None
    for lo in range(0, len(pairs), PAIRS):
        some = pairs[lo : lo + PAIRS]

        def products(batches: Iterator[pa.RecordBatch], some: list[tuple[int, int]] = some) -> Iterator[pa.RecordBatch]:
            total = {k: 0 for k in range(len(some))}
            for batch in batches:
                x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]) - centre
                there = (~np.isnan(x)).astype(float)
                x = np.where(there > 0, x, 0.0)
                for k, (a, b) in enumerate(some):
                    xa, xb, ma, mb = x[:, a : a + block], x[:, b : b + block], there[:, a : a + block], there[:, b : b + block]
                    total[k] = total[k] + np.stack([ma.T @ mb, xa.T @ mb, ma.T @ xb, (xa * xa).T @ mb, ma.T @ (xb * xb), xa.T @ xb])
            made = {k: v for k, v in total.items() if not isinstance(v, int)}
            salt = [TaskContext.get().partitionId() % 32] * len(made)
            yield pa.RecordBatch.from_pydict({"pair": pa.array(list(made), pa.int32()), "salt": pa.array(salt, pa.int32()), "sums": pa.array([v.tobytes() for v in made.values()], pa.binary())})

        def finish(batches: Iterator[pa.RecordBatch], some: list[tuple[int, int]] = some) -> Iterator[pa.RecordBatch]:
            for done in _add_up(batches):
                for pair, sums in zip(done.column("pair").to_pylist(), done.column("sums").to_pylist(), strict=True):
                    a, b = some[pair]
                    fa, fb = columns[a : a + block], columns[b : b + block]
                    n, sx, sy, xx, yy, xy = np.frombuffer(sums).reshape(_SUMS, len(fa), len(fb))
                    vx, vy = n * xx - sx * sx, n * yy - sy * sy
                    with np.errstate(invalid="ignore", divide="ignore"):
                        c = np.where((vx > 1e-12 * n * xx) & (vy > 1e-12 * n * yy), (n * xy - sx * sy) / np.sqrt(vx * vy), np.nan)
                    i, j = np.meshgrid(np.arange(len(fa)), np.arange(len(fb)), indexing="ij")
                    use = ((i <= j) | (a != b)).ravel()
                    f1, f2, c = [fa[k] for k in i.ravel()[use]], [fb[k] for k in j.ravel()[use]], c.ravel()[use]
                    again = [k for k in range(len(f1)) if f1[k] != f2[k]]
                    both = np.concatenate([c, c[again]])
                    yield pa.RecordBatch.from_pydict({"f1": f1 + [f2[k] for k in again], "f2": f2 + [f1[k] for k in again], "corr": pa.array(np.clip(both, -1.0, 1.0), mask=np.isnan(both))})

        parts = rows.mapInArrow(products, kinds).repartition(32, "pair", "salt").mapInArrow(_add_up, kinds)
        got = parts.withColumn("salt", F.lit(0)).repartition(min(len(some), 32), "pair").mapInArrow(finish, "f1 string, f2 string, corr double")
        out = got if out is None else out.unionByName(got)
    return out


def score_predictions(df: DataFrame, keys: tuple[str, ...] = ("model", "fold"), y: str = "y", score: str = "score") -> DataFrame:
    """corr, rmse, mae, mse, r2 and directional accuracy (%) of finite pairs."""
    a, b = finite(F.col(y).cast("double")), finite(F.col(score).cast("double"))
    rows = df.select(*keys, a.alias("_y"), b.alias("_s")).filter("_y is not null and _s is not null")
    d = F.col("_y") - F.col("_s")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), corr(F.col("_y"), F.col("_s")).alias("corr"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("mae"),
        (1 - ratio(F.sum(d * d), F.var_pop("_y") * F.count("*"))).alias("r2"), (F.avg((F.signum("_y") == F.signum("_s")).cast("double")) * 100).alias("directional_accuracy"),
    )


def fold_table(scored: DataFrame, value: str = "corr") -> DataFrame:
    return scored.groupBy("model").pivot("fold", ["train", "val", "test"]).agg(F.first(value))
