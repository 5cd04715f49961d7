"""Series of any length, cut into chunks, so that one long series uses all cores.

:func:`number_rows` gives each row its place in its series: rows are range-partitioned by key and time and written, a partition's run of
a series is counted, and the counts are summed from left to right; no series is ever in one window. A chunk is ``size`` places.

* :func:`in_chunks` copies the rows that a chunk's windows look back (or ahead) to from its neighbours, and makes chunks look like series:
  any operator on series runs on them as it is. :func:`out_of_chunks` drops the copies.
* :func:`running` carries sums, products, counts and extremes over chunks: a state a chunk, a prefix over the states, a second pass.
* :func:`ewm_chunks` does the same for exponentially weighted means and deviations, with gaps.
* :func:`rolling_apply` runs a caller's function on all windows of a column.

Times must be unique in a series. NULL is a gap.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketspark.functions.ewm import Ewm
from marketspark.sources.scratch import keep

#: Rows of a chunk.
SIZE = 250_000


def number_rows(df: DataFrame, keys: tuple[str, ...] = ("symbol",), order: str = "ts") -> DataFrame:
    """``df`` with ``_i``, a row's place in its series from 0."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = keep(df.repartitionByRange(parts, *keys, order).sortWithinPartitions(*keys, order).withColumn("_id", F.monotonically_increasing_id()), "numbered")
    placed = placed.withColumn("_part", F.shiftright("_id", 33))
    runs = placed.groupBy(*keys, "_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))  # a row for each partition and series in it
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_n")
    runs = runs.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_part").alias("_k_part"), (before - F.col("_first")).alias("_shift"))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_part") == F.col("_k_part")]
    return placed.join(runs, same).withColumn("_i", F.col("_id") + F.col("_shift")).drop("_id", "_part", "_shift", "_k_part", *(f"_k_{k}" for k in keys))


def chunk_of(i: Column, size: int) -> Column:
    return F.floor(i / size).cast("long")


def in_chunks(numbered: DataFrame, size: int = SIZE, before: int = 0, ahead: int = 0, key: str = "symbol") -> DataFrame:
    """Chunks as series: ``key`` becomes (key, chunk), and each chunk has copies of the ``before`` rows before it and the ``ahead`` rows after it.

    Windows of up to ``before`` + 1 rows are the same as over the whole series, in rows where ``_own`` is true.
    """
    first, last = chunk_of(F.greatest(F.col("_i") - ahead, F.lit(0)), size), chunk_of(F.col("_i") + before, size)
    dealt = numbered.withColumn("_chunk", F.explode(F.sequence(first, last)))
    return dealt.withColumns({"_own": F.col("_chunk") == chunk_of(F.col("_i"), size), key: F.struct(F.col(key).alias("of"), F.col("_chunk").alias("chunk"))}).drop("_chunk")


def out_of_chunks(df: DataFrame, key: str = "symbol") -> DataFrame:
    return df.filter("_own").withColumn(key, F.col(f"{key}.of")).drop("_own")


def over_chunks(numbered: DataFrame, make: Callable[[DataFrame], DataFrame], size: int = SIZE, before: int = 0, ahead: int = 0) -> DataFrame:
    """``make`` on chunks that see so many rows before and ahead; its result is that on whole series."""
    return out_of_chunks(make(in_chunks(numbered, size, before, ahead)))


_MERGE: dict[str, tuple[Callable, Callable]] = {
    "sum": (F.sum, lambda a, b: a + b), "count": (F.count, lambda a, b: a + b), "product": (F.product, lambda a, b: a * b),
    "max": (F.max, F.greatest), "min": (F.min, F.least),
}


def running(numbered: DataFrame, columns: dict[str, tuple[str, str | Column]], size: int = SIZE, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Columns name: (kind, values) of running sums, counts, products, maxima and minima up to each row; missing values are passed over."""
    df = numbered.withColumn("_chunk", chunk_of(F.col("_i"), size))
    kinds = {name: _MERGE[kind] for name, (kind, _) in columns.items()}
    df = df.withColumns({f"_x_{name}": F.col(x) if isinstance(x, str) else x for name, (_, x) in columns.items()})
    states = df.groupBy(*keys, "_chunk").agg(*(agg(F.col(f"_x_{name}")).alias(f"_s_{name}") for name, (agg, _) in kinds.items()))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row a chunk
    total = {name: F.sum if agg is F.count else agg for name, (agg, _) in kinds.items()}
    states = states.select(*keys, "_chunk", *(total[name](F.col(f"_s_{name}")).over(earlier).alias(f"_b_{name}") for name in kinds))
    here = Window.partitionBy(*keys, "_chunk").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    inside = df.withColumns({name: agg(F.col(f"_x_{name}")).over(here) for name, (agg, _) in kinds.items()})
    both = inside.join(states, [*keys, "_chunk"])
    carried = {name: F.when(F.col(f"_b_{name}").isNull(), F.col(name)).when(F.col(name).isNull(), F.col(f"_b_{name}")).otherwise(put(F.col(f"_b_{name}"), F.col(name))) for name, (_, put) in kinds.items()}
    return both.withColumns(carried).select(*numbered.columns, *columns)


# ---- exponentially weighted


def affine(b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """x[i] = b[i] x[i - 1] + c[i] for b[0] = 0 and 0 <= b < 1, by doubling; stops where what is left of earlier values is nothing."""
    b, c, shift = b.copy(), c.copy(), 1
    while shift < len(b) and b[shift:].max() > 1e-40:
        c[shift:] += b[shift:] * c[:-shift]
        b[shift:] = b[shift:] * b[:-shift]
        shift *= 2
    return c


class State:
    """What an exponentially weighted series leaves behind: mean, biased variance, 1 less the sum of squared weights, observations, missing rows since the last one."""

    def __init__(self, m: float = np.nan, v: float = 0.0, s: float = 0.0, n: float = 0, t: float = 0):
        self.m, self.v, self.s, self.n, self.t = m, v, s, n, t

    def list(self) -> list[float]:
        return [self.m, self.v, self.s, float(self.n), float(self.t)]


def step(a: float, missing: float | np.ndarray) -> tuple:
    """Weights of the old mean and of a new value after so many missing rows."""
    old = (1 - a) ** (missing + 1)
    return old / (old + a), a / (old + a)


def walk(x: np.ndarray, a: float, start: State) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, State]:
    """Means, variances, 1 less sums of squared weights and observations so far at each row, and what is left behind. NaN is a gap."""
    at = np.flatnonzero(~np.isnan(x))
    if not len(at):
        hold = lambda v: np.full(len(x), v)
        return hold(start.m), hold(start.v), hold(start.s), hold(start.n), State(start.m, start.v, start.s, start.n, start.t + len(x))
    xs, fresh = x[at], start.n == 0
    beta, alpha = step(a, np.concatenate([[at[0] + start.t], np.diff(at) - 1.0]))
    decay = np.concatenate([[0.0], beta[1:]])
    new = alpha * xs
    new[0] = xs[0] if fresh else beta[0] * start.m + alpha[0] * xs[0]
    m = affine(decay, new)
    new = alpha * beta * (xs - np.concatenate([[xs[0] if fresh else start.m], m[:-1]])) ** 2
    new[0] = 0.0 if fresh else new[0] + beta[0] * start.v
    v = affine(decay, new)
    new = 2 * alpha * beta  # not 1 less a sum: after a long gap nothing would be left of its digits
    new[0] = 0.0 if fresh else new[0] + beta[0] ** 2 * start.s
    s = affine(decay**2, new)
    seen = np.cumsum(~np.isnan(x))
    spread = lambda y, first: np.concatenate([[first], y])[seen]
    end = State(m[-1], v[-1], s[-1], start.n + len(at), len(x) - 1 - at[-1])
    return spread(m, start.m), spread(v, start.v), spread(s, start.s), start.n + seen, end


def summary(x: np.ndarray, a: float) -> list[float]:
    """A chunk's state: observations, missing rows before the first, the first, weight left of it, its end on its own, rows."""
    at = np.flatnonzero(~np.isnan(x))
    if not len(at):
        return [0.0] * 8 + [float(len(x))]
    *_, end = walk(x, a, State())
    left = float(step(a, np.diff(at) - 1.0)[0].prod())
    return [float(len(at)), float(at[0]), float(x[at[0]]), left, end.m, end.v, end.s, end.t, float(len(x))]


def merge(before: State, chunk: list[float], a: float) -> State:
    """The state after a chunk, from that before it and the chunk's own."""
    n, lead, x, left, m, v, s, t, rows = chunk
    if not n:
        return State(before.m, before.v, before.s, before.n, before.t + rows)
    if not before.n:
        return State(m, v, s, n, t)
    beta, alpha = step(a, before.t + lead)
    m1, v1, s1 = beta * before.m + alpha * x, beta * before.v + alpha * beta * (x - before.m) ** 2, beta**2 * before.s + 2 * alpha * beta
    if n == 1:
        return State(m1, v1, s1, before.n + 1, t)
    rest = (m - left * x) / (1 - left)  # of the chunk's values but the first
    v = v - left * (1 - left) * (x - rest) ** 2
    return State(m + left * (m1 - x), max(0.0, left * v1 + v + left * (1 - left) * (m1 - rest) ** 2), s + left**2 * s1, before.n + n, t)


def ewm_chunks(numbered: DataFrame, columns: list[Ewm], size: int = SIZE, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The columns of :func:`marketspark.functions.ewm.ewm` for series of any length, gaps included.

    Columns that build on others of the list follow in a further round; all columns of a round share its two passes.
    """
    names = {c.name for c in columns}
    now = [c for c in columns if not {c.x, c.minus} & names]
    later = [c for c in columns if c not in now]
    if not now:
        raise ValueError("columns build on each other in a circle")
    df = numbered.withColumn("_chunk", chunk_of(F.col("_i"), size))
    kinds = T.StructType([*(df.schema[k] for k in keys), T.StructField("_chunk", T.LongType()), T.StructField("_state", T.ArrayType(T.DoubleType()))])

    def values(pdf: pd.DataFrame, c: Ewm) -> np.ndarray:
        x = pdf[c.x].to_numpy(float)
        return x if c.minus is None else x - pdf[c.minus].to_numpy(float)

    def end(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        out = pdf[[*keys, "_chunk"]].iloc[:1].copy()
        out["_state"] = [[y for c in now for y in summary(values(pdf, c), c.a)]]
        return out

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_chunk").reset_index(drop=True)
        at, out = [State() for _ in now], []
        for state in pdf["_state"]:
            out.append([y for s in at for y in s.list()])
            at = [merge(s, list(state[9 * i : 9 * i + 9]), c.a) for i, (s, c) in enumerate(zip(at, now, strict=True))]
        pdf["_state"] = out
        return pdf

    def run(pdf: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        state = states["_state"].iloc[0]
        for i, c in enumerate(now):
            m, v, s, n, _ = walk(values(pdf, c), c.a, State(*state[5 * i : 5 * i + 5]))
            with np.errstate(invalid="ignore", divide="ignore"):
                out = m if c.kind == "mean" else np.where(n > 1, np.sqrt(v / s), np.nan)
            pdf[c.name] = np.where(n >= max(c.least, 1), out, np.nan)
        return pdf.drop(columns="_chunk")

    need = [x for c in now for x in (c.x, c.minus) if x]
    states = df.select(*keys, "_i", "_chunk", *dict.fromkeys(need)).groupBy(*keys, "_chunk").applyInPandas(end, kinds)
    before = states.groupBy(*keys).applyInPandas(carry, kinds)
    schema = T.StructType([*numbered.schema.fields, *(T.StructField(c.name, T.DoubleType()) for c in now)])
    out = df.groupBy(*keys, "_chunk").cogroup(before.groupBy(*keys, "_chunk")).applyInPandas(run, schema)
    out = out.select(*numbered.columns, *(F.when(~F.isnan(c.name), F.col(c.name)).alias(c.name) for c in now))
    return ewm_chunks(keep(out, "ewm"), later, size, keys) if later else out


# ---- a caller's own function


def rolling_apply(numbered: DataFrame, x: str, name: str, window: int, function: Callable[[np.ndarray], np.ndarray], least: int | None = None, size: int = SIZE, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """``name``: the function's value for the last ``window`` rows of ``x``, where they hold ``least`` values (all, if not given).

    The function gets a matrix, a row for each window with its values in time order and NaN for gaps (and before the series), and returns
    a number a row; NaN becomes NULL. It is called for some thousand windows at a time, and only for those with enough values.
    """
    least = window if least is None else least
    if window < 1 or not 0 < least <= window:
        raise ValueError("window >= least >= 1")
    schema = T.StructType([*numbered.schema.fields, T.StructField(name, T.DoubleType())])
    dealt = numbered.withColumn("_chunk", F.explode(F.sequence(chunk_of(F.col("_i"), size), chunk_of(F.col("_i") + (window - 1), size))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        values = np.concatenate([np.full(window - 1, np.nan), pdf[x].to_numpy(float)])
        views, out = np.lib.stride_tricks.sliding_window_view(values, window), np.full(len(pdf), np.nan)
        for lo in range(0, len(pdf), 8192):
            some = views[lo : lo + 8192]
            use = np.flatnonzero((~np.isnan(some)).sum(1) >= least)
            if len(use):
                out[lo + use] = function(some[use])
        own = (pdf["_i"] // size == pdf["_chunk"]).to_numpy()
        return pdf.assign(**{name: out})[own].drop(columns="_chunk")

    made = dealt.groupBy(*keys, "_chunk").applyInPandas(run, schema)
    return made.withColumn(name, F.when(~F.isnan(name), F.col(name)))
