"""Window helpers. NULL is the only missing value inside the library; windows count rows, not time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEYS = ("symbol",)


def series(*keys: str, order: str = "ts") -> WindowSpec:
    return Window.partitionBy(*(keys or KEYS)).orderBy(order)


def roll(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def running(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def full(value: Column, x: Column, w: WindowSpec, n: int) -> Column:
    """``value`` where the last n rows of x hold n values."""
    return F.when(F.count(x).over(roll(w, n)) == n, value)


def finite(x: Column) -> Column:
    """x, with NaN and infinities as NULL."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def rolling_mean(x: Column, w: WindowSpec, n: int) -> Column:
    return full(F.avg(x).over(roll(w, n)), x, w, n)


def rolling_std(x: Column, w: WindowSpec, n: int) -> Column:
    """Sample standard deviation of n values."""
    return full(F.stddev_samp(x).over(roll(w, n)), x, w, n)


def clip(x: Column, lo: Column, hi: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(lo, F.least(x, hi)))


def corr(x: Column, y: Column, over: WindowSpec | None = None) -> Column:
    """Pearson correlation of complete pairs; NULL where either does not vary."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    put = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    return ratio(put(F.covar_pop(x, y)), put(F.stddev_pop(x)) * put(F.stddev_pop(y)))


def add_entropy(df: DataFrame, values: str, name: str, bins: int = 20, base: float | None = None, least: int = 5) -> DataFrame:
    """Shannon entropy of an array column's equal-width histogram; the last bin is closed. NULL arrays give NULL.

    In steps, so that bounds and bins are computed once a row and not once an element.
    """
    v, lo, hi, n = F.col(values), F.col("_lo"), F.col("_hi"), F.col("_size")
    width = (hi - lo) / bins
    edge = lambda k: F.when(k == bins, hi).otherwise(lo + k * width)

    def bin_of(x: Column) -> Column:
        k = F.least(F.floor((x - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")
        return F.when(x < edge(k), k - 1).when((x >= edge(k + 1)) & (k != bins - 1), k + 1).otherwise(k)

    df = df.withColumns({"_lo": F.array_min(v), "_hi": F.array_max(v), "_size": F.size(v).cast("double")})
    df = df.withColumn("_ids", F.array_sort(F.when(hi > lo, F.transform(v, bin_of)).otherwise(F.transform(v, lambda x: F.lit(0)))))
    # lengths of the runs of equal bins in the sorted array
    ends = F.filter(F.sequence(F.lit(1), F.size("_ids")), lambda i: (i == F.size("_ids")) | (F.element_at("_ids", i) != F.element_at("_ids", F.least(i + 1, F.size("_ids")))))
    df = df.withColumn("_ends", F.when(F.size("_ids") > 0, ends))
    zero = F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("h"))
    add = lambda acc, e: F.struct(e.alias("at"), (acc["h"] - (e - acc["at"]) / n * F.log((e - acc["at"]) / n)).alias("h"))
    total = F.aggregate("_ends", zero, add, lambda acc: acc["h"])
    df = df.withColumn(name, F.when(n >= least, total / F.log(F.lit(base)) if base else total))
    return df.drop("_lo", "_hi", "_size", "_ids", "_ends")


def add_slope(df: DataFrame, points: list[tuple[float, str]], name: str, least: int = 3) -> DataFrame:
    """Least-squares slope through points (x, column) where the column has a value; NULL if fewer than ``least`` have."""
    add = lambda f: reduce(lambda a, b: a + b, (f(x, F.col(c)) for x, c in points))
    has = lambda y, v: F.when(y.isNotNull(), F.lit(v)).otherwise(0.0)
    df = df.withColumns({"_n": add(lambda x, y: has(y, 1.0)), "_sx": add(lambda x, y: has(y, x)), "_sy": add(lambda x, y: F.coalesce(y, F.lit(0.0))), "_sxx": add(lambda x, y: has(y, x * x)), "_sxy": add(lambda x, y: F.coalesce(y * x, F.lit(0.0)))})
    n, sx, sy, sxx, sxy = map(F.col, ("_n", "_sx", "_sy", "_sxx", "_sxy"))
    return df.withColumn(name, F.when(n >= least, ratio(n * sxy - sx * sy, n * sxx - sx * sx))).drop("_n", "_sx", "_sy", "_sxx", "_sxy")
