"""Exact quantiles of groups of any size: counts narrow down where the wanted ranks lie, 16 bits of the values at a time.

Doubles become 64-bit integers of the same order. Equal values of a group are counted first, so a frequent one costs a row. A pass counts the
values by the next 16 bits inside the brackets found so far, at most 65,536 rows each, and finds the one that holds each wanted rank; after four passes a bracket is
one value. No group's values meet in one buffer or window.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketspark.sources.scratch import keep

BITS, PASSES = 16, 4


@F.pandas_udf(T.LongType())
def in_order(x: pd.Series) -> pd.Series:
    """Integers in the order of the doubles; both zeros are one, and NaN comes last."""
    v = x.to_numpy(float) + 0.0
    bits = np.where(np.isnan(v), np.nan, v).view(np.int64)
    return pd.Series(bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF)))


def beside(df: DataFrame, other: DataFrame, keys: tuple[str, ...], how: str = "left") -> DataFrame:
    """A join on keys where NULL equals NULL; no hint, so Spark broadcasts ``other`` only below its own threshold."""
    named = other.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *(c for c in other.columns if c not in keys))
    return df.join(named, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], how).drop(*(f"_k_{k}" for k in keys))


def _asked(total: Column, qs: tuple[float, ...]) -> Column:
    at = lambda q, f: f((total - 1) * F.lit(float(q))).cast("long")
    return F.array_distinct(F.array(*(at(q, f) for q in qs for f in (F.floor, F.ceil))))


def quantiles(df: DataFrame, keys: tuple[str, ...], x: str, qs: tuple[float, ...]) -> DataFrame:
    """Keys, ``n`` (values that are not NULL) and ``quantiles``, an array in the order of ``qs``, interpolated between neighbours as ``percentile`` does.

    Groups without a value have no row. NaN counts as the greatest value, NULL keys are a group.
    """
    if not qs or not all(0 <= q <= 1 for q in qs):
        raise ValueError("quantiles lie in 0 ... 1")
    counted = df.select(*keys, (F.col(x).cast("double") + 0.0).alias("_x")).filter("_x is not null").groupBy(*keys, "_x").agg(F.count("*").alias("_c"))
    counted = keep(counted.withColumn("_bits", in_order("_x")), "counted")
    prefix = lambda p: F.shiftright("_bits", 64 - BITS * (p + 1))
    found = None
    for p in range(PASSES):
        if found is None:
            rows, inside = counted, list(keys)
        else:
            rows, inside = beside(counted.withColumn("_bracket", prefix(p - 1)), found, (*keys, "_bracket"), "inner"), [*keys, "_bracket"]
        carried = [] if found is None else [F.first("_asked").alias("_asked"), F.first("n").alias("n")]
        bins = rows.withColumn("_prefix", prefix(p)).groupBy(*inside, "_prefix").agg(F.sum("_c").alias("_c"), F.min("_x").alias("_x"), *carried)
        bins = bins.withColumn("_before", F.sum("_c").over(Window.partitionBy(*inside).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c"))
        if found is None:
            bins = bins.withColumn("n", F.sum("_c").over(Window.partitionBy(*inside)))
            bins = bins.withColumn("_asked", F.transform(_asked(F.col("n"), qs), lambda r: F.struct(r.alias("rank"), r.alias("rest"))))
        here = F.filter("_asked", lambda a: (a["rest"] >= F.col("_before")) & (a["rest"] < F.col("_before") + F.col("_c")))
        bins = bins.withColumn("_asked", F.transform(here, lambda a: F.struct(a["rank"].alias("rank"), (a["rest"] - F.col("_before")).alias("rest")))).filter(F.size("_asked") > 0)
        # a row for each group and wanted rank at most; stored, so that Spark knows its size before it joins
        found = keep(bins.select(*keys, F.col("_prefix").alias("_bracket"), "_asked", "n", "_x"), "brackets")
        if p < PASSES - 1:
            found = found.drop("_x")
    ranks = found.select(*keys, "n", F.explode("_asked.rank").alias("_rank"), "_x").groupBy(*keys, "n").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_x"))).alias("_at"))

    def value(q: float) -> Column:
        h = (F.col("n") - 1) * F.lit(float(q))
        lo, hi = F.floor(h).cast("long"), F.ceil(h).cast("long")
        a, b = F.col("_at")[lo], F.col("_at")[hi]
        return F.when(a == b, a).otherwise((hi - h) * a + (h - lo) * b)

    return ranks.select(*keys, "n", F.array(*map(value, qs)).alias("quantiles"))
