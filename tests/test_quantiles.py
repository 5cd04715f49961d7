"""Selection by counts against sorting."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketspark.functions.quantiles import in_order, quantiles
from marketspark.operators import datasets, longseries, metrics

QS = (0.0, 0.25, 1 / 3, 0.5, 0.9, 1.0)


def test_equal_to_sorting(spark):
    rng = np.random.default_rng(2)
    groups = {
        "normal": rng.normal(size=501), "far apart": np.concatenate([rng.normal(size=50) * 10.0 ** rng.integers(-300, 300, 50), [0.0, -0.0]]),
        "ties": np.repeat([7.5, -1.0, 7.5000000001], [300, 200, 1]), "one": np.array([3.0]), "two": np.array([-1e-310, 5e300]), "near": 1000 + rng.integers(0, 9, 99) * 2.0**-43, None: rng.normal(size=20),
    }
    rows = [(k, float(v)) for k, values in groups.items() for v in values] + [("none", None)] * 3 + [("one", None)]
    got = {r.g: r for r in quantiles(spark.createDataFrame(rows, "g string, x double").repartition(5), ("g",), "x", QS).collect()}
    assert got.keys() == groups.keys()
    for k, values in groups.items():
        assert got[k].n == len(values)
        np.testing.assert_allclose(got[k].quantiles, np.quantile(values, QS), rtol=1e-13, err_msg=str(k))


def test_equal_to_percentile_and_no_rows(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 11 > 0, F.round(F.randn(4), 2)).alias("x"))
    df = df.union(spark.createDataFrame([(2, float("nan")), (2, float("inf")), (2, float("-inf"))], "g long, x double")).persist()
    want = {r.g: r.p for r in df.groupBy("g").agg(F.percentile("x", F.array(*map(F.lit, QS))).alias("p")).collect()}
    got = {r.g: r.quantiles for r in quantiles(df, ("g",), "x", QS).collect()}
    for g in want:
        np.testing.assert_allclose(got[g], want[g], rtol=1e-12)
    df.unpersist()
    assert quantiles(df.filter("false"), ("g",), "x", QS).count() == 0
    with pytest.raises(ValueError):
        quantiles(df, ("g",), "x", (1.5,))


def test_bits_keep_the_order():
    x = np.sort(np.concatenate([np.random.default_rng(0).normal(size=100) * 1e200, [-np.inf, np.inf, 0.0, 5e-324, -5e-324]]))
    bits = in_order.func(pd.Series(np.append(x, np.nan)))
    assert (np.diff(bits.to_numpy()) > 0).all()
    assert in_order.func(pd.Series([0.0])).equals(in_order.func(pd.Series([-0.0])))


def test_describe_keeps_columns_without_values(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 2.0, None)], "symbol string, x double, y double")
    assert {(r.column, r.n, r.q50) for r in datasets.describe(df, ["x", "y"]).collect()} == {("x", 2, 1.5), ("y", 0, None)}


def test_long_forms_equal_the_window_forms(spark):
    rng = np.random.default_rng(5)
    n = 260
    parts = [pd.DataFrame({"symbol": s, "model": "m", "ts": pd.date_range("2020-01-01", periods=n), "weight": np.round(rng.normal(size=n) * 0.7), "net_return": np.where(rng.random(n) < 0.1, np.nan, rng.normal(size=n) * 0.01)}) for s in ("a", "b")]
    parts[1].loc[:, "weight"] = 0.0
    flat = parts[0].assign(symbol="c", net_return=np.nan)
    f = spark.createDataFrame(pd.concat([*parts, flat])).repartition(3)
    key = lambda rows: sorted(map(repr, rows))
    plain = lambda df: key(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(sorted(df.columns)).collect())
    assert plain(longseries.trade_summary(f, size=17)) == plain(metrics.trade_summary(f))
    assert plain(longseries.regimes(f, size=17)) == plain(metrics.regimes(f))
    assert plain(longseries.regimes(f, cuts=(0.009, 0.011), size=50)) == plain(metrics.regimes(f, cuts=(0.009, 0.011)))
