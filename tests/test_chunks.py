"""Long series in forced small chunks, against pandas and the window forms."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketspark.functions import chunks
from marketspark.functions.ewm import Ewm
from marketspark.operators import features, longseries, metrics

from .test_market import DAY, walk


def gappy(n=400, seed=3, share=0.3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n)
    x[rng.random(n) < share] = np.nan
    x[:7] = np.nan
    x[100:160] = np.nan  # whole chunks without a value
    return x


@pytest.fixture(scope="module")
def table(spark):
    both = [("a", i, float(v)) for i, v in enumerate(gappy())] + [("b", i, float(v)) for i, v in enumerate(gappy(90, 4, 0.0))] + [("none", i, math.nan) for i in range(30)]
    df = spark.createDataFrame(both, "symbol string, ts long, x double").withColumn("x", F.when(~F.isnan("x"), F.col("x"))).repartition(5)
    return chunks.number_rows(df).cache()


def test_rows_are_numbered(table):
    assert table.filter("_i <> ts").count() == 0 and table.count() == 520


@pytest.mark.parametrize("size", [1, 13, 50, 1000])
@pytest.mark.parametrize("span", [1, 9, 200])
def test_states_merge(size, span):
    x, a = gappy(), 2 / (span + 1)
    want = chunks.walk(x, a, chunks.State())[-1].list()
    at = chunks.State()
    for lo in range(0, len(x), size):
        at = chunks.merge(at, chunks.summary(x[lo : lo + size], a), a)
    np.testing.assert_allclose(at.list(), want, rtol=1e-9, atol=1e-15)


@pytest.mark.parametrize("size", [13, 50])
def test_ewm_with_gaps(table, size):
    cols = [Ewm("m", "x", span=9, least=5), Ewm("s", "x", "std", span=20, least=3), Ewm("later", "m", minus="x", alpha=0.2, least=2), Ewm("one", "x", "std", span=5)]
    got = chunks.ewm_chunks(table, cols, size).toPandas().sort_values(["symbol", "ts"])
    for symbol in ("a", "b", "none"):
        p = got[got.symbol == symbol]
        e = lambda v, **k: v.astype(float).ewm(adjust=False, **k)
        m = e(p.x, span=9, min_periods=5).mean()
        for name, want in (("m", m), ("s", e(p.x, span=20, min_periods=3).std()), ("later", e(m - p.x, alpha=0.2, min_periods=2).mean()), ("one", e(p.x, span=5).std())):
            np.testing.assert_allclose(p[name].to_numpy(float), want.to_numpy(float), rtol=1e-5 if name == "one" else 1e-9, err_msg=f"{symbol} {name}")  # pandas loses digits of one after the long gap


def test_running(table):
    got = chunks.running(table, {"total": ("sum", "x"), "n": ("count", "x"), "hi": ("max", "x"), "lo": ("min", "x"), "grown": ("product", 1 + F.col("x") / 10)}, 17).toPandas().sort_values(["symbol", "ts"])
    for symbol in ("a", "b", "none"):
        p = got[got.symbol == symbol]
        x = p.x.astype(float)
        for name, want in (("total", x.cumsum().ffill()), ("hi", x.cummax().ffill()), ("lo", x.cummin().ffill()), ("grown", (1 + x / 10).cumprod().ffill()), ("n", x.notna().cumsum())):
            np.testing.assert_allclose(p[name].to_numpy(float), want.to_numpy(float), rtol=1e-9, err_msg=f"{symbol} {name}")


@pytest.mark.parametrize(("size", "window", "least"), [(13, 30, None), (50, 7, 3), (1000, 20, 1)])
def test_rolling_apply(table, size, window, least):
    def spread(w):
        assert w.shape[1] == window
        return np.nanmax(w, axis=1) - np.nanmin(w, axis=1)

    got = chunks.rolling_apply(table, "x", "y", window, spread, least, size).toPandas().sort_values(["symbol", "ts"])
    assert len(got) == 520
    for symbol in ("a", "b", "none"):
        p = got[got.symbol == symbol]
        r = p.x.astype(float).rolling(window, min_periods=least)
        np.testing.assert_allclose(p.y.to_numpy(float), (r.max() - r.min()).to_numpy(float), rtol=1e-12)
    with pytest.raises(ValueError):
        chunks.rolling_apply(table, "x", "y", 5, spread, 6)


def test_feature_matrix_in_chunks(spark):
    bars = spark.createDataFrame(pd.concat([walk("a", 330, seed=1), walk("b", 130, seed=2)]))
    want = features.feature_matrix(bars).orderBy("symbol", "ts").toPandas()
    got = longseries.feature_matrix(bars, size=40).orderBy("symbol", "ts").toPandas()
    pd.testing.assert_frame_equal(got, want, rtol=1e-9)
    plain = longseries.feature_matrix(bars.drop("volume", "vwap", "trade_count"), lag_days=0, drop_incomplete=False, size=1000)
    assert plain.count() == 460 and "obv" not in plain.columns


def test_wealth_and_trades_in_chunks(spark):
    rng = np.random.default_rng(0)
    r = rng.choice([0.0, 1.0, -0.5], 120)  # exact products, so ties of peaks and troughs
    r[60] = -1.5  # a loss beyond all
    weight = np.repeat(rng.choice([0.0, 1.0, -1.0, 1e-6], 24), 5)
    rows = [("a", m, (DAY + pd.Timedelta(days=i)).to_pydatetime(), None if i % 11 == 5 else float(v), float(w)) for m in ("m", "n") for i, (v, w) in enumerate(zip(r if m == "m" else r[::-1], weight, strict=True))]
    f = spark.createDataFrame(rows, "symbol string, model string, ts timestamp, net_return double, weight double")
    same = lambda a, b: pd.testing.assert_frame_equal(*(x.orderBy(*x.columns[:3]).toPandas() for x in (a, b)), rtol=1e-9)
    cols = ["symbol", "model", "ts", "wealth", "peak", "peak_ts", "drawdown"]
    for log in (False, True):
        same(longseries.with_wealth(f, start=5.0, log=log, size=7).select(*cols), metrics.with_wealth(f, start=5.0, log=log).select(*cols))
    same(longseries.max_drawdown(f, size=7), metrics.max_drawdown(f))
    same(longseries.trades(f, size=3), metrics.trades(f))
    assert metrics.trades(f.withColumn("weight", F.lit(1e-6))).count() == 2  # the threshold itself is a side
    assert metrics.attribution(f.withColumn("weight", F.lit(-1e-6))).first().Days_short > 100


def test_a_long_series_has_many_tasks(spark):
    """One series, no window or group over it: rows of a chunk at most meet in a task."""
    df = spark.range(100_000).select(F.lit("a").alias("symbol"), F.col("id").alias("ts"), F.sin("id").alias("x"))
    out = chunks.running(chunks.number_rows(df), {"total": ("sum", "x")}, 5_000)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_chunk" in plan and all("_chunk" in line or "sum(_n" in line or "_b_" in line for line in plan.splitlines() if "Window [" in line)
    assert math.isclose(out.agg(F.max("_i")).first()[0], 99_999) and math.isclose(out.filter("ts = 99999").first().total, float(np.sin(np.arange(100_000)).sum()), rel_tol=1e-6)
