"""Market operators against pandas and NumPy, and the rules they must keep."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketspark.functions.ewm import Ewm, ewm
from marketspark.operators import backtest as bt
from marketspark.operators import checks, datasets, features, metrics, models
from marketspark.sources.bars import normalize_bars

DAY = pd.Timestamp("2020-01-01")


def walk(symbol="a", n=160, seed=0):
    rng = np.random.default_rng(seed)
    c = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    o = c * np.exp(rng.normal(0, 0.01, n))
    return pd.DataFrame({"symbol": symbol, "ts": [DAY + pd.Timedelta(days=i) for i in range(n)], "open": o, "high": np.maximum(o, c) * 1.01, "low": np.minimum(o, c) * 0.99, "close": c, "volume": rng.integers(1, 1000, n).astype(float), "vwap": (o + c) / 2, "trade_count": rng.integers(1, 50, n).astype(float)})


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(pd.concat([walk("a", seed=1), walk("b", 130, seed=2)])).cache()


def column(df, name, symbol="a"):
    return df.filter(F.col("symbol") == symbol).orderBy("ts").toPandas()[name].to_numpy(float)


def test_features_match_pandas(bars):
    p = walk("a", seed=1)
    c = p.close
    x = features.feature_matrix(bars, lag_days=0, drop_incomplete=False).cache()
    gain, loss = c.diff().clip(lower=0), -c.diff().clip(upper=0)
    smooth = lambda s: s.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    ema = lambda s, n: s.ewm(span=n, adjust=False, min_periods=n).mean()
    macd = ema(c, 12) - ema(c, 26)

    def hurst(v):
        tau = [np.std(v[k:] - v[:-k]) for k in range(2, 20)]
        return np.polyfit(np.log(range(2, 20)), np.log(tau), 1)[0]

    def entropy(v):
        q = np.histogram(v, 20)[0]
        q = q[q > 0] / q.sum()
        return -(q * np.log(q)).sum()

    want = {
        "ema_50": ema(c, 50), "rsi_14": 100 - 100 / (1 + smooth(gain) / smooth(loss)), "macd_signal": ema(macd, 9), "macd_histogram": macd - ema(macd, 9),
        "bb_upper_20": c.rolling(20).mean() + 2 * c.rolling(20).std(), "obv": (np.sign(c.diff().fillna(0)) * p.volume).cumsum(), "vol_10": np.log(c).diff().rolling(10).std(),
        "hurst_close_100": c.rolling(100).apply(hurst, raw=True), "entropy_close_20": c.rolling(20).apply(entropy, raw=True), "autocorr_close_2_w20": c.rolling(20).apply(lambda v: np.corrcoef(v[:-2], v[2:])[0, 1], raw=True),
    }
    for name, values in want.items():
        np.testing.assert_allclose(column(x, name), values.to_numpy(float), rtol=1e-8, atol=1e-9, err_msg=name)
    assert x.columns[2:] == features.feature_columns(bars.columns) and len(x.columns) == 40


def test_no_lookahead_and_series_apart(spark, bars):
    whole = features.feature_matrix(bars).cache()
    cut = features.feature_matrix(bars.filter(F.col("ts") < "2020-05-01"))
    a = whole.filter(F.col("ts") < "2020-05-01").orderBy("symbol", "ts").toPandas()
    b = cut.orderBy("symbol", "ts").toPandas()
    pd.testing.assert_frame_equal(a, b, rtol=1e-12)
    alone = features.feature_matrix(bars.filter("symbol = 'b'")).orderBy("ts").toPandas()
    pd.testing.assert_frame_equal(alone, whole.filter("symbol = 'b'").orderBy("ts").toPandas(), rtol=1e-12)


def test_ewm_gaps(spark):
    x = np.random.default_rng(3).normal(size=90)
    gappy = [None if i % 7 == 3 else float(v) for i, v in enumerate(x)]
    df = spark.createDataFrame([("a", i, v, float(w)) for i, (v, w) in enumerate(zip(gappy, x, strict=True))], "symbol string, ts long, x double, y double")
    got = ewm(df, [Ewm("s", "x", "std", span=9, least=5)]).orderBy("ts").toPandas()
    np.testing.assert_allclose(got.s.to_numpy(float), pd.Series(gappy, dtype=float).ewm(span=9, adjust=False, min_periods=5).std(), rtol=1e-12)


def test_cleaning(spark):
    rows = [("2020-01-01", None, 1), ("2020-01-01", "5", 2), ("2020-01-02", "abc", 3), ("2020-01-03", "7", 4), ("never", "8", 5), ("2020-01-04", "NaN", 6)]
    df = spark.createDataFrame([(t, c, c, c, c, c, i) for t, c, i in rows], "Date string, Open string, HIGH string, low string, close string, volume string, seq int")
    assert [str(r.ts)[:10] for r in normalize_bars(df, ("seq",), symbol="s").collect()] == ["2020-01-03"]
    assert [str(r.ts)[:10] for r in normalize_bars(df, symbol="s").orderBy("ts").collect()] == ["2020-01-01", "2020-01-03"]
    with pytest.raises(ValueError):
        normalize_bars(df.drop("volume"))
    with pytest.raises(KeyError):
        normalize_bars(df.drop("Date"))


def test_backtest_and_metrics(spark, bars):
    r = bars.withColumn("lr", features.log_return()).withColumn("y_next", F.expm1(F.lead("lr").over(features.W())))
    scores = r.select("symbol", "ts", F.lit("m").alias("model"), F.col("lr").alias("score"))
    f = bt.backtest(scores, r).cache()
    p = f.filter("symbol = 'a'").orderBy("ts").toPandas()
    s = pd.Series(column(scores, "score"))
    z = (s - s.rolling(60).mean()) / (s.rolling(60).std() + 1e-12)
    y = pd.Series(column(r, "y_next"))
    vol = y.shift(1).ewm(span=20, adjust=False, min_periods=20).std()
    w = (z.clip(-1, 1) * (0.1 / math.sqrt(252) / (vol + 1e-12)).clip(upper=3)).clip(-3, 3)
    keep = z.notna() & w.notna()
    np.testing.assert_allclose(p.weight.to_numpy(float), w[keep].to_numpy(float), rtol=1e-8)
    net = (w * y - (w - w.shift()).abs().fillna(0) * 5e-4)[keep].dropna().to_numpy()
    wealth = 1000 * np.cumprod(1 + net)
    out = metrics.summary(f).filter("symbol = 'a'").first()
    assert math.isclose(out.FinalWealth, wealth[-1], rel_tol=1e-9) and out.n_periods == len(net)
    assert math.isclose(out.Sharpe, net.mean() / net.std() * math.sqrt(252), rel_tol=1e-9)
    assert math.isclose(out.MaxDD, (wealth / np.maximum.accumulate(wealth) - 1).min(), rel_tol=1e-9)
    t = metrics.trades(f).filter("symbol = 'a'").toPandas()
    held = p[p.weight.abs() > 1e-6].net_return.sum()
    assert math.isclose(t.pnl.sum(), held, rel_tol=1e-9)
    for bad in ({"z_window": 4}, {"cost_bps": -1.0}, {"gross_limit": 0.5}):
        with pytest.raises(ValueError):
            bt.backtest(scores, r, **bad)


def test_drawdown_dates_take_the_first_of_ties(spark):
    rets = [0.0, 0.1, -0.5, 0.0, 1.0, -0.5]
    f = spark.createDataFrame([("a", "m", (DAY + pd.Timedelta(days=i)).to_pydatetime(), v) for i, v in enumerate(rets)], "symbol string, model string, ts timestamp, net_return double")
    r = metrics.max_drawdown(f).first()
    assert (r.peak.day, r.trough.day) == (2, 3) and math.isclose(r.MaxDD, -0.5)


def test_ridge_and_selection(spark):
    rng = np.random.default_rng(0)
    n = 600
    x = rng.normal(size=(n, 3))
    x[:, 1] = x[:, 0] * 2 + rng.normal(size=n) * 1e-3
    y = x[:, 0] - 0.5 * x[:, 2] + rng.normal(size=n) * 0.1
    fold = np.where(np.arange(n) < 420, "train", np.where(np.arange(n) < 510, "val", "test"))
    df = spark.createDataFrame(pd.DataFrame({"symbol": "a", "ts": range(n), "fold": fold, "f1": x[:, 0], "f2": x[:, 1], "f3": x[:, 2], "y": y}))
    m = models.ridge(df, ["f1", "f3"], alphas=[0.1, 10.0], refit=False)
    t = fold == "train"
    z = (x[t][:, [0, 2]] - x[t][:, [0, 2]].mean(0)) / x[t][:, [0, 2]].std(0)
    b = np.linalg.solve(z.T @ z + m["best_alpha"] * np.eye(2), z.T @ (y[t] - y[t].mean())) / x[t][:, [0, 2]].std(0)
    np.testing.assert_allclose(list(m["coefficients"].values()), b, rtol=1e-9)
    assert models.prune_redundant(df, ["f1", "f2", "f3"]) == ["f1", "f3"]
    imp = models.permutation_importance(df, ["f1", "f3"], lambda d: models.predict_linear(d, m), repeats=3).collect()
    assert [r.feature for r in imp] == ["f1", "f3"] and imp[1].importance > 0.01


def test_trees_find_the_planted_signal(spark):
    rng = np.random.default_rng(1)
    n = 900
    x = rng.normal(size=(n, 3))
    y = np.where(x[:, 0] > 0, 1.0, -1.0) + 0.2 * x[:, 1] + rng.normal(size=n) * 0.05
    fold = np.where(np.arange(n) < 600, "train", np.where(np.arange(n) < 750, "val", "test"))
    df = spark.createDataFrame(pd.DataFrame({"symbol": "a", "ts": range(n), "fold": fold, "f1": x[:, 0], "f2": x[:, 1], "f3": x[:, 2], "y": y})).cache()
    names = ["f1", "f2", "f3"]
    model, rounds = models.boosted(df, names, rounds=15, step=0.3)
    scored = {r.fold: r for r in datasets.score_predictions(models.predict_trees(df, model, names)).collect()}
    assert 1 < rounds <= 15 and scored["test"]["corr"] > 0.97 and scored["test"].n == 150
    trees = models.forest(df, names, trees=10, depth=6)
    ranked = models.permutation_importance(df, names, lambda d: models.predict_trees(d, trees, names, "forest"), repeats=2).collect()
    assert [r.feature for r in ranked][:2] == ["f1", "f2"] and ranked[0].importance > 0.5 and abs(ranked[2].importance) < 0.02


def test_boosting_stops_by_patience(spark):
    assert models.best_round([3.0, 2.0, 2.5, 2.4, 1.0], 2) == (2, True)
    assert models.best_round([3.0, 2.0, 2.0, 2.0, 1.0], 2) == (2, True)  # an equal error is no gain
    assert models.best_round([3.0, 2.0, 2.5, 1.0], 3) == (4, False) and models.best_round([1.0], 1) == (1, False)
    x = np.random.default_rng(2).normal(size=300)
    df = spark.createDataFrame(pd.DataFrame({"fold": ["train"] * 200 + ["val"] * 100, "f1": x, "y": x}))  # each round helps
    short, n = models.boosted(df, ["f1"], rounds=4, step=0.3, patience=2)
    long, m = models.boosted(df, ["f1"], rounds=8, step=0.3, patience=2)  # fits 4 rounds, then 8
    assert (n, m) == (4, 8)
    assert [t.toDebugString.split("\n", 1)[1] for t in short.trees] == [t.toDebugString.split("\n", 1)[1] for t in long.trees[:4]]
    with pytest.raises(ValueError):
        models.boosted(df, ["f1"], rounds=0)


def test_summary_counts_only_finite_returns(spark):
    rets = [None, -0.5, float("nan"), 1.0, None]
    f = spark.createDataFrame([("a", "m", (DAY + pd.Timedelta(days=i)).to_pydatetime(), v, 1.0, 0.25) for i, v in enumerate(rets)] + [("a", "none", DAY.to_pydatetime(), None, 1.0, 0.0)], "symbol string, model string, ts timestamp, net_return double, turnover double, transaction_cost double")
    rows = {r.model: r for r in metrics.summary(f, start=10.0).collect()}
    assert (rows["m"].n_periods, rows["m"].FinalWealth, rows["m"].MaxDD, rows["m"].TotalCost) == (2, 10.0, 0.0, 1.25)
    assert rows["none"].n_periods == 0 and rows["none"].FinalWealth is None
    assert {(r.Regime, r.Count) for r in metrics.regimes(f.filter("model = 'none'")).collect()} == {("low", 0), ("mid", 0), ("high", 0)}
    flat = f.withColumn("weight", F.lit(0.0))
    assert [(r.Trades, r.MeanPnL_per_trade) for r in metrics.trade_summary(flat).collect()] == [(0, None)] * 2
    with pytest.raises(ValueError):
        metrics.rate_per_period(0.02, 0)


def test_regimes_pass_over_gaps(spark):
    r = np.random.default_rng(8).normal(0, 0.01, 90)
    make = lambda at, v: spark.createDataFrame([("a", "m", (DAY + pd.Timedelta(days=i)).to_pydatetime(), x) for i, x in zip(at, v, strict=True)], "symbol string, model string, ts timestamp, net_return double")
    whole = make(range(90), r.tolist())
    at = [i for i in range(95) if i not in (40, 41, 42, 70, 94)]
    gaps = make(range(95), [r[at.index(i)].item() if i in at else None for i in range(95)])
    rows = lambda f: sorted(map(tuple, metrics.regimes(f).drop("symbol", "model").collect()))
    assert rows(gaps) == rows(whole) and sum(x[-1] for x in rows(gaps)) == 70


def test_penalties_that_are_none_are_left_out(spark):
    x = np.random.default_rng(0).normal(size=60)
    df = spark.createDataFrame(pd.DataFrame({"fold": ["train"] * 40 + ["val"] * 20, "f1": x, "y": x * 2}))
    assert models.ridge(df, ["f1"], alphas=[0.0, -1.0, float("inf"), 0.5])["best_alpha"] == 0.5
    with pytest.raises(ValueError):
        models.ridge(df, ["f1"], alphas=[0.0, -1.0])


def test_reports_run_the_backtest_once(spark):
    bars = spark.createDataFrame(walk(n=70))
    r = bars.withColumn("lr", features.log_return()).withColumn("y_next", F.expm1(F.lead("lr").over(features.W())))
    f = bt.backtest(r.select("symbol", "ts", F.lit("m").alias("model"), F.col("lr").alias("score")), r)
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInPandas")
    assert [scans(x) for x in (metrics.summary(f), metrics.regimes(f), metrics.trade_summary(f), features.feature_matrix(bars))] == [1, 1, 1, 1]
    plain = bt.backtest(r.select("symbol", "ts", F.lit("m").alias("model"), F.col("lr").alias("score")), r, use_vol_targeting=False)
    assert scans(metrics.summary(plain)) == 0 and plain.filter("asset_volatility is not null").count() == 0
    assert scans(metrics.summary(bt.with_benchmark(f, r))) == 1


def test_checks_find_planted_leak(spark, bars):
    x = bars.withColumn("leak", F.lead("close", 2).over(features.W())).select("symbol", "ts", "open", "leak").dropna()
    found = checks.future_fields(x, bars, ["open", "leak"], ["open", "close"]).collect()
    assert [r.subject for r in found] == ["leak = close + 2"]
    with pytest.raises(ValueError):
        checks.raise_on_failure(checks.same_keys(x, bars))


def test_split_and_sequences(bars):
    f = datasets.chronological(bars)
    n = {(r.symbol, r.fold): r["count"] for r in f.groupBy("symbol", "fold").count().collect()}
    assert n["a", "train"] == 112 and n["a", "val"] == 24 and n["a", "test"] == 24
    assert datasets.sequences(f, ["close"], "close", 10).filter("symbol = 'a' and fold = 'val'").count() == 14


def test_results_are_stored(spark, tmp_path):
    from marketspark.sources.results import read_features, read_results, write_features, write_results

    rows = spark.createDataFrame([("A", "ridge", 1.0), ("A", "boosted", 2.0)], "symbol string, model string, score double")
    write_results(rows, f"{tmp_path}/scores")
    assert [tuple(r) for r in read_results(spark, f"{tmp_path}/scores", ["ridge"]).select("symbol", "model", "score").collect()] == [("A", "ridge", 1.0)]
    write_features(spark, ["b", "a", "c"], f"{tmp_path}/features")
    assert read_features(spark, f"{tmp_path}/features") == ["b", "a", "c"]


def test_numeric_columns(spark):
    from marketspark.sources.bars import numeric_columns, select_numeric

    df = spark.createDataFrame([("a", 1, 2.0, "x", True)], "symbol string, ts long, `a.b` double, s string, flag boolean").withColumn("d", F.lit(1).cast("decimal(9,2)"))
    assert numeric_columns(df) == ["ts", "a.b", "d"] and numeric_columns(df, ["d", "S", "s", "a.b", "none", "d"]) == ["d", "a.b"]
    assert select_numeric(df, ["d", "a.b", "ts"]).columns == ["symbol", "ts", "d", "a.b"] and select_numeric(df, []).columns == ["symbol", "ts"]
