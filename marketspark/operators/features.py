"""Targets and the feature matrix. Every block adds columns to bars keyed by (symbol, ts); nothing is joined."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from marketspark.functions.ewm import Ewm, ewm
from marketspark.functions.windows import add_entropy, add_slope, corr, finite, full, ratio, roll, rolling_mean, rolling_std, running, series

LAGS = range(2, 20)
HURST = 100


def W() -> WindowSpec:
    """A symbol's rows in time order."""
    return series()


def positive(close: str = "close") -> Column:
    """log of a price; an error for a price that is not positive."""
    c = F.col(close)
    return F.when(c <= 0, F.raise_error(F.lit("prices must be positive")).cast("double")).otherwise(F.log(c))


def log_return(close: str = "close") -> Column:
    return positive(close) - F.lag(positive(close)).over(W())


def add_targets(bars: DataFrame, vol_span: int = 20) -> DataFrame:
    """log_return, ewma_vol_{span}, y_raw (next return) and y_vol (next return by volatility)."""
    out = bars.withColumn("log_return", log_return()).withColumn("y_raw", F.lead("log_return").over(W()))
    vol = f"ewma_vol_{vol_span}"
    out = ewm(out, [Ewm(vol, "log_return", "std", span=vol_span, least=vol_span)])
    return out.withColumn("y_vol", ratio(F.col("y_raw"), F.col(vol)))


def change(x: str) -> Column:
    return ratio(F.col(x), F.lag(x).over(W())) - 1


def price_block() -> dict[str, Column]:
    o, h, low, c = map(F.col, ("open", "high", "low", "close"))
    return {
        "close_minus_open": c - o, "high_minus_low": h - low, "close_over_open": ratio(c, o), "high_over_low": ratio(h, low),
        "simple_return": change("close"), "log_return": log_return(), "momentum_5d": c - F.lag(c, 5).over(W()),
    }


def technical_block(width: float = 2.0) -> dict[str, Column]:
    """The part that needs no scan; the exponential averages are in :func:`scan_columns`."""
    c = F.col("close")
    mid, std = rolling_mean(c, W(), 20), rolling_std(c, W(), 20)
    lo, hi = F.min("low").over(roll(W(), 14)), F.max("high").over(roll(W(), 14))
    return {
        "sma_10": rolling_mean(c, W(), 10), "sma_20": mid, "bb_middle_20": mid, "bb_upper_20": mid + width * std, "bb_lower_20": mid - width * std,
        "stochastic_k_14": full(full(ratio(c - lo, hi - lo) * 100, F.col("high"), W(), 14), F.col("low"), W(), 14),
    }


def scan_columns() -> list[Ewm]:
    return [*_plain_scan(), Ewm("macd_signal", "_ema_12", minus="_ema_26", span=9, least=9)]


def _plain_scan() -> list[Ewm]:
    return [Ewm("ema_20", "close", span=20, least=20), Ewm("ema_50", "close", span=50, least=50), Ewm("_gain", "_up", alpha=1 / 14, least=14), Ewm("_loss", "_down", alpha=1 / 14, least=14), Ewm("_ema_12", "close", span=12, least=12), Ewm("_ema_26", "close", span=26, least=26)]


def signed_volume(close: str = "close", volume: str = "volume") -> Column:
    """The volume with the sign of the close's change; 0 in the first row. An error for a negative volume."""
    c, v = F.col(close), F.col(volume)
    v = F.when(v < 0, F.raise_error(F.lit("volumes must not be negative")).cast("double")).otherwise(v)
    return F.signum(F.coalesce(c - F.lag(c).over(W()), F.lit(0.0))) * v


def obv(close: str = "close", volume: str = "volume") -> Column:
    return F.sum(signed_volume(close, volume)).over(running(W()))


def on_balance_volume(close: DataFrame, volume: DataFrame, how: str = "inner") -> DataFrame:
    """OBV of two tables (symbol, ts, close) and (symbol, ts, volume), aligned by a join of any kind."""
    if how not in ("inner", "outer", "left", "right"):
        raise ValueError(f"unknown alignment: {how}")
    step = close.join(volume, ["symbol", "ts"], how).withColumn("_s", F.signum(F.coalesce(F.col("close") - F.lag("close").over(W()), F.lit(0.0))))
    return step.select("symbol", "ts", F.sum(F.col("_s") * F.col("volume")).over(running(W())).alias("obv"))


def volume_block(columns: list[str]) -> dict[str, Column]:
    out: dict[str, Column] = {}
    over = lambda x: ratio(F.col(x), rolling_mean(F.col(x), W(), 10))
    if "volume" in columns:
        out |= {"volume_change": change("volume"), "volume_over_avg_10d": over("volume")}
    if "vwap" in columns:
        out |= {"close_minus_vwap": F.col("close") - F.col("vwap"), "close_over_vwap": ratio(F.col("close"), F.col("vwap"))}
    if "trade_count" in columns:
        out |= {"trade_count_change": change("trade_count"), "trade_count_over_avg_10d": over("trade_count")}
    return out


def volatility_block(windows: tuple[int, ...] = (10, 20)) -> dict[str, Column]:
    """Needs the column log_return."""
    c, r, out = F.col("close"), F.col("log_return"), {}
    for n in windows:
        out |= {f"vol_{n}": rolling_std(r, W(), n), f"rolling_std_{n}": rolling_std(c, W(), n), f"rolling_mean_{n}": rolling_mean(c, W(), n)}
    return out | {"z_score_10": ratio(c - rolling_mean(c, W(), 10), rolling_std(c, W(), 10))}


def autocorr(x: Column, lag: int, window: int) -> Column:
    if lag <= 0:
        raise ValueError("lag must be at least 1")
    return full(corr(x, F.lag(x, lag).over(W()), roll(W(), window - lag)), x, W(), window)


def statistical_block() -> dict[str, Column]:
    """Autocorrelations, and what entropy and the Hurst exponent start from. Needs _d2 ... _d19 (differences to earlier closes) and _c1 ... _c3 (earlier closes)."""
    c = F.col("close")
    out = {"_values": full(F.collect_list(c).over(roll(W(), 20)), c, W(), 20), "_rows": F.count(c).over(roll(W(), HURST))}
    for k in LAGS:
        tau = F.stddev_pop(f"_d{k}").over(roll(W(), HURST - k))
        out[f"_t{k}"] = F.when(tau > 0, F.log(tau))
    for k in (1, 2, 3):
        out[f"autocorr_close_{k}_w20"] = full(corr(c, F.col(f"_c{k}"), roll(W(), 20 - k)), c, W(), 20)
    return out


def feature_columns(columns: list[str]) -> list[str]:
    extra = [c for c in (*volume_block(columns),)]
    if "volume" in columns:
        extra.insert(2, "obv")
    return [*price_block(), "sma_10", "sma_20", "ema_20", "ema_50", "rsi_14", "macd", "macd_signal", "macd_histogram", "bb_middle_20", "bb_upper_20", "bb_lower_20", "stochastic_k_14", *extra, *volatility_block(), "entropy_close_20", "hurst_close_100", *(f"autocorr_close_{k}_w20" for k in (1, 2, 3))]


def add_plain_features(bars: DataFrame) -> DataFrame:
    """Bars with all features that windows express: a few selects on one shuffle and sort."""
    c = F.col("close")
    first = bars.withColumns({**price_block(), **{f"_d{k}": c - F.lag(c, k).over(W()) for k in LAGS}, **{f"_c{k}": F.lag(c, k).over(W()) for k in (1, 2, 3)}, **({"obv": obv()} if "volume" in bars.columns and "obv" not in bars.columns else {})})
    out = first.withColumns({**technical_block(), **volume_block(bars.columns), **volatility_block(), **statistical_block()})
    out = add_slope(out, [(math.log(k), f"_t{k}") for k in LAGS], "hurst_close_100").withColumn("hurst_close_100", F.when(F.col("_rows") == HURST, F.col("hurst_close_100")))
    out = add_entropy(out, "_values", "entropy_close_20")
    return out.drop("_values", "_rows", *(f"_{x}{k}" for k in LAGS for x in "dt"), *(f"_c{k}" for k in (1, 2, 3)))


def add_scan_features(df: DataFrame) -> DataFrame:
    """Exponential averages, RSI and MACD, in one grouped scan. Its rows are shuffled again by what follows, so it goes first, over few columns."""
    return finish_scan(ewm(with_moves(df), scan_columns()))


def with_moves(df: DataFrame) -> DataFrame:
    """What RSI starts from: rises and falls of the close."""
    c = F.col("close")
    d = c - F.lag(c).over(W())
    return df.withColumns({"_up": F.when(d.isNotNull(), F.greatest(d, F.lit(0.0))), "_down": F.when(d.isNotNull(), -F.least(d, F.lit(0.0)))})


def finish_scan(scanned: DataFrame) -> DataFrame:
    """MACD and RSI from the scan's columns, which go."""
    out = scanned.withColumn("macd", F.col("_ema_12") - F.col("_ema_26"))
    rs = ratio(F.col("_gain"), F.col("_loss"))
    out = out.withColumn("rsi_14", F.when(rs.isNotNull(), 100 - 100 / (1 + rs))).withColumn("macd_histogram", F.col("macd") - F.col("macd_signal"))
    return out.drop("_up", "_down", "_gain", "_loss", "_ema_12", "_ema_26")


def feature_matrix(bars: DataFrame, lag_days: int = 1, drop_incomplete: bool = True) -> DataFrame:
    """symbol, ts and all features, each of ``lag_days`` before; rows with a gap are dropped."""
    names = feature_columns(bars.columns)
    wide = add_plain_features(add_scan_features(bars))
    value = lambda c: F.lag(finite(F.col(c)), lag_days).over(W()) if lag_days else finite(F.col(c))
    out = wide.select("symbol", "ts", *(value(c).alias(c) for c in names))
    return out.dropna("any") if drop_incomplete else out
