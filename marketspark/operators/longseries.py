"""Feature matrix, backtest frames, wealth, trades and regimes of series too long for one task. Results equal those of the window forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketspark.functions.chunks import SIZE, ewm_chunks, number_rows, over_chunks, running
from marketspark.functions.quantiles import beside, quantiles
from marketspark.functions.windows import finite, roll
from marketspark.operators import features, metrics
from marketspark.sources.scratch import keep


def feature_matrix(bars: DataFrame, lag_days: int = 1, drop_incomplete: bool = True, size: int = SIZE) -> DataFrame:
    """As :func:`features.feature_matrix`, in chunks of ``size`` rows."""
    names = features.feature_columns(bars.columns)

    def steps(df: DataFrame) -> DataFrame:
        df = features.with_moves(df)
        return df.withColumn("_signed", features.signed_volume()) if "volume" in df.columns else df

    rows = over_chunks(number_rows(bars), steps, size, before=1)
    if "volume" in bars.columns:
        rows = running(rows, {"obv": ("sum", "_signed")}, size).drop("_signed")
    rows = keep(features.finish_scan(ewm_chunks(rows, features.scan_columns(), size)), "scanned")
    value = lambda c: (F.lag(finite(F.col(c)), lag_days).over(features.W()) if lag_days else finite(F.col(c))).alias(c)
    out = over_chunks(rows, lambda df: features.add_plain_features(df).select("symbol", "ts", "_own", *map(value, names)), size, before=features.HURST + lag_days)
    return out.dropna("any") if drop_incomplete else out


def with_wealth(frame: DataFrame, keys: tuple[str, ...] = metrics.KEYS, returns: str = "net_return", start: float = 1.0, log: bool = False, size: int = SIZE) -> DataFrame:
    """As :func:`metrics.with_wealth` without gaps: finite returns with wealth, its running peak, the peak's first date and drawdown."""
    if start <= 0:
        raise ValueError("start must be positive")
    rows = number_rows(frame.withColumn("_r", finite(F.col(returns).cast("double"))).filter("_r is not null"), keys)
    rows = running(rows, {"_grown": ("sum", "_r") if log else ("product", 1 + F.col("_r"))}, size, keys)
    rows = rows.withColumn("wealth", start * (F.exp("_grown") if log else F.col("_grown")))
    rows = running(rows, {"_top": ("max", F.struct(F.col("wealth").alias("w"), (-F.unix_micros(F.col("ts").cast("timestamp"))).alias("t")))}, size, keys)
    return rows.withColumns({"peak": F.col("_top.w"), "peak_ts": F.timestamp_micros(-F.col("_top.t")), "drawdown": F.col("wealth") / F.col("_top.w") - 1}).drop("_top", "_grown", "_i")


def max_drawdown(frame: DataFrame, keys: tuple[str, ...] = metrics.KEYS, returns: str = "net_return", size: int = SIZE) -> DataFrame:
    return with_wealth(frame, keys, returns, size=size).groupBy(*keys).agg(*(c.alias(n) for n, c in metrics.worst().items()))


def _with_trades(frame: DataFrame, weight: str, least: float, size: int) -> DataFrame:
    """Rows with ``side`` and ``trade_id``, the number of trades begun so far."""
    side = F.when(F.abs(F.col(weight)) >= least, F.signum(weight)).otherwise(0).cast("int")

    def starts(df: DataFrame) -> DataFrame:
        before = F.coalesce(F.lag("side").over(Window.partitionBy(*metrics.KEYS).orderBy("ts")), F.lit(0))
        return df.withColumn("_new", ((F.col("side") != 0) & (F.col("side") != before)).cast("long"))

    rows = over_chunks(number_rows(frame.withColumn("side", side), metrics.KEYS), starts, size, before=1)
    return running(rows, {"trade_id": ("sum", "_new")}, size, metrics.KEYS)


def trades(frame: DataFrame, weight: str = "weight", returns: str = "net_return", least: float = 1e-6, size: int = SIZE) -> DataFrame:
    """As :func:`metrics.trades`: a trade's rows may lie in any number of chunks."""
    return metrics.finish_trades(_with_trades(frame, weight, least, size), returns)


def trade_summary(frame: DataFrame, weight: str = "weight", returns: str = "net_return", least: float = 1e-6, size: int = SIZE) -> DataFrame:
    """As :func:`metrics.trade_summary`, for any number of trades: the median is selected by counts."""
    by_trade = keep(metrics.of_trades(_with_trades(frame, weight, least, size), returns), "trades")
    median = quantiles(by_trade.filter("trade_id is not null and n_days > 0"), metrics.KEYS, "pnl", (0.5,))
    median = median.select(*metrics.KEYS, F.col("quantiles")[0].alias("MedianPnL_per_trade"))
    return beside(by_trade.groupBy(*metrics.KEYS).agg(*metrics.trade_results()), median, metrics.KEYS)


def regimes(frame: DataFrame, window: int = 20, cuts: tuple[float, float] | None = None, periods: int = metrics.YEAR, size: int = SIZE) -> DataFrame:
    """As :func:`metrics.regimes`: volatility and wealth in chunks, thirds selected by counts."""
    keys, values = metrics.KEYS, ("CAGR", "Sharpe", "MaxDD", "Count")
    rows = keep(frame.select(*keys, "ts", finite(F.col("net_return").cast("double")).alias("net_return")), "returns")

    def volatility(df: DataFrame) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy("ts")
        df = df.withColumn("_p", F.lag("net_return").over(w))
        return df.withColumn("_v", F.when(F.count("_p").over(roll(w, window)) == window, F.stddev_samp("_p").over(roll(w, window)))).drop("_p")

    seen = keep(over_chunks(number_rows(rows.filter("net_return is not null"), keys), volatility, size, before=window).drop("_i"), "volatility").filter("_v is not null")
    if cuts is None:
        seen = beside(seen, quantiles(seen, keys, "_v", (1 / 3, 2 / 3)).drop("n"), keys)
    else:
        seen = seen.withColumn("quantiles", F.array(*map(F.lit, cuts)))
    v, lo, hi = F.col("_v"), F.col("quantiles")[0], F.col("quantiles")[1]
    seen = seen.select(*keys, "ts", "net_return", F.when(v <= lo, "low").when(v <= hi, "mid").otherwise("high").alias("Regime"))
    r = F.col("_r")
    got = with_wealth(seen, (*keys, "Regime"), size=size).groupBy(*keys, "Regime").agg(metrics.annualized_return(r, periods).alias("CAGR"), metrics.sharpe(r, 0.0, periods).alias("Sharpe"), F.min("drawdown").alias("MaxDD"), F.count(r).alias("Count"))
    every = rows.select(*keys).distinct().withColumn("Regime", F.explode(F.array(*map(F.lit, ("low", "mid", "high")))))
    return beside(every, got, (*keys, "Regime")).select(*keys, "Regime", *(F.coalesce(c, F.lit(0)).alias(c) if c == "Count" else c for c in values))
