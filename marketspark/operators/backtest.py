"""Scores to positions and returns, per (symbol, model)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from marketspark.functions.chunks import ewm_chunks, number_rows, over_chunks
from marketspark.functions.ewm import Ewm, ewm
from marketspark.functions.windows import clip, ratio, rolling_mean, rolling_std, series

KEYS = ("symbol", "model")
EPS = 1e-12


def W() -> WindowSpec:
    """A series' rows in time order."""
    return series(*KEYS)


def backtest(scores: DataFrame, returns: DataFrame, z_window: int = 60, raw_weight_cap: float = 1.0, target_vol_annual: float = 0.10, vol_span: int = 20, cost_bps: float = 5.0, gross_limit: float = 3.0, drop_warmup: bool = True, use_vol_targeting: bool = True, with_volatility: bool | None = None, size: int | None = None) -> DataFrame:
    """Scores (symbol, model, ts, score) against next simple returns (symbol, ts, y_next).

    Opening the first position costs nothing: the first turnover has nothing to differ from. ``asset_volatility`` is NULL without
    targeting, unless ``with_volatility`` asks for it. With ``size``, series are worked on in chunks of so many rows.
    """
    checks = [(z_window < 5, "z_window must be at least 5"), (raw_weight_cap < 0, "raw_weight_cap must not be negative"), (gross_limit < raw_weight_cap, "gross_limit must be at least raw_weight_cap"), (vol_span < 5, "vol_span must be at least 5"), (cost_bps < 0, "cost_bps must not be negative"), (use_vol_targeting and target_vol_annual <= 0, "target_vol_annual must be positive")]
    for bad, say in checks:
        if bad:
            raise ValueError(say)
    s, lit = F.col("score"), F.lit
    df = scores.select(*KEYS, "ts", F.col("score").cast("double")).join(returns.select("symbol", "ts", F.col("y_next").cast("double")), ["symbol", "ts"])
    if size is None:
        each, scan = lambda rows, make, before: make(rows), lambda rows, columns: ewm(rows, columns, KEYS)
    else:
        df = number_rows(df, KEYS)
        each, scan = lambda rows, make, before: over_chunks(rows, make, size, before), lambda rows, columns: ewm_chunks(rows, columns, size, KEYS)
    df = each(df, lambda rows: rows.withColumns({"z_score": (s - rolling_mean(s, W(), z_window)) / (rolling_std(s, W(), z_window) + EPS), "_r": F.lag("y_next").over(W())}), z_window - 1)
    df = df.withColumn("weight_pre_scaling", clip(F.col("z_score"), lit(-raw_weight_cap), lit(raw_weight_cap)))
    if use_vol_targeting if with_volatility is None else with_volatility or use_vol_targeting:
        df = scan(df, [Ewm("asset_volatility", "_r", "std", span=vol_span, least=vol_span)])
    else:
        df = df.withColumn("asset_volatility", lit(None).cast("double"))
    vol = F.col("asset_volatility")
    if use_vol_targeting:
        most = gross_limit / max(raw_weight_cap, EPS)
        scale = F.when(vol.isNotNull(), F.least(target_vol_annual / math.sqrt(252.0) / (vol + EPS), lit(most)))
    else:
        scale = lit(1.0)
    df = df.withColumn("risk_scaling_multiplier", scale)
    df = df.withColumn("weight", clip(F.col("weight_pre_scaling") * F.col("risk_scaling_multiplier"), lit(-gross_limit), lit(gross_limit)))
    df = each(df, lambda rows: rows.withColumn("turnover", F.coalesce(F.abs(F.col("weight") - F.lag("weight").over(W())), lit(0.0))), 1)
    df = df.withColumns({"gross_return": F.col("weight") * F.col("y_next"), "transaction_cost": F.col("turnover") * (cost_bps / 10_000.0)})
    df = df.withColumn("net_return", F.col("gross_return") - F.col("transaction_cost"))
    df = df.select(*KEYS, "ts", "score", "z_score", "weight_pre_scaling", "asset_volatility", "risk_scaling_multiplier", "weight", "turnover", "gross_return", "transaction_cost", "net_return")
    return df.dropna("any", subset=["z_score", "weight"]) if drop_warmup else df


def buy_and_hold(frame: DataFrame, returns: DataFrame) -> DataFrame:
    """The benchmark on the strategies' dates: the asset's own return, no turnover, no cost."""
    days = frame.select("symbol", "ts").distinct()
    return days.join(returns.select("symbol", "ts", "y_next"), ["symbol", "ts"], "left").select("symbol", F.lit("buy_and_hold").alias("model"), "ts", F.col("y_next").alias("net_return"), F.lit(0.0).alias("turnover"), F.lit(0.0).alias("transaction_cost"))


def with_benchmark(frame: DataFrame, returns: DataFrame) -> DataFrame:
    """Results of all models and of :func:`buy_and_hold` on their dates, from one reading of the frame: symbol, model, ts, net_return, turnover, transaction_cost."""
    own = F.struct("model", "net_return", "turnover", "transaction_cost")
    hold = F.struct(F.lit("buy_and_hold").alias("model"), F.col("y_next").alias("net_return"), F.lit(0.0).alias("turnover"), F.lit(0.0).alias("transaction_cost"))
    both = frame.join(returns.select("symbol", "ts", "y_next"), ["symbol", "ts"], "left").select("symbol", "ts", F.explode(F.array(own, hold)).alias("v")).select("symbol", "ts", "v.*")
    # a date has the benchmark once for each model; a model's own rows are single
    return both.groupBy("symbol", "model", "ts").agg(*(F.first(c).alias(c) for c in ("net_return", "turnover", "transaction_cost")))


def shuffled(scores: DataFrame, seed: int = 42, name: str = "shuffled") -> DataFrame:
    """The same scores in a random but repeatable order of dates, per series."""
    by_time, by_hash = Window.partitionBy(*KEYS).orderBy("ts"), Window.partitionBy(*KEYS).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).cast("binary")), "ts")
    days = scores.select(*KEYS, "ts", F.row_number().over(by_time).alias("_n"))
    values = scores.select(*KEYS, "score", F.row_number().over(by_hash).alias("_n"))
    return days.join(values, [*KEYS, "_n"]).select("symbol", F.concat_ws("_", "model", F.lit(name)).alias("model"), "ts", "score")


def price_path(frame: DataFrame, close: str = "close", predicted: str = "predicted") -> DataFrame:
    """Next closes from predicted log returns: anchored on each actual close, and chained from the first."""
    w = series("symbol")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return frame.withColumns({"anchored": F.col(close) * F.exp(predicted), "chained": F.first(close).over(run) * F.exp(F.sum(predicted).over(run))})


def path_scores(paths: DataFrame, close: str = "close") -> DataFrame:
    """How near the paths of :func:`price_path` come to the next close, by symbol and path: r2, mae, rmse and mape (%)."""
    after = paths.withColumn("_next", F.lead(close).over(series("symbol"))).filter("_next is not null")
    long = after.select("symbol", "_next", F.explode(F.array(*(F.struct(F.lit(p).alias("path"), F.col(p).alias("_p")) for p in ("anchored", "chained")))).alias("v")).select("symbol", "_next", "v.*")
    d, y = F.col("_p") - F.col("_next"), F.col("_next")
    return long.groupBy("symbol", "path").agg((1 - ratio(F.sum(d * d), F.var_pop(y) * F.count("*"))).alias("r2"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), (F.avg(ratio(F.abs(d), F.abs(y))) * 100).alias("mape"))
