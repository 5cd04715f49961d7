"""Registered market queries over the given tables, and their SQL twins for DuckDB.

Bars are built from lineitem (a symbol per return flag, price per piece) and events. Floats are rounded on both sides.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketspark.functions.chunks import ewm_chunks, number_rows, rolling_apply
from marketspark.functions.ewm import Ewm
from marketspark.functions.windows import series
from marketspark.operators import backtest as bt
from marketspark.operators import checks, datasets, features, longseries, metrics, models, tensors
from marketspark.sources.bars import align, build_bars, last_rows, normalize_bars, read_bars, select_numeric, write_bars
from marketspark.sources.results import read_features, read_results, write_features, write_results
from marketspark.sources.scratch import delete_on_exit, keep, scratch

Query = Callable[[SparkSession, str], DataFrame]
DIGITS = 6
#: Prices are quotients by at most 50, exact in so many digits, so no value lies between two roundings.
EXACT = 8


def tidy(df: DataFrame, digits: int = DIGITS, exact: tuple[str, ...] = ()) -> DataFrame:
    """Doubles rounded, times as dates, counts as long: a form that two engines can agree on. A ``vwap`` stays as it is, and ``exact`` columns keep more digits."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.name == "vwap":
            pass
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), EXACT if f.name in exact else digits)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = c.cast("date")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def in_cents(bars: DataFrame) -> DataFrame:
    """Turnover is in whole cents here, so rounding it takes away the order in which floats were added."""
    return bars.withColumn("vwap", F.round(F.col("vwap") * F.col("volume"), 2) / F.col("volume"))


def daily(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem")
    ties = tuple(F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    return in_cents(build_bars(t, F.col("l_returnflag"), F.col("l_shipdate"), F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_quantity"), "day", ties))


def hourly(spark: SparkSession, d: str) -> DataFrame:
    return build_bars(table(spark, d, "events"), F.col("event_type"), F.col("ts"), F.col("value"), F.get_json_object("props", "$.k").cast("double") + 1, "hour", (F.col("event_id"),))


def brand_daily(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    ties = tuple(F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    return in_cents(build_bars(t, F.col("p_brand"), F.col("l_shipdate"), F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_quantity"), "day", ties))


def stored(spark: SparkSession, d: str) -> DataFrame:
    """The last two years of bars that were written and are read again; the folder goes when the driver ends."""
    path = f"{scratch(spark)}/bars.PARQUET"
    write_bars(daily(spark, d), path)
    delete_on_exit(spark, path)
    return read_bars(spark, path, 2, "1998-12-31")


def dirty(spark: SparkSession, d: str) -> DataFrame:
    """Every bar twice, with gaps in some of the first rows and values that are no numbers in some volumes."""
    twice = daily(spark, d).withColumn("seq", F.explode(F.array(F.lit(2), F.lit(1))))
    close = F.when((F.col("seq") == 1) & (F.dayofmonth("ts") % 7 == 0), F.lit(None)).otherwise(F.col("close") + F.col("seq") - 1)
    odd = F.when(F.col("volume") % 5 == 0, float("nan")).when(F.col("volume") % 5 == 1, float("inf")).otherwise(F.col("volume"))
    return twice.withColumns({"close": close, "volume": odd, "ts": F.date_format("ts", "yyyy-MM-dd HH:mm:ss")}).withColumnRenamed("ts", "Time")


def strategy_table(spark: SparkSession, d: str) -> DataFrame:
    r = returns(daily(spark, d))
    return metrics.summary(bt.with_benchmark(frame(spark, d), r))


def returns(bars: DataFrame) -> DataFrame:
    w = series()
    r = bars.withColumn("log_return", features.log_return())
    return r.withColumns({"y": F.lead("log_return").over(w), "y_next": F.expm1(F.lead("log_return").over(w)), "momentum_5d": F.col("close") - F.lag("close", 5).over(w)})


def scores(r: DataFrame) -> DataFrame:
    """Two models without a fit: the last return, and momentum."""
    two = F.explode(F.array(F.struct(F.lit("persistence").alias("model"), F.col("log_return").alias("score")), F.struct(F.lit("momentum").alias("model"), F.col("momentum_5d").alias("score"))))
    return r.select("symbol", "ts", two.alias("v")).select("symbol", "ts", "v.*")


def frame(spark: SparkSession, d: str, vol: bool = False, size: int | None = None) -> DataFrame:
    r = returns(daily(spark, d))
    return bt.backtest(scores(r), r.select("symbol", "ts", "y_next"), use_vol_targeting=vol, size=size)


PROFILE = ["open", "high", "low", "close", "volume"]
SCAN = ["ema_20", "ema_50", "rsi_14", "macd", "macd_signal", "macd_histogram"]
PRICE = ["close_minus_open", "high_minus_low", "close_over_open", "high_over_low", "simple_return", "log_return", "momentum_5d"]
TECHNICAL = ["sma_10", "sma_20", "bb_middle_20", "bb_upper_20", "bb_lower_20", "stochastic_k_14"]
VOLUME = ["volume_change", "volume_over_avg_10d", "obv", "close_minus_vwap", "close_over_vwap", "trade_count_change", "trade_count_over_avg_10d"]
VOLATILITY = ["vol_10", "rolling_std_10", "rolling_mean_10", "vol_20", "rolling_std_20", "rolling_mean_20", "z_score_10"]
AUTOCORR = ["autocorr_close_1_w20", "autocorr_close_2_w20", "autocorr_close_3_w20"]
#: The columns of the feature matrix, in its order.
MATRIX = [*PRICE, *TECHNICAL[:2], *SCAN, *TECHNICAL[2:], *VOLUME, *VOLATILITY, "entropy_close_20", "hurst_close_100", *AUTOCORR]
CORR = ["close_minus_open", "high_minus_low", "momentum_5d", "log_return", "volume"]


def scored(spark: SparkSession, d: str) -> DataFrame:
    r = datasets.chronological(returns(daily(spark, d)).filter("y is not null"))
    return datasets.score_predictions(models.persistence(r).select("symbol", "model", "fold", "y", "score"))


def with_block(spark: SparkSession, d: str, names: list[str], plain: bool = True) -> DataFrame:
    return features.add_plain_features(daily(spark, d)).select("symbol", "ts", *names)


LINEAR = ["log_return", "momentum_5d", "z_score_10", "vol_10"]


def ridge_result(spark: SparkSession, d: str) -> DataFrame:
    r = datasets.chronological(returns(features.add_plain_features(daily(spark, d)).drop("momentum_5d", "log_return")).filter("y is not null")).select("symbol", "ts", "fold", "y", *LINEAR).dropna("any")
    model = models.ridge(r, LINEAR)
    return datasets.score_predictions(models.predict_linear(r, model)).withColumns({"best_alpha": F.lit(model["best_alpha"]), "val_corr": F.lit(model["val_corr"])})


def matrix_with_folds(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    """The whole feature matrix with targets and folds, cached because fits read it often, and its inputs."""
    bars = daily(spark, d)
    names = features.feature_columns(bars.columns)
    y = returns(bars).filter("y is not null").select("symbol", "ts", "y")
    return datasets.chronological(align(features.feature_matrix(bars), y)).select("symbol", "ts", "fold", "y", *names).cache(), names


def boosted_result(spark: SparkSession, d: str) -> DataFrame:
    r, names = matrix_with_folds(spark, d)
    model, best = models.boosted(r, names)
    return datasets.score_predictions(models.predict_trees(r, model, names)).withColumn("best_rounds", F.lit(best))


def forest_importance(spark: SparkSession, d: str, trees: int = 100, depth: int = 8) -> DataFrame:
    r, names = matrix_with_folds(spark, d)
    model = models.forest(r, names, trees=trees, depth=depth)
    return models.permutation_importance(r, names, lambda rows: models.predict_trees(rows, model, names, "forest"))


def scaled_back(spark: SparkSession, d: str) -> DataFrame:
    cols = ["close", "volume"]
    r = datasets.chronological(daily(spark, d))
    scaler = datasets.fit_scaler(r, cols)
    return datasets.scale(datasets.scale(r, scaler, cols), scaler, cols, inverse=True).select("symbol", "ts", "fold", *cols)


def aligned(spark: SparkSession, d: str) -> DataFrame:
    r = returns(daily(spark, d))
    return align(with_block(spark, d, ["sma_10", "vol_10"]), r.select("symbol", "ts", "y"))


def importance(spark: SparkSession, d: str) -> DataFrame:
    r, names = matrix_with_folds(spark, d)
    model = models.ridge(r, names)
    return models.permutation_importance(r, names, lambda rows: models.predict_linear(rows, model))


RANKED = ["sma_10", "sma_20", "rolling_std_10", "rolling_std_20", "z_score_10", "momentum_5d", "log_return"]


def pruned(spark: SparkSession, d: str) -> DataFrame:
    return kept_pairs(datasets.chronological(features.add_plain_features(daily(spark, d))), RANKED)


def kept_pairs(r: DataFrame, names: list[str], top: int | None = None) -> DataFrame:
    """Correlations of the columns that pruning keeps with all."""
    c = datasets.correlations(r.filter("fold = 'train'"), names)
    return c.filter(F.col("f1").isin(models.prune_by(c, names, top=top)))


def results_stored(spark: SparkSession, d: str) -> DataFrame:
    """A backtest stored by model; one model read alone."""
    path = f"{scratch(spark)}/results"
    write_results(frame(spark, d), path)
    delete_on_exit(spark, path)
    return read_results(spark, path, ["momentum"]).select("symbol", "model", "ts", "score", "z_score", "weight", "net_return")


def features_frozen(spark: SparkSession, d: str) -> DataFrame:
    """The list that pruning keeps is stored and read again; correlations of its columns with all."""
    r = datasets.chronological(features.add_plain_features(daily(spark, d)))
    c = datasets.correlations(r.filter("fold = 'train'"), RANKED)
    path = f"{scratch(spark)}/features"
    write_features(spark, models.prune_by(c, RANKED), path)
    delete_on_exit(spark, path)
    return c.filter(F.col("f1").isin(read_features(spark, path)))


def pruned_matrix(spark: SparkSession, d: str) -> DataFrame:
    """The 25 first of the whole matrix's columns, pruned."""
    x = tidy(features.feature_matrix(daily(spark, d)), exact=tuple(PRICE))
    return kept_pairs(datasets.chronological(x), x.columns[2:], 25)


def check_report(spark: SparkSession, d: str) -> DataFrame:
    bars = daily(spark, d)
    x = features.add_plain_features(bars).select("symbol", "ts", "close_minus_open", "momentum_5d", F.lead("close").over(series()).alias("planted")).dropna("any")
    y = bars.select("symbol", "ts")
    return checks.run_all(bars, x, y, ["close_minus_open", "momentum_5d", "planted"], ["open", "close"])


@F.pandas_udf(T.StringType())
def contents(sequence: pd.Series) -> pd.Series:
    """MD5 of all numbers of a window: floats in whole parts of 4096, which no two roundings can tell apart."""
    of = lambda b: np.frombuffer(b, np.float32).reshape(-1, 2).astype(float)
    text = lambda x: ",".join(f"{math.floor(c * 4096)}:{math.floor(v * 4096)}" for c, v in x)
    return pd.Series([hashlib.md5(text(of(b)).encode()).hexdigest() for b in sequence])


def sequences_stored(spark: SparkSession, d: str) -> DataFrame:
    """Windows cut from stored chunks, each with a digest of its whole contents."""
    r = datasets.chronological(daily(spark, d)).withColumn("y", F.col("volume"))
    stored = keep(tensors.sequence_chunks(r, ["close", "volume"], "y", size=500), "sequences")
    return tensors.sequence_windows(stored, 2).select("symbol", "ts", "fold", contents("sequence").alias("contents"), "y")


BARS_OF = ["open", "high", "low", "close", "volume", "vwap", "trade_count"]


def matrix_checks(spark: SparkSession, d: str) -> DataFrame:
    """The whole feature matrix, with a planted leak, against all columns of the bars."""
    bars = daily(spark, d)
    leak = bars.select("symbol", "ts", F.lead("close").over(series()).alias("planted"))
    x = features.feature_matrix(bars)
    x = x.select("symbol", "ts", *(F.round(c, EXACT if c in PRICE else DIGITS).alias(c) for c in x.columns[2:])).join(leak.dropna("any"), ["symbol", "ts"])
    return checks.run_all(bars, x, bars.select("symbol", "ts"), x.columns[2:], BARS_OF)


def queries() -> dict[str, Query]:
    plain = lambda *names, digits=DIGITS: lambda s, d: tidy(with_block(s, d, list(names)), digits)
    made: dict[str, Query] = {
        "bars_daily": lambda s, d: tidy(daily(s, d), EXACT),
        "bars_hourly": lambda s, d: hourly(s, d).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH")).withColumn("vwap", F.round("vwap", DIGITS)).transform(tidy),
        "bars_brand": lambda s, d: tidy(brand_daily(s, d), EXACT),
        "bars_clean": lambda s, d: tidy(normalize_bars(daily(s, d).withColumnRenamed("ts", "Date").withColumnRenamed("close", "CLOSE").withColumn("open", F.when(F.col("open") < 1000, F.lit("abc")).otherwise(F.col("open").cast("string"))), ("high",)), EXACT),
        "bars_stored": lambda s, d: tidy(stored(s, d), EXACT),
        "bars_deduplicated": lambda s, d: tidy(normalize_bars(dirty(s, d), ("seq",)), EXACT),
        "aligned_left": lambda s, d: (lambda r: tidy(align(r.select("symbol", "ts", "close"), with_block(s, d, ["sma_10"]).filter("sma_10 is not null"), dropna=False, how="left"), EXACT))(daily(s, d)),
        "price_path_scores": lambda s, d: tidy(bt.path_scores(bt.price_path(returns(daily(s, d)).filter("log_return is not null").withColumn("predicted", F.col("log_return") * 0.01)))),
        "strategy_table": lambda s, d: tidy(strategy_table(s, d)),
        "last_rows": lambda s, d: tidy(last_rows(daily(s, d), 50), EXACT),
        "targets": lambda s, d: tidy(returns(daily(s, d)).select("symbol", "ts", "log_return", F.col("y").alias("y_raw"), "y_next")),
        "features_price": plain(*PRICE, digits=EXACT),
        "features_technical": plain(*TECHNICAL),
        "features_volume": plain(*VOLUME),
        "features_volatility": plain(*VOLATILITY),
        "features_autocorr": plain(*AUTOCORR),
        "features_hurst": plain("hurst_close_100"),
        "features_entropy": plain("entropy_close_20"),
        "targets_ewm": lambda s, d: tidy(features.add_targets(daily(s, d)).select("symbol", "ts", "log_return", "ewma_vol_20", "y_raw", "y_vol")),
        "features_scan": lambda s, d: tidy(features.add_scan_features(daily(s, d)).select("symbol", "ts", *SCAN)),
        "feature_matrix": lambda s, d: tidy(features.feature_matrix(daily(s, d)), exact=tuple(PRICE)),
        "checks": check_report,
        "checks_matrix": matrix_checks,
        "split": lambda s, d: datasets.chronological(daily(s, d)).groupBy("symbol", "fold").agg(F.count("*").alias("n"), F.min("ts").cast("date").alias("first"), F.max("ts").cast("date").alias("last")),
        "split_panel": lambda s, d: datasets.chronological(daily(s, d), panel=True).groupBy("symbol", "fold").agg(F.count("*").alias("n"), F.min("ts").cast("date").alias("first"), F.max("ts").cast("date").alias("last")),
        "describe": lambda s, d: tidy(datasets.describe(daily(s, d), PROFILE)),
        "missing": lambda s, d: datasets.missing(with_block(s, d, ["sma_10", "sma_20", "momentum_5d", "vol_20", "obv"]), ["sma_10", "sma_20", "momentum_5d", "vol_20", "obv"]),
        "correlations": lambda s, d: tidy(datasets.correlations(with_block(s, d, CORR[:-1]).join(daily(s, d).select("symbol", "ts", "volume"), ["symbol", "ts"]), CORR)),
        "correlations_matrix": lambda s, d: (lambda x: tidy(datasets.correlations(x, x.columns[2:])))(tidy(features.feature_matrix(daily(s, d)), exact=tuple(PRICE))),
        "pruned_matrix": lambda s, d: tidy(pruned_matrix(s, d)),
        "scaled": lambda s, d: (lambda r: tidy(datasets.scale(r, datasets.fit_scaler(r, ["close", "volume"]), ["close", "volume"]).select("symbol", "ts", "fold", "close", "volume")))(datasets.chronological(daily(s, d))),
        "sequences": lambda s, d: tidy(datasets.sequences(datasets.chronological(daily(s, d)).withColumn("y", F.col("volume")), ["close", "volume"], "y").select("symbol", "ts", "fold", F.size("sequence").alias("rows"), F.col("sequence")[0][1].alias("first_volume"), "y")),
        "results_stored": lambda s, d: tidy(results_stored(s, d)),
        "features_frozen": lambda s, d: tidy(features_frozen(s, d)),
        "columns_numeric": lambda s, d: tidy(select_numeric(daily(s, d).withColumn("high", F.col("high").cast("string")), ["volume", "absent", "high", "close", "volume"]), EXACT),
        "sequences_stored": lambda s, d: tidy(sequences_stored(s, d)),
        "scores_persistence": lambda s, d: tidy(scored(s, d)),
        "fold_table": lambda s, d: tidy(datasets.fold_table(scored(s, d), "rmse")),
        "ridge": lambda s, d: tidy(ridge_result(s, d)),
        "importance": lambda s, d: tidy(importance(s, d)),
        "pruned_features": lambda s, d: tidy(pruned(s, d)),
        "boosted": lambda s, d: tidy(boosted_result(s, d)),
        "forest_importance": lambda s, d: tidy(forest_importance(s, d)),
        "scaled_back": lambda s, d: tidy(scaled_back(s, d), EXACT),
        "aligned": lambda s, d: tidy(aligned(s, d)),
        "ewm_chunked": lambda s, d: tidy(ewm_chunks(number_rows(daily(s, d).select("symbol", "ts", "close")), [Ewm("ema_20", "close", span=20, least=20)], 500).select("symbol", "ts", "ema_20")),
        "feature_matrix_chunked": lambda s, d: tidy(longseries.feature_matrix(daily(s, d), size=150), exact=tuple(PRICE)),
        "backtest_chunked": lambda s, d: tidy(frame(s, d, True, 150)),
        "max_drawdown_chunked": lambda s, d: tidy(longseries.max_drawdown(frame(s, d), size=150)),
        "trades_chunked": lambda s, d: tidy(longseries.trades(frame(s, d), size=150)),
        "trade_summary_chunked": lambda s, d: tidy(longseries.trade_summary(frame(s, d), size=150)),
        "regimes_chunked": lambda s, d: tidy(longseries.regimes(frame(s, d), size=150)),
        "rolling_median": lambda s, d: tidy(rolling_apply(number_rows(daily(s, d).select("symbol", "ts", "close")), "close", "median_30", 30, partial(np.median, axis=1), size=150).select("symbol", "ts", "median_30")),
        "obv_of_tables": lambda s, d: (lambda b: tidy(features.on_balance_volume(b.select("symbol", "ts", "close"), b.select("symbol", "ts", "volume"))))(daily(s, d)),
        "periods": lambda s, d: tidy(metrics.infer_periods(frame(s, d))),
        "price_path": lambda s, d: tidy(bt.price_path(returns(daily(s, d)).filter("log_return is not null").withColumn("predicted", F.col("log_return") * 0.01)).select("symbol", "ts", "anchored", "chained")),
        "shuffled_scores": lambda s, d: tidy(bt.shuffled(scores(returns(daily(s, d))))),
        "backtest": lambda s, d: tidy(frame(s, d).select("symbol", "model", "ts", "score", "z_score", "weight", "turnover", "gross_return", "transaction_cost", "net_return")),
        "backtest_vol_target": lambda s, d: tidy(frame(s, d, True)),
        "summary": lambda s, d: tidy(metrics.summary(frame(s, d))),
        "max_drawdown": lambda s, d: tidy(metrics.max_drawdown(frame(s, d))),
        "wealth": lambda s, d: tidy(metrics.wealth_table(frame(s, d), ["momentum", "persistence"]), 3),
        "trades": lambda s, d: tidy(metrics.trades(frame(s, d))),
        "trade_summary": lambda s, d: tidy(metrics.trade_summary(frame(s, d))),
        "attribution": lambda s, d: tidy(metrics.attribution(frame(s, d))),
        "yearly": lambda s, d: tidy(metrics.yearly(frame(s, d))),
        "regimes": lambda s, d: tidy(metrics.regimes(frame(s, d))),
        "buy_and_hold": lambda s, d: (lambda r: tidy(metrics.summary(bt.buy_and_hold(bt.backtest(scores(r), r.select("symbol", "ts", "y_next"), use_vol_targeting=False), r))))(returns(daily(s, d))),
    }
    return made


# SQL ------------------------------------------------------------------------------------------------------------------

_PRICE = "l_extendedprice / l_quantity AS p, CAST(l_quantity AS DOUBLE) AS q, row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / l_quantity, l_quantity) AS o"
_BAR = "arg_min(p, o) AS open, max(p) AS high, min(p) AS low, arg_max(p, o) AS close, sum(q) AS volume, round(sum(p * q), 2) / sum(q) AS vwap, CAST(count(*) AS DOUBLE) AS trade_count"
BARS = f"bars AS (SELECT l_returnflag AS symbol, CAST(l_shipdate AS DATE) AS ts, {_BAR} FROM (SELECT *, {_PRICE} FROM lineitem) GROUP BY 1, 2)"
RET = "ret AS (SELECT *, ln(close) - lag(ln(close)) OVER w AS log_return, close - lag(close, 5) OVER w AS momentum_5d FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts))"
Y = "y AS (SELECT *, lead(log_return) OVER w AS y, exp(lead(log_return) OVER w) - 1 AS y_next FROM ret WINDOW w AS (PARTITION BY symbol ORDER BY ts))"
BASE = f"WITH {BARS}, {RET}, {Y}"


def rnd(*names: str, digits: int = DIGITS, **made: str) -> str:
    return ", ".join(f"round(CAST({e} AS DOUBLE), {digits}) AS {n}" for n, e in ({n: n for n in names} | made).items())


def over(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def whole(agg: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) {over(n)} = {n} THEN {agg}({x}) {over(n)} END"


def lagged(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER (PARTITION BY symbol ORDER BY ts)"


def _sum(e: str) -> str:
    return f"sum({e}) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)"


FOLD = "CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY ts) <= floor(count(*) OVER (PARTITION BY symbol) * 0.70::DOUBLE) THEN 'train' WHEN row_number() OVER (PARTITION BY symbol ORDER BY ts) <= floor(count(*) OVER (PARTITION BY symbol) * 0.85::DOUBLE) THEN 'val' ELSE 'test' END AS fold"
_SM = "PARTITION BY symbol, model ORDER BY ts"


def scan(x: str) -> str:
    """Exponential averages of the close and the deviation of ``x`` (missing in row 1), a row at a time."""
    ema = lambda name, span: f"{name} + (close - {name}) * 2.0::DOUBLE / {span + 1}"
    first = lambda name, then, start: f"CASE WHEN {name} IS NULL THEN {start} ELSE {then} END"
    up, down, macd, a = "greatest(delta, 0)", "greatest(-delta, 0)", f"({ema('e12', 12)} - ({ema('e26', 26)}))", "(2.0::DOUBLE / 21)"
    return f"""{BASE.replace("WITH", "WITH RECURSIVE", 1)},
n AS MATERIALIZED (SELECT *, {x} AS x, close - lag(close) OVER w AS delta, row_number() OVER w AS i FROM y WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
e AS (SELECT symbol, i, close AS e12, close AS e26, close AS e20, close AS e50, NULL::DOUBLE AS up, NULL::DOUBLE AS down, NULL::DOUBLE AS signal, NULL::DOUBLE AS m, NULL::DOUBLE AS cv, NULL::DOUBLE AS s2 FROM n WHERE i = 1
UNION ALL SELECT n.symbol, n.i, {ema("e12", 12)}, {ema("e26", 26)}, {ema("e20", 20)}, {ema("e50", 50)},
{first("up", f"up + ({up} - up) / 14", up)}, {first("down", f"down + ({down} - down) / 14", down)}, CASE WHEN n.i >= 26 THEN {first("signal", f"signal + ({macd} - signal) * 0.2::DOUBLE", macd)} END,
{first("m", f"m + {a} * (x - m)", "x")}, {first("m", f"(1 - {a}) * (cv + {a} * (x - m) * (x - m))", "0")}, {first("m", f"(1 - {a}) * (1 - {a}) * s2 + {a} * {a}", "1")}
FROM e JOIN n ON n.symbol = e.symbol AND n.i = e.i + 1),
v AS (SELECT *, CASE WHEN i >= 21 THEN sqrt(cv / (1 - s2)) END AS vol FROM n JOIN e USING (symbol, i))"""


FRAME = f"""{BASE},
sc AS (SELECT symbol, ts, 'persistence' AS model, log_return AS score, y_next FROM y UNION ALL SELECT symbol, ts, 'momentum', momentum_5d, y_next FROM y),
z AS (SELECT *, CASE WHEN count(score) OVER w = 60 THEN (score - avg(score) OVER w) / (stddev_samp(score) OVER w + 1e-12::DOUBLE) END AS z_score FROM sc WINDOW w AS ({_SM} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
wt AS (SELECT *, CASE WHEN z_score IS NOT NULL THEN greatest(-1.0::DOUBLE, least(z_score, 1.0::DOUBLE)) END AS weight FROM z),
tu AS (SELECT *, coalesce(abs(weight - lag(weight) OVER ({_SM})), 0) AS turnover FROM wt),
bt AS (SELECT *, weight * y_next AS gross_return, turnover * 0.0005::DOUBLE AS transaction_cost, weight * y_next - turnover * 0.0005::DOUBLE AS net_return FROM tu WHERE z_score IS NOT NULL)"""


SCALED = f"""{scan("lag(y_next) OVER w")}, {FRAME.removeprefix(BASE + ",").partition("wt AS")[0].strip()}
wp AS (SELECT z.*, vol AS asset_volatility, CASE WHEN z_score IS NOT NULL THEN greatest(-1.0::DOUBLE, least(z_score, 1.0::DOUBLE)) END AS weight_pre_scaling FROM z JOIN v USING (symbol, ts)),
ws AS (SELECT *, CASE WHEN asset_volatility IS NOT NULL THEN least(0.1::DOUBLE / sqrt(252.0::DOUBLE) / (asset_volatility + 1e-12::DOUBLE), 3.0::DOUBLE) END AS risk_scaling_multiplier FROM wp),
wt AS (SELECT *, CASE WHEN weight_pre_scaling * risk_scaling_multiplier IS NOT NULL THEN greatest(-3.0::DOUBLE, least(weight_pre_scaling * risk_scaling_multiplier, 3.0::DOUBLE)) END AS weight FROM ws),
tu AS (SELECT *, coalesce(abs(weight - lag(weight) OVER ({_SM})), 0) AS turnover FROM wt),
bt AS (SELECT *, weight * y_next AS gross_return, turnover * 0.0005::DOUBLE AS transaction_cost, weight * y_next - turnover * 0.0005::DOUBLE AS net_return FROM tu WHERE z_score IS NOT NULL AND weight IS NOT NULL)"""


_FEW = "SELECT symbol, ts, close - open AS close_minus_open, momentum_5d, lead(close) OVER (PARTITION BY symbol ORDER BY ts) AS planted FROM y"


def _checks(names: tuple[str, ...] = ("close_minus_open", "momentum_5d", "planted"), base: tuple[str, ...] = ("open", "close"), head: str = BASE, x: str = _FEW) -> str:
    row = lambda check, subject, n, src: f"SELECT '{check}' AS \"check\", '{subject}' AS subject, CAST({n} AS BIGINT) AS violations, {n} = 0 AS passed FROM {src}"
    one = "(SELECT 1)"
    keys = lambda a, b: f"(SELECT count(*) FROM {a} ANTI JOIN {b} USING (symbol, ts))"
    twice = lambda t: f"(SELECT count(*) FROM (SELECT 1 FROM {t} GROUP BY symbol, ts HAVING count(*) > 1))"
    parts = [row("required_columns", b, "0", one) for b in base] + [row("duplicate_columns", "all", "0", one)]
    parts += [row("time_type", "ts", "0", one)]
    parts += [row("unique_keys", "symbol, ts", twice(t), one) for t in ("bars", "x")]
    parts += [row("complete", f, f"count(*) FILTER ({f} IS NULL)", "x") for f in names]
    parts += [row("same_keys", "symbol, ts", f"({keys('x', 'bars')} + {keys('bars', 'x')})", one)]
    hits = lambda f, b, k: f"count(*) FILTER (abs({f} - {b}{k}) <= 0)"
    parts += [f"{row('future_fields', f'{f} = {b} + {k}', hits(f, b, k), 'xb')} HAVING {hits(f, b, k)} > 0 AND {hits(f, b, k)} >= floor(0.95::DOUBLE * count(*))" for b in base for f in names for k in (1, 2, 3)]
    parts += [row("lookahead", f, f"CAST(count(*) > 0 AND count(*) FILTER ({f} IS NOT DISTINCT FROM n_{f}) = count(*) AS BIGINT)", "xn") for f in names]
    leads = ", ".join(f"lead({b}, {k}) OVER w AS {b}{k}" for b in base for k in (1, 2, 3))
    return f"""{head}, x AS (SELECT * FROM ({x}) WHERE {" AND ".join(f"{f} IS NOT NULL" for f in names)}),
xb AS (SELECT * FROM x JOIN (SELECT symbol, ts, {leads} FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)) USING (symbol, ts)),
xn AS (SELECT *, {", ".join(f"lead({f}) OVER w AS n_{f}" for f in names)} FROM x WINDOW w AS (PARTITION BY symbol ORDER BY ts) QUALIFY lead(1) OVER w = 1)
{" UNION ALL ".join(parts)}"""


def grown(keys: str, src: str = "bt") -> str:
    w = f"PARTITION BY {keys} ORDER BY ts ROWS UNBOUNDED PRECEDING"
    return f"wl AS (SELECT *, product(1 + net_return) OVER ({w}) AS wealth FROM {src} WHERE net_return IS NOT NULL), dd AS (SELECT *, wealth / max(wealth) OVER ({w}) - 1 AS drawdown, max(wealth) OVER ({w}) AS peak_w FROM wl)"


CAGR = "CASE WHEN product(1 + net_return) > 0 THEN pow(product(1 + net_return), 252.0::DOUBLE / count(net_return)) - 1 END"
SHARPE = "CASE WHEN stddev_pop(net_return) > 0 THEN avg(net_return) / stddev_pop(net_return) * sqrt(252.0::DOUBLE) END"
DOWN = "sqrt(avg(pow(least(net_return, 0), 2)))"
TRADES = f"""{FRAME},
sd AS (SELECT *, CASE WHEN abs(weight) > 1e-6::DOUBLE THEN CAST(sign(weight) AS INTEGER) ELSE 0 END AS side FROM bt),
nw AS (SELECT *, CASE WHEN side <> 0 AND side <> coalesce(lag(side) OVER ({_SM}), 0) THEN 1 ELSE 0 END AS fresh FROM sd),
id AS (SELECT *, sum(fresh) OVER ({_SM} ROWS UNBOUNDED PRECEDING) AS trade_id FROM nw),
tr AS (SELECT symbol, model, CAST(trade_id AS BIGINT) AS trade_id, CAST(any_value(side) AS BIGINT) AS side, min(ts) AS "start", max(ts) AS "end", count(net_return) AS n_days, sum(net_return) AS pnl FROM id WHERE side <> 0 GROUP BY ALL HAVING count(net_return) > 0)"""


def _hurst() -> str:
    diffs = ", ".join(f"close - {lagged('close', k)} AS d{k}" for k in features.LAGS)
    tau = ", ".join(f"CASE WHEN stddev_pop(d{k}) {over(100 - k)} > 0 THEN ln(stddev_pop(d{k}) {over(100 - k)}) END AS t{k}" for k in features.LAGS)
    add = lambda e: "(" + " + ".join(e(k, repr(math.log(k)) + "::DOUBLE") for k in features.LAGS) + ")"
    n, sx = add(lambda k, x: f"CASE WHEN t{k} IS NULL THEN 0 ELSE 1 END"), add(lambda k, x: f"CASE WHEN t{k} IS NULL THEN 0 ELSE {x} END")
    sy, sxx, sxy = add(lambda k, x: f"coalesce(t{k}, 0)"), add(lambda k, x: f"CASE WHEN t{k} IS NULL THEN 0 ELSE {x} * {x} END"), add(lambda k, x: f"coalesce(t{k} * {x}, 0)")
    return f"{BASE}, d AS (SELECT symbol, ts, close, {diffs} FROM y), t AS (SELECT symbol, ts, count(close) {over(100)} AS n, {tau} FROM d) SELECT symbol, ts, {rnd(hurst_close_100=f'CASE WHEN n = 100 AND {n} >= 3 THEN ({n} * {sxy} - {sx} * {sy}) / ({n} * {sxx} - {sx} * {sx}) END')} FROM t"


def _autocorr() -> str:
    made = {f"autocorr_close_{k}_w20": f"CASE WHEN count(close) {over(20)} = 20 AND stddev_pop(close) {over(20 - k)} > 0 AND stddev_pop(c{k}) {over(20 - k)} > 0 THEN corr(close, c{k}) {over(20 - k)} END" for k in (1, 2, 3)}
    return f"{BASE}, l AS (SELECT *, {', '.join(f'{lagged("close", k)} AS c{k}' for k in (1, 2, 3))} FROM y) SELECT symbol, ts, {rnd(**made)} FROM l"


_ENTROPY = f"""{BASE}, v AS (SELECT symbol, ts, count(close) {over(20)} AS n, list(close) {over(20)} AS vals, min(close) {over(20)} AS mn, max(close) {over(20)} AS mx FROM y),
x AS (SELECT symbol, ts, n, mn, mx, unnest(vals) AS v FROM v),
k AS (SELECT *, CASE WHEN mx > mn THEN CAST(least(floor((v - mn) / (mx - mn) * 20), 19) AS INTEGER) ELSE 0 END AS k FROM x),
b AS (SELECT *, CASE WHEN NOT mx > mn THEN 0 WHEN v < mn + k * ((mx - mn) / 20) THEN k - 1 WHEN k <> 19 AND v >= mn + (k + 1) * ((mx - mn) / 20) THEN k + 1 ELSE k END AS bin FROM k),
c AS (SELECT symbol, ts, any_value(n) AS n, bin, count(*)::DOUBLE AS c FROM b GROUP BY symbol, ts, bin)
SELECT symbol, ts, round(CASE WHEN any_value(n) = 20 THEN sum(-(c / n) * ln(c / n)) END, {DIGITS}) AS entropy_close_20 FROM c GROUP BY symbol, ts"""


def _pairs(names: list[str], source: str) -> str:
    """c: one row with the correlations of all pairs, as c_i_j."""
    n = range(len(names))
    sums = ", ".join(f"corr({names[i]}, {names[j]}) AS c_{i}_{j}" for i in n for j in n if i <= j)
    return f"c AS MATERIALIZED (SELECT {sums} FROM {source})"


def _listed(names: list[str], source: str, only: str = "TRUE") -> str:
    """f1, f2, corr of all ordered pairs; ``only`` is a condition with {i}."""
    n = range(len(names))
    rows = ", ".join(f"{{'f1': '{names[i]}', 'f2': '{names[j]}', 'corr': c_{min(i, j)}_{max(i, j)}, 'use': {only.format(i=i)}}}" for i in n for j in n)
    return f"SELECT x.f1, x.f2, round(CASE WHEN NOT isnan(x.corr) THEN x.corr END, {DIGITS}) AS corr FROM (SELECT unnest([{rows}]) AS x FROM {source}) WHERE x.use"


def _kept(names: list[str], top: int) -> str:
    """A step for each of the first names in order: kept if its correlation with every kept one before is small."""
    near = lambda i, j: f"(NOT kept_{j} OR coalesce(abs(c_{j}_{i}) < 0.95::DOUBLE, FALSE))"
    return ", ".join(f"k{i} AS (SELECT *, {' AND '.join(['TRUE', *(near(i, j) for j in range(i))])} AS kept_{i} FROM {f'k{i - 1}' if i else 'c'})" for i in range(top))


def _pruned() -> str:
    made = {"sma_10": whole("avg", "close", 10), "sma_20": whole("avg", "close", 20), "rolling_std_10": whole("stddev_samp", "close", 10), "rolling_std_20": whole("stddev_samp", "close", 20)}
    made["z_score_10"] = f"(close - {made['sma_10']}) / nullif({made['rolling_std_10']}, 0)"
    cols, top = ", ".join(f"{made.get(n, n)} AS {n}" for n in RANKED), len(RANKED)
    return f"{BASE}, f AS (SELECT {cols}, {FOLD} FROM y), t AS (SELECT * FROM f WHERE fold = 'train'), {_pairs(RANKED, 't')}, {_kept(RANKED, top)} {_listed(RANKED, f'k{top - 1}', 'kept_{i}')}"


def _ridge(score_cols: str, z: str, vol: str) -> str:
    """Normal equations of standardised inputs for every penalty, solved by elimination a column at a time."""
    p, same = len(LINEAR), lambda a, b: "1.0::DOUBLE" if a == b else f"corr({a}, {b})"
    system = ", ".join("[" + ", ".join([f"count(*) * {same(a, b)}" + (" + alpha" if a == b else "") for b in LINEAR] + [f"count(*) * covar_pop({a}, y) / stddev_pop({a})"]) + "]" for a in LINEAR)
    value = " + ".join(f"a[{j}][{p + 1}] / sd[{j}] * ({c} - mean[{j}])" for j, c in enumerate(LINEAR, 1))
    lists = ", ".join(f"[{', '.join(f'{f}({c})' for c in LINEAR)}] AS {n}" for f, n in (("avg", "mean"), ("stddev_pop", "sd")))
    return f"""{BASE.replace("WITH", "WITH RECURSIVE", 1)}, x AS (SELECT symbol, ts, y, log_return, momentum_5d, {z} AS z_score_10, {vol} AS vol_10 FROM y),
f AS (SELECT *, {FOLD} FROM x WHERE y IS NOT NULL), g AS (SELECT * FROM f WHERE {" AND ".join(f"{c} IS NOT NULL" for c in LINEAR)}),
used AS (SELECT 'train' AS part, * FROM g WHERE fold = 'train' UNION ALL SELECT 'both', * FROM g WHERE fold IN ('train', 'val')),
penalties AS (SELECT i, pow(10.0::DOUBLE, i / 3.0::DOUBLE - 4) AS alpha FROM range(25) AS t(i)),
sums AS (SELECT part, avg(y) AS my, {lists} FROM used GROUP BY part),
solved AS (
  SELECT part, i, alpha, CAST(1 AS BIGINT) AS k, [{system}] AS a FROM used, penalties GROUP BY part, i, alpha
  UNION ALL
  SELECT part, i, alpha, k + 1, list_transform(a, lambda r, j: CASE WHEN j = k THEN list_transform(r, lambda v: v / a[k][k]) ELSE list_transform(r, lambda v, c: v - r[k] * a[k][c] / a[k][k]) END) FROM solved WHERE k <= {p}),
best AS (
  SELECT i, alpha, corr(g.y, my + {value}) AS c FROM solved JOIN sums USING (part), g WHERE k = {p + 1} AND part = 'train' AND fold = 'val'
  GROUP BY i, alpha ORDER BY c DESC NULLS LAST, i LIMIT 1),
p AS (SELECT fold, g.y, my + {value} AS score, best.alpha, best.c FROM solved JOIN sums USING (part) JOIN best USING (i), g WHERE k = {p + 1} AND part = 'both')
SELECT 'ridge' AS model, fold, count(*) AS n, {score_cols}, {rnd(best_alpha="max(alpha)", val_corr="max(c)")} FROM p GROUP BY fold"""


def oracle_sql() -> dict[str, str]:
    bar = rnd("open", "high", "low", "close", "volume", "trade_count", digits=EXACT) + ", vwap"
    c10, s10 = whole("avg", "close", 10), whole("stddev_samp", "close", 10)
    c20, s20 = whole("avg", "close", 20), whole("stddev_samp", "close", 20)
    split = "SELECT symbol, fold, count(*) AS n, min(ts) AS first, max(ts) AS last FROM f GROUP BY 1, 2"
    ratio10 = lambda x: f"{x} / nullif({whole('avg', x, 10)}, 0)"
    score_cols = rnd(corr="CASE WHEN stddev_pop(y) > 0 AND stddev_pop(score) > 0 THEN corr(y, score) END", rmse="sqrt(avg((y - score) * (y - score)))", mse="avg((y - score) * (y - score))", mae="avg(abs(y - score))", r2="1 - sum((y - score) * (y - score)) / nullif(var_pop(y) * count(*), 0)", directional_accuracy="avg(CASE WHEN sign(y) = sign(score) THEN 1.0 ELSE 0.0 END) * 100")
    persist = f"{BASE}, f AS (SELECT *, {FOLD} FROM y WHERE y IS NOT NULL), p AS (SELECT *, lag(y) OVER (PARTITION BY symbol, fold ORDER BY ts) AS score FROM f)"
    stats = f"count(net_return) AS n_periods, {rnd(CAGR=CAGR, AnnVol='stddev_pop(net_return) * sqrt(252.0::DOUBLE)', Sharpe=SHARPE, Sortino=f'CASE WHEN {DOWN} > 0 THEN avg(net_return) * 252 / ({DOWN} * sqrt(252.0::DOUBLE)) END', MaxDD='min(drawdown)', HitRate='avg(CASE WHEN net_return > 0 THEN 1.0 ELSE 0.0 END)', FinalWealth='1000 * arg_max(wealth, ts)')}"
    prof = " UNION ALL ".join(f"SELECT symbol, '{c}' AS \"column\", count({c}) AS n, {rnd(mean=f'avg({c})', std=f'stddev_samp({c})', min=f'min({c})', q25=f'quantile_cont({c}, 0.25)', q50=f'quantile_cont({c}, 0.5)', q75=f'quantile_cont({c}, 0.75)', max=f'max({c})')} FROM bars GROUP BY symbol" for c in PROFILE)
    feat = f"{BASE}, x AS (SELECT symbol, ts, close - open AS close_minus_open, high - low AS high_minus_low, momentum_5d, log_return, volume FROM y)"
    pairs = " UNION ALL ".join(f"SELECT '{a}' AS f1, '{b}' AS f2, round(corr({a}, {b}), {DIGITS}) AS corr FROM x" for a in CORR for b in CORR)
    miss = f"{BASE}, r AS (SELECT {c10} AS sma_10, {c20} AS sma_20, momentum_5d, {whole('stddev_samp', 'log_return', 20)} AS vol_20, 1 AS obv FROM y) " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, count({c}) AS present FROM r" for c in ("sma_10", "sma_20", "momentum_5d", "vol_20", "obv"))
    reg = f"""{FRAME}, pv AS (SELECT *, lag(net_return) OVER ({_SM}) AS p FROM bt WHERE net_return IS NOT NULL), vv AS (SELECT *, CASE WHEN count(p) OVER w = 20 THEN stddev_samp(p) OVER w END AS v FROM pv WINDOW w AS ({_SM} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
cc AS (SELECT symbol, model, quantile_cont(v, 1.0::DOUBLE / 3) AS lo, quantile_cont(v, 2.0::DOUBLE / 3) AS hi FROM vv GROUP BY 1, 2),
rg AS (SELECT vv.*, CASE WHEN v <= lo THEN 'low' WHEN v <= hi THEN 'mid' WHEN v > hi THEN 'high' END AS Regime FROM vv JOIN cc USING (symbol, model)), rr AS (SELECT * FROM rg WHERE Regime IS NOT NULL), {grown('symbol, model, Regime', 'rr')}
SELECT symbol, model, Regime, {rnd(CAGR=CAGR, Sharpe=SHARPE, MaxDD='min(drawdown)')}, count(net_return) AS Count FROM dd GROUP BY 1, 2, 3"""
    vol = "vol"
    out = {
        "targets_ewm": f"{scan('log_return')} SELECT symbol, ts, {rnd('log_return', ewma_vol_20=vol, y_raw='y', y_vol='y / nullif(vol, 0)')} FROM v",
        "features_scan": f"{scan('log_return')} SELECT symbol, ts, {rnd(ema_20='CASE WHEN i >= 20 THEN e20 END', ema_50='CASE WHEN i >= 50 THEN e50 END', rsi_14='CASE WHEN i >= 15 THEN 100 - 100 / (1 + up / nullif(down, 0)) END', macd='CASE WHEN i >= 26 THEN e12 - e26 END', macd_signal='CASE WHEN i >= 34 THEN signal END', macd_histogram='CASE WHEN i >= 34 THEN e12 - e26 - signal END')} FROM v",
        "backtest_vol_target": f"{SCALED} SELECT symbol, model, ts, {rnd('score', 'z_score', 'weight_pre_scaling', 'asset_volatility', 'risk_scaling_multiplier', 'weight', 'turnover', 'gross_return', 'transaction_cost', 'net_return')} FROM bt",
        "buy_and_hold": f"{FRAME}, bh AS (SELECT symbol, 'buy_and_hold' AS model, ts, y_next AS net_return FROM (SELECT DISTINCT symbol, ts FROM bt) JOIN y USING (symbol, ts)), {grown('symbol, model', 'bh')} SELECT symbol, model, {stats}, 0.0::DOUBLE AS AvgTurnover, 0.0::DOUBLE AS AnnTurnover, 0.0::DOUBLE AS TotalCost FROM dd GROUP BY 1, 2",
        "checks": _checks(),
        "pruned_features": _pruned(),
        "scaled_back": f"WITH {BARS} SELECT symbol, ts, {FOLD}, {rnd('close', 'volume', digits=EXACT)} FROM bars",
        "aligned": f"{BASE}, x AS (SELECT symbol, ts, {c10} AS sma_10, {whole('stddev_samp', 'log_return', 10)} AS vol_10, y FROM y) SELECT symbol, ts, {rnd('sma_10', 'vol_10', 'y')} FROM x WHERE sma_10 IS NOT NULL AND vol_10 IS NOT NULL AND y IS NOT NULL",
        "ewm_chunked": f"{scan('log_return')} SELECT symbol, ts, {rnd(ema_20='CASE WHEN i >= 20 THEN e20 END')} FROM v",
        "obv_of_tables": f"{BASE}, s AS (SELECT *, CAST(sign(coalesce(close - {lagged('close')}, 0)) AS DOUBLE) * volume AS sv FROM y) SELECT symbol, ts, {rnd(obv=_sum('sv'))} FROM s",
        "periods": f"{FRAME}, g AS (SELECT symbol, model, date_diff('day', lag(ts) OVER ({_SM}), ts) AS g FROM bt), m AS (SELECT symbol, model, quantile_cont(g, 0.5) AS g, count(g) AS n FROM g GROUP BY 1, 2) SELECT symbol, model, CAST(CASE WHEN n < 2 OR g <= 4 THEN 252 WHEN g <= 10 THEN 52 WHEN g <= 45 THEN 12 WHEN g <= 135 THEN 4 ELSE 1 END AS BIGINT) AS periods_per_year FROM m",
        "bars_daily": f"WITH {BARS} SELECT symbol, ts, {bar} FROM bars",
        "bars_hourly": f"SELECT event_type AS symbol, strftime(ts, '%Y-%m-%d %H') AS ts, {rnd(open='arg_min(value, row(ts, event_id))', high='max(value)', low='min(value)', close='arg_max(value, row(ts, event_id))', volume='sum(q)', vwap='sum(value * q) / sum(q)', trade_count='count(*)')} FROM (SELECT *, 1 + CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS q FROM events) GROUP BY 1, 2",
        "bars_brand": f"WITH b AS (SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS ts, {_BAR} FROM (SELECT *, {_PRICE} FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1, 2) SELECT symbol, ts, {bar} FROM b",
        "bars_clean": f"WITH {BARS} SELECT symbol, ts, {bar} FROM bars WHERE open >= 1000",
        "last_rows": f"WITH {BARS} SELECT symbol, ts, {bar} FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 50",
        "targets": f"{BASE} SELECT symbol, ts, {rnd('log_return', 'y_next', y_raw='y')} FROM y",
        "features_price": f"{BASE} SELECT symbol, ts, {rnd('log_return', 'momentum_5d', digits=EXACT, close_minus_open='close - open', high_minus_low='high - low', close_over_open='close / open', high_over_low='high / low', simple_return=f'close / {lagged("close")} - 1')} FROM y",
        "features_technical": f"{BASE} SELECT symbol, ts, {rnd(sma_10=c10, sma_20=c20, bb_middle_20=c20, bb_upper_20=f'{c20} + 2 * {s20}', bb_lower_20=f'{c20} - 2 * {s20}', stochastic_k_14=f'CASE WHEN count(close) {over(14)} = 14 THEN (close - min(low) {over(14)}) / nullif(max(high) {over(14)} - min(low) {over(14)}, 0) * 100 END')} FROM y",
        "features_volume": f"{BASE}, s AS (SELECT *, CAST(sign(coalesce(close - {lagged('close')}, 0)) AS DOUBLE) * volume AS sv FROM y) SELECT symbol, ts, {rnd(volume_change=f'volume / {lagged("volume")} - 1', volume_over_avg_10d=ratio10('volume'), obv=_sum('sv'), close_minus_vwap='close - vwap', close_over_vwap='close / vwap', trade_count_change=f'trade_count / {lagged("trade_count")} - 1', trade_count_over_avg_10d=ratio10('trade_count'))} FROM s",
        "features_volatility": f"{BASE} SELECT symbol, ts, {rnd(vol_10=whole('stddev_samp', 'log_return', 10), rolling_std_10=s10, rolling_mean_10=c10, vol_20=whole('stddev_samp', 'log_return', 20), rolling_std_20=s20, rolling_mean_20=c20, z_score_10=f'(close - {c10}) / nullif({s10}, 0)')} FROM y",
        "features_autocorr": _autocorr(),
        "features_hurst": _hurst(),
        "features_entropy": _ENTROPY,
        "split": f"WITH {BARS}, f AS (SELECT *, {FOLD} FROM bars) {split}",
        "split_panel": f"WITH {BARS}, dy AS (SELECT ts, CASE WHEN row_number() OVER (ORDER BY ts) <= floor(count(*) OVER () * 0.70::DOUBLE) THEN 'train' WHEN row_number() OVER (ORDER BY ts) <= floor(count(*) OVER () * 0.85::DOUBLE) THEN 'val' ELSE 'test' END AS fold FROM (SELECT DISTINCT ts FROM bars)), f AS (SELECT * FROM bars JOIN dy USING (ts)) {split}",
        "describe": f"WITH {BARS} {prof}",
        "missing": miss,
        "correlations": f"{feat} {pairs}",
        "scaled": f"WITH {BARS}, f AS (SELECT *, {FOLD} FROM bars), m AS (SELECT avg(close) AS mc, stddev_pop(close) AS sc, avg(volume) AS mv, stddev_pop(volume) AS sv FROM f WHERE fold = 'train') SELECT symbol, ts, fold, {rnd(close='(close - mc) / sc', volume='(volume - mv) / sv')} FROM f, m",
        "sequences": f"WITH {BARS}, f AS (SELECT *, {FOLD} FROM bars), g AS (SELECT *, lag(volume, 59) OVER w AS fv, row_number() OVER w AS i, count(*) OVER (PARTITION BY symbol, fold) AS n FROM f WINDOW w AS (PARTITION BY symbol, fold ORDER BY ts)) SELECT symbol, ts, fold, CAST(60 AS BIGINT) AS \"rows\", {rnd(first_volume='CAST(fv AS FLOAT)', y='volume')} FROM g WHERE i >= 60 AND i < n",
        "scores_persistence": f"{persist} SELECT 'persistence' AS model, fold, count(*) AS n, {score_cols} FROM p WHERE score IS NOT NULL GROUP BY fold",
        "fold_table": f"{persist} SELECT 'persistence' AS model, " + ", ".join(f"round(sqrt(avg((y - score) * (y - score)) FILTER (fold = '{f}')), {DIGITS}) AS {f}" for f in ("train", "val", "test")) + " FROM p WHERE score IS NOT NULL",
        "price_path": f"{BASE}, q AS (SELECT *, log_return * 0.01::DOUBLE AS predicted FROM y WHERE log_return IS NOT NULL) SELECT symbol, ts, {rnd(anchored='close * exp(predicted)', chained=f'first_value(close) OVER (PARTITION BY symbol ORDER BY ts) * exp({_sum("predicted")})')} FROM q",
        "backtest": f"{FRAME} SELECT symbol, model, ts, {rnd('score', 'z_score', 'weight', 'turnover', 'gross_return', 'transaction_cost', 'net_return')} FROM bt",
        "summary": f"{FRAME}, {grown('symbol, model')}, a AS (SELECT symbol, model, {stats} FROM dd GROUP BY 1, 2), c AS (SELECT symbol, model, {rnd(AvgTurnover='avg(turnover)', AnnTurnover='avg(turnover) * 252', TotalCost='sum(transaction_cost)')} FROM bt GROUP BY 1, 2) SELECT * FROM c JOIN a USING (symbol, model)",
        "max_drawdown": f"{FRAME}, {grown('symbol, model')}, t AS (SELECT symbol, model, min(drawdown) AS mdd, arg_min(ts, row(drawdown, ts)) AS trough, arg_min(peak_w, row(drawdown, ts)) AS pw FROM dd GROUP BY 1, 2) SELECT t.symbol, t.model, round(mdd, {DIGITS}) AS MaxDD, min(dd.ts) AS peak, trough FROM t JOIN dd ON t.symbol = dd.symbol AND t.model = dd.model AND dd.wealth = pw AND dd.ts <= trough GROUP BY ALL",
        "wealth": f"{FRAME}, {grown('symbol, model')} SELECT symbol, ts, {rnd(digits=3, momentum='max(wealth) FILTER (model = $$momentum$$)', persistence='max(wealth) FILTER (model = $$persistence$$)')} FROM dd GROUP BY 1, 2",
        "trades": f"{TRADES} SELECT symbol, model, trade_id, side, \"start\", \"end\", n_days, {rnd('pnl', pnl_per_day='pnl / n_days')}, CAST(pnl > 0 AS BIGINT) AS hit FROM tr",
        "trade_summary": f"{TRADES} SELECT symbol, model, count(*) AS Trades, {rnd(HitRate_trades='avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END)', MeanPnL_per_trade='avg(pnl)', MedianPnL_per_trade='median(pnl)', AvgDays_per_trade='avg(n_days)')} FROM tr GROUP BY 1, 2",
        "attribution": f"{FRAME} SELECT symbol, model, {rnd(PnL_long='coalesce(sum(net_return) FILTER (weight > 1e-6), 0)', PnL_short='coalesce(sum(net_return) FILTER (weight < -1e-6), 0)', AvgPnL_day_long='avg(net_return) FILTER (weight > 1e-6)', AvgPnL_day_short='avg(net_return) FILTER (weight < -1e-6)')}, count(net_return) FILTER (weight > 1e-6) AS Days_long, count(net_return) FILTER (weight < -1e-6) AS Days_short FROM bt GROUP BY 1, 2",
        "yearly": f"{FRAME}, yr AS (SELECT *, CAST(year(ts) AS BIGINT) AS Year FROM bt), {grown('symbol, model, Year', 'yr')} SELECT symbol, model, Year, {rnd(CAGR=CAGR, Sharpe=SHARPE, MaxDD='min(drawdown)')} FROM dd GROUP BY 1, 2, 3",
        "regimes": reg,
    }
    out["ridge"] = _ridge(score_cols, f"(close - {c10}) / nullif({s10}, 0)", whole("stddev_samp", "log_return", 10))
    out["bars_stored"] = f"WITH {BARS} SELECT symbol, ts, {bar} FROM bars WHERE ts BETWEEN DATE '1996-12-31' AND DATE '1998-12-31'"
    out["bars_deduplicated"] = f"WITH {BARS} SELECT symbol, ts, {bar} FROM bars WHERE day(ts) % 7 <> 0 AND volume % 5 NOT IN (0, 1)"
    out["aligned_left"] = f"{BASE} SELECT symbol, ts, {rnd('close', sma_10=c10, digits=EXACT)} FROM y"
    path = f"{out['price_path'].partition(' SELECT symbol, ts, round')[0]}, pp AS (SELECT symbol, close * exp(predicted) AS anchored, first_value(close) OVER (PARTITION BY symbol ORDER BY ts) * exp({_sum('predicted')}) AS chained, lead(close) OVER (PARTITION BY symbol ORDER BY ts) AS nx FROM q)"
    ps = lambda p: f"SELECT symbol, '{p}' AS path, {rnd(r2=f'1 - sum(({p} - nx) * ({p} - nx)) / (var_pop(nx) * count(*))', mae=f'avg(abs({p} - nx))', rmse=f'sqrt(avg(({p} - nx) * ({p} - nx)))', mape=f'avg(abs({p} - nx) / nx) * 100')} FROM pp WHERE nx IS NOT NULL GROUP BY symbol"
    out["price_path_scores"] = f"{path} {ps('anchored')} UNION ALL {ps('chained')}"
    out["strategy_table"] = f"SELECT * FROM ({out['summary']}) UNION ALL BY NAME SELECT * FROM ({out['buy_and_hold']})"
    day = "strftime(ts, '%Y-%m-%d %H:%M:%S')"
    out["shuffled_scores"] = f"""{BASE}, sc AS (SELECT symbol, ts, 'persistence' AS model, log_return AS score FROM y UNION ALL SELECT symbol, ts, 'momentum', momentum_5d FROM y),
d AS (SELECT symbol, model, ts, row_number() OVER ({_SM}) AS n FROM sc), v AS (SELECT symbol, model, score, row_number() OVER (PARTITION BY symbol, model ORDER BY md5('42:' || {day}), ts) AS n FROM sc)
SELECT symbol, model || '_shuffled' AS model, ts, {rnd('score')} FROM d JOIN v USING (symbol, model, n)"""
    blocks = ["features_price", "features_technical", "features_scan", "features_volume", "features_volatility", "features_autocorr", "features_hurst", "features_entropy"]
    names = [*PRICE, *TECHNICAL, *SCAN, *VOLUME, *VOLATILITY, "entropy_close_20", "hurst_close_100", *AUTOCORR]
    joined = " JOIN ".join(f"({out[b]}) AS {b}" + (" USING (symbol, ts)" if i else "") for i, b in enumerate(blocks))
    before = ", ".join(f"lag({c}) OVER (PARTITION BY symbol ORDER BY ts) AS {c}" for c in names)
    out["feature_matrix"] = f"SELECT * FROM (SELECT symbol, ts, {before} FROM {joined}) WHERE {' AND '.join(f'{c} IS NOT NULL' for c in names)}"
    out |= {f"{name}_chunked": out[name] for name in ("feature_matrix", "max_drawdown", "trades", "trade_summary", "regimes")}
    m = f"WITH m AS MATERIALIZED ({out['feature_matrix']})"
    planted = "SELECT m.*, planted FROM m JOIN (SELECT symbol, ts, lead(close) OVER (PARTITION BY symbol ORDER BY ts) AS planted FROM bars) USING (symbol, ts)"
    out["checks_matrix"] = _checks((*MATRIX, "planted"), tuple(BARS_OF), f"{m}, {BARS}", planted)
    out["correlations_matrix"] = f"{m}, {_pairs(MATRIX, 'm')} {_listed(MATRIX, 'c')}"
    only = " ".join(f"WHEN {{i}} = {i} THEN kept_{i}" for i in range(25))
    out["pruned_matrix"] = f"{m}, t AS (SELECT * FROM (SELECT *, {FOLD} FROM m) WHERE fold = 'train'), {_pairs(MATRIX, 't')}, {_kept(MATRIX, 25)} {_listed(MATRIX, 'k24', f'CASE {only} ELSE FALSE END')}"
    out["results_stored"] = f"{FRAME} SELECT symbol, model, ts, {rnd('score', 'z_score', 'weight', 'net_return')} FROM bt WHERE model = 'momentum'"
    out["features_frozen"] = out["pruned_features"]
    out["columns_numeric"] = f"WITH {BARS} SELECT symbol, ts, {rnd('volume', 'close', digits=EXACT)} FROM bars"
    window = "PARTITION BY symbol, fold ORDER BY ts"
    cells = " || ':' || ".join(f"CAST(floor(CAST(CAST({c} AS FLOAT) AS DOUBLE) * 4096) AS BIGINT)" for c in ("close", "volume"))
    out["sequences_stored"] = f"""WITH {BARS}, f AS (SELECT *, {FOLD} FROM bars), g AS (SELECT *, list({cells}) OVER ({window} ROWS 59 PRECEDING) AS l, lead(1) OVER ({window}) AS more FROM f)
SELECT symbol, ts, fold, md5(array_to_string(l, ',')) AS contents, {rnd(y="volume")} FROM g WHERE len(l) = 60 AND more = 1"""
    out["backtest_chunked"] = out["backtest_vol_target"]
    out["rolling_median"] = f"WITH {BARS} SELECT symbol, ts, {rnd(median_30=whole('median', 'close', 30))} FROM bars"
    return out
