"""Baselines and feature selection. The driver sees sums over rows, never rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .datasets import correlations


def persistence(df: DataFrame, y: str = "y") -> DataFrame:
    """The last known target as a forecast, within each fold."""
    return df.withColumn("score", F.lag(y).over(Window.partitionBy("symbol", "fold").orderBy("ts"))).withColumn("model", F.lit("persistence"))


def gram(df: DataFrame, columns: list[str], y: str, centre: np.ndarray) -> dict[str, np.ndarray]:
    """For each fold the sums of z z' with z = (1, x - centre, y): one scan, one row a task and fold."""
    p = len(columns) + 2

    def part(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for pdf in it:
            for fold, g in pdf.groupby("fold"):
                z = np.column_stack([np.ones(len(g)), g[columns].to_numpy(float) - centre, g[y].to_numpy(float)])
                total[fold] = total.get(fold, 0) + z.T @ z
        for fold, m in total.items():
            yield pd.DataFrame({"fold": fold, "i": np.arange(p * p), "v": m.ravel()})

    rows = df.select("fold", *columns, y).dropna("any").mapInPandas(part, "fold string, i int, v double").groupBy("fold", "i").agg(F.sum("v").alias("v")).collect()  # folds x p x p numbers
    out: dict[str, np.ndarray] = {}
    for r in rows:
        out.setdefault(r.fold, np.zeros(p * p))[r.i] = r.v
    return {f: m.reshape(p, p) for f, m in out.items()}


def _solve(g: np.ndarray, alpha: float) -> tuple[float, np.ndarray]:
    """Intercept and slopes for standardised inputs, in units of the centred inputs."""
    n = g[0, 0]
    mx, my = g[0, 1:-1] / n, g[0, -1] / n
    sxx, sxy = g[1:-1, 1:-1] - n * np.outer(mx, mx), g[1:-1, -1] - n * mx * my
    sd = np.sqrt(np.maximum(np.diag(sxx) / n, 0))
    sd[sd == 0] = 1
    b = np.linalg.solve(sxx / np.outer(sd, sd) + alpha * np.eye(len(sd)), sxy / sd) / sd
    return my - b @ mx, b


def _fit_quality(g: np.ndarray, a: float, b: np.ndarray) -> tuple[float, float]:
    """Correlation and RMSE on the rows of a Gram matrix."""
    n = g[0, 0]
    w = np.array([a, *b])
    pp, py, yy = w @ g[:-1, :-1] @ w, w @ g[:-1, -1], g[-1, -1]
    mp, my = w @ g[:-1, 0] / n, g[-1, 0] / n
    vp, vy = pp / n - mp**2, yy / n - my**2
    c = (py / n - mp * my) / np.sqrt(vp * vy) if vp > 1e-300 and vy > 1e-300 else np.nan
    return c, float(np.sqrt(max(pp - 2 * py + yy, 0) / n))


def ridge(df: DataFrame, columns: list[str], y: str = "y", alphas: list[float] | None = None, refit: bool = True) -> dict:
    """Ridge on the train fold, its penalty chosen by correlation on the validation fold (the first of equal ones)."""
    alphas = [x for x in (np.logspace(-4, 4, 25) if alphas is None else alphas) if x > 0 and np.isfinite(x)]
    if not alphas:
        raise ValueError("no positive, finite penalty given")
    means = df.filter("fold = 'train'").agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in columns)).first()
    centre = np.array([means[c] for c in columns], float)
    g = gram(df, columns, y, centre)
    if "train" not in g or "val" not in g:
        raise ValueError("train and val folds need rows")
    best = None
    for alpha in alphas:
        c, rmse = _fit_quality(g["val"], *_solve(g["train"], alpha))
        if np.isfinite(c) and (best is None or c > best[1]):
            best = (float(alpha), float(c), rmse)
    if best is None:
        raise ValueError("no penalty gives a defined correlation")
    a, b = _solve(g["train"] + g["val"] if refit else g["train"], best[0])
    return {"best_alpha": best[0], "val_corr": best[1], "val_rmse": best[2], "intercept": float(a - b @ centre), "coefficients": dict(zip(columns, b.tolist(), strict=True))}


def predict_linear(df: DataFrame, model: dict, name: str = "ridge") -> DataFrame:
    score = sum((F.lit(b) * F.col(c) for c, b in model["coefficients"].items()), F.lit(model["intercept"]))
    return df.withColumn("score", score).withColumn("model", F.lit(name))


def _assembled(df: DataFrame, columns: list[str], y: str) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=columns, outputCol="_x").transform(df.dropna("any", subset=[*columns, y]))


def best_round(errors: list[float], patience: int) -> tuple[int, bool]:
    """The round (from 1) of the least error before ``patience`` rounds bring none smaller, and whether they were seen."""
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


def boosted(df: DataFrame, columns: list[str], y: str = "y", rounds: int = 2000, depth: int = 3, step: float = 0.05, share: float = 0.8, patience: int = 50, seed: int = 42) -> tuple[object, int]:
    """Boosted trees, stopped when ``patience`` rounds bring no smaller validation error, then a refit of the best number of rounds on train and validation.

    A fit cannot be continued, so it is repeated with twice the rounds until it was long enough; a round's tree depends on the seed and those before, not on
    their number.
    """
    from pyspark.ml.regression import GBTRegressor

    if rounds < 1 or patience < 1:
        raise ValueError("rounds and patience must be at least 1")
    rows = _assembled(df, columns, y).cache()
    make = lambda n: GBTRegressor(featuresCol="_x", labelCol=y, maxIter=n, maxDepth=depth, stepSize=step, subsamplingRate=share, featureSubsetStrategy=str(share), seed=seed)
    n, done = min(rounds, 2 * patience), False
    while not done:
        errors = make(n).fit(rows.filter("fold = 'train'")).evaluateEachIteration(rows.filter("fold = 'val'"), "squared")
        best, done = best_round(errors, patience)
        done, n = done or n == rounds, min(2 * n, rounds)
    model = make(best).fit(rows.filter("fold in ('train', 'val')"))
    rows.unpersist()
    return model, best


def forest(df: DataFrame, columns: list[str], y: str = "y", trees: int = 600, depth: int = 30, least: int = 2, memory: int = 32, seed: int = 42):
    """A random forest on the train fold. ``memory``: MB of split statistics that a task holds at a time; the driver holds the trees, up to 2^depth nodes each."""
    from pyspark.ml.regression import RandomForestRegressor

    return RandomForestRegressor(featuresCol="_x", labelCol=y, numTrees=trees, maxDepth=depth, minInstancesPerNode=least, featureSubsetStrategy="all", maxMemoryInMB=memory, seed=seed).fit(_assembled(df.filter("fold = 'train'"), columns, y))


def predict_trees(df: DataFrame, model, columns: list[str], name: str = "boosted", y: str = "y") -> DataFrame:
    """Rows with all inputs, and their ``score`` by a fitted ensemble of trees."""
    return model.transform(_assembled(df, columns, y)).withColumnRenamed("prediction", "score").withColumn("model", F.lit(name)).drop("_x")


def permutation_importance(df: DataFrame, columns: list[str], predict, y: str = "y", repeats: int = 20, seed: int = 42, block: int = 200_000) -> DataFrame:
    """Mean and deviation of the fall in validation correlation when a column is permuted, most important first.

    ``predict`` maps a DataFrame with the columns to the same rows with ``score``, and keeps other columns. Columns are permuted one at a time, all of a repeat by
    the same permutation: a row's value comes from the row with the same rank in a random order, an equi-join on the rank. Rows are dealt by hash into blocks of
    about ``block`` rows, anew in each repeat, and permuted inside them, so no task orders all rows. The plan has one join, whatever the number of columns.
    """
    from marketspark.functions.windows import corr

    val = df.filter("fold = 'val'").select(*columns, y).dropna("any")
    val = val.withColumn("_id", F.xxhash64(*columns, y))
    base, n = predict(val).agg(corr(F.col(y), F.col("score")), F.count("*")).first()
    base, blocks = base or 0.0, -(-n // block) or 1
    packed = val.select("_id", y, F.array(*(F.col(c).cast("double") for c in columns)).alias("_v"))
    copies = packed.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("_block", F.pmod(F.xxhash64("_id", "_rep", F.lit(seed)), F.lit(blocks)))
    rank = lambda *o: F.row_number().over(Window.partitionBy("_rep", "_block").orderBy(*o))
    natural = copies.withColumn("_k", rank("_id"))
    moved = copies.select("_rep", "_block", F.col("_v").alias("_moved"), rank(F.xxhash64("_id", "_rep", F.lit("order"), F.lit(seed)), "_id").alias("_k"))
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number, so that rows small before they are repeated are not put in few tasks
    one = natural.join(moved, ["_rep", "_block", "_k"]).repartition(spread, "_rep", "_k").withColumn("_at", F.explode(F.sequence(F.lit(0), F.lit(len(columns) - 1))))
    value = lambda k, c: F.when(F.col("_at") == k, F.col("_moved")[k]).otherwise(F.col("_v")[k]).alias(c)
    scored = predict(one.select("_rep", "_at", y, *(value(k, c) for k, c in enumerate(columns))))
    falls = scored.groupBy("_at", "_rep").agg(corr(F.col(y), F.col("score")).alias("s"))
    fall = F.lit(base) - F.coalesce("s", F.lit(0.0))
    names = F.array(*map(F.lit, columns))
    return falls.groupBy(names[F.col("_at")].alias("feature")).agg(F.avg(fall).alias("importance"), F.stddev_pop(fall).alias("std")).orderBy(F.desc("importance"), "feature")


def prune_redundant(df: DataFrame, ranked: list[str], most: float = 0.95, top: int | None = None) -> list[str]:
    """In order of rank, columns whose correlation with every kept one is below ``most``; an undefined one fails."""
    return prune_by(correlations(df.filter("fold = 'train'"), ranked), ranked, most, top)


def prune_by(pairs: DataFrame, ranked: list[str], most: float = 0.95, top: int | None = None) -> list[str]:
    """The same from rows (f1, f2, corr), for the ``top`` first of the ranked columns."""
    c = {(r.f1, r.f2): r["corr"] for r in pairs.collect()}  # p x p numbers
    kept: list[str] = []
    for f in ranked[:top]:
        if all(c.get((f, k)) is not None and abs(c[f, k]) < most for k in kept):
            kept.append(f)
    return kept
