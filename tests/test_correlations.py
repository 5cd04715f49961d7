"""Blocked correlations against NumPy, pair by pair."""

import numpy as np
import pandas as pd
import pytest

from marketspark.operators import datasets, models


def plain(p, a, b):
    both = p[[a, b]].replace([np.inf, -np.inf], np.nan).dropna() if a != b else p[[a]].replace([np.inf, -np.inf], np.nan).dropna()
    x, y = both[a], both[b]
    return None if len(both) < 2 or x.nunique() < 2 or y.nunique() < 2 else float(np.corrcoef(x, y)[0, 1])


@pytest.mark.parametrize("block", [3, 256])
def test_pairs_with_gaps(spark, block):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)) + 1e4
    x[:, 1] = x[:, 0] * -2 + rng.normal(size=300) * 0.1
    x[:, 2] = 7.5  # doesn't vary
    x[rng.random(x.shape) < 0.2] = np.nan
    x[3, 4], x[5, 5] = np.inf, -np.inf
    x[:, 6] = np.nan
    p = pd.DataFrame(x, columns=[f"f {i}" for i in range(8)])
    df = spark.createDataFrame(p).repartition(7)
    got = {(r.f1, r.f2): r["corr"] for r in datasets.correlations(df, list(p.columns), block).collect()}
    assert len(got) == 64
    for (a, b), c in got.items():
        want = plain(p, a, b)
        assert (c is None) == (want is None) and (c is None or abs(c - want) < 1e-9), (a, b)
    ranked = ["f 0", "f 1", "f 2", "f 3", "f 4"]
    assert models.prune_by(datasets.correlations(df, list(p.columns), block), ranked) == ["f 0", "f 3", "f 4"]
    assert models.prune_by(datasets.correlations(df, list(p.columns), block), ranked, top=4) == ["f 0", "f 3"]


def test_many_columns_and_no_rows(spark):
    names = [f"c{i}" for i in range(500)]
    wide = spark.createDataFrame(pd.DataFrame(np.random.default_rng(1).normal(size=(50, 500)), columns=names)).repartition(2)
    assert datasets.correlations(wide, names).count() == 250_000
    assert datasets.correlations(wide.filter("false"), names[:3]).filter("corr is not null").count() == 0
