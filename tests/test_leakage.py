"""Leakage checks in one scan against a plain version, over forced partitions and batches."""

import numpy as np
import pandas as pd
import pytest

from marketspark.operators import checks, leakage

FEATURES, BASE = ["same", "leak 2", "part", "still"], ["open", "close.x"]


def tables(seed=0, sizes=(("a", 90), ("b", 1), ("c", 40), ("d", 2))):
    rng = np.random.default_rng(seed)
    raw = pd.concat([pd.DataFrame({"symbol": s, "ts": pd.date_range("2020-01-01", periods=n), "open": rng.normal(size=n), "close.x": rng.normal(size=n)}) for s, n in sizes], ignore_index=True)
    by = raw.groupby("symbol")
    x = raw[["symbol", "ts"]].assign(**{"same": raw.open, "leak 2": by["close.x"].shift(-2), "part": by["open"].shift(-1).where(rng.random(len(raw)) < 0.5), "still": 1.0})
    x = x[rng.random(len(x)) < 0.97]
    y = raw[["symbol", "ts"]][rng.random(len(raw)) < 0.9]
    return raw, x, y


def plain(raw, x, y, ahead, lag, share=0.95):
    key = ["symbol", "ts"]
    xs, ys = set(map(tuple, x[key].to_numpy())), set(map(tuple, y[key].to_numpy()))
    out = [("unique_keys", "symbol, ts", int((raw.groupby(key).size() > 1).sum())), ("unique_keys", "symbol, ts", int((x.groupby(key).size() > 1).sum()))]
    out += [("complete", f, int((~np.isfinite(x[f])).sum())) for f in FEATURES]
    out.append(("same_keys", "symbol, ts", len(xs ^ ys)))
    raw = raw.sort_values(key)
    for b in BASE:
        for f in FEATURES:
            for k in range(1, ahead + 1):
                both = x.merge(raw[key].assign(later=raw.groupby("symbol")[b].shift(-k)), on=key)
                n = int((both[f] == both.later).sum())
                if n and n >= np.floor(share * len(both)):
                    out.append(("future_fields", f"{f} = {b} + {k}", n))
    x = x.sort_values(key)
    for f in FEATURES:
        there = x.groupby("symbol").cumcount(ascending=False) >= lag
        later = x.groupby("symbol")[f].shift(-lag)
        equal = ((x[f] == later) | (x[f].isna() & later.isna()))[there]
        out.append(("lookahead", f, int(len(equal) > 0 and equal.all())))
    return sorted(out)


def table(spark, p):
    df = spark.createDataFrame(p)
    return df.select("symbol", "ts", *(df[f"`{c}`"] for c in p.columns[2:]))


@pytest.mark.parametrize(("parts", "batch", "ahead", "lag"), [(1, 10000, 3, 1), (1, 2, 3, 2), (4, 3, 3, 1), (40, 1, 5, 3), (200, 10000, 3, 1)])
def test_scan_equals_plain(spark, parts, batch, ahead, lag):
    p = tables()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = leakage.scan(*(table(spark, t) for t in p), FEATURES, BASE, ahead, lag, share=0.9).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = plain(*p, ahead, lag, 0.9)
    assert sorted((r.check, r.subject, r.violations) for r in got) == want
    assert all(r.passed == (r.violations == 0) for r in got)
    assert [s for c, s, _ in want if c == "future_fields"] == ["leak 2 = close.x + 2"]


def test_repeated_null_and_no_rows(spark):
    raw, x, y = (table(spark, t) for t in tables(1))
    null = spark.createDataFrame([(None, None, 1.0, None, 0.0, 1.0)], "symbol string, ts timestamp, a double, b double, c double, d double").toDF(*x.columns)
    got = leakage.scan(raw.unionAll(raw.limit(7)), x.unionAll(x.limit(3)).unionAll(null), x.select("symbol", "ts").unionAll(null.select("symbol", "ts")), FEATURES, BASE).collect()
    by = [(r.check, r.violations) for r in got if r.check in ("unique_keys", "same_keys")]
    assert by == [("unique_keys", 7), ("unique_keys", 3), ("same_keys", 2)]
    empty = leakage.scan(raw.filter("false"), x.filter("false"), y.filter("false"), FEATURES, BASE).collect()
    assert len(empty) == 3 + 2 * len(FEATURES) and all(r.passed for r in empty)


def test_two_exchanges(spark, tmp_path):
    names = ("raw", "x", "y")
    for name, t in zip(names, tables(), strict=True):
        table(spark, t).write.parquet(f"{tmp_path}/{name}")
    raw, x, y = (spark.read.parquet(f"{tmp_path}/{n}") for n in names)
    plan = checks.run_all(raw, x, y, FEATURES, BASE)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and plan.count("FileScan") == 3
