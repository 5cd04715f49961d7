"""Windows cut from chunks against the windows that hold their rows."""

import numpy as np
import pandas as pd
import pytest

from marketspark.operators import datasets, tensors


@pytest.mark.parametrize(("length", "size", "keep_last"), [(5, 7, False), (5, 7, True), (1, 4, False), (12, 3, False), (60, 4096, True)])
def test_equal_to_copied_rows(spark, length, size, keep_last):
    rng = np.random.default_rng(1)
    p = pd.DataFrame({"symbol": np.repeat(["a", "b", "c"], [90, 22, 1]), "ts": pd.date_range("2020-01-01", periods=113), "x": rng.normal(size=113), "z.1": rng.normal(size=113)})
    df = spark.createDataFrame(p).repartition(3)
    df = datasets.chronological(df).withColumnRenamed("z.1", "z")
    df = df.withColumn("y", df.x * 2)
    got = tensors.sequence_windows(tensors.sequence_chunks(df, ["x", "z"], "y", length, size), 2, length, keep_last).collect()
    want = {(r.symbol, r.fold, r.ts): r for r in datasets.sequences(df, ["x", "z"], "y", length, keep_last).collect()}
    assert len(got) == len(want) and (length > 50 or want)
    for r in got:
        w = want[r.symbol, r.fold, r.ts]
        np.testing.assert_array_equal(np.frombuffer(r.sequence, np.float32).reshape(length, 2), np.array(w.sequence, np.float32))
        assert r.y == w.y


def test_stored_size_gaps_and_no_rows(spark):
    n = 9000
    df = spark.range(n).selectExpr("'a' AS symbol", "timestamp_seconds(id * 86400) AS ts", "'train' AS fold", "IF(id % 10 = 0, NULL, id) AS x", "IF(id % 7 = 0, NULL, id) AS y")
    chunks = tensors.sequence_chunks(df, ["x"], "y")
    rows = chunks.selectExpr("sum(length(rows)) / 4 AS n", "sum(size(ts)) AS own").first()
    assert rows.own == n and rows.n < 1.1 * n
    first = tensors.sequence_windows(chunks, 1).orderBy("ts").first()
    x = np.frombuffer(first.sequence, np.float32)
    np.testing.assert_array_equal(x, [np.nan if i % 10 == 0 else i for i in range(60)])
    assert first.y == 59 and tensors.sequence_windows(chunks, 1).filter("y is null").count() == sum(i % 7 == 0 for i in range(59, n - 1))
    assert tensors.sequence_windows(tensors.sequence_chunks(df.filter("false"), ["x"], "y"), 1).count() == 0
