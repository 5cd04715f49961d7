"""Quality and leakage checks as rows (check, subject, violations, passed)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketspark.functions.windows import finite
from marketspark.operators.leakage import scan

KEYS = ["symbol", "ts"]


def _known(df: DataFrame, check: str, violations: dict[str, int]) -> DataFrame:
    return df.sparkSession.createDataFrame([(check, s, n, n == 0) for s, n in violations.items()], "check string, subject string, violations long, passed boolean")


def _counted(check: str, subject, n) -> list:
    return [F.lit(check).alias("check"), subject.alias("subject"), n.cast("long").alias("violations"), (n == 0).alias("passed")]


def required_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return _known(df, "required_columns", {c: int(c not in df.columns) for c in columns})


def duplicate_columns(df: DataFrame) -> DataFrame:
    low = [c.lower() for c in df.columns]
    return _known(df, "duplicate_columns", {"all": len(low) - len(set(low))})


def time_type(df: DataFrame, column: str = "ts") -> DataFrame:
    """Times must be timestamps; rows of a table have no order of their own, so operators order by them."""
    return _known(df, "time_type", {column: int(column not in df.columns or df.schema[column].dataType.typeName() not in ("timestamp", "timestamp_ntz"))})


def unique_keys(df: DataFrame) -> DataFrame:
    return df.groupBy(*KEYS).count().agg(F.count_if(F.col("count") > 1).alias("n")).select(*_counted("unique_keys", F.lit("symbol, ts"), F.col("n")))


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing, NaN or infinite values per column, in one pass."""
    one = df.agg(*(F.count_if(finite(F.col(c).cast("double")).isNull()).alias(c) for c in columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("s"), F.col(c).alias("n")) for c in columns))).alias("x")).select(*_counted("complete", F.col("x.s"), F.col("x.n")))


def same_keys(x: DataFrame, y: DataFrame) -> DataFrame:
    a, b = x.select(*KEYS), y.select(*KEYS)
    out = a.join(b, KEYS, "left_anti").select(F.lit("left").alias("s")).union(b.join(a, KEYS, "left_anti").select(F.lit("right").alias("s")))
    return out.agg(F.count("*").alias("n")).select(*_counted("same_keys", F.lit("symbol, ts"), F.col("n")))


def future_fields(x: DataFrame, raw: DataFrame, features: list[str], base: list[str], ahead: int = 3, atol: float = 0.0, rtol: float = 0.0, share: float = 0.95) -> DataFrame:
    """Pairs where a feature equals (or comes as near as allowed to) a base column of 1 ... ``ahead`` rows later on nearly all rows."""
    return scan(raw, x, x, features, base, ahead, atol=atol, rtol=rtol, share=share).filter("check = 'future_fields'")


def lookahead(x: DataFrame, features: list[str], lag: int = 1) -> DataFrame:
    """Features that equal themselves ``lag`` rows later wherever there is such a row."""
    return scan(x, x, x, features, [], lag=lag).filter("check = 'lookahead'")


def run_all(raw: DataFrame, x: DataFrame, y: DataFrame, features: list[str], base: list[str], ahead: int = 3) -> DataFrame:
    """All checks: names and types from the schema, the rest in one scan of the three tables. Base columns that raw lacks are only reported."""
    named = [required_columns(raw, base), duplicate_columns(x), time_type(raw)]
    return reduce(DataFrame.unionByName, named).unionByName(scan(raw, x, y, features, [b for b in base if b in raw.columns], ahead))


def raise_on_failure(checks: DataFrame) -> None:
    failed = checks.filter("not passed").limit(20).collect()
    if failed:
        raise ValueError("; ".join(f"{r.check}({r.subject}): {r.violations}" for r in failed))
