"""Exponentially weighted mean and deviation: a scan in order, a series at a time. :mod:`marketspark.functions.chunks` has the form for long series."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass(frozen=True)
class Ewm:
    """A column to make: ``kind`` mean or std of ``x`` (less ``minus``), by span or alpha; no value before ``least`` observations."""

    name: str
    x: str
    kind: str = "mean"
    minus: str | None = None
    span: float | None = None
    alpha: float | None = None
    least: int = 0

    @property
    def a(self) -> float:
        return self.alpha if self.alpha is not None else 2.0 / (self.span + 1.0)


def ewm(df: DataFrame, columns: list[Ewm], keys: tuple[str, ...] = ("symbol",), order: str = "ts") -> DataFrame:
    """``df`` with the columns, one series per key; columns may build on earlier ones of the list. NULL is a gap: weights go on decaying."""
    schema = T.StructType([*df.schema.fields, *(T.StructField(c.name, T.DoubleType()) for c in columns)])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        for c in columns:
            x = pdf[c.x].astype("float64")
            e = (x if c.minus is None else x - pdf[c.minus]).ewm(alpha=c.a, adjust=False, min_periods=c.least)
            pdf[c.name] = e.mean() if c.kind == "mean" else e.std()
        return pdf

    return df.groupBy(*keys).applyInPandas(one, schema)
