"""Bars: reading, writing, building from trades, cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketspark.functions.windows import finite

PRICES = ("open", "high", "low", "close", "volume")
EXTRA = ("vwap", "trade_count")
TIME_NAMES = ("timestamp", "time", "date", "datetime", "ts")
BAR_SCHEMA = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampType()), *(T.StructField(c, T.DoubleType()) for c in (*PRICES, *EXTRA))])


def read_bars(spark: SparkSession, path: str, years: int | None = None, end: str | None = None) -> DataFrame:
    """Stored bars, Parquet or CSV by extension; only the last ``years`` before ``end`` if both are given."""
    kind = path.lower()
    if kind.endswith((".parquet", ".pq")):
        df = spark.read.schema(BAR_SCHEMA).parquet(path)
    elif kind.endswith((".csv", ".csv.gz")):
        df = spark.read.schema(BAR_SCHEMA).option("header", True).csv(path)
    else:
        raise ValueError(f"neither Parquet nor CSV: {path}")
    if years is not None:
        if end is None:
            raise ValueError("years needs an end, so that runs can be repeated")
        stop = F.lit(end).cast("timestamp")
        df = df.filter((F.col("ts") >= stop - F.make_interval(years=F.lit(years))) & (F.col("ts") <= stop))
    return df


def write_bars(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A folder for each symbol, and in it about a file for each year."""
    df.repartition("symbol", F.year("ts")).write.mode(mode).partitionBy("symbol").parquet(path)


def build_bars(trades: DataFrame, symbol: Column, ts: Column, price: Column, size: Column, every: str = "day", ties: tuple[Column, ...] = ()) -> DataFrame:
    """OHLCV bars with vwap and trade_count. ``ties`` order trades of equal time; price and size come last.

    All aggregates combine before the shuffle, so a busy symbol costs one row a task and bar.
    """
    t = trades.select(symbol.cast("string").alias("symbol"), ts.cast("timestamp").alias("_at"), price.cast("double").alias("_p"), size.cast("double").alias("_q"), F.struct(ts.cast("timestamp"), *ties, price.cast("double"), size.cast("double")).alias("_o"))
    return t.groupBy("symbol", F.date_trunc(every, "_at").alias("ts")).agg(
        F.min_by("_p", "_o").alias("open"), F.max("_p").alias("high"), F.min("_p").alias("low"), F.max_by("_p", "_o").alias("close"),
        F.sum("_q").alias("volume"), F.try_divide(F.sum(F.col("_p") * F.col("_q")), F.sum("_q")).alias("vwap"), F.count("*").cast("double").alias("trade_count"),
    )


def normalize_bars(df: DataFrame, ties: tuple[str, ...] = (), required: tuple[str, ...] = PRICES, symbol: str | None = None) -> DataFrame:
    """Clean bars from a raw table of any name case.

    Finds the time column, reads times and numbers (what cannot be read is missing), keeps the first row of each (symbol, ts) by ``ties``,
    and then drops rows with anything missing. A first row with a gap therefore removes its time; without ``ties``, complete rows come first, by value.
    """
    by_name = {c.lower(): c for c in df.columns}
    time = next((by_name[t] for t in TIME_NAMES if t in by_name), None)
    if time is None:
        raise KeyError("no time column")
    lacking = [c for c in required if c not in by_name]
    if lacking:
        raise ValueError(f"required columns are missing: {lacking}")
    kept = [c for c in (*PRICES, *EXTRA) if c in by_name]
    name = F.col(by_name["symbol"]).cast("string") if "symbol" in by_name else F.lit(symbol)
    at = F.col(f"`{time}`")
    at = F.try_to_timestamp(at) if isinstance(df.schema[time].dataType, T.StringType) else at.cast("timestamp")
    rows = df.select(name.alias("symbol"), at.alias("ts"), *(finite(F.col(f"`{by_name[c]}`").try_cast("double")).alias(c) for c in kept), *(F.col(f"`{t}`").alias(f"_t{i}") for i, t in enumerate(ties)))
    order = [f"_t{i}" for i in range(len(ties))] or [sum((F.col(c).isNull().cast("int") for c in kept), F.lit(0)), F.struct(*kept)]
    first = F.row_number().over(Window.partitionBy("symbol", "ts").orderBy(*order))
    return rows.filter("ts is not null").withColumn("_n", first).filter("_n = 1").select("symbol", "ts", *kept).dropna("any")


def numeric_columns(df: DataFrame, wanted: list[str] | None = None) -> list[str]:
    """Names of the columns that hold numbers, in the order of ``df``; of ``wanted``, those that exist, in its order. Names are compared as they are."""
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    return numbers if wanted is None else [c for c in dict.fromkeys(wanted) if c in numbers]


def select_numeric(df: DataFrame, wanted: list[str] | None = None, keys: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    """Keys and numeric columns, of ``wanted`` those that exist; the scan reads no others."""
    return df.select(*keys, *(F.col(f"`{c}`") for c in numeric_columns(df, wanted) if c not in keys))


def last_rows(df: DataFrame, n: int, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ts")))).filter(F.col("_n") <= n).drop("_n")


def align(x: DataFrame, y: DataFrame, keys: tuple[str, ...] = ("symbol", "ts"), dropna: bool = True, how: str = "inner") -> DataFrame:
    """Join on the keys, numbers made finite, incomplete rows dropped. With ``how="left"`` and without dropping, y is brought to the rows of x."""
    both = x.join(y, list(keys), how)
    both = both.select(*keys, *(finite(F.col(c).cast("double")).alias(c) for c in both.columns if c not in keys))
    return both.dropna("any") if dropna else both
