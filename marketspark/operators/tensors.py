"""Training windows without a copy of each row for each window: rows are stored once, in chunks, and windows are cut from them while reading."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketspark.functions.chunks import in_chunks, number_rows

#: Rows of a chunk, and windows in a batch while cutting.
SIZE, BATCH = 4096, 256
CHUNKS = "symbol string, fold string, chunk long, first long, more boolean, ts array<timestamp>, rows binary, y array<double>"
WINDOWS = "symbol string, ts timestamp, fold string, sequence binary, y double"


def sequence_chunks(df: DataFrame, columns: list[str], target: str, length: int = 60, size: int = SIZE) -> DataFrame:
    """A row for each chunk of ``size`` rows of a (symbol, fold): times and targets of its own rows, and a float32 matrix of these and the ``length`` - 1 rows before.

    So the matrices hold (size + length - 1) / size times the rows. ``first`` is the place of the chunk's first own row, ``more`` whether a row
    follows the chunk. Missing values are NaN in the matrix; a missing target stays NULL. Times must be unique in a (symbol, fold).
    """
    if length < 1 or size < 1:
        raise ValueError("length and size must be positive")
    slim = df.select(F.col("symbol").cast("string").alias("symbol"), "fold", F.col("ts").cast("timestamp").alias("ts"), F.array(*(F.col(f"`{c}`").cast("float") for c in columns)).alias("_v"), F.col(f"`{target}`").cast("double").alias("_y"))
    dealt = in_chunks(number_rows(slim, ("symbol", "fold")), size, before=length - 1, ahead=1)
    dealt = dealt.select(F.col("symbol.of").alias("symbol"), F.col("symbol.chunk").alias("chunk"), "fold", "ts", "_v", "_y", "_i", "_own")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        own = pdf["_own"].to_numpy(bool)
        if not own.any():
            return pd.DataFrame(columns=["symbol", "fold", "chunk", "first", "more", "ts", "rows", "y"])
        last = np.flatnonzero(own)[-1]
        rows = np.array([[np.nan if v is None else v for v in row] for row in pdf["_v"].iloc[: last + 1]], np.float32)
        mine = pdf[own]
        y = [None if np.isnan(v) else float(v) for v in mine["_y"].to_numpy(float)]
        return pd.DataFrame({"symbol": [mine["symbol"].iloc[0]], "fold": [mine["fold"].iloc[0]], "chunk": [mine["chunk"].iloc[0]], "first": [mine["_i"].iloc[0]], "more": [bool(last + 1 < len(pdf))], "ts": [list(mine["ts"])], "rows": [rows.tobytes()], "y": [y]})

    return dealt.groupBy("symbol", "fold", "chunk").applyInPandas(pack, CHUNKS)


def cut(rows: bytes, own: int, length: int, width: int, first: int, more: bool, keep_last: bool) -> tuple[int, np.ndarray]:
    """The windows of a chunk as views (window, row, column), and the number of its own rows before the first window's end."""
    matrix = np.frombuffer(rows, np.float32).reshape(-1, width)
    skip = max(0, length - 1 - first)
    stop = own if more or keep_last else own - 1
    if skip >= stop:
        return skip, np.empty((0, length, width), np.float32)
    views = np.lib.stride_tricks.sliding_window_view(matrix, length, axis=0).swapaxes(1, 2)  # ends at place length - 1 of the matrix, and on
    at = len(matrix) - own + skip - (length - 1)
    return skip, views[at : at + stop - skip]


def sequence_windows(chunks: DataFrame, columns: int, length: int = 60, keep_last: bool = False) -> DataFrame:
    """symbol, ts, fold, sequence (``length`` x ``columns`` float32 in C order, time first), y, at each window's end row; the last one of a (symbol, fold) is dropped unless kept.

    ``length`` is that of the stored chunks, at most. A task holds one chunk and ``BATCH`` windows.
    """

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                ts, y, first, more = row["ts"].values, row["y"].values, row["first"].as_py(), row["more"].as_py()
                skip, views = cut(row["rows"].as_py(), len(ts), length, columns, first, more, keep_last)
                for lo in range(0, len(views), BATCH):
                    some = np.ascontiguousarray(views[lo : lo + BATCH])
                    n, at = len(some), skip + lo
                    data = [pa.array([row["symbol"].as_py()] * n, pa.string()), ts.slice(at, n), pa.array([row["fold"].as_py()] * n, pa.string()), pa.array([w.tobytes() for w in some], pa.binary()), y.slice(at, n)]
                    yield pa.RecordBatch.from_arrays(data, names=["symbol", "ts", "fold", "sequence", "y"])

    return chunks.mapInArrow(windows, WINDOWS)
