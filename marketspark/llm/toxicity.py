"""Toxicity by compression distance.

Two zstandard dictionaries are built from labelled text: an ordinary one from the words that ordinary text uses most,
and a toxic one that holds the same and, behind it, the words that stand out in toxic text. A text is cut into
windows of ``WINDOW`` words; what the toxic dictionary saves over the ordinary one, in bytes, is a window's gain.
The largest gains, the number of windows over a threshold and the length go through a logistic calibration; the threshold is that of
``GAINS`` with the least loss in the calibration.

Words are counted by distinct contexts (word before, word after), so copies of one document count once. Both fits use a
bounded sample of labelled rows (``MOST_TOXIC``, ``MOST_ORDINARY``, the lowest hashes of doc_id), two thirds for the
dictionaries and one third for the calibration; every text is scored. Dictionary content is chosen by these
counts, since zstandard's own trainer ranks by frequency alone and finds mostly common syllables.

Labels come from rows whose crc32(doc_id) mod 5 is not 0. Inputs of a score are texts only. Null and empty texts have
no gain and get the score of a text without signs. Without any toxic label the score is the (smoothed) rate of
toxic labels. Equal rows get equal results; labels that are null or repeated are ignored or counted once. Of rows that share a doc_id, the fits see the one with the smallest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WS, as_bytes, crc_bucket

WINDOW = 8
MOST_TOXIC = 4000
MOST_ORDINARY = 8000
#: Words in the ordinary dictionary, and most in the toxic one.
COMMON = 3000
STANDING_OUT = 2000
#: Least log-likelihood ratio of a word that stands out, and how many times as frequent it must be.
LEAST_G2 = 20.0
TIMES = 8.0
#: Gains in bytes of a window that counts, to choose from.
GAINS = (2, 3, 4, 6)
#: zstandard starts no match in the last bytes of its input, so a window and a dictionary end in bytes that text lacks.
PAD = b" \x01\x02\x03\x04\x05\x06\x07\x08"
TAIL = b"\x0e\x0f\x10\x11\x12\x13\x14\x15"
FEATURES = ["best", "second", *(f"n_over_{g}" for g in GAINS), "n_windows"]


@dataclass
class Model:
    """Dictionaries and calibration; a few dozen KB, whatever the size of the input."""

    ordinary: bytes
    toxic: bytes
    weights: list[float]
    gain: int = GAINS[0]

    def compressors(self) -> tuple[zs.ZstdCompressor, zs.ZstdCompressor]:
        p = zs.ZstdCompressionParameters(window_log=17, hash_log=17, chain_log=17, search_log=5, min_match=6, target_length=32, strategy=zs.STRATEGY_GREEDY, write_content_size=0, write_checksum=0, write_dict_id=0)
        out = []
        for content in (self.ordinary, self.toxic):
            d = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=p)
            out.append(zs.ZstdCompressor(dict_data=d, compression_params=p))
        return out[0], out[1]


def gains(text: bytes, ordinary: zs.ZstdCompressor, toxic: zs.ZstdCompressor) -> np.ndarray:
    words = text.lower().split()
    windows = [b" " + b" ".join(words[i : i + WINDOW]) + PAD for i in range(0, len(words), WINDOW)]
    return np.array([len(ordinary.compress(w)) - len(toxic.compress(w)) for w in windows], np.int64)


def features(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and the features of every text."""
    schema = T.StructType([*docs.select(*keep).schema.fields, *(T.StructField(c, T.DoubleType()) for c in FEATURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = model.compressors()
        for batch in batches:
            rows = np.zeros((batch.num_rows, len(FEATURES)))
            for i, t in enumerate(as_bytes(batch.column("_text"))):
                g = np.maximum(gains(t.as_py(), *both), 0)
                if len(g):
                    top = np.sort(g)[-2:][::-1]
                    rows[i] = top[0], top[1] if len(top) > 1 else 0, *((g >= least).sum() for least in GAINS), len(g)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(rows[:, j]) for j in range(len(FEATURES)))], names=[f.name for f in schema])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def design(best, second, n_over, n_windows, log1p, sqrt):
    """The calibration's inputs, for numpy arrays or columns: a constant first."""
    return [best * 0 + 1.0, best, second, log1p(n_over), log1p(n_windows), n_over / sqrt(n_windows + 1)]


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[list[float], float]:
    """Logistic regression with a small ridge, by Newton steps; its weights and its loss."""
    b = np.zeros(x.shape[1])
    ridge = np.diag([1e-6, *[1e-3 * len(y)] * (x.shape[1] - 1)]) * 0.1
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        w = weight * p * (1 - p) + 1e-9
        step = np.linalg.solve(x.T * w @ x + ridge, x.T @ (weight * (y - p)) - ridge @ b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ b, -30, 30))), 1e-12, 1 - 1e-12)
    return b.tolist(), float(-(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum())


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on a bounded sample. docs: doc_id, text; labels: doc_id, toxic (0 or 1)."""
    known = labels.filter("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    by_hash = lambda y, n: known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    rate = known.agg(F.avg("toxic")).first()[0]
    rate = 0.1 if rate is None else min(max(rate, 1e-3), 1 - 1e-3)
    sample = by_hash(1, MOST_TOXIC).union(by_hash(0, MOST_ORDINARY))  # at most 12,000 ids, so it can be broadcast
    rows = docs.filter("doc_id is not null").select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).withColumn("fit", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(3)) > 0).cache()
    words = F.filter(F.split(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), f"[{WS}]+"), lambda w: w != "")
    at = rows.filter("fit").select("toxic", words.alias("w")).select("toxic", F.explode(F.transform("w", lambda x, i: F.struct(x.alias("word"), F.get("w", i - 1).alias("a"), F.get("w", i + 1).alias("b")))).alias("c")).select("toxic", "c.*")
    seen = at.distinct().groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("o"))
    seen = seen.filter("t + o > 1").cache()
    nt, no = seen.agg(F.sum("t"), F.sum("o")).first()
    common = [r.word for r in seen.orderBy(F.desc("o"), "word").limit(COMMON).collect() if r.o]
    ordinary = b" ".join(w.encode() for w in reversed(common))
    out = []
    if nt and no:
        e_t, e_o = (F.col("t") + F.col("o")) * (nt / (nt + no)), (F.col("t") + F.col("o")) * (no / (nt + no))
        g2 = 2 * (F.col("t") * F.log(F.col("t") / e_t) + F.when(F.col("o") > 0, F.col("o") * F.log(F.col("o") / e_o)).otherwise(0.0))
        out = [r.word for r in seen.filter((F.col("t") > 0) & (F.col("t") * no > TIMES * nt * F.col("o"))).withColumn("g2", g2).filter(F.col("g2") > LEAST_G2).orderBy(F.desc("g2"), "word").limit(STANDING_OUT).collect()]
    toxic = ordinary + b"".join(b" " + w.encode() + b" " for w in reversed(out))
    model = Model(ordinary + b" " + TAIL, toxic + b" " + TAIL, [])
    found = features(rows.filter("not fit"), model, ["toxic"]).collect()
    y = np.array([r.toxic for r in found], float)
    f = {c: np.array([r[c] for r in found], float) for c in FEATURES}
    rows.unpersist()
    seen.unpersist()
    if len(set(y)) < 2:
        model.weights = [float(np.log(rate / (1 - rate))), *[0.0] * 5]
        return model
    weight = np.where(y == 1, rate / y.mean(), (1 - rate) / (1 - y.mean()))
    fits = {g: calibrate(np.stack(design(f["best"], f["second"], f[f"n_over_{g}"], f["n_windows"], np.log1p, np.sqrt), 1), y, weight) for g in GAINS}
    model.gain = min(GAINS, key=lambda g: fits[g][1])
    model.weights = fits[model.gain][0]
    return model


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, the features, and score and predicted for every text."""
    rows = features(docs, model, keep, text).withColumnRenamed(f"n_over_{model.gain}", "n_over").drop(*(f"n_over_{g}" for g in GAINS if g != model.gain))
    z = sum((F.lit(w) * x for w, x in zip(model.weights, design(*map(F.col, ("best", "second", "n_over", "n_windows")), F.log1p, F.sqrt), strict=True)), F.lit(0.0))
    return rows.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held = crc_bucket(F.col("doc_id"), 5) == 0
    model = train(docs.filter(~held), labels.filter(~held))
    rows = docs.select("doc_id", "text").withColumn("held_out", held)
    return score(rows, model, ["doc_id", "held_out"]).select("doc_id", "held_out", "score", "predicted", F.col("n_over").cast("long").alias("n_windows_over"))
