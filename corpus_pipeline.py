"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs. All
but the last return the columns of ``documents``. Null texts have no words, so the first stage rejects them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketspark.llm.common import discard, save_only
from marketspark.llm.mixing import mixed_documents
from marketspark.llm.packing import pack
from marketspark.llm.pii import redact
from marketspark.llm.quality import quality_rules
from marketspark.llm.simhash import one_of_each


def carried(docs: DataFrame, need: list[str], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``stage`` on the columns it needs; all others pass it in one struct, so that none is overwritten, whatever its name."""
    rest = [c for c in docs.columns if c not in need]
    out = stage(docs.select(*(c for c in docs.columns if c in need), *([F.struct(*(F.col(f"`{c}`") for c in rest)).alias("own")] if rest else [])))
    return out.select(*(F.col(c) if c in need else F.col("own")[c].alias(c) for c in docs.columns))


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return carried(docs, ["text"], lambda d: quality_rules(d).filter("kept"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return carried(docs, ["doc_id", "text"], one_of_each)


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind. ``n_chars`` stays that of the source text."""
    return carried(docs, ["text"], redact)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources; a document is as many rows as it is taken times."""
    return carried(docs, ["doc_id", "source", "text"], mixed_documents)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, with their token ids."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("quality rules", good_documents),
    ("near-duplicates", without_copies),
    ("personal data", without_pii),
    ("mixing", mixed),
    ("packing", packed),
]

#: Fingerprints and token ids are beyond SQL; tests/llm/test_pipeline.py holds the result against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``. A stage's table, and what its operator saved, is deleted when the next one is written; those of the last two stay until the driver ends."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = save_only(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"corpus-{k}")
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
