"""The queries of the training-data operators, and their SQL twins.

SQL is given where DuckDB can express a query over whole tables in sensible time; the others are tested
against plain versions in tests/llm.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import htmltext, language_model, manifest, mixing, neighbours, packing, pii, quality, ranking, setjoin, simhash, substrings, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def _of(op: Callable[..., DataFrame], *tables: str) -> Query:
    return lambda spark, sf_dir: op(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables))


def queries() -> dict[str, Query]:
    return {
        "op1_simhash": _of(simhash.op1, "documents"),
        "op2_toxicity": _of(toxicity.op2, "documents", "labels"),
        "op3_language_model": _of(language_model.op3, "documents"),
        "op4_pii": _of(pii.op4, "documents"),
        "op5_neighbours": _of(neighbours.op5, "embeddings"),
        "op6_packing": _of(packing.op6, "documents"),
        "op7_quality": _of(quality.op7, "documents"),
        "op8_mixing": _of(mixing.op8, "documents"),
        "op9_html_text": _of(htmltext.op9, "pages"),
        "op10_substrings": _of(substrings.op10, "documents"),
        "op11_merkle": _of(manifest.op11, "documents"),
        "op12_jaccard": _of(setjoin.op12, "documents"),
        "op13_search": _of(ranking.op13, "documents", "benchmark"),
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_pii": pii.SQL, "op7_quality": quality.SQL, "op8_mixing": mixing.SQL, "op10_substrings": substrings.SQL, "op11_merkle": manifest.SQL, "op12_jaccard": setjoin.SQL, "op13_search": ranking.SQL}
