"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

Size of a document: its number of words ``[^\\x20\\x09-\\x0D]+`` (null text: 0). Sources are ordered by code point
with null last and weigh 5, 2, 1, repeating. They share 100 % of all sizes; a target stops at ``MOST_EPOCHS`` times
its source's size and the excess is shared again by weight until none is above. That fixed point is computed in
closed form: with caps ordered by cap / weight, a source is capped if the share that the rest would get exceeds it.

A source takes floor(target / size) complete epochs of all its documents. The fraction that is left goes to documents
in the order of exponential keys -ln(u) / w, with u from a hash of doc_id and seed (so reruns agree) and w the
document's quality weight in 0.5 ... 1. The document at the budget's edge gives its first words only, so a source takes
its target to the word. No document gives more than ``MOST_EPOCHS`` times its size.

The running sum does not put a source in one task: keys fall into ``BUCKETS`` fixed ranges, and a table of at most ``BUCKETS`` rows a source
carries the totals on. Ranges before a source's budget edge are taken whole and those behind it not at all, without a shuffle; only the range at
the edge is put in order. Equal ids have equal keys and
are ordered by size; equal rows are interchangeable. Only the table of sources, one row each, is ordered as a whole.
Sources without words take nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS, save, word_count

WEIGHTS = (5.0, 2.0, 1.0)
MOST_EPOCHS = 3
BUCKETS = 4096
SEED = "mix-1"


def quality_weight(size: Column, n_chars: Column) -> Column:
    """0.5 ... 1: long documents, of words of usual length, weigh more."""
    words = size.cast("double") / (size + 100)
    length = n_chars.cast("double") / F.greatest(size, F.lit(1))
    usual = F.when((length >= 4.0) & (length <= 10.0), 1.0).otherwise(0.5)
    return 0.5 + 0.5 * words * usual


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """From one row per source (source, source_size): target besides."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1)))
    ranked = ranked.withColumn("cap", F.col("source_size") * MOST_EPOCHS)
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    ranked = ranked.withColumn("level", left.cast("double") / F.sum("w").over(after))
    # the first source, in this order, that stays below its cap sets the level for itself and all behind it
    free = F.col("level") * F.col("w") <= F.col("cap")
    level = F.min(F.when(free, F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(whole)["level"]
    return ranked.withColumn("target", F.when(free, level * F.col("w")).otherwise(F.col("cap").cast("double"))).select("source", "source_size", "w", "target")


def _keyed(docs: DataFrame, carry: list[str], seed: str) -> DataFrame:
    """The carried columns as _c0, _c1, ..., and source, s, size, key and bucket."""
    s = F.coalesce(F.concat(F.lit("0"), F.col("source")), F.lit("1"))  # without nulls, sorts them last
    sized = docs.select(*(F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)), F.col("source").alias("source"), s.alias("s"), F.col("doc_id").alias("_id"), word_count(F.col("text")).alias("size"), F.length("text").alias("_n"))
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("_id").cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    keyed = sized.withColumn("key", -F.log(u) / quality_weight(F.col("size"), F.coalesce("_n", F.lit(0)))).drop("_n")
    # never null, and said so: else each reader would first filter on it, by counting words
    return keyed.withColumn("bucket", F.coalesce(F.floor((1 - F.exp(-F.col("key"))) * BUCKETS).cast("int"), F.lit(0)))


def _taken(keyed: DataFrame) -> DataFrame:
    """Rows of :func:`_keyed` with source_size, target, epochs and part."""
    sums = save(keyed.groupBy("s", "bucket").agg(F.sum("size").alias("in_bucket")), "mix-ranges")
    totals = targets(sums.groupBy(F.col("s").alias("source")).agg(F.sum("in_bucket").alias("source_size"))).withColumnRenamed("source", "s")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    totals = totals.select("s", "source_size", "target", epochs.alias("epochs")).withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    before = F.sum("in_bucket").over(Window.partitionBy("s").orderBy("bucket")) - F.col("in_bucket")
    at_edge = (F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("in_bucket"))
    edge = sums.withColumn("before", before).join(totals.select("s", "rest"), "s").filter(at_edge).select("s", F.col("bucket").alias("edge"), "before")
    plan = save(totals.join(edge, "s", "left").withColumn("edge", F.coalesce("edge", F.lit(BUCKETS + 1))), "mix-plan")  # a row for each source; broadcast by Spark if it is small
    out = keyed.join(plan, "s")
    run = Window.partitionBy("s").orderBy("key", "_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before") - F.col("inside") + F.col("size")))
    ordered = out.filter("bucket = edge").withColumn("inside", F.sum("size").over(run)).withColumn("part", part).drop("inside")
    whole = out.filter("bucket <> edge").withColumn("part", F.when(F.col("bucket") < F.col("edge"), F.col("size")).otherwise(F.lit(0).cast("long")))
    return whole.unionByName(ordered)


def mix_sources(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs, part and taken of documents (doc_id, text, source).

    ``epochs`` complete copies are taken and the first ``part`` words of one more; ``taken`` is their sum in words.
    Words are counted once and kept in a table without texts; no text is shuffled.
    """
    taken = F.col("epochs") * F.col("size") + F.col("part")
    rows = _taken(save(_keyed(docs, ["doc_id"], seed), "mix-rows")).withColumn("taken", taken)
    return rows.select(F.col("_c0").alias("doc_id"), "source", "size", "source_size", "target", "epochs", "part", "taken")


def mixed_documents(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mix as documents, with the columns of ``docs``: a copy for each complete epoch, and the first words of a part.

    Documents are read three times, since texts are neither stored again nor, but for those at a budget's edge, shuffled.
    """
    text = F.col(f"_c{docs.columns.index('text')}")
    share = F.when(F.col("part") == F.col("size"), text).otherwise(F.array_join(F.slice(F.regexp_extract_all(text, F.lit(rf"[{WS}]*[^{WS}]+"), F.lit(0)), F.lit(1), F.col("part").cast("int")), ""))
    copies = F.array_repeat(F.lit(False), F.col("epochs").cast("int"))
    copies = F.when(F.col("part") > 0, F.concat(copies, F.array(F.lit(True)))).otherwise(copies)
    rows = _taken(_keyed(docs, docs.columns, seed)).withColumn("_partial", F.explode(copies))
    cols = [(F.when(F.col("_partial"), share).otherwise(text) if c == "text" else F.col(f"_c{i}")).alias(c) for i, c in enumerate(docs.columns)]
    return rows.select(*cols)


def op8(docs: DataFrame) -> DataFrame:
    return mix_sources(docs.select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


#: DuckDB. Expressions keep the order of operations of the DataFrame form.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, CAST(coalesce(length(text), 0) AS BIGINT) AS n
  FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, ([5.0, 2.0, 1.0]::DOUBLE[])[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS w, source_size * 3 AS cap FROM sums),
levels AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ranked),
aims AS (
  SELECT source, source_size, CASE WHEN level * w <= cap THEN w * arg_min(level, cap / w) FILTER (level * w <= cap) OVER () ELSE CAST(cap AS DOUBLE) END AS target FROM levels),
keyed AS (
  SELECT doc_id, source, size,
    -ln((CAST(('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE)
    / (0.5::DOUBLE + 0.5::DOUBLE * (size::DOUBLE / (size + 100)) * CASE WHEN n::DOUBLE / greatest(size, 1) BETWEEN 4.0::DOUBLE AND 10.0::DOUBLE THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END) AS key
  FROM sized),
placed AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS before FROM keyed),
plan AS (
  SELECT p.*, a.source_size, a.target, CASE WHEN a.source_size > 0 THEN CAST(floor(a.target / a.source_size) AS BIGINT) ELSE 0 END AS epochs
  FROM placed p JOIN aims a ON p.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, size, source_size, target,
  epochs * size + greatest(0, least(size, CAST(round(target - epochs * source_size) AS BIGINT) - before)) AS taken
FROM plan
"""
