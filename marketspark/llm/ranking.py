"""Ranked lexical search by the Best Position Algorithm.

Terms are the maximal runs of letters, digits and characters beyond ASCII, A-Z lower-cased. An item's score of a document sums its terms' weights
times impacts, as :func:`op13` states it; an impact, ``(1000000000 * tf) div (1000 * tf + 8 * m)``, doesn't depend on the item, so the
lists of a block of documents, one a term in falling order of impact, serve all items.

For an item, positions of its terms' lists are read side by side, from the top. A document that is seen for the first time is scored
by direct accesses to all other lists, and its position in each of them counts as seen, too. A list's best position ends
the run of seen positions from its top. No unseen document can score above the sum of weights times impacts at the best positions, so reading
stops as soon as this sum is strictly below the k-th score so far (a document with an equal score and a smaller id is still found). A task
carries its k-th scores from block to block, so that later blocks are mostly left at once; a block's lists end with
impact 0, since a document that is not in a list gains nothing from it.

Items are the query set: they come to the driver in blocks of at most ``MOST_TERMS`` distinct terms (or one item), and each block is run against
all documents. A task holds a block of documents, ``CELLS`` impacts and as many positions, and one text. Results of tasks, k rows an item and task, meet in
two steps. Equal rows of items count once, different texts under one id are items of their own; a null text has no terms and
no results. Repeated rows of documents are documents of their own; a null doc_id comes after the others of its score. Other columns play
no part. Without any term in the documents there is no result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, save

K = 10
#: Distinct terms of a block of items.
MOST_TERMS = 4096
#: Impacts that a task holds, in a table of terms by documents.
CELLS = 1 << 23
#: Positions read from every list before the threshold is looked at; doubled each time.
DEPTH = 32
SALT = 64

_KEPT = {*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(128, 256)}
_TABLE = bytes(c if c in _KEPT else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def postings(docs: DataFrame, ids: dict[bytes, int], text: str = "text") -> DataFrame:
    """Rows (doc_id, n, term, tf) of documents with terms: arrays over the terms of ``ids`` that a document holds."""
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, t) for c, t in (("n", T.LongType()), ("term", T.ArrayType(T.IntegerType())), ("tf", T.ArrayType(T.IntegerType()))))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ns, term, tf = [], [], [], []
            for i, t in enumerate(as_bytes(batch.column("text"))):
                counts = Counter(found := terms(t.as_py()))
                if found:
                    held = [(ids[w], c) for w, c in counts.items() if w in ids]
                    rows.append(i)
                    ns.append(len(found))
                    term.append([w for w, _ in held])
                    tf.append([c for _, c in held])
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(ns, pa.int64()), pa.array(term, kind), pa.array(tf, kind)], names=[f.name for f in schema])

    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, schema)


class Lists:
    """The impact lists of a block of documents, with direct access."""

    def __init__(self, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, n_terms: int, n_docs: int, length: int):
        m = 25 + (75 * n * n_docs) // length
        g = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
        order = np.lexsort((doc, -g, term))
        self.doc, self.g, term = doc[order], g[order], term[order]
        self.at = np.searchsorted(term, np.arange(n_terms + 1))
        self.impact = np.zeros((n_terms, len(n)), np.int32)
        self.impact[term, self.doc] = self.g
        self.place = np.zeros((n_terms, len(n)), np.int32)  # position from 1; 0: not in the list
        self.place[term, self.doc] = np.arange(len(term)) - self.at[term] + 1

    def best(self, term: np.ndarray, weight: np.ndarray, kth: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of at least ``kth``, and above 0, that hold the k best ones; few others."""
        start, size = self.at[term], self.at[term + 1] - self.at[term]
        some = size > 0
        term, weight, start, size = term[some], weight[some], start[some], size[some]
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(term) or (weight * self.g[start]).sum() < kth:
            return docs, scores
        known = np.zeros(self.impact.shape[1], bool)
        seen = np.zeros((len(term), size.max() + 1), bool)  # the last column stays unseen and ends each run
        lo, hi, rows = 0, DEPTH, np.arange(len(term))[:, None]
        while lo < size.max():
            here = np.arange(lo, min(hi, size.max()))
            read = (start[:, None] + here)[here < size[:, None]]
            new = self.doc[read]
            new = np.unique(new[~known[new]])
            known[new] = True
            of = term[:, None], new
            score = (self.impact[of] * weight[:, None]).sum(0)
            place = self.place[of]
            row = np.broadcast_to(rows, place.shape)[place > 0]
            seen[row, place[place > 0] - 1] = True
            use = score >= max(kth, 1)
            docs, scores = np.concatenate([docs, new[use]]), np.concatenate([scores, score[use]])
            if len(scores) > k:
                kth = max(kth, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
            elif len(scores) == k:
                kth = max(kth, int(scores.min()))
            ended = seen.argmin(axis=1)  # best positions
            bound = np.where(ended < size, self.g[start + np.minimum(np.maximum(ended, 1), size) - 1], 0)
            if (weight * bound).sum() < kth:
                break
            lo, hi = hi, hi * 3
        use = scores >= kth
        return docs[use], scores[use]


def search(rows: DataFrame, items: list[tuple[object, np.ndarray, np.ndarray]], kind: T.DataType, n_terms: int, n_docs: int, length: int, k: int = K) -> DataFrame:
    """For rows of :func:`postings`, and items (id, term numbers, weights): (item, item_id, doc_id, score), at most k rows an item and task."""
    schema = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", kind), rows.schema["doc_id"], T.StructField("score", T.LongType())])
    most = max(1, CELLS // max(n_terms, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = [(np.zeros(0, np.int64), []) for _ in items]  # scores and ids, the best first
        for batch in batches:
            for b in (batch.slice(i, most) for i in range(0, batch.num_rows, most)):
                term, tf = b.column("term"), b.column("tf")
                doc = np.repeat(np.arange(b.num_rows), np.diff(term.offsets.to_numpy()))
                lists = Lists(b.column("n").to_numpy(), doc, term.flatten().to_numpy().astype(np.int64), tf.flatten().to_numpy().astype(np.int64), n_terms, n_docs, length)
                for i, (_, of, weight) in enumerate(items):
                    scores, ids = top[i]
                    docs, new = lists.best(of, weight, int(scores[-1]) if len(scores) == k else 0, k)
                    if len(docs):
                        scores, ids = np.concatenate([scores, new]), ids + b.column("doc_id").take(pa.array(docs)).to_pylist()
                        order = sorted(range(len(ids)), key=lambda j: (-scores[j], ids[j] is None, ids[j] if ids[j] is not None else 0))[:k]
                        top[i] = scores[order], [ids[j] for j in order]
        got = [(i, items[i][0], d, int(s)) for i, (scores, ids) in enumerate(top) for s, d in zip(scores, ids, strict=True)]
        arrow = _schema()
        yield pa.RecordBatch.from_arrays([pa.array([g[j] for g in got], f.type) for j, f in enumerate(arrow)], schema=arrow)

    def _schema() -> pa.Schema:
        from pyspark.sql.pandas.types import to_arrow_schema

        return to_arrow_schema(schema)

    return rows.mapInArrow(run, schema)


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def blocks(items: DataFrame, most_terms: int) -> Iterator[tuple[list[tuple[object, Counter]], dict[bytes, int]]]:
    """Items (id, counts of terms) in blocks, with the numbers of a block's terms."""
    held, ids = [], {}
    for r in items.select("item_id", F.col("text").cast("binary").alias("text")).distinct().toLocalIterator():
        counts = Counter(terms(bytes(r.text or b"")))
        if held and len(ids.keys() | counts.keys()) > most_terms:
            yield held, ids
            held, ids = [], {}
        for w in counts:
            ids.setdefault(w, len(ids))
        held.append((r.item_id, counts))
    if held:
        yield held, ids


def rank(docs: DataFrame, items: DataFrame, k: int = K, most_terms: int = MOST_TERMS) -> DataFrame:
    """The k best documents (doc_id, text) of each item (item_id, text): item_id, rank, doc_id, score."""
    best = F.desc("score"), F.asc_nulls_last("doc_id")
    kind = items.schema["item_id"].dataType
    out = None
    for held, ids in blocks(items, most_terms):
        rows = save(postings(docs, ids), "postings")
        n_docs, length = rows.agg(F.count("*"), F.sum("n")).first()
        df = dict(rows.select(F.explode("term").alias("term")).groupBy("term").count().collect())  # at most the block's terms
        weights = {w: weight(df.get(i, 0), n_docs) for w, i in ids.items()}
        asked = [(i, np.array([ids[w] for w in c], np.int64), np.array([weights[w] * n for w, n in c.items()], np.int64)) for i, c in held]
        found = search(rows, asked, kind, len(ids), n_docs, max(length or 0, 1), k)
        for by in (["item", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALT))], ["item"]):
            found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*best))).filter(F.col("rank") <= k)
        found = found.select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], T.StructType([items.schema["item_id"], T.StructField("rank", T.IntegerType()), docs.schema["doc_id"], T.StructField("score", T.LongType())]))
    return out


def op13(docs: DataFrame, items: DataFrame) -> DataFrame:
    return rank(docs.select("doc_id", "text"), items.select("item_id", "text"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
#: DuckDB. Scores every document that holds a term.
SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents WHERE text IS NOT NULL),
sizes AS (SELECT r, doc_id, len(ws)::BIGINT AS n FROM d WHERE len(ws) > 0),
whole AS MATERIALIZED (SELECT count(*) AS nd, sum(n)::BIGINT AS total FROM sizes),
items AS MATERIALIZED (SELECT row_number() OVER () AS i, item_id, {_WORDS} AS ws FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
asked AS (SELECT i, item_id, w, count(*) AS q FROM (SELECT i, item_id, unnest(ws) AS w FROM items) GROUP BY ALL),
tf AS MATERIALIZED (SELECT r, w, count(*) AS tf FROM (SELECT r, unnest(ws) AS w FROM d) WHERE w IN (SELECT w FROM asked) GROUP BY ALL),
weights AS (SELECT w, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM tf, whole GROUP BY w, nd),
impacts AS (SELECT r, doc_id, w, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // total)) AS g FROM tf JOIN sizes USING (r), whole),
scores AS (SELECT i, item_id, r, doc_id, sum(q * weight * g)::BIGINT AS score FROM asked JOIN weights USING (w) JOIN impacts USING (w) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0) WHERE rank <= {K}
"""
