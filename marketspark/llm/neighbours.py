"""Approximate nearest neighbours over balanced posting lists.

Cells: centroids are fitted on a bounded sample (``SAMPLE`` rows, the lowest hashes of vec_id) by spherical k-means whose large
clusters are split until sizes are even; there are about n / ``LIST_SIZE``, at most ``MOST_CELLS``, so they can be sent to every task. A graph over the centroids, held in
memory, is searched with a bounded pool to find the lists of a vector. Every vector is indexed: it goes to its nearest list
and, near a boundary, to up to ``COPIES`` lists. A query reads the lists whose distance is at most ``RATIO`` times that
of its nearest list; its pool is doubled while the last list in it is still near enough. In larger tables a cell is divided in the same way, by centroids fitted in a task on a
bounded sample of the cell (``CELL_SAMPLE``), so that lists keep their size and their number grows with the table. Queries that find fewer than asked for, in lists of a few vectors, read the
``WIDE`` cells nearest to them afterwards, and those that still lack some are compared with all vectors, in blocks. They stay a table all the time. Scores are cosines of the original vectors in double precision; ties go to the smaller vec_id.

A list of more than ``PART`` vectors is dealt out in parts, and so are the queries of a list, so no group is unbounded: a task holds ``PART`` vectors and queries, and as
many similarities as 256 queries have. Fitting holds a sample's similarities to the centroids for ``ROWS`` rows at a time. What is sent to all tasks are at most ``MOST_CELLS`` centroids (divided up to twice
by sizes) and sizes of lists behind Spark's own check of a stored table.
Vectors that are null, empty, zero, of another dimension than the sample's usual one, or hold null or non-finite components take no
part, nor do rows without vec_id. Equal rows count once, before the nearest are chosen; an id with several vectors counts once, with its best score. The query's own id
is not among its neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import salted, save

SAMPLE = 20000
MOST_CELLS = 1024
#: Rows of a cell that its own centroids are fitted on, at most, and rows for each centroid.
CELL_SAMPLE = 1 << 16
ROWS_EACH = 16
#: Lists in the pool of a search, for vectors and, at first, for queries.
POOL = 16
ASK_POOL = 32
LIST_SIZE = 256
COPIES = 4
BOUNDARY = 1.08
RATIO = 1.28
DEGREE = 24
PART = 8192
#: Cells read by queries that lack neighbours.
WIDE = 64
#: Rows whose similarities to all centroids are held at once while fitting.
ROWS = 2048
TOP = 5
STRIDE = 50


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit vectors; clusters over twice the mean size are split afterwards."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    nearest_of = lambda: np.concatenate([(x[at : at + ROWS] @ c.T).argmax(1) for at in range(0, len(x), ROWS)])
    for _ in range(rounds):
        near = nearest_of()
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1)
        c = np.where(size[:, None] > 1e-12, total / np.maximum(size, 1e-12)[:, None], c)
    near = nearest_of()
    out = []
    for i in range(len(c)):
        own = x[near == i]
        if len(own) > 2 * len(x) / len(c) and len(c) > 1 and np.ptp(own, axis=0).max() > 1e-9:
            out.extend(kmeans(own, 2, rounds, seed) if len(own) < len(x) else [c[i]])
        else:
            out.append(c[i])
    return np.array(out)


class Centroids:
    """Centroids with a graph of each one's nearest and some far neighbours."""

    def __init__(self, c: np.ndarray):
        self.c = c
        k = min(DEGREE, len(c) - 1)
        self.links = np.zeros((len(c), k + 8 if len(c) > k + 1 else k), np.int64)
        for at in range(0, len(c), 1024):
            sims = c[at : at + 1024] @ c.T
            sims[np.arange(len(sims)), np.arange(at, at + len(sims))] = -2
            order = np.argsort(-sims, axis=1, kind="stable")
            self.links[at : at + 1024, :k] = order[:, :k]
            if len(c) > k + 1:
                self.links[at : at + 1024, k:] = order[:, np.linspace(k, len(c) - 2, 8).astype(int)]
        self.entries = np.unique(np.linspace(0, len(c) - 1, max(1, int(len(c) ** 0.5))).astype(int))
        self.expanded = 0

    def search(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row the ``width`` nearest centroids found, nearest first, and their similarities.

        A pool of ``width`` centroids, from some spread-out ones on: the links of the best that are not yet followed are looked at, until all in the pool are.
        ``expanded`` counts the centroids followed.
        """
        n, k = len(x), len(self.c)
        width = min(width, k)
        start = x @ self.c[self.entries].T
        top = np.argsort(-start, axis=1, kind="stable")[:, :width]
        pool, sim = np.full((n, width), -1), np.full((n, width), -3.0)
        pool[:, : top.shape[1]], sim[:, : top.shape[1]] = self.entries[top], np.take_along_axis(start, top, 1)
        done = sim == -3.0
        go = np.arange(n)
        while len(go):
            todo = np.where(done[go], -3.0, sim[go])
            best = np.argsort(-todo, axis=1, kind="stable")[:, :4]
            fresh = np.take_along_axis(todo, best, 1) > -3.0
            self.expanded += int(fresh.sum())
            i, j = np.nonzero(fresh)
            done[go[i], best[i, j]] = True
            near = np.where(fresh[:, :, None], self.links[np.take_along_axis(pool[go], best, 1)], -1).reshape(len(go), -1)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near[(near[:, :, None] == pool[go][:, None, :]).any(2)] = -1
            i, j = np.nonzero(near >= 0)
            found = np.full(near.shape, -3.0)
            found[i, j] = np.einsum("nd,nd->n", x[go[i]], self.c[near[i, j]])
            every = np.concatenate([sim[go], found], axis=1)
            keep = np.argpartition(-every, width - 1, axis=1)[:, :width]
            pool[go] = np.take_along_axis(np.concatenate([pool[go], near], axis=1), keep, 1)
            done[go] = np.take_along_axis(np.concatenate([done[go], found == -3.0], axis=1), keep, 1)
            sim[go] = np.take_along_axis(every, keep, 1)
            go = go[~done[go].all(1)]
        order = np.argsort(-sim, axis=1, kind="stable")
        return np.take_along_axis(pool, order, 1), np.take_along_axis(sim, order, 1)

    def within(self, x: np.ndarray, ratio: float, most: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and their lists: those at most ``ratio`` times as far as the nearest, at most ``most``."""
        rows, out = np.arange(len(x)), []
        while len(rows):
            lists, sim = self.search(x[rows], width)
            far = np.sqrt(np.maximum(2 - 2 * sim, 0))
            fine = (far <= ratio * far[:, :1] + 1e-12) & (sim > -3.0)
            open_ = fine[:, -1] & (lists.shape[1] < min(most, len(self.c)))
            i, j = np.nonzero(fine[~open_][:, :most])
            out.append((rows[~open_][i], lists[~open_][i, j]))
            rows, width = rows[open_], 2 * width
        return tuple(np.concatenate(p) if p else np.zeros(0, np.int64) for p in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2


def usable(v: Column) -> Column:
    """Whether a vector has a direction: all components finite and not all zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines of paired rows in double precision, in the same order of operations for any pair."""
    norm = lambda a: np.sqrt(np.add.reduce(a * a, axis=1))
    return np.add.reduce(q * x, axis=1) / (norm(q) * norm(x))


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def distinct_rows(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of id and vector in order of ids, equal ones once."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    if (ids[1:] != ids[:-1]).all():
        return ids, x
    row = np.ascontiguousarray(np.column_stack([ids.astype(np.int64).view(np.float64), x + 0.0]))
    keep = np.sort(np.unique(row.view(np.dtype((np.void, row.shape[1] * 8))).ravel(), return_index=True)[1])
    return ids[keep], x[keep]


def best(query: np.ndarray, found: np.ndarray, score: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``top`` best of the rows of each query, a found id once with its best score."""
    order = np.lexsort((-score, found, query))
    query, found, score = query[order], found[order], score[order]
    new = np.concatenate([[True], (np.diff(query) != 0) | (np.diff(found) != 0)])[: len(query)]
    query, found, score = query[new], found[new], score[new]
    order = np.lexsort((found, -score, query))
    query, found, score = query[order], found[order], score[order]
    keep = np.arange(len(query)) - np.searchsorted(query, query) < top
    return query[keep], found[keep], score[keep]


def tops(asked: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query id, id and score of the ``top`` nearest other ids of each query vector; an id may have several rows."""
    ids, x = distinct_rows(ids, x)
    unit = _unit(x)
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])[: len(ids)])
    rows_of = np.diff(np.append(first, len(ids)))
    out = []
    for at in range(0, len(q) if len(ids) else 0, 256):
        block, names = q[at : at + 256], asked[at : at + 256]
        sims = _unit(block) @ unit.T
        if len(first) < len(ids):
            sims = np.maximum.reduceat(sims, first, axis=1)
        sims[names[:, None] == ids[first][None]] = -3
        least = np.partition(sims, max(0, len(first) - top), axis=1)[:, max(0, len(first) - top)] - 1e-9
        i, g = np.nonzero((sims >= least[:, None]) & (sims > -2))
        n = rows_of[g]
        j = np.repeat(first[g] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        i = np.repeat(i, n)
        row, found, score = best(i, ids[j], exact(block[i], x[j]), top)
        out.append((names[row], found, score))
    return tuple(np.concatenate([o[m] for o in out]) if out else np.zeros(0, t) for m, t in ((0, np.int64), (1, np.int64), (2, np.float64)))


def divide(placed: DataFrame, dim: int, lists_of, listed: str) -> DataFrame:
    """Rows of cells (list, ask, id, v) dealt to lists inside the cells."""
    sizes = placed.filter("not ask").groupBy("list").agg(F.count("*").alias("n"))
    sizes = F.broadcast(sizes.withColumn("parts", F.ceil(F.col("n") / PART).cast("int")))  # a row for each cell: a few thousand at most, by MOST_CELLS
    rate = F.least(F.lit(ROWS_EACH / LIST_SIZE), F.lit(float(CELL_SAMPLE)) / F.col("n"))
    few = placed.join(sizes, "list").filter(~F.col("ask") & (F.pmod(F.xxhash64("id", F.lit("cell")), F.lit(1 << 20)) < rate * (1 << 20)))

    def fit(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        x = _unit(_rows(table.column("v").combine_chunks(), dim))
        c = kmeans(x, max(1, len(x) // ROWS_EACH))
        return pa.table([table.column("list").slice(0, 1), pa.array([c.tobytes()], pa.binary())], names=["list", "c"])

    fitted = few.select("list", "v").groupBy("list").applyInArrow(fit, "list long, c binary")
    every = sizes.join(fitted, "list", "left").select(F.col("list").alias("cell"), "c", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("of"))
    dealt = placed.join(sizes.select("list", "parts"), "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")

    def deal(left: pa.Table, right: pa.Table) -> pa.Table:
        c = right.column("c")[0].as_py() if len(right) else None
        cell = left.column("list")[0].as_py() if len(left) else 0
        by = Centroids(np.frombuffer(c).reshape(-1, dim) if c else np.ones((1, dim)) / dim**0.5)
        out = [lists_of(b.slice(at, 2048), by, cell << 32) for b in left.combine_chunks().to_batches() for at in range(0, b.num_rows, 2048)]
        return pa.Table.from_batches(out) if out else pa.table([pa.array([], t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.float64()))], names=["list", "ask", "id", "v"])

    return dealt.groupBy("list", "part").cogroup(every.groupBy("cell", "of")).applyInArrow(deal, listed)


def nearest(vectors: DataFrame, is_query: Column, top: int = TOP, ratio: float = RATIO) -> DataFrame:
    """query_id, rank, vec_id, score of the ``top`` nearest rows found for every row that ``is_query`` marks."""
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), is_query.alias("q")).filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    sample = v.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()
    schema = "query_id long, rank int, vec_id long, score double"
    if not len(sample):
        return vectors.sparkSession.createDataFrame([], schema)
    sample = sample.column("v").combine_chunks()
    lengths = sample.value_lengths().to_numpy()
    dim = int(np.bincount(lengths).argmax())
    x = _unit(_rows(sample.filter(pa.array(lengths == dim)), dim))
    v = v.filter(F.size("v") == dim)
    n = v.count()
    centroids = Centroids(kmeans(x, max(1, min(MOST_CELLS, n // LIST_SIZE, len(x)))))

    def lists_of(b: pa.RecordBatch, by: Centroids, first: int) -> pa.RecordBatch:
        """Rows of (list, ask, id, v) for vectors of (ask, id, v): queries go to lists by ratio, vectors to the nearest and those near a boundary."""
        x, q = _unit(_rows(b.column("v"), dim)), b.column("ask").to_numpy(zero_copy_only=False).astype(bool)
        take, lists = [], []
        for rows, args in ((np.flatnonzero(~q), (BOUNDARY, COPIES, POOL)), (np.flatnonzero(q), (ratio, len(by.c), ASK_POOL))):
            i, j = by.within(x[rows], *args)
            take.append(rows[i])
            lists.append(j)
        take = np.concatenate(take)
        picked = pa.array(take)
        return pa.RecordBatch.from_arrays([pa.array(first + np.concatenate(lists).astype(np.int64)), pa.array(q[take]), b.column("id").take(picked).cast(pa.int64()), b.column("v").take(picked)], names=["list", "ask", "id", "v"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                yield lists_of(batch.slice(at, 2048), centroids, 0)

    listed = "list long, ask boolean, id long, v array<double>"
    both = v.select(F.explode(F.when(F.col("q"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("ask"), F.col("vec_id").alias("id"), "v")
    cells = placed = both.mapInArrow(place, listed)
    if n > 4 * LIST_SIZE * len(centroids.c):
        cells = save(placed, "cells")
        placed = divide(cells, dim, lists_of, listed)
    found = "query_id long, vec_id long, score double"

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ask = table.column("ask").to_numpy().astype(bool)
        ids = table.column("id").to_numpy()
        x = _rows(table.column("v").combine_chunks(), dim)
        cols = tops(*distinct_rows(ids[ask], x[ask]), ids[~ask], x[~ask], top)
        return pa.table([pa.array(c) for c in cols], names=["query_id", "vec_id", "score"])

    def compared(rows: DataFrame) -> DataFrame:
        """Best pairs of the queries and vectors (list, ask, id, v) of one list; each part of its vectors meets each part of its queries."""
        sizes = rows.groupBy("list").agg(F.count("*").alias("n"), F.ceil(F.count_if(~F.col("ask")) / PART).cast("int").alias("parts"), F.ceil(F.count_if("ask") / PART).cast("int").alias("asks"))
        sizes = save(sizes.filter("parts > 0 and asks > 0"), "sizes")
        total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        own = lambda of: F.pmod(F.xxhash64("id"), F.col(of)).cast("int")
        every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
        sized = salted(rows, sizes, ["list"], total, ["id"])
        dealt = sized.filter("ask").withColumn("a", own("asks")).withColumn("p", every("parts")).unionByName(sized.filter("not ask").withColumn("p", own("parts")).withColumn("a", every("asks")))
        return dealt.select("list", "p", "a", "ask", "id", "v").groupBy("list", "p", "a").applyInArrow(compare, found)

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))

    def ranked(pairs: DataFrame) -> DataFrame:
        best_of = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return best_of.withColumn("rank", rank).filter(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

    def lacking(near: DataFrame, queries: DataFrame) -> DataFrame:
        """Queries (id, v) with fewer than ``top`` neighbours so far."""
        full = near.filter(F.col("rank") == top).select(F.col("query_id").alias("id"))
        return save(queries.join(full, "id", "left_anti"), "lacking")

    def place_wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                lists, sim = centroids.search(_unit(_rows(b.column("v"), dim)), WIDE)
                i, j = np.nonzero(sim > -3.0)
                yield pa.RecordBatch.from_arrays([pa.array(lists[i, j].astype(np.int64)), pa.array(np.ones(len(i), bool)), b.column("id").take(pa.array(i)), b.column("v").take(pa.array(i))], names=["list", "ask", "id", "v"])

    near = save(ranked(compared(placed)), "neighbours")
    short = lacking(near, v.filter("q").select(F.col("vec_id").cast("long").alias("id"), "v").distinct())
    if short.isEmpty():
        return near
    pairs = near.select("query_id", "vec_id", "score")
    near = save(ranked(pairs.unionByName(compared(short.mapInArrow(place_wide, listed).unionByName(cells.filter("not ask"))))), "neighbours")
    short = lacking(near, short)
    if short.isEmpty():
        return near
    blocks = max(1, -(-n // PART))
    asked = short.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("list"), F.lit(True).alias("ask"), "id", "v")
    all_rows = v.select(F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks)).cast("long").alias("list"), F.lit(False).alias("ask"), F.col("vec_id").cast("long").alias("id"), "v")
    return ranked(near.select("query_id", "vec_id", "score").unionByName(compared(asked.unionByName(all_rows))))


def op5(vectors: DataFrame) -> DataFrame:
    return nearest(vectors.select("vec_id", "embedding"), F.col("vec_id") % STRIDE == 0)
