"""Similarity join of documents by the Jaccard measure of their shingles, with prefixes of token combinations.

A document's set holds the distinct 3-word shingles of its words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased (fewer words: the
whole sequence). Two sets link when 100 * intersection >= 90 * union. Equal sets meet in one node before anything is compared.

Prefixes. Shingles are known by 64-bit hashes, whose range is cut into m segments. All of a set's shingles in a segment make one combination, so a set has
m of them. Linked sets differ in d = (a + b) / 19 shingles at most, so in at most d combinations; the others are equal. Put in one order for
all sets, those of most shingles first, the first d + 1 combinations of both hold a common one: these are the set's signatures. A combination says
far more than a shingle of it, so a signature is shared by near copies and hardly ever by chance, however frequent single shingles or short passages are; no
frequencies are counted. m follows the power of two of the larger set's size; a set that may have a partner beyond the next power has signatures for that,
too. A combination of no shingles is one like the others (the last in order), so no link is lost.

Sets that share a signature are joined to one of its members (a star, not all pairs), and the classes of these edges are groups: a link never leaves
a group. The whole sets of grouped nodes are made anew from their texts, and a group is compared in one task: a few pairs of each node first, then nodes outside
the largest class with all of another class, by sizes, parities of shingles and whole sets. A group larger than a task's share is dealt into parts, each compared with itself and with the
first; then members outside the largest class are compared with all others (each two parts, if most are outside). Only links leave a task, a tree of each class.

Null and empty texts, and those of blanks, have an empty set: they link with nothing and are classes of their own. Equal rows, and equal
texts under several ids, are one node; a class has the smallest doc_id that is not null. Other columns play no part. Two shingles
with one hash would count as one in a verification (a chance of 1e-13 for two sets of 1,000); ``n_shingles`` is
counted without hashes. Memory of a task follows its largest set (about 100 bytes a word) and ``TOKENS``. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _ODD, as_bytes, mix, salted, save
from .simhash import connect

#: Hashes up to this make combinations: all.
REGION = (1 << 64) - 1
#: A group of more nodes than this, and than a task's share, is dealt into parts: ``PARTS`` at most, but for shingles beyond ``TOKENS``.
CHUNK = 32
PARTS = 64
#: Shingles of a part, about.
TOKENS = 1 << 22
#: Nodes that are broadcast to find their texts, at most (about 60 bytes each); more are joined by a shuffle.
FEW = 100_000
#: Smaller sets link with no other.
LEAST = 9


def shingles(text: bytes, k: int = 3) -> set[bytes]:
    words = text.lower().split()  # bytes: only A-Z, and only the white space of the word rule
    if len(words) <= k:
        return {b" ".join(words)} if words else set()
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-k] + 1])
    return {joined[a:b] for a, b in zip(starts.tolist(), ends[k - 1 :].tolist(), strict=True)}


def hashes(grams: set[bytes]) -> np.ndarray:
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, grams), np.uint64, len(grams)))


def systems(a: int) -> list[tuple[int, int]]:
    """The powers of two a set of this size takes part in, with their numbers of segments: 1.3 for each combination that a prefix may need."""
    b = a.bit_length() - 1
    return [(x, -(-13 * (2 * ((2 << x) - 1) // 19 + 1) // 10)) for x in ([b, b + 1] if 10 * a >= 9 << (b + 1) else [b])]


def prefix_size(a: int, a0: int) -> int:
    """Shingles that signatures are made of: all, but for a set too small to link."""
    return 0 if a < LEAST else a


def signatures_of(a: int, a0: int, at: np.ndarray | None, h: np.ndarray, n: np.ndarray | None = None) -> np.ndarray:
    """Signatures of a set with the sorted hashes ``h``. Places and numbers of sets of single shingles are not needed, nor is ``a0``."""
    if a < LEAST:
        return np.zeros(0, np.uint64)
    out = []
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h))])
        for power, m in systems(a):
            segments = np.arange(m, dtype=np.uint64)
            edges = np.concatenate([np.searchsorted(h, segments * np.uint64((1 << 64) // m)), [len(h)]])
            held = np.diff(edges)
            sigs = mix(sums[edges[1:]] - sums[edges[:-1]] + segments * _ODD + np.uint64(power))
            most = min(10 * a // 9, (2 << power) - 1)  # of a partner
            out.append(sigs[np.lexsort((sigs, -held))[: (a + most) // 19 + 1]])
    return np.unique(np.concatenate(out))


def digest(h: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None


def set_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows (doc_id, key, a, sigs): the set's digest (null: empty), size and signatures."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("key", T.BinaryType()), T.StructField("a", T.IntegerType()), T.StructField("sigs", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
                key, a, sigs = [], [], []
                for t in as_bytes(batch.column("text")):
                    grams = shingles(t.as_py())
                    h = hashes(grams)
                    key.append(digest(h))
                    a.append(len(grams))
                    sigs.append(signatures_of(len(h), len(h), None, h).view(np.int64))
                cols = [batch.column("doc_id"), pa.array(key, pa.binary()), pa.array(a, pa.int32()), pa.array(sigs, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema])

    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, schema)


def whole_sets(docs: DataFrame, wanted: DataFrame, text: str = "text") -> DataFrame:
    """Rows (node, group, parts, part, tokens) of the nodes ``wanted`` (those, key and first), with all their hashes.

    Texts are found by a node's smallest doc_id and told apart by the set's digest; the first of equal ones counts.
    """
    own = ["node", "group", "parts", "part"]
    asked = wanted.select(*own, "key", F.col("first").alias("_id"))
    asked = F.broadcast(asked) if wanted.count() <= FEW else asked
    found = docs.select("doc_id", F.col(text).alias("text")).join(asked, F.col("doc_id").eqNullSafe(F.col("_id"))).select(*own, "key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 64) for i in range(0, whole.num_rows, 64)):
                sets = [hashes(shingles(t.as_py())) for t in as_bytes(batch.column("text"))]
                use = [i for i, (h, key) in enumerate(zip(sets, batch.column("key").to_pylist(), strict=True)) if digest(h) == key]
                cols = [*(batch.column(c).take(pa.array(use, pa.int64())) for c in own), pa.array([sets[i].view(np.int64) for i in use], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=[*own, "tokens"])

    return found.mapInArrow(run, "node long, group long, parts int, part int, tokens array<long>").groupBy(*own).agg(F.first("tokens").alias("tokens"))


def forest(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """Edges of each node with the smallest of its class, for the classes of the edges (u, v)."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    i, j = at[: len(u)], at[len(u) :]
    label = np.arange(len(names))
    while (label[i] != label[j]).any():
        x, y = label[i], label[j]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    far = label != np.arange(len(names))
    return pa.RecordBatch.from_arrays([pa.array(names[far], pa.int64()), pa.array(names[label[far]], pa.int64())], names=["u", "v"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges that join the nodes of each signature, of rows sorted by signature: of its first node with its others, made fewer in each batch."""
    last, centre = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        sig, node = (batch.column(c).to_numpy() for c in ("sig", "node"))
        new = np.concatenate([[sig[0] != last], sig[1:] != sig[:-1]])
        run = np.cumsum(new)
        of = np.concatenate([[centre], node[new]])[run]
        last, centre = sig[-1], of[-1]
        far = of != node
        yield forest(of[far], node[far])


def groups(nodes: DataFrame) -> DataFrame:
    """Rows (node, group) of the nodes (node, sigs) that share signatures; a link never leaves a group."""
    sigs = nodes.select("node", F.explode("sigs").alias("sig"))
    edges = connect(sigs.repartition("sig").sortWithinPartitions("sig").mapInArrow(_stars, "u long, v long"))
    grouped = edges.select(F.col("u").alias("node"), F.col("v").alias("group"))
    return grouped.unionByName(grouped.select(F.col("group").alias("node"), "group").distinct())


def shared_with(x: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """How many hashes of the sorted ``x`` each of the sets holds."""
    every = np.concatenate(sets)
    hit = x[np.minimum(np.searchsorted(x, every), len(x) - 1)] == every
    return np.add.reduceat(hit, np.cumsum([0, *(len(s) for s in sets[:-1])]), dtype=np.int64)


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """Of each set, whether an odd number of its hashes falls on each of about 8 bits for a hash of the largest."""
    most = max(map(len, sets))
    words = min(1 << max(3, (most // 8).bit_length()), max(8, 1 << ((1 << 22) // len(sets)).bit_length() - 1))
    out = np.zeros((len(sets), words), np.uint64)
    every = np.concatenate(sets)
    at = np.repeat(np.arange(len(sets)) * words, [len(s) for s in sets]) + ((every >> np.uint64(6)) & np.uint64(words - 1)).astype(np.int64)
    np.bitwise_xor.at(out.reshape(-1), at, np.uint64(1) << (every & np.uint64(63)))
    return out


def link(sets: list[np.ndarray], label: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the sets' classes (``label``: those known; it is changed), one for each two classes that become one."""
    n, out = len(sets), []
    a = np.array([len(s) for s in sets])

    def meet(i: int, j: int) -> None:
        if label[i] != label[j]:
            out.append((i, j))
            label[label == label[j]] = label[i]

    def links(i: int, js: np.ndarray) -> np.ndarray:
        return js[190 * shared_with(sets[i], [sets[j] for j in js.tolist()]) >= 90 * (a[i] + a[js])]

    if n <= 6:
        for i, j in combinations(range(n), 2):
            if label[i] != label[j] and 10 * min(a[i], a[j]) >= 9 * max(a[i], a[j]) and len(links(i, np.array([j]))):
                meet(i, j)
        return out
    bits = parities(sets)

    def near(i: np.ndarray | int, j: np.ndarray) -> np.ndarray:
        """Labels, sizes and parities allow a link."""
        use = np.flatnonzero((label[i] != label[j]) & (10 * np.minimum(a[i], a[j]) >= 9 * np.maximum(a[i], a[j])))
        i, j = (i if isinstance(i, int) else i[use]), j[use]
        return use[19 * np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64) <= a[i] + a[j]]

    shift = 1
    while shift < n:
        first = np.arange(n - shift)
        for i in near(first, first + shift).tolist():
            if label[i] != label[i + shift] and len(links(i, np.array([i + shift]))):
                meet(i, i + shift)
        shift *= 2
    names, sizes = np.unique(label, return_counts=True)
    core = int(np.flatnonzero(label == names[sizes.argmax()])[0])
    every = np.arange(n)
    for i in np.flatnonzero(label != label[core]).tolist():
        if label[i] == label[core]:
            continue
        left = near(i, every)
        left = left[np.argsort(np.bitwise_count(bits[i] ^ bits[left]).sum(1), kind="stable")]
        while len(left) and label[i] != label[core]:
            for j in links(i, left[:32]).tolist():
                meet(j, i)
            left = left[32:]
            left = left[label[left] != label[i]]
    return out


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, np.ndarray], list[np.ndarray]]]:
    """Columns and sets of each bucket of rows with a column ``tokens``, sorted by ``bucket``."""

    def out(t: pa.Table) -> Iterator[tuple[dict[str, np.ndarray], list[np.ndarray]]]:
        cols = {c: t.column(c).to_numpy() for c in t.column_names if c != "tokens"}
        tokens = t.column("tokens").combine_chunks()
        ends = tokens.offsets.to_numpy()
        every = tokens.values.to_numpy().view(np.uint64)
        bucket = cols["bucket"]
        edges = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]]).tolist()
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            yield {c: x[lo:hi] for c, x in cols.items()}, [every[ends[k] : ends[k + 1]] for k in range(lo, hi)]

    held: list[pa.RecordBatch] = []
    size, first = 0, None
    for whole in batches:
        for batch in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
            held.append(batch)
            size += batch.num_rows + batch.column("tokens").flatten().nbytes // 2048
            first = batch.column("bucket")[0].as_py() if first is None else first
            last = batch.column("bucket")[-1].as_py()
            if size >= 1 << 13 and first != last:
                t = pa.Table.from_batches(held)
                cut = int(np.searchsorted(t.column("bucket").to_numpy(), last))
                yield from out(t.slice(0, cut))
                held, size, first = t.slice(cut).to_batches(), len(t) - cut, last
    if held:
        yield from out(pa.Table.from_batches(held))


TILES = "node long, label long, core boolean, split boolean, hub boolean"


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes inside each bucket of :func:`hub_buckets`: rows (node, label, core, split, hub) of the nodes that link.

    A group in parts has a core, the class that holds the largest class of its first part, the hub (of equal ones, that with the smallest node). So all its
    buckets know the same core, whose label is -1 - group; other labels are a class's smallest node.
    """
    for cols, sets in _buckets(batches):
        node, hub = cols["node"], cols["part"] == 0
        label, core, split = np.arange(len(node)), np.zeros(len(node), bool), cols["parts"] > 1
        first = np.flatnonzero(hub & split)
        if len(first):
            own = np.arange(len(first))
            link([sets[k] for k in first.tolist()], own)
            _, at, sizes = np.unique(own, return_index=True, return_counts=True)  # rows are in order of nodes
            anchor = first[min(at[sizes == sizes.max()])]
            label[first] = first[own]
        link(sets, label)
        _, of = np.unique(label, return_inverse=True)
        least = np.full(of.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, of, node)
        if len(first):
            core = of == of[anchor]
        of = np.where(core, -1 - cols["group"], least[of])
        use = of != node
        yield pa.RecordBatch.from_arrays([pa.array(x[use]) for x in (node, of, core, split, hub)], names=["node", "label", "core", "split", "hub"])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u > v) that join the classes in each bucket (bucket, node, label, tokens); the core's nodes stand under its label."""
    for cols, sets in _buckets(batches):
        name = np.where(cols["label"] < 0, cols["label"], cols["node"])
        i, j = np.array(link(sets, cols["label"].copy()), np.int64).reshape(-1, 2).T
        yield forest(name[i], name[j])


def dealt(members: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Members (node, group, a, and others) with ``n`` and ``parts`` of their group, and ``part``."""
    total = members.count()
    share = max(chunk, total // int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sized = members.groupBy("group").agg(F.count("*").alias("n"), F.sum("a").alias("shingles"))
    parts = F.greatest(F.least(F.ceil(F.col("n") / share), F.lit(PARTS)), F.ceil(F.col("shingles") / TOKENS)).cast("int")
    rows = salted(members, sized.select("group", "n", parts.alias("parts")), ["group"], total, ["node"])
    return rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))


def hub_buckets(sets: DataFrame) -> DataFrame:
    """Buckets of each part of a group (group, parts, part) with its first part."""
    others = F.when(F.col("parts") == 1, F.array(F.lit(0))).when(F.col("part") == 0, F.sequence(F.lit(1), F.col("parts") - 1)).otherwise(F.array("part"))
    return sets.withColumn("at", F.explode(others)).select(F.xxhash64("group", "at").alias("bucket"), "node", "group", "parts", "part", "tokens")


def outsiders(rows: DataFrame) -> DataFrame:
    """Buckets (bucket, node, label) of groups in several parts (group, node, label, n, parts, part), label below zero for a group's core: each part of the members outside it with each part of all.

    Where the core holds less than half of them, each two parts of all members.
    """
    others = rows.groupBy("group").agg(F.sum((F.col("label") >= 0).cast("long")).alias("others"), F.count("*").alias("n")).filter("others > 0")
    rows = salted(rows.drop("n"), others, ["group"], rows.count(), ["node"])
    outer = F.ceil(F.col("others") * F.col("parts") / (2 * F.col("n"))).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(1)), outer).cast("int")
    each = lambda n: F.sequence(F.lit(0), n - 1)
    as_other = F.when(F.col("label") >= 0, F.transform(each(F.col("parts")), lambda i: F.struct(own.alias("o"), i.alias("i")))).otherwise(F.array())
    as_member = F.transform(each(outer), lambda o: F.struct(o.alias("o"), F.col("part").alias("i")))
    two = F.filter(F.transform(each(F.col("parts")), lambda x: F.struct(F.least("part", x).alias("o"), F.greatest("part", x).alias("i"))), lambda x: x["o"] != x["i"])
    at = F.explode(F.when(2 * F.col("others") > F.col("n"), two).otherwise(F.array_distinct(F.concat(as_member, as_other))))
    return rows.withColumn("at", at).select(F.xxhash64("group", "at.o", "at.i").alias("bucket"), "node", "label")


def classes(docs: DataFrame, nodes: DataFrame, text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Rows (node, label) of the nodes (node, key, first, a, sigs) that link with another; ``label`` is the same for a class: a node, or below zero."""
    grouped = save(groups(nodes).join(nodes.select("node", "key", "first", "a"), "node"), "groups")
    wanted = save(dealt(grouped, chunk), "wanted")
    sets = save(whole_sets(docs, wanted, text), "whole-sets")
    tiles = save(hub_buckets(sets).repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(_tiles, TILES), "tiles")
    done = tiles.filter("not split").select("node", "label")
    rows = wanted.filter("parts > 1").select("group", "node", "n", "parts", "part")
    if rows.isEmpty():
        return done
    core = tiles.filter("core").select("node", "label")
    left = save(outsiders(save(rows.join(core.distinct(), "node", "left").withColumn("label", F.coalesce("label", "node")), "split-groups")), "outsiders")
    few = F.broadcast(left) if left.count() <= FEW else left
    more = sets.select("node", "tokens").join(few, "node").repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(_links, "u long, v long")
    inside = tiles.filter("split and (hub or not core)").select(F.col("node").alias("u"), F.col("label").alias("v"))
    labels = connect(inside.unionByName(more)).select(F.col("u").alias("node"), F.col("v").alias("label"))
    return done.unionByName(tiles.filter("core and not hub").select("node", "label")).unionByName(labels)


def join(docs: DataFrame, text: str = "text", chunk: int = CHUNK, rare: int | None = None, very: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, and n_same (documents with the same set). ``rare`` and ``very`` are of an older form, and play no part."""
    rows = save(set_rows(docs, text).withColumn("row", F.monotonically_increasing_id()), "sets")
    some = rows.filter("key is not null")
    nodes = save(some.groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"), F.min("row").alias("node"), F.first("a").alias("a"), F.first("sigs").alias("sigs")), "nodes")
    labels = classes(docs, nodes, text, chunk)
    placed = nodes.select("key", "first", "n", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = placed.groupBy("label").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    total = rows.count()
    sized = salted(placed.withColumnRenamed("n", "n_same"), least, ["label"], total, ["node"]).select("key", F.col("n_same").alias("n"), "component_id")
    out = salted(some.select("doc_id", "key", "a"), sized, ["key"], total, ["doc_id"])
    alone = rows.filter("key is null").select("doc_id", F.col("a").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("n_same"))
    return out.select("doc_id", F.col("a").alias("n_shingles"), "component_id", F.col("n").alias("n_same")).unionByName(alone).withColumn("n_shingles", F.col("n_shingles").cast("long"))


def op12(docs: DataFrame) -> DataFrame:
    return join(docs.select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


#: DuckDB. Counts shared shingles of all pairs that share one.
SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sets AS MATERIALIZED (
  SELECT r, doc_id, list_sort(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END) AS s
  FROM d),
named AS MATERIALIZED (SELECT s, min(r) AS node, len(s) AS a FROM sets WHERE len(s) > 0 GROUP BY s),
tokens AS MATERIALIZED (SELECT node, a, unnest(s) AS t FROM named),
links AS MATERIALIZED (
  SELECT x.node AS u, y.node AS v FROM tokens x JOIN tokens y ON x.t = y.t AND x.node < y.node AND 10 * least(x.a, y.a) >= 9 * greatest(x.a, y.a)
  GROUP BY x.node, y.node, x.a, y.a HAVING 100 * count(*) >= 90 * (x.a + y.a - count(*))),
both_ways AS MATERIALIZED (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (SELECT node AS u, node AS v FROM named UNION SELECT reach.u, both_ways.v FROM reach JOIN both_ways ON both_ways.u = reach.v),
label AS (SELECT u AS node, min(v) AS label FROM reach GROUP BY u),
members AS MATERIALIZED (SELECT sets.r, sets.doc_id, label.label FROM sets JOIN named USING (s) JOIN label USING (node))
SELECT sets.doc_id, len(sets.s)::BIGINT AS n_shingles, CASE WHEN len(sets.s) = 0 THEN sets.doc_id ELSE min(members.doc_id) OVER (PARTITION BY members.label) END AS component_id
FROM sets LEFT JOIN members USING (r)
"""
