"""Merkle manifest of a table: a tree of SHA-256 digests that keeps midstates.

A row is a leaf, the digest of its columns (``-`` for null, else byte count, ``:``, value). The leaves of a language, in the
order of doc_id (null first; equal ids by leaf), are folded two by two until one digest, the subroot, is left; subroots, in
the bytewise order of languages (null first), are folded likewise to the root. A digest enters its parent as 64 hexadecimal
digits, which is one block of SHA-256, so the hash state before a child slot is eight words: the initial ones before the
first slot, and for the second slot the state that a parent keeps as 32 bytes. :func:`fold` replaces leaves and
recomputes the root: at each level it resumes the state before the leaf's slot with the replacement and the siblings to the right
only.

The tree is stored in chunks of ``size`` nodes of one level: a chunk's row holds all digests and states of the levels inside it, and
its own root is a node of the next pass. Each pass is a written table, a ``size``-th of the one before. A task holds one chunk.
Folding joins leaves with the one chunk they lie in, so a language of any size is spread evenly; the steps above a chunk are
the same for all its leaves and are computed once, from the top down.

Null doc_ids come first; repeated rows are leaves of their own with one digest, in any order among themselves. An empty table gives
no rows. Other columns of a table play no part. Memory follows the longest text only where Spark hashes a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save

#: Nodes of one level in a chunk: a power of two.
CHUNK = 2048
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Partitions that the sorted leaves are cut into hold about so many leaves.
PART = 200_000

# Fixed values of SHA-256: the first 32 bits of the fractional parts of square roots of the first 8 primes (initial state) and of
# cube roots of the first 64 primes (round constants), computed from that rule.
_PRIMES = [p for p in range(2, 312) if all(p % q for q in range(2, int(p**0.5) + 1))]


def _root_bits(p: int, k: int) -> int:
    """First 32 fractional bits of the k-th root of p, in whole numbers."""
    n, lo, hi = p << (32 * k), 0, 1 << 40
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if mid**k <= n else (lo, mid)
    return lo & 0xFFFFFFFF


INITIAL = np.array([_root_bits(p, 2) for p in _PRIMES[:8]], np.uint32)
_ROUND = np.array([_root_bits(p, 3) for p in _PRIMES], np.uint32)
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def _schedule(w: np.ndarray) -> list[np.ndarray]:
    out = list(w)
    for i in range(16, 64):
        a, b = out[i - 15], out[i - 2]
        out.append(out[i - 16] + (_turn(a, 7) ^ _turn(a, 18) ^ (a >> np.uint32(3))) + out[i - 7] + (_turn(b, 17) ^ _turn(b, 19) ^ (b >> np.uint32(10))))
    return out


def absorb(state: np.ndarray, words: np.ndarray | list[np.ndarray]) -> np.ndarray:
    """States (8 x n) after one more block each: its 16 words (16 x n), or a schedule of 64."""
    with np.errstate(over="ignore"):
        w = words if isinstance(words, list) else _schedule(words)
        a, b, c, d, e, f, g, h = state
        for k in range(64):
            t = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + _ROUND[k] + w[k]
            u = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
            a, b, c, d, e, f, g, h = t + u, a, b, c, d + t, e, f, g
        return state + np.stack([a, b, c, d, e, f, g, h])


def _padding(blocks: int) -> list[np.ndarray]:
    """The schedule of the block that ends a message of so many whole blocks."""
    w = np.zeros((16, 1), np.uint32)
    w[0], w[15] = 0x80000000, 512 * blocks
    return _schedule(w)


_END = {1: _padding(1), 2: _padding(2)}


def digits(digests: np.ndarray) -> np.ndarray:
    """The hexadecimal digits (n x 64 bytes) of digests (n x 32 bytes)."""
    out = np.empty((len(digests), 64), np.uint8)
    out[:, 0::2], out[:, 1::2] = _HEX[digests >> 4], _HEX[digests & 15]
    return out


def as_block(digests: np.ndarray) -> np.ndarray:
    """Digests as blocks of 16 words (16 x n)."""
    return np.ascontiguousarray(digits(digests).view(">u4").astype(np.uint32).T)


def to_bytes(states: np.ndarray) -> np.ndarray:
    """States (8 x n) as n x 32 bytes; the last state of a message is its digest."""
    return np.ascontiguousarray(states.T.astype(">u4")).view(np.uint8).reshape(-1, 32)


def from_bytes(raw: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(raw).view(">u4").astype(np.uint32).T


def start(n: int) -> np.ndarray:
    return np.repeat(INITIAL[:, None], n, axis=1)


def levels_of(n: int) -> list[int]:
    """Nodes on each level of a tree over n leaves."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // 2))
    return out


def grow(leaves: np.ndarray, height: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Digests of the levels 0 ... height over leaves (n x 32), and for the levels 1 ... height each parent's state before its second slot."""
    digests, states = [leaves], []
    for _ in range(height):
        below = digests[-1]
        first = absorb(start(-(-len(below) // 2)), as_block(below[0::2]))
        two = len(below) // 2
        done = np.empty_like(first)
        if two:
            done[:, :two] = absorb(absorb(first[:, :two], as_block(below[1::2])), _END[2])
        if two < first.shape[1]:
            done[:, two:] = absorb(first[:, two:], _END[1])
        states.append(to_bytes(first))
        digests.append(to_bytes(done))
    return digests, states


def resume(new: np.ndarray, second: np.ndarray, state: np.ndarray, right: np.ndarray, paired: np.ndarray) -> np.ndarray:
    """Parents' digests with the child ``new`` (n x 32) in its slot.

    In the second slot (``second``) the kept ``state`` (n x 32) is resumed; in the first the initial one, and the ``right`` sibling follows if the
    parent is ``paired``.
    """
    at = np.where(second, from_bytes(state), INITIAL[:, None])
    at = absorb(at, as_block(new))
    more = np.flatnonzero(paired & ~second)
    if len(more):
        at[:, more] = absorb(at[:, more], as_block(right[more]))
    out = np.empty_like(at)
    for blocks, of in ((1, np.flatnonzero(~paired)), (2, np.flatnonzero(paired))):
        if len(of):
            out[:, of] = absorb(at[:, of], _END[blocks])
    return to_bytes(out)


# ---- leaves


def field(c: Column) -> Column:
    text = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(columns: dict[str, Column]) -> Column:
    """The digest of a row, hexadecimal."""
    return F.sha2(F.concat(*(field(c) for c in columns.values())).cast("binary"), 256)


def leaves(docs: DataFrame, keep: list[str], extra: dict[str, Column] | None = None) -> DataFrame:
    """Rows (tree, leaf, *keep, *extra): ``tree`` names the language so that bytewise order is the trees' order."""
    own = leaf({c: F.col(c) for c in FIELDS})
    tree = F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("lang")))
    return docs.select(tree.alias("tree"), F.unhex(own).alias("leaf"), *keep, *((v.alias(k) for k, v in (extra or {}).items())))


def numbered(rows: DataFrame, key: str, order: list[str], parts: int) -> DataFrame:
    """``rows`` with ``idx``, the place in its key's order (from 0), and ``n``, the key's number of rows.

    Rows are range-partitioned by key and order and written with their place inside the part; a part's rows of one key are
    counted, and the counts, one for each part and key in it, are summed up from left to right.
    """
    placed = rows.repartitionByRange(parts, key, *order).withColumn("_part", F.spark_partition_id()).sortWithinPartitions(key, *order)
    at = pa.schema([("_at", pa.int64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count = None, 0
        for batch in batches:
            keys = batch.column(key).dictionary_encode()
            names, codes = keys.dictionary.to_pylist(), keys.indices.to_numpy(zero_copy_only=False)
            out = np.empty(len(codes), np.int64)
            edges = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1], [True]])) if len(codes) else []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if names[codes[a]] != last:
                    last, count = names[codes[a]], 0
                out[a:b] = np.arange(count, count + b - a)
                count += b - a
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, *at.names])

    schema = placed.withColumn("_at", F.lit(0).cast("long")).schema
    stored = save(placed.mapInArrow(place, schema), "places")
    counts = stored.groupBy(key, "_part").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(key)  # a row for each part that the key lies in
    offsets = counts.select(key, "_part", (F.sum("_n").over(w.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(w).alias("n"))
    return stored.join(offsets, [key, "_part"]).withColumn("idx", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


# ---- the tree in chunks


def height_of(nodes: int, size: int) -> int:
    """Levels inside a chunk of a level with so many nodes in the whole tree."""
    return len(levels_of(min(nodes, size))) - 1


CHUNKS = "tree string, idx long, n long, width int, height int, digests binary, states binary, digest binary"


def chunks(nodes: DataFrame, size: int = CHUNK) -> DataFrame:
    """Rows (tree, idx, n, width, height, digests, states, digest) of nodes (tree, idx, n, digest): a chunk is a node of the next pass."""

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        raw = np.frombuffer(b"".join(table.column("digest").to_pylist()), np.uint8).reshape(-1, 32)
        n = table.column("n")[0].as_py()
        height = height_of(n, size)
        digests, states = grow(raw, height)
        row = {
            "tree": [table.column("tree")[0].as_py()], "idx": [table.column("chunk")[0].as_py()], "n": [-(-n // size)], "width": [len(raw)], "height": [height],
            "digests": [np.concatenate(digests).tobytes()], "states": [np.concatenate(states).tobytes() if states else b""], "digest": [digests[-1][0].tobytes()],
        }
        return pa.table(row, schema=_CHUNK_SCHEMA)

    dealt = nodes.select("tree", "idx", "n", "digest", F.floor(F.col("idx") / size).cast("long").alias("chunk"))
    return dealt.groupBy("tree", "chunk").applyInArrow(build, CHUNKS)


_CHUNK_SCHEMA = pa.schema([("tree", pa.string()), ("idx", pa.int64()), ("n", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("digests", pa.binary()), ("states", pa.binary()), ("digest", pa.binary())])
STEP = "array<struct<second: boolean, paired: boolean, state: binary, sibling: binary>>"


class Chunk:
    """A chunk's row, by level."""

    def __init__(self, width: int, height: int, digests: bytes, states: bytes):
        sizes = [width]
        for _ in range(height):
            sizes.append(-(-sizes[-1] // 2))
        at = np.cumsum([0, *sizes])
        raw = np.frombuffer(digests, np.uint8).reshape(-1, 32)
        kept = np.frombuffer(states, np.uint8).reshape(-1, 32)
        self.digests = [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        self.states = [kept[a - width : b - width] for a, b in zip(at[1:-1], at[2:], strict=True)]

    def steps(self, places: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For nodes at ``places``, level by level: second slot?, paired?, state before the slot, sibling."""
        for k, states in enumerate(self.states):
            i = places >> k
            other = i ^ 1
            paired = other < len(self.digests[k])
            yield (i & 1).astype(bool), paired, states[i >> 1], self.digests[k][np.where(paired, other, i)]


def _paths(size: int):
    """For each chunk (with the steps above it) its nodes with all steps above them."""
    kind = pa.list_(pa.struct([("second", pa.bool_()), ("paired", pa.bool_()), ("state", pa.binary()), ("sibling", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for batch in batches for r in batch.to_pylist()):
            chunk, width = Chunk(r["width"], r["height"], r["digests"], r["states"]), r["width"]
            own = [[] for _ in range(width)]
            for step in chunk.steps(np.arange(width)):
                for steps, second, paired, state, sibling in zip(own, *step, strict=True):
                    steps.append({"second": bool(second), "paired": bool(paired), "state": state.tobytes(), "sibling": sibling.tobytes()})
            for lo in range(0, width, 256):
                some = [s + (r["above"] or []) for s in own[lo : lo + 256]]
                idx = r["idx"] * size + np.arange(lo, lo + len(some))
                yield pa.RecordBatch.from_arrays([pa.array([r["tree"]] * len(some), pa.string()), pa.array(idx, pa.int64()), pa.array(some, kind)], names=["tree", "idx", "above"])

    return run


def paths(chunk_rows: DataFrame, above: DataFrame | None, size: int = CHUNK) -> DataFrame:
    """Rows (tree, idx, above) for the nodes of chunks; ``above`` (tree, idx, above) has the steps above each chunk, None: nothing is above."""
    rows = chunk_rows.select("tree", "idx", "width", "height", "digests", "states")
    rows = rows.withColumn("above", F.lit(None).cast(STEP)) if above is None else rows.join(above, ["tree", "idx"], "left")
    return rows.mapInArrow(_paths(size), f"tree string, idx long, above {STEP}")


def pyramid(nodes: DataFrame, name: str, size: int = CHUNK) -> list[DataFrame]:
    """Chunk tables of all passes, each written; the last has one chunk for each tree."""
    out = [save(chunks(nodes, size), name)]
    most = out[0].agg(F.max("n")).first()[0] or 0  # chunks of the largest tree
    while most > 1:
        out.append(save(chunks(out[-1], size), name))
        most = -(-most // size)
    return out


def manifest(nodes: DataFrame, size: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """For leaves (tree, idx, n, digest): their chunks with the steps ``above`` each up to the root, and (tree, subroot, root).

    Chunks hold the digests and midstates; :func:`fold` needs nothing else.
    """
    passes = pyramid(nodes, "manifest", size)
    subroots = save(numbered(passes[-1].select(F.lit("top").alias("all"), "tree", "digest"), "all", ["tree"], 8), "subroots")
    top = pyramid(subroots.select(F.col("all").alias("tree"), "idx", "n", "digest"), "manifest-top", size)
    above = None
    for level in reversed(top):
        above = paths(level, above, size)
    over_trees = subroots.join(above.select("idx", "above"), "idx").select("tree", F.lit(0).cast("long").alias("idx"), "above")
    for level in reversed(passes[1:]):
        over_trees = paths(level, over_trees, size)
    root = top[-1].select(F.col("digest").alias("root"))  # one row
    return passes[0].join(over_trees, ["tree", "idx"]), subroots.select("tree", F.col("digest").alias("subroot")).join(F.broadcast(root))


def fold(rows: DataFrame, chunk_rows: DataFrame, keep: list[str], size: int = CHUNK) -> DataFrame:
    """``keep`` of rows (tree, idx, new, *keep), ``folded``, the root with ``new`` in place of the leaf, and ``proof``, the digest of all siblings."""
    of = rows.select("tree", "idx", "new", *keep).withColumn("chunk", F.floor(F.col("idx") / size).cast("long"))
    schema = of.select("tree", *keep).withColumns({"folded": F.lit(b""), "proof": F.lit("")}).schema

    def climb(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):  # no leaf of this chunk is asked for
            return pa.table({f.name: pa.array([], left.schema.field(f.name).type if f.name in left.schema.names else pa.string() if f.name == "proof" else pa.binary()) for f in schema})
        r = right.to_pylist()[0]
        chunk, n = Chunk(r["width"], r["height"], r["digests"], r["states"]), len(left)
        places = left.column("idx").to_numpy() - r["idx"] * size
        new = np.frombuffer(b"".join(left.column("new").to_pylist()), np.uint8).reshape(-1, 32)
        inside = [hashlib.sha256() for _ in range(n)]

        def level(new, second, paired, state, sibling):
            text = digits(sibling)
            for i in np.flatnonzero(paired).tolist():
                inside[i].update(text[i])
            return resume(new, second, state, sibling, paired)

        for second, paired, state, sibling in chunk.steps(places):
            new = level(new, second, paired, state, sibling)
        for s in r["above"]:
            spread = lambda raw: np.broadcast_to(np.frombuffer(raw, np.uint8), (n, 32))
            new = level(new, np.full(n, s["second"]), np.full(n, s["paired"]), spread(s["state"]), spread(s["sibling"]))
        return left.select(["tree", *keep]).append_column("folded", pa.array([x.tobytes() for x in new], pa.binary())).append_column("proof", pa.array([h.hexdigest() for h in inside], pa.string()))

    other = chunk_rows.select("tree", F.col("idx").alias("chunk"), "idx", "width", "height", "digests", "states", "above")
    return of.groupBy("tree", "chunk").cogroup(other.groupBy("tree", "chunk")).applyInArrow(climb, schema)


def op11(docs: DataFrame, size: int = CHUNK, part: int = PART) -> DataFrame:
    docs = docs.select(*FIELDS)
    # one more character, beyond a 64-bit number, too; a null id is never tampered with
    tampered = leaf({c: (F.col(c).cast("decimal(20,0)") + 1) if c == "n_chars" else F.col(c) for c in FIELDS})
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    rows = save(leaves(docs, ["doc_id"], {"tampered": F.when(chosen, F.unhex(tampered))}), "leaves")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // part + 1)
    placed = save(numbered(rows, "tree", ["doc_id", "leaf"], parts), "numbered")
    chunk_rows, roots = manifest(placed.select("tree", "idx", "n", F.col("leaf").alias("digest")), size)
    folded = fold(placed.withColumn("new", F.coalesce("tampered", "leaf")), chunk_rows, ["doc_id", "leaf"], size)
    text = lambda c: F.lower(F.hex(c)).alias(c)
    out = folded.join(roots, "tree")
    return out.select("doc_id", text("leaf"), text("subroot"), text("root"), F.col("proof").alias("proof_sha256"), F.lower(F.hex("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


#: DuckDB. Plain digests level by level; crc32 bit by bit.
SQL = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, lang,
    {leaf} AS leaf,
    list_reduce(list_prepend(4294967295::BIGINT, range(8 * length(CAST(doc_id AS VARCHAR)))), lambda c, i:
      xor(CASE WHEN i % 8 = 0 THEN xor(c, ord(substr(CAST(doc_id AS VARCHAR), (i // 8 + 1)::BIGINT, 1))) ELSE c END >> 1,
        CASE WHEN (CASE WHEN i % 8 = 0 THEN xor(c, ord(substr(CAST(doc_id AS VARCHAR), (i // 8 + 1)::BIGINT, 1))) ELSE c END) & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END)) AS crc,
    {tampered} AS tampered
  FROM documents),
leaves AS MATERIALIZED (
  SELECT r, doc_id, coalesce('=' || lang, '') AS tree, leaf, CASE WHEN doc_id IS NOT NULL AND xor(crc, 4294967295::BIGINT) % 7 = 0 THEN tampered ELSE leaf END AS new,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n
  FROM d),
up AS (
  SELECT tree, 0 AS level, i, n, leaf AS h FROM leaves
  UNION ALL
  SELECT tree, level + 1, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY tree, level, i // 2),
subroots AS MATERIALIZED (SELECT tree, h, level, row_number() OVER (ORDER BY encode(tree)) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
high AS (
  SELECT 0 AS level, i, n, h FROM subroots
  UNION ALL
  SELECT level + 1, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY level, i // 2),
steps AS MATERIALIZED (
  SELECT l.r, u.level AS step, u.i % 2 AS second, s.h AS sibling
  FROM leaves l JOIN up u ON u.tree = l.tree AND u.i = l.i >> u.level AND u.n > 1 LEFT JOIN up s ON s.tree = u.tree AND s.level = u.level AND s.i = xor(u.i, 1)
  UNION ALL
  SELECT l.r, t.level + u.level, u.i % 2, s.h
  FROM leaves l JOIN subroots t USING (tree) JOIN high u ON u.i = t.i >> u.level AND u.n > 1 LEFT JOIN high s ON s.level = u.level AND s.i = xor(u.i, 1)),
folded AS (
  SELECT r, 0 AS step, new AS h FROM leaves
  UNION ALL
  SELECT f.r, f.step + 1, sha256(CASE WHEN s.second = 1 THEN s.sibling || f.h ELSE f.h || coalesce(s.sibling, '') END) FROM folded f JOIN steps s ON s.r = f.r AND s.step = f.step),
proofs AS (SELECT r, sha256(coalesce(string_agg(sibling, '' ORDER BY step), '')) AS proof FROM steps GROUP BY r),
root AS (SELECT h AS root FROM high WHERE n = 1)
SELECT l.doc_id, l.leaf, t.h AS subroot, root, coalesce(p.proof, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
FROM leaves l JOIN subroots t USING (tree) CROSS JOIN root LEFT JOIN proofs p USING (r) JOIN (SELECT r, arg_max(h, step) AS h FROM folded GROUP BY r) f USING (r)
""".format(
    **{
        name: "sha256(concat(" + ", ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen(CAST({e} AS VARCHAR)), ':', {e}) END" for c, e in of.items()) + "))"
        for name, of in (("leaf", {c: c for c in FIELDS}), ("tampered", {c: f"(CAST({c} AS HUGEINT) + 1)" if c == "n_chars" else c for c in FIELDS}))
    }
)
