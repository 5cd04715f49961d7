"""Packing by concatenation and cutting.

Pass 1 turns every text into token ids with its end id, and writes them in partitions to the shared folder together with each
document's place inside its partition. The partition totals (one row a partition) become base offsets by a prefix
sum. Pass 2 adds the base to get every document's global place and cuts at multiples of the window: one boundary
record per piece. All sequences but the last are full, so padding is less than one window in all. Nothing is
shuffled but the partition totals.

A null text is empty: only its end id. Documents keep the order of the table's partitions; equal rows are packed
apart. Tokens of a text are those of the public tokenizer. Where its rules never reach over white space (``by_words``), the
texts of a slice are cut into pieces with numpy, different pieces are found with Arrow, and only those that a worker has not
met go to the tokenizer; they are remembered, also for its next tasks (up to ``REMEMBERED``, then forgotten). With any other
tokenizer file, whole texts are encoded.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, flat, save, slices

WINDOW = 2048
END_ID = 1
REMEMBERED = 700_000
SLICE = 1 << 22
_encoders: dict[str, TextTokenizer] = {}

#: A word of Latin-1 letters and then ASCII signs (no apostrophe): two pieces for the splitting rule below, whatever they are.
PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*)([!-&(-/:-@\[-`{-~]*)")
#: The rules of a tokenizer whose texts can be encoded piece by piece.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMAL = [("NFC", None), ("Replace", "\\s+"), ("Lowercase", None)]
WORD_END = "</w>"
BLANK, LETTER, SIGN, OTHER = range(4)
_KIND = np.full(256, OTHER, np.uint8)
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
_KIND[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and c != 0x27]] = SIGN
_KIND[[0x20, 0x0A]] = BLANK  # other white space stays inside a word, which then goes to the whole tokenizer


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next free one above 255."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def by_words(rules: dict) -> bool:
    """Whether a tokenizer lower-cases, splits as above, spells in byte letters, and marks the ends of pieces."""
    normal, split, model = rules["normalizer"] or {}, rules["pre_tokenizer"] or {}, rules["model"]
    steps = [(n["type"], n.get("pattern", {}).get("Regex")) for n in normal.get("normalizers", ())]
    cut = split.get("pretokenizers", [])
    return (
        steps == NORMAL
        and [c["type"] for c in cut] == ["Split", "ByteLevel"]
        and (cut[0]["pattern"], cut[0]["behavior"], cut[0]["invert"]) == ({"Regex": SPLIT}, "Removed", True)
        and not cut[1]["add_prefix_space"]
        and not cut[1]["use_regex"]
        and (model["type"], model["end_of_word_suffix"], model["continuing_subword_prefix"], model["dropout"]) == ("BPE", WORD_END, None, None)
        and not any(PLAIN.fullmatch(t["content"]) for t in rules["added_tokens"])
    )


def pieces(data: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Pieces of concatenated texts in order: their bytes (those of plain words lower-cased), which are whole odd words, and each one's text."""
    n = len(data)
    kind = _KIND[data]
    low = data.copy()
    low[(data >= 0x41) & (data <= 0x5A)] |= 0x20
    lead = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0xC0) & (data[1:] != 0x97) & (data[1:] != 0xB7))  # two bytes of a Latin-1 letter
    kind[lead] = kind[lead + 1] = LETTER
    big = lead[data[lead + 1] < 0x9F] + 1
    low[big] |= 0x20
    ink = kind != BLANK
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    fresh = edge[:-1] | np.concatenate([[True], ~ink[:-1]])
    starts = np.flatnonzero(ink & fresh)
    if not len(starts):
        return pa.array([], pa.large_binary()), np.zeros(0, bool), np.zeros(0, np.int64)
    before = np.concatenate([[np.uint8(BLANK)], kind[:-1]])
    turn = (before == LETTER) & (kind == SIGN) & ~fresh
    odd = (kind == OTHER) | ((before == SIGN) & (kind == LETTER) & ~fresh)
    odd_word = np.add.reduceat(odd, starts, dtype=np.int32) > 0  # a blank is never odd
    word = np.cumsum(ink & fresh) - 1
    cut = np.flatnonzero(turn)
    cut = cut[~odd_word[word[cut]]]
    first = np.sort(np.concatenate([starts, cut]))
    is_odd = odd_word[word[first]]
    if is_odd.any():
        keep = ink & odd_word[np.maximum(word, 0)]
        low[keep] = data[keep]
    inked = np.cumsum(ink)
    ends = np.append(inked[first] - 1, inked[-1])
    array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(low[ink])])
    return array, is_odd, np.searchsorted(at, first, "right") - 1


class TextTokenizer:
    """Ids of whole texts by a tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer, pre_tokenizers

        self.inner = Tokenizer.from_file(path)
        self.by_words = by_words(json.loads(self.inner.to_str()))
        self.known: dict[bytes, int] = {}
        if self.by_words:
            self.model = Tokenizer(self.inner.model)  # for pieces that are split, lower-cased and spelt already
            self.model.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
            vocabulary = self.inner.get_vocab(with_added_tokens=False)
            self.last = np.zeros(self.inner.get_vocab_size(), bool)
            self.last[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True
            letters = byte_letters()
            self.spelling = {chr(c): "".join(letters[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}

    def forget(self, end_id: int) -> None:
        """Only the end of a text is known, as piece 0."""
        self.end_id = end_id
        self.known = {b"": 0}
        small = self.inner.get_vocab_size() <= 1 << 16 and end_id < 1 << 16
        self.ids = np.full(1 << 20, end_id, np.uint16 if small else np.uint32)
        self.ends = np.array([0, 1])

    def learn(self, names: list[bytes], odd: np.ndarray) -> np.ndarray:
        """Numbers of different pieces."""
        known = self.known.get
        codes = np.fromiter((known(n, -1) for n in names), np.int64, len(names))
        new = codes < 0
        plain, whole = (np.flatnonzero(new & which).tolist() for which in (~odd, odd))
        for group in (plain, whole):
            if not group:
                continue
            if group is plain:
                text = b" ".join([names[i] for i in group]).decode()
                if not text.isascii():
                    for c in set(text).intersection(self.spelling):
                        text = text.replace(c, self.spelling[c])
                ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.ids.dtype)
                ends = np.flatnonzero(self.last[ids]) + 1
            else:
                found = [e.ids for e in self.inner.encode_batch_fast([names[i].decode() for i in group], add_special_tokens=False)]
                ids = np.array([i for e in found for i in e], self.ids.dtype)
                ends = np.cumsum([len(e) for e in found])
            assert len(ends) == len(group)
            used = int(self.ends[-1])
            while used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.ids[used : used + len(ids)] = ids
            codes[group] = np.arange(len(group)) + len(self.ends) - 1
            self.ends = np.concatenate([self.ends, used + ends])
            self.known.update(zip((names[i] for i in group), codes[group].tolist(), strict=True))
        return codes

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by the end id, and the number of ids of each text."""
        if not self.by_words:
            found = [e.ids for e in self.inner.encode_batch_fast([t.decode() for t in as_bytes(texts).to_pylist()], add_special_tokens=False)]
            return np.array([i for e in found for i in (*e, end_id)], np.uint32), np.array([len(e) + 1 for e in found], np.int64)
        if len(self.known) > REMEMBERED or not self.known or self.end_id != end_id:
            self.forget(end_id)
        data, at = flat(texts)
        found, odd, text = pieces(data, at)
        coded = found.dictionary_encode()
        index = coded.indices.to_numpy()
        odd_name = np.zeros(len(coded.dictionary), bool)
        odd_name[index[odd]] = True
        code = self.learn(coded.dictionary.to_pylist(), odd_name)[index]
        n = len(at) - 1
        after = np.cumsum(np.bincount(text, minlength=n)) + np.arange(n)  # a text's end comes behind its pieces
        every = np.zeros(len(code) + n, np.int64)
        inside = np.ones(len(every), bool)
        inside[after] = False
        every[inside] = code
        first, length = self.ends[every], self.ends[every + 1] - self.ends[every]
        total = np.cumsum(length)
        ids = self.ids[np.repeat(first - (total - length), length) + np.arange(total[-1] if n else 0)]
        return ids, np.diff(total[after], prepend=0)


def tokenized(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, part, place (ids before the document in its partition), doc_tokens and ids (little-endian unsigned 32-bit or, where they fit, 16-bit)."""
    schema = docs.select("doc_id").selectExpr("doc_id", "0 as part", "0L as place", "0L as doc_tokens", "cast(null as binary) as ids").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _encoders:
            _encoders[tokenizer] = TextTokenizer(tokenizer)
        encode, place = _encoders[tokenizer], 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            done = 0
            for texts in slices(batch.column("text"), SLICE):
                ids, n = encode(texts, end_id)
                ends = np.cumsum(n)
                data = ids.astype(ids.dtype.newbyteorder("<"))
                blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.concatenate([[0], ends]) * data.itemsize), pa.py_buffer(data)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(done, len(n)), pa.array(np.full(len(n), part, np.int32)), pa.array(place + ends - n), pa.array(n), blobs], names=[f.name for f in schema])
                place += int(ends[-1])
                done += len(n)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def cut(tokens: DataFrame, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Pieces of documents with a global place: one row for each stretch of a document in one sequence."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
    schema = tokens.selectExpr("doc_id", *(f"0L as {c}" for c in names[1:7]), *["cast(null as binary) as ids"] * with_ids).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("doc_tokens").to_numpy()
            at = batch.column("place").to_numpy()
            pieces = (at + n - 1) // window - at // window + 1
            row = np.repeat(np.arange(len(n)), pieces)
            seq = np.repeat(at // window - (np.cumsum(pieces) - pieces), pieces) + np.arange(pieces.sum())
            first, last = np.maximum(at[row], seq * window), np.minimum((at + n)[row], (seq + 1) * window)
            start, length = first - at[row], last - first
            blobs, crc, bits = batch.column("ids"), [], []
            ids = np.zeros(0, np.uint32)
            held = -1
            for r, a, m in zip(row.tolist(), start.tolist(), length.tolist(), strict=True):
                if r != held:
                    raw, held = blobs[r].as_buffer(), r
                    ids = np.frombuffer(raw, "<u2" if raw.size == 2 * n[r] else "<u4").astype("<u4")
                piece = ids[a : a + m].tobytes()
                crc.append(zlib.crc32(piece))
                if with_ids:
                    bits.append(piece)
            arrays = [batch.column("doc_id").take(pa.array(row)), *map(pa.array, (start, length)), pa.array(crc, pa.int64()), pa.array(n[row]), pa.array(seq), pa.array(first - seq * window)]
            yield pa.RecordBatch.from_arrays([*arrays, *[pa.array(bits, pa.binary())] * with_ids], names=names)

    return tokens.select("doc_id", "place", "doc_tokens", "ids").mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids if asked for."""
    if window < 1:
        raise ValueError("window must be positive")
    tokens = save(tokenized(docs, tokenizer, end_id), "tokens")
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    bases = totals.select(F.col("part"), (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    placed = tokens.join(F.broadcast(bases), "part").withColumn("place", F.col("place") + F.col("base"))  # a row for each task of pass 1
    return cut(placed, window, with_ids)


def op6(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
