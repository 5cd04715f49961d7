"""Quality rules by repetition coverage.

Each text is a sequence of words ``[^\\x20\\x09-\\x0D]+``. Rolling hashes of word n-grams of several lengths and of
whole lines find what is said twice inside one text; the rules look at the share of the text's characters that
such repeats cover. A null or empty text has no words and fails. Equal rows get equal results. Hashes have
64 bits; those of words and lines depend on bytes and places without algebraic structure, so that two different n-grams of one text count as equal with a
chance below 1e-9 for a text of 100,000 words.
Memory: about 60 bytes per byte of the longest text or of a 2 MB slice, whichever is larger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Rolling, as_bytes, covered, flat, mix, range_hashes, repeated, slices, word_bounds

#: Largest share of characters inside repeated word n-grams, by n.
MOST_IN_NGRAMS = {5: 0.35, 6: 0.33, 8: 0.30, 10: 0.27}
#: Largest share of characters inside lines that an earlier line equals.
MOST_IN_LINES = 0.30
SLICE = 1 << 21

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars_in_dup_lines"]


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each text of one slice; ``chars_in_{n}grams`` for each n of the rules besides."""
    data, at = flat(column)
    n_docs = len(at) - 1
    starts, ends, doc = word_bounds(data, at)
    per_doc = lambda mask, of: np.bincount(of[mask], minlength=n_docs).astype(np.int64)
    lead = (data & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(lead)])
    n_chars = chars[ends] - chars[starts]
    sym = np.zeros(256, bool)
    sym[list(b"#*$%&|<>")] = True
    symbols = np.concatenate([[0], np.cumsum(sym[data])])
    out = {
        "n_words": np.bincount(doc, minlength=n_docs).astype(np.int64),
        "word_chars": np.bincount(doc, n_chars, minlength=n_docs).astype(np.int64),
        "n_symbols": symbols[at[1:]] - symbols[at[:-1]],
    }
    # lines: between line feeds and the ends of texts
    cuts = np.flatnonzero(data == 10)
    line_start = np.concatenate([at[:-1], cuts + 1])
    line_end = np.concatenate([at[1:], cuts])
    line_start.sort()
    line_end.sort()
    line_doc = np.searchsorted(at[1:], line_start, "right")
    line_doc[line_start >= len(data)] = 0
    words_before = np.searchsorted(starts, np.stack([line_start, line_end]))
    use = words_before[1] > words_before[0]
    line_start, line_end, line_doc = line_start[use], line_end[use], np.searchsorted(at, line_start[use], "right") - 1
    salt = mix(np.arange(1, n_docs + 1, dtype=np.uint64))
    keys = range_hashes(data, line_start, line_end) ^ salt[line_doc]
    _, first = np.unique(keys, return_index=True)  # lines are in order, so the first of equal ones stays
    again = np.ones(len(keys), bool)
    again[first] = False
    out["n_dup_lines"] = per_doc(again, line_doc)
    ink = np.concatenate([[0], np.cumsum(n_chars)])
    w = np.searchsorted(starts, np.stack([line_start, line_end]))
    out["chars_in_dup_lines"] = np.bincount(line_doc[again], (ink[w[1]] - ink[w[0]])[again], minlength=n_docs).astype(np.int64)
    # word n-grams
    n = len(starts)
    grams = Rolling(range_hashes(data, starts, ends))  # of ten words at most
    for k in sorted({8, *MOST_IN_NGRAMS}):
        i = np.arange(max(0, n - k + 1))
        i = i[doc[i] == doc[i + k - 1]] if len(i) else i
        mask = covered(i[repeated(grams(i, i + k) ^ salt[doc[i]])], k, n)
        if k == 8:
            out["n_repeat_words"] = per_doc(mask, doc)
        out[f"chars_in_{k}grams"] = np.bincount(doc[mask], n_chars[mask], minlength=n_docs).astype(np.int64)
    return out


def verdict(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """base_failed and kept."""
    failed = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
    ink = np.maximum(m["word_chars"], 1)
    bad = m["chars_in_dup_lines"] > MOST_IN_LINES * ink
    for k, most in MOST_IN_NGRAMS.items():
        bad |= m[f"chars_in_{k}grams"] > most * ink
    return failed, ~(failed | bad)


def quality_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with the counts, the covered characters, ``base_failed`` and ``kept``.

    Columns of ``docs`` with the name of a result column are replaced. One pass without a shuffle.
    """
    results = [*COUNTS, *(f"chars_in_{k}grams" for k in sorted({8, *MOST_IN_NGRAMS}))]
    keep = [c for c in docs.columns if c not in {*results, "base_failed", "kept"}]
    schema = T.StructType([*docs.select(*keep).schema.fields, *(T.StructField(c, T.LongType()) for c in results), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = [measure(s) for s in slices(as_bytes(batch.column(text)), SLICE)]
            m = {c: np.concatenate([p[c] for p in parts]) for c in results}
            failed, kept = verdict(m)
            new = [*(pa.array(m[c], pa.int64()) for c in results), pa.array(failed), pa.array(kept)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *new], names=[f.name for f in schema])

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def op7(docs: DataFrame) -> DataFrame:
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality_rules(docs.select("doc_id", "text")).select(*cols, *(F.col(f"chars_in_{k}grams") for k in MOST_IN_NGRAMS))


def _sql() -> str:
    ks = sorted({8, *MOST_IN_NGRAMS})
    each = lambda form, join=",\n    ": join.join(form(k) for k in ks)
    gram = lambda k: " || ' ' || ".join(["word", *(f"lead(word, {j}) OVER w" for j in range(1, k))])
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d)),
grams AS (
  SELECT r, i, length(word) AS n,
    {each(lambda k: f"{gram(k)} AS g{k}")}
  FROM words WINDOW w AS (PARTITION BY r ORDER BY i)),
twice AS (
  SELECT r, i, n,
    {each(lambda k: f"CAST(g{k} IS NOT NULL AND count(*) OVER (PARTITION BY r, g{k}) > 1 AS BIGINT) AS f{k}")}
  FROM grams),
inside AS (
  SELECT r, n,
    {each(lambda k: f"max(f{k}) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) AS c{k}")}
  FROM twice),
of_words AS (
  SELECT r, count(*) AS n_words, sum(n) AS word_chars, sum(c8) AS n_repeat_words,
    {each(lambda k: f"sum(n * c{k}) AS chars_in_{k}grams")}
  FROM inside GROUP BY r),
lines AS (
  SELECT r, line, row_number() OVER (PARTITION BY r, line) > 1 AS again
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
of_lines AS (
  SELECT r, count(*) AS n_dup_lines, sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g'))) AS chars_in_dup_lines FROM lines WHERE again GROUP BY r),
counted AS (
  SELECT doc_id, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ["n_words", "word_chars", "n_repeat_words", "n_dup_lines", "chars_in_dup_lines", *(f"chars_in_{k}grams" for k in ks)])}
  FROM d LEFT JOIN of_words USING (r) LEFT JOIN of_lines USING (r)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, greatest(word_chars, 1)::DOUBLE AS ink FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {", ".join(f"chars_in_{k}grams" for k in MOST_IN_NGRAMS)}, base_failed,
  NOT (base_failed OR chars_in_dup_lines > {MOST_IN_LINES}::DOUBLE * ink OR {" OR ".join(f"chars_in_{k}grams > {most}::DOUBLE * ink" for k, most in MOST_IN_NGRAMS.items())}) AS kept
FROM judged
"""


#: DuckDB. Compares n-grams and lines themselves, not their hashes.
SQL = _sql()
