"""Personal data, with DataFrame functions only.

Regular expressions propose spans, checks confirm them (digit counts, octets, Luhn, mod 97), and words near a span
move its score. Base kinds (email, ip, card, phone) that pass their check always stay; the method adds ``iban``
(mod 97) and ``ssn`` (a number that only nearby words confirm), which stay at a score of ``LEAST`` or more.
Spans are in code points, end exclusive. A null or empty text has none. Equal rows give equal results.

Positions come from the pieces between matches: the text split at a pattern, and the matches of the same pattern, alternate.
Patterns use possessive quantifiers and begin at the edge of a run, which finds the same matches in linear time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: kind: (pattern, cheap test whether a text can have one, score before context, words that raise it, least score)
KINDS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, r"(?i)e-?mail|contact|write|address|mailto", 0.0),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", r"[0-9]\.[0-9]", 0.7, r"(?i)\bip\b|host|server|addr|login|client", 0.0),
    "card": (r"[0-9](?:[\x20-]?+[0-9])++", r"[0-9]", 0.8, r"(?i)card|visa|master|credit|pay|amex", 0.0),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.7, r"(?i)phone|tel|call|mobile|fax|contact", 0.0),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}", 0.8, r"(?i)iban|bank|account|transfer|konto", 0.5),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]", 0.3, r"(?i)ssn|social|security|insurance", 0.5),
}
BASE = ("email", "ip", "card", "phone")
#: Code points before and after a span that count as near, and what a word there adds.
NEAR = 48
RAISE = 0.3


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(d, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number without blanks passes its check."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: (a * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97) == 1


def confirmed(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))).between(0, 3) & (F.coalesce(F.try_to_number(F.right(F.concat(F.lit("000"), p), F.lit(3)), F.lit("999")), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        plain = F.replace(m, F.lit(" "), F.lit(""))
        return F.when(F.length(plain).between(15, 34), mod97(plain)).otherwise(F.lit(False))
    return F.lit(True)


#: Spans compare by start, then by the place of their kind in the list.
EMPTY = "array<struct<start:bigint,rank:int,end:bigint,kind:string,score:double>>"


def spans_of(text: Column, kind: str) -> Column:
    """The confirmed spans of a kind: array of (start, rank, end, kind, score)."""
    pattern, can, score, words, least = KINDS[kind]
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # place: (end of the last match, spans so far), over pairs of the piece before a match and the match
    pairs = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)).alias("gap"), matches.alias("match"))
    start = lambda acc, p: acc["at"] + F.length(p["gap"])
    step = lambda acc, p: F.struct(
        (start(acc, p) + F.length(p["match"])).cast("long").alias("at"),
        F.when(confirmed(kind, p["match"]), F.concat(acc["out"], F.array(F.struct(start(acc, p).cast("long").alias("start"), (start(acc, p) + F.length(p["match"])).cast("long").alias("end"))))).otherwise(acc["out"]).alias("out"),
    )
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out"))
    found = F.aggregate(pairs, zero, step)["out"]
    near = lambda s: F.concat(F.substr(text, F.greatest(s["start"] - NEAR, F.lit(0)).cast("int") + 1, (s["start"] - F.greatest(s["start"] - NEAR, F.lit(0))).cast("int")), F.lit(" "), F.substr(text, s["end"].cast("int") + 1, F.lit(NEAR)))
    scored = F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(list(KINDS).index(kind)).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), F.when(F.rlike(near(s), F.lit(words)), F.lit(min(1.0, score + RAISE))).otherwise(F.lit(score)).alias("score")))
    if least > 0:
        scored = F.filter(scored, lambda s: s["score"] >= least)
    return F.when(F.rlike(text, F.lit(can)), scored).otherwise(F.array().cast(EMPTY))


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``findings``: all spans by start, then kind as listed. A column of that name is replaced."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.drop("findings").withColumns({f"_pii_{k}": spans_of(t, k) for k in KINDS})
    found = F.array_sort(F.concat(*(F.col(f"_pii_{k}") for k in KINDS)))
    return rows.withColumn("findings", found).drop(*(f"_pii_{k}" for k in KINDS))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each span of the text replaced by its kind in brackets; overlapping spans become one, named after the first."""
    rows = find_pii(docs, text)
    t = F.col(text)
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    gap = lambda acc, s: F.substr(t, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int"))
    step = lambda acc, s: F.struct(
        F.greatest(acc["at"], s["end"]).alias("at"),
        F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap(acc, s), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(acc["out"]).alias("out"),
    )
    done = F.aggregate(F.col("findings"), zero, step, lambda acc: F.concat(acc["out"], F.substr(t, acc["at"].cast("int") + 1, F.length(t))))
    return rows.withColumn(text, F.when(F.size("findings") > 0, done).otherwise(t)).drop("findings")


def op4(docs: DataFrame) -> DataFrame:
    rows = find_pii(docs.select("doc_id", "text"))
    joined = lambda f: F.array_join(F.transform(f, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("findings", lambda s: s["rank"] < len(BASE))
    of = lambda kind: lambda s: s["kind"] == kind
    return rows.select(
        "doc_id",
        *(F.size(F.filter("findings", of(k))).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("findings")).alias("spans"),
        F.when(F.size("findings") > 0, F.array_max(F.transform("findings", lambda s: s["score"]))).alias("top_score"),
    )


#: The kinds' patterns for an engine without look-around. ``<`` and ``>`` stand for marks around the runs of a class of characters.
PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", None),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", None),
    "card": (r"[0-9]([\x20-]?[0-9])+", None),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", None),
    "iban": (r"<[A-Z]{2}[0-9]{2}(?:(?:>\x20<)?[A-Z0-9]{4}){2,7}(?:(?:>\x20<)?[A-Z0-9]{1,3})?>", "[A-Za-z0-9]"),
    "ssn": (r"<[0-9]{3}-[0-9]{2}-[0-9]{4}>", "[0-9-]"),
}


def _sql() -> str:
    low, high = "\ue000", "\ue001"
    sources, raised, plain, least = [], [], [], []
    for rank, (kind, (pattern, runs)) in enumerate(PLAIN.items()):
        text = f"regexp_replace(t, '({runs}+)', '{low}\\1{high}', 'g')" if runs else "t"
        pattern = pattern.replace("<", low).replace(">", high)
        sources.append(f"SELECT r, {rank} AS rank, '{kind}' AS kind, t, string_split_regex(s, '{pattern}') AS gaps, regexp_extract_all(s, '{pattern}') AS found FROM (SELECT r, t, {text} AS s FROM d)")
        _, _, score, words, lowest = KINDS[kind]
        raised.append(f"WHEN kind = '{kind}' AND regexp_matches(near, '{words}') THEN {min(1.0, score + RAISE)}::DOUBLE")
        plain.append(f"WHEN kind = '{kind}' THEN {score}::DOUBLE")
        least.append(f"WHEN '{kind}' THEN {lowest}::DOUBLE")
    bare = lambda c: f"replace(replace({c}, '{low}', ''), '{high}', '')"
    span = "kind || ':' || (e - n) || ':' || e"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
proposed AS ({" UNION ALL ".join(sources)}),
pieces AS (SELECT r, rank, kind, t, unnest(gaps[1:len(found)]) AS gap, unnest(found) AS m, generate_subscripts(found, 1) AS k FROM proposed WHERE len(found) > 0),
bare AS (SELECT r, rank, kind, t, k, {bare("m")} AS m, length({bare("gap")}) AS before FROM pieces),
placed AS (
  SELECT *, length(m) AS n, CAST(sum(before + length(m)) OVER (PARTITION BY r, rank ORDER BY k) AS BIGINT) AS e, regexp_replace(m, '[^0-9]', '', 'g') AS digits, replace(m, ' ', '') AS account
  FROM bare),
confirmed AS (
  SELECT * FROM placed WHERE CASE kind
    WHEN 'ip' THEN list_max(list_transform(string_split(m, '.'), lambda p: CASE WHEN length(ltrim(p, '0')) > 3 THEN 999 ELSE CAST('0' || ltrim(p, '0') AS INTEGER) END)) <= 255
    WHEN 'card' THEN length(digits) BETWEEN 12 AND 19
      AND list_sum(list_transform(string_split(reverse(digits), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN CAST(c AS INTEGER) ELSE CAST(c AS INTEGER) * 2 // 10 + CAST(c AS INTEGER) * 2 % 10 END)) % 10 = 0
    WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15
    WHEN 'iban' THEN length(account) BETWEEN 15 AND 34
      AND list_reduce(list_transform(string_split(substr(account, 5) || substr(account, 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END), lambda a, v: (a * CASE WHEN v < 10 THEN 10 ELSE 100 END + v) % 97, 0) = 1
    ELSE true END),
beside AS (SELECT *, substr(t, greatest(e - n - {NEAR}, 0) + 1, e - n - greatest(e - n - {NEAR}, 0)) || ' ' || substr(t, e + 1, {NEAR}) AS near FROM confirmed),
scored AS (SELECT *, CASE {" ".join(raised + plain)} END AS score FROM beside),
stay AS (SELECT * FROM scored WHERE score >= CASE kind {" ".join(least)} END),
joined AS (
  SELECT r, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)}, max(score) AS top_score,
    string_agg({span}, ',' ORDER BY e - n, rank) FILTER (rank < {len(BASE)}) AS base, string_agg({span}, ',' ORDER BY e - n, rank) AS spans
  FROM stay GROUP BY r)
SELECT doc_id, {", ".join(f"CAST(coalesce(n_{k}, 0) AS BIGINT) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, top_score
FROM d LEFT JOIN joined USING (r)
"""


#: DuckDB.
SQL = _sql()
