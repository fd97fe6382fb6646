"""The corpus queries in DuckDB's SQL, where SQL can say them."""

from __future__ import annotations

from spendlens.llm import pii, secret_scan

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

NEAR_DUPLICATES = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'),
                                                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingles FROM w),
e AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
halves AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
    AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
links AS (FROM halves UNION ALL SELECT b, a FROM halves),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM s UNION SELECT reach.doc_id, b FROM reach JOIN links ON other = a),
smallest AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT s.doc_id, len(shingles) AS n_shingles, component_id, s.doc_id = component_id AS kept
FROM s JOIN smallest USING (doc_id)"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def matches(kind: int, pattern: str, kept: str = "doc_id", source: str = "texts") -> str:
    """The columns ``kept`` and kind, start, value of the matches of a pattern in the texts of ``source``."""
    p = quoted(pattern)
    return f"""
  SELECT {kept}, text, {kind} AS kind, found[k] AS value,
         length(array_to_string(between_[1:k], '')) + length(array_to_string(found[1:k - 1], '')) AS start
  FROM (SELECT *, unnest(range(1, len(found) + 1)) AS k FROM (
    SELECT {kept}, text, regexp_extract_all(text, {p}) AS found, string_split_regex(text, {p}) AS between_ FROM {source}))"""


def names(kinds: list[str]) -> str:
    return f"([{', '.join(map(quoted, kinds))}])[kind + 1]"


def answer(kinds: list[str], base: int, further: str) -> str:
    """One row per document from ``good``, the spans that stay."""
    counts = ", ".join(f"count(*) FILTER (kind = {k}) AS n_{kinds[k]}" for k in range(base))
    shown = f"string_agg({names(kinds)} || ':' || start || ':' || start + length(value), ',' ORDER BY start, kind)"
    return f"""
SELECT doc_id, {counts}, sha256(coalesce({shown} FILTER (kind < {base}), '')) AS base_sha256,
       coalesce({shown} FILTER (kind >= 0), '') AS spans, {further}
FROM texts LEFT JOIN good USING (doc_id) GROUP BY doc_id"""


TEXTS = "WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"
DIGITS = "regexp_replace(value, '[^0-9]', '', 'g')"
LUHN = f"""list_sum(list_transform(range(1, length({DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1
  THEN substr({DIGITS}, length({DIGITS}) - i + 1, 1)::INT ELSE (2 * substr({DIGITS}, length({DIGITS}) - i + 1, 1)::INT) // 10
  + (2 * substr({DIGITS}, length({DIGITS}) - i + 1, 1)::INT) % 10 END)) % 10 = 0"""
PLAIN = "replace(value, ' ', '')"
MOD_97 = f"""list_reduce(list_prepend(0, list_transform(string_split(substr({PLAIN}, 5) || left({PLAIN}, 4), ''),
  lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c::INT ELSE 1000 + ascii(c) - 55 END)),
  lambda r, d: CASE WHEN d >= 1000 THEN (100 * r + d - 1000) % 97 ELSE (10 * r + d) % 97 END) = 1"""
BEFORE = f"lower(substr(text, greatest(start - {pii.NEAR}, 0) + 1, least(start, {pii.NEAR})))"
WORTH = "([" + ", ".join(f"{p + c}::DOUBLE" for p, c in zip(pii.PROPOSED, pii.CHECKED)) + "])[kind + 1]"
SUPPORTED = "CASE kind " + " ".join(
    f"WHEN {k} THEN regexp_matches({BEFORE}, {quoted(w)})" for k, w in enumerate(pii.WORDS)) + " END"

PERSONAL_DATA = TEXTS + ", proposed AS (" + " UNION ALL ".join(matches(k, p) for k, p in enumerate([
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    r"[0-9](?:[\x20-]?[0-9])+", pii.PHONE, pii.IBAN, pii.SSN])) + f"""),
confirmed AS (
  SELECT *, round(least(1.0::DOUBLE, {WORTH} + CASE WHEN {SUPPORTED} THEN {pii.SUPPORT}::DOUBLE ELSE 0 END), 2) AS score
  FROM proposed WHERE CASE kind
    WHEN 1 THEN list_max(list_transform(string_split(value, '.'), lambda p: CASE WHEN length(ltrim(p, '0')) > 3 THEN 999
      WHEN ltrim(p, '0') = '' THEN 0 ELSE ltrim(p, '0')::INT END)) <= 255
    WHEN 2 THEN length({DIGITS}) BETWEEN 12 AND 19 AND {LUHN} WHEN 3 THEN length({DIGITS}) BETWEEN 9 AND 15
    WHEN 4 THEN {MOD_97}
    WHEN 5 THEN NOT regexp_matches(CASE WHEN start > 0 THEN substr(text, start, 1) ELSE '' END || substr(text, start + length(value) + 1, 1), '[0-9-]')
    ELSE TRUE END),
good AS (SELECT doc_id, kind, value, start, score FROM confirmed WHERE kind < {pii.BASE} OR score >= {pii.THRESHOLD})""" + answer(
    pii.KINDS, pii.BASE, "coalesce(string_agg(score::VARCHAR, ',' ORDER BY start, kind), '') AS scores")

ALLOWED = " OR ".join(f"regexp_matches(value, {quoted(p)})" for p in secret_scan.ALLOWED[:-1])
LEAST_BITS = "CASE " + " ".join(f"WHEN regexp_matches(value, {quoted(p)}) THEN {bits}::DOUBLE" for p, bits in secret_scan.CLASSES) + " END"
#: A part between separators that holds a word of the allow-list; matches begin leftmost, so at the part's first character.
SHOWN = f"(?i)[A-Za-z0-9]*?(?:{secret_scan.SHOWN.removeprefix('(?i)')})[A-Za-z0-9]*"
TOP_BITS = f"""list_max(list_transform(range(1, length(value) - {secret_scan.WINDOW - 2}),
  lambda i: list_entropy(string_split(substr(value, i, {secret_scan.WINDOW}), ''))))"""

SECRETS = TEXTS + ", proposed AS (" + " UNION ALL ".join(matches(k, p) for k, p in enumerate([
    secret_scan.ASSIGN, secret_scan.ACCESS, secret_scan.HEX, secret_scan.CANDIDATE])) + f"""),
base AS (SELECT doc_id, kind, value, start FROM proposed WHERE CASE kind
    WHEN 0 THEN length(regexp_extract(value, {quoted(secret_scan.ASSIGN)}, 1)) >= 8 WHEN 1 THEN length(value) >= 16
    WHEN 2 THEN TRUE ELSE FALSE END),
runs AS (SELECT doc_id, start AS head, value AS text, row_number() OVER () AS run FROM proposed WHERE kind = 3),
shown AS ({matches(3, SHOWN, "run, head", "runs")}),
cuts AS (
  SELECT run, head + start AS a, head + start + length(value) AS b FROM shown
  UNION ALL SELECT run, start, start + length(value) FROM runs JOIN base USING (doc_id)),
uncut AS (
  SELECT doc_id, run, head, text, p, p - row_number() OVER (PARTITION BY run ORDER BY p) AS island
  FROM (SELECT *, unnest(range(head, head + length(text))) AS p FROM runs) c
  WHERE NOT EXISTS (SELECT 1 FROM cuts WHERE cuts.run = c.run AND a <= p AND p < b)),
pieces AS (
  SELECT doc_id, head, text, min(p) AS a, max(p) + 1 AS b FROM uncut GROUP BY doc_id, run, head, text, island
  HAVING count(*) >= {secret_scan.WINDOW}),
headless AS (
  SELECT *, substr(text, a - head + 1, b - a) AS part, CASE WHEN a > head THEN ltrim(part, '{secret_scan.SEPARATORS}') ELSE part END AS tail
  FROM pieces),
random AS (
  SELECT doc_id, 3 AS kind, CASE WHEN b < head + length(text) THEN rtrim(tail, '{secret_scan.SEPARATORS}') ELSE tail END AS value,
         a + length(part) - length(tail) AS start
  FROM headless WHERE length(value) >= {secret_scan.WINDOW} AND NOT ({ALLOWED}) AND {TOP_BITS} >= {LEAST_BITS}),
good AS (FROM base UNION ALL FROM random)""" + answer(
    secret_scan.KINDS, secret_scan.BASE, "count(*) FILTER (kind = 3) AS n_entropy")
