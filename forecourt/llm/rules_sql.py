"""The quality rules (operator 4) as one SQL text for DuckDB, built from the operator's parameters."""

from __future__ import annotations

from . import quality_rules as R

#: CRC-32 of a short ASCII text, from the byte table of its reversed polynomial.
_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
_TABLE = f"list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, x: {_STEP}))"


def _crc32(text: str, table: str) -> str:
    return f"xor(list_reduce(list_concat([4294967295]::BIGINT[], list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1])), 4294967295)"


_SPACE = r"\x20\x09-\x0D"
_VALUES = {
    "symbols": ("n_symbols", "n_words"),
    "capitals": ("n_capitals", "word_chars"),
    "exclamations": ("n_marks", "n_words"),
    "repeats": ("n_repeat_words", "n_words"),
    "lines": ("n_dup_lines", "n_lines"),
}
_RISK = R.RISK / len(R.RULES)

SQL = f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
cut AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^{_SPACE}]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{_SPACE}]')) AS l FROM texts),
windows AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + {R.WINDOW - 1}] AS g FROM cut, unnest(range(1, greatest(len(w) - {R.WINDOW - 2}, 1))) AS u(i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range({R.WINDOW}) AS v(k) GROUP BY r),
stats AS (
  SELECT c.r, doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals, length(regexp_replace(t, '[^!]', '', 'g')) AS n_marks, len(l) AS n_lines
  FROM cut c LEFT JOIN covered v ON c.r = v.r),
judged AS (
  SELECT *, n_words < {R.LEAST_WORDS} OR 100 * n_repeat_words > {R.MOST_REPEATED_PERCENT} * n_words AS base_failed,
    {" + ".join(f"(n_words >= {n})::INT" for n in R.STRATA)} AS s,
    {", ".join(f"coalesce({a}::DOUBLE / nullif({b}, 0), 0) AS v_{name}" for name, (a, b) in _VALUES.items())}
  FROM stats),
crc AS (SELECT {_TABLE} AS bytes),
labelled AS (
  SELECT s, quality AS label, unnest([{", ".join(f"{{'rule': '{name}', 'v': v_{name}}}" for name in _VALUES)}]) AS u
  FROM judged j JOIN labels q ON j.doc_id = q.doc_id, crc
  WHERE quality IN (0, 1) AND NOT base_failed AND {_crc32("j.doc_id::VARCHAR", "bytes")} % {R.FOLDS} <> {R.HELD_OUT}),
grid AS (SELECT unnest(range({len(R.GRID)})) AS k, unnest([{", ".join(f"{c}::DOUBLE" for c in R.GRID)}]) AS cutoff),
counted AS (SELECT s, u.rule AS rule, k, cutoff, count(*) FILTER (WHERE label = 1) AS n, count(*) FILTER (WHERE label = 1 AND u.v > cutoff) AS f, count(*) FILTER (WHERE label = 0 AND u.v > cutoff) AS t FROM labelled, grid GROUP BY ALL),
tested AS (
  SELECT *, CASE WHEN f >= n OR f > n * {_RISK!r} THEN 1 ELSE list_sum(list_transform(range(f + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_RISK!r}) + (n - i) * ln(1 - {_RISK!r})))) END AS chance FROM counted),
certified AS (SELECT *, bool_and(chance <= {R.LEVEL / (len(R.RULES) * len(R.STRATA))!r}) OVER (PARTITION BY s, rule ORDER BY k) AS ok FROM tested),
chosen AS (SELECT s, rule, first(cutoff ORDER BY t - {R.GOOD_COST} * f DESC, k) AS cutoff FROM certified WHERE ok AND t > {R.GOOD_COST} * f GROUP BY s, rule),
limits AS (SELECT {", ".join(f"coalesce(max(cutoff) FILTER (WHERE s = {s} AND rule = '{name}'), 'infinity'::DOUBLE) AS c{s}_{name}" for s in range(1, len(R.STRATA) + 1) for name in _VALUES)} FROM chosen)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ({" OR ".join(f"(s = {s} AND v_{name} > c{s}_{name})" for s in range(1, len(R.STRATA) + 1) for name in _VALUES)}) AS kept,
  n_capitals, n_marks, n_lines
FROM judged, limits
"""
