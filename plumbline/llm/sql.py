"""SQL twins of the contract queries that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

from . import quality, winnow

_LOWERED = f"translate(coalesce(text, ''), '{winnow.UPPER}', '{winnow.LOWER}')"
_WORDS = rf"list_filter(regexp_split_to_array({_LOWERED}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

CONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least({winnow.WINDOW_WORDS}, len(w)) AS n, unnest(generate_series(1, len(w) - least({winnow.WINDOW_WORDS}, len(w)) + 1)) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, p, dw.n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS q FROM m) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS items FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def _shares(kind: str) -> str:
    cases = " ".join(f"WHEN '{lang}' THEN {quality.language_shares(lang, kind)}" for lang in quality.references())
    return f"CASE lang {cases} END"


def _distance(counts: str, shares: str) -> str:
    half = lambda v, q, p: f"CASE WHEN {v} > 0 THEN {v} * log2({v} / (({p} + {q}) / 2)) ELSE 0 END"
    p, q = f"({counts}[i] / list_sum({counts})::DOUBLE)", "s[i]"
    term = f"({half(p, q, p)} + {half(q, q, p)}) / 2"
    return f"list_min(list_transform({shares}, lambda s: sqrt(greatest(list_sum(list_transform(range(1, len(s) + 1), lambda i: {term})), 0))))"


_OWN = " ".join(f"WHEN '{lang}' THEN {listed.split()}" for lang, listed in quality.COMMON_WORDS.items())
_SPACE = r"[\x20\x09-\x0D]+"


def _kept(characters: str) -> str:
    return f"length(regexp_replace(t, '[^{characters}]', '', 'g'))"


QUALITY = rf"""
WITH base AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, lang, t, list_filter(regexp_split_to_array(t, '{_SPACE}'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '{_SPACE}', '', 'g') <> '') AS l FROM base),
g AS (SELECT doc_id, p, array_to_string(w[p:p + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS p FROM w WHERE len(w) >= 3)),
r AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
c AS (
  SELECT w.doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST({_kept('#*$%&|<>')} AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
         [{_kept('A-Z')}, {_kept('0-9')}, {_kept(".,;:!?''\"()\\-")}, {_kept('#$%&*+/<=>@\\[\\\\\\]^_`{{|}}~').replace('{{', '{').replace('}}', '}')}, length(regexp_replace(t, '[\x00-\x7F]', '', 'g'))] AS k,
         list_filter(regexp_split_to_array(lower(t), '[^\p{{L}}]+'), lambda x: x <> '') AS tokens, CASE lang {_OWN} END AS own
  FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
h AS (
  SELECT *, list_append(k, greatest(word_chars - list_sum(k), 0)) AS cc, list_transform(own, lambda x: len(list_filter(tokens, lambda y: y = x))) AS f FROM c),
h2 AS (SELECT *, list_append(f, len(tokens) - list_sum(f)) AS cw FROM h),
d AS (
  SELECT *, CASE WHEN word_chars >= {quality.GUARD_CHARS} THEN {_distance('cc', _shares('chars'))} END AS char_distance,
         CASE WHEN len(tokens) >= {quality.GUARD_WORDS} THEN {_distance('cw', _shares('words'))} END AS word_distance,
         n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM h2)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(char_distance > {quality.CHARS_BASE} + {quality.CHARS_SPREAD} / sqrt(word_chars), false)
       AND NOT coalesce(word_distance > {quality.WORDS_BASE} + {quality.WORDS_SPREAD} / sqrt(len(tokens)), false) AS kept
FROM d
"""
