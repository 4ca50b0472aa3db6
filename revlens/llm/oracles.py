"""DuckDB SQL of the operators that SQL can express on whole tables.

The others are held against brute-force versions in the tests: BPE and packing
against the tokenizers library, near-duplicates against all pairs, spans against
the plain expressions, and the two classifiers by held-out accuracy.
"""

from __future__ import annotations

from revlens.llm.quality import STOP_WORDS

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)

QUALITY = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), w AS (
  SELECT doc_id, p, list_slice(words, p, p + 7) AS eight
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS p FROM d WHERE len(words) >= 8)
), r AS (
  SELECT doc_id, count(DISTINCT place) AS n FROM (
    SELECT doc_id, unnest(range(p, p + 8)) AS place
    FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, eight) AS n FROM w)
    WHERE n > 1
  ) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g')) AS BIGINT) AS n_upper,
    CAST(length(text) - length(regexp_replace(text, '\|', '', 'g')) AS BIGINT) AS n_bars,
    CAST(len(list_filter(words, lambda x: lower(x) IN ({_STOPS}))) AS BIGINT) AS n_stop_words
  FROM d LEFT JOIN r ON d.doc_id = r.doc_id
), b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
)
SELECT *, NOT base_failed
    AND coalesce(word_chars / nullif(n_words, 0) BETWEEN 2 AND 40, true)
    AND coalesce(n_symbols / nullif(n_words, 0) <= 0.4, true)
    AND coalesce(n_dup_lines / nullif(n_lines, 0) <= 0.5, true)
    AND coalesce(n_upper / nullif(word_chars, 0) <= 0.5, true)
    AND coalesce(n_stop_words / nullif(n_words, 0) >= 0.02, true)
    AND coalesce(n_bars / nullif(n_words, 0) <= 0.25, true) AS kept
FROM b
"""

SUBSTRING = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS words FROM documents),
w AS (
  SELECT doc_id, p, sha256(array_to_string(list_slice(words, p, p + 34), ' ')) AS run
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS p FROM d WHERE len(words) >= 35)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS place
  FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY run) AS n FROM w) WHERE n > 1
), flat AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM d
), kept AS (
  SELECT f.doc_id, string_agg(f.word, ' ' ORDER BY f.place) AS text
  FROM flat f ANTI JOIN gone g ON f.doc_id = g.doc_id AND f.place = g.place GROUP BY f.doc_id
), n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
"""

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""

HARD_NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
         CAST(list_sum(list_transform(list_zip(a.x, c.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank,
       s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
  AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 3
"""

_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

LEXICAL_SEARCH = rf"""
WITH d AS (SELECT doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, CAST(len(terms) AS BIGINT) AS n FROM d WHERE len(terms) > 0),
c AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM n),
t AS (
  SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf
  FROM (SELECT doc_id, unnest(terms) AS term FROM d) GROUP BY ALL
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM t GROUP BY term), c
), q AS (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark),
s AS (
  SELECT item_id, t.doc_id,
    CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN t USING (term) JOIN w USING (term) JOIN n ON n.doc_id = t.doc_id, c GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER o AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id)
QUALIFY row_number() OVER o <= 20
"""

EXACT_DEDUP = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id,
       CAST(count(*) OVER (PARTITION BY text_sha256) AS BIGINT) AS group_size,
       doc_id = first_value(doc_id) OVER best AS kept, text_sha256
FROM d
WINDOW best AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)
"""


def sql() -> dict[str, str]:
    return {
        "op1_quality_rules": QUALITY,
        "op2_substring_dedup": SUBSTRING,
        "op10_top_k": TOP_K,
        "op11_hard_negatives": HARD_NEGATIVES,
        "op12_lexical_search": LEXICAL_SEARCH,
        "op13_exact_dedup": EXACT_DEDUP,
    }
