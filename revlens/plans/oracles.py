"""For each query with an exact answer, standard SQL over the given tables that
computes it another way: plain windows, whole groups, no staging."""

from __future__ import annotations

from revlens.plans import fixtures as FX
from revlens.settings import (
    BAD_TEXTS,
    BLANK_TEXT_MESSAGE,
    SPACE_CHARS,
    STOPWORDS,
    TOKEN_PATTERN,
    TfidfOptions,
)


def _quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "(" + ", ".join(map(_quote, values)) + ")"


def _clean(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), {_quote(f'[{SPACE_CHARS}]+')}, ' ', 'g'))"


def _label(x: str) -> str:
    c = _clean(x)
    return (
        f"CASE lower({c}) WHEN 'positif' THEN 'Positif' WHEN 'negatif' THEN 'Negatif'"
        f" WHEN 'netral' THEN 'Netral' ELSE {c} END"
    )


def _tokens(x: str, min_len: int = 2, stop: tuple[str, ...] = ()) -> str:
    words = (
        f"list_transform(regexp_extract_all({x}, {_quote(TOKEN_PATTERN)}), lambda w: lower(w))"
    )
    test = f"length(w) >= {min_len}" + (f" AND w NOT IN {_list(stop)}" if stop else "")
    return f"list_filter({words}, lambda w: {test})"


def _pairs(t: str) -> str:
    return (
        f"list_transform(range(1, len({t})::BIGINT), lambda k: list_extract({t}, k) || ' '"
        f" || list_extract({t}, k + 1))"
    )


def _title(code: str) -> str:
    return f"CASE {code} WHEN 0 THEN 'Negatif' WHEN 1 THEN 'Positif' END"


def _meaningful(term: str, stop: tuple[str, ...]) -> str:
    return (
        f"len(list_filter(string_split({term}, ' '), lambda w: length(w) >= 3"
        f" AND w NOT IN {_list(stop)})) > 0"
    )


RAW = """raw AS (
  SELECT d.doc_id AS row_id,
    CASE WHEN l.quality = 1 THEN ' POSITIF' WHEN l.quality = 0 THEN 'Negatif'
         WHEN d.doc_id % 3 = 0 THEN 'Netral' WHEN d.doc_id % 3 = 1 THEN 'campuran'
         ELSE 'negatif ' END AS sentimen,
    d.source AS kategori,
    CAST(1 + d.doc_id % 5 AS VARCHAR) AS stars,
    CASE WHEN d.doc_id % 4 = 0 THEN NULL WHEN d.doc_id % 4 = 1 THEN '   ' ELSE d.text END
      AS perbaikan,
    CASE WHEN d.doc_id % 8 IN (0, 1) THEN NULL ELSE d.text END AS textTranslated,
    CASE WHEN d.doc_id % 40 = 0 THEN ' N/A ' ELSE d.text END AS text
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

PICKED = f"""picked AS (
  SELECT row_id, {_label('sentimen')} AS label_name, kategori, stars,
    CASE WHEN {_clean('perbaikan')} <> '' THEN 'perbaikan'
         WHEN {_clean('textTranslated')} <> '' THEN 'textTranslated' ELSE 'text' END
      AS source_column,
    coalesce(nullif({_clean('perbaikan')}, ''), nullif({_clean('textTranslated')}, ''),
             {_clean('text')}) AS clean
  FROM raw)"""

TAGGED = f"""tagged0 AS (
  SELECT *,
    CASE WHEN label_name = 'Netral' THEN 'netral'
         WHEN label_name NOT IN ('Negatif', 'Positif') THEN 'other_label'
         WHEN lower(clean) IN {_list(BAD_TEXTS)} THEN 'bad_text' END AS reason0,
    array_to_string({_tokens('clean', 1)}, ' ') AS key
  FROM picked),
tagged AS (
  SELECT *, CASE WHEN reason0 IS NULL AND row_id >
      min(row_id) OVER (PARTITION BY key, reason0 IS NULL) THEN 'duplicate' ELSE reason0 END
    AS drop_reason
  FROM tagged0)"""

_PREP_COLUMNS = f"""row_id, clean AS text,
  CASE label_name WHEN 'Negatif' THEN 0 WHEN 'Positif' THEN 1 END::INTEGER AS label, label_name,
  {_clean('kategori')} AS kategori, {_clean('stars')} AS stars, source_column"""

PREP = f"prep AS (SELECT {_PREP_COLUMNS} FROM tagged WHERE drop_reason IS NULL)"

TERMS = f"""toks AS (SELECT row_id, label, {_tokens('text')} AS t FROM prep),
terms AS (SELECT row_id, label, unnest(list_concat(t, {_pairs('t')})) AS term FROM toks)"""

STATS = """counted AS (SELECT row_id, term, count(*) AS tf FROM terms GROUP BY ALL),
stats AS (SELECT term, sum(tf)::BIGINT AS tf, count(*) AS df FROM counted GROUP BY term)"""

_T = TfidfOptions()
VOCAB = f"""best AS (SELECT * FROM stats WHERE df >= {_T.min_df}
  ORDER BY tf DESC, term LIMIT {_T.max_features}),
vocab AS (SELECT term, tf, df, (row_number() OVER (ORDER BY term) - 1)::INTEGER AS idx,
  ln((1 + (SELECT count(*) FROM prep))::DOUBLE / (1 + df)) + 1 AS idf FROM best)"""

_FIRST = "min(row_id) OVER (PARTITION BY label)"
_HASH = f"md5('{FX.SEED}:' || row_id)"
FOLDS = f"""firsts AS (SELECT row_id, label, {_FIRST} AS first, {_HASH} AS h FROM prep),
folds AS (SELECT row_id, label,
  ((row_number() OVER (ORDER BY first, h, row_id) - 1) % {FX.FOLDS} + 1)::INTEGER AS fold
  FROM firsts)"""

_CANDIDATES = ", ".join(f"({i}, '{f}', '{m}')" for i, f, m in FX.CANDIDATES)
SCORED = f"""cands(candidate_id, feature, model) AS (VALUES {_CANDIDATES}),
valued AS (SELECT *,
    CAST((row_id * 37 + candidate_id * 11) % 101 + 25 * label AS DOUBLE) / 126 AS value
  FROM folds CROSS JOIN cands WHERE candidate_id <> 4 OR label = 1),
scored AS (SELECT row_id, label, fold, candidate_id, feature, model,
    CASE WHEN candidate_id <> 3 THEN value END AS score,
    CASE WHEN value >= 0.5 AND candidate_id <> 5 THEN 1 ELSE 0 END::INTEGER AS prediction
  FROM valued)"""

_TAGGED = (RAW, PICKED, TAGGED)
_PREP = (*_TAGGED, PREP)
_VOCAB = (*_PREP, TERMS, STATS, VOCAB)
_SCORED = (*_PREP, FOLDS, SCORED)


def _cells(keys: str, source: str = "scored") -> str:
    return f"""cells AS (SELECT {keys},
      count(*) FILTER (label = 0 AND prediction = 0) AS tn,
      count(*) FILTER (label = 0 AND prediction = 1) AS fp,
      count(*) FILTER (label = 1 AND prediction = 0) AS fn,
      count(*) FILTER (label = 1 AND prediction = 1) AS tp,
      count(*) FILTER (score IS NULL) AS gaps
    FROM {source} GROUP BY ALL)"""


def _rate(part: str, whole: str) -> str:
    return f"coalesce(({part})::DOUBLE / nullif({whole}, 0), 0)"


_RATES = {
    "accuracy": _rate("tn + tp", "tn + fp + fn + tp"),
    "precision": _rate("tp", "tp + fp"),
    "recall": _rate("tp", "tp + fn"),
    "f1": _rate("2 * tp", "2 * tp + fp + fn"),
}
_ROUNDED_RATES = ", ".join(f"round({v}, 6) AS {k}" for k, v in _RATES.items())


def _levels() -> str:
    """Rows once per fold and once for all folds (fold 0)."""
    return """levels AS (
      SELECT row_id, label, candidate_id, feature, model, fold, score, prediction FROM scored
      UNION ALL
      SELECT row_id, label, candidate_id, feature, model, 0, score, prediction FROM scored)"""


def _area(keys: str, source: str) -> str:
    """Rank-sum form of the AUC, with average ranks for ties."""
    return f"""ranked AS (SELECT {keys}, label,
        rank() OVER (PARTITION BY {keys} ORDER BY score)
          + (count(*) OVER (PARTITION BY {keys}, score) - 1) / 2.0 AS r
      FROM {source} WHERE score IS NOT NULL),
    area AS (SELECT {keys},
        (sum(r) FILTER (label = 1) - count(*) FILTER (label = 1)::DOUBLE
            * (count(*) FILTER (label = 1) + 1) / 2)
          / nullif(count(*) FILTER (label = 1)::DOUBLE * count(*) FILTER (label = 0), 0)
          AS roc_auc
      FROM ranked GROUP BY ALL)"""


_KEYS = "candidate_id, feature, model"
METRICS = (
    *_SCORED,
    _levels(),
    _cells(f"{_KEYS}, fold", "levels"),
    _area("candidate_id, fold", "levels"),
    f"""metrics AS (SELECT {_KEYS}, nullif(fold, 0)::INTEGER AS fold, tn + fp + fn + tp AS n,
      {', '.join(f'{v} AS {k}' for k, v in _RATES.items())},
      CASE WHEN gaps = 0 THEN roc_auc END AS roc_auc
    FROM cells LEFT JOIN area USING (candidate_id, fold))""",
    f"""results AS (SELECT {_KEYS}, {FX.FOLDS}::INTEGER AS folds, n, accuracy, precision, recall,
      f1, roc_auc, row_number() OVER (ORDER BY f1 DESC NULLS LAST, roc_auc DESC NULLS LAST,
        accuracy DESC NULLS LAST, candidate_id)::INTEGER AS rank
    FROM metrics WHERE fold IS NULL)""",
)
_ROUNDED = ", ".join(
    f"round({m}, 6) AS {m}" for m in ("accuracy", "precision", "recall", "f1", "roc_auc")
)

QUOTAS = """classes AS (SELECT label, count(*) AS n, sum(count(*)) OVER ()::BIGINT AS total
  FROM prep GROUP BY label),
kept AS (SELECT *, total - ceil(0.10::DOUBLE * total)::BIGINT AS n_kept FROM classes),
kept_floor AS (SELECT *, (n_kept * n) // total AS fl, (n_kept * n) % total AS re FROM kept),
kept_quota AS (SELECT *, (fl + CASE WHEN row_number() OVER (ORDER BY re DESC, label)
    <= n_kept - sum(fl) OVER () THEN 1 ELSE 0 END)::BIGINT AS rest_n FROM kept_floor),
train AS (SELECT label, n, n_kept, rest_n,
  n_kept - ceil(0.111111::DOUBLE * n_kept)::BIGINT AS n_train FROM kept_quota),
train_floor AS (SELECT *, (n_train * rest_n) // n_kept AS fl, (n_train * rest_n) % n_kept AS re
  FROM train),
quotas AS (SELECT label, n - rest_n AS test_n, rest_n - (fl + CASE WHEN row_number()
    OVER (ORDER BY re DESC, label) <= n_train - sum(fl) OVER () THEN 1 ELSE 0 END)::BIGINT
    AS valid_n FROM train_floor)"""

HOLDOUT = f"""ranked AS (SELECT row_id, label,
  row_number() OVER (PARTITION BY label ORDER BY {_HASH}, row_id) AS r FROM prep),
held AS (SELECT row_id, ranked.label, CASE WHEN r <= test_n THEN 'test'
    WHEN r <= test_n + valid_n THEN 'valid' ELSE 'train' END AS split
  FROM ranked JOIN quotas USING (label))"""

ROC = (
    *_SCORED,
    """usable AS (SELECT candidate_id, label, score FROM scored WHERE candidate_id IN (
      SELECT candidate_id FROM scored GROUP BY candidate_id
      HAVING count(*) FILTER (score IS NULL) = 0 AND count(DISTINCT label) = 2)),
    steps AS (SELECT candidate_id, score, count(*) FILTER (label = 1) AS pos,
        count(*) FILTER (label = 0) AS neg FROM usable GROUP BY ALL),
    curve AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
        sum(pos) OVER (PARTITION BY candidate_id) AS p,
        sum(neg) OVER (PARTITION BY candidate_id) AS m,
        row_number() OVER w AS nr, lead(pos) OVER w AS next_pos, lead(neg) OVER w AS next_neg
      FROM steps WINDOW w AS (PARTITION BY candidate_id ORDER BY score DESC))""",
)


def _points(where: str) -> str:
    return f"""SELECT candidate_id, round(score, 6) AS threshold,
        round(fp::DOUBLE / m, 6) AS fpr, round(tp::DOUBLE / p, 6) AS tpr FROM curve WHERE {where}
      UNION ALL
      SELECT DISTINCT candidate_id, 'Infinity'::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM curve"""


def _class_rates(code: int) -> tuple[str, str, str, str]:
    if code:
        return _RATES["precision"], _RATES["recall"], _RATES["f1"], "(tp + fn)"
    return (
        _rate("tn", "tn + fn"),
        _rate("tn", "tn + fp"),
        _rate("2 * tn", "2 * tn + fp + fn"),
        "(tn + fp)",
    )


def _report() -> str:
    (p0, r0, f0, s0), (p1, r1, f1, s1) = _class_rates(0), _class_rates(1)

    def row(name: str, p: str, r: str, f: str, s: str) -> str:
        return (
            f"SELECT candidate_id, '{name}' AS class, round({p}, 6) AS precision,"
            f" round({r}, 6) AS recall, round({f}, 6) AS f1_score, ({s})::DOUBLE AS support"
            " FROM cells"
        )

    def macro(a: str, b: str) -> str:
        return f"({a} + {b}) / 2"

    def weighted(a: str, b: str) -> str:
        return f"({a} * {s0} + {b} * {s1}) / ({s0} + {s1})"

    total = f"{s0} + {s1}"
    return " UNION ALL ".join(
        (
            row("Negatif", p0, r0, f0, s0),
            row("Positif", p1, r1, f1, s1),
            row("accuracy", "NULL::DOUBLE", "NULL::DOUBLE", _RATES["accuracy"], total),
            row("macro avg", macro(p0, p1), macro(r0, r1), macro(f0, f1), total),
            row("weighted avg", weighted(p0, p1), weighted(r0, r1), weighted(f0, f1), total),
        )
    )


REPORT = (*_SCORED, _cells("candidate_id"), f"report AS ({_report()})")


def _section(name: str) -> str:
    pick = lambda c: f"max({c}) FILTER (class = '{name}')"
    return (
        f"'{name}', json_object('precision', {pick('precision')}, 'recall', {pick('recall')},"
        f" 'f1-score', {pick('f1_score')}, 'support', {pick('support')})"
    )


WORDS = f"""words AS (SELECT label, row_id, {_tokens('text', 3, FX.STOPWORDS)} AS t FROM prep),
uni AS (SELECT label, term, count(*) AS n FROM (SELECT label, unnest(t) AS term FROM words)
  GROUP BY ALL)"""

PAIRS = f"""pairs AS (SELECT label, string_split(pair, ' ')[1] AS first,
    string_split(pair, ' ')[2] AS second, count(*) AS n
  FROM (SELECT label, unnest({_pairs('t')}) AS pair FROM words) GROUP BY ALL),
sized AS (SELECT p.*, a.n::DOUBLE AS c1, b.n::DOUBLE AS c2, p.n::DOUBLE AS c12,
    sum(t.total)::DOUBLE AS big
  FROM pairs p JOIN uni a ON a.label = p.label AND a.term = p.first
  JOIN uni b ON b.label = p.label AND b.term = p.second
  JOIN (SELECT label, sum(n) AS total FROM uni GROUP BY label) t ON t.label = p.label
  GROUP BY ALL),
rates AS (SELECT *, c2 / big AS q, c12 / c1 AS q1, (c2 - c12) / (big - c1) AS q2 FROM sized),
logs AS (SELECT *,
    ln(greatest(q, 1e-10)) AS l, ln(greatest(1 - q, 1e-10)) AS m,
    ln(greatest(q1, 1e-10)) AS l1, ln(greatest(1 - q1, 1e-10)) AS m1,
    ln(greatest(q2, 1e-10)) AS l2, ln(greatest(1 - q2, 1e-10)) AS m2 FROM rates),
colls AS (SELECT label, first, second, n, CASE WHEN big <= c1 OR big <= c2 THEN 0 ELSE -2 * (
      (l * c12 + m * (c1 - c12)) + (l * (c2 - c12) + m * (big - c1 - (c2 - c12)))
      - (l1 * c12 + m1 * (c1 - c12)) - (l2 * (c2 - c12) + m2 * (big - c1 - (c2 - c12)))
    ) END AS score FROM logs)"""

CLOUD = """strong AS (SELECT * FROM colls WHERE score > 30),
left_over AS (SELECT label, term, sum(n)::BIGINT AS n FROM (
    SELECT label, term, n FROM uni
    UNION ALL SELECT label, first, -n FROM strong
    UNION ALL SELECT label, second, -n FROM strong
    UNION ALL SELECT label, first || ' ' || second, n FROM strong) GROUP BY ALL HAVING sum(n) > 0)"""


def _top120(source: str) -> str:
    return f"""SELECT label, term, n, round(n::DOUBLE / max(n) OVER (PARTITION BY label), 6)
        AS relative FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, term)
        AS r FROM {source}) WHERE r <= 120"""


CLASS_WEIGHTS = f"""weighted AS (SELECT term, (p - n)::DOUBLE / (p + n + 5) AS weight FROM (
    SELECT term, count(DISTINCT row_id) FILTER (label = 1) AS p,
      count(DISTINCT row_id) FILTER (label = 0) AS n FROM terms GROUP BY term) WHERE p + n >= 2),
meaning AS (SELECT * FROM weighted WHERE {_meaningful('term', FX.STOPWORDS)}),
top AS ((SELECT term, weight, 'Positif' AS label_name FROM meaning
    ORDER BY weight DESC, term LIMIT 60)
  UNION ALL (SELECT term, weight, 'Negatif' FROM meaning ORDER BY weight, term LIMIT 60))"""

LOGITS = """logits AS (SELECT candidate_id, row_id, score * 4 - 2 AS a, 1 - score AS b
  FROM scored WHERE score IS NOT NULL)"""

RUNS = f"""runs AS (SELECT feature || '/' || model AS model_id,
    regexp_replace(feature || '/' || model, '[^a-zA-Z0-9_.-]+', '__', 'g') AS slug, {_ROUNDED}
  FROM results)"""

_METRIC_NAMES = ("accuracy", "precision", "recall", "f1", "roc_auc")
_METRIC_PAIRS = ", ".join(f"'{m}', {m}" for m in _METRIC_NAMES)


def _with(parts: tuple[str, ...], select: str) -> str:
    return f"WITH {', '.join(parts)} {select}"


def _weights(source: str) -> str:
    return f"""hits AS (SELECT row_id, term, count(*) AS tf, any_value(idf) AS idf
      FROM {source} JOIN vocab USING (term) GROUP BY row_id, term),
    raws AS (SELECT row_id, term, tf, (1 + ln(tf)) * idf AS w FROM hits)"""


_SELECT_WEIGHTS = """SELECT row_id, term, tf,
    round(w / sqrt(sum(w * w) OVER (PARTITION BY row_id)), 6) AS weight FROM raws"""


def sql() -> dict[str, str]:
    n_bad = lambda reason: f"count(*) FILTER (drop_reason = '{reason}')"
    summary = f"""count(*) AS original_rows, {n_bad('netral')} AS dropped_netral,
      {n_bad('other_label')} AS dropped_other_label, {n_bad('bad_text')} AS dropped_bad_text"""
    kept = "drop_reason IS NULL"
    usable = "reason0 IS NULL"
    out: dict[str, str] = {}

    # Text
    out["normalize_text"] = _with(
        (RAW,),
        f"SELECT row_id, {_clean('perbaikan')} AS perbaikan,"
        f" {_clean('chr(9) || text || chr(32) || chr(10)')} AS text FROM raw",
    )
    out["normalize_label"] = _with(
        (RAW,), f"SELECT row_id, {_label('sentimen')} AS label_name FROM raw"
    )
    for name, stop in (("tokenize", ()), ("stopword_filter", FX.STOPWORDS)):
        out[name] = f"""SELECT doc_id, array_to_string(t, ' ') AS tokens, len(t)::BIGINT AS n
          FROM (SELECT doc_id, {_tokens('text', 2, stop)} AS t FROM documents)"""
    out["dedupe_key"] = f"""SELECT doc_id, array_to_string({_tokens('text', 1)}, ' ') AS key
      FROM documents"""
    out["bigrams"] = f"""SELECT doc_id, array_to_string(list_concat(t, {_pairs('t')}), '|')
        AS terms, (len(t) + greatest(len(t) - 1, 0))::BIGINT AS n
      FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents)"""
    out["bad_text"] = _with(
        (RAW,),
        f"SELECT row_id, (lower({_clean('text')}) IN {_list(BAD_TEXTS)})::INTEGER AS bad FROM raw",
    )
    code = "CASE label_name WHEN 'Negatif' THEN 0 WHEN 'Positif' THEN 1 END"
    out["label_codes"] = _with(
        (RAW, f"named AS (SELECT row_id, {_label('sentimen')} AS label_name FROM raw)"),
        f"SELECT row_id, label_name, coalesce({code}, -1)::INTEGER AS label,"
        f" {_title(code)} AS decoded FROM named",
    )
    out["stopword_hits"] = f"""SELECT term, count(*) AS n FROM (
        SELECT unnest({_tokens('text')}) AS term FROM documents)
      WHERE term IN {_list(STOPWORDS)} GROUP BY term"""
    out["slug"] = """SELECT doc_id, regexp_replace(source || '/' || lang || ' #' || doc_id,
        '[^a-zA-Z0-9_.-]+', '__', 'g') AS slug FROM documents"""

    # Preparation
    out["text_fallback"] = _with(
        (RAW, PICKED), "SELECT row_id, source_column, clean AS text FROM picked"
    )
    out["drop_reason"] = _with(_TAGGED, "SELECT row_id, drop_reason FROM tagged")
    out["prep_rows"] = _with(_TAGGED, f"SELECT {_PREP_COLUMNS} FROM tagged WHERE {kept}")
    out["prep_keep_duplicates"] = _with(
        _TAGGED, f"SELECT {_PREP_COLUMNS} FROM tagged WHERE {usable}"
    )
    out["prep_summary"] = _with(
        _TAGGED,
        f"""SELECT {summary}, {n_bad('duplicate')} AS dropped_duplicates,
          count(*) FILTER ({kept}) AS kept_rows,
          count(*) FILTER ({kept} AND label_name = 'Negatif') AS negatif,
          count(*) FILTER ({kept} AND label_name = 'Positif') AS positif FROM tagged""",
    )
    out["prep_summary_keep_duplicates"] = _with(
        _TAGGED,
        f"""SELECT {summary}, 0::BIGINT AS dropped_duplicates,
          count(*) FILTER ({usable}) AS kept_rows,
          count(*) FILTER ({usable} AND label_name = 'Negatif') AS negatif,
          count(*) FILTER ({usable} AND label_name = 'Positif') AS positif FROM tagged""",
    )
    out["summary_json"] = _with(
        (*_TAGGED, f"s AS ({_select_only(out['prep_summary'])})"),
        """SELECT json_object('input_file', 'reviews_raw', 'output_file', 'prepared',
          'original_rows', original_rows, 'dropped_netral', dropped_netral,
          'dropped_other_label', dropped_other_label, 'dropped_bad_text', dropped_bad_text,
          'dropped_duplicates', dropped_duplicates, 'kept_rows', kept_rows,
          'labels', json_object('Negatif', negatif, 'Positif', positif))::VARCHAR AS value FROM s""",
    )
    out["label_counts"] = _with(
        _PREP, "SELECT label_name, count(*) AS n FROM prep GROUP BY label_name"
    )
    out["class_texts"] = _with(_PREP, "SELECT row_id, text, label FROM prep")
    out["csv_round_trip"] = _with(_PREP, "SELECT * FROM prep")
    out["known_labels"] = _with(
        (RAW,),
        f"""SELECT row_id, {_clean('perbaikan')} AS text,
            (CASE WHEN sentimen LIKE '%POS%' THEN 1 ELSE 0 END)::INTEGER AS label,
            {_label('sentimen')} AS label_name FROM raw
          WHERE {_clean('perbaikan')} <> '' AND {_label('sentimen')} IN ('Negatif', 'Positif')""",
    )
    out["stream_prepared"] = f"""SELECT doc_id AS row_id, {_clean('text')} AS text,
        (CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END)::INTEGER AS label, 'text' AS source_column
      FROM documents WHERE lower({_clean('text')}) NOT IN {_list(BAD_TEXTS)}"""

    # TF-IDF
    out["term_stats"] = _with((*_PREP, TERMS, STATS), "SELECT term, tf, df FROM stats")
    out["vocab"] = _with(_VOCAB, "SELECT term, tf, df, idx FROM vocab")
    out["idf"] = _with(_VOCAB, "SELECT term, round(idf, 6) AS idf FROM vocab")
    out["tfidf_weights"] = _with((*_VOCAB, _weights("terms")), _SELECT_WEIGHTS)
    out["tfidf_vectors"] = out["tfidf_weights"]
    out["tfidf_unseen"] = _with(
        (
            *_VOCAB,
            f"""other AS (SELECT row_id, unnest(list_concat(t, {_pairs('t')})) AS term FROM (
              SELECT item_id AS row_id, {_tokens('text')} AS t FROM benchmark))""",
            _weights("other"),
        ),
        _SELECT_WEIGHTS,
    )
    out["meaningful_terms"] = _with(
        (*_PREP, TERMS, STATS),
        f"SELECT term, df FROM stats WHERE df >= 2 AND {_meaningful('term', FX.STOPWORDS)}",
    )

    # Splits
    with_folds = (*_PREP, FOLDS)
    out["folds"] = _with(with_folds, "SELECT row_id, label, fold FROM folds")
    out["fold_sizes"] = _with(
        with_folds, "SELECT fold, label, count(*) AS n FROM folds GROUP BY ALL"
    )
    out["fold_train_rows"] = _with(
        (*with_folds, f"ks AS (SELECT unnest(range(1, {FX.FOLDS + 1}))::INTEGER AS of_fold)"),
        """SELECT of_fold, CASE WHEN fold = of_fold THEN 'valid' ELSE 'train' END AS side, row_id
          FROM folds, ks""",
    )
    out["cv_coverage"] = _with(
        with_folds,
        """SELECT row_id, fold, label, 2::BIGINT AS candidates, 2::BIGINT AS scored,
          2::BIGINT AS consistent FROM folds""",
    )
    outside = f"""ks AS (SELECT unnest(range(1, {FX.FOLDS + 1}))::INTEGER AS fold),
    per AS (SELECT fold, term, count(*) AS tf, count(DISTINCT row_id) AS df
      FROM terms JOIN folds USING (row_id) GROUP BY ALL),
    fstats AS (SELECT k.fold, term, sum(tf)::BIGINT AS tf, sum(df)::BIGINT AS df
      FROM per JOIN ks k ON per.fold <> k.fold GROUP BY ALL HAVING sum(df) >= 2)"""
    fold_parts = (*_PREP, TERMS, FOLDS, outside)
    out["fold_term_stats"] = _with(fold_parts, "SELECT fold, term, tf, df FROM fstats")
    out["fold_vocabularies"] = _with(
        (
            *fold_parts,
            """sizes AS (SELECT k.fold, count(*) AS n FROM folds f JOIN ks k ON f.fold <> k.fold
              GROUP BY k.fold),
            ranked AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY tf DESC, term) AS r
              FROM fstats)""",
        ),
        f"""SELECT fold, term, tf, df, round(ln((1 + n)::DOUBLE / (1 + df)) + 1, 6) AS idf
          FROM ranked JOIN sizes USING (fold) WHERE r <= {_T.max_features}""",
    )
    held = (*_PREP, QUOTAS, HOLDOUT)
    out["holdout"] = _with(held, "SELECT row_id, label, split FROM held")
    out["split_counts"] = _with(
        held, "SELECT split, label, count(*) AS n FROM held GROUP BY ALL"
    )
    out["class_weights"] = _with(
        _PREP,
        """SELECT label, n, round(sum(n) OVER () / (count(*) OVER () * n)::DOUBLE, 6) AS weight
          FROM (SELECT label, count(*) AS n FROM prep GROUP BY label)""",
    )

    # Evaluation
    cells = (*_SCORED, _cells(_KEYS))
    out["confusion"] = _with(
        cells,
        " UNION ALL ".join(
            f"SELECT {_KEYS}, {y}::INTEGER AS label, {p}::INTEGER AS prediction, {c} AS n FROM cells"
            for y, p, c in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))
        ),
    )
    out["binary_metrics"] = _with(cells, f"SELECT {_KEYS}, {_ROUNDED_RATES} FROM cells")
    out["roc_auc"] = _with(
        METRICS, f"SELECT {_KEYS}, n, round(roc_auc, 6) AS roc_auc FROM metrics WHERE fold IS NULL"
    )
    out["roc_points"] = _with(ROC, _points("true"))
    out["roc_chart"] = _with(
        ROC, _points("nr = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg")
    )
    out["class_report"] = _with(REPORT, "SELECT * FROM report")
    out["report_json"] = _with(
        REPORT,
        f"""SELECT candidate_id, json_object({_section('Negatif')}, {_section('Positif')},
          'accuracy', max(f1_score) FILTER (class = 'accuracy'), {_section('macro avg')},
          {_section('weighted avg')})::VARCHAR AS report FROM report GROUP BY candidate_id""",
    )
    out["metrics_by_fold"] = _with(
        METRICS, f"SELECT {_KEYS}, coalesce(fold, 0)::INTEGER AS fold, n, {_ROUNDED} FROM metrics"
    )
    out["rank_candidates"] = _with(
        METRICS, f"SELECT {_KEYS}, folds, n, rank, {_ROUNDED} FROM results"
    )
    out["best_candidate"] = _with(
        METRICS, f"SELECT {_KEYS}, folds, n, {_ROUNDED} FROM results WHERE rank = 1"
    )
    out["best_metadata"] = _with(
        (*METRICS, f"b AS (SELECT {_KEYS}, folds, n, {_ROUNDED} FROM results WHERE rank = 1)"),
        f"""SELECT json_object('candidate_id', candidate_id, 'feature', feature, 'model', model,
          'folds', folds, 'n', n, {_METRIC_PAIRS})::VARCHAR AS value FROM b""",
    )
    out["stacked_folds"] = _with(
        METRICS,
        f"SELECT {_KEYS}, fold, n AS n_valid, {_ROUNDED} FROM metrics WHERE fold IS NOT NULL",
    )
    out["oof_predictions"] = _with(
        _SCORED,
        f"""SELECT candidate_id, fold, row_id, text, s.label, {_title('s.label')} AS label_name,
            prediction, {_title('prediction')} AS prediction_name, round(score, 6) AS score
          FROM scored s JOIN prep USING (row_id)""",
    )
    x = "CASE WHEN fold % 3 <> 0 THEN fold ELSE fold * 10 END::DOUBLE AS x"
    per_fold = "FROM metrics WHERE fold IS NOT NULL"
    out["history_series"] = _with(
        METRICS,
        f"""SELECT candidate_id, 'train' AS series, {x}, round(1 - accuracy, 6) AS y
            {per_fold} AND fold % 4 <> 0
          UNION ALL SELECT candidate_id, 'eval', {x}, round(1 - f1, 6) {per_fold}
            AND fold % 5 <> 0""",
    )
    runs = (*METRICS, RUNS)
    out["run_log"] = _with(
        runs,
        f"""SELECT json_object(
            'results', (SELECT to_json(list(json_object('model_id', model_id, 'slug', slug,
               'test_metrics', json_object({_METRIC_PAIRS})) ORDER BY model_id))
               FROM runs WHERE roc_auc IS NOT NULL),
            'failures', (SELECT to_json(list(json_object('model_id', model_id,
               'error', 'no score') ORDER BY model_id)) FROM runs WHERE roc_auc IS NULL)
          )::VARCHAR AS value""",
    )
    tests = ", ".join(f"{m} AS test_{m}" for m in _METRIC_NAMES)
    out["flatten_runs"] = _with(
        runs, f"SELECT model_id, slug, {tests} FROM runs WHERE roc_auc IS NOT NULL"
    )
    out["rank_runs"] = _with(
        runs,
        f"""SELECT model_id, slug, {tests}, row_number() OVER (ORDER BY f1 DESC NULLS LAST,
            roc_auc DESC NULLS LAST, accuracy DESC NULLS LAST, model_id)::INTEGER AS rank
          FROM runs WHERE roc_auc IS NOT NULL""",
    )
    external = (
        *_SCORED,
        QUOTAS,
        HOLDOUT,
        """ext AS (SELECT feature || '/' || model AS model_id, split, row_id, label, score,
            CASE WHEN a >= b THEN 0 ELSE 1 END AS prediction
          FROM (SELECT feature, model, split, s.row_id, s.label, s.score * 4 - 2 AS a,
              1 - s.score AS b, exp(1 - s.score) / (exp(s.score * 4 - 2) + exp(1 - s.score)) AS score
            FROM scored s JOIN held USING (row_id)
            WHERE s.score IS NOT NULL AND split <> 'train') logits)""",
        """need AS (SELECT count(*) FILTER (split = 'train') AS train_rows,
            count(*) FILTER (split = 'valid') AS valid_rows,
            count(*) FILTER (split = 'test') AS test_rows FROM held)""",
        """status AS (SELECT model_id, coalesce(n, 0) AS n, need.*, coalesce(n, 0) = valid_rows + test_rows AS whole
          FROM (SELECT feature || '/' || model AS model_id FROM cands) CROSS JOIN need
          LEFT JOIN (SELECT model_id, count(*) AS n FROM ext GROUP BY ALL) USING (model_id))""",
        _cells("model_id, split", "ext"),
        _area("model_id, split", "ext").replace("ranked", "ext_ranked"),
        f"""parts AS (SELECT model_id, split, {_ROUNDED_RATES}, round(roc_auc, 6) AS roc_auc
          FROM cells LEFT JOIN area USING (model_id, split))""",
        """done AS (SELECT model_id, regexp_replace(model_id, '[^a-zA-Z0-9_.-]+', '__', 'g') AS slug,
            train_rows, valid_rows, test_rows, """
        + ", ".join(f"{p[0]}.{m} AS {p}_{m}" for p in ("eval", "test") for m in _METRIC_NAMES)
        + """ FROM status JOIN parts e USING (model_id) JOIN parts t USING (model_id)
          WHERE whole AND e.split = 'valid' AND t.split = 'test')""",
    )
    out["external_run"] = _with(
        external,
        """SELECT *, row_number() OVER (ORDER BY test_f1 DESC NULLS LAST, test_roc_auc DESC NULLS LAST,
            test_accuracy DESC NULLS LAST, model_id)::INTEGER AS rank FROM done""",
    )
    pairs = {p: ", ".join(f"'{m}', {p}_{m}" for m in _METRIC_NAMES) for p in ("eval", "test")}
    parts = ", ".join(f"'{p}_metrics', json_object({pairs[p]})" for p in pairs)
    out["external_log"] = _with(
        external,
        f"""SELECT json_object(
            'results', (SELECT to_json(list(json_object('model_id', model_id, 'slug', slug,
               'train_rows', train_rows, 'valid_rows', valid_rows, 'test_rows', test_rows, {parts})
               ORDER BY model_id)) FROM done),
            'failures', (SELECT to_json(list(json_object('model_id', model_id, 'error',
               n || ' logits for ' || n || ' of ' || (valid_rows + test_rows) || ' rows')
               ORDER BY model_id)) FROM status WHERE NOT whole)
          )::VARCHAR AS value""",
    )

    # Insights
    totals = "(SELECT count(*) FROM prep WHERE label = {})::DOUBLE"
    keywords = f"""seen AS (SELECT DISTINCT row_id, label, term FROM (
              SELECT row_id, label, unnest({_tokens('text')}) AS term FROM prep)
              WHERE term IN {_list(FX.SEEDS)}),
            k AS (SELECT term, count(*) FILTER (label = 1) AS positif_docs,
              count(*) FILTER (label = 0) AS negatif_docs FROM seen GROUP BY term),
            r AS (SELECT *, positif_docs / {totals.format(1)} AS pr,
              negatif_docs / {totals.format(0)} AS nr FROM k)"""
    lift = "round((pr + 1e-9::DOUBLE) / (nr + 1e-9::DOUBLE), 6)"
    out["keyword_counts"] = _with(
        (*_PREP, keywords),
        f"""SELECT term, positif_docs, negatif_docs, round(pr, 6) AS positif_rate,
            round(nr, 6) AS negatif_rate,
            CASE WHEN pr >= nr THEN 'Positif' ELSE 'Negatif' END AS dominant_label,
            {lift} AS lift FROM r""",
    )
    out["seed_documents"] = _with(
        _PREP,
        f"""SELECT DISTINCT row_id, term FROM (
            SELECT row_id, unnest({_tokens('text')}) AS term FROM prep)
          WHERE term IN {_list(FX.SEEDS)}""",
    )
    out["word_counts"] = _with((*_PREP, WORDS), "SELECT label, term, n FROM uni")
    out["word_freq"] = _with((*_PREP, WORDS), _top120("uni"))
    out["collocations"] = _with(
        (*_PREP, WORDS, PAIRS),
        "SELECT label, first, second, n, round(score, 4) AS score FROM colls",
    )
    out["word_cloud"] = _with((*_PREP, WORDS, PAIRS, CLOUD), _top120("left_over"))
    weighted = (*_PREP, TERMS, CLASS_WEIGHTS)
    out["top_terms"] = _with(
        weighted, "SELECT term, round(weight, 6) AS weight, label_name FROM top"
    )
    out["top_terms_signed"] = _with(
        weighted,
        """SELECT label_name, r::INTEGER AS rank, term, round(CASE label_name WHEN 'Positif'
            THEN abs(weight) ELSE -abs(weight) END, 6) AS signed_weight
          FROM (SELECT *, row_number() OVER (PARTITION BY label_name
            ORDER BY abs(weight) DESC, term) AS r FROM top) WHERE r <= 20""",
    )

    out["dashboard"] = _with(
        (*METRICS, TERMS, CLASS_WEIGHTS, keywords),
        f"""SELECT 'results' AS section, feature || '/' || model AS name, round(f1, 6) AS value
            FROM results
          UNION ALL SELECT 'top_words', term, round(weight, 6) FROM top
          UNION ALL SELECT 'keyword_counts', term, {lift} FROM r
          UNION ALL SELECT 'summary', label_name, count(*)::DOUBLE FROM prep GROUP BY label_name""",
    )

    # Scoring
    logits = (*_SCORED, LOGITS)
    out["softmax"] = _with(
        logits,
        """SELECT candidate_id, row_id, round(exp(a) / (exp(a) + exp(b)), 6) AS p_negatif,
            round(exp(b) / (exp(a) + exp(b)), 6) AS p_positif FROM logits""",
    )
    best = "CASE WHEN a >= b THEN 0 ELSE 1 END"
    out["argmax_label"] = _with(
        logits,
        f"""SELECT candidate_id, row_id, ({best})::INTEGER AS prediction,
            {_title(f'({best})')} AS label_name FROM logits""",
    )
    out["sigmoid"] = _with(
        logits,
        """SELECT candidate_id, row_id, round(1 / (1 + exp(-(a - b))), 6) AS p_positif
          FROM logits""",
    )
    out["score_fallback"] = _with(
        _SCORED,
        """SELECT candidate_id, row_id, round(coalesce(CASE row_id % 3 WHEN 0 THEN score
            WHEN 1 THEN 1 / (1 + exp(-(score * 4 - 2))) END, prediction::DOUBLE), 6)
            AS p_positif FROM scored""",
    )
    out["blank_scores"] = _with(
        (
            RAW,
            f"""b AS (SELECT row_id, {_clean('perbaikan')} AS t,
              ((row_id * 37) % 101)::DOUBLE / 100 AS s FROM raw),
            n AS (SELECT *, CASE WHEN s >= 0.5 THEN 'Positif' ELSE 'Negatif' END AS l FROM b)""",
        ),
        f"""SELECT row_id, round(CASE WHEN t = '' THEN 0 ELSE 1 - s END, 6) AS p_negatif,
            round(CASE WHEN t = '' THEN 0 ELSE s END, 6) AS p_positif,
            CASE WHEN t <> '' THEN l END AS label_name,
            CASE WHEN t = '' THEN '{BLANK_TEXT_MESSAGE}' ELSE l || ' - classical' END AS message
          FROM n""",
    )
    out["external_scores"] = f"""WITH c AS (SELECT conv_id, turn, {_clean('text')} AS t
        FROM conversations),
      l AS (SELECT conv_id, turn, t, len({_tokens('t')})::DOUBLE AS x, length(t)::DOUBLE AS y FROM c),
      g AS (SELECT *, x / (x + 10) AS a, y / (y + 60) AS b FROM l)
      SELECT conv_id, turn,
        round(CASE WHEN t = '' THEN 0 ELSE 1 - exp(b) / (exp(a) + exp(b)) END, 6) AS p_negatif,
        round(CASE WHEN t = '' THEN 0 ELSE exp(b) / (exp(a) + exp(b)) END, 6) AS p_positif,
        CASE WHEN t = '' THEN NULL WHEN a >= b THEN 'Negatif' ELSE 'Positif' END AS label_name
      FROM g"""
    return out


def _select_only(query: str) -> str:
    """The part of a ``_with`` query after its last common table."""
    return query[query.rindex(") SELECT ") + 2 :]
