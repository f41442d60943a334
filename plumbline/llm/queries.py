"""The queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from plumbline.llm import quality, substring_dedup
from plumbline.llm._common import WORD_PATTERN
from plumbline.llm.bpe import op1_bpe
from plumbline.llm.html_extract import op2_html
from plumbline.llm.licenses import op10_licenses
from plumbline.llm.media import op7_media
from plumbline.llm.packing import op3_packing
from plumbline.llm.pii import op6_pii
from plumbline.llm.quality import op8_quality
from plumbline.llm.secret_scan import op9_secrets
from plumbline.llm.simhash import op5_simhash
from plumbline.llm.substring_dedup import op4_substring_dedup


def queries() -> dict:
    return {
        "op1_bpe": op1_bpe,
        "op2_html": op2_html,
        "op3_packing": op3_packing,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_simhash": op5_simhash,
        "op6_pii": op6_pii,
        "op7_media": op7_media,
        "op8_quality": op8_quality,
        "op9_secrets": op9_secrets,
        "op10_licenses": op10_licenses,
    }


def _substring_sql(length: int = substring_dedup.WINDOW) -> str:
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD_PATTERN}') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - {length - 2})) AS i FROM w WHERE len(ws) >= {length}),
g AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY array_to_string(ws[i:i + {length - 1}], ' ')) AS lo FROM p),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM g, range({length}) x(j) WHERE lo < doc_id),
each_ AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
kept AS (SELECT e.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM each_ e WHERE NOT EXISTS (SELECT 1 FROM gone x WHERE x.doc_id = e.doc_id AND x.i = e.i) GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""


def _quality_sql() -> str:
    k = quality.REPEAT_WINDOW
    count = lambda x, pattern: f"len(regexp_extract_all({x}, '{pattern}'))"
    closing = quality.CLOSING.replace("'", "''")
    stock = " OR ".join(f"contains(lower(x), '{p}')" for p in quality.BOILERPLATE)
    n = count("x", WORD_PATTERN)
    fails = f"""(instr('{closing}', right(rtrim(x), 1)) = 0 AND {n} < {quality.FRAGMENT_WORDS}) OR {count("x", quality.SEPARATORS)} > {n} * {quality.MOST_SEPARATORS}
    OR {count("x", quality.SYMBOLS)} > {n} * {quality.MOST_SYMBOLS} OR ({n} <= {quality.BOILERPLATE_WORDS} AND ({stock}))"""
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{WORD_PATTERN}') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD_PATTERN}')) AS ls FROM d),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - {k - 2})) AS i FROM w WHERE len(ws) >= {k}),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i:i + {k - 1}], ' ')) AS c FROM p),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM g, range({k}) x(j) WHERE c > 1 GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST({count("t", quality.SYMBOLS)} AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
  coalesce(list_sum(list_transform(list_filter(ls, lambda x: NOT ({fails})), lambda x: {n})), 0) AS stays FROM w LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND stays >= n_words * {quality.LEAST_KEPT} AS kept FROM f
"""


def oracle_sql() -> dict[str, str]:
    """The others need tokenizers, media bytes, seeded hashes or match positions, which SQL doesn't give."""
    return {"op4_substring_dedup": _substring_sql(), "op8_quality": _quality_sql()}
