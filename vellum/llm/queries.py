"""Named queries of the subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from vellum.llm import boilerplate, languages, leaks, lookalikes, privacy, scans, splitting, tokens

QUERIES = {
    "p1_found": splitting.p1_found,
    "p1_pieces": splitting.p1_pieces,
    "p2_found": scans.p2_found,
    "p2_texts": scans.p2_texts,
    "p3_found": lookalikes.p3_found,
    "p3_classes": lookalikes.p3_classes,
    "p3_texts": lookalikes.p3_texts,
    "p4_found": privacy.p4_found,
    "p4_texts": privacy.p4_texts,
    "p5_found": boilerplate.p5_found,
    "p5_articles": boilerplate.p5_articles,
    "p7_ids": tokens.p7_ids,
    "p8_found": leaks.p8_found,
    "p8_spans": leaks.p8_spans,
    "p8_clean": leaks.p8_clean,
    "p9_found": languages.p9_found,
    "p9_languages": languages.p9_languages,
}

SQL = {
    "p1_found": r"""
SELECT note_row_id, profile_id FROM notes, split_profiles
WHERE max_size < CASE size_unit WHEN 'chars' THEN length(content) WHEN 'bytes' THEN strlen(content)
  ELSE len(regexp_extract_all(content, '[^\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+')) END
""",
    "p8_found": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
e AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT doc_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d)),
eg AS (SELECT item_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM e))
SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g)
""",
}
