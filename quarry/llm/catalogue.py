"""The registered queries of this subpackage and, where SQL can express them, their DuckDB SQL.

Every query reads its whole table and returns its full result.
"""

from __future__ import annotations

from quarry.llm import (decontaminate, htmlcrf, langid, levels, linededup, packing, periodic, quality, secrets, sharding, simhash,
                        toxicity, whitening)
from quarry.llm.common import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_decontaminate(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op2_simhash(spark, sf_dir):
    return simhash.report(table(spark, sf_dir, "documents"))


@query
def op3_language_id(spark, sf_dir):
    return langid.report(table(spark, sf_dir, "documents"))


@query
def op4_html_crf(spark, sf_dir):
    return htmlcrf.report(table(spark, sf_dir, "pages"))


@query
def op5_line_dedup(spark, sf_dir):
    return linededup.report(table(spark, sf_dir, "documents"))


@query
def op6_best_fit_packing(spark, sf_dir):
    return packing.report(table(spark, sf_dir, "documents"))


@query
def op7_label_propagation(spark, sf_dir):
    return sharding.report(table(spark, sf_dir, "documents"))


@query
def op8_quality_cascade(spark, sf_dir):
    return quality.report(table(spark, sf_dir, "documents"))


@query
def op9_toxicity(spark, sf_dir):
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_secrets(spark, sf_dir):
    return secrets.report(table(spark, sf_dir, "documents"))


@query
def op11_sum_of_squares(spark, sf_dir):
    return levels.report(table(spark, sf_dir, "documents"))


@query
def op12_periodic_runs(spark, sf_dir):
    return periodic.report(table(spark, sf_dir, "documents"))


@query
def op13_whitening(spark, sf_dir):
    return whitening.report(table(spark, sf_dir, "embeddings"))


ORACLE["op1_decontaminate"] = r"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS rid,
                     regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k
        FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
occ AS (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS k
        FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT o.rid, o.i, o.n, win.item_id FROM occ o JOIN win USING (k, n)),
words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
ids AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS s
        FROM (SELECT DISTINCT rid, coalesce(CAST(item_id AS VARCHAR), 'null') AS id FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN words USING (rid) LEFT JOIN ids USING (rid)
"""

ORACLE["op8_quality_cascade"] = r"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text,
                     regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (
          SELECT rid, unnest(range(i, i + 8)) AS p FROM (
            SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM (
              SELECT rid, i, w[i:i + 7] AS k FROM (
                SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM docs WHERE len(w) >= 8)))
          WHERE c > 1) GROUP BY rid),
lines AS (SELECT rid, count(*) AS n, count(*) - count(DISTINCT line) AS dup
          FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM docs)
          WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
f AS (SELECT doc_id, w, CAST(len(w) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(lines.dup, 0) AS BIGINT) AS n_dup_lines, coalesce(lines.n, 0) AS n_lines,
             CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
             length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS n_capitals, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS n_letters,
             length(regexp_replace(text, '[^""" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in quality.UNSPACED) + r"""]', '', 'g')) AS n_unspaced,
             len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_runs
      FROM docs LEFT JOIN rep USING (rid) LEFT JOIN lines USING (rid)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 4 * n_symbols > n_words OR 2 * n_capitals > n_letters OR 10 * n_runs > 3 * n_words
            OR word_chars < 2 * n_words OR word_chars - n_unspaced > 40 * n_words OR 10 * n_dup_lines > 6 * n_lines) AS kept
FROM v
"""

ORACLE["op5_line_dedup"] = r"""
WITH lines AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln
               FROM documents),
full_lines AS (SELECT doc_id, ln, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line,
                      row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS pos FROM lines
               WHERE trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''),
win AS (SELECT a.doc_id, a.pos, a.line AS l1, b.line AS l2, c.line AS l3 FROM full_lines a
        JOIN full_lines b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 JOIN full_lines c ON a.doc_id = c.doc_id AND c.pos = a.pos + 2),
later AS (SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY l1, l2, l3 ORDER BY doc_id, pos) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, pos + j AS pos FROM later, (VALUES (0), (1), (2)) t(j)),
cut AS (SELECT f.doc_id, f.ln FROM full_lines f JOIN gone USING (doc_id, pos)),
rest AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY ln) AS text FROM lines ANTI JOIN cut USING (doc_id, ln) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_lines FROM full_lines GROUP BY doc_id),
r AS (SELECT doc_id, count(*) AS n_removed FROM cut GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(rest.text, '') END AS text
FROM documents d LEFT JOIN rest USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id)
"""
