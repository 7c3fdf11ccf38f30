"""Structural checks, one query per check with its SQL, and all of them together."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import masking as M
from folioscope.operators import metrics
from folioscope.operators import structure as S
from folioscope.plans.common import LINES, PAGES, block, doc_pages


def _lines(spark, sf_dir):
    return M.page_lines(doc_pages(spark, sf_dir)).repartition("page")


def structure_issues(spark, sf_dir):
    return S.issues(doc_pages(spark, sf_dir))


def structure_places(spark, sf_dir):
    return S.issues(doc_pages(spark, sf_dir)).select("check_id", "level", "page", "line")


def structure_by_check(spark, sf_dir):
    return S.issues(doc_pages(spark, sf_dir)).groupBy("check_id", "level").agg(F.count("*").alias("n"))


def headings(spark, sf_dir):
    return S.headings(_lines(spark, sf_dir))


def heading_skip(spark, sf_dir):
    return S.heading_skips(headings(spark, sf_dir)).select("page", "line")


def multiple_h1(spark, sf_dir):
    return S.multiple_h1(headings(spark, sf_dir)).select("page", "line")


def duplicate_heading(spark, sf_dir):
    return S.duplicate_headings(headings(spark, sf_dir)).select("page", "line")


def empty_heading(spark, sf_dir):
    return S.empty_headings(_lines(spark, sf_dir)).select("page", "line")


def page_titles(spark, sf_dir):
    pages = doc_pages(spark, sf_dir)
    return S.titles(pages, headings(spark, sf_dir), S.Policy(h1_source="either"))


def missing_title(spark, sf_dir):
    return S.missing_titles(page_titles(spark, sf_dir)).select("page")


def title_not_unique(spark, sf_dir):
    return S.titles_not_unique(page_titles(spark, sf_dir)).select("page")


def fence_labels(spark, sf_dir):
    return S.fence_labels(_lines(spark, sf_dir), S.Policy()).select("check_id", "page", "line", "level")


def callouts(spark, sf_dir):
    return S.callouts(_lines(spark, sf_dir), S.Policy()).select("check_id", "page", "line", "level")


def table_checks(spark, sf_dir):
    return S.table_checks(S.table_rows(_lines(spark, sf_dir)), S.Policy()).select("check_id", "page", "line", "level", "message")


def placeholder_unexplained(spark, sf_dir):
    return S.placeholders(doc_pages(spark, sf_dir), S.Policy()).select("page", F.col("message").alias("name"))


def policy_excluded(spark, sf_dir):
    return doc_pages(spark, sf_dir).filter(~S.excluded(F.col("path"), ("v1/faq/**", "*.mdx"))).select("page")


def structure_report(spark, sf_dir):
    return S.issues(doc_pages(spark, sf_dir)).orderBy("page", "line", "check_id", "message").limit(200)


def structure_gate(spark, sf_dir):
    return metrics.gate(S.issues(doc_pages(spark, sf_dir)).withColumnRenamed("level", "severity"), "error")


QUERIES = {f.__name__: f for f in (structure_issues, structure_places, structure_by_check, headings, heading_skip, multiple_h1, duplicate_heading, empty_heading, page_titles, missing_title, title_not_unique, fence_labels, callouts, table_checks, placeholder_unexplained, policy_excluded, structure_report, structure_gate)}

H = f"""{LINES}, hd AS (SELECT page, line, CAST(length(regexp_extract(text, '^(#{{1,6}})[ \\t]+(.*?)[ \\t\\r]*$', 1)) AS INT) AS level, regexp_extract(text, '^(#{{1,6}})[ \\t]+(.*?)[ \\t\\r]*$', 2) AS title
       FROM ln WHERE regexp_matches(text, '^(#{{1,6}})[ \\t]+(.*?)[ \\t\\r]*$'))"""
T = f"""{H}, h1 AS (SELECT page, arg_min(title, line) AS h1 FROM hd WHERE level = 1 GROUP BY page),
fr AS (SELECT page, trim(regexp_extract(regexp_extract(text, '(?s)\\A---\\n(.*?)\\n---\\n', 1), '(?m)^title:[ \\t]*(\\S.*?)[ \\t\\r]*$', 1), '"''') AS front FROM pg),
tt AS (SELECT page, coalesce(nullif(trim(h1), ''), nullif(trim(front), '')) AS title FROM fr LEFT JOIN h1 USING (page))"""
FENCE = "^[ \\t]*(`{3,}|~{3,})([^\\n]*)$"
CALL = "^[ \\t]*\\*\\*([A-Za-z]+)\\*\\*[ \\t]*(:|[ \\t]|$)"
NAME = "\\b([A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+)\\b"
ROW = "^[ \\t]*\\|(.+)\\|[ \\t\\r]*$"

SQL = {
    "headings": f"WITH {H} SELECT page, line, level, title FROM hd",
    "heading_skip": f"WITH {H}, b AS (SELECT *, lag(level) OVER (PARTITION BY page ORDER BY line) AS prev FROM hd) SELECT page, line FROM b WHERE level > prev + 1",
    "multiple_h1": f"WITH {H} SELECT page, line FROM hd WHERE level = 1 QUALIFY row_number() OVER (PARTITION BY page ORDER BY line) = 2",
    "duplicate_heading": f"WITH {H} SELECT page, line FROM hd QUALIFY row_number() OVER (PARTITION BY page, lower(trim(title)) ORDER BY line) > 1",
    "empty_heading": f"""WITH {H}, nx AS (SELECT page, line, lead(line) OVER (PARTITION BY page ORDER BY line) AS nxt FROM hd)
        SELECT page, line FROM nx WHERE NOT EXISTS (SELECT 1 FROM ln WHERE ln.page = nx.page AND ln.line > nx.line AND (nx.nxt IS NULL OR ln.line < nx.nxt) AND trim(ln.text) <> '')""",
    "page_titles": f"WITH {T} SELECT page, title FROM tt",
    "missing_title": f"WITH {T} SELECT page FROM tt WHERE title IS NULL",
    "title_not_unique": f"WITH {T} SELECT page FROM tt WHERE title IS NOT NULL QUALIFY count(*) OVER (PARTITION BY lower(trim(title))) > 1",
    "fence_labels": f"""WITH {LINES}, f AS (SELECT page, line, split_part(trim(regexp_replace(regexp_extract(raw, '{FENCE}', 2), '\\s+', ' ', 'g')), ' ', 1) AS label, row_number() OVER (PARTITION BY page ORDER BY line) AS p FROM ln WHERE regexp_matches(raw, '{FENCE}')),
        c AS (SELECT page, line, CASE WHEN label = '' THEN 'fence_no_language' WHEN label <> lower(label) THEN 'fence_case' WHEN label NOT IN ({', '.join(f"'{x}'" for x in S.Policy().approved_fences)}) THEN 'fence_unapproved' END AS check_id FROM f WHERE p % 2 = 1)
        SELECT check_id, page, line, CASE WHEN check_id = 'fence_unapproved' THEN 'suggestion' ELSE 'error' END AS level FROM c WHERE check_id IS NOT NULL""",
    "callouts": f"""WITH {LINES}, s AS (SELECT page, line, text, coalesce(last_value(CASE WHEN regexp_matches(text, '^##[ \\t]+') THEN regexp_extract(text, '^(#{{1,6}})[ \\t]+(.*?)[ \\t\\r]*$', 2) END IGNORE NULLS) OVER (PARTITION BY page ORDER BY line ROWS UNBOUNDED PRECEDING), '(top)') AS section FROM ln),
        k AS (SELECT *, regexp_extract(text, '{CALL}', 1) AS label, regexp_extract(text, '{CALL}', 2) AS sep FROM s WHERE regexp_matches(text, '{CALL}')),
        c AS (SELECT *, lag(line) OVER (PARTITION BY page ORDER BY line) AS prev FROM k WHERE label IN ('Info', 'Danger', 'Forbidden', 'Error', 'Note', 'Tip', 'Important', 'Caution', 'Warning'))
        SELECT 'callout_retired' AS check_id, page, line, 'error' AS level FROM c WHERE label IN ('Info', 'Danger', 'Forbidden', 'Error')
        UNION ALL SELECT 'callout_format', page, line, 'warning' FROM c WHERE sep <> ':' UNION ALL SELECT 'callout_stacked', page, line, 'error' FROM c WHERE line - prev <= 2
        UNION ALL SELECT 'callout_density', page, 1, 'warning' FROM c GROUP BY page, section HAVING count(*) > 2""",
    "table_checks": f"""WITH {LINES}, r AS (SELECT page, line, regexp_matches(text, '{ROW}') AS is_row, list_transform(string_split(regexp_replace(trim(replace(text, chr(13), '')), '^\\|+|\\|+$', '', 'g'), '|'), lambda c: trim(c)) AS cells FROM ln),
        i AS (SELECT *, sum(CASE WHEN is_row THEN 0 ELSE 1 END) OVER (PARTITION BY page ORDER BY line) AS island, len(list_filter(cells, lambda c: NOT regexp_full_match(c, '(:?-{{2,}}:?)?'))) = 0 AND len(list_filter(cells, lambda c: c <> '')) > 0 AS rule FROM r),
        n AS (SELECT *, lead(rule) OVER (PARTITION BY page, island ORDER BY line) AS nr FROM i WHERE is_row),
        h AS (SELECT *, last_value(CASE WHEN nr AND NOT rule THEN line END IGNORE NULLS) OVER (PARTITION BY page, island ORDER BY line ROWS UNBOUNDED PRECEDING) AS head FROM n),
        d AS (SELECT a.page, a.line, a.head, a.cells, list_transform(b.cells, lambda c: trim(regexp_replace(c, '[*`]', '', 'g'))) AS header FROM h a JOIN h b ON a.page = b.page AND a.head = b.line WHERE NOT a.rule),
        q AS (SELECT page, line, trim(regexp_replace(cells[list_position(header, 'Required')], '[*`]', '', 'g')) AS value FROM d WHERE line > head AND list_contains(header, 'Required'))
        SELECT 'table_width' AS check_id, page, line, 'warning' AS level, CAST(len(header) AS VARCHAR) AS message FROM d WHERE line = head AND len(header) > 5
        UNION ALL SELECT 'table_column_name', page, line, 'error', name FROM (SELECT page, line, unnest(header) AS name FROM d WHERE line = head) WHERE name IN ({', '.join(f"'{x}'" for x in S.Policy().banned_column_names)})
        UNION ALL SELECT 'required_value', page, line, 'error', value FROM q WHERE value <> '' AND value NOT IN ('Yes', 'No', 'Conditional')
        UNION ALL SELECT 'table_empty_cell', page, line, 'warning', '' FROM d WHERE line > head AND len(cells) = len(header) AND list_contains(cells, '')""",
    "placeholder_unexplained": f"""WITH {LINES}, cd AS (SELECT page, array_to_string(regexp_extract_all(body, '{block()}'), chr(10)) AS code, blank FROM bl), nm AS (SELECT DISTINCT page, blank, unnest(regexp_extract_all(code, '{NAME}', 1)) AS name FROM cd)
        SELECT page, name FROM nm WHERE NOT list_contains(regexp_extract_all(blank, '{NAME}', 1), name)""",
    "policy_excluded": f"WITH {PAGES} SELECT page FROM pg WHERE NOT starts_with(path, 'v1/faq/') AND NOT (path LIKE '%.mdx')",
}

# all checks under the default policy, by which a title is a page's first H1
_KIND = {"heading_skip": "error", "multiple_h1": "error", "duplicate_heading": "error", "empty_heading": "warning", "placeholder_unexplained": "suggestion"}
_BY_H1 = "nt AS (SELECT pg.page, nullif(trim(h1), '') AS title FROM pg LEFT JOIN h1 USING (page))"


def _inner(name: str) -> str:
    """The steps and the selection of a check's SQL, as one subquery."""
    return f"(SELECT * FROM ({SQL[name]}))"


_PARTS = [f"SELECT '{c}' AS check_id, '{level}' AS level FROM {_inner(c)}" for c, level in _KIND.items()] + [f"SELECT check_id, level FROM {_inner(c)}" for c in ("fence_labels", "callouts", "table_checks")]
_PARTS += [
    f"SELECT 'missing_title', 'warning' FROM (WITH {T}, {_BY_H1} SELECT page FROM nt WHERE title IS NULL)",
    f"SELECT 'title_not_unique', 'warning' FROM (WITH {T}, {_BY_H1} SELECT page FROM nt WHERE title IS NOT NULL QUALIFY count(*) OVER (PARTITION BY lower(title)) > 1)",
]
_ALL = " UNION ALL ".join(_PARTS)
SQL["structure_by_check"] = f"SELECT check_id, level, count(*) AS n FROM ({_ALL}) GROUP BY check_id, level"
_AT = [f"SELECT '{c}' AS check_id, '{level}' AS level, page, line FROM {_inner(c)}" for c, level in _KIND.items() if c != "placeholder_unexplained"]
_AT += [
    f"""SELECT 'placeholder_unexplained', 'suggestion', p.page, min(l.line) FROM {_inner("placeholder_unexplained")} p
        JOIN (WITH {LINES} SELECT page, line, raw FROM ln) l ON l.page = p.page AND regexp_matches(l.raw, '\\b' || p.name || '\\b') GROUP BY p.page, p.name"""
]
_AT += [f"SELECT check_id, level, page, line FROM {_inner(c)}" for c in ("fence_labels", "callouts", "table_checks")]
_AT += [p.replace("'warning' FROM", "'warning', page, 1 FROM", 1) for p in _PARTS[-2:]]
SQL["structure_places"] = f"SELECT check_id, level, page, CAST(line AS INT) AS line FROM ({' UNION ALL '.join(_AT)})"
SQL["structure_gate"] = f"SELECT count_if(level = 'error') AS failing, count(*) AS total FROM ({_ALL})"
