"""Queries over pages and documents, with the SQL of those that SQL can express on whole tables."""

from folioscope.core.runtime import spread, table
from folioscope.llm import boilerplate, leaks, markup, near_duplicates, packing, repeated_lines, repetition, residue

PAGES = ("page_id", "text", "url", "loaded_at")


def pages(spark, sf_dir):
    """The scan for operators that work on each page's text; a single small file is spread over the cores."""
    return spread(table(spark, sf_dir, "pages", *PAGES))


def p2_found(spark, sf_dir):
    return markup.notations(pages(spark, sf_dir))


def p2_clean(spark, sf_dir):
    return markup.clean_text(pages(spark, sf_dir))


def p2_path_ratios(spark, sf_dir):
    return markup.path_ratios(pages(spark, sf_dir))


def p3_found(spark, sf_dir):
    return boilerplate.surroundings(pages(spark, sf_dir))


def p3_main_content(spark, sf_dir):
    return boilerplate.main_content(pages(spark, sf_dir))


def p4_found(spark, sf_dir):
    return residue.residue_pages(pages(spark, sf_dir))


def p4_report(spark, sf_dir):
    return residue.residue_report(pages(spark, sf_dir))


def p5_found(spark, sf_dir):
    return near_duplicates.pairs(pages(spark, sf_dir))


def p5_groups(spark, sf_dir):
    return near_duplicates.groups(pages(spark, sf_dir))


def p6_found(spark, sf_dir):
    return repeated_lines.repeated_lines(pages(spark, sf_dir))


def p6_rebuilt(spark, sf_dir):
    return repeated_lines.rebuilt_pages(pages(spark, sf_dir))


def p7_packed(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "containers"))


def p7_usage(spark, sf_dir):
    return packing.usage(p7_packed(spark, sf_dir), table(spark, sf_dir, "containers"))


def p8_found(spark, sf_dir):
    return leaks.leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "eval_items"))


def p8_report(spark, sf_dir):
    return leaks.leak_report(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "eval_items"))


def p8_proximity(spark, sf_dir):
    return leaks.proximity(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "eval_items"))


def p9_found(spark, sf_dir):
    return repetition.repetitive(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))


def p9_shares(spark, sf_dir):
    return repetition.shares(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))


def p9_outliers(spark, sf_dir):
    return repetition.outliers(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))


QUERIES = {
    "p2_found": p2_found,
    "p2_clean": p2_clean,
    "p2_path_ratios": p2_path_ratios,
    "p3_found": p3_found,
    "p3_main_content": p3_main_content,
    "p4_found": p4_found,
    "p4_report": p4_report,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p6_found": p6_found,
    "p6_rebuilt": p6_rebuilt,
    "p7_packed": p7_packed,
    "p7_usage": p7_usage,
    "p8_found": p8_found,
    "p8_report": p8_report,
    "p8_proximity": p8_proximity,
    "p9_found": p9_found,
    "p9_shares": p9_shares,
    "p9_outliers": p9_outliers,
}

LINES = """
pg AS (SELECT page_id, coalesce(text, '') AS text, regexp_replace(regexp_extract(lower(trim(url)), '^(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:@]+)', 1), '^www\\.', '') AS site
       FROM pages WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY loaded_at DESC) = 1),
sites AS (SELECT site, count(*) AS site_pages FROM pg WHERE site <> '' GROUP BY site),
ln AS (SELECT page_id, site, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, unnest(string_split(text, chr(10))) AS line FROM pg WHERE site <> ''),
keyed AS (SELECT page_id, site, line_no, line, trim(regexp_replace(regexp_replace(regexp_replace(lower(line), '<[^<>]*>', '', 'g'), '[^\\p{L}\\p{N}]+', ' ', 'g'), '\\p{Nd}+', '0', 'g')) AS key FROM ln),
hot AS (SELECT site, key FROM keyed JOIN sites USING (site) WHERE len(string_split(key, ' ')) >= 4
        GROUP BY site, key, site_pages HAVING count(DISTINCT page_id) >= 5 AND count(DISTINCT page_id) * 100 >= site_pages * 20)"""

SIMILAR = """
pw AS (SELECT page_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM pages QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY loaded_at DESC) = 1),
sh AS (SELECT DISTINCT page_id, hash(array_to_string(list_slice(w, s, s + 4), ' ')) AS run FROM pw, LATERAL (SELECT unnest(generate_series(1, len(w) - 4)) AS s) WHERE len(w) >= 100),
n AS (SELECT page_id, count(*) AS n FROM sh GROUP BY page_id),
common AS (SELECT x.page_id AS a, y.page_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.run = y.run AND x.page_id < y.page_id GROUP BY 1, 2)"""

ITEM_WINDOWS = """
iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items),
dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM documents),
win AS (SELECT item_id, least(13, len(w)) AS n, s AS at, array_to_string(list_slice(w, s, s + least(13, len(w)) - 1), ' ') AS run
        FROM iw, LATERAL (SELECT unnest(generate_series(1, greatest(len(w) - 12, 1))) AS s) WHERE len(w) > 0),
runs_of AS (SELECT doc_id, n, s AS at, array_to_string(list_slice(w, s, s + n - 1), ' ') AS run
            FROM dw, (SELECT DISTINCT n FROM win), LATERAL (SELECT unnest(generate_series(1, len(w) - n + 1)) AS s) WHERE len(w) >= n),
met AS (SELECT d.doc_id, i.item_id, i.at AS item_at, d.at AS doc_at FROM win i JOIN runs_of d USING (n, run))"""

NEARBY = """
it AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM eval_items),
dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM documents),
dt AS (SELECT doc_id, generate_subscripts(w, 1) AS pos, unnest(w) AS term FROM dw),
df AS (SELECT term, count(DISTINCT doc_id) AS df FROM dt GROUP BY term),
chosen AS (SELECT item_id, term, row_number() OVER (PARTITION BY item_id ORDER BY df, term) AS slot FROM it JOIN df USING (term) QUALIFY slot <= 3),
seen AS (SELECT doc_id, item_id, pos, max(CASE WHEN slot = 1 THEN pos END) OVER so_far AS p1, max(CASE WHEN slot = 2 THEN pos END) OVER so_far AS p2, max(CASE WHEN slot = 3 THEN pos END) OVER so_far AS p3
         FROM dt JOIN chosen USING (term) WINDOW so_far AS (PARTITION BY doc_id, item_id ORDER BY pos ROWS UNBOUNDED PRECEDING))"""

REPEATED = """
dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM documents),
rn AS (SELECT doc_id, s AS pos, array_to_string(list_slice(w, s, s + 7), ' ') AS run FROM dw, LATERAL (SELECT unnest(generate_series(1, len(w) - 7)) AS s) WHERE len(w) >= 8),
again AS (SELECT doc_id, pos FROM rn QUALIFY pos > min(pos) OVER (PARTITION BY doc_id, run)),
hit AS (SELECT doc_id, count(DISTINCT pos + k) AS n FROM again, LATERAL (SELECT unnest(generate_series(0, 7)) AS k) GROUP BY doc_id),
share AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_repeated, CASE WHEN len(w) > 0 THEN coalesce(n, 0) / len(w) ELSE 0.0 END AS share FROM dw LEFT JOIN hit USING (doc_id))"""

SQL = {
    "p5_found": f"WITH {SIMILAR} SELECT a AS page_id_a, b AS page_id_b FROM common JOIN n na ON na.page_id = a JOIN n nb ON nb.page_id = b WHERE c * 100 >= (na.n + nb.n - c) * 70",
    "p5_groups": f"""WITH RECURSIVE {SIMILAR}, cls AS (SELECT page_id, min(page_id) OVER (PARTITION BY array_to_string(w, ' ')) AS rep FROM pw WHERE len(w) >= 100),
        link AS (SELECT a, b FROM common JOIN n na ON na.page_id = a JOIN n nb ON nb.page_id = b WHERE c * 100 >= (na.n + nb.n - c) * 70 AND a IN (SELECT rep FROM cls) AND b IN (SELECT rep FROM cls)),
        ends AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
        reach(id, root) AS (SELECT DISTINCT rep, rep FROM cls UNION SELECT e.b, r.root FROM reach r JOIN ends e ON e.a = r.id)
        SELECT page_id, cls.rep AS class_id, g.root AS group_id, count(*) OVER (PARTITION BY cls.rep) AS n_copies FROM cls JOIN (SELECT id, min(root) AS root FROM reach GROUP BY id) g ON g.id = cls.rep""",
    "p6_found": f"WITH {LINES} SELECT page_id, CAST(line_no AS INT) AS line_no FROM keyed JOIN hot USING (site, key)",
    "p6_rebuilt": f"""WITH {LINES}, marked AS (SELECT k.page_id, k.line_no, k.line, h.key IS NOT NULL AS hit FROM keyed k LEFT JOIN hot h USING (site, key))
        SELECT page_id, CAST(count(*) FILTER (WHERE hit) AS INT) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT hit), '') AS text FROM marked GROUP BY page_id""",
    "p8_found": f"WITH {ITEM_WINDOWS} SELECT DISTINCT doc_id, item_id FROM met",
    "p8_report": f"""WITH {ITEM_WINDOWS} SELECT doc_id, item_id, count(DISTINCT item_at) AS matched, any_value(nw) AS n_windows, count(DISTINCT item_at) / any_value(nw) AS coverage, CAST(min(doc_at) - 1 AS INT) AS first_word
        FROM met JOIN (SELECT item_id, count(*) AS nw FROM win GROUP BY item_id) USING (item_id) GROUP BY doc_id, item_id""",
    "p8_proximity": f"""WITH {NEARBY} SELECT DISTINCT doc_id, item_id FROM seen WHERE p1 IS NOT NULL AND p2 IS NOT NULL AND p3 IS NOT NULL AND pos - least(p1, p2, p3) < 26""",
    "p9_found": f"WITH {REPEATED} SELECT doc_id FROM share WHERE n_words >= 40 AND n_repeated * 100 >= n_words * 30",
    "p9_shares": f"WITH {REPEATED} SELECT doc_id, n_words, n_repeated, share FROM share",
}
