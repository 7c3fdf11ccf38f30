"""Style alerts, their counts and comparisons, word counts and replacements, over all pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import masking as M
from folioscope.functions import rule_data as D
from folioscope.functions.rules import catalog, rules
from folioscope.operators import metrics, remediation, style
from folioscope.plans.common import LINES, PAGES, block, doc_pages, values


def _plain():
    return [r for r in rules() if r.kind != "capitalization"]


def _alerts(spark, sf_dir):
    return style.alerts(doc_pages(spark, sf_dir), _plain())


def style_alerts(spark, sf_dir):
    return _alerts(spark, sf_dir).select("page", "rule", "severity", "line", "found")


def style_replacements(spark, sf_dir):
    return _alerts(spark, sf_dir).filter("replacement IS NOT NULL").select("page", "rule", "line", "found", "replacement")


def heading_case(spark, sf_dir):
    return style.alerts(doc_pages(spark, sf_dir), [r for r in rules() if r.kind == "capitalization"]).select("page", "rule", "severity", "line", "found")


def style_counts(spark, sf_dir):
    return metrics.counts(_alerts(spark, sf_dir))


def style_by_severity(spark, sf_dir):
    return metrics.by_severity(_alerts(spark, sf_dir))


def style_ranked(spark, sf_dir):
    return metrics.ranked(_alerts(spark, sf_dir), "rule")


def style_per_1k(spark, sf_dir):
    return metrics.per_thousand(_alerts(spark, sf_dir), style.prose_words(doc_pages(spark, sf_dir)))


def style_annotations(spark, sf_dir):
    return metrics.annotations(_alerts(spark, sf_dir)).select("severity", "page", "line", "rule", "place")


def style_top_pages(spark, sf_dir):
    return metrics.summary(_alerts(spark, sf_dir))[1]


def style_gate(spark, sf_dir):
    return metrics.gate(_alerts(spark, sf_dir), "warning")


def style_sarif(spark, sf_dir):
    return metrics.sarif_results(_alerts(spark, sf_dir))


def style_before_after(spark, sf_dir):
    """Alerts measured anew on the remediated texts, against those before."""
    pages = doc_pages(spark, sf_dir)
    after = remediation.fixed(pages).select("page", "text")
    return metrics.compared(_alerts(spark, sf_dir), style.alerts(after, _plain()), "rule")


def prose_words(spark, sf_dir):
    return style.prose_words(doc_pages(spark, sf_dir))


def prose_segments(spark, sf_dir):
    each = doc_pages(spark, sf_dir).select("page", F.posexplode(M.segments(F.col("text"))).alias("seq", "s"))
    return each.select("page", "seq", F.col("s.prose").alias("prose"), F.length("s.text").alias("chars"))


def indented_code(spark, sf_dir):
    return M.indented_code(M.page_lines(doc_pages(spark, sf_dir)))


def remediation_fixes(spark, sf_dir):
    return remediation.fixes_by_rule(remediation.fixed(doc_pages(spark, sf_dir)))


def remediated_text(spark, sf_dir):
    return remediation.fixed(doc_pages(spark, sf_dir)).filter("size(fixes) > 0").select("page", "text")


def protected_unchanged(spark, sf_dir):
    """Protected segments in all, and those that the replacements altered: none."""
    done = remediation.fixed(doc_pages(spark, sf_dir))
    n = done.agg(F.sum(F.size(F.filter(M.segments(F.col("text")), lambda s: ~s["prose"]))).cast("bigint").alias("segments"))
    return n.crossJoin(remediation.altered_segments(done).agg(F.count("*").alias("altered")))


def rule_catalog(spark, sf_dir):
    return spark.createDataFrame(catalog(rules()), "rule string, kind string, level string, scope string, patterns int, automatic boolean")


def alerts_with_rules(spark, sf_dir):
    """Alerts with what the catalog knows of their rule; alerts of a rule that it does not know stay."""
    known = F.broadcast(rule_catalog(spark, sf_dir).filter("rule <> 'EmDash'"))  # a row for each rule
    return _alerts(spark, sf_dir).join(known, "rule", "left").groupBy("rule", "kind", "automatic").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (rule_catalog, alerts_with_rules, style_alerts, style_replacements, heading_case, style_counts, style_by_severity, style_ranked, style_per_1k, style_annotations, style_top_pages, style_gate, style_sarif, style_before_after, prose_words, prose_segments, indented_code, remediation_fixes, remediated_text, protected_unchanged)
}


def _sql(text: str) -> str:
    return text.replace("'", "''")


def _alert_sql() -> str:
    parts = []
    for r in _plain():
        line = "raw" if r.scope == "raw" else "seen"
        if r.kind in ("existence", "substitution"):
            where = {"heading": f" WHERE regexp_matches(seen, '{_sql(style.HEADING)}')", "table.cell": f" WHERE regexp_matches(seen, '{_sql(style.ROW)}')"}.get(r.scope, "")
            source = "text" if r.scope == "raw" else line
            parts.append(f"SELECT page, path, '{r.name}' AS rule, '{r.level}' AS severity, line, unnest(regexp_extract_all({source}, '{_sql(r.pattern())}')) AS found FROM seen{where}")
        elif r.kind == "occurrence":
            token = "(?:[\\p{L}\\p{N}\\p{M}\\p{Pc}])+"
            parts.append(f"SELECT page, path, '{r.name}', '{r.level}', line, s FROM (SELECT page, path, line, unnest(regexp_split_to_array(seen, '{style.SENTENCE_END}')) AS s FROM seen) WHERE len(regexp_extract_all(s, '{token}')) > {r.most}")
        else:
            known = ", ".join(f"'{w}'" for w in r.exceptions)
            parts.append(
                f"SELECT DISTINCT page, path, '{r.name}', '{r.level}', line, s FROM (SELECT page, path, line, unnest(regexp_extract_all(seen, '{D.ACRONYM[1]}', 1)) AS s FROM seen) a WHERE s NOT IN ({known})"
                f" AND NOT EXISTS (SELECT 1 FROM (SELECT page, unnest(regexp_extract_all(seen, '{D.ACRONYM[2]}', 1)) AS d FROM whole) w WHERE w.page = a.page AND w.d = a.s)"
            )
    unseen = _sql(style.UNSEEN)
    seen = f"whole AS (SELECT page, regexp_replace(blank, '{unseen}', '', 'g') AS seen FROM bl), seen AS (SELECT page, path, line, text, regexp_replace(text, '{unseen}', '', 'g') AS seen FROM ln)"
    return f"{LINES}, {seen}, alerts AS ({' UNION ALL '.join(parts)})"


ALERTS = _alert_sql()
AREA = "CASE WHEN instr(page, '/') > 0 THEN split_part(page, '/', 1) ELSE '(root)' END"
INLINE = "`+[^`\\n]*`+|<[A-Za-z/][^>\\n]*>|\\]\\([^)\\s]+(?:\\s+\"[^\"]*\")?\\)|https?://[^\\s)\\]]+"
RANK = "CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END"

SQL = {
    "style_alerts": f"WITH {ALERTS} SELECT page, rule, severity, line, found FROM alerts",
    "style_counts": f"WITH {ALERTS}, a AS (SELECT *, {AREA} AS area FROM alerts) SELECT rule, severity, area, count(*) AS n, count(DISTINCT page) AS pages FROM a GROUP BY GROUPING SETS ((rule), (severity), (area), ())",
    "style_by_severity": f"WITH {ALERTS} SELECT s.severity, count(a.page) AS n FROM (VALUES ('error'), ('warning'), ('suggestion')) s(severity) LEFT JOIN alerts a USING (severity) GROUP BY s.severity",
    "style_ranked": f"WITH {ALERTS}, c AS (SELECT rule, count(*) AS n FROM alerts GROUP BY rule) SELECT rule, n, CAST(row_number() OVER (ORDER BY n DESC, rule) AS INT) AS place FROM c",
    "style_annotations": f"WITH {ALERTS}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY severity ORDER BY page, line, rule, found) AS INT) AS place FROM alerts) SELECT severity, page, line, rule, place FROM r WHERE place <= 50",
    "style_top_pages": f"WITH {ALERTS} SELECT page, count(*) AS n FROM alerts GROUP BY page ORDER BY n DESC, page LIMIT 15",
    "style_gate": f"WITH {ALERTS} SELECT count_if({RANK} <= 1) AS failing, count(*) AS total FROM alerts",
    "prose_words": f"""WITH {PAGES}, cut AS (SELECT page, array_to_string(list_transform(list_zip(regexp_split_to_array(text, '{{b}}'), regexp_extract_all(text, '{{b}}')), lambda x: regexp_replace(coalesce(x[1], ''), '{INLINE}', '', 'g')), '') AS prose FROM pg)
        SELECT page, CAST(len(regexp_extract_all(prose, '[\\p{{L}}\\p{{N}}\\p{{M}}\\p{{Pc}}](?:[\\p{{L}}\\p{{N}}\\p{{M}}\\p{{Pc}}''-]*[\\p{{L}}\\p{{N}}\\p{{M}}\\p{{Pc}}])?')) AS INT) AS words FROM cut""".replace("{b}", block()),
}
WORDS = SQL["prose_words"].removeprefix("WITH ").rpartition("SELECT page")
CATALOG = values("ca", "rule, kind, level, scope, patterns, automatic", catalog(rules()))
SQL |= {
    "rule_catalog": f"WITH {CATALOG} SELECT rule, kind, level, scope, patterns, automatic FROM ca",
    "alerts_with_rules": f"WITH {ALERTS}, {CATALOG} SELECT a.rule, kind, automatic, count(*) AS n FROM alerts a LEFT JOIN (SELECT * FROM ca WHERE rule <> 'EmDash') c USING (rule) GROUP BY a.rule, kind, automatic",
    "style_per_1k": f"WITH {ALERTS}, {WORDS[0].replace(PAGES + ', ', '')}, w AS (SELECT page{WORDS[2]}), t AS (SELECT (SELECT count(*) FROM alerts) AS total, (SELECT CAST(sum(words) AS BIGINT) FROM w) AS words) SELECT total, words, CASE WHEN words > 0 THEN round_even(total * 1000 / words, 2) ELSE 0.0 END AS per_1k FROM t",
    "prose_segments": f"""WITH {PAGES}, c AS (SELECT page, list_filter(flatten(list_transform(list_zip(regexp_split_to_array(text, '{block()}'), regexp_extract_all(text, '{block()}')), lambda x: [{{'p': true, 't': coalesce(x[1], '')}}, {{'p': false, 't': coalesce(x[2], '')}}])), lambda s: s.t <> '') AS s FROM pg)
        SELECT page, CAST(generate_subscripts(s, 1) - 1 AS INT) AS seq, unnest(s).p AS prose, CAST(length(unnest(s).t) AS INT) AS chars FROM c""",
}


def _replacement_sql() -> str:
    parts = []
    for r in _plain():
        if r.kind != "substitution":
            continue
        flag = "(?i)" if r.ignorecase else ""
        cases = ""
        for key, value in r.swap.items():
            new = f"regexp_replace(found, '{flag}{_sql(key)}', '{_sql(value.replace('$1', chr(92) + '1'))}')" if "$" in value else f"'{_sql(value)}'"
            cases += f" WHEN regexp_full_match(found, '{flag}(?:{_sql(key)})') THEN {new}"
        parts.append(f"SELECT page, rule, line, found, CASE{cases} END AS replacement FROM alerts WHERE rule = '{r.name}'")
    return f"WITH {ALERTS}, rp AS ({' UNION ALL '.join(parts)}) SELECT page, rule, line, found, replacement FROM rp WHERE replacement IS NOT NULL AND replacement <> found"


SQL["style_replacements"] = _replacement_sql()
