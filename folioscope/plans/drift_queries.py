"""Claims of the pages, and what an API description says to them."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.core.runtime import durable
from folioscope.functions import openapi
from folioscope.operators import claims as C
from folioscope.operators import drift as D
from folioscope.operators import metrics
from folioscope.plans.common import BODY, PAGES, doc_pages, values
from folioscope.plans.sample_api import DOC

def _claims(spark, sf_dir):
    return durable(C.claims(doc_pages(spark, sf_dir)))


def page_claims(spark, sf_dir):
    return C.claims(doc_pages(spark, sf_dir))


def curl_calls(spark, sf_dir):
    return C.curl_claims(doc_pages(spark, sf_dir)).filter("kind = 'endpoint'").select("page", "line", "method", "base", "path")


def claim_bases(spark, sf_dir):
    return C.suggested_bases(durable(C.curl_claims(doc_pages(spark, sf_dir))))


def inline_routes(spark, sf_dir):
    return C.route_claims(doc_pages(spark, sf_dir)).select("page", "line", "method", "path", "origin")


def enum_claims(spark, sf_dir):
    return C.enum_claims(doc_pages(spark, sf_dir)).select("page", "line", "field", "value")


def api_operations(spark, sf_dir):
    return openapi.tables(spark, DOC)[0]


def api_enums(spark, sf_dir):
    return openapi.tables(spark, DOC)[1]


def _found(spark, sf_dir):
    made = _claims(spark, sf_dir)
    operations, enums = openapi.tables(spark, DOC)
    return D.findings(made, operations, enums, D.base_set(made, openapi.Document(DOC).server_bases()))


def drift_findings(spark, sf_dir):
    return _found(spark, sf_dir)


def drift_gated(spark, sf_dir):
    return D.gated(_found(spark, sf_dir)).groupBy("detector", "severity", "gated").agg(F.count("*").alias("n"))


def drift_by_detector(spark, sf_dir):
    return metrics.ranked(_found(spark, sf_dir), "detector")


def drift_unified(spark, sf_dir):
    return D.unified(_found(spark, sf_dir))


def drift_adjudicated(spark, sf_dir):
    return D.applied(_found(spark, sf_dir).withColumn("verdict", D.heuristic_verdict()))


def drift_context(spark, sf_dir):
    return D.context(_found(spark, sf_dir), doc_pages(spark, sf_dir)).select("page", "line", "detector", "evidence", "context")


def drift_verdicts(spark, sf_dir):
    return D.verdict_counts(_found(spark, sf_dir).withColumn("verdict", D.heuristic_verdict()))


def _matched(spark, sf_dir):
    return D.matched(_claims(spark, sf_dir), openapi.tables(spark, DOC)[0])


def template_match(spark, sf_dir):
    return _matched(spark, sf_dir).filter("path <> ''").select("page", "line", "kind", "name", F.col("op.path").alias("template"))


def path_methods(spark, sf_dir):
    return _matched(spark, sf_dir).filter("kind = 'endpoint'").select("page", "line", F.array_join("others", ",").alias("methods"))


def missing_auth(spark, sf_dir):
    return D.missing_auth(_matched(spark, sf_dir)).select("page", "line", "confidence")


def deprecated_endpoint(spark, sf_dir):
    return D.deprecated_endpoints(_matched(spark, sf_dir)).select("page", "line", "confidence")


def unknown_enum_value(spark, sf_dir):
    return D.unknown_enum_values(_claims(spark, sf_dir), openapi.tables(spark, DOC)[1]).select("page", "line", "evidence")


def unknown_parameter(spark, sf_dir):
    return D.unknown_parameters(_matched(spark, sf_dir)).select("page", "line", "evidence")


def abstentions(spark, sf_dir):
    return D.abstentions(_matched(spark, sf_dir)).select("page", "line")


def base_scope(spark, sf_dir):
    return _claims(spark, sf_dir).select("page", "line", "kind", "name", D.in_scope(["", "http://localhost:7700"]).alias("in_scope"))


QUERIES = {
    f.__name__: f
    for f in (page_claims, curl_calls, claim_bases, inline_routes, enum_claims, api_operations, api_enums, drift_findings, drift_gated, drift_by_detector, drift_unified, drift_adjudicated, drift_context, drift_verdicts, template_match, path_methods, missing_auth, deprecated_endpoint, unknown_enum_value, unknown_parameter, abstentions, base_scope)
}

#: What the description in `sample_api` says, typed out.
SETTINGS = ["maxImport", "onQuery", "order", "useVector"]
OPERATIONS = [
    ("/{service}/{setting}", "GET", "read", "", False, True, [], ["service", "setting"], ["limit"], [], [], [], ["200"]),
    ("/{service}/{setting}", "PATCH", "change", "", False, True, [], ["service", "setting"], [], SETTINGS, [], ["maxImport"], ["202"]),
    ("/{service}/{setting}", "DELETE", "drop", "", True, False, [], ["service", "setting"], [], [], [], [], ["204"]),
    ("/{service}/health", "GET", "health", "", False, False, [], [], [], [], [], [], ["200"]),
    ("/tasks", "POST", "task", "", False, True, [], [], [], SETTINGS, [], [], ["202"]),
]
ENUMS_OF = [("order", ["asc", "desc"])]
OPERATION_COLUMNS = "path, method, operation_id, summary, deprecated, secured, security, path_params, query_params, body_params, required_query, required_body, status_codes"
RAW_LINES = f"""{PAGES}, {BODY},
li AS (SELECT page, CAST(generate_subscripts(string_split(body, chr(10)), 1) + off AS INT) AS line, unnest(string_split(body, chr(10))) AS raw FROM body)"""
#: Calls in fenced shell samples, by the lines between each odd and the next fence; a call is one line, or goes on behind a backslash.
CALLS = f"""{RAW_LINES},
fe AS (SELECT *, regexp_matches(raw, '^[ \\t]*```') AS fence, sum(CASE WHEN regexp_matches(raw, '^[ \\t]*```') THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY line) AS n, lead(raw) OVER (PARTITION BY page ORDER BY line) AS nxt FROM li),
top AS (SELECT page, n, lower(regexp_extract(raw, '^[ \\t]*```([\\w+-]*)', 1)) AS lang FROM fe WHERE fence AND n % 2 = 1), per AS (SELECT page, max(n) AS fences FROM fe GROUP BY page),
said AS (SELECT page, line, regexp_replace(regexp_replace(raw, '\\\\\\s*$', ''), '^\\s+|\\s+$', '', 'g') || CASE WHEN regexp_matches(raw, '\\\\\\s*$') THEN ' ' || regexp_replace(nxt, '^\\s+|\\s+$', '', 'g') ELSE '' END AS command
         FROM fe JOIN top USING (page, n) JOIN per USING (page) WHERE NOT fence AND n < fences AND lang IN ('bash', 'sh', 'shell', 'console', '') AND regexp_matches(raw, '^\\s*curl ')),
url AS (SELECT *, regexp_extract(command, '-X (\\w+)', 1) AS method, regexp_extract(command, '\\x27([^\\x27]*)\\x27', 1) AS url FROM said),
calls AS (SELECT *, regexp_extract(url, '^(?:https?://[^/]+|[A-Z][A-Z0-9_]+)') AS base, regexp_replace(regexp_replace(url, '^(?:https?://[^/]+|[A-Z][A-Z0-9_]+)', ''), '/+$', '') AS path, contains(lower(command), 'authorization:') AS has_auth FROM url),
cl AS (SELECT k.kind, page, line, method, path, '' AS name, base, 'curl' AS origin, '' AS value, '' AS field, substr(command, 1, 160) AS snippet, has_auth FROM calls, (VALUES ('endpoint'), ('auth')) k(kind)
       UNION ALL SELECT 'body_param', page, line, method, path, unnest(list_distinct(regexp_extract_all(command, '"(\\w+)"\\s*:', 1))), base, 'curl', '', '', substr(command, 1, 160), NULL FROM calls)"""
_OPS = [(r[0], r[1], r[4], r[5], r[8], r[9]) for r in OPERATIONS]
TABLES = f"""{CALLS}, {values('op', 'tpath, tmethod, deprecated, secured, query_params, body_params', _OPS)}, {values('en', 'efield, allowed', ENUMS_OF)},
seg AS (SELECT *, list_filter(string_split(path, '/'), lambda s: s <> '') AS cs FROM cl), tem AS (SELECT *, list_filter(string_split(tpath, '/'), lambda s: s <> '') AS ts FROM op),
fit AS (SELECT s.*, t.*, len(list_filter(ts, lambda s: s[1] <> '{{')) AS literal FROM seg s JOIN tem t ON len(cs) = len(ts) AND len(list_filter(list_zip(ts, cs), lambda x: x[1][1] <> '{{' AND x[1] <> x[2])) = 0),
best AS (SELECT * FROM fit WHERE tmethod = method QUALIFY row_number() OVER (PARTITION BY page, line, kind, name ORDER BY literal DESC, tpath DESC) = 1)"""
ROUTES = f"""{RAW_LINES},
sp AS (SELECT page, line, unnest(regexp_extract_all(raw, '`(?:GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\\s+/[A-Za-z0-9_{{}}/:.-]*`')) AS span FROM li)"""
TYPES = ", ".join(f"'{t}'" for t in C.TYPE_WORDS)
ENUMS = f"""{RAW_LINES},
ro AS (SELECT page, line, regexp_extract(raw, '^\\|\\s*`([A-Za-z_][\\w.\\[\\]-]*)`\\s*\\|(.*)\\|\\s*$', 1) AS field, regexp_extract(raw, '^\\|\\s*`([A-Za-z_][\\w.\\[\\]-]*)`\\s*\\|(.*)\\|\\s*$', 2) AS rest FROM li WHERE regexp_matches(raw, '^\\|\\s*`([A-Za-z_][\\w.\\[\\]-]*)`\\s*\\|(.*)\\|\\s*$')),
va AS (SELECT page, line, field, trim(unnest(regexp_extract_all(regexp_replace(rest, '\\[[^\\]]*\\]\\([^)]*\\)', ' ', 'g'), '`([^`]+)`', 1))) AS value FROM ro)"""

SQL = {
    "inline_routes": f"WITH {ROUTES} SELECT page, line, regexp_extract(span, '`([A-Z]+)', 1) AS method, coalesce(nullif(regexp_replace(regexp_extract(span, '\\s(/[^`]*)`', 1), '/+$', ''), ''), '/') AS path, 'inline' AS origin FROM sp",
    "enum_claims": f"""WITH {ENUMS} SELECT page, line, field, value FROM va WHERE value <> '' AND length(value) <= 32 AND NOT regexp_matches(value, '[\\s(){{}}\\[\\]:,/=.]') AND NOT regexp_matches(value, '^[-+]?\\d+(\\.\\d+)?$')
        AND lower(value) NOT IN ({TYPES}) AND lower(value) NOT IN (lower(field), lower(field) || 's', lower(field) || 'es') AND lower(field) NOT IN (lower(value) || 's', lower(value) || 'es')""",
    "api_operations": f"WITH {values('o', OPERATION_COLUMNS, OPERATIONS)} SELECT * FROM o",
    "api_enums": f"WITH {values('e', 'field, allowed', ENUMS_OF)} SELECT * FROM e",
    "curl_calls": f"WITH {CALLS} SELECT page, line, method, base, path FROM calls",
    "page_claims": f"WITH {CALLS} SELECT * FROM cl",
    "template_match": f"WITH {TABLES} SELECT s.page, s.line, s.kind, s.name, b.tpath AS template FROM seg s LEFT JOIN best b USING (page, line, kind, name) WHERE s.path <> ''",
    "path_methods": f"WITH {TABLES} SELECT page, line, coalesce(string_agg(DISTINCT tmethod, ',' ORDER BY tmethod), '') AS methods FROM seg LEFT JOIN (SELECT page, line, kind, tmethod FROM fit) f USING (page, line, kind) WHERE kind = 'endpoint' GROUP BY page, line",
    "missing_auth": f"WITH {TABLES} SELECT page, line, CAST(0.65 AS DOUBLE) AS confidence FROM best WHERE kind = 'auth' AND NOT has_auth AND secured",
    "deprecated_endpoint": f"WITH {TABLES} SELECT page, line, CAST(0.95 AS DOUBLE) AS confidence FROM best WHERE kind = 'endpoint' AND deprecated",
    "unknown_enum_value": f"WITH {ENUMS}, {values('en', 'efield, allowed', ENUMS_OF)} SELECT page, line, field || '=' || value AS evidence FROM va JOIN en ON efield = field WHERE value <> '' AND NOT list_contains(allowed, value)",
    "unknown_parameter": f"""WITH {TABLES}, k AS (SELECT *, CASE WHEN kind = 'body_param' THEN body_params ELSE query_params END AS known FROM best WHERE kind IN ('body_param', 'query_param'))
        SELECT page, line, tmethod || ' ' || tpath || ' ' || name AS evidence FROM k WHERE len(known) > 0 AND NOT list_contains(known, name)""",
    "abstentions": f"WITH {TABLES} SELECT DISTINCT page, line FROM best WHERE kind IN ('body_param', 'query_param') AND len(CASE WHEN kind = 'body_param' THEN body_params ELSE query_params END) = 0",
    "base_scope": f"WITH {CALLS} SELECT page, line, kind, name, base = '' OR base = 'http://localhost:7700' AS in_scope FROM cl",
}
