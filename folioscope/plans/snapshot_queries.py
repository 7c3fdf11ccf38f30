"""Queries of the snapshot comparison, with their SQL."""

from folioscope.core.runtime import table
from folioscope.operators import snapshots as S


def p1_found(spark, sf_dir):
    return S.found_changes(table(spark, sf_dir, "page_snapshots", "run_id", "path", "fetched_at", "loaded_at", "revision"), table(spark, sf_dir, "runs"))


def p1_page_revisions(spark, sf_dir):
    return S.page_changes(table(spark, sf_dir, "page_snapshots"), table(spark, sf_dir, "runs"))


def p1_findings(spark, sf_dir):
    return S.finding_changes(table(spark, sf_dir, "run_findings"), table(spark, sf_dir, "runs"))


QUERIES = {"p1_found": p1_found, "p1_page_revisions": p1_page_revisions, "p1_findings": p1_findings}

RUNS = """
last_run AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY loaded_at DESC NULLS LAST, fingerprints DESC NULLS LAST) = 1),
ord AS (SELECT run_id, source, label, run_ts, row_number() OVER w AS seq, lag(run_id) OVER w AS prev_run, lead(run_id) OVER w AS next_run
        FROM last_run WINDOW w AS (PARTITION BY source, label ORDER BY run_ts, run_id))"""

PAGES = """
one AS (SELECT o.*, s.path, s.revision FROM page_snapshots s JOIN ord o USING (run_id)
        QUALIFY row_number() OVER (PARTITION BY s.run_id, s.path ORDER BY s.fetched_at DESC NULLS LAST, s.loaded_at DESC NULLS LAST, s.revision DESC NULLS LAST) = 1),
norm AS (SELECT *, regexp_replace(regexp_replace(lower(revision), '^[\\s"]*(w/)?[\\s"]*', ''), '[\\s"]+$', '') AS bare FROM one),
known AS (SELECT *, CASE WHEN bare <> '' AND NOT starts_with(bare, 'error:') THEN bare END AS rev,
                 seq - row_number() OVER (PARTITION BY source, label, path ORDER BY seq) AS stay FROM norm),
eff AS (SELECT *, last_value(rev IGNORE NULLS) OVER (PARTITION BY source, label, path, stay ORDER BY seq) AS r FROM known),
page_diff AS (
  SELECT c.run_id, c.path, CASE WHEN p.run_id IS NULL THEN 'added' ELSE 'changed' END AS change_kind, p.r AS old_revision, c.r AS new_revision
  FROM eff c LEFT JOIN eff p ON p.run_id = c.prev_run AND p.path = c.path
  WHERE c.prev_run IS NOT NULL AND (p.run_id IS NULL OR (c.r <> p.r))
  UNION ALL
  SELECT p.next_run, p.path, 'removed', p.r, NULL FROM eff p WHERE p.next_run IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM eff c WHERE c.run_id = p.next_run AND c.path = p.path))"""


def _sets(rows: str) -> str:
    return f"""
done AS (SELECT run_id, lag(run_id) OVER w AS prev_run, lead(run_id) OVER w AS next_run FROM last_run WHERE fingerprints IS NOT NULL
         WINDOW w AS (PARTITION BY source, label ORDER BY run_ts, run_id)),
fp AS ({rows}),
fp_diff AS (
  SELECT c.run_id, c.fingerprint, 'added' AS change_kind FROM fp c JOIN done d USING (run_id) WHERE d.prev_run IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM fp p WHERE p.run_id = d.prev_run AND p.fingerprint = c.fingerprint)
  UNION ALL
  SELECT d.next_run, p.fingerprint, 'removed' FROM fp p JOIN done d USING (run_id) WHERE d.next_run IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM fp c WHERE c.run_id = d.next_run AND c.fingerprint = p.fingerprint))"""


FROM_RUNS = _sets("SELECT DISTINCT run_id, unnest(fingerprints) AS fingerprint FROM last_run WHERE fingerprints IS NOT NULL")
FROM_FINDINGS = _sets("SELECT DISTINCT run_id, coalesce(kind, '') || ':' || coalesce(check_id, '') || ':' || coalesce(page, '') AS fingerprint FROM run_findings")

SQL = {
    "p1_found": f"WITH {RUNS},{PAGES},{FROM_RUNS} SELECT run_id, 'page' AS entity, path AS record_key, change_kind FROM page_diff UNION ALL SELECT run_id, 'fingerprint', fingerprint, change_kind FROM fp_diff",
    "p1_page_revisions": f"WITH {RUNS},{PAGES} SELECT run_id, path, change_kind, old_revision, new_revision FROM page_diff",
    "p1_findings": f"WITH {RUNS},{FROM_FINDINGS} SELECT run_id, fingerprint, change_kind FROM fp_diff",
}
