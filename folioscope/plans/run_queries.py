"""Monitoring runs and how well findings meet expectations."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.core.runtime import table
from folioscope.operators import claims as C
from folioscope.operators import evaluation as E
from folioscope.operators import runs as R
from folioscope.operators.snapshots import latest_runs
from folioscope.plans.common import doc_pages, values
from folioscope.plans.snapshot_queries import FROM_RUNS, RUNS


def run_deltas(spark, sf_dir):
    return R.deltas(table(spark, sf_dir, "runs")).drop("run_ts")


def run_change_counts(spark, sf_dir):
    return R.change_counts(table(spark, sf_dir, "runs"))


def run_regressions(spark, sf_dir):
    return R.regressions(table(spark, sf_dir, "runs"), table(spark, sf_dir, "run_findings"))


def run_latest(spark, sf_dir):
    return R.latest_snapshot(table(spark, sf_dir, "runs")).drop("run_ts")


def run_trend(spark, sf_dir):
    return R.trend(table(spark, sf_dir, "runs"))


def run_levels(spark, sf_dir):
    """The counts of a run's snapshot, as rows."""
    snap = R.snapshot(table(spark, sf_dir, "run_findings"), ["run_id"])
    return snap.select("run_id", F.explode("by_level").alias("level", "n"))


def run_checks(spark, sf_dir):
    snap = R.snapshot(table(spark, sf_dir, "run_findings"), ["run_id"])
    return snap.select("run_id", "total", F.size("fingerprints").alias("fingerprints"), F.explode("by_check").alias("check_id", "n"))


def top_checks(spark, sf_dir):
    return R.top_checks(table(spark, sf_dir, "run_findings"))


def _met(spark, sf_dir):
    """Fingerprints of the stored findings, with the confidence of their worst level, against those that the runs record."""
    confidence = F.when(F.col("severity") == "error", 0.9).when(F.col("severity") == "warning", 0.65).otherwise(0.4)
    produced = table(spark, sf_dir, "run_findings").select("run_id", "kind", R.fingerprint().alias("fingerprint"), confidence.alias("confidence"))
    expected = latest_runs(table(spark, sf_dir, "runs")).select("run_id", F.explode("fingerprints").alias("fingerprint")).withColumn("kind", F.split_part("fingerprint", F.lit(":"), F.lit(1)))
    return E.outcomes(produced, expected, ["run_id", "fingerprint"], ["kind", "confidence"])


def precision_recall(spark, sf_dir):
    return E.scores(_met(spark, sf_dir), "kind")


def threshold_sweep(spark, sf_dir):
    return E.sweep(_met(spark, sf_dir))


FLOORS = [("none", "gated", "precision", 1.0), ("none", "gated", "recall", 0.7), ("none", "mutated", "recall", 1.0), ("heuristic", "mutated", "recall", 1.0)]
MEASURED = [("none", "gated", "precision", 1.0), ("none", "gated", "recall", 0.69), ("none", "mutated", "recall", 1.0)]


def gate_floors(spark, sf_dir):
    keys = "arm string, metric_set string, metric string, "
    return E.below_floors(spark.createDataFrame(MEASURED, keys + "value double"), spark.createDataFrame(FLOORS, keys + "floor double"))


def baseline_subtraction(spark, sf_dir):
    """Findings of each run that its source's first run does not have."""
    runs = latest_runs(table(spark, sf_dir, "runs"))
    first = runs.groupBy("source").agg(F.min_by("run_id", F.struct("run_ts", "run_id")).alias("run_id"))
    found = table(spark, sf_dir, "run_findings").select("run_id", "source", "kind", "check_id", "page").distinct()
    return E.beyond_baseline(found, found.join(first.select("run_id"), "run_id", "left_semi"), ["source", "kind", "check_id", "page"])


def mutated_pages(spark, sf_dir):
    pages = doc_pages(spark, sf_dir)
    return E.mutations(C.curl_claims(pages), pages)


QUERIES = {f.__name__: f for f in (run_deltas, run_change_counts, run_regressions, run_latest, run_trend, run_levels, run_checks, top_checks, precision_recall, threshold_sweep, gate_floors, baseline_subtraction, mutated_pages)}

PRINT = "coalesce(kind, '') || ':' || coalesce(check_id, '') || ':' || coalesce(page, '')"
MET = f"""{RUNS}, pr AS (SELECT run_id, {PRINT} AS fingerprint, max(kind) AS kind, max(CASE severity WHEN 'error' THEN 0.9 WHEN 'warning' THEN 0.65 ELSE 0.4 END) AS confidence FROM run_findings GROUP BY 1, 2),
ex AS (SELECT DISTINCT run_id, unnest(fingerprints) AS fingerprint FROM last_run WHERE fingerprints IS NOT NULL),
mt AS (SELECT coalesce(p.kind, split_part(e.fingerprint, ':', 1)) AS kind, coalesce(confidence, 0) AS confidence, p.run_id IS NOT NULL AS produced, e.run_id IS NOT NULL AS expected FROM pr p FULL JOIN ex e USING (run_id, fingerprint))"""


def _rates(tp: str, fp: str, fn: str) -> str:
    p, r = f"CASE WHEN {tp} + {fp} > 0 THEN {tp} / ({tp} + {fp}) ELSE 0.0 END", f"CASE WHEN {tp} + {fn} > 0 THEN {tp} / ({tp} + {fn}) ELSE 0.0 END"
    return f"round_even({p}, 4) AS precision, round_even({r}, 4) AS recall, round_even(CASE WHEN ({p}) + ({r}) > 0 THEN 2 * ({p}) * ({r}) / (({p}) + ({r})) ELSE 0.0 END, 4) AS f1"


SQL = {
    "run_deltas": "WITH one AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY loaded_at DESC, total DESC NULLS LAST) = 1), b AS (SELECT *, lag(total) OVER (PARTITION BY source, label ORDER BY run_ts, run_id) AS before FROM one) SELECT run_id, source, label, total, before, total - before AS total_delta FROM b",
    "run_change_counts": f"WITH {RUNS},{FROM_RUNS} SELECT run_id, count_if(change_kind = 'added') AS new, count_if(change_kind = 'removed') AS fixed FROM fp_diff GROUP BY run_id",
    "run_regressions": f"WITH {RUNS},{FROM_RUNS} SELECT run_id, fingerprint FROM fp_diff WHERE change_kind = 'added' AND (run_id, fingerprint) IN (SELECT (run_id, {PRINT}) FROM run_findings WHERE severity = 'error')",
    "run_latest": f"WITH {RUNS} SELECT source, label, run_id FROM last_run WHERE fingerprints IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source, label ORDER BY run_ts DESC, run_id DESC) = 1",
    "run_trend": "WITH one AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY loaded_at DESC, total DESC NULLS LAST) = 1) SELECT run_id, source, label, strftime(run_ts, '%d %b %H:%M') AS at, total, coalesce(by_level['error'], 0) AS error, coalesce(by_level['warning'], 0) AS warning, coalesce(by_level['suggestion'], 0) AS suggestion FROM one WHERE total IS NOT NULL",
    "run_levels": "SELECT run_id, severity AS level, count(*) AS n FROM run_findings WHERE severity IS NOT NULL GROUP BY run_id, severity",
    "run_checks": f"WITH t AS (SELECT run_id, count(*) AS total, CAST(count(DISTINCT {PRINT}) AS INT) AS fingerprints FROM run_findings GROUP BY run_id) SELECT run_id, total, fingerprints, check_id, count(*) AS n FROM run_findings JOIN t USING (run_id) WHERE check_id IS NOT NULL GROUP BY run_id, total, fingerprints, check_id",
    "top_checks": "SELECT check_id, count(*) AS n FROM run_findings GROUP BY check_id ORDER BY n DESC, check_id LIMIT 12",
    "precision_recall": f"WITH {MET}, c AS (SELECT kind, count_if(produced AND expected) AS tp, count_if(produced AND NOT expected) AS fp, count_if(expected AND NOT produced) AS fn FROM mt GROUP BY kind) SELECT kind, tp, fp, fn, {_rates('tp', 'fp', 'fn')} FROM c",
    "threshold_sweep": f"WITH {MET}, s AS (SELECT CAST(t AS DOUBLE) AS threshold, expected, produced AND confidence + 1e-9 >= t AS shown FROM mt, (SELECT unnest([0.0, 0.35, 0.45, 0.6, 0.7, 0.8, 0.9]) AS t)), c AS (SELECT threshold, count_if(shown) AS reported, count_if(shown AND expected) AS tp, count_if(shown AND NOT expected) AS fp, count_if(expected AND NOT shown) AS fn FROM s GROUP BY threshold) SELECT threshold, reported, tp, fp, fn, {_rates('tp', 'fp', 'fn')} FROM c",
    "gate_floors": f"WITH {values('m', 'arm, metric_set, metric, value', MEASURED)}, {values('f', 'arm, metric_set, metric, floor', FLOORS)} SELECT arm, metric_set, metric, CAST(floor AS DOUBLE) AS floor, CAST(coalesce(value, 0) AS DOUBLE) AS value FROM f LEFT JOIN m USING (arm, metric_set, metric) WHERE coalesce(value, 0) + 1e-9 < floor",
    "baseline_subtraction": f"WITH {RUNS}, fi AS (SELECT run_id FROM last_run QUALIFY row_number() OVER (PARTITION BY source ORDER BY run_ts, run_id) = 1), f AS (SELECT DISTINCT run_id, source, kind, check_id, page FROM run_findings) SELECT run_id, source, kind, check_id, page FROM f WHERE NOT EXISTS (SELECT 1 FROM f b JOIN fi USING (run_id) WHERE b.source = f.source AND b.kind = f.kind AND b.check_id = f.check_id AND b.page = f.page)",
}
