"""Monitoring runs: a snapshot's counts, what changed since the run before, and whether that is a regression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.snapshots import latest_runs, run_set_changes

FINDING = ["kind", "check_id", "page", "line", "level", "message"]


def union_of(style: DataFrame, structure: DataFrame, drift: DataFrame) -> DataFrame:
    """Findings of all three checks in one form."""
    a = style.select(F.lit("style").alias("kind"), F.col("rule").alias("check_id"), "page", "line", F.col("severity").alias("level"), F.col("found").alias("message"))
    b = structure.select(F.lit("structure").alias("kind"), "check_id", "page", "line", "level", "message")
    return a.unionByName(b).unionByName(drift.select(*FINDING))


def fingerprint() -> Column:
    """Check and page of a finding; lines do not count, as they move between runs."""
    return F.concat_ws(":", F.coalesce("kind", F.lit("")), F.coalesce("check_id", F.lit("")), F.coalesce("page", F.lit("")))


def snapshot(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Per run (`keys`): total, counts by level, kind and check as maps, and the sorted distinct fingerprints.

    Counts are summed per key first, so the maps are built from a handful of rows a run. A run's set of fingerprints is one array, as
    the history stores it; comparisons of large runs use the exploded form.
    """
    level = "severity" if "severity" in findings.columns else "level"
    rows = findings.withColumn("_level", F.col(level)).withColumn("_f", fingerprint())
    counted = rows.groupBy(*keys, "_level", "kind", "check_id").agg(F.count("*").alias("n"))

    def as_map(column: str, name: str) -> DataFrame:
        n = counted.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.sum("n").alias("n"))
        return n.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias(name))

    out = counted.groupBy(*keys).agg(F.sum("n").alias("total"))
    for column, name in (("_level", "by_level"), ("kind", "by_kind"), ("check_id", "by_check")):
        out = out.join(as_map(column, name), keys, "left")
    prints = rows.select(*keys, "_f").distinct().groupBy(*keys).agg(F.array_sort(F.collect_list("_f")).alias("fingerprints"))
    return out.join(prints, keys, "left")


def deltas(runs: DataFrame) -> DataFrame:
    """`run_id, source, label, run_ts, total, before, total_delta`: each run's total against the one before of its source and label."""
    one = runs.groupBy("run_id").agg(F.max(F.struct("loaded_at", "total", "run_ts", "source", "label")).alias("r")).select("run_id", "r.*")
    by_time = Window.partitionBy("source", "label").orderBy("run_ts", "run_id")
    rows = one.withColumn("before", F.lag("total").over(by_time))
    return rows.select("run_id", "source", "label", "run_ts", "total", "before", (F.col("total") - F.col("before")).alias("total_delta"))


def change_counts(runs: DataFrame) -> DataFrame:
    """`run_id, new, fixed`: how many fingerprints appeared and vanished against the nearest earlier finished run."""
    done = latest_runs(runs).filter(F.col("fingerprints").isNotNull())
    rows = done.select("run_id", F.explode("fingerprints").alias("fingerprint")).distinct()
    each = run_set_changes(rows, done, "fingerprint")
    return each.groupBy("run_id").agg(F.count_if(F.col("change_kind") == "added").alias("new"), F.count_if(F.col("change_kind") == "removed").alias("fixed"))


def regressions(runs: DataFrame, findings: DataFrame, level: str = "error") -> DataFrame:
    """`run_id, fingerprint`: new fingerprints that stand for a finding of the level in their run. A first run has none."""
    done = latest_runs(runs).filter(F.col("fingerprints").isNotNull())
    rows = done.select("run_id", F.explode("fingerprints").alias("fingerprint")).distinct()
    new = run_set_changes(rows, done, "fingerprint").filter("change_kind = 'added'").select("run_id", "fingerprint")
    bad = findings.filter(F.col("severity") == level).select("run_id", fingerprint().alias("fingerprint")).distinct()
    return new.join(bad, ["run_id", "fingerprint"], "left_semi")


def latest_snapshot(runs: DataFrame) -> DataFrame:
    """The last finished run of each source and label."""
    done = latest_runs(runs).filter(F.col("fingerprints").isNotNull())
    return done.groupBy("source", "label").agg(F.max_by("run_id", F.struct("run_ts", "run_id")).alias("run_id"), F.max("run_ts").alias("run_ts"))


def trend(runs: DataFrame) -> DataFrame:
    """What a dashboard draws of each run: its total and the three levels."""
    one = runs.groupBy("run_id").agg(F.max(F.struct("loaded_at", "total", "run_ts", "source", "label", F.map_entries("by_level").alias("levels"))).alias("r")).select("run_id", "r.*")
    n = lambda k: F.coalesce(F.element_at(F.map_from_entries("levels"), k), F.lit(0)).alias(k)
    return one.filter("total IS NOT NULL").select("run_id", "source", "label", F.date_format("run_ts", "dd MMM HH:mm").alias("at"), "total", n("error"), n("warning"), n("suggestion"))


def top_checks(findings: DataFrame, top: int = 12) -> DataFrame:
    n = findings.groupBy("check_id").agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "check_id").limit(top)
