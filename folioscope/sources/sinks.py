"""Where results go: tables and JSON written by the executors, and small reports rendered from bounded aggregates."""

from __future__ import annotations

import html
import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators.drift import severity

MOST_ROWS = 300


def write_history(snapshot: DataFrame, path: str, by: str = "run_id") -> None:
    """Appends run snapshots to the history table, partitioned by run."""
    snapshot.write.mode("append").partitionBy(by).parquet(path)


def write_texts(pages: DataFrame, path: str) -> None:
    """Remediated or mutated pages as Parquet; a tree of files is for small corpora, and a table serves the next job."""
    pages.write.mode("overwrite").parquet(path)


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def findings_json(found: DataFrame) -> DataFrame:
    """`value`: each finding as a JSON object with its severity."""
    return found.withColumn("severity", severity(F.col("confidence"))).select(F.to_json(F.struct("*")).alias("value"))


def findings_sarif(found: DataFrame) -> DataFrame:
    """`result`: each finding as a SARIF 2.1.0 result; high is an error, medium a warning, low a note."""
    level = F.when(severity(F.col("confidence")) == "high", "error").when(severity(F.col("confidence")) == "medium", "warning").otherwise("note")
    place = F.struct(F.struct(F.struct(F.col("page").alias("uri")).alias("artifactLocation"), F.struct(F.greatest("line", F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))
    return found.select(F.to_json(F.struct(F.col("detector").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"))).alias("result"))


def nice_ceiling(value: float) -> float:
    """The end of an axis: 1, 2, 2.5 or 5 times a power of ten, at least the value."""
    if value <= 0:
        return 1
    power = 10 ** math.floor(math.log10(value))
    return next(step * power for step in (1, 2, 2.5, 5, 10) if step * power >= value)


def compact(n: float) -> str:
    """1234 as 1.2k."""
    return f"{n / 1000:.1f}k".replace(".0k", "k") if abs(n) >= 1000 else f"{n:g}"


def dashboard(trend: DataFrame, checks: DataFrame, findings: DataFrame, most: int = MOST_ROWS) -> str:
    """One HTML page: the last run's figures, the trend from two runs on, the most frequent checks, and the first findings.

    `trend` is one source and label, as `runs.trend` gives it, and all of its runs are shown. Of checks and findings only bounded heads come to the driver.
    """
    runs = [r.asDict() for r in trend.orderBy("run_id").collect()]
    bars = [r.asDict() for r in checks.limit(12).collect()]
    rows = [r.asDict() for r in findings.limit(most).collect()]
    cell = lambda v: f"<td>{html.escape(str('' if v is None else v))}</td>"
    out = ["<!DOCTYPE html><html><head><meta charset='utf-8'><title>Documentation quality</title></head><body>"]
    if runs:
        out.append("<p>" + " · ".join(f"{k}: {compact(runs[-1][k] or 0)}" for k in ("total", "error", "warning", "suggestion")) + "</p>")
    if len(runs) > 1:
        top = nice_ceiling(max(r["total"] or 0 for r in runs))
        points = " ".join(f"{600 * i / (len(runs) - 1):.1f},{200 - 200 * (r['total'] or 0) / top:.1f}" for i, r in enumerate(runs))
        out.append(f"<svg width='600' height='200' role='img' aria-label='findings by run, up to {compact(top)}'><polyline fill='none' stroke='currentColor' points='{points}'/></svg>")
    widest = max((b["n"] for b in bars), default=1)
    out.append("<table>" + "".join(f"<tr>{cell(b['check_id'])}<td><meter min='0' max='{widest}' value='{b['n']}'></meter> {compact(b['n'])}</td></tr>" for b in bars) + "</table>")
    if rows:
        out.append("<table><tr>" + "".join(f"<th>{html.escape(k)}</th>" for k in rows[0]) + "</tr>" + "".join("<tr>" + "".join(map(cell, r.values())) + "</tr>" for r in rows) + "</table>")
    return "\n".join([*out, "</body></html>"])


def index_json(pages: DataFrame) -> DataFrame:
    """`value`: what a staged tree's index says of each page: its file, title, url and revision."""
    from folioscope.sources.pages import safe_path

    return pages.select(F.to_json(F.struct(safe_path(F.col("page")).alias("file"), "title", "url", "revision")).alias("value")).filter(F.get_json_object("value", "$.file").isNotNull())


def report_json(counts: dict) -> str:
    return json.dumps(counts, sort_keys=True, indent=2)
