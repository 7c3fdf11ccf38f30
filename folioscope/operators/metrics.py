"""Counts, rates, rankings and reports over alerts, issues and findings."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.core.runtime import broadcast_checked

#: Parts in which the first alerts are sought before they are compared.
PARTS = 64
SEVERITIES = ("error", "warning", "suggestion")


def severity_rank(level: Column) -> Column:
    return F.when(level == "error", 0).when(level == "warning", 1).otherwise(2)


def counts(alerts: DataFrame) -> DataFrame:
    """`rule, severity, area, n, pages` by rule, by severity, by area and in all, in one pass; the keys not counted by are null."""
    return alerts.groupingSets([["rule"], ["severity"], ["area"], []], "rule", "severity", "area").agg(F.count("*").alias("n"), F.countDistinct("page").alias("pages"))


def per_thousand(alerts: DataFrame, words: DataFrame) -> DataFrame:
    """`total, words, per_1k`: alerts per 1,000 words of prose, 0 without words."""
    a = alerts.agg(F.count("*").alias("total"))
    w = words.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("words"))
    return a.crossJoin(w).select("total", "words", F.when(F.col("words") > 0, F.bround(F.col("total") * 1000 / F.col("words"), 2)).otherwise(0.0).alias("per_1k"))


def by_severity(alerts: DataFrame) -> DataFrame:
    """`severity, n` of each of the three severities, those without alerts too."""
    spark = alerts.sparkSession
    domain = spark.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    return domain.join(alerts.groupBy("severity").count(), "severity", "left").select("severity", F.coalesce("count", F.lit(0)).alias("n"))


def ranked(alerts: DataFrame, key: str) -> DataFrame:
    """`key, n, place`: most frequent first, then by name."""
    n = alerts.groupBy(key).agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), key)))


def summary(alerts: DataFrame, links: DataFrame | None = None, top: int = 15) -> tuple[DataFrame, DataFrame]:
    """Alerts by rule, with the rule's link if known, and the pages with most alerts."""
    rule = alerts.groupBy("rule").agg(F.count("*").alias("n"))
    if links is not None:
        rule = rule.join(broadcast_checked(links), "rule", "left")
    pages = alerts.groupBy("page").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "page").limit(top)
    return rule, pages


def annotations(alerts: DataFrame, most: int = 50) -> DataFrame:
    """The first alerts of each severity by page and line, as workflow commands; `suppressed` says how many more there are.

    The first of each of many parts come first, so that no task sorts all alerts of a severity.
    """
    order = ["page", "line", "rule", "found"]
    part = F.pmod(F.xxhash64("page"), F.lit(PARTS)).alias("_part")
    first = alerts.select("*", part).withColumn("place", F.row_number().over(Window.partitionBy("severity", "_part").orderBy(*order))).filter(F.col("place") <= most)
    rows = first.withColumn("place", F.row_number().over(Window.partitionBy("severity").orderBy(*order)))
    command = F.when(F.col("severity") == "error", "error").when(F.col("severity") == "warning", "warning").otherwise("notice")
    safe = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "%", "%25"), "\r", "%0D"), "\n", "%0A")
    said = F.concat(F.lit("::"), command, F.lit(" file="), F.col("page"), F.lit(",line="), F.col("line"), F.lit("::"), F.col("rule"), F.lit(": "), safe(F.col("found")))
    return rows.filter(F.col("place") <= most).select("severity", "page", "line", "rule", "place", said.alias("command"))


def suppressed(alerts: DataFrame, most: int = 50) -> DataFrame:
    """`severity, further`: how many alerts of each severity `annotations` leaves out."""
    return alerts.groupBy("severity").agg(F.greatest(F.count("*") - most, F.lit(0)).alias("further"))


def compared(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """`key, before, after, delta, percent` of the alerts of two states; a key missing on one side counts 0 there."""
    b, a = before.groupBy(key).agg(F.count("*").alias("before")), after.groupBy(key).agg(F.count("*").alias("after"))
    both = b.join(a, key, "full").select(key, F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))
    delta = F.col("after") - F.col("before")
    return both.select("*", delta.alias("delta"), F.when(F.col("before") > 0, F.round(delta * 100 / F.col("before"))).alias("percent"))


def gate(alerts: DataFrame, threshold: str) -> DataFrame:
    """`failing, total`: alerts at least as severe as the threshold."""
    rank = {s: i for i, s in enumerate(SEVERITIES)}[threshold]
    return alerts.agg(F.count_if(severity_rank(F.col("severity")) <= rank).alias("failing"), F.count("*").alias("total"))


def markdown_table(rows: DataFrame, most: int = 200) -> str:
    """A small result as a Markdown table; bars in cells are escaped, and rows beyond `most` counted."""
    taken = rows.limit(most + 1).collect()
    out = ["| " + " | ".join(rows.columns) + " |", "| " + " | ".join("---" for _ in rows.columns) + " |"]
    out += ["| " + " | ".join(str("" if v is None else v).replace("|", "\\|") for v in r) + " |" for r in taken[:most]]
    return "\n".join(out + ([f"(more than {most} rows)"] if len(taken) > most else []))


def sarif_results(alerts: DataFrame) -> DataFrame:
    """`result`: each alert as a SARIF 2.1.0 result in JSON; rows stay distributed until a sink writes them."""
    level = F.when(F.col("severity") == "suggestion", "note").otherwise(F.col("severity"))
    place = F.struct(F.struct(F.struct(F.col("page").alias("uri")).alias("artifactLocation"), F.struct(F.greatest("line", F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))
    text = F.struct(F.concat_ws(": ", "rule", "found").alias("text"))
    return alerts.select(F.to_json(F.struct(F.col("rule").alias("ruleId"), level.alias("level"), text.alias("message"), F.array(place).alias("locations"))).alias("result"))


def sarif(alerts: DataFrame, tool: str, catalog: list[str], most: int = 100_000) -> str:
    """One SARIF document of at most `most` results; larger reports take `sarif_results`."""
    index = {r: i for i, r in enumerate(catalog)}
    results = []
    for r in sarif_results(alerts).limit(most + 1).collect():
        one = json.loads(r["result"])
        if one["ruleId"] in index:
            one["ruleIndex"] = index[one["ruleId"]]
        results.append(one)
    if len(results) > most:
        raise ValueError(f"more than {most} results; write sarif_results() instead")
    run = {"tool": {"driver": {"name": tool, "rules": [{"id": r} for r in catalog]}}, "results": results}
    return json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [run]})
