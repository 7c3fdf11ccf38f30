"""Claims held against an API's operations: what the API does not know, with a confidence, and what becomes of it.

The index of operations is small (its size is checked where it is built), so the template join is a broadcast join on method and number
of segments with a residual on the segments; the best template is one of the few that match, chosen within the claim's row.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.core.runtime import broadcast_checked

# Confidences and cutoffs
VERB, NEAR_PATH, NO_PATH, INLINE_NEAR, INLINE = 0.9, 0.75, 0.4, 0.45, 0.35
NEAR_PARAMETER, PARAMETER, NEAR_ENUM, ENUM, NO_AUTH, DEPRECATED = 0.85, 0.7, 0.8, 0.6, 0.65, 0.95
PATH_CUTOFF, PARAMETER_CUTOFF, ENUM_CUTOFF = 0.7, 0.82, 0.75
HIGH, MEDIUM, GATE = 0.8, 0.6, 0.6
THIRD_PARTY = r"(?i)(github\.com|githubusercontent\.com|githubassets|gitlab\.com|amazonaws\.com|googleapis\.com|cloudflare\.com|docker\.io|npmjs\.|pypi\.org|crates\.io|PROJECT_URL|ANALYTICS)"
FILE_LIKE = r"(?i)\.(json|toml|yml|yaml|tar\.gz|zip|deb|rpm|exe|sh)$"
FINDING = ["detector", "page", "line", "message", "confidence", "evidence", "suggestion", "needs_review", "base", "origin", "snippet"]


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def templates(operations: DataFrame) -> DataFrame:
    """Operations with the segments of their path and how many of them are literal."""
    segs = segments(F.col("path"))
    return operations.select("*", segs.alias("segs"), F.size(F.filter(segs, lambda s: ~s.rlike(r"^\{.*\}$"))).alias("literal"))


def fits(template: str, concrete: str) -> Column:
    return F.forall(F.zip_with(template, concrete, lambda t, c: t.rlike(r"^\{.*\}$") | (t == c)), lambda ok: ok)


def matched(claims: DataFrame, operations: DataFrame) -> DataFrame:
    """Every claim with `op`, the operation of its method whose template fits best (most literal segments, then the greater path), or null, and `others`, the methods of all fitting templates."""
    ops = templates(operations).select(F.size("segs").alias("_n"), F.struct("literal", "path", "method", "segs", "deprecated", "secured", "security", "query_params", "body_params").alias("o"))
    by_size = broadcast_checked(ops.groupBy("_n").agg(F.collect_list("o").alias("ops")))
    rows = claims.withColumn("_segs", segments(F.col("path"))).withColumn("_n", F.size("_segs")).join(by_size, "_n", "left")
    fit = F.filter(F.coalesce("ops", F.array().cast(by_size.schema["ops"].dataType)), lambda o: F.forall(F.zip_with(o["segs"], F.col("_segs"), lambda t, c: t.rlike(r"^\{.*\}$") | (t == c)), lambda ok: ok))
    rows = rows.withColumn("_fit", fit)
    best = F.array_max(F.filter("_fit", lambda o: o["method"] == F.upper("method")))
    return rows.select(*claims.columns, best.alias("op"), F.array_sort(F.array_distinct(F.transform("_fit", lambda o: o["method"]))).alias("others"))


@F.pandas_udf(T.StringType())
def closest(name: pd.Series, candidates: pd.Series, cutoff: pd.Series) -> pd.Series:
    """The candidate most like the name by matching blocks, from a cutoff on; of equals the greater. Null where there is none."""
    out = []
    for n, c, k in zip(name, candidates, cutoff, strict=True):
        near = difflib.get_close_matches(n, list(c), n=1, cutoff=float(k)) if n is not None and c is not None else []
        out.append(near[0] if near else None)
    return pd.Series(out, dtype="object")


def base_set(claims: DataFrame, servers: list[str]) -> list[str]:
    """The bases that are this API: none at all, its servers, and a placeholder that at least three and half of all endpoint samples use, in its three spellings."""
    n = claims.filter("kind = 'endpoint' AND base <> ''").groupBy("base").agg(F.count("*").alias("n"), F.min(F.struct("page", "line")).alias("first"))
    top = n.withColumn("total", F.sum("n").over(Window.partitionBy())).orderBy(F.desc("n"), "first").limit(1).collect()
    bases = ["", *servers]
    if top and top[0]["n"] >= 3 and 2 * top[0]["n"] >= top[0]["total"]:
        bare = top[0]["base"].strip("${}")
        bases += [top[0]["base"], "${" + bare + "}", "$" + bare]
    return sorted(set(bases))


def in_scope(bases: list[str] | None) -> Column:
    """Whether a claim is about this API; enum values and claims without a base always are."""
    if bases is None:
        return F.lit(True)
    return (F.col("kind") == "enum_value") | F.coalesce(F.col("base") == "", F.lit(True)) | F.col("base").isin(*bases)


def _findings(rows: DataFrame, detector: str, confidence, evidence: Column, message: Column, suggestion: Column, review) -> DataFrame:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return rows.select(F.lit(detector).alias("detector"), "page", "line", message.alias("message"), as_column(confidence).cast("double").alias("confidence"), evidence.alias("evidence"), F.coalesce(suggestion, F.lit("")).alias("suggestion"), as_column(review).alias("needs_review"), "base", "origin", "snippet")


def unknown_endpoints(rows: DataFrame, operations: DataFrame) -> DataFrame:
    paths = operations.groupBy("method").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    lost = rows.filter("kind = 'endpoint' AND op IS NULL").join(broadcast_checked(paths), "method", "left")
    lost = lost.withColumn("near", closest("path", "paths", F.lit(PATH_CUTOFF)))
    inline, verb, near = F.col("origin") == "inline", F.size("others") > 0, F.col("near").isNotNull()
    confidence = F.when(inline & near, INLINE_NEAR).when(inline, INLINE).when(verb, VERB).when(near, NEAR_PATH).otherwise(NO_PATH)
    said = F.concat_ws(" ", "method", "path")
    suggestion = F.when(~inline & verb, F.concat_ws(" ", F.get("others", F.lit(0)), F.col("path"))).when(near, F.concat_ws(" ", "method", "near"))
    message = F.concat(said, F.when(~inline & verb, F.concat(F.lit(" exists only for "), F.array_join("others", ", "))).otherwise(" is not in the index"))
    return _findings(lost, "unknown_endpoint", confidence, said, message, suggestion, inline | (~verb & ~near))


def unknown_parameters(rows: DataFrame) -> DataFrame:
    """An operation without a body schema, or without query parameters, gives no findings: see `abstentions`."""
    known = F.when(F.col("kind") == "body_param", F.col("op.body_params")).otherwise(F.col("op.query_params"))
    bad = rows.filter("kind IN ('body_param', 'query_param') AND op IS NOT NULL").withColumn("known", known).filter((F.size("known") > 0) & ~F.array_contains("known", F.col("name")))
    bad = bad.withColumn("near", closest("name", "known", F.lit(PARAMETER_CUTOFF)))
    evidence = F.concat_ws(" ", "op.method", "op.path", "name")
    return _findings(bad, "unknown_parameter", F.when(F.col("near").isNotNull(), NEAR_PARAMETER).otherwise(PARAMETER), evidence, F.concat("name", F.lit(" is no parameter of "), F.concat_ws(" ", "op.method", "op.path")), F.col("near"), False)


def unknown_enum_values(claims: DataFrame, enums: DataFrame) -> DataFrame:
    bad = claims.filter("kind = 'enum_value'").join(broadcast_checked(enums), "field").filter((F.size("allowed") > 0) & ~F.array_contains("allowed", F.col("value")))
    bad = bad.withColumn("near", closest("value", "allowed", F.lit(ENUM_CUTOFF)))
    return _findings(bad, "unknown_enum_value", F.when(F.col("near").isNotNull(), NEAR_ENUM).otherwise(ENUM), F.concat_ws("=", "field", "value"), F.concat("value", F.lit(" is no value of "), "field"), F.col("near"), F.col("near").isNull())


def missing_auth(rows: DataFrame) -> DataFrame:
    bad = rows.filter("kind = 'auth' AND NOT coalesce(has_auth, false) AND op.secured")
    key = F.concat_ws(" ", "op.method", "op.path")
    return _findings(bad, "missing_auth", NO_AUTH, key, F.concat(key, F.lit(" needs authorization: "), F.when(F.size("op.security") > 0, F.array_join("op.security", ", ")).otherwise("a key")), F.lit(""), True)


def deprecated_endpoints(rows: DataFrame) -> DataFrame:
    key = F.concat_ws(" ", "op.method", "op.path")
    return _findings(rows.filter("kind = 'endpoint' AND op.deprecated"), "deprecated_endpoint", DEPRECATED, key, F.concat(key, F.lit(" is deprecated")), F.lit(""), False)


def findings(claims: DataFrame, operations: DataFrame, enums: DataFrame, bases: list[str] | None = None) -> DataFrame:
    """All findings, one per (page, line, detector, evidence). `claims` is used several times; cut its lineage before, where it is costly."""
    scoped = claims.filter(in_scope(bases))
    rows = matched(scoped, operations)
    parts = [unknown_endpoints(rows, operations), unknown_parameters(rows), unknown_enum_values(scoped, enums), missing_auth(rows), deprecated_endpoints(rows)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    rest = [c for c in FINDING if c not in ("page", "line", "detector", "evidence")]
    # the most trusted of equal findings, for a defined result in any order of rows
    first = every.groupBy("page", "line", "detector", "evidence").agg(F.max(F.struct("confidence", *[c for c in rest if c != "confidence"])).alias("f"))
    return first.select(*[F.col(c) if c not in rest else F.col(f"f.{c}").alias(c) for c in FINDING])


def abstentions(rows: DataFrame) -> DataFrame:
    """`page, line, reason` of parameter claims whose operation does not describe that side."""
    asked = rows.filter("kind IN ('body_param', 'query_param') AND op IS NOT NULL")
    body = F.col("kind") == "body_param"
    silent = asked.filter(F.size(F.when(body, F.col("op.body_params")).otherwise(F.col("op.query_params"))) == 0)
    return silent.select("page", "line", F.concat_ws(" ", "op.method", "op.path", F.when(F.col("kind") == "body_param", "has no body schema").otherwise("declares no query parameters")).alias("reason")).distinct()


def severity(confidence: Column) -> Column:
    return F.when(confidence >= HIGH, "high").when(confidence >= MEDIUM, "medium").otherwise("low")


def gated(found: DataFrame, least: float = GATE) -> DataFrame:
    """Findings with their severity and whether they pass the gate or wait for review."""
    return found.withColumn("severity", severity(F.col("confidence"))).withColumn("gated", F.col("confidence") >= least)


def unified(found: DataFrame, least: float = GATE) -> DataFrame:
    """`kind, check_id, page, line, level, message`, as all checks report to a run."""
    level = F.when((F.col("confidence") >= least) & (F.col("confidence") >= HIGH), "error").when(F.col("confidence") >= least, "warning").otherwise("suggestion")
    return found.select(F.lit("freshness").alias("kind"), F.col("detector").alias("check_id"), "page", F.col("line").cast("int").alias("line"), level.alias("level"), "message")


def heuristic_verdict() -> Column:
    """A verdict on findings that need review; null abstains."""
    no = lambda confidence, why: F.struct(F.lit(False).alias("actionable"), F.lit(confidence).alias("confidence"), F.lit(why).alias("reason"))
    return (
        F.when(~F.col("needs_review"), None)
        .when((F.col("base") != "") & F.col("base").rlike(THIRD_PARTY), no(0.9, "another host"))
        .when(F.col("evidence").rlike(FILE_LIKE), no(0.8, "a file"))
        .when((F.col("snippet") != "") & F.col("snippet").rlike(THIRD_PARTY), no(0.7, "names another host"))
    )


def context(found: DataFrame, pages: DataFrame, radius: int = 12) -> DataFrame:
    """Findings with the lines around them."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    start = F.greatest(F.col("line") - radius, F.lit(1))
    around = F.array_join(F.slice(lines, start, F.greatest(F.col("line") + radius - start + 1, F.lit(0)).cast("int")), "\n")
    return found.join(pages.select("page", "text"), "page", "left").withColumn("context", around).drop("text")


def verdict_key(model: Column) -> Column:
    """24 hexadecimal digits that stand for a finding and its context in a cache of verdicts."""
    return F.substring(F.sha2(F.to_json(F.struct("context", "detector", "evidence", "message", model.alias("model"))), 256), 1, 24)


def recorded(found: DataFrame, verdicts: DataFrame, model: str) -> DataFrame:
    """Findings with `verdict` from a table (key, actionable, confidence, reason); those not in it abstain."""
    keyed = found.withColumn("key", F.when(F.col("needs_review"), verdict_key(F.lit(model))))
    known = verdicts.select("key", F.struct("actionable", "confidence", "reason").alias("verdict"))
    return keyed.join(known, "key", "left").drop("key")


def applied(judged: DataFrame) -> DataFrame:
    """The findings that survive their `verdict`: actionable ones with the greater confidence and no more review, undecided ones as they are."""
    yes = F.col("verdict").isNotNull() & F.col("verdict.actionable")
    kept = judged.filter(F.col("verdict").isNull() | F.col("verdict.actionable"))
    said = F.when(yes, F.concat("message", F.lit(" [reviewed: "), "verdict.reason", F.lit("]"))).otherwise(F.col("message"))
    return kept.select(*[{"confidence": F.when(yes, F.greatest("confidence", "verdict.confidence")).otherwise(F.col("confidence")), "needs_review": F.col("needs_review") & ~yes, "message": said}.get(c, F.col(c)).alias(c) for c in FINDING])


def verdict_counts(judged: DataFrame) -> DataFrame:
    yes, no = F.coalesce("verdict.actionable", F.lit(False)), F.col("verdict").isNotNull() & ~F.coalesce("verdict.actionable", F.lit(True))
    return judged.agg(F.count_if(F.col("verdict").isNotNull()).alias("reviewed"), F.count_if(yes).alias("kept"), F.count_if(no).alias("dropped"), F.count_if(F.col("verdict").isNull()).alias("abstained"))
