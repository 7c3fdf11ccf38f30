"""How well findings meet expectations: precision and recall, sweeps over thresholds, floors, constructed defects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values
THRESHOLDS = (0.0, 0.35, 0.45, 0.6, 0.7, 0.8, 0.9)
EPSILON = 1e-9
KINDS = ("rename_body_param", "change_http_verb", "move_route", "drop_enum_value", "strip_auth_header")


def rates(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall, f1; 0 where there is nothing to divide by."""
    part = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = part(tp, tp + fp), part(tp, tp + fn)
    return [F.bround(p, 4).alias("precision"), F.bround(r, 4).alias("recall"), F.bround(part(2 * p * r, p + r), 4).alias("f1")]


def outcomes(produced: DataFrame, expected: DataFrame, keys: list[str], keep: list[str] = []) -> DataFrame:
    """Every key that was produced or expected, once, with `produced` and `expected`; `keep` columns come from either side."""
    p = produced.groupBy(*keys).agg(F.lit(True).alias("produced"), *[F.max(c).alias(f"p_{c}") for c in keep if c in produced.columns])
    e = expected.groupBy(*keys).agg(F.lit(True).alias("expected"), *[F.max(c).alias(f"e_{c}") for c in keep if c in expected.columns])
    met = p.join(e, keys, "full")
    kept = [F.coalesce(*[F.col(f"{s}_{c}") for s in ("p", "e") if f"{s}_{c}" in met.columns]).alias(c) for c in keep]
    return met.select(*keys, F.coalesce("produced", F.lit(False)).alias("produced"), F.coalesce("expected", F.lit(False)).alias("expected"), *kept)


def scores(met: DataFrame, *by: str) -> DataFrame:
    """`*by, tp, fp, fn, precision, recall, f1`; the counts add up over groups."""
    hit, no = F.col("produced") & F.col("expected"), F.col("produced") & ~F.col("expected")
    n = met.groupBy(*by).agg(F.count_if(hit).alias("tp"), F.count_if(no).alias("fp"), F.count_if(F.col("expected") & ~F.col("produced")).alias("fn"))
    return n.select(*by, "tp", "fp", "fn", *rates(F.col("tp"), F.col("fp"), F.col("fn")))


def sweep(met: DataFrame, confidence: str = "confidence", thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """`threshold, reported, tp, fp, fn, precision, recall, f1`, all thresholds in one pass."""
    each = met.select("*", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    shown = F.col("produced") & (F.coalesce(confidence, F.lit(0.0)) + EPSILON >= F.col("threshold"))
    n = each.groupBy("threshold").agg(F.count_if(shown).alias("reported"), F.count_if(shown & F.col("expected")).alias("tp"), F.count_if(shown & ~F.col("expected")).alias("fp"), F.count_if(F.col("expected") & ~shown).alias("fn"))
    return n.select("threshold", "reported", "tp", "fp", "fn", *rates(F.col("tp"), F.col("fp"), F.col("fn")))


def below_floors(measured: DataFrame, floors: DataFrame) -> DataFrame:
    """Floors (`arm, metric_set, metric, floor`) that the measured `value` does not reach; a metric that was not measured counts as 0."""
    keys = ["arm", "metric_set", "metric"]
    met = floors.join(measured, keys, "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    return met.filter(F.col("value") + EPSILON < F.col("floor")).select(*keys, "floor", "value")


def beyond_baseline(found: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """Findings on changed pages that the unchanged pages do not have."""
    return found.join(baseline.select(*keys).distinct(), keys, "left_anti")


def snake(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"(?<=[a-z0-9])([A-Z])", "_$1"))


def replace_first(text: Column, old: Column, new: Column) -> Column:
    """The text with the first occurrence of `old` replaced; as it is where there is none."""
    at = F.position(old, text)
    return F.when(at > 0, F.overlay(text, new, at, F.length(old))).otherwise(text)


def mutations(claims: DataFrame, pages: DataFrame, per_kind: int = 4, seed: int = 42) -> DataFrame:
    """`name, detector, page, line, before, after, text` of constructed defects: per kind a number of pages, chosen by a hash of page and seed, each page once.

    Renamed body fields (camelCase to snake_case, else `_v2`), changed verbs, routes moved below /v2, enum values with `_legacy`, and
    removed authorization headers; the first place in the page changes.
    """
    body, endpoint = F.col("kind") == "body_param", F.col("kind") == "endpoint"
    kind = F.when(body, KINDS[0]).when(F.col("kind") == "enum_value", KINDS[3])
    flipped = F.when(F.col("method") == "POST", "PUT").when(F.col("method") == "PUT", "POST").when(F.col("method") == "GET", "POST").when(F.col("method") == "PATCH", "PUT").otherwise("GET")
    made = F.when(endpoint, F.array(*[F.lit(k) for k in (KINDS[1], KINDS[2], KINDS[4])])).when(kind.isNotNull(), F.array(kind))
    each = claims.filter("origin = 'curl'").withColumn("name_", F.explode(made))
    each = each.filter((F.col("name_") != KINDS[4]) | F.col("has_auth"))
    renamed = F.when(snake(F.col("name")) != F.col("name"), snake(F.col("name"))).otherwise(F.concat("name", F.lit("_v2")))
    before = F.when(body, F.concat(F.lit('"'), "name", F.lit('"'))).when(F.col("name_") == KINDS[3], F.concat(F.lit("`"), "value", F.lit("`"))).when(F.col("name_") == KINDS[1], F.concat(F.lit("-X "), "method")).when(F.col("name_") == KINDS[2], F.col("path")).otherwise("Authorization:")
    after = F.when(body, F.concat(F.lit('"'), renamed, F.lit('"'))).when(F.col("name_") == KINDS[3], F.concat(F.lit("`"), "value", F.lit("_legacy`"))).when(F.col("name_") == KINDS[1], F.concat(F.lit("-X "), flipped)).when(F.col("name_") == KINDS[2], F.concat(F.lit("/v2"), "path")).otherwise("X-Removed:")
    detector = F.when(body, "unknown_parameter").when(F.col("name_") == KINDS[3], "unknown_enum_value").when(F.col("name_") == KINDS[4], "missing_auth").otherwise("unknown_endpoint")
    rows = each.select(F.col("name_").alias("name"), detector.alias("detector"), "page", "line", before.alias("before"), after.alias("after"), F.xxhash64("page", F.lit(seed)).alias("order_"))
    # only places where the text to change stands count towards a kind's number
    rows = rows.join(pages.select("page", "text"), "page").filter(F.col("text").contains(F.col("before"))).drop("text")
    one = rows.groupBy("page").agg(F.min(F.struct(F.xxhash64("name", "order_").alias("h"), "name", "detector", "line", "before", "after", "order_")).alias("m")).select("page", "m.*")
    ranked = one.withColumn("place", F.row_number().over(Window.partitionBy("name").orderBy("order_", "page"))).filter(F.col("place") <= per_kind)
    met = ranked.join(pages.select("page", "text"), "page")
    return met.select("name", "detector", "page", "line", "before", "after", replace_first(F.col("text"), F.col("before"), F.col("after")).alias("text"))
