"""Claims that pages make about an API: endpoints, authorization, parameters and enum values."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import masking as M
from folioscope.functions import shell

SCHEMA = "kind string, page string, line int, method string, path string, name string, base string, origin string, value string, field string, snippet string, has_auth boolean"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
ROUTE = r"`(?:GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+/[A-Za-z0-9_{}/:.-]*`"
MARKER = r"<RouteHighlighter\b[^>]*?method=[\"'][A-Z]+[\"'][^>]*?path=[\"']/[^\"']*[\"'][^>]*?/?>"
ENUM_ROW = r"^\|\s*`([A-Za-z_][\w.\[\]-]*)`\s*\|(.*)\|\s*$"
# Words of a type column, which are no enum members
TYPE_WORDS = ["string", "integer", "int", "number", "float", "boolean", "bool", "array", "object", "null", "none", "any", "date", "datetime", "uuid", "n/a", "-"]


def _curl(batches):
    for batch in batches:
        out = {c: [] for c in COLUMNS}

        def put(**row):
            for c in COLUMNS:
                out[c].append(row.get(c, "" if c not in ("has_auth", "line") else None))

        for page, text in zip(batch.column("page").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for line, snippet, r in shell.calls(text or ""):
                same = {"page": page, "line": line, "method": r["method"], "path": r["path"], "base": r["base"], "origin": "curl", "snippet": snippet}
                auth = any(h.lower().startswith("authorization:") for h in r["headers"])
                put(kind="endpoint", has_auth=auth, **same)
                put(kind="auth", has_auth=auth, **same)
                for key in shell.query_keys(r["query"]):
                    put(kind="query_param", name=key, **same)
                for key in shell.body_keys(r["body"]) if r["body"] else []:
                    put(kind="body_param", name=key, **same)
        kinds = {"line": pa.int32(), "has_auth": pa.bool_()}
        yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(c, pa.string())) for c, v in out.items()], names=COLUMNS)


def curl_claims(pages: DataFrame) -> DataFrame:
    """Claims of the curl calls in a page's shell samples. The filter before Python keeps pages without a call out of it."""
    return pages.select("page", "text").filter(F.col("text").contains("curl")).mapInArrow(_curl, SCHEMA)


def _claim(rows: DataFrame, **values: Column) -> DataFrame:
    given = {"page": F.col("page"), "line": F.col("line").cast("int"), "has_auth": F.lit(None).cast("boolean")} | values
    return rows.select(*[given.get(c, F.lit("")).alias(c) for c in COLUMNS])


def _bare_path(path: Column) -> Column:
    short = F.regexp_replace(path, "/+$", "")
    return F.when(short == "", "/").otherwise(short)


def route_claims(pages: DataFrame) -> DataFrame:
    """Routes in code spans anywhere in the body, and route markers anywhere in the page; both without a base."""
    bare = M.once(pages.select("page", "text"), body=M.body(F.col("text")), offset=M.body_offset(F.col("text")))
    lines = bare.select("page", "offset", F.posexplode(F.split("body", "\n", -1)).alias("i", "raw")).filter(F.col("raw").rlike(ROUTE))
    spans = lines.select("page", (F.col("i") + 1 + F.col("offset")).alias("line"), F.explode(F.regexp_extract_all("raw", F.lit(ROUTE), F.lit(0))).alias("span"))
    inline = _claim(spans, kind=F.lit("endpoint"), origin=F.lit("inline"), method=F.regexp_extract("span", r"`([A-Z]+)", 1), path=_bare_path(F.regexp_extract("span", r"\s(/[^`]*)`", 1)), snippet=F.col("span"))
    marked = pages.filter(F.col("text").contains("<RouteHighlighter")).select("page", F.posexplode(M.protected(F.col("text"), MARKER)).alias("i", "tag"), M.editable(F.col("text"), MARKER).alias("parts"))
    before = F.aggregate(F.slice("parts", 1, F.col("i") + 1), F.lit(0), lambda n, p: n + M.newlines(p)) + 1
    tags = marked.select("page", before.alias("line"), "tag")
    return inline.unionByName(_claim(tags, kind=F.lit("endpoint"), origin=F.lit("route_marker"), method=F.regexp_extract("tag", r"method=[\"']([A-Z]+)", 1), path=_bare_path(F.regexp_extract("tag", r"path=[\"'](/[^\"']*)", 1)), snippet=F.substring("tag", 1, 160)))


def enum_candidate(field: Column, value: Column) -> Column:
    """Whether a code span in a field's table row can be one of its values: no setting path, type, number or the field's own name."""
    own, v = F.lower(field), F.lower(value)
    itself = (v == own) | (v == F.concat(own, F.lit("s"))) | (v == F.concat(own, F.lit("es"))) | (F.concat(v, F.lit("s")) == own) | (F.concat(v, F.lit("es")) == own)
    shaped = (value != "") & (F.length(value) <= 32) & ~value.rlike(r"[\s(){}\[\]:,/=.]") & ~value.rlike(r"^[-+]?\d+(\.\d+)?$")
    return shaped & ~v.isin(*TYPE_WORDS) & ~itself


def enum_claims(pages: DataFrame) -> DataFrame:
    """Code spans in the other cells of a table row whose first cell is a field in a code span; links are taken out before."""
    bare = M.once(pages.select("page", "text").filter(F.col("text").contains("|")), body=M.body(F.col("text")), offset=M.body_offset(F.col("text")))
    lines = bare.select("page", "offset", F.posexplode(F.split("body", "\n", -1)).alias("i", "raw")).filter(F.col("raw").rlike(ENUM_ROW))
    rest = F.regexp_replace(F.regexp_extract("raw", ENUM_ROW, 2), r"\[[^\]]*\]\([^)]*\)", " ")
    spans = lines.select("page", (F.col("i") + 1 + F.col("offset")).alias("line"), "raw", F.regexp_extract("raw", ENUM_ROW, 1).alias("field"), F.explode(F.regexp_extract_all(rest, F.lit("`([^`]+)`"), F.lit(1))).alias("span"))
    spans = spans.withColumn("value", F.trim("span")).filter(enum_candidate(F.col("field"), F.col("value")))
    return _claim(spans, kind=F.lit("enum_value"), origin=F.lit("curl"), field=F.col("field"), value=F.col("value"), snippet=F.substring("raw", 1, 160))


def claims(pages: DataFrame) -> DataFrame:
    """All claims of all pages (`page`, `text`); null texts make none."""
    pages = pages.filter(F.col("text").isNotNull())
    return curl_claims(pages).unionByName(route_claims(pages)).unionByName(enum_claims(pages))


def suggested_bases(found: DataFrame) -> DataFrame:
    """`base, n, share` of the endpoints' bases, most frequent first."""
    n = found.filter("kind = 'endpoint'").groupBy("base").agg(F.count("*").alias("n"))
    return n.crossJoin(n.agg(F.sum("n").alias("total"))).select("base", "n", (F.col("n") / F.col("total")).alias("share"))
