"""Where pages come from: directories, lists, tables of responses; each source is a function to a DataFrame of `page, text, title, url, revision`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.core.runtime import broadcast_checked
from folioscope.functions import masking as M
from folioscope.operators.html_text import unescape
from folioscope.operators.structure import excluded

PAGE = ["page", "text", "title", "url", "revision"]


def directory(spark: SparkSession, root: str, patterns: tuple[str, ...] = ("*.md", "*.mdx"), exclude: tuple[str, ...] = ()) -> DataFrame:
    """The Markdown files below a directory; the title is the front matter's, else the file's stem."""
    ends = "{" + ",".join(patterns) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", ends).load(root)
    base = root.rstrip("/")
    rel = F.regexp_replace(F.col("path"), "^.*?" + r"\Q" + base.split("://")[-1] + r"\E/?", "")
    rows = files.select(rel.alias("page"), F.decode("content", "UTF-8").alias("text"))
    if exclude:
        rows = rows.filter(~excluded(F.col("page"), exclude))
    stem = F.regexp_replace(F.regexp_extract("page", r"([^/]+)$", 1), r"\.[^.]*$", "")
    return rows.select("page", "text", F.coalesce(M.front_title(F.col("text")), stem).alias("title"), F.lit("").alias("url"), F.lit("").alias("revision"))


def changed(pages: DataFrame, paths: DataFrame) -> DataFrame:
    """Only the pages whose path is in a table of changed paths (`path`)."""
    return pages.join(paths.select(F.col("path").alias("page")).distinct(), "page", "left_semi")


def safe_path(path: Column) -> Column:
    """The path below which a page may be written; null for one that climbs out of the tree. Pages without ending get .md."""
    bare = F.regexp_replace(path, r"^/+|/+$", "")
    bare = F.when(bare == "", "index").otherwise(bare)
    bad = bare.rlike(r"(^|/)\.\.(/|$)")
    return F.when(~bad, F.when(bare.rlike(r"\.mdx?$"), bare).otherwise(F.concat(bare, F.lit(".md"))))


def dotted(record: Column, path: str) -> Column:
    """A field of a JSON record by dotted path; a list on the way stands for its first element."""
    out = record
    for part in path.split("."):
        here = F.get_json_object(out, f"$.{part}")
        out = F.coalesce(F.get_json_object(out, f"$[0].{part}"), here) if part else here
    return out


def api_pages(responses: DataFrame, items: str, fields: dict[str, str]) -> DataFrame:
    """The pages of a content API's responses (`response`, JSON): the items at a dotted path, their fields at others; items without body are left out."""
    each = responses.select(F.explode(F.from_json(F.get_json_object("response", f"$.{items}"), "array<string>")).alias("item"))
    rows = each.select(*[(dotted(F.col("item"), fields[k]) if k in fields else F.lit("")).alias(k) for k in ("id", "title", "body", "url", "revision")])
    return rows.filter(F.trim(F.coalesce("body", F.lit(""))) != "").select(F.col("id").alias("page"), F.col("body").alias("text"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("title", "url", "revision")])


def next_link(responses: DataFrame, path: str) -> DataFrame:
    return responses.select(dotted(F.col("response"), path).alias("next")).filter("next IS NOT NULL")


def sitemap(documents: DataFrame) -> DataFrame:
    """`pos, url` of the locations in sitemap XML (`xml`)."""
    locs = documents.select(F.posexplode(F.regexp_extract_all("xml", F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1))).alias("pos", "loc"))
    return locs.select("pos", unescape(F.col("loc")).alias("url"))


def url_list(lines: DataFrame) -> DataFrame:
    """`pos, url` of a list of URLs (`pos, value`); lines with # are comments."""
    url = F.trim("value")
    return lines.filter((url != "") & ~url.startswith("#")).select("pos", url.alias("url"))


def robots_rules(text: DataFrame) -> DataFrame:
    """`agent, rule, path, crawl_delay` of robots.txt (`value`): consecutive agents share the rules that follow."""
    lines = text.select(F.posexplode(F.split("value", r"\r?\n", -1)).alias("pos", "raw"))
    parts = lines.select("pos", F.lower(F.regexp_extract("raw", r"(?i)^\s*([a-z-]+)\s*:", 1)).alias("key"), F.trim(F.regexp_extract("raw", r"(?i)^\s*[a-z-]+\s*:\s*([^#]*)", 1)).alias("value")).filter("key <> ''")
    order = Window.partitionBy(F.lit(0)).orderBy("pos")  # one small file
    agent = F.col("key") == "user-agent"
    marked = parts.withColumn("starts", (agent & (F.coalesce(F.lag("key").over(order), F.lit("")) != "user-agent")).cast("int")).withColumn("block", F.sum("starts").over(order))
    agents = marked.filter(agent).select("block", F.lower("value").alias("agent"))
    rules = marked.filter(~agent).filter("key IN ('allow', 'disallow', 'crawl-delay')")
    path = F.when(F.col("key") != "crawl-delay", F.col("value"))
    return rules.join(agents, "block").select("agent", F.col("key").alias("rule"), path.alias("path"), F.when(F.col("key") == "crawl-delay", F.col("value").cast("double")).alias("crawl_delay"))


def allowed(urls: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """The URLs that the rules of an agent (else of *) let a crawler fetch: the longest matching path decides, allow wins a tie; no rules allow all."""
    own = rules.filter(F.col("agent") == agent.lower())
    used = own if own.limit(1).count() else rules.filter("agent = '*'")
    used = used.filter("path IS NOT NULL AND path <> ''").select(F.col("path").alias("rule_path"), (F.col("rule") == "allow").alias("allow"))
    path = F.regexp_replace(F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]*([^#]*)", 1), "^$", "/")
    # a rule is met by the prefix of the path that has its length, so any number of rules is an equal join
    lengths = F.broadcast(used.agg(F.collect_set(F.length("rule_path")).alias("_lengths")))  # one row, of as many numbers as there are lengths
    prefixes = F.transform(F.filter("_lengths", lambda n: n <= F.length("_path")), lambda n: F.substring(F.col("_path"), F.lit(1), n))
    each = urls.withColumn("_path", path).crossJoin(lengths).withColumn("rule_path", F.explode_outer(prefixes)).withColumnRenamed("rule_path", "_prefix")
    met = each.join(broadcast_checked(used), F.col("_prefix") == F.col("rule_path"), "left")
    best = met.groupBy(*urls.columns).agg(F.max(F.when(F.col("rule_path").isNotNull(), F.struct(F.length("rule_path").alias("n"), "allow"))).alias("r"))
    return best.filter("r IS NULL OR r.allow").select(*urls.columns)


def url_filter(urls: DataFrame, host: str, include: list[str] = [], exclude: list[str] = [], limit: int | None = None) -> DataFrame:
    """URLs (`pos, url`) of one host that match no exclude pattern and, if there are any, an include pattern; each once, in first order."""
    rows = urls.filter(F.try_parse_url("url", F.lit("AUTHORITY")) == host)
    for p in exclude:
        rows = rows.filter(~F.col("url").rlike(p))
    if include:
        rows = rows.filter(F.col("url").rlike("|".join(f"(?:{p})" for p in include)))
    one = rows.groupBy("url").agg(F.min("pos").alias("pos"))
    return one.orderBy("pos").limit(limit) if limit is not None else one


def crawl(edges: DataFrame, seeds: DataFrame, depth: int = 2, budget: int = 500) -> DataFrame:
    """`url, depth`: what a breadth-first crawl over a table of links (`src, dst`) reaches, nearest first, as far as the budget goes.

    The frontier of each level joins the edges by source; pages seen before are kept out by an anti join. Each level is cut off.
    """
    from folioscope.core.runtime import durable

    seen = durable(seeds.select(F.col("url"), F.lit(0).alias("depth")).distinct())
    frontier = seen
    for level in range(1, depth + 1):
        reached = frontier.select(F.col("url").alias("src")).join(edges, "src").select(F.col("dst").alias("url")).distinct()
        frontier = durable(reached.join(seen, "url", "left_anti").withColumn("depth", F.lit(level)))
        seen = seen.unionByName(frontier)
    return seen.orderBy("depth", "url").limit(budget)


def fetched(responses: DataFrame) -> DataFrame:
    """Pages of stored responses (`url, html, error`): HTML as Markdown, the path of the URL, the first heading as title; a failed fetch is an empty page whose revision says so."""
    from folioscope.operators.html_text import markdown

    path = F.regexp_replace(F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1), "^/+|/+$", "")
    text = markdown(responses.filter("error IS NULL").select(F.col("url").alias("page"), F.col("html").alias("text")))
    met = responses.join(text.withColumnRenamed("page", "url"), "url", "left")
    revision = F.when(F.col("error").isNotNull(), F.concat(F.lit("error: "), "error")).otherwise("")
    return met.select(F.when(path == "", "index").otherwise(path).alias("page"), F.coalesce("markdown", F.lit("")).alias("text"), M.first_heading(F.col("markdown")).alias("title"), "url", revision.alias("revision"))


def alerts_json(files: DataFrame) -> DataFrame:
    """Alerts of a linter's JSON (`value`): a map from page to list of alerts."""
    kind = "map<string, array<struct<Check:string, Severity:string, Message:string, Line:int, Span:array<int>, Match:string, Link:string>>>"
    each = files.select(F.explode(F.from_json("value", kind)).alias("page", "alerts")).select("page", F.explode("alerts").alias("a"))
    return each.select("page", F.col("a.Check").alias("rule"), F.col("a.Severity").alias("severity"), F.col("a.Line").alias("line"), F.col("a.Span").alias("span"), F.col("a.Match").alias("found"), F.col("a.Message").alias("message"), F.col("a.Link").alias("link"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON Lines by a given schema; blank lines, and a path without files, give no rows."""
    try:
        return spark.read.schema(schema).json(path)
    except Exception as e:  # AnalysisException of a missing path
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def history(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The stored run snapshots; files that cannot be read as such are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def source(spark: SparkSession, config: dict, **tables: DataFrame) -> DataFrame:
    """The source that a configuration names. Live fetching is a loader's work; site sources read its tables of responses."""
    kind = config.get("type")
    if kind == "filesystem":
        return directory(spark, config["root"], tuple(config.get("patterns", ("*.md", "*.mdx"))), tuple(config.get("exclude", ())))
    if kind == "cms-api":
        return api_pages(tables["responses"], config["fields"]["items"], config["fields"])
    if kind in ("site-crawl", "rendered-crawl"):
        return fetched(tables["responses"])
    raise ValueError(f"unknown source type {kind!r}")
