"""HTML, links, sources and sites, over all pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import masking as M
from folioscope.operators import html_text as H
from folioscope.operators import style
from folioscope.plans.common import PAGES, doc_pages, values
from folioscope.sources import pages as P


def html_markdown(spark, sf_dir):
    return H.markdown(doc_pages(spark, sf_dir))


def html_links(spark, sf_dir):
    return H.links(doc_pages(spark, sf_dir).filter("url IS NOT NULL")).groupBy("page", "link").agg(F.count("*").alias("n"))


def html_budget(spark, sf_dir):
    return H.budget(doc_pages(spark, sf_dir))


def html_diagnosis(spark, sf_dir):
    return H.diagnosis(doc_pages(spark, sf_dir))


def html_main(spark, sf_dir):
    return H.main_elements(doc_pages(spark, sf_dir)).select("page", "via", "chars")


def html_islands(spark, sf_dir):
    return H.best_text(doc_pages(spark, sf_dir))


def html_payloads(spark, sf_dir):
    return H.payloads(doc_pages(spark, sf_dir))


def page_first_heading(spark, sf_dir):
    return doc_pages(spark, sf_dir).select("page", M.first_heading(F.col("text")).alias("heading"), M.front_title(F.col("text")).alias("front"))


def page_areas(spark, sf_dir):
    return doc_pages(spark, sf_dir).groupBy(style.area(F.regexp_replace("path", "^v1/", "")).alias("area")).agg(F.count("*").alias("n"))


def url_filter(spark, sf_dir):
    urls = doc_pages(spark, sf_dir).filter("url IS NOT NULL").select(F.split_part("page", F.lit("#"), F.lit(-1)).cast("bigint").alias("pos"), "url")
    return P.url_filter(urls, "docs.zigralo.example", include=["/v1/"], exclude=["/faq/", r"\?"])


def link_crawl(spark, sf_dir):
    """A crawl over the links between sections: from the shortest path, over links that the pages' own texts hold."""
    found = H.links(doc_pages(spark, sf_dir).filter("url IS NOT NULL"))
    edges = found.select(F.regexp_replace("url", r"^[a-z]+://[^/]*|[?#].*$", "").alias("src"), F.regexp_replace("link", r"^[a-zA-Z]+://[^/]*", "").alias("dst")).distinct()
    start = edges.agg(F.min("src").alias("url"))
    return P.crawl(edges, start, depth=2, budget=500)


XML = [('<urlset><url><loc> https://x.example/a </loc></url><url><loc>https://x.example/b?x=1&amp;y=2</loc></url></urlset>',)]
ROBOTS = [("User-agent: *\nDisallow: /v1/faq\nAllow: /v1/faq/choose\nDisallow: /v1/learn/\n\nUser-agent: Bot\nUser-agent: Other\nCrawl-delay: 2\nDisallow: /\n",)]


def sitemap(spark, sf_dir):
    return P.sitemap(spark.createDataFrame(XML, "xml string"))


def robots_rules(spark, sf_dir):
    return P.robots_rules(spark.createDataFrame(ROBOTS, "value string"))


def robots_allowed(spark, sf_dir):
    return P.allowed(doc_pages(spark, sf_dir).filter("url IS NOT NULL").select("page", "url"), robots_rules(spark, sf_dir), "mine")


API = [('{"data": {"items": [{"id": "1", "attributes": {"title": "A", "body": "text a"}}, {"id": "2", "attributes": [{"title": "B", "body": "text b"}]}, {"id": "3", "attributes": {"title": "C", "body": " "}}]}, "links": {"next": "https://x.example/2"}}',)]


def api_pages(spark, sf_dir):
    fields = {"id": "id", "title": "attributes.title", "body": "attributes.body"}
    return P.api_pages(spark.createDataFrame(API, "response string"), "data.items", fields)


def safe_paths(spark, sf_dir):
    return doc_pages(spark, sf_dir).select("page", P.safe_path(F.col("path")).alias("file"))


QUERIES = {f.__name__: f for f in (html_markdown, html_main, html_links, html_budget, html_diagnosis, html_islands, html_payloads, page_first_heading, page_areas, url_filter, link_crawl, sitemap, robots_rules, robots_allowed, api_pages, safe_paths)}

SQL = {
    "html_budget": f"""WITH {PAGES}, b AS (SELECT page, length(text) AS total, list_sum(list_transform(regexp_extract_all(text, '(?is)<script\\b([^>]*)>(.*?)</script>', 2), lambda s: length(s))) AS js,
        list_sum(list_transform(regexp_extract_all(text, '(?is)<style\\b[^>]*>(.*?)</style>', 1), lambda s: length(s))) AS css FROM pg)
        SELECT page, CAST(total AS INT) AS total, CAST(coalesce(js, 0) AS INT) AS inline_script, CAST(coalesce(css, 0) AS INT) AS inline_style, CAST(greatest(total - coalesce(js, 0) - coalesce(css, 0), 0) AS INT) AS markup FROM b""",
    "page_first_heading": f"""WITH {PAGES} SELECT page, nullif(regexp_extract(text, '(?m)^#{{1,6}}[ \\t]+(\\S.*?)[ \\t]*#*[ \\t\\r]*$', 1), '') AS heading,
        nullif(trim(regexp_extract(regexp_extract(text, '(?s)\\A---\\n(.*?)\\n---\\n', 1), '(?m)^title:[ \\t]*(\\S.*?)[ \\t\\r]*$', 1), '"'''), '') AS front FROM pg""",
    "page_areas": f"WITH {PAGES}, a AS (SELECT regexp_replace(path, '^v1/', '') AS p FROM pg) SELECT CASE WHEN instr(p, '/') > 0 THEN split_part(p, '/', 1) ELSE '(root)' END AS area, count(*) AS n FROM a GROUP BY 1",
    "url_filter": f"WITH {PAGES} SELECT url, min(CAST(split_part(page, '#', -1) AS BIGINT)) AS pos FROM pg WHERE regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1) = 'docs.zigralo.example' AND NOT regexp_matches(url, '/faq/') AND NOT regexp_matches(url, '\\?') AND regexp_matches(url, '/v1/') GROUP BY url",
    "sitemap": f"WITH {values('x', 'xml', XML)}, l AS (SELECT regexp_extract_all(xml, '(?is)<loc>\\s*(.*?)\\s*</loc>', 1) AS u FROM x) SELECT CAST(generate_subscripts(u, 1) - 1 AS INT) AS pos, replace(unnest(u), '&amp;', '&') AS url FROM l",
    "robots_allowed": f"WITH {PAGES}, u AS (SELECT page, url, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^#]*)', 1) AS p FROM pg WHERE url IS NOT NULL) SELECT page, url FROM u WHERE NOT starts_with(p, '/v1/learn/') AND (NOT starts_with(p, '/v1/faq') OR starts_with(p, '/v1/faq/choose'))",
    "safe_paths": f"WITH {PAGES} SELECT page, CASE WHEN regexp_matches(path, '\\.mdx?$') THEN path ELSE path || '.md' END AS file FROM pg",
    "html_payloads": f"""WITH {PAGES}, t AS (SELECT page, unnest(regexp_extract_all(text, '(?is)<script\\b([^>]*)>(.*?)</script>', 1)) AS attrs, unnest(regexp_extract_all(text, '(?is)<script\\b([^>]*)>(.*?)</script>', 2)) AS body FROM pg)
        SELECT page, coalesce(nullif(regexp_extract(attrs, 'id="([^"]+)"', 1), ''), nullif(regexp_extract(body, 'window\\.(\\w+)\\s*=', 1), ''), nullif(regexp_extract(body, '^\\s*var (\\w+)\\s*=', 1), ''), '(anonymous)') AS name, CAST(length(body) AS INT) AS size,
        regexp_matches(body, '^\\s*[\\[{{]') OR regexp_matches(body, '=\\s*[{{\\[]') AS json_like FROM t WHERE trim(body) <> ''""",
    "api_pages": f"""WITH {values('r', 'response', API)}, i AS (SELECT unnest(CAST(json_extract(response, '$.data.items') AS JSON[])) AS item FROM r),
        f AS (SELECT item->>'$.id' AS page, coalesce(item->>'$.attributes.body', item->>'$.attributes[0].body') AS text, coalesce(item->>'$.attributes.title', item->>'$.attributes[0].title') AS title FROM i)
        SELECT page, text, title, '' AS url, '' AS revision FROM f WHERE trim(text) <> ''""",
    "robots_rules": "SELECT * FROM (VALUES ('*', 'disallow', '/v1/faq', NULL), ('*', 'allow', '/v1/faq/choose', NULL), ('*', 'disallow', '/v1/learn/', NULL), ('bot', 'crawl-delay', NULL, CAST(2 AS DOUBLE)), ('other', 'crawl-delay', NULL, CAST(2 AS DOUBLE)), ('bot', 'disallow', '/', NULL), ('other', 'disallow', '/', NULL)) t(agent, rule, path, crawl_delay)",
}
