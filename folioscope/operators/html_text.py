"""HTML pages as Markdown, texts in their inline JSON, their links and what their bytes are spent on; all in built-in functions but
entities beyond the common ones and the walk through JSON."""

from __future__ import annotations

import html
import json
from html.parser import HTMLParser
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions import masking as M

# Fixed values --------------------------------------------------------------------------------------------------------------------
DROPPED = ("script", "style", "nav", "header", "footer")
# of prose within data: least length, least share of blanks, what is telling, what is data whatever its length; how many texts a page gives
LEAST_LENGTH, LEAST_BLANKS, MOST_TEXTS, SAME_PREFIX = 80, 0.05, 40, 200
PROSE = r"(?m)(^#{1,6}\s|\n\n|```|\. [A-Z]|, |\bthe\b|\byou\b)"
MACHINE = r"^(?:https?://|/|[A-Za-z0-9+/=]{60,}$|[0-9a-f]{32,}$|\{|\[|#[0-9a-f]{3,8}$)"
# of a page without much text: words and words a kilobyte of a readable one, a payload's size, a stub's size, signs of a gate and of an app shell
OK_WORDS, OK_DENSITY, BIG_PAYLOAD, SMALL_PAGE, BUNDLES = 150, 4.0, 20_000, 5_000, 3
BLOCKED = r"(?i)(just a moment|checking your browser|attention required|access denied|captcha|cf-chl|cf-browser-verification|ddos protection|request blocked|enable javascript (?:and cookies )?to continue|are you a robot)"
APP_ROOT = r"""(?i)<div[^>]+id=["'](root|__next|app|__nuxt|svelte)["']"""
SCRIPT = r"(?is)<script\b([^>]*)>(.*?)</script>"
STYLE = r"(?is)<style\b[^>]*>(.*?)</style>"
PAYLOAD_NAMES = (r"""id=["']([^"']+)["']""", r"(?:window|self|globalThis)\.([A-Za-z_$][\w$]*)\s*=", r"^\s*(?:var|let|const)\s+([A-Za-z_$][\w$]*)\s*=")
# of the main content: names that say so, in order; what is never content; elements whose text counts; least length
MAIN = ("main", '[role="main"]', "article", "#main-content", "#content", ".markdown-body", ".markdown", ".doc-content", ".docs-content", ".article-content", ".content-wrapper")
CHROME_TAGS = ("script", "style", "noscript", "template", "svg", "iframe", "form", "button", "nav", "header", "footer", "aside")
CHROME_ROLES = ("navigation", "banner", "contentinfo", "search")
TEXT_TAGS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "pre", "code", "td", "th", "dd", "blockquote")
CONTAINERS = ("div", "section", "article", "td")
LEAST_MAIN = 200
# ----------------------------------------------------------------------------------------------------------------------------------


@F.pandas_udf(T.StringType())
def unescape(text: pd.Series) -> pd.Series:
    return text.map(lambda t: html.unescape(t) if t is not None and "&" in t else t)


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<[^>]+>", "")


def _bare(text: Column) -> Column:
    return F.regexp_replace(_strip(text), r"^\s+|\s+$", "")


def _each(pattern: str, change):
    return lambda c: M.replace_each(c, pattern, change)


#: From HTML to Markdown with entities still escaped: surroundings dropped, pre as fences, code as spans, headings as #, blocks as lines, other tags gone.
STEPS = [
    lambda c: M.chained(c, [lambda x, t=t: F.regexp_replace(x, rf"(?is)<{t}\b.*?</{t}>", " ") for t in DROPPED]),
    _each(r"(?is)<pre\b[^>]*>.*?</pre>", lambda m: F.concat(F.lit("\n```\n"), _bare(m), F.lit("\n```\n"))),
    _each(r"(?is)<code\b[^>]*>.*?</code>", lambda m: F.concat(F.lit("`"), _bare(m), F.lit("`"))),
    _each(r"(?is)<h([1-6])\b[^>]*>.*?</h\1>", lambda m: F.concat(F.lit("\n"), F.repeat(F.lit("#"), F.substring(m, 3, 1).cast("int")), F.lit(" "), _bare(m), F.lit("\n"))),
    lambda c: _strip(F.regexp_replace(c, r"(?i)</(?:p|div|li|tr)>", "\n")),
]


def tidy(text: Column) -> Column:
    text = F.regexp_replace(text, r"[ \t]+", " ")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return F.concat(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit("\n"))


def markdown(pages: DataFrame) -> DataFrame:
    """`page, markdown` of HTML pages (`page`, `text`)."""
    rows = pages.select("page", F.col("text").alias("_m"))
    for step in STEPS:  # one generator each, as a step looks at its input more than once
        rows = M.once(rows, _n=step(F.col("_m"))).select("page", F.col("_n").alias("_m"))
    return rows.select("page", unescape("_m").alias("_u")).select("page", tidy(F.col("_u")).alias("markdown"))


def links(pages: DataFrame) -> DataFrame:
    """`page, url, link`: the targets of a page's anchors as absolute URLs without fragment and trailing slash; relative ones against the page's url."""
    found = pages.select("page", "url", F.explode(F.regexp_extract_all("text", F.lit(r"""(?i)<a\b[^>]*?href\s*=\s*["']([^"'#]+)"""), F.lit(1))).alias("href"))
    root = F.regexp_extract("url", r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1)
    scheme = F.regexp_extract("url", r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    folder = F.regexp_extract("url", r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+(?:/(?:[^/?#]*/)*)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    absolute = (
        F.when(F.col("href").rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.col("href"))
        .when(F.col("href").startswith("//"), F.concat(scheme, F.col("href")))
        .when(F.col("href").startswith("/"), F.concat(root, F.col("href")))
        .otherwise(F.concat(folder, F.regexp_replace("href", r"^\./", "")))
    )
    split = M.once(found.select("page", "url", "href"), to=absolute)
    at = lambda g: F.regexp_extract("to", r"^((?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)?)([^?#]*)([^#]*)", g)
    step = lambda way, part: F.when(part == "..", F.slice(way, 1, F.greatest(F.size(way) - 1, F.lit(1)))).when(part == ".", way).otherwise(F.concat(way, F.array(part)))
    path = F.when(at(2).rlike(r"/\.\.?(?:/|$)"), F.array_join(F.aggregate(F.split(at(2), "/", -1), F.array().cast("array<string>"), step), "/")).otherwise(at(2))
    return split.select("page", "url", F.regexp_replace(F.concat(at(1), path, at(3)), "/+$", "").alias("link"))


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def budget(pages: DataFrame) -> DataFrame:
    """`page, total, inline_script, inline_style, markup` in characters."""
    total_of = lambda p, g: F.aggregate(F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(g)), lambda m: F.length(m)), F.lit(0), lambda a, b: a + b)
    cut = M.once(pages.select("page", "text"), total=F.length("text"), inline_script=total_of(SCRIPT, 2), inline_style=total_of(STYLE, 1))
    return cut.select("page", "total", "inline_script", "inline_style", F.greatest(F.col("total") - F.col("inline_script") - F.col("inline_style"), F.lit(0)).alias("markup"))


def scripts(pages: DataFrame) -> DataFrame:
    """`page, pos, name, body` of inline scripts; the name is an id, or the variable that the data is assigned to."""
    both = F.arrays_zip(F.regexp_extract_all("text", F.lit(SCRIPT), F.lit(1)).alias("a"), F.regexp_extract_all("text", F.lit(SCRIPT), F.lit(2)).alias("b"))
    each = pages.select("page", F.posexplode(both).alias("pos", "s")).select("page", "pos", F.col("s.a").alias("attrs"), F.col("s.b").alias("body")).filter(F.trim("body") != "")
    head = F.substring("body", 1, 400)
    names = [F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for c in (F.col("attrs"), head) for p in PAYLOAD_NAMES]
    return each.select("page", "pos", F.coalesce(*names, F.lit("(anonymous)")).alias("name"), "body")


def payloads(pages: DataFrame) -> DataFrame:
    """`page, name, size, json_like` of inline scripts."""
    json_like = F.trim("body").rlike(r"^[\[{]") | F.substring(F.trim("body"), 1, 400).rlike(r"=\s*[{\[]")
    return scripts(pages).select("page", "name", F.length("body").alias("size"), json_like.alias("json_like"))


def diagnosis(pages: DataFrame) -> DataFrame:
    """`page, words, density, verdict`: whether a page's text can be had as it is (ok), lies in inline data (embedded), needs a browser (spa), or is withheld (blocked)."""
    biggest = payloads(pages).groupBy("page").agg(F.max(F.struct("size", "json_like")).alias("big"))
    shown = markdown(pages).select("page", words(F.col("markdown")).alias("words"))
    size = pages.select("page", F.length("text").alias("size"), F.col("text").rlike(APP_ROOT).alias("root"), F.col("text").rlike(BLOCKED).alias("gate"), F.size(F.regexp_extract_all("text", F.lit(r"(?i)<script[^>]+src="), F.lit(0))).alias("bundles"))
    met = size.join(shown, "page").join(biggest, "page", "left")
    density = F.col("words") / F.greatest(F.col("size") / 1024, F.lit(1.0))
    verdict = (
        F.when(F.col("gate"), "blocked")
        .when((F.col("words") >= OK_WORDS) & (density >= OK_DENSITY), "ok")
        .when((F.col("big.size") >= BIG_PAYLOAD) & F.col("big.json_like"), "embedded")
        .when(F.col("root") | (F.col("bundles") >= BUNDLES), "spa")
        .when(F.col("size") < SMALL_PAGE, "blocked")
        .otherwise("spa")
    )
    return met.select("page", "words", F.round(density, 4).alias("density"), verdict.alias("verdict"))


def prose_score(text: Column) -> Column:
    """How much a string reads like prose; 0 for short ones, for code, and for texts without blanks."""
    text = F.regexp_replace(text, r"^\s+|\s+$", "")
    n, blanks = F.length(text), F.length(text) - F.length(F.replace(text, F.lit(" ")))
    ratio = blanks / F.greatest(n, F.lit(1))
    return F.when((n < LEAST_LENGTH) | text.rlike(MACHINE) | (ratio < LEAST_BLANKS), 0.0).otherwise(F.regexp_count(text, F.lit(PROSE)) * F.sqrt(n.cast("double")) * ratio)


@F.udtf(returnType=T.StructType([T.StructField("path", T.StringType()), T.StructField("value", T.StringType())]))
class JsonStrings:
    """Every string leaf of a JSON text with its path; nothing for a text that is none."""

    def eval(self, text: str):
        try:
            stack = [("$", json.loads(text))] if text else []
        except ValueError:
            return
        while stack:
            path, node = stack.pop()
            if isinstance(node, str):
                yield path, node
            elif isinstance(node, dict):
                stack += [(f"{path}.{k}", v) for k, v in reversed(node.items())]
            elif isinstance(node, list):
                stack += [(f"{path}[{i}]", v) for i, v in reversed(list(enumerate(node)))]


def islands(pages: DataFrame) -> DataFrame:
    """`page, name, pos, body`: the JSON of inline scripts, bare or assigned to a name."""
    body = F.regexp_replace("body", r"^\s+|\s+$", "")
    after = F.regexp_replace(F.substring(body, F.instr(body, "=") + 1, F.length(body)), r"^\s+|[\s;]+$", "")
    bare = F.when(body.rlike(r"^[\[{]"), body).when(F.instr(body, "=") > 0, after)
    each = scripts(pages).select("page", "name", "pos", bare.alias("body"))
    return each.filter(F.col("body").rlike(r"^[\[{]") & F.try_parse_json("body").isNotNull())


def island_text(pages: DataFrame) -> DataFrame:
    """`page, text`: the best texts of a page's inline JSON, in order of score, one of those that begin alike."""
    leaves = islands(pages).lateralJoin(JsonStrings(F.col("body").outer())).select("page", "name", "pos", "path", "value")
    scored = leaves.withColumn("score", prose_score(F.col("value"))).filter("score > 0")
    top = scored.withColumn("place", F.row_number().over(Window.partitionBy("page").orderBy(F.desc("score"), "pos", "path"))).filter(F.col("place") <= MOST_TEXTS)
    first = top.withColumn("again", F.row_number().over(Window.partitionBy("page", F.substring(F.trim("value"), 1, SAME_PREFIX)).orderBy("place"))).filter("again = 1")
    return first.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: F.trim(x["value"])), "\n\n").alias("text"))


def best_text(pages: DataFrame) -> DataFrame:
    """`page, text, origin`: the inline data's text if it has more words than the page's own, else the page's."""
    both = markdown(pages).join(island_text(pages), "page", "left")
    inner = words(F.coalesce("text", F.lit(""))) > words(F.col("markdown"))
    return both.select("page", F.when(inner, F.col("text")).otherwise(F.col("markdown")).alias("text"), F.when(inner, "json").otherwise("html").alias("origin"))


class Element:
    """A node of a parsed page."""

    __slots__ = ("tag", "attrs", "open", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], opening: str, parent: Element | None):
        self.tag, self.attrs, self.open, self.parent = tag, attrs, opening, parent
        self.children: list[Element | str] = []

    def chrome(self) -> bool:
        a = self.attrs
        return self.tag in CHROME_TAGS or a.get("role") in CHROME_ROLES or a.get("aria-hidden") == "true" or "hidden" in a

    def matches(self, selector: str) -> bool:
        if selector[0] == "#":
            return self.attrs.get("id") == selector[1:]
        if selector[0] == ".":
            return selector[1:] in (self.attrs.get("class") or "").split()
        if selector[0] == "[":
            name, _, value = selector[1:-1].partition("=")
            return self.attrs.get(name) == value.strip('"')
        return self.tag == selector

    def inner(self) -> str:
        """The HTML within, without what is never content."""
        out, ahead = [], list(reversed(self.children))
        while ahead:
            c = ahead.pop()
            if isinstance(c, Element):
                if not c.chrome():
                    out.append(c.open)
                    ahead += [Closing(c.tag), *reversed(c.children)]
            else:
                out.append(f"</{c.tag}>" if isinstance(c, Closing) else html.escape(c, quote=False))
        return "".join(out)


class Closing(NamedTuple):
    tag: str


class Extent(NamedTuple):
    """The length of a text with its white space squeezed, so that texts side by side can be added up."""

    letters: int = 0
    words: int = 0
    open_start: bool = False
    open_end: bool = False

    @classmethod
    def of(cls, text: str) -> Extent:
        words = text.split()
        return cls(sum(map(len, words)), len(words), bool(text) and text[0].isspace(), bool(text) and text[-1].isspace())

    def then(self, other: Extent) -> Extent:
        if not self.words:
            return other._replace(open_start=self.open_start or self.open_end or other.open_start) if other.words else Extent(0, 0, self.open_start or other.open_start, self.open_end or other.open_end)
        if not other.words:
            return self._replace(open_end=self.open_end or other.open_start or other.open_end)
        joined = not (self.open_end or other.open_start)
        return Extent(self.letters + other.letters, self.words + other.words - joined, self.open_start, other.open_end)

    def size(self) -> int:
        return self.letters + max(self.words - 1, 0)


class Measured(NamedTuple):
    """An element that may be content, with its depth, the length of its text, and that of the text elements below it."""

    element: Element
    depth: int
    size: int
    below: int


def measured(root: Element) -> list[Measured]:
    """All elements that may be content, in document order, sized from the leaves up in one walk."""
    order, ahead = [], [(root, 1)]
    while ahead:
        node, depth = ahead.pop()
        order.append((node, depth))
        ahead += [(c, depth + 1) for c in reversed(node.children) if isinstance(c, Element) and not c.chrome()]
    extent, below = {}, {}
    for node, _ in reversed(order):
        whole, text = Extent(), 0
        for c in node.children:
            if isinstance(c, str):
                whole = whole.then(Extent.of(c))
            elif id(c) in extent:
                whole = whole.then(extent[id(c)])
                text += below[id(c)] + (extent[id(c)].size() if c.tag in TEXT_TAGS else 0)
        extent[id(node)], below[id(node)] = whole, text
    return [Measured(node, depth, extent[id(node)].size(), below[id(node)]) for node, depth in order]


class Tree(HTMLParser):
    VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")

    def __init__(self, source: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("document", {}, "", None)
        self.feed(source)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = Element(tag, {k: v or "" for k, v in attrs}, self.get_starttag_text() or f"<{tag}>", self.at)
        self.at.children.append(node)
        if tag not in self.VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Element(tag, {k: v or "" for k, v in attrs}, f"<{tag}>", self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def candidates(elements: list[Measured]):
    """(rank, element, how it was found, characters) of everything that could be the main content; the least rank is taken.

    Ranks: containers named as main content with enough text, by name; containers with enough text in text elements, by that text, the
    deeper of equals; the same of either kind with less text, by the text; the body; the page.
    """
    for place, (e, depth, size, below) in enumerate(elements):
        for k, name in enumerate(MAIN):
            if place and size and e.matches(name):
                yield (0, k, place) if size >= LEAST_MAIN else (2, -size, 0, k, place), e, name, size
        if place and e.tag in CONTAINERS and below:
            yield (1, -below, -depth, place) if below >= LEAST_MAIN else (2, -below, 1, -depth, place), e, "densest-block", below
        if e.tag == "body" or not place:
            yield (3, not place, place), e, "body", size


def pick_main(source: str) -> tuple[str, str, int]:
    """(HTML, how it was found, characters) of a page's main content."""
    _, element, how, chars = min(candidates(measured(Tree(source).root)), key=lambda c: c[0])
    return element.inner(), how, chars


def _pick(batches):
    for batch in batches:
        got = [pick_main(t) if t else ("", "body", 0) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.int64())], names=["page", "text", "via", "chars"])


def main_elements(pages: DataFrame) -> DataFrame:
    """`page, text, via, chars`: the HTML of each page's main content and how it was found."""
    return pages.select("page", "text").mapInArrow(_pick, "page string, text string, via string, chars bigint")
