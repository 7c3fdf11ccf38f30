"""Structural checks of documentation pages: headings, fences, callouts, tables, placeholders, titles.

All checks read one table of lines in which code is blanked but keeps its line numbers, and are windows over a page's lines. The
page is the partition of every window; only the title check looks across pages, and it shuffles titles, not pages.

Every table of a page is checked: a table's rows end at the first line that is no row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import masking as M

HEADING = r"^(#{1,6})[ \t]+(.*?)[ \t\r]*$"
FENCE = r"^[ \t]*(`{3,}|~{3,})([^\n]*)$"
CALLOUT = r"^[ \t]*\*\*([A-Za-z]+)\*\*[ \t]*(:|[ \t]|$)"
ROW = r"^[ \t]*\|(.+)\|[ \t\r]*$"
PLACEHOLDER = r"\b([A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+)\b"


@dataclass(frozen=True)
class Policy:
    """What a doc set asks of its pages."""

    h1_source: str = "heading"
    approved_fences: tuple[str, ...] = ("bash", "json", "javascript", "typescript", "html", "python", "java", "kotlin", "swift", "text")
    required_column_values: tuple[str, ...] = ("Yes", "No", "Conditional")
    banned_column_names: tuple[str, ...] = ("Key", "Param", "Name", "Field Name", "Nested field", "Parameter")
    max_table_columns: int = 5
    approved_callouts: tuple[str, ...] = ("Note", "Tip", "Important", "Caution", "Warning")
    retired_callouts: dict[str, str] = field(default_factory=lambda: {"Info": "Note", "Danger": "Warning", "Forbidden": "Warning", "Error": "Warning"}, hash=False)
    max_callouts_per_section: int = 2
    exclude: tuple[str, ...] = ()
    known_placeholders: tuple[str, ...] = ()

    def __post_init__(self):
        if self.h1_source not in ("heading", "frontmatter", "either"):
            raise ValueError(f"h1_source {self.h1_source!r} is not heading, frontmatter or either")
        for name in ("approved_fences", "required_column_values", "banned_column_names", "approved_callouts", "exclude", "known_placeholders"):
            for value in getattr(self, name):
                if not isinstance(value, str):
                    raise ValueError(f"{name} has {value!r}, which is no string")


def by_page() -> Window:
    return Window.partitionBy("page").orderBy("line")


def issue(rows: DataFrame, check: str | Column, level: str | Column, message: Column) -> DataFrame:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return rows.select(as_column(check).alias("check_id"), "page", "line", as_column(level).alias("level"), message.alias("message"))


def headings(lines: DataFrame) -> DataFrame:
    """`page, line, level, title` of # headings outside code."""
    found = lines.filter(F.col("text").rlike(HEADING))
    return found.select("page", "line", F.length(F.regexp_extract("text", HEADING, 1)).alias("level"), F.regexp_extract("text", HEADING, 2).alias("title"))


def heading_skips(heads: DataFrame) -> DataFrame:
    rows = heads.withColumn("before", F.lag("level").over(by_page())).filter("level > before + 1")
    return issue(rows, "heading_skip", "error", F.concat(F.lit("from H"), "before", F.lit(" to H"), "level", F.lit(": "), "title"))


def multiple_h1(heads: DataFrame) -> DataFrame:
    rows = heads.filter("level = 1").withColumn("place", F.row_number().over(by_page())).withColumn("n", F.count("*").over(Window.partitionBy("page"))).filter("place = 2")
    return issue(rows, "multiple_h1", "error", F.concat("n", F.lit(" H1 headings")))


def duplicate_headings(heads: DataFrame) -> DataFrame:
    same = Window.partitionBy("page", F.lower(F.trim("title"))).orderBy("line")
    rows = heads.withColumn("place", F.row_number().over(same)).withColumn("first", F.first("line").over(same)).filter("place > 1")
    return issue(rows, "duplicate_heading", "error", F.concat("title", F.lit(" repeats line "), "first"))


def empty_headings(lines: DataFrame) -> DataFrame:
    """Headings without a word before the next one or the end; a code block under a heading is no word."""
    is_head = F.col("text").rlike(HEADING)
    rows = lines.select("page", "line", "text", is_head.alias("head"), F.sum(is_head.cast("int")).over(by_page()).alias("section"))
    full = rows.groupBy("page", "section").agg(F.max(F.when(~F.col("head") & (F.trim("text") != ""), 1)).alias("full"), F.min(F.when(F.col("head"), F.struct("line", "text"))).alias("h"))
    bare = full.filter("section > 0 AND full IS NULL").select("page", F.col("h.line").alias("line"), F.regexp_extract("h.text", HEADING, 2).alias("title"))
    return issue(bare, "empty_heading", "warning", F.col("title"))


def titles(pages: DataFrame, heads: DataFrame, policy: Policy) -> DataFrame:
    """`page, title`: from the first H1, the front matter, or either, by policy; null where there is none."""
    h1 = heads.filter("level = 1").groupBy("page").agg(F.min_by("title", "line").alias("h1"))
    both = pages.select("page", M.front_title(F.col("text")).alias("front")).join(h1, "page", "left")
    order = {"heading": ("h1",), "frontmatter": ("front", "h1"), "either": ("h1", "front")}[policy.h1_source]
    some = F.coalesce(*[F.when(F.trim(c) != "", F.col(c)) for c in order])
    return both.select("page", some.alias("title"))


def missing_titles(named: DataFrame) -> DataFrame:
    return issue(named.filter("title IS NULL").withColumn("line", F.lit(1)), "missing_title", "warning", F.lit("no title"))


def titles_not_unique(named: DataFrame) -> DataFrame:
    """Pages whose title other pages have too. Counted by a partial aggregate, then joined, so that a title that very many pages share splits."""
    keyed = named.filter("title IS NOT NULL").withColumn("key", F.lower(F.trim("title")))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    return issue(keyed.join(shared, "key").withColumn("line", F.lit(1)), "title_not_unique", "warning", F.concat("key", F.lit(" is on "), "n", F.lit(" pages")))


def fence_labels(lines: DataFrame, policy: Policy) -> DataFrame:
    """Every other fence line opens a block; its label is the first word after the signs."""
    fences = lines.filter(F.col("raw").rlike(FENCE)).withColumn("place", F.row_number().over(by_page())).filter("place % 2 = 1")
    label = F.split_part(F.trim(F.regexp_replace(F.regexp_extract("raw", FENCE, 2), r"\s+", " ")), F.lit(" "), F.lit(1))
    rows = fences.withColumn("label", label)
    approved = F.col("label").isin(*policy.approved_fences) if policy.approved_fences else F.lit(False)
    check = F.when(F.col("label") == "", "fence_no_language").when(F.col("label") != F.lower("label"), "fence_case").when(~approved, "fence_unapproved")
    level = F.when(check == "fence_unapproved", "suggestion").otherwise("error")
    return issue(rows.withColumn("check", check).filter(F.col("check").isNotNull()), F.col("check"), level, F.col("label"))


def callouts(lines: DataFrame, policy: Policy) -> DataFrame:
    """Retired labels, labels without colon, callouts within two lines of each other, and too many in one H2 section."""
    level, title = F.length(F.regexp_extract("text", HEADING, 1)), F.regexp_extract("text", HEADING, 2)
    section = F.coalesce(F.last(F.when(level == 2, title), ignorenulls=True).over(by_page()), F.lit("(top)"))
    label = F.regexp_extract("text", CALLOUT, 1)
    retired = F.create_map(*[F.lit(x) for kv in policy.retired_callouts.items() for x in kv]) if policy.retired_callouts else F.create_map(F.lit(""), F.lit(""))
    rows = lines.withColumn("section", section).filter(F.col("text").rlike(CALLOUT)).withColumn("label", label).withColumn("instead", F.element_at(retired, F.col("label")))
    rows = rows.filter(F.col("instead").isNotNull() | F.col("label").isin(*policy.approved_callouts)).withColumn("before", F.lag("line").over(by_page()))
    a = issue(rows.filter("instead IS NOT NULL"), "callout_retired", "error", F.concat("label", F.lit(" is now "), "instead"))
    b = issue(rows.filter(F.regexp_extract("text", CALLOUT, 2) != ":"), "callout_format", "warning", F.col("label"))
    c = issue(rows.filter("line - before <= 2"), "callout_stacked", "error", F.col("label"))
    many = rows.groupBy("page", "section").agg(F.count("*").alias("n")).filter(F.col("n") > policy.max_callouts_per_section).withColumn("line", F.lit(1))
    return a.unionByName(b).unionByName(c).unionByName(issue(many, "callout_density", "warning", F.concat("section", F.lit(" has "), "n")))


def cells(row: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(F.trim(row), r"^\|+|\|+$", ""), r"\|", -1), lambda c: F.trim(c))


def table_rows(lines: DataFrame) -> DataFrame:
    """`page, table, line, cells, header`: the rows of each table with the header's cells; a table is a row, a rule, and the rows that follow on."""
    rows = lines.select("page", "line", F.regexp_replace("text", r"\r$", "").alias("text")).withColumn("is_row", F.col("text").rlike(ROW))
    rows = rows.withColumn("island", F.sum((~F.col("is_row")).cast("int")).over(by_page())).filter("is_row").withColumn("cells", cells(F.col("text")))
    rule = F.forall("cells", lambda c: c.rlike(r"^(?::?-{2,}:?)?$")) & F.exists("cells", lambda c: c != "")
    rows = rows.withColumn("rule", rule).withColumn("next_rule", F.lead("rule").over(Window.partitionBy("page", "island").orderBy("line")))
    heads = F.last(F.when(F.col("next_rule") & ~F.col("rule"), F.struct("line", "cells")), ignorenulls=True).over(Window.partitionBy("page", "island").orderBy("line"))
    rows = rows.withColumn("head", heads).filter("NOT rule AND head IS NOT NULL")
    plain = F.transform("head.cells", lambda h: F.trim(F.regexp_replace(h, r"[*`]", "")))
    return rows.select("page", F.col("head.line").alias("table"), "line", "cells", plain.alias("header"))


def table_checks(rows: DataFrame, policy: Policy) -> DataFrame:
    """Too many columns, banned header names, values outside a Required column's list, empty cells of complete rows."""
    heads, data = rows.filter("line = table"), rows.filter("line > table")
    wide = issue(heads.filter(F.size("header") > policy.max_table_columns), "table_width", "warning", F.size("header").cast("string"))
    names = heads.select("page", "line", F.explode("header").alias("name"))
    banned = issue(names.filter(F.col("name").isin(*policy.banned_column_names)), "table_column_name", "error", F.col("name"))
    at = F.array_position("header", "Required").cast("int")
    value = F.trim(F.regexp_replace(F.get("cells", at - 1), r"[*`]", ""))
    required = data.filter(at > 0).withColumn("value", value).filter((F.col("value") != "") & ~F.col("value").isin(*policy.required_column_values))
    empty = data.filter((F.size("cells") == F.size("header")) & F.exists("cells", lambda c: c == ""))
    return wide.unionByName(banned).unionByName(issue(required, "required_value", "error", F.col("value"))).unionByName(issue(empty, "table_empty_cell", "warning", F.lit("")))


def placeholders(pages: DataFrame, policy: Policy) -> DataFrame:
    """UPPER_SNAKE names within code blocks that the page's prose never mentions, at their first place in the body."""
    bare = M.once(pages.select("page", "text"), body=M.body(F.col("text")), offset=M.body_offset(F.col("text")))
    cut = M.once(bare.select("page", "body", "offset"), code=F.array_join(M.protected(F.col("body")), "\n"), said=M.blanked(F.col("body")))
    names = F.array_distinct(F.array_except(F.regexp_extract_all("code", F.lit(PLACEHOLDER), F.lit(1)), F.regexp_extract_all("said", F.lit(PLACEHOLDER), F.lit(1))))
    if policy.known_placeholders:
        names = F.array_except(names, F.array(*[F.lit(x) for x in policy.known_placeholders]))
    each = cut.select("page", "body", "offset", F.explode(names).alias("name"))
    before = F.split(F.col("body"), F.concat(F.lit(r"\b\Q"), F.col("name"), F.lit(r"\E\b")), 2)[0]
    rows = each.withColumn("line", (M.newlines(before) + 1 + F.col("offset")).cast("int"))
    return issue(rows, "placeholder_unexplained", "suggestion", F.col("name"))


def excluded(path: Column, patterns: tuple[str, ...]) -> Column:
    """Whether a path is one that a policy leaves out: by shell pattern, in which * crosses directories, or by the directory it names."""
    import fnmatch

    out = F.lit(False)
    for p in patterns:
        stem = p.rstrip("*").rstrip("/") + "/"
        out = out | path.rlike("^" + fnmatch.translate(p).replace("\\Z", "$").replace("\\z", "$")) | path.startswith(stem)
    return out


def shared_lines(pages: DataFrame) -> DataFrame:
    """The lines of all pages, hashed by page once for the windows of all checks.

    Columns pass the exchange as one array, as each check would else prune them its own way and make an exchange of its own; of lines
    that no check reads only whether they are blank goes along.
    """
    read = F.col("text").rlike(f"{HEADING}|{CALLOUT}|{ROW}")
    said = F.when(read, F.col("text")).when(F.trim("text") == "", "").otherwise("-")
    narrow = M.page_lines(pages).select("page", F.array(F.struct("line", said.alias("text"), F.when(F.col("raw").rlike(FENCE), F.col("raw")).otherwise("").alias("raw"))).alias("_l"))
    return narrow.repartition("page").select("page", F.inline("_l"))


def issues(pages: DataFrame, policy: Policy | None = None) -> DataFrame:
    """`check_id, page, line, level, message` of every structural issue; `pages` has `page` and `text`, a null text counts as empty."""
    policy = policy or Policy()
    pages = pages.select("page", F.coalesce("text", F.lit("")).alias("text"))
    if policy.exclude:
        pages = pages.filter(~excluded(F.col("page"), policy.exclude))
    lines = shared_lines(pages)
    heads = headings(lines)
    named = titles(pages, heads, policy)
    parts = [heading_skips(heads), multiple_h1(heads), duplicate_headings(heads), empty_headings(lines), missing_titles(named), titles_not_unique(named), fence_labels(lines, policy), callouts(lines, policy), table_checks(table_rows(lines), policy), placeholders(pages, policy)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
