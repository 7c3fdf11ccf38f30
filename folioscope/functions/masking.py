"""Code told from prose: Column expressions that cut a text into protected and editable segments.

`split` gives the editable text between protected constructs and `regexp_extract_all` the constructs themselves; put together they
are the text again, so every operator on prose works on one half and leaves the other as it is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Front matter at the very start, or a fence of three or more signs up to a line with the very same signs; an unclosed fence is prose.
BLOCK = r"(?msd)\A---\n.*?\n---\n|^[ \t]*(?<mark>`{3,}|~{3,})[^\n]*\n.*?^[ \t]*\k<mark>[ \t]*$"
#: Code span, component or HTML tag, link target, bare URL.
INLINE = r"`+[^`\n]*`+|<[A-Za-z/][^>\n]*>|\]\([^)\s]+(?:\s+\"[^\"]*\")?\)|https?://[^\s)\]]+"
FRONT_MATTER = r"(?sd)\A---\n(.*?)\n---\n"
WORD = r"(?U)\b[\w'-]+\b"


def editable(text: Column, pattern: str = BLOCK) -> Column:
    """The segments of a text outside `pattern`; one more than there are protected ones."""
    return F.split(text, pattern, -1)


def protected(text: Column, pattern: str = BLOCK) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def segments(text: Column, pattern: str = BLOCK) -> Column:
    """array<struct<text, prose>>: the segments in order, empty ones left out."""
    pairs = F.zip_with(
        editable(text, pattern),
        protected(text, pattern),
        lambda a, b: F.array(F.struct(F.coalesce(a, F.lit("")).alias("text"), F.lit(True).alias("prose")), F.struct(F.coalesce(b, F.lit("")).alias("text"), F.lit(False).alias("prose"))),
    )
    return F.filter(F.flatten(pairs), lambda s: s["text"] != "")


def all_segments(text: Column) -> Column:
    """array<struct<text, prose>> with blocks and, outside of them, inline constructs protected."""
    inner = F.transform(segments(text), lambda s: F.when(s["prose"], segments(s["text"], INLINE)).otherwise(F.array(s)))
    return F.flatten(inner)


def joined(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda s: s["text"]), "")


def blanked(text: Column) -> Column:
    """The text with protected blocks reduced to their newlines, so that line numbers hold."""
    return F.array_join(F.transform(segments(text), lambda s: F.when(s["prose"], s["text"]).otherwise(F.regexp_replace(s["text"], r"[^\n]", ""))), "")


def prose(text: Column) -> Column:
    """All prose segments, one after the other."""
    return F.array_join(F.transform(F.filter(all_segments(text), lambda s: s["prose"]), lambda s: s["text"]), "")


def word_count(text: Column) -> Column:
    return F.regexp_count(prose(text), F.lit(WORD))


def body(text: Column) -> Column:
    """The text without its front matter."""
    return F.regexp_replace(text, FRONT_MATTER, "")


def body_offset(text: Column) -> Column:
    """The number of lines that the front matter takes."""
    front = F.regexp_extract(text, FRONT_MATTER, 0)
    return F.length(front) - F.length(F.replace(front, F.lit("\n")))


def front_title(text: Column) -> Column:
    """The front matter's title without quotes; null where there is none."""
    line = F.regexp_extract(F.regexp_extract(text, FRONT_MATTER, 1), r"(?md)^title:[ \t]*(\S.*?)[ \t\r]*$", 1)
    bare = F.regexp_replace(line, "^[\"']+|[\"']+$", "")
    return F.when(bare != "", bare)


def first_heading(text: Column) -> Column:
    """The text of the first # heading of any level; null where there is none."""
    found = F.regexp_extract(text, r"(?md)^#{1,6}[ \t]+(\S.*?)[ \t]*#*[ \t\r]*$", 1)
    return F.when(found != "", found)


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n")))


def page_lines(pages: DataFrame, *keep: str) -> DataFrame:
    """`page, *keep, line, text, raw`: each line of a page's body, with code blanked (`text`) and as it is (`raw`); numbers count the front matter."""
    bare = once(pages.select("page", *keep, "text"), _o=body_offset(F.col("text")), _b=body(F.col("text")))
    cut = bare.select("page", *keep, "_o", F.split("_b", "\n", -1).alias("_raw"), F.split(blanked(F.col("_b")), "\n", -1).alias("_text"))
    each = cut.select("page", *keep, "_o", F.posexplode(F.arrays_zip("_text", "_raw")).alias("_i", "_l"))
    return each.select("page", *keep, (F.col("_i") + 1 + F.col("_o")).cast("int").alias("line"), F.col("_l._text").alias("text"), F.col("_l._raw").alias("raw"))


def indented_code(lines: DataFrame) -> DataFrame:
    """`page, line` of lines in genuinely indented code blocks.

    Such a block starts after a blank line with four blanks or a tab, unless the last line before is a list item, a table row, a
    quote, a tag, or ends with `>` or `{`; it goes on through indented and blank lines and ends with its last indented line.
    """
    order = Window.partitionBy("page").orderBy("line")
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    inside = blank | F.col("text").rlike(r"^(?: {4}|\t)")
    before = F.last(F.when(~blank, F.trim("text")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    barred = F.coalesce(before.rlike(r"^(?:(?:[-*+]|\d+[.)])\s|[<|>])|[>{]$"), F.lit(False))
    marked = lines.select("page", "line", blank.alias("blank"), inside.alias("inside"), (F.col("text").rlike(r"^(?: {4}|\t)\S") & F.lag(blank).over(order) & ~barred).alias("opens"))
    island = F.sum((~F.col("inside")).cast("int")).over(order)
    marked = marked.withColumn("island", island).filter("inside")
    run = Window.partitionBy("page", "island")
    first = F.min(F.when(F.col("opens"), F.col("line"))).over(run)
    last = F.max(F.when(~F.col("blank"), F.col("line"))).over(run)
    return marked.withColumn("first", first).withColumn("last", last).filter("line >= first AND line <= last").select("page", "line")


def in_quotes(before: Column) -> Column:
    """Whether a place lies within double quotes on its line, by the text before it."""
    line = F.substring_index(before, "\n", -1)
    return (F.length(line) - F.length(F.replace(line, F.lit('"')))) % 2 == 1


def merged_spans(spans: DataFrame) -> DataFrame:
    """`page, start, end` with overlapping and touching spans of a page as one."""
    order = Window.partitionBy("page").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = spans.withColumn("fresh", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0))
    return fresh.withColumn("island", F.sum("fresh").over(order)).groupBy("page", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def replace_each(text: Column, pattern: str, change) -> Column:
    """The text with `change(match)` in place of each match, without a UDF."""
    pieces = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda a, m: F.concat(a, F.when(m.isNull(), "").otherwise(change(m))))
    return F.array_join(pieces, "")


def mirror_case(found: Column, replacement: Column) -> Column:
    """The replacement in the case of what it replaces: all capitals, a leading capital, or as it is."""
    first = F.substring(found, 1, 1)
    capital = (first == F.upper(first)) & (first != F.lower(first))
    whole = (F.length(found) > 1) & (found == F.upper(found)) & (found != F.lower(found))
    raised = F.concat(F.upper(F.substring(replacement, 1, 1)), F.substring(replacement, 2, 10_000))
    return F.when(whole, F.upper(replacement)).when(capital, raised).otherwise(replacement)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """`df` with further columns that are computed once a row, however often later expressions use them.

    A generator over a single element keeps the optimizer from copying costly expressions into each place of use.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def chained(start: Column, steps: list) -> Column:
    return reduce(lambda c, step: step(c), steps, start)
