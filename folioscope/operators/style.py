"""Style alerts: every rule on every page in one projection.

A first projection asks of each page's prose which rules match at all; only those (page, rule) pairs are exploded to lines, where the
matches are taken out with their line numbers. Pages are the unit of work; nothing is shuffled but the alerts' own aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import masking as M
from folioscope.functions import rule_data as D
from folioscope.functions.literals import may_match
from folioscope.functions.rules import Rule, rules

#: Code spans, link targets and URLs; tags other than bare lower-case ones, which may be placeholders.
UNSEEN = r"`+[^`\n]*`+|\]\([^)\s]+(?:\s+\"[^\"]*\")?\)|https?://[^\s)\]]+|</?[A-Z][^>\n]*>|<[a-z][\w-]*\s[^>\n]*>|</[a-z][^>\n]*>|<(?:br|hr|p|b|i|em|strong|code|pre|ul|ol|li|table|tr|td|th|div|span|h[1-6]|main|nav|section|article|small|sup|sub) ?/?>|<!--.*?-->"
HEADING = r"^(#{1,6})[ \t]+(.*?)[ \t\r]*$"
ROW = r"^[ \t]*\|(.+)\|[ \t\r]*$"
SENTENCE_END = r"[.!?]\s+"


def scoped(pages: DataFrame) -> DataFrame:
    """`page, area, offset, raw, seen`: each page's body with code blanked, as it is and with what prose rules do not look at left out."""
    bare = M.once(pages.select("page", "text"), offset=M.body_offset(F.col("text")), raw=M.blanked(M.body(F.col("text"))))
    both = M.once(bare.select("page", "offset", "raw"), area=area(F.col("page")), low=F.lower("raw"), seen=F.regexp_replace("raw", UNSEEN, ""))
    return M.once(both, low_seen=F.lower("seen"))


def area(page: Column) -> Column:
    """The first directory of a path; `(root)` if it has none."""
    return F.when(F.instr(page, "/") > 0, F.split_part(page, F.lit("/"), F.lit(1))).otherwise("(root)")


def _on_page(rule: Rule) -> Column:
    """Whether the page can have an alert of the rule at all."""
    text = F.col("raw") if rule.scope == "raw" else F.col("seen")
    if rule.scope == "heading" and rule.kind == "existence":
        return text.rlike(rf"(?m)^#{{1,6}}[ \t].*{rule.pattern()}")
    if rule.kind in ("existence", "substitution"):
        return may_match(F.col("low" if rule.scope == "raw" else "low_seen"), text, list(rule.tokens or rule.swap)) & text.rlike("(?m)" + rule.pattern())
    if rule.kind == "conditional":
        return text.rlike(rule.tokens[0])
    if rule.kind == "capitalization":
        return text.rlike("(?m)^#[ \t]" if rule.scope == "heading.h1" else "(?m)^##+[ \t]")
    return F.length(text) > 80


def _on_line(rule: Rule) -> Column:
    """array<struct<found, replacement>> of one line."""
    line = F.col("raw_line") if rule.scope == "raw" else F.col("seen_line")
    none = F.array().cast("array<struct<found:string,replacement:string>>")
    pair = lambda m, r: F.struct(m.alias("found"), r.alias("replacement"))
    if rule.kind in ("existence", "substitution"):
        found = F.regexp_extract_all(line, F.lit(rule.pattern()), F.lit(0))
        if rule.kind == "existence":
            out = F.transform(found, lambda m: pair(m, F.lit(None).cast("string")))
        else:
            out = F.filter(F.transform(found, lambda m: pair(m, rule.replacement(m))), lambda x: x["replacement"].isNotNull() & (x["found"] != x["replacement"]))
        if rule.scope == "heading":
            return F.when(line.rlike(HEADING), out).otherwise(none)
        if rule.scope == "table.cell":
            return F.when(line.rlike(ROW), out).otherwise(none)
        return out
    if rule.kind == "occurrence":
        long = F.filter(F.split(line, SENTENCE_END, -1), lambda s: F.regexp_count(s, F.lit(rule.tokens[0])) > rule.most)
        return F.transform(long, lambda s: pair(s, F.lit(None).cast("string")))
    if rule.kind == "conditional":
        loose = F.array_except(F.regexp_extract_all(line, F.lit(rule.tokens[0]), F.lit(1)), F.col("defined"))
        kept = F.filter(loose, lambda m: ~m.isin(*rule.exceptions)) if rule.exceptions else loose
        return F.transform(kept, lambda m: pair(m, F.lit(None).cast("string")))
    title = F.regexp_extract(line, HEADING, 2)
    level = F.length(F.regexp_extract(line, HEADING, 1))
    right = title_case(title, rule.exceptions) if rule.scope == "heading.h1" else sentence_case(title, rule.exceptions)
    meant = (level == 1) if rule.scope == "heading.h1" else (level > 1)
    return F.when(meant & ~right, F.array(pair(title, F.lit(None).cast("string")))).otherwise(none)


def _words(title: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(title, r"[^\p{L}\p{N}.'’-]+", " "), " "), lambda w: w != "")


def _named(word: Column, exceptions: tuple[str, ...]) -> Column:
    """Names and words whose capitals are their spelling: listed, all capitals, or with a capital or digit inside."""
    listed = word.isin(*exceptions) if exceptions else F.lit(False)
    return listed | word.rlike(r"^\P{L}*$|^[\p{Lu}\p{N}.'’-]{2,}s?$|^.+\p{Lu}")


def title_case(title: Column, exceptions: tuple[str, ...] = ()) -> Column:
    """Whether all words but small ones begin with a capital, the first one in any case."""
    words = _words(title)
    return F.forall(F.transform(words, lambda w, i: w.rlike(r"^\P{L}*\p{Lu}") | ((i > 0) & w.isin(*D.SMALL_WORDS)) | _named(w, exceptions)), lambda ok: ok)


def sentence_case(title: Column, exceptions: tuple[str, ...] = ()) -> Column:
    """Whether no word after the first begins with a capital, names aside; a word after a colon begins anew."""
    words = _words(F.regexp_replace(title, r":\s+\p{Lu}", ": "))
    return F.forall(F.transform(words, lambda w, i: (i == 0) | w.rlike(r"^\P{Lu}") | _named(w, exceptions)), lambda ok: ok)


def alerts(pages: DataFrame, package: list[Rule] | None = None) -> DataFrame:
    """`page, area, rule, severity, line, found, replacement` of every alert; `pages` has `page` and `text`. A null text has none."""
    package = rules() if package is None else package
    names = F.array(*[F.when(_on_page(r), F.lit(r.name)) for r in package])
    hits = M.once(scoped(pages), rules=F.filter(names, lambda n: n.isNotNull())).filter(F.size("rules") > 0)
    # terms that the page defines: `content delivery network (CDN)`
    defined = F.array_distinct(F.regexp_extract_all("seen", F.lit(D.ACRONYM[2]), F.lit(1)))
    split = M.once(hits, defined=defined, lines=F.arrays_zip(F.split("raw", "\n", -1).alias("r"), F.split("seen", "\n", -1).alias("s")))
    each = split.select("page", "area", "offset", "defined", "lines", F.explode("rules").alias("rule"))
    lines = each.select("page", "area", "offset", "rule", "defined", F.posexplode("lines").alias("i", "l"))
    lines = lines.select("page", "area", "rule", "defined", (F.col("i") + 1 + F.col("offset")).cast("int").alias("line"), F.col("l.r").alias("raw_line"), F.col("l.s").alias("seen_line"))
    found, level = F.lit(None).cast("array<struct<found:string,replacement:string>>"), F.lit(None).cast("string")
    for r in package:
        found = F.when(F.col("rule") == r.name, _on_line(r)).otherwise(found)
        level = F.when(F.col("rule") == r.name, r.level).otherwise(level)
    return lines.select("page", "area", "rule", level.alias("severity"), "line", F.inline(found))


def prose_words(pages: DataFrame) -> DataFrame:
    """`page, words` of every page's prose."""
    return pages.select("page", F.coalesce(M.word_count(F.col("text")), F.lit(0)).alias("words"))
