"""Deterministic replacements in prose, counted by rule, with the proof that code stays as it was.

A page stays one row. Its protected segments are lifted out, a sign that no pattern matches takes their place, the patterns run over
the one string that is left, and the segments are put back. So nothing is exploded or shuffled, and code cannot change. No replacement
makes or breaks a delimiter, so one cut serves all patterns. Replacements that mirror the case of what they replace are three plain
ones: all capitals, a leading capital, the rest.

A null text stays null. Sentence-bound fixes leave quoted strings alone: these are messages that a product prints.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import fix_data as D
from folioscope.functions import masking as M
from folioscope.functions.literals import may_match

#: Stands for a protected segment: a code point that Unicode keeps out of texts for good. One in a text's prose becomes the next such point.
HOLE, NEXT = "\ufdd0", "\ufdd1"


def _raised(pattern: str) -> str:
    """A pattern with its literal letters in capitals; escapes and group signs stay."""
    return re.sub(r"(?<![\\?])[a-z]+", lambda m: m[0].upper(), pattern)


def variants(pattern: str, replacement: str, mirror: bool) -> list[tuple[str, str]]:
    if not mirror:
        return [(pattern, replacement)]
    bare = pattern.removeprefix("(?i)")
    return [(_raised(bare), replacement.upper()), (rf"(?=\p{{Lu}})(?i:{bare})", replacement[:1].upper() + replacement[1:]), (f"(?i:{bare})", replacement)]


def any_of(patterns: list[str]) -> str:
    return "|".join(f"(?i:{p[4:]})" if p.startswith("(?i)") else f"(?:{p})" for p in patterns)


def lifted(text: Column, segments: Column) -> tuple[Column, Column]:
    """The prose with a hole for each protected segment, and the segments."""
    prose = F.array_join(F.transform(segments, lambda s: F.when(s["prose"], F.replace(s["text"], F.lit(HOLE), F.lit(NEXT))).otherwise(HOLE)), "")
    return prose, F.transform(F.filter(segments, lambda s: ~s["prose"]), lambda s: s["text"])


def filled(prose: Column, kept: Column) -> Column:
    """The prose with the segments back in their holes."""
    return F.array_join(F.zip_with(F.split(prose, HOLE, -1), kept, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")


def _step(rows: DataFrame, rule: str, patterns: list[str], hit: Column, new: Column, n: Column) -> DataFrame:
    """One rule: `_p` rewritten and its number of fixes appended to `_n`, both computed once a row, and only where the patterns' literals stand."""
    seen = M.once(rows, _low=F.lower("_p"))
    hit = may_match(F.col("_low"), F.col("_p"), patterns) & hit
    done = M.once(seen, _new=F.when(hit, new).otherwise(F.col("_p")), _hits=F.when(hit, n).otherwise(0))
    return done.select("page", "text", "_kept", F.col("_new").alias("_p"), F.concat("_n", F.array(F.struct(F.lit(rule).alias("rule"), F.col("_hits").cast("bigint").alias("n")))).alias("_n"))


def _prose_rules(rows: DataFrame, brand_terms: dict[str, str] | None) -> DataFrame:
    for rule, patterns in D.FIXES.items():
        if rule == "ProductTerms" and brand_terms:
            patterns = [(p, r, False) for p, r in brand_terms.items()] + patterns
        whole = any_of([p for p, _, _ in patterns])
        new = M.chained(F.col("_p"), [lambda c, a=a, b=b: F.regexp_replace(c, a, b) for p, r, mirror in patterns for a, b in variants(p, r, mirror)])
        rows = _step(rows, rule, [p for p, _, _ in patterns], F.col("_p").rlike(whole), new, F.regexp_count("_p", F.lit(whole)))
    return rows


def _line_rules(rows: DataFrame) -> DataFrame:
    rows = _step(rows, "HeadingPunctuation", ["# "], F.col("_p").rlike(D.HEADING_END), F.regexp_replace("_p", D.HEADING_END, "$1"), F.regexp_count("_p", F.lit(D.HEADING_END)))
    for rule, stems in D.STEMS.items():
        for stem in stems:
            # a quoted span is matched first, and goes back as it is
            pattern = r'(?m)"[^"\n]*(?:"|$)|' + stem.removeprefix("(?m)").replace("(?:^|", f"(?:^|(?<={HOLE})|") + r"\w"
            change = lambda m: F.when(m.startswith('"'), m).otherwise(F.upper(F.right(m, F.lit(1))))
            n = F.size(F.filter(F.regexp_extract_all("_p", F.lit(pattern), F.lit(0)), lambda m: ~m.startswith('"')))
            rows = _step(rows, rule, ["that " if "that " in stem else "lease "], F.col("_p").rlike(stem.replace("(?:^|", f"(?:^|(?<={HOLE})|")), M.replace_each(F.col("_p"), pattern, change), n)
    return rows


def _cut(rows: DataFrame, segments) -> DataFrame:
    one = M.once(rows, _s=segments(F.col("text")))
    prose, kept = lifted(F.col("text"), F.col("_s"))
    return M.once(one, _p=prose, _kept=kept).select("page", "text", "_kept", "_p", "_n")


def fixed(pages: DataFrame, brand_terms: dict[str, str] | None = None) -> DataFrame:
    """`page, before, text, fixes`: every page's text before and after, and a map of the rules that changed it to their number of fixes."""
    none = F.array().cast("array<struct<rule:string,n:bigint>>")
    rows = pages.filter(F.col("text").isNotNull()).select("page", "text").withColumn("_n", none)
    rows = _prose_rules(_cut(rows, M.all_segments), brand_terms)
    rows = M.once(rows, _b=filled(F.col("_p"), F.col("_kept"))).select("page", F.struct(F.col("text").alias("a"), F.col("_b").alias("b")).alias("both"), "_n")
    again = rows.select("page", F.col("both.b").alias("text"), "_n", F.col("both.a").alias("_a"))
    # line-bound fixes see code spans, and only whole-line constructs are lifted out
    again = again.withColumn("page", F.struct("page", "_a")).drop("_a")
    done = _line_rules(_cut(again, M.segments))
    done = M.once(done, _b=filled(F.col("_p"), F.col("_kept")))
    per_rule = F.aggregate(F.filter("_n", lambda x: x["n"] > 0), F.create_map().cast("map<string,bigint>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != x["rule"]), F.create_map(x["rule"], F.coalesce(F.element_at(m, x["rule"]), F.lit(0)) + x["n"])))
    return done.select(F.col("page.page").alias("page"), F.col("page._a").alias("before"), F.col("_b").alias("text"), per_rule.alias("fixes"))


def fixes_by_rule(done: DataFrame) -> DataFrame:
    """`rule, fixes, pages`."""
    each = done.select("page", F.explode("fixes").alias("rule", "n"))
    return each.groupBy("rule").agg(F.sum("n").alias("fixes"), F.countDistinct("page").alias("pages"))


def altered_segments(done: DataFrame) -> DataFrame:
    """`page, seq, before, after` of protected segments that are not the same before and after, or stand on one side only."""
    side = lambda c, n: F.transform(F.filter(M.segments(F.col(c)), lambda s: ~s["prose"]), lambda s: s["text"]).alias(n)
    both = done.select("page", side("before", "a"), side("text", "b"))
    pairs = both.select("page", F.posexplode(F.arrays_zip("a", "b")).alias("seq", "x"))
    return pairs.select("page", "seq", F.col("x.a").alias("before"), F.col("x.b").alias("after")).filter(~F.col("before").eqNullSafe(F.col("after")))
