"""Lines repeated across one site's pages.

State: a table of (site, key) with the number of pages that hold the key, one of sites with their number of pages, and each page's
line keys; it is saved after a run and loaded by the next. A new partition of pages is counted by itself and merged as a delta (pages
delivered anew take their earlier counts back); where the merged count crosses the threshold (which moves too, as the site grows),
the key is newly crossed or newly uncrossed. Built anew are the partition's pages and those that hold such a key. The first run has
the empty state, so that every page comes out.

The key of a line is its words without everything of the form <...>, each run of digits read as 0. Lines under `least_words` words
have no key. A key is repeated if it stands on `least_pages` distinct pages of the site and on `least_share` of the site's pages.

Defined cases: rows without page_id and pages without url (null, blank) are left out; a null or empty text counts as a page without lines; of several
deliveries of a page the one with the greatest `loaded_at` counts; an empty table gives no rows; further columns are ignored.

Scale: a page travels as the array of its 64-bit line keys, never as text. Counting pre-aggregates before the shuffle, so a site
with a third of all pages is no hot spot. The repeated keys go back to the pages by broadcast if their checked number is small,
else by a shuffle on (key), where a site's lines spread over all its keys.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.core.runtime import broadcast_checked, current, durable, written
from folioscope.llm.text import identified, latest, site_column, without_lines

LEAST_WORDS, LEAST_PAGES, LEAST_SHARE_PERCENT = 4, 5, 20


def line_keys(text: Column) -> Column:
    """The key of each line of a text, words parted by single spaces, in order of lines."""
    flat = F.regexp_replace(F.lower(text), r"<[^<>\n]*>", "")
    flat = F.regexp_replace(flat, r"[^\p{L}\p{N}\n]+", " ")
    flat = F.regexp_replace(flat, r"\p{Nd}+", "0")
    return F.transform(F.split(flat, "\n", -1), lambda x: F.trim(x))


def page_lines(pages: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """`page_id, site, loaded_at, lines`: of each line that has a key its number and the hash of (site, key)."""
    rows = identified(pages, "page_id").select("page_id", "loaded_at", site_column(F.col("url")).alias("site"), line_keys(F.coalesce("text", F.lit(""))).alias("keys")).filter(F.col("site").isNotNull())
    numbered = F.transform(F.col("keys"), lambda k, i: F.struct((i + 1).cast("int").alias("line_no"), k.alias("key")))
    kept = F.filter(numbered, lambda x: x["key"].rlike(r"^\S+(?: \S+){%d}" % (least_words - 1)))
    lines = F.transform(kept, lambda x: F.struct(x["line_no"].alias("line_no"), F.xxhash64(F.col("site"), x["key"]).alias("key")))
    return latest(rows.select("page_id", "loaded_at", "site", lines.alias("lines")), "page_id", "loaded_at", ["site", "lines", "loaded_at"])


def count_delta(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(site, key, n_pages) and (site, site_pages) of a partition of pages."""
    distinct = F.array_distinct(F.transform("lines", lambda x: x["key"]))
    keys = lines.select("site", F.explode(distinct).alias("key")).groupBy("site", "key").agg(F.count("*").alias("n_pages"))
    return keys, lines.groupBy("site").agg(F.count("*").alias("site_pages"))


def merge(state: DataFrame, delta: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Both counts of each key: `old` before the delta and `count` after it."""
    both = state.select(*keys, F.col(count).alias("old"), F.col(count)).unionByName(delta.select(*keys, F.lit(0).cast("bigint").alias("old"), F.col(count)))
    return both.groupBy(*keys).agg(F.sum("old").alias("old"), F.sum(count).alias(count))


def crossings(keys: DataFrame, sites: DataFrame, least_pages: int = LEAST_PAGES, share_percent: int = LEAST_SHARE_PERCENT) -> DataFrame:
    """`site, key, was, now`: for merged counts, whether the key was repeated before the delta and is now; keys that are neither are left out."""
    sites = sites.withColumnRenamed("old", "old_pages")
    met = keys.filter(F.greatest("old", "n_pages") >= least_pages).join(broadcast_checked(sites), "site")
    passes = lambda n, all_: (F.col(n) >= least_pages) & (F.col(n) * 100 >= F.col(all_) * share_percent)
    return met.select("site", "key", passes("old", "old_pages").alias("was"), passes("n_pages", "site_pages").alias("now")).filter("was OR now")


def batches(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What was there before the last day of loading, and that day's pages as the delta; pages without a time belong to the delta."""
    day = lines.agg(F.max(F.to_date("loaded_at")).alias("last_day"))
    dated = lines.crossJoin(F.broadcast(day))  # one row
    older = F.to_date("loaded_at") < F.col("last_day")
    return dated.filter(older).drop("last_day"), dated.filter(~F.coalesce(older, F.lit(False))).drop("last_day")


class State(NamedTuple):
    """What a run leaves for the next: `page_id, loaded_at, site, lines`; `site, key, n_pages`; `site, site_pages`."""

    lines: DataFrame
    keys: DataFrame
    sites: DataFrame


def save(state: State, folder: str) -> None:
    """Writes the state to a new folder; the one it was loaded from stays as it is."""
    for name, df in state._asdict().items():
        df.write.parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str) -> State:
    return State(*(spark.read.parquet(f"{folder}/{name}") for name in State._fields))


def advance(state: State | None, lines: DataFrame) -> tuple[State, DataFrame, DataFrame]:
    """The state after a partition of pages (their `page_lines`), the keys that were or are repeated (`site, key, was, now`), and the
    `page_id` of the pages that the partition adds or replaces. A delivery older than the stored one changes nothing.

    Of the state only the counts are read, and the lines of pages that the partition delivers anew.
    """
    if state is None:
        old, fresh, after = State(lines.limit(0), *count_delta(lines.limit(0))), lines, lines
        new_keys, new_sites = count_delta(lines)
    else:
        old = state
        met = broadcast_checked(lines.select("page_id"))
        again = durable(old.lines.join(met, "page_id", "left_semi"))
        stored = broadcast_checked(again.select("page_id", F.col("loaded_at").alias("_at"), F.lit(True).alias("_stored")))
        newer = F.col("_stored").isNull() | F.col("_at").isNull() | (F.col("loaded_at") >= F.col("_at"))
        fresh = durable(lines.join(stored, "page_id", "left").filter(newer).select(lines.columns))
        ids = broadcast_checked(fresh.select("page_id"))
        replaced, after = again.join(ids, "page_id", "left_semi"), old.lines.join(ids, "page_id", "left_anti").unionByName(fresh)
        (add_keys, add_sites), (less_keys, less_sites) = count_delta(fresh), count_delta(replaced)
        new_keys = add_keys.unionByName(less_keys.withColumn("n_pages", -F.col("n_pages")))
        new_sites = add_sites.unionByName(less_sites.withColumn("site_pages", -F.col("site_pages")))
    keys = written(merge(old.keys, new_keys, ["site", "key"], "n_pages"))
    sites = durable(merge(old.sites, new_sites, ["site"], "site_pages"))
    now = State(after, keys.filter("n_pages > 0").select("site", "key", "n_pages"), sites.filter("site_pages > 0").select("site", "site_pages"))
    return now, crossings(keys, sites), fresh.select("page_id")


def repeated_lines(pages: DataFrame) -> DataFrame:
    """`page_id, line_no` of all lines whose key is repeated on its site.

    Two runs of the operator: one over the pages of all earlier days of loading, which leaves its table of line counts, and one
    over the last day, which merges its own counts into that table.
    """
    lines = durable(page_lines(pages))
    earlier, last = batches(lines)
    state, _, _ = advance(None, earlier)
    state, keys, _ = advance(state, last)
    now = durable(keys.filter("now").select("key"))
    return state.lines.select("page_id", F.inline("lines")).join(broadcast_checked(now), "key", "left_semi").select("page_id", "line_no")


def rebuild(pages: DataFrame, partition: DataFrame, state: State | None = None) -> tuple[DataFrame, State]:
    """`page_id, n_removed, text` of the pages that a partition concerns: its own, and others that hold a key which crossed; and the
    state to save. `pages` has the texts of all pages, the partition's included.

    The text comes without its repeated lines. Pages outside came out of an earlier run, and their lines' keys kept their side of the threshold.
    """
    now, keys, fresh = advance(state, durable(page_lines(partition)))
    met = now.lines.select("page_id", F.inline("lines")).join(broadcast_checked(durable(keys.select("key", "was", "now"))), "key")
    per_page = met.groupBy("page_id").agg(F.max((F.col("was") != F.col("now")).cast("int")).alias("crossed"), F.array_sort(F.collect_list(F.when(F.col("now"), F.col("line_no")))).alias("drop"))
    todo = per_page.join(fresh.withColumn("fresh", F.lit(1)), "page_id", "full").filter("crossed = 1 OR fresh = 1").select("page_id", F.coalesce("drop", F.array().cast("array<int>")).alias("drop"))
    todo = durable(todo)
    texts = identified(pages, "page_id").filter(site_column(F.col("url")).isNotNull()).select("page_id", "loaded_at", F.coalesce("text", F.lit("")).alias("text")).join(todo, "page_id", "left_semi")
    each = current(texts, "page_id", "loaded_at").join(todo, "page_id")
    return without_lines(each, "text", "drop").select("page_id", F.size("drop").alias("n_removed"), "text"), now


def rebuilt_pages(pages: DataFrame) -> DataFrame:
    """`page_id, n_removed, text` of all pages of all sites, without their repeated lines: the first run, from the empty state."""
    return rebuild(pages, pages)[0]
