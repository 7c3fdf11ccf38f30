"""Evaluation texts that leaked into documents, by a distributed positional inverted index.

Every run of 13 consecutive words of an item (all its words, if it has fewer) is a window. A window that a document holds shows its
two rarest terms, by document frequency, at their distance. The index holds, per (term, doc_id), the sorted positions of those terms
in the document; it is written to the shared folder. The list of a window's rarest term, moved by the distance to its second rarest,
is intersected with that term's list. What is left names a document, an item and the shift between their positions; there the words
are compared one by one, so that exactly the phrases remain.

Documents are cut into words once: as the numbers of the items' terms, 0 for a word that no item has. Frequencies, index and comparison
read those numbers, and equal numbers are equal words. Only where the items have over `MOST_TERMS` distinct terms every word's number is
its 64-bit hash, and equality is that of hashes.

Defined cases: rows without id are left out; items without words and documents without words match nothing; a null text is an empty text; items with equal passages
are all reported; a window with a term that no document holds is dropped before any lookup; empty tables give no rows.

Scale: a document sends on the numbers of its words, never its text, and only the positions of terms that are among some window's two
rarest are shuffled. An intersection is an equal join on (document, term, position), so a frequent term or a long document is no hot
spot. A place to compare is a row of its own (document, item, shift) with the few words about it; nothing is collected per document.
Windows and terms of the items are broadcast after a check of their number and bytes, else shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.core.runtime import broadcast_checked, durable, written
from folioscope.llm.text import WORD, identified, words_column

RUN = 13
#: Words within which the rarest terms of an item must stand together for a proximity match.
NEAR = 26
#: Distinct terms of all items up to which they are sent to the tasks as a dictionary.
MOST_TERMS = 500_000
#: The number of a word that no item has.
UNKNOWN = 0


def item_words(items: DataFrame) -> DataFrame:
    return identified(items, "item_id").select("item_id", words_column(F.col("text")).alias("words")).filter(F.size("words") > 0)


def windows(items: DataFrame, run: int = RUN) -> DataFrame:
    """`item_id, at, words`: the runs of `run` words of each item with the place of their first word from 0, or all its words."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - run, F.lit(0)))
    each = item_words(items).select("item_id", "words", F.explode(starts).alias("at"))
    return each.select("item_id", "at", F.slice("words", F.col("at") + 1, run).alias("words"))


class Hashes(dict):
    """Spark's xxhash64 of a word; the cache starts anew when it has grown."""

    most = 1_000_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42)
        value = self[word] = value - (1 << 64) if value >> 63 else value
        return value


class Known(dict):
    """The numbers of the items' terms; `UNKNOWN` for every other word."""

    def __missing__(self, word: str) -> int:
        return UNKNOWN


class Terms:
    """The items' terms: `table` (`term, t`) with the number of each, and what a task needs to number words."""

    def __init__(self, terms: DataFrame):
        rows = terms.select("term").limit(MOST_TERMS + 1).collect()
        self.type, self.known = "bigint", None
        self.table = terms.select("term", F.xxhash64("term").alias("t"))
        if len(rows) <= MOST_TERMS:
            self.type, self.known = "int", {term: i + 1 for i, term in enumerate(sorted(r["term"] for r in rows))}
            self.table = terms.sparkSession.createDataFrame(list(self.known.items()), "term string, t int")


def _numbers(known: dict[str, int] | None):
    def run(batches):
        get, kind = (Hashes() if known is None else Known(known)).__getitem__, np.int64 if known is None else np.int32
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                ends, parts = np.zeros(part.num_rows + 1, np.int32), []
                for i, text in enumerate(part.column("text").to_pylist()):
                    found = WORD.findall(text.lower()) if text else ()
                    ends[i + 1] = ends[i] + len(found)
                    parts.append(np.fromiter(map(get, found), kind, len(found)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts)))], names=["doc_id", "words"])

    return run


def document_numbers(documents: DataFrame, terms: Terms) -> DataFrame:
    """`doc_id, words`: the words of each document as the numbers of `terms`."""
    return identified(documents, "doc_id").select("doc_id", "text").mapInArrow(_numbers(terms.known), f"doc_id bigint, words array<{terms.type}>")


def frequencies(numbers: DataFrame, terms: Terms) -> DataFrame:
    """`term, t, df`: in how many documents each of `terms` occurs; terms that occur nowhere are not in it."""
    each = numbers.select(F.explode(F.array_distinct("words")).alias("t")).filter(F.col("t") != UNKNOWN).groupBy("t").agg(F.count("*").alias("df"))
    return each.join(broadcast_checked(terms.table), "t").select("term", "t", "df")


def anchors(wins: DataFrame, df: DataFrame) -> DataFrame:
    """`item_id, place, t1, t2, step`: of each window its rarest term with its place in the item, and its second rarest `step` words on.

    Windows over the same two words are one row; a window of one single term has that term as both, at step 0.
    """
    each = wins.select("item_id", "at", F.posexplode("words").alias("offset", "term")).join(broadcast_checked(df), "term", "left")
    once = each.groupBy("item_id", "at", "term").agg(F.first("t").alias("t"), F.min("offset").alias("offset"), F.coalesce(F.min("df"), F.lit(0)).alias("df"))
    ranked = once.groupBy("item_id", "at").agg(F.array_sort(F.collect_list(F.struct("df", "t", "offset"))).alias("a")).filter(F.col("a")[0]["df"] > 0)
    first, second = F.col("a")[0], F.coalesce(F.get("a", F.lit(1)), F.col("a")[0])
    return ranked.select("item_id", (F.col("at") + first["offset"]).alias("place"), first["t"].alias("t1"), second["t"].alias("t2"), (second["offset"] - first["offset"]).alias("step")).distinct()


def postings(numbers: DataFrame, terms: DataFrame) -> DataFrame:
    """The positional index of `terms` (`t`): `t, doc_id, positions`, positions from 0, ascending; spread by term and document."""
    each = numbers.select("doc_id", F.posexplode("words").alias("pos", "t"))
    return each.join(broadcast_checked(terms), "t").groupBy("t", "doc_id").agg(F.array_sort(F.collect_list("pos")).alias("positions"))


def phrase_places(anchored: DataFrame, index: DataFrame) -> DataFrame:
    """`doc_id, item_id, shift, low, high`: where both terms of a window stand at their distance.

    `shift` is the place in the document less that in the item; the terms found lie from `low` to `high` in the item.
    """
    lists = index.select("t", "doc_id", F.explode("positions").alias("pos"))
    moves = broadcast_checked(durable(anchored.select("t1", "t2", "step").distinct()))
    moved = lists.withColumnRenamed("t", "t1").join(moves, "t1").select("doc_id", "t1", "t2", "step", "pos", (F.col("pos") + F.col("step")).alias("there"))
    second = lists.select(F.col("t").alias("t2"), "doc_id", F.col("pos").alias("there"))
    met = moved.join(second, ["doc_id", "t2", "there"]).select("doc_id", "t1", "t2", "step", "pos")
    met = met.join(broadcast_checked(anchored), ["t1", "t2", "step"])
    shift, other = (F.col("pos") - F.col("place")).alias("shift"), F.col("place") + F.col("step")
    return met.groupBy("doc_id", "item_id", shift).agg(F.min(F.least("place", other)).alias("low"), F.max(F.greatest("place", other)).alias("high"))


def _equal_windows(batches):
    """Of each place the starts of the windows all of whose words agree."""
    for batch in batches:
        said, meant = batch.column("said"), batch.column("meant")
        lengths = said.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(lengths)), lengths)
        offset = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        n, first, shift = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n", "first", "shift"))
        agree = np.r_[0, np.cumsum(said.flatten().to_numpy() == meant.flatten().to_numpy())]
        at = np.flatnonzero(offset + n[row] <= lengths[row])
        at = at[agree[at + n[row[at]]] - agree[at] == n[row[at]]]
        take = pa.array(row[at])
        columns = [batch.column("doc_id").take(take), batch.column("item_id").take(take), pa.array(shift[row[at]].astype(np.int32)), pa.array((first[row[at]] + offset[at]).astype(np.int32))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "shift", "start"])


def item_numbers(items: DataFrame, terms: Terms) -> DataFrame:
    """`item_id, item`: the words of each item as the numbers of its terms."""
    each = item_words(items).distinct().select("item_id", "words", F.posexplode("words").alias("pos", "term")).join(broadcast_checked(terms.table), "term")
    return each.groupBy("item_id", "words").agg(F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("a")).select("item_id", F.col("a.t").alias("item"))


def phrase_matches(documents: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """`doc_id, item_id, shift, start`: the windows of an item, by their first word's place in it, that a document holds at this shift."""
    wins = windows(items, run)
    terms = Terms(wins.select(F.explode("words").alias("term")).distinct())
    numbers = written(document_numbers(documents, terms))
    anchored = durable(anchors(wins, durable(frequencies(numbers, terms))))
    index = written(postings(numbers, durable(anchored.select(F.explode(F.array("t1", "t2")).alias("t")).distinct())))
    known = broadcast_checked(durable(item_numbers(items, terms)))
    # only windows that reach the terms found can hold them; `first` to `last` are their first words' places in the item
    reach = phrase_places(anchored, index).join(known, "item_id").withColumn("n", F.least(F.size("item"), F.lit(run)))
    first, last = F.greatest(F.col("low") - run + 1, -F.col("shift"), F.lit(0)), F.least(F.col("high"), F.size("item") - F.col("n"))
    tried = reach.select("doc_id", "item_id", "shift", "n", first.alias("first"), last.alias("last")).filter("first <= last")
    met = numbers.join(tried, "doc_id").withColumn("last", F.least("last", F.size("words") - F.col("n") - F.col("shift"))).filter("first <= last")
    width = F.col("last") - F.col("first") + F.col("n")
    said = met.select("doc_id", "item_id", "shift", "n", "first", width.alias("width"), F.slice("words", F.col("first") + F.col("shift") + 1, width).alias("said"))
    compared = said.join(known, "item_id").select("doc_id", "item_id", "shift", "n", "first", "said", F.slice("item", F.col("first") + 1, F.col("width")).alias("meant"))
    return compared.mapInArrow(_equal_windows, "doc_id bigint, item_id bigint, shift int, start int")


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """`doc_id, item_id` of documents that hold a window of an item."""
    return phrase_matches(documents, items).select("doc_id", "item_id").distinct()


def leak_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Per (document, item): number of matched windows of the item, their share of all its windows, and the first place in the document."""
    n = windows(items).groupBy("item_id").agg(F.count("*").alias("n_windows"))
    per = phrase_matches(documents, items).groupBy("doc_id", "item_id").agg(F.countDistinct("start").alias("matched"), F.min(F.col("start") + F.col("shift")).alias("first_word"))
    return per.join(broadcast_checked(n), "item_id").select("doc_id", "item_id", "matched", "n_windows", (F.col("matched") / F.col("n_windows")).alias("coverage"), "first_word")


def proximity(documents: DataFrame, items: DataFrame, near: int = NEAR) -> DataFrame:
    """`doc_id, item_id`: documents in which the three rarest terms of an item stand within `near` words, in any order.

    Items with fewer than three terms that occur in documents have no such match. Along a document's positions of the three terms the
    last place of each is carried on; a match is a position from which all three lie within reach.
    """
    each = item_words(items).select("item_id", F.explode(F.array_distinct("words")).alias("term"))
    terms = Terms(each.select("term").distinct())
    numbers = written(document_numbers(documents, terms))
    df = durable(frequencies(numbers, terms))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("df", "term"))
    chosen = durable(each.distinct().join(broadcast_checked(df), "term").withColumn("slot", rank).filter("slot <= 3").select("item_id", "slot", "t"))
    index = written(postings(numbers, chosen.select("t").distinct()))
    # a document without all three terms is left out before any position is read
    met = index.join(broadcast_checked(chosen), "t")
    whole = met.groupBy("doc_id", "item_id").agg(F.count("*").alias("slots")).filter("slots = 3").drop("slots")
    places = met.join(whole, ["doc_id", "item_id"]).select("doc_id", "item_id", "slot", F.explode("positions").alias("pos"))
    so_far = Window.partitionBy("doc_id", "item_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    last = [F.max(F.when(F.col("slot") == k, F.col("pos"))).over(so_far) for k in (1, 2, 3)]
    seen = places.select("doc_id", "item_id", "pos", *[x.alias(f"p{k}") for k, x in enumerate(last)]).dropna()
    return seen.filter(F.col("pos") - F.least("p0", "p1", "p2") < near).select("doc_id", "item_id").distinct()
