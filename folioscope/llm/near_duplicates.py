"""Near-duplicate pages.

The set of runs of five consecutive words of a page is sketched by one-permutation hashing: each run is hashed once, the hash names
a bin and a value, and a bin keeps its least value; an empty bin borrows from a filled one that a fixed sequence of probes, of its own
for each bin, reaches first (optimal densification). The bins form bands; pages with an equal band share a bucket. Each bucket joins
its pages to one centre only, the page whose hash with the band is least, so a bucket of n pages gives n - 1 edges. As the centre
changes from band to band, the union of the stars links the pages of a group in many ways.

Pages with the same words in the same order form a class and take part once, by their least id. Edges are checked on the exact sets.
Pairs of two members of one star are candidates too: if both lie so near to the centre that the triangle inequality (1 - Jaccard is a
metric) allows the threshold. What the inequality already proves isn't read again. For groups, such pairs are looked at only where
they could join two groups that the edges leave apart.

Defined cases: rows without page_id, pages with fewer than `LEAST_WORDS` words, and null texts, take no part; of several deliveries of a page the one
with the greatest `loaded_at` counts; ties between centres go to the least id; an empty table gives no rows.

Scale: signatures are a few hundred bytes a page; stars bound the edges by bands x pages, whatever the size of a bucket; a hot bucket's
centre is found by a partial aggregate and met by a join, which splits it. Sets of runs are built only for pages with an edge. `pairs`
has as many rows as there are pairs, as asked; its joins of hot stars and classes are cut into blocks of `BLOCK` rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.core.runtime import broadcast_checked, durable
from folioscope.llm.text import hashed_words, identified, latest, mix, run_hashes

RUN, LEAST_WORDS, SIMILARITY_PERCENT = 5, 100, 70
BANDS, ROWS = 32, 4
BINS = BANDS * ROWS
#: An edge to a centre is kept for the search of further pairs from this similarity on: two pages at 0.7 to each other.
HOP_PERCENT = 40
#: Rows of one join key that one task takes.
BLOCK = 1000
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def probes(bins: int = BINS, tries: int = 64) -> np.ndarray:
    """For each bin the bins from which it borrows when it is empty, in order of trial."""
    seed = np.arange(bins, dtype=np.uint64)[:, None] * np.uint64(tries) + np.arange(tries, dtype=np.uint64)[None, :] + np.uint64(0x5851F42D4C957F2D)
    return (mix(seed) % np.uint64(bins)).astype(np.int64)


def sketch(runs: np.ndarray, owner: np.ndarray, n: int, bins: int = BINS) -> np.ndarray:
    """The densified signature of each of `n` sets of run hashes; a row of `EMPTY` for an empty set."""
    shift = np.uint64(64 - bins.bit_length() + 1)
    table = np.full(n * bins, EMPTY)
    np.minimum.at(table, owner * bins + (runs >> shift).astype(np.int64), runs & ((np.uint64(1) << shift) - np.uint64(1)))
    table = table.reshape(n, bins)
    filled, ways = table != EMPTY, probes(bins)
    lines, holes = np.nonzero(~filled & filled.any(axis=1)[:, None])
    out = table.copy()
    for t in range(ways.shape[1]):
        if not len(lines):
            break
        source = ways[holes, t]
        ok = filled[lines, source]
        out[lines[ok], holes[ok]] = table[lines[ok], source[ok]]
        lines, holes = lines[~ok], holes[~ok]
    for i, j in zip(lines, holes, strict=True):  # no probe met a filled bin: the next filled one
        out[i, j] = table[i, np.flatnonzero(filled[i])[np.searchsorted(np.flatnonzero(filled[i]), j) % filled[i].sum()]]
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key a band, which says the band's number too."""
    n, bins = signature.shape
    parts = signature.reshape(n, bands, bins // bands)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), (n, bands)).copy()
        for k in range(parts.shape[2]):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key


def _sequence_hash(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A hash of each text's words in their order."""
    starts = np.cumsum(counts) - counts
    place = np.arange(len(hashes)) - np.repeat(starts, counts)
    with np.errstate(over="ignore"):
        terms = mix(hashes ^ mix(place.astype(np.uint64) + np.uint64(7)))
        total = np.r_[np.uint64(0), np.cumsum(terms, dtype=np.uint64)]
        return mix(total[starts + counts] - total[starts] + counts.astype(np.uint64))


def _pieces(batches, rows: int = 2000):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _signatures(batches):
    for batch in _pieces(batches):
        hashes, counts = hashed_words(batch.column("text").to_pylist())
        long = np.flatnonzero(counts >= LEAST_WORDS)
        hashes = hashes[np.repeat(counts >= LEAST_WORDS, counts)]
        counts = counts[long]
        runs, owner, _ = run_hashes(hashes, counts, RUN)
        keys = band_keys(sketch(runs, owner, len(counts))).view(np.int64)
        arrays = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
        take = pa.array(long)
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id").take(take), batch.column("loaded_at").take(take), pa.array(_sequence_hash(hashes, counts).view(np.int64)), arrays], names=["page_id", "loaded_at", "words_hash", "bands"]
        )


def signatures(pages: DataFrame) -> DataFrame:
    """`page_id, words_hash, bands` of pages of at least `LEAST_WORDS` words."""
    rows = identified(pages, "page_id").select("page_id", F.col("loaded_at").cast("timestamp").alias("loaded_at"), "text")
    made = rows.mapInArrow(_signatures, "page_id bigint, loaded_at timestamp, words_hash bigint, bands array<bigint>")
    return latest(made, "page_id", "loaded_at", ["words_hash", "bands"])


def _run_sets(batches):
    for batch in _pieces(batches):
        hashes, counts = hashed_words(batch.column("text").to_pylist())
        runs, owner, _ = run_hashes(hashes, counts, RUN)
        order = np.lexsort((runs, owner))
        runs, owner = runs[order], owner[order]
        first = np.r_[True, (runs[1:] != runs[:-1]) | (owner[1:] != owner[:-1])][: len(runs)]
        runs, owner = runs[first], owner[first]
        ends = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(counts)))].astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(runs.view(np.int64)))], names=["page_id", "runs"])


def run_sets(pages: DataFrame, ids: DataFrame) -> DataFrame:
    """`page_id, runs`: the exact set of run hashes of the pages in `ids`."""
    wanted = pages.select("page_id", "text").join(broadcast_checked(ids), "page_id", "left_semi")
    return wanted.mapInArrow(_run_sets, "page_id bigint, runs array<bigint>").dropDuplicates(["page_id"])


def star_edges(classes: DataFrame) -> DataFrame:
    """`a, b` (a < b): each bucket's pages joined to its centre."""
    buckets = classes.select("page_id", F.explode("bands").alias("bucket"))
    order = F.struct(F.xxhash64("page_id", "bucket"), "page_id")
    centres = buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.min_by("page_id", order).alias("centre")).filter("n > 1").drop("n")
    met = buckets.join(centres, "bucket").filter("page_id <> centre")
    return met.select(F.least("page_id", "centre").alias("a"), F.greatest("page_id", "centre").alias("b")).distinct()


def similarities(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """`a, b, common, together`: sizes of the intersection and of the union of both sets of runs."""
    one = lambda k: sets.select(F.col("page_id").alias(k), F.col("runs").alias(f"runs_{k}"))
    met = edges.join(one("a"), "a").join(one("b"), "b")
    met = met.select("a", "b", F.size(F.array_intersect("runs_a", "runs_b")).alias("common"), (F.size("runs_a") + F.size("runs_b")).alias("sum"))
    return met.select("a", "b", "common", (F.col("sum") - F.col("common")).alias("together"))


def met_in_blocks(rows: DataFrame, key: str, x: list[str], y: list[str], block: int = BLOCK) -> DataFrame:
    """`rows` joined with themselves on `key`, with the columns `x` of one side and `y` (new names, in the same order) of the other.

    A key of over `block` rows is cut into blocks by a hash of its first column, and each pair of blocks is a join key of its own, so that
    no task gets a whole hot key.
    """
    hot = durable(rows.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > block))
    parts = F.coalesce(F.ceil(F.col("_n") / block), F.lit(1)).cast("int")
    cut = rows.join(broadcast_checked(hot), key, "left").withColumn("_parts", parts).withColumn("_own", F.pmod(F.xxhash64(F.col(x[0]), F.lit(1)), F.col("_parts")))
    every = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    left = cut.select(key, *x, F.col("_own").alias("_i"), every.alias("_j"))
    right = cut.select(key, *[F.col(c).alias(d) for c, d in zip(x, y, strict=True)], every.alias("_i"), F.col("_own").alias("_j"))
    return left.join(right, [key, "_i", "_j"]).drop("_i", "_j")


def near_ends(edges: DataFrame) -> DataFrame:
    """`a, x, dx`: of each page its neighbours along the edges that are near enough to lead to a pair over the threshold."""
    d = edges.select("a", F.col("b").alias("x"), (1 - F.col("common") / F.col("together")).alias("dx")).filter(F.col("dx") <= 1 - HOP_PERCENT / 100)
    return d.unionByName(d.select(F.col("x").alias("a"), F.col("a").alias("x"), "dx"))


def hop_pairs(edges: DataFrame) -> DataFrame:
    """Pairs of two neighbours of one page that no edge joins yet, as far as the triangle inequality allows the threshold.

    `sure` says that it proves the threshold. These pairs are asked for one by one in `pairs`; `groups` does without them.
    """
    bound = 1 - SIMILARITY_PERCENT / 100
    pairs = met_in_blocks(near_ends(edges), "a", ["x", "dx"], ["y", "dy"]).filter("x < y").filter(F.abs(F.col("dx") - F.col("dy")) <= bound + 1e-9)
    pairs = pairs.groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.min(F.col("dx") + F.col("dy")).alias("most"))
    return pairs.join(edges.select("a", "b"), ["a", "b"], "left_anti").select("a", "b", (F.col("most") < bound - 1e-9).alias("sure"))


def parting_pairs(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """`a, b`: two neighbours of one page that the components (`id, root`) hold apart, as far as the triangle inequality allows the threshold.

    Where all near neighbours of a page are in one component, there is nothing to look at; else those outside the largest one meet the others.
    """
    ends = durable(near_ends(edges).join(roots.select(F.col("id").alias("x"), F.col("root").alias("rx")), "x"))
    per = ends.groupBy("a", "rx").agg(F.count("*").alias("n"))
    mixed = durable(per.groupBy("a").agg(F.count("*").alias("k"), F.max_by("rx", F.struct("n", "rx")).alias("main")).filter("k > 1").select("a", "main"))
    concerned = ends.join(broadcast_checked(mixed), "a")
    outside = concerned.filter("rx <> main").select("a", "x", "dx", "rx")
    others = concerned.select("a", F.col("x").alias("y"), F.col("dx").alias("dy"), F.col("rx").alias("ry"))
    met = outside.join(others, "a").filter((F.col("rx") != F.col("ry")) & (F.abs(F.col("dx") - F.col("dy")) <= 1 - SIMILARITY_PERCENT / 100 + 1e-9))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


class Stars:
    """What both results start from: `classes` (`page_id, rep, n_copies`), the exact `sets` of pages with an edge, and the `edges` with both sizes."""

    def __init__(self, pages: DataFrame):
        signed = durable(signatures(pages))
        reps = signed.groupBy("words_hash").agg(F.min("page_id").alias("rep"), F.count("*").alias("n_copies"))
        classes = signed.join(reps, "words_hash").select("page_id", "rep", "bands", "n_copies")
        edges = durable(star_edges(classes.filter("page_id = rep").select("page_id", "bands")))
        ids = durable(edges.select(F.col("a").alias("page_id")).union(edges.select("b")).distinct())
        self.classes = classes.drop("bands")
        self.sets = durable(run_sets(pages, ids))
        self.edges = durable(similarities(edges, self.sets))


def similar(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("common") * 100 >= F.col("together") * SIMILARITY_PERCENT).select("a", "b")


def pairs(pages: DataFrame) -> DataFrame:
    """`page_id_a, page_id_b` (a < b) of all pages, copies included, at or over the threshold."""
    stars = Stars(pages)
    hops = durable(hop_pairs(stars.edges))
    more = similar(similarities(hops.filter("NOT sure").select("a", "b"), stars.sets))
    found = similar(stars.edges).union(hops.filter("sure").select("a", "b")).union(more)
    members = stars.classes.select("rep", "page_id")
    a, b = members.select(F.col("rep").alias("a"), F.col("page_id").alias("x")), members.select(F.col("rep").alias("b"), F.col("page_id").alias("y"))
    copies = stars.classes.filter("n_copies > 1").select("rep", F.col("page_id").alias("x"))
    own = met_in_blocks(copies, "rep", ["x"], ["y"]).filter("x < y").select("x", "y")
    across = found.join(a, "a").join(b, "b").select("x", "y")
    return across.union(own).select(F.least("x", "y").alias("page_id_a"), F.greatest("x", "y").alias("page_id_b"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """`id, root`: the least id reachable from each node, by large-star and small-star rounds until no edge changes.

    Neighbours of one node are pointed to its least one, so the edges at a root are rows of their own and are only counted and compared, never listed.
    """
    current = durable(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("u < v").distinct())
    size = None
    while True:
        both = current.select(F.col("v").alias("c"), F.col("u").alias("n")).union(current.select(F.col("u").alias("c"), F.col("v").alias("n")))
        least = both.groupBy("c").agg(F.least(F.min("n"), F.col("c")).alias("m"))
        large = both.join(least, "c").filter("n > c").select(F.col("n").alias("v"), F.col("m").alias("u")).filter("v <> u").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.explode(F.array(F.struct("v", F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e")).select("e.v", "e.u").filter("v <> u").distinct()
        current = durable(small)
        now = current.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == size:
            break
        size = now
    roots = current.groupBy(F.col("v").alias("id")).agg(F.min("u").alias("root"))
    return nodes.select("id").join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def groups(pages: DataFrame) -> DataFrame:
    """`page_id, class_id, group_id, n_copies`: of every page of enough words its class of equal pages with their number, and its group of pages linked by similarity.

    The checked edges of the stars join nearly all of a group; pairs beyond them are looked for only where they could join two groups, so a
    family costs its edges and not its pairs. The groups are those of all similar pairs.
    """
    stars = Stars(pages)
    first = durable(components(stars.classes.select(F.col("rep").alias("id")).distinct(), similar(stars.edges)))
    joined = similar(similarities(parting_pairs(stars.edges, first), stars.sets))
    root = lambda k: first.select(F.col("id").alias(k), F.col("root").alias(f"r{k}"))
    between = joined.join(root("a"), "a").join(root("b"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    second = components(first.select(F.col("root").alias("id")).distinct(), between).select(F.col("id").alias("root"), F.col("root").alias("group_id"))
    roots = first.join(second, "root").select(F.col("id").alias("rep"), "group_id")
    return stars.classes.join(roots, "rep").select("page_id", F.col("rep").alias("class_id"), "group_id", "n_copies")
