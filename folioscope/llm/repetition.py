"""Repetition inside a single document.

Of each document a vector of statistics is taken, transformed so that usual documents lie in one cloud: shares of words within
repeated runs of 8 and of 3 words, share of the most frequent word (each as the arcsine of its root) and the logarithm of the number
of words. Per language and source, location and spread of the cloud come from the minimum covariance determinant: of all halves of the
group, the one whose covariance has the least determinant. It is sought from four deterministic starts (medians and quartiles; the covariances of
hyperbolic tangents, of spatial signs, and of the whole group); from each, concentration steps keep the half nearest by Mahalanobis
distance and take its mean and covariance; after two steps the start with the least determinant goes on until that falls no more. Documents
further than the chi-square quantile are outliers. The shares themselves are exact.

A step is one aggregate over all documents: their moments are added up per bin of the distance's logarithm (16 bins to a doubling), and the
nearest half is the sum of the nearest bins, the last one in proportion. Sums are combined before the shuffle, so a language or source
may hold any share of the corpus, and the estimate of all documents meets them as four rows at most. Groups under `LEAST_GROUP` documents, too few for
a covariance of their own, use their language's estimate, else that of all documents. Each document is also held against the
estimate of all, as a source may repeat itself in more than half of its documents; one distance beyond the quantile is enough.

A word is repeated if it lies in a run of 8 words that equals a run beginning earlier in the same document.

Defined cases: rows without doc_id are left out; a null, empty or short text (under 8 words) has no repeated words; documents under `LEAST_WORDS` words are measured but
take no part in the estimates and are no outliers; unknown language and source form groups of their own; equal distances share a bin and
count alike in a concentration step; equal determinants go to the first start; an empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.core.runtime import BROADCAST_ROWS, broadcast_checked, durable
from folioscope.llm.text import hashed_words, identified, mix, run_hashes

RUN, SHORT_RUN = 8, 3
LEAST_WORDS, LEAST_SHARE_PERCENT = 40, 30
LEAST_GROUP = 200
#: The share of a group that a concentration step keeps, and the quantile beyond which a document is an outlier.
KEPT, QUANTILE = 0.5, 0.999
#: Steps of every start, and by how much the logarithm of the best one's determinant has to fall for another step.
FIRST_STEPS, FALL = 2, 0.01
#: Bins of squared distances to a doubling.
FINE = 16
#: The least standard deviation of a statistic: most documents repeat nothing, which would leave a covariance without inverse.
LEAST_DEVIATION = 0.02
VECTOR = ("x0", "x1", "x2", "x3")
P = len(VECTOR)


def repeated_words(hashes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Of each text the number of words within runs of `size` words that began earlier in the text."""
    run, owner, at = run_hashes(hashes, counts, size)
    if not len(run):
        return np.zeros(len(counts), np.int64)
    key = run ^ mix(owner.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    step = np.zeros(len(hashes) + 1, np.int64)
    step[at[again]] += 1
    step[at[again] + size] -= 1
    covered = np.cumsum(step[:-1]) > 0
    return np.bincount(np.repeat(np.arange(len(counts)), counts), weights=covered, minlength=len(counts)).astype(np.int64)


def most_frequent(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each text how often its most frequent word occurs."""
    owner = np.repeat(np.arange(len(counts)), counts)
    out = np.zeros(len(counts), np.int64)
    if len(hashes):
        key = hashes ^ mix(owner.astype(np.uint64) + np.uint64(1))
        order = np.argsort(key, kind="stable")
        key = key[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        np.maximum.at(out, owner[order[starts]], np.diff(np.r_[starts, len(key)]))
    return out


def _measure(batches):
    for batch in batches:
        hashes, counts = hashed_words(batch.column("text").to_pylist())
        columns = [batch.column(c) for c in ("doc_id", "lang", "source")]
        measures = [counts, repeated_words(hashes, counts, RUN), repeated_words(hashes, counts, SHORT_RUN), most_frequent(hashes, counts)]
        yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, measures)], names=["doc_id", "lang", "source", "n_words", "n_repeated", "n_short", "n_top"])


def measures(documents: DataFrame) -> DataFrame:
    """`doc_id, lang, source, n_words, n_repeated, n_short, n_top` of each document."""
    schema = "doc_id bigint, lang string, source string, n_words bigint, n_repeated bigint, n_short bigint, n_top bigint"
    return identified(documents, "doc_id").select("doc_id", "lang", "source", "text").mapInArrow(_measure, schema)


def language(lang: Column) -> Column:
    """Two letters of a language written in different ways; `--` where unknown."""
    two = F.substring(F.lower(F.trim(lang)), 1, 2)
    two = F.when(two == "ge", "de").when(two == "sp", "es").otherwise(two)
    return F.when(two.rlike("^[a-z]{2}$"), two).otherwise("--")


def vectors(measured: DataFrame) -> DataFrame:
    """Adds the transformed statistics x0..x3."""
    share = lambda c: F.asin(F.sqrt(F.col(c) / F.greatest("n_words", F.lit(1))))
    return measured.select("*", share("n_repeated").alias("x0"), share("n_short").alias("x1"), share("n_top").alias("x2"), F.log1p("n_words").alias("x3"))


def grouped(rows: DataFrame) -> DataFrame:
    """Adds `grp`: language and source, or language alone, or all, whichever has enough documents."""
    rows = rows.withColumn("lg", language(F.col("lang"))).withColumn("fine", F.concat_ws("|", "lg", F.coalesce("source", F.lit("?"))))
    n = rows.groupBy("lg", "fine").count()
    coarse = n.groupBy("lg").agg(F.sum("count").alias("n_lg"))
    choice = n.join(coarse, "lg").select("fine", F.when(F.col("count") >= LEAST_GROUP, F.col("fine")).when(F.col("n_lg") >= LEAST_GROUP, F.col("lg")).otherwise("all").alias("grp"))
    return rows.join(broadcast_checked(choice), "fine").drop("fine", "lg")


def chi_square(q: float, even: int) -> float:
    """Quantile of the chi-square distribution for an even number of degrees of freedom, by bisection."""
    low, high = 0.0, 1000.0
    for _ in range(80):
        x = (low + high) / 2
        low, high = (x, high) if chi_square_cdf(x, even) < q else (low, x)
    return low


def chi_square_cdf(x: float, even: int) -> float:
    term, total = 1.0, 1.0
    for k in range(1, even // 2):
        term *= x / 2 / k
        total += term
    return 1 - math.exp(-x / 2) * total


def distance(row: str = "e") -> Column:
    """Squared Mahalanobis distance of x0..x3 by the centre and the inverse covariance in `row`."""
    d = [F.col(x) - F.col(f"{row}.centre")[i] for i, x in enumerate(VECTOR)]
    return sum((d[i] * d[j] * F.col(f"{row}.inverse")[i * P + j] * (1 if i == j else 2) for i in range(P) for j in range(i, P)), F.lit(0.0))


PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
ESTIMATE = "grp string, start int, centre array<double>, inverse array<double>, logdet double"


def moments(terms: list[Column], name: str) -> list[Column]:
    """The sums of the terms and of their products, as one array column each."""
    return [F.array(*[F.sum(t) for t in terms]).alias(f"{name}_sum"), F.array(*[F.sum(terms[i] * terms[j]) for i, j in PAIRS]).alias(f"{name}_square")]


def covariance(total: float, sums: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean, square = sums / total, np.zeros((P, P))
    for (i, j), v in zip(PAIRS, squares / total, strict=True):
        square[i, j] = square[j, i] = v
    return mean, square - np.outer(mean, mean)


def estimated(mean: np.ndarray, cov: np.ndarray) -> tuple[list[float], list[float], float]:
    """Centre, inverse covariance and the logarithm of its determinant."""
    cov = cov + np.eye(P) * LEAST_DEVIATION**2
    return mean.tolist(), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1])


def _starts(frames):
    for f in frames:
        out = []
        for r in f.itertuples(index=False):
            middle, scale = np.asarray(r.middle), np.asarray(r.scale)
            out.append((r.grp, 0, *estimated(middle, np.diag(scale * scale))))
            for k, name in enumerate(("tanh", "sign"), 1):
                _, cov = covariance(r.n, np.asarray(getattr(r, f"{name}_sum")), np.asarray(getattr(r, f"{name}_square")))
                spread = np.sqrt(np.maximum(np.diag(cov), 1e-12))
                out.append((r.grp, k, *estimated(middle, cov / np.outer(spread, spread) * np.outer(scale, scale))))
            out.append((r.grp, 3, *estimated(*covariance(r.n, np.asarray(r.whole_sum), np.asarray(r.whole_square)))))
        yield pd.DataFrame(out, columns=["grp", "start", "centre", "inverse", "logdet"])


def starts(every: DataFrame) -> DataFrame:
    """The four starts of each group; their determinants are not those of a half, and count as infinite."""
    quarters = [F.percentile_approx(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000).alias(x) for x in VECTOR]
    robust = every.groupBy("grp").agg(*quarters)
    scale = [F.greatest((F.col(x)[2] - F.col(x)[0]) / 1.349, F.lit(LEAST_DEVIATION)) for x in VECTOR]
    robust = durable(robust.select("grp", F.array(*[F.col(x)[1] for x in VECTOR]).alias("middle"), F.array(*scale).alias("scale")))
    z = [(F.col(x) - F.col("middle")[i]) / F.col("scale")[i] for i, x in enumerate(VECTOR)]
    norm = F.sqrt(sum((v * v for v in z), F.lit(1e-12)))
    sums = every.join(broadcast_checked(robust), "grp").groupBy("grp").agg(
        F.count("*").alias("n"), *moments([F.tanh(v) for v in z], "tanh"), *moments([v / norm for v in z], "sign"), *moments([F.col(x) for x in VECTOR], "whole")
    )
    return sums.join(broadcast_checked(robust), "grp").mapInPandas(_starts, ESTIMATE).withColumn("logdet", F.lit(math.inf))


def half(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, covariance and number of the nearest `KEPT` of a group's documents, from the moments of its bins."""
    frame = frame.sort_values("bin")
    n = frame["n"].to_numpy(float)
    wanted = max(KEPT * n.sum(), 1.0)
    before = np.cumsum(n) - n
    taken = np.clip((wanted - before) / n, 0.0, 1.0)
    sums, squares = taken @ np.stack(frame["x_sum"].to_numpy()), taken @ np.stack(frame["x_square"].to_numpy())
    return *covariance(wanted, sums, squares), wanted


def _concentrate(frame: pd.DataFrame) -> pd.DataFrame:
    mean, cov, _ = half(frame)
    # the covariance of the nearest share of a normal cloud is too small by this factor
    factor = KEPT / chi_square_cdf(chi_square(KEPT, P), P + 2)
    return pd.DataFrame([(frame["grp"].iloc[0], frame["start"].iloc[0], *estimated(mean, cov * factor), frame["was"].iloc[0])], columns=["grp", "start", "centre", "inverse", "logdet", "was"])


def concentrate(rows: DataFrame, estimate: DataFrame, few: bool) -> DataFrame:
    """One concentration step of every start in `estimate`: mean and covariance of the nearest half of its group; `was` is the determinant before.

    `few` says that the estimates may be broadcast.
    """
    e = estimate.select("grp", "start", F.struct("centre", "inverse").alias("e"), F.col("logdet").alias("was"))
    own = rows.filter("grp <> 'all'").join(F.broadcast(e) if few else e, "grp")
    whole = rows.drop("grp").crossJoin(F.broadcast(e.filter("grp = 'all'")))  # at most four rows
    cut = F.floor(F.log2(distance() + 1e-9) * FINE).cast("int").alias("bin")
    near = own.select("grp", "start", "was", cut, *VECTOR).unionByName(whole.select("grp", "start", "was", cut, *VECTOR))
    binned = near.groupBy("grp", "start", "was", "bin").agg(F.count("*").alias("n"), *moments([F.col(x) for x in VECTOR], "x"))
    return binned.groupBy("grp", "start").applyInPandas(_concentrate, f"{ESTIMATE}, was double")


def least_determinants(rows: DataFrame) -> DataFrame:
    """`grp, start, centre, inverse, logdet`: of each group, and of `all`, the estimate with the least determinant.

    All starts take `FIRST_STEPS`; of each group the best goes on until its determinant falls no more.
    """
    every = rows.filter("grp <> 'all'").unionByName(rows.withColumn("grp", F.lit("all")))
    now = durable(starts(every.select("grp", *VECTOR)))
    few = now.count() <= BROADCAST_ROWS
    for _ in range(FIRST_STEPS):
        now = durable(concentrate(rows, now, few))
    best = now.groupBy("grp").agg(F.min(F.struct("logdet", "start", "centre", "inverse")).alias("b")).select("grp", "b.start", "b.centre", "b.inverse", "b.logdet")
    parts, going = [], durable(best)
    while True:
        after = durable(concentrate(rows, going, few))
        falls = F.col("logdet") < F.col("was") - FALL
        parts.append(after.filter(~falls).drop("was"))
        going = after.filter(falls).drop("was")
        if not going.limit(1).count():
            return reduce(DataFrame.unionByName, parts)


def outliers(documents: DataFrame) -> DataFrame:
    """`doc_id, n_words, n_repeated, share, distance, is_outlier` of documents of at least `LEAST_WORDS` words; the greater of both distances."""
    rows = durable(grouped(vectors(durable(measures(documents)).filter(F.col("n_words") >= LEAST_WORDS))).select("doc_id", "n_words", "n_repeated", "grp", *VECTOR))
    estimate = durable(least_determinants(rows)).select("grp", F.struct("centre", "inverse").alias("e"))
    own = rows.join(broadcast_checked(estimate), "grp").withColumn("own", distance())
    whole = F.broadcast(estimate.filter("grp = 'all'").select(F.col("e").alias("all")))  # one row
    scored = own.crossJoin(whole).withColumn("distance", F.greatest(F.col("own"), distance("all")))
    beyond = F.col("distance") > chi_square(QUANTILE, P)
    return scored.select("doc_id", "n_words", "n_repeated", (F.col("n_repeated") / F.col("n_words")).alias("share"), "distance", beyond.alias("is_outlier"))


def repetitive(documents: DataFrame) -> DataFrame:
    """`doc_id` of the outliers whose share of repeated words reaches the threshold."""
    return outliers(documents).filter(F.col("is_outlier") & (F.col("n_repeated") * 100 >= F.col("n_words") * LEAST_SHARE_PERCENT)).select("doc_id")


def shares(documents: DataFrame) -> DataFrame:
    """`doc_id, n_words, n_repeated, share` of every document; the share of a document without words is 0."""
    m = measures(documents)
    return m.select("doc_id", "n_words", "n_repeated", F.when(F.col("n_words") > 0, F.col("n_repeated") / F.col("n_words")).otherwise(0.0).alias("share"))
