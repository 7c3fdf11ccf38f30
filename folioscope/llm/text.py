"""Words, lines, sites and current pages, as the operators on text see them."""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.masking import once

#: A word is a maximal run of letters or digits of any script; `_` is neither.
WORD = re.compile(r"[^\W_]+")
JAVA_WORD = r"[\p{L}\p{N}]+"

MASK = (1 << 64) - 1


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def words_column(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({JAVA_WORD})"), 1)


def site_column(url: Column) -> Column:
    """The host of a URL, lower-cased, without leading `www.` and port; null where there is none."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    host = F.regexp_replace(host, r"^www\.", "")
    return F.when(host != "", host)


class WordHashes(dict):
    """64-bit hash of a word, alike in every process; the cache starts anew when it has grown."""

    most = 1_000_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) - (1 << 63)
        return value


_HASHES = WordHashes()


def hashed_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of all texts in a row, and the number of words of each text."""
    counts, parts, get = np.zeros(len(texts), np.int64), [], _HASHES.__getitem__
    for i, text in enumerate(texts):
        if text:
            found = WORD.findall(text.lower())
            counts[i] = len(found)
            parts.append(np.fromiter(map(get, found), np.int64, len(found)))
    return (np.concatenate(parts) if parts else np.zeros(0, np.int64)).view(np.uint64), counts


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finalizer of splitmix64)."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def run_hashes(hashes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` consecutive words that lie within one text: (hash, index of the text, place of the first word in the row)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for k in range(size):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n])
    owner = np.repeat(np.arange(len(counts)), counts)
    at = np.flatnonzero(owner[:n] == owner[size - 1 :])
    return out[at], owner[at], at


def identified(df: DataFrame, key: str) -> DataFrame:
    """Rows with an id; a row without one is no page or document, and is left out."""
    return df.filter(F.col(key).isNotNull())


def latest(df: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """One row per `key`: of several deliveries the one with the greatest `order` (then values). For narrow rows."""
    kept = [order, *[v for v in values if v != order]]
    return df.groupBy(key).agg(F.max(F.struct(*kept)).alias("_r")).select(key, *[f"_r.{v}" for v in values])


def without_lines(df: DataFrame, text: str, drop: str) -> DataFrame:
    """`df` with the lines of column `text` joined again without those whose numbers (from 1) are in the array `drop`.

    The numbers kept come from one set difference, so the work is that of lines plus dropped lines, not of their product.
    """
    lines = F.split(text, "\n", -1)
    kept = once(df, _lines=lines, _at=F.array_except(F.sequence(F.lit(1), F.size(lines)), drop))
    return kept.withColumn(text, F.array_join(F.transform("_at", lambda i: F.get("_lines", i - 1)), "\n")).drop("_lines", "_at")
