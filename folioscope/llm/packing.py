"""Filling containers of fixed capacity with documents, by lexical retrieval.

Documents are measured in tokens of a public tokenizer and laid in order of content: each by its nearest of `CENTRES` centres of topics, then
by the next nearest, `KEYS` of them; the centres themselves stand in a chain in which like ones follow each other. They are spherical k-means
over TF-IDF vectors of about `SAMPLE` documents; the order has all documents. It is cut into shards of `SHARD_DOCUMENTS`. Each shard has a BM25 inverted index of its documents. The largest unused document seeds a container; the unused
neighbours that the index returns for the seed's weightiest terms fill its window greedily, best score first, as long as they fit; what room
is left takes the largest unused documents that fit, so that little stays empty. A document over the capacity is cut into full pieces, which
have containers of their own, and a rest that is packed like a document. Nothing else is ever split.

Defined cases: rows without doc_id are left out; a document without tokens (null or empty text) is reported once per kind with no container and 0 tokens; a container
kind without a positive capacity holds nothing and gives no rows; repeated rows of a container kind count once, by the greatest
capacity; ties in size go by doc_id, ties in score too; empty tables give no rows.

A term is a word's 32-bit hash: two words of one shard that share it count as one term for the choice of neighbours, and for nothing else.
Document frequencies, for the order only, are counted over all documents in `COUNTERS` hashed counters, whose number is fixed.

Scale: an exchange by range of (centres, doc_id) splits hot topics and groups of copies, as doc_id is part of the order; a task cuts its
range into shards one after the other and holds one at a time. Only the last containers of a shard are partly filled. A document
travels as its terms and their counts, not as text.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.core.runtime import broadcast_checked, written
from folioscope.llm.text import hashed_words, identified, mix

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the tokenizer splits text before its merges (the published pattern of this vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHARD_DOCUMENTS = 2000
#: BM25's parameters, and the number of a seed's weightiest terms that are looked up.
K1, B, QUERY_TERMS = 1.2, 0.75, 16
#: Centres of topics, how many of them a document's place goes by, the width of its hashed TF-IDF vector, and the documents to fit them on.
CENTRES, KEYS, WIDTH, SAMPLE, ROUNDS = 64, 4, 512, 5000, 12
COUNTERS = 1 << 18
MOST_KINDS = 1000


@functools.cache
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, path: str = TOKENIZER) -> int:
    return len(encoder(path).encode_ordinary(text)) if text else 0


def counted_terms(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The terms of all texts in a row, how often each occurs in its text, and where each text's terms begin and end."""
    hashes, counts = hashed_words(texts)
    owner = np.repeat(np.arange(len(texts)), counts)
    term = (hashes >> np.uint64(32)).astype(np.uint32).view(np.int32)
    order = np.lexsort((term, owner))
    term, owner = term[order], owner[order]
    first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (owner[1:] != owner[:-1])][: len(term)])
    return term[first], np.diff(np.r_[first, len(term)]).astype(np.int32), np.searchsorted(owner[first], np.arange(len(texts) + 1)).astype(np.int32)


def _measure(path: str):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column("text").to_pylist()
                tokens = [count_tokens(t, path) for t in texts]
                terms, times, ends = counted_terms(texts)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (terms, times)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(tokens, pa.int64()), *lists], names=["doc_id", "n_tokens", "terms", "times"])

    return run


def measured(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """`doc_id, n_tokens, terms, times` of each document."""
    return identified(documents, "doc_id").select("doc_id", "text").mapInArrow(_measure(tokenizer), "doc_id bigint, n_tokens bigint, terms array<int>, times array<int>")


def _counters(batches):
    total = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        total += np.bincount(batch.column("terms").flatten().to_numpy() & (COUNTERS - 1), minlength=COUNTERS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["counter", "n"])


def document_frequencies(rows: DataFrame) -> np.ndarray:
    """The number of documents per counter of terms."""
    found = rows.select("terms").mapInArrow(_counters, "counter int, n bigint").groupBy("counter").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(COUNTERS, np.int64)
    df[found["counter"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return df


class Vectors:
    """Hashed TF-IDF vectors of unit length, by the document frequencies of all documents."""

    def __init__(self, df: np.ndarray, documents: int):
        self.idf = np.log(1 + (documents - np.minimum(df, documents) + 0.5) / (df + 0.5)).astype(np.float32)

    def __call__(self, batch: pa.RecordBatch) -> np.ndarray:
        lists, n = batch.column("terms"), batch.num_rows
        terms, times = lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy()
        owner = np.repeat(np.arange(n), lists.value_lengths().to_numpy(zero_copy_only=False))
        weight = self.idf[terms & (COUNTERS - 1)] * times / (times + K1)
        spread = mix(terms.astype(np.uint64))
        sign = np.where(spread >> np.uint64(63), 1.0, -1.0)
        flat = np.bincount(owner * WIDTH + (spread % np.uint64(WIDTH)).astype(np.int64), weight * sign, n * WIDTH)
        out = flat.reshape(n, WIDTH).astype(np.float32)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def _pieces(batches, rows: int = 2000):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _sampled(vectors: Vectors):
    def run(batches):
        for part in _pieces(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([v.tobytes() for v in vectors(part)], pa.binary())], names=["doc_id", "vector"])

    return run


def topic_centres(x: np.ndarray) -> np.ndarray:
    """Spherical k-means of the vectors, as a chain: each centre is followed by the most like of those left."""
    centres = x[np.random.default_rng(0).permutation(len(x))[:CENTRES]]
    for _ in range(ROUNDS):
        nearest = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.maximum(size, 1e-9), centres)
    like, chain, left = centres @ centres.T, [], set(range(len(centres)))
    at = 0
    while left:
        left.discard(at)
        chain.append(at)
        if left:
            at = max(sorted(left), key=lambda j: like[chain[-1], j])
    return centres[chain]


def _keyed(vectors: Vectors, centres: np.ndarray):
    def run(batches):
        for part in _pieces(batches):
            keys = np.zeros((part.num_rows, KEYS), np.int32)
            order = np.argsort(-(vectors(part) @ centres.T), axis=1, kind="stable")[:, :KEYS]
            keys[:, : order.shape[1]] = order
            yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(keys[:, k].copy()) for k in range(KEYS)]], names=[*part.schema.names, *[f"k{k}" for k in range(KEYS)]])

    return run


def in_order(rows: DataFrame) -> DataFrame:
    """`part` and the measured columns, ranges of the order of content as partitions, sorted within."""
    n = rows.count()
    vectors = Vectors(document_frequencies(rows), n)
    some = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(max(n, 1))) < SAMPLE).limit(2 * SAMPLE)
    fitted = some.mapInArrow(_sampled(vectors), "doc_id bigint, vector binary").toPandas().sort_values(["doc_id", "vector"])
    x = np.frombuffer(b"".join(fitted["vector"]), np.float32).reshape(-1, WIDTH)
    centres = topic_centres(x) if len(x) else np.zeros((1, WIDTH), np.float32)
    schema = "doc_id bigint, n_tokens bigint, terms array<int>, times array<int>, " + ", ".join(f"k{k} int" for k in range(KEYS))
    keyed = rows.mapInArrow(_keyed(vectors, centres), schema)
    order = [*[f"k{k}" for k in range(KEYS)], "doc_id"]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "doc_id", "n_tokens", "terms", "times")


class Index:
    """BM25 over the documents of one shard."""

    def __init__(self, terms: np.ndarray, times: np.ndarray, lengths: np.ndarray):
        self.n = len(lengths)
        owner, times = np.repeat(np.arange(self.n), lengths), times.astype(float)
        _, term = np.unique(terms, return_inverse=True)
        df = np.bincount(term)
        size = np.bincount(owner, weights=times, minlength=self.n)
        idf = np.log(1 + (self.n - df + 0.5) / (df + 0.5))
        weight = idf[term] * times * (K1 + 1) / (times + K1 * (1 - B + B * size[owner] / max(size.mean() if self.n else 1.0, 1.0)))
        by_term = np.argsort(term, kind="stable")
        self.documents, self.weights = owner[by_term], weight[by_term]
        self.starts = np.r_[0, np.cumsum(df)]
        # the query of each document: its weightiest terms that occur elsewhere too
        shared = df[term] > 1
        o, t, w = owner[shared], term[shared], weight[shared]
        order = np.lexsort((t, -w, o))
        o, t = o[order], t[order]
        begin = np.searchsorted(o, np.arange(self.n + 1))
        self.queries = [t[begin[i] : min(begin[i + 1], begin[i] + QUERY_TERMS)] for i in range(self.n)]

    def scores(self, seed: int) -> np.ndarray:
        spans = [slice(self.starts[t], self.starts[t + 1]) for t in self.queries[seed]]
        if not spans:
            return np.zeros(self.n)
        return np.bincount(np.concatenate([self.documents[s] for s in spans]), np.concatenate([self.weights[s] for s in spans]), self.n)


def pack(sizes: np.ndarray, capacity: int, index: Index) -> np.ndarray:
    """The container of each item of size 1 to `capacity`, numbered from 0; -1 for items of size 0."""
    n = len(sizes)
    container = np.full(n, -1, np.int64)
    order = np.argsort(sizes, kind="stable")
    sorted_sizes = sizes[order]
    below = np.arange(n) - 1  # a place from which to go on, below a used one
    free = sizes > 0

    def unused_at(i: int) -> int:
        path = []
        while i >= 0 and not free[order[i]]:
            path.append(i)
            i = below[i]
        for p in path:
            below[p] = i
        return i

    number = 0
    top = unused_at(n - 1)
    while top >= 0:
        seed = order[top]
        free[seed], container[seed] = False, number
        room = capacity - sizes[seed]
        if room > 0:
            score = index.scores(seed)
            near = np.flatnonzero(free & (score > 0) & (sizes <= room))
            for d in near[np.lexsort((near, -score[near]))]:
                if sizes[d] <= room:
                    free[d], container[d] = False, number
                    room -= sizes[d]
                    if room == 0:
                        break
            while room > 0:
                i = unused_at(int(np.searchsorted(sorted_sizes, room, side="right")) - 1)
                if i < 0:
                    break
                free[order[i]], container[order[i]] = False, number
                room -= sorted_sizes[i]
        number += 1
        top = unused_at(top)
    return container


def _pack_shard(kinds: list[tuple[str, int]], rows: pa.Table, shard: int):
    doc, tokens = rows.column("doc_id").to_numpy(), rows.column("n_tokens").to_numpy()
    terms, times = rows.column("terms").combine_chunks(), rows.column("times").combine_chunks()
    index = Index(terms.flatten().to_numpy(), times.flatten().to_numpy(), terms.value_lengths().to_numpy(zero_copy_only=False))
    for kind, capacity in kinds:
        full, rest = tokens // capacity, tokens % capacity
        container = pack(rest, capacity, index)
        used = int(container.max(initial=-1)) + 1
        whole = np.repeat(np.arange(len(doc)), full)
        piece = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
        packed = np.flatnonzero((rest > 0) | (tokens == 0))
        size = np.r_[np.full(len(whole), capacity), rest[packed]]
        ids = np.r_[used + np.arange(len(whole)), container[packed]] + (shard << 28)
        columns = [
            pa.array([kind] * len(size), pa.string()),
            pa.array(np.r_[doc[whole], doc[packed]], pa.int64()),
            pa.array(np.r_[piece, full[packed]].astype(np.int32)),
            pa.array(size, pa.int64()),
            pa.array(ids, pa.int64(), mask=size == 0),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["container_kind", "doc_id", "piece_no", "n_tokens", "container_id"])


def _pack_parts(kinds: list[tuple[str, int]], shard_documents: int):
    def run(batches):
        held, n, shard = [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            shard = shard or (batch.column("part")[0].as_py() << 14) + 1
            held.append(batch)
            n += batch.num_rows
            while n >= shard_documents:
                rows = pa.Table.from_batches(held)
                yield from _pack_shard(kinds, rows.slice(0, shard_documents), shard)
                held, n, shard = rows.slice(shard_documents).to_batches(), n - shard_documents, shard + 1
        if n:
            yield from _pack_shard(kinds, pa.Table.from_batches(held), shard)

    return run


def packed(documents: DataFrame, containers: DataFrame, tokenizer: str = TOKENIZER, shard_documents: int = SHARD_DOCUMENTS) -> DataFrame:
    """`container_kind, doc_id, piece_no, n_tokens, container_id`: the container of every piece; ids are unique within a kind."""
    kinds = containers.filter("capacity_tokens > 0 AND container_kind IS NOT NULL").groupBy("container_kind").agg(F.max("capacity_tokens")).orderBy("container_kind").limit(MOST_KINDS + 1).collect()
    if len(kinds) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of containers")
    schema = "container_kind string, doc_id bigint, piece_no int, n_tokens bigint, container_id bigint"
    if not kinds:
        return documents.sparkSession.createDataFrame([], schema)
    rows = in_order(written(measured(documents, tokenizer)))
    return rows.mapInArrow(_pack_parts([(k, int(c)) for k, c in kinds], shard_documents), schema)


def usage(pieces: DataFrame, containers: DataFrame) -> DataFrame:
    """Per kind: number of containers and of pieces, tokens, and the share of room left unused."""
    capacity = containers.groupBy("container_kind").agg(F.max("capacity_tokens").alias("capacity"))
    per = pieces.groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("pieces")).filter("container_id IS NOT NULL")
    total = per.groupBy("container_kind").agg(F.count("*").alias("n_containers"), F.sum("pieces").alias("n_pieces"), F.sum("tokens").alias("n_tokens"))
    met = total.join(broadcast_checked(capacity), "container_kind")
    return met.select("container_kind", "n_containers", "n_pieces", "n_tokens", (1 - F.col("n_tokens") / (F.col("n_containers") * F.col("capacity"))).alias("unused_share"))
