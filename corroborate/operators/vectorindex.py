"""An approximate vector index: inverted lists of product-quantised codes.

Every vector, at unit length, lies in the list of its nearest centroid, as a code of one byte for each part of what it differs
from that centroid. A query takes the lists nearest to it, and by one table of its products with the parts' codebooks
scores their codes without the vectors; only its best codes meet their vectors, by a join on doc_id, and are ranked exactly.

Centroids and codebooks are fitted on at most sample vectors, those with the least hash of doc_id; all vectors are indexed. The
codes are stored list by list, a list of many rows in several files by the hash of doc_id, so that no list is gathered; of a
batch only the rows whose list a query takes are scored for it. At most a tenth of the vectors is ranked exactly for a query.

Cases: null vectors are not indexed and find nothing; one of length 0 scores 0 with all; equal scores rank by doc_id; all vectors
have one length; an empty index finds nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from corroborate.operators import retrieval as X
from corroborate.session import ship, written

LISTS = 64
PROBES = 48
PARTS = 16
BEST = 20  # codes that are ranked exactly, for each of a query's first k
SHARE = 10  # one in so many vectors is ranked exactly for a query at most, but k in any case
SAMPLE = 20_000
LIST_ROWS = 1 << 20


@dataclass(frozen=True)
class Codebook:
    """Centroids (lists, width), and for each part of the width its words (parts, words, width / parts), padded with zeros."""

    centroids: np.ndarray
    words: np.ndarray
    width: int

    def padded(self, x: np.ndarray) -> np.ndarray:
        """x with the width that the parts make up."""
        full = self.words.shape[0] * self.words.shape[2]
        return np.pad(x, ((0, 0), (0, full - x.shape[1]))) if x.shape[1] < full else x[:, :full]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list, code) of unit vectors."""
        near = (x @ self.centroids.T).argmax(1)
        rest = self.padded(x - self.centroids[near]).reshape(len(x), self.words.shape[0], -1)
        code = np.stack([(rest[:, p] @ w.T * 2 - (w * w).sum(1)).argmax(1) for p, w in enumerate(self.words)], 1)
        return near.astype(np.int32), code.astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Products (parts, words, queries) of unit queries with the parts' words."""
        split = self.padded(q).reshape(len(q), self.words.shape[0], -1)
        return np.einsum("qpd,pwd->pwq", split, self.words)


def _means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator, unit: bool) -> np.ndarray:
    """k-means, of unit centroids by the largest product or of any by the least distance; fewer rows than k are the centroids themselves."""
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds if len(x) > k else 0):
        near = (x @ c.T - (0 if unit else (c * c).sum(1) / 2)).argmax(1)
        total, size = np.zeros_like(c), np.bincount(near, minlength=len(c))[:, None]
        np.add.at(total, near, x)
        length = np.linalg.norm(total, axis=1, keepdims=True) if unit else size
        c = np.where(length > 0, total / np.maximum(length, 1e-12), c)
    return c


def fit(x: np.ndarray, lists: int = LISTS, parts: int = PARTS, words: int = 256, rounds: int = 12, seed: int = 3) -> Codebook:
    """The codebook of a sample of unit vectors."""
    rng, width = np.random.default_rng(seed), x.shape[1]
    c = _means(x, lists, rounds, rng, True)
    each = -(-width // parts) if width else 1
    rest = np.pad(x - c[(x @ c.T).argmax(1)], ((0, 0), (0, each * parts - width))).reshape(len(x), parts, each)
    return Codebook(c, np.stack([_means(np.ascontiguousarray(rest[:, p]), min(words, len(x)), rounds, rng, False) for p in range(parts)]), width)


class CodeBlock:
    """Some unit queries' tables and lists."""

    def __init__(self, book: Codebook, probes: int, block: pa.Table, k: int) -> None:
        asked = X._unit(block.column("embedding").combine_chunks())
        self.k, self.tables = k, book.tables(asked).astype(np.float32)
        self.base = book.centroids @ asked.T
        rank = np.argpartition(-self.base, probes - 1, axis=0)[:probes] if probes < len(self.base) else np.broadcast_to(np.arange(len(self.base))[:, None], self.base.shape)
        self.takes = np.zeros(self.base.shape, bool)
        np.put_along_axis(self.takes, rank, True, 0)

    def pick(self, lists: np.ndarray, codes: np.ndarray, least: np.ndarray) -> X.Picked:
        """The rows, queries and scores that are above a query's least and may be among its first k."""
        score = np.full((len(lists), self.base.shape[1]), -np.inf)
        for one in np.unique(lists):
            rows, of = np.flatnonzero(lists == one), np.flatnonzero(self.takes[one])
            if len(of):
                part = self.tables[:, :, of]
                score[np.ix_(rows, of)] = self.base[one, of] + sum(part[p][codes[rows, p]] for p in range(codes.shape[1]))
        rows, of = np.nonzero(score > least)
        return rows, of, score[rows, of]

    def first(self, of: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of each query's first k, the k-th score of each query or -inf)."""
        order = np.lexsort((-score, of))
        sorted_ = of[order]
        rank = np.arange(len(order)) - np.searchsorted(sorted_, sorted_)
        least = np.full(self.base.shape[1], -np.inf)
        last = order[rank == self.k - 1]
        least[of[last]] = score[last]
        return order[rank < self.k], least


def _best(held, step: int):
    """Of codes (doc_id, list, code) each query's first k of the task, as rows (q, doc_id, score): what is held on to stays bounded by a few times k a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = held.value
        ids, of, score, least = None, np.empty(0, np.int64), np.empty(0), np.full(block.base.shape[1], -np.inf)
        for batch in batches:
            for at in range(0, len(batch), step):
                part = batch.slice(at, step)
                codes = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(len(part), -1)
                rows, q, s = block.pick(part.column(1).to_numpy(zero_copy_only=False), codes, least)
                new = part.column(0).take(pa.array(rows))
                ids, of, score = (new if ids is None else pa.concat_arrays([ids, new])), np.append(of, q), np.append(score, s)
                if len(of) > 2 * block.k * len(least):
                    keep, least = block.first(of, score)
                    ids, of, score = ids.take(pa.array(keep)), of[keep], score[keep]
        if ids is not None:
            keep, _ = block.first(of, score)
            yield pa.record_batch([pa.array(of[keep].astype(np.int32)), ids.take(pa.array(keep)), pa.array(score[keep])], ["q", "doc_id", "score"])

    return run


def _exact(spark: SparkSession) -> Callable:
    ship(spark)

    @F.arrow_udf(Y.DoubleType())
    def product(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(np.einsum("ij,ij->i", X._unit(a), X._unit(b)))

    return product


class QuantisedIndex:
    """Lists of codes of vectors (doc_id, embedding); search() gives the nearest of queries (query_id, embedding) as (query_id, doc_id, score, rank)."""

    def __init__(self, vectors: DataFrame, lists: int = LISTS, probes: int = PROBES, parts: int = PARTS, best: int = BEST, sample: int = SAMPLE, seed: int = 3) -> None:
        spark = vectors.sparkSession
        ship(spark)
        self.vectors = vectors.filter("embedding is not null").select("doc_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
        drawn = self.vectors.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample).select("embedding").toArrow()
        x = X._unit(drawn.column(0).combine_chunks())
        self.book = fit(x, lists, parts, seed=seed) if len(x) else None
        self.probes, self.best, self.n = probes, best, self.vectors.count()
        if self.book:
            held = np.bincount(self.book.encode(x)[0], minlength=len(self.book.centroids)) / len(x)
            self.codes = written(spark, self._dealt(self._coded(spark), held), "codes")

    def _coded(self, spark: SparkSession) -> DataFrame:
        held = spark.sparkContext.broadcast(self.book)
        doc = self.vectors.schema["doc_id"].dataType.simpleString()

        def run(batches):
            for batch in batches:
                if len(batch):
                    near, code = held.value.encode(X._unit(batch.column(1)))
                    yield pa.record_batch([batch.column(0), pa.array(near), pa.array([c.tobytes() for c in code], pa.binary())], ["doc_id", "list", "code"])

        return self.vectors.mapInArrow(run, f"doc_id {doc}, list int, code binary")

    def _dealt(self, coded: DataFrame, shares: np.ndarray, most: int = LIST_ROWS) -> DataFrame:
        """Rows of a list next to each other, a list of over most rows (by the sample's shares) in several parts."""
        splits = F.element_at(F.array(*[F.lit(int(max(1, -(-self.n * s // most)))) for s in shares]), F.col("list") + 1)
        parts = int(coded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return coded.repartition(parts, "list", F.pmod(F.xxhash64("doc_id"), splits)).sortWithinPartitions("list", "doc_id")

    def ranked(self, k: int) -> int:
        """How many codes of a query are ranked exactly."""
        return max(k, min(self.best * k, self.n // SHARE))

    def candidates(self, queries: DataFrame, k: int) -> DataFrame:
        """The ranked(k) best codes of each query: query_id, doc_id, score."""
        spark, most = queries.sparkSession, self.ranked(k)
        asked = queries.filter("embedding is not null").select("query_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
        out, n = None, max(1, -(-asked.count() // X.BLOCK))
        for block in X._blocks(asked, n):
            held = spark.sparkContext.broadcast(CodeBlock(self.book, self.probes, block, most))
            names = spark.createDataFrame(pa.table({"q": pa.array(range(len(block)), pa.int32()), "query_id": block.column("query_id")}))
            doc = self.codes.schema["doc_id"].dataType.simpleString()
            found = self.codes.select("doc_id", "list", "code").mapInArrow(_best(held, max(1, X.CELLS // max(1, len(block)))), f"q int, doc_id {doc}, score double")
            first = X.top_k(found, most, [F.desc("score"), F.asc("doc_id")], by="q").join(F.broadcast(names), "q").select("query_id", "doc_id", "score")
            first = written(spark, first, "candidates") if n > 1 else first
            out = first if out is None else out.unionByName(first)
        return out

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        spark = self.vectors.sparkSession
        if not self.book:
            kinds = [d.schema[i].dataType.simpleString() for d, i in ((queries, "query_id"), (self.vectors, "doc_id"))]
            return spark.createDataFrame([], f"query_id {kinds[0]}, doc_id {kinds[1]}, score double, rank int")
        picked = self.candidates(queries, k).select("query_id", "doc_id")
        asked = queries.select("query_id", F.transform("embedding", lambda x: x.cast("double")).alias("asked"))
        met = picked.join(self.vectors, "doc_id").join(X.small(asked), "query_id")
        scored = met.select("query_id", "doc_id", _exact(spark)(F.col("asked"), F.col("embedding")).alias("score"))
        return X.top_k(scored, k, [F.desc(F.round("score", 9)), F.asc("doc_id")]).select("query_id", "doc_id", "score", "rank")
