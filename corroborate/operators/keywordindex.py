"""A keyword index of blocks of documents with bounds, for top-k by shared tokens without reading the texts again.

Documents of like numbers of distinct tokens lie together in blocks of a few, long ones in blocks of fewer. A block holds its distinct tokens, each with
a bit for every document that has it; its head holds only hashes of the tokens and the largest number of tokens of a document. A
query can share with any document of a block no more tokens than it shares hashes with the head, nor more than that number.

A search reads the heads, scores each query's k most promising blocks (a broadcast of k pairs a query), and has so a k-th score that
the true one can't be below. It then reads the blocks, and of each scores the documents only for those queries whose k-th score
the block can reach. Neither blocks nor texts are shuffled, by the build or by a search, nor are pairs of query and
document but for each task's first k.

Cases: as keyword_topk, whose rows it returns: a null text has no token, documents that share nothing fill up, ties go to the smaller
doc_id, which is unique; a block's hash that meets by chance raises a bound and never lowers it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corroborate.functions import text as T
from corroborate.operators import retrieval as X
from corroborate.session import ship, written

DOCS = 16  # documents of a block, at most 63
TOKENS = 4096  # tokens of a block, unless one document has more


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row of each element, the elements) of lists without null."""
    return np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False)), column.flatten()


def _build(size: int):
    def block(number: int, rows: pa.RecordBatch) -> pa.RecordBatch:
        of, tokens = _lists(rows.column(1))
        coded = tokens.dictionary_encode()
        masks = np.zeros(len(coded.dictionary), np.int64)
        np.bitwise_or.at(masks, coded.indices.to_numpy(zero_copy_only=False), np.int64(1) << of)
        most = int(np.bincount(of, minlength=1).max()) if len(of) else 0
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        return pa.record_batch([pa.array([number], pa.int64()), pa.array([most], pa.int32()), one(rows.column(0)), one(coded.dictionary), one(pa.array(masks))], ["block", "most", "ids", "tokens", "masks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            at, held = 0, 0
            many = batch.column(1).value_lengths().to_pylist()
            for end in range(1, len(batch) + 1):
                held += many[end - 1]
                if end == len(batch) or end - at == size or held + many[end] > TOKENS:
                    yield block(number, pa.record_batch([pa.concat_arrays([c.slice(at, end - at), c.slice(0, 0)]) for c in batch.columns], ["doc_id", "tokens"]))
                    number, at, held = number + 1, end, 0

    return run


class Asked:
    """The tokens of some queries, or their hashes: the queries of each, sorted by it."""

    def __init__(self, lists: pa.Array) -> None:
        of, values = _lists(lists)
        self.n, self.values = len(lists), values.unique().sort()
        at = self.place(values)
        order = np.argsort(at, kind="stable")
        self.begins, self.posted = np.searchsorted(at[order], np.arange(len(self.values) + 1)), of[order]

    def place(self, values: pa.Array) -> np.ndarray:
        """The place of each of values among the queries', -1 without one."""
        return pc.index_in(values, self.values).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)

    def met(self, lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, element, query) of every meeting of an element of a row's list with a query."""
        of, values = _lists(lists)
        at = self.place(values)
        some = np.flatnonzero(at >= 0)
        at = at[some]
        size = self.begins[at + 1] - self.begins[at]
        posted = np.repeat(self.begins[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.repeat(of[some], size), np.repeat(some, size), self.posted[posted]

    def bounds(self, heads: pa.RecordBatch) -> np.ndarray:
        """The most that a document of each head (block, most, hashes) can share with each query."""
        row, _, query = self.met(heads.column(2))
        shared = np.bincount(row * self.n + query, minlength=len(heads) * self.n).reshape(len(heads), self.n)
        return np.minimum(shared, heads.column(1).to_numpy(zero_copy_only=False)[:, None])


def _parts(batch: pa.RecordBatch, n: int, size: int = 1) -> Iterator[pa.RecordBatch]:
    step = max(1, X.CELLS // max(1, n * size))
    for at in range(0, len(batch), step):
        yield pa.record_batch([pa.concat_arrays([c.slice(at, step), c.slice(0, 0)]) for c in batch.columns], batch.schema.names)


def _promising(held, k: int):
    """Of heads each query's k blocks of the largest bounds, as rows (q, block, bound)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, held.value.n):
                bound = held.value.bounds(part)
                first = np.argpartition(-bound, k - 1, axis=0)[:k] if len(part) > k else np.broadcast_to(np.arange(len(part))[:, None], bound.shape)
                found = np.take_along_axis(bound, first, 0)
                place, q = np.nonzero(found)
                yield pa.record_batch([pa.array(q.astype(np.int32)), part.column(0).take(pa.array(first[place, q])), pa.array(found[place, q].astype(np.int32))], ["q", "block", "bound"])

    return run


def _reached(held, least: np.ndarray):
    """Of heads how many pairs of query and block can reach the query's least score, as one row (pairs) a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, held.value.n):
                yield pa.record_batch([pa.array([int((held.value.bounds(part) >= least).sum())])], ["pairs"])

    return run


def _scored(held, k: int, size: int, least: np.ndarray | None):
    """Of blocks (ids, tokens, masks, most or queries) what may be among the first k of a query, as rows (q, doc_id, score).

    With least, the least scores, for all queries that a block can reach; else for those that its last column names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = held.value
        for batch in batches:
            for part in _parts(batch, asked.n, size):
                n = len(part)
                row, element, q = asked.met(part.column(1))
                if least is None:
                    wanted = np.zeros((n, asked.n), bool)
                    of, named = _lists(part.column(3))
                    wanted[of, named.to_numpy(zero_copy_only=False)] = True
                else:
                    met = np.bincount(row * asked.n + q, minlength=n * asked.n).reshape(n, asked.n)
                    wanted = np.minimum(met, part.column(3).to_numpy(zero_copy_only=False)[:, None]) >= least
                use = wanted[row, q]
                row, mask, q = row[use], part.column(2).flatten().to_numpy(zero_copy_only=False)[element[use]], q[use]
                of, ids = _lists(part.column(0))
                place = np.arange(len(of)) - np.searchsorted(of, of)
                shared = np.zeros((n, size, asked.n), np.int32)
                for bit in range(size):
                    one = mask >> bit & 1 > 0
                    shared[:, bit] = np.bincount(row[one] * asked.n + q[one], minlength=n * asked.n).reshape(n, asked.n)
                order = pc.sort_indices(ids).to_numpy(zero_copy_only=False)
                ids, shared = ids.take(pa.array(order)), shared[of, place][order]
                value = shared.astype(np.int64) * len(ids) + np.arange(len(ids))[::-1, None]  # more tokens first, then the smaller doc_id
                first = np.argpartition(-value, k - 1, axis=0)[:k] if len(ids) > k else np.broadcast_to(np.arange(len(ids))[:, None], shared.shape)
                found = np.take_along_axis(shared, first, 0)
                at, q = np.nonzero(found)
                yield pa.record_batch([pa.array(q.astype(np.int32)), ids.take(pa.array(first[at, q])), pa.array(found[at, q] + X.FLOOR, pa.float64())], ["q", "doc_id", "score"])

    return run


class KeywordIndex:
    """W1, J2 over a stored index of corpus (doc_id, text)."""

    def __init__(self, corpus: DataFrame, size: int = DOCS) -> None:
        spark = corpus.sparkSession
        ship(spark)
        self.corpus, self.size, self.searched = corpus, size, []
        self.kind = corpus.schema["doc_id"].dataType.simpleString()
        tokens = F.coalesce(T.tokens(F.col("text")), F.array().cast("array<string>"))
        docs = corpus.select("doc_id", tokens.alias("tokens")).withColumn("n", F.size("tokens")).withColumn("h", F.xxhash64("doc_id"))
        near = docs.sortWithinPartitions("n", "h").select("doc_id", "tokens")
        self.blocks = written(spark, near.mapInArrow(_build(size), f"block long, most int, ids array<{self.kind}>, tokens array<string>, masks array<long>"), "blocks")
        self.heads = written(spark, self.blocks.select("block", "most", F.transform("tokens", lambda t: F.hash(t)).alias("hashes")), "heads")
        self.n = self.heads.count()

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, doc_id, score, rank of queries (query_id, text)."""
        spark = queries.sparkSession
        asked = queries.select("query_id", F.coalesce(T.tokens(F.col("text")), F.array().cast("array<string>")).alias("tokens"))
        hashed = asked.withColumn("hashes", F.transform("tokens", lambda t: F.hash(t)))
        order = [F.desc("score"), F.asc("doc_id")]
        out, parts, self.searched = [], max(1, -(-queries.count() // X.BLOCK)), []
        columns, result = ["ids", "tokens", "masks"], f"q int, doc_id {self.kind}, score double"
        for block in X._blocks(hashed, parts):
            if not len(block):
                continue
            whole, heads = (spark.sparkContext.broadcast(Asked(block.column(c).combine_chunks())) for c in ("tokens", "hashes"))
            best = X.top_k(self.heads.mapInArrow(_promising(heads, k), "q int, block long, bound int"), k, [F.desc("bound"), F.asc("block")], by="q")
            best = written(spark, best.groupBy("block").agg(F.collect_list("q").alias("qs")), "best")  # k pairs a query of the block
            tried = self.blocks.select("block", *columns).join(F.broadcast(best), "block").select(*columns, "qs")
            tried = X.top_k(tried.mapInArrow(_scored(whole, k, self.size, None), result), k, order, by="q")
            least = np.ones(len(block))
            for r in tried.filter(F.col("rank") == k).select("q", "score").collect():  # one row a query of the block
                least[r.q] = round(r.score - X.FLOOR)
            self.searched.append((heads, least))
            names = spark.createDataFrame(pa.table({"q": pa.array(range(len(block)), pa.int32()), "query_id": block.column("query_id")}))
            found = X.top_k(self.blocks.select(*columns, "most").mapInArrow(_scored(whole, k, self.size, least), result), k, order, by="q")
            found = found.join(F.broadcast(names), "q").select("query_id", "doc_id", "score")
            out.append(written(spark, found, "found") if parts > 1 else found)
        # as in keyword_topk: the first k documents that share nothing fill up where fewer than k share a token
        first = self.corpus.orderBy("doc_id").limit(2 * k).select("doc_id", F.coalesce(T.tokens(F.col("text")), F.array().cast("array<string>")).alias("d"))
        scored = asked.join(F.broadcast(first)).filter(F.size(F.array_intersect("tokens", "d")) == 0).select("query_id", "doc_id", F.lit(X.FLOOR).alias("score"))
        for found in out:
            scored = scored.unionByName(found)
        return X.top_k(scored, k, order).select("query_id", "doc_id", "score", "rank")

    def read(self) -> tuple[int, int]:
        """Of the last search the pairs of query and block that the heads' bounds let through, and all of them."""
        counts = [self.heads.mapInArrow(_reached(heads, least), "pairs long").agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0] for heads, least in self.searched]
        return sum(counts), self.n * sum(len(least) for _, least in self.searched)
