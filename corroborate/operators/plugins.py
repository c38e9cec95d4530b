"""The extension surface: models as batch functions, vector indexes as strategies, sinks of spans. Each has a deterministic default."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from corroborate.functions import relevance as R
from corroborate.operators import evidence as E
from corroborate.operators import retrieval as X
from corroborate.operators import runlog as L
from corroborate.session import shared_dir, ship, written
from corroborate.sources.files import exists


class EmbeddingProvider(Protocol):
    """Texts to vectors; called with the texts of an Arrow batch."""

    name: str

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Y1, the default: signed feature hashing of words, unit length; needs no model and is the same everywhere."""

    def __init__(self, dims: int = 64) -> None:
        self.dims, self.name = dims, f"hashing-{dims}"

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims), np.float32)
        for row, text in zip(out, texts, strict=True):
            for w in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                row[h % self.dims] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embedder(spark: SparkSession, provider: EmbeddingProvider) -> Callable[[Column], Column]:
    """A column function text -> vector."""
    ship(spark)

    @F.arrow_udf(Y.ArrayType(Y.FloatType()))
    def embed(text: pa.Array) -> pa.Array:
        return pa.array(list(provider.embed([t or "" for t in text.to_pylist()])), pa.list_(pa.float32()))

    return embed


def ensure_index(spark: SparkSession, chunks: DataFrame, provider: EmbeddingProvider, folder: str | None = None) -> DataFrame:
    """Embeddings (doc_id, embedding) of chunks (doc_id, text) in a table named by the content's digest and the provider: reused if it is there with as many rows, else built."""
    row = F.xxhash64(F.col("doc_id").cast("string"), "text").cast("decimal(38,0)")
    n, digest = chunks.agg(F.count("*"), F.sha2(F.coalesce(F.sum(row), F.lit(0)).cast("string"), 256)).first()
    path = f"{folder or shared_dir(spark)}/index-{provider.name}-{digest[:16]}"
    if not (exists(spark, path) and spark.read.parquet(path).count() == n):
        chunks.select("doc_id", embedder(spark, provider)(F.col("text")).alias("embedding")).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


class VectorIndex(Protocol):
    """Nearest rows of queries (query_id, embedding) as (query_id, doc_id, score, rank)."""

    def search(self, queries: DataFrame, k: int) -> DataFrame: ...


class ExactIndex:
    """Y7, the default: every pair of a stated query set and the corpus."""

    def __init__(self, vectors: DataFrame) -> None:
        self.vectors = vectors

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return X.vector_topk(queries, self.vectors, k).select("query_id", "doc_id", "score", "rank")


class CellIndex:
    """Y7, approximate: every vector lies in the cell of its nearest centroid, and a query is compared with the vectors of the probes cells nearest to it.

    The centroids are fitted by spherical k-means on at most sample vectors, those with the least hash of doc_id; all vectors are
    indexed. A cell may hold any number of them: it is never gathered, its rows meet the queries by a join. Recall grows with probes:
    on vectors without any clusters 0.53, 0.69, 0.81 and 0.90 of the exact ten with 8, 16, 24 and 32 of 64 cells."""

    def __init__(self, vectors: DataFrame, cells: int = 64, probes: int = 40, sample: int = 20_000, rounds: int = 12, seed: int = 3) -> None:
        spark = vectors.sparkSession
        ship(spark)
        rows = vectors.filter("embedding is not null").select("doc_id", F.transform("embedding", lambda x: x.cast("float")).alias("embedding"))
        drawn = rows.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample).select("embedding").toArrow()
        x = X._unit(drawn.column(0).combine_chunks())
        rng = np.random.default_rng(seed)
        c = x[rng.permutation(len(x))[:cells]]
        for _ in range(rounds if len(x) else 0):
            near = (x @ c.T).argmax(1)
            total = np.zeros_like(c)
            np.add.at(total, near, x)
            size = np.linalg.norm(total, axis=1, keepdims=True)
            c = np.where(size > 0, total / np.maximum(size, 1e-12), c)
        self.centroids, self.probes = c, min(probes, max(1, len(c)))
        self.vectors = written(spark, rows.select("doc_id", "embedding", self._cells(spark, 1)(F.col("embedding"))[0].alias("cell")), "cells")

    def _cells(self, spark: SparkSession, n: int) -> Callable[[Column], Column]:
        """A column function embedding -> the n nearest cells."""
        held = spark.sparkContext.broadcast(self.centroids)

        @F.arrow_udf(Y.ArrayType(Y.IntegerType()))
        def cells(embedding: pa.Array) -> pa.Array:
            near = X._unit(embedding) @ held.value.T if len(held.value) else np.zeros((len(embedding), 1))
            return pa.array(list(np.argpartition(-near, n - 1, axis=1)[:, :n].astype(np.int32)), pa.list_(pa.int32()))

        return cells

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        asked = queries.filter("embedding is not null").select("query_id", F.transform("embedding", lambda x: x.cast("float")).alias("asked"))
        asked = asked.select("query_id", "asked", F.explode(self._cells(queries.sparkSession, self.probes)(F.col("asked"))).alias("cell"))
        score = F.coalesce(F.try_divide(X.dot(F.col("asked"), F.col("embedding")), F.sqrt(X.dot(F.col("asked"), F.col("asked")) * X.dot(F.col("embedding"), F.col("embedding")))), F.lit(0.0))
        pairs = self.vectors.join(X.small(asked), "cell").select("query_id", "doc_id", score.alias("score"))
        return X.top_k(pairs, k, [F.desc(F.round("score", 9)), F.asc("doc_id")]).select("query_id", "doc_id", "score", "rank")


class Reranker(Protocol):
    """Y2: a score of (query text, document text)."""

    def score(self, query: Column, text: Column) -> Column: ...


class LexicalReranker:
    def score(self, query: Column, text: Column) -> Column:
        return R.overlap(query, text)


class CitationJudge(Protocol):
    """Assessments to assessments with the judge's verdict."""

    def judge(self, assessed: DataFrame) -> DataFrame: ...


class HeuristicJudge:
    name, model = "heuristic", "local-groundtruth-substring"

    def judge(self, assessed: DataFrame) -> DataFrame:
        return E.judged(assessed)


class Model(Protocol):
    """Prompts to answers, for mapInArrow over (id, prompt); plans.research holds the deterministic one as expressions."""

    def answer(self, prompts: list[str]) -> list[str]: ...


def answers(spark: SparkSession, model: Model) -> Callable[[Column], Column]:
    ship(spark)

    @F.arrow_udf(Y.StringType())
    def ask(prompt: pa.Array) -> pa.Array:
        return pa.array(model.answer([p or "" for p in prompt.to_pylist()]), pa.string())

    return ask


def export_spans(events: DataFrame, export: Callable[[DataFrame, int], None], checkpoint: str):
    """A stream of trace events as spans to an exporter, a micro-batch at a time."""
    return events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, n: export(L.otlp_spans(df), n)).start()


def refreshed(claims: DataFrame, sources: DataFrame, recorded: DataFrame) -> DataFrame:
    """Stored reports checked again offline; recorded has (report_id, providers array). A report that another judge than the heuristic one had judged cannot be judged again: unscored."""
    assessed = E.assessments(E.citations(claims, sources)).join(recorded, "report_id")
    known = F.forall("providers", lambda p: F.lower(p) == HeuristicJudge.name)
    by_judge = E.citation_report(E.judged(assessed.filter((F.size("providers") > 0) & known))).withColumn("judge", F.lit(HeuristicJudge.name)).withColumn("status", F.lit("replayed"))
    lexical = E.citation_report(assessed.filter(F.size("providers") == 0)).withColumn("judge", F.lit("lexical")).withColumn("status", F.lit("replayed"))
    other = recorded.filter(~known).select("report_id")
    scored = by_judge.unionByName(lexical)
    empty = other.select("report_id", *(F.lit(None).cast(t).alias(c) for c, t in scored.dtypes if c not in ("report_id", "judge", "status")), F.lit("lexical").alias("judge"), F.lit("unscored").alias("status"))
    return scored.unionByName(empty)
