"""Queries of stored indexes: quantised vectors, and keyword blocks with bounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from corroborate.operators import keywordindex as K
from corroborate.operators import vectorindex as V
from corroborate.plans import evidence_queries as E
from corroborate.session import table, written

K_FIRST = E.K


def keyword_index_topk(spark, sf_dir):
    """The ten best documents of each benchmark item, from blocks whose bounds can reach them."""
    index = K.KeywordIndex(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return index.search(E._queries(spark, sf_dir), K_FIRST)


def _index(spark, sf_dir):
    q, e = E._vectors(spark, sf_dir)
    return q.select("query_id", "embedding"), V.QuantisedIndex(e.select("doc_id", "embedding"))


def vector_index_topk(spark, sf_dir):
    """Near neighbours of every vector whose id is divisible by 20, from lists of quantised codes."""
    q, index = _index(spark, sf_dir)
    return index.search(q, K_FIRST).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


def vector_index_recall(spark, sf_dir):
    """How many of the exact neighbours the index finds, as measured: n_queries, enough (recall of at least 0.9), few (at most a tenth of the vectors ranked exactly for a query)."""
    q, index = _index(spark, sf_dir)
    n = index.n
    exact = written(spark, E.X.vector_topk(q, index.vectors, K_FIRST).select("query_id", "doc_id"), "exact")
    found = index.search(q, K_FIRST).select("query_id", "doc_id", F.lit(1).alias("found"))
    measured = exact.join(found, ["query_id", "doc_id"], "left").agg(F.countDistinct("query_id").alias("n_queries"), F.avg(F.coalesce("found", F.lit(0))).alias("recall"))
    return measured.select("n_queries", (F.col("recall") >= 0.9).alias("enough"), F.lit(index.ranked(K_FIRST) * V.SHARE <= n).alias("few"))


QUERIES = {f.__name__: f for f in (keyword_index_topk, vector_index_topk, vector_index_recall)}

ORACLES = {
    "keyword_index_topk": E.ORACLES["keyword_topk"],
    "vector_index_recall": "SELECT count(*) AS n_queries, true AS enough, true AS few FROM embeddings WHERE vec_id % 20 = 0 AND embedding IS NOT NULL",
}
