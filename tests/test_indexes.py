"""Stored indexes against the exact searches: ties, nulls, empty and long texts, hot lists and blocks, fillers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corroborate.operators import keywordindex as K
from corroborate.operators import retrieval as X
from corroborate.operators import vectorindex as V

SF = "/root/testdata/sf0.1"


def rows(df):
    return sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 6)) for r in df.collect())


def test_keyword_index_gives_the_rows_of_the_scan_and_skips_most_blocks(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").filter("doc_id < 3000")
    asked = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    index = K.KeywordIndex(docs)
    assert rows(index.search(asked, 10)) == rows(X.keyword_topk(asked, docs, 10))
    read, total = index.read()
    assert 0 < read < total / 2


@pytest.mark.parametrize(("size", "k"), [(1, 2), (3, 4), (16, 3), (63, 30)])
def test_keyword_index_of_odd_texts(spark, monkeypatch, size, k):
    monkeypatch.setattr(X, "BLOCK", 3)  # several blocks of queries
    monkeypatch.setattr(X, "CELLS", 64)
    monkeypatch.setattr(K, "TOKENS", 40)
    words = [f"w{i}" for i in range(12)]
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(words, rng.integers(0, 9))) for _ in range(70)] + [None, "", "w1 w2"] * 3 + ["w1 w2 w3"] * 20 + [" ".join(f"x{i}" for i in range(20_000)) + " w5"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(k, t) for k, t in enumerate(["w1 w2", "w3", "nothing here", None, "", "w5 x7 x9", " ".join(words), "w1 w1 w1"])], "query_id long, text string")
    assert rows(K.KeywordIndex(docs, size).search(asked, k)) == rows(X.keyword_topk(asked.fillna(""), docs.fillna(""), k))


def test_keyword_index_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a b")], "query_id long, text string")
    assert rows(K.KeywordIndex(docs).search(asked, 3)) == []
    assert rows(K.KeywordIndex(spark.createDataFrame([(1, "a")], docs.schema)).search(asked.limit(0), 3)) == []


def near(got, want):
    found = {(q, d) for q, _, d, _ in got}
    return len(found & {(q, d) for q, _, d, _ in want}) / len(want)


def test_vector_index_recall_and_share(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "embedding")
    q = e.filter("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    index = V.QuantisedIndex(e)
    want = rows(X.vector_topk(q, e, 10).select("query_id", "doc_id", "rank", "score"))
    got = rows(index.search(q, 10))
    assert near(got, want) >= 0.9 and 10 * index.ranked(10) <= index.n == e.count()
    exact = {(a, d): s for a, _, d, s in want}
    assert all(exact.get((a, d), s) == s for a, _, d, s in got)  # scores are those of the vectors, not of the codes


def test_all_lists_and_all_codes_give_the_exact_answer(spark, monkeypatch):
    monkeypatch.setattr(V, "SHARE", 1)
    monkeypatch.setattr(V, "LIST_ROWS", 7)
    rng = np.random.default_rng(2)
    data = [(k, [float(x) for x in rng.normal(size=5)]) for k in range(90)]
    data += [(100 + k, data[0][1]) for k in range(200)] + [(400, None), (401, [0.0] * 5)]  # most vectors are one: a hot list
    e = spark.createDataFrame(data, "doc_id long, embedding array<double>")
    q = e.filter("doc_id < 6 or doc_id > 399").withColumnRenamed("doc_id", "query_id")
    index = V.QuantisedIndex(e, lists=6, probes=6, parts=3, best=1000)
    assert rows(index.search(q, 8)) == rows(X.vector_topk(q, e, 8).select("query_id", "doc_id", "rank", "score"))
    assert index.codes.count() == 291


def test_an_empty_vector_index(spark):
    e = spark.createDataFrame([(1, None)], "doc_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, embedding array<float>")
    assert V.QuantisedIndex(e).search(q, 3).collect() == []


def test_codes_of_a_width_that_the_parts_do_not_divide():
    x = np.random.default_rng(1).normal(size=(300, 7))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    book = V.fit(x, lists=4, parts=3)
    near_, code = book.encode(x)
    t = book.tables(x[:5])
    told = (book.centroids @ x[:5].T)[near_] + sum(t[p][code[:, p]] for p in range(3))
    assert np.abs(told - x @ x[:5].T).max() < 0.25
