"""Whitening against numpy's own eigensolver and plain whole-number loops: ties, nulls, bad entries, other lengths, large numbers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corroborate.llm import whitening

SF = "/root/testdata/sf0.001"
KIND = "vec_id long, embedding array<float>, label int"


def table(spark, rows):
    d = spark.createDataFrame([(i, v, 0) for i, v in rows], KIND)
    for name in ("id", "x", "y", "k", "d", "c", "n", "i", "component", "deviation", "whitened"):
        d = d.withColumn(name, F.lit("clash"))
    return d


def plain(rows):
    """{vec_id: (n, deviation)}, the covariance, and the whole-number vectors of rows (vec_id, vector), by plain loops over the float entries."""
    xs = [(i, tuple(int(np.floor(256 * float(np.float32(c)))) for c in v)) for i, v in rows]
    distinct = sorted({x for _, x in xs})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct, strict=True)]
    out = sorted((i, n, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))) for i, x in xs)
    c = np.array(distinct, float) - np.array(sums) / n
    return out, c.T @ c / n, np.array([x for _, x in xs], float) - np.array(sums) / n


def check(got, rows):
    want, v, centred = plain(rows)
    k = min(4, len(v))
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    assert sorted({(r.vec_id, r.n, r.deviation) for r in got}) == sorted(set(want)) and len(got) == k * len(rows)
    for c in range(k):
        own = sorted((r.vec_id, r.whitened) for r in got if r.component == c + 1)
        mine = np.array([x for _, x in own])
        for x in {r.explained for r in got if r.component == c + 1}:
            assert x == pytest.approx(e[c] / np.trace(v), rel=1e-9)
        by_id = np.array([x for _, x in sorted(zip([i for i, _ in rows], centred @ u[:, c] / np.sqrt(e[c]), strict=True))])
        assert min(np.abs(mine - by_id).max(), np.abs(mine + by_id).max()) < 1e-7
    assert {r.identity_error for r in got} == {got[0].identity_error} and 0 <= got[0].identity_error < 1e-9


def test_the_query_is_what_numpy_gives(spark):
    from corroborate.llm import queries

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(queries.QUERIES["op11_embedding_whitening"](spark, SF).collect(), rows)


def test_repeated_bad_and_clashing_rows(spark):
    rng = np.random.default_rng(1)
    good = [(k, [float(x) for x in rng.normal(size=3)]) for k in range(40)]
    good += [(k, good[0][1]) for k in range(40, 90)]  # more than half are one vector
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, float("nan"), 2.0]), (103, [float("inf"), 0.0, 0.0]), (104, [1.0, 2.0]), (105, []), (106, [1.0] * 5)]
    got = whitening.whiten(spark, table(spark, good + bad)).collect()
    check(got, good)


def test_null_ids_stay_and_rows_of_one_vector_have_no_variance(spark):
    got = whitening.whiten(spark, table(spark, [(None, [0.5, -0.25]), (1, [0.5, -0.25])])).collect()
    assert sorted((r.vec_id or 0, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got) == [(i, c, 1, 0, None, 0.0, 0.0) for i in (0, 1) for c in (1, 2)]


def test_a_dimension_without_variance(spark):
    got = whitening.whiten(spark, table(spark, [(k, [float(k), 1.0, 0.0]) for k in range(5)])).collect()
    assert {(r.component, r.whitened is None) for r in got} == {(1, False), (2, True), (3, True)} and got[0].identity_error < 1e-12


def test_entries_beyond_long_range_are_cut_and_deviations_beyond_64_bits_are_null(spark):
    got = whitening.whiten(spark, table(spark, [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 5.0])])).collect()
    assert {r.deviation for r in got if r.vec_id != 3} == {None} and len(got) == 6


def test_empty_tables(spark):
    assert whitening.whiten(spark, table(spark, [])).collect() == []
    assert whitening.whiten(spark, table(spark, [(1, None), (2, [])])).collect() == []


@pytest.mark.parametrize("d", [1, 2, 5, 64])
def test_jacobi_finds_small_eigenvalues(d):
    rng = np.random.default_rng(d)
    q = np.linalg.qr(rng.normal(size=(d, d)))[0]
    e = np.sort(10.0 ** rng.uniform(-3, 3, d))[::-1]
    got, u = whitening.jacobi((q * e) @ q.T)
    assert np.allclose(got, e, rtol=1e-9) and np.allclose(u.T @ u, np.eye(d), atol=1e-12)
    # scaled badly but close to diagonal: what the criterion is for
    s = 10.0 ** np.linspace(0, -9, d)
    h = np.eye(d) + 0.01 * (lambda m: m + m.T)(rng.normal(size=(d, d))) / d
    got, u = whitening.jacobi(h * np.outer(s, s))
    residual = (h * np.outer(s, s)) @ u - u * got
    assert np.all(np.abs(residual).max(0) <= 1e-14 + 1e-12 * np.abs(got).max()) and np.all(got > 0)


def test_products_of_large_entries_are_whole_numbers():
    x = np.array([[2**61, 3], [-(2**60), 5]])
    assert whitening._product(x).tolist() == [[2**122 + 2**120, 3 * 2**61 - 5 * 2**60], [3 * 2**61 - 5 * 2**60, 34]]


def test_covariance_is_rounded_once():
    assert whitening.covariance(3, [4, 3_000_000_000_001], [1, 10**12], {(0, 0): 6, (0, 1): 2, (1, 1): 1})[1, 1] == (3 * 1 - 1) / 9
