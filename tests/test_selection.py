"""Exact percentiles against plain Python and Spark's own, and the prefix join against every rule of an origin."""

import math
import re

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corroborate.functions import urls as U
from corroborate.operators import evidence as E
from corroborate.operators import quantiles as Q

POINTS = {"low": 0.0, "mid": 0.5, "high": 0.9, "top": 1.0, "odd": 0.377}


def same(a, b):
    return a is None and b is None or a == b or math.isnan(a) and math.isnan(b)


def check(spark, values, by=("g", "h")):
    """values: (g, h, v)."""
    df = spark.createDataFrame(values, "g string, h int, v double").withColumns({c: F.lit("clash") for c in ("k", "lo", "hi", "name", "pos", "n", "bin")})
    got = {(r.g, r.h): r for r in Q.percentiles(df, list(by), "v", POINTS).collect()}
    groups = {}
    for g, h, v in values:
        if v is not None:
            groups.setdefault((g, h), []).append(v)
    assert set(got) == set(groups)
    for key, vs in groups.items():
        for name, p in POINTS.items():
            assert same(got[key][name], Q.plain(vs, p)), (key, name)


def test_percentiles_of_groups_of_any_kind(spark, monkeypatch):
    monkeypatch.setattr(Q, "BINS", 4)
    monkeypatch.setattr(Q, "LEFT", 3)
    rng = np.random.default_rng(4)
    rows = [("hot", 1, float(x)) for x in rng.lognormal(0, 6, 400)] + [("ties", 1, float(x)) for x in rng.integers(0, 3, 80)]
    rows += [(None, 2, float(x)) for x in rng.normal(size=30)] + [("one", None, 7.5), ("two", 0, -1.0), ("two", 0, 1.0), ("none", 0, None), ("same", 3, 2.0)] + [("same", 3, 2.0)] * 50
    rows += [("wide", 1, x) for x in (-1.7e308, 1.7e308, 5e-324, 0.0, -5e-324, 1.0, 3.0, 1e-300, 2e-300, 1e300)] + [("odd", 1, x) for x in (float("inf"), float("-inf"), float("nan"), 1.0, 2.0, 3.0, 4.0, 5.0, float("inf"))]
    check(spark, rows)


def test_percentiles_equal_sparks_own(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    got = Q.percentiles(e, ["event_type"], "value", {"p50": 0.5, "p90": 0.9})
    want = e.groupBy("event_type").agg(F.percentile("value", F.lit(0.5)).alias("p50"), F.percentile("value", F.lit(0.9)).alias("p90"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_percentiles_without_groups_and_without_rows(spark):
    assert Q.percentiles(spark.range(101).withColumn("v", F.col("id") * 1.0), [], "v", {"p": 0.25}).collect()[0].p == 25.0
    assert Q.percentiles(spark.range(0).withColumn("v", F.col("id") * 1.0), ["id"], "v", {"p": 0.25}).collect() == []


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.just("a"), st.just(1), st.floats(allow_nan=False, allow_infinity=False)), min_size=1, max_size=40))
def test_percentiles_of_any_floats(spark, values):
    bins, left = Q.BINS, Q.LEFT
    Q.BINS, Q.LEFT = 3, 1
    try:
        check(spark, values)
    finally:
        Q.BINS, Q.LEFT = bins, left


def brute(sources, blocked):
    """Each source against every blocked identity of its origin, by the rule's own words."""

    def hit(b, c):
        root = re.sub(r"/+$", "", re.sub(r"(?i)\.html$", "", b.path))
        return (b.scheme, b.host, b.port) == (c.scheme, c.host, c.port) and (b.path == c.path or b.path.lower().endswith(".html") and root != "" and c.path.startswith(root + "/"))

    ids = lambda df: df.select("url", U.identity(F.col("url")).alias("i")).collect()
    rules = [r.i for r in ids(blocked) if r.i]
    return {r.url: bool(r.i) and any(hit(b, r.i) for b in rules) for r in ids(sources)}


URLS = [
    "https://a.org/x", "https://a.org/x/", "https://a.org/x/y/z?q=1", "https://a.org/report/chapter", "https://a.org/report", "https://a.org/report/", "https://a.org/reports/x", "http://a.org/x", "https://a.org:8443/x", "https://a.org/a//b",
    "https://a.org", "https://a.org/.html", "https://a.org/y/.html/z", "https://b.org/report/chapter", "ftp://a.org/x", "not a url", "", None, "https://u@a.org/x", "https://a.org/Report/one",
]
RULES = ["https://a.org/x", "https://a.org/report.html", "https://a.org/.html", "https://a.org/a//.html", "https://a.org/report.HTML", "https://a.org:8443/x#f", "https://a.org:443/x", None, "nothing"]


@pytest.mark.parametrize("join", ["broadcast", "merge"])
def test_denylist_is_what_every_rule_gives(spark, monkeypatch, join):
    monkeypatch.setattr(E, "small", lambda df: df.hint(join))
    s = spark.createDataFrame([(u,) for u in URLS], "url string").withColumns({c: F.lit("clash") for c in ("h", "kind", "path", "origin", "b", "rh", "scheme")})
    d = spark.createDataFrame([(u,) for u in RULES], "url string")
    got = {r.url: r.blocked for r in E.denylisted(s, d).collect()}
    assert got == brute(s, d) and sum(got.values()) >= 6


def test_a_hundred_thousand_rules_of_one_host(spark):
    rules = spark.range(100_000).select(F.concat(F.lit("https://hot.org/r"), "id", F.when(F.col("id") % 2 == 0, ".html").otherwise("")).alias("url"))
    s = spark.range(3000).select(F.col("id").alias("k"), F.concat(F.lit("https://hot.org/r"), F.col("id") * 50, F.lit("/chapter/"), "id").alias("url"))
    s = s.unionByName(spark.range(3000).select(F.col("id").alias("k"), F.concat(F.lit("https://hot.org/r"), F.col("id") * 50 + 1).alias("url")))
    got = E.denylisted(s, rules).groupBy(F.col("url").contains("chapter").alias("c")).agg(F.count_if("blocked").alias("n"), F.count("*").alias("rows")).collect()
    assert {(r.c, r.n, r.rows) for r in got} == {(True, 2000, 3000), (False, 2000, 3000)}
