import hashlib
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given
from hypothesis import strategies as st

from corroborate.llm import exactdedup as X

ROWS = [(3, "a  b"), (1, "a\tb"), (2, "a b"), (5, None), (4, ""), (6, " "), (7, "x" * 200_000), (8, "x" * 200_000), (9, "once"), (1, "a b"), (1, "a b"), (None, "once"), (None, "lost"), (None, "lost")]


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    g = defaultdict(list)
    for i, t in rows:
        g[norm(t)].append(i)
    out = []
    for t, ids in g.items():
        keep = min((i for i in ids if i is not None), default=None)
        first = True
        for i in ids:
            kept = i == keep and first
            first = first and not kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("k", [1, 2, 1024])
def test_groups_match_brute_force(spark, documents, k):
    got = X.groups(spark, documents(ROWS), k=k).collect()
    assert Counter(map(tuple, got)) == brute(ROWS)


def test_one_row_of_each_group_stays_with_its_columns(spark, documents):
    for k in (1, 1024):
        docs = documents(ROWS)
        kept = X.keep_first(spark, docs, k=k)
        assert kept.columns == docs.columns
        want = sorted((str(i), h) for (i, _, _, kept, h), n in brute(ROWS).items() if kept)
        assert sorted((str(r.doc_id), hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "").encode()).hexdigest()) for r in kept.collect()) == want


def test_empty_table(spark, documents):
    assert X.groups(spark, documents([])).count() == 0
    assert X.keep_first(spark, documents([])).count() == 0


@given(st.lists(st.integers(0, 12), max_size=300), st.integers(1, 5))
def test_misra_gries_keeps_every_heavy_value(values, k):
    counts: dict = {}
    for v in values:
        counts[v] = counts.get(v, 0) + 1
        counts = X.shrink(counts, k)
    heavy = {v for v, n in Counter(values).items() if n > len(values) / (k + 1)}
    assert heavy <= set(counts) and len(counts) <= k
