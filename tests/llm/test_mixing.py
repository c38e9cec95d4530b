"""Mixing: targets and flow against plain versions, selection against a sort, nulls, ties, copies, hot texts, empty tables and clashing names."""

from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corroborate import session
from corroborate.llm import mixing
from corroborate.llm.flow import Network

SF = "/root/testdata/sf0.001"


def plain_targets(sizes, weights):
    """Pour the total by weight; fix whoever is above twice its size; pour the rest again."""
    fixed, total = {}, Fraction(3, 2) * sum(sizes)
    while True:
        free = [k for k in range(len(sizes)) if k not in fixed]
        rest = total - sum(fixed.values())
        got = {k: rest * weights[k] / sum(weights[j] for j in free) for k in free}
        above = [k for k in free if got[k] > 2 * sizes[k]]
        if not above:
            return [fixed.get(k, got.get(k)) for k in range(len(sizes))]
        fixed |= {k: Fraction(2 * sizes[k]) for k in above}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1000), max_size=9))
def test_targets(sizes):
    weights = [(3, 1, 2)[k % 3] for k in range(len(sizes))]
    got = mixing.targets(sizes, weights)
    assert got == plain_targets(sizes, weights)
    assert sum(got) == Fraction(3, 2) * sum(sizes) and all(t <= 2 * s for t, s in zip(got, sizes, strict=True))


def cheapest(nodes, arcs, source, sink):
    """(flow, cost) by single units along paths of least cost found by Bellman-Ford."""
    room = {k: r for k, (_, _, r, _) in enumerate(arcs)}
    back = dict.fromkeys(room, 0)
    sent = cost = 0
    while True:
        best, via = {source: 0}, {}
        for _ in range(nodes):
            for k, (a, b, _, c) in enumerate(arcs):
                for x, y, r, w, e in ((a, b, room[k], c, (k, 1)), (b, a, back[k], -c, (k, -1))):
                    if r and x in best and best[x] + w < best.get(y, 1 << 60):
                        best[y], via[y] = best[x] + w, (x, e)
        if sink not in best:
            return sent, cost
        sent, cost, y = sent + 1, cost + best[sink], sink
        while y != source:
            y, (k, d) = via[y]
            room[k] -= d
            back[k] += d


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5), st.integers(0, 4), st.integers(0, 5)), max_size=14))
def test_flow_is_largest_and_cheapest(arcs):
    net = Network(6)
    own = [net.add(*a) for a in arcs]
    sent = net.solve(0, 5)
    cost = sum(net.flow(e) * a[3] for e, a in zip(own, arcs, strict=True))
    assert (sent, cost) == cheapest(6, arcs, 0, 5)
    kept = Counter()
    for e, (a, b, r, _) in zip(own, arcs, strict=True):
        assert 0 <= net.flow(e) <= r
        kept[a] -= net.flow(e)
        kept[b] += net.flow(e)
    assert all(not n for x, n in kept.items() if x not in (0, 5))


def test_shared_texts_are_left_to_the_source_that_needs_them():
    # the first source has enough texts of its own; the second has none but the shared ones
    assert mixing.route([50, 50], [(100, {0: 100}), (50, {0: 50, 1: 50})]) == [{0: 50}, {0: 0, 1: 50}]


def test_a_flow_over_a_thousand_patterns():
    patterns = [(1000 + k, {s: 900 + 7 * k + s for s in range(20) if (k * 2654435761 >> s) & 1} or {0: 1}) for k in range(1024)] + [(10**6, {s: 10**6}) for s in range(20)]
    sizes = [sum(by.get(s, 0) for _, by in patterns) for s in range(20)]
    quotas = [int(t) for t in mixing.targets(sizes, [(3, 1, 2)[s % 3] for s in range(20)])]
    got = mixing.route(quotas, patterns)
    assert [sum(x.get(s, 0) for x in got) for s in range(20)] == quotas
    assert all(0 <= f <= 2 * by[s] for x, (_, by) in zip(got, patterns, strict=True) for s, f in x.items())


def plain_mix(rows, most=1024):
    """Of (id, source, text, h) the words taken, each step by its plainest definition."""
    size = [len([w for w in (t or "").replace("\t", " ").replace("\n", " ").split(" ") if w]) for _, _, t, _ in rows]
    names = sorted({r[1] for r in rows}, key=lambda s: (s is None, s or ""))
    total = [sum(n for n, r in zip(size, rows, strict=True) if r[1] == s) for s in names]
    goals = mixing.targets(total, [(3, 1, 2)[k % 3] for k in range(len(names))])
    held, copies = defaultdict(set), Counter()
    for r in rows:
        held[r[2] or ""].add(names.index(r[1]))
        copies[r[2] or ""] += 1
    words = Counter()
    for n, r in zip(size, rows, strict=True):
        if len(held[r[2] or ""]) > 1 and n:
            words[tuple(sorted(held[r[2] or ""]))] += n
    common = {h: len(names) + k for k, (h, _) in enumerate(sorted(words.items(), key=lambda x: (-x[1], x[0]))[:most])}
    p = [common.get(tuple(sorted(held[r[2] or ""])), names.index(r[1])) for r in rows]
    by, parts = defaultdict(dict), Counter()
    for k, r in enumerate(rows):
        if size[k]:
            s = names.index(r[1])
            by[p[k]][s] = by[p[k]].get(s, 0) + size[k]
            parts[p[k], copies[r[2] or ""]] += size[k]
    once = Counter()
    for (q, c), n in parts.items():
        once[q] += n // c
    order = sorted(by)
    order = sorted(order, key=lambda q: min((q, s) for s in by[q]))
    routed = mixing.route([min(round(g), 2 * n) for g, n in zip(goals, total, strict=True)], [(max(1, once[q]), dict(sorted(by[q].items()))) for q in order])
    taken = [0] * len(rows)
    for q, own in zip(order, routed, strict=True):
        for s, f in own.items():
            mine = sorted((r[3], k) for k, r in enumerate(rows) if p[k] == q and names.index(r[1]) == s and size[k])
            left = f % by[q][s]
            for h in sorted({x for x, _ in mine}):
                same = [k for x, k in mine if x == h]
                here = min(left, sum(size[k] for k in same))
                for k in same:
                    taken[k] = f // by[q][s] * size[k] + (size[k] if here == sum(size[j] for j in same) and left > here else min(size[k], here // len(same)))
                left -= here
    return [(r[0], r[1], n, total[names.index(r[1])], float(goals[names.index(r[1])]), t, len(held[r[2] or ""])) for r, n, t in zip(rows, size, taken, strict=True)]


def hashed(docs):
    """Rows (id, source, text, h) with the order of the seeded selection."""
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return [tuple(r) for r in docs.select("doc_id", "source", "text", F.xxhash64(F.lit(mixing.SEED), F.col("doc_id").cast("string"), digest, F.col("text").isNull()).bitwiseAND((1 << 63) - 1)).collect()]


def key(r):
    return str(tuple(r))


def mixed(spark, docs, **more):
    return mixing.mix(spark, docs, **more).select("doc_id", "source", "size", "source_size", "target", "taken", "n_sources").collect()


def table(spark, rows):
    d = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for name in ("id", "s", "p", "h", "d", "n", "size", "name", "held", "left", "bin", "taken", "target", "copies"):
        d = d.withColumn(name, F.lit("clash"))
    return d


def test_the_query_is_what_plain_loops_give(spark):
    from corroborate.llm import queries

    rows = hashed(spark.read.parquet(f"{SF}/documents.parquet"))
    got = queries.QUERIES["op12_source_mixing"](spark, SF).select("doc_id", "source", "size", "source_size", "target", "taken", "n_sources").collect()
    assert sorted(map(key, got)) == sorted(map(key, plain_mix(rows)))
    sums = defaultdict(int)
    for r in got:
        sums[r.source, r.target] += r.taken
        assert 0 <= r.taken <= 2 * r["size"]
    assert all(abs(n - t) <= 0.5 for (_, t), n in sums.items())


ROWS = [(k, ("a", "b", None, "é")[k % 4], f"word{k} " * (k % 7 + 1)) for k in range(60)]
ODD = [(100, "a", None), (101, "b", ""), (102, None, " \t\n"), (None, "a", "x y z"), (None, "b", "x y z"), (103, "zero", ""), (104, "a", "w " * 50_000), (105, "c", "x y z")]


def test_odd_rows_and_clashing_names(spark):
    docs = table(spark, ROWS + ODD)
    assert sorted(map(key, mixed(spark, docs))) == sorted(map(key, plain_mix(hashed(docs))))


@pytest.mark.parametrize("most", [0, 1, 3])
def test_copies_across_sources_and_patterns_beyond_the_limit(spark, most):
    shared = [(200 + k, "abcd"[(k * k) % 4], f"shared text number {k // 3} here") for k in range(40)]
    docs = table(spark, ROWS + shared)
    assert sorted(map(key, mixed(spark, docs, patterns=most))) == sorted(map(key, plain_mix(hashed(docs), most)))


def test_a_text_of_half_of_all_rows_is_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(session, "HOT_PARTS", 4)
    docs = table(spark, ROWS + [(300 + k, "ab"[k % 2], "the same text for all") for k in range(80)] + [(400 + k, "b", "") for k in range(90)])
    assert sorted(map(key, mixed(spark, docs))) == sorted(map(key, plain_mix(hashed(docs))))


def test_equal_rows_are_taken_alike(spark):
    docs = table(spark, [(1, "a", "one two three four five")] * 7 + [(2, "b", "six " * 30)])
    got = [r for r in mixed(spark, docs) if r.source == "a"]
    assert len({r.taken for r in got}) == 1 and got[0].target - 7 <= 7 * got[0].taken <= got[0].target


def test_an_empty_table(spark):
    assert mixed(spark, table(spark, [])) == []
