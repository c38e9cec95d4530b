import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from corroborate.llm import graph
from corroborate.llm import simhash as S

BASE = " ".join(f"w{i}" for i in range(400))
ROWS = [(5, BASE), (4, BASE.upper()), (9, BASE + " tail"), (2, "far away words here"), (7, None), (8, ""), (1, " \t"), (3, "one"), (6, "One"), (10, "two words"), (None, "far away words here"), (2, "far away words here"), (None, "alone in the dark")]


def plain(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def brute(rows):
    f = [plain(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(f[i] ^ f[j]).count("1") <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(str((d, f"{f[i]:016x}", least.get(find(i)))) for i, (d, _) in enumerate(rows))


def test_groups_match_brute_force(spark, documents):
    got = S.groups(spark, documents(ROWS))
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(ROWS)


def test_keep_one(spark, documents):
    docs = documents(ROWS)
    kept = S.keep_one(spark, docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [4, 2, 1, 3, 10, None]))


def test_empty_table(spark, documents):
    assert S.groups(spark, documents([])).count() == 0
    assert S.keep_one(spark, documents([])).count() == 0


@settings(deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=3))
def test_near_fingerprints_share_an_anchor_that_is_home_to_one(x, flips):
    y = x
    for b in flips:
        y ^= 1 << b
    shared = False
    for side in (0, 32):
        half = np.array([x >> side & 0xFFFFFFFF, y >> side & 0xFFFFFFFF], np.uint32)
        home, others = S.anchors(half)
        shared |= home[0] == home[1] or home[0] in others[1] or home[1] in others[0]
    assert shared


def test_crowded_anchors_lose_no_link(spark):
    rng = np.random.default_rng(1)
    centre = int(rng.integers(0, 2**62))
    f = {centre}
    while len(f) < 300:
        x = list(f)[int(rng.integers(len(f)))]
        for b in rng.integers(0, 64, 2):
            x ^= 1 << int(b)
        f.add(x)
    f |= {int(v) for v in rng.integers(0, 2**62, 200)}
    signed = [int(np.uint64(v).astype(np.int64)) for v in f]
    df = spark.createDataFrame([(v,) for v in signed], "f long")
    for cell in (5, 2048):
        edges = S.links(spark, df, cell=cell).collect()
        assert all(bin((a.a ^ a.b) & (2**64 - 1)).count("1") <= 3 for a in edges)
        assert groups(signed, [(a.a, a.b) for a in edges]) == groups(signed, [(a, b) for i, a in enumerate(signed) for b in signed[:i] if bin((a ^ b) & (2**64 - 1)).count("1") <= 3])


def groups(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(k, k + 1) for k in range(200, 260)] + [(5, 5)]
    got = {r.node: r.root for r in graph.components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    want = groups({n for e in edges for n in e}, edges)
    assert got == {n: want[n] for n in got} and {n for e in edges for n in e if e[0] != e[1]} == set(got)
    assert graph.components(spark, spark.createDataFrame([], "a long, b long")).count() == 0
