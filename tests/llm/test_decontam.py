import random

import numpy as np

from corroborate.llm import decontam as D

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
MOVED = "x " + " ".join(ITEM.split()[10:]) + " y z " + " ".join(ITEM.split()[:10])


def brute_tiles(item, doc, least):
    """The textbook loop: scan all pairs of unmarked places for the longest match, mark it, until none is long enough."""
    mi, md, out = [False] * len(item), [False] * len(doc), []
    while True:
        best = (0, 0, 0)
        for a in range(len(item)):
            for b in range(len(doc)):
                n = 0
                while a + n < len(item) and b + n < len(doc) and item[a + n] == doc[b + n] and not mi[a + n] and not md[b + n]:
                    n += 1
                if (-n, a, b) < (-best[0], best[1], best[2]) and n >= least:
                    best = (n, a, b)
        n, a, b = best
        if not n:
            return sum(mi)
        out.append(best)
        for k in range(n):
            mi[a + k] = md[b + k] = True


def test_coverage_matches_the_textbook_loop():
    rng = random.Random(5)
    for _ in range(150):
        item = [rng.choice("abcdef") * 2 for _ in range(rng.randint(3, 25))]
        doc = [rng.choice("abcdefg") * 2 for _ in range(rng.randint(0, 60))]
        at = rng.randint(0, len(doc))
        doc[at:at] = item[: rng.randint(0, len(item))]
        found = D.hits(D.build([(1, " ".join(item))], 3), " ".join(doc))
        assert (round(found[0][1] * len(item)) if found else 0) == brute_tiles(item, doc, 3)


def test_rolling_hash_equals_itself_anywhere():
    ids = np.array([1, 2, 3, 4, 5, 1, 2, 3, 4, 5, 9])
    h = D.rolling(ids, 5)
    assert h[0] == h[5] and len(set(h.tolist())) == 6 and len(D.rolling(ids[:3], 5)) == 0


def run(spark, documents, rows, items=((1, ITEM),)):
    d, b = documents(rows), spark.createDataFrame(list(items), "item_id long, text string")
    return sorted((r.doc_id, r.item_id, round(r.coverage, 3)) for r in D.contaminations(spark, d, b).collect()), sorted(str(r.doc_id) for r in D.keep_clean(spark, d, b).collect())


def test_whole_moved_and_partial_passages(spark, documents):
    rows = [(1, "pre " + ITEM.upper() + ", post"), (2, MOVED), (3, " ".join(ITEM.split()[:12])), (4, None), (5, ""), (6, "clean words only"), (7, ("filler words " * 20_000) + ITEM), (1, ITEM), (None, "nothing")]
    found, kept = run(spark, documents, rows)
    assert found == [(1, 1, 1.0), (1, 1, 1.0), (2, 1, 1.0), (7, 1, 1.0)]
    assert kept == sorted(map(str, [3, 4, 5, 6, None]))


def test_bundles_and_salted_joins_give_the_same(spark, documents, monkeypatch):
    items = [(k, " ".join(f"w{k}x{j}" for j in range(8))) for k in range(30)] + [(99, None), (98, ""), (97, "too few words"), (None, ITEM), (3, ITEM)]
    rows = [(k, f"a {t} b") for k, (_, t) in enumerate(items[:30])] + [(50, ITEM)] + [(60, " . ".join(t for _, t in items[:30]))]
    whole = run(spark, documents, rows, items)
    monkeypatch.setattr(D, "BUNDLE", 4)
    monkeypatch.setattr(D, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(D, "SALTS", 3)
    assert run(spark, documents, rows, items) == whole
    assert (50, 3, 1.0) in whole[0] and len(whole[0]) == 61


def test_the_seeds_that_are_needed_lose_nothing():
    rng = random.Random(8)
    for _ in range(300):
        n, seed, coverage = rng.randint(1, 30), rng.randint(1, 6), rng.choice([0.5, 0.8, 1.0])
        seed = min(seed, n)
        part = D.needed(np.array([rng.randint(1, 9) for _ in range(n - seed + 1)]), n, seed, coverage)
        for _ in range(60):  # any set of tiles that covers enough holds one of them
            covered, at = set(), rng.randint(0, 3)
            while at + seed <= n:
                size = rng.randint(seed, min(n - at, seed + 8))
                covered.add((at, at + size))
                at += size + rng.randint(0, 2)
            if sum(b - a for a, b in covered) / n >= coverage and covered:
                assert any(a <= k and k + seed <= b for a, b in covered for k in range(part.start, part.stop))


def test_short_items_match_by_a_seed_of_their_own_length(spark, documents):
    items = [(1, "four words only here"), (2, "Zweiwort, hier"), (3, "single"), (4, "a b c d e")]
    rows = [(1, "x four words, only here y"), (2, "four words only"), (3, "zweiwort hier"), (4, "a Single one"), (5, "x a b c d e"), (6, "hier zweiwort")]
    found, kept = run(spark, documents, rows, items)
    assert found == [(1, 1, 1.0), (3, 2, 1.0), (4, 3, 1.0), (5, 4, 1.0)] and kept == ["2", "6"]


def test_a_phrase_of_a_thousand_items_is_no_key(spark, documents):
    phrase = "which of the following statements is true about"
    items = [(k, f"{phrase} " + " ".join(f"i{k}w{j}" for j in range(6))) for k in range(1000)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = [(k, f"filler {k} {phrase} nothing else") for k in range(300)] + [(900, f"see: {items[7][1]} end")]
    keys = D._keys(spark, D._items(spark, benchmark)[0], D.COVERAGE, D.SEED_WORDS)
    assert keys.groupBy("h").count().agg({"count": "max"}).first()[0] == 1
    found, kept = run(spark, documents, rows, items)
    assert found == [(900, 7, 1.0)] and len(kept) == 300


def test_clashing_columns_of_the_benchmark(spark, documents):
    from pyspark.sql import functions as F

    b = spark.createDataFrame([(1, ITEM), (2, ITEM)], "item_id long, text string")
    for name in ("doc_id", "uid", "cls", "w", "h", "hits", "n", "row"):
        b = b.withColumn(name, F.lit("clash"))
    d = documents([(1, ITEM), (2, None), (2, ITEM), (2, ITEM)])
    for name in ("uid", "cls", "w", "h", "hits", "n"):
        d = d.withColumn(name, F.lit("clash"))
    assert sorted((r.doc_id, r.item_id) for r in D.contaminations(spark, d, b).collect()) == [(1, 1), (1, 2)] + 2 * [(2, 1)] + 2 * [(2, 2)]
    clean = D.keep_clean(spark, d, b)
    assert clean.columns == d.columns and [r.doc_id for r in clean.collect()] == [2]


def test_the_same_as_every_item_against_every_document(spark):
    sf = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet").collect(), spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    index = D.build([(r.item_id, r.text) for r in items])
    want = sorted((r.doc_id, *x) for r in docs for x in D.hits(index, r.text) if x[1] >= D.COVERAGE)
    got = D.contaminations(spark, spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert sorted(map(tuple, got.collect())) == want and want


def test_empty_tables(spark, documents):
    assert run(spark, documents, []) == ([], [])
    assert run(spark, documents, [(1, ITEM)], items=[(None, None)]) == ([], ["1"])
    empty = spark.createDataFrame([], "item_id long, text string")
    assert D.keep_clean(spark, documents([(1, ITEM)]), empty).count() == 1
