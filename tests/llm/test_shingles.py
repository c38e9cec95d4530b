import corpus_pipeline
import numpy as np

from corroborate.llm import shingles as S
from corroborate.llm.simhash import fingerprint

WORDS = [f"w{i}" for i in range(5000)]


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts):
    g, root = [grams(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(g)):
        for j in range(i):
            if g[i] and 5 * len(g[i] & g[j]) >= 4 * len(g[i] | g[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(g))]


def corpus():
    """Bases with copies of every closeness, a passage in all texts of one kind, short and blank texts."""
    rng = np.random.default_rng(7)
    passage, out = list(rng.choice(WORDS, 40)), [None, "", " ", "one two", "One  two", "a b c d e", "a b c d e f"]
    for n in (6, 9, 15, 30, 60, 200):
        for _ in range(3):
            base = list(rng.choice(WORDS, n)) + (passage if n < 40 else [])
            for _ in range(8):
                copy = list(base)
                for at in rng.integers(0, len(copy), rng.integers(0, max(2, len(copy) // 18))):
                    copy[at] = str(rng.choice(WORDS))
                out.append(" ".join(copy[int(rng.integers(0, 2)) :]))
    return list(dict.fromkeys(out))


def test_links_match_brute_force(spark):
    texts = corpus()
    want = brute(texts)
    rows = spark.createDataFrame(list(enumerate(texts)), "t long, text string").repartition(3)
    names = rows.selectExpr("t", "t as f")
    for cell in (4, 2048):
        root = list(range(len(texts)))

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for e in S.links(spark, rows, names, cell=cell).collect():
            a, b = sorted((find(e.a), find(e.b)))
            root[b] = a
        assert [find(i) for i in range(len(texts))] == want
    assert len(set(want)) < len(texts) - 20


def test_the_pipeline_links_similar_texts_with_distant_fingerprints(spark, documents):
    rng = np.random.default_rng(11)
    base = [str(w) for w in rng.choice(WORDS, 60)]
    for at in range(10, 50):
        copy = " ".join([*base[:at], "other", *base[at + 1 :]])
        if (fingerprint(copy) ^ fingerprint(" ".join(base))).bit_count() > 3:
            break
    assert (fingerprint(copy) ^ fingerprint(" ".join(base))).bit_count() > 3
    docs = documents([(1, " ".join(base)), (2, copy), (3, " ".join(str(w) for w in rng.choice(WORDS, 60)))])
    got = corpus_pipeline.near(spark, docs, "")
    assert sorted(r.doc_id for r in got.collect()) == [1, 3] and got.columns == docs.columns


def test_empty_table(spark):
    rows = spark.createDataFrame([], "t long, text string")
    assert S.links(spark, rows, rows.selectExpr("t", "t as f")).count() == 0
