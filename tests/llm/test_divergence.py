"""Source divergence against plain counts: nulls, empty and long texts, repeated rows, ties, empty tables and clashing names."""

import re
from collections import Counter, defaultdict

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corroborate.llm import divergence


def plain_terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)


def plain(rows, least, top):
    """Of (lang, source, text) the rows of the audit."""
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lang, found = lang or "", plain_terms(text)
        counts[lang, source or ""].update(found)
        docs[lang].update(set(found))
    out = []
    for lang in {g[0] for g in counts}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        own = {s: counts[g, s] for g, s in counts if g == lang}
        share = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in own.items()}, share(sum(own.values(), Counter()))
        for s in own:
            order = lambda x: (-x[1], x[0].encode())
            pairs = sorted(((o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in own if o != s), key=order)
            above = sorted(((t, p[s][t] - q[t]) for t in kept if own[s][t] and p[s][t] > q[t]), key=order)[:top]
            out += [(lang, s, part, item, v, k) for part, found in (("pair", pairs), ("term", above)) for k, (item, v) in enumerate(found, 1)]
    return sorted(out)


def table(spark, rows):
    d = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, lang string, source string, text string")
    for name in ("i", "n", "k", "x", "g", "term", "docs", "counts", "sources", "kept", "rank", "part", "item"):
        d = d.withColumn(name, F.lit("clash"))
    return d


def audited(spark, rows, least=2, top=3):
    return sorted(tuple(r) for r in divergence.audit(spark, table(spark, rows), least, top).select("lang", "source", "part", "item", "value", "rank").collect())


ROWS = [
    ("en", "a", "One two THREE one"), ("en", "a", "One two THREE one"), ("en", "b", "two, three; Äpfel äpfel"), ("en", None, "three ÄPFEL äpfel \U0001f600x"), ("en", "c", None), ("en", "d", ""),
    ("en", "b", "12 34 -- !"), (None, "a", "one one"), (None, None, "one"), ("fr", "z", "seul"), ("de", "é", "eins zwei"), ("de", "z", "zwei eins"), ("de", "a", "eins zwei zwei"), ("en", "e", "two " * 30_000 + "one"),
]


def test_same_rows_as_plain_counts(spark):
    assert audited(spark, ROWS) == plain(ROWS, 2, 3)


def test_same_rows_where_one_group_holds_most_rows_and_kept_terms_are_joined_by_a_shuffle(spark, monkeypatch):
    rows = ROWS + [("en", "hot", f"one word{k % 7} two") for k in range(400)]
    monkeypatch.setattr(divergence, "small", lambda df: df.hint("merge"))
    monkeypatch.setattr(divergence, "BLOCK", 64)
    assert audited(spark, rows, 3, 50) == plain(rows, 3, 50)


def test_an_empty_table_and_a_table_without_kept_terms(spark):
    assert audited(spark, []) == []
    assert audited(spark, [("en", "a", "x"), ("en", "b", "y"), ("en", "c", None)]) == plain([("en", "a", "x"), ("en", "b", "y"), ("en", "c", None)], 2, 3)


def test_shares_beyond_64_bits_are_exact(spark):
    got = spark.sql("select 12345678901234 n, 98765432109876 total, 1000003 kept").select(divergence.share(F.col("n"), F.col("total"), F.col("kept"))).first()[0]
    assert got == 1 + 1_000_000_000 * (12345678901234 + 5) // (98765432109876 + 5 * 1000003)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZ@[`{ 9é\t\x7f\U0001f600"), max_size=12), max_size=5))
def test_terms_of_any_text(texts):
    lists = divergence.tokens(pa.array(texts, pa.string())).to_pylist()
    assert [[t for t in x if t] for x in lists] == [plain_terms(t) for t in texts]
