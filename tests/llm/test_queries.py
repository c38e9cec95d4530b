"""Every query of the subpackage and the pipeline, on small tables: columns, rows, and equality with its SQL."""

import re

import corpus_pipeline
import duckdb
import pandas as pd
import pytest

from corroborate.llm import queries

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "labels", "benchmark", "conversations")


def text(frame):
    """The rows as text, whole numbers alike whatever type holds them."""
    number = lambda v: str(int(v)) if not isinstance(v, (str, bool)) and float(v) == int(v) else str(v)
    rows = frame[sorted(frame.columns)].astype(object).itertuples(index=False)
    return sorted(str(tuple("-" if pd.isna(v) else str(v) if isinstance(v, (str, bool)) else number(v) for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert text(got) == text(want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES) - {"op7_decontamination", "op11_embedding_whitening"}))
def test_one_row_per_document(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.QUERIES[name](spark, SF)
    assert got.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0 and got.count() == docs.count()


def test_pipeline_stages_keep_the_columns_and_run_gives_their_result(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and docs.count() <= rows
            rows = docs.count()
    got = corpus_pipeline.run(spark, SF)
    assert got.exceptAll(docs).count() == 0 and docs.exceptAll(got).count() == 0 and docs.count() == rows > 0


def test_the_pipeline_is_what_brute_force_gives(spark):
    """Exact copies, near copies by fingerprint, and whole benchmark items, each by its plainest definition: the stages with 3 bits alone for near copies."""
    from corroborate.llm import simhash
    from corroborate.llm.simhash import fingerprint

    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    seen, unique = set(), []
    for r in docs:
        t = re.sub(r"[\x20\x09-\x0D]+", " ", r.text)
        if t not in seen and any(c.isalpha() for c in t):
            seen.add(t)
            unique.append(r)
    f, root = [fingerprint(r.text) for r in unique], list(range(len(unique)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(f)):
        for j in range(i):
            if (f[i] ^ f[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    heads = [r for i, r in enumerate(unique) if find(i) == i]
    clean = {r.doc_id for r in heads if not any(x in " ".join(r.text.lower().split()) for x in items)}
    left = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        left = simhash.keep_one(spark, left) if name == "near" else stage(spark, left, SF)
    got = {r.doc_id for r in left.select("doc_id").collect()}
    assert got <= {r.doc_id for r in heads} and got == clean


def brute_pipeline(docs, items):
    """doc_ids that the stages keep, each stage by its plainest definition; near copies are 3 bits or a similarity of 0.8 of the sets of 5-word shingles."""
    from corroborate.llm.decontam import build, hits
    from corroborate.llm.simhash import fingerprint

    seen, unique = set(), []
    for i, t in sorted(docs, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        key = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        if key not in seen and any(c.isalpha() for c in key):
            seen.add(key)
            unique.append((i, t))
    words = [t.encode().lower().split() for _, t in unique]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    f, root = [fingerprint(t) for _, t in unique], list(range(len(unique)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(f)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if (f[i] ^ f[j]).bit_count() <= 3 or common and 5 * common >= 4 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    index = build(items)
    return [i for k, (i, t) in enumerate(unique) if find(k) == k and not any(x[1] >= 0.8 for x in hits(index, t))]


def test_the_pipeline_with_similar_texts_is_what_brute_force_gives(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()) == sorted(brute_pipeline(docs, items))


def tables(spark, path, docs):
    """A folder of tables with these documents (doc_id, text, lang) and the small benchmark, both with columns named like what the stages use inside."""
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in docs], "doc_id long, text string, lang string, source string, n_chars long")
    b = spark.read.parquet(f"{SF}/benchmark.parquet")
    for name in ("id", "d", "t", "f", "h", "w", "keep", "digest", "row", "own", "uid", "cls", "hits", "n", "item_id", "component_id", "lang_pred", "ambiguous"):
        d = d.withColumn(name, F.lit("clash"))
        b = b if name == "item_id" else b.withColumn(name, F.lit("clash"))
    d.write.parquet(f"{path}/documents.parquet")
    b.write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_pipeline_of_null_empty_repeated_and_clashing_rows(spark, tmp_path):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()
    prose = {r.lang: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").filter("n_chars between 2000 and 6000").orderBy("doc_id").collect()}
    en, de = prose["en"], prose["de"]
    rows = [
        (1, en, "en"), (1, en, "en"), (2, en, None), (3, de, "de"), (4, None, "en"), (5, "", "de"), (6, "12 34 !!", "en"), (None, de + " x", "de"), (None, None, None), (7, f"{en[:900]} {item.text}", "en"),
        (8, en.replace(" ", "  "), "en"), (9, " ".join(en.split()[:-1]), "en"), (10, (de + "\n") * 200, "de"), (11, de.upper(), "de"), (6, "12 34 !!", "en"),
    ]
    at = tables(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, at)
        assert docs.columns == columns, name
    got = sorted(r.doc_id for r in corpus_pipeline.run(spark, at).select("doc_id").collect())
    assert got == sorted(brute_pipeline([r[:2] for r in rows], [(item.item_id, item.text)])) == [1, 3, 11]


def test_pipeline_of_an_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path, [])).count() == 0
