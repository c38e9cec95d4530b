import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Rows (doc_id, text) as a table with the columns of documents and some more, named like what operators use inside."""

    def make(rows):
        from pyspark.sql import functions as F

        d = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOC)
        for name in ("id", "d", "t", "f", "keep", "digest", "row", "own", "__d", "__id", "__t", "kept", "score", "text_sha256", "item_id"):
            d = d.withColumn(name, F.lit("clash"))
        return d

    return make
