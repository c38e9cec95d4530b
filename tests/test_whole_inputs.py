"""Operators and queries without SQL read all of their input, whatever its length and number of rows."""

from pyspark.sql import functions as F

from corroborate.operators import evidence as E
from corroborate.operators import metrics as M
from corroborate.plans import extension_queries as N
from corroborate.plans import research_queries as Q


def test_all_short_prompts_are_compared(spark):
    n = 10_050
    k = F.lpad(F.col("id").cast("string"), 6, "0")
    forms = F.array(F.concat(F.lit("questionnumbered"), k), F.concat(F.lit("questionnumber "), k), F.concat(F.lit("question number "), k), F.concat(F.lit("a question number "), k))
    prompts = spark.range(n).select(F.col("id").alias("item_id"), F.element_at(forms, (F.pmod("id", F.lit(4)) + 1).cast("int")).alias("text"))
    docs = prompts.groupBy(F.floor(F.col("item_id") / 50).alias("doc_id")).agg(F.concat(F.lit("pre"), F.array_join(F.collect_list("text"), "x, pre"), F.lit("post")).alias("text"))
    got = {(r.doc_id, r.item_id) for r in E.prompt_leaks(docs, prompts, answer_fields=False).collect()}
    assert got == {(k // 50, k) for k in range(n)}


def test_all_prices_are_used(spark):
    n = 10_050
    prices = spark.range(n).select(F.concat(F.lit("m"), "id").alias("model"), F.lit(1.0).alias("hit"), F.lit(1.0).alias("miss"), F.lit(1.0).alias("output"))
    usage = prices.select("model", F.lit(1).alias("prompt_tokens"), F.lit(1).alias("completion_tokens"), F.lit(0).alias("hit_tokens"), F.lit(None).cast("int").alias("miss_tokens"))
    assert M.usage_cost(usage, prices).filter("cost_usd is not null").count() == n


def tables(spark, path):
    """65 items, documents and conversations, with long texts of several sentences."""
    text = F.concat(F.lit("Topic number "), "id", F.lit(" was first described in 1990 by some people. It holds "), "id", F.lit(" parts and many more words than fit in sixty characters. The last one ends here"))
    ids = spark.range(65)
    ids.select(F.col("id").alias("item_id"), text.alias("text")).write.parquet(f"{path}/benchmark.parquet")
    ids.select(F.col("id").alias("doc_id"), text.alias("text")).write.parquet(f"{path}/documents.parquet")
    turns = ids.select(F.col("id").alias("conv_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("turn"), text.alias("text"))
    turns.withColumn("role", F.when(F.col("turn") == 0, "user").otherwise("assistant")).write.parquet(f"{path}/conversations.parquet")
    return str(path)


def test_queries_read_all_rows(spark, tmp_path):
    sf = tables(spark, tmp_path)
    for query, key in ((Q.research_reports, "report_id"), (N.embedded_search, "query_id"), (N.replayed_reports, "report_id")):
        assert {r[0] for r in query(spark, sf).select(key).distinct().collect()} == set(range(65)), query.__name__


def test_queries_read_whole_texts(spark, tmp_path):
    sf = tables(spark, tmp_path)
    texts = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    assert all(texts[r.conv_id] in r.answer for r in Q._answers(spark, sf).collect())
    assert all(texts[r.item_id] + " [S1]. " in r.answer for r in Q._reports(spark, sf).collect())
    assert {r.run_id: r["query"] for r in Q._requests(spark, sf).collect()} == texts
    cited = {r.item_id: r for r in Q.cited_claims(spark, sf).collect()}
    clean = {r.item_id: r for r in Q.markdown_sanitised(spark, sf).collect()}
    assert len(cited) == len(clean) == 65 and all(r.n_claims >= 2 for r in cited.values()) and all(r.n_chars > 0 for r in clean.values())
    counts = N.replayed_reports(spark, sf).filter("total_claims is not null").select("total_claims").collect()  # none where the judge would have to be live
    assert [r.total_claims for r in counts] == [2] * 44
