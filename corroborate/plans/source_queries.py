"""Queries of sources and sinks: each lands a table in a source's format in the shared folder and reads it back through the source."""

from __future__ import annotations

from pyspark.sql import functions as F

from corroborate.operators import judging as J
from corroborate.operators import replay as R
from corroborate.session import new_path, table
from corroborate.sources import batches, files


def corpus_round_trip(spark, sf_dir):
    """Documents as a JSON-lines corpus and back; every third without an id, so that its url stands in."""
    d = table(spark, sf_dir, "documents")
    at = new_path(spark, "corpus")
    given = F.when(F.pmod("doc_id", F.lit(3)) > 0, F.concat(F.lit("d"), "doc_id"))
    files.write_jsonl(d.select(given.alias("id"), F.col("lang").alias("title"), F.concat(F.lit("file:///"), "source", F.lit("/"), "doc_id").alias("url"), F.col("text").alias("content")), at)
    return files.corpus(spark, at).select("id", "title", "url", F.md5("content").alias("content_md5"))


def cases_round_trip(spark, sf_dir):
    """Items as evaluation cases and back: the question under one of four names, an id for every second."""
    b = table(spark, sf_dir, "benchmark")
    at = new_path(spark, "cases")
    k = F.pmod("item_id", F.lit(4))
    asked = [F.when(k == i, F.col("text")).alias(n) for i, n in enumerate(("query", "question", "prompt", "input"))]
    files.write_jsonl(b.select(F.concat(F.lit("case "), "item_id").alias("case_id"), F.concat(F.lit("c"), k).alias("category"), F.length("text").cast("string").alias("size"), *asked), f"{at}.jsonl")
    c = files.normalised_cases(files.cases(spark, f"{at}.jsonl"), "items")
    return c.select("id", F.md5("query").alias("query_md5"), "category", "benchmark_name", F.try_element_at("metadata", F.lit("size")).alias("size"), F.size("metadata").alias("n_metadata"))


def numbered_cases(spark, sf_dir):
    """Items without ids are numbered in order; a window of them."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ord"), F.col("text").alias("question"))
    named = files.normalised_cases(b, "items").select(F.col("id").alias("case_id"), F.md5("query").alias("query_md5"))
    return files.window_of(named, 5, 20, "case_id")


def ir_round_trip(spark, sf_dir):
    """Documents, items and judgments in an IR data set's files and back, with judgments that repeat and that are 0."""
    at = new_path(spark, "ir")
    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    files.write_jsonl(d.select(F.col("doc_id").cast("string").alias("_id"), F.col("lang").alias("title"), "text"), f"{at}/corpus")
    files.write_jsonl(b.select(F.col("item_id").cast("string").alias("_id"), "text"), f"{at}/queries")
    judged = d.select((F.pmod("doc_id", F.lit(10))).alias("query-id"), F.col("doc_id").alias("corpus-id"), F.pmod(F.floor(F.col("doc_id") / 10), F.lit(3)).alias("score"))
    judged.write.option("header", True).option("sep", "\t").csv(f"{at}/qrels")
    r = files.ir_qrels(spark, f"{at}/qrels").join(files.ir_queries(spark, f"{at}/queries"), "query_id").join(files.ir_corpus(spark, f"{at}/corpus").select("doc_id", "title", F.length("text").alias("n")), "doc_id")
    return r.groupBy("query_id", "title").agg(F.count("*").alias("n_docs"), F.sum("rel").alias("rel"), F.sum("n").alias("n_chars"))


def artifact_round_trip(spark, sf_dir):
    """Conversations as an artifact of case results below its manifest, and back."""
    at = new_path(spark, "artifact")
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.max("turn").alias("last"))
    rows = c.select(F.lit("case_result").alias("type"), F.col("conv_id").cast("string").alias("case_id"), "n_turns", "last")
    config = spark.range(1).select(F.lit("config").alias("type"), F.lit(None).cast("string").alias("case_id"), F.lit(0).cast("long").alias("n_turns"), F.lit(0).cast("long").alias("last"))
    files.write_benchmark(rows.unionByName(config), c.agg(F.count("*").alias("n")), at, "m1")
    found, results = files.generation(spark, f"{at}/m1/raw")
    same = files.case_results(spark, f"{at}/m1/raw").join(results.select("case_id"), "case_id")
    total = spark.read.json(f"{at}/m1/summary").select(F.col("n").alias("total"))
    return same.join(F.broadcast(total)).join(F.broadcast(found.select(F.col("type").alias("config")))).select("case_id", "n_turns", F.col("last").alias("last_turn"), "total", "config")


def cassette_round_trip(spark, sf_dir):
    """Events as a cassette and back, replayed by calls of which every seventh differs."""
    at = new_path(spark, "cassette")
    e = table(spark, sf_dir, "events")
    tape = e.select((F.col("event_id") + 1).alias("sequence"), F.col("event_type").alias("kind"), F.lit("op").alias("operation"), F.col("props").alias("request"), F.col("value").cast("string").alias("response"), F.lit("{}").alias("metadata"))
    files.write_cassette(tape, at)
    calls = tape.select("sequence", "kind", "operation", F.when(F.pmod("sequence", F.lit(7)) == 0, "other").otherwise(F.col("request")).alias("request"))
    return R.replayed(files.cassette(spark, at), calls)


def run_table_round_trip(spark, sf_dir):
    """Events as a run's event table in two files, the older without payloads, and back."""
    at = new_path(spark, "run-events")
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("stage"), F.lit("ok").alias("status"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("props").alias("payload"))
    old = F.pmod("event_id", F.lit(2)) == 0
    e.filter(old).drop("payload").write.parquet(at)
    e.filter(~old).write.mode("append").parquet(at)
    return files.run_table(spark, at).groupBy("run_id", "stage").agg(F.count("*").alias("n"), F.count("payload").alias("n_payloads"), F.max("event_id").alias("last"))


def judgment_batches(spark, sf_dir):
    """Judgments of conversations' turns in batches, the first written twice; turns with a question mark are unscored at first and judged again. A row a turn: its attempts and its latest score."""
    at = new_path(spark, "judgments")
    c = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("rubric_id"), "text")
    asks = F.coalesce(F.col("text").contains("?"), F.lit(False))
    first = c.select("rubric_id", F.lit(1).alias("attempt"), F.when(asks, -1).otherwise(F.length("text") % 2).alias("score"))
    again = c.filter(asks).select("rubric_id", F.lit(2).alias("attempt"), (F.length("text") % 2).alias("score"))
    for rows in (first, again, first):
        batches.append(rows, at)
    judged = batches.read(spark, at, "rubric_id string, attempt int, score int")
    counted = judged.groupBy("rubric_id").agg(F.count("*").alias("n_attempts"))
    return J.latest(judged).join(counted, "rubric_id").select("rubric_id", "n_attempts", "attempt", "score")


QUERIES = {f.__name__: f for f in (corpus_round_trip, cases_round_trip, numbered_cases, ir_round_trip, artifact_round_trip, cassette_round_trip, run_table_round_trip, judgment_batches)}

ORACLES = {
    "judgment_batches": """SELECT conv_id || ':' || turn AS rubric_id, CASE WHEN a THEN 2 ELSE 1 END AS n_attempts, CASE WHEN a THEN 2 ELSE 1 END AS attempt, length(text) % 2 AS score
FROM (SELECT *, coalesce(contains(text, '?'), false) AS a FROM conversations)""",
    "corpus_round_trip": "SELECT CASE WHEN doc_id % 3 > 0 THEN 'd' || doc_id ELSE 'file:///' || source || '/' || doc_id END AS id, lang AS title, 'file:///' || source || '/' || doc_id AS url, md5(text) AS content_md5 FROM documents",
    "cases_round_trip": "SELECT 'case ' || item_id AS id, md5(text) AS query_md5, 'c' || item_id % 4 AS category, 'items' AS benchmark_name, CAST(length(text) AS VARCHAR) AS size, 1 AS n_metadata FROM benchmark",
    "numbered_cases": "SELECT * FROM (SELECT format('case-{:04d}', row_number() OVER (ORDER BY item_id)) AS case_id, md5(text) AS query_md5 FROM benchmark) ORDER BY case_id LIMIT 20 OFFSET 5",
    "ir_round_trip": """SELECT CAST(doc_id % 10 AS VARCHAR) AS query_id, lang AS title, count(*) AS n_docs, CAST(sum(doc_id // 10 % 3) AS BIGINT) AS rel, CAST(sum(length(documents.text)) AS BIGINT) AS n_chars
FROM documents JOIN benchmark ON item_id = doc_id % 10 WHERE doc_id // 10 % 3 > 0 GROUP BY ALL""",
    "artifact_round_trip": "SELECT CAST(conv_id AS VARCHAR) AS case_id, count(*) AS n_turns, max(turn) AS last_turn, (SELECT count(DISTINCT conv_id) FROM conversations) AS total, 'config' AS config FROM conversations GROUP BY conv_id",
    "cassette_round_trip": "SELECT event_id + 1 AS sequence, CASE WHEN (event_id + 1) % 7 > 0 THEN CAST(value AS VARCHAR) END AS response, (event_id + 1) % 7 > 0 AS matches, true AS played FROM events",
    "run_table_round_trip": "SELECT CAST(user_id AS VARCHAR) AS run_id, event_type AS stage, count(*) AS n, count(*) FILTER (WHERE event_id % 2 = 1) AS n_payloads, max(event_id) AS last FROM events GROUP BY ALL",
}
