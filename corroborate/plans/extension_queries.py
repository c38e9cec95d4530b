"""Queries of plug-ins, replayed reports and benchmark building."""

from __future__ import annotations

from pyspark.sql import functions as F

from corroborate.functions import text as T
from corroborate.operators import evidence as E
from corroborate.operators import judging as J
from corroborate.operators import plugins as G
from corroborate.plans.text_queries import SENT
from corroborate.session import table


def embedded_search(spark, sf_dir):
    """Items searched in an index of hashed document vectors that is built once."""
    p = G.HashingEmbedder(64)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), G.embedder(spark, p)(F.col("text")).alias("embedding"))
    return G.ExactIndex(G.ensure_index(spark, docs, p)).search(items, 5).select("query_id", "doc_id", "rank", F.round("score", 5).alias("score"))


def evidence_summaries(spark, sf_dir):
    """conversations' assistant turns as evidence, summed up."""
    c = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "question_id")
    items = c.filter("role = 'assistant'").select("question_id", F.col("turn").cast("int").alias("ord"), F.lit("t").alias("title"), F.col("text").alias("quote"))
    return E.evidence_summaries(items, c.groupBy("question_id").agg(F.count("*").alias("n_rounds"))).select("question_id", F.md5("summary").alias("summary_md5"))


def compressed_findings(spark, sf_dir):
    """Turns as findings of their conversation."""
    c = table(spark, sf_dir, "conversations")
    f = c.select(F.col("conv_id").alias("run_id"), F.concat(F.lit("Q"), "turn").alias("q"), F.col("text").alias("summary"), F.when(F.col("role") == "user", F.array(F.lit("a"), F.lit("b"), F.lit("a"))).otherwise(F.array().cast("array<string>")).alias("titles"))
    return E.compressed(f).select("run_id", F.md5("text").alias("text_md5"))


def payload_claims(spark, sf_dir):
    """Claims of models' payloads, as texts and as objects."""
    s = T.sentences(F.col("text"))
    plain = F.to_json(F.struct(s.alias("key_claims")))
    objects = F.to_json(F.struct(F.transform(s, lambda x: F.struct(x.alias("text"), F.array(F.lit("S1"), F.lit("S2")).alias("citations"))).alias("claims")))
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", E.claims_of_payload(F.when(F.pmod("item_id", F.lit(2)) == 0, plain).otherwise(objects)).alias("c")).select("item_id", F.md5(F.array_join("c", "|")).alias("claims_md5"))


def generation_status(spark, sf_dir):
    """Labelled documents as generation records."""
    d = table(spark, sf_dir, "labels").select(
        (F.col("quality") == 1).alias("execution_success"), (F.pmod("doc_id", F.lit(3)) > 0).alias("report_emitted"), (F.col("toxic") == 1).alias("contaminated"), F.when(F.pmod("doc_id", F.lit(5)) == 0, "e").alias("error"),
        F.when(F.pmod("doc_id", F.lit(2)) == 0, F.pmod("doc_id", F.lit(10)) / 10).alias("citation_grounding"), F.lit(None).cast("double").alias("citation_precision"), (F.pmod("doc_id", F.lit(4)) / 4).alias("citation_coverage"), F.lit(0.5).alias("unsupported_claim_rate"),
    )
    return J.generation_status(d)


def replayed_reports(spark, sf_dir):
    """Conversations as stored reports: claims are turns that cite the turn before them."""
    c = table(spark, sf_dir, "conversations")
    claims = c.select(F.col("conv_id").alias("report_id"), F.col("turn").alias("ord"), F.concat("text", F.lit(" [S"), "turn", F.lit("]")).alias("claim"))
    sources = c.select(F.col("conv_id").alias("report_id"), F.concat(F.lit("S"), "turn").alias("source_id"), F.lit("").alias("title"), F.col("text").alias("content"), F.lit("ok").alias("extract_status"), F.lit(False).alias("snippet_only"))
    kinds = F.when(F.pmod("conv_id", F.lit(3)) == 0, F.array().cast("array<string>")).when(F.pmod("conv_id", F.lit(3)) == 1, F.array(F.lit("heuristic"))).otherwise(F.array(F.lit("live")))
    return G.refreshed(claims, sources, c.select(F.col("conv_id").alias("report_id"), kinds.alias("providers")).distinct()).select("report_id", "judge", "status", "total_claims", "supported_claims")


def pinned_snapshot(spark, sf_dir):
    """Forbidden urls of prompts built from pages, and documents that match their pinned counts."""
    p = table(spark, sf_dir, "pages")
    prompt = F.concat(F.lit("task"), F.lit(" avoid {'urls': ['"), "url", F.lit("', '"), "url", F.lit("']}"))
    urls = p.select("page_id", J.forbidden_urls(prompt, F.lit("task")).alias("u"))
    sizes = {r.role: r["count"] for r in table(spark, sf_dir, "conversations").groupBy("role").count().collect()}
    checked = J.pinned(table(spark, sf_dir, "conversations"), sum(sizes.values()), "role", sizes).agg(F.count("*").alias("n_turns"))
    return urls.join(F.broadcast(checked)).select("page_id", F.size("u").alias("n_urls"), F.get("u", 0).alias("url"), "n_turns")


QUERIES = {f.__name__: f for f in (embedded_search, evidence_summaries, compressed_findings, payload_claims, generation_status, replayed_reports, pinned_snapshot)}

ORACLES = {
    "evidence_summaries": """
WITH c AS (SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE role = 'assistant') AS k FROM conversations GROUP BY 1),
e AS (SELECT conv_id, string_agg('t: ' || text, ' | ' ORDER BY turn) AS x FROM (SELECT * FROM conversations WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 3) GROUP BY 1)
SELECT conv_id AS question_id, md5(CASE WHEN k > 0 THEN 'Collected ' || k || ' verified evidence items across ' || n || ' bounded research rounds. Evidence: ' || x
  ELSE 'No verified evidence survived filtering for this subquestion.' END) AS summary_md5 FROM c LEFT JOIN e USING (conv_id)""",
    "compressed_findings": """
WITH l AS (SELECT conv_id AS run_id, 'Q' || turn AS q, 'Q' || turn || ': ' || text || ' Sources: ' || CASE role WHEN 'user' THEN 'a, b' ELSE 'no sources' END AS line FROM conversations)
SELECT run_id, md5(rtrim(substr(string_agg(line, chr(10) ORDER BY q), 1, 1200), ' ' || chr(10))) AS text_md5 FROM l GROUP BY 1""",
    "payload_claims": f"""
WITH s AS (SELECT item_id, {SENT.format(x='text')} AS s FROM benchmark)
SELECT item_id, md5(array_to_string(CASE WHEN item_id % 2 = 0 THEN s ELSE list_transform(s, lambda x: x || ' [S1] [S2]') END, '|')) AS claims_md5 FROM s""",
    "generation_status": """SELECT count(*) AS case_count, count(*) FILTER (WHERE quality = 1) AS success_count, count(*) FILTER (WHERE quality <> 1) AS failure_count, count(*) FILTER (WHERE doc_id % 3 > 0) AS report_emitted_count,
  count(*) FILTER (WHERE toxic = 1) AS contaminated_count, count(*) FILTER (WHERE doc_id % 5 = 0) AS error_count, round(avg(doc_id % 10 / 10.0::DOUBLE) FILTER (WHERE doc_id % 2 = 0), 4) AS citation_grounding_avg,
  count(*) FILTER (WHERE doc_id % 2 = 0) AS citation_grounding_scored_count, CAST(NULL AS DOUBLE) AS citation_precision_avg, 0 AS citation_precision_scored_count, round(avg(doc_id % 4 / 4.0::DOUBLE), 4) AS citation_coverage_avg,
  count(*) AS citation_coverage_scored_count, 0.5 AS unsupported_claim_rate_avg, count(*) AS unsupported_claim_rate_scored_count FROM labels""",
    "pinned_snapshot": "SELECT page_id, 1 AS n_urls, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS url, (SELECT count(*) FROM conversations) AS n_turns FROM pages",
}
