"""Search adapters as relations: each gives rows (query_id, ord, title, url, content, provider, score) from landed results.

Live adapters are out of reach of a query engine; what they returned is landed as (query_id, provider, ord, title,
url, content) and scored here by each provider's rule."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.functions import text as T
from corroborate.operators.retrieval import top_k

# The six documents of the mock adapter.
MOCK = (
    ("Supervisor researcher pattern", "https://example.local/supervisor-researcher", "A supervisor-researcher deep research agent decomposes a broad question into independent subquestions, runs worker researchers concurrently, and merges their findings with source IDs for later citation checks."),
    ("Agentic RAG evidence handling", "https://example.local/agentic-rag", "Agentic RAG differs from normal RAG because the system can plan searches, call tools, inspect intermediate evidence, and revise the retrieval path before producing a final answer."),
    ("Citation faithfulness check", "https://example.local/citation-faithfulness", "Citation faithfulness checks compare each cited claim with the referenced source text, flagging claims whose words or facts are not supported by the cited source."),
    ("Tool failure fallback", "https://example.local/tool-fallback", "Reliable agent tools should use timeout budgets, bounded retries, circuit breakers, and deterministic fallback providers so a failed search API does not stop the full research workflow."),
    ("Trace and cost attribution", "https://example.local/trace-cost", "Structured trace logs and per-stage token accounting make it possible to explain latency, cost, and failure recovery for each stage of a multi-agent research pipeline."),
    ("Benchmark harness design", "https://example.local/benchmark-harness", "A reproducible benchmark harness records seed, configuration, latency, token estimates, source counts, citation retention, and task success for every research case."),
)
# Words that query candidates leave out, the providers, and which one stands in for another.
STOP = [
    "about", "agent", "agents", "and", "are", "between", "compare", "compared", "common", "does", "from", "have", "how", "implement", "implemented", "into", "needed",
    "should", "that", "the", "their", "used", "what", "when", "where", "which", "why", "with",
]
PROVIDERS = ("wikipedia", "bing", "searxng", "jina", "brave", "tavily", "gateway-web", "mcp")
FALLBACK = {"gateway-web": "bing"}


def mock(spark: SparkSession, queries: DataFrame, k: int) -> DataFrame:
    """The mock corpus by shared tokens, six rows a query before the cut."""
    docs = spark.createDataFrame([(i, *d) for i, d in enumerate(MOCK)], "ord int, title string, url string, content string")
    d = docs.withColumn("d", T.tokens(F.concat_ws(" ", "title", "url", "content")))
    q = queries.select("query_id", T.tokens(F.col("text")).alias("q"))
    scored = q.join(F.broadcast(d)).withColumn("score", F.size(F.array_intersect("q", "d")) + F.lit(0.1))
    return top_k(scored, k, [F.desc("score"), F.asc("ord")]).select("query_id", (F.col("rank") - 1).alias("ord"), "title", "url", "content", F.lit("mock").alias("provider"), "score")


def score(provider: Column, overlap: Column, place: Column, n: Column, limit: int) -> Column:
    """Each provider's score of the row at place (from 0) of n: shared tokens times its weight plus a bonus for early places."""
    weight = F.create_map(*[F.lit(x) for kv in {"wikipedia": 10, "bing": 8}.items() for x in kv])
    general = F.coalesce(weight[provider], F.lit(5)) * overlap + (limit - place)
    return F.when(provider == "gateway-web", F.greatest(n - (place + 1), F.lit(1))).when(provider == "mcp", n - place).otherwise(general).cast("double")


def landed(results: DataFrame, queries: DataFrame, provider: str, k: int) -> DataFrame:
    """A provider's landed results, scored; at most k a query by their place."""
    n = results.filter(F.col("provider") == provider).join(queries.select("query_id", T.tokens(F.col("text")).alias("q")), "query_id").filter(F.col("ord") < k)
    counts = n.groupBy("query_id").agg(F.count("*").alias("n"))
    shared = F.size(F.array_intersect("q", T.tokens(F.concat_ws(" ", "title", "content"))))
    return n.join(counts, "query_id").select("query_id", "ord", "title", "url", "content", "provider", score(F.col("provider"), shared, F.col("ord"), F.col("n"), k).alias("score"))


def build(name: str, spark: SparkSession, results: DataFrame | None = None) -> Callable[[DataFrame, int], DataFrame]:
    """The adapter of a name; its queries without a row are answered by the fallback adapter."""
    if name == "mock":
        return lambda q, k: mock(spark, q, k)
    if name not in PROVIDERS:
        raise ValueError(f"unknown search adapter: {name}")

    def search(q: DataFrame, k: int) -> DataFrame:
        own = landed(results, q, name, k)
        rest = q.join(own.select("query_id").distinct(), "query_id", "left_anti")
        return own.unionByName(build(FALLBACK.get(name, "mock"), spark, results)(rest, k))

    return search


def keywords(query: Column, pattern: str, stop: list[str]) -> Column:
    """Distinct words of a query, the first spelling of each, without stop words and short ones."""
    bare = lambda w: F.trim(F.lower(w), F.lit("."))
    words = F.filter(T.extract_all(query, pattern), lambda w: ~bare(w).isin(stop) & ((F.length(bare(w)) > 2) | bare(w).rlike(r"^\d+$")))
    begin = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<string>").alias("out"))
    add = lambda acc, w: F.when(F.array_contains(acc["seen"], bare(w)), acc).otherwise(F.struct(F.concat(acc["seen"], F.array(F.lower(w))).alias("seen"), F.concat(acc["out"], F.array(w)).alias("out")))
    return F.aggregate(words, begin, add)["out"]


def wikipedia_candidates(query: Column) -> Column:
    """Eight keywords, four, and the query itself."""
    w = keywords(query, r"[A-Za-z][A-Za-z0-9_-]+", STOP)
    join = lambda n: F.array_join(F.slice(w, 1, n), " ")
    return F.array_distinct(F.array_compact(F.array(F.when(F.size(w) > 0, join(8)), F.when(F.size(w) > 4, join(4)), F.nullif(F.trim(query), F.lit("")))))


def _without(text: Column, word: Column) -> Column:
    """text without word wherever it stands between word bounds, in capitals or not."""
    return F.regexp_replace(text, F.concat(F.lit(r"(?i)\b\Q"), word, F.lit(r"\E\b")), F.lit(""))


def bing_candidates(query: Column) -> Column:
    """The query, ten keywords (with site: for a domain in it), and its quoted phrases."""
    site = F.lower(F.regexp_extract(query, r"\b(?:www\.)?([A-Za-z0-9.-]+\.[A-Za-z]{2,})\b", 1))
    w = F.array_join(F.slice(keywords(query, r"[A-Za-z0-9][A-Za-z0-9_.-]*", STOP + ["who", "latest", "current"]), 1, 10), " ")
    compact = F.when(site == "", w).otherwise(F.concat(T.squeezed(_without(w, site)), F.lit(" site:"), site))
    quoted = F.array_join(F.transform(F.slice(T.extract_all(query, r'"([^"\n]{3,100})"', 1), 1, 2), lambda x: F.concat(F.lit('"'), x, F.lit('"'))), " ")
    return F.array_distinct(F.filter(F.transform(F.array(query, F.when(w != "", compact), quoted), lambda x: T.squeezed(x)), lambda x: x.isNotNull() & (x != "")))


def query_domain(query: Column) -> Column:
    """T26."""
    return F.nullif(F.lower(F.regexp_extract(query, r"(?:site:)?(?:www\.)?([A-Za-z0-9.-]+\.[A-Za-z]{2,})", 1)), F.lit(""))
