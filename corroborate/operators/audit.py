"""Audit rows: hints of failed candidates, metadata defaults, capability probes, attempt ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.functions import text as T
from corroborate.functions import urls as U


def _cut(c: str, n: int) -> Column:
    return F.substr(T.squeezed(F.coalesce(F.col(c), F.lit(""))), F.lit(1), F.lit(n))


def failed_hints(candidates: DataFrame) -> DataFrame:
    """Of candidates (title, url, query, provider, rank, extract_status, error_class, crawl_attempts, blocked) bounded rows on the blocked ones (their url only as a hash) and the failed ones; each once."""
    c = candidates.filter("blocked or extract_status = 'crawl_failed'")
    hints = c.select(
        _cut("title", 240).alias("title"),
        F.when(F.col("blocked"), F.sha2("url", 256)).alias("url_identity_sha256"),
        F.when(~F.col("blocked"), F.substr(U.display(F.col("url")), F.lit(1), F.lit(2048))).alias("url"),
        _cut("query", 320).alias("query"),
        _cut("provider", 80).alias("provider"),
        "rank",
        F.when(F.col("blocked"), "blocked").otherwise("failed").alias("crawl_status"),
        F.when(F.col("blocked"), "denylist_enforcement").otherwise(F.coalesce(F.nullif(_cut("error_class", 80), F.lit("")), F.lit("crawler_error"))).alias("error_class"),
        F.coalesce("crawl_attempts", F.when(F.col("blocked"), 0).otherwise(1)).alias("crawl_attempts"),
    )
    return hints.distinct()


def enriched(metadata: Column, content: Column, snippet_only: Column, retrieved_at: Column) -> Column:
    """A source's metadata map with defaults for what it lacks; its own values win."""
    given = F.map_filter(F.coalesce(metadata, F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull())
    status = F.when(T.stripped(content) == "", "empty").when(snippet_only, "snippet").otherwise("ok")
    wanted = {"retrieved_at": retrieved_at.cast("string"), "content_hash": F.sha2(content, 256), "content_type": F.lit("text/plain"), "extract_status": status, "snippet_only": snippet_only.cast("string"), "fallback_used": F.lit("false")}
    defaults = F.create_map(*[x for k, v in wanted.items() for x in (F.lit(k), v)])
    return F.map_concat(F.map_filter(defaults, lambda k, v: ~F.map_contains_key(given, k)), given)


def probe_status(requested: Column, actual: Column, n_tools: Column, n_results: Column, blocks: Column) -> Column:
    """What a search model's answer shows of its tool: blocks are its content's block types."""
    dated = F.concat(F.lit(r"^\Q"), requested, F.lit(r"\E-\d{6}(\d{2})?$"))
    matches = actual.isNull() | (actual == requested) | F.regexp_like(actual, dated)
    return F.when(~matches, "model_mismatch").when((n_tools > 0) & (n_results > 0), "tool_results").when(n_tools > 0, "tool_no_results").when(F.array_contains(blocks, "text"), "text_only_no_tool").when(F.size(blocks) > 0, "no_tool_result").otherwise("empty_response")


def model_matches(requested: Column, actual: Column) -> Column:
    """Equal, or the requested name with a valid date behind it."""
    tail = F.regexp_extract(actual, r"-(\d{6}|\d{8})$", 1)
    day = F.try_to_timestamp(F.when(F.length(tail) == 8, tail).otherwise(F.concat(tail, F.lit("01"))), F.lit("yyyyMMdd"))
    return (requested == actual) | ((tail != "") & (actual == F.concat(requested, F.lit("-"), tail)) & day.isNotNull())


def llm_failure(message: Column) -> Column:
    """The class of a model call's failure."""
    low = F.lower(message)
    rules = ((r"timed out|timeout", "timeout"), (r"\b429\b|rate limit", "rate_limit"), (r"\b5\d\d\b", "server_error"), (r"\b4\d\d\b", "client_error"), (r"json|parse", "invalid_json"), (r"empty", "empty_response"))
    out = None
    for pattern, name in rules:
        out = F.when(low.rlike(pattern), name) if out is None else out.when(low.rlike(pattern), name)
    return out.otherwise("unknown")


def attempts(calls: DataFrame) -> DataFrame:
    """Calls (call_id, stage, ledger array<struct<kind, class, duration_ms, tokens>>) as one row per attempt, summed by stage and kind."""
    rows = calls.select("call_id", "stage", F.posexplode("ledger").alias("attempt", "a")).select("call_id", "stage", "attempt", "a.*")
    return rows.groupBy("stage", "kind").agg(F.count("*").alias("n_attempts"), F.count("class").alias("n_failed"), F.count_distinct("call_id").alias("n_calls"), F.round(F.sum("duration_ms"), 3).alias("duration_ms"), F.sum("tokens").alias("tokens"))
