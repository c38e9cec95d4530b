"""Evaluation metrics over case records, costs, latencies and crawls. Rates over no rows are 0, averages over no values null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.functions import text as T
from corroborate.operators.quantiles import with_percentiles
from corroborate.operators.retrieval import small


def rate(a: Column, b: Column) -> Column:
    return F.when(b > 0, F.round(a / b, 4)).otherwise(0.0)


def case_metrics(r: DataFrame) -> DataFrame:
    """Rows (case_id, answer, n_claims, total_claims, supported_claims, unsupported_claims, all_cited, mean_quality, retention, n_sources, fallbacks, failure_case, format) with the case's flags."""
    text = T.stripped(F.coalesce("answer", F.lit(""))) != ""
    body = F.regexp_replace(F.trim("answer"), r"(?s)^```(?:json)?\s*|\s*```$", "")
    valid = text & F.when(F.col("format").startswith("json"), F.try_parse_json(body).isNotNull()).otherwise(F.lit(True))
    substantive = text & (F.col("n_claims") > 0)
    grounded = substantive & (F.col("total_claims") > 0) & (F.col("n_claims") == F.col("total_claims")) & (F.col("supported_claims") == F.col("total_claims")) & F.col("all_cited")
    usable = valid & grounded
    return r.withColumns(
        {
            "task_format_valid": valid,
            "substantive_answer": substantive,
            "grounded_answer": grounded,
            "evidence_abstention": text & ~substantive,
            "final_result_usable": usable,
            "unsupported_claim_rate": F.when(F.col("total_claims") > 0, F.round(F.col("unsupported_claims") / F.col("total_claims"), 4)),
            "source_quality": F.round("mean_quality", 4),
            "legacy_success": (F.col("retention") >= 0.8) & (F.col("n_sources") > 0),
            "tool_failure_recovery": F.when(F.col("failure_case"), F.when(usable & (F.col("fallbacks") > 0), 1.0).otherwise(0.0)),
        }
    )


def percentile(value: str, p: float) -> Column:
    """A4: exact, interpolated linearly; 0 without values. For small groups: it holds all values of one; quantiles.percentiles does not."""
    return F.coalesce(F.percentile(value, F.lit(p)), F.lit(0.0))


def evaluation_summary(r: DataFrame, by: list[str]) -> DataFrame:
    """A2, A3: per group, of case_metrics() rows with verdict, latency_ms, tokens and cost, counts, rates, means and percentiles: one pass, and the latencies once more for each narrowing of the percentiles."""
    n = F.count("*")
    yes = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    verdicts = ("correct", "incorrect", "not_attempted", "unscored")
    points = {"p50_latency_ms": 0.5, "p90_latency_ms": 0.9}
    counts = r.groupBy(*by).agg(
        n.alias("case_count"),
        *(x for c in ("task_format_valid", "grounded_answer", "evidence_abstention") for x in (yes(F.col(c)).alias(f"{c}_count"), rate(yes(F.col(c)), n).alias(f"{c}_rate"))),
        *(F.count_if(F.coalesce("verdict", F.lit("unscored")) == v).alias(f"answer_{v}_count") for v in verdicts),
        rate(F.count_if(F.col("verdict") == "correct"), n).alias("answer_correct_rate"),
        *(F.round(F.avg(c), 4).alias(f"{c}_avg") for c in ("unsupported_claim_rate", "source_quality", "tool_failure_recovery")),
        F.count("tool_failure_recovery").alias("tool_failure_recovery_applicable_count"),
        F.coalesce(F.max("latency_ms"), F.lit(0.0)).alias("max_latency_ms"),
        F.round(F.avg("tokens"), 3).alias("avg_tokens"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"),
        F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 8).alias("total_cost_usd"),
    )
    return with_percentiles(counts, r, by, "latency_ms", points).fillna(0.0, list(points))


def record_cost(input_text: Column, output_text: Column, input_per_1m: float, output_per_1m: float) -> dict[str, Column]:
    """One cost record of estimated tokens."""
    i, o = T.cost_tokens(input_text), T.cost_tokens(output_text)
    return {"input_tokens": i, "output_tokens": o, "cost": F.round(i * input_per_1m / 1_000_000 + o * output_per_1m / 1_000_000, 8)}


def usage_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Usage rows (model, prompt_tokens, completion_tokens, hit_tokens, miss_tokens) priced by (model, hit, miss, output) per million; unknown models and missing token counts have no price but an error text."""
    miss = F.coalesce("miss_tokens", F.greatest(F.col("prompt_tokens") - F.coalesce("hit_tokens", F.lit(0)), F.lit(0)))
    price = (F.coalesce("hit_tokens", F.lit(0)) * F.col("hit") + miss * F.col("miss") + F.col("completion_tokens") * F.col("output")) / 1_000_000
    p = prices.select(F.lower("model").alias("__m"), "hit", "miss", "output")
    counted = (F.coalesce("prompt_tokens", F.lit(0)) > 0) & (F.coalesce("completion_tokens", F.lit(0)) > 0)
    error = F.when(~counted, "usage has no token counts").when(F.col("__m").isNull(), "no price for this model")
    return usage.join(small(p), F.lower("model") == F.col("__m"), "left").withColumn("error", error).withColumn("cost_usd", F.when(F.col("error").isNull(), price)).drop("__m", "hit", "miss", "output")


def cost_rollup(records: DataFrame, run: str = "run_id") -> DataFrame:
    """Per run its total and its breakdown by stage and model, as one rollup."""
    total_in = F.sum(F.col("input_tokens") + F.col("cache_creation_tokens") + F.col("cache_read_tokens"))
    r = records.rollup(run, "stage", "model").agg(F.grouping_id().alias("level"), total_in.alias("total_input_tokens"), F.sum("output_tokens").alias("total_output_tokens"), (total_in + F.sum("output_tokens")).alias("total_tokens"), F.round(F.sum("cost"), 8).alias("total_cost_usd"))
    return r


# Marks of failures, in the order they are tried: (pattern, class, retryable).
CRAWL_ERRORS = (
    (r"timed out|timeout", "timeout", True),
    (r"\b(?:status|http)\s+429\b", "http_429", True),
    (r"\b(?:status|http)\s+5\d\d\b", "http_5xx", True),
    (r"\b(?:status|http)\s+4\d\d\b", "http_4xx", False),
    (r"unsupported content type", "non_html", False),
    (r"response too large", "response_too_large", False),
    (r"dns resolution failed", "dns_failure", True),
    (r"url policy", "policy_rejected", False),
    (r"connection refused|connection reset|connection aborted|remote end closed|temporary failure|network is unreachable|ssl", "connection_failure", True),
    (r"empty content", "empty_content", False),
)


def crawl_error(message: Column) -> Column:
    """struct(class, retryable) of an error message."""
    low = F.lower(message)
    out = None
    for pattern, name, again in CRAWL_ERRORS:
        told = F.struct(F.lit(name).alias("class"), F.lit(again).alias("retryable"))
        out = F.when(low.rlike(pattern), told) if out is None else out.when(low.rlike(pattern), told)
    return out.otherwise(F.struct(F.lit("crawler_error").alias("class"), F.lit(False).alias("retryable")))


def retrieval_audit(candidates: DataFrame, by: list[str]) -> DataFrame:
    """Of candidates (url, verified, crawl_attempts, extract_status, error_class, violation) counts, and the histogram of error classes sorted by name; audits of rounds merge by grouping coarser."""
    failed = F.when(F.col("extract_status") == "crawl_failed", F.coalesce(F.nullif(F.col("error_class"), F.lit("")), F.lit("crawler_error")))
    per_class = candidates.withColumn("e", failed).groupBy(*by, "e").agg(
        F.count("*").alias("n"), F.count_if(F.col("url").rlike("^https?://")).alias("f"), F.count_if("verified").alias("v"), F.sum(F.coalesce("crawl_attempts", F.lit(0))).alias("a"), F.count("violation").alias("b")
    )
    errors = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("e").isNotNull(), F.struct("e", "n")))))
    return per_class.groupBy(*by).agg(F.sum("n").alias("candidate_count"), F.sum("f").alias("fetchable_count"), F.sum("v").alias("verified_count"), F.sum("a").alias("crawl_attempts"), errors.alias("error_classes"), F.sum("b").alias("blocked_count"), (F.sum("b") > 0).alias("denylist_enforcement_hit"))


def distributions(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of every value of the columns: dimension, value, n; one pass over the rows."""
    tall = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    return tall.groupBy("dimension", "value").agg(F.count("*").alias("n"))
