"""Durable runs as an event log: the state of a run is the fold of its requests in order, by the rules of `runrules`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corroborate.operators import runrules as Q

def fold(requests: DataFrame, start: str = "queued") -> DataFrame:
    """The state of each run after all its requests: run_id, status, worker, expires, changed, applied, rejected."""
    return Q.folded(requests, start=start).select("run_id", "status", "worker", "expires", "changed", "applied", "rejected")


def stale(runs: DataFrame, now: Column) -> DataFrame:
    """Running runs whose lease has run out."""
    return runs.filter((F.col("status") == "running") & (F.col("expires") <= now))


def next_queued(runs: DataFrame, now: Column) -> DataFrame:
    """The run that a worker takes next: the oldest queued one at the planner without a live lease."""
    free = F.col("worker").isNull() | F.col("expires").isNull() | (F.col("expires") <= now)
    return runs.filter((F.col("status") == "queued") & (F.col("stage") == "planner") & free).orderBy("created", "updated", "run_id").limit(1)


def recent(runs: DataFrame, n: int) -> DataFrame:
    """W13."""
    return runs.orderBy(F.desc("updated"), F.desc("created"), "run_id").limit(n)


def tail(events: DataFrame, after_id: int) -> DataFrame:
    """Events behind a cursor, in order of their id when read by it."""
    return events.filter(F.col("event_id") > after_id)


def trace_totals(runs: DataFrame, steps: DataFrame) -> DataFrame:
    """Latency from a run's first step to its last update, in milliseconds."""
    first = steps.groupBy("run_id").agg(F.min("created").alias("first"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return runs.join(first, "run_id", "left").select("run_id", F.round((micros("updated") - micros("first")) / 1000, 3).alias("latency_ms"))


def next_retry(steps: DataFrame) -> DataFrame:
    """Per run one more than the most retries that its steps or event payloads have seen."""
    return steps.groupBy("run_id").agg((F.greatest(F.lit(0), F.coalesce(F.max("retries"), F.lit(0)), F.coalesce(F.max("payload_retries"), F.lit(0))) + 1).alias("next_retry"))


def payload_defaults(payload: Column, stage: Column) -> Column:
    """struct(attempt, retryable, degraded) of a JSON payload, with defaults."""
    p = F.from_json(payload, "attempt int, retryable boolean, degraded boolean")
    return F.struct(F.coalesce(p["attempt"], F.lit(1)).alias("attempt"), F.coalesce(p["retryable"], stage == "error").alias("retryable"), F.coalesce(p["degraded"], F.lit(False)).alias("degraded"))


def breaker(attempts: DataFrame, threshold: int, cooldown_s: float) -> DataFrame:
    """Of attempts (key, ord, at, ok), at in seconds, per key how many a circuit breaker lets through, and whether it is open at the end."""

    def step(acc: Column, x: Column) -> Column:
        closed = acc["opened"].isNull()
        cooled = ~closed & (x["at"] - acc["opened"] >= cooldown_s)
        passes = closed | cooled
        failures = F.when(cooled, 0).otherwise(acc["failures"]) + F.when(passes & ~x["ok"], 1).otherwise(0)
        failures = F.when(passes & x["ok"], 0).otherwise(failures)
        opened = F.when(passes & x["ok"], F.lit(None)).when(passes & (failures >= threshold), x["at"]).when(cooled, F.lit(None)).otherwise(acc["opened"])
        return F.struct(failures.alias("failures"), opened.cast("double").alias("opened"), (acc["passed"] + passes.cast("int")).alias("passed"), (acc["refused"] + (~passes).cast("int")).alias("refused"))

    g = attempts.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ord", F.col("at").cast("double").alias("at"), "ok"))).alias("log"))
    begin = F.struct(F.lit(0).alias("failures"), F.lit(None).cast("double").alias("opened"), F.lit(0).alias("passed"), F.lit(0).alias("refused"))
    return g.select("key", F.aggregate("log", begin, step).alias("s")).select("key", "s.passed", "s.refused", F.col("s.opened").isNotNull().alias("open"))


def limiter(calls: DataFrame, per_second: float) -> DataFrame:
    """Of calls (key, ord, at) the time each may start: at the earliest one interval after the one before.

    start_n = max(at_n, start_(n-1) + i) has the closed form n*i + max over m<=n of (at_m - m*i): a running maximum."""
    i = 1.0 / per_second
    w = W.partitionBy("key").orderBy("ord")
    n = F.row_number().over(w) - 1
    lead = calls.withColumn("n", n).withColumn("free", F.col("at") - F.col("n") * i)
    return lead.withColumn("start", F.max("free").over(w.rowsBetween(W.unboundedPreceding, 0)) + F.col("n") * i).drop("n", "free")


def backoff(attempt: Column, base: float) -> Column:
    """Seconds to wait before a retry."""
    return base * F.pow(F.lit(2.0), attempt)


def budget(depth: Column, rounds: Column, calls: Column, deadline: Column, results: Column) -> Column:
    """A request's limits; deep requests get two rounds, two calls, 300 seconds and eight results at least."""
    deep = depth == "deep"
    least = lambda c, n: F.when(deep, F.greatest(c, F.lit(n))).otherwise(c)
    return F.struct(least(rounds, 2).alias("max_rounds"), least(calls, 2).alias("max_tool_calls"), F.coalesce(deadline, F.when(deep, 300.0)).alias("deadline_s"), F.when(deep, 2).otherwise(1).alias("min_evidence"), least(results, 8).alias("max_results"))


def otlp_spans(events: DataFrame) -> DataFrame:
    """K5: trace events (run_id, stage, status, ts, duration_ms) as spans: trace_id, span_id, start_ns, end_ns, code."""
    end = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    length = F.greatest(F.coalesce("duration_ms", F.lit(0.0)), F.lit(0.0)) * 1_000_000
    start = F.greatest(end - length.cast("bigint"), F.lit(0))
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return events.select("run_id", F.substr(F.sha2(F.col("run_id").cast("string"), 256), F.lit(1), F.lit(32)).alias("trace_id"), F.substr(F.sha2(F.concat_ws(":", F.col("run_id").cast("string"), "stage", stamp), 256), F.lit(1), F.lit(16)).alias("span_id"), start.alias("start_ns"), end.alias("end_ns"), F.when(F.col("status").isin("error", "fallback"), "ERROR").otherwise("OK").alias("code"))
