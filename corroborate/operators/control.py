"""Run control: the commands of a controller, folded by the rules of `runrules` with the leases of workers, and worker loops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corroborate.operators import runrules as Q
from corroborate.operators.runrules import OPEN, RULES, Rule


def controlled(commands: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Each run after its log in order of ord: run_id, status, stage, plan, error, retries, told (of each request).

    The log is (run_id, ord, ts, command, note, plan, stage), and with the other columns of `runrules.REQUEST` it holds leases too:
    commands that need a free run are refused while one is live."""
    return Q.folded(commands.withColumnRenamed("command", "kind"), rules, told=True).select("run_id", "status", "stage", "plan", "error", "retries", "told")


def reusable(runs: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Of checkpoints (run_id, q, evidence) those that a retried run need not research again: run_id, q, reused."""
    going = runs.filter((F.col("retries") > 0) & F.col("plan").isNotNull() & F.col("status").isin(*OPEN)).select("run_id")
    return checkpoints.join(going, "run_id").select("run_id", "q", (F.col("evidence") > 0).alias("reused"))


def worker_loop(polls: DataFrame, max_runs: int | None = None, idle_exit: bool = False) -> DataFrame:
    """Of polls (worker, ord, run_id or null) what each worker's loop tells when it ends: processed, idle polls since the last run, the last run and why."""
    so_far = W.partitionBy("worker").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    p = polls.withColumn("done", F.count("run_id").over(so_far))
    full = F.col("run_id").isNotNull() & (F.col("done") >= max_runs) if max_runs is not None else F.lit(False)
    p = p.withColumn("stop", F.when(full, "max_runs").when(F.lit(idle_exit) & F.col("run_id").isNull(), "idle"))
    p = p.withColumn("ended", F.count("stop").over(so_far.rowsBetween(W.unboundedPreceding, -1)))
    run = p.filter("ended = 0").groupBy("worker").agg(F.count("run_id").alias("processed"), F.max(F.when(F.col("run_id").isNotNull(), F.struct("ord", "run_id"))).alias("last"), F.max("stop").alias("stop"), F.collect_list(F.when(F.col("run_id").isNull(), F.col("ord"))).alias("idle"))
    since = F.size(F.filter("idle", lambda o: F.col("last.ord").isNull() | (o > F.col("last.ord"))))
    return run.select("worker", "processed", since.alias("idle_polls"), F.col("last.run_id").alias("last_run_id"), F.coalesce("stop", F.lit("interrupted")).alias("stopped_reason"))


def answered_search(attempts: DataFrame, max_attempts: int = 3, base: float = 0.5, policy: str = "mock") -> DataFrame:
    """Of landed attempts (query_id, provider, hop, attempt, ok, n_rows) how the search of each query ends.

    A provider is tried up to max_attempts times, after waiting base * 2^n before try n+1; the first hop with rows answers. Where none
    has, the policy decides: `mock` rows, a `degraded` empty answer, or `fail`. A row a query: provider, hops, tries, waited, outcome."""
    w = W.partitionBy("query_id", "hop").orderBy("attempt")
    tried = attempts.filter(F.col("attempt") < max_attempts).withColumn("before", F.coalesce(F.max(F.col("ok").cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    tried = tried.filter("before = 0")  # nothing is tried after it worked
    won = F.min(F.when(F.col("ok") & (F.col("n_rows") > 0), F.col("hop"))).over(W.partitionBy("query_id"))
    tried = tried.withColumn("won", won).filter(F.col("won").isNull() | (F.col("hop") <= F.col("won")))
    wait = F.when(F.col("attempt") > 0, F.lit(base) * F.pow(F.lit(2.0), F.col("attempt") - 1)).otherwise(0.0)
    g = tried.groupBy("query_id").agg(F.max("won").alias("won"), F.max(F.when(F.col("hop") == F.col("won"), F.col("provider"))).alias("p"), F.countDistinct("hop").alias("hops"), F.count("*").alias("tries"), F.sum(wait).alias("waited"))
    none = {"mock": "fallback_mock", "degraded": "degraded", "fail": "failed"}[policy]
    outcome = F.when(F.col("won").isNull(), none).when(F.col("hops") > 1, "fallback").otherwise("ok")
    return g.select("query_id", F.coalesce("p", F.lit("mock" if policy == "mock" else None)).alias("provider"), "hops", "tries", "waited", outcome.alias("outcome"))
