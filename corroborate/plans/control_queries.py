"""Queries of run control, worker loops, search outcomes and hybrid retrieval. Events stand for commands, polls and attempts."""

from __future__ import annotations

from pyspark.sql import functions as F

from corroborate.functions import text as T
from corroborate.functions import times as N
from corroborate.operators import control as C
from corroborate.operators import evidence as E
from corroborate.operators import judging as J
from corroborate.operators import replay as R
from corroborate.operators import retrieval as X
from corroborate.operators import runrules as Q
from corroborate.plans.evidence_queries import _FUSE, _VEC, K, _label_ranking, _vectors
from corroborate.session import table

COMMANDS = ("plan", "approve", "advance", "finish", "fail", "retry", "edit", "advance", "reject", "plan", "cancel")
SETTINGS = ("model_api_key", "API_KEY", "token", "tokens", "db_password", "region", "secret_sauce", "client_secret")
VERDICTS = ("correct", " Incorrect", "not_attempted", "NOT_ATTEMPTED ", "unscored", "maybe")
STATUSES = ("ok", "snippet", "blocked", "empty", "crawl_failed", "")


def _key(c="props"):
    return F.get_json_object(c, "$.k").cast("int")


def run_control(spark, sf_dir):
    """Eight commands a run, chosen by each event's key."""
    e = table(spark, sf_dir, "events").withColumn("k", _key())
    command = F.element_at(F.array(*[F.lit(x) for x in COMMANDS]), F.pmod("k", F.lit(len(COMMANDS))) + 1)
    rows = e.select(F.floor(F.col("event_id") / 8).alias("run_id"), F.col("event_id").alias("ord"), "ts", command.alias("command"), F.concat(F.lit("note "), "k").alias("note"), F.concat(F.lit("p"), "k").alias("plan"), F.when(F.col("value") > 50, "verifier").otherwise("researcher").alias("stage"))
    return C.controlled(rows).withColumn("told", F.array_join("told", ","))


def run_log(spark, sf_dir):
    """users' weeks of events as logs of commands and leases: two workers, leases of `value` hours, commands that a live lease refuses."""
    e = table(spark, sf_dir, "events").withColumn("k", _key())
    kinds = [r.kind for r in Q.RULES]
    high = F.col("value") > 50
    named = {
        "kind": F.element_at(F.array(*[F.lit(x) for x in kinds]), F.pmod("k", F.lit(len(kinds))) + 1),
        "worker": F.concat(F.lit("w"), F.pmod(F.floor(F.col("k") / len(kinds)), F.lit(2))),
        "expected": F.when(high, F.array(F.lit("queued"), F.lit("waiting_approval"))).otherwise(F.array(F.lit("failed"))),
        "status": F.when(F.col("event_type") == "view", "queued").otherwise("running"),
        "lease_seconds": F.round(F.col("value") * 100).cast("long") * 36,
        "note": F.concat(F.lit("note "), "k"),
        "plan": F.concat(F.lit("p"), "k"),
        "stage": F.when(high, "verifier").otherwise("researcher"),
    }
    log = e.select(F.concat_ws("-", "user_id", F.weekofyear("ts")).alias("run_id"), F.col("event_id").alias("ord"), "ts", *[c.alias(n) for n, c in named.items()])
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return Q.folded(log).select("run_id", "status", "stage", "plan", "error", "retries", "worker", stamp("expires"), stamp("changed"), "applied", "rejected")


def worker_loops(spark, sf_dir):
    """Users as workers whose polls find a run or, on an error, nothing; loops that end after five runs, when idle, or not."""
    e = table(spark, sf_dir, "events")
    polls = e.select(F.col("user_id").alias("worker"), F.col("event_id").alias("ord"), F.when(F.col("event_type") != "error", F.col("event_id")).alias("run_id"))
    out = None
    for mode, most, idle in (("five", 5, False), ("idle", None, True), ("open", None, False)):
        r = C.worker_loop(polls, most, idle).withColumn("mode", F.lit(mode))
        out = r if out is None else out.unionByName(r)
    return out


def _attempts(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("hop", F.pmod("event_id", F.lit(3)).cast("int"))
    n = F.row_number().over(X.W.partitionBy("user_id", "hop").orderBy("event_id")) - 1
    return e.select(F.col("user_id").alias("query_id"), F.concat(F.lit("provider"), "hop").alias("provider"), "hop", n.alias("attempt"), (F.col("event_type") == "purchase").alias("ok"), F.pmod(_key(), F.lit(3)).alias("n_rows"))


def search_outcomes(spark, sf_dir):
    """Users as queries whose events are attempts at three providers in turn."""
    out = None
    for policy in ("mock", "degraded", "fail"):
        r = C.answered_search(_attempts(spark, sf_dir), policy=policy).withColumn("policy", F.lit(policy))
        out = r if out is None else out.unionByName(r)
    return out


def _told(df):
    m = lambda n: F.try_element_at("metadata", F.lit(n)).alias(n)
    return df.select("query_id", "doc_id", "rank", F.round("score", 9).alias("score"), *(m(n) for n in ("retrieval_mode", "keyword_rank", "vector_rank", "rrf_k", "vector_weight", "retrieval_degraded")))


def hybrid_sources(spark, sf_dir):
    """Fused sources with what the fusion knew of them."""
    q, e = _vectors(spark, sf_dir)
    return _told(X.hybrid_sources(_label_ranking(spark, sf_dir), lambda: X.vector_topk(q, e.select("doc_id", "embedding"), K), K, rrf_k=60, vector_weight=1.5))


def degraded_sources(spark, sf_dir):
    """The same where the vector search fails while it runs."""
    q, e = _vectors(spark, sf_dir)
    broken = e.select("doc_id", F.when(F.col("doc_id") >= 0, F.raise_error(F.lit("no index")).cast("array<float>")).alias("embedding"))
    return _told(X.hybrid_sources(_label_ranking(spark, sf_dir), lambda: X.vector_topk(q, broken, K), K))


def redactions(spark, sf_dir):
    """Keys in conversations' texts, and settings of which some names are secret."""
    c = table(spark, sf_dir, "conversations")
    text = F.concat("text", F.lit(" sk-a_"), "conv_id", F.lit("-Z. sk- task-sk-"), "turn")
    value = F.when(F.pmod("conv_id", F.lit(3)) == 0, "").when(F.pmod("conv_id", F.lit(3)) == 1, F.col("role"))
    hidden = R.redact_settings(F.map_from_arrays(F.array(*[F.lit(n) for n in SETTINGS]), F.array_repeat(value, len(SETTINGS))))
    return c.select("conv_id", "turn", F.md5(T.redacted(text)).alias("text_md5"), F.array_join(F.transform(F.array(*[F.lit(n) for n in SETTINGS]), lambda n: F.coalesce(F.try_element_at(hidden, n), F.lit("-"))), ",").alias("settings"))


def judgment_contracts(spark, sf_dir):
    """Judgments that may contradict themselves."""
    e = table(spark, sf_dir, "events").withColumn("k", _key())
    verdict = F.element_at(F.array(*[F.lit(v) for v in VERDICTS]), F.pmod("k", F.lit(len(VERDICTS))) + 1)
    score = F.when(F.pmod("event_id", F.lit(4)) > 0, F.pmod("event_id", F.lit(4)) / 2)
    # to two digits as the SQL rounds, by the double itself: round(x, 2) goes by its decimal form, where 1.005 is a half
    confidence = F.when(F.pmod("event_id", F.lit(7)) > 0, F.round(F.col("value") / 100 * 100) / 100)
    listed = lambda n: F.when(F.pmod("event_id", F.lit(n)) == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return e.select("event_id", J.contract(verdict, score, confidence, listed(5), listed(6)).alias("verdict"))


def evidence_readiness(spark, sf_dir):
    """Pages with statuses, crawlers and providers of all kinds."""
    status = F.element_at(F.array(*[F.lit(s) for s in STATUSES]), F.pmod("page_id", F.lit(len(STATUSES))).cast("int") + 1)
    snippet = F.when(F.pmod("page_id", F.lit(4)) < 3, F.pmod("page_id", F.lit(4)) == 1)
    crawler = F.when(F.pmod("page_id", F.lit(3)) > 0, F.when(F.pmod("page_id", F.lit(3)) == 1, "c").otherwise(""))
    provider = F.when(F.pmod("page_id", F.lit(2)) == 0, "gateway-web").otherwise("bing")
    blocked = F.when(F.pmod("page_id", F.lit(11)) < 2, F.pmod("page_id", F.lit(11)) == 0)
    content = F.when(F.pmod("page_id", F.lit(13)) > 0, F.when(F.pmod("page_id", F.lit(13)) == 1, " ").otherwise(F.col("html")))
    return table(spark, sf_dir, "pages").select("page_id", E.citable(status, snippet, content).alias("citable"), E.evidence_ready(status, snippet, crawler, provider, blocked).alias("ready"))


def timestamps(spark, sf_dir):
    """events' moments written out in three forms, read back, moved by a lease and measured."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("t"), "value")
    iso = N.formatted(F.col("t"))
    k = F.pmod("event_id", F.lit(4))
    told = F.when(k == 0, F.regexp_replace(iso, r"\+00:00$", "Z")).when(k == 1, iso).when(k == 2, F.concat(F.lit(" "), F.regexp_replace(iso, r"\+00:00$", "+02:00"))).otherwise(F.concat(iso, F.lit("x")))
    back = N.parsed(told)
    end = N.later(back, F.col("value"))
    return e.select("event_id", N.formatted(back).alias("moment"), N.formatted(end).alias("lease_until"), N.millis(back, end).alias("ms"))


QUERIES = {f.__name__: f for f in (run_control, run_log, worker_loops, search_outcomes, hybrid_sources, degraded_sources, redactions, judgment_contracts, evidence_readiness, timestamps)}

_CMD = "['" + "', '".join(COMMANDS) + "']"

_KINDS = "['" + "', '".join(r.kind for r in Q.RULES) + "']"
_LIST = lambda x: "[" + ", ".join(f"'{v}'" for v in x) + "]"

ORACLES = {
    "redactions": f"""
SELECT conv_id, turn, md5(regexp_replace(text || ' sk-a_' || conv_id || '-Z. sk- task-sk-' || turn, 'sk-[A-Za-z0-9_-]+', 'sk-***', 'g')) AS text_md5,
  array_to_string(list_transform({_LIST(SETTINGS)}, lambda n: CASE WHEN lower(n) IN ('api_key', 'token', 'secret', 'password') OR regexp_matches(lower(n), '_(api_key|token|secret|password)$')
    THEN CASE WHEN conv_id % 3 = 1 THEN '<redacted>' ELSE '' END ELSE CASE conv_id % 3 WHEN 0 THEN '' WHEN 1 THEN role ELSE '-' END END), ',') AS settings FROM conversations""",
    "judgment_contracts": f"""
WITH j AS (SELECT event_id, lower(trim({_LIST(VERDICTS)}[CAST(json_extract(props, '$.k') AS INT) % {len(VERDICTS)} + 1])) AS v, CASE WHEN event_id % 4 > 0 THEN event_id % 4 / 2.0 END AS score,
  CASE WHEN event_id % 7 > 0 THEN round(value / 100, 2) END AS conf, event_id % 5 = 0 AS missing, event_id % 6 = 0 AS wrong FROM events)
SELECT event_id, CASE WHEN v IN ('correct', 'incorrect', 'not_attempted') AND conf >= 0 AND conf <= 1 AND coalesce(score, 0) <= 1
  AND CASE WHEN v = 'correct' THEN coalesce(score, 1) = 1 AND NOT missing AND NOT wrong ELSE coalesce(score, 0) < 1 END THEN v ELSE 'unscored' END AS verdict FROM j""",
    "evidence_readiness": f"""
WITH p AS (SELECT page_id, {_LIST(STATUSES)}[CAST(page_id % {len(STATUSES)} + 1 AS INT)] AS status, CASE WHEN page_id % 4 < 3 THEN page_id % 4 = 1 END AS snippet, page_id % 3 = 1 AS crawled, page_id % 2 = 0 AS gateway, page_id % 11 = 0 AS blocked,
  page_id % 13 > 1 AND trim(html) <> '' AS filled FROM pages)
SELECT page_id, filled AND coalesce(NOT snippet, true) AND status NOT IN ({{blocked}}) AS citable, NOT blocked AND (NOT gateway OR (status = 'ok' AND coalesce(NOT snippet, false) AND crawled)) AS ready FROM p""".replace("{blocked}", ", ".join(f"'{s}'" for s in E.NOT_EXTRACTED)),
    "timestamps": r"""
WITH t AS (SELECT event_id, value, CASE event_id % 4 WHEN 2 THEN CAST(ts AS TIMESTAMP) - INTERVAL 2 HOUR WHEN 3 THEN NULL ELSE CAST(ts AS TIMESTAMP) END AS a FROM events),
u AS (SELECT *, a + to_microseconds(CAST(round(value * 1000000) AS BIGINT)) AS z FROM t)
SELECT event_id, regexp_replace(strftime(a, '%Y-%m-%dT%H:%M:%S.%f'), '\.000000$', '') || '+00:00' AS moment, regexp_replace(strftime(z, '%Y-%m-%dT%H:%M:%S.%f'), '\.000000$', '') || '+00:00' AS lease_until,
  round((epoch_us(z) - epoch_us(a)) / 1000.0, 3)::DOUBLE AS ms FROM u""",
    "run_control": f"""
WITH RECURSIVE c AS (SELECT event_id // 8 AS run_id, event_id % 8 AS n, {_CMD}[CAST(json_extract(props, '$.k') AS INT) % {len(COMMANDS)} + 1] AS cmd, CAST(json_extract(props, '$.k') AS INT) AS k, value FROM events),
s AS (SELECT DISTINCT run_id, CAST(-1 AS BIGINT) AS n, 'queued' AS status, 'planner' AS stage, CAST(NULL AS VARCHAR) AS plan, CAST(NULL AS VARCHAR) AS error, 0 AS retries, '' AS told FROM c
UNION ALL SELECT run_id, n, CASE WHEN NOT ok THEN status ELSE CASE cmd WHEN 'plan' THEN 'waiting_approval' WHEN 'approve' THEN 'queued' WHEN 'edit' THEN 'queued' WHEN 'reject' THEN 'cancelled' WHEN 'cancel' THEN 'cancelled'
    WHEN 'retry' THEN 'queued' WHEN 'advance' THEN 'running' WHEN 'fail' THEN 'failed' ELSE 'succeeded' END END,
  CASE WHEN NOT ok THEN stage ELSE CASE cmd WHEN 'plan' THEN 'approval' WHEN 'approve' THEN 'researcher' WHEN 'edit' THEN 'researcher' WHEN 'retry' THEN CASE WHEN plan IS NULL THEN 'planner' ELSE 'researcher' END
    WHEN 'advance' THEN CASE WHEN value > 50 THEN 'verifier' ELSE 'researcher' END WHEN 'fail' THEN stage ELSE 'completed' END END,
  CASE WHEN ok AND cmd IN ('plan', 'edit') THEN 'p' || k ELSE plan END,
  CASE WHEN NOT ok THEN error WHEN cmd IN ('reject', 'fail') THEN 'note ' || k WHEN cmd = 'cancel' THEN 'run cancelled' END,
  retries + CASE WHEN ok AND cmd = 'retry' THEN 1 ELSE 0 END,
  told || CASE WHEN told = '' THEN '' ELSE ',' END || CASE WHEN ok THEN 'applied' WHEN cmd = 'cancel' THEN 'kept' ELSE 'refused' END
FROM (SELECT c.*, status, stage, plan, error, retries, told, CASE cmd WHEN 'plan' THEN status IN ('queued', 'running') WHEN 'advance' THEN status IN ('queued', 'running') WHEN 'retry' THEN status = 'failed'
    WHEN 'finish' THEN status = 'running' WHEN 'cancel' THEN status IN ('queued', 'running', 'waiting_approval') WHEN 'fail' THEN status IN ('queued', 'running', 'waiting_approval') ELSE status = 'waiting_approval' END AS ok
  FROM s JOIN c ON c.run_id = s.run_id AND c.n = s.n + 1))
SELECT run_id, status, stage, plan, error, retries, told FROM s QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY n DESC) = 1""",
    "run_log": f"""
WITH RECURSIVE j AS (SELECT user_id || '-' || weekofyear(ts) AS run_id, row_number() OVER (PARTITION BY user_id, weekofyear(ts) ORDER BY event_id) AS n, ts, value, event_type, CAST(json_extract(props, '$.k') AS INT) AS k FROM events),
c AS (SELECT *, {_KINDS}[k % {len(Q.RULES)} + 1] AS kind, 'w' || (k // {len(Q.RULES)} % 2) AS w, ts + to_seconds(CAST(round(value * 100) AS BIGINT) * 36) AS until FROM j),
s AS (SELECT DISTINCT run_id, CAST(0 AS BIGINT) AS n, 'queued' AS status, 'planner' AS stage, CAST(NULL AS VARCHAR) AS plan, CAST(NULL AS VARCHAR) AS error, 0 AS retries, CAST(NULL AS VARCHAR) AS worker,
  CAST(NULL AS TIMESTAMP) AS expires, CAST(NULL AS TIMESTAMP) AS changed, 0 AS applied, 0 AS rejected FROM c
UNION ALL SELECT run_id, n,
  CASE WHEN NOT ok THEN status WHEN kind = 'transition' THEN CASE WHEN event_type = 'view' THEN 'queued' ELSE 'running' END WHEN kind IN ('complete', 'finish') THEN 'succeeded' WHEN kind = 'plan' THEN 'waiting_approval'
    WHEN kind IN ('recover', 'approve', 'edit', 'retry') THEN 'queued' WHEN kind IN ('reject', 'cancel') THEN 'cancelled' WHEN kind = 'advance' THEN 'running' WHEN kind = 'fail' THEN 'failed' ELSE status END,
  CASE WHEN NOT ok THEN stage WHEN kind = 'plan' THEN 'approval' WHEN kind IN ('approve', 'edit') THEN 'researcher' WHEN kind IN ('reject', 'cancel', 'finish') THEN 'completed'
    WHEN kind = 'retry' THEN CASE WHEN plan IS NULL THEN 'planner' ELSE 'researcher' END WHEN kind = 'advance' THEN CASE WHEN value > 50 THEN 'verifier' ELSE 'researcher' END ELSE stage END,
  CASE WHEN ok AND kind IN ('plan', 'edit') THEN 'p' || k ELSE plan END,
  CASE WHEN NOT ok OR kind IN ('transition', 'acquire', 'heartbeat', 'release', 'complete', 'recover') THEN error WHEN kind IN ('reject', 'fail') THEN 'note ' || k WHEN kind = 'cancel' THEN 'run cancelled' END,
  retries + CASE WHEN ok AND kind = 'retry' THEN 1 ELSE 0 END,
  CASE WHEN ok AND kind IN ('acquire', 'heartbeat') THEN w WHEN ok AND kind IN ('release', 'complete', 'recover', 'reject', 'cancel', 'fail', 'finish') THEN NULL ELSE worker END,
  CASE WHEN ok AND kind IN ('acquire', 'heartbeat') THEN until WHEN ok AND kind IN ('release', 'complete', 'recover', 'reject', 'cancel', 'fail', 'finish') THEN NULL ELSE expires END,
  CASE WHEN ok THEN ts ELSE changed END, applied + CASE WHEN ok THEN 1 ELSE 0 END, rejected + CASE WHEN ok OR over AND kind = 'cancel' THEN 0 ELSE 1 END
FROM (SELECT *, CASE kind WHEN 'transition' THEN CASE WHEN value > 50 THEN status IN ('queued', 'waiting_approval') ELSE status = 'failed' END WHEN 'acquire' THEN NOT over AND (free OR mine) WHEN 'heartbeat' THEN NOT over AND mine
    WHEN 'release' THEN mine WHEN 'complete' THEN status = 'running' AND mine WHEN 'recover' THEN status = 'running' AND coalesce(expires <= ts, false) WHEN 'plan' THEN status IN ('queued', 'running')
    WHEN 'retry' THEN status = 'failed' AND free WHEN 'advance' THEN status IN ('queued', 'running') WHEN 'finish' THEN status = 'running' WHEN 'cancel' THEN NOT over WHEN 'fail' THEN NOT over
    ELSE status = 'waiting_approval' AND free END AS ok
  FROM (SELECT s.status, s.stage, s.plan, s.error, s.retries, s.worker, s.expires, s.changed, s.applied, s.rejected, c.*, status IN ('succeeded', 'failed', 'cancelled') AS over,
      worker IS NULL OR expires IS NULL OR expires <= ts AS free, coalesce(worker = w, false) AS mine FROM s JOIN c ON c.run_id = s.run_id AND c.n = s.n + 1)))
SELECT run_id, status, stage, plan, error, retries, worker, strftime(expires, '%Y-%m-%d %H:%M:%S') AS expires, strftime(changed, '%Y-%m-%d %H:%M:%S') AS changed, applied, rejected
FROM s QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY n DESC) = 1""",
    "worker_loops": """
WITH p AS (SELECT user_id AS worker, event_id AS ord, CASE WHEN event_type <> 'error' THEN event_id END AS run_id FROM events),
d AS (SELECT *, count(run_id) OVER (PARTITION BY worker ORDER BY ord) AS done FROM p),
m(mode) AS (VALUES ('five'), ('idle'), ('open')),
t AS (SELECT mode, worker, min(ord) AS stop FROM d, m WHERE mode = 'five' AND run_id IS NOT NULL AND done >= 5 OR mode = 'idle' AND run_id IS NULL GROUP BY ALL),
r AS (SELECT m.mode, d.*, t.stop FROM d CROSS JOIN m LEFT JOIN t ON t.mode = m.mode AND t.worker = d.worker WHERE t.stop IS NULL OR d.ord <= t.stop),
l AS (SELECT mode, worker, count(run_id) AS processed, max(ord) FILTER (WHERE run_id IS NOT NULL) AS last_ord, any_value(stop) AS stop FROM r GROUP BY ALL)
SELECT mode, worker, processed, (SELECT count(*) FROM r WHERE r.mode = l.mode AND r.worker = l.worker AND r.run_id IS NULL AND r.ord > coalesce(l.last_ord, -1)) AS idle_polls, last_ord AS last_run_id,
  CASE WHEN stop IS NULL THEN 'interrupted' WHEN mode = 'five' THEN 'max_runs' ELSE 'idle' END AS stopped_reason FROM l""",
    "search_outcomes": """
WITH a AS (SELECT user_id AS query_id, event_id % 3 AS hop, row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY event_id) - 1 AS attempt, event_type = 'purchase' AS ok, CAST(json_extract(props, '$.k') AS INT) % 3 AS n_rows FROM events),
w AS (SELECT query_id, hop, min(attempt) AS first_ok FROM a WHERE ok AND attempt < 3 GROUP BY ALL),
t AS (SELECT a.* FROM a LEFT JOIN w USING (query_id, hop) WHERE attempt < 3 AND (first_ok IS NULL OR attempt <= first_ok)),
v AS (SELECT query_id, min(hop) AS won FROM t WHERE ok AND n_rows > 0 GROUP BY 1),
u AS (SELECT t.*, won FROM t LEFT JOIN v USING (query_id) WHERE won IS NULL OR hop <= won),
g AS (SELECT query_id, any_value(won) AS won, count(DISTINCT hop) AS hops, count(*) AS tries, sum(CASE WHEN attempt > 0 THEN 0.5 * pow(2, attempt - 1) ELSE 0 END)::DOUBLE AS waited FROM u GROUP BY 1)
SELECT policy, query_id, CASE WHEN won IS NOT NULL THEN 'provider' || won WHEN policy = 'mock' THEN 'mock' END AS provider, hops, tries, waited,
  CASE WHEN won IS NULL THEN CASE policy WHEN 'mock' THEN 'fallback_mock' WHEN 'degraded' THEN 'degraded' ELSE 'failed' END WHEN hops > 1 THEN 'fallback' ELSE 'ok' END AS outcome
FROM g, (VALUES ('mock'), ('degraded'), ('fail')) p(policy)""",
    "hybrid_sources": f"""WITH {_VEC}, {_FUSE.replace('coalesce(1.0::DOUBLE / (60 + vector_rank), 0)', 'coalesce(1.5::DOUBLE / (60 + vector_rank), 0)')}
SELECT query_id, doc_id, rank, round(score, 9) AS score, 'hybrid' AS retrieval_mode, CAST(keyword_rank AS VARCHAR) AS keyword_rank, CAST(vector_rank AS VARCHAR) AS vector_rank, '60' AS rrf_k, '1.5' AS vector_weight, CAST(NULL AS VARCHAR) AS retrieval_degraded FROM fused""",
    "degraded_sources": f"""WITH {_VEC} SELECT query_id, doc_id, rank, round(score, 9) AS score, 'keyword' AS retrieval_mode, CAST(rank AS VARCHAR) AS keyword_rank, CAST(NULL AS VARCHAR) AS vector_rank, CAST(NULL AS VARCHAR) AS rrf_k,
  CAST(NULL AS VARCHAR) AS vector_weight, 'true' AS retrieval_degraded FROM lab""",
}
