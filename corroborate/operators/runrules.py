"""Durable runs: one table of rules for what controllers and workers ask of a run, in batch and in streams.

A run's log holds requests (run_id, ord, ts, kind, worker, expected, status, lease_seconds, note, plan, stage), commands and
leases alike. A rule says from which statuses its kind may go, how the run must be leased, and what becomes of the run. A request
that no rule allows changes nothing and is told as refused, so lost races are rows and not exceptions; a cancel after the end
is kept. The table is read in two ways: `step` makes column expressions of it, `after` follows it for one run of a stream.

Cases: a column that a log lacks reads as null; a request with a null kind, or one of no rule, is refused; equal ord are taken in the
order of their other columns; a run's log is gathered, since each request depends on the one before it, so an endless log belongs in the
stream, which holds the state alone; a lease of null seconds never runs out in the log but does not keep others out either.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENDED = ("succeeded", "failed", "cancelled")
OPEN = ("queued", "running", "waiting_approval")
REQUEST = {"kind": "string", "worker": "string", "expected": "array<string>", "status": "string", "lease_seconds": "double", "note": "string", "plan": "string", "stage": "string"}

# marks in a rule; every other text stands for itself
SAME, GIVEN, RESUME, NOTE = "=same", "=given", "=resume", "=note"
EXPECTED, UNENDED, ANY = "=expected", "=unended", "=any"


@dataclass(frozen=True)
class Rule:
    """One kind of request.

    before: statuses, EXPECTED (those that the request names), UNENDED or ANY. lease: any; free (nobody holds a live one); mine (the
    request's worker holds one); open (free or mine); over (it has run out). status, stage: a name, SAME, GIVEN (the request's) or,
    for a stage, RESUME (research if there is a plan, else planning). error: a text, NOTE, SAME or None. hold: keep, take or drop."""

    kind: str
    before: tuple[str, ...] | str
    status: str = SAME
    stage: str = SAME
    lease: str = "any"
    hold: str = "keep"
    error: str | None = SAME
    plan: bool = False
    retry: bool = False


LEASES = (
    Rule("transition", EXPECTED, GIVEN),
    Rule("acquire", UNENDED, lease="open", hold="take"),
    Rule("heartbeat", UNENDED, lease="mine", hold="take"),
    Rule("release", ANY, lease="mine", hold="drop"),
    Rule("complete", ("running",), "succeeded", lease="mine", hold="drop"),
    Rule("recover", ("running",), "queued", lease="over", hold="drop"),
)
COMMANDS = (
    Rule("plan", ("queued", "running"), "waiting_approval", "approval", error=None, plan=True),
    Rule("approve", ("waiting_approval",), "queued", "researcher", "free", error=None),
    Rule("edit", ("waiting_approval",), "queued", "researcher", "free", error=None, plan=True),
    Rule("reject", ("waiting_approval",), "cancelled", "completed", "free", "drop", NOTE),
    Rule("cancel", OPEN, "cancelled", "completed", hold="drop", error="run cancelled"),
    Rule("retry", ("failed",), "queued", RESUME, "free", error=None, retry=True),
    Rule("advance", ("queued", "running"), "running", GIVEN, error=None),
    Rule("fail", OPEN, "failed", hold="drop", error=NOTE),
    Rule("finish", ("running",), "succeeded", "completed", hold="drop", error=None),
)
RULES = LEASES + COMMANDS
RESUMED = ("researcher", "planner")


def state(moment: str) -> str:
    """The columns of a run, with moments of a type."""
    return f"status string, stage string, plan string, error string, retries int, worker string, expires {moment}, changed {moment}, applied int, rejected int"


def _allowed(r: Rule, run: Column, x: Column) -> Column:
    mine = F.coalesce(run["worker"] == x["worker"], F.lit(False))
    over = F.coalesce(run["expires"] <= x["ts"], F.lit(False))
    free = run["worker"].isNull() | run["expires"].isNull() | over
    lease = {"any": F.lit(True), "free": free, "mine": mine, "open": free | mine, "over": over}[r.lease]
    marks = {EXPECTED: F.array_contains(x["expected"], run["status"]), UNENDED: ~run["status"].isin(*ENDED), ANY: F.lit(True)}
    before = marks[r.before] if isinstance(r.before, str) else run["status"].isin(*r.before)
    return (x["kind"] == r.kind) & F.coalesce(before, F.lit(False)) & lease


def step(run: Column, x: Column, rules: tuple[Rule, ...] = RULES, moment: str = "timestamp") -> Column:
    """struct(run, told): the run after a request, told applied, kept or refused."""
    none = F.lit(None).cast("string")

    def made(r: Rule | None, told: str) -> Column:
        r = r or Rule("", ANY)
        stage = {SAME: run["stage"], GIVEN: F.coalesce(x["stage"], run["stage"]), RESUME: F.when(run["plan"].isNotNull(), RESUMED[0]).otherwise(RESUMED[1])}
        error = {SAME: run["error"], NOTE: x["note"], None: none}
        until = x["ts"] + F.make_dt_interval(secs=x["lease_seconds"].cast("decimal(18,6)"))
        fields = {
            "status": {SAME: run["status"], GIVEN: x["status"]}.get(r.status, F.lit(r.status)),
            "stage": stage.get(r.stage, F.lit(r.stage)),
            "plan": F.coalesce(x["plan"], run["plan"]) if r.plan else run["plan"],
            "error": error.get(r.error, F.lit(r.error)),
            "retries": run["retries"] + int(r.retry),
            "worker": {"keep": run["worker"], "take": x["worker"], "drop": none}[r.hold],
            "expires": {"keep": run["expires"], "take": until, "drop": F.lit(None)}[r.hold].cast(moment),
            "changed": x["ts"] if told == "applied" else run["changed"],
            "applied": run["applied"] + int(told == "applied"),
            "rejected": run["rejected"] + int(told == "refused"),
        }
        return F.struct(F.struct(*[c.alias(n) for n, c in fields.items()]).alias("run"), F.lit(told).alias("told"))

    out = F.when((x["kind"] == "cancel") & run["status"].isin(*ENDED), made(None, "kept"))
    for r in rules:
        out = out.when(_allowed(r, run, x), made(r, "applied"))
    return out.otherwise(made(None, "refused"))


def after(run: dict, x: dict, rules: tuple[Rule, ...] = RULES) -> tuple[dict, str]:
    """The same for one run as a dict, with moments (ts, expires, changed) and the lease, lease, as whole microseconds."""
    status, now = run["status"], x["ts"]
    if x["kind"] == "cancel" and status in ENDED:
        return run, "kept"
    mine = run["worker"] is not None and run["worker"] == x.get("worker")
    over = run["expires"] is not None and now is not None and run["expires"] <= now
    free = run["worker"] is None or run["expires"] is None or over
    lease = {"any": True, "free": free, "mine": mine, "open": free or mine, "over": over}
    before = {EXPECTED: status in (x.get("expected") or ()), UNENDED: status not in ENDED, ANY: True}
    for r in rules:
        if r.kind != x["kind"] or not lease[r.lease] or not (before[r.before] if isinstance(r.before, str) else status in r.before):
            continue
        new = dict(run, changed=now, applied=run["applied"] + 1, retries=run["retries"] + r.retry)
        new["status"] = {SAME: status, GIVEN: x.get("status")}.get(r.status, r.status)
        new["stage"] = {SAME: run["stage"], GIVEN: x.get("stage") or run["stage"], RESUME: RESUMED[run["plan"] is None]}.get(r.stage, r.stage)
        new["error"] = {SAME: run["error"], NOTE: x.get("note")}.get(r.error, r.error)
        if r.plan and x.get("plan") is not None:
            new["plan"] = x["plan"]
        if r.hold == "take":
            until = None if now is None or x.get("lease") is None else now + x["lease"]
            new.update(worker=x.get("worker"), expires=until)
        elif r.hold == "drop":
            new.update(worker=None, expires=None)
        return new, "applied"
    return dict(run, rejected=run["rejected"] + 1), "refused"


def completed(requests: DataFrame) -> DataFrame:
    """requests with a null for each column of REQUEST that they lack."""
    return requests.withColumns({c: F.lit(None).cast(t) for c, t in REQUEST.items() if c not in requests.columns})


def folded(requests: DataFrame, rules: tuple[Rule, ...] = RULES, start: str = "queued", told: bool = False) -> DataFrame:
    """Each run after its requests in order of ord: run_id and the columns of state(), and on demand told, what became of each."""
    moment = requests.schema["ts"].dataType.simpleString()
    log = completed(requests).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("ord", "ts", *REQUEST))).alias("log"))
    new = F.from_json(F.lit(f'{{"status":"{start}","stage":"{RESUMED[1]}","retries":0,"applied":0,"rejected":0}}'), state(moment))

    def told_step(acc: Column, x: Column) -> Column:
        # one element, so that the rules are gone through once for both of its parts
        return F.get(F.transform(F.array(step(acc["run"], x, rules, moment)), lambda y: F.struct(y["run"].alias("run"), F.concat(acc["told"], F.array(y["told"])).alias("told"))), F.lit(0))

    if told:
        begin = F.struct(new.alias("run"), F.array().cast("array<string>").alias("told"))
        return log.select("run_id", F.aggregate("log", begin, told_step).alias("s")).select("run_id", "s.run.*", "s.told")
    return log.select("run_id", F.aggregate("log", new, lambda acc, x: step(acc, x, rules, moment)["run"]).alias("s")).select("run_id", "s.*")
