"""One table of rules: leases against commands, and the batch fold against the stream on random logs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from corroborate.operators import control as C
from corroborate.operators import runrules as Q
from corroborate.streaming import runs as S

T0 = dt.datetime(2024, 1, 1)
COLS = "run_id string, ord int, ts timestamp, kind string, worker string, expected array<string>, status string, lease_seconds double, note string, plan string, stage string"


def row(run, k, kind, worker=None, minutes=0, lease=None, **more):
    x = dict(run_id=run, ord=k, ts=T0 + dt.timedelta(minutes=minutes), kind=kind, worker=worker, expected=None, status=None, lease_seconds=lease, note=None, plan=None, stage=None) | more
    return tuple(x.values())


def random_logs(seed, runs=40, size=30):
    r = random.Random(seed)
    kinds = [x.kind for x in Q.RULES] + ["bogus", None]
    out = []
    for run in range(runs):
        t = 0
        for k in range(size):
            t += r.randrange(0, 20)
            out.append(row(f"r{run}", k, r.choice(kinds), r.choice(["w1", "w2", None]), t, r.choice([60.0, 1200.5, None]), expected=r.choice([None, ["queued"], ["failed", "running"]]), status=r.choice(["running", "queued"]), note=r.choice([None, "n"]), plan=r.choice([None, f"p{k}"]), stage=r.choice([None, "verifier"])))
    return out


def test_commands_meet_the_leases_of_the_same_log(spark):
    rows = [
        *[row("live", k, kind, w, m, s) for k, (kind, w, m, s) in enumerate([("acquire", "w1", 0, 600.0), ("plan", None, 1, None), ("approve", None, 2, None), ("edit", None, 3, None), ("reject", None, 4, None), ("release", "w2", 5, None)])],
        *[row("over", k, kind, w, m, s) for k, (kind, w, m, s) in enumerate([("acquire", "w1", 0, 60.0), ("plan", None, 1, None), ("approve", None, 2, None)])],
        *[row("freed", k, kind, w, m, s) for k, (kind, w, m, s) in enumerate([("acquire", "w1", 0, 600.0), ("plan", None, 1, None), ("approve", None, 2, None), ("release", "w1", 3, None), ("approve", None, 4, None)])],
        *[row("ended", k, kind, w, m, s) for k, (kind, w, m, s) in enumerate([("acquire", "w1", 0, 600.0), ("cancel", None, 1, None), ("acquire", "w2", 2, 60.0), ("cancel", None, 3, None)])],
    ]
    df = spark.createDataFrame(rows, COLS)
    got = {r.run_id: (r.status, r.told) for r in C.controlled(df.withColumnRenamed("kind", "command")).collect()}
    assert got == {
        "live": ("waiting_approval", ["applied", "applied", "refused", "refused", "refused", "refused"]),
        "over": ("queued", ["applied", "applied", "applied"]),
        "freed": ("queued", ["applied", "applied", "refused", "applied", "applied"]),
        "ended": ("cancelled", ["applied", "applied", "refused", "kept"]),
    }
    assert {r.run_id: r.worker for r in Q.folded(df).collect()} == {"live": "w1", "over": "w1", "freed": None, "ended": None}


def plain(rows):
    """The states of random logs by the rules as the stream reads them."""
    out, us = {}, lambda t: round((t - T0).total_seconds() * 1e6)
    for x in sorted(rows, key=lambda r: (r[0], r[1])):
        d = dict(zip([c.split()[0] for c in COLS.split(", ")], x, strict=True))
        d |= {"ts": us(d["ts"]), "lease": None if d["lease_seconds"] is None else round(d["lease_seconds"] * 1e6)}
        run = out.get(d["run_id"], dict.fromkeys(S.FIELDS) | {"status": "queued", "stage": "planner", "retries": 0, "applied": 0, "rejected": 0})
        out[d["run_id"]] = Q.after(run, d)[0]
    return out


@pytest.mark.parametrize("moment", ["timestamp", "timestamp_ntz"])
def test_columns_and_rows_read_the_table_alike(spark, moment):
    rows = random_logs(7)
    got = Q.folded(spark.createDataFrame(rows, COLS).withColumn("ts", F.col("ts").cast(moment)))
    want = plain(rows)
    names = [f for f in S.FIELDS if f not in ("expires", "changed")]
    held = {r.run_id: r for r in got.collect()}
    assert held.keys() == want.keys() and len({r.status for r in held.values()}) > 3
    for run, w in want.items():
        assert {n: held[run][n] for n in names} == {n: w[n] for n in names}, run
        for n in ("expires", "changed"):
            t = held[run][n]
            assert w[n] == (None if t is None else round((t - T0).total_seconds() * 1e6)), (run, n)


def test_the_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    """A log in three files, each its own micro-batch of its own start of the query: the last states are those of the batch fold."""
    rows = [r for r in random_logs(3, 12, 24) if r[3] != "transition"]
    cols = COLS.replace("expected array<string>", "expected string")
    df = spark.createDataFrame(rows, COLS)
    last = {}
    for part in range(3):
        cut = df.filter(f"ord >= {8 * part} and ord < {8 * part + 8}").withColumn("expected", F.array_join("expected", ","))
        cut.coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        q = S.run_states(spark.readStream.schema(cols).json(str(tmp_path / "in")), "3650 days").writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c"))
        seen = []
        q = q.foreachBatch(lambda b, _, seen=seen: seen.extend(b.collect())).trigger(availableNow=True).start()
        q.awaitTermination(120)
        last |= {r.run_id: r for r in seen if not r.stale}
    want = plain(rows)
    assert {k: (r.status, r.stage, r.worker, r.applied, r.rejected) for k, r in last.items()} == {k: (w["status"], w["stage"], w["worker"], w["applied"], w["rejected"]) for k, w in want.items()}


def test_a_lease_that_the_watermark_passes_frees_its_run(spark, tmp_path):
    rows = [row("a", 0, "acquire", "w1", 0, 60.0), row("a", 1, "advance", None, 0), row("b", 0, "plan", None, 600)]
    spark.createDataFrame(rows, COLS).write.json(str(tmp_path / "in"))
    seen = []
    q = S.run_states(spark.readStream.schema(COLS).json(str(tmp_path / "in"))).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c"))
    q = q.foreachBatch(lambda b, _: seen.extend(b.collect())).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.status, r.worker) for r in seen if r.run_id == "a" and not r.stale] == [("running", "w1")]
    assert [(r.status, r.worker) for r in seen if r.run_id == "a" and r.stale] == [("queued", None)]


def test_empty_log(spark):
    assert Q.folded(spark.createDataFrame([], COLS)).count() == 0
