"""Streams: the run log folded with a timer for leases, an event tail, and windows over events."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Y
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo

from corroborate.operators import runrules as Q

RUN = "run_id string, status string, stage string, worker string, expires_ms long, applied int, rejected int, stale boolean"
STATE = Q.state("long")
FIELDS = [f.split()[0] for f in STATE.split(", ")]
ORDER = ("ord", "ts", *Q.REQUEST)
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def tail(spark: SparkSession, folder: str, schema: str, per_trigger: int | None = None) -> DataFrame:
    """New JSON event files of a folder as a stream; the checkpoint's offsets are the cursor."""
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", per_trigger) if per_trigger else r).json(folder)


def windows(events: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """An extension: counts and sums by type in tumbling windows, with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """An extension: sessions of a user."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


class RunStates(StatefulProcessor):
    """One run's state, and a timer at the end of its lease: when the watermark passes it, a running run goes back to the queue by the rule of `recover`."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", STATE)

    def _held(self) -> dict:
        if not self.run.exists():
            return dict.fromkeys(FIELDS) | {"status": "queued", "stage": "planner", "retries": 0, "applied": 0, "rejected": 0}
        return dict(zip(FIELDS, self.run.get(), strict=True))

    def _keep(self, key: tuple, run: dict, stale: bool) -> Row:
        self.run.update(tuple(run[f] for f in FIELDS))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if run["status"] == "running" and run["expires"] is not None:
            self.handle.registerTimer(_millis(run["expires"]))
        return Row(run_id=key[0], status=run["status"], stage=run["stage"], worker=run["worker"], expires_ms=_millis(run["expires"]), applied=run["applied"], rejected=run["rejected"], stale=stale)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        run = self._held()
        # as in batch: by ord, and equal ones by their other columns, nulls first
        for x in sorted((r.asDict() for r in rows), key=lambda r: [(r[c] is not None, r[c]) for c in ORDER]):
            run, _ = Q.after(run, x)
        yield self._keep(key, run, False)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        run, now = self._held(), 1000 * expiredTimerInfo.getExpiryTimeInMs()
        run, told = Q.after(run, {"kind": "recover", "ts": now})
        if told == "applied":
            yield self._keep(key, run, True)

    def close(self) -> None:
        pass


def _millis(micros: int | None) -> int | None:
    """The first millisecond that is not before a moment."""
    return None if micros is None else -(-micros // 1000)


def run_states(requests: DataFrame, late: str = "10 seconds") -> DataFrame:
    """X1-X5 as a stream: requests, commands and leases alike, to the states of their runs; a lease that the watermark passes puts a running run back in the queue.

    expected may be a string of names with commas between them. Requests of a run are taken in order of ord within a micro-batch; those
    older than the watermark are dropped by Spark. The session is set to the RocksDB state store, which timers and value states need."""
    requests.sparkSession.conf.set(STORE, ROCKS)
    r = Q.completed(requests.withWatermark("ts", late))
    if r.schema["expected"].dataType == Y.StringType():
        r = r.withColumn("expected", F.split("expected", ","))
    lease = (F.col("lease_seconds").cast("decimal(18,6)") * 1_000_000).cast("long")
    r = r.withColumn("at", F.col("ts")).select("run_id", "ord", F.unix_micros("at").alias("ts"), *Q.REQUEST, lease.alias("lease"), F.col("ts").alias("event_time"))
    return r.groupBy("run_id").transformWithState(RunStates(), RUN, "update", "EventTime")
