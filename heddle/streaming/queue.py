"""A durable job queue as keyed state over a stream of requests, with event-time timers for leases and retries.

A job's state is a fold over its requests in the order of their times.  What falls due between two requests, the end of a lease or of a wait, happens at its own time: ahead of
the next request where one comes, else by a timer once the watermark has passed it.  So the stream's final states are those of ``folded`` over the same requests in one batch.

The stream needs a RocksDB state store: set ``spark.sql.streaming.stateStore.providerClass`` to STATE_STORE.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Fixed values.
MAX_ATTEMPTS, LEASE_S, FIRST_WAIT_S, LONGEST_WAIT_S = 3, 600, 5, 300
ENDED = ("SUCCEEDED", "FAILED", "CANCELLED")
REQUESTS = "job string, at timestamp, kind string"
TRANSITIONS = "job string, at_ms long, state string, attempts int, cancel_requested boolean, reason string"
_STATE = "state string, attempts int, cancel_requested boolean, due long"


@dataclass
class Job:
    """due: when the lease ends (RUNNING) or the wait before the next attempt (PENDING), in ms; 0 for never."""

    state: str = ""
    attempts: int = 0
    cancel_requested: bool = False
    due: int = 0

    def elapse(self, now: int) -> list[tuple[int, str]]:
        """What has fallen due by now: (when, reason)."""
        if not self.due or self.due > now:
            return []
        at, self.due = self.due, 0
        if self.state == "PENDING":
            return [(at, "runnable again")]
        self.state = "FAILED" if self.attempts >= MAX_ATTEMPTS else "PENDING"
        return [(at, "lease expired")]

    def take(self, kind: str, now: int) -> list[tuple[int, str]]:
        """One request; those that don't fit the state change nothing: a job is enqueued once while it waits or runs, and claimed only when it may run."""
        if kind == "enqueue" and (not self.state or self.state in ENDED):
            self.state, self.attempts, self.cancel_requested, self.due = "PENDING", 0, False, 0
        elif kind == "claim" and self.state == "PENDING" and not self.due:
            self.state, self.attempts, self.due = "RUNNING", self.attempts + 1, now + LEASE_S * 1000
        elif kind == "succeed" and self.state == "RUNNING":
            self.state, self.due = "SUCCEEDED", 0
        elif kind == "fail" and self.state == "RUNNING":
            ends = self.attempts >= MAX_ATTEMPTS
            wait = min(FIRST_WAIT_S * 2 ** (self.attempts - 1), LONGEST_WAIT_S) * 1000
            self.state, self.due = ("FAILED", 0) if ends else ("PENDING", now + wait)
        elif kind == "cancel" and self.state == "PENDING":
            self.state, self.due = "CANCELLED", 0
        elif kind == "cancel" and self.state == "RUNNING" and not self.cancel_requested:
            self.cancel_requested = True
        elif kind == "checkpoint" and self.state == "RUNNING" and self.cancel_requested:
            self.state, self.due = "CANCELLED", 0
        else:
            return []
        return [(now, kind)]


def _milliseconds(at) -> int:
    return int(pd.Timestamp(at).timestamp() * 1000)


class Queue(StatefulProcessor):
    """Per job its state and one timer, for what falls due next; each transition is a row."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("job", _STATE)

    def _load(self) -> Job:
        found = self.kept.get() if self.kept.exists() else None
        return Job(*found) if found else Job()

    def _save(self, job: Job) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if job.due:
            self.handle.registerTimer(job.due)
        self.kept.update(tuple(asdict(job).values()))

    @staticmethod
    def _rows(key: tuple, job: Job, happened: list[tuple[int, str]]) -> Iterator[Row]:
        for at, reason in happened:
            yield Row(job=key[0], at_ms=at, state=job.state, attempts=job.attempts, cancel_requested=job.cancel_requested, reason=reason)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        job = self._load()
        for now, kind in sorted((_milliseconds(r["at"]), r["kind"]) for r in rows):
            yield from self._rows(key, job, job.elapse(now))
            yield from self._rows(key, job, job.take(kind, now))
        self._save(job)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        job = self._load()
        yield from self._rows(key, job, job.elapse(expiredTimerInfo.getExpiryTimeInMs()))
        self._save(job)

    def close(self) -> None:
        pass


def transitions(requests: DataFrame, late: str = "1 minute") -> DataFrame:
    """A stream of requests (job, at, kind: enqueue, claim, succeed, fail, cancel, checkpoint) to the transitions that they and the timers bring; requests later than ``late`` are dropped."""
    return requests.withWatermark("at", late).groupBy("job").transformWithState(Queue(), TRANSITIONS, "Update", "EventTime")


def folded(requests: DataFrame, until_ms: int) -> DataFrame:
    """The same transitions over requests of one batch, with all that falls due until then.  A job's requests are one task's work."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        job, out = Job(), []
        for now, kind in sorted(zip(part["at"].map(_milliseconds), part["kind"], strict=True)):
            out += Queue._rows(key, job, job.elapse(now))
            out += Queue._rows(key, job, job.take(kind, now))
        out += Queue._rows(key, job, job.elapse(until_ms))
        return pd.DataFrame([r.asDict() for r in out], columns=["job", "at_ms", "state", "attempts", "cancel_requested", "reason"])

    return requests.groupBy("job").applyInPandas(run, TRANSITIONS)


def latest(rows: DataFrame) -> DataFrame:
    """job, state, attempts and cancel_requested after the last of each job's transitions; of those of one moment the one of most attempts, then the furthest state."""
    furthest = F.array_position(F.array(*map(F.lit, ("PENDING", "RUNNING", *ENDED))), F.col("state"))
    last = F.max_by(F.struct("state", "attempts", "cancel_requested"), F.struct("at_ms", "attempts", furthest.alias("s"), "cancel_requested"))
    return rows.groupBy("job").agg(last.alias("x")).select("job", "x.*")
