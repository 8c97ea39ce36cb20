"""The stateful queue: a stream in several micro-batches against one batch, and each rule by hand."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest

from heddle.streaming import queue

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(seconds: float) -> datetime:
    return START + timedelta(seconds=seconds)


@pytest.fixture
def state_store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, queue.STATE_STORE)
    yield
    spark.conf.set(name, before)


def streamed(spark, tmp_path, batches: list[list[tuple]]):
    """The transitions of a stream that reads one file per micro-batch."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, queue.REQUESTS).coalesce(1).write.parquet(f"{tmp_path}/in/batch={k}")
    source = spark.readStream.schema(queue.REQUESTS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in")
    name = f"queue_{random.randrange(1 << 30)}"
    run = queue.transitions(source).writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination(240)
    assert run.exception() is None
    return spark.table(name)


def states(rows):
    return {r["job"]: (r["state"], r["attempts"], r["cancel_requested"]) for r in queue.latest(rows).collect()}


def test_stream_equals_batch(spark, tmp_path, state_store):
    """A late lease, retries and a cancellation, over three micro-batches; the last only moves the watermark."""
    first = [("lease", at(0), "enqueue"), ("lease", at(1), "claim"), ("retry", at(0), "enqueue"), ("retry", at(2), "claim"), ("retry", at(3), "fail"), ("stop", at(0), "enqueue"), ("stop", at(5), "claim"), ("stop", at(6), "cancel"), ("wait", at(1), "enqueue")]
    second = [("retry", at(5), "claim"), ("retry", at(9), "claim"), ("retry", at(11), "succeed"), ("stop", at(30), "checkpoint"), ("wait", at(40), "cancel"), ("wait", at(41), "cancel"), ("other", at(50), "enqueue"), ("other", at(51), "enqueue")]
    third = [("clock", at(3000), "enqueue")]
    want = {"lease": ("PENDING", 1, False), "retry": ("SUCCEEDED", 2, False), "stop": ("CANCELLED", 1, True), "wait": ("CANCELLED", 0, False), "other": ("PENDING", 0, False), "clock": ("PENDING", 0, False)}
    rows = streamed(spark, tmp_path, [first, second, third])
    assert states(rows) == want
    batch = queue.folded(spark.createDataFrame([*first, *second, *third], queue.REQUESTS), int(at(3000).timestamp() * 1000) - 60_000)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(rows) == key(batch)
    assert ("lease", int(at(601).timestamp() * 1000), "lease expired") in {(r["job"], r["at_ms"], r["reason"]) for r in rows.collect()}


def test_rules_by_hand():
    run = lambda *kinds: (lambda job: ([job.take(k, t * 1000) for t, k in kinds], job)[1])(queue.Job())
    assert run((0, "claim")).state == "" and run((0, "enqueue"), (1, "succeed")).state == "PENDING"
    assert run((0, "enqueue"), (1, "claim"), (2, "enqueue")).state == "RUNNING"  # once while it runs
    again = run((0, "enqueue"), (1, "claim"), (2, "succeed"), (3, "enqueue"))
    assert (again.state, again.attempts) == ("PENDING", 0)
    waiting = run((0, "enqueue"), (1, "claim"), (2, "fail"), (3, "claim"))
    assert (waiting.state, waiting.due) == ("PENDING", 7000)  # five seconds at first
    assert waiting.elapse(6999) == [] and waiting.elapse(7000) == [(7000, "runnable again")]
    waiting.take("claim", 8000)
    waiting.take("fail", 9000)
    assert waiting.due == 19_000  # then ten
    waiting.elapse(19_000)
    waiting.take("claim", 20_000)
    waiting.take("fail", 21_000)
    assert (waiting.state, waiting.due) == ("FAILED", 0)
    lost = run((0, "enqueue"), (1, "claim"))
    lost.attempts = queue.MAX_ATTEMPTS
    assert lost.elapse(601_000) == [(601_000, "lease expired")] and lost.state == "FAILED"
    assert run((0, "enqueue"), (1, "claim"), (2, "checkpoint")).state == "RUNNING"
