"""Review decisions and jobs as append-only events; the present state is a fold over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def current_states(facts: DataFrame, decisions: DataFrame) -> DataFrame:
    """facts (id, state) after decisions (id, seq, action, actor): verify, reject or correct; the last decision counts.

    A corrected fact is superseded by a new one with the id <id>~<seq>; that one is CORRECTED.
    """
    last = decisions.groupBy("id").agg(F.max_by(F.struct("action", "seq", "actor"), "seq").alias("d"))
    state = F.when(F.col("d.action") == "verify", "HUMAN_VERIFIED").when(F.col("d.action") == "reject", "REJECTED").when(F.col("d.action") == "correct", "CORRECTED").otherwise(F.col("state"))
    out = facts.join(last, "id", "left")
    new_id = F.when(F.col("d.action") == "correct", F.concat_ws("~", "id", F.col("d.seq").cast("string")))
    return out.select("id", state.alias("state"), new_id.alias("superseded_by"), F.when(F.col("d").isNotNull(), "TRUSTED").otherwise("CANDIDATE").alias("trust"))


def remembered(known: DataFrame, new: DataFrame) -> DataFrame:
    """Merge decisions (pair_key, decision, decided_by): new ones replace known ones, but never a human's."""
    both = known.select("pair_key", F.struct("decision", "decided_by").alias("k")).join(new.select("pair_key", F.struct("decision", "decided_by").alias("n")), "pair_key", "full_outer")
    kept = F.when(F.col("k.decided_by") == "HUMAN", F.col("k")).otherwise(F.coalesce("n", "k"))
    return both.select("pair_key", kept.alias("x")).select("pair_key", "x.*")


def job_states(events: DataFrame, max_attempts: int = 3) -> DataFrame:
    """events (job, seq, kind: enqueued, claimed, failed, succeeded, cancelled) folded to job, attempts, state and retry delay in seconds.

    A failed job waits min(5 * 2^(n-1), 300) seconds for its next attempt, until its attempts are used up.
    """
    folded = events.groupBy("job").agg(F.count(F.when(F.col("kind") == "claimed", 1)).alias("attempts"), F.count(F.when(F.col("kind") == "failed", 1)).alias("failures"), F.max_by("kind", "seq").alias("last"))
    state = (
        F.when(F.col("last") == "claimed", "RUNNING").when(F.col("last") == "succeeded", "SUCCEEDED").when(F.col("last") == "cancelled", "CANCELLED")
        .when((F.col("last") == "failed") & (F.col("failures") >= max_attempts), "FAILED").otherwise("PENDING")
    )
    delay = F.when((state == "PENDING") & (F.col("failures") > 0), F.least(F.lit(5) * F.pow(F.lit(2), F.col("failures") - 1), F.lit(300)).cast("long"))
    return folded.select("job", "attempts", state.alias("state"), delay.alias("delay"))


def job_chains(jobs: DataFrame, steps: int = 5) -> DataFrame:
    """jobs (id, next): per first job the ids of its chain."""
    firsts = jobs.join(jobs.where("next is not null").select(F.col("next").alias("id")), "id", "left_anti")
    out = firsts.select("id", F.array("id").alias("chain"), "next")
    for _ in range(steps - 1):
        later = jobs.select(F.col("id").alias("next"), F.col("next").alias("further"))
        out = out.join(later, "next", "left").select("id", F.when(F.col("next").isNotNull(), F.concat("chain", F.array("next"))).otherwise(F.col("chain")).alias("chain"), F.col("further").alias("next"))
    return out.select("id", F.array_join("chain", ">").alias("chain"))


#: Fixed value: the kind of job that follows a finished one, and the prefix of its key.
NEXT_STAGE = {
    "DOCUMENT_INGESTION": ("EMBEDDING", "embedding"), "EMBEDDING": ("GRAPH_EXTRACTION", "extraction"), "GRAPH_EXTRACTION": ("ENTITY_RESOLUTION", "resolution"), "ENTITY_RESOLUTION": ("GRAPH_BUILD", "graph-build"),
}


def claimed(jobs: DataFrame, workers: DataFrame, now: Column, most: int = 1000) -> DataFrame:
    """One round of claiming: the oldest runnable jobs (id, state, run_after, created_at, attempts) go to the workers (worker), one each in the order of their names.

    Runnable are pending jobs whose run_after is null or has come.  A round deals with at most ``most`` jobs; the rest wait for the next.
    """
    oldest = jobs.where((F.col("state") == "PENDING") & (F.col("run_after").isNull() | (F.col("run_after") <= now))).orderBy("created_at", "id").limit(most)
    turn = lambda rows, order: rows.withColumn("turn", F.expr(f"row_number() over (order by {order})"))
    free = turn(workers.select("worker").distinct().orderBy("worker").limit(most), "worker")
    return turn(oldest, "created_at, id").join(free, "turn").select("id", "worker", F.lit("RUNNING").alias("state"), (F.col("attempts") + 1).alias("attempts"), now.alias("locked_at"))


def cancelled(jobs: DataFrame, requests: DataFrame, at_checkpoint: DataFrame) -> DataFrame:
    """jobs (id, state) after requests (id) to cancel: a pending job is cancelled, a running one flagged, and cancelled once it is at a checkpoint (id)."""
    asked = jobs.join(requests.select("id").distinct().withColumn("asked", F.lit(True)), "id", "left").join(at_checkpoint.select("id").distinct().withColumn("stops", F.lit(True)), "id", "left")
    hit = F.coalesce("asked", F.lit(False)) & F.col("state").isin("PENDING", "RUNNING")
    ends = hit & ((F.col("state") == "PENDING") | F.coalesce("stops", F.lit(False)))
    return asked.select("id", F.when(ends, "CANCELLED").otherwise(F.col("state")).alias("state"), (hit & ~ends).alias("cancel_requested"))


def next_jobs(finished: DataFrame, known: DataFrame) -> DataFrame:
    """finished (kind, project, version): the jobs that follow (kind, idempotency_key), once per key and not those whose key is known (idempotency_key)."""
    table = F.create_map(*(F.lit(x) for k, (kind, prefix) in NEXT_STAGE.items() for x in (k, f"{kind}|{prefix}")))
    rows = finished.withColumn("next", F.split(table[F.col("kind")], r"\|")).where("next is not null")
    key = F.concat_ws(":", F.col("next")[1], "project", F.coalesce(F.col("version").cast("string"), F.lit("all")))
    return rows.select(F.col("next")[0].alias("kind"), key.alias("idempotency_key")).distinct().join(known.select("idempotency_key"), "idempotency_key", "left_anti").select("kind", "idempotency_key")
