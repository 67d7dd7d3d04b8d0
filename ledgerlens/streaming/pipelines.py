"""The same rules over streams, and a driver that applies a log as it arrives.

Folds keep their state in the state store (``streaming_fold``); the state machine,
which needs answers by client before values by key, is applied batch by batch with
snapshots as its state. Both go on after a restart where they had stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import health, recurrences
from ..operators.fold import streaming_fold
from ..sinks import snapshots
from ..sources.fixtures import fixture
from ..sources.storage import exists, new_folder

Stream = Callable[[DataFrame], DataFrame]


def exactly_once(log: DataFrame) -> DataFrame:
    """Where each command's pair was first seen, with one state a client: its requests
    so far. Untracked commands are their own first."""

    def step(first, row):
        client, idx, request = row
        at = first.setdefault(request, idx) if client and request else idx
        return first, (idx, at, idx != at)

    return streaming_fold(log.select("client_id", "idx", "request_id"), ["client_id"], ["idx"], dict, step, "idx long, first_idx long, duplicate boolean")


def cooldown(attempts: DataFrame, seconds: int) -> DataFrame:
    named = attempts.select("event_id", "t", F.when(F.coalesce(F.trim("ip"), F.lit("")) == "", "unknown").otherwise(F.col("ip")).alias("ip"))
    return streaming_fold(named, ["ip"], ["t", "event_id"], lambda: None, recurrences.cooldown_step(seconds), "event_id long, ip string, accepted boolean")


def aimd(ticks: DataFrame, start: float, least: float, most: float) -> DataFrame:
    return streaming_fold(ticks.select("part", "tick", "ok", "fail"), ["part"], ["tick"], lambda: start, recurrences.aimd_step(least, most), "part long, tick long, rate double")


def batches(items: DataFrame, span: int, most: int | None) -> DataFrame:
    """items(part, idx, t): (part, idx, batch), as ``recurrences.batches``."""

    def step(state, row):
        part, idx, t = row
        first, n, name = state
        if first is None or t - first > span or most and n >= most:
            first, n, name = t, 0, idx
        return (first, n + 1, name), (part, idx, name)

    return streaming_fold(items.select("part", "idx", "t"), ["part"], ["idx"], lambda: (None, 0, 0), step, "part long, idx long, batch long")


def audit_step(stall_after: int):
    """The observer's memory and the events of one look at a cluster."""

    def step(state, row):
        cluster, tick, quorum, leader, commit, stepdowns, readable = row
        if state is None:
            return (quorum, leader, commit, tick, False, stepdowns if readable else None), (cluster, tick, ["0|controlplane_started"])
        was_quorum, was_leader, was_commit, since, stalled, known = state
        events = []
        if quorum != was_quorum:
            events.append("1|quorum_regained" if quorum else "1|quorum_lost")
        if leader and leader != was_leader:
            events.append("2|leader_changed")
        if commit != was_commit:
            if stalled:
                events.append("3|progress_resumed")
            since, stalled = tick, False
        elif quorum and leader and not stalled and tick - since >= stall_after:
            events.append("3|progress_stalled")
            stalled = True
        if readable:
            if known is not None and stepdowns > known:
                events.append("4|watchdog_stepdown")
            known = stepdowns
        return (quorum, leader, commit, since, stalled, known), (cluster, tick, events)

    return step


def audit(observed: DataFrame, stall_after: int) -> DataFrame:
    """observed(cluster, tick, quorum, leader_id, max_commit, stepdowns, readable):
    (cluster, tick, ord, event) as looks come in."""
    rows = observed.select("cluster", "tick", "quorum", "leader_id", "max_commit", "stepdowns", "readable")
    found = streaming_fold(rows, ["cluster"], ["tick"], lambda: None, audit_step(stall_after), "cluster long, tick long, events array<string>")
    each = found.select("cluster", "tick", F.explode("events").alias("e"))
    return each.select("cluster", "tick", F.split_part("e", F.lit("|"), F.lit(1)).cast("int").alias("ord"), F.split_part("e", F.lit("|"), F.lit(2)).alias("event"))


def arrivals(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """events(ts, instance): (start, instance, per_sec), emitted once no more than
    ``late`` rows can come for a window. The time must be a timestamp with zone."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counts = timed.groupBy(F.window("ts", window).alias("w"), "instance").count()
    return counts.select(F.col("w.start").alias("start"), "instance", (F.col("count") / (F.unix_timestamp("w.end") - F.unix_timestamp("w.start"))).alias("per_sec"))


def apply_log(stream: DataFrame, path: str, checkpoint: str):
    """A writer that applies commands as they arrive: answers by micro-batch under
    path/answers, the state as snapshots under path/state. A batch that is repeated
    after a failure finds its answers written, or writes them again from the same
    state."""
    spark = stream.sparkSession

    def run(batch: DataFrame, number: int) -> None:
        own = f"{path}/answers/batch={number}"
        base = snapshots.load(spark, f"{path}/state")
        last = batch.agg(F.max("idx")).first()[0]
        if last is None or last <= base.idx and exists(spark, f"{own}/_SUCCESS"):
            return
        if batch.agg(F.min("idx")).first()[0] <= base.idx:
            raise ValueError(f"commands up to {base.idx} were applied before batch {number}")
        snapshots.replay(base, batch).write.mode("overwrite").parquet(own)
        snapshots.save(base, batch, f"{path}/state", last)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def run_to_end(source: DataFrame, order: str, parts: int, stream: Stream, path: str) -> DataFrame:
    """Writes the source as ``parts`` ordered files, and streams them in two runs with
    a restart between; the rows that came out."""
    spark = source.sparkSession
    source = source.cache()
    ends = source.agg(F.min(order).alias("a"), F.max(order).alias("b")).first()
    for i in range(parts):
        low, high = (ends["a"] + (ends["b"] + 1 - ends["a"]) * k // parts for k in (i, i + 1))
        source.where((F.col(order) >= low) & (F.col(order) < high)).write.parquet(f"{path}/in/{i}")
        files = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1000).option("recursiveFileLookup", "true").parquet(f"{path}/in")
        made = stream(files)
        query = made.start() if not isinstance(made, DataFrame) else made.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    source.unpersist()
    return spark.read.parquet(f"{path}/answers" if exists(spark, f"{path}/answers") else f"{path}/out")


def _query(table: str, order: str, stream: Stream) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run_to_end(fixture(spark, sf_dir, table), order, 2, stream, new_folder(spark, "stream"))


def _apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "stream")
    return run_to_end(fixture(spark, sf_dir, "kv_log"), "idx", 2, lambda s: apply_log(s, path, f"{path}/checkpoint"), path).drop("batch")


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    looks = health.cluster_rollup(health.seen(fixture(spark, sf_dir, "node_status_ticks")))
    looks = looks.select(F.lit(0).cast("long").alias("cluster"), "tick", "quorum", "leader_id", "max_commit", F.floor(F.col("tick") / 50).alias("stepdowns"), (F.col("tick") % 7 != 0).alias("readable"))
    return run_to_end(looks, "tick", 2, lambda s: audit(s, 6), new_folder(spark, "stream")).drop("cluster")


QUERIES = {
    "exactly_once": _query("kv_log", "idx", exactly_once),
    "cooldown": _query("disrupt_attempts", "event_id", lambda s: cooldown(s, 6 * 3600)),
    "aimd": _query("load_ticks", "tick", lambda s: aimd(s.withColumn("part", F.lit(0).cast("long")), 1000.0, 100.0, 2000.0).drop("part")),
    "batches": _query("kv_log", "idx", lambda s: batches(s.where("op IN (2, 3, 4)").withColumn("part", F.col("node_id")), 1800, 8).drop("part")),
    "apply": _apply,
    "audit": _audit,
}
