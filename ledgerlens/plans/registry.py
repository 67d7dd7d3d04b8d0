"""Every registered query on the event log: an operator on its input tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import role_code
from ..operators import control, elections, health, kv, recurrences, replog, telemetry
from ..sinks import audit_log, snapshots
from ..sources import binary
from ..sources.fixtures import fixture, with_fixtures
from ..sources.storage import new_folder
from ..streaming import pipelines
from .oracles import ORACLES

Query = Callable[[SparkSession, str], DataFrame]
LEADER, NODES, HOUR = 1, 7, 3600.0


def on(operator: Callable[..., DataFrame], *tables: str, **options) -> Query:
    """The operator on whole fixture tables."""
    return lambda spark, sf_dir: operator(*(fixture(spark, sf_dir, t) for t in tables), **options)


def log_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replog.recover(fixture(spark, sf_dir, "raft_wal"), fixture(spark, sf_dir, "compactions"))


def on_log(operator: Callable[..., DataFrame], *tables: str, **options) -> Query:
    """The operator on the recovered logs and further tables."""
    return lambda spark, sf_dir: operator(log_of(spark, sf_dir), *(fixture(spark, sf_dir, t) for t in tables), **options)


def seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.seen(fixture(spark, sf_dir, "node_status_ticks"))


def on_nodes(operator: Callable[..., DataFrame], **options) -> Query:
    return lambda spark, sf_dir: operator(seen(spark, sf_dir), **options)


def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.cluster_rollup(seen(spark, sf_dir))


# the command log


def kv_get(spark, sf_dir):
    log = fixture(spark, sf_dir, "kv_log")
    return kv.get(log, log.select(F.col("k").alias("key")).distinct().union(spark.createDataFrame([("k/none",)], "key string")))


def kv_get_as_of(spark, sf_dir):
    """Each get of the log as a read at its own index."""
    log = fixture(spark, sf_dir, "kv_log")
    return kv.get_as_of(log, log.where(F.col("op") == kv.GET).select(F.col("idx").alias("read"), F.col("k").alias("key"), F.col("idx").alias("at")))


def kv_read_checkpoint(spark, sf_dir):
    log = fixture(spark, sf_dir, "kv_log")
    return kv.read_checkpoint(log, log.select("client_id").distinct().union(spark.createDataFrame([("nobody",)], "client_id string")))


def kv_snapshot(spark, sf_dir):
    """The whole log's state, written and read again."""
    log, path = fixture(spark, sf_dir, "kv_log"), new_folder(spark, "snapshot")
    snapshots.save(snapshots.empty(spark), log, path, log.agg(F.max("idx")).first()[0] or 0)
    return snapshots.rows(snapshots.load(spark, path))


def _half(spark, sf_dir):
    """The log, and a snapshot that was taken half way through it."""
    log, path = fixture(spark, sf_dir, "kv_log"), new_folder(spark, "snapshot")
    snapshots.save(snapshots.empty(spark), log, path, (log.agg(F.max("idx")).first()[0] or 0) // 2)
    return snapshots.load(spark, path), log


def kv_recover(spark, sf_dir):
    return snapshots.recover(*_half(spark, sf_dir))


def kv_replay(spark, sf_dir):
    """Answers of the commands behind the snapshot, which knows of earlier ones."""
    return snapshots.replay(*_half(spark, sf_dir))


def wait_applied(spark, sf_dir):
    reads = fixture(spark, sf_dir, "read_requests").select(F.col("request").alias("read"), F.col("pos").alias("at"), (F.col("t") * 1000).alias("asked_ms"))
    return kv.wait_applied(reads, fixture(spark, sf_dir, "applies"), 3600 * 1000)


def _items(spark, sf_dir, *ops):
    return fixture(spark, sf_dir, "kv_log").where(F.col("op").isin(*ops)).select(F.col("node_id").alias("part"), "idx", "t")


def propose_batches(spark, sf_dir):
    return recurrences.batches(_items(spark, sf_dir, kv.PUT, kv.CAS, kv.CHECKPOINT), 1800, 8).drop("part")


def read_batches(spark, sf_dir):
    return recurrences.batches(_items(spark, sf_dir, kv.GET), 3600, None).drop("part")


def snapshot_cache(spark, sf_dir):
    return recurrences.cached(_items(spark, sf_dir, kv.GET), 7200).drop("part")


def read_lease(spark, sf_dir):
    reads = _items(spark, sf_dir, kv.GET)
    return recurrences.lease(reads.withColumn("term", F.floor(F.col("t") / 86400) + 1), 7200).drop("part")


# replicated logs


def raft_rewrite(spark, sf_dir):
    wal = fixture(spark, sf_dir, "raft_wal")
    return snapshots.rewritten(replog.raft_compact(log_of(spark, sf_dir), fixture(spark, sf_dir, "snapshots"), 64), replog.hard_state(wal))


def role_transitions(spark, sf_dir):
    return elections.role_transitions(health.role_history(fixture(spark, sf_dir, "node_status_ticks")))


def commit_stall(spark, sf_dir):
    nodes = fixture(spark, sf_dir, "node_status_ticks").groupBy("tick").agg(F.max("last_index").alias("last_index"))
    ticks = rollup(spark, sf_dir).join(nodes, "tick").withColumnRenamed("max_commit", "commit_index")
    return elections.commit_stall(ticks, 5)


def vote_grants(spark, sf_dir):
    return elections.vote_grants(fixture(spark, sf_dir, "vote_requests"))


def election_tally(spark, sf_dir):
    return elections.election_tally(vote_grants(spark, sf_dir), NODES)


def election_backoff_bounds(spark, sf_dir):
    return elections.backoff_bounds(fixture(spark, sf_dir, "vote_requests").select((F.col("event_id") % 6).alias("attempts")).distinct())


# health


def node_status(spark, sf_dir):
    heals = health.pending_heals(fixture(spark, sf_dir, "heal_actions"), 30 * 86_400_000, 30 * 86_400_000)
    return health.node_status(fixture(spark, sf_dir, "inspections"), "mesh", heals)


def reconcile_plan(spark, sf_dir):
    status = health.node_status(fixture(spark, sf_dir, "inspections"), "mesh")
    return health.reconcile_plan(status, status.where((F.col("tick") + F.col("node_id")) % 4 == 0).select("tick", "node_id"))


def heal_due(spark, sf_dir):
    actions = fixture(spark, sf_dir, "heal_actions")
    return health.pending_heals(actions, 20 * 86_400_000, 15 * 86_400_000)


def _observed(spark, sf_dir):
    stepdowns, readable = F.floor(F.col("tick") / 50), F.col("tick") % 7 != 0
    return rollup(spark, sf_dir).select("*", stepdowns.alias("stepdowns"), readable.alias("readable"))


def audit_events(spark, sf_dir):
    return health.audit_events(_observed(spark, sf_dir), 6)


def audit_tail(spark, sf_dir):
    """The audit log written as lines, and its tail as it is served without a limit."""
    path = new_folder(spark, "audit")
    audit_log.append(audit_events(spark, sf_dir).select("tick", "ord", "event", "detail"), path, 0, ["tick", "ord"])
    entry = F.from_json("line", "tick long, ord int, event string, detail string")
    return audit_log.tail(spark, path, 200).select("place", entry.alias("e")).select("place", "e.*")


def _feed(spark, sf_dir, n):
    return health.newest(fixture(spark, sf_dir, "disrupt_attempts").select("event_id", "t", "ip"), n, ["t", "event_id"])


def snapshot_json(spark, sf_dir):
    body = health.snapshot_json(seen(spark, sf_dir), rollup(spark, sf_dir))
    nodes = "array<struct<node_id: long, running: boolean, term: long>>"
    read = F.from_json("body", f"alive long, total long, quorum boolean, leader_id long, term long, max_commit long, nodes {nodes}")
    kept = body.withColumn("s", read).select("tick", "s.alive", "s.quorum", "s.leader_id", F.explode("s.nodes").alias("n"))
    return kept.select("tick", "alive", "quorum", "leader_id", F.col("n.node_id").alias("node_id"), F.col("n.running").alias("running"), F.col("n.term").alias("node_term"))


def pending_kill_overlay(spark, sf_dir):
    nodes = seen(spark, sf_dir)
    return health.pending_kill_overlay(nodes, nodes.where((F.col("tick") + F.col("node_id")) % 5 == 0).select("tick", "node_id"))


def role_int(spark, sf_dir):
    return fixture(spark, sf_dir, "metric_samples").groupBy("role").agg(F.count("*").alias("n")).select("role", role_code(F.col("role")).alias("code"), "n")


def leader_try_order(spark, sf_dir):
    nodes = fixture(spark, sf_dir, "raft_wal").select("node_id").distinct()
    return control.leader_try_order(fixture(spark, sf_dir, "requests"), nodes)


def loadgen_log(spark, sf_dir):
    """As many commands as there are events, by 64 workers."""
    return control.loadgen_log(spark, fixture(spark, sf_dir, "kv_log").count(), 64)


def heartbeats(spark, sf_dir):
    return control.heartbeats(fixture(spark, sf_dir, "load_ticks").select("tick", (F.col("fail") <= F.col("ok")).alias("ok")))


def aimd_rate(spark, sf_dir):
    ticks = fixture(spark, sf_dir, "load_ticks").withColumn("part", F.lit(0).cast("long"))
    return recurrences.aimd(ticks, 1000.0, 100.0, 2000.0).drop("part")


# binary records


def _records(spark, sf_dir):
    return fixture(spark, sf_dir, "storage_log").select("seq", binary.storage_payload(F.col("op"), F.col("k"), F.col("v")).alias("payload"))


def _cut(every: int, size: int):
    """The payload, every so many cut short."""
    return F.when(F.col("seq") % every == 0, F.substring("payload", F.lit(1), F.lit(size))).otherwise(F.col("payload"))


def storage_decode(spark, sf_dir):
    return binary.storage_decode(_records(spark, sf_dir).withColumn("payload", _cut(97, 7)))


def _kv_records(spark, sf_dir):
    parts = [F.col(c) for c in ("op", "client_id", "request_id", "k", "expect", "v")]
    return fixture(spark, sf_dir, "kv_log").select(F.col("idx").alias("seq"), binary.kv_payload(*parts).alias("payload"))


def kv_decode(spark, sf_dir):
    return binary.kv_decode(_kv_records(spark, sf_dir).withColumn("payload", _cut(89, 18)))


def kv_codec_roundtrip(spark, sf_dir):
    return binary.kv_decode(_kv_records(spark, sf_dir).withColumn("size", F.length("payload").cast("long")))


def wal_frame_roundtrip(spark, sf_dir):
    framed = _records(spark, sf_dir).select("seq", binary.framed(F.col("payload")).alias("frame"))
    size, crc = binary.uint(F.col("frame"), 1, 4), binary.uint(F.col("frame"), 5, 4)
    body = F.substring("frame", F.lit(9), F.length("frame"))
    checked = framed.select("seq", F.length("frame").cast("long").alias("framed"), (size == F.length(body)).alias("whole"), body.alias("payload"), crc.alias("crc"))
    checked = checked.withColumn("intact", F.col("crc") == binary.crc32c_column(F.col("payload"))).drop("crc")
    return binary.storage_decode(checked).drop("error")


def wal_scan(spark, sf_dir):
    """The storage log written to four files and scanned again."""
    path = new_folder(spark, "wal")
    binary.write_frames(_records(spark, sf_dir).withColumn("file", (F.col("seq") % 4).cast("string")), path, "file", "seq")
    scanned = binary.scan_frames(spark, path).withColumn("file", F.regexp_extract("path", r"([0-9]+)\.wal$", 1).cast("long")).drop("path")
    return binary.storage_decode(scanned).drop("error")


def raft_wal_decode(spark, sf_dir):
    rows = binary.raft_payload(fixture(spark, sf_dir, "raft_wal")).select("node_id", "seq", "payload")
    return binary.raft_decode(rows).select("node_id", "seq", "tag", "term", "index_or_from", "voted_for", F.col("data").cast("string").alias("data"), "error")


OWN = (
    kv_get, kv_get_as_of, kv_read_checkpoint, kv_snapshot, kv_recover, kv_replay, wait_applied, propose_batches, read_batches, snapshot_cache, read_lease, raft_rewrite, role_transitions,
    commit_stall, vote_grants, election_tally, election_backoff_bounds, node_status, reconcile_plan, heal_due, audit_events, audit_tail, snapshot_json, pending_kill_overlay, role_int,
    leader_try_order, loadgen_log, heartbeats, aimd_rate, storage_decode, kv_decode, kv_codec_roundtrip, wal_frame_roundtrip, wal_scan, raft_wal_decode,
)

QUERIES: dict[str, Query] = {
    "kv_apply": on(kv.apply, "kv_log"),
    "kv_state": on(kv.state, "kv_log"),
    "kv_exactly_once": on(kv.exactly_once, "kv_log"),
    "kv_put_previous": on(kv.put_previous, "kv_log"),
    "kv_cas": on(kv.cas, "kv_log"),
    "kv_checkpoint": on(kv.checkpoint, "kv_log"),
    "kv_watch": on(kv.watch, "kv_log"),
    "kv_execute_once": on(kv.execute_once, "kv_log"),
    "kv_execute_once_remote": on(kv.execute_once, "kv_log", remote=True),
    "kv_client_max_request": on(kv.client_max_request, "kv_log"),
    "kv_recent_results": on(kv.recent_results, "kv_log"),
    "kv_snapshot_points": on(kv.snapshot_points, "applies", every=256),
    "kv_dedup_sweep": on(recurrences.dedup_sweep, "kv_log"),
    "apply_counters": on(kv.apply_counters, "kv_log", "proposals", "read_requests"),
    "propose_latency": on(kv.propose_latency, "proposals", "applies", patience_ms=10),
    "storage_state": on(kv.storage_state, "storage_log"),
    "storage_len": on(kv.storage_len, "storage_log"),
    "raft_recover": log_of,
    "raft_hard_state": on(replog.hard_state, "raft_wal"),
    "log_bounds": on_log(replog.bounds),
    "log_term_at": on_log(replog.term_at, "log_asks"),
    "log_suffix": on_log(replog.suffix, "suffix_asks"),
    "log_truncate": on_log(replog.truncate, "snapshots"),
    "log_first_of_term": on_log(replog.term_edges, "log_asks", last=False),
    "log_last_of_term": on_log(replog.term_edges, "log_asks", last=True),
    "log_compact": on_log(replog.compact, "snapshots"),
    "raft_snapshot_cuts": on_log(replog.snapshot_cuts, "snapshots", retain=64),
    "raft_compact": on_log(replog.raft_compact, "snapshots", retain=64),
    "log_merge": on_log(replog.merge, "incoming"),
    "append_conflict": on_log(replog.append_conflict, "append_requests"),
    "install_snapshot": on_log(replog.install_snapshot, "snapshots"),
    "snapshot_cursors": on(replog.snapshot_cursors, "snapshots"),
    "apply_delivery": on_log(replog.to_apply, "snapshots"),
    "next_index_repair": on_log(replog.next_index_repair, "rejections"),
    "follower_commit": on(replog.follower_commit, "append_requests"),
    "commit_index": on(replog.commit_index, "match_progress_ticks", leader=LEADER),
    "match_progress": on(replog.match_progress, "match_progress_ticks"),
    "replication_plan": on(replog.replication_plan, "match_progress_ticks", leader=LEADER),
    "check_quorum": on(elections.check_quorum, "match_progress_ticks", leader=LEADER, n=NODES),
    "read_quorum": on(elections.read_quorum, "match_progress_ticks", leader=LEADER, n=NODES),
    "vote_up_to_date": on(elections.vote_up_to_date, "vote_requests"),
    "pre_vote": on(elections.pre_vote, "vote_requests"),
    "gauge_latest": on(telemetry.gauge_latest, "metric_samples"),
    "sampled_gauges": on(telemetry.sampled_gauges, "metric_samples"),
    "latency_histogram": on(telemetry.latency_histogram, "metric_samples"),
    "writes_per_sec": on(telemetry.leader_rate, "metric_samples", counter="writes_total", seconds=HOUR),
    "reads_per_sec": on(telemetry.leader_rate, "metric_samples", counter="reads_total", seconds=HOUR),
    "applies_per_sec": on(telemetry.applies_per_sec, "metric_samples", seconds=HOUR),
    "stepdowns_total": on(telemetry.stepdowns_total, "metric_samples"),
    "host_cpu_busy": on(telemetry.host_cpu_busy, "host_samples", seconds=HOUR),
    "host_mem_used": on(telemetry.host_mem_used, "host_samples", seconds=HOUR),
    "series_select": on(telemetry.series_select, "metric_samples", "host_samples"),
    "metrics_unpivot": on(telemetry.metrics_unpivot, "metric_samples"),
    "alert_no_progress": on(telemetry.alert_no_progress, "metric_samples", seconds=HOUR, window=2, needed=5),
    "alert_leader_stuck": on(telemetry.alert_leader_stuck, "metric_samples", seconds=HOUR, window=2, needed=2),
    "alert_watchdog": on(telemetry.alert_watchdog, "metric_samples", window=15, needed=1),
    "healthz_parse": on(health.healthz_parse, "inspections"),
    "cluster_rollup": rollup,
    "since_quorum_loss": lambda spark, sf_dir: health.since_quorum_loss(rollup(spark, sf_dir)),
    "event_ring": partial(_feed, n=64),
    "feed_top12": partial(_feed, n=12),
    "node_badge": on_nodes(health.node_badge),
    "ring_layout": on_nodes(health.ring_layout),
    "mesh_edges": on_nodes(health.mesh_edges),
    "cooldown_accepts": on(recurrences.cooldown, "disrupt_attempts", seconds=6 * 3600),
    "client_ip": on(control.client_ip, "requests"),
    "route_parse": on(control.route_parse, "requests"),
    "audit_limit": on(control.limit_of, "requests"),
    "parse_peers": on(control.parse_peers, "peer_specs"),
    "throughput_report": on(control.throughput_report, "load_ticks", seconds=HOUR),
    "active_viewers": on(control.active_viewers, "presence_events"),
} | {f.__name__: f for f in OWN} | {f"stream_{k}": f for k, f in pipelines.QUERIES.items()}
ORACLE_SQL = {name: with_fixtures(text) for name, text in ORACLES.items()}
