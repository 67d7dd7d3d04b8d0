"""Health of a cluster of nodes: listing, roll-up, audit events and repair plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import healthz

#: Node ids that are listed.
MOST_ID = 64


def healthz_parse(answers: DataFrame) -> DataFrame:
    """answers(tick, node_id, code, body): the fields of answers that can be used."""
    h = healthz(F.col("body"), F.col("code"))
    names = {"ok": "ok", "id": "id", "term": "term", "commitIndex": "commit_index", "leaderId": "leader_id", "isLeader": "is_leader", "role": "role"}
    return answers.withColumn("h", h).select("tick", "node_id", *[F.col(f"h.{a}").alias(b) for a, b in names.items()])


def node_status(inspections: DataFrame, network: str, heals: DataFrame | None = None) -> DataFrame:
    """inspections(tick, node_id, ok, out, networks, code, body): one row a listed
    node. A failed or odd inspection gives an unknown, stopped node; a running one
    without the network is partitioned; what the node says of itself counts only if
    it runs and is reachable. ``heals``(node_id, kind, due_in) are put beside."""
    words = F.split(F.trim("out"), r"\s+")
    rows = inspections.where((F.col("node_id") >= 1) & (F.col("node_id") <= MOST_ID)).withColumn("words", words)
    known = F.col("ok") & (F.size("words") >= 2)
    rows = rows.select("*", F.coalesce(known & (F.get("words", F.lit(0)) == "true"), F.lit(False)).alias("running"), F.when(known, F.get("words", F.lit(1))).otherwise("unknown").alias("status"))
    rows = rows.withColumn("partitioned", F.col("running") & ~F.coalesce(F.contains("networks", F.lit(f'"{network}"')), F.lit(True)))
    rows = rows.withColumn("h", F.when(F.col("running") & ~F.col("partitioned"), healthz(F.col("body"), F.col("code"))))
    zero = F.lit(0).cast("long")
    out = rows.select(
        "tick", "node_id", "running", "status", "partitioned", F.coalesce("h.term", zero).alias("term"), F.coalesce("h.commitIndex", zero).alias("commit_index"),
        F.coalesce("h.leaderId", zero).alias("reported_leader"), F.coalesce("h.isLeader", F.lit(False)).alias("is_leader"), F.coalesce("h.role", F.lit("")).alias("role"),
    )
    if heals is None:
        return out
    return out.join(heals.select("node_id", F.col("kind").alias("heal_kind"), F.col("due_in").alias("heal_due_ms")), "node_id", "left")


def seen(status: DataFrame) -> DataFrame:
    """status rows with what a stopped or partitioned node says of itself blanked."""
    alive = F.col("running") & ~F.col("partitioned")
    blank = lambda c, x: F.when(F.col("alive"), F.col(c)).otherwise(x).alias(c)
    rest = [blank("reported_leader", F.lit(0).cast("long")), (F.col("alive") & F.col("is_leader")).alias("is_leader"), blank("term", F.lit(0).cast("long")), blank("commit_index", F.lit(0).cast("long"))]
    return status.withColumn("alive", alive).select("tick", "node_id", "running", "partitioned", "alive", *rest)


def cluster_rollup(nodes: DataFrame, by: Sequence[str] = ("tick",)) -> DataFrame:
    """(tick, alive, total, quorum, leader_id, term, max_commit). The leader is the
    last node that says it leads, else the one that the first node names; the term is
    that node's."""
    leads = F.max_by(F.struct("node_id", "term"), F.when(F.col("is_leader"), F.col("node_id")))
    named = F.min_by(F.struct(F.col("reported_leader").alias("node_id"), "term"), F.when(F.col("reported_leader") != 0, F.col("node_id")))
    out = nodes.groupBy(*by).agg(F.count_if("alive").alias("alive"), F.count("*").alias("total"), leads.alias("a"), named.alias("b"), F.max("commit_index").alias("max_commit"), F.count_if("is_leader").alias("n"), F.count_if(F.col("reported_leader") != 0).alias("m"))
    pick = lambda c: F.when(F.col("n") > 0, F.col(f"a.{c}")).when(F.col("m") > 0, F.col(f"b.{c}")).otherwise(F.lit(0).cast("long"))
    return out.select(*by, "alive", "total", (F.col("alive") > F.floor(F.col("total") / 2)).alias("quorum"), pick("node_id").alias("leader_id"), pick("term").alias("term"), "max_commit")


def since_quorum_loss(health: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(tick, quorum, since): ticks since quorum was last lost, -1 if it never was."""
    order = Window.partitionBy(*by).orderBy("tick")
    lost = F.when(~F.col("quorum") & F.coalesce(F.lag("quorum").over(order), F.lit(True)), F.col("tick"))
    rows = health.withColumn("lost", lost)
    return rows.select(*by, "tick", "quorum", F.coalesce(F.col("tick") - F.max("lost").over(order), F.lit(-1)).alias("since"))


def audit_events(health: DataFrame, stall_after: int = 60, by: Sequence[str] = ()) -> DataFrame:
    """health(tick, alive, total, quorum, leader_id, term, max_commit, stepdowns,
    readable): (tick, ord, event, detail and the state) of every change. The first
    tick only opens the log. A commit index that stands still for ``stall_after``
    while the cluster could serve is told once, and once more as it moves on;
    step-downs count from the last value that could be read."""
    order = Window.partitionBy(*by).orderBy("tick")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = health.select("*", F.row_number().over(order).alias("n"), *[F.lag(c).over(order).alias(f"was_{c}") for c in ("quorum", "leader_id", "max_commit")])
    rows = rows.withColumn("moved", (F.col("n") == 1) | (F.col("max_commit") != F.col("was_max_commit")))
    rows = rows.withColumn("run", F.sum(F.col("moved").cast("int")).over(order)).withColumn("known", F.last(F.when(F.col("readable"), F.col("stepdowns")), ignorenulls=True).over(past))
    own = Window.partitionBy(*by, "run")
    frozen = ~F.col("moved") & F.col("quorum") & (F.col("leader_id") != 0) & (F.col("tick") - F.min("tick").over(own) >= stall_after)
    rows = rows.withColumn("told", F.min(F.when(frozen, F.col("tick"))).over(own)).withColumn("since", F.min("tick").over(own))
    rows = rows.withColumn("was_told", F.lag("told").over(order)).withColumn("was_since", F.lag("since").over(order))
    s = lambda c: F.col(c).cast("string")
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    event = lambda when, order, kind, detail: F.when(when, F.struct(F.lit(order).alias("ord"), kind.alias("event"), detail.alias("detail")))
    later = F.col("n") > 1
    new_leader = F.when(F.col("was_leader_id") != 0, text("node ", s("leader_id"), " replaced node ", s("was_leader_id"), " at term ", s("term"))).otherwise(text("node ", s("leader_id"), " now leader at term ", s("term")))
    found = F.array_compact(F.array(
        event(~later, 0, F.lit("controlplane_started"), F.lit("audit log opened")),
        event(later & (F.col("quorum") != F.col("was_quorum")), 1, F.when(F.col("quorum"), "quorum_regained").otherwise("quorum_lost"), F.when(F.col("quorum"), "").otherwise(text(s("alive"), " of ", s("total"), " alive"))),
        event(later & (F.col("leader_id") != 0) & (F.col("leader_id") != F.col("was_leader_id")), 2, F.lit("leader_changed"), new_leader),
        event(later & F.col("moved") & F.col("was_told").isNotNull(), 3, F.lit("progress_resumed"), text("commit index moving again after ", (F.col("tick") - F.col("was_since")).cast("string"), "s stalled at ", s("was_max_commit"))),
        event(later & (F.col("tick") == F.col("told")), 3, F.lit("progress_stalled"), text("commit index frozen at ", s("max_commit"), " for ", (F.col("tick") - F.col("since")).cast("string"), "s with quorum and a leader")),
        event(later & F.col("readable") & (F.col("stepdowns") > F.col("known")), 4, F.lit("watchdog_stepdown"), text("commit-stall watchdog deposed a leader (", s("stepdowns"), " in total)")),
    ))
    return rows.select(*by, "tick", "alive", "total", "quorum", "leader_id", "term", "max_commit", F.explode(found).alias("e")).select(*by, "tick", "e.*", "alive", "total", "quorum", "leader_id", "term", "max_commit")


def newest(events: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The last ``n`` events; as they are shown oldest first, with their place."""
    top = events.orderBy(*[F.desc(c) for c in order]).limit(n)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # n rows


def pending_heals(actions: DataFrame, now_ms: int | Column, after_ms: int, nodes: Sequence[int] | None = None) -> DataFrame:
    """actions(seq, at_ms, node_id, action): (node_id, kind, due_in) of the repairs
    that are still due. A kill or partition plans one in place of the node's last, a
    restart of the node ends it, a reset those of all nodes; what is past is done."""
    reset = actions.where(F.col("action") == "reset").agg(F.max("seq").alias("reset"))
    last = actions.where(F.col("action") != "reset").groupBy("node_id").agg(F.max_by(F.struct("seq", "at_ms", "action"), "seq").alias("s"))
    last = last.join(F.broadcast(reset)).where(F.col("reset").isNull() | (F.col("s.seq") > F.col("reset")))
    kind = F.when(F.col("s.action") == "kill", "start").otherwise("reconnect")
    due = F.col("s.at_ms") + after_ms - now_ms
    out = last.where(F.col("s.action").isin("kill", "partition")).select("node_id", kind.alias("kind"), due.alias("due"))
    return out.where("due >= 0").select("node_id", "kind", F.col("due").alias("due_in"))


def reconcile_plan(status: DataFrame, heals: DataFrame) -> DataFrame:
    """status(tick, node_id, running, status, partitioned), heals(tick, node_id): what
    to do about nodes that drifted: not those with a repair due, nor those whose
    inspection failed."""
    drifted = status.where((F.col("status") != "unknown") & (~F.col("running") | F.col("partitioned"))).join(heals, ["tick", "node_id"], "left_anti")
    return drifted.select("tick", "node_id", F.when(~F.col("running"), "start").otherwise("reconnect").alias("action"))


def role_history(status: DataFrame) -> DataFrame:
    """node_status rows as (tick, node_id, role, term, voted_for, last_index); a node
    that can't be seen has no role."""
    role = F.when(F.col("running") & ~F.col("partitioned"), F.when(F.col("is_leader"), "leader").otherwise("follower"))
    return status.select("tick", "node_id", role.alias("role"), "term", "voted_for", "last_index").where("role IS NOT NULL")


def snapshot_json(nodes: DataFrame, health: DataFrame) -> DataFrame:
    """(tick, body): a cluster snapshot with its nodes as JSON."""
    rows = nodes.groupBy("tick").agg(F.array_sort(F.collect_list(F.struct("node_id", "running", "partitioned", "reported_leader", "is_leader", "term", "commit_index"))).alias("nodes"))
    return health.join(rows, "tick").select("tick", F.to_json(F.struct("alive", "total", "quorum", "leader_id", "term", "max_commit", "nodes")).alias("body"))


# what the pages show


def node_badge(nodes: DataFrame) -> DataFrame:
    badge = F.when(~F.col("running"), "down").when(F.col("partitioned"), "partitioned").when(F.col("is_leader"), "leader").otherwise("follower")
    return nodes.select("tick", "node_id", badge.alias("badge"), F.col("alive").alias("killable"))


def _placed(nodes: DataFrame) -> DataFrame:
    own = Window.partitionBy("tick")
    return nodes.where("alive").select("tick", "node_id", (F.row_number().over(own.orderBy("node_id")) - 1).alias("pos"), F.count("*").over(own).alias("n"))


def ring_layout(nodes: DataFrame) -> DataFrame:
    """Healthy nodes evenly on a circle."""
    turn = F.lit(2.0) * F.pi() * F.col("pos") / F.col("n")
    return _placed(nodes).select("tick", "node_id", (F.round(F.cos(turn), 6) + 0.0).alias("x"), (F.round(F.sin(turn), 6) + 0.0).alias("y"))


def mesh_edges(nodes: DataFrame, near: int = 2) -> DataFrame:
    """Pairs of healthy nodes; of more than three, those within ``near`` on the ring."""
    p = _placed(nodes)
    a = p.select("tick", F.col("node_id").alias("node_a"), F.col("pos").alias("i"), "n")
    b = p.select("tick", F.col("node_id").alias("node_b"), F.col("pos").alias("j"))
    apart = F.col("j") - F.col("i")
    return a.join(b, "tick").where((F.col("i") < F.col("j")) & ((F.col("n") <= 3) | (F.least(apart, F.col("n") - apart) <= near))).select("tick", "node_a", "node_b")


def pending_kill_overlay(nodes: DataFrame, kills: DataFrame) -> DataFrame:
    """kills(tick, node_id) that the status doesn't show yet: (tick, alive, quorum)."""
    both = nodes.join(kills.withColumn("killed", F.lit(True)), ["tick", "node_id"], "left")
    alive = F.count_if(F.col("alive") & F.col("killed").isNull())
    return both.groupBy("tick").agg(alive.alias("alive"), (alive > F.floor(F.count("*") / 2)).alias("quorum"))
