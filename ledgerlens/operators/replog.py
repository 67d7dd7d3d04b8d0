"""Algebra of replicated logs: recovery, bounds, compaction, conflicts and commits.

A log is a table (node_id, log_index, term, sentinel): for each node its entries and
one sentinel, which holds the index and term up to which it was compacted (0 and 0
at first). Questions are tables too, so that many are answered at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HARD_STATE, ENTRY, TRUNCATE = 1, 2, 3
#: Entries of one append, and retained ones after a snapshot.
MOST_ENTRIES, RETAIN = 64, 1024


def zero() -> Column:
    return F.lit(0).cast("long")


def surviving(wal: DataFrame) -> DataFrame:
    """wal(node_id, seq, tag, term, index_or_from): the entries that no later marker
    cuts off, (node_id, log_index, term)."""
    # read backwards, the frame grows and keeps one running minimum
    backwards = Window.partitionBy("node_id").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    cut = F.min(F.when(F.col("tag") == TRUNCATE, F.col("index_or_from"))).over(backwards)
    rows = wal.withColumn("cut", cut).where((F.col("tag") == ENTRY) & (F.col("cut").isNull() | (F.col("cut") > F.col("index_or_from"))))
    return rows.select("node_id", F.col("index_or_from").alias("log_index"), "term")


def hard_state(wal: DataFrame) -> DataFrame:
    """(node_id, term, voted_for): the last one written wins; 0 and 0 without any."""
    last = F.max_by(F.when(F.col("tag") == HARD_STATE, F.struct("term", "voted_for")), F.when(F.col("tag") == HARD_STATE, F.col("seq")))
    out = wal.groupBy("node_id").agg(last.alias("s"))
    return out.select("node_id", F.coalesce("s.term", zero()).alias("term"), F.coalesce("s.voted_for", zero()).alias("voted_for"))


def recover(wal: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """The log of every node; of ``snapshots`` (node_id, pos, term), if given, the
    sentinel, with only the entries behind it."""
    live = surviving(wal)
    if snapshots is None:
        first = wal.select("node_id").distinct().select("node_id", zero().alias("log_index"), zero().alias("term"))
    else:
        first = wal.select("node_id").distinct().join(snapshots, "node_id", "left").select("node_id", F.coalesce("pos", zero()).alias("log_index"), F.coalesce("term", zero()).alias("term"))
        live = live.join(first.select("node_id", F.col("log_index").alias("from")), "node_id").where("log_index > from").drop("from")
    return live.withColumn("sentinel", F.lit(False)).unionByName(first.withColumn("sentinel", F.lit(True)))


def bounds(log: DataFrame) -> DataFrame:
    """(node_id, first_index, last_index, last_term): the first is the sentinel's."""
    return log.groupBy("node_id").agg(F.min("log_index").alias("first_index"), F.max("log_index").alias("last_index"), F.max_by("term", "log_index").alias("last_term"))


def term_at(log: DataFrame, asks: DataFrame) -> DataFrame:
    """asks(node_id, pos): (node_id, pos, term, available) from sentinel to last."""
    found = log.select("node_id", F.col("log_index").alias("pos"), "term")
    return asks.select("node_id", "pos").join(found, ["node_id", "pos"], "left").withColumn("available", F.col("term").isNotNull())


def suffix(log: DataFrame, asks: DataFrame, most: int = MOST_ENTRIES) -> DataFrame:
    """asks(node_id, start): entries from there on, ``most`` at most; none if the
    start is the sentinel or before, or beyond the last. Indexes have no gaps, so the
    cap is a range, which is joined by blocks of as many indexes."""
    block = lambda c: F.floor(c / most)
    fit = asks.select("node_id", "start").distinct().join(bounds(log), "node_id").where("start > first_index AND start <= last_index").select("node_id", "start")
    fit = fit.withColumn("block", F.explode(F.array(block(F.col("start")), block(F.col("start")) + 1)))
    entries = log.where("NOT sentinel").withColumn("block", block(F.col("log_index")))
    both = fit.join(entries, ["node_id", "block"])
    return both.where((F.col("log_index") >= F.col("start")) & (F.col("log_index") < F.col("start") + most)).select("node_id", "start", "log_index", "term")


def truncate(log: DataFrame, cuts: DataFrame) -> DataFrame:
    """cuts(node_id, pos): the log before that index; the sentinel always stays."""
    return log.join(cuts.select("node_id", "pos"), "node_id", "left").where(F.col("sentinel") | F.col("pos").isNull() | (F.col("log_index") < F.col("pos"))).drop("pos")


def of_term(log: DataFrame, last: bool) -> DataFrame:
    """(node_id, term, log_index): the first or last entry of each term."""
    pick = F.max if last else F.min
    return log.where("NOT sentinel").groupBy("node_id", "term").agg(pick("log_index").alias("log_index"))


def term_edges(log: DataFrame, asks: DataFrame, last: bool) -> DataFrame:
    """asks(node_id, term): with the first or last index of that term, 0 if none."""
    return asks.select("node_id", "term").distinct().join(of_term(log, last), ["node_id", "term"], "left").select("node_id", "term", F.coalesce("log_index", zero()).alias("log_index"))


def compact(log: DataFrame, cuts: DataFrame) -> DataFrame:
    """cuts(node_id, pos, term): entries up to there go, the sentinel stands there;
    nothing changes if it does already or is further on."""
    first = log.where("sentinel").select("node_id", F.col("log_index").alias("first_index"))
    held = log.join(first, "node_id").join(cuts.select("node_id", "pos", F.col("term").alias("cut_term")), "node_id", "left")
    moves = F.coalesce(F.col("pos") > F.col("first_index"), F.lit(False))
    kept = held.where(F.col("sentinel") | ~moves | (F.col("log_index") > F.col("pos")))
    at_cut = moves & F.col("sentinel")
    return kept.select("node_id", F.when(at_cut, F.col("pos")).otherwise(F.col("log_index")).alias("log_index"), F.when(at_cut, F.col("cut_term")).otherwise(F.col("term")).alias("term"), "sentinel")


def snapshot_cuts(log: DataFrame, taken: DataFrame, retain: int = RETAIN) -> DataFrame:
    """taken(node_id, pos, applied): (node_id, status, pos, cut, term) of a snapshot at
    an index. It is done already, beyond what is applied, not in the log, or ok; then
    ``retain`` entries before it stay for followers that lag, and entries up to cut go."""
    asked = taken.select("node_id", "pos", "applied").join(bounds(log), "node_id")
    asked = asked.join(term_at(log, asked).select("node_id", F.col("pos"), F.col("term").alias("snap_term")), ["node_id", "pos"])
    status = F.when(F.col("pos") <= F.col("first_index"), "done").when(F.col("pos") > F.col("applied"), "beyond applied").when(F.col("snap_term").isNull(), "not in log").otherwise("ok")
    cut = F.when(status == "ok", F.greatest(F.col("pos") - retain, zero()) if retain > 0 else F.col("pos"))
    out = asked.select("node_id", status.alias("status"), F.col("pos").alias("snap"), cut.alias("pos"))
    out = out.join(term_at(log, out.where("pos IS NOT NULL")).select("node_id", "pos", "term"), ["node_id", "pos"], "left")
    return out.select("node_id", "status", F.col("snap").alias("pos"), F.col("pos").alias("cut"), "term")


def raft_compact(log: DataFrame, taken: DataFrame, retain: int = RETAIN) -> DataFrame:
    """The log after a snapshot of each node in ``taken``, as it is written anew."""
    cuts = snapshot_cuts(log, taken, retain).where("term IS NOT NULL")
    return compact(log, cuts.select("node_id", F.col("cut").alias("pos"), "term"))


def merge(log: DataFrame, incoming: DataFrame) -> DataFrame:
    """incoming(node_id, log_index, term): (node_id, log_index, term, origin), the
    log once a leader's entries are in. Those up to the sentinel and those that are
    there already are passed over; from the first other term on the log is replaced;
    without one, what lies beyond the last entry is added and nothing goes."""
    edge = bounds(log).select("node_id", "first_index", "last_index")
    fresh = incoming.join(edge, "node_id").where("log_index > first_index")
    ours = log.select("node_id", "log_index", F.col("term").alias("our_term"))
    clash = fresh.join(ours, ["node_id", "log_index"]).where("term <> our_term").groupBy("node_id").agg(F.min("log_index").alias("clash"))
    kept = log.join(clash, "node_id", "left").where(F.col("sentinel") | F.col("clash").isNull() | (F.col("log_index") < F.col("clash")))
    added = fresh.join(clash, "node_id", "left").where(F.col("log_index") >= F.coalesce("clash", F.col("last_index") + 1))
    return kept.select("node_id", "log_index", "term", F.lit("kept").alias("origin")).union(added.select("node_id", "log_index", "term", F.lit("incoming")))


def append_conflict(log: DataFrame, requests: DataFrame) -> DataFrame:
    """requests(node_id, request, prev_index, prev_term): whether the node holds the
    entry before the new ones, and else hints: one past its last entry if it is too
    short; its term there with that term's first index, or the first entry's if only
    the sentinel has the term. Places before the sentinel pass."""
    asked = requests.select("node_id", "request", "prev_index", "prev_term").join(bounds(log), "node_id")
    held = log.select("node_id", F.col("log_index").alias("prev_index"), F.col("term").alias("our_term"))
    runs = of_term(log, last=False).select("node_id", F.col("term").alias("our_term"), F.col("log_index").alias("run_start"))
    asked = asked.join(held, ["node_id", "prev_index"], "left").join(runs, ["node_id", "our_term"], "left")
    outcome = (
        F.when(F.col("prev_index") > F.col("last_index"), "short")
        .when((F.col("prev_index") >= F.col("first_index")) & ~F.col("our_term").eqNullSafe(F.col("prev_term")), "conflict")
        .otherwise("ok")
    )
    index = F.when(F.col("outcome") == "short", F.col("last_index") + 1).when(F.col("outcome") == "conflict", F.coalesce("run_start", F.col("first_index") + 1)).otherwise(0)
    term = F.when(F.col("outcome") == "conflict", F.coalesce("our_term", zero())).otherwise(zero())
    return asked.withColumn("outcome", outcome).select("node_id", "request", "outcome", index.cast("long").alias("conflict_index"), term.alias("conflict_term"))


def follower_commit(requests: DataFrame) -> DataFrame:
    """requests(node_id, request, prev_index, n_entries, leader_commit, commit_index):
    the follower's commit index after an append that it took."""
    new = F.least(F.col("leader_commit"), F.greatest(F.col("prev_index") + F.col("n_entries"), F.col("commit_index")))
    return requests.select("node_id", "request", F.when(F.col("leader_commit") > F.col("commit_index"), new).otherwise(F.col("commit_index")).alias("commit_index"))


def commit_index(progress: DataFrame, leader: int) -> DataFrame:
    """progress(tick, node_id, last_index, term, match_index): (tick, term,
    last_index, commit_index) of a leader that counts its own last index and its
    peers' matches. What a majority holds is committed if it is of the current term,
    that is beyond all that earlier terms wrote; commits never go back."""
    own = F.when(F.col("node_id") == leader, F.col("last_index")).otherwise(F.col("match_index"))
    ticks = progress.groupBy("tick").agg(F.max("term").alias("term"), F.max("last_index").alias("last_index"), F.sort_array(F.collect_list(own), asc=False).alias("held"))
    # n / 2 rounded down is the place of the majority's least, from 0
    ticks = ticks.withColumn("reached", F.get("held", F.floor(F.size("held") / 2).cast("int")))
    before = Window.orderBy("term").rowsBetween(Window.unboundedPreceding, -1)
    terms = ticks.groupBy("term").agg(F.max("last_index").alias("top")).select("term", F.coalesce(F.max("top").over(before), zero()).alias("old"))  # one row a term
    moved = ticks.join(terms, "term").withColumn("moved", F.when(F.col("reached") > F.col("old"), F.col("reached")))
    so_far = Window.orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)  # one row a tick of one leader
    return moved.select("tick", "term", "last_index", F.coalesce(F.max("moved").over(so_far), zero()).alias("commit_index"))


def match_progress(progress: DataFrame) -> DataFrame:
    """(tick, node_id, match_index, next_index, behind): cursors only move forward."""
    match = F.max("match_index").over(Window.partitionBy("node_id").orderBy("tick"))
    return progress.select("tick", "node_id", match.alias("match_index"), (match + 1).alias("next_index"), (match + 1 <= F.col("last_index")).alias("behind"))


def next_index_repair(log: DataFrame, rejections: DataFrame) -> DataFrame:
    """rejections(node_id, request, conflict_term, conflict_index, next_index): where
    the leader goes on: past its own last entry of the term that clashes, else at the
    hinted index, else, without hints, one back; 1 at least."""
    runs = of_term(log, last=True).select("node_id", F.col("term").alias("conflict_term"), F.col("log_index").alias("run_end"))
    asked = rejections.join(runs, ["node_id", "conflict_term"], "left")
    back = F.when(F.col("next_index") > 1, F.col("next_index") - 1).otherwise(F.col("next_index"))
    to = F.when(F.col("conflict_term") != 0, F.coalesce(F.col("run_end") + 1, "conflict_index")).when(F.col("conflict_index") != 0, F.col("conflict_index")).otherwise(back)
    return asked.select("node_id", "request", F.greatest(to, F.lit(1).cast("long")).alias("next_index"))


def replication_plan(progress: DataFrame, leader: int, most: int = MOST_ENTRIES) -> DataFrame:
    """progress(tick, node_id, last_index, first_index, match_index): what the leader
    sends to each peer: a snapshot if the next entry was compacted, else entries, at
    most so many; none is a heartbeat."""
    at = F.col("match_index") + 1
    plan = F.when(at <= F.col("first_index"), "snapshot").when(at <= F.col("last_index"), "entries").otherwise("heartbeat")
    n = F.when(plan == "entries", F.least(F.col("last_index") - F.col("match_index"), F.lit(most).cast("long"))).otherwise(zero())
    return progress.where(F.col("node_id") != leader).select("tick", "node_id", plan.alias("plan"), n.alias("entries"))


def install_snapshot(log: DataFrame, offers: DataFrame) -> DataFrame:
    """offers(node_id, pos, term, commit_index): the log of each node after a snapshot
    is installed, if it is beyond its commit index; else as it was."""
    return compact(log, offers.where("pos > commit_index").select("node_id", "pos", "term"))


def snapshot_cursors(offers: DataFrame) -> DataFrame:
    """offers(node_id, pos, applied, commit_index): the cursors after that."""
    new = F.col("pos") > F.col("commit_index")
    return offers.select("node_id", new.alias("installed"), F.when(new, F.col("pos")).otherwise(F.col("commit_index")).alias("commit_index"), F.when(new, F.col("pos")).otherwise(F.col("applied")).alias("last_applied"))


def to_apply(log: DataFrame, cursors: DataFrame) -> DataFrame:
    """cursors(node_id, applied, commit_index): the entries that are delivered next,
    with their order."""
    rows = log.where("NOT sentinel").join(cursors.select("node_id", "applied", "commit_index"), "node_id").where("log_index > applied AND log_index <= commit_index")
    return rows.select("node_id", "log_index", "term", (F.col("log_index") - F.col("applied")).alias("position"))
