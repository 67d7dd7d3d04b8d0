"""Rules of elections and leadership, over recorded requests and states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import majority

#: Election timeout in milliseconds, least and most.
LEAST_MS, MOST_MS = 750, 1500


def up_to_date() -> Column:
    return F.struct("cand_last_term", "cand_last_index") >= F.struct("voter_last_term", "voter_last_index")


def heard_leader(least_ms: int) -> Column:
    return (F.col("leader_id") != 0) & (F.col("heard_ms") < least_ms)


def vote_up_to_date(requests: DataFrame) -> DataFrame:
    return requests.select("event_id", up_to_date().alias("up_to_date"))


def pre_vote(requests: DataFrame, least_ms: int = LEAST_MS) -> DataFrame:
    """requests(.., term, voter_term, leader_id, heard_ms): asking changes nothing."""
    return requests.select("event_id", ((F.col("term") > F.col("voter_term")) & ~heard_leader(least_ms) & up_to_date()).alias("granted"))


def vote_grants(requests: DataFrame, least_ms: int = LEAST_MS) -> DataFrame:
    """(event_id, term, voter_id, candidate_id, granted, response_term) of requests
    in order by voter. A voter that knows a live leader refuses higher terms and
    keeps its own; else it adopts the highest term seen, refuses lower ones, and
    votes for one up-to-date candidate a term, again and again for the same."""
    order = Window.partitionBy("voter_id").orderBy("event_id")
    # a request of a higher term is seen unless a live leader is known; others change no term
    adopted = F.max(F.when(~heard_leader(least_ms), F.col("term"))).over(order)
    rows = requests.withColumn("current", F.coalesce(adopted, F.lit(0).cast("long"))).withColumn("fresh", up_to_date())
    rows = rows.withColumn("able", (F.col("term") == F.col("current")) & F.col("fresh"))
    first = F.first(F.when(F.col("able"), F.col("candidate_id")), ignorenulls=True).over(Window.partitionBy("voter_id", "term").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("event_id", "term", "voter_id", "candidate_id", (F.col("able") & F.coalesce(first == F.col("candidate_id"), F.lit(False))).alias("granted"), F.col("current").alias("response_term"))


def election_tally(votes: DataFrame, n: int) -> DataFrame:
    """votes(term, voter_id, candidate_id, granted, response_term): the candidate's
    own vote and those of others for its term; answers of another term count for
    nothing, and one of a later term ends the candidacy."""
    others = votes.where("voter_id <> candidate_id")
    voted = F.count_distinct(F.when(F.col("granted") & (F.col("response_term") == F.col("term")), F.col("voter_id")))
    out = others.groupBy("term", "candidate_id").agg((voted + 1).alias("votes"), (F.max("response_term") > F.col("term")).alias("outdated"))
    return out.select("term", "candidate_id", "votes", ((F.col("votes") >= majority(n)) & ~F.col("outdated")).alias("won"))


def check_quorum(progress: DataFrame, leader: int, n: int, most_ms: int = MOST_MS) -> DataFrame:
    """progress(tick, node_id, contact_ms): the leader and the peers heard of in time."""
    heard = F.count_if((F.col("node_id") != leader) & (F.col("contact_ms") < most_ms)) + 1
    return progress.groupBy("tick").agg(heard.alias("active"), (heard >= majority(n)).alias("quorum"))


def read_quorum(progress: DataFrame, leader: int, n: int) -> DataFrame:
    """progress(tick, node_id, term, acked, ack_term): leadership is confirmed by a
    majority of successful answers of the same term; a later term ends it."""
    peers = F.col("node_id") != leader
    acks = F.count_if(peers & F.col("acked") & (F.col("ack_term") == F.col("term"))) + 1
    deposed = F.max(peers & (F.col("ack_term") > F.col("term")))
    return progress.groupBy("tick", "term").agg(acks.alias("acks"), ((acks >= majority(n)) & ~deposed).alias("confirmed"))


def backoff_bounds(attempts: DataFrame, least_ms: int = LEAST_MS, most_ms: int = MOST_MS) -> DataFrame:
    """attempts(attempts): the range of the next election timeout."""
    wide = F.lit(most_ms - least_ms) * F.pow(F.lit(2), F.least(F.col("attempts"), F.lit(3)))
    return attempts.select("attempts", F.lit(least_ms).alias("low_ms"), (F.lit(least_ms) + wide).cast("long").alias("high_ms"))


def commit_stall(ticks: DataFrame, timeout: int, by: tuple[str, ...] = ()) -> DataFrame:
    """ticks(tick, last_index, commit_index, quorum): (tick, age, fires). The clock
    starts anew with each commit and while nothing is pending; a leader that has
    entries to commit for ``timeout`` and an active majority is deposed. A negative
    timeout turns it off."""
    order = Window.partitionBy(*by).orderBy("tick")
    moved = F.lag("commit_index").over(order)
    fresh = (F.col("last_index") <= F.col("commit_index")) | moved.isNull() | (moved != F.col("commit_index"))
    rows = ticks.withColumn("fresh", fresh.cast("int")).withColumn("run", F.sum("fresh").over(order))
    age = F.col("tick") - F.min("tick").over(Window.partitionBy(*by, "run"))
    due = (F.col("fresh") == 0) & (F.col("age") >= timeout) & F.col("quorum") if timeout >= 0 else F.lit(False)
    return rows.withColumn("age", age).select(*by, "tick", "age", due.alias("fires"))


def role_transitions(status: DataFrame) -> DataFrame:
    """status(tick, node_id, role, term, voted_for, last_index), role null while the
    node can't be seen: (tick, node_id, was, role, term, voted_for, next_index,
    match_index) where the role or the term changes. A higher term clears the vote, a
    step-down in the same term keeps it, and a new leader expects its peers to hold
    all it has and knows of nothing they do."""
    order = Window.partitionBy("node_id").orderBy("tick")
    rows = status.withColumn("was", F.lag("role").over(order)).withColumn("old_term", F.lag("term").over(order))
    rows = rows.where((F.col("was") != F.col("role")) | (F.col("term") > F.col("old_term")))
    leads = F.col("role") == "leader"
    vote = F.when(leads, F.col("node_id")).when(F.col("term") > F.col("old_term"), F.lit(0)).otherwise(F.col("voted_for"))
    return rows.select("tick", "node_id", "was", "role", "term", vote.cast("long").alias("voted_for"), F.when(leads, F.col("last_index") + 1).alias("next_index"), F.when(leads, F.lit(0)).cast("long").alias("match_index"))
