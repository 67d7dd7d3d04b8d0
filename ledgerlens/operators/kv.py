"""The key-value state machine over an ordered command log.

A log has idx, op (1 get, 2 put, 3 compare-and-swap, 4 checkpoint), client_id,
request_id, k, v and expect. A (client, request) pair counts once: later commands of
the pair get the first one's result, whatever they ask for. Commands without a
client or with request 0 are not tracked.

Keys without compare-and-swap are settled by window expressions; only the others
are folded command by command.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fold import ordered_fold

GET, PUT, CAS, CHECKPOINT = 1, 2, 3, 4
RESULT = "key string, idx long, found boolean, value string, after string"
SEED = -1


def tracked() -> Column:
    return (F.col("client_id") != "") & (F.col("request_id") != 0)


def checkpoint_key(client: Column) -> Column:
    return F.concat(F.lit("_checkpoint/"), client)


def effective_key() -> Column:
    return F.when(F.col("op") == CHECKPOINT, checkpoint_key(F.col("client_id"))).otherwise(F.col("k"))


def first_of_pair(log: DataFrame) -> DataFrame:
    """log with ``first_idx``: where the command's pair was first seen."""
    pair = Window.partitionBy("client_id", "request_id", F.when(tracked(), F.lit(None)).otherwise(F.col("idx")))
    return log.withColumn("first_idx", F.min("idx").over(pair))


def executed(log: DataFrame) -> DataFrame:
    return first_of_pair(log).where("idx = first_idx").withColumn("key", effective_key())


def step(value: str | None, row: tuple) -> tuple[str | None, tuple]:
    """One command on the value of its key: the next value, and (key, idx, found,
    answer, next value)."""
    idx, op, v, expect, key = row
    if op == GET:
        return value, (key, idx, value is not None, value, value)
    if op == PUT:
        return v, (key, idx, True, value, v)
    if op == CAS:
        done = expect == "" if value is None else value == expect
        after = v if done else value
        return after, (key, idx, done, value, after)
    if op == CHECKPOINT:
        return v, (key, idx, True, v, v)
    return value, (key, idx, False, None, value)


def _windows(rows: DataFrame) -> DataFrame:
    """Results where no command depends on a comparison."""
    before = Window.partitionBy("key").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    writes = F.col("op").isin(PUT, CHECKPOINT)
    held = F.last(F.when(writes, F.struct("v")), ignorenulls=True).over(before)
    rows = rows.withColumn("held", held["v"])
    found = F.when(F.col("op") == GET, F.col("held").isNotNull()).otherwise(writes)
    value = F.when(F.col("op") == CHECKPOINT, F.col("v")).when(F.col("op").isin(GET, PUT), F.col("held"))
    return rows.select("key", "idx", found.alias("found"), value.alias("value"), F.when(writes, F.col("v")).otherwise(F.col("held")).alias("after"))


def results_of(rows: DataFrame) -> DataFrame:
    """rows(idx, op, v, expect, key) of executed commands: (key, idx, found, value,
    after), the answer and the key's value once it has run."""
    names = ["idx", "op", "v", "expect", "key"]
    rows = rows.select(*names).withColumn("swaps", F.max(F.col("op") == CAS).over(Window.partitionBy("key")))
    plain = _windows(rows.where("NOT swaps").select(*names))
    return plain.union(ordered_fold(rows.where("swaps").select(*names), ["key"], ["idx"], lambda: None, step, RESULT))


def results(log: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """Results of the log's commands; ``seeds`` (key, value) are there before it."""
    rows = executed(log).select("idx", "op", "v", "expect", "key")
    if seeds is None:
        return results_of(rows)
    first = seeds.select(F.lit(SEED).cast("long").alias("idx"), F.lit(PUT).alias("op"), F.col("value").alias("v"), F.lit("").alias("expect"), "key")
    return results_of(first.unionByName(rows))


def apply(log: DataFrame) -> DataFrame:
    """(idx, found, value, duplicate) of every command, in any order."""
    done = results(log).select(F.col("idx").alias("first_idx"), "found", "value")
    return first_of_pair(log).join(done, "first_idx").select("idx", "found", "value", (F.col("idx") != F.col("first_idx")).alias("duplicate"))


def exactly_once(log: DataFrame) -> DataFrame:
    return first_of_pair(log).select("idx", "first_idx", (F.col("idx") != F.col("first_idx")).alias("duplicate"))


def last_value(done: DataFrame) -> DataFrame:
    """results: (key, value) of the keys that are there."""
    return done.groupBy("key").agg(F.max_by("after", "idx").alias("value")).where(F.col("value").isNotNull())


def state(log: DataFrame) -> DataFrame:
    """(key, value): gets are dropped before the fold, as they change nothing."""
    return last_value(results_of(executed(log).where(F.col("op") != GET)))


def get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """keys(key): (key, val, found) at the end of the log."""
    now = state(log).withColumnRenamed("value", "val")
    return keys.select("key").join(now, "key", "left").select("key", "val", F.col("val").isNotNull().alias("found"))


def get_as_of(log: DataFrame, reads: DataFrame) -> DataFrame:
    """reads(read, key, at): (read, key, val, found) by the state after index ``at``,
    whatever the reads' own ids; never a duplicate."""
    facts = results_of(executed(log).where(F.col("op") != GET)).select("key", F.col("idx").alias("at"), F.lit(None).cast("long").alias("read"), F.struct(F.col("after").alias("v")).alias("held"))
    asked = reads.select("key", "at", F.col("read").cast("long").alias("read"), F.lit(None).cast("struct<v:string>").alias("held"))
    order = Window.partitionBy("key").orderBy("at", F.col("read").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = facts.union(asked).withColumn("val", F.last("held", ignorenulls=True).over(order)["v"])
    return both.where("read IS NOT NULL").select("read", "key", "val", F.col("val").isNotNull().alias("found"))


def put_previous(log: DataFrame) -> DataFrame:
    """(idx, key, v, previous) of executed puts."""
    puts = executed(log).where(F.col("op") == PUT).select("idx", "v")
    return results(log).join(puts, "idx").select("idx", "key", "v", F.col("value").alias("previous"))


def cas(log: DataFrame) -> DataFrame:
    """(idx, key, swapped, value) of executed compare-and-swaps."""
    swaps = executed(log).where(F.col("op") == CAS).select("idx")
    return results(log).join(swaps, "idx", "left_semi").select("idx", "key", F.col("found").alias("swapped"), "value")


def checkpoint(log: DataFrame) -> DataFrame:
    """(key, val): the last checkpoint of each client that has one."""
    return executed(log).where(F.col("op") == CHECKPOINT).groupBy("key").agg(F.max_by("v", "idx").alias("val"))


def read_checkpoint(log: DataFrame, clients: DataFrame) -> DataFrame:
    """clients(client_id): (client_id, val, found)."""
    asked = clients.select("client_id", checkpoint_key(F.col("client_id")).alias("key"))
    return asked.join(checkpoint(log), "key", "left").select("client_id", "val", F.col("val").isNotNull().alias("found"))


def watch(log: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Change feed of all keys, or of those in keys(key): executed puts and swaps that
    succeeded; lossless."""
    changes = executed(log).where(F.col("op").isin(PUT, CAS)).select("idx", "op")
    out = results(log).join(changes, "idx").where((F.col("op") == PUT) | F.col("found")).select("idx", "key", F.col("after").alias("new_value"))
    return out if keys is None else out.join(keys, "key", "left_semi").select(*out.columns)


def execute_once(log: DataFrame, remote: bool = False) -> DataFrame:
    """(idx, error, found, value, duplicate): only commands that the interface takes
    are applied; a remote client has no checkpoints."""
    allowed = F.col("op").isin(PUT, CAS) if remote else F.col("op").isin(PUT, CAS, CHECKPOINT)
    error = F.when(allowed, F.lit(None)).otherwise(F.concat(F.lit("unsupported op "), F.col("op").cast("string")))
    return log.select("idx", error.alias("error")).join(apply(log.where(allowed)), "idx", "left")


def client_max_request(log: DataFrame) -> DataFrame:
    order = Window.partitionBy("client_id").orderBy("idx")
    return log.select("idx", "client_id", F.max("request_id").over(order).alias("max_request"))


def recent_results(log: DataFrame, window: int = 256) -> DataFrame:
    """log(.., waited): the results that nobody was waiting for, as far as the cache
    still has them after the last command; it is cleaned as such results come in."""
    own = log.where("NOT waited")
    last = own.agg(F.max("idx").alias("last"))
    return own.join(F.broadcast(last)).where(F.col("idx") + window >= F.col("last")).select("idx", "client_id", "request_id")


def snapshot_points(applies: DataFrame, every: int) -> DataFrame:
    """applies(node_id, idx, ahead, fails), ahead being how far the commit index is
    beyond idx: (node_id, idx) at which a snapshot is taken. It is due ``every``
    commands after the last one; waits while the commit index is more than that
    ahead; and a failure leaves it due."""

    def run(last: int, row: tuple) -> tuple[int, tuple]:
        node, idx, ahead, fails = row
        taken = idx >= last + every and ahead <= every and not fails
        return (idx if taken else last), (node, idx, taken)

    rows = applies.select("node_id", "idx", "ahead", "fails")
    return ordered_fold(rows, ["node_id"], ["idx"], lambda: 0, run, "node_id long, idx long, taken boolean").where("taken").select("node_id", "idx")


def apply_counters(log: DataFrame, proposals: DataFrame, reads: DataFrame) -> DataFrame:
    """One row: every decoded command counts as applied, puts and swaps as writes
    whether or not they change anything; reads are those that were served."""
    counts = log.agg(F.count("*").alias("applies"), F.count_if(F.col("op").isin(PUT, CAS)).alias("writes"))
    served = reads.agg(F.count_if("ok").alias("reads"))
    return counts.join(proposals.agg(F.count("*").alias("proposals"))).join(served)


def propose_latency(proposals: DataFrame, applies: DataFrame, patience_ms: int = 5000) -> DataFrame:
    """proposals(idx, client_id, proposed_ms), applies(idx, applied_ms): the time from
    one to the other by index, and whether the caller would propose again before."""
    late = F.col("applied_ms") - F.col("proposed_ms")
    both = proposals.join(applies.select("idx", "applied_ms"), "idx", "left")
    return both.select("idx", "client_id", late.alias("latency_ms"), F.coalesce(late > patience_ms, F.lit(True)).alias("proposed_again"))


def wait_applied(reads: DataFrame, applies: DataFrame, patience_ms: int = 5000) -> DataFrame:
    """reads(read, at, asked_ms): when index ``at`` had been applied, at the first
    apply of it or of a later one, at most ``patience_ms`` after the question; else
    null. Applies are in the order of their index, so it is a forward as-of join, in
    ranges of indexes: the answer is in the read's own range or starts a later one."""
    width = 4096
    place = lambda c: F.floor(F.col(c) / width)
    heads = applies.groupBy(place("idx").alias("b")).agg(F.min_by("applied_ms", "idx").alias("head_ms"))
    heads = heads.union(reads.select(place("at").alias("b"), F.lit(None).cast("long")).distinct()).groupBy("b").agg(F.max("head_ms").alias("head_ms"))
    # read backwards, frames grow and keep one value
    ahead = Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("next_ms", F.last("head_ms", ignorenulls=True).over(ahead))  # one row a range
    facts = applies.select(place("idx").alias("b"), F.col("idx").alias("at"), F.lit(None).cast("long").alias("read"), F.lit(None).cast("long").alias("asked_ms"), "applied_ms")
    asked = reads.select(place("at").alias("b"), "at", F.col("read").cast("long").alias("read"), "asked_ms", F.lit(None).cast("long").alias("applied_ms"))
    order = Window.partitionBy("b").orderBy(F.desc("at"), F.col("read").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    near = facts.union(asked).withColumn("own_ms", F.last("applied_ms", ignorenulls=True).over(order)).where("read IS NOT NULL")
    out = near.join(heads, "b")
    done = F.coalesce("own_ms", "next_ms")
    return out.select("read", F.when(done <= F.col("asked_ms") + patience_ms, F.greatest(done, F.col("asked_ms"))).alias("applied_ms"))


# storage layer: puts and deletes without clients


def storage_state(log: DataFrame) -> DataFrame:
    """log(seq, op, k, v), op 1 put and 2 delete: the last writer wins."""
    last = log.groupBy("k").agg(F.max_by(F.struct("op", "v"), "seq").alias("last"))
    return last.where("last.op = 1").select("k", F.col("last.v").alias("val"))


def storage_len(log: DataFrame) -> DataFrame:
    return storage_state(log).agg(F.count("*").alias("live"))
