"""Every query against DuckDB, and operators against hand-made and brute-force cases."""

import json
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerlens import config
from ledgerlens.functions import scalars
from ledgerlens.operators import control, elections, health, kv, recurrences, replog, telemetry
from ledgerlens.plans import registry
from ledgerlens.sinks import audit_log, snapshots
from ledgerlens.sources import binary
from ledgerlens.streaming import pipelines

DATA = "/root/testdata/sf0.001"
LOG = "idx long, op int, client_id string, request_id long, k string, v string, expect string"


def same(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    df = registry.QUERIES[name](spark, DATA)
    con = duckdb.connect()
    for t in ("events", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    cur = con.execute(registry.ORACLE_SQL[name])
    names, theirs = [d[0] for d in cur.description], cur.fetchall()
    assert sorted(names) == sorted(df.columns)
    ours = df.select(*[f"`{n}`" for n in names]).collect()
    key = lambda rows: sorted(repr(tuple(same(v) for v in r)) for r in rows)
    assert key(ours) == key(theirs)


def log(spark, rows):
    return spark.createDataFrame(rows, LOG)


# the state machine


class Machine:
    """The rules once more, one command at a time."""

    def __init__(self):
        self.data, self.done, self.feed = {}, {}, []

    def apply(self, idx, op, client, request, k, v, expect):
        tracked = client != "" and request != 0
        if tracked and (client, request) in self.done:
            return (*self.done[client, request], True)
        key = f"_checkpoint/{client}" if op == 4 else k
        now = self.data.get(key)
        found, value = False, None
        if op == 1:
            found, value = now is not None, now
        elif op == 2:
            found, value = True, now
            self.data[key] = v
            self.feed.append((idx, key, v))
        elif op == 3:
            value = now
            found = expect == "" if now is None else now == expect
            if found:
                self.data[key] = v
                self.feed.append((idx, key, v))
        elif op == 4:
            found, value = True, v
            self.data[key] = v
        if tracked:
            self.done[client, request] = (found, value)
        return found, value, False


def random_log(n, seed, swaps=True):
    rng = random.Random(seed)
    ops = [1, 2, 2, 4, 9] + [3, 3] * swaps
    return [(i, rng.choice(ops), rng.choice(["", "a", "b", "c"]), rng.randrange(40), rng.choice("xyz"), rng.choice(["", "p", "q"]), rng.choice(["", "p", "q"])) for i in range(1, n + 1)]


@pytest.mark.parametrize("swaps", [True, False])
def test_machine(spark, swaps):
    rows, m = random_log(400, int(swaps), swaps), Machine()
    want = {r[0]: m.apply(*r) for r in rows}
    df = log(spark, rows)
    assert {r.idx: (r.found, r.value, r.duplicate) for r in kv.apply(df).collect()} == want
    assert {r.key: r.value for r in kv.state(df).collect()} == m.data
    assert sorted((r.idx, r.key, r.new_value) for r in kv.watch(df).collect()) == m.feed
    assert {r.key for r in kv.watch(df, spark.createDataFrame([("x",)], "key string")).collect()} == {"x"}


def test_same_request_twice(spark):
    got = {r.idx: r.duplicate for r in kv.apply(log(spark, [(1, 2, "agent", 99, "x", "1", ""), (2, 2, "agent", 99, "x", "2", "")])).collect()}
    assert got == {1: False, 2: True}


def test_swaps(spark):
    rows = [(1, 2, "a", 1, "k", "old", ""), (2, 3, "a", 2, "k", "new", "old"), (3, 3, "a", 3, "k", "other", "old"), (4, 3, "a", 4, "none", "made", ""), (5, 3, "a", 5, "none2", "made", "x")]
    assert {r.idx: (r.swapped, r.value) for r in kv.cas(log(spark, rows)).collect()} == {2: (True, "old"), 3: (False, "new"), 4: (True, None), 5: (False, None)}
    assert {r.key: r.value for r in kv.state(log(spark, rows)).collect()} == {"k": "new", "none": "made"}


def test_reads_at_an_index(spark):
    rows = random_log(200, 5)
    m, states = Machine(), {0: {}}
    for r in rows:
        m.apply(*r)
        states[r[0]] = dict(m.data)
    reads = [(i, random.Random(i).choice(["x", "y", "none", "_checkpoint/a"]), i * 7 % 201) for i in range(60)]
    got = kv.get_as_of(log(spark, rows), spark.createDataFrame(reads, "read long, key string, at long")).collect()
    assert {r.read: (r.val, r.found) for r in got} == {i: (states[at].get(k), k in states[at]) for i, k, at in reads}


def test_interfaces_refuse_other_commands(spark):
    rows = [(1, 1, "a", 1, "k", "", ""), (2, 2, "a", 2, "k", "v", ""), (3, 4, "a", 3, "", "blob", ""), (4, 9, "a", 4, "k", "", "")]
    local = {r.idx: r.error for r in kv.execute_once(log(spark, rows)).collect()}
    remote = {r.idx: r.error for r in kv.execute_once(log(spark, rows), remote=True).collect()}
    assert local == {1: "unsupported op 1", 2: None, 3: None, 4: "unsupported op 9"} and remote[3] == "unsupported op 4" and remote[2] is None


def test_snapshot_points(spark):
    rows = [(1, i, 300 if 500 <= i < 520 else 0, i in (256, 257)) for i in range(1, 1200)]
    got = kv.snapshot_points(spark.createDataFrame(rows, "node_id long, idx long, ahead long, fails boolean"), 256).collect()
    assert sorted(r.idx for r in got) == [258, 520, 776, 1032]


@pytest.mark.parametrize("cut", [0, 1, 150, 400])
def test_recovery_from_a_snapshot(spark, tmp_path, cut):
    rows, m = random_log(400, 9), Machine()
    want = {r[0]: m.apply(*r) for r in rows}
    df, path = log(spark, rows), str(tmp_path / "s")
    assert snapshots.load(spark, path).data.count() == 0
    if cut:
        snapshots.save(snapshots.empty(spark), df, path, cut)
    base = snapshots.load(spark, path)
    assert base.idx == cut and {r.key: r.value for r in snapshots.recover(base, df).collect()} == m.data
    assert {r.idx: (r.found, r.value, r.duplicate) for r in snapshots.replay(base, df).collect()} == {i: x for i, x in want.items() if i > cut}
    again = snapshots.save(base, df, path, 400)
    assert {r.client_id: r.top for r in again.clients.collect()} == {c: max(r for d, r in m.done if d == c) for c, _ in m.done} and again.meta.first().applies == len(m.done)
    assert {(r.client_id, r.request_id): (r.found, r.value) for r in snapshots.load(spark, path).dedup.collect()} == m.done


def test_snapshot_keeps_duplicates_out(spark, tmp_path):
    path = str(tmp_path / "s")
    snapshots.save(snapshots.empty(spark), log(spark, [(1, 2, "c", 1, "a", "1", ""), (2, 2, "c", 2, "b", "2", "")]), path, 2)
    base = snapshots.load(spark, path)
    tail = log(spark, [(3, 2, "c", 1, "a", "other", "")])
    assert [r.duplicate for r in snapshots.replay(base, tail).collect()] == [True]
    assert {r.key: r.value for r in snapshots.recover(base, tail).collect()} == {"a": "1", "b": "2"}


def test_storage_log(spark):
    rows = [(1, 1, "a", "1"), (2, 1, "b", "2"), (3, 1, "c", "3"), (4, 1, "a", "100"), (5, 2, "b", ""), (6, 2, "none", "")]
    df = spark.createDataFrame(rows, "seq long, op int, k string, v string")
    assert {r.k: r.val for r in kv.storage_state(df).collect()} == {"a": "100", "c": "3"} and kv.storage_len(df).first().live == 2


def brute_sweep(rows, limit, every, window):
    applied, top, count, out, most = set(), {}, 0, {}, 0
    for idx, client, request in sorted(rows):
        tracked = bool(client) and bool(request)
        out[idx] = tracked and (client, request) in applied
        if tracked and not out[idx]:
            applied.add((client, request))
            top[client] = max(top.get(client, 0), request)
            count += 1
            if len(applied) >= limit and count % every == 0:
                applied = {(c, r) for c, r in applied if r + window >= top[c]}
            most = max(most, len(applied))
    return out, most


def test_sweep(spark):
    rows = [(i, 2, "" if i % 3 == 0 else "ab"[i % 2], i * 7 % 50 + i // 4, "k", "v", "") for i in range(1, 400)]
    for sizes in ((16, 8, 4), (8, 5, 20), (10_000, 8, 4)):
        got = {r.idx: r.duplicate for r in recurrences.dedup_sweep(log(spark, rows), *sizes).collect()}
        assert got == brute_sweep([(r[0], r[2], r[3]) for r in rows], *sizes)[0]


def test_sweep_bounds_the_table(spark):
    n = 16384 + 1024 + 128 + 100
    rows = [(i, "a", i) for i in range(1, n + 1)] + [(n + 1, "a", n), (n + 2, "a", 1)]
    want, most = brute_sweep(rows, 16384, 1024, 128)
    got = recurrences.dedup_sweep(spark.createDataFrame(rows, "idx long, client_id string, request_id long")).where(F.col("idx") > n).collect()
    assert most <= 16384 + 1024 and {r.idx: r.duplicate for r in got} == {n + 1: True, n + 2: False} == {i: want[i] for i in (n + 1, n + 2)}


# replicated logs


def raft_log(spark, entries, first=(0, 0), node=1):
    return spark.createDataFrame([(node, *first, True)] + [(node, i, t, False) for i, t in entries], "node_id long, log_index long, term long, sentinel boolean")


def test_recovery_of_a_log(spark):
    rows = [(1, 0, 2, 1, 1, 0), (1, 1, 2, 1, 2, 0), (1, 2, 1, 2, 0, 3), (1, 3, 3, 0, 2, 0), (1, 4, 2, 2, 2, 0), (1, 5, 2, 2, 3, 0), (2, 0, 2, 1, 1, 0)]
    wal = spark.createDataFrame(rows, "node_id long, seq long, tag int, term long, index_or_from long, voted_for long")
    assert sorted((r.node_id, r.log_index, r.term) for r in replog.surviving(wal).collect()) == [(1, 1, 1), (1, 2, 2), (1, 3, 2), (2, 1, 1)]
    assert sorted(map(tuple, replog.hard_state(wal).collect())) == [(1, 2, 3), (2, 0, 0)]
    got = replog.recover(wal, spark.createDataFrame([(1, 2, 2)], "node_id long, pos long, term long"))
    assert sorted((r.node_id, r.log_index, r.sentinel) for r in got.collect()) == [(1, 2, True), (1, 3, False), (2, 0, True), (2, 1, False)]
    again = snapshots.rewritten(got, replog.hard_state(wal))
    assert sorted(map(tuple, replog.surviving(again).collect())) == [(1, 3, 2), (2, 1, 1)] and sorted(map(tuple, replog.hard_state(again).collect())) == [(1, 2, 3), (2, 0, 0)]


def test_log_records_are_appended_by_node(spark, tmp_path):
    rows = [(1, 0, 2, 1, 1, 0), (2, 0, 1, 4, 0, 2), (1, 1, 2, 1, 2, 0)]
    wal = spark.createDataFrame(rows, "node_id long, seq long, tag int, term long, index_or_from long, voted_for long")
    for part in (wal.where("seq = 0"), wal.where("seq = 1")):
        snapshots.persist(part, str(tmp_path / "wal"))
    back = spark.read.parquet(str(tmp_path / "wal"))
    assert sorted(map(tuple, back.select(*wal.columns).collect())) == sorted(rows)


def brute_append(ours, first, prev, prev_term, entries):
    """ours: terms by index beyond the sentinel ``first`` (index, term)."""
    terms = {first[0]: first[1]} | ours
    last = max(terms)
    if prev > last:
        return ("short", last + 1, 0), None
    if prev >= first[0] and terms.get(prev) != prev_term:
        run = [i for i, t in sorted(ours.items()) if t == terms[prev]]
        return ("conflict", run[0] if run else first[0] + 1, terms[prev]), None
    out = dict(ours)
    for i, t in entries:
        if i <= first[0] or out.get(i) == t:
            continue
        if i in out:
            out = {j: u for j, u in out.items() if j < i}
        out[i] = t
    return ("ok", 0, 0), out


def test_appends(spark):
    rng = random.Random(2)
    logs, asks, entries, want = [], [], [], {}
    for node in range(1, 60):
        first = (rng.randrange(5), rng.randrange(1, 3))
        term, ours = first[1], {}
        for i in range(first[0] + 1, first[0] + 1 + rng.randrange(12)):
            term += rng.random() < 0.3
            ours[i] = term
        prev = rng.randrange(first[0] + 14)
        prev_term = ({first[0]: first[1]} | ours).get(prev, 1) if rng.random() < 0.7 else rng.randrange(1, 5)
        new, t = [], prev_term
        for i in range(prev + 1, prev + 1 + rng.randrange(1, 7)):
            t = max(t, ours.get(i, t)) if rng.random() < 0.8 else t + 1
            new.append((i, t))
        logs += [(node, *first, True)] + [(node, i, t, False) for i, t in ours.items()]
        asks.append((node, node, prev, prev_term))
        entries += [(node, i, t) for i, t in new]
        want[node] = brute_append(ours, first, prev, prev_term, new)
    df = spark.createDataFrame(logs, "node_id long, log_index long, term long, sentinel boolean")
    got = {r.node_id: (r.outcome, r.conflict_index, r.conflict_term) for r in replog.append_conflict(df, spark.createDataFrame(asks, "node_id long, request long, prev_index long, prev_term long")).collect()}
    assert got == {n: w[0] for n, w in want.items()} and {w[0][0] for w in want.values()} == {"short", "conflict", "ok"}
    merged = {}
    for r in replog.merge(df, spark.createDataFrame(entries, "node_id long, log_index long, term long")).collect():
        merged.setdefault(r.node_id, {})[r.log_index] = r.term
    firsts = {n: i for n, i, _, s in logs if s}
    for n, (_, out) in want.items():
        if out is not None:
            assert {i: t for i, t in merged[n].items() if i != firsts[n]} == out


def test_compaction_and_snapshots(spark):
    df = raft_log(spark, [(i, 1 + i // 4) for i in range(3, 13)], (2, 1))
    cut = lambda at, applied, retain: replog.snapshot_cuts(df, spark.createDataFrame([(1, at, applied)], "node_id long, pos long, applied long"), retain).first()
    assert cut(2, 12, 3).status == "done" and cut(9, 8, 3).status == "beyond applied" and cut(20, 30, 3).status == "not in log"
    assert (cut(9, 12, 3).status, cut(9, 12, 3).cut, cut(9, 12, 3).term) == ("ok", 6, 2) and cut(9, 12, -1).cut == 9 and cut(9, 12, 100).term is None
    after = replog.raft_compact(df, spark.createDataFrame([(1, 9, 12)], "node_id long, pos long, applied long"), 3)
    assert tuple(replog.bounds(after).first()) == (1, 6, 12, 4)
    for offer, first in (((1, 8, 3, 5), 8), ((1, 5, 2, 5), 2), ((1, 50, 9, 5), 50)):
        got = replog.install_snapshot(df, spark.createDataFrame([offer], "node_id long, pos long, term long, commit_index long"))
        assert replog.bounds(got).first().first_index == first
    assert sorted(map(tuple, replog.snapshot_cursors(spark.createDataFrame([(1, 8, 2, 5), (2, 4, 2, 5)], "node_id long, pos long, applied long, commit_index long")).collect())) == [(1, True, 8, 8), (2, False, 5, 2)]


def test_commit_needs_a_majority_and_the_current_term(spark):
    rows = [(1, 1, 10, 1, 0), (1, 2, 10, 1, 9), (1, 3, 10, 1, 3), (2, 1, 12, 2, 0), (2, 2, 12, 2, 10), (2, 3, 12, 2, 4), (3, 1, 12, 2, 0), (3, 2, 12, 2, 11), (3, 3, 12, 2, 11)]
    df = spark.createDataFrame(rows, "tick long, node_id long, last_index long, term long, match_index long")
    # of three nodes the leader and one more: 9; then 10 is of an old term; then 11
    assert [r.commit_index for r in replog.commit_index(df, 1).orderBy("tick").collect()] == [9, 9, 11]


def test_follower_commit(spark):
    df = spark.createDataFrame([(1, 1, 10, 2, 20, 5), (1, 2, 10, 2, 11, 5), (1, 3, 3, 1, 20, 8), (1, 4, 10, 2, 4, 5)], "node_id long, request long, prev_index long, n_entries long, leader_commit long, commit_index long")
    assert {r.request: r.commit_index for r in replog.follower_commit(df).collect()} == {1: 12, 2: 11, 3: 8, 4: 5}


def test_next_index(spark):
    df = raft_log(spark, [(1, 1), (2, 1), (3, 2)])
    asks = spark.createDataFrame([(1, 1, 1, 7, 9), (1, 2, 5, 7, 9), (1, 3, 0, 4, 9), (1, 4, 0, 0, 9), (1, 5, 0, 0, 1), (1, 6, 5, 0, 9)], "node_id long, request long, conflict_term long, conflict_index long, next_index long")
    assert {r.request: r.next_index for r in replog.next_index_repair(df, asks).collect()} == {1: 3, 2: 7, 3: 4, 4: 8, 5: 1, 6: 1}


# elections and watchdogs


def test_votes(spark):
    schema = "event_id long, term long, candidate_id long, voter_id long, cand_last_term long, cand_last_index long, voter_last_term long, voter_last_index long, voter_term long, leader_id long, heard_ms long"
    one = lambda i, term, cand, last=9, leader=0, heard=0: (i, term, cand, 1, 1, last, 1, 5, 3, leader, heard)
    rows = [one(1, 4, 2), one(2, 4, 3), one(3, 4, 2), one(4, 3, 3), one(5, 6, 3, leader=2, heard=100), one(6, 5, 3, last=4), one(7, 5, 4), one(8, 7, 5, leader=2, heard=800)]
    got = {r.event_id: (r.granted, r.response_term) for r in elections.vote_grants(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: (True, 4), 2: (False, 4), 3: (True, 4), 4: (False, 4), 5: (False, 4), 6: (False, 5), 7: (True, 5), 8: (True, 7)}
    pre = {r.event_id: r.granted for r in elections.pre_vote(spark.createDataFrame(rows, schema)).collect()}
    assert pre == {1: True, 2: True, 3: True, 4: False, 5: False, 6: False, 7: True, 8: True}


def test_tally(spark):
    votes = [(4, v, 2, v < 5, 4) for v in range(3, 8)] + [(5, v, 3, v < 6, 6 if v == 7 else 5) for v in range(4, 8)]
    got = elections.election_tally(spark.createDataFrame(votes, "term long, voter_id long, candidate_id long, granted boolean, response_term long"), 5).collect()
    assert {(r.term, r.votes, r.won) for r in got} == {(4, 3, True), (5, 3, False)}


def test_wedged_leader_is_deposed_and_an_idle_one_is_not(spark):
    wedged = spark.createDataFrame([(i, 10, min(i, 3), i != 9) for i in range(12)], "tick long, last_index long, commit_index long, quorum boolean")
    idle = spark.createDataFrame([(i, 3, 3, True) for i in range(12)], "tick long, last_index long, commit_index long, quorum boolean")
    assert [r.tick for r in elections.commit_stall(wedged, 5).where("fires").orderBy("tick").collect()] == [8, 10, 11]
    assert elections.commit_stall(idle, 5).where("fires").count() == 0 and elections.commit_stall(wedged, -1).where("fires").count() == 0


def test_backoff(spark):
    got = elections.backoff_bounds(spark.createDataFrame([(i,) for i in range(6)], "attempts int")).orderBy("attempts").collect()
    assert [(r.low_ms, r.high_ms) for r in got] == [(750, 1500), (750, 2250), (750, 3750), (750, 6750), (750, 6750), (750, 6750)]


# health and audit


def observed(spark, rows):
    return spark.createDataFrame([(t, 7 if q else 3, 7, q, lead, term, c, s, ok) for t, q, lead, term, c, s, ok in rows], "tick long, alive long, total long, quorum boolean, leader_id long, term long, max_commit long, stepdowns long, readable boolean")


def events(spark, rows, stall=60):
    return [(r.tick, r.event) for r in health.audit_events(observed(spark, rows), stall).orderBy("tick", "ord").collect()]


def test_audit_tells_a_stall_once(spark):
    ticks = [(0, 100), (5, 110), (10, 120), (30, 120), (75, 120), (80, 120), (85, 120), (90, 130)]
    got = events(spark, [(t, True, 1, 3, c, 0, True) for t, c in ticks])
    assert got == [(0, "controlplane_started"), (75, "progress_stalled"), (90, "progress_resumed")]


def test_audit_without_a_leader_has_no_stall(spark):
    got = events(spark, [(5 * i, i == 0, 0 if i else 1, 3, 100, 0, True) for i in range(40)])
    assert got == [(0, "controlplane_started"), (5, "quorum_lost")]


def test_audit_edges(spark):
    rows = [(0, True, 1, 3, 1, 0, True), (5, False, 0, 3, 1, 0, True), (10, True, 1, 3, 2, 0, False), (15, True, 2, 4, 3, 0, True), (20, True, 2, 4, 4, 1, True), (25, True, 2, 4, 5, 3, False), (30, True, 2, 4, 6, 3, True)]
    assert events(spark, rows) == [(0, "controlplane_started"), (5, "quorum_lost"), (10, "quorum_regained"), (10, "leader_changed"), (15, "leader_changed"), (20, "watchdog_stepdown"), (30, "watchdog_stepdown")]


def test_audit_equals_the_step(spark):
    rng = random.Random(4)
    rows, c = [], 0
    for t in range(300):
        c += rng.random() < 0.2
        rows.append((t, rng.random() < 0.9, rng.choice([0, 1, 1, 1, 2]), t // 20, c, t // 60, rng.random() < 0.7))
    state, want = None, []
    for t, q, lead, _, c, s, ok in rows:
        state, (_, _, found) = pipelines.audit_step(6)(state, (0, t, q, lead, c, s, ok))
        want += [(t, e.split("|")[1]) for e in found]
    assert events(spark, rows, 6) == want


def test_quorum_clock(spark):
    df = spark.createDataFrame(list(enumerate([True, True, False, False, True, True, False, False])), "tick long, quorum boolean")
    assert [r.since for r in health.since_quorum_loss(df).orderBy("tick").collect()] == [-1, -1, 0, 1, 2, 3, 0, 1]


def test_heals(spark):
    rows = [(1, 0, 1, "kill"), (2, 5, 1, "partition"), (3, 5, 2, "kill"), (4, 6, 2, "restart"), (5, 7, 3, "kill")]
    df = spark.createDataFrame(rows, "seq long, at_ms long, node_id long, action string")
    assert {(r.node_id, r.kind, r.due_in) for r in health.pending_heals(df, 10, 30).collect()} == {(1, "reconnect", 25), (3, "start", 27)}
    assert health.pending_heals(df.union(spark.createDataFrame([(6, 8, 0, "reset")], df.schema)), 10, 30).count() == 0
    assert {r.node_id for r in health.pending_heals(df, 36, 30).collect()} == {3}


def test_node_listing(spark):
    body = json.dumps({"ok": True, "id": 1, "term": 4, "commitIndex": 9, "leaderId": 2, "isLeader": False, "role": "follower"})
    rows = [(0, 1, True, "true running", '{"mesh":{}}', 200, body), (0, 2, True, "true running", '{"other":{}}', 200, body), (0, 3, False, "", "", 0, ""), (0, 4, True, "true", "", 200, body), (0, 5, True, "true running", '{"mesh":{}}', 503, body), (0, 65, True, "true running", '{"mesh":{}}', 200, body)]
    got = {r.node_id: r for r in health.node_status(spark.createDataFrame(rows, "tick long, node_id long, ok boolean, out string, networks string, code int, body string"), "mesh").collect()}
    assert set(got) == {1, 2, 3, 4, 5} and (got[1].term, got[1].commit_index, got[1].reported_leader, got[1].role) == (4, 9, 2, "follower")
    assert got[2].partitioned and got[2].term == 0 and got[3].status == got[4].status == "unknown" and got[5].running and got[5].term == 0
    assert {(r.node_id, r.action) for r in health.reconcile_plan(health.node_status(spark.createDataFrame(rows, "tick long, node_id long, ok boolean, out string, networks string, code int, body string"), "mesh"), spark.createDataFrame([], "tick long, node_id long")).collect()} == {(2, "reconnect")}


def test_audit_log_is_rotated_and_read_back(spark, tmp_path):
    path = str(tmp_path / "audit")
    assert audit_log.tail(spark, path, 5).count() == 0
    entries = lambda a, b: spark.createDataFrame([(i, f"event {i}") for i in range(a, b)], "tick long, event string")
    for n in range(3):
        audit_log.append(entries(10 * n, 10 * n + 10), path, n, ["tick"])
    audit_log.append(entries(20, 30), path, 2, ["tick"])  # a repeated batch
    assert [json.loads(r.line)["tick"] for r in audit_log.tail(spark, path, 12).orderBy("place").collect()] == list(range(18, 30))
    assert audit_log.tail(spark, path, 0).count() == 30
    audit_log.append(entries(30, 31), path, 3, ["tick"], most_bytes=10)
    audit_log.append(entries(31, 32), path, 4, ["tick"])
    assert [json.loads(r.line)["tick"] for r in audit_log.tail(spark, path, 5).collect()] == [31] and os.path.exists(f"{path}/current.1")


# telemetry and control


def test_rates_survive_resets(spark):
    rows = [(t, t, 1, v, int(t < 3), 0, 0) for t, v in enumerate([5, 9, 2, 2, 8])]
    df = spark.createDataFrame(rows, "ts long, tick long, instance long, writes_total long, is_leader int, stepdowns long, applies_total long")
    assert [r.rate for r in telemetry.rates(df, "writes_total", 1.0).orderBy("tick").collect()] == [0, 4, 2, 0, 6]
    assert [r.rate for r in telemetry.rates(df, "writes_total", 1.0, 2).orderBy("tick").collect()] == [0, 2, 3, 1, 3]
    assert [r.tick for r in telemetry.leader_rate(df, "writes_total", 1.0).orderBy("tick").collect()] == [0, 1, 2]


def test_alerts_wait(spark):
    df = spark.createDataFrame([(i, i not in (0, 4)) for i in range(9)], "tick long, hit boolean")
    assert [r.tick for r in telemetry.held_for(df, 2).where("firing").orderBy("tick").collect()] == [3, 7, 8]


def test_host_figures_need_all_readings(spark):
    rows = [(0, 1, 0.0, 10.0, 4.0), (1, 1, 0.5, 10.0, 4.0), (2, 1, 1.0, 0.0, 4.0), (3, 1, 1.0, 10.0, None), (4, 1, 1.0, 10.0, 12.0)]
    got = telemetry.host_mem_used(spark.createDataFrame(rows, "tick long, cpu long, idle_seconds double, mem_total double, mem_available double"), 1.0).orderBy("tick").collect()
    assert [(r.ok, r.busy, r.used) for r in got] == [(True, 100.0, 6.0), (True, 50.0, 6.0), (False, 0.0, 0.0), (False, 0.0, 0.0), (True, 100.0, 0.0)]


def test_cooldown_is_not_extended_by_refusals(spark):
    df = spark.createDataFrame([(1, 0, "a"), (2, 1, "a"), (3, 2, "a"), (4, 3, "b"), (5, 3, ""), (6, 4, None), (7, 9, "a")], "event_id long, t long, ip string")
    got = recurrences.cooldown(df, 2).collect()
    assert {r.event_id for r in got if r.accepted} == {1, 3, 4, 5, 7} and {r.ip for r in got} == {"a", "b", "unknown"}


def test_batches_and_leases(spark):
    rows = [(p, i, t) for p in (1, 2) for i, t in enumerate([0, 1, 5, 6, 7, 30, 31, 32, 36, 37])]
    df = spark.createDataFrame(rows, "part long, idx long, t long")
    assert [r.batch for r in recurrences.batches(df, 5, 3).where("part = 2").orderBy("idx").collect()] == [0, 0, 0, 3, 3, 5, 5, 5, 8, 8]
    got = recurrences.lease(df.withColumn("term", (F.col("t") > 31).cast("long")), 5).where("part = 1").orderBy("idx").collect()
    assert [r.leased for r in got] == [False, True, False, True, True, False, True, False, True, False]


def test_presence_is_never_negative(spark):
    rng = random.Random(6)
    rows = [(i, i // 7, rng.choice([1, -1, -1])) for i in range(200)]
    n, want = 0, {}
    for i, _, d in rows:
        n = max(0, n + d)
        want[i] = n
    assert {r.event_id: r.viewers for r in control.active_viewers(spark.createDataFrame(rows, "event_id long, tick long, delta int")).collect()} == want


def test_answers_of_a_metrics_server(spark):
    bodies = ['{"status":"success","data":{"result":[{"value":[1,"2.5"]},{"value":[1,"9"]}]}}', '{"status":"success","data":{"result":[]}}', "oops", '{"status":"error"}', '{"status":"success","data":{"result":[{"value":[1,"x"]}]}}']
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, body string")
    assert [r.x for r in df.select("i", scalars.instant(F.col("body")).alias("x")).orderBy("i").collect()] == [2.5, None, None, None, None]


def test_heartbeats_use_a_number_again(spark):
    df = spark.createDataFrame([(0, True), (1, False), (2, False), (3, True), (4, True)], "tick long, ok boolean")
    assert [r.request_id for r in control.heartbeats(df).orderBy("tick").collect()] == [1, 2, 2, 2, 3]


def test_settings():
    read = lambda **env: config.Config.read({"NODE_ID": "2", **env})
    assert read().snapshot_every == 10_000 and read(SNAPSHOT_ENTRIES="5").snapshot_every == 512 and read(SNAPSHOT_ENTRIES="x").snapshot_every == 10_000
    assert read(RAFT_COMMIT_STALL_TIMEOUT="-1s").stall_s == -1 and read(RAFT_ELECTION_TIMEOUT_MIN="1.5s").election_ms == (1500, 1500) and read(RAFT_ELECTION_TIMEOUT_MIN="-1s").election_ms[0] == 750
    assert read(PEERS=" 1=a:1, ,2=b:2").raft_peers == {1: "a:1", 2: "b:2"} and read(SNAPSHOT_RETAIN="-1").retain == -1
    for env in ({"NODE_ID": "0"}, {"PEERS": "bad"}, {"RUN_AGENT": "TRUE"}):
        with pytest.raises(ValueError):
            read(**env)


# binary records and streams


def test_frames_and_records(spark, tmp_path):
    assert binary.crc32c(b"123456789") == 0xE3069283 and binary.crc32c(b"") == 0
    record = lambda k, v: b"\1" + len(k).to_bytes(4, "big") + k + v
    good = [binary.frame(record(f"k{i}".encode(), b"v")) for i in range(3)]
    bad = b"\0\0\0\1\0\0\0\0x"
    assert len(list(binary.frames(b"".join(good) + b"\1\2\3"))) == 3 and len(list(binary.frames(b"".join(good), 2))) == 3
    assert len(list(binary.frames(good[0] + bad + good[1]))) == 1
    (tmp_path / "a.wal").write_bytes(good[0] + good[1] + bad)
    (tmp_path / "b.wal").write_bytes(good[2] + b"\1\2\3")
    rows = binary.storage_decode(binary.scan_frames(spark, str(tmp_path))).orderBy("path", "seq").collect()
    assert [(r.seq, r.offset, r.op, r.k, r.v) for r in rows] == [(0, 16, 1, "k0", "v"), (1, 32, 1, "k1", "v"), (0, 16, 1, "k2", "v")]
    assert binary.scan_frames(spark, str(tmp_path / "none")).count() == 0


def test_short_and_odd_records(spark):
    df = spark.createDataFrame([(3, "agent-1", 42, "balance", "100", "50"), (2, "", 0, "", "", "")], "op int, client_id string, request_id long, k string, expect string, v string")
    full = df.select(binary.kv_payload(*[F.col(c) for c in df.columns]).alias("payload"))
    assert sorted(map(tuple, binary.kv_decode(full).collect())) == sorted((*r, None) for r in map(tuple, df.collect()))
    data = bytes(full.first().payload)
    cut = spark.createDataFrame([(i, data[:i]) for i in range(len(data))], "n int, payload binary")
    short = {r.n for r in binary.kv_decode(cut).where("error IS NOT NULL").collect()}
    assert short == set(range(len(data) - 2))  # the value is what is left and may be empty
    records = [binary.encode_raft(1, 7, 3), binary.encode_raft(2, 7, 300, b"d"), binary.encode_raft(3, 0, 9), b"\4abc", b"", b"\1abc", b"\2\x08", b"\2\x1a\x05ab"]
    got = binary.raft_decode(spark.createDataFrame(list(enumerate(records)), "n int, payload binary")).orderBy("n").collect()
    assert [(r.tag, r.term, r.index_or_from, r.voted_for) for r in got[:3]] == [(1, 7, 0, 3), (2, 7, 300, 0), (3, 0, 9, 0)] and all(r.error for r in got[3:])


def test_raft_snapshot_files(spark, tmp_path):
    (tmp_path / "s").write_bytes((9).to_bytes(8, "big") + (4).to_bytes(8, "big") + b"rest")
    files = spark.read.format("binaryFile").load(str(tmp_path / "s"))
    got = snapshots.raft_snapshot(files).first()
    assert (got.pos, got.term, bytes(got.data)) == (9, 4, b"rest")
    (tmp_path / "t").write_bytes(b"short")
    with pytest.raises(Exception, match="short snapshot"):
        snapshots.raft_snapshot(spark.read.format("binaryFile").load(str(tmp_path / "t"))).collect()


def test_streams_refuse_rows_out_of_order(spark, tmp_path):
    df = spark.createDataFrame([(i, 10 - i if i > 5 else i, "a") for i in range(10)], "event_id long, t long, ip string")
    with pytest.raises(Exception, match="came after"):
        pipelines.run_to_end(df, "event_id", 2, lambda s: pipelines.cooldown(s, 2), str(tmp_path))


def test_rates_of_arrivals(spark, tmp_path):
    df = spark.sql("SELECT id, timestamp_seconds(id * 60) AS ts, id % 2 AS instance FROM range(600)")
    out = pipelines.run_to_end(df, "id", 3, lambda s: pipelines.arrivals(s), str(tmp_path))
    got = out.groupBy("start", "instance").agg(F.count("*").alias("n"), F.max("per_sec").alias("r")).collect()
    assert {r.n for r in got} == {1} and {round(r.r * 3600) for r in got} == {30} and len(got) >= 2 * 5
