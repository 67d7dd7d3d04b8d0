"""The registered queries once more, as SQL that DuckDB runs on the same tables.

Written from the rules and not from the operators: folds are recursive queries,
truncations are anti-joins, runs are found by counting, as-of reads are as-of joins.
"""

from __future__ import annotations

ONCE = """x AS (SELECT *, min(idx) OVER (PARTITION BY client_id, request_id, CASE WHEN client_id <> '' AND request_id <> 0 THEN 0 ELSE idx END) AS first_idx FROM kv_log),
e AS (SELECT *, CASE WHEN op = 4 THEN '_checkpoint/' || client_id ELSE k END AS key FROM x WHERE idx = first_idx)"""
# one recursive step for each command of a key
FOLD = f"""WITH RECURSIVE {ONCE}, o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY idx) AS n FROM e),
f AS (SELECT key, idx, n, op, v, client_id, request_id, CASE WHEN op IN (2, 4) THEN v WHEN op = 3 AND expect = '' THEN v END AS after, CAST(NULL AS VARCHAR) AS held, CASE WHEN op = 3 THEN expect = '' ELSE op IN (2, 4) END AS found FROM o WHERE n = 1
  UNION ALL
  SELECT o.key, o.idx, o.n, o.op, o.v, o.client_id, o.request_id, CASE WHEN o.op IN (2, 4) THEN o.v WHEN o.op = 3 AND coalesce(f.after, '') = o.expect THEN o.v ELSE f.after END, f.after,
    CASE o.op WHEN 1 THEN f.after IS NOT NULL WHEN 3 THEN coalesce(f.after, '') = o.expect ELSE true END
  FROM f JOIN o ON o.key = f.key AND o.n = f.n + 1),
a AS (SELECT idx, found, CASE WHEN op = 4 THEN after ELSE held END AS value FROM f),
last AS (SELECT key, arg_max(after, idx) AS value FROM f WHERE after IS NOT NULL GROUP BY key)"""
APPLY = f"{FOLD} SELECT x.idx, a.found, a.value, x.idx <> x.first_idx AS duplicate FROM x JOIN a ON a.idx = x.first_idx"


def only(ops: str) -> str:
    once = APPLY.replace("FROM kv_log)", f"FROM kv_log WHERE op IN ({ops}))")
    return f"SELECT l.idx, CASE WHEN l.op NOT IN ({ops}) THEN 'unsupported op ' || l.op END AS error, r.found, r.value, r.duplicate FROM kv_log l LEFT JOIN ({once}) r USING (idx)"


def greedy(source: str, closes: str, result: str, key: str = "part") -> str:
    """A fold whose state is when something last began, one recursive step a row."""
    return f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY t, idx) AS n FROM ({source}) s),
f AS (SELECT o.*, t AS began, 1 AS size, idx AS name, true AS opens FROM o WHERE n = 1
  UNION ALL SELECT o.*, CASE WHEN {closes} THEN o.t ELSE f.began END, CASE WHEN {closes} THEN 1 ELSE f.size + 1 END, CASE WHEN {closes} THEN o.idx ELSE f.name END, {closes}
  FROM f JOIN o ON o.{key} = f.{key} AND o.n = f.n + 1) SELECT {result} FROM f"""


def items(ops: str, more: str = "") -> str:
    return f"SELECT node_id AS part, idx, t{more} FROM kv_log WHERE op IN ({ops})"


LOG = """live AS (SELECT w.node_id, w.index_or_from AS log_index, w.term FROM raft_wal w
  WHERE w.tag = 2 AND NOT EXISTS (SELECT 1 FROM raft_wal m WHERE m.tag = 3 AND m.node_id = w.node_id AND m.seq > w.seq AND m.index_or_from <= w.index_or_from)),
rlog AS (SELECT live.node_id, log_index, live.term, false AS sentinel FROM live JOIN compactions c ON c.node_id = live.node_id AND log_index > c.pos UNION ALL SELECT node_id, pos, term, true FROM compactions),
lim AS (SELECT node_id, min(log_index) AS lo, max(log_index) AS hi FROM rlog GROUP BY node_id)"""
CUTS = f"""{LOG}, asked AS (SELECT s.node_id, s.pos, s.applied, lim.lo, l.term AS snap FROM snapshots s JOIN lim USING (node_id) LEFT JOIN rlog l ON l.node_id = s.node_id AND l.log_index = s.pos),
told AS (SELECT *, CASE WHEN pos <= lo THEN 'done' WHEN pos > applied THEN 'beyond applied' WHEN snap IS NULL THEN 'not in log' ELSE 'ok' END AS status FROM asked),
cuts AS (SELECT told.node_id, status, told.pos, CASE WHEN status = 'ok' THEN CASE WHEN told.pos > 64 THEN told.pos - 64 ELSE 0 END END AS cut FROM told),
known AS (SELECT cuts.*, l.term FROM cuts LEFT JOIN rlog l ON l.node_id = cuts.node_id AND l.log_index = cuts.cut)"""


def compacted(cuts: str) -> str:
    """Of nodes whose cut lies beyond the sentinel the rest and a new sentinel."""
    return f"""moved AS (SELECT c.node_id, c.pos, c.term FROM ({cuts}) c JOIN lim ON lim.node_id = c.node_id AND c.pos > lim.lo),
done AS (SELECT l.* FROM rlog l WHERE NOT EXISTS (SELECT 1 FROM moved m WHERE m.node_id = l.node_id) UNION ALL SELECT l.* FROM rlog l JOIN moved m ON m.node_id = l.node_id AND l.log_index > m.pos UNION ALL SELECT node_id, pos, term, true FROM moved)"""


SEEN = """seen AS (SELECT tick, node_id, running, partitioned, running AND NOT partitioned AS alive,
  if(running AND NOT partitioned, reported_leader, 0) AS named, running AND NOT partitioned AND is_leader AS leads, if(running AND NOT partitioned, term, 0) AS term, if(running AND NOT partitioned, commit_index, 0) AS commit_index FROM node_status_ticks)"""
ROLL = f"""{SEEN}, roll AS (SELECT g.tick, g.alive, g.total, g.alive > g.total // 2 AS quorum, coalesce(a.node_id, b.named, 0) AS leader_id, coalesce(a.term, b.term, 0) AS term, g.max_commit
  FROM (SELECT tick, count(*) FILTER (alive) AS alive, count(*) AS total, max(commit_index) AS max_commit, max(node_id) FILTER (leads) AS la, min(node_id) FILTER (named <> 0) AS lb FROM seen GROUP BY tick) g
  LEFT JOIN seen a ON a.tick = g.tick AND a.node_id = g.la LEFT JOIN seen b ON b.tick = g.tick AND b.node_id = g.lb)"""
# the observer's memory, carried from tick to tick
AUDIT = f"""WITH RECURSIVE {ROLL}, obs AS (SELECT *, tick // 50 AS steps, tick % 7 <> 0 AS readable, row_number() OVER (ORDER BY tick) AS n FROM roll),
m AS (SELECT n, tick, quorum, leader_id, max_commit, tick AS since, false AS stalled, if(readable, steps, NULL) AS known, ['0|controlplane_started|audit log opened'] AS events FROM obs WHERE n = 1
  UNION ALL SELECT o.n, o.tick, o.quorum, o.leader_id, o.max_commit, if(o.max_commit <> m.max_commit, o.tick, m.since),
    CASE WHEN o.max_commit <> m.max_commit THEN false ELSE m.stalled OR o.quorum AND o.leader_id <> 0 AND o.tick - m.since >= 6 END, if(o.readable, o.steps, m.known),
    list_filter([
      if(o.quorum <> m.quorum, if(o.quorum, '1|quorum_regained|', '1|quorum_lost|' || o.alive || ' of ' || o.total || ' alive'), NULL),
      if(o.leader_id <> 0 AND o.leader_id <> m.leader_id, '2|leader_changed|' || if(m.leader_id <> 0, 'node ' || o.leader_id || ' replaced node ' || m.leader_id, 'node ' || o.leader_id || ' now leader') || ' at term ' || o.term, NULL),
      if(o.max_commit <> m.max_commit AND m.stalled, '3|progress_resumed|commit index moving again after ' || (o.tick - m.since) || 's stalled at ' || m.max_commit, NULL),
      if(o.max_commit = m.max_commit AND NOT m.stalled AND o.quorum AND o.leader_id <> 0 AND o.tick - m.since >= 6, '3|progress_stalled|commit index frozen at ' || o.max_commit || ' for ' || (o.tick - m.since) || 's with quorum and a leader', NULL),
      if(o.readable AND o.steps > m.known, '4|watchdog_stepdown|commit-stall watchdog deposed a leader (' || o.steps || ' in total)', NULL)], lambda z: z IS NOT NULL)
  FROM m JOIN obs o ON o.n = m.n + 1),
ev AS (SELECT tick, unnest(events) AS e FROM m),
audit AS (SELECT tick, CAST(split_part(e, '|', 1) AS INTEGER) AS ord, split_part(e, '|', 2) AS event, split_part(e, '|', 3) AS detail FROM ev)"""
SAMPLES = "s AS (SELECT *, row_number() OVER (PARTITION BY instance ORDER BY ts) AS n FROM metric_samples)"


def grown(counter: str) -> str:
    """Increase of a counter in each tick by a self-join with the sample before."""
    return f"{SAMPLES}, g AS (SELECT a.tick, a.instance, sum(CASE WHEN b.n IS NULL THEN 0 WHEN a.{counter} < b.{counter} THEN a.{counter} ELSE a.{counter} - b.{counter} END) AS inc FROM s a LEFT JOIN s b ON b.instance = a.instance AND b.n = a.n - 1 GROUP BY a.tick, a.instance)"


LEADS = "leads AS (SELECT tick, instance FROM s QUALIFY row_number() OVER (PARTITION BY tick, instance ORDER BY ts DESC) = 1 AND is_leader = 1)"


def leader_rate(counter: str) -> str:
    return f"WITH {grown(counter)}, {LEADS} SELECT tick, round(sum(inc / 3600.0), 6) AS rate FROM g JOIN leads USING (tick, instance) GROUP BY tick"


def held(source: str, needed: int, by: str = "") -> str:
    """Ticks at which a condition has held at all evaluations since so long ago: the
    last evaluation without it must lie before the first of those."""
    part = f"PARTITION BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    return f"""z AS (SELECT *, max(tick) FILTER (NOT hit) OVER ({part} ORDER BY tick) AS off FROM ({source})),
zz AS (SELECT *, min(tick) FILTER (hit) OVER (PARTITION BY {lead}off) AS start FROM z) SELECT {lead}tick, hit AS pending, hit AND tick - start >= {needed} AS firing FROM zz"""


def window_sum(counter: str) -> str:
    return f"{grown(counter)}, w AS (SELECT a.tick, a.instance, sum(b.inc) AS inc FROM g a JOIN g b ON b.instance = a.instance AND b.tick BETWEEN a.tick - 1 AND a.tick GROUP BY a.tick, a.instance)"


def histogram(kind: str, column: str, bounds: str) -> str:
    return f"SELECT le, (SELECT count(*) FROM metric_samples WHERE {column} <= le) AS cumulative, (SELECT count({column}) FROM metric_samples) AS n, (SELECT round(sum({column}), 4) FROM metric_samples) AS total, '{kind}' AS kind FROM (SELECT unnest([{bounds}]::DOUBLE[]) AS le)"


GAUGES = "is_leader, term, commit_index, CASE role WHEN 'leader' THEN 2 WHEN 'candidate' THEN 1 WHEN 'follower' THEN 0 ELSE -1 END AS role_code, leader_id, stepdowns"
IDLE = """i AS (SELECT tick, cpu, idle_seconds, lag(idle_seconds) OVER (PARTITION BY cpu ORDER BY tick) AS p FROM host_samples),
busy AS (SELECT tick, round(100 * (1 - avg(CASE WHEN p IS NULL THEN 0 WHEN idle_seconds < p THEN idle_seconds ELSE idle_seconds - p END / 3600.0)), 6) AS busy FROM i GROUP BY tick)"""
BODY = "CASE WHEN code = 200 AND json_valid(body) THEN body END"
STATUS = f"""ins AS (SELECT tick, node_id, ok AND trim(out) LIKE '% %' AS known, split_part(trim(out), ' ', 1) AS a, regexp_extract(trim(out), '[^ ]+$') AS b, networks, {BODY} AS j FROM inspections),
st AS (SELECT tick, node_id, known AND a = 'true' AS running, if(known, b, 'unknown') AS status, known AND a = 'true' AND NOT contains(networks, '"mesh"') AS partitioned, if(known AND a = 'true' AND contains(networks, '"mesh"'), j, NULL) AS j FROM ins)"""


def heals(now: int, after: int) -> str:
    return f"""h AS (SELECT * FROM heal_actions WHERE seq > coalesce((SELECT max(seq) FROM heal_actions WHERE action = 'reset'), -1)),
hl AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM h l WHERE l.node_id = h.node_id AND l.seq > h.seq)),
heal AS (SELECT node_id, if(action = 'kill', 'start', 'reconnect') AS kind, at_ms + {after} - {now} AS due_in FROM hl WHERE action IN ('kill', 'partition') AND at_ms + {after} >= {now})"""


RING = f"{SEEN}, p AS (SELECT tick, node_id, row_number() OVER (PARTITION BY tick ORDER BY node_id) - 1 AS pos, count(*) OVER (PARTITION BY tick) AS n FROM seen WHERE alive)"
SNAP = f"{FOLD}, d AS (SELECT client_id, request_id, found, CASE WHEN op = 4 THEN after ELSE held END AS value FROM f WHERE client_id <> '' AND request_id <> 0)"
DAY = 86_400_000

ORACLES: dict[str, str] = {
    # command log
    "kv_apply": APPLY,
    "kv_state": f"{FOLD} SELECT key, value FROM last",
    "kv_exactly_once": "SELECT idx, CASE WHEN client_id = '' OR request_id = 0 THEN idx ELSE min(idx) OVER w END AS first_idx, client_id <> '' AND request_id <> 0 AND idx <> min(idx) OVER w AS duplicate FROM kv_log WINDOW w AS (PARTITION BY client_id, request_id)",
    "kv_get": f"{FOLD} SELECT k.key, value AS val, value IS NOT NULL AS found FROM (SELECT DISTINCT k AS key FROM kv_log UNION ALL SELECT 'k/none') k LEFT JOIN last USING (key)",
    "kv_get_as_of": f"{FOLD} SELECT r.idx AS read, r.k AS key, f.after AS val, f.after IS NOT NULL AS found FROM (SELECT * FROM kv_log WHERE op = 1) r ASOF LEFT JOIN f ON f.key = r.k AND r.idx >= f.idx",
    "kv_put_previous": f"{FOLD} SELECT idx, key, v, held AS previous FROM f WHERE op = 2",
    "kv_cas": f"{FOLD} SELECT idx, key, found AS swapped, held AS value FROM f WHERE op = 3",
    "kv_checkpoint": f"WITH {ONCE} SELECT key, arg_max(v, idx) AS val FROM e WHERE op = 4 GROUP BY key",
    "kv_read_checkpoint": f"WITH {ONCE}, c AS (SELECT client_id, arg_max(v, idx) AS val FROM e WHERE op = 4 GROUP BY client_id) SELECT client_id, val, val IS NOT NULL AS found FROM (SELECT DISTINCT client_id FROM kv_log UNION ALL SELECT 'nobody') LEFT JOIN c USING (client_id)",
    "kv_watch": f"{FOLD} SELECT idx, key, after AS new_value FROM f WHERE op = 2 OR op = 3 AND found",
    "kv_execute_once": only("2, 3, 4"),
    "kv_execute_once_remote": only("2, 3"),
    "kv_client_max_request": "SELECT idx, client_id, max(request_id) OVER (PARTITION BY client_id ORDER BY idx) AS max_request FROM kv_log",
    "kv_recent_results": "SELECT idx, client_id, request_id FROM kv_log WHERE NOT waited AND idx + 256 >= (SELECT max(idx) FROM kv_log WHERE NOT waited)",
    "kv_snapshot_points": """WITH RECURSIVE r AS (SELECT CAST(0 AS BIGINT) AS idx, CAST(1 AS BIGINT) AS node_id
      UNION ALL SELECT (SELECT min(a.idx) FROM applies a WHERE a.idx >= r.idx + 256 AND a.ahead <= 256 AND NOT a.fails), node_id FROM r WHERE r.idx IS NOT NULL) SELECT node_id, idx FROM r WHERE idx > 0""",
    "kv_dedup_sweep": "SELECT idx, client_id <> '' AND request_id <> 0 AND EXISTS (SELECT 1 FROM kv_log b WHERE b.client_id = a.client_id AND b.request_id = a.request_id AND b.idx < a.idx) AS duplicate FROM kv_log a",
    "kv_snapshot": f"{SNAP} SELECT 'data' AS part, key AS name, CAST(NULL AS BIGINT) AS request_id, CAST(NULL AS BOOLEAN) AS found, value AS val, CAST(NULL AS BIGINT) AS n FROM last UNION ALL SELECT 'dedup', client_id, request_id, found, value, NULL FROM d UNION ALL SELECT 'clients', client_id, NULL, NULL, NULL, max(request_id) FROM d GROUP BY client_id UNION ALL SELECT 'meta', NULL, NULL, NULL, NULL, count(*) FROM d",
    "kv_recover": f"{FOLD} SELECT key, value FROM last",
    "kv_replay": f"SELECT * FROM ({APPLY}) WHERE idx > (SELECT max(idx) // 2 FROM kv_log)",
    "apply_counters": "SELECT (SELECT count(*) FROM kv_log) AS applies, (SELECT count(*) FROM kv_log WHERE op IN (2, 3)) AS writes, (SELECT count(*) FROM proposals) AS proposals, (SELECT count(*) FROM read_requests WHERE ok) AS reads",
    "propose_latency": "SELECT p.idx, p.client_id, a.applied_ms - p.proposed_ms AS latency_ms, a.idx IS NULL OR a.applied_ms > p.proposed_ms + 10 AS proposed_again FROM proposals p LEFT JOIN applies a USING (idx)",
    "wait_applied": "SELECT r.request AS read, CASE WHEN a.applied_ms <= r.t * 1000 + 3600000 THEN greatest(a.applied_ms, r.t * 1000) END AS applied_ms FROM read_requests r ASOF LEFT JOIN applies a ON r.pos <= a.idx",
    "propose_batches": greedy(items("2, 3, 4"), "(o.t - f.began > 1800 OR f.size >= 8)", "idx, name AS batch"),
    "read_batches": greedy(items("1"), "o.t - f.began > 3600", "idx, name AS batch"),
    "snapshot_cache": greedy(items("1"), "o.t - f.began >= 7200", "idx, opens AS fresh, name AS computed_at"),
    "read_lease": greedy(items("1", ", t // 86400 AS term"), "(o.t - f.began >= 7200 OR o.term <> f.term)", "idx, NOT opens AS leased"),
    # storage
    "storage_state": "SELECT k, v AS val FROM storage_log a WHERE op = 1 AND NOT EXISTS (SELECT 1 FROM storage_log b WHERE b.k = a.k AND b.seq > a.seq)",
    "storage_len": "SELECT count(*) AS live FROM storage_log a WHERE op = 1 AND NOT EXISTS (SELECT 1 FROM storage_log b WHERE b.k = a.k AND b.seq > a.seq)",
    # replicated logs
    "raft_recover": f"WITH {LOG} SELECT * FROM rlog",
    "raft_hard_state": "SELECT node_id, coalesce(s.term, 0) AS term, coalesce(s.voted_for, 0) AS voted_for FROM (SELECT DISTINCT node_id FROM raft_wal) LEFT JOIN (SELECT * FROM raft_wal WHERE tag = 1 QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY seq DESC) = 1) s USING (node_id)",
    "log_bounds": f"WITH {LOG} SELECT lim.node_id, lo AS first_index, hi AS last_index, term AS last_term FROM lim JOIN rlog ON rlog.node_id = lim.node_id AND log_index = hi",
    "log_term_at": f"WITH {LOG} SELECT a.node_id, a.pos, l.term, l.term IS NOT NULL AS available FROM log_asks a LEFT JOIN rlog l ON l.node_id = a.node_id AND l.log_index = a.pos",
    "log_suffix": f"WITH {LOG} SELECT s.node_id, s.start, l.log_index, l.term FROM suffix_asks s JOIN lim ON lim.node_id = s.node_id AND s.start > lo AND s.start <= hi JOIN rlog l ON l.node_id = s.node_id AND l.log_index >= s.start QUALIFY row_number() OVER (PARTITION BY s.node_id, s.start ORDER BY l.log_index) <= 64",
    "log_truncate": f"WITH {LOG} SELECT l.* FROM rlog l JOIN snapshots s USING (node_id) JOIN lim USING (node_id) WHERE l.log_index < greatest(s.pos, lo + 1)",
    "log_first_of_term": f"WITH {LOG} SELECT DISTINCT a.node_id, a.term, coalesce((SELECT min(log_index) FROM rlog l WHERE l.node_id = a.node_id AND l.term = a.term AND NOT sentinel), 0) AS log_index FROM log_asks a",
    "log_last_of_term": f"WITH {LOG} SELECT DISTINCT a.node_id, a.term, coalesce((SELECT max(log_index) FROM rlog l WHERE l.node_id = a.node_id AND l.term = a.term AND NOT sentinel), 0) AS log_index FROM log_asks a",
    "log_compact": f"WITH {LOG}, {compacted('SELECT node_id, pos, term FROM snapshots')} SELECT * FROM done",
    "raft_snapshot_cuts": f"WITH {CUTS} SELECT * FROM known",
    "raft_compact": f"WITH {CUTS}, {compacted('SELECT node_id, cut AS pos, term FROM known WHERE term IS NOT NULL')} SELECT * FROM done",
    "raft_rewrite": f"""WITH {CUTS}, {compacted('SELECT node_id, cut AS pos, term FROM known WHERE term IS NOT NULL')},
      hard AS (SELECT * FROM raft_wal WHERE tag = 1 QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY seq DESC) = 1)
      SELECT n.node_id, 0 AS seq, 1 AS tag, coalesce(h.term, 0) AS term, 0 AS index_or_from, coalesce(h.voted_for, 0) AS voted_for FROM (SELECT DISTINCT node_id FROM raft_wal) n LEFT JOIN hard h USING (node_id)
      UNION ALL SELECT node_id, row_number() OVER (PARTITION BY node_id ORDER BY log_index), 2, term, log_index, 0 FROM done WHERE NOT sentinel""",
    "log_merge": f"""WITH {LOG}, inc AS (SELECT i.*, l.term AS ours FROM incoming i JOIN lim ON lim.node_id = i.node_id AND i.log_index > lo LEFT JOIN rlog l ON l.node_id = i.node_id AND l.log_index = i.log_index),
      start AS (SELECT node_id, min(log_index) FILTER (term <> ours) AS clash FROM inc GROUP BY node_id)
      SELECT l.node_id, l.log_index, l.term, 'kept' AS origin FROM rlog l LEFT JOIN start USING (node_id) WHERE l.log_index < coalesce(clash, 9223372036854775807) OR sentinel
      UNION ALL SELECT i.node_id, i.log_index, i.term, 'incoming' FROM inc i JOIN start USING (node_id) JOIN lim USING (node_id) WHERE i.log_index >= CASE WHEN clash IS NULL THEN hi + 1 ELSE clash END""",
    "append_conflict": f"""WITH {LOG}, a AS (SELECT r.node_id, r.request, r.prev_index, r.prev_term, lo, hi, l.term AS ours FROM append_requests r JOIN lim USING (node_id) LEFT JOIN rlog l ON l.node_id = r.node_id AND l.log_index = r.prev_index),
      t AS (SELECT node_id, term, min(log_index) AS s FROM rlog WHERE NOT sentinel GROUP BY node_id, term),
      b AS (SELECT a.*, t.s, CASE WHEN prev_index > hi THEN 'short' WHEN prev_index < lo THEN 'ok' WHEN ours = prev_term THEN 'ok' ELSE 'conflict' END AS outcome FROM a LEFT JOIN t ON t.node_id = a.node_id AND t.term = a.ours)
      SELECT node_id, request, outcome, CASE outcome WHEN 'short' THEN hi + 1 WHEN 'conflict' THEN coalesce(s, lo + 1) ELSE 0 END AS conflict_index, CASE outcome WHEN 'conflict' THEN coalesce(ours, 0) ELSE 0 END AS conflict_term FROM b""",
    "install_snapshot": f"WITH {LOG}, {compacted('SELECT node_id, pos, term FROM snapshots WHERE commit_index < pos')} SELECT * FROM done",
    "snapshot_cursors": "SELECT node_id, commit_index < pos AS installed, if(commit_index < pos, pos, commit_index) AS commit_index, if(commit_index < pos, pos, applied) AS last_applied FROM snapshots",
    "apply_delivery": f"WITH {LOG} SELECT l.node_id, l.log_index, l.term, l.log_index - s.applied AS position FROM rlog l JOIN snapshots s ON s.node_id = l.node_id AND l.log_index BETWEEN s.applied + 1 AND s.commit_index WHERE NOT sentinel",
    "next_index_repair": f"""WITH {LOG}, t AS (SELECT node_id, term, max(log_index) AS e FROM rlog WHERE NOT sentinel GROUP BY node_id, term)
      SELECT r.node_id, r.request, greatest(1, CASE WHEN conflict_term <> 0 AND e IS NOT NULL THEN e + 1 WHEN conflict_term <> 0 OR conflict_index <> 0 THEN conflict_index WHEN next_index > 1 THEN next_index - 1 ELSE next_index END) AS next_index FROM rejections r LEFT JOIN t ON t.node_id = r.node_id AND t.term = r.conflict_term""",
    "follower_commit": "SELECT node_id, request, CASE WHEN leader_commit <= commit_index THEN commit_index WHEN prev_index + n_entries < commit_index THEN commit_index WHEN prev_index + n_entries < leader_commit THEN prev_index + n_entries ELSE leader_commit END AS commit_index FROM append_requests",
    # a candidate index counts those that hold it, the leader's own log among them
    "commit_index": """WITH held AS (SELECT tick, term, last_index, if(node_id = 1, last_index, match_index) AS m FROM match_progress_ticks),
      enough AS (SELECT a.tick, a.term, a.last_index, max(a.m) FILTER ((SELECT count(*) FROM held b WHERE b.tick = a.tick AND b.m >= a.m) >= 4) AS top FROM held a GROUP BY a.tick, a.term, a.last_index),
      older AS (SELECT term, (SELECT max(last_index) FROM enough o WHERE o.term < t.term) AS old FROM (SELECT DISTINCT term FROM enough) t)
      SELECT tick, term, last_index, coalesce(max(CASE WHEN old IS NULL OR top > old THEN top END) OVER (ORDER BY tick), 0) AS commit_index FROM enough JOIN older USING (term)""",
    "match_progress": "SELECT a.tick, a.node_id, max(b.match_index) AS match_index, max(b.match_index) + 1 AS next_index, max(b.match_index) < a.last_index AS behind FROM match_progress_ticks a JOIN match_progress_ticks b ON b.node_id = a.node_id AND b.tick <= a.tick GROUP BY a.tick, a.node_id, a.last_index",
    "replication_plan": "SELECT tick, node_id, CASE WHEN match_index < first_index THEN 'snapshot' WHEN match_index < last_index THEN 'entries' ELSE 'heartbeat' END AS plan, CASE WHEN match_index >= first_index THEN least(last_index - match_index, 64) ELSE 0 END AS entries FROM match_progress_ticks WHERE node_id > 1",
    # elections
    "check_quorum": "SELECT tick, 1 + sum(CASE WHEN node_id > 1 AND contact_ms < 1500 THEN 1 ELSE 0 END)::BIGINT AS active, sum(CASE WHEN node_id > 1 AND contact_ms < 1500 THEN 1 ELSE 0 END) >= 3 AS quorum FROM match_progress_ticks GROUP BY tick",
    "read_quorum": "SELECT tick, term, 1 + count(*) FILTER (node_id > 1 AND acked AND ack_term = term) AS acks, count(*) FILTER (node_id > 1 AND acked AND ack_term = term) >= 3 AND count(*) FILTER (node_id > 1 AND ack_term > term) = 0 AS confirmed FROM match_progress_ticks GROUP BY tick, term",
    "vote_up_to_date": "SELECT event_id, cand_last_term > voter_last_term OR cand_last_term = voter_last_term AND cand_last_index >= voter_last_index AS up_to_date FROM vote_requests",
    "pre_vote": "SELECT event_id, NOT (term <= voter_term OR leader_id > 0 AND heard_ms < 750 OR cand_last_term < voter_last_term OR cand_last_term = voter_last_term AND cand_last_index < voter_last_index) AS granted FROM vote_requests",
    # each voter's memory of its term and vote, request by request
    "vote_grants": """WITH RECURSIVE q AS (SELECT *, row_number() OVER (PARTITION BY voter_id ORDER BY event_id) AS n, leader_id > 0 AND heard_ms < 750 AS sticky, (cand_last_term, cand_last_index) >= (voter_last_term, voter_last_index) AS fresh FROM vote_requests),
      v AS (SELECT DISTINCT voter_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS cur, CAST(0 AS BIGINT) AS vote, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS term, CAST(NULL AS BIGINT) AS candidate_id, false AS granted FROM q
        UNION ALL SELECT q.voter_id, q.n, if(q.term > v.cur AND NOT q.sticky, q.term, v.cur),
          CASE WHEN q.term > v.cur AND q.sticky OR q.term < v.cur THEN v.vote WHEN q.term > v.cur THEN if(q.fresh, q.candidate_id, 0) WHEN v.vote = 0 AND q.fresh THEN q.candidate_id ELSE v.vote END, q.event_id, q.term, q.candidate_id,
          CASE WHEN q.term > v.cur THEN NOT q.sticky AND q.fresh WHEN q.term < v.cur THEN false ELSE q.fresh AND v.vote IN (0, q.candidate_id) END
        FROM v JOIN q ON q.voter_id = v.voter_id AND q.n = v.n + 1) SELECT event_id, term, voter_id, candidate_id, granted, cur AS response_term FROM v WHERE n > 0""",
    "election_backoff_bounds": "SELECT a AS attempts, 750 AS low_ms, CASE a WHEN 0 THEN 1500 WHEN 1 THEN 2250 WHEN 2 THEN 3750 ELSE 6750 END AS high_ms FROM (SELECT DISTINCT event_id % 6 AS a FROM vote_requests)",
    "commit_stall": f"""WITH RECURSIVE {ROLL}, o AS (SELECT roll.tick, max_commit, quorum, l.hi, row_number() OVER (ORDER BY roll.tick) AS n FROM roll JOIN (SELECT tick, max(last_index) AS hi FROM node_status_ticks GROUP BY tick) l USING (tick)),
      w AS (SELECT n, tick, max_commit, tick AS since, 0::BIGINT AS age, false AS fires FROM o WHERE n = 1
        UNION ALL SELECT o.n, o.tick, o.max_commit, if(o.hi <= o.max_commit OR o.max_commit <> w.max_commit, o.tick, w.since), if(o.hi <= o.max_commit OR o.max_commit <> w.max_commit, 0, o.tick - w.since),
          o.hi > o.max_commit AND o.max_commit = w.max_commit AND o.tick - w.since >= 5 AND o.quorum FROM w JOIN o ON o.n = w.n + 1) SELECT tick, age, fires FROM w""",
    "role_transitions": f"""WITH r AS (SELECT *, if(is_leader, 'leader', 'follower') AS role, row_number() OVER (PARTITION BY node_id ORDER BY tick) AS n FROM node_status_ticks WHERE running AND NOT partitioned)
      SELECT b.tick, b.node_id, a.role AS was, b.role, b.term, CASE WHEN b.is_leader THEN b.node_id WHEN b.term > a.term THEN 0 ELSE b.voted_for END AS voted_for, if(b.is_leader, b.last_index + 1, NULL) AS next_index, if(b.is_leader, 0, NULL) AS match_index
      FROM r b JOIN r a ON a.node_id = b.node_id AND a.n = b.n - 1 WHERE a.role <> b.role OR b.term > a.term""",
    # telemetry
    "gauge_latest": f"SELECT instance, {GAUGES} FROM metric_samples QUALIFY row_number() OVER (PARTITION BY instance ORDER BY ts DESC) = 1",
    "sampled_gauges": f"SELECT tick, instance, {GAUGES} FROM metric_samples QUALIFY row_number() OVER (PARTITION BY tick, instance ORDER BY ts DESC) = 1",
    "latency_histogram": histogram("propose", "seconds", ".001, .0025, .005, .01, .025, .05, .1, .25, .5, 1, 2.5") + " UNION ALL " + histogram("read", "read_seconds", ".0001, .00025, .0005, .001, .0025, .005, .01, .025, .05, .1"),
    "role_int": "SELECT role, CASE role WHEN 'leader' THEN 2 WHEN 'candidate' THEN 1 WHEN 'follower' THEN 0 ELSE -1 END AS code, count(*) AS n FROM metric_samples GROUP BY role",
    "writes_per_sec": leader_rate("writes_total"),
    "reads_per_sec": leader_rate("reads_total"),
    "applies_per_sec": f"WITH {grown('applies_total')} SELECT tick, round(sum(inc / 3600.0), 6) AS rate, round(sum(inc / 3600.0), 6) < 1 AS low FROM g GROUP BY tick",
    "stepdowns_total": "SELECT sum(n)::BIGINT AS stepdowns FROM (SELECT arg_max(stepdowns, ts) AS n FROM metric_samples GROUP BY instance)",
    "host_cpu_busy": f"WITH {IDLE} SELECT tick, busy FROM busy",
    "host_mem_used": f"""WITH {IDLE}, m AS (SELECT tick, max(mem_total) AS t, max(mem_available) AS a FROM host_samples GROUP BY tick), o AS (SELECT *, coalesce(t > 0 AND a IS NOT NULL AND busy IS NOT NULL, false) AS ok FROM m JOIN busy USING (tick))
      SELECT tick, ok, if(ok, busy, 0.0) AS busy, if(ok, if(t < a, 0.0, t - a), 0.0) AS used, if(ok, t, 0.0) AS total FROM o""",
    "series_select": """WITH l AS (SELECT * FROM metric_samples QUALIFY row_number() OVER (PARTITION BY tick, instance ORDER BY ts DESC) = 1), m AS (SELECT tick, max(mem_total) AS t, max(mem_available) AS a FROM host_samples GROUP BY tick)
      SELECT tick, instance, 'is_leader' AS series, is_leader::DOUBLE AS val FROM l UNION ALL SELECT tick, instance, 'term', term::DOUBLE FROM l UNION ALL SELECT tick, instance, 'commit_index', commit_index::DOUBLE FROM l
      UNION ALL SELECT tick, 0, 'mem_used', t - a FROM m WHERE t - a IS NOT NULL UNION ALL SELECT tick, 0, 'mem_total', t FROM m WHERE t IS NOT NULL""",
    "metrics_unpivot": " UNION ALL ".join(f"SELECT ts, instance, '{c}' AS metric, ({c})::DOUBLE AS val FROM u" for c in "is_leader term commit_index role_code leader_id stepdowns proposals_total applies_total writes_total reads_total seconds read_seconds".split()).replace("SELECT", f"WITH u AS (SELECT ts, instance, {GAUGES}, proposals_total, applies_total, writes_total, reads_total, seconds, read_seconds FROM metric_samples) SELECT", 1),
    "alert_no_progress": f"WITH {window_sum('applies_total')}, {held('SELECT tick, sum(inc) = 0 AS hit FROM w GROUP BY tick', 5)}",
    "alert_leader_stuck": f"WITH {window_sum('commit_index')}, {LEADS}, {held('SELECT tick, sum(inc) = 0 AND tick IN (SELECT tick FROM leads) AS hit FROM w GROUP BY tick', 2)}",
    "alert_watchdog": f"""WITH l AS (SELECT tick, instance, stepdowns, row_number() OVER (PARTITION BY instance ORDER BY tick) AS n FROM (SELECT tick, instance, arg_max(stepdowns, ts) AS stepdowns FROM metric_samples GROUP BY tick, instance)),
      c AS (SELECT b.instance, a.tick AS since, b.tick FROM l b JOIN l a ON a.instance = b.instance AND a.n = b.n - 1 AND a.stepdowns <> b.stepdowns),
      {held('SELECT l.instance, l.tick, EXISTS (SELECT 1 FROM c WHERE c.instance = l.instance AND c.since >= l.tick - 15 AND c.tick <= l.tick) AS hit FROM l', 1, 'instance')}""",
    # health
    "healthz_parse": f"""WITH j AS (SELECT tick, node_id, {BODY} AS j FROM inspections) SELECT tick, node_id, (j ->> 'ok')::BOOLEAN AS ok, (j ->> 'id')::BIGINT AS id, (j ->> 'term')::BIGINT AS term, (j ->> 'commitIndex')::BIGINT AS commit_index, (j ->> 'leaderId')::BIGINT AS leader_id, (j ->> 'isLeader')::BOOLEAN AS is_leader, j ->> 'role' AS role FROM j""",
    "node_status": f"""WITH {STATUS}, {heals(30 * DAY, 30 * DAY)} SELECT tick, node_id, running, status, partitioned, coalesce((j ->> 'term')::BIGINT, 0) AS term, coalesce((j ->> 'commitIndex')::BIGINT, 0) AS commit_index, coalesce((j ->> 'leaderId')::BIGINT, 0) AS reported_leader,
      coalesce((j ->> 'isLeader')::BOOLEAN, false) AS is_leader, coalesce(j ->> 'role', '') AS role, kind AS heal_kind, due_in AS heal_due_ms FROM st LEFT JOIN heal USING (node_id)""",
    "cluster_rollup": f"WITH {ROLL} SELECT * FROM roll",
    "since_quorum_loss": f"""WITH {ROLL}, n AS (SELECT tick, quorum, row_number() OVER (ORDER BY tick) AS n FROM roll), lost AS (SELECT b.tick FROM n b LEFT JOIN n a ON a.n = b.n - 1 WHERE NOT b.quorum AND coalesce(a.quorum, true))
      SELECT n.tick, n.quorum, coalesce(n.tick - (SELECT max(l.tick) FROM lost l WHERE l.tick <= n.tick), -1) AS since FROM n""",
    "audit_events": f"{AUDIT} SELECT a.*, r.alive, r.total, r.quorum, r.leader_id, r.term, r.max_commit FROM audit a JOIN roll r USING (tick)",
    "audit_tail": f"{AUDIT}, t AS (SELECT *, row_number() OVER (ORDER BY tick, ord) AS n, count(*) OVER () AS c FROM audit) SELECT CAST(n - greatest(c - 200, 0) AS INTEGER) AS place, tick, ord, event, detail FROM t WHERE n > c - 200",
    "event_ring": "WITH t AS (SELECT event_id, t, ip, row_number() OVER (ORDER BY t DESC, event_id DESC) AS r, count(*) OVER () AS c FROM disrupt_attempts) SELECT event_id, t, ip, CAST(least(c, 64) + 1 - r AS INTEGER) AS place FROM t WHERE r <= 64",
    "feed_top12": "WITH t AS (SELECT event_id, t, ip, row_number() OVER (ORDER BY t DESC, event_id DESC) AS r, count(*) OVER () AS c FROM disrupt_attempts) SELECT event_id, t, ip, CAST(least(c, 12) + 1 - r AS INTEGER) AS place FROM t WHERE r <= 12",
    "reconcile_plan": f"WITH {STATUS} SELECT tick, node_id, CASE WHEN running THEN 'reconnect' ELSE 'start' END AS action FROM st WHERE status <> 'unknown' AND (tick + node_id) % 4 <> 0 AND NOT (running AND NOT partitioned)",
    "heal_due": f"WITH {heals(20 * DAY, 15 * DAY)} SELECT node_id, kind, due_in FROM heal",
    "snapshot_json": f"WITH {ROLL} SELECT roll.tick, roll.alive, roll.quorum, roll.leader_id, seen.node_id, seen.running, seen.term AS node_term FROM roll JOIN seen USING (tick)",
    "node_badge": f"WITH {SEEN} SELECT tick, node_id, CASE WHEN alive AND leads THEN 'leader' WHEN alive THEN 'follower' WHEN running THEN 'partitioned' ELSE 'down' END AS badge, alive AS killable FROM seen",
    "ring_layout": f"WITH {RING} SELECT tick, node_id, round(cos(2 * pi() * pos / n), 6) + 0.0 AS x, round(sin(2 * pi() * pos / n), 6) + 0.0 AS y FROM p",
    "mesh_edges": f"WITH {RING} SELECT a.tick, a.node_id AS node_a, b.node_id AS node_b FROM p a JOIN p b ON b.tick = a.tick AND b.node_id > a.node_id WHERE a.n < 4 OR b.pos - a.pos < 3 OR a.pos + a.n - b.pos < 3",
    "pending_kill_overlay": f"WITH {SEEN} SELECT tick, count(*) FILTER (alive AND (tick + node_id) % 5 <> 0) AS alive, count(*) FILTER (alive AND (tick + node_id) % 5 <> 0) * 2 >= 8 AS quorum FROM seen GROUP BY tick",
    # control plane
    "cooldown_accepts": greedy("SELECT event_id AS idx, if(ip = '', 'unknown', ip) AS ip, t FROM disrupt_attempts", f"o.t - f.began >= {6 * 3600}", "idx AS event_id, ip, opens AS accepted", "ip"),
    "client_ip": "SELECT event_id, CASE WHEN forwarded <> '' THEN trim(string_split(forwarded, ',')[1]) WHEN remote = 'unix' THEN remote WHEN starts_with(remote, '[') THEN string_split(remote[2:], ']')[1] ELSE string_split(remote, ':')[1] END AS ip FROM requests",
    "route_parse": """WITH p AS (SELECT *, regexp_matches(path, '^/api/nodes/0*[1-9][0-9]*/(kill|restart|partition)$') AS good, string_split(path, '/') AS w FROM requests)
      SELECT event_id, if(good, w[4]::BIGINT, NULL) AS id, if(good, w[5], NULL) AS action, CASE WHEN method = 'GET' THEN 405 WHEN good AND cooling THEN 429 WHEN good THEN 200 ELSE 400 END AS code FROM p""",
    "audit_limit": "SELECT event_id, CASE WHEN try_cast(lim AS INTEGER) > 1000 THEN 1000 WHEN try_cast(lim AS INTEGER) > 0 THEN try_cast(lim AS INTEGER) ELSE 200 END AS served FROM requests",
    "parse_peers": """WITH i AS (SELECT event_id, generate_subscripts(string_split(spec, ','), 1) AS n, trim(unnest(string_split(spec, ','))) AS x FROM peer_specs), k AS (SELECT event_id, n, trim(string_split(x, '=')[1]) AS id, trim(string_split(x, '=')[2]) AS addr, contains(x, '=') AND regexp_full_match(trim(string_split(x, '=')[1]), '[0-9]+') AS fine FROM i WHERE x <> ''),
      b AS (SELECT DISTINCT event_id FROM k WHERE NOT fine)
      SELECT event_id, CAST(NULL AS VARCHAR) AS error, id::BIGINT AS id, addr FROM k WHERE event_id NOT IN (SELECT event_id FROM b) QUALIFY row_number() OVER (PARTITION BY event_id, id::BIGINT ORDER BY n DESC) = 1
      UNION ALL SELECT event_id, 'want id=host:port', NULL, NULL FROM b""",
    "leader_try_order": "WITH n AS (SELECT DISTINCT node_id FROM raft_wal) SELECT event_id, node_id, CAST(CASE WHEN node_id = hint THEN 1 WHEN hint IN (SELECT node_id FROM n) AND node_id < hint THEN 1 + (SELECT count(*) FROM n m WHERE m.node_id <= n.node_id) ELSE (SELECT count(*) FROM n m WHERE m.node_id <= n.node_id) END AS INTEGER) AS attempt FROM requests, n",
    "loadgen_log": "SELECT i + 1 AS idx, 2 AS op, 'loadgen-w-' || (i % 64) AS client_id, i // 64 + 1 AS request_id, 'load/w/' || ((i // 64 + 1) % 10000) AS k, CAST(i // 64 + 1 AS VARCHAR) AS v, '' AS expect FROM (SELECT unnest(range(0, (SELECT count(*) FROM events))) AS i)",
    "heartbeats": "SELECT a.tick, 2 AS op, 'traffic' AS client_id, 1 + (SELECT count(*) FROM load_ticks b WHERE b.tick < a.tick AND b.fail <= b.ok) AS request_id, 'demo/heartbeat' AS k, CAST(a.tick AS VARCHAR) AS v FROM load_ticks a",
    "throughput_report": "WITH c AS (SELECT a.tick, a.fail, (SELECT sum(ok) FROM load_ticks b WHERE b.tick <= a.tick)::BIGINT AS total, (SELECT max(tick) FROM load_ticks b WHERE b.tick < a.tick) AS prev FROM load_ticks a) SELECT c.tick, c.total, round((c.total - p.total) / ((c.tick - c.prev) * 3600.0), 9) AS per_sec, c.fail FROM c LEFT JOIN c p ON p.tick = c.prev",
    "active_viewers": "WITH p AS (SELECT event_id, sum(delta) OVER (ORDER BY event_id) AS s FROM presence_events) SELECT event_id, CAST(s - least(0, min(s) OVER (ORDER BY event_id)) AS BIGINT) AS viewers FROM p",
    "aimd_rate": """WITH RECURSIVE o AS (SELECT *, row_number() OVER (ORDER BY tick) AS n FROM load_ticks),
      f AS (SELECT 0 AS n, CAST(-1 AS BIGINT) AS tick, CAST(1000.0 AS DOUBLE) AS rate
        UNION ALL SELECT o.n, o.tick, CAST(CASE WHEN ok + fail = 0 THEN f.rate WHEN fail / (ok + fail) > 0.2 THEN greatest(f.rate / 2, 100.0) WHEN fail / (ok + fail) < 0.05 AND f.rate < 2000.0 THEN least(f.rate + 100.0, 2000.0) ELSE f.rate END AS DOUBLE) FROM f JOIN o ON o.n = f.n + 1)
      SELECT tick, rate FROM f WHERE n > 0""",
    # binary records
    "storage_decode": "SELECT seq, if(seq % 97 = 0, NULL, op)::INTEGER AS op, if(seq % 97 = 0, NULL, k) AS k, if(seq % 97 = 0, NULL, v) AS v, if(seq % 97 = 0, 'short record', NULL) AS error FROM storage_log",
    "kv_decode": "SELECT idx AS seq, if(idx % 89 = 0, NULL, op)::INTEGER AS op, if(idx % 89 = 0, NULL, client_id) AS client_id, if(idx % 89 = 0, NULL, request_id) AS request_id, if(idx % 89 = 0, NULL, k) AS k, if(idx % 89 = 0, NULL, expect) AS expect, if(idx % 89 = 0, NULL, v) AS v, if(idx % 89 = 0, 'short record', NULL) AS error FROM kv_log",
    "kv_codec_roundtrip": "SELECT idx AS seq, 21 + strlen(client_id) + strlen(k) + strlen(expect) + strlen(v) AS size, op::INTEGER AS op, client_id, request_id, k, expect, v, CAST(NULL AS VARCHAR) AS error FROM kv_log",
    "wal_frame_roundtrip": "SELECT seq, 13 + strlen(k) + strlen(v) AS framed, true AS whole, true AS intact, op::INTEGER AS op, k, v FROM storage_log",
    "wal_scan": "SELECT row_number() OVER w - 1 AS seq, (sum(13 + strlen(k) + strlen(v)) OVER w)::BIGINT AS \"offset\", seq % 4 AS file, op::INTEGER AS op, k, v FROM storage_log WINDOW w AS (PARTITION BY seq % 4 ORDER BY storage_log.seq)",
    "raft_wal_decode": "SELECT node_id, seq, tag::INTEGER AS tag, if(tag = 3, 0, term) AS term, index_or_from, voted_for, if(tag = 2, 'x', NULL) AS data, CAST(NULL AS VARCHAR) AS error FROM raft_wal",
}
ORACLES["election_tally"] = f"SELECT term, candidate_id, 1 + count(DISTINCT voter_id) FILTER (granted AND response_term = term) AS votes, count(DISTINCT voter_id) FILTER (granted AND response_term = term) >= 3 AND max(response_term) <= term AS won FROM ({ORACLES['vote_grants']}) WHERE voter_id <> candidate_id GROUP BY term, candidate_id"
for _name in ("exactly_once", "cooldown", "aimd", "batches"):
    ORACLES[f"stream_{_name}"] = ORACLES[{"exactly_once": "kv_exactly_once", "cooldown": "cooldown_accepts", "aimd": "aimd_rate", "batches": "propose_batches"}[_name]]
ORACLES["stream_apply"] = APPLY
ORACLES["stream_audit"] = f"{AUDIT} SELECT tick, ord, event FROM audit"
