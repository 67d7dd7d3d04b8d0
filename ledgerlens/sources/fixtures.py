"""Input tables of the registered queries, derived from the driver's events and orders.

The same text runs on Spark and DuckDB. Events are numbered in the order of time, so
``idx`` is their number and nothing has to be ranked. They are stand-ins for a log
and its telemetry; the operators take any table with these columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TICK = "CAST((extract(DAY FROM ts) - 1) * 24 + extract(HOUR FROM ts) AS BIGINT)"
SECONDS = "CAST((extract(DAY FROM ts) - 1) * 86400 + extract(HOUR FROM ts) * 3600 + extract(MINUTE FROM ts) * 60 + floor(extract(SECOND FROM ts)) AS BIGINT)"
NODES = "(VALUES (1), (2), (3), (4), (5), (6), (7)) AS n(node_id)"
TICKS = f"(SELECT DISTINCT {TICK} AS tick FROM events)"

FIXTURES: dict[str, str] = {
    # op 1 get, 2 put, 3 compare-and-swap, 4 checkpoint; request 0 is not tracked
    "kv_log": f"""
SELECT event_id + 1 AS idx, ts, {SECONDS} AS t,
       CASE event_type WHEN 'view' THEN 1 WHEN 'purchase' THEN 3 WHEN 'error' THEN 4 ELSE 2 END AS op,
       'u' || CAST(user_id AS STRING) AS client_id,
       CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS request_id,
       'k/' || CAST(event_id % 37 AS STRING) AS k,
       CAST(CAST(floor(value) AS BIGINT) % 4 AS STRING) AS v,
       CASE WHEN event_id % 5 = 4 THEN '' ELSE CAST(event_id % 4 AS STRING) END AS expect,
       event_id % 3 = 0 AS waited, CAST(user_id % 5 + 1 AS BIGINT) AS node_id
FROM events
""",
    "proposals": f"""
SELECT event_id + 1 AS idx, 'u' || CAST(user_id AS STRING) AS client_id, {SECONDS} * 1000 AS proposed_ms
FROM events WHERE event_type <> 'view'
""",
    "applies": f"""
SELECT event_id + 1 AS idx, {SECONDS} * 1000 + event_id % 11 + 3 AS applied_ms, (event_id + 1) * 2 % 1013 AS ahead,
       event_id % 700 > 600 AS fails, CAST(1 AS BIGINT) AS node_id
FROM events WHERE event_id % 97 <> 0
""",
    "read_requests": f"""
SELECT event_id AS request, {SECONDS} AS t, user_id % 20 <> 0 AS ok, value / 20000 AS seconds, event_id * 7 % 100003 AS pos
FROM events WHERE event_type = 'view'
""",
    # op 1 put, 2 delete
    "storage_log": """
SELECT o_orderkey AS seq, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS op,
       'c/' || CAST(o_custkey AS STRING) AS k, CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) AS v
FROM orders
""",
    # by node: blocks of 48 appends and one hard state, then a marker that drops the last 3
    "raft_wal": """
SELECT node_id, r AS seq, CASE r % 50 WHEN 49 THEN 3 WHEN 24 THEN 1 ELSE 2 END AS tag,
       CAST(floor(r / 500) + 1 AS BIGINT) AS term,
       CASE r % 50 WHEN 49 THEN block * 45 + 46 WHEN 24 THEN 0 ELSE block * 45 + r % 50 + CASE WHEN r % 50 < 24 THEN 1 ELSE 0 END END AS index_or_from,
       CASE WHEN r % 50 = 24 THEN r % 7 ELSE 0 END AS voted_for
FROM (SELECT CAST(user_id % 5 + 1 AS BIGINT) AS node_id, r, CAST(floor(r / 50) AS BIGINT) AS block
      FROM (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id % 5 ORDER BY ts, event_id) - 1 AS BIGINT) AS r FROM events) e) t
""",
    # what a leader asks of each node, with the node's own cursors
    "append_requests": """
SELECT node_id, seq AS request, index_or_from + seq % 3 * 4 AS prev_index, CASE WHEN seq % 7 = 0 THEN term + 1 ELSE term END AS prev_term,
       seq % 5 AS n_entries, index_or_from + seq % 13 AS leader_commit, CASE WHEN index_or_from > 20 THEN index_or_from - 20 + seq % 40 ELSE 0 END AS commit_index
FROM raft_wal WHERE tag <> 1
""",
    # one batch of entries for each node; every second node's has a newer term from some place on
    "incoming": """
SELECT node_id, index_or_from AS log_index, CASE WHEN node_id % 2 = 0 AND index_or_from > 100 * node_id THEN term + 1 ELSE term END AS term
FROM raft_wal WHERE tag = 2 AND seq % 50 < 40 AND seq >= 20 * node_id
UNION ALL
SELECT node_id, max(index_or_from) + 100, max(term) FROM raft_wal WHERE tag = 2 GROUP BY node_id
""",
    "compactions": """
SELECT DISTINCT node_id, node_id * 40 AS pos, CAST(1 AS BIGINT) AS term FROM raft_wal
""",
    "suffix_asks": """
SELECT DISTINCT node_id, CAST(floor(index_or_from / 50) * 50 + 1 AS BIGINT) AS start FROM raft_wal WHERE tag <> 1
""",
    "log_asks": """
SELECT node_id, index_or_from + seq % 60 AS pos, term + seq % 3 - 1 AS term FROM raft_wal WHERE tag <> 1
""",
    # by node: a snapshot offered or taken at an index, and the node's cursors
    "snapshots": """
SELECT node_id, max(index_or_from) - 30 * node_id AS pos, max(index_or_from) - 25 * node_id - CASE WHEN node_id = 3 THEN 40 ELSE 0 END AS applied,
       max(index_or_from) - 20 * node_id - CASE WHEN node_id % 2 = 0 THEN 30 ELSE 0 END AS commit_index, max(term) AS term
FROM raft_wal WHERE tag = 2 GROUP BY node_id
""",
    # node 1 leads; how far each node has got
    "match_progress_ticks": f"""
SELECT t.tick, n.node_id, t.last_index, t.term,
       CASE WHEN t.last_index - (t.tick * 7 + n.node_id * 5) % 29 < 0 THEN 0
            ELSE t.last_index - (t.tick * 7 + n.node_id * 5) % 29 END AS match_index,
       (t.tick * 37 + n.node_id * 211) % 2400 AS contact_ms, (t.tick + n.node_id) % 3 <> 0 AS acked,
       t.term + CASE WHEN (t.tick + n.node_id) % 41 = 0 THEN 1 ELSE 0 END AS ack_term,
       CASE WHEN t.last_index > 25 THEN t.last_index - 25 ELSE 0 END AS first_index
FROM (SELECT tick, CAST(sum(c) OVER (ORDER BY tick) AS BIGINT) AS last_index, CAST(floor(tick / 48) + 1 AS BIGINT) AS term
      FROM (SELECT {TICK} AS tick, count(*) AS c FROM events GROUP BY 1) a) t
CROSS JOIN {NODES}
""",
    # refused appends: the follower's hints, and the leader's cursor for it
    "rejections": """
SELECT node_id, seq AS request, CASE seq % 4 WHEN 0 THEN term + seq % 3 ELSE 0 END AS conflict_term,
       CASE seq % 4 WHEN 3 THEN 0 ELSE seq % 90 END AS conflict_index, seq % 50 AS next_index
FROM raft_wal
""",
    "metric_samples": f"""
SELECT ts, tick, instance, writes_total, writes_total * 2 + instance AS reads_total, writes_total * 3 AS proposals_total,
       CAST(sum(moves) OVER (PARTITION BY instance, day ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS applies_total,
       CAST(sum(moves) OVER (PARTITION BY instance ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS commit_index,
       CAST(floor((tick + instance * 17) / 50) AS BIGINT) AS stepdowns, CAST(floor(tick / 7) + 1 AS BIGINT) AS term, is_leader,
       CASE WHEN is_leader = 1 THEN 'leader' WHEN tick % 11 = 0 THEN 'candidate' WHEN tick % 29 = 0 THEN 'lost' ELSE 'follower' END AS role, tick % 7 + 1 AS leader_id,
       seconds, seconds / 20 AS read_seconds
FROM (SELECT ts, event_id, {TICK} AS tick, CAST(user_id % 7 + 1 AS BIGINT) AS instance, extract(DAY FROM ts) AS day, value / 1000 AS seconds,
             CASE WHEN {TICK} % 50 BETWEEN 20 AND 34 THEN 0 ELSE 1 END AS moves, CASE WHEN (extract(HOUR FROM ts) % 7) = user_id % 7 THEN 1 ELSE 0 END AS is_leader,
             CAST(count(*) OVER (PARTITION BY user_id % 7, extract(DAY FROM ts) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS writes_total
      FROM events) e
""",
    # a host's idle seconds by processor, and its memory; some readings are missing
    "host_samples": f"""
SELECT tick, node_id AS cpu, CAST(tick * (1800 + node_id * 97) + tick % 13 AS DOUBLE) AS idle_seconds,
       CASE WHEN tick % 31 = 0 THEN NULL WHEN tick % 37 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(24000 AS DOUBLE) END AS mem_total,
       CASE WHEN tick % 41 = 0 THEN NULL WHEN tick % 43 = 0 THEN CAST(25000 AS DOUBLE) ELSE CAST(8000 + tick % 900 AS DOUBLE) END AS mem_available
FROM {TICKS} g CROSS JOIN {NODES}
""",
    "node_status_ticks": f"""
SELECT g.tick, n.node_id,
       (g.tick * 3 + n.node_id * 11) % 13 > 3 AS running,
       (g.tick + n.node_id * 5) % 17 = 0 AS partitioned,
       CASE WHEN (g.tick * 3 + n.node_id * 11) % 13 > 3 THEN CAST(floor(g.tick / 5) AS BIGINT) % 8 ELSE 0 END AS reported_leader,
       CAST(floor(g.tick / 5) AS BIGINT) % 8 = n.node_id AS is_leader,
       CAST(floor(g.tick / 5) + 1 AS BIGINT) AS term,
       CAST(floor(g.tick / 9) * 10 + n.node_id % 2 AS BIGINT) AS commit_index,
       CAST(floor(g.tick / 9) * 10 + g.tick % 5 AS BIGINT) AS last_index, (g.tick + n.node_id) % 7 AS voted_for
FROM {TICKS} g CROSS JOIN {NODES}
""",
    # what inspecting a container and asking its node printed
    "inspections": f"""
SELECT g.tick, n.node_id, (g.tick + n.node_id) % 23 <> 0 AS ok,
       CASE WHEN (g.tick + n.node_id * 3) % 29 = 0 THEN 'gone' WHEN (g.tick * 3 + n.node_id * 11) % 13 > 3 THEN ' true  running ' ELSE 'false exited' END AS out,
       CASE WHEN (g.tick + n.node_id * 5) % 17 = 0 THEN '{{"bridge":{{}}}}' ELSE '{{"bridge":{{}},"mesh":{{"ip":"10.0.0.' || CAST(n.node_id AS STRING) || '"}}}}' END AS networks,
       CASE WHEN (g.tick + n.node_id) % 9 = 0 THEN 503 ELSE 200 END AS code,
       CASE WHEN (g.tick + n.node_id) % 10 = 0 THEN 'oops' ELSE '{{"ok":true,"id":' || CAST(n.node_id AS STRING) || ',"term":' || CAST(g.tick AS STRING) || ',"commitIndex":' || CAST(g.tick * 2 AS STRING)
         || ',"leaderId":' || CAST(g.tick % 7 + 1 AS STRING) || ',"isLeader":' || CASE WHEN g.tick % 7 + 1 = n.node_id THEN 'true' ELSE 'false' END || ',"role":"follower"}}' END AS body
FROM {TICKS} g CROSS JOIN {NODES}
""",
    # faults that were made on purpose, and the actions that end them early
    "heal_actions": f"""
SELECT event_id AS seq, {SECONDS} * 1000 AS at_ms, CAST(user_id % 9 + 1 AS BIGINT) AS node_id,
       CASE event_type WHEN 'error' THEN 'kill' WHEN 'click' THEN 'partition' WHEN 'purchase' THEN 'restart' ELSE 'reset' END AS action
FROM events WHERE event_type <> 'view' AND (event_type <> 'signup' OR event_id % 50 = 0)
""",
    "disrupt_attempts": f"""
SELECT event_id, {SECONDS} AS t, CASE WHEN user_id % 10 = 0 THEN '' ELSE '10.0.0.' || CAST(user_id % 50 AS STRING) END AS ip
FROM events WHERE event_type IN ('click', 'error')
""",
    "load_ticks": f"""
SELECT {TICK} AS tick, CAST(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) AS BIGINT) AS ok,
       CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS fail
FROM events GROUP BY 1
""",
    "presence_events": f"""
SELECT event_id, {TICK} AS tick, CASE WHEN event_type IN ('signup', 'view') THEN 1 ELSE -1 END AS delta
FROM events WHERE event_type IN ('signup', 'view', 'click', 'error')
""",
    "vote_requests": """
SELECT event_id, CAST(floor(event_id / 40) + 1 AS BIGINT) AS term,
       CAST(user_id % 7 + 1 AS BIGINT) AS candidate_id, CAST(event_id % 7 + 1 AS BIGINT) AS voter_id,
       CAST(floor(event_id / 80) AS BIGINT) AS cand_last_term, event_id + user_id % 9 - 4 AS cand_last_index,
       CAST(floor(event_id / 80) AS BIGINT) AS voter_last_term, event_id AS voter_last_index,
       CAST(floor(event_id / 45) AS BIGINT) AS voter_term, event_id % 4 AS leader_id, event_id * 13 % 1600 AS heard_ms
FROM events
""",
    "requests": """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN ' 10.1.' || CAST(user_id % 9 AS STRING) || '.7 , 9.9.9.9' ELSE '' END AS forwarded,
       CASE WHEN event_id % 11 = 0 THEN 'unix' WHEN event_id % 13 = 0 THEN '[fe80::1]:80' ELSE '10.2.0.' || CAST(user_id % 50 AS STRING) || ':443' END AS remote,
       CASE WHEN event_id % 17 = 0 THEN 'GET' ELSE 'POST' END AS method,
       CASE event_id % 8 WHEN 0 THEN '/api/nodes/3/kill' WHEN 1 THEN '/api/nodes/x/kill' WHEN 2 THEN '/api/nodes/4/dance' WHEN 3 THEN '/api/nodes/5'
         WHEN 4 THEN '/api/nodes/0/kill' WHEN 5 THEN '/api/nodes/2/kill/now' WHEN 6 THEN '/api/nodes/2/partition' ELSE '/api/nodes/' || CAST(user_id AS STRING) || '/restart' END AS path,
       event_id % 5 = 0 AS cooling, CASE WHEN event_id % 6 = 0 THEN '' WHEN event_id % 6 = 1 THEN 'x' ELSE CAST(user_id * 40 - 100 AS STRING) END AS lim, user_id % 7 AS hint
FROM events
""",
    "peer_specs": """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN ' 1=a:7001, 2=b:7002,, 3=c:7003 ' WHEN 1 THEN '' WHEN 2 THEN '1=a:1,bad,2=b:2' WHEN 3 THEN 'x=a:1' WHEN 4 THEN '1=a:1,1=b:2'
         ELSE CAST(user_id AS STRING) || ' = h' || CAST(user_id AS STRING) || ':70' END AS spec
FROM events
""",
}


def _used(sql: str) -> list[str]:
    """The tables that a text names, and those that these are made from."""
    found = [n for n in FIXTURES if n in sql]
    deeper = {m for n in found for m in _used(FIXTURES[n]) if m != n}
    return [n for n in FIXTURES if n in found or n in deeper]


def with_fixtures(sql: str) -> str:
    """The query with the tables that it names put before it, made from first ones on."""
    names = sorted(_used(sql), key=lambda n: len(_used(FIXTURES[n])))
    ctes = [f"{n} AS ({FIXTURES[n].strip()})" for n in names]
    body = sql.strip()
    if not ctes:
        return body
    for start in ("WITH RECURSIVE", "WITH"):
        if body.upper().startswith(start):
            return f"{start} {', '.join(ctes)}, {body[len(start):]}"
    return f"WITH {', '.join(ctes)} {body}"


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    for name in ("events", "orders"):
        if name in sql:
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark.sql(sql)


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return run_sql(spark, sf_dir, with_fixtures(f"SELECT * FROM {name}"))
