"""Rules around a control plane and its load: requests, presence, throughput."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import audit_limit

ACTIONS = ("kill", "restart", "partition")


def client_ip(requests: DataFrame) -> DataFrame:
    """requests(event_id, forwarded, remote): the first forwarded address, else the
    host of host:port, else all of it."""
    host = F.regexp_extract("remote", r"^\[([^\[\]]*)\]:[^:\[\]]*$", 1)
    plain = F.regexp_extract("remote", r"^([^:\[\]]*):[^:\[\]]*$", 1)
    bracketed = F.col("remote").rlike(r"^\[[^\[\]]*\]:[^:\[\]]*$")
    simple = F.col("remote").rlike(r"^[^:\[\]]*:[^:\[\]]*$")
    ip = F.when(F.col("forwarded") != "", F.trim(F.split_part("forwarded", F.lit(","), F.lit(1)))).when(bracketed, host).when(simple, plain).otherwise(F.col("remote"))
    return requests.select("event_id", ip.alias("ip"))


def route_parse(requests: DataFrame) -> DataFrame:
    """requests(event_id, method, path, cooling): (event_id, id, action, code). Only
    posts to /api/nodes/{id}/{action} of a node id over 0 and a known action pass; an
    address that must wait gets 429."""
    path = F.regexp_replace("path", "^/api/nodes/", "")
    parts = F.split(path, "/")
    number = F.when(F.get(parts, F.lit(0)).rlike("^[0-9]+$"), F.get(parts, F.lit(0)).try_cast("decimal(20,0)"))
    node, action = number.try_cast("long"), F.get(parts, F.lit(1))
    good = (F.size(parts) == 2) & F.coalesce(node > 0, F.lit(False)) & action.isin(*ACTIONS)
    code = F.when(F.col("method") != "POST", 405).when(~good, 400).when(F.col("cooling"), 429).otherwise(200)
    return requests.select("event_id", F.when(good, node).alias("id"), F.when(good, action).alias("action"), code.alias("code"))


def parse_peers(specs: DataFrame) -> DataFrame:
    """specs(event_id, spec) of id=address items: (event_id, error, id, addr), one row
    an item, the last one of an id; blank items are passed over. One item without = or
    with an id that is no number spoils the whole, which is then one row."""
    items = F.filter(F.transform(F.split("spec", ","), lambda x: F.trim(x)), lambda x: x != "")
    cut = F.transform(items, lambda x, i: F.struct(i.alias("i"), F.trim(F.substring_index(x, "=", 1)).alias("id"), F.trim(x.substr(F.locate("=", x) + 1, F.length(x))).alias("addr"), F.contains(x, F.lit("=")).alias("cut")))
    rows = specs.select("event_id", cut.alias("items"))
    odd = F.exists("items", lambda x: ~x["cut"] | ~x["id"].rlike("^[0-9]{1,18}$"))
    good = rows.where(~odd).select("event_id", F.explode("items").alias("x"))
    good = good.groupBy("event_id", F.col("x.id").cast("long").alias("id")).agg(F.max_by("x.addr", "x.i").alias("addr"))
    bad = rows.where(odd).select("event_id", F.lit("want id=host:port").alias("error"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("addr"))
    return good.select("event_id", F.lit(None).cast("string").alias("error"), "id", "addr").union(bad)


def leader_try_order(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """requests(event_id, hint), nodes(node_id): (event_id, node_id, attempt), the
    hinted node first if it is known, the others by id. The nodes are few."""
    own = Window.partitionBy("event_id").orderBy(F.col("node_id") != F.col("hint"), "node_id")
    return requests.select("event_id", "hint").join(F.broadcast(nodes.where(F.col("node_id") <= 64))).select("event_id", "node_id", F.row_number().over(own).alias("attempt"))


def loadgen_log(spark: SparkSession, commands: int, workers: int, keys: int = 10_000, reads: bool = False) -> DataFrame:
    """Synthetic load: each worker counts its commands from 1; the key is the count
    modulo ``keys``, the value the count, the client the worker's own."""
    n = F.floor(F.col("id") / workers) + 1
    worker, kind = (F.col("id") % workers).cast("string"), "r" if reads else "w"
    out = spark.range(commands).select(
        (F.col("id") + 1).alias("idx"), F.lit(1 if reads else 2).alias("op"), F.concat(F.lit(f"loadgen-{kind}-"), worker).alias("client_id"), n.alias("request_id"),
        F.concat(F.lit("load/w/"), (n % keys).cast("string")).alias("k"), (F.lit("") if reads else n.cast("string")).alias("v"), F.lit("").alias("expect"),
    )
    return out


def heartbeats(ticks: DataFrame, key: str = "demo/heartbeat", client: str = "traffic") -> DataFrame:
    """ticks(tick, ok): one put of a key each tick, by one client; its request number
    is used again after a failure."""
    before = Window.orderBy("tick").rowsBetween(Window.unboundedPreceding, -1)
    request = F.coalesce(F.sum(F.col("ok").cast("long")).over(before), F.lit(0).cast("long")) + 1
    return ticks.select("tick", F.lit(2).alias("op"), F.lit(client).alias("client_id"), request.alias("request_id"), F.lit(key).alias("k"), F.col("tick").cast("string").alias("v"))


def throughput_report(totals: DataFrame, seconds: float) -> DataFrame:
    """totals(tick, ok, fail) in each tick: (tick, total, per_sec, fail), the change of
    the running totals over the time between reports."""
    order = Window.orderBy("tick")
    done = F.sum("ok").over(order)
    rows = totals.select("tick", "fail", done.alias("total"), ((F.col("tick") - F.lag("tick", 1).over(order)) * seconds).alias("dt"))
    return rows.select("tick", "total", F.round((F.col("total") - F.lag("total").over(order)) / F.col("dt"), 9).alias("per_sec"), "fail")


def active_viewers(presence: DataFrame) -> DataFrame:
    """presence(event_id, tick, delta) of +1 and -1: (event_id, viewers), never under
    0. Sums and least prefixes are taken within each tick, then once over ticks, so
    that no task sorts all events."""
    inside = Window.partitionBy("tick").orderBy("event_id")
    rows = presence.withColumn("s", F.sum("delta").over(inside))
    rows = rows.withColumn("low", F.min("s").over(inside))
    past = Window.orderBy("tick").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("tick").agg(F.sum("delta").alias("d"), F.min("s").alias("least"))
    sums = sums.withColumn("before", F.coalesce(F.sum("d").over(past), F.lit(0)))  # one row a tick
    sums = sums.withColumn("floor", F.least(F.lit(0), F.coalesce(F.min(F.col("before") + F.col("least")).over(past), F.lit(0))))
    s = F.col("before") + F.col("s")
    return rows.join(sums.select("tick", "before", "floor"), "tick").select("event_id", (s - F.least(F.col("floor"), F.col("before") + F.col("low"))).cast("long").alias("viewers"))


def limit_of(requests: DataFrame) -> DataFrame:
    """requests(event_id, lim): how many audit lines each is served."""
    return requests.select("event_id", audit_limit(F.col("lim")).alias("served"))
