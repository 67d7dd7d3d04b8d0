"""Snapshots of the state machine and of replicated logs, and recovery from them.

A snapshot is a folder of tables of its own; a pointer file names the current one and
is replaced by a rename, so a reader sees a whole snapshot or the one before.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import kv
from ..sources.storage import exists, hadoop, written

POINTER = "CURRENT"
SCHEMAS = {
    "data": "key string, value string",
    "dedup": "client_id string, request_id long, found boolean, value string",
    "clients": "client_id string, top long",
    "meta": "idx long, applies long",
}


@dataclass
class Snapshot:
    """Values by key, answers by (client, request), the highest request of each
    client, and up to which index and after how many tracked commands."""

    data: DataFrame
    dedup: DataFrame
    clients: DataFrame
    meta: DataFrame
    idx: int = 0


def empty(spark: SparkSession) -> Snapshot:
    return Snapshot(*(spark.createDataFrame([], s) for s in SCHEMAS.values()))


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file in full or not at all."""
    tmp, fs = hadoop(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode()))
    out.close()
    where, _ = hadoop(spark, path)
    if not fs.rename(tmp, where):
        fs.delete(where, False)
        fs.rename(tmp, where)


def get_text(spark: SparkSession, path: str) -> str | None:
    return "\n".join(r.value for r in spark.read.text(path).collect()) if exists(spark, path) else None


def load(spark: SparkSession, path: str) -> Snapshot:
    """The current snapshot of a folder; an empty one if there is none."""
    pointer = get_text(spark, f"{path}/{POINTER}")
    if not pointer:
        return empty(spark)
    at = json.loads(pointer)
    tables = [spark.read.schema(s).parquet(f"{path}/{at['version']}/{name}") for name, s in SCHEMAS.items()]
    return Snapshot(*tables, at["idx"])


def _split(tail: DataFrame, dedup: DataFrame) -> DataFrame:
    """tail with first_idx, and ``old``, the answer that the snapshot has for the pair."""
    old = dedup.select(F.col("client_id").alias("_c"), F.col("request_id").alias("_r"), F.struct("found", "value").alias("old"))
    pair = kv.tracked() & (F.col("client_id") == F.col("_c")) & (F.col("request_id") == F.col("_r"))
    return kv.first_of_pair(tail).join(old, pair, "left").drop("_c", "_r")


def _fresh(base: Snapshot, log: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    tail = _split(log.where(F.col("idx") > base.idx), base.dedup)
    run = tail.where("idx = first_idx AND old IS NULL").withColumn("key", kv.effective_key())
    seeds = base.data.select(F.lit(kv.SEED).cast("long").alias("idx"), F.lit(kv.PUT).alias("op"), F.col("value").alias("v"), F.lit("").alias("expect"), "key")
    return tail, run, kv.results_of(seeds.unionByName(run.select("idx", "op", "v", "expect", "key")))


def replay(base: Snapshot, log: DataFrame) -> DataFrame:
    """(idx, found, value, duplicate) of the commands behind the snapshot; those that
    it has are passed over, so an overlap does no harm."""
    tail, _, done = _fresh(base, log)
    answers = tail.join(done.select(F.col("idx").alias("first_idx"), "found", "value"), "first_idx", "left")
    pick = lambda c: F.when(F.col("old").isNotNull(), F.col(f"old.{c}")).otherwise(F.col(c)).alias(c)
    return answers.select("idx", pick("found"), pick("value"), (F.col("old").isNotNull() | (F.col("idx") != F.col("first_idx"))).alias("duplicate"))


def recover(base: Snapshot, log: DataFrame) -> DataFrame:
    """(key, value) after the snapshot and the commands behind it."""
    return kv.last_value(_fresh(base, log)[2])


def save(base: Snapshot, log: DataFrame, path: str, idx: int) -> Snapshot:
    """Writes the state after index ``idx`` as a new version and points to it."""
    spark = log.sparkSession
    _, run, done = _fresh(base, log.where(F.col("idx") <= idx))
    fresh = run.where(kv.tracked()).select("idx", "client_id", "request_id").join(done.select("idx", "found", "value"), "idx")
    version = f"v{idx}-{uuid.uuid4().hex}"
    where = f"{path}/{version}"
    data = written(kv.last_value(done), f"{where}/data")
    dedup = written(base.dedup.unionByName(fresh.select("client_id", "request_id", "found", "value")), f"{where}/dedup")
    clients = written(dedup.groupBy("client_id").agg(F.max("request_id").alias("top")), f"{where}/clients")
    meta = written(dedup.agg(F.lit(idx).cast("long").alias("idx"), F.count("*").alias("applies")), f"{where}/meta")
    put_text(spark, f"{path}/{POINTER}", json.dumps({"version": version, "idx": idx}))
    return Snapshot(data, dedup, clients, meta, idx)


def rows(snapshot: Snapshot) -> DataFrame:
    """All tables of a snapshot as one: (part, name, request_id, found, val, n)."""
    none = lambda t: F.lit(None).cast(t)
    parts = [
        snapshot.data.select(F.lit("data").alias("part"), F.col("key").alias("name"), none("long").alias("request_id"), none("boolean").alias("found"), F.col("value").alias("val"), none("long").alias("n")),
        snapshot.dedup.select(F.lit("dedup"), "client_id", "request_id", "found", "value", none("long")),
        snapshot.clients.select(F.lit("clients"), "client_id", none("long"), none("boolean"), none("string"), "top"),
        snapshot.meta.select(F.lit("meta"), none("string"), none("long"), none("boolean"), none("string"), "applies"),
    ]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


# replicated logs


def rewritten(log: DataFrame, hard: DataFrame) -> DataFrame:
    """The write-ahead log of each node as it is written anew around a snapshot: its
    hard state, then the entries that are left, (node_id, seq, tag, term,
    index_or_from, voted_for)."""
    zero = F.lit(0).cast("long")
    entries = log.where("NOT sentinel").select("node_id", F.row_number().over(Window.partitionBy("node_id").orderBy("log_index")).cast("long").alias("seq"), F.lit(2).alias("tag"), "term", F.col("log_index").alias("index_or_from"), zero.alias("voted_for"))
    return hard.select("node_id", zero.alias("seq"), F.lit(1).alias("tag"), "term", zero.alias("index_or_from"), F.col("voted_for").cast("long").alias("voted_for")).union(entries)


def persist(wal: DataFrame, path: str) -> None:
    """Appends hard states, entries and markers to a table by node."""
    wal.write.mode("append").partitionBy("node_id").parquet(path)


def raft_snapshot(files: DataFrame) -> DataFrame:
    """files(path, content) of raw snapshots: (path, pos, term, data); a file that is
    too short for its header is an error."""
    from ..sources.binary import uint

    content = F.col("content")
    size = F.when(F.length(content) >= 16, F.length(content)).otherwise(F.raise_error(F.concat(F.lit("short snapshot "), "path")))
    return files.where(size.isNotNull()).select("path", uint(content, 1, 8).cast("long").alias("pos"), uint(content, 9, 8).cast("long").alias("term"), F.substring(content, F.lit(17), F.length(content)).alias("data"))
