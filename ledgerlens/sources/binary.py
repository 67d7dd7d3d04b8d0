"""Binary records: framed write-ahead logs, commands, and log records.

All integers are big-endian. A frame is payload length u32, CRC-32C of the payload
u32, payload; a scan ends silently at the first short or damaged frame. Records are
put together and taken apart with column expressions; Python is left for checksums,
many rows at a time, and for the variable-length integers of log entries.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.fold import ship

HEADER = 8


def _table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = (out >> 1) ^ np.where(out & 1, np.uint32(0x82F63B78), np.uint32(0))
    return out


CRC_TABLE = _table()


def crc32c_many(payloads: list[bytes]) -> np.ndarray:
    """CRC-32C of each payload; one step for each byte of the longest, over all that
    are at least so long."""
    sizes = np.fromiter(map(len, payloads), np.int64, len(payloads))
    out = np.full(len(payloads), 0xFFFFFFFF, np.uint32)
    data = np.frombuffer(b"".join(payloads) or b"\0", np.uint8)
    at = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    left = np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0))), side="left")  # so many are longer than i
    for i, n in enumerate(left):
        rows = order[:n]
        out[rows] = CRC_TABLE[(out[rows] ^ data[at[rows] + i]) & 255] ^ (out[rows] >> 8)
    return out ^ np.uint32(0xFFFFFFFF)


def crc32c(data: bytes) -> int:
    return int(crc32c_many([data])[0])


def frame(payload: bytes) -> bytes:
    return struct.pack(">II", len(payload), crc32c(payload)) + payload


def frames(data: bytes, most: int = 4096) -> Iterator[tuple[int, bytes]]:
    """(offset after the frame, payload) of each valid frame; checked ``most`` at once."""
    at = 0
    while True:
        found, sums = [], []
        while len(found) < most and at + HEADER <= len(data):
            size, crc = struct.unpack_from(">II", data, at)
            if at + HEADER + size > len(data):
                break
            at += HEADER + size
            found.append((at, data[at - size : at]))
            sums.append(crc)
        if not found:
            return
        good = crc32c_many([p for _, p in found]) == np.array(sums, np.uint32)
        for one, fine in zip(found, good):
            if not fine:
                return
            yield one


# column expressions


def uint(data: Column, at: Column | int, n: int) -> Column:
    """The unsigned integer of n bytes from a place, from 1; null if it isn't all there."""
    at = F.lit(at) if isinstance(at, int) else at
    piece = F.conv(F.hex(F.substring(data, at, F.lit(n))), 16, 10)
    return F.when(at + n - 1 <= F.length(data), piece.cast("decimal(20,0)") if n > 7 else piece.cast("long"))


def big_endian(value: Column, n: int) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * n, "0"))


def sized(text: Column) -> Column:
    data = F.encode(text, "UTF-8")
    return F.concat(big_endian(F.length(data), 4), data)


def crc32c_column(payload: Column) -> Column:
    @F.pandas_udf("long")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series(crc32c_many([bytes(v) for v in values]).astype(np.int64))

    return run(payload)


def framed(payload: Column) -> Column:
    return F.concat(big_endian(F.length(payload), 4), big_endian(crc32c_column(payload), 4), payload)


def storage_payload(op: Column, key: Column, value: Column) -> Column:
    return F.concat(big_endian(op, 1), sized(key), F.encode(value, "UTF-8"))


def kv_payload(op: Column, client: Column, request: Column, key: Column, expect: Column, value: Column) -> Column:
    return F.concat(big_endian(op, 1), sized(client), big_endian(request, 8), sized(key), sized(expect), F.encode(value, "UTF-8"))


def _text(data: Column, at: Column, n: Column) -> Column:
    return F.decode(F.substring(data, at, n), "UTF-8")


def storage_decode(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """rows with op, k, v and ``error``, which is set if the record is too short."""
    data, size = F.col(payload), F.length(payload)
    n = uint(data, 2, 4)
    short = F.coalesce(n + 5 > size, F.lit(True))
    fine = lambda c: F.when(~short, c)
    return rows.select(
        *[c for c in rows.columns if c != payload], fine(uint(data, 1, 1)).cast("int").alias("op"), fine(_text(data, F.lit(6), n.cast("int"))).alias("k"),
        fine(_text(data, n.cast("int") + 6, size - n.cast("int") - 5)).alias("v"), F.when(short, "short record").alias("error"),
    )


def kv_decode(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """rows with op, client_id, request_id, k, expect, v and ``error``; every field is
    checked against the record's end."""
    data, size = F.col(payload), F.length(payload).cast("long")
    out = rows.withColumn("_n1", uint(data, 2, 4))
    out = out.withColumn("_p2", F.col("_n1") + 6)  # request, then the key's length
    out = out.withColumn("_n2", F.when(F.col("_p2") + 11 <= size, uint(data, (F.col("_p2") + 8).cast("int"), 4)))
    out = out.withColumn("_p3", F.col("_p2") + 12 + F.col("_n2"))
    out = out.withColumn("_n3", F.when(F.col("_p3") + 3 <= size, uint(data, F.col("_p3").cast("int"), 4)))
    out = out.withColumn("_p4", F.col("_p3") + 4 + F.col("_n3"))
    short = F.coalesce(F.col("_p4") - 1 > size, F.lit(True))
    fine = lambda c: F.when(~short, c)
    i = lambda c: F.col(c).cast("int")
    return out.select(
        *[c for c in rows.columns if c != payload], fine(uint(data, 1, 1)).cast("int").alias("op"), fine(_text(data, F.lit(6), i("_n1"))).alias("client_id"),
        fine(uint(data, i("_p2"), 8)).cast("long").alias("request_id"), fine(_text(data, i("_p2") + 12, i("_n2"))).alias("k"), fine(_text(data, i("_p3") + 4, i("_n3"))).alias("expect"),
        fine(_text(data, i("_p4"), F.length(payload) - i("_p4") + 1)).alias("v"), F.when(short, "short record").alias("error"),
    )


# records of replicated logs


def varint(n: int) -> bytes:
    out = b""
    while True:
        n, low = n >> 7, n & 127
        out += bytes([low | (128 if n else 0)])
        if not n:
            return out


def encode_raft(tag: int, term: int = 0, index_or_vote: int = 0, data: bytes = b"") -> bytes:
    """Tag 1 hard state (term, vote), 2 log entry, 3 truncate from an index."""
    if tag == 1:
        return struct.pack(">BQQ", 1, term, index_or_vote)
    if tag == 3:
        return struct.pack(">BQ", 3, index_or_vote)
    body = b"\x08" + varint(index_or_vote) if index_or_vote else b""
    body += b"\x10" + varint(term) if term else b""
    return b"\x02" + body + (b"\x1a" + varint(len(data)) + data if data else b"")


def entry_fields(body: bytes) -> dict[int, int | bytes]:
    """Fields of a protobuf message of integers and byte strings."""
    at, out = 0, {}

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            if at >= len(body):
                raise ValueError("short record")
            b = body[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(body):
        key = number()
        if key & 7 == 0:
            out[key >> 3] = number()
            continue
        if key & 7 != 2:
            raise ValueError(f"wire type {key & 7}")
        n = number()
        if at + n > len(body):
            raise ValueError("short record")
        out[key >> 3] = body[at : at + n]
        at += n
    return out


def decode_raft(record: bytes) -> tuple[int, int, int, bytes]:
    """(tag, term, index, from or vote, data); unknown tags and sizes are errors."""
    tag = record[0] if record else 0
    if tag == 1 and len(record) == 17:
        return tag, *struct.unpack_from(">QQ", record, 1), b""
    if tag == 3 and len(record) == 9:
        return tag, 0, struct.unpack_from(">Q", record, 1)[0], b""
    if tag != 2:
        raise ValueError(f"record of tag {tag} and {len(record)} bytes")
    fields = entry_fields(record[1:])
    return tag, int(fields.get(2, 0)), int(fields.get(1, 0)), bytes(fields.get(3, b""))


def raft_decode(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """rows with tag, term, index_or_from, voted_for, data and ``error``."""
    ship(rows.sparkSession)
    kept = [c for c in rows.columns if c != payload]
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != payload)

    def one(record: bytes) -> tuple:
        try:
            tag, term, at, data = decode_raft(record)
        except ValueError as e:
            return None, None, None, None, None, str(e)
        return (tag, term, 0, at, None, None) if tag == 1 else (tag, term, at, 0, data if tag == 2 else None, None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = pd.DataFrame([one(bytes(p)) for p in pdf[payload]], columns=["tag", "term", "index_or_from", "voted_for", "data", "error"]).astype({c: "Int64" for c in ("tag", "term", "index_or_from", "voted_for")})
            yield pd.concat([pdf[kept].reset_index(drop=True), got], axis=1)

    return rows.mapInPandas(run, f"{schema}, tag int, term long, index_or_from long, voted_for long, data binary, error string")


def raft_payload(rows: DataFrame) -> DataFrame:
    """raft_wal rows with ``payload``; tags 1 and 3 have fixed widths, entries don't."""
    ship(rows.sparkSession)

    @F.pandas_udf("binary")
    def entry(term: pd.Series, index: pd.Series) -> pd.Series:
        return pd.Series([encode_raft(2, int(t), int(i), b"x") for t, i in zip(term, index)])

    hard = F.concat(big_endian(F.lit(1), 1), big_endian(F.col("term"), 8), big_endian(F.col("voted_for"), 8))
    cut = F.concat(big_endian(F.lit(3), 1), big_endian(F.col("index_or_from"), 8))
    return rows.withColumn("payload", F.when(F.col("tag") == 1, hard).when(F.col("tag") == 3, cut).otherwise(entry("term", "index_or_from")))


# files


def scan_frames(spark: SparkSession, path: str) -> DataFrame:
    """(path, seq, offset, payload) of write-ahead logs: files in parallel, frames of
    one file in order. A missing path is an empty log. Spark hands over a file as one
    value, so a file has at most 2 GB."""
    from .storage import exists

    schema = "path string, seq long, offset long, payload binary"
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"]):
                rows = [(p, i, at, payload) for i, (at, payload) in enumerate(frames(bytes(content)))]
                for s in range(0, len(rows), 4096):
                    yield pd.DataFrame(rows[s : s + 4096], columns=["path", "seq", "offset", "payload"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def write_frames(rows: DataFrame, path: str, file: str, order: str) -> None:
    """rows(.., payload): one log file for each value of ``file``, frames in order.
    A task writes under a name of its own and renames, so a repeated one is harmless."""
    from pyarrow import fs

    ship(rows.sparkSession)
    target = path if "://" in path else f"file://{path.removeprefix('file:')}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        system, root = fs.FileSystem.from_uri(target)
        system.create_dir(root, recursive=True)
        name, out, tmp = None, None, ""

        def close() -> None:
            if out is not None:
                out.close()
                system.move(tmp, f"{root}/{name}.wal")

        for pdf in batches:
            for own, record in zip(pdf[file], pdf["frame"]):
                if own != name:
                    close()
                    name, tmp = own, f"{root}/.{own}-{TaskContext.get().taskAttemptId()}"
                    out = system.open_output_stream(tmp)
                out.write(record)
        close()
        yield pd.DataFrame({"done": [1]})

    data = rows.select(file, order, framed(F.col("payload")).alias("frame"))
    data.repartition(file).sortWithinPartitions(file, order).select(file, "frame").mapInPandas(run, "done int").collect()
