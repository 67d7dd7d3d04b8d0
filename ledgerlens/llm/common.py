"""Small helpers that the operators of this subpackage share.

Words of ASCII white space: Arrow's ``ascii_lower`` touches A-Z alone and
``ascii_split_whitespace`` cuts at 0x20 and 0x09-0x0D alone, which is what the
word definitions of these operators ask for.
"""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import suppress
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Words handled at once in a Python worker; bounds its memory.
WORDS_AT_ONCE = 200_000
#: Bytes of an Arrow batch between Spark and a Python worker, unless the session sets
#: another: Spark's default of 64 MB, or 10,000 texts, is held several times over on
#: both sides, outside of Java's heap.
BATCH_BYTES = 4 << 20
U64 = np.uint64


def ship(spark: SparkSession) -> None:
    """Gives this package to the executors, once a context: they need not have it
    installed, nor share the driver's folders. Bounds the session's Arrow batches."""
    sc = spark.sparkContext
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(setting, None) is None:
        spark.conf.set(setting, BATCH_BYTES)
    if getattr(sc, "_ledgerlens_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    where = Path(tempfile.mkdtemp(prefix="ledgerlens-code-")) / f"{root.name}.zip"
    with zipfile.ZipFile(where, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    sc.addPyFile(str(where))
    sc._ledgerlens_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col: str, modulus: int) -> Column:
    """crc32 of a column as text, modulo a number; null if the column is."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % modulus


def lower_az(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one if it is unset and all of
    Spark runs on this machine. A cluster must name a folder that all share."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = sc._ledgerlens_dir = getattr(sc, "_ledgerlens_dir", None) or tempfile.mkdtemp(prefix="ledgerlens-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends here,
    so a lost executor costs no recomputation of what came before, and the
    shuffle files behind the table are dropped once it is written. The table goes
    with ``discard``, at the latest when Python ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ledgerlens-{uuid.uuid4().hex}"
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, "false")
    spark.conf.set(setting, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(setting, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._ledgerlens_path = path
    atexit.register(_remove, spark, path)
    return out


def _remove(spark: SparkSession, path: str) -> None:
    with suppress(Exception):  # the session may have ended before Python does
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing will read again."""
    for df in tables:
        if path := getattr(df, "_ledgerlens_path", None):
            _remove(df.sparkSession, path)


def give_back() -> None:
    """Returns freed memory to the system, which allocators else hold on to."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cuts batches so that one slice has a few MB of text (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(sizes):
            before = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, before + 6 * WORDS_AT_ONCE, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
            give_back()


def fresh(texts: pa.Array) -> pa.Array:
    """The texts, null as empty, in buffers of their own: Arrow's ascii_lower
    misreads a slice that was cast to large_string."""
    texts = texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string())
    return pc.fill_null(texts, "")


def words_of(texts: pa.Array, lower: bool) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and where each text's words begin
    (len(texts) + 1 offsets). Null has none."""
    texts = fresh(texts)
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    if not full.all():  # white space at either end leaves empty strings
        flat = flat.filter(pa.array(full))
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
    return flat, offsets


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of every word; equal words are hashed once."""
    if not len(words):
        return np.empty(0, U64)
    coded = words.dictionary_encode()
    each = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()), U64, len(coded.dictionary))
    return each[coded.indices.to_numpy()]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every bit comes to depend on all others."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def window_hashes(hashes: np.ndarray, width: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of each run of ``width`` neighbours: a polynomial modulo 2**64 in an
    odd base, from one running sum. Shorter input gives none."""
    n = len(hashes)
    if n < width:
        return np.empty(0, U64)
    inverse = pow(base, -1, 1 << 64)
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(hashes * powers(base, n), dtype=U64)])
    return mix((sums[width:] - sums[:-width]) * powers(inverse, n)[: n - width + 1])


def starts_inside(offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For windows over many texts laid end to end: global start, row and start
    within the row, of those windows that lie within one text."""
    sizes = np.diff(offsets)
    count = np.maximum(sizes - width + 1, 0)
    row = np.repeat(np.arange(len(sizes)), count)
    local = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return offsets[:-1][row] + local, row, local


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of rows sorted by ``keys``: each yielded table holds all rows
    of one or more keys, and no key is in two tables."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        n, same = batch.num_rows, np.ones(batch.num_rows, bool)
        for k in keys:
            col = batch.column(k)
            same &= pc.equal(col, col[n - 1]).to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        first = not cut and held and all(held[-1].column(k)[-1] == batch.column(k)[0] for k in keys)
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        elif first or not held:
            held.append(batch)
        else:
            yield pa.Table.from_batches(held)
            held = [batch]
    if held:
        yield pa.Table.from_batches(held)


def ids_are_keys(docs: DataFrame) -> bool:
    """Whether the ids are whole, unique and not null."""
    if dict(docs.dtypes)["doc_id"] not in ("bigint", "int", "smallint", "tinyint"):
        return False
    n = docs.agg(F.count("*").alias("all"), F.countDistinct("doc_id").alias("ids")).first()
    return n["all"] == n["ids"]


def plain_names(docs: DataFrame) -> DataFrame:
    """docs with names that no helper column has: all but doc_id and text become c0,
    c1, ...; ``toDF(*docs.columns)`` gives the old ones back."""
    return docs.toDF(*[n if n in ("doc_id", "text") else f"c{i}" for i, n in enumerate(docs.columns)])


def keyed(docs: DataFrame, key: str = "__key") -> tuple[DataFrame, bool]:
    """docs with a whole number that tells documents apart and orders them: the
    doc_id, if ids are whole, unique and not null (second result). Else rows of the
    same id and text are one document, null ids come last, and texts of one id are
    ordered by their hash; the numbers are those of rows sorted over all partitions."""
    if ids_are_keys(docs):
        return docs.withColumn(key, F.col("doc_id").cast("long")).where(F.col(key).isNotNull()), True
    own = F.coalesce(F.xxhash64("text"), F.lit(0))
    pairs = docs.select(F.col("doc_id").alias("__id"), own.alias("__h")).distinct().orderBy(F.col("__id").asc_nulls_last(), "__h")
    numbers = materialize(pairs.withColumn(key, F.monotonically_increasing_id()))
    return docs.join(numbers, F.col("doc_id").eqNullSafe(F.col("__id")) & (own == F.col("__h"))).drop("__id", "__h"), False


def packed_spans(starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Spans as one long each: start above, stop below."""
    return (starts.astype(np.int64) << 32) | stops.astype(np.int64)


def span_mask(spans: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in a packed span."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, np.clip(spans >> 32, 0, n), 1)
    np.add.at(edge, np.clip(spans & 0xFFFFFFFF, 0, n), -1)
    return np.cumsum(edge)[:n] > 0


def merged_runs(keys: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of spans by key, as disjoint spans sorted by key and start."""
    if not len(keys):
        return keys, starts, stops
    order = np.lexsort((starts, keys))
    keys, starts, stops = keys[order], starts[order].astype(np.int64), stops[order].astype(np.int64)
    first = np.concatenate([[True], keys[1:] != keys[:-1]])
    lift = np.cumsum(first) * (int(stops.max()) + 2)  # sets keys apart, so one running maximum will do
    reach = np.maximum.accumulate(stops + lift)
    new = first | np.concatenate([[True], (starts + lift)[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    ends = np.concatenate([at[1:], [len(keys)]]) - 1
    return keys[at], starts[at], reach[ends] - lift[ends]
