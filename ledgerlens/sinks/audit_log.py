"""A durable audit log of JSON lines: appended in batches, rotated by size, read back.

The log is a folder of line files, the batches of one generation; a generation that
has grown to ``MOST_BYTES`` becomes the one before, which is then dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.storage import exists, hadoop

MOST_BYTES = 8 << 20
OLD = ".1"


def append(entries: DataFrame, path: str, batch: int, order: list[str], most_bytes: int = MOST_BYTES) -> None:
    """Writes a batch, one line an entry, in order; the same batch again replaces
    itself. If the full generation can't be moved away, it goes on growing."""
    spark = entries.sparkSession
    lines = entries.orderBy(*order).select(F.to_json(F.struct(*entries.columns)).alias("value"))
    lines.coalesce(1).write.mode("overwrite").text(f"{path}/current/{batch:012d}")  # a batch of events is small
    current, fs = hadoop(spark, f"{path}/current")
    if fs.getContentSummary(current).getLength() >= most_bytes:
        old, _ = hadoop(spark, f"{path}/current{OLD}")
        if fs.exists(old):
            fs.delete(old, True)
        fs.rename(current, old)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(batch, n, line) of the current generation; none if it was never written."""
    if not exists(spark, f"{path}/current"):
        return spark.createDataFrame([], "batch string, n long, line string")
    text = spark.read.text(f"{path}/current/*", wholetext=True)
    batch = F.element_at(F.split(F.input_file_name(), "/"), -2)
    each = text.select(batch.alias("batch"), F.posexplode(F.split("value", "\n")).alias("n", "line"))
    return each.where(F.col("line") != "").select("batch", F.col("n").cast("long").alias("n"), "line")


def tail(spark: SparkSession, path: str, limit: int) -> DataFrame:
    """The last ``limit`` lines, oldest first (place from 1); all if it is 0."""
    rows = lines(spark, path)
    if limit > 0:
        rows = rows.orderBy(F.desc("batch"), F.desc("n")).limit(limit)
    return rows.withColumn("place", F.row_number().over(Window.orderBy("batch", "n"))).select("place", "line")
