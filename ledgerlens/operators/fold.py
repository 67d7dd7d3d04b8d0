"""Recurrences over ordered rows, one state a key, in batch and as a stream.

Rows are dealt by key and sorted by Spark, which spills, and each task streams
its keys with one state in memory; a key is sequential by nature, keys are not.
"""

from __future__ import annotations

import pickle
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from tempfile import mkdtemp
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Step = Callable[[Any, tuple], tuple[Any, tuple]]


def ship(spark: SparkSession) -> None:
    """Gives this package to the executors, once a context."""
    sc = spark.sparkContext
    if getattr(sc, "_ledgerlens_code", False):
        return
    root = Path(__file__).resolve().parents[1]
    where = Path(mkdtemp(prefix="ledgerlens-code-")) / "ledgerlens_code.zip"
    with zipfile.ZipFile(where, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    sc.addPyFile(str(where))
    sc._ledgerlens_code = True


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names).convert_dtypes(convert_string=False, convert_floating=False)


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], Any], step: Step, out: str) -> DataFrame:
    """For each row, in order within its key, ``step(state, row)`` gives the next
    state and the output row. Rows are tuples of df's columns."""
    ship(df.sparkSession)
    at = [df.columns.index(k) for k in keys]
    names = [c.split()[0] for c in out.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key: Any = None
        state: Any = None
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False, name=None):
                own = tuple(row[i] for i in at)
                if own != key:
                    key, state = own, start()
                state, result = step(state, row)
                rows.append(result)
            yield _frame(rows, names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, out)


def streaming_fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], Any], step: Step, out: str) -> DataFrame:
    """The same over a stream: states live in the state store and survive a restart
    from the checkpoint. Rows of one micro-batch are sorted; a row that comes before
    one of an earlier micro-batch is an error, as the state can't be taken back."""
    ship(df.sparkSession)
    columns, names = df.columns, [c.split()[0] for c in out.split(",")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, last = pickle.loads(held.get[0]) if held.exists else (start(), None)
        pdf = pd.concat(list(batches)).sort_values(order)[columns]
        at, rows = [columns.index(c) for c in order], []
        for row in pdf.itertuples(index=False, name=None):
            place = tuple(row[i] for i in at)
            if last is not None and place < last:
                raise ValueError(f"row {place} of {key} came after {last}")
            last = place
            state, result = step(state, row)
            rows.append(result)
        held.update((pickle.dumps((state, last)),))
        yield _frame(rows, names)

    return df.groupBy(*keys).applyInPandasWithState(run, out, "state binary", "append", GroupStateTimeout.NoTimeout)
