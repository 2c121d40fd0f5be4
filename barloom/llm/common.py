"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.session import prepare


def configured(spark: SparkSession) -> SparkSession:
    """The session with the settings that jobs on texts expect."""
    # Texts can be long: small Arrow batches keep a Python worker's memory bounded.
    prepare(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark whatever store the folder is in."""
    return configured(spark).read.parquet(f"{folder}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """A text as string, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of a partition sorted by integer ``keys``, regrouped so that no group is cut.

    Memory is one batch and one group; callers bound the size of a group before.
    """
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        start = _last_group(rows, keys)
        same = not held or all(held[-1].column(k)[-1].equals(rows.column(k)[0]) for k in keys)
        if not same:
            yield pa.concat_tables(held)
            held = []
        if start == 0:
            held.append(rows)
            continue
        yield pa.concat_tables([*held, rows.slice(0, start)])
        held = [rows.slice(start)]
    if held:
        yield pa.concat_tables(held)


def _last_group(rows: pa.Table, keys: list[str]) -> int:
    """Where the last group of a sorted table starts."""
    other = np.zeros(rows.num_rows, dtype=bool)
    for k in keys:
        values = rows.column(k).to_numpy()
        other |= values != values[-1]
    found = np.flatnonzero(other)
    return int(found[-1]) + 1 if len(found) else 0


def group_starts(*columns: np.ndarray) -> np.ndarray:
    """First row of each group of equal neighbours."""
    n = len(columns[0])
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def lowest_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest node that each of ``n`` nodes reaches over the links ``a[i] - b[i]``."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label
