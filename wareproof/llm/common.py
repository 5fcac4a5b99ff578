"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

import wareproof
from wareproof.session import scratch_path

_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Make this package importable on executors that do not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(wareproof.__path__[0])
    folder = tempfile.mkdtemp(prefix="wareproof-")
    archive = shutil.make_archive(f"{folder}/wareproof", "zip", package.parent, package.name)
    context.addPyFile(archive)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # executors may ask for it at any time
    _shipped.add(context.applicationId)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back. Later steps neither recompute it nor lose
    it with an executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(batches: Iterator[pa.RecordBatch], column: str, budget: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds at most ``budget`` bytes in each, or a single row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + budget, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def spread_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[0], starts[0]+1, ... of all ranges, one range after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def sums_of(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of ``values``; empty stretches sum to zero."""
    total = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]
