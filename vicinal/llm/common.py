"""Helpers that the corpus operators share."""

from __future__ import annotations

import sys
import threading
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vicinal.sources.interim import dropped, work_dir, written  # noqa: F401

#: The six ASCII white-space characters, as a Java regular expression.
SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The maximal runs of characters that are not ASCII white space; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


_LOCK, _WRITING = threading.Lock(), []


@contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go with the query that wrote them; the setting is put back when the last of several concurrent writers is done."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    with _LOCK:
        _WRITING.append(_WRITING[0] if _WRITING else spark.conf.get(key))
        spark.conf.set(key, "true")
    try:
        yield
    finally:
        with _LOCK:
            before = _WRITING.pop()
            if not _WRITING:
                spark.conf.set(key, before)


def spool(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, keeps columns prunable, survives lost executors.

    Its shuffle files go when the table is written, instead of when the driver happens to collect its garbage. The table goes by
    ``unspool``, at the latest when the application ends.
    """
    with _cleaning(df.sparkSession):
        return written(df, name)


def unspool(*tables: DataFrame) -> None:
    """Delete what ``spool`` wrote, once nothing that is still to be computed reads it."""
    dropped(*tables)


def prefix_sums(df: DataFrame, keys: Sequence[str], block: Sequence[str], order: Sequence[Column], measure: Column, out: str, extra: DataFrame | None = None) -> DataFrame:
    """Add ``out``: the sum of ``measure`` (long) over all rows of the same ``keys`` before this one, in the order of ``block``, then ``order``.

    A key may hold any share of the rows: only the blocks' totals meet by key, and rows are sorted within (key, block).
    ``block`` columns must not be null. ``extra`` has columns to add by ``keys``; it goes over the blocks' totals too.
    """
    at = [*keys, *block]
    totals = df.groupBy(*at).agg(F.sum(measure).alias("_total"))
    before = Window.partitionBy(*keys).orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    if extra is not None:
        totals = totals.join(extra, list(keys))
    within = Window.partitionBy(*at).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.join(totals, at).withColumn(out, F.col("_before") + F.sum(measure).over(within) - measure).drop("_before")


def parts(batches: Iterator[pa.RecordBatch], text: int = 1, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches with about ``most`` bytes in the column ``text``, a row at least; what a worker holds as Python objects is so bounded."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < len(sizes):
            to = at + max(1, int(np.searchsorted(np.cumsum(sizes[at : at + 4096]), most, side="right")))
            yield batch.slice(at, to - at)
            at = to
        del batch
    pa.default_memory_pool().release_unused()


def ship(module: str) -> None:
    """Send functions of ``module`` to executors with their code, so that the library need not be installed there."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)
