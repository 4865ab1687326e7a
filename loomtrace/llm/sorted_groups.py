"""Groups of rows, one after the other, as Arrow tables: for operators that work on a whole bounded group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parallelism(df: DataFrame) -> int:
    """Tasks for a stage that is heavy on CPU but light on bytes: it must not be coalesced by size."""
    spark = df.sparkSession
    return max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def map_groups(df: DataFrame, key: str, fn: Callable[[int, pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply ``fn(key, rows)`` to each group of the long column ``key``.

    One shuffle and one sort; unlike applyInPandas there is no cost per group beyond ``fn``'s own, so
    thousands of small groups are cheap. Callers bound the size of a group by their choice of key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at: int | None = None
        for b in batches:
            if not b.num_rows:
                continue
            k = b.column(b.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if held and at != k[lo]:
                    yield from fn(int(at), pa.Table.from_batches(held))
                    held = []
                at = k[lo]
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from fn(int(at), pa.Table.from_batches(held))

    return df.repartition(parallelism(df), key).sortWithinPartitions(key).mapInArrow(run, schema)


def map_kept_groups(df: DataFrame, key: str, kept: str, fn: Callable[[pa.Table, bool], Iterator[pa.RecordBatch]], schema: str, rows: int) -> DataFrame:
    """Apply ``fn(rows, again)`` to each group of the long column ``key``, a long group piece by piece.

    The rows where the boolean column ``kept`` holds come first in a group and are in each of its pieces; ``again`` says that an earlier piece
    had them. A piece of a long group has at most an Arrow batch more than ``rows`` rows besides the kept ones, which callers bound.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at, again, n = None, False, 0
        for b in batches:
            if not b.num_rows:
                continue
            k = b.column(b.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if held and at != k[lo]:
                    if n or not again:
                        yield from fn(pa.Table.from_batches(held), again)
                    held, again, n = [], False, 0
                at = k[lo]
                held.append(b.slice(lo, hi - lo))
                n += held[-1].column(held[-1].schema.get_field_index(kept)).false_count
                if n >= rows:
                    t = pa.Table.from_batches(held)
                    yield from fn(t, again)
                    held, again, n = t.filter(t.column(kept)).combine_chunks().to_batches() or [b.slice(0, 0)], True, 0
        if held and (n or not again):
            yield from fn(pa.Table.from_batches(held), again)

    return df.repartition(parallelism(df), key).sortWithinPartitions(key, F.desc(kept)).mapInArrow(run, schema)


def map_whole_groups(df: DataFrame, key: str, fn: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str, rows: int = 1 << 16) -> DataFrame:
    """Apply ``fn`` to runs of whole groups of the long column ``key``: about ``rows`` rows at a time, or one larger group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            if not b.num_rows:
                continue
            k = b.column(b.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
            if n >= rows:
                # The last group that began before may go on in this batch: what lies before its end is complete.
                last = held[-1].column(b.schema.get_field_index(key))[held[-1].num_rows - 1].as_py()
                cut = int(np.searchsorted(k != last, True)) if k[0] == last else 0
                if cut < len(k):
                    yield from fn(pa.Table.from_batches([*held, b.slice(0, cut)]))
                    held, n, b = [], 0, b.slice(cut)
            held.append(b)
            n += b.num_rows
        if held:
            yield from fn(pa.Table.from_batches(held))

    return df.repartition(parallelism(df), key).sortWithinPartitions(key).mapInArrow(run, schema)
