"""Small helpers of the llm operators."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kervan.functions.storage import cut_lineage, new_path, shared_dir, written

__all__ = ["cut_lineage", "first_of_key", "new_path", "partial_rows", "shared_dir", "tasks_of", "tree_merged", "written"]

#: Rows that are merged at a time on the way to one.
FAN = 64


def first_of_key(df: DataFrame, key: str) -> DataFrame:
    """One row per key of rows that are delivered more than once; which of them is not said, since they hold the same."""
    return df.dropDuplicates([key])


def tasks_of(df: DataFrame) -> int:
    """Tasks that read a written table or a source."""
    return max(1, df.rdd.getNumPartitions())


def partial_rows(blobs: list[bytes]) -> pa.RecordBatch:
    """A task's partial result, cut in parts, as rows (part, slot, blob) for tree_merged."""
    n, slot = len(blobs), TaskContext.get().partitionId()
    return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([slot] * n, pa.int64()), pa.array(blobs, pa.binary())], names=["part", "slot", "blob"])


PARTIAL = "part int, slot bigint, blob binary"


def tree_merged(partial: DataFrame, tasks: int, merge: Callable[[list], bytes]) -> dict[int, bytes]:
    """{part: blob} of the partial rows of so many tasks, merged in rounds of about FAN rows at a time, so that no task gets those of all tasks."""

    def apply(t: pa.Table) -> pa.Table:
        return pa.table({"part": t.column("part")[:1], "slot": t.column("slot")[:1], "blob": pa.array([merge([x.as_buffer() for x in t.column("blob")])], pa.binary())})

    slots = tasks
    while True:
        slots = -(-slots // FAN)
        partial = partial.withColumn("slot", F.pmod("slot", F.lit(slots))).groupBy("part", "slot").applyInArrow(apply, PARTIAL)
        if slots == 1:
            return {r.part: r.blob for r in partial.collect()}  # one row for each part, of fixed size
