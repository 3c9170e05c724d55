"""Scans over range-partitioned, sorted rows that carry a state over the partitions' ends."""

from __future__ import annotations

from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlode.session import checkpointed


def arrow_schema(columns: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in columns.split(", ")])


def _positions(batches, unit: str, keep: list[str], columns: str):
    """Rows with their place in their unit, counted from the partition's start where the unit is its first (`head`); the
    last row, an `edge`, gives the unit at the partition's end and how many rows of it are there."""
    from pyspark import TaskContext

    pid, schema = TaskContext.get().partitionId(), arrow_schema(columns)
    cur, at, head, started = None, 0, True, False
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        place, heads = [], []
        for u in b.column(unit).to_pylist():
            if u != cur or not started:
                head, at, cur, started = not started, 0, u, True
            place.append(at)
            heads.append(head)
            at += 1
        lead = [pa.array([pid] * n, pa.int32()), pa.array(heads, pa.bool_()), pa.array([False] * n, pa.bool_()), b.column(unit), pa.array(place, pa.int64())]
        yield pa.RecordBatch.from_arrays(lead + [b.column(c) for c in keep], schema=schema)
    if started:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((pid, head, True, cur, at, *([None] * len(keep))), schema)], schema=schema)


def numbered(rows: DataFrame, unit: str, keep: list[str]) -> DataFrame:
    """`keep` and `unit` of range-partitioned and sorted `rows`, with `position` from 0 in their unit, by one scan; `unit` is a
    string and comes first in the order. A unit of any size may lie in many partitions; one row a partition reaches the
    driver."""
    kinds = {f.name: {"bigint": "long"}.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in rows.schema}
    columns = ", ".join(["pid int", "head boolean", "edge boolean", f"{unit} string", "position long", *(f"{c} {kinds[c]}" for c in keep)])
    got = checkpointed(rows.select(unit, *keep).mapInArrow(partial(_positions, unit=unit, keep=keep, columns=columns), columns))
    carried, last, n = [], None, 0
    for r in sorted(got.where("edge").collect(), key=lambda r: r.pid):
        carried.append((r.pid, last, n))
        last, n = r[unit], r.position + (n if r.head and r[unit] == last else 0)
    ends = F.broadcast(rows.sparkSession.createDataFrame(carried, "pid int, last string, before long"))
    back = F.when(F.col("head") & (F.col(unit) == F.col("last")), F.col("before")).otherwise(0)
    return got.where("not edge").join(ends, "pid").select(unit, (F.col("position") + back).alias("position"), *keep)
