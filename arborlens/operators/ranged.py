"""Ordered scans that no hot key can slow: sampled ranges of (key, order), and partial states at their edges.

A window function puts all rows of a key into one task. Here rows are range partitioned on the key *and*
its order, by quantiles that Spark samples, so that a key with a third of all rows lies in a third of the
partitions. Each partition is read once in order; what crosses an edge between partitions is stitched
afterwards from at most two rows of each partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborlens.scratch import cut

#: Columns added by the scans of this module. Input columns may not have these names; see :func:`free_names`.
PART, FIRST, LAST = "__part", "__first", "__last"


def in_ranges(df: DataFrame, keys: Sequence[str], then: Sequence[str] = ()) -> DataFrame:
    """Rows in ranges of ``keys``, each partition sorted by ``keys`` and ``then``. Equal keys stay together."""
    return df.repartitionByRange(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *then)


def scan(df: DataFrame, work: Callable[[int, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Run ``work(partition number, batches in order)`` over the partitions of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(TaskContext.get().partitionId(), batches)

    return df.mapInArrow(run, schema)


def differs(a: pa.Array, b: pa.Array) -> pa.Array:
    """Row by row, whether two columns differ; null equals null."""
    either, both = pc.or_(pc.is_null(a), pc.is_null(b)), pc.and_(pc.is_null(a), pc.is_null(b))
    return pc.if_else(either, pc.invert(both), pc.not_equal(a, b))


def shifted(column: pa.Array, before: pa.Array | None) -> pa.Array:
    """The column moved down by one row; ``before`` (one value) or null comes first."""
    head = before if before is not None else pa.nulls(1, column.type)
    return pa.concat_arrays([head, column.slice(0, max(0, len(column) - 1))]) if len(column) else column


def shifted_up(column: pa.Array, behind: pa.Array | None) -> pa.Array:
    """The column moved up by one row; ``behind`` (one value) or null comes last."""
    tail = behind if behind is not None else pa.nulls(1, column.type)
    return pa.concat_arrays([column.slice(1), tail]) if len(column) else column


def with_previous(df: DataFrame, key: Sequence[str], order: Sequence[str], carry: Sequence[str], prefix: str = "prev_", ahead: Sequence[str] = ()) -> DataFrame:
    """Each row with the ``carry`` columns of the row before it in its key, or nulls; ``has_prev`` tells which.

    With ``ahead`` also with these columns of the row behind it, as ``next_`` columns, and ``has_next``. Rows are ordered
    by ``order`` within ``key``; rows equal in both follow each other in any order.
    """
    sorted_df = in_ranges(df, [*key, *order])
    fields = {f.name: f.dataType.simpleString() for f in df.schema}
    extra = [*(f"`{prefix}{c}` {fields[c]}" for c in carry), "has_prev boolean", *(f"`next_{c}` {fields[c]}" for c in ahead), *(["has_next boolean"] if ahead else [])]
    out_schema = ", ".join([*(f"`{n}` {t}" for n, t in fields.items()), *extra, f"{PART} int, {FIRST} boolean, {LAST} boolean"])
    names = [*fields, *(prefix + c for c in carry), "has_prev", *(f"next_{c}" for c in ahead), *(["has_next"] if ahead else [])]

    def work(part: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        last: pa.RecordBatch | None = None
        seen = 0

        def beside(b: pa.RecordBatch, other: pa.RecordBatch | None, side, columns: Sequence[str], edge: int) -> list[pa.Array]:
            """The columns of the rows beside those of a batch, and whether they are of the same key."""
            n = b.num_rows
            moved = {c: side(b.column(c), other.column(c) if other is not None else None) for c in {*key, *columns}}
            lone = np.zeros(n, bool)
            lone[edge] = other is None
            new = pa.array(lone)
            for k in key:
                new = pc.or_(new, differs(b.column(k), moved[k]))
            same = pc.invert(new)
            return [*(pc.if_else(same, moved[c], pa.nulls(n, b.column(c).type)) for c in columns), same]

        def done(b: pa.RecordBatch, then: pa.RecordBatch | None) -> pa.RecordBatch:
            nonlocal last, seen
            n = b.num_rows
            cols = list(b.columns) + beside(b, last, shifted, carry, 0)
            if ahead:
                cols += beside(b, then.slice(0, 1) if then is not None else None, shifted_up, ahead, n - 1)
            cols += [pa.array([part] * n, pa.int32()), pa.array([seen == 0] + [False] * (n - 1)), pa.array([False] * (n - 1) + [then is None])]
            last, seen = b.slice(n - 1), seen + n
            return pa.RecordBatch.from_arrays(cols, names=[*names, PART, FIRST, LAST])

        for b in batches:
            if b.num_rows:
                if held is not None:
                    yield done(held, b)
                held = b
        if held is not None:
            yield done(held, None)

    out = cut(scan(sorted_df.select(*fields), work, out_schema), "previous")
    at_edge = F.col(FIRST) | F.col(LAST) if ahead else F.col(FIRST)
    # one row a partition: its last and first row, and by their numbers those of its neighbours
    w = Window.orderBy(PART)
    ends = out.filter(F.col(FIRST) | F.col(LAST)).groupBy(PART).agg(F.first(F.when(F.col(LAST), F.struct(*key, *carry)), True).alias("z"), F.first(F.when(F.col(FIRST), F.struct(*key, *ahead)), True).alias("a"))
    ends = ends.select(PART, F.lag("z").over(w).alias("__p"), F.lead("a").over(w).alias("__n"))
    joined = out.filter(at_edge).join(F.broadcast(ends), PART, "left")
    for side, edge, columns, before, flag in (("__p", FIRST, carry, prefix, "has_prev"), ("__n", LAST, ahead, "next_", "has_next")):
        if side == "__n" and not ahead:
            continue
        same = F.col(side).isNotNull()
        for k in key:
            same = same & F.col(side)[k].eqNullSafe(F.col(k))
        joined = joined.withColumn(flag, F.when(F.col(edge), same).otherwise(F.col(flag)))
        for c in columns:
            joined = joined.withColumn(before + c, F.when(F.col(edge), F.when(F.col(flag), F.col(side)[c])).otherwise(F.col(before + c)))
    return out.filter(~at_edge).select(*names).unionByName(joined.select(*names))
