"""Runs of repeated consecutive events, by pointer doubling.

Every event that repeats the one before it points to it; every other event points to itself and starts a
run. Pointers are then replaced by their pointers' pointers until all of them reach a run's start, which
takes as many rounds as the longest run has binary digits. It is done on two levels:

* within a block of ordered rows the pointers are an array, and a round is one gather;
* what is left of each block, one row for a whole run's part in it, points to the part before it. These
  pointers are doubled by self-joins of the table of parts, one join a round, over parts that have not
  reached a start and the parts they point to.

So a run of any length, over any number of partitions, takes no task more than its block, and single
events never enter a join.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborlens.operators.ranged import FIRST, LAST, PART, differs, in_ranges, scan, shifted
from arborlens.scratch import cut, release

#: Rows of a block at most; a longer run consists of several parts.
BLOCK = 8192


def _jump(linked: np.ndarray) -> np.ndarray:
    """For each row the row its run starts at; ``linked[i]``: row i repeats row i - 1."""
    at = np.arange(len(linked))
    to = at - linked
    while True:
        nxt = to[to]
        if np.array_equal(nxt, to):
            return to
        to = nxt


def double_pointers(pointers: DataFrame) -> DataFrame:
    """(id, to) with each ``to`` replaced by the start of its chain.

    ``to`` is the id before it in the chain, or ``id`` itself at a start. Each round is one self-join;
    pointers that have reached a start drop out of it.
    """
    table = cut(pointers, "pointers")
    while True:
        there = table.select(F.col("id").alias("to"), F.col("to").alias("then"))
        moving = table.filter(F.col("id") != F.col("to")).join(there, "to").filter(F.col("then") != F.col("to")).select("id", F.col("then").alias("to"))
        moving = cut(moving, "moving")
        if moving.isEmpty():
            release(moving)
            return table
        rest = table.join(moving.select("id"), "id", "left_anti")
        table, past = cut(rest.unionByName(moving), "pointers"), table
        release(past, moving)


def collapse_runs(
    events: DataFrame,
    key: Sequence[str],
    time: str,
    event_id: str,
    same: Sequence[str],
    near: dict[str, float],
    max_gap_us: int,
    tie: Sequence[str] = (),
    prepare=lambda df: df,
    least: int = 1,
) -> DataFrame:
    """Collapse each run of repeated events into one row.

    Events of a ``key`` are ordered by ``time``, then ``event_id``. An event repeats the one before it if
    the ``same`` columns are equal (null equals null), each ``near`` column differs by its bound at most
    (null counts as 0) and ``time`` is at most ``max_gap_us`` microseconds later. Rows equal in key, time
    and id are one event: the first of them by ``tie`` counts. ``prepare`` is applied after rows are put
    in order, so that what it computes is computed once.

    Gives key, first_event_id, last_event_id, events (their count), started_at, ended_at, duration_us, and
    of each ``same`` column the value, for runs of ``least`` events or more. Nulls in key columns form a
    key of their own; rows with a null time or id are left out; an empty input gives no rows.
    """
    cols = list(dict.fromkeys([*key, time, event_id, *same, *near]))
    src = events.filter(F.col(time).isNotNull() & F.col(event_id).isNotNull())
    ordered = prepare(in_ranges(src, [*key, time, event_id], tie)).select(*[F.col(c).cast("double").alias(c) if c in near else F.unix_micros(F.col(c).cast("timestamp")).alias(c) if c == time else F.col(c) for c in cols])
    kinds = {f.name: f.dataType.simpleString() for f in ordered.schema}
    head = ", ".join(f"`{c}` {kinds[c]}" for c in dict.fromkeys([*key, *same]))
    ends = ", ".join(f"`{side}_{c}` double" for c in near for side in ("a", "z"))
    schema = f"id bigint, to bigint, {head}, first_id {kinds[event_id]}, last_id {kinds[event_id]}, n bigint, start_us bigint, end_us bigint, {ends + ', ' if ends else ''}{PART} int, {FIRST} boolean, {LAST} boolean"

    def links(b: pa.RecordBatch, before: pa.RecordBatch | None) -> tuple[np.ndarray, pa.RecordBatch]:
        prev = {c: shifted(b.column(c), before.column(c) if before is not None else None) for c in cols}
        other = pa.array([before is None] + [False] * (b.num_rows - 1))
        for c in key:
            other = pc.or_(other, differs(b.column(c), prev[c]))
        again = pc.and_(pc.invert(other), pc.and_(pc.invert(differs(b.column(time), prev[time])), pc.invert(differs(b.column(event_id), prev[event_id]))))
        if pc.any(again).as_py():  # repeated deliveries: leave them out and look again
            b = b.filter(pc.invert(again))
            return links(b, before) if b.num_rows else (np.zeros(0, bool), b)
        for c in same:
            other = pc.or_(other, differs(b.column(c), prev[c]))
        for c, most in near.items():
            step = pc.abs(pc.subtract(pc.fill_null(b.column(c), 0.0), pc.fill_null(prev[c], 0.0)))
            other = pc.or_(other, pc.greater(step, float(most)))
        late = pc.greater(pc.subtract(b.column(time), prev[time]), max_gap_us)
        return ~pc.or_(other, pc.fill_null(late, True)).to_numpy(zero_copy_only=False), b

    def work(part: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: pa.RecordBatch | None = None
        made, held = 0, None
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                linked, b = links(whole.slice(at, BLOCK), before)
                n = b.num_rows
                if not n:
                    continue
                tied = bool(linked[0])  # to the part before this block
                linked = linked.copy()
                linked[0] = False
                to = _jump(linked)
                starts = np.flatnonzero(to == np.arange(n))
                ends_at = np.append(starts[1:], n) - 1
                ids = (part << 40) + made + np.arange(len(starts))
                goes = ids.copy()
                if tied:
                    goes[0] = ids[0] - 1
                s, e = pa.array(starts), pa.array(ends_at)
                out = [pa.array(ids), pa.array(goes)]
                out += [b.column(c).take(s) for c in dict.fromkeys([*key, *same])]
                out += [b.column(event_id).take(s), b.column(event_id).take(e), pa.array(ends_at - starts + 1, pa.int64()), b.column(time).take(s), b.column(time).take(e)]
                for c in near:
                    out += [b.column(c).take(s), b.column(c).take(e)]
                first = np.zeros(len(starts), bool)
                first[0] = made == 0
                out += [pa.array(np.full(len(starts), part, np.int32)), pa.array(first)]
                before, made = b.slice(n - 1), made + len(starts)
                if held is not None:
                    yield rows(held, False, least)
                held = out
        if held is not None:
            yield rows(held, True, least)

    names = ["id", "to", *dict.fromkeys([*key, *same]), "first_id", "last_id", "n", "start_us", "end_us", *(f"{side}_{c}" for c in near for side in ("a", "z")), PART, FIRST, LAST]

    def rows(out: list, is_last: bool, least: int) -> pa.RecordBatch:
        n = len(out[0])
        b = pa.RecordBatch.from_arrays([*out, pa.array([False] * (n - 1) + [is_last])], names=names)
        if least > 1:  # short runs inside the block are whole; at its edges they may go on
            keep = out[names.index("n")].to_numpy() >= least
            keep[[0, -1]] = True
            b = b.filter(pa.array(keep))
        return b

    parts = cut(scan(ordered, work, schema), "runs")
    # Edges between partitions: two rows of each at most, so one task orders no more than there are partitions.
    w = Window.orderBy(PART, "id")
    carried = dict.fromkeys([*key, *same])
    edge = parts.filter(F.col(FIRST) | F.col(LAST))
    edge = edge.withColumn("b", F.lag(F.struct("id", "end_us", *carried, *[f"z_{c}" for c in near], LAST)).over(w))
    tied = F.col("b").isNotNull() & F.col(FIRST) & (F.col("start_us") - F.col("b.end_us") <= max_gap_us)
    for c in carried:
        tied = tied & F.col(c).eqNullSafe(F.col("b")[c])
    for c, most in near.items():
        tied = tied & (F.abs(F.coalesce(F.col(f"a_{c}"), F.lit(0.0)) - F.coalesce(F.col("b")[f"z_{c}"], F.lit(0.0))) <= most)
    crossing = edge.filter(tied).select("id", F.col("b.id").alias("to"))
    inside = parts.filter(F.col("id") != F.col("to")).select("id", "to")
    chained = inside.unionByName(crossing)
    # starts of chains: parts that others point to and that point to none themselves
    heads = chained.select(F.col("to").alias("id")).join(chained.select("id"), "id", "left_anti").distinct()
    found = double_pointers(chained.unionByName(heads.select("id", F.col("id").alias("to"))))
    long = parts.join(found.withColumnRenamed("to", "start"), "id")
    first, last = F.struct("start_us", "id"), F.struct("end_us", "id")
    summed = long.groupBy("start").agg(
        *[F.min_by(c, first).alias(c) for c in carried],
        F.min_by("first_id", first).alias("first_id"), F.max_by("last_id", last).alias("last_id"),
        F.sum("n").alias("n"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"),
    )
    alone = parts.join(found.select("id"), "id", "left_anti")
    fields = [*carried, "first_id", "last_id", "n", "start_us", "end_us"]
    whole = alone.select(*fields).unionByName(summed.select(*fields)).filter(F.col("n") >= least)
    return whole.select(
        *carried,
        F.col("first_id").alias("first_event_id"), F.col("last_id").alias("last_event_id"), F.col("n").alias("events"),
        F.timestamp_micros("start_us").alias("started_at"), F.timestamp_micros("end_us").alias("ended_at"), (F.col("end_us") - F.col("start_us")).alias("duration_us"),
    )
