"""Sessions of activity, closed by inactivity timers.

:class:`Timer` is the keyed state: an ordered event updates the open session and sets the timer anew; when
the timer has expired the session's start, end and count are final. The stream form keeps one Timer a key
(:mod:`arborlens.streaming.sessions`). The batch form replays the history: ranges of (key, time) run in
parallel, each from an empty state, and the sessions still open at a range's edge are carried over to the
next, so that a key with a third of all events is replayed by a third of the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlens.operators.ranged import FIRST, LAST, PART, differs, in_ranges, scan, shifted
from arborlens.scratch import cut


@dataclass
class Open:
    """A session that goes on."""

    first_id: int
    last_id: int
    start: int
    last: int
    n: int


class Timer:
    """The open session of a key and the time at which its inactivity timer expires."""

    def __init__(self, gap: int, state: Open | None = None) -> None:
        self.gap, self.state = gap, state

    @property
    def expires(self) -> int | None:
        """The last time at which an event still belongs to the open session."""
        return None if self.state is None else self.state.last + self.gap

    def update(self, ids: np.ndarray, times: np.ndarray, new_key: np.ndarray | None = None) -> list[tuple[np.ndarray, ...]]:
        """Take ordered events; give the sessions that the timer closed on the way.

        They come as arrays of the start's place among ``ids`` (-1: before them), first id, last id, start,
        last time and count.

        ``new_key[i]``: event i is the first of another key, whose state is empty.
        """
        if not len(ids):
            return []
        fires = np.empty(len(ids), bool)
        fires[0] = self.state is None or times[0] > self.expires
        np.greater(np.diff(times), self.gap, out=fires[1:])
        if new_key is not None:
            fires |= new_key
        at = np.flatnonzero(fires)
        out = []
        if self.state is not None:
            s, upto = self.state, at[0] if len(at) else len(ids)
            if upto:
                self.state = s = Open(s.first_id, int(ids[upto - 1]), s.start, int(times[upto - 1]), s.n + int(upto))
            if not len(at):
                return []
            out.append(tuple(np.array([x], np.int64) for x in (-1, s.first_id, s.last_id, s.start, s.last, s.n)))
        ends = np.append(at[1:], len(ids)) - 1
        a, z = at[-1], ends[-1]
        self.state = Open(int(ids[a]), int(ids[z]), int(times[a]), int(times[z]), int(z - a + 1))
        if len(at) > 1:
            out.append((at[:-1], ids[at[:-1]], ids[ends[:-1]], times[at[:-1]], times[ends[:-1]], ends[:-1] - at[:-1] + 1))
        return out

    def close(self, now: int | None = None) -> Open | None:
        """The session, if the timer has expired at ``now`` (None: at the end of time); the state is then empty."""
        if self.state is None or now is not None and now <= self.expires:
            return None
        done, self.state = self.state, None
        return done


def sessionize(events: DataFrame, key: Sequence[str], time: str, event_id: str, gap_us: int, count: Column | None = None) -> DataFrame:
    """(key, first_event_id, last_event_id, started_at, ended_at, duration_us, events, counted) of each session.

    ``counted`` are the events of which the condition ``count`` holds; without one the column is left out.

    Events of a key are ordered by ``time``, then ``event_id``; a session ends where the next event comes
    more than ``gap_us`` microseconds later. Rows equal in key, time and id are one event. Rows with a
    null time or id are left out; null keys form a key of their own; an empty input gives no rows. Ids
    must be integers.
    """
    cols = [*key, time, event_id]
    flag = F.coalesce(count, F.lit(False)).cast("bigint") if count is not None else F.lit(0).cast("bigint")
    src = events.filter(F.col(time).isNotNull() & F.col(event_id).isNotNull()).select(*cols, flag.alias("__count"))
    ordered = in_ranges(src, cols, ["__count"]).select(*key, F.unix_micros(F.col(time).cast("timestamp")).alias(time), F.col(event_id).cast("bigint").alias(event_id), "__count")
    kinds = {f.name: f.dataType.simpleString() for f in ordered.schema}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in key) + f", first_id bigint, last_id bigint, start_us bigint, end_us bigint, n bigint, counted bigint, {PART} int, {FIRST} boolean, {LAST} boolean"
    names = [*key, "first_id", "last_id", "start_us", "end_us", "n", "counted", PART, FIRST, LAST]

    def work(part: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        timer, before, opened, emitted = Timer(gap_us), None, None, 0
        held_n, held = 0, 0  # events of the open session from earlier batches, and those counted

        def rows(sessions: tuple[np.ndarray, ...], keys: list[pa.Array], is_last: bool = False) -> pa.RecordBatch:
            nonlocal emitted
            n = len(sessions[0])
            first, last = np.zeros(n, bool), np.zeros(n, bool)
            first[0], last[-1] = emitted == 0, is_last
            emitted += n
            return pa.RecordBatch.from_arrays([*keys, *(pa.array(c.astype(np.int64)) for c in sessions), pa.array(np.full(n, part, np.int32)), pa.array(first), pa.array(last)], names=names)

        for b in batches:
            if not b.num_rows:
                continue
            prev = {c: shifted(b.column(c), before.column(c) if before is not None else None) for c in cols}
            other = pa.array([before is None] + [False] * (b.num_rows - 1))
            for k in key:
                other = pc.or_(other, differs(b.column(k), prev[k]))
            again = pc.and_(pc.invert(other), pc.and_(pc.equal(b.column(time), prev[time]), pc.equal(b.column(event_id), prev[event_id])))
            before = b.slice(b.num_rows - 1)
            keep = pc.invert(pc.fill_null(again, False))
            new_key, b = other.filter(keep).to_numpy(zero_copy_only=False), b.filter(keep)
            # sessions follow each other without gaps, so their lengths tell which events are theirs
            sums, at = np.concatenate([[0], np.cumsum(b.column("__count").to_numpy())]), 0
            for place, *session in timer.update(b.column(event_id).to_numpy(), b.column(time).to_numpy(), new_key):
                ends = at + np.cumsum(session[-1]) - (held_n if place[0] < 0 else 0)
                counted = np.diff(sums[np.append(at, ends)]) + (held if place[0] < 0 else 0)
                at, held_n, held = int(ends[-1]), 0, 0
                yield rows([*session, counted], opened if place[0] < 0 else [b.column(k).take(pa.array(place)) for k in key])
            held_n, held = held_n + b.num_rows - at, held + int(sums[-1] - sums[at])
            opened = [before.column(k) for k in key]
        if (s := timer.close()) is not None:
            yield rows(tuple(np.array([x], np.int64) for x in (s.first_id, s.last_id, s.start, s.last, s.n, held)), opened, True)

    parts = cut(scan(ordered, work, schema), "sessions")
    edge = parts.filter(F.col(FIRST) | F.col(LAST))
    # two rows of each partition at most: the state handed from one range to the next
    w = Window.orderBy(PART, LAST, "start_us")
    goes_on = F.col(FIRST) & F.lag(F.lit(True)).over(w) & (F.col("start_us") - F.lag("end_us").over(w) <= gap_us)
    for k in key:
        goes_on = goes_on & F.col(k).eqNullSafe(F.lag(k).over(w))
    told = edge.withColumn("fresh", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("s", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.struct("start_us", "first_id")
    till = F.struct("end_us", "last_id")
    stitched = told.groupBy("s").agg(*[F.first(k).alias(k) for k in key], F.min_by("first_id", at).alias("first_id"), F.max_by("last_id", till).alias("last_id"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("n").alias("n"), F.sum("counted").alias("counted"))
    fields = [*key, "first_id", "last_id", "start_us", "end_us", "n", "counted"]
    whole = parts.filter(~(F.col(FIRST) | F.col(LAST))).select(*fields).unionByName(stitched.select(*fields))
    return whole.select(
        *key, F.col("first_id").alias("first_event_id"), F.col("last_id").alias("last_event_id"), F.timestamp_micros("start_us").alias("started_at"), F.timestamp_micros("end_us").alias("ended_at"),
        (F.col("end_us") - F.col("start_us")).alias("duration_us"), F.col("n").alias("events"), *(["counted"] if count is not None else []),
    )
