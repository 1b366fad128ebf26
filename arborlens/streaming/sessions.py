"""Sessions of a stream: a keyed timer for each key, set anew by each event, emits the session when it expires."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from arborlens.operators.events import with_sound_op
from arborlens.operators.sessions import Open, Timer
from arborlens.scratch import folder

_STATE = "held_ids binary, held_us binary, first_id bigint, last_id bigint, start bigint, last bigint, n bigint"


def sessionize_stream(events: DataFrame, key: str, time: str, event_id: str, gap_us: int, lateness_us: int) -> DataFrame:
    """(key, first_event_id, last_event_id, start_us, end_us, events) of each session once it is over.

    ``events`` is a stream with a watermark on ``time`` (a TIMESTAMP) of ``lateness_us`` microseconds.
    Events that may still be overtaken by a late one are held in the state, in order; the others go
    through the timer. The timer expires when the watermark has passed the last event by the gap, or as soon
    as an event comes that is later than that. Events behind the watermark are dropped by Spark; rows equal in
    time and id are one event while they are held. Results equal those of the batch form on the same
    events as long as none is dropped.
    """
    kind = dict(events.dtypes)[key]

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        timer, ids, us = Timer(gap_us), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if state.exists:
            held_ids, held_us, *opened = state.get
            ids, us = np.frombuffer(held_ids, np.int64), np.frombuffer(held_us, np.int64)
            if opened[4]:
                timer.state = Open(*map(int, opened))
        new = list(frames)
        if new:
            ids = np.concatenate([ids, *(f[event_id].to_numpy(np.int64) for f in new)])
            us = np.concatenate([us, *(f[time].to_numpy("datetime64[us]").astype(np.int64) for f in new)])
        order = np.lexsort((ids, us))
        ids, us = ids[order], us[order]
        again = np.append(False, (ids[1:] == ids[:-1]) & (us[1:] == us[:-1])) if len(ids) else np.zeros(0, bool)
        ids, us = ids[~again], us[~again]
        mark = state.getCurrentWatermarkMs() * 1000
        n = int(np.searchsorted(us, mark))  # these can no longer be overtaken
        closed = [np.stack(s[1:]) for s in timer.update(ids[:n], us[:n])]
        ids, us = ids[n:], us[n:]
        done = None if len(us) and timer.state and us[0] <= timer.expires else timer.close(mark)
        if done:
            closed.append(np.array([[done.first_id], [done.last_id], [done.start], [done.last], [done.n]], np.int64))
        if len(us) or timer.state:
            s = timer.state or Open(0, 0, 0, 0, 0)
            state.update((ids.tobytes(), us.tobytes(), s.first_id, s.last_id, s.start, s.last, s.n))
            due = min(x for x in (timer.expires, int(us[0]) if len(us) else None) if x is not None)
            state.setTimeoutTimestamp(max(due // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        else:
            state.remove()
        rows = pd.DataFrame(np.concatenate(closed, axis=1).T if closed else np.zeros((0, 5), np.int64), columns=["first_event_id", "last_event_id", "start_us", "end_us", "events"])
        rows.insert(0, key, name[0])
        yield rows

    schema = f"`{key}` {kind}, first_event_id bigint, last_event_id bigint, start_us bigint, end_us bigint, events bigint"
    return events.select(key, time, event_id).groupBy(key).applyInPandasWithState(step, schema, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def drained(spark: SparkSession, events: str, key: str, time: str, event_id: str, gap_us: int, lateness_us: int, files_at_once: int | None = None) -> DataFrame:
    """The sessions of all events of a folder of parquet files, read as a stream until it is empty, open ones too.

    Files are taken at once, so that none is late; with ``files_at_once`` in batches, for files that come in order of receipt
    and events at most ``lateness_us`` late. The state is what :func:`sessionize_stream` keeps. Then one row later than all, of a key
    that no event has, lets the watermark pass every timer. A key's events go through one task: for
    histories with hot keys the batch form is the better choice. Columns as :func:`sessionize_stream`.
    """
    at = folder(spark, "stream")
    schema = spark.read.parquet(events).schema
    last = spark.read.parquet(events).agg(F.max(F.col(time).cast("timestamp")).alias("t")).select(F.expr(f"t + make_interval(0, 0, 0, 0, 0, 0, {(gap_us + lateness_us) / 1e6 + 60})").cast(schema[time].dataType).alias(time))
    closing = last.select(*[F.col(time) if f.name == time else F.lit("WRITE").alias("op") if f.name == "op" else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
    closing = closing.withColumn(event_id, F.lit(-1).cast(schema[event_id].dataType)).withColumn("__closing", F.lit(True))
    closing.limit(0).write.parquet(f"{at}/closing")
    pattern = f"{events[:-1]}[{events[-1]}]"  # a pattern may also name a single file, a path only a folder
    for more in (False, True):
        if more:
            closing.filter(F.col(time).isNotNull()).coalesce(1).write.mode("append").parquet(f"{at}/closing")
        reader = spark.readStream.schema(schema)
        reader = reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader
        source = reader.parquet(pattern).withColumn("__closing", F.lit(False))
        both = with_sound_op(source.unionByName(spark.readStream.schema(closing.schema).parquet(f"{at}/closing")).filter(F.col(event_id).isNotNull()))
        known = F.struct(F.col(key).alias("k"), F.col("__closing").alias("closing"))  # a null key is a key too
        timed = both.select(known.alias("__key"), F.col(time).cast("timestamp").alias("__at"), F.col(event_id).cast("bigint").alias("__id")).withWatermark("__at", f"{lateness_us // 1000} milliseconds")
        timed = timed.withColumn("__key", F.to_json("__key"))
        out = sessionize_stream(timed, "__key", "__at", "__id", gap_us, lateness_us)
        out.writeStream.outputMode("append").option("checkpointLocation", f"{at}/check").format("parquet").option("path", f"{at}/out").trigger(availableNow=True).start().awaitTermination()
    done = spark.read.schema("__key string, first_event_id bigint, last_event_id bigint, start_us bigint, end_us bigint, events bigint").parquet(f"{at}/out")
    told = F.from_json("__key", f"k {schema[key].dataType.simpleString()}, closing boolean")
    return done.withColumn("__k", told).filter(~F.col("__k.closing")).select(F.col("__k.k").alias(key), "first_event_id", "last_event_id", "start_us", "end_us", "events")
