"""Edit events as a stream: reading, debouncing, deltas against the last state, the working set, sinks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from arborlens.operators.events import with_sound_op

GONE = ("REMOVE", "RENAME")


def _micros(times: pd.Series) -> np.ndarray:
    return times.to_numpy("datetime64[us]").astype(np.int64)


def read_events(spark: SparkSession, folder: str, schema: str, files_at_once: int = 16) -> DataFrame:
    """A folder of parquet files as a stream of sound events, a bounded number of files at a time."""
    return with_sound_op(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder))


def track_files(events: DataFrame, window_us: int) -> DataFrame:
    """(root, path, event_id, ts, op, skipped, line_delta, size_delta) of each event in order of arrival.

    One state a file: its last known lines and size, and the last write seen. A write less than
    ``window_us`` after that is skipped (its successor, or the end of the burst, speaks for it); exactly the
    window later is outside; other operations are never skipped and end a burst. Deltas are those of
    :func:`arborlens.operators.activity.deltas`. The state is three numbers a file and needs no timer: a
    burst that is over is told by the gap before the next write. A removed file has no state.
    ``events``: root, path, event_id, ts, op, lines, size.
    """
    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        lines, size, wrote = state.get if state.exists else (0, 0, None)
        f = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        us, write, gone = _micros(f["ts"]), (f["op"] == "WRITE").to_numpy(), f["op"].isin(GONE).to_numpy()
        before = np.append(us[:1] if wrote is None else wrote, us[:-1])
        skipped = write & np.append(wrote is not None, write[:-1]) & (us - before < window_us)
        told = gone | f["lines"].notna().to_numpy() | f["size"].notna().to_numpy()
        out = {"event_id": f["event_id"], "ts": f["ts"], "op": f["op"], "skipped": skipped}
        for column, known in (("lines", lines), ("size", size)):
            now = np.where(gone, 0, f[column].fillna(0).to_numpy(np.int64))
            # the last known value before each event: that of the last event that told one
            at = np.maximum.accumulate(np.where(told, np.arange(len(f)), -1))
            last = np.append(known, np.where(at < 0, known, now[at]))
            out["line_delta" if column == "lines" else "size_delta"] = np.where(told, now - last[:-1], 0)
            lines, size = (last[-1], size) if column == "lines" else (lines, last[-1])
        if lines or size or write[-1]:
            state.update((int(lines), int(size), int(us[-1]) if write[-1] else None))
        elif state.exists:
            state.remove()  # as a file that was never seen
        rows = pd.DataFrame(out)
        rows.insert(0, "root", name[0])
        rows.insert(1, "path", name[1])
        yield rows

    kinds = dict(events.dtypes)
    schema = f"root string, path string, event_id bigint, ts {kinds['ts']}, op string, skipped boolean, line_delta bigint, size_delta bigint"
    return events.select("root", "path", "event_id", "ts", "op", "lines", "size").groupBy("root", "path").applyInPandasWithState(step, schema, "lines bigint, size bigint, wrote bigint", "append", GroupStateTimeout.NoTimeout)


def working_set(events: DataFrame) -> DataFrame:
    """(root, path, first_touch, last_touch, edits, net_delta) in update mode; a removed file has 0 edits until it is touched again."""
    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        first, last, edits, net = state.get if state.exists else (None, None, 0, 0)
        f = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        us, gone = _micros(f["ts"]), np.flatnonzero(f["op"].isin(GONE).to_numpy())
        if len(gone):
            first, last, edits, net = None, None, 0, 0
            f, us = f.iloc[gone[-1] + 1 :], us[gone[-1] + 1 :]
        if len(us):
            first, last, edits, net = (int(us[0]) if first is None else first), int(us[-1]), edits + len(us), net + int(f["delta"].fillna(0).sum())
        if edits:
            state.update((first, last, edits, net))
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(name[0], name[1], first, last, edits, net)], columns=["root", "path", "first_us", "last_us", "edits", "net_delta"])

    out = events.select("root", "path", "event_id", "ts", "op", "delta").groupBy("root", "path").applyInPandasWithState(
        step, "root string, path string, first_us bigint, last_us bigint, edits bigint, net_delta bigint", "first bigint, last bigint, edits bigint, net bigint", "update", GroupStateTimeout.NoTimeout
    )
    return out.select("root", "path", F.timestamp_micros("first_us").alias("first_touch"), F.timestamp_micros("last_us").alias("last_touch"), "edits", "net_delta")


def enriched(events: DataFrame, degree: DataFrame) -> DataFrame:
    """Events with the importers and imports of their file, from a static table (path, importers, imports)."""
    return events.join(degree, "path", "left").withColumns({"importers": F.coalesce("importers", F.lit(0)), "imports": F.coalesce("imports", F.lit(0))})


def bursts(events: DataFrame, gap: str, lateness: str) -> DataFrame:
    """(root, began, events, removed) of control events coalesced within a gap, once the watermark has passed."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", lateness).groupBy("root", w.alias("w")).agg(F.count(F.lit(1)).alias("events"), F.bool_or(F.col("op") == "REMOVE").alias("removed")).select("root", F.col("w.start").alias("began"), "events", "removed")


def append_to(df: DataFrame, folder: str, checkpoint: str, mode: str = "append", once: bool = True):
    """Start writing a stream to parquet; ``once``: what is there now, then stop."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    if mode == "update":

        def write(batch: DataFrame, n: int) -> None:
            batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(folder)

        writer = writer.foreachBatch(write)
    else:
        writer = writer.format("parquet").option("path", folder)
    return (writer.trigger(availableNow=True) if once else writer).start()
