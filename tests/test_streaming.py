"""Streams give what the batch operators give on the same events."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from arborlens.operators import activity
from arborlens.operators.sessions import sessionize
from arborlens.streaming import edits
from arborlens.streaming.sessions import drained, sessionize_stream

T0 = datetime(2024, 1, 1)
SCHEMA = "event_id bigint, root string, ts timestamp, op string, path string, lines int, size bigint, delta int"


def write(spark, rows, folder, files):
    """In order of time, cut into files that are read one after the other."""
    n = -(-len(rows) // files)
    for i in range(files):
        spark.createDataFrame(rows[i * n : (i + 1) * n], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def some(seed, n):
    r, t, rows = random.Random(seed), T0, []
    for i in range(n):
        t += timedelta(seconds=r.choice([1, 2, 30, 90, 400]))
        rows.append((i, r.choice("ab"), t, r.choice(["WRITE", "WRITE", "write ", "CREATE", "REMOVE", "CHMOD"]), r.choice("xyz"), r.choice([None, 5, 9]), r.choice([None, 50, 90]), r.choice([None, 1, -2])))
    return rows


def drain(df, tmp, mode="append"):
    edits.append_to(df, f"{tmp}/out", f"{tmp}/check", mode).awaitTermination(120)
    return df.sparkSession.read.parquet(f"{tmp}/out")


def test_sessions(spark, tmp_path):
    rows = some(1, 200)
    ends = [(10_000 + i, root, T0 + timedelta(days=2 + i), "WRITE", "x", 1, 1, 1) for i in (0, 1) for root in "ab"]  # so that the watermark passes
    late = rows[:]
    for i in range(0, len(late) - 3, 7):  # a little out of order
        late[i], late[i + 2] = late[i + 2], late[i]
    write(spark, late, f"{tmp_path}/in", 3)
    for e in ends:
        write(spark, [e], f"{tmp_path}/in", 1)
    stream = edits.read_events(spark, f"{tmp_path}/in", SCHEMA, 1).withWatermark("ts", "1 hour")
    got = drain(sessionize_stream(stream, "root", "ts", "event_id", 300_000_000, 3_600_000_000), tmp_path)
    got = {(x["root"], x["first_event_id"], x["last_event_id"], x["events"]) for x in got.collect() if x["first_event_id"] < 10_000}
    from arborlens.operators.events import with_sound_op

    batch = sessionize(with_sound_op(spark.createDataFrame(rows, SCHEMA)), ["root"], "ts", "event_id", 300_000_000).collect()
    want = {(x["root"], x["first_event_id"], x["last_event_id"], x["events"]) for x in batch}
    assert len(want) > 5 and got == want


def test_a_drained_stream_equals_the_batch(spark, tmp_path):
    rows = [(i, None if i % 5 == 0 else root, *rest) for i, root, *rest in some(4, 200)] + [(900, "a", None, "WRITE", "x", 1, 1, 1)]
    rows += [rows[3], rows[50]]  # delivered again
    write(spark, rows, f"{tmp_path}/in", 3)
    got = {(x["root"], x["first_event_id"], x["last_event_id"], x["events"]) for x in drained(spark, f"{tmp_path}/in", "root", "ts", "event_id", 300_000_000, 10**12, 1).collect()}
    from arborlens.operators.events import with_sound_op

    batch = sessionize(with_sound_op(spark.createDataFrame(rows, SCHEMA)), ["root"], "ts", "event_id", 300_000_000).collect()
    assert got == {(x["root"], x["first_event_id"], x["last_event_id"], x["events"]) for x in batch} and {x[0] for x in got} == {"a", "b", None}


def test_deltas_and_debouncing(spark, tmp_path):
    rows = some(2, 150)
    write(spark, rows, f"{tmp_path}/in", 3)
    stream = edits.read_events(spark, f"{tmp_path}/in", SCHEMA, 1)
    got = {x["event_id"]: (x["skipped"], x["line_delta"], x["size_delta"]) for x in drain(edits.track_files(stream, 60_000_000), tmp_path).collect()}
    from arborlens.operators.events import with_sound_op

    sound = with_sound_op(spark.createDataFrame(rows, SCHEMA))
    d = activity.deltas(sound).join(activity.debounced(sound, 60_000_000).select("event_id", "skipped"), "event_id").collect()
    assert got == {x["event_id"]: (x["skipped"], x["line_delta"], x["size_delta"]) for x in d}


def test_working_set(spark, tmp_path):
    rows = some(3, 150)
    write(spark, rows, f"{tmp_path}/in", 3)
    out = drain(edits.working_set(edits.read_events(spark, f"{tmp_path}/in", SCHEMA, 1)), tmp_path, "update")
    last = out.groupBy("root", "path").agg(F.max_by(F.struct("edits", "net_delta", "last_touch"), "batch").alias("s")).filter("s.edits > 0")
    got = {(x["root"], x["path"], x["s"]["edits"], x["s"]["net_delta"]) for x in last.collect()}
    from arborlens.operators.events import with_sound_op

    want = activity.working_set(with_sound_op(spark.createDataFrame(rows, SCHEMA))).collect()
    assert got == {(x["root"], x["path"], x["edits"], x["net_delta"]) for x in want}


def test_debounce_cases(spark):
    """Writes at 0, 50, 120 and 220 ms with a window of 100: the burst extends itself, exactly the window is outside."""
    at = lambda ms, op, i: (i, "r", T0 + timedelta(milliseconds=ms), op, "p", 1, 1, 0)
    rows = [at(0, "WRITE", 1), at(50, "WRITE", 2), at(120, "WRITE", 3), at(220, "WRITE", 4)]
    got = [x["skipped"] for x in activity.debounced(spark.createDataFrame(rows, SCHEMA), 100_000).orderBy("event_id").collect()]
    assert got == [False, True, True, False]
    rows = [at(0, "CREATE", 1), at(5, "REMOVE", 2), at(10, "WRITE", 3), at(15, "RENAME", 4)]
    assert not any(x["skipped"] for x in activity.debounced(spark.createDataFrame(rows, SCHEMA), 100_000).collect())
