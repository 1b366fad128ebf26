"""Sessions and previous rows against a plain walk over ordered events."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from arborlens.operators.ranged import with_previous
from arborlens.operators.sessions import Open, Timer, sessionize

T0 = datetime(2024, 1, 1)
SCHEMA = "event_id bigint, root string, ts timestamp_ntz, op string, path string, delta int, id string, n int"


def events(seed, n, hot=True):
    r = random.Random(seed)
    rows, t = [], T0
    for i in range(n):
        t += timedelta(seconds=r.choice([0, 0, 1, 5, 10, 11, 40, 1799, 1800, 1801]) if r.random() < 0.5 else r.choice([0, 1]))
        root = "hot" if hot and r.random() < 0.6 else r.choice(["a", "b", None])
        rows.append((i, root, None if r.random() < 0.03 else t, r.choice(["WRITE"] * 8 + ["CREATE", None]), r.choice(["x"] * 6 + ["y", None]), r.choice([0, 1, 1, 2, None]), "other", 7))
    rows += [r.choice(rows) for _ in range(n // 10)]  # delivered again
    r.shuffle(rows)
    return rows


def ordered(rows):
    by = {}
    for e in {(e[0], e[1], e[2]): e for e in rows if e[2] is not None}.values():
        by.setdefault(e[1], []).append(e)
    return {k: sorted(v, key=lambda e: (e[2], e[0])) for k, v in by.items()}


def plain_sessions(rows, gap):
    out = set()
    for root, es in ordered(rows).items():
        s = [es[0]]
        for a, b in zip(es, es[1:]):
            if b[2] - a[2] > timedelta(seconds=gap):
                out.add((root, s[0][0], s[-1][0], len(s)))
                s = []
            s.append(b)
        out.add((root, s[0][0], s[-1][0], len(s)))
    return out


@pytest.mark.parametrize("seed", [5, 6, 7])
def test_sessions_equal_a_plain_walk(spark, seed):
    rows = events(seed, 500)
    df = sessionize(spark.createDataFrame(rows, SCHEMA), ["root"], "ts", "event_id", 1800 * 1_000_000)
    got = {(x["root"], x["first_event_id"], x["last_event_id"], x["events"]) for x in df.collect()}
    assert got == plain_sessions(rows, 1800)


def test_sessions_of_nothing_and_one_long_session(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert sessionize(empty, ["root"], "ts", "event_id", 1).count() == 0
    rows = [(i, "hot", T0 + timedelta(seconds=i), "WRITE", "x", 0, "o", 1) for i in range(2000)]
    (one,) = sessionize(spark.createDataFrame(rows, SCHEMA), ["root"], "ts", "event_id", 1_000_000).collect()
    assert (one["first_event_id"], one["last_event_id"], one["events"], one["duration_us"]) == (0, 1999, 2000, 1999 * 1_000_000)


def test_exactly_the_gap_is_inside(spark):
    rows = [(1, "a", T0, "WRITE", "x", 0, "", 0), (2, "a", T0 + timedelta(minutes=30), "WRITE", "x", 0, "", 0), (3, "a", T0 + timedelta(minutes=60, microseconds=1), "WRITE", "x", 0, "", 0)]
    got = sessionize(spark.createDataFrame(rows, SCHEMA), ["root"], "ts", "event_id", 1800 * 1_000_000).collect()
    assert sorted((x["first_event_id"], x["last_event_id"]) for x in got) == [(1, 2), (3, 3)]


def test_timer_hands_on_its_state():
    import numpy as np

    t = Timer(10)
    assert t.update(np.array([1, 2]), np.array([0, 5])) == [] and t.expires == 15
    (closed,) = t.update(np.array([3]), np.array([16]))
    assert [int(x[0]) for x in closed] == [-1, 1, 2, 0, 5, 2]
    assert t.close(26) is None and t.close(27) == Open(3, 3, 16, 16, 1) and t.state is None


def test_previous_rows_over_edges(spark):
    rows = events(9, 300)
    df = spark.createDataFrame(rows, SCHEMA).filter("ts is not null").dropDuplicates(["event_id"])
    got = {x["event_id"]: (x["has_prev"], x["prev_event_id"]) for x in with_previous(df, ["root"], ["ts", "event_id"], ["event_id"]).collect()}
    want = {}
    for es in ordered(rows).values():
        for a, b in zip([None, *es], es):
            want[b[0]] = (a is not None, a and a[0])
    assert got == want
    both = with_previous(df, ["root"], ["ts", "event_id"], ["event_id"], ahead=["event_id", "op"]).collect()
    assert {x["event_id"]: (x["has_prev"], x["prev_event_id"]) for x in both} == want
    behind = {}
    for es in ordered(rows).values():
        for a, b in zip(es, [*es[1:], None]):
            behind[a[0]] = (b is not None, b and b[0], b and b[3])
    assert {x["event_id"]: (x["has_next"], x["next_event_id"], x["next_op"]) for x in both} == behind


def test_sessions_count_events_of_a_kind(spark):
    rows = events(11, 400)
    df = sessionize(spark.createDataFrame(rows, SCHEMA), ["root"], "ts", "event_id", 60 * 1_000_000, F.col("op") == "CREATE")
    ops = {e[0]: e[3] for e in rows}
    want = {}
    for root, es in ordered(rows).items():
        s = [es[0]]
        for a, b in zip([*es, None], [*es[1:], None]):
            if b is None or b[2] - a[2] > timedelta(seconds=60):
                want[root, s[0][0]] = sum(ops[e[0]] == "CREATE" for e in s)
                s = []
            s.append(b)
            if b is None:
                break
    assert {(x["root"], x["first_event_id"]): x["counted"] for x in df.collect()} == want
