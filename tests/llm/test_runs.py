"""Runs of repeated events against a plain walk over ordered events."""

import random
from datetime import datetime, timedelta

import pytest

from arborlens.llm import runs as R

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


def plain_runs(rows, least):
    out = set()
    for root, es in ordered(rows).items():
        run = [es[0]]
        for a, b in zip(es, es[1:]):
            again = a[3] == b[3] and a[4] == b[4] and abs((a[5] or 0) - (b[5] or 0)) <= 1 and b[2] - a[2] <= timedelta(seconds=10)
            if again:
                run.append(b)
            else:
                out.add((root, run[0][0], run[-1][0], len(run)))
                run = [b]
        out.add((root, run[0][0], run[-1][0], len(run)))
    return {x for x in out if x[3] >= least}


def collapsed(spark, rows, least=1):
    df = R.collapse_runs(spark.createDataFrame(rows, SCHEMA), ["root"], "ts", "event_id", ["op", "path"], {"delta": 1}, 10_000_000, least=least)
    got = df.collect()
    assert all(x["duration_us"] == (x["ended_at"] - x["started_at"]) / timedelta(microseconds=1) for x in got)
    return sorted(((x["root"], x["first_event_id"], x["last_event_id"], x["events"]) for x in got), key=str)


@pytest.mark.parametrize("seed,block", [(1, 8192), (2, 7), (3, 1), (4, 2)])
@pytest.mark.parametrize("least", [1, 2])
def test_runs_equal_a_plain_walk(spark, monkeypatch, seed, block, least):
    monkeypatch.setattr(R, "BLOCK", block)
    rows = events(seed, 400)
    assert collapsed(spark, rows, least) == sorted(plain_runs(rows, least), key=str)


def test_one_run_over_all_partitions(spark, monkeypatch):
    """Every event repeats the one before, so pointers are doubled over many parts and all edges."""
    monkeypatch.setattr(R, "BLOCK", 5)
    rows = [(i, "hot", T0 + timedelta(seconds=i), "WRITE", "x", i % 2, "o", 1) for i in range(997)]
    assert collapsed(spark, rows, 2) == [("hot", 0, 996, 997)]


def test_runs_of_nothing(spark):
    assert collapsed(spark, []) == []
    assert collapsed(spark, [(1, None, None, None, None, None, None, None)]) == []
    assert collapsed(spark, [(1, None, T0, None, None, None, None, None)]) == [(None, 1, 1, 1)]


def test_ties_are_ordered_by_id(spark):
    rows = [(i, "a", T0, "WRITE", "x" if i < 3 else "y", 0, "", 0) for i in (5, 1, 4, 2, 3)]
    assert collapsed(spark, rows) == [("a", 1, 2, 2), ("a", 3, 5, 3)]
