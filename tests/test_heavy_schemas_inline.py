"""Heavy keys, drifting schemas and nested records on small cases and against plain Python."""

import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from arborlens.operators.events import agents
from arborlens.operators.heavy import distinct_members, heavy_keys, pair_ranges
from arborlens.operators.inline import flatten, latest
from arborlens.operators.schemas import conform, edit_script, file_scripts, parts, schema_changes, typed_paths

T0 = datetime(2024, 1, 1)


def test_members_of_a_heavy_key(spark):
    r = random.Random(1)
    rows = [("hot" if r.random() < 0.5 else r.choice(["a", "b", None]), r.choice([None, *map(str, range(50))]), 1) for _ in range(2000)]
    got = {x["k"]: (x["rows"], x["members"]) for x in distinct_members(spark.createDataFrame(rows, "k string, m string, rows int"), ["k"], "m").collect()}
    assert got == {k: (sum(x[0] == k for x in rows), len({x[1] for x in rows if x[0] == k} - {None})) for k in ("hot", "a", "b", None)}


def test_heavy_share_counts_pairs(spark):
    rows = [("a", str(i)) for i in range(98)] + [("b", "x")] * 50 + [("c", "y"), ("d", None)]
    got = {x["k"]: x["members"] for x in heavy_keys(spark.createDataFrame(rows, "k string, m string"), ["k"], "m", 0.01).collect()}
    assert got == {"a": 98, "b": 1, "c": 1}
    assert heavy_keys(spark.createDataFrame([], "k string, m string"), ["k"], "m", 0.01).count() == 0


def test_hot_pairs_and_null_members_are_spread(spark):
    # one pair has 99 % of all rows, a null member half of the rest
    rows = spark.range(200_000).selectExpr("if(id % 100 > 0, 'hot', concat('k', id % 7)) as k", "case when id % 100 > 0 then 'one' when id % 200 = 0 then null else cast(id as string) end as m")
    more = spark.range(3000).selectExpr("'hot' as k", "cast(id as string) as m")
    spread = pair_ranges(rows.unionByName(more), ["k"], "m")
    sizes = [r["n"] for r in spread.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) > 1 and max(sizes) <= 2 * sum(sizes) / len(sizes), sizes
    got = {r["k"]: (r["rows"], r["members"]) for r in distinct_members(rows.unionByName(more), ["k"], "m").collect()}
    assert got["hot"] == (201_000, 3001) and sum(r for r, _ in got.values()) == 203_000


def test_edit_scripts():
    s = lambda v: {p: t for p, t in typed_paths(v)}
    assert edit_script(s({"a": 1, "b": "x"}), s({"a": "1", "c": "x"})) == [("renamed", "b", "c"), ("retyped", "a", "a")]
    # two that go and one that comes: nothing tells which was renamed
    assert edit_script(s({"a": 1, "b": 2}), s({"c": 3})) == [("added", "", "c"), ("removed", "a", ""), ("removed", "b", "")]
    # nothing below what was reported
    assert edit_script(s({"d": {"x": 1, "y": [1]}}), s({"e": {"x": "1"}})) == [("renamed", "d", "e")]
    assert edit_script(s({"d": [{"x": 1}]}), s({"d": [{"x": 1, "z": None}, {"y": 2}]})) == [("added", "", "d[].y")]
    assert edit_script(s({"d": {"x": 1}, "e": {"q": 1}}), s({"d": {"q": 1}, "e": {"x": 1}}), moves=True) == [("renamed", "d.x", "d.q"), ("renamed", "e.q", "e.x")]
    assert edit_script(s({"d": {"x": 1, "k": True}, "e": {"q": 1}}), s({"d": {"k": True}, "e": {"q": 1, "x": 1}}), moves=True) == [("moved", "d.x", "e.x")]
    assert edit_script({}, {}) == []
    assert parts("delta.changed[].size") == ["delta", "changed", "[]", "size"] and parts("a[][].b") == ["a", "[]", "[]", "b"]


RAW = "record_id bigint, lineage string, file_name string, file_written_at timestamp, payload string, written string, path string"


def raw(spark, rows):
    return spark.createDataFrame([(i, l, f, t, p, "clash", "clash") for i, (l, f, t, p) in enumerate(rows)], RAW)


def test_changes_between_files(spark):
    h = lambda n: T0 + timedelta(hours=n)
    rows = [
        ("L", "f1", h(1), json.dumps({"v": 1, "d": {"size": 1}})), ("L", "f1", h(1), json.dumps({"v": 2, "opt": None})), ("L", "f1", h(1), '{"v": 3, "broken'),
        ("L", "f2", h(2), json.dumps({"ver": 1, "d": {"size": "1"}})), ("L", "f2", h(2), json.dumps({"ver": 1, "d": {"size": "1"}})), ("L", "f3", h(3), None), ("L", "f3", h(3), ""), ("L", "f3", h(3), "[1]"),
        ("L", "f4", h(4), json.dumps({"ver": 1, "d": {"size": "1"}, "new": [1]})), ("M", "g1", h(1), json.dumps({"a": 1})), (None, "n1", None, json.dumps({"a": 1})), (None, "n2", h(1), json.dumps({"a": True})),
    ]
    got = {tuple(x) for x in schema_changes(raw(spark, rows), "lineage", "file_name", "file_written_at", "payload").select("file_name", "change_kind", "old_path", "new_path").collect()}
    # f3 holds no readable record and is left out
    assert got == {("f2", "renamed", "v", "ver"), ("f2", "retyped", "d.size", "d.size"), ("f4", "added", "", "new"), ("n2", "retyped", "a", "a")}


def test_one_table_with_first_names(spark):
    h = lambda n: T0 + timedelta(hours=n)
    rows = [
        ("L", "f1", h(1), json.dumps({"v": 1, "c": [{"p": "a"}]})), ("L", "f2", h(2), json.dumps({"ver": 2, "c": [{"q": "b"}]})), ("L", "f3", h(3), json.dumps({"version": "3", "c": [{"q": "c"}]})),
        ("L", "f4", h(4), json.dumps({"name": "4", "c": [{"q": "c"}]})), ("L", "f4", h(4), "{"),
    ]
    df = raw(spark, rows)
    changes = file_scripts(df, "lineage", "file_name", "file_written_at", "payload")
    got = {x["file_name"]: dict(x["fields"]) for x in conform(df, changes, "lineage", "file_name", "payload", ["record_id"]).collect()}
    assert [got[f].get("v") for f in ("f1", "f2")] == ["1", "2"]
    # a rename that also changes the type is a removal and an addition, and stays apart
    assert got["f3"]["version"] == "3" and got["f4"]["version"] == "4"
    assert {json.loads(g["c"])[0].get("p") for g in got.values()} == {"a", "b", "c"}


def test_empty_schemas(spark):
    df = raw(spark, [])
    changes = file_scripts(df, "lineage", "file_name", "file_written_at", "payload")
    assert changes.count() == 0 and conform(df, changes, "lineage", "file_name", "payload", []).count() == 0


HISTORY = [
    ('[{"agent_id": "a", "files_edited": ["x", null, {"path": "y", "edits": [{"line": 1, "delta": -2}]}]}, null, {"agent_id": "b", "files_edited": null}]', [(0, "a"), (2, "b")], [(0, 0, "x"), (0, 2, "y")]),
    ('{"agent_id": "c", "files_edited": []}', [(0, "c")], []),
    (json.dumps('[{"agent_id": "d", "files_edited": ["z"]}]'), [(0, "d")], [(0, 0, "z")]),
    ("null", [], []), (None, [], []), ("", [], []), ('[{"agent_id": "e"', [], []), ("7", [], []), ('"text"', [], []),
]


def test_agent_histories_in_any_shape(spark):
    df = spark.createDataFrame([(i, h) for i, (h, _, _) in enumerate(HISTORY)], "id int, agent_history string")
    tables = flatten(df.withColumn("agent_history", agents(F.col("agent_history"))), ["id"], "rec")
    got = {(x["id"], x["pos"], x["agent_id"]) for x in tables["agent_history"].collect()}
    assert got == {(i, *a) for i, (_, ags, _) in enumerate(HISTORY) for a in ags}
    got = {(x["id"], x["outer_pos"], x["pos"], x["path"]) for x in tables["files_edited"].collect()}
    assert got == {(i, *f) for i, (_, _, fs) in enumerate(HISTORY) for f in fs}
    assert [(x["id"], list(x["places"]), x["pos"], x["line"], x["delta"]) for x in tables["edits"].collect()] == [(0, [0, 2], 0, 1, -2)]


def test_inlining_sharing_and_clashes(spark):
    schema = "id int, pos string, one struct<a:int,two:struct<b:string>>, left struct<items:array<struct<k:int,pos:int>>>, right struct<items:array<struct<k:int,pos:int>>>, m map<string,int>, other struct<items:array<string>>"
    rows = [(1, "p", (1, ("x",)), ([(1, 5), None],), ([(2, 6)],), {"u": 1}, (["t"],)), (2, None, None, None, ([],), None, None), (None, None, None, ([(3, None)],), None, {}, (None,))]
    t = flatten(spark.createDataFrame(rows, schema), ["id"], "rec")
    assert set(t) == {"rec", "items", "m", "rec_items"}
    assert set(t["rec"].columns) == {"id", "pos", "one.a", "one.two.b"}
    assert sorted((tuple(x[c] for c in ("id", "outer_pos", "pos", "k", "item.pos")) for x in t["items"].collect()), key=str) == sorted([(1, -1, 0, 1, 5), (1, -1, 0, 2, 6), (None, -1, 0, 3, None)], key=str)
    assert [tuple(x) for x in t["m"].select("id", "pos", "key", "value").collect()] == [(1, 0, "u", 1)]
    assert [tuple(x) for x in t["rec_items"].select("id", "pos", "value").collect()] == [(1, 0, "t")]


def test_shared_structs_have_one_table(spark):
    who = "struct<name:string,at:struct<city:string>,tags:array<string>>"
    schema = f"id int, author {who}, reviews array<struct<stars:int,author:{who}>>, only struct<x:int>, `only.x` int"
    rows = [(1, ("ann", ("oslo",), ["t"]), [(5, ("bob", None, None)), (4, None)], (7,), 8), (2, None, [(3, ("eve", ("rome",), []))], None, None)]
    t = flatten(spark.createDataFrame(rows, schema), ["id"], "rec")
    assert set(t) == {"rec", "author", "reviews", "tags"} and set(t["rec"].columns) == {"id", "only.x", "only.x_"}
    got = {tuple(r) for r in t["author"].select("id", "parent_table", "outer_pos", "pos", "name", "`at.city`").collect()}
    assert got == {(1, "rec", -1, 0, "ann", "oslo"), (1, "reviews", 0, 0, "bob", None), (2, "reviews", 0, 0, "eve", "rome")}
    assert [tuple(r) for r in t["tags"].select("id", "parent_table", "outer_pos", "pos", "value").collect()] == [(1, "author", 0, 0, "t")]


def test_three_shapes_of_one_name(spark):
    schema = "id int, a struct<l:array<int>,m:struct<l:array<string>>,n:struct<l:array<boolean>>>"
    t = flatten(spark.createDataFrame([(1, ([1], (["x"],), ([True],)))], schema), ["id"], "rec")
    assert {n: [r["value"] for r in f.collect()] for n, f in t.items() if n != "rec"} == {"l": [1], "rec_l": ["x"], "rec_l_2": [True]}


def test_latest_version(spark):
    rows = [(1, T0, "old"), (1, T0 + timedelta(1), "new"), (1, None, "none"), (2, None, "only"), (None, T0, "x"), (1, T0 + timedelta(1), "new")]
    got = {x["id"]: x["v"] for x in latest(spark.createDataFrame(rows, "id int, at timestamp, v string"), ["id"], ["at"]).collect()}
    assert got == {1: "new", 2: "only", None: "x"}
