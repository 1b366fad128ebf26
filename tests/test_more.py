"""Storage of hand-offs, watches, limits, control events and sources of coverage on small cases."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from arborlens import api
from arborlens.functions import extract
from arborlens.functions import text as T
from arborlens.operators import activity, coverage, handoff
from arborlens.streaming import edits

T0 = datetime(2024, 1, 1)
ARTIFACT = "root string, generated_at timestamp, prefix struct<file_count:int,hubs:array<struct<path:string,importers:int>>>, delta struct<changed:array<struct<path:string,status:string>>,next_steps:array<string>>, prefix_hash string, delta_hash string, combined_hash string"


def test_storing_and_reading_hand_offs(spark, tmp_path):
    folder = str(tmp_path / "store")
    assert handoff.read_latest(spark, folder) is None
    for n in range(4):
        rows = [("a", T0 + timedelta(hours=n), (n, None), (None, ["go on"]), None, "", None), ("a", T0 - timedelta(hours=1), (9, []), None, "old", "old", "old"), ("b", T0, None, None, None, None, None)]
        handoff.write_latest(spark.createDataFrame(rows, ARTIFACT), folder, most=3)
    got = {r["root"]: r for r in handoff.read_latest(spark, folder).collect()}
    assert got["a"]["prefix"]["file_count"] == 3 and got["a"]["prefix"]["hubs"] == [] and got["a"]["delta"]["changed"] == []
    assert got["a"]["combined_hash"] and got["a"]["prefix_hash"] != got["b"]["prefix_hash"]
    lines = handoff.read_latest(spark, folder, "metrics").collect()
    # the newest three of a; b wrote the same line each time
    assert sorted((r["root"], r["generated_at"]) for r in lines) == [("a", T0 + timedelta(hours=n)) for n in (1, 2, 3)] + [("b", T0)]


def test_digests_tell_rows_not_order(spark):
    one = lambda rows: handoff.digest(spark.createDataFrame(rows, "path string, n int"), "path", "n").first()["hash"]
    assert one([("a", 1), ("b", None)]) == one([("b", None), ("a", 1)]) != one([("a", 1), ("b", 0)])
    assert one([("a", 1), ("a", 1)]) != one([("a", 1)]) != one([])


def test_rendering_counts_what_it_leaves_out(spark):
    rows = spark.createDataFrame([("k", i, f"p{i}") for i in range(4)], "key string, nth int, item string")
    none = rows.limit(0)
    (one,) = handoff.rendered(rows, none, none, spark.createDataFrame([("k", "main")], "key string, head string"), 1).collect()
    assert one["text"] == "# main\n\n## Changed\n- p0\n- p1\n... and 2 more"


def test_limits_from_settings():
    got = api.limits_from({"ARBORLENS_MAX_CHANGED": " 7 ", "ARBORLENS_MAX_HUBS": "-3", "ARBORLENS_MAX_LISTED": "many"})
    assert (got.changed, got.hubs, got.listed, got.context) == (7, 0, 500, 8)


def test_watches(spark, tmp_path):
    schema = "event_id bigint, root string, ts timestamp, op string, path string, lines int, size bigint, delta int"
    spark.createDataFrame([(1, "r", T0, "WRITE", "a.go", 1, 1, 1)], schema).write.parquet(f"{tmp_path}/in")
    start = lambda: edits.append_to(edits.read_events(spark, f"{tmp_path}/in", schema), f"{tmp_path}/out", f"{tmp_path}/check", once=False)
    assert api.watch_status("w") == {"active": False, "batch": None, "rows": 0, "error": ""}
    assert api.watch_start("w", start) == "started" and api.watch_start("w", start) == "running" and api.watch_status("w")["active"]
    assert api.watch_stop("w") and not api.watch_stop("w") and not api.watch_status("w")["active"]


def test_control_and_members(spark):
    rows = [(1, "r", T0, "WRITE", "sub/.gitignore"), (2, "r", T0, "WRITE", ".arborlens/config.json"), (3, "r", T0, "CREATE", "a.go"), (4, "r", T0, "REMOVE", "b.go"), (5, "r", T0, "CREATE", "vite.config.ts.timestamp-1-a.mjs"), (6, "r", T0, "WRITE", "notes.txt")]
    e = spark.createDataFrame(rows, "event_id int, root string, ts timestamp, op string, path string")
    control, data = activity.split_control(e)
    assert {r["event_id"]: r["control"] for r in control.collect()} == {1: "ignores", 2: "config"} and {r["event_id"] for r in data.collect()} == {3, 4}
    start = spark.createDataFrame([("r", "b.go"), ("r", "c.go"), ("s", "a.go")], "root string, path string")
    assert {tuple(r) for r in activity.members(data, start).collect()} == {("r", "a.go"), ("r", "c.go"), ("s", "a.go")}


def test_outcomes_of_fallbacks(spark):
    kind = "k int, status string, detail string"
    first = [(1, "authoritative", "x"), (2, "timeout", "late"), (3, "mixed", None), (4, "timeout", "")]
    second = [(1, "fallback", "y"), (2, "fallback", "y"), (3, "fallback", "y"), (4, "timeout", "z"), (5, "fallback", "only")]
    got = {r["k"]: (r["status"], r["detail"]) for r in coverage.merged(spark.createDataFrame(first, kind), spark.createDataFrame(second, kind), ["k"]).collect()}
    assert got == {1: ("authoritative", "x; y"), 2: ("fallback", "late; y"), 3: ("mixed", "y"), 4: ("timeout", "z"), 5: ("fallback", "only")}


def test_go_without_a_parser(spark):
    rows = [("a.go", 'package a\n\nimport "fmt"\n\n// func No() {\nfunc A() { fmt.Print("}") }\nfunc (t T) M() {}\n'), ("b.go", "func B() {}"), ("c.go", "package c\nfunc C() {"), ("d.go", None), ("e.py", "def f(): pass")]
    got = extract.go_fallback(spark.createDataFrame([(1, *r) for r in rows], "k int, path string, content string"))
    assert {r["path"]: (r["imports"], r["functions"], r["skipped"]) for r in got.collect()} == {"a.go": (["fmt"], ["A"], False), "b.go": ([], [], True), "c.go": ([], [], True), "d.go": ([], [], True)}
    assert [tuple(r) for r in extract.recovered(got, ["k"]).collect()] == [(1, "fallback", "recovered 1 of 4 files")]


def test_texts_without_controls_and_literals(spark):
    df = spark.createDataFrame([("\u001b[1mx\u001b[0m \u001b]8;;http://a\u0007link\u001b]8;;\u001b\\", 'a("x\\"y"); r#"q"z"#; r"w"; "" // z'), (None, None)], "a string, b string")
    got = df.select(T.plain_text(F.col("a")), T.rust_strings(F.col("b"))).collect()
    assert tuple(got[0]) == ("x link", ['x\\"y', 'q"z', "w", ""]) and tuple(got[1]) == (None, None)
