"""End-user operations on a small tree with a change in it."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from arborlens import api, render
from arborlens.operators import coverage, rank

T0 = datetime(2024, 1, 2, 12)
FILES = ["pkg/math/math.go", "internal/service/service.go", "internal/worker/worker.go", "main.go", "docs/readme.md", "pkg/math/math_test.go"]


@pytest.fixture(scope="module")
def repo(spark):
    files = spark.createDataFrame([("r", p, 10 * (i + 1), "." + p.rpartition(".")[2], None, None) for i, p in enumerate(FILES)], "root string, path string, size bigint, ext string, added int, removed int")
    edges = spark.createDataFrame([("internal/service/service.go", "pkg/math/math.go"), ("internal/worker/worker.go", "pkg/math/math.go"), ("main.go", "internal/service/service.go"), ("main.go", "pkg/math/math.go"), ("pkg/math/math_test.go", "pkg/math/math.go")], "src string, dst string")
    diff = spark.createDataFrame([("pkg/math/math.go", 3, 1, False), ("new.go", 5, 0, True)], "path string, added int, removed int, untracked boolean")
    rows = [(1, "r", T0, "WRITE", "pkg/math/math.go", 5, True), (2, "r", T0, "CREATE", "main.go", 2, False), (3, "r", T0, "REMOVE", "docs/readme.md", -3, None)]
    events = spark.createDataFrame(rows, "event_id bigint, root string, ts timestamp, op string, path string, delta int, dirty boolean")
    return files, edges, diff, events


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_structure_and_views(spark, repo):
    files, edges, _, _ = repo
    got = api.structure(files, edges)
    assert rows(got["totals"]) == [(6, 210, 0, 0)] and rows(got["hubs"]) == [("pkg/math/math.go", 3)] and rows(got["depth"]) == [(4,)]
    assert [r["src"] for r in got["hub_importers"].orderBy("nth").collect()] == ["internal/service/service.go", "internal/worker/worker.go", "main.go"]
    text = render.tree(got["directories"], files, 4)
    assert text.splitlines()[0].endswith("docs/ (1 files, 50.0B)") and text.splitlines()[-1] == "└── main.go"
    assert ".go" in render.skyline(api.skyline(files)["buildings"])
    assert render.markdown("Tree", {"totals": got["totals"]}).startswith("# Tree\n\n## totals")


def test_importers_and_context(spark, repo):
    _, edges, _, _ = repo
    got = api.importers(edges, "./pkg//math/math.go")
    (r,) = got["report"].collect()
    assert (r["importer_count"], r["is_hub"], r["truncated"]) == (4, True, False) and got["importers"].count() == 4
    ctx = api.file_context(edges, "internal/service/service.go")
    assert rows(ctx["connected"].orderBy("other")) == [("main.go",), ("pkg/math/math.go",)] and rows(ctx["facts"]) == [("internal/service/service.go", 1, 1, False)]
    assert api.importers(edges, "none.go")["report"].first()["importer_count"] == 0


def test_blast_radius(spark, repo):
    files, edges, diff, _ = repo
    lines = spark.createDataFrame([("internal/service/service.go", 1, 'import "pkg/math"'), ("internal/service/service.go", 2, "x := ComputeTotal(1)"), ("main.go", 1, "nothing")], "path string, line_no int, line string")
    functions = spark.createDataFrame([("pkg/math/math.go", ["Sum", "ComputeTotal"])], "path string, functions array<string>")
    got = api.blast_radius(files, diff, edges, lines, functions)
    assert rows(got["summary"]) == [(1, 4, 1, 4, "pkg/math/math.go")]
    assert {r["path"] for r in got["impacted"].collect()} == {"internal/service/service.go", "internal/worker/worker.go", "main.go", "pkg/math/math_test.go"}
    assert [(r["path"], r["line_no"]) for r in got["snippets"].collect()] == [("internal/service/service.go", 2)]
    # caps are for what is shown only
    few = api.blast_radius(files, diff, edges, limits=api.Limits(impacted=1))
    assert few["impacted"].count() == 1 and few["summary"].first()["impacted"] == 4


def test_activity_and_handoff(spark, repo):
    files, edges, diff, events = repo
    now = F.lit(T0) + F.expr("interval 10 minutes")
    got = api.recent_activity(events, now)
    assert rows(got["summary"]) == [("r", 2, 2, 7, 1)] and got["timeline"].count() == 3
    assert api.recent_activity(events, now, "10 minutes")["summary"].count() == 0  # strictly after
    d = diff.select("path", F.when(F.col("untracked"), "untracked").otherwise("modified").alias("status"))
    h = api.build_handoff(files, d, edges, events, now)
    assert rows(h["changed"]) == [("pkg/math/math.go", True), ("new.go", False)] and rows(h["risk"]) == [("pkg/math/math.go", 4, True)]
    again = api.build_handoff(files, d, edges, events, now)
    assert rows(h["prefix"]) == rows(again["prefix"]) and len(rows(h["delta"])[0][0]) == 64
    none = api.build_handoff(files, d.limit(0), edges, events, now)
    assert {r["status"] for r in none["statuses"].collect()} == {"event"}
    assert rows(api.session_stop(events, edges)["hub_edits"]) == [("pkg/math/math.go", 3)]


PROMPTS = ["fix the broken test in pkg/math/math.go", "add test coverage for the intent system", "hello world", "", "rename and restructure main.go and internal/worker/worker.go", "how does the daemon work", "merge the pull request"]


def test_envelope(spark, repo):
    files, edges, _, _ = repo
    prompts = spark.createDataFrame(list(enumerate(PROMPTS)), "id bigint, text string")
    skills = spark.createDataFrame([("b", 0, ["refactor"], [], []), ("a", 5, ["refactor"], ["go"], []), ("c", 50, [], [], ["*.py"])], "name string, priority int, keywords array<string>, languages array<string>, patterns array<string>")
    got = api.envelope(prompts, files, edges, skills, [("math", ["total"], ["pkg/math"])])
    assert {r["id"]: r["category"] for r in got["intent"].collect()} == {0: "bugfix", 1: "test", 2: "feature", 3: "feature", 4: "refactor", 5: "explore", 6: "vcs"}
    assert {r["id"]: r["scope"] for r in got["scope"].collect()} == {0: "single-file", 1: "unknown", 2: "unknown", 3: "unknown", 4: "cross-cutting", 5: "unknown", 6: "unknown"}
    assert {r["id"]: r["risk"] for r in got["risk"].collect() if r["id"] in (0, 1, 4)} == {0: "medium", 1: "unknown", 4: "low"}
    assert [(r["name"], r["score"], r["reason"]) for r in got["skills"].filter("id = 4").orderBy("nth").collect()] == [("a", 6, "category:refactor, language:go"), ("b", 3, "category:refactor")]
    assert [tuple(r) for r in got["routes"].collect()] == [(0, 1, "math", 1)]


def test_find_and_edits(spark, repo):
    files, edges, _, _ = repo
    got = api.find(files, "MATH", only=["py"], exclude=["*_test*"])
    assert got["found"].count() == 0 and rows(got["hidden"]) == [("pkg/math/math.go",)]
    assert api.edit_check(edges, files.limit(3))["report"].count() == 3


def test_coverage(spark):
    cases = {"none": [], "auth": ["authoritative"], "fall": ["fallback"], "time": ["timeout"], "mix": ["authoritative", "timeout"]}
    s = spark.createDataFrame([(k, x, i, f"note {x}") for k, v in cases.items() for i, x in enumerate(v or [None])], "k string, status string, seq int, detail string")
    assert {r["k"]: r["status"] for r in coverage.reduced(s, ["k"]).collect()} == {"none": "unavailable", "auth": "complete", "fall": "partial", "time": "unavailable", "mix": "partial"}
    folds = {("authoritative",): "", ("timeout",): "unavailable", ("timeout", "authoritative"): "partial", ("fallback", "timeout"): "partial", (): "", ("authoritative", "failed"): "partial"}
    df = spark.createDataFrame([(list(k),) for k in folds], "s array<string>")
    assert {tuple(r["s"]): r["f"] for r in df.select("s", coverage.folded(F.col("s")).alias("f")).collect()} == folds


def test_drift(spark):
    commits = spark.createDataFrame([(0, "watch/a.go"), (3, "docs/watch.md"), (1, "x/y.go"), (20, "docs/old.md"), (4, "docs/new.md"), (5, "cmd/h.go")], "pos int, path string")
    pairs = spark.createDataFrame([("watch", "docs/watch.md", "watch/"), ("x", "docs/old.md", "x/"), ("h", "docs/new.md", "cmd/h.go"), ("gone", "docs/new.md", "none/")], "subsystem string, doc string, code string")
    assert {(r["subsystem"], r["behind"]) for r in rank.drift(commits, pairs, 10).collect()} == {("watch", 3), ("x", 10)}


def test_text_budget():
    t = render.Text(40, "!cut")
    assert t.add("```\n" + "x" * 20) and not t.add("y" * 50) and not t.add("z")
    assert str(t).endswith("\n```!cut") and str(t).count("```") == 2
