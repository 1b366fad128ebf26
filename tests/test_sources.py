"""Readers on small trees and texts."""

import json
import subprocess
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from arborlens.sources import manifests as M
from arborlens.sources import state as S
from arborlens.sources import tree


def make(root, files):
    for p, text in files.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(text)


def test_scan_and_ignore(spark, tmp_path):
    make(tmp_path, {"a.go": "package a", "node_modules/x.js": "1", "sub/b.PY": "x=1\n", "sub/skip.log": "l", "sub/keep.log": "k", "out/z.bin": "", ".gitignore": "*.log\n/out\n# c\n\n", "sub/.gitignore": "!keep.log\n", ".arborlens/state.json": "{}"})
    files = tree.scan(spark, str(tmp_path), texts=True)
    got = {x["path"]: (x["size"], x["ext"]) for x in files.collect()}
    assert got["sub/b.PY"] == (4, ".PY") and got[".gitignore"][1] == ".gitignore" and len(got) == 9
    assert {x["path"] for x in tree.configured(files).collect()} == got.keys() - {"node_modules/x.js", ".arborlens/state.json"}
    kept = {x["path"] for x in tree.not_ignored(files, tree.ignore_rules(files)).collect()}
    assert kept == got.keys() - {"sub/skip.log", "out/z.bin"}


def test_diff_of_a_repository(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q", "-b", "main")
    make(tmp_path, {"main.go": "a\nb\n", "two words.txt": "x\n"})
    git("add", "-A")
    git("commit", "-qm", "one")
    make(tmp_path, {"main.go": "a\nc\nd\n", "two words.txt": "y\n", "new.go": "n\n"})
    got = {x["path"]: (x["added"], x["removed"], x["untracked"]) for x in tree.diff(spark, str(tmp_path), "HEAD").collect()}
    assert got == {"main.go": (2, 1, False), "two words.txt": (1, 1, False), "new.go": (0, 0, True)}
    assert {tuple(x) for x in tree.changed_entries(spark, str(tmp_path), "main").collect()} == {("main.go", "modified"), ("two words.txt", "modified"), ("new.go", "untracked")}
    assert {(x["pos"], x["path"]) for x in tree.commits(spark, str(tmp_path), 5).collect()} == {(0, "main.go"), (0, "two words.txt")}


def test_numstat_lines(spark):
    cases = {"3\t1\ta.go": ("a.go", 3, 1), "-\t-\timg.png": ("img.png", 0, 0), "1\t2\ta  b.txt": ("a b.txt", 1, 2), "warning: x y": None, "": None, "1\t2": None}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {x["s"]: x["n"] and tuple(x["n"]) for x in df.select("s", tree.numstat(F.col("s")).alias("n")).collect()} == cases


def test_projects(spark, tmp_path):
    for n in ("Alpha", "beta", ".hidden"):
        (tmp_path / n).mkdir()
    (tmp_path / "file").write_text("")
    df, cut = tree.projects(spark, str(tmp_path), "a")
    assert [x["name"] for x in df.collect()] == ["Alpha", "beta"] and not cut
    df, cut = tree.projects(spark, str(tmp_path), examine=2)
    assert df.count() == 0 and cut


MANIFESTS = {
    "go.mod": "module example.com/demo\n\nrequire one/single v1\n\nrequire (\n\tgithub.com/x/yaml/v2 v2.0.0\n\t// note\n\tgolang.org/x/term v0.1 // indirect\n)\n",
    "requirements.txt": "flask==2.0\nrequests>=2,<3\nnumpy~=1.0\n# c\npandas[extra]; python_version > '3'\nscikit-learn\npytest # x\n\n",
    "web/package.json": '{\n "name": "w",\n "dependencies": {\n  "react": "1",\n  "@a/b": "2"\n },\n "scripts": {\n  "x": "y"\n },\n "devDependencies": {\n  "jest": "3"\n }\n}\n',
    "Podfile": "pod 'Alamofire', '~> 5'\npod \"Snap\"\n# pod 'No'\n", "Package.swift": '  .package(url: "https://github.com/u/Repo.git", from: "1")\n', "A.csproj": '<PackageReference Include="Newtonsoft.Json" Version="1" />\n', "packages.config": '<package id="NUnit" version="3" />\n',
}


def test_manifests(spark):
    df = spark.createDataFrame([("r", p, len(t), t) for p, t in MANIFESTS.items()] + [("r", "x/requirements.txt", 9, "flask\nzope\n"), ("r", "n/go.mod", 1, None)], "root string, path string, size bigint, content string")
    got = {}
    for x in M.external(df).orderBy("language", "nth").collect():
        got.setdefault(x["language"], []).append(x["dep"])
    assert got == {
        "go": ["github.com/x/yaml/v2", "golang.org/x/term"], "python": ["flask", "requests", "numpy", "pandas", "scikit-learn", "pytest ", "zope"], "javascript": ["react", "@a/b", "jest"],
        "swift": ["Repo", "Alamofire", "Snap"], "csharp": ["Newtonsoft.Json", "NUnit"],
    }
    shown = [x["line"] for x in M.shown(M.external(df)).orderBy("ord").collect()]
    assert shown[0] == "Go: yaml, term" and shown[1] == "JavaScript: react, jest" and shown[-1] == "C#: Newtonsoft.Json, NUnit"
    assert {x["language"] for x in M.languages(df).collect()} == {"go", "python", "swift", "csharp"}
    assert [x["m"] for x in df.filter("path = 'go.mod'").select(M.module_name(F.col("content")).alias("m")).collect()] == ["example.com/demo"]
    assert M.external(df, budget=10).count() == 2


def test_log(spark):
    log = "\n".join(f"2025-12-06 14:46:{i:02d} | WRITE  | {'f%d.go' % (i % 3):<40} |   10 |     +{i} | {'dirty' if i % 2 else ''}" for i in range(40)) + "\n2025-12-06 15:00:00 | REMOVE | f0.go | 0 | -3 | \n\nbroken\n"
    logs = spark.createDataFrame([("r", log), ("s", "")], "root string, content string")
    tail = S.log_tail(logs)
    assert tail.filter("root = 'r'").count() == 20 and tail.filter("root = 's'").count() == 0
    rows = S.parsed_log(tail)
    last = {x["path"]: x["op"] for x in S.last_operations(rows, spark.createDataFrame([("r", "f0.go")], "root string, path string")).collect()}
    assert last == {"f0.go": "edited", "f1.go": "write", "f2.go": "write"}
    x = rows.filter("op = 'REMOVE'").first()
    assert (x["ts"], x["delta"], x["dirty"]) == (datetime(2025, 12, 6, 15), -3, False)
    assert S.log_tail(logs, most=100, tail=200).count() < 6


def test_agent_edits(spark):
    now = datetime(2025, 1, 3)
    lines = [{"path": "a", "session": "s1", "at": "2025-01-02T12:00:00Z"}, {"path": "b", "session": "", "at": "2025-01-02T12:00:00Z"}, {"path": "c", "session": "s1", "at": "2024-12-01T00:00:00Z"}]
    logs = spark.createDataFrame([("r", "\n".join(map(json.dumps, lines)) + "\nnot json\n")], "root string, content string")
    e = S.agent_edits(logs, F.lit(now - timedelta(hours=48)))
    assert {(x["session"], x["path"]) for x in e.collect()} == {("s1", "a"), ("", "b")}
    assert [tuple(x) for x in S.by_session(e).collect()] == [("r", "s1", ["a"])]
    w = spark.createDataFrame([("r", "a", 3), ("r", "b", 1)], "root string, path string, edits int")
    assert {(x["path"], x["mine"]) for x in S.split_working(w, e, "s1").collect()} == {("a", True), ("b", False)}


def test_setup_quality(spark):
    cases = {"none": None, "blank": "  ", "bad": "{oops", "zero": "{}", "only": '{"only": ["go"]}', "ready": '{"only": ["go"], "exclude": ["x"]}', "hints": '{"guidance": {"missing_extension_hints": false}}', "list": "[1]"}
    df = spark.createDataFrame(list(cases.items()), "root string, content string")
    assert {x["root"]: x["state"] for x in S.setup_quality(df).collect()} == {"none": "missing", "blank": "empty", "bad": "malformed", "zero": "empty", "only": "boilerplate", "ready": "ready", "hints": "ready", "list": "malformed"}


def test_skills_override(spark):
    one = "---\nname: a\npriority: 5\nkeywords: [refactor, \"x\"]\nlanguages:\n  - go\n---\nbody a"
    rows = [(0, "builtin", "a.md", one), (0, "builtin", "b.md", "no head"), (1, "project", "z.md", "---\nname: a\n---\nnew"), (2, "global", "c.txt", "x")]
    got = {x["name"]: (x["source"], x["body"], x["priority"], x["pos"]["rank"]) for x in S.skills(spark.createDataFrame(rows, "rank int, source string, path string, content string")).collect()}
    assert got == {"a": ("project", "new", 0, 0), "b": ("builtin", "no head", 0, 0)}


def test_request_with_files(spark):
    text = json.dumps({"files": [{"path": "a/b.go", "content": "x"}, {"path": "../etc", "content": ""}, {"path": "/abs", "content": ""}, {"path": "c:\\x", "content": ""}]})
    df = spark.createDataFrame([(1, text), (2, "no json"), (3, '{"files": []}')], "id bigint, text string")
    assert [(x["id"], x["path"]) for x in S.manifest_files(df).collect()] == [(1, "a/b.go")]
