"""Resolution on small trees with results worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from arborlens.functions.dims import LADDER
from arborlens.functions.extract import analyses, function_name, import_path
from arborlens.operators import graph
from arborlens.operators import resolve as R
from arborlens.plans import reference


def resolved(spark, files, imports, module=None, aliases=None):
    f = spark.createDataFrame([("r", p) for p in files], "root string, path string")
    m = spark.createDataFrame([("r", module)], "root string, module string") if module else None
    a = spark.createDataFrame([("r", p, n, t) for p, n, t in aliases], "root string, pattern string, nth int, target string") if aliases else None
    i = spark.createDataFrame([("r", p, s) for p, s in imports], "root string, path string, spec string")
    got = R.resolve(R.attempts(i, m, a), R.index(f, m)).collect()
    return {(x["src"], x["spec"], x["dst"]) for x in got}


def test_ladder(spark):
    files = ["pkg/util/helpers.go", "pkg/main.go", "src/shared/config.py", "src/services/__init__.py", "src/modules/auth/login.ts", "src/app.ts", "src/run.py", "other/x.rb"]
    got = resolved(
        spark, files,
        [("pkg/main.go", "example.com/p/pkg/util"), ("pkg/main.go", "fmt"), ("pkg/main.go", "./util/helpers"), ("src/app.ts", "@modules/auth/login"), ("src/run.py", "src.shared.config"), ("src/run.py", "shared.config"), ("src/run.py", "services"), ("src/run.py", "missing.pkg.path"), ("src/app.ts", "lodash"), ("notes.md", "src.shared.config")],
        module="example.com/p", aliases=[("@modules/*", 0, "./src/modules/*")],
    )
    assert got == {
        ("pkg/main.go", "example.com/p/pkg/util", "pkg/util/helpers.go"), ("pkg/main.go", "./util/helpers", "pkg/util/helpers.go"), ("src/app.ts", "@modules/auth/login", "src/modules/auth/login.ts"),
        ("src/run.py", "src.shared.config", "src/shared/config.py"), ("src/run.py", "shared.config", "src/shared/config.py"), ("src/run.py", "services", "src/services/__init__.py"),
    }


def test_go_packages_fail_closed(spark):
    files = ["pkg/only/only.go", "pkg/multi/a.go", "pkg/multi/b.go", "pkg/t/t_test.go", "cmd/caller.go", "fmt/fmt.go"]
    specs = ["fmt", "github.com/x/y", "example.com/demo-extra/pkg/only", "example.com/demo/pkg/none", "example.com/demo/pkg/only", "example.com/demo/pkg/t", "example.com/demo/pkg/multi"]
    got = resolved(spark, files, [("cmd/caller.go", s) for s in specs], module="example.com/demo")
    assert got == {("cmd/caller.go", "example.com/demo/pkg/only", "pkg/only/only.go")}
    assert resolved(spark, files, [("cmd/caller.go", "example.com/demo/pkg/only")]) == set()


def test_directories_and_relatives(spark):
    files = ["MyApp/Models/User.cs", "MyApp/Models/Product.cs", "MyApp/Services/UserService.cs", "a/b/c.js", "a/d.js", "a/lib/index.js", "e.py", "p/__init__.py", "p/q.py"]
    got = resolved(spark, files, [("MyApp/Services/UserService.cs", "MyApp.Models"), ("MyApp/Services/UserService.cs", "X.MyApp.Services"), ("MyApp/Services/UserService.cs", "System.Collections.Generic"), ("a/b/c.js", "../d"), ("a/b/c.js", "../../../../a/d.js"), ("a/d.js", "./lib"), ("a/d.js", "./b/c.js"), ("p/q.py", ".")])
    cs = "MyApp/Services/UserService.cs"
    assert got == {
        (cs, "MyApp.Models", "MyApp/Models/User.cs"), (cs, "MyApp.Models", "MyApp/Models/Product.cs"), (cs, "X.MyApp.Services", cs), ("a/b/c.js", "../d", "a/d.js"), ("a/b/c.js", "../../../../a/d.js", "a/d.js"),
        ("a/d.js", "./lib", "a/lib/index.js"), ("a/d.js", "./b/c.js", "a/b/c.js"), ("p/q.py", ".", "p/__init__.py"),
    }


def test_alias_targets_in_order(spark):
    files = ["src/a/x.ts", "gen/x.ts", "lib/deep/y.ts", "app.ts"]
    aliases = [("@/*", 0, "gen/*"), ("@/*", 1, "src/a/*"), ("@/deep/*", 0, "deep/*"), ("whole", 0, "src/a/x")]
    got = resolved(spark, files, [("app.ts", "@/x"), ("app.ts", "@/deep/y"), ("app.ts", "whole"), ("app.ts", "@x")], aliases=aliases)
    assert got == {("app.ts", "@/x", "gen/x.ts"), ("app.ts", "@/deep/y", "lib/deep/y.ts"), ("app.ts", "whole", "src/a/x.ts")}


@pytest.mark.parametrize("name", ["resolve_degree", "resolve_ladder"])
def test_lookups_are_not_broadcast(spark, data, monkeypatch, name):
    """Small files hold many rows: what their size tells the planner is no reason to send keys, hits or files to the driver."""
    plans, cut = {}, R.cut

    def seen(df, step):
        plans[step] = df._jdf.queryExecution().executedPlan().toString()
        return cut(df, step)

    monkeypatch.setattr(R, "cut", seen)
    seen(reference.QUERIES[name](spark, data), "result")
    for step in ("hits", "result"):
        assert "SortMergeJoin" in plans[step]
        assert "Broadcast" not in plans[step]


def test_endings_in_order(spark):
    """Against trying every ending on every attempt."""
    asked = ["a", "a/b", "a.b", "a/", "b", "", "__init__", "a/index", "index.js", "a/__init__.py", "mod", "b/c", "A"]
    odd = ["__init__.py", "index.js", ".py", "/mod.rs", "", "a.PY", "a.tar.go", "/a", "a/b/", "b/c/index.js/index.js"]
    some = random.Random(7)
    keys = {k: sorted({*odd, *some.sample([a + e for a in asked for e in LADDER], 60)}) for k in ("exact", "suffix", "whole", "dir")}
    idx = spark.createDataFrame([("r", k, x, "f", f"{k}:{x}") for k, xs in keys.items() for x in xs], "root string, kind string, key string, family string, path string")
    tries = spark.createDataFrame([("r", "s", f"{k}:{a}", "f", R.EXACT, k, a) for k in keys for a in asked], "root string, src string, spec string, family string, strategy int, kind string, key string")

    def first(kind, key):
        full = ["__init__.py"] if key == "" else [key + e for e in LADDER]
        parts = key.split("/")
        tried = full if kind in ("exact", "suffix") else ["/".join(parts[i:]) for i in range(len(parts))] if kind == "dir" else [key]
        return next((x for x in tried if x in keys[kind]), None)

    want = {(f"{k}:{a}", f"{k}:{first(k, a)}") for k in keys for a in asked if first(k, a) is not None}
    assert {(x["spec"], x["dst"]) for x in R.resolve(tries, idx).collect()} == want


def test_normalised(spark):
    cases = {'"pkg/util"': "pkg/util", "app.core.config": "app/core/config", "../app.core": "../app.core", "crate::feature::parser": "feature/parser", "super::module::item": "super/module/item"}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {x["s"]: x["n"] for x in df.select("s", R.normalised(F.col("s")).alias("n")).collect()} == cases


def test_import_statements(spark):
    cases = {
        "#include <stdio.h>": "stdio.h", '#include "a/b.h"': "a/b.h", "source ./env.sh": "./env.sh", "import x from 'y/z'": "y/z", "using static Foo.Bar;": "Foo.Bar", "using A = Foo.Bar.Baz;": "Foo.Bar.Baz",
        "import os": "os", "from a.b import c": "a.b", "use foo::bar;": "foo", "import java.util.List;": "java.util.List", "nothing": "", "": "",
    }
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {x["s"]: x["n"] for x in df.select("s", import_path(F.col("s")).alias("n")).collect()} == cases


def test_function_heads(spark):
    cases = {
        ("func (r *T) Name(a int)", "go"): "Name", ("func Plain()", "go"): "Plain", ("async function go2(x)", "typescript"): "go2", ("public static run(x)", "typescript"): "run", ("if (x)", "javascript"): "", ("def f(x):", "python"): "f",
        ("pub fn parse<T>(x: T)", "rust"): "parse", ("public void doIt(int a)", "java"): "doIt", ("def ok?(x)", "ruby"): "ok?", ("func go(x: Int)", "swift"): "go", ("int *find(char c)", "c"): "find", ("run() {", "bash"): "run", ("function x() {}", "php"): "",
    }
    df = spark.createDataFrame(list(cases), "t string, l string")
    assert {(x["t"], x["l"]): x["n"] for x in df.select("t", "l", function_name(F.col("t"), F.col("l")).alias("n")).collect()} == cases


def test_analyses_and_hubs(spark):
    files = [
        ("types.py", "X = 1\n"), ("a.py", "import types\n\ndef f(x):\n    pass\n"), ("b.py", "from types import X\n"), ("c.py", "import types, os\n"), ("test_d.py", "import types\n"), ("notes.md", "import types\n"), ("e.py", None),
    ]
    one = analyses(spark.createDataFrame([("r", *f) for f in files], "root string, path string, content string"))
    assert {x["path"]: (x["language"], x["imports"], x["functions"]) for x in one.collect()}["a.py"] == ("python", ["types"], ["f"])
    idx = R.index(spark.createDataFrame([("r", p) for p, _ in files], "root string, path string"))
    e = R.edges(R.resolve(R.attempts(one.select("root", "path", F.explode("imports").alias("spec"))), idx))
    assert [tuple(x) for x in graph.hubs(e).collect()] == [("types.py", 3)]
    assert [tuple(x) for x in graph.hubs(e, "all").collect()] == [("types.py", 4)]


def test_hub_ignores_tests(spark):
    rows = [("a.go", "pkg/types.go"), ("b_test.go", "pkg/types.go"), ("c.go", "pkg/types.go")] + [(f"{x}.go", "pkg/hub.go") for x in "abc"] + [(f"{x}.go", "pkg/pop_test.go") for x in "abcd"]
    e = spark.createDataFrame(rows, "src string, dst string")
    assert [x["path"] for x in graph.hubs(e).collect()] == ["pkg/hub.go"]
    assert {x["path"] for x in graph.hubs(e, "report").collect()} == {"pkg/hub.go", "pkg/pop_test.go"}
    assert {x["path"] for x in graph.hubs(e, "shown").collect()} == {"pkg/types.go", "pkg/hub.go", "pkg/pop_test.go"}
