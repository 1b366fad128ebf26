"""Hand-written and other source on small trees, and attribute rules against git."""

import random
import shutil
import subprocess

import pytest

from arborlens.llm import authored as A

FILES = "file_id bigint, root string, path string, size bigint, reason string, stem string"
CONTENTS = "file_id bigint, path string, content string"


def found(spark, files, contents):
    f = spark.createDataFrame([(*x, "clash", "clash") for x in files], FILES)
    return {x["file_id"]: x["reason"] for x in A.classify(f, spark.createDataFrame(contents, CONTENTS)).collect()}


def test_globs():
    import re

    def hit(glob, path):
        return bool(re.search(A.glob_regex(glob), path))

    assert hit("*.pb.go", "a/b/x.pb.go") and A.glob_regex("vendor/") is None
    assert hit("/gen/*", "gen/x") and not hit("/gen/*", "a/gen/x") and not hit("gen/*", "a/gen/x") and not hit("gen/*", "gen/a/x")
    assert hit("**/gen/**", "gen/a/x") and hit("**/gen/**", "a/gen/x") and hit("a/**/z", "a/z") and hit("a/**/z", "a/b/c/z")
    assert hit("x?[0-9].js", "xa1.js") and not hit("x?[!0-9].js", "xa1.js")


def test_rules_are_those_of_git(spark, tmp_path):
    """Which paths attribute files mark, as git itself tells."""
    if not shutil.which("git"):
        pytest.skip("needs git")
    r = random.Random(11)
    names = ["a", "gen", "x.pb.go", "y_gen.ts", "lib.min.js", "sub", "d e.js", "[z]", "#h", "v-1"]
    globs = ["gen", "gen/", "/gen/*", "gen/**", "**/gen/**", "**/gen", "a/**/x.pb.go", "*.pb.go", "*_gen.*", "?", "[a-f]", "[!a-f]*", "a/*", "*/sub/*", '"d e.js"', "\\#h", "a**.go", "sub/**/gen", "/*.js", "**", "!gen", "v-[0-9]", "a/gen", "[[]z]"]
    values = ["linguist-generated", "-linguist-generated", "!linguist-generated", "linguist-generated=true", "linguist-generated=false", "linguist-generated linguist-vendored", "text"]
    files, contents, want, n = [], [], {}, 0
    for k in range(6):
        root = tmp_path / f"r{k}"
        root.mkdir()
        subprocess.run(["git", "init", "-q", str(root)], check=True)
        paths = sorted({"/".join(r.choice(names) for _ in range(r.randint(1, 4))) for _ in range(60)})
        for folder in ["", "a", "sub", "gen/sub"]:
            text = "\n".join(f"{r.choice(globs)} {r.choice(values)}" for _ in range(r.randint(1, 5))) + "\n# end\n"
            (root / folder).mkdir(parents=True, exist_ok=True)
            (root / folder / ".gitattributes").write_text(text)
            n += 1
            files.append((n, f"r{k}", f"{folder}/.gitattributes".lstrip("/"), 1))
            contents.append((n, "", text))
        asked = subprocess.run(["git", "-C", str(root), "check-attr", "-z", "--stdin", "linguist-generated"], input="\0".join(paths), capture_output=True, text=True, check=True).stdout.split("\0")
        told = {asked[i]: {"set": True, "unset": False, "true": True, "false": False, "unspecified": None}[asked[i + 2]] for i in range(0, len(asked) - 2, 3)}
        for p in paths:
            n += 1
            files.append((n, f"r{k}", p, 1))
            want[n] = told[p]
    f = spark.createDataFrame([x[:3] for x in files], "file_id bigint, root string, path string")
    rules = A.attribute_rules(f, spark.createDataFrame(contents, CONTENTS))
    got = {x["file_id"]: x["generated"] for x in A.declared(f, rules).collect()}
    assert {i: got.get(i) for i in want} == want and len({*want.values()}) == 3


def test_equivalents_are_mined_and_hold_elsewhere(spark):
    """Twelve repositories declare their layout by globs of their own; twenty others have the same layout and declare nothing."""
    r = random.Random(4)
    made, hand = ["stubs/{}.ts", "copied/kit/{}.c", "src/{}_wire.go", "{}.tmpl.py"], ["src/{}.go", "core/{}.ts", "lib/{}.c", "{}.py"]
    styles = ["stubs/** linguist-generated\ncopied/** linguist-vendored\n*_wire.go linguist-generated\n*.tmpl.py linguist-generated", "/stubs/*.ts linguist-generated\n/copied/*/* linguist-vendored\nsrc/*_wire.go linguist-generated\n/*.tmpl.py linguist-generated=true"]
    files, contents, truth = [], [], {}
    for k in range(32):
        if k < 12:
            contents.append((len(files), "", styles[k % 2]))
            files.append((len(files), f"r{k}", ".gitattributes", 1))
        for is_made, shapes in ((True, made), (False, hand)):
            for shape in shapes:
                for _ in range(r.randint(1, 4)):
                    truth[len(files)] = is_made
                    files.append((len(files), f"r{k}", shape.format(f"{r.choice('pqst')}{r.randint(0, 99)}"), 1))
    rows = A.classify(spark.createDataFrame([(*x, "", "") for x in files], FILES), spark.createDataFrame(contents, CONTENTS)).collect()
    elsewhere = [x for x in rows if int(x["root"][1:]) >= 12]
    assert all((x["reason"] is not None) == truth[x["file_id"]] for x in elsewhere)
    assert {x["evidence"] for x in elsewhere} == {None, "mined pattern"}


def test_shapes_of_lines(spark):
    code = "\n".join(f"    total = total + price[{i}] * count" for i in range(40))
    dense = "".join(f"function f{i}(a,b){{return a.c[{i}]?b(a):a.d()}}" for i in range(60))
    cases = {
        1: (code + "\n# " + "see the notes " * 40 + "\n", False),  # one long line among others
        2: (dense, True), 3: ("\n".join(dense[i : i + 150] for i in range(0, len(dense), 150)), True),  # minified, and wrapped
        4: ("\n".join("a sentence of plain prose that goes on for rather long, as texts without line breaks do, " * 2 for _ in range(9)), False), 5: ("", False), 6: (None, False), 7: ("x", False),
    }
    df = spark.createDataFrame([(i, t) for i, (t, _) in cases.items()], "id int, content string")
    assert {x["id"]: x["d"] for x in df.select("id", A.by_text(df["content"])["dense"].alias("d")).collect()} == {i: d for i, (_, d) in cases.items()}


def test_attribute_files_and_precedence(spark):
    files = [
        (1, "R", ".gitattributes", 10), (2, "R", "sub/.gitattributes", 10), (3, "R", "api/a.gen.txt", 5), (4, "R", "api/b.txt", 5), (5, "R", "sub/lib/c.c", 5), (6, "R", "sub/lib/keep.c", 5),
        (7, "R", "sub/x.pb.go", 5), (8, "S", "api/b.txt", 5), (9, "R", "third_party/own.c", 5),
    ]
    contents = [
        (1, "", "# marks\napi/* linguist-generated\napi/b.txt -linguist-generated\n*.pb.go linguist-generated\nthird_party/** linguist-vendored=false\n"),
        (2, "", "lib/** linguist-vendored=true\nlib/keep.c linguist-vendored=false\n*.pb.go -linguist-generated\n"),
        (4, "", "// Code generated by x. DO NOT EDIT.\n"),
    ]
    got = found(spark, files, contents)
    assert got == {1: None, 2: None, 3: "declared", 4: None, 5: "declared", 6: None, 7: None, 8: None, 9: None}


def test_patterns_shared_by_repositories(spark):
    files = [(i, f"R{i}", ".gitattributes", 1) for i in range(3)] + [(10, "S", "wire/x_stub.ts", 9), (11, "S", "wire/hand.ts", 9)]
    got = found(spark, files, [(i, "", "*_stub.ts linguist-generated") for i in range(3)])
    assert got[10] == "declared" and got[11] is None


def test_texts(spark):
    cases = [
        ("a.py", "# Code generated by tool. DO NOT EDIT.\nx = 1\n", "generated"), ("b.py", "x = 1\n\n\n\n\n\n# emit() puts \"DO NOT EDIT\" on top\n", None), ("c.c", "/* Part of zlib 1.2.13, see COPYING */\nint x;\n", "vendored"),
        ("d.js", "!function(a){" + "a=b(c);" * 100 + "}();", "minified-or-data"), ("e.py", "ROWS = [\n" + "  1, 2, 3, 4, 5,\n" * 20, "minified-or-data"), ("f.go", "// output is generated lazily\nfunc f() {}\n", None),
        ("g.c", "A_LIMIT = 5\nB_LIMIT = 7\nC_LIMIT = 9\nD = 1\nE = 2\nF = 3\nG = 4\nH = 5\nI = 6\n", None), ("web/js/h.min.js", None, "generated"), ("shop/vendors/list.py", "x\n", None), (None, None, None), ("i.py", "", None),
        ("  .\\node_modules\\m\\i.js ", None, "vendored"),
    ]
    got = found(spark, [(i, "/r", p, None) for i, (p, _, _) in enumerate(cases)], [(i, "", t) for i, (_, t, _) in enumerate(cases)])
    assert got == {i: r for i, (_, _, r) in enumerate(cases)}


def test_names_of_packages_are_mined(spark):
    note = "// copied unchanged from zed 1.2.3, local fixes go upstream\n"
    files = [(i, f"R{i}", f"src/zed-1.{i}.0.js", 1) for i in range(5)] + [(9, "S", "lib/zed.ts", 1), (10, "S", "lib/zedder.ts", 1)]
    got = found(spark, files, [(i, "", note) for i in range(5)])
    assert got[9] == "vendored" and got[10] is None


def test_empty_and_repeated(spark):
    assert found(spark, [], []) == {}
    assert found(spark, [(1, "R", "a/b.go", 1), (1, "R", "./a/b.go", None)], [(1, "", "package a\n"), (1, "", None)]) == {1: None}


def test_notices_behind_a_licence(spark):
    licence = [" * Licensed to whom it may concern."] * 400
    notes = {
        1: "\n".join(["/*", *licence, " */", "", "// Code generated by tool. DO NOT EDIT.", "package x"]), 2: "\n".join(["# Licence"] * 9 + ["# upstream: https://example.org/x", "x = 1"]),
        3: "\n".join(["# Licence"] * 9 + ["x = 1", "# generated by hand", "# do not edit"]), 4: "\n".join(["#include <a.h>"] * 9 + ["/* do not edit */"]),
    }
    df = spark.createDataFrame(list(notes.items()), "id int, content string")
    says = A.by_text(df["content"])
    assert {r["id"]: (r["p"], r["o"]) for r in df.select("id", says["by_program"].alias("p"), says["by_others"].alias("o")).collect()} == {1: (True, False), 2: (False, True), 3: (False, False), 4: (False, False)}
