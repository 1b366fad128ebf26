"""Packages of a JavaScript workspace, with results worked out by hand."""

import json

from arborlens.operators import packages as P
from arborlens.operators import resolve as R


def resolved(spark, files, imports):
    rows = [("r", p, t if isinstance(t, str) or t is None else json.dumps(t)) for p, t in files.items()]
    f = spark.createDataFrame(rows, "root string, path string, content string")
    i = spark.createDataFrame([("r", p, s) for p, s in imports], "root string, path string, spec string")
    tries = R.attempts(i, aliases=P.aliases(f), workspace=P.resolve_specifiers(i, P.read(f)))
    return {(x["src"], x["spec"], x["dst"]) for x in R.resolve(tries, R.index(f)).collect()}


SAILS = {
    "name": "@regatta/sails", "exports": {".": {"types": "./out/all.d.ts", "import": "./code/all.ts"}, "./jib": "./code/jib.ts", "./rigs/*": "./code/rigs/*.ts", "./torn": {"import": "./code/port.ts", "require": "./code/starboard.ts"}},
    "imports": {"#knots/*": "./code/knots/*.ts"},
}
FILES = {
    "package.json": '{"workspaces": ["boats/*", "!boats/wreck",], // note\n}', "boats/sails/package.json": SAILS, "boats/wreck/package.json": {"name": "@regatta/wreck", "main": "hull.js"}, "boats/dinghy/package.json": {"name": "dinghy", "main": "keel/entry.js"},
    "boats/sails/code/all.ts": "", "boats/sails/code/jib.ts": "", "boats/sails/code/rigs/gaff.ts": "", "boats/sails/code/knots/bowline.ts": "", "boats/sails/code/port.ts": "", "boats/sails/code/starboard.ts": "", "boats/wreck/hull.js": "",
    "boats/dinghy/keel/entry.js": "", "boats/dinghy/oars/left.js": "", "race/start.ts": "", "boats/sails/code/crew.ts": "",
}


def test_workspace(spark):
    specs = ["@regatta/sails", "@regatta/sails/jib", "@regatta/sails/rigs/gaff", "@regatta/sails/rigs/lug", "@regatta/sails/torn", "@regatta/wreck", "#knots/bowline", "node:fs", "react", "dinghy", "dinghy/oars/left"]
    got = resolved(spark, FILES, [("race/start.ts", s) for s in specs] + [("boats/sails/code/crew.ts", "#knots/bowline"), ("boats/sails/code/crew.ts", "./jib")])
    code, start = "boats/sails/code/", "race/start.ts"
    assert got == {
        (start, "@regatta/sails", code + "all.ts"), (start, "@regatta/sails/jib", code + "jib.ts"), (start, "@regatta/sails/rigs/gaff", code + "rigs/gaff.ts"), (start, "dinghy", "boats/dinghy/keel/entry.js"),
        (start, "dinghy/oars/left", "boats/dinghy/oars/left.js"), (code + "crew.ts", "#knots/bowline", code + "knots/bowline.ts"), (code + "crew.ts", "./jib", code + "jib.ts"),
    }


def test_names_twice_and_output_directories(spark):
    files = {
        "package.json": {"name": "root-pkg", "workspaces": {"packages": ["a/**"]}, "exports": "./dist/main.js"}, "tsconfig.json": {"compilerOptions": {"outDir": "dist", "rootDir": "src"}}, "src/main.ts": "", "src/self.ts": "",
        "a/one/package.json": {"name": "twin"}, "a/two/package.json": {"name": "twin"}, "a/one/index.js": "",
    }
    got = resolved(spark, files, [("src/self.ts", "root-pkg"), ("src/self.ts", "twin")])
    assert got == {("src/self.ts", "root-pkg", "src/main.ts")}


def test_import_maps_and_other_workspaces(spark):
    files = {
        "deno.json": {"imports": {"lib/": "./src/lib/", "one": "./src/one.ts", "far": "npm:far@1", "bad": 3}}, "src/lib/x.ts": "", "src/one.ts": "", "m.ts": "", "pn/pnpm-workspace.yaml": "packages:\n  - 'p/*'\nother:\n  - q\n",
        "pn/p/k/package.json": {"name": "k", "module": "./k.mjs", "main": "k.mjs"}, "pn/p/k/k.mjs": "", "pn/use.js": "",
    }
    got = resolved(spark, files, [("m.ts", "lib/x.ts"), ("m.ts", "one"), ("m.ts", "far"), ("m.ts", "bad"), ("pn/use.js", "k")])
    assert got == {("m.ts", "lib/x.ts", "src/lib/x.ts"), ("m.ts", "one", "src/one.ts"), ("pn/use.js", "k", "pn/p/k/k.mjs")}


def test_aliases_of_configurations(spark):
    files = {
        "tsconfig.json": '{"extends": "./base", "compilerOptions": {"paths": {"@/*": ["app/*"]}}}', "base.json": {"compilerOptions": {"baseUrl": "./src", "paths": {"@/*": ["no/*"], "lib": ["lib/index.ts"]}}}, "src/app/x.ts": "", "src/lib/index.ts": "", "m.ts": ""
    }
    assert resolved(spark, files, [("m.ts", "@/x"), ("m.ts", "lib")]) == {("m.ts", "@/x", "src/app/x.ts"), ("m.ts", "lib", "src/lib/index.ts")}


def test_texts():
    assert P.plain_json('{"a": "x // y", /* c */ "b": [1, 2, ], // d\n}') == {"a": "x // y", "b": [1, 2]}
    assert P.plain_json("[1]") == {} and P.plain_json(None) == {} and P.plain_json("{") == {}
    assert P.runtime_target({"import": "./a.js", "types": "./a.d.ts"}) == "./a.js" and P.runtime_target({"import": "./a.js", "custom": "./b.js"}) is None and P.runtime_target(["./a"]) is None
    assert not P.local("../x") and not P.local("./a/../b") and not P.local("x") and P.local("./x")
    import re

    def hit(pattern, path):
        return bool(re.search(P.workspace_regex(pattern)[0], path))

    assert hit("a/*", "a/b") and not hit("a/*", "a/b/c") and hit("a/**", "a/b/c") and hit("**/x", "p/q/x") and hit("./a/?", "a/b") and P.workspace_regex("../a") is None
