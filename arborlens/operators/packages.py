"""JavaScript packages of a workspace: manifests as tables, specifiers resolved by joins with them.

Each manifest is parsed once (:func:`read`), into rows of a few tables: scopes (directories with a manifest),
specifier maps (exports, imports, import maps), entry points, workspace patterns, output directories. An
import then finds the scope it lies in by its directory's ancestors, a package by its name within its workspace, and
a target by exact key or the most specific pattern. What is ambiguous resolves to nothing.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlens.functions.paths import base_name, dir_name
from arborlens.scratch import cut

#: Conditions of exports that name a file at run time, and schemes of specifiers that name none here.
RUNTIME = ("default", "import", "require", "module-sync", "node", "node-addons", "browser", "development", "production", "deno", "bun")
EXTERNAL = r"(?i)^(node|bun|npm|jsr|http|https|data):"
_TYPES = (".d.ts", ".d.mts", ".d.cts")


def plain_json(text: str | None) -> dict:
    """The object of a JSON text that may have comments and trailing commas; {} if it is none."""
    out, i, text = [], 0, text or ""
    while i < len(text):
        c = text[i]
        if c == '"':
            end = i + 1
            while end < len(text) and text[end] != '"':
                end += 2 if text[end] == "\\" else 1
            out.append(text[i : end + 1])
            i = end + 1
        elif text.startswith("//", i):
            i = (text + "\n").index("\n", i)
        elif text.startswith("/*", i):
            end = text.find("*/", i)
            i = len(text) if end < 0 else end + 2
        elif c == "," and re.match(r"(?:\s|//[^\n]*(?:\n|$)|/\*.*?\*/)*[}\]]", text[i + 1 :], re.S):
            i += 1
        else:
            out.append(c)
            i += 1
    try:
        value = json.loads("".join(out))
    except ValueError:
        return {}
    return value if isinstance(value, dict) else {}


def local(target) -> bool:
    """Whether a target is a path below its manifest: ``./`` and no way out."""
    return isinstance(target, str) and target.startswith("./") and len(target) > 2 and "\0" not in target and ".." not in target.replace("\\", "/").split("/")


def runtime_target(value) -> str | None:
    """The only file that the conditions of an export can name at run time; None if there are several or unknown conditions."""
    found: set[str] = set()
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, str):
            if not v.endswith(_TYPES):
                found.add(v)
        elif isinstance(v, dict):
            for k, x in v.items():
                if k == "types" or k.startswith("types@"):
                    continue
                if k not in RUNTIME:
                    return None
                todo.append(x)
        else:
            return None
    return found.pop() if len(found) == 1 else None


def _mapped(kind: str, key: str, target: str | None, prefix: bool = False) -> tuple:
    stars = key.count("*")
    if target is None:
        return kind, key, "exact", "", False
    if prefix:
        return kind, key, "prefix", target, target.endswith("/") and local(target)
    if stars == 0:
        return kind, key, "exact", target, local(target)
    return kind, key, "pattern", target, stars == 1 and target.count("*") == 1 and local(target)


def specifiers(doc: dict, deno: bool) -> list[tuple]:
    """(map, key, kind, target, valid) of a manifest's exports and imports."""
    out = []
    if "exports" in doc:
        e = doc["exports"]
        if isinstance(e, str):
            out.append(_mapped("exports", ".", e))
        elif isinstance(e, dict) and all(k.startswith(".") for k in e):
            out += [_mapped("exports", k, runtime_target(v)) for k, v in e.items()]
        else:
            out.append(_mapped("exports", ".", runtime_target(e) if isinstance(e, dict) else None))
    imports = doc.get("imports")
    for k, v in imports.items() if isinstance(imports, dict) else ():
        if deno:
            out.append(_mapped("deno", k, v if isinstance(v, str) else None, isinstance(v, str) and k.endswith("/")))
        elif k.startswith("#") and k != "#" and not k.startswith("#/"):
            out.append(_mapped("imports", k, v if isinstance(v, str) else runtime_target(v)))
    return out


def entry(doc: dict) -> str:
    """The one file that ``module`` and ``main`` agree on, '' if none."""
    found = set()
    for k in ("module", "main"):
        v = doc.get(k)
        if isinstance(v, str) and (v := v.strip().replace("\\", "/")) and ":" not in v and not v.startswith("/"):
            v = v if v.startswith("./") else "./" + v
            if local(v):
                found.add(v)
    return found.pop() if len(found) == 1 else ""


def workspace_regex(pattern: str) -> tuple[str, bool] | None:
    """(regular expression on a member's path, whether it excludes) of a workspace pattern; None if it is not valid."""
    pattern = pattern.strip().replace("\\", "/")
    out = pattern.startswith("!")
    pattern = pattern.removeprefix("!").strip().removeprefix("./")
    if not pattern or pattern[0] in "!/" or re.match(r"[A-Za-z]:", pattern) or ".." in pattern.split("/"):
        return None
    parts, regex = pattern.rstrip("/").split("/"), ""
    for i, p in enumerate(parts):
        if p == "**":
            regex += "(?:[^/]+/)*" if i < len(parts) - 1 else "(?:[^/]+(?:/[^/]+)*)?"
        else:
            regex += re.sub(r"\\\*", "[^/]*", re.escape(p)).replace(r"\?", "[^/]") + ("/" if i < len(parts) - 1 else "")
    return f"^{regex}/?$", out


def patterns(value, key: str) -> list[str] | None:
    """Workspace patterns of a manifest, as a list or below a key; None unless all of them are valid."""
    if isinstance(value, dict):
        value = value.get(key)
    if not isinstance(value, list) or not all(isinstance(x, str) and workspace_regex(x) for x in value):
        return None
    return value


def _rows(path: str, text: str | None) -> Iterator[tuple]:
    """Rows (table, a, b, c, d, flag, nth) of one manifest."""
    name = path.rsplit("/", 1)[-1]
    if name == "pnpm-workspace.yaml":
        inside, found = False, []
        for line in (text or "").split("\n"):
            if not line.startswith((" ", "-")):
                inside = line.strip() == "packages:"
            elif inside and line.strip().startswith("- "):
                found.append(line.strip()[2:].strip().strip("\"'"))
        for n, p in enumerate(patterns(found, "") or []):
            yield "patterns", *workspace_regex(p)[:1], "pnpm", "", "", workspace_regex(p)[1], n
        return
    doc = plain_json(text)
    if not doc:
        return
    if name == "rush.json":
        folders = [p.get("projectFolder") for p in doc.get("projects", []) if isinstance(p, dict)] if isinstance(doc.get("projects"), list) else []
        if folders and all(isinstance(f, str) and f and not f.startswith("/") and ".." not in f.split("/") for f in folders):
            for n, f in enumerate(folders):
                yield "patterns", "^" + re.escape(f.strip("/").removeprefix("./")) + "/?$", "rush", "", "", False, n
        return
    if name.startswith("tsconfig"):
        options = doc.get("compilerOptions") if isinstance(doc.get("compilerOptions"), dict) else {}
        clean = lambda v: v.strip().removeprefix("./").strip("/") if isinstance(v, str) and not v.startswith("/") and ".." not in v.split("/") else ""
        yield "outputs", clean(options.get("outDir")), clean(options.get("rootDir")), str(doc.get("extends") or ""), "", False, 0
        return
    deno = name.startswith("deno.")
    yield "scopes", doc.get("name") if isinstance(doc.get("name"), str) else "", "deno" if deno else "package", "" if deno else entry(doc), "", "exports" in doc, 0
    for kind, key, how, target, valid in specifiers(doc, deno):
        yield "specifiers", kind, key, how, target, valid, 0
    for n, p in enumerate(patterns(doc.get("workspace" if deno else "workspaces"), "members" if deno else "packages") or []):
        yield "patterns", workspace_regex(p)[0], "deno" if deno else "npm", "", "", workspace_regex(p)[1], n


MANIFESTS = ("package.json", "deno.json", "deno.jsonc", "tsconfig.json", "rush.json", "pnpm-workspace.yaml")


def read(files: DataFrame) -> DataFrame:
    """(root, dir, manifest, table, a, b, c, d, flag, nth) of all manifests; ``files``: root, path, content."""
    own = files.filter(base_name(F.col("path")).isin(*MANIFESTS)).select("root", "path", "content")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(r, p.rpartition("/")[0], p.rsplit("/", 1)[-1], *x) for r, p, t in zip(b["root"], b["path"], b["content"]) for x in _rows(p, t)]
            yield pd.DataFrame(rows, columns=["root", "dir", "manifest", "table", "a", "b", "c", "d", "flag", "nth"])

    return own.mapInPandas(work, "root string, dir string, manifest string, table string, a string, b string, c string, d string, flag boolean, nth int")


def _above(path: Column) -> Column:
    """All directories above a path, '' too."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def _nearest(one: DataFrame, scopes: DataFrame) -> DataFrame:
    """(root, src, scope): the deepest of the directories that a file lies in."""
    met = one.select("root", "src").distinct().select("root", "src", F.explode(_above(F.col("src"))).alias("dir")).join(scopes.select("root", "dir").distinct(), ["root", "dir"])
    return met.groupBy("root", "src").agg(F.max_by("dir", F.length("dir")).alias("scope"))


def members(manifests: DataFrame) -> DataFrame:
    """(root, workspace, dir, name): the packages of each workspace; of ordered patterns the last that matches decides."""
    pats = manifests.filter("table = 'patterns'").select("root", F.col("dir").alias("workspace"), F.col("a").alias("regex"), F.col("flag").alias("out"), "nth", F.col("b").alias("kind"))
    scopes = manifests.filter("table = 'scopes'").select("root", "dir", F.col("a").alias("name"))
    # a package meets the workspaces above it by equality, then their patterns
    met = scopes.select("root", "dir", "name", F.explode(F.when(F.col("dir") == "", F.array().cast("array<string>")).otherwise(_above(F.col("dir")))).alias("workspace")).join(pats, ["root", "workspace"])
    rel = F.when(F.col("workspace") == "", F.col("dir")).otherwise(F.expr("substring(dir, length(workspace) + 2)"))
    met = met.withColumn("rel", rel).filter(F.expr("rel rlike regex"))
    last = met.groupBy("root", "workspace", "dir", "name", "kind").agg(F.max_by("out", "nth").alias("out")).filter(~F.col("out"))
    owners = scopes.join(pats.select("root", F.col("workspace").alias("dir")).distinct(), ["root", "dir"]).select("root", F.col("dir").alias("workspace"), "dir", "name")
    return last.select("root", "workspace", "dir", "name").unionByName(owners).filter(F.col("name") != "").distinct()


def _mapped_target(one: DataFrame, maps: DataFrame) -> DataFrame:
    """(…one, target, valid): by exact key, else by the longest key that matches, if only one does; unmatched rows are left out.

    ``one`` has root, scope, map, asked and an id of its own (``ask``); ``maps`` has root, scope, map, key, how, to, valid.
    """
    m = one.join(maps, ["root", "scope", "map"])
    pre, suf = F.substring_index("key", "*", 1), F.substring_index("key", "*", -1)
    fits = (
        F.when(F.col("how") == "exact", F.col("asked") == F.col("key")).when(F.col("how") == "prefix", F.startswith("asked", "key"))
        .otherwise(F.startswith("asked", pre) & F.endswith("asked", suf) & (F.length("asked") >= F.length(pre) + F.length(suf)))
    )
    m = m.filter(fits)
    rest = F.when(F.col("how") == "prefix", F.substr("asked", F.length("key") + 1)).otherwise(F.substr(F.col("asked"), F.length(pre) + 1, F.length("asked") - F.length(pre) - F.length(suf)))
    target = F.when(F.col("how") == "exact", F.col("to")).when(F.col("how") == "prefix", F.concat("to", rest)).otherwise(F.concat(F.substring_index("to", "*", 1), rest, F.substring_index("to", "*", -1)))
    m = m.withColumn("target", target).withColumn("weight", F.when(F.col("how") == "exact", 1_000_000).otherwise(F.length("key")))
    best = m.groupBy("ask").agg(F.max("weight").alias("weight"))
    top = m.join(best, ["ask", "weight"]).groupBy("ask").agg(F.count(F.lit(1)).alias("n"), F.first("target").alias("target"), F.first("valid").alias("valid"))
    return one.join(top, "ask").withColumn("valid", F.col("valid") & (F.col("n") == 1)).drop("n")


def resolve_specifiers(imports: DataFrame, manifests: DataFrame) -> DataFrame:
    """(root, src, spec, kind, key) for :func:`arborlens.operators.resolve.attempts`; ``imports``: root, path, spec.

    ``#names`` go through the imports of the package a file lies in; then the nearest import map, if it
    matches; then a package of the workspace above the file, if exactly one has the name, or the file's own
    package. Exports decide where there are any; without them a subpath, or the one entry point, is a
    path below the package. Targets in the output directory are also looked for in the source directory.
    """
    js = imports.select("root", F.col("path").alias("src"), "spec").filter(F.col("path").rlike(r"\.(js|jsx|mjs|ts|tsx)$") & ~F.col("spec").rlike(EXTERNAL) & ~F.col("spec").startswith(".")).distinct()
    # each stage is used by several of the next ones: it is written once instead of being planned again for each
    js = cut(js.withColumn("ask", F.concat_ws("\u0001", "root", "src", "spec")), "specifiers")
    manifests = cut(manifests, "manifests")
    scopes = manifests.filter("table = 'scopes'")
    packages = scopes.filter("b = 'package'")
    maps = manifests.filter("table = 'specifiers'").select("root", F.col("dir").alias("scope"), F.col("a").alias("map"), F.col("b").alias("key"), F.col("c").alias("how"), F.col("d").alias("to"), F.col("flag").alias("valid")).distinct()

    own = cut(_nearest(js, packages), "scopes")
    private = js.filter(F.col("spec").startswith("#")).join(own, ["root", "src"]).withColumn("map", F.lit("imports")).withColumn("asked", F.col("spec"))
    a = _mapped_target(private, maps).filter("valid").select("root", "src", "spec", "scope", "target")

    public = js.filter(~F.col("spec").startswith("#"))
    deno = _nearest(public, scopes.filter("b = 'deno'"))
    mapped = cut(_mapped_target(public.join(deno, ["root", "src"]).withColumn("map", F.lit("deno")).withColumn("asked", F.col("spec")), maps), "mapped")
    b = mapped.filter("valid").select("root", "src", "spec", "scope", "target")

    left = public.join(mapped.select("ask"), "ask", "left_anti")
    name = F.regexp_extract("spec", r"^(@[^/]+/[^/]+|[^@/][^/]*)", 1)
    left = left.withColumn("name", name).filter(F.col("name") != "").withColumn("sub", F.regexp_replace(F.substr("spec", F.length("name") + 1), "^/", ""))
    left, known = cut(left, "names"), cut(members(manifests), "members")
    near = _nearest(left, known.select("root", F.col("workspace").alias("dir"))).withColumnRenamed("scope", "workspace")
    by_name = known.groupBy("root", "workspace", "name").agg(F.count_distinct("dir").alias("n"), F.first("dir").alias("scope")).filter("n = 1").drop("n")
    in_workspace = left.join(near, ["root", "src"]).join(by_name, ["root", "workspace", "name"]).select("ask", "root", "src", "spec", "sub", "scope")
    in_workspace = cut(in_workspace, "named")
    self_named = left.join(in_workspace.select("ask"), "ask", "left_anti").join(own, ["root", "src"]).join(packages.select("root", F.col("dir").alias("scope"), F.col("a").alias("name")), ["root", "scope", "name"]).select("ask", "root", "src", "spec", "sub", "scope")
    found = in_workspace.unionByName(self_named)
    facts = scopes.groupBy("root", F.col("dir").alias("scope")).agg(F.bool_or("flag").alias("exports"), F.max("c").alias("entry"))
    found = found.join(facts, ["root", "scope"]).withColumn("asked", F.when(F.col("sub") == "", ".").otherwise(F.concat(F.lit("./"), F.col("sub")))).withColumn("map", F.lit("exports"))
    found = cut(found, "found")
    c = _mapped_target(found.filter("exports"), maps).filter("valid").select("root", "src", "spec", "scope", "target")
    inferred = found.filter(~F.col("exports")).withColumn("target", F.when(F.col("sub") != "", F.col("asked")).otherwise(F.col("entry"))).filter((F.col("target") != "") & ~F.col("target").rlike(r"(^|/)\.\.(/|$)"))
    d = inferred.select("root", "src", "spec", "scope", "target")

    below = lambda directory, path: F.when(directory == "", path).otherwise(F.concat_ws("/", directory, path))
    target = F.regexp_replace("target", r"^\./", "")
    strict = a.unionByName(b).unionByName(c).filter(~F.col("target").rlike(r"\.d\.[mc]?ts$"))
    whole = strict.select("root", "src", "spec", "scope", "target", F.lit("whole").alias("kind"), below(F.col("scope"), target).alias("key")).unionByName(d.select("root", "src", "spec", "scope", "target", F.lit("exact").alias("kind"), below(F.col("scope"), target).alias("key")))
    whole = cut(whole, "targets")
    dirs = manifests.filter("table = 'outputs' and manifest = 'tsconfig.json' and a <> '' and b <> ''").select("root", F.col("dir").alias("scope"), F.col("a").alias("out_dir"), F.col("b").alias("source"))
    moved = whole.join(dirs, ["root", "scope"]).withColumn("t", target).filter(F.startswith("t", F.concat("out_dir", F.lit("/"))))
    moved = moved.select("root", "src", "spec", "scope", "target", F.lit("exact").alias("kind"), below(F.col("scope"), F.concat_ws("/", "source", F.regexp_replace(F.substr("t", F.length("out_dir") + 2), r"\.(mjs|cjs|jsx|js)$", ""))).alias("key"))
    return whole.unionByName(moved).select("root", "src", "spec", "kind", "key").distinct()


def aliases(files: DataFrame) -> DataFrame:
    """(root, pattern, nth, target): path aliases of tsconfig.json at the top, else jsconfig.json, base directory applied; parents' aliases are taken over."""
    own = files.filter(F.col("path").rlike(r"\.json$") & (dir_name(F.col("path")) == "")).groupBy("root").agg(F.map_from_entries(F.collect_list(F.struct("path", "content"))).alias("texts"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def options(texts: dict, name: str, depth: int = 0) -> tuple[dict, str]:
            doc = plain_json(texts.get(name))
            o = doc.get("compilerOptions") if isinstance(doc.get("compilerOptions"), dict) else {}
            paths, base = o.get("paths") if isinstance(o.get("paths"), dict) else {}, o.get("baseUrl") or ""
            if isinstance(doc.get("extends"), str) and depth < 32:
                up = doc["extends"].removeprefix("./")
                more, more_base = options(texts, up if up.endswith(".json") else up + ".json", depth + 1)
                paths, base = {**more, **paths}, base or more_base
            return paths, base

        for b in batches:
            rows = []
            for root, texts in zip(b["root"], b["texts"]):
                texts = dict(texts)
                for name in ("tsconfig.json", "jsconfig.json"):
                    paths, base = options(texts, name)
                    if paths:
                        base = base.removeprefix("./").strip("/")
                        base = "" if base == "." else base
                        rows += [(root, k, n, (base + "/" if base else "") + t.removeprefix("./")) for k, ts in paths.items() if isinstance(ts, list) for n, t in enumerate(ts) if isinstance(t, str)]
                        break
            yield pd.DataFrame(rows, columns=["root", "pattern", "nth", "target"])

    return own.mapInPandas(work, "root string, pattern string, nth int, target string")
