"""Rust modules and paths: which file a module declaration names, and which file a path leads to.

The module tree is grown level by level, one join of the last level's files with their declarations a round,
and paths are walked part by part in the same way. "Exactly one or nothing" holds throughout: a
declaration with two candidate files, or a file that lies at two places of a tree, leads nowhere.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlens.functions.paths import dir_name
from arborlens.scratch import cut

#: Nesting of braces in a use declaration that is followed.
DEPTH = 64
#: Module levels and path parts that are followed; real trees have a dozen.
LEVELS = 64

_NAME = re.compile(r"(?:r#)?[^\W\d]\w*$")
_ITEM = re.compile(r"\s*([{},]|::|\*|\bas\b\s+(?:r#)?\w+|(?:r#)?[^\W\d]\w*|\S)")


def use_paths(text: str | None) -> list[str]:
    """The paths that the tree of a ``use`` declaration names, aliases and globs off; [] for an outside crate or a malformed tree."""
    tokens = _ITEM.findall((text or "").strip().rstrip(";"))
    if not tokens or tokens[0] not in ("crate", "self", "super"):
        return []
    at = 0

    def tree(prefix: tuple[str, ...], depth: int) -> list[tuple[str, ...]]:
        """One item of a tree, from the token at hand."""
        nonlocal at
        if depth > DEPTH:
            raise ValueError
        path, start = list(prefix), at
        while at < len(tokens):
            t = tokens[at]
            if t == "{":
                if at == start and not prefix or at > start and tokens[at - 1] != "::":
                    raise ValueError
                at += 1
                out = []
                while tokens[at] != "}":
                    out += tree(tuple(path), depth + 1)
                    if tokens[at] == ",":
                        at += 1
                        if tokens[at] == ",":
                            raise ValueError
                    elif tokens[at] != "}":
                        raise ValueError
                if not out:
                    raise ValueError
                at += 1
                return out
            if t == "*" or t == "self" and path and at == start:
                at += 1
                break
            if not _NAME.match(t) or t == "as":
                raise ValueError
            path.append(t)
            at += 1
            if at < len(tokens) and tokens[at] == "::":
                at += 1
                continue
            break
        if at == start:
            raise ValueError
        if tokens[at - 1] == "::":
            raise ValueError
        if at < len(tokens) and re.match(r"as\b\s", tokens[at]):
            at += 1
        return [tuple(path)]

    try:
        found = tree((), 0)
        if at != len(tokens):
            return []
    except (ValueError, IndexError):
        return []
    return list(dict.fromkeys("::".join(p) for p in found))


def cargo(text: str | None) -> dict:
    """name, lib, members, exclude of a Cargo.toml, and its local dependencies as (alias, path, kind, optional)."""
    out: dict = {"name": "", "lib": "", "members": [], "exclude": [], "dependencies": []}
    section, pending = "", ""
    for raw in (text or "").split("\n"):
        line = re.sub(r"""^((?:[^"#]|"(?:[^"\\]|\\.)*")*)#.*$""", r"\1", raw).strip()
        line = pending + line
        pending = ""
        if re.match(r"^\[+[^\[\]]+\]+$", line):
            section = line.strip("[] ")
            continue
        key, eq, value = line.partition("=")
        key, value = key.strip(), value.strip()
        if not eq:
            continue
        if value.startswith("[") and "]" not in value:
            pending = line
            continue
        words = re.findall(r'"((?:[^"\\]|\\.)*)"', value)
        if (section, key) == ("package", "name") and words:
            out["name"] = words[0]
        elif (section, key) == ("lib", "path") and words:
            out["lib"] = words[0]
        elif section == "workspace" and key in ("members", "exclude"):
            out[key] = words
        elif (kind := re.fullmatch(r"(?:(dev|build)-)?dependencies", section)) and (path := re.search(r'\bpath\s*=\s*"([^"]*)"', value)):
            out["dependencies"].append((key.replace("-", "_"), path[1], kind[1] or "normal", "optional = true" in value))
    return out


def crates(files: DataFrame) -> DataFrame:
    """(root, dir, crate, lib, dependencies) of the packages of each tree; ``files``: root, path, content."""
    parse = F.udf(lambda t: (c := cargo(t)) and (c["name"], c["lib"], c["dependencies"]), "struct<name:string,lib:string,dependencies:array<struct<alias:string,path:string,kind:string,optional:boolean>>>")  # manifests only
    own = files.filter(F.col("path").rlike(r"(^|/)Cargo\.toml$")).select("root", dir_name(F.col("path")).alias("dir"), parse("content").alias("c")).filter(F.col("c.name") != "")
    lib = F.when(F.col("c.lib") != "", F.col("c.lib")).otherwise("src/lib.rs")
    return own.select("root", "dir", F.replace(F.col("c.name"), F.lit("-"), F.lit("_")).alias("crate"), _below(F.col("dir"), lib).alias("lib"), F.col("c.dependencies").alias("dependencies"))


def _below(directory: Column, name: Column) -> Column:
    return F.when(directory == "", name).otherwise(F.concat_ws("/", directory, name))


def module_tree(tops: DataFrame, declared: DataFrame, files: DataFrame) -> DataFrame:
    """(root, top, file, parent, name, base): the place of every file that a target's module tree reaches once.

    ``tops``: root, top (the root file of a target); ``declared``: root, file, name, explicit (a path from an
    attribute, or null); ``files``: root, path. A module is ``base/name.rs`` or ``base/name/mod.rs``, if
    only one of them exists; its own children lie below ``base/name``. Files at two places are left out.
    """
    there = cut(files.filter(F.col("path").endswith(".rs")).select("root", F.col("path").alias("child")).distinct(), "rust")
    named = cut(declared.distinct(), "declared")
    level = cut(tops.select("root", "top", F.col("top").alias("file"), F.lit(None).cast("string").alias("parent"), F.lit("").alias("name"), dir_name(F.col("top")).alias("base")).join(there.withColumnRenamed("child", "file"), ["root", "file"]).select("root", "top", "file", "parent", "name", "base").distinct(), "level")
    whole = level
    for _ in range(LEVELS):
        inner = _below(F.col("base"), F.col("n"))
        asked = level.select("root", "top", "file", "base").join(named.select("root", "file", F.col("name").alias("n"), "explicit"), ["root", "file"])
        tries = F.when(F.col("explicit").isNotNull(), F.array(_below(dir_name(F.col("file")), F.col("explicit")))).otherwise(F.array(F.concat(inner, F.lit(".rs")), F.concat(inner, F.lit("/mod.rs"))))
        met = asked.select("root", "top", "file", "n", F.when(F.col("explicit").isNull(), inner).alias("inner"), F.explode(tries).alias("child")).join(there, ["root", "child"])
        one = met.groupBy("root", "top", "file", "n").agg(F.count_distinct("child").alias("k"), F.first("child").alias("child"), F.first("inner").alias("inner")).filter("k = 1")
        found = one.select("root", "top", F.col("child").alias("file"), F.col("file").alias("parent"), F.col("n").alias("name"), F.coalesce("inner", dir_name(F.col("child"))).alias("base"))
        level = cut(found.join(whole, ["root", "top", "file", "parent", "name", "base"], "left_anti"), "level")
        if level.isEmpty():
            break
        whole = cut(whole.unionByName(level), "modules")
    once = whole.groupBy("root", "file").agg(F.count_distinct(F.struct("top", F.coalesce("parent", F.lit("")).alias("p"), "name", "base")).alias("k")).filter("k = 1")
    return whole.join(once.select("root", "file"), ["root", "file"], "left_semi")


def walk(paths: DataFrame, tree: DataFrame, packages: DataFrame) -> DataFrame:
    """(root, src, path, dst): where each Rust path leads: the deepest module on it that is a file.

    ``paths``: root, src, path (``crate::a::B``, ``self::``, ``super::``, a child module's or a crate's name
    first). From ``crate`` or another crate a path leads to that crate's root file at least, otherwise
    to a child module or nowhere; a name of two crates leads nowhere, and never a file to itself.
    """
    place = cut(tree, "places")
    child = place.filter(F.col("parent").isNotNull()).select("root", F.col("parent").alias("cur"), F.col("name").alias("part"), F.col("file").alias("next"))
    parts = F.split(F.regexp_replace(F.trim("path"), "^::", ""), "::")
    one = paths.select("root", "src", "path", parts.alias("parts")).filter(F.size("parts") > 1).distinct()
    here = one.join(place.select("root", F.col("file").alias("src"), "top", F.col("parent").alias("up")), ["root", "src"], "left").withColumn("head", F.element_at("parts", 1))
    tail = F.slice("parts", F.lit(2), F.size("parts"))
    by_name = packages.groupBy("root", F.col("crate").alias("head")).agg(F.count(F.lit(1)).alias("k"), F.first("lib").alias("lib")).filter("k = 1").drop("k")
    first_child = child.select("root", F.col("cur").alias("src"), F.col("part").alias("head"), F.col("next").alias("first"))
    begun = here.join(by_name, ["root", "head"], "left").join(first_child, ["root", "src", "head"], "left")
    cur = (
        F.when(F.col("head") == "crate", F.col("top")).when(F.col("head") == "self", F.when(F.col("top").isNotNull(), F.col("src"))).when(F.col("head") == "super", F.col("up")).otherwise(F.coalesce("first", "lib"))
    )
    kept = (F.col("head") == "crate") | (~F.col("head").isin("self", "super") & F.coalesce("first", "lib").isNotNull())
    state = cut(begun.select("root", "src", "path", cur.alias("cur"), tail.alias("rest"), kept.alias("kept")).filter(F.col("cur").isNotNull()), "walk")
    done = None
    for _ in range(LEVELS):
        ups = state.withColumn("part", F.try_element_at("rest", F.lit(1)))
        step = ups.join(child, ["root", "cur", "part"], "left").join(place.select("root", F.col("file").alias("cur"), F.col("parent").alias("up")), ["root", "cur"], "left")
        goes = F.when(F.col("part") == "super", F.col("up")).otherwise(F.col("next"))
        step = cut(step.withColumn("goes", goes), "step")
        over = step.filter("goes is null and kept").select("root", "src", "path", F.col("cur").alias("dst"))
        done = over if done is None else done.unionByName(over)
        state = step.filter("goes is not null").select("root", "src", "path", F.col("goes").alias("cur"), F.slice("rest", F.lit(2), F.size("rest")).alias("rest"), (F.col("part") != "super").alias("kept"))
        if state.isEmpty():
            break
        state = cut(state, "walk")
    return done.filter(F.col("dst") != F.col("src")).distinct()
