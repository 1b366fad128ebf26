"""Imports resolved to files by ranked first match.

An import becomes a short list of attempts (strategy, kind of key, key), the files an index of keys. An
attempt is one equi-join key, since endings are cut off the index's keys instead of tried on attempts, and a suffix or
directory match never compares paths with patterns. Attempts are resolved once for each distinct (root, family, kind, key): a popular import
costs one lookup, however many files make it. The lowest ending that hits a file of a language of the
same family wins, with *all* files at that key; of an import's attempts the first strategy that hits wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlens.functions.dims import LADDER
from arborlens.functions.paths import base_name, dir_name
from arborlens.functions.text import extension, family, language
from arborlens.scratch import cut

#: Strategies in order: Go package, relative path, path alias, package of a workspace, exact, suffix, directory.
GO, RELATIVE, ALIAS, WORKSPACE, EXACT, SUFFIX, DIRECTORY = range(100, 800, 100)


def _no_ext(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def index(files: DataFrame, modules: DataFrame | None = None) -> DataFrame:
    """(root, kind, key, family, path): exact paths (with and without extension, and whole only), suffixes, directories, Go packages; ``files``: root, path; ``modules``: root, module."""
    known = files.select("root", "path", family(language(F.col("path"))).alias("family")).filter(F.col("family").isNotNull()).distinct()
    parts = F.split("path", "/")
    n = F.size(parts)
    tails = F.when(n > 1, F.transform(F.sequence(F.lit(2), n), lambda i: F.array_join(F.slice(parts, i, n), "/"))).otherwise(F.array().cast("array<string>"))
    keyed = lambda kind, keys: F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))
    both = lambda keys: F.concat(keys, F.transform(keys, _no_ext))
    keys = F.concat(keyed("exact", both(F.array("path"))), keyed("whole", F.array("path")), keyed("suffix", both(tails)), keyed("dir", F.array(dir_name(F.col("path")))))
    out = known.select("root", "family", "path", F.explode(F.array_distinct(keys)).alias("k")).select("root", "k.kind", "k.key", "family", "path")
    if modules is not None:
        d = dir_name(F.col("path"))
        go = known.filter((F.col("family") == "go") & ~F.col("path").endswith("_test.go")).join(modules, "root")
        out = out.unionByName(go.select("root", F.lit("go").alias("kind"), F.when(d == "", F.col("module")).otherwise(F.concat_ws("/", "module", d)).alias("key"), "family", "path"))
    return out


def normalised(spec: Column) -> Column:
    """Quotes off; dots to ``/`` in a dotted name; Rust paths from the crate to ``/``."""
    s = F.regexp_replace(spec, "^[\"'`]+|[\"'`]+$", "")
    dotted = s.contains(".") & ~s.contains("/") & ~s.startswith(".")
    return (
        F.when(s.startswith("crate::"), F.replace(F.substring(s, 8, 10_000), F.lit("::"), F.lit("/"))).when(s.startswith("super::"), F.replace(s, F.lit("::"), F.lit("/"))).when(dotted, F.replace(s, F.lit("."), F.lit("/"))).otherwise(s)
    )


def relative(spec: Column, src: Column) -> Column:
    """The path that a relative import names from its file; going up stops at the root."""
    ups = F.length(F.regexp_extract(spec, r"^((?:\.\./)*)", 1)) / 3
    rest = F.regexp_replace(F.regexp_replace(spec, r"^(?:\.\./)+", ""), r"^\./", "")
    d = F.split(dir_name(src), "/")
    base = F.array_join(F.slice(d, F.lit(1), F.greatest(F.size(d) - ups.cast("int"), F.lit(0))), "/")
    joined = F.when(base == "", rest).otherwise(F.concat_ws("/", base, rest))
    return F.regexp_replace(F.regexp_replace(joined, r"(^|/)\.$", ""), r"/$", "")


def attempts(imports: DataFrame, modules: DataFrame | None = None, aliases: DataFrame | None = None, workspace: DataFrame | None = None) -> DataFrame:
    """(root, src, spec, family, strategy, kind, key) of each import; ``imports``: root, path, spec.

    Go: relative, or a package of its own module, else nothing. JavaScript: relative, aliases, then what the
    workspace resolves (``workspace``: root, src, spec, kind, key), and nothing else. Others: relative, or
    exact, suffix, directory. A file of an unknown language has no attempts.
    """
    one = imports.select("root", F.col("path").alias("src"), "spec", language(F.col("path")).alias("language")).filter(F.col("language").isNotNull() & F.col("spec").isNotNull()).distinct().withColumn("family", family(F.col("language")))
    if modules is not None:
        one = one.join(modules, "root", "left")
    else:
        one = one.withColumn("module", F.lit(None).cast("string"))
    a = lambda s, kind, key: F.struct(F.lit(s).alias("strategy"), F.lit(kind).alias("kind"), key.alias("key"))
    bare, norm = F.regexp_replace("spec", "^[\"'`]+|[\"'`]+$", ""), normalised(F.col("spec"))
    go, js = F.col("language") == "go", F.col("family") == "js"
    local = (bare == F.col("module")) | F.startswith(bare, F.concat("module", F.lit("/")))
    none = F.array().cast("array<struct<strategy:int,kind:string,key:string>>")
    rel = F.array(a(RELATIVE, "exact", relative(F.col("spec"), F.col("src"))))
    todo = F.when(F.col("spec").startswith("."), rel).when(go, F.when(F.coalesce(local, F.lit(False)), F.array(a(GO, "go", bare))).otherwise(none)).when(js, none).otherwise(F.array(a(EXACT, "exact", norm), a(SUFFIX, "suffix", norm), a(DIRECTORY, "dir", norm)))
    out = one.select("root", "src", "spec", "family", F.explode(todo).alias("a")).select("root", "src", "spec", "family", "a.*")
    if aliases is not None:
        out = out.unionByName(_by_alias(one.filter(js & ~F.col("spec").startswith(".")), aliases))
    if workspace is not None:
        w = one.filter(js).join(workspace, ["root", "src", "spec"])
        out = out.unionByName(w.select("root", "src", "spec", "family", F.lit(WORKSPACE).alias("strategy"), "kind", "key"))
    return out


def _by_alias(one: DataFrame, aliases: DataFrame) -> DataFrame:
    """Attempts by path aliases (root, pattern, nth, target): the longest prefix that matches, its targets in order, exact before suffix."""
    prefix, suffix = F.substring_index("pattern", "*", 1), F.when(F.contains(F.col("pattern"), F.lit("*")), F.substring_index("pattern", "*", -1)).otherwise(None)
    m = one.join(aliases, "root").withColumn("pre", prefix).withColumn("suf", suffix)
    star = F.col("suf").isNotNull()
    hit = F.when(star, F.startswith("spec", "pre") & F.endswith("spec", "suf") & (F.length("spec") >= F.length("pre") + F.length("suf"))).otherwise(F.col("spec") == F.col("pattern"))
    m = m.filter(hit)
    best = m.groupBy("root", "src", "spec").agg(F.max(F.struct((~star).cast("int").alias("whole"), F.length("pre").alias("n"), "pattern")).alias("b")).select("root", "src", "spec", "b.pattern")
    m = m.join(best, ["root", "src", "spec", "pattern"])
    wild = F.substr(F.col("spec"), F.length("pre") + 1, F.length("spec") - F.length("pre") - F.length("suf"))
    key = F.when(star, F.concat(F.substring_index("target", "*", 1), F.when(F.contains(F.col("target"), F.lit("*")), F.concat(wild, F.substring_index("target", "*", -1))).otherwise(""))).otherwise(F.col("target"))
    key = F.regexp_replace(key, r"^\./", "")
    keyed = m.withColumn("key", key)
    kinds = F.explode(F.array(F.struct(F.lit(0).alias("o"), F.lit("exact").alias("kind")), F.struct(F.lit(1).alias("o"), F.lit("suffix").alias("kind"))))
    # attempts by alias keep their order within the strategy
    return keyed.select("root", "src", "spec", "family", kinds.alias("k"), "nth", "key").select("root", "src", "spec", "family", (F.lit(ALIAS) + 2 * F.col("nth") + F.col("k.o")).cast("int").alias("strategy"), "k.kind", "key")


def _reaching(kind: Column, key: Column) -> Column:
    """What attempts ask for to reach a key of the index, with the order of that: the key without an ending of the ladder.

    An ending is nothing, the extension, or the name with its ``/``, so at most three need a look at a key. Nothing at all asks for ``__init__.py``.
    """
    rungs = F.create_map(*[F.lit(x) for i, e in enumerate(LADDER) for x in (e, i)])
    ends = F.filter(F.array_distinct(F.array(extension(key), F.concat(F.lit("/"), base_name(key)), F.lit(""))), lambda e: rungs[e].isNotNull() & (F.length(e) < F.length(key)))
    cuts = F.transform(ends, lambda e: F.struct(rungs[e].alias("rung"), F.left(key, F.length(key) - F.length(e)).alias("full")))
    whole = lambda full: F.array(F.struct(F.lit(0).alias("rung"), full.alias("full")))
    return F.when(~kind.isin("exact", "suffix"), whole(key)).when(key == "__init__.py", F.concat(whole(F.lit("")), cuts)).otherwise(cuts)


def _asking(kind: Column, key: Column) -> Column:
    """Keys to look up for an attempt, with their order: a directory also by its last names."""
    parts = F.split(key, "/")
    shorter = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct((i - 1).alias("rung"), F.array_join(F.slice(parts, i, F.size(parts)), "/").alias("full")))
    return F.when(kind == "dir", shorter).otherwise(F.array(F.struct(F.lit(0).alias("rung"), key.alias("full"))))


def resolve(tries: DataFrame, idx: DataFrame) -> DataFrame:
    """(root, src, spec, strategy, dst): the files of each import by its first strategy that hits.

    Go imports of a package with more than one file resolve to nothing.
    """
    tries = cut(tries, "tries")  # imports are looked through and attempts made once
    asked = tries.select("root", "family", "kind", "key").distinct()
    looked = asked.select("root", "family", "kind", "key", F.explode(_asking(F.col("kind"), F.col("key"))).alias("t")).select("root", "family", "kind", "key", F.col("t.rung").alias("step"), "t.full")
    keyed = idx.select("root", "family", "kind", "path", F.explode(_reaching(F.col("kind"), F.col("key"))).alias("t")).select("root", "family", "kind", "path", "t.rung", "t.full")
    # merged, not left to the planner: it takes the size of the files for that of the rows, which is several times as large, and would broadcast them
    hits = looked.join(keyed.hint("merge"), ["root", "family", "kind", "full"]).select("root", "family", "kind", "key", (F.col("step") + F.col("rung")).alias("rung"), "path")
    hits = cut(hits, "hits")
    first = hits.groupBy("root", "family", "kind", "key").agg(F.min("rung").alias("rung"), F.count(F.lit(1)).alias("n"))
    first = first.filter((F.col("kind") != "go") | (F.col("n") == 1)).drop("n")
    best = tries.join(first.hint("merge"), ["root", "family", "kind", "key"])
    chosen = best.groupBy("root", "src", "spec").agg(F.min(F.struct("strategy", "kind", "family", "key", "rung")).alias("b")).select("root", "src", "spec", "b.*")
    return chosen.join(hits.hint("merge"), ["root", "family", "kind", "key", "rung"]).select("root", "src", "spec", "strategy", F.col("path").alias("dst")).distinct()


def edges(resolved: DataFrame) -> DataFrame:
    """(root, src, dst), each once."""
    return resolved.select("root", "src", "dst").distinct()
