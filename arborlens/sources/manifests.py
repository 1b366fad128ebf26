"""Dependency manifests, read line by line as expressions: what a tree needs from outside, and its languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlens.functions.dims import DISPLAY
from arborlens.functions.paths import base_name
from arborlens.functions.text import language

#: Languages that a manifest's name tells.
LANGUAGES = {
    "go.mod": ["go"], "package.json": ["javascript"], "Cargo.toml": ["rust"], "pyproject.toml": ["python"], "setup.py": ["python"], "requirements.txt": ["python"], "Gemfile": ["ruby"], "build.gradle": ["java"],
    "build.gradle.kts": ["kotlin", "java"], "pom.xml": ["java"], "Package.swift": ["swift"], "Podfile": ["swift"], "mix.exs": ["elixir"], "composer.json": ["php"], "build.sbt": ["scala"], "tsconfig.json": ["typescript"],
}
#: Order of languages in the view of what comes from outside.
ORDER = "go javascript python swift rust ruby bash kotlin csharp php lua scala elixir solidity".split()
#: Larger manifests are left out where a budget is asked for.
BUDGET = 1 << 20


def _kept(items: Column) -> Column:
    return F.filter(items, lambda x: x.isNotNull() & (x != ""))


def _lines(text: Column) -> Column:
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\t\r]", " ")))


def _between(text: Column, opens: str, closes: str) -> Column:
    """The lines inside blocks: from after one that matches ``opens`` to before one that matches ``closes``."""
    state = F.aggregate(
        _lines(text), F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("got")),
        lambda s, x: F.when(x.rlike(opens), F.struct(F.lit(True).alias("inside"), s["got"].alias("got"))).when(s["inside"] & x.rlike(closes), F.struct(F.lit(False).alias("inside"), s["got"].alias("got")))
        .when(s["inside"], F.struct(s["inside"].alias("inside"), F.array_append(s["got"], x).alias("got"))).otherwise(s),
    )
    return state["got"]


def go_mod(text: Column) -> Column:
    """Modules of ``require (`` blocks, indirect ones too; single-line requirements are not read."""
    return _kept(F.transform(F.filter(_between(text, r"^require \(", r"^\)$"), lambda x: ~x.startswith("//")), lambda x: F.regexp_extract(x, r"^(\S+)", 1)))


def requirements(text: Column) -> Column:
    """Names of a requirements file, without versions, extras, markers and comments."""
    names = F.transform(F.filter(_lines(text), lambda x: ~x.startswith("#")), lambda x: F.regexp_replace(x, r"(?:==|>=|<=|~=|<|>|\[|;|#).*$", ""))
    return _kept(names)


def package_json(text: Column) -> Column:
    """Names in the blocks ``dependencies`` and ``devDependencies``, read by lines."""
    inside = _between(text, r'"(?:dependencies|devDependencies)"', r"\}")
    return _kept(F.transform(F.filter(inside, lambda x: x.contains(":")), lambda x: F.regexp_replace(F.trim(F.substring_index(x, ":", 1)), '^"+|"+$', "")))


def podfile(text: Column) -> Column:
    """Names of ``pod`` lines."""
    return _kept(F.transform(F.filter(_lines(text), lambda x: x.startswith("pod ")), lambda x: F.trim(F.regexp_extract(x, r"^pod ['\"]*([^'\",]*)", 1))))


def package_swift(text: Column) -> Column:
    """Repository names of package urls."""
    return _kept(F.transform(_lines(text), lambda x: F.when(x.contains(".package("), F.regexp_replace(F.substring_index(F.regexp_extract(x, r"url:[ \"']*([^\"]*)\"", 1), "/", -1), r"\.git$", ""))))


def csproj(text: Column) -> Column:
    """Packages that a C# project references."""
    return _kept(F.transform(F.filter(_lines(text), lambda x: x.contains("<PackageReference")), lambda x: F.regexp_extract(x, r"Include=[\"']([^\"']*)[\"']", 1)))


def packages_config(text: Column) -> Column:
    """Packages that a packages.config lists."""
    return _kept(F.transform(F.filter(_lines(text), lambda x: x.contains("<package")), lambda x: F.regexp_extract(x, r"\bid=[\"']([^\"']*)[\"']", 1)))


def external(files: DataFrame, budget: int | None = None) -> DataFrame:
    """(root, language, dep, nth) of all manifests of a tree, each name once a language; ``files``: root, path, size, content."""
    name = base_name(F.col("path"))
    kinds = [
        (name == "go.mod", "go", go_mod), (name == "requirements.txt", "python", requirements), (name == "package.json", "javascript", package_json), (name == "Podfile", "swift", podfile),
        (name == "Package.swift", "swift", package_swift), (name == "packages.config", "csharp", packages_config), (name.endswith(".csproj"), "csharp", csproj),
    ]
    lang, deps = F.lit(None).cast("string"), F.array().cast("array<string>")
    for is_it, which, parse in kinds:
        lang, deps = F.when(is_it, which).otherwise(lang), F.when(is_it, parse(F.col("content"))).otherwise(deps)
    rows = files if budget is None else files.filter(F.col("size") <= budget)
    one = rows.select("root", "path", lang.alias("language"), deps.alias("deps")).filter(F.col("language").isNotNull()).select("root", "path", "language", F.posexplode("deps").alias("pos", "dep"))
    first = one.groupBy("root", "language", "dep").agg(F.min(F.struct("path", "pos")).alias("at"))
    per = first.groupBy("root", "language").agg(F.array_sort(F.collect_list(F.struct("at", "dep"))).alias("d"))
    return per.select("root", "language", F.posexplode(F.transform("d", lambda x: x["dep"])).alias("nth", "dep"))


def shown(deps: DataFrame) -> DataFrame:
    """(root, ord, line): what comes from outside, a line a language; last path parts, version parts skipped, names of one letter left out."""
    version = r"^v\d+$"
    last, before = F.substring_index("dep", "/", -1), F.substring_index(F.substring_index("dep", "/", -2), "/", 1)
    name = F.when(last.rlike(version) & F.col("dep").contains("/"), before).otherwise(last)
    one = deps.withColumn("name", name).filter(~F.col("name").rlike(version) & (F.length("name") > 1))
    per = one.groupBy("root", "language").agg(F.array_sort(F.collect_list(F.struct("nth", "name"))).alias("d"))
    label = F.initcap("language")
    for k, v in DISPLAY.items():
        label = F.when(F.col("language") == k, v).otherwise(label)
    names = F.array_distinct(F.transform("d", lambda x: x["name"]))
    order = F.array_position(F.array(*[F.lit(x) for x in ORDER]), F.col("language"))
    return per.select("root", order.alias("ord"), F.concat(label, F.lit(": "), F.array_join(names, ", ")).alias("line")).filter(F.col("ord") > 0)


def languages(files: DataFrame) -> DataFrame:
    """(root, language): by manifests at the top, C# projects, packages/*/package.json, Makefiles and source files."""
    path, name = F.col("path"), base_name(F.col("path"))
    top = ~path.contains("/")
    by_name = F.array().cast("array<string>")
    for manifest, langs in LANGUAGES.items():
        by_name = F.when(top & (name == manifest), F.array(*[F.lit(x) for x in langs])).otherwise(by_name)
    make = F.lower(F.coalesce(F.left("content", F.lit(128 * 1024)), F.lit("")))
    cpp, c = make.rlike(r"g\+\+|clang\+\+|\.cpp|\.cc"), make.contains("gcc") | (make.contains("clang") & ~make.contains("clang++"))
    some = F.concat(
        by_name, F.array(F.when(top & path.rlike(r"\.(csproj|sln)$"), "csharp"), F.when(path.rlike(r"^packages/[^/]+/package\.json$"), "javascript"), F.when((path == "Makefile") & cpp, "cpp"), F.when((path == "Makefile") & c, "c"), language(path))
    )
    return files.select("root", F.explode(some).alias("language")).filter(F.col("language").isNotNull()).distinct()


def module_name(text: Column) -> Column:
    """The module that a go.mod declares, null if none."""
    return F.nullif(F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?m)^\s*module (.*)$", 1)), F.lit(""))
