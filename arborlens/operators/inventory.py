"""Files of a tree: filters, totals, directories, the largest, the commonest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlens.functions.dims import ASSETS, CODE_EXTENSIONS, CODE_NAMES, IGNORED, LARGE_TREE, MEDIUM_TREE
from arborlens.functions.paths import base_name, dir_name
from arborlens.functions.text import language, passes


def scanned(files: DataFrame, only: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """Files outside ignored directories that pass the filters."""
    ignored = F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(x) for x in IGNORED]))
    return files.filter(~ignored & passes(F.col("path"), F.col("ext"), list(only), list(exclude)))


def directories(files: DataFrame, key: list[str] = ()) -> DataFrame:
    """(key, dir, files, bytes, depth) of every directory with all below it; '' is the top.

    A file is counted once for each directory above it before anything is shuffled; the heavy top
    directories are summed by partial aggregation.
    """
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    rows = files.select(*key, F.explode(above).alias("dir"), "size")
    return rows.groupBy(*key, "dir").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).withColumn("depth", F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/"))))


def chains(files: DataFrame, key: list[str] = ()) -> DataFrame:
    """(key, dir, end): directories that hold one directory and no file, with the end of the chain they begin.

    Directories of one chain have the same files below them, so the chain's end is the deepest
    directory with as many files as its top.
    """
    d = directories(files, key)
    here = files.groupBy(*key, dir_name(F.col("path")).alias("dir")).agg(F.count(F.lit(1)).alias("own"))
    kids = d.filter(F.col("dir") != "").groupBy(*key, dir_name(F.col("dir")).alias("dir")).agg(F.count(F.lit(1)).alias("kids"))
    single = d.join(here, [*key, "dir"], "left").join(kids, [*key, "dir"], "left").withColumn("single", (F.coalesce("own", F.lit(0)) == 0) & (F.coalesce("kids", F.lit(0)) == 1))
    # each directory looks up what is above it: a chain begins where the parent is not single
    up = single.select(*key, F.col("dir").alias("up"), F.col("single").alias("up_single"))
    one = single.withColumn("up", F.when(F.col("dir") != "", dir_name(F.col("dir")))).join(up, [*key, "up"], "left")
    tops = one.filter(F.col("single") & ~F.coalesce("up_single", F.lit(False))).select(*key, F.col("dir").alias("top"), F.col("files").alias("n"))
    ends = one.filter(~F.col("single") & F.coalesce("up_single", F.lit(False)))
    above = F.transform(F.sequence(F.lit(0), F.col("depth") - 1), lambda n: F.array_join(F.slice(F.split("dir", "/"), F.lit(1), n), "/"))
    reach = ends.select(*key, F.col("dir").alias("end"), F.col("files").alias("n"), F.explode(above).alias("top")).join(tops, [*key, "top", "n"])
    return reach.groupBy(*key, "top").agg(F.min_by("end", F.length("end")).alias("end"))


def hidden_below(files: DataFrame, depth: int, key: list[str] = ()) -> DataFrame:
    """(key, dir, hidden_files, hidden_dirs): what directories at ``depth`` hold deeper down, which is not shown."""
    parts = F.split("path", "/")
    deep = files.filter(F.size(parts) > depth).select(*key, F.array_join(F.slice(parts, 1, depth), "/").alias("dir"), dir_name(F.col("path")).alias("d"))
    return deep.groupBy(*key, "dir").agg(F.count(F.lit(1)).alias("hidden_files"), F.count_distinct(F.when(F.col("d") != F.col("dir"), F.col("d"))).alias("hidden_dirs"))


def one_extension(files: DataFrame, key: list[str] = ()) -> DataFrame:
    """(key, dir, ext, files) of directories whose own files, two or more, have one extension."""
    return files.groupBy(*key, dir_name(F.col("path")).alias("dir")).agg(F.count(F.lit(1)).alias("files"), F.min("ext").alias("ext"), F.max("ext").alias("z")).filter((F.col("files") > 1) & (F.col("ext") == F.col("z"))).drop("z")


def totals(files: DataFrame) -> DataFrame:
    """One row: files, bytes, lines added and removed."""
    zero = F.lit(0)
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), zero).alias("bytes"), F.coalesce(F.sum("added"), zero).alias("added"), F.coalesce(F.sum("removed"), zero).alias("removed"))


def extensions(files: DataFrame) -> DataFrame:
    """(ext, files, bytes); a file without extension counts under its name."""
    e = F.lower("ext")
    return files.groupBy(F.when(e != "", e).otherwise(base_name(F.col("path"))).alias("ext")).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def top_extensions(files: DataFrame, most: int = 5) -> DataFrame:
    """The commonest extensions (ext, files)."""
    return files.filter(F.col("ext") != "").groupBy("ext").agg(F.count(F.lit(1)).alias("files")).orderBy(F.desc("files"), "ext").limit(most)


def asset(ext: Column) -> Column:
    """Whether an extension is none, or one of pictures, fonts, sound, archives, documents, binaries and lock files."""
    e = F.coalesce(F.lower(ext), F.lit(""))
    return (e == "") | e.isin(*ASSETS)


def common_sources(files: DataFrame, most: int = 5) -> DataFrame:
    """(ext, files, matched): the commonest extensions of source files, what a configuration would allow, and how many files all of these match."""
    few = files.filter(language(F.col("path")).isNotNull()).groupBy(F.lower("ext").alias("ext")).agg(F.count(F.lit(1)).alias("files")).orderBy(F.desc("files"), "ext").limit(most)
    return few.join(F.broadcast(few.agg(F.sum("files").alias("matched"))), F.lit(True), "left")  # ``most`` rows and one


def largest(files: DataFrame, most: int = 5) -> DataFrame:
    """The largest files that are no assets (path, size); files without extension or size do not count."""
    return files.filter(F.col("size").isNotNull() & ~asset(F.col("ext"))).select("path", "size").orderBy(F.desc("size"), "path").limit(most)


def largest_in(files: DataFrame, key: list[str], most: int = 5) -> DataFrame:
    """As :func:`largest`, for each key, with place ``nth``."""
    source = files.filter(F.col("size").isNotNull() & ~asset(F.col("ext")))
    w = Window.partitionBy(*key).orderBy(F.desc("size"), "path")
    return source.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= most).select(*key, "nth", "path", "size")


def code_only(files: DataFrame) -> DataFrame:
    """Code files, or all files if there is no code."""
    rows = files.withColumn("__code", F.lower("ext").isin(*CODE_EXTENSIONS) | base_name(F.col("path")).isin(*CODE_NAMES))
    any_code = rows.agg(F.coalesce(F.bool_or("__code"), F.lit(False)).alias("__any"))
    return rows.join(F.broadcast(any_code), F.col("__code") | ~F.col("__any")).drop("__code", "__any")  # one row


def skyline(files: DataFrame) -> DataFrame:
    """(ext, files, bytes, height): a building for each extension, 2 to 12 high by the root of its share."""
    e = extensions(code_only(files))
    ends = e.agg(F.min("bytes").alias("lo"), F.max("bytes").alias("hi"))
    ratio = F.sqrt((F.col("bytes") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1)))
    return e.join(F.broadcast(ends), F.lit(True)).select("ext", "files", "bytes", (F.lit(2) + F.floor(ratio * 10)).cast("int").alias("height"))


def arranged(buildings: DataFrame) -> DataFrame:
    """Buildings with their place from the left, the tallest in the middle; one row an extension."""
    nth = F.row_number().over(Window.orderBy(F.desc("height"), F.desc("bytes"), "ext")) - 1
    return buildings.withColumn("nth", nth).withColumn("place", F.when(F.col("nth") % 2 == 0, F.col("nth") / 2).otherwise(-(F.col("nth") + 1) / 2).cast("int")).drop("nth")


def languages(files: DataFrame, key: list[str] = ()) -> DataFrame:
    """(key, language, files)."""
    return files.withColumn("language", language(F.col("path"))).filter(F.col("language").isNotNull()).groupBy(*key, "language").agg(F.count(F.lit(1)).alias("files"))


def primary_language(files: DataFrame, key: list[str]) -> DataFrame:
    """(key, language, files) with the most files, the first by name on a tie."""
    n = languages(files, key)
    return n.groupBy(*key).agg(F.min(F.struct((-F.col("files")).alias("n"), "language")).alias("b")).select(*key, F.col("b.language").alias("language"), (-F.col("b.n")).alias("files"))


def find(files: DataFrame, text: str, only: list[str], exclude: list[str], muted: list[str] = ()) -> DataFrame:
    """(path, visible): paths that hold a text in any case; those that only the allow-list hides are told apart."""
    hit = files.filter(F.contains(F.lower("path"), F.lit(text.lower())))
    shown = passes(F.col("path"), F.col("ext"), only, exclude)
    hidden = passes(F.col("path"), F.col("ext"), [], exclude) & ~F.lower(F.regexp_replace("ext", r"^\.", "")).isin([m.removeprefix(".").lower() for m in muted] or [""])
    return hit.filter(shown | hidden).select("path", shown.alias("visible"))


def depth_for(files: Column) -> Column:
    """How deep a tree of so many files is shown: 4, 3 or 2; 2 if unknown."""
    return F.when(F.coalesce(files, F.lit(0)) <= 0, 2).when(files > LARGE_TREE, 2).when(files > MEDIUM_TREE, 3).otherwise(4)


def depth_of(argument: Column, configured: Column, files: Column) -> Column:
    """The depth that is asked for, else the configured one, else that of the tree's size; 0 and less count as none."""
    some = lambda c: F.when(c > 0, c)
    return F.coalesce(some(argument), some(configured), depth_for(files))


def budget_for(files: Column) -> Column:
    """(changed, risk, events) that a hand-off of a tree of so many files lists."""
    big, mid = files > LARGE_TREE, files > MEDIUM_TREE
    pick = lambda a, b, c: F.when(big, a).when(mid, b).otherwise(c)
    return F.struct(pick(25, 40, 60).alias("changed"), pick(8, 10, 15).alias("risk"), pick(10, 15, 25).alias("events"))


def fitted(buildings: DataFrame, width: int, each: int = 7) -> DataFrame:
    """The tallest buildings that stand side by side in ``width`` letters, at least one."""
    return buildings.orderBy(F.desc("height"), F.desc("bytes"), "ext").limit(max(1, width // each))


def system_facts(files: DataFrame, functions: DataFrame, edges: DataFrame) -> DataFrame:
    """(system, files, functions, dependencies, standalone): by the first directory; ``functions``: path, functions; ``edges``: src, dst.

    Dependencies are the edges that leave a system's files; standalone are files that neither import nor are imported.
    """
    s = F.when(F.col("path").contains("/"), F.substring_index("path", "/", 1)).otherwise(".")
    ends = edges.select(F.col("src").alias("path"), F.lit(1).alias("out")).unionByName(edges.select(F.col("dst").alias("path"), F.lit(0).alias("out"))).groupBy("path").agg(F.sum("out").alias("out"))
    one = files.select("path").distinct().join(functions.groupBy("path").agg(F.max(F.size("functions")).alias("n")), "path", "left").join(ends, "path", "left")
    return one.groupBy(s.alias("system")).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("functions"), F.coalesce(F.sum("out"), F.lit(0)).alias("dependencies"), F.count_if(F.col("out").isNull()).alias("standalone"))


def systems(files: DataFrame) -> DataFrame:
    """(system, files, bytes): by the first directory; files at the top are '.'."""
    s = F.when(F.col("path").contains("/"), F.substring_index("path", "/", 1)).otherwise(".")
    return files.groupBy(s.alias("system")).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
