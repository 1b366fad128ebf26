"""The import graph as a table of edges (src imports dst): degrees, hubs, neighbours, changes and what they touch.

Depth is one throughout, so an edge table and joins on it are all that is needed; hubs are heavy keys and
are only ever counted, or joined as a small semi-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborlens.functions.dims import HUB, RISK, STATUSES
from arborlens.functions.paths import dir_name
from arborlens.functions.text import is_test


def degrees(edges: DataFrame) -> DataFrame:
    """(path, importers, imports, counted): in- and out-degree, and importers that are no tests."""
    both = edges.select(F.col("dst").alias("path"), F.lit(1).alias("i"), F.lit(0).alias("o"), (~is_test(F.col("src"))).cast("int").alias("c")).unionByName(
        edges.select(F.col("src").alias("path"), F.lit(0).alias("i"), F.lit(1).alias("o"), F.lit(0).alias("c"))
    )
    return both.groupBy("path").agg(F.sum("i").alias("importers"), F.sum("o").alias("imports"), F.sum("c").alias("counted"))


def hubs(edges: DataFrame, kind: str = "graph", least: int = HUB) -> DataFrame:
    """(path, importers) of hubs. Four definitions are in use and must not be mixed.

    ``graph``: importers that are no tests, and the file is no test. ``all``: all importers count. ``report``:
    importers that are no tests, whatever the file is. ``shown``: as ``all``, among the edges given, from 2 on.
    """
    if kind == "shown":
        least = 2
    counted = F.lit(True) if kind in ("all", "shown") else ~is_test(F.col("src"))
    rows = edges.filter(counted) if kind not in ("all", "shown") else edges
    if kind == "graph":
        rows = rows.filter(~is_test(F.col("dst")))
    return rows.groupBy(F.col("dst").alias("path")).agg(F.count(F.lit(1)).alias("importers")).filter(F.col("importers") >= least)


def top_importers(edges: DataFrame, hub_rows: DataFrame, most: int = 3) -> DataFrame:
    """(path, importers, src, nth): each hub's first importers by name."""
    rows = edges.withColumnRenamed("dst", "path").join(hub_rows, "path")
    # of each hub a task keeps its first few importers before they are shuffled
    nth = F.row_number().over(Window.partitionBy("path").orderBy("src"))
    return rows.withColumn("nth", nth).filter(F.col("nth") <= most).select("path", "importers", "src", "nth")


def connected(edges: DataFrame, key: list[str] = ()) -> DataFrame:
    """(key, path, other): whatever a file imports or is imported by, itself left out."""
    one = edges.select(*key, F.col("src").alias("path"), F.col("dst").alias("other"))
    two = edges.select(*key, F.col("dst").alias("path"), F.col("src").alias("other"))
    return one.unionByName(two).filter(F.col("path") != F.col("other")).distinct()


def hub_imports(edges: DataFrame, hub_rows: DataFrame) -> DataFrame:
    """(src, dst) where dst is a hub."""
    return edges.join(hub_rows.select(F.col("path").alias("dst")), "dst", "left_semi").select("src", "dst")


def importers_report(edges: DataFrame, files: DataFrame, shown: int = 500) -> DataFrame:
    """(path, importer_count, shown, truncated, omitted, imports, hub_imports, is_hub) of each of ``files`` (path)."""
    d = degrees(edges)
    hub_rows = hubs(edges)
    hub_side = hub_imports(edges, hub_rows).groupBy(F.col("src").alias("path")).agg(F.count(F.lit(1)).alias("hub_imports"))
    one = files.select("path").distinct().join(d, "path", "left").join(hub_side, "path", "left").join(hub_rows.select("path", F.lit(True).alias("is_hub")), "path", "left")
    n = F.coalesce("importers", F.lit(0))
    return one.select(
        "path", n.alias("importer_count"), F.least(n, F.lit(shown)).alias("shown"), (n > shown).alias("truncated"), F.greatest(n - shown, F.lit(0)).alias("omitted"),
        F.coalesce("imports", F.lit(0)).alias("imports"), F.coalesce("hub_imports", F.lit(0)).alias("hub_imports"), F.coalesce("is_hub", F.lit(False)).alias("is_hub"),
    )


def displayed(edges: DataFrame, shown: DataFrame) -> DataFrame:
    """The edges with both ends among ``shown`` (path)."""
    a = shown.select(F.col("path").alias("src")).distinct()
    return edges.join(a, "src", "left_semi").join(a.withColumnRenamed("src", "dst"), "dst", "left_semi").select("src", "dst")


# changes


def annotate(files: DataFrame, diff: DataFrame) -> DataFrame:
    """The changed files with what the diff says of them; ``diff``: path, added, removed, untracked."""
    cols = [c for c in files.columns if c not in ("is_new", "added", "removed")]
    return files.select(*cols).join(diff, "path").select(*cols, F.coalesce("untracked", F.lit(False)).alias("is_new"), F.coalesce("added", F.lit(0)).alias("added"), F.coalesce("removed", F.lit(0)).alias("removed"))


def merge_statuses(rows: DataFrame) -> DataFrame:
    """(path, status): of several statuses of a path the strongest."""
    rank = F.array_position(F.array(*[F.lit(s) for s in STATUSES]), F.col("status"))
    return rows.filter(rank > 0).groupBy("path").agg(F.max_by("status", rank).alias("status"))


def impact(imports: DataFrame, changed: DataFrame) -> DataFrame:
    """(file, used_by): imports whose last part names a changed file or a changed directory, counted by import.

    ``imports``: path, spec; ``changed``: seq, path. Of changed files with one name the last in order stands
    for it, of directories with one name the first. Self-imports and imports from the same directory do not count.
    """
    last = F.regexp_replace(F.substring_index("spec", "/", -1), r"\.[^.]*$", "")
    used = imports.select("path", last.alias("k"))
    name = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    bases = changed.groupBy(name.alias("k")).agg(F.max_by("path", "seq").alias("target"))
    dirs = changed.withColumn("d", dir_name(F.col("path"))).filter(F.col("d") != "").groupBy(F.substring_index("d", "/", -1).alias("k")).agg(F.min_by("d", "seq").alias("target"))
    a = used.join(bases, "k").filter(F.col("path") != F.col("target")).select("target")
    b = used.join(dirs, "k").filter(dir_name(F.col("path")) != F.col("target")).select(F.concat("target", F.lit("/")).alias("target"))
    counts = a.unionByName(b).groupBy("target").agg(F.count(F.lit(1)).alias("used_by"))
    return counts.select("target", F.substring_index(F.regexp_replace("target", "/$", ""), "/", -1).alias("file"), "used_by")


def impacted(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(path, via): unchanged files that import a changed one."""
    c = changed.select("path").distinct()
    return edges.join(c.withColumnRenamed("path", "dst"), "dst", "left_semi").join(c.withColumnRenamed("path", "src"), "src", "left_anti").select(F.col("src").alias("path"), F.col("dst").alias("via")).distinct()


def context(edges: DataFrame, changed: DataFrame, hub_rows: DataFrame) -> DataFrame:
    """(path, via, relation, is_hub): unchanged files that a changed one imports."""
    c = changed.select("path").distinct()
    one = edges.join(c.withColumnRenamed("path", "src"), "src", "left_semi").join(c.withColumnRenamed("path", "dst"), "dst", "left_anti")
    one = one.select(F.col("dst").alias("path"), F.col("src").alias("via")).distinct().join(hub_rows.select("path", F.lit(True).alias("h")), "path", "left")
    is_hub = F.coalesce("h", F.lit(False))
    return one.select("path", "via", F.when(is_hub, "shared_hub_dependency").otherwise("dependency").alias("relation"), is_hub.alias("is_hub"))


def blast_summary(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """One row: changed files, impacted files, changed files with dependents, the most dependents and which file has them."""
    c = changed.select("path").distinct()
    dependents = edges.withColumnRenamed("dst", "path").groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    per = c.join(dependents, "path", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    totals = per.agg(
        F.count(F.lit(1)).alias("changed"), F.count_if(F.col("n") > 0).alias("with_dependents"), F.max("n").alias("most_dependents"), F.min(F.struct((-F.col("n")).alias("m"), "path")).alias("top")
    )
    hit = impacted(edges, c).agg(F.count_distinct("path").alias("impacted"))
    return totals.join(F.broadcast(hit), F.lit(True), "left").select("changed", "impacted", "with_dependents", "most_dependents", F.when(F.col("most_dependents") > 0, F.col("top.path")).alias("highest"))


def risk_files(edges: DataFrame, changed: DataFrame, most: int | None = None) -> DataFrame:
    """(path, importers, is_hub): changed files with importers, tests included, most first."""
    one = changed.select("path").distinct().join(hubs(edges, "all", RISK), "path").select("path", "importers", (F.col("importers") >= HUB).alias("is_hub"))
    return one if most is None else one.orderBy(F.desc("importers"), "path").limit(most)


def first_changed(changed: DataFrame, risk: DataFrame, most: int) -> DataFrame:
    """(path, is_risk): files at risk first, most importers first, then the others by name, ``most`` in all."""
    one = changed.select("path").distinct().join(risk.select("path", "importers"), "path", "left")
    return one.orderBy(F.col("importers").isNull(), F.desc_nulls_last("importers"), "path").limit(most).select("path", F.col("importers").isNotNull().alias("is_risk"))


def snippets(relations: DataFrame, text: DataFrame, terms: DataFrame, most: int | None = 8, per_via: int = 2) -> DataFrame:
    """(seq, path, via, line_no, line): for each relation, in order, the first line of its file that holds the first term that any does.

    ``relations``: seq, path, via; ``text``: path, line_no, line; ``terms``: via, rank, term, whole (word or part).
    ``most`` is for the relations of one request; for many requests at once it is None, and ``per_via`` alone limits.
    """
    hits = relations.join(terms, "via").join(text, "path")
    whole = F.regexp_like(F.col("line"), F.concat(F.lit(r"\b"), F.regexp_replace("term", r"([^A-Za-z0-9_])", r"\\$1"), F.lit(r"\b")))
    hits = hits.filter(F.when(F.col("whole"), whole).otherwise(F.contains(F.col("line"), F.col("term"))))
    best = hits.groupBy("seq", "path", "via").agg(F.min_by(F.struct("line_no", "line"), F.struct("rank", "line_no")).alias("b"))
    nth = F.row_number().over(Window.partitionBy("via").orderBy("seq"))
    kept = best.withColumn("nth", nth).filter(F.col("nth") <= per_via)
    return (kept if most is None else kept.orderBy("seq").limit(most)).select("seq", "path", "via", "b.line_no", "b.line")
