"""Hand-offs between sessions: what changed, what is at risk, what happened, and hashes that tell if anything is new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlens.operators.ranged import with_previous

#: Endings of binary files and directories of tools, which no hand-off lists.
BINARY = (
    "exe", "dll", "bin", "o", "a", "so", "dylib", "wasm", "class", "jar", "zip", "tar", "gz", "7z", "png", "jpg", "jpeg", "gif", "webp", "ico",
    "bmp", "tiff", "mp3", "wav", "ogg", "mp4", "mov", "avi", "log", "out", "pdf", "ttf", "otf", "woff", "woff2",
)
TOOLS = (".git", ".arborlens", "node_modules", "vendor", "dist", "build", "target", "__pycache__", ".next", ".nuxt")


def listed(path: Column, content: Column | None = None) -> Column:
    """Whether a changed path is listed: not of a tool, not binary by its ending, no NUL in its first 2048 bytes."""
    ending = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    ok = ~F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(t) for t in TOOLS])) & ~ending.isin(*BINARY)
    if content is not None:
        ok = ok & ~F.contains(F.coalesce(F.left(content, F.lit(2048)), F.lit("")), F.lit("\u0000"))
    return ok


def canonical(row: Column) -> Column:
    """The hash of a struct by its JSON, null fields included."""
    return F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256)


def digest(rows: DataFrame, *columns: str) -> DataFrame:
    """One row (hash) that tells whether two tables hold the same rows, in whatever order; nothing is collected."""
    h = F.xxhash64(*columns)
    return rows.agg(chained(F.count(F.lit(1)), F.coalesce(F.bit_xor(h), F.lit(0)), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0))).alias("hash"))


def chained(*parts: Column) -> Column:
    """The hash of texts, each followed by ``:``."""
    return F.sha2(F.concat(*[x for p in parts for x in (F.coalesce(p.cast("string"), F.lit("")), F.lit(":"))]), 256)


def metrics(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """(key, order, bytes, reused_bytes, prefix_reused, delta_reused, ratio): what a snapshot shares with the one before.

    ``rows``: key, order, prefix_hash, delta_hash, prefix_bytes, delta_bytes.
    """
    same = lambda c: F.coalesce(F.col("has_prev") & (F.col(c) == F.col(f"prev_{c}")), F.lit(False))
    one = with_previous(rows, key, order, ["prefix_hash", "delta_hash"]).withColumn("prefix_reused", same("prefix_hash")).withColumn("delta_reused", same("delta_hash"))
    size = F.col("prefix_bytes") + F.col("delta_bytes")
    reused = F.when(F.col("prefix_reused"), F.col("prefix_bytes")).otherwise(0) + F.when(F.col("delta_reused"), F.col("delta_bytes")).otherwise(0)
    return one.select(*key, *order, size.alias("bytes"), reused.alias("reused_bytes"), "prefix_reused", "delta_reused", F.when(size > 0, reused / size).otherwise(0.0).alias("ratio"))


def promoted(new: Column, legacy: Column) -> Column:
    """A field, or what an older version called it; empty lists count as missing."""
    return F.when(F.size(F.coalesce(new, F.array())) > 0, new).otherwise(F.coalesce(legacy, F.array()))


def normalised(artifacts: DataFrame) -> DataFrame:
    """Artifacts (prefix, delta as structs, prefix_hash, delta_hash, combined_hash) with no list missing and every hash there.

    Missing lists of the delta and of the prefix become empty ones; hashes that are missing or empty are made from the content.
    """

    def whole(c: str) -> Column:
        kind = artifacts.schema[c].dataType
        return F.struct(*[(F.coalesce(F.col(f"{c}.{f.name}"), F.array().cast(f.dataType)) if f.dataType.typeName() == "array" else F.col(f"{c}.{f.name}")).alias(f.name) for f in kind.fields])

    one = artifacts.withColumns({"prefix": whole("prefix"), "delta": whole("delta")})
    kept = lambda c, made: F.coalesce(F.nullif(F.col(c), F.lit("")), made)
    one = one.withColumns({"prefix_hash": kept("prefix_hash", canonical(F.col("prefix"))), "delta_hash": kept("delta_hash", canonical(F.col("delta")))})
    return one.withColumn("combined_hash", kept("combined_hash", chained(F.col("prefix_hash"), F.col("delta_hash"))))


def write_latest(artifacts: DataFrame, folder: str, most: int = 500) -> None:
    """Store one normalised artifact a root (root, generated_at, ...): the newest, its prefix and delta apart, and a line of metrics more.

    Tables are written beside the old ones and take their place when they are whole. Of a root's lines of
    metrics the newest ``most`` stay.
    """
    spark = artifacts.sparkSession
    newest = normalised(artifacts).groupBy("root").agg(F.max_by(F.struct(*artifacts.columns), "generated_at").alias("a")).select("a.*")
    lines = newest.select("root", "generated_at", "prefix_hash", "delta_hash", "combined_hash")
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(at(f"{folder}/metrics")):
        lines = spark.read.parquet(f"{folder}/metrics").unionByName(lines).distinct()
    rank = F.row_number().over(Window.partitionBy("root").orderBy(F.desc("generated_at"), "combined_hash"))
    lines = lines.withColumn("nth", rank).filter(F.col("nth") <= most).drop("nth")
    for name, rows in {"metrics": lines, "prefix": newest.select("root", "prefix", "prefix_hash"), "delta": newest.select("root", "delta", "delta_hash"), "latest": newest}.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{name}.new")
        fs.delete(at(f"{folder}/{name}"), True)
        fs.rename(at(f"{folder}/{name}.new"), at(f"{folder}/{name}"))


def read_latest(spark, folder: str, name: str = "latest") -> DataFrame | None:
    """A stored table, or None if nothing was stored."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    return spark.read.parquet(f"{folder}/{name}") if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else None


def rendered(changed: DataFrame, risk: DataFrame, events: DataFrame, facts: DataFrame, most: int = 20) -> DataFrame:
    """(key, text): a hand-off as text. Each section (key, nth, item) lists its first ``most`` items and counts the rest; facts: key, head."""
    text = facts.select("key", F.concat(F.lit("# "), "head").alias("text"))
    for name, rows in (("Changed", changed), ("At risk", risk), ("Recent events", events)):
        per = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("nth") <= most, F.struct("nth", "item")))).alias("l"))
        more = F.when(F.col("n") > F.size("l"), F.concat(F.lit("\n... and "), (F.col("n") - F.size("l")).cast("string"), F.lit(" more"))).otherwise("")
        part = F.concat(F.lit(f"\n\n## {name}\n"), F.array_join(F.transform("l", lambda x: F.concat(F.lit("- "), x["item"])), "\n"), more)
        text = text.join(per.select("key", part.alias("part")), "key", "left").select("key", F.concat("text", F.coalesce("part", F.lit(""))).alias("text"))
    return text


def changed_from_events(diff: DataFrame, events: DataFrame) -> DataFrame:
    """(path, status): the diff's paths; if it has none, the paths of events with status ``event``."""
    none = diff.agg((F.count(F.lit(1)) == 0).alias("none"))
    seen = events.filter(F.col("op").isin("CREATE", "WRITE", "RENAME", "REMOVE")).select("path").distinct()
    extra = seen.join(F.broadcast(none), F.col("none")).select("path", F.lit("event").alias("status"))  # one row
    return diff.select("path", "status").unionByName(extra)


def edited_files(history: Column) -> Column:
    """The distinct files that an agent history's entries (files_edited: array<struct<path>>) edited, in the order first seen."""
    paths = F.flatten(F.transform(F.filter(history, lambda e: e.isNotNull() & e["files_edited"].isNotNull()), lambda e: F.transform(e["files_edited"], lambda f: f["path"])))
    return F.array_distinct(F.filter(paths, lambda p: p.isNotNull()))


def last_agents(history: Column, most: int = 20) -> Column:
    """The last entries of an agent history, at most ``most``."""
    return F.slice(history, F.greatest(F.size(history) - most + 1, F.lit(1)), F.lit(most))


def guidance(facts: DataFrame) -> DataFrame:
    """(key, next_steps, open_questions); ``facts``: changed, risk, events (counts), has_state, has_graph and any key columns."""
    kept = lambda *a: F.filter(F.array(*a), lambda s: s.isNotNull())
    some, none = F.col("changed") > 0, F.col("changed") == 0
    steps = kept(F.when(F.col("risk") > 0, F.lit("review dependents of files at risk")), F.when(some, F.lit("run tests of changed files")))
    questions = kept(
        F.when(none, F.lit("no changes found: are base and branch right?")), F.when(~F.col("has_state"), F.lit("no live state: events may be missing")),
        F.when(~F.col("has_graph"), F.lit("no import graph: files at risk may be missing")), F.when((F.col("events") == 0) & F.col("has_state"), F.lit("no recent events")),
    )
    return facts.select(*[c for c in facts.columns if c not in ("changed", "risk", "events", "has_state", "has_graph")], steps.alias("next_steps"), questions.alias("open_questions"))
