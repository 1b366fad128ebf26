"""The tables of the domain in sound form: one row a file, an event, an edge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlens.functions.paths import plain_path
from arborlens.functions.text import extension
from arborlens.operators.events import with_sound_op
from arborlens.tables import table

#: Files reported since then are the changed ones.
CHANGED_SINCE = "2016-01-25 00:00:00"
#: Look-backs are counted from here, not from the clock.
NOW = "2016-01-29 00:00:00"


def files(spark: SparkSession, d: str, *wanted: str) -> DataFrame:
    """(file_id, root, path, size, added, removed, is_new, ext): a file scanned twice counts once, with its first path in order.

    Of ``wanted`` columns beside the path no other is read or shuffled.
    """
    raw = table(spark, d, "files").filter(F.col("file_id").isNotNull())
    wanted = wanted or ("size", "added", "removed", "is_new")
    one = raw.groupBy("file_id").agg(F.min(F.struct("path", "root", *wanted)).alias("f")).select("file_id", "f.*")
    rest = [F.coalesce(c, F.lit(False)).alias(c) if c == "is_new" else F.col(c) for c in wanted]
    return one.select("file_id", "root", plain_path(F.col("path"), F.col("root")).alias("path"), *rest).withColumn("ext", extension(F.col("path")))


def contents(spark: SparkSession, d: str) -> DataFrame:
    """(file_id, content)."""
    return table(spark, d, "contents").select("file_id", "content").filter(F.col("content").isNotNull()).groupBy("file_id").agg(F.max("content").alias("content"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst): which file imports which, over all roots, by the importers and the imports that reports list."""
    # a report's own file is made plain once, not for each of its importers
    # a plain path is null if the path is: filters on plain paths would compute them twice
    raw = table(spark, d, "importers_report").filter(F.col("file").isNotNull()).select("root", plain_path(F.col("file"), F.col("root")).alias("own"), "importers", "imports")
    other = plain_path(F.col("other"), F.col("root"))
    into = raw.select("root", "own", F.explode(F.array_distinct("importers")).alias("other")).filter(F.col("other").isNotNull()).select(other.alias("src"), F.col("own").alias("dst"))
    out_of = raw.select("root", "own", F.explode(F.array_distinct("imports")).alias("other")).filter(F.col("other").isNotNull()).select(F.col("own").alias("src"), other.alias("dst"))
    return into.unionByName(out_of).distinct()


def changed(spark: SparkSession, d: str) -> DataFrame:
    """(path): files reported since :data:`CHANGED_SINCE`."""
    raw = table(spark, d, "importers_report").filter((F.col("reported_at") >= F.lit(CHANGED_SINCE).cast("timestamp_ntz")) & F.col("file").isNotNull())
    return raw.select(plain_path(F.col("file"), F.col("root")).alias("path")).distinct()


def events(spark: SparkSession, d: str, *wanted: str) -> DataFrame:
    """The sound events, each once, as first received; of ``wanted`` columns no other is read or shuffled."""
    raw = with_sound_op(table(spark, d, "fs_events"))
    wanted = wanted or ("root", "ts", "op", "path", "lines", "size", "delta", "dirty")
    cols = ["received_at", "root", *(c for c in wanted if c != "root")] if "path" in wanted else ["received_at", *wanted]
    one = raw.groupBy("event_id").agg(F.min(F.struct(*cols)).alias("e")).select("event_id", "e.*")
    one = one.withColumn("path", plain_path(F.col("path"), F.col("root"))) if "path" in wanted else one
    return one.select("event_id", *wanted)


def prompts(spark: SparkSession, d: str) -> DataFrame:
    """(id, text): every document as a request."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
