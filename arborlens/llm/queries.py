"""The queries on repeated events and on text corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlens.functions.paths import plain_path
from arborlens.llm import authored, language, leaks, packing
from arborlens.llm.runs import collapse_runs
from arborlens.operators.events import with_sound_op
from arborlens.scratch import cut
from arborlens.tables import table


#: A repeated event follows within so many microseconds, and its delta differs by so much at most.
RUN_GAP_US, RUN_DELTA = 10_000_000, 1


def _runs(spark: SparkSession, d: str, least: int) -> DataFrame:
    events = with_sound_op(table(spark, d, "fs_events").select("event_id", "root", "ts", "received_at", "op", "path", "delta"))
    return collapse_runs(
        events, key=["root"], time="ts", event_id="event_id", same=["op", "path"], near={"delta": RUN_DELTA}, max_gap_us=RUN_GAP_US,
        tie=["received_at", "op", "path", "delta"], prepare=lambda df: df.withColumn("path", plain_path(F.col("path"), F.col("root"))), least=least,
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d, 2).select("root", "first_event_id", "last_event_id")


def p1_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """Every run, single events too, with its count and duration."""
    return _runs(spark, d, 1)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return authored.classify(table(spark, d, "files"), table(spark, d, "contents")).filter(F.col("reason").isNotNull()).select("file_id")


def p4_written(spark: SparkSession, d: str) -> DataFrame:
    """The hand-written files."""
    return authored.classify(table(spark, d, "files"), table(spark, d, "contents")).filter(F.col("reason").isNull()).select("file_id", "root", "path")


def p4_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Every file with the reason why it is not hand-written, null if it is."""
    return authored.classify(table(spark, d, "files"), table(spark, d, "contents"))


def p4_partition(spark: SparkSession, d: str) -> DataFrame:
    """One row: files, files that are told one way or the other, files told both ways or twice."""
    told = authored.classify(table(spark, d, "files"), table(spark, d, "contents")).groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    files = table(spark, d, "files").select("file_id").filter(F.col("file_id").isNotNull()).distinct()
    return files.join(told, "file_id", "full").agg(F.count(F.lit(1)).alias("files"), F.count("n").alias("told"), F.count_if(F.col("n") > 1).alias("told_twice"))


def p7_checked(spark: SparkSession, d: str) -> DataFrame:
    """Of each capacity the texts that have a place, and what must not be: windows too full, texts divided without need, texts whose pieces are not all there."""
    docs, windows = table(spark, d, "documents"), table(spark, d, "pack_windows").select("window_id", "capacity_tokens")
    packed = cut(packing.pack_all(docs, windows), "packed")
    cap = F.broadcast(windows)  # a few capacities
    full = packed.filter(F.col("window").isNotNull()).groupBy("window_id", "window").agg(F.sum("tokens").alias("n")).join(cap, "window_id").groupBy("window_id").agg(F.count_if(F.col("n") > F.col("capacity_tokens")).alias("too_full"))
    texts = packed.groupBy("window_id", "doc_id").agg(F.sum("tokens").alias("n"), F.max("pieces").alias("pieces"), F.count(F.lit(1)).alias("have")).join(cap, "window_id").groupBy("window_id").agg(
        F.count(F.lit(1)).alias("texts"), F.count_if((F.col("pieces") > 1) & (F.col("n") <= F.col("capacity_tokens"))).alias("divided_without_need"), F.count_if(F.col("have") != F.greatest("pieces", F.lit(1))).alias("pieces_missing")
    )
    return texts.join(full, "window_id").select("window_id", "texts", "too_full", "divided_without_need", "pieces_missing")


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    """The place of every text in the windows of each capacity."""
    return packing.pack_all(table(spark, d, "documents"), table(spark, d, "pack_windows"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Of each capacity its windows, the tokens in them, the windows that are full, and the fewest that could hold them."""
    packed = packing.pack_all(table(spark, d, "documents"), table(spark, d, "pack_windows")).filter(F.col("window").isNotNull())
    one = packed.groupBy("window_id", "window").agg(F.sum("tokens").alias("tokens"))
    cap = table(spark, d, "pack_windows").select("window_id", "capacity_tokens")
    return one.join(F.broadcast(cap), "window_id").groupBy("window_id", "capacity_tokens").agg(
        F.count(F.lit(1)).alias("windows"), F.sum("tokens").alias("tokens"), F.count_if(F.col("tokens") == F.col("capacity_tokens")).alias("full_windows"),
        F.ceil(F.sum("tokens") / F.first("capacity_tokens")).alias("least_windows"), F.max("tokens").alias("most_tokens"),
    )


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_checked(spark: SparkSession, d: str) -> DataFrame:
    """One row: whether there are pairs of :func:`p8_found`, and how many of them a plain alignment of the whole item with the whole text does not confirm."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    items = table(spark, d, "eval_items").select("item_id", F.col("text").alias("said"))
    found = cut(p8_found(spark, d), "leaks")
    pairs = found.join(items, "item_id").join(docs, "doc_id").select("said", "text")
    # few pairs, each of which takes long: spread over all cores
    sure = leaks.confirmed(pairs.repartition(4 * spark.sparkContext.defaultParallelism))
    return sure.agg((F.count(F.lit(1)) > 0).alias("some"), F.count_if(~F.col("sure")).alias("doubtful"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return language.cases(table(spark, d, "documents"), table(spark, d, "lang_samples")).select("doc_id", F.col("para_no").cast("bigint").alias("para_no"), "lang")


def p9_languages(spark: SparkSession, d: str) -> DataFrame:
    """Every document and paragraph with its language, confidence and words."""
    return language.identify(table(spark, d, "documents"), table(spark, d, "lang_samples"))


QUERIES = {f.__name__: f for f in (p1_found, p1_collapsed, p4_found, p4_written, p4_reasons, p4_partition, p7_packed, p7_fill, p7_checked, p8_found, p8_checked, p9_found, p9_languages)}
