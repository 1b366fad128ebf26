"""The queries on heavy keys, drifting schemas, sessions and nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlens.functions.paths import plain_path
from arborlens.operators.events import agents, with_sound_op
from arborlens.operators.heavy import distinct_members, heavy_keys
from arborlens.operators.inline import flatten, latest
from arborlens.operators.schemas import conform, file_scripts, schema_changes
from arborlens.operators.sessions import sessionize
from arborlens.scratch import cut
from arborlens.streaming.sessions import drained
from arborlens.tables import table

#: A session ends at a pause longer than this.
SESSION_GAP_US = 30 * 60 * 1_000_000
#: A file is heavy if it holds this share of all pairs.
HEAVY_SHARE = 0.01


def _importer_pairs(spark: SparkSession, d: str) -> DataFrame:
    # a plain path is null if the path is: filters on plain paths would compute them twice
    reports = table(spark, d, "importers_report").filter(F.col("file").isNotNull()).select("root", "file", "importers")
    # a report without importers keeps a null one, so that its file has a row
    one = reports.select(plain_path(F.col("file"), F.col("root")).alias("path"), "root", F.array_distinct("importers").alias("importers"))
    return one.select("path", "root", F.explode_outer("importers").alias("importer")).select("path", plain_path(F.col("importer"), F.col("root")).alias("importer"))


def _hub_pairs(spark: SparkSession, d: str) -> DataFrame:
    hubs = table(spark, d, "hub_summary").filter(F.col("path").isNotNull()).select("snapshot_id", "root", "path", "importers")
    return hubs.select(plain_path(F.col("path"), F.col("root")).alias("path"), "snapshot_id", "importers")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    a = heavy_keys(_importer_pairs(spark, d), ["path"], "importer", HEAVY_SHARE).select(F.lit("importers_report").alias("origin"), "path")
    b = heavy_keys(_hub_pairs(spark, d), ["path"], "snapshot_id", HEAVY_SHARE).select(F.lit("hub_summary").alias("origin"), "path")
    return a.unionByName(b)


def p2_importers(spark: SparkSession, d: str) -> DataFrame:
    """Every file's distinct importers, over all roots."""
    return distinct_members(_importer_pairs(spark, d), ["path"], "importer").select("path", F.col("members").alias("importers"))


def p2_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Every hub path's snapshots and the most importers it had in one."""
    return distinct_members(_hub_pairs(spark, d), ["path"], "snapshot_id", {"most_importers": F.max("importers")}).select("path", F.col("members").alias("snapshots"), "most_importers")


_RAW = ("lineage", "file_name", "file_written_at", "payload")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_changes(table(spark, d, "handoff_raw"), *_RAW).select("file_name", "change_kind", "old_path", "new_path")


def p3_moves(spark: SparkSession, d: str) -> DataFrame:
    """As p3_found, but what reappears unchanged under another parent is one move."""
    return schema_changes(table(spark, d, "handoff_raw"), *_RAW, moves=True).select("file_name", "change_kind", "old_path", "new_path")


def p3_table(spark: SparkSession, d: str) -> DataFrame:
    """All readable records in one schema, each once however often it was loaded."""
    raw = table(spark, d, "handoff_raw")
    # records without an id are told apart by all they hold; when they were loaded is not part of it
    whole = F.when(F.col("record_id").isNull(), F.struct(*[c for c in raw.columns if c != "loaded_at"]))
    raw = raw.withColumn("__whole", whole).dropDuplicates(["record_id", "__whole"]).drop("__whole")
    one = conform(raw, file_scripts(raw, *_RAW, moves=True), "lineage", "file_name", "payload", keep=["record_id"])
    get = lambda name: F.col("fields")[name]
    return one.select(
        "record_id", "lineage", "file_name", get("schema_version").alias("schema_version"), get("root").alias("root"), get("branch").alias("branch"), get("base_ref").alias("base_ref"), get("generated_at").alias("generated_at"),
        get("prefix.file_count").alias("file_count"), get("changed_files").alias("changed_files"), get("delta.changed").alias("delta_changed"), F.to_json("fields").alias("fields"), F.to_json("conflicts").alias("conflicts"),
    )


def artifact_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The hand-off artifacts, last version of each, as flat tables."""
    newest = latest(table(spark, d, "handoff_artifact"), ["artifact_id"], ["written_at"])
    # a table, so that versions are compared and histories parsed once for all tables
    return flatten(cut(newest.withColumn("agent_history", agents(F.col("agent_history"))), "artifacts"), ["artifact_id"], "artifact")


#: The column that identifies an element in each child table.
_ITEM_KEY = {"hubs": "path", "changed": "path", "risk_files": "path", "recent_events": "path", "next_steps": "value", "open_questions": "value", "agent_history": "agent_id", "files_edited": "path"}


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    tables = artifact_tables(spark, d)
    whole = None
    for child, item in _ITEM_KEY.items():
        one = tables[child].select("artifact_id", F.lit(child).alias("child"), "outer_pos", "pos", F.col(f"`{item}`").alias("item_key"))
        whole = one if whole is None else whole.unionByName(one)
    return whole


def p6_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """The table of the records themselves, with what occurs once in each inlined."""
    t = artifact_tables(spark, d)["artifact"]
    return t.select(*[F.col(f"`{c}`").alias(c.replace(".", "_")) for c in t.columns])


def p6_edits(spark: SparkSession, d: str) -> DataFrame:
    """The deepest table: single edits, with the places of the agent entry and of the file they belong to."""
    return artifact_tables(spark, d)["edits"].select("artifact_id", F.col("places")[0].alias("agent_pos"), F.col("places")[1].alias("file_pos"), "pos", "line", "delta")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_sessions(spark, d).select("root", "first_event_id", "last_event_id")


def p5_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Each root's sessions with start, end, duration and number of events."""
    events = with_sound_op(table(spark, d, "fs_events").select("event_id", "root", "ts", "op"))
    return sessionize(events, ["root"], "ts", "event_id", SESSION_GAP_US)


def p5_streamed(spark: SparkSession, d: str) -> DataFrame:
    """As p5_found, by the stream with a timer a root; no event is received later than the latest that was."""
    late = table(spark, d, "fs_events").agg(F.max(F.unix_micros(F.col("received_at").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")))).first()[0]
    lateness = max(late or 0, 0) + 60_000_000
    return drained(spark, f"{d}/fs_events.parquet", "root", "ts", "event_id", SESSION_GAP_US, lateness).select("root", "first_event_id", "last_event_id")


def p5_ambiguous_ids(spark: SparkSession, d: str) -> DataFrame:
    """One row: event ids, and those that were delivered with more than one root and time, which sessions and runs would take for several events."""
    e = with_sound_op(table(spark, d, "fs_events").select("event_id", "root", "ts", "op"))
    per = e.groupBy("event_id").agg((F.min(F.struct("root", "ts")) != F.max(F.struct("root", "ts"))).alias("several"))
    return per.agg(F.count(F.lit(1)).alias("ids"), F.count_if("several").alias("ambiguous"))


QUERIES = {f.__name__: f for f in (p2_found, p2_importers, p2_snapshots, p3_found, p3_moves, p3_table, p5_found, p5_sessions, p5_streamed, p5_ambiguous_ids, p6_found, p6_artifacts, p6_edits)}
