"""Logs, snapshots, configuration and skills: what a session leaves and the next one reads."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The log is read from its last so many bytes.
TAIL = 128 * 1024

CONFIG = (
    "only array<string>, exclude array<string>, depth int, mode string, budgets struct<session_start_bytes:int,diff_bytes:int,max_hubs:int>, "
    "routing struct<retrieval:struct<strategy:string,top_k:int>,subsystems:array<struct<id:string,paths:array<string>,keywords:array<string>,docs:array<string>,agents:array<string>,instructions:string>>>, "
    "drift struct<enabled:boolean,recent_commits:int,require_docs_for:array<string>>, guidance struct<missing_extension_hints:boolean,ignored_extensions:array<string>>"
)


def log_tail(logs: DataFrame, most: int = 20, tail: int = TAIL) -> DataFrame:
    """(root, nth, line): the last lines that are not blank of each log (root, content), of its last bytes, without a line cut in two."""
    raw = F.encode("content", "UTF-8")
    n = F.octet_length("content")
    cut = F.make_valid_utf8(F.substring(raw, -tail, tail).cast("string"))
    text = F.when(n > tail, F.regexp_replace(cut, r"^[^\n]*\n", "")).otherwise(F.col("content"))
    kept = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    last = F.slice(kept, F.greatest(F.size(kept) - most + 1, F.lit(1)), F.lit(most))
    return logs.select("root", F.posexplode(last).alias("pos", "line")).select("root", (F.col("pos") + 1).alias("nth"), "line")


def parsed_log(lines: DataFrame) -> DataFrame:
    """(root, nth, ts, op, path, lines, delta, dirty) of log lines; lines with fewer than three columns are left out."""
    part = F.transform(F.split("line", r"\|"), lambda x: F.trim(x))
    at = lambda i: F.try_element_at(F.col("p"), F.lit(i))
    return lines.withColumn("p", part).filter((F.size("p") >= 3) & (at(2) != "") & (at(3) != "")).select(
        "root", "nth", F.try_to_timestamp(at(1), F.lit("yyyy-MM-dd HH:mm:ss")).alias("ts"), at(2).alias("op"), at(3).alias("path"), at(4).try_cast("int").alias("lines"), F.coalesce(at(5).try_cast("int"), F.lit(0)).alias("delta"),
        F.coalesce(at(6) == "dirty", F.lit(False)).alias("dirty"),
    )


def last_operations(lines: DataFrame, files: DataFrame, most: int = 5) -> DataFrame:
    """(root, path, op, more): the last operation of each file of a log, removed files that exist again as edited; ``more`` counts those not shown."""
    last = lines.groupBy("root", "path").agg(F.lower(F.max_by("op", "nth")).alias("op")).join(files.select("root", "path", F.lit(True).alias("there")).distinct(), ["root", "path"], "left")
    w = Window.partitionBy("root").orderBy("path")  # rows of a log's tail only
    rows = last.withColumn("nth", F.row_number().over(w)).withColumn("more", F.greatest(F.count(F.lit(1)).over(Window.partitionBy("root")) - most, F.lit(0)))
    op = F.when(F.col("op").isin("remove", "rename") & F.coalesce("there", F.lit(False)), "edited").otherwise(F.col("op"))
    return rows.filter(F.col("nth") <= most).select("root", "path", op.alias("op"), "more")


def agent_edits(logs: DataFrame, since: Column) -> DataFrame:
    """(root, session, path, at) of edit logs (root, content), one JSON a line; malformed lines and earlier records are left out."""
    one = logs.select("root", F.explode(F.split("content", "\n")).alias("line")).withColumn("r", F.from_json("line", "path string, session string, at timestamp"))
    return one.filter(F.col("r.path").isNotNull() & (F.col("r.at") >= since)).select("root", F.coalesce("r.session", F.lit("")).alias("session"), "r.path", "r.at")


def by_session(edits: DataFrame) -> DataFrame:
    """(root, session, paths): files that each named session edited."""
    return edits.filter(F.col("session") != "").groupBy("root", "session").agg(F.array_sort(F.collect_set("path")).alias("paths"))


def split_working(working: DataFrame, edits: DataFrame, session: str) -> DataFrame:
    """The working set (root, path, ...) with ``mine``: whether the session's agent edited the file."""
    own = edits.filter(F.col("session") == session).select("root", "path", F.lit(True).alias("mine")).distinct()
    return working.join(own, ["root", "path"], "left").withColumn("mine", F.coalesce("mine", F.lit(False)))


def leases(rows: DataFrame, now: Column, life: str = "24 hours") -> DataFrame:
    """(root, leases): sessions (root, session, at) that are still alive."""
    return rows.filter(F.col("at") > now - F.expr(f"interval {life}")).groupBy("root").agg(F.count_distinct("session").alias("leases"))


def write_snapshot(state: DataFrame, folder: str) -> None:
    """Replace a snapshot table (with root and updated_at)."""
    state.write.mode("overwrite").parquet(folder)


def read_snapshot(spark: SparkSession, folder: str, root: str, now: Column, alive: bool = False, fresh: str = "30 seconds") -> DataFrame:
    """The rows of a root's snapshot, unless it is stale and its writer is not alive."""
    rows = spark.read.parquet(folder).filter(F.col("root") == root)
    return rows if alive else rows.filter(F.col("updated_at") >= now - F.expr(f"interval {fresh}"))


def usable_handoffs(artifacts: DataFrame, now: Column, branch: str) -> DataFrame:
    """Hand-offs of the branch, not older than a day, that list changes."""
    return artifacts.filter((F.col("generated_at") >= now - F.expr("interval 24 hours")) & (F.col("branch") == branch) & (F.size(F.coalesce("delta.changed", F.array())) > 0))


def configs(files: DataFrame) -> DataFrame:
    """(root, config, malformed) of configuration texts (root, content); a malformed one is an empty configuration."""
    parsed = F.try_parse_json("content")
    whole = parsed.isNotNull() & F.schema_of_variant(parsed).startswith("OBJECT")
    return files.select("root", F.when(whole, F.from_json("content", CONFIG)).otherwise(F.from_json(F.lit("{}"), CONFIG)).alias("config"), ((F.coalesce(F.trim("content"), F.lit("")) != "") & ~F.coalesce(whole, F.lit(False))).alias("malformed"))


def setup_quality(files: DataFrame) -> DataFrame:
    """(root, state): missing (null content), malformed, empty, boilerplate (an allow-list only) or ready."""
    c = configs(files).join(files.select("root", "content"), "root")
    some = lambda x: F.size(F.coalesce(x, F.array())) > 0
    has = lambda x: F.coalesce(x, F.lit(0)) > 0
    g = {n: F.col(f"config.{n}") for n in "exclude only depth mode budgets.session_start_bytes budgets.diff_bytes budgets.max_hubs routing.retrieval.strategy routing.retrieval.top_k routing.subsystems drift.enabled drift.recent_commits drift.require_docs_for guidance.missing_extension_hints guidance.ignored_extensions".split()}
    rest = (
        some(g["exclude"]) | (F.trim(F.coalesce(g["mode"], F.lit(""))) != "") | has(g["budgets.session_start_bytes"]) | has(g["budgets.diff_bytes"]) | has(g["budgets.max_hubs"])
        | (F.trim(F.coalesce(g["routing.retrieval.strategy"], F.lit(""))) != "") | has(g["routing.retrieval.top_k"]) | (F.size(F.coalesce(g["routing.subsystems"], F.array())) > 0)
        | F.coalesce(g["drift.enabled"], F.lit(False)) | has(g["drift.recent_commits"]) | some(g["drift.require_docs_for"])
    )
    hints = g["guidance.missing_extension_hints"].isNotNull() | some(g["guidance.ignored_extensions"])
    empty = ~rest & ~hints & ~some(g["only"]) & ~has(g["depth"])
    state = F.when(F.col("content").isNull(), "missing").when(F.trim("content") == "", "empty").when(F.col("malformed"), "malformed").when(empty, "empty").when(~rest & some(g["only"]), "boilerplate").otherwise("ready")
    return c.select("root", state.alias("state"))


_FIELD = re.compile(r"^(\w+):\s*(.*)$")


def parse_skill(text: str, path: str) -> tuple:
    """(name, description, priority, keywords, languages, patterns, body) of a skill text with a head of fields between ``---``."""
    text = (text or "").strip()
    fields: dict = {}
    body = text
    if text.startswith("---") and (end := text.find("\n---", 3)) >= 0:
        body = text[end + 4 :].strip()
        last = None
        for line in text[3:end].split("\n"):
            if m := _FIELD.match(line.strip()):
                last, value = m[1], m[2].strip()
                fields[last] = [v.strip().strip("\"'") for v in value.strip("[]").split(",") if v.strip()] if value.startswith("[") else value.strip("\"'")
            elif line.strip().startswith("- ") and last:
                fields[last] = (fields[last] if isinstance(fields[last], list) else []) + [line.strip()[2:].strip().strip("\"'")]
    many = lambda k: fields.get(k) if isinstance(fields.get(k), list) else [fields[k]] if fields.get(k) else []
    priority = str(fields.get("priority", "0"))
    name = fields.get("name") or re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1])
    return name, fields.get("description") or "", int(priority) if priority.lstrip("-").isdigit() else 0, many("keywords"), many("languages"), many("path_patterns"), body


def skills(texts: DataFrame) -> DataFrame:
    """(name, description, priority, keywords, languages, patterns, body, source, pos) of skill texts (rank, source, path, content).

    Of skills of one name the one of the highest rank stays, at the place where the name came first.
    """
    parse = F.udf(parse_skill, "struct<name:string,description:string,priority:int,keywords:array<string>,languages:array<string>,patterns:array<string>,body:string>")  # a few short texts
    one = texts.filter(F.col("path").endswith(".md")).select("rank", "source", "path", parse("content", "path").alias("s"))
    best = one.groupBy("s.name").agg(F.max_by(F.struct("s", "source"), F.struct("rank", "path")).alias("b"), F.min(F.struct("rank", "path")).alias("pos"))
    return best.select("b.s.*", "b.source", "pos")


def manifest_files(requests: DataFrame) -> DataFrame:
    """(id, path, content) of requests (id, text) that carry files as JSON; paths that leave the tree are left out."""
    one = requests.select("id", F.explode(F.from_json("text", "files array<struct<path:string,content:string>>")["files"]).alias("f")).select("id", "f.*")
    safe = (F.col("path") != "") & ~F.col("path").startswith("/") & ~F.col("path").rlike(r"^[A-Za-z]:|(^|[/\\])\.\.([/\\]|$)")
    return one.filter(safe)
