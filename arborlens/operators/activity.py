"""Edit events: activity, working set, debouncing, deltas, related hot files, bounded histories.

Whatever needs the event before another is read in ranges of (key, time), so that neither a root nor a single
file with very many events becomes one task's work. Windows rank the newest rows of a key only, of
which Spark keeps no more than asked for in each task before it shuffles, or one minute of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlens.functions.dims import HUB
from arborlens.functions.text import control, is_source
from arborlens.operators.ranged import with_previous
from arborlens.operators.sessions import sessionize

TOUCHES = ("CREATE", "WRITE")
GONE = ("REMOVE", "RENAME")


def activity(events: DataFrame, since: Column | None = None, key: list[str] = ("root",)) -> DataFrame:
    """(key, path, edits, net_delta, last_edit, dirty): CREATE and WRITE events strictly after ``since``."""
    rows = events.filter(F.col("op").isin(*TOUCHES))
    rows = rows if since is None else rows.filter(F.col("ts") > since)
    return rows.groupBy(*key, "path").agg(F.count(F.lit(1)).alias("edits"), F.coalesce(F.sum("delta"), F.lit(0)).alias("net_delta"), F.max("ts").alias("last_edit"), F.coalesce(F.bool_or("dirty"), F.lit(False)).alias("dirty"))


def activity_summary(events: DataFrame, key: list[str] = ("root",), every_op: bool = False) -> DataFrame:
    """(key, files, edits, net_delta, uncommitted). The end of a session counts all operations, a look back only touches."""
    rows = events if every_op else events.filter(F.col("op").isin(*TOUCHES))
    per = rows.groupBy(*key, "path").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("delta"), F.lit(0)).alias("d"), F.coalesce(F.bool_or("dirty"), F.lit(False)).alias("u"))
    return per.groupBy(*key).agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("edits"), F.sum("d").alias("net_delta"), F.count_if("u").alias("uncommitted"))


def newest(events: DataFrame, most: int, order: list[str] = ("ts", "path", "op", "event_id")) -> DataFrame:
    """The last ``most`` events, in order."""
    return events.orderBy(*[F.desc(c) for c in order]).limit(most).orderBy(*order)


def newest_of(events: DataFrame, key: list[str], most: int) -> DataFrame:
    """(key, nth, event_id, ts, op, path): the last ``most`` events of each key; Spark keeps only so many rows of a key in each task before it shuffles."""
    w = Window.partitionBy(*key).orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= most).select(*key, "nth", "event_id", "ts", "op", "path")


def working_set(events: DataFrame, key: list[str] = ("root",)) -> DataFrame:
    """(key, path, first_touch, last_touch, edits, net_delta) of the files touched since they were last removed or renamed."""
    at = F.struct("ts", "event_id")
    gone = events.groupBy(*key, "path").agg(F.max(F.when(F.col("op").isin(*GONE), at)).alias("gone"))
    # one pass: events and their last removal meet by (key, path), so both sides are partitioned once
    rows = events.filter(F.col("op").isin(*TOUCHES)).join(gone, [*key, "path"]).filter(F.col("gone").isNull() | (at > F.col("gone")))
    return rows.groupBy(*key, "path").agg(F.min("ts").alias("first_touch"), F.max("ts").alias("last_touch"), F.count(F.lit(1)).alias("edits"), F.coalesce(F.sum("delta"), F.lit(0)).alias("net_delta"))


def hot_files(working: DataFrame, most: int) -> DataFrame:
    """The files with the most edits, the latest first among equals."""
    return working.orderBy(F.desc("edits"), F.desc("last_touch"), *[c for c in ("root", "path") if c in working.columns]).limit(most)


def active_since(working: DataFrame, since: Column) -> DataFrame:
    """Files of a working set that were touched at ``since`` or later."""
    return working.filter(F.col("last_touch") >= since)


def working_hubs(working: DataFrame, importers: DataFrame, key: list[str] = ("root",)) -> DataFrame:
    """(key, files, hubs) of a working set; ``importers``: path, importers."""
    one = working.join(importers, "path", "left")
    return one.groupBy(*key).agg(F.count(F.lit(1)).alias("files"), F.count_if(F.coalesce("importers", F.lit(0)) >= HUB).alias("hubs"))


def debounced(events: DataFrame, window_us: int, key: list[str] = ("root", "path")) -> DataFrame:
    """(key, event_id, ts, skipped, last_of_burst): writes less than a window after the last one seen are put off.

    The gap is measured from the last write seen, so a burst extends itself; exactly a window later is
    outside. Other operations are never put off and end a burst. The first write of a burst is
    processed at once (leading edge), its last one when the burst is over (trailing edge).
    """
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = with_previous(events.select(*key, "event_id", "ts", "op"), list(key), ["ts", "event_id"], ["op", "ts"], ahead=["op", "ts"])
    write = F.col("op") == "WRITE"
    skipped = F.col("has_prev") & write & (F.col("prev_op") == "WRITE") & (us("ts") - us("prev_ts") < window_us)
    goes_on = F.col("has_next") & write & (F.col("next_op") == "WRITE") & (us("next_ts") - us("ts") < window_us)
    skipped, goes_on = F.coalesce(skipped, F.lit(False)), F.coalesce(goes_on, F.lit(False))
    return rows.select(*key, "event_id", "ts", skipped.alias("skipped"), (skipped & ~goes_on).alias("last_of_burst"))


def unchanged(events: DataFrame, key: list[str] = ("root", "path")) -> DataFrame:
    """(key, event_id) of writes with the size and number of lines of the event before them."""
    rows = with_previous(events.select(*key, "event_id", "ts", "op", "size", "lines"), list(key), ["ts", "event_id"], ["size", "lines"])
    return rows.filter(F.col("has_prev") & (F.col("op") == "WRITE") & (F.col("size") == F.col("prev_size")) & (F.col("lines") == F.col("prev_lines"))).select(*key, "event_id")


def deltas(events: DataFrame, key: list[str] = ("root", "path")) -> DataFrame:
    """(key, event_id, line_delta, size_delta): change against the last known state of a file.

    A file not known before, or removed or renamed since, counts from 0. Removal takes away what was
    known, nothing if nothing was. Events whose lines and size are not known change nothing and leave the state.
    """
    gone, known = F.col("op").isin(*GONE), F.col("lines").isNotNull() | F.col("size").isNotNull()
    n = lambda c: F.when(gone, 0).otherwise(F.coalesce(c, F.lit(0))).cast("bigint")
    told = events.filter(gone | known).select(*key, "event_id", "ts", n("lines").alias("l"), n("size").alias("s"))
    rows = with_previous(told, list(key), ["ts", "event_id"], ["l", "s"])
    d = lambda c: F.col(c) - F.coalesce(F.col(f"prev_{c}"), F.lit(0))
    zero = F.lit(0).cast("bigint")
    silent = events.filter(~gone & ~known).select(*key, "event_id", zero.alias("line_delta"), zero.alias("size_delta"))
    return rows.select(*key, "event_id", d("l").alias("line_delta"), d("s").alias("size_delta")).unionByName(silent)


def related_hot(events: DataFrame, connected: DataFrame, window_us: int) -> DataFrame:
    """(event_id, other): connected files with a CREATE or WRITE in the window before an event, in its root.

    ``connected``: root, path, other. The range join is made an equi-join on time buckets one window wide: an
    event looks into its own bucket and the one before.
    """
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    touched = events.filter(F.col("op").isin(*TOUCHES)).select("root", F.col("path").alias("other"), us.alias("t2"))
    touched = touched.withColumn("bucket", F.floor(F.col("t2") / window_us))
    asked = events.select("event_id", "root", "path", us.alias("t1")).join(connected, ["root", "path"]).filter(F.col("other") != F.col("path"))
    asked = asked.withColumn("bucket", F.explode(F.array(F.floor(F.col("t1") / window_us), F.floor(F.col("t1") / window_us) - 1)))
    near = asked.join(touched, ["root", "other", "bucket"]).filter((F.col("t2") <= F.col("t1")) & (F.col("t2") >= F.col("t1") - window_us))
    return near.select("event_id", "other").distinct()


def enriched(events: DataFrame, degree: DataFrame) -> DataFrame:
    """(event_id, importers, imports, is_hub) of each event; ``degree``: path, importers, imports."""
    one = events.select("event_id", "path").join(degree, "path", "left")
    n = F.coalesce("importers", F.lit(0))
    return one.select("event_id", n.alias("importers"), F.coalesce("imports", F.lit(0)).alias("imports"), (n >= HUB).alias("is_hub"))


def split_control(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(control events with ``control``, data events of source files): a change of ignore files or of the configuration is no edit."""
    told = events.withColumn("control", control(F.col("path")))
    return told.filter(F.col("control").isNotNull()), told.filter(F.col("control").isNull() & is_source(F.col("path"))).drop("control")


def members(events: DataFrame, start: DataFrame, key: list[str] = ("root",)) -> DataFrame:
    """(key, path) of the files that are there after some events: those at the start (key, path), with what the last event of each file did."""
    last = events.groupBy(*key, "path").agg(F.max_by("op", F.struct("ts", "event_id")).alias("op"))
    one = start.select(*key, "path", F.lit(True).alias("there")).distinct().join(last, [*key, "path"], "full")
    return one.filter(F.when(F.col("op").isNull(), F.col("there")).otherwise(~F.col("op").isin(*GONE))).select(*key, "path")


def bursts(events: DataFrame, gap_us: int = 150_000, key: list[str] = ("root",)) -> DataFrame:
    """(key, began, events, removed): events coalesced while they follow within less than a gap, flags or-ed (trailing edge)."""
    one = sessionize(events, list(key), "ts", "event_id", gap_us - 1, F.col("op") == "REMOVE")
    return one.select(*key, F.col("started_at").alias("began"), "events", (F.col("counted") > 0).alias("removed"))


def _padded(text: Column, width: int, left: bool) -> Column:
    """Filled with blanks to a width, never cut."""
    fill = F.repeat(F.lit(" "), F.greatest(F.lit(width) - F.length(text), F.lit(0)))
    return F.concat(fill, text) if left else F.concat(text, fill)


def log_line(ts: Column, op: Column, path: Column, lines: Column, delta: Column, dirty: Column) -> Column:
    """An event as a line of the log, in columns that are filled to a width."""
    change = F.when(delta > 0, F.concat(F.lit("+"), delta.cast("string"))).when(delta < 0, delta.cast("string")).otherwise("")
    return F.concat_ws(
        " | ", F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), _padded(op, 6, False), _padded(path, 40, False), _padded(F.coalesce(lines, F.lit(0)).cast("string"), 4, True),
        _padded(F.coalesce(change, F.lit("")), 6, True), F.when(dirty, "dirty").otherwise(""),
    )


def last_bytes(events: DataFrame, line: Column, most: int, key: list[str] = ("root",)) -> DataFrame:
    """(key, event_id, line): the newest whole lines of each key that fit into ``most`` bytes.

    Rows come in order by ranges of (key, time); a running sum over a key's lines is needed only among its
    newest, so lines are first summed by minute and only minutes within the budget are ordered.
    """
    rows = events.select(*key, "event_id", "ts", line.alias("line")).withColumn("n", F.octet_length("line") + 1).withColumn("slice", F.date_trunc("minute", "ts"))
    by_slice = rows.groupBy(*key, "slice").agg(F.sum("n").alias("slice_n"))
    later = Window.partitionBy(*key).orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    open_slices = by_slice.withColumn("before", F.coalesce(F.sum("slice_n").over(later), F.lit(0))).filter(F.col("before") <= most).select(*key, "slice", "before")
    w = Window.partitionBy(*key, "slice").orderBy(F.desc("ts"), F.desc("event_id"))
    kept = rows.join(open_slices, [*key, "slice"]).withColumn("total", F.col("before") + F.sum("n").over(w)).filter(F.col("total") <= most)
    return kept.select(*key, "event_id", "line")


def last_operation(events: DataFrame, files: DataFrame, key: list[str] = ("root",)) -> DataFrame:
    """(key, path, op) of the last event of each file; removed or renamed files that exist again are EDITED. ``files``: key, path."""
    last = events.groupBy(*key, "path").agg(F.max_by("op", F.struct("ts", "event_id")).alias("op"))
    there = files.select(*key, "path").distinct().withColumn("there", F.lit(True))
    return last.join(there, [*key, "path"], "left").select(*key, "path", F.when(F.col("op").isin(*GONE) & F.coalesce("there", F.lit(False)), "EDITED").otherwise(F.col("op")).alias("op"))


def gaps(events: DataFrame, key: list[str] = ("root",)) -> DataFrame:
    """(event_id, gap_us): time since the event before in the key, whatever the key's share of all events; null for the first."""
    rows = with_previous(events.select(*key, "ts", "event_id"), list(key), ["ts", "event_id"], ["ts"])
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return rows.select("event_id", F.when(F.col("has_prev"), us("ts") - us("prev_ts")).alias("gap_us"))
