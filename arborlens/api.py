"""End-user operations: each puts a few operators together and gives its results as named DataFrames.

Nothing here runs a job. Limits change what is shown, never what is counted: totals come from the whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from arborlens.functions import text as T
from arborlens.functions.dims import HUB
from arborlens.functions.paths import plain_path
from arborlens.operators import activity as A
from arborlens.operators import coverage, graph, handoff, inventory, rank

Bundle = dict[str, DataFrame]


@dataclass(frozen=True)
class Limits:
    """How much is shown."""

    changed: int = 60
    impacted: int = 12
    context: int = 8
    snippets: int = 8
    snippets_per_file: int = 2
    hubs: int = 5
    importers: int = 3
    listed: int = 500
    timeline: int = 5
    active: int = 10


def limits_from(settings: Mapping[str, str], limits: Limits = Limits(), prefix: str = "ARBORLENS_MAX_") -> Limits:
    """Limits with what settings (such as the environment) say of them, none below 0; what is no whole number says nothing."""
    told = {}
    for f in fields(limits):
        value = settings.get(prefix + f.name.upper(), "").strip()
        told[f.name] = max(0, int(value) if re.fullmatch(r"[+-]?\d+", value) else getattr(limits, f.name))
    return Limits(**told)


_watches: dict[str, StreamingQuery] = {}


def watch_start(name: str, start: Callable[[], StreamingQuery]) -> str:
    """Start a stream under a name (see :func:`arborlens.streaming.edits.append_to`) unless it runs; 'started' or 'running'."""
    if name in _watches and _watches[name].isActive:
        return "running"
    _watches[name] = start()
    return "started"


def watch_status(name: str) -> dict:
    """Whether a watch is active, its last batch and the rows of it, and what ended it if it failed."""
    q = _watches.get(name)
    last = q.lastProgress if q is not None else None
    return {"active": q is not None and q.isActive, "batch": last["batchId"] if last else None, "rows": last["numInputRows"] if last else 0, "error": str(q.exception()) if q is not None and q.exception() else ""}


def watch_stop(name: str) -> bool:
    """Stop a watch; False if there was none."""
    q = _watches.pop(name, None)
    if q is not None:
        q.stop()
    return q is not None


def structure(files: DataFrame, edges: DataFrame | None = None, only: list[str] = (), exclude: list[str] = (), limits: Limits = Limits()) -> Bundle:
    """A tree: totals, directories, commonest extensions, largest files and, where edges are known, hubs."""
    shown = inventory.scanned(files, only, exclude)
    out = {
        "files": shown, "totals": inventory.totals(shown), "directories": inventory.directories(shown), "chains": inventory.chains(shown), "extensions": inventory.top_extensions(shown), "largest": inventory.largest(shown),
        "depth": inventory.totals(shown).select(inventory.depth_for(F.col("files")).alias("depth")),
    }
    return out | hubs(edges, limits) if edges is not None else out


def skyline(files: DataFrame) -> Bundle:
    """A building for each extension."""
    return {"buildings": inventory.arranged(inventory.skyline(files))}


def dependency_flow(files: DataFrame, edges: DataFrame, external: DataFrame, sources: DataFrame | None = None) -> Bundle:
    """Systems, edges between shown files, what comes from outside, and the hubs among what is shown."""
    from arborlens.sources.manifests import shown as shown_external

    between = graph.displayed(edges, files)
    out = {"systems": inventory.systems(files).withColumn("name", T.system_name(F.col("system"))), "edges": between, "external": shown_external(external), "hubs": graph.hubs(between, "shown")}
    return out | {"coverage": coverage.reduced(sources.withColumn("all", F.lit(1)), ["all"]).drop("all"), "notes": coverage.notes(sources.withColumn("all", F.lit(1)), ["all"]).drop("all")} if sources is not None else out


def importers(edges: DataFrame, file: str, root: str = "", limits: Limits = Limits()) -> Bundle:
    """Who imports a file: one row of counts, and the lists behind them."""
    path = plain_path(F.lit(file), F.lit(root))
    asked = edges.sparkSession.range(1).select(path.alias("path"))
    return {
        "report": graph.importers_report(edges, asked, limits.listed), "importers": edges.filter(F.col("dst") == path).select(F.col("src").alias("path")).orderBy("path").limit(limits.listed),
        "hub_imports": graph.hub_imports(edges.filter(F.col("src") == path), graph.hubs(edges)).select(F.col("dst").alias("path")),
    }


def hubs(edges: DataFrame, limits: Limits = Limits()) -> Bundle:
    """The hubs with the most importers, and the first importers of each."""
    top = graph.hubs(edges).orderBy(F.desc("importers"), "path").limit(limits.hubs)
    return {"hubs": top, "hub_importers": graph.top_importers(edges, top, limits.importers)}


def file_context(edges: DataFrame, file: str) -> Bundle:
    """What a file imports, who imports it, and all it is connected with."""
    return {
        "imports": edges.filter(F.col("src") == file).select("dst"), "importers": edges.filter(F.col("dst") == file).select("src"),
        "connected": graph.connected(edges.filter((F.col("src") == file) | (F.col("dst") == file))).filter(F.col("path") == file).select("other"),
        "facts": graph.degrees(edges.filter((F.col("src") == file) | (F.col("dst") == file))).filter(F.col("path") == file).select("path", "importers", "imports", ((F.col("counted") >= HUB) & ~T.is_test(F.col("path"))).alias("is_hub")),
    }


def changes(files: DataFrame, diff: DataFrame, imports: DataFrame) -> Bundle:
    """What changed and how often other files name it."""
    changed = graph.annotate(files, diff)
    return {"changed": changed, "impact": graph.impact(imports, changed.select(F.col("path").alias("seq"), "path"))}


def blast_radius(files: DataFrame, diff: DataFrame, edges: DataFrame, texts: DataFrame | None = None, functions: DataFrame | None = None, limits: Limits = Limits()) -> Bundle:
    """A change, what it touches and what it rests on: summary, changed files, relations and, with texts (path, line_no, line), snippets.

    ``functions``: path, functions of the changed files, whose names are looked for first.
    """
    changed = graph.annotate(files, diff)
    hub_rows = graph.hubs(edges)
    n = graph.degrees(edges).select(F.col("path").alias("via"), F.col("importers").alias("via_importers"))
    hit = graph.impacted(edges, changed).join(n, "via").select("path", "via", F.lit("dependent").alias("relation"), "via_importers")
    rests = graph.context(edges, changed, hub_rows)
    out = {
        "summary": graph.blast_summary(edges, changed), "changed": changed.orderBy("path").limit(limits.changed), "impacted": hit.orderBy(F.desc("via_importers"), "path", "via").limit(limits.impacted),
        "context": rests.orderBy(F.desc("is_hub"), "path", "via").limit(limits.context), "reports": graph.importers_report(edges, changed),
    }
    if texts is not None:
        order = F.row_number().over(_by("kind", "at"))  # at most impacted + context rows
        rows = out["impacted"].select(F.lit(0).alias("kind"), F.struct((-F.col("via_importers")).alias("a"), "path", "via").cast("string").alias("at"), "path", "via").unionByName(out["context"].select(F.lit(1).alias("kind"), F.struct((~F.col("is_hub")).alias("a"), "path", "via").cast("string").alias("at"), "path", "via"))
        out["snippets"] = graph.snippets(rows.select(order.alias("seq"), "path", "via"), texts, terms(changed, functions), limits.snippets, limits.snippets_per_file)
    return out


def _by(*cols: str):
    from pyspark.sql import Window

    return Window.orderBy(*cols)


def terms(changed: DataFrame, functions: DataFrame | None = None) -> DataFrame:
    """(via, rank, term, whole): what to look for of a changed file: its functions, longest first, then its path, directory, and their names."""
    bare = F.regexp_replace("path", r"\.[^./]*$", "")
    d = F.when(F.col("path").contains("/"), F.regexp_replace("path", r"/[^/]*$", "")).otherwise("")
    parts = F.array(bare, d, F.substring_index(d, "/", -1), F.substring_index(bare, "/", -1))
    one = changed.select("path", parts.alias("parts"))
    one = one.join(functions.select("path", "functions"), "path", "left") if functions is not None else one.withColumn("functions", F.array().cast("array<string>"))
    own = F.transform(F.array_sort(F.transform(F.coalesce("functions", F.array().cast("array<string>")), lambda f: F.struct((-F.length(f)).alias("n"), f.alias("f")))), lambda x: x["f"])
    tagged = F.concat(F.transform(own, lambda f: F.struct(f.alias("term"), F.lit(True).alias("whole"))), F.transform("parts", lambda p: F.struct(p.alias("term"), F.lit(False).alias("whole"))))
    return one.select(F.col("path").alias("via"), F.posexplode(tagged).alias("rank", "t")).select("via", "rank", "t.term", "t.whole").filter(F.trim("term") != "")


def find(files: DataFrame, text: str, only: list[str] = (), exclude: list[str] = (), muted: list[str] = ()) -> Bundle:
    """Paths that hold a text, and apart from them those that only the allow-list hides."""
    hit = inventory.find(files, text, list(only), list(exclude), list(muted))
    return {"found": hit.filter("visible").select("path").orderBy("path"), "hidden": hit.filter("not visible").select("path").orderBy("path")}


def recent_activity(events: DataFrame, now: Column, back: str = "30 minutes", limits: Limits = Limits()) -> Bundle:
    """What was edited in a look-back: summary, files with the most edits, last events."""
    since = now - F.expr(f"interval {back}")
    per = A.activity(events, since)
    return {"summary": A.activity_summary(events.filter(F.col("ts") > since)), "files": per.orderBy(F.desc("edits"), "root", "path").limit(limits.active), "timeline": A.newest(events.filter(F.col("ts") > since), limits.timeline)}


def working(events: DataFrame, importers_of: DataFrame, most: int = 10) -> Bundle:
    """The working set: its hottest files and its hubs."""
    w = A.working_set(events)
    return {"hot": A.hot_files(w, most), "hubs": A.working_hubs(w, importers_of)}


def build_handoff(files: DataFrame, diff: DataFrame, edges: DataFrame, events: DataFrame, now: Column, back: str = "6 hours") -> Bundle:
    """What the next session needs: changed files by priority, hubs, files at risk, last events, and hashes that tell what is new."""
    recent = events.filter(F.col("ts") >= now - F.expr(f"interval {back}"))
    changed = handoff.changed_from_events(diff, recent).filter(handoff.listed(F.col("path")))
    risk = graph.risk_files(edges, changed)
    count = inventory.totals(files).select("files", inventory.budget_for(F.col("files")).alias("b"))
    hub_rows = graph.hubs(edges, "all")
    prefix = handoff.digest(hub_rows, "path", "importers").join(F.broadcast(count.select("files")), F.lit(True))  # two single rows
    return {
        "budget": count.select("b.*"), "changed": graph.first_changed(changed, risk, 60), "statuses": graph.merge_statuses(changed), "risk": risk, "hubs": hub_rows, "events": A.newest(recent, 25),
        "prefix": prefix.select(handoff.chained(F.col("files"), F.col("hash")).alias("hash")), "delta": handoff.digest(changed, "path", "status"),
    }


def handoff_file(edges: DataFrame, events: DataFrame, file: str) -> Bundle:
    """A file of a hand-off in detail."""
    return file_context(edges, file) | {"events": A.newest(events.filter(F.col("path") == file), 25)}


def envelope(prompts: DataFrame, files: DataFrame, edges: DataFrame, known_skills: DataFrame, subsystems: list | None = None) -> Bundle:
    """A request in context: intent, the files it names that exist, scope, risk, skills, routes. Counts without edges stay unknown."""
    intent = rank.intents(prompts)
    said = prompts.select("id", F.posexplode(T.mentions(F.col("text"), 20)).alias("pos", "m")).withColumn("path", plain_path(F.col("m")))
    named = said.join(files.select("path").distinct(), "path").groupBy("id", "path").agg(F.min("pos").alias("pos"))
    every = prompts.select("id").join(named, "id", "left")
    n = graph.degrees(edges).select("path", "importers")
    langs = F.array_sort(F.array_distinct(F.filter(F.transform("files", T.language), lambda x: x.isNotNull())))
    tasks = every.groupBy("id").agg(F.array_sort(F.collect_set("path")).alias("files")).withColumn("languages", langs).join(intent.select("id", "category"), "id")
    out = {"intent": intent, "files": named, "scope": rank.scope(every), "risk": rank.risk(every, n), "suggestions": rank.suggestions(every, n, intent), "next_steps": rank.next_steps(intent, every, n), "skills": rank.skills(tasks, known_skills)}
    return out | {"routes": rank.routes(prompts, subsystems)} if subsystems else out


def session_start(files: DataFrame, edges: DataFrame, diff: DataFrame, log: DataFrame, limits: Limits = Limits()) -> Bundle:
    """What a session begins with: the tree, its hubs, the change in work, what the last session did (``log`` as :func:`arborlens.sources.state.parsed_log`)."""
    from arborlens.sources.state import last_operations

    return structure(files, edges, limits=limits) | {"changed": graph.annotate(files, diff).limit(limits.changed), "last_session": last_operations(log, files)}


def edit_check(edges: DataFrame, edited: DataFrame) -> Bundle:
    """Before or after an edit: importers of each edited file (path), and the hubs it imports."""
    return {"report": graph.importers_report(edges, edited), "hub_imports": graph.hub_imports(edges.join(edited.select(F.col("path").alias("src")).distinct(), "src", "left_semi"), graph.hubs(edges))}


def session_stop(events: DataFrame, edges: DataFrame) -> Bundle:
    """What a session leaves: its summary over all operations, and the hubs it edited."""
    touched = events.select("path").distinct()
    return {"summary": A.activity_summary(events, every_op=True), "hub_edits": graph.hubs(edges).join(touched, "path", "left_semi")}


def drift_warnings(commits: DataFrame, pairs: DataFrame, window: int = 10) -> Bundle:
    """Documents that lag behind the code they describe."""
    return {"drift": rank.drift(commits, pairs, window)}
