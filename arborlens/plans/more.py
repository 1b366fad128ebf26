"""The queries on logs, manifests, hand-off storage, predicates and the end-user operations.

End-user operations give bundles of tables; their queries stack the tables as (section, item, n).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlens import api
from arborlens.functions import extract
from arborlens.functions import text as T
from arborlens.functions.paths import base_name, dir_name
from arborlens.operators import activity as A
from arborlens.operators import coverage, handoff, inventory, resolve
from arborlens.operators.events import agents
from arborlens.operators.ranged import with_previous
from arborlens.plans import views as V
from arborlens.plans.reference import ROUTES, SKILLS, _ago, _diff, _drift, _edges
from arborlens.plans.views import NOW
from arborlens.scratch import cut
from arborlens.sources import manifests, state
from arborlens.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable) -> Callable:
    """Register a query by its name."""
    QUERIES[f.__name__] = f
    return f


def stacked(**sections: tuple[DataFrame, Column, Column]) -> DataFrame:
    """(section, item, n) of several tables: of each a text that names a row and a number."""
    whole = None
    for name, (rows, item, n) in sections.items():
        one = rows.select(F.lit(name).alias("section"), item.cast("string").alias("item"), n.cast("bigint").alias("n"))
        whole = one if whole is None else whole.unionByName(one)
    return whole


# logs and what they leave


def _lines(s, d):
    c = F.col
    return V.events(s, d).select("root", c("event_id").alias("nth"), A.log_line(c("ts"), c("op"), c("path"), c("lines"), c("delta"), c("dirty")).alias("line"))


@query
def log_parsed(s, d):
    return state.parsed_log(_lines(s, d))


@query
def log_tail_lines(s, d):
    logs = table(s, d, "documents").filter(F.col("doc_kind") == "log").select(F.col("doc_id").alias("root"), F.col("text").alias("content"))
    return state.log_tail(logs)


@query
def last_session(s, d):
    newest = A.newest_of(V.events(s, d, "root", "ts", "op", "path"), ["root"], 20).select("root", (-F.col("nth")).alias("nth"), "op", "path")
    return state.last_operations(newest, V.files(s, d, "size"))


def _agent_edits(s, d):
    """Edit logs of one line each: the language stands for the session."""
    raw = table(s, d, "fs_events").select("root", "ts", "path", "lang").filter(F.col("ts").isNotNull())
    line = F.to_json(F.struct("path", F.col("lang").alias("session"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("at")))
    return state.agent_edits(raw.select("root", line.alias("content")), _ago("5 days").cast("timestamp"))


@query
def agent_edit_rows(s, d):
    return _agent_edits(s, d).groupBy("root", "session").agg(F.count(F.lit(1)).alias("edits"), F.count_distinct("path").alias("paths"), F.max(F.unix_micros("at")).alias("last_us"))


@query
def edits_by_session(s, d):
    return state.by_session(_agent_edits(s, d)).select("root", "session", F.array_join("paths", "\n").alias("paths"))


@query
def working_split(s, d):
    w = A.working_set(V.events(s, d, "root", "ts", "op", "path", "delta")).select("root", "path", "edits")
    return state.split_working(w, _agent_edits(s, d), "python")


@query
def lease_count(s, d):
    rows = table(s, d, "fs_events").select("root", F.col("path").alias("session"), F.col("ts").alias("at"))
    return state.leases(rows, F.lit(NOW).cast("timestamp_ntz"), "48 hours")


@query
def usable_handoffs(s, d):
    a = table(s, d, "handoff_artifact").select("artifact_id", "generated_at", "branch", "delta").distinct()
    return state.usable_handoffs(a, F.lit("2016-01-20 00:00:00").cast("timestamp_ntz"), "main").select("artifact_id").distinct()


@query
def notes_dedupe(s, d):
    rows = table(s, d, "importers_report").select("root", F.col("report_id").alias("seq"), F.concat_ws(" ", "mode", "coverage_status").alias("detail"))
    return coverage.notes(rows, ["root"]).select("root", F.array_join("notes", "; ").alias("notes"))


@query
def coverage_merged(s, d):
    # a root's first source is its reports in one mode, what stands in for it those in the others
    r = table(s, d, "importers_report").select("root", "mode", F.when(F.col("coverage_status") == "complete", "authoritative").when(F.col("coverage_status") == "partial", "mixed").otherwise("timeout").alias("status"))
    one = lambda df: df.groupBy("root", F.substring(F.col("root"), -2, 1).alias("part")).agg(F.min("status").alias("status"), F.min("mode").alias("detail"))
    first = r.groupBy("root").agg(F.min("mode").alias("m"))
    told = r.join(first, "root")
    return coverage.merged(one(told.filter(F.col("mode") == F.col("m"))), one(told.filter(F.col("mode") != F.col("m"))), ["root", "part"]).drop("part")


# predicates


@query
def transient_files(s, d):
    p = F.when(F.col("file_id") % 7 == 0, F.concat("path", F.lit(".timestamp-17-ab.mjs"))).otherwise(F.col("path"))
    return V.files(s, d, "size").select("file_id", T.is_transient(p).alias("transient"), F.coalesce(T.is_source(p), F.lit(False)).alias("source"))


@query
def asset_files(s, d):
    e = F.when(F.col("file_id") % 5 == 0, ".PNG").when(F.col("file_id") % 5 == 1, ".lock").otherwise(F.col("ext"))
    return V.files(s, d, "size").filter(inventory.asset(e)).select("file_id")


@query
def control_split(s, d):
    """Events by what they are: some paths are taken for ignore files and configurations."""
    k = F.col("event_id") % 11
    p = F.when(k == 0, F.concat_ws("/", F.regexp_replace("path", "/[^/]*$", ""), F.lit(".gitignore"))).when(k == 1, ".arborlens/config.json").otherwise(F.col("path"))
    control, data = A.split_control(V.events(s, d, "root", "path").withColumn("path", p))
    return control.groupBy("root", "control").agg(F.count(F.lit(1)).alias("events")).unionByName(data.groupBy("root").agg(F.count(F.lit(1)).alias("events")).select("root", F.lit("data").alias("control"), "events"))


@query
def membership(s, d):
    """The files of a tree behind its events, from the scan before them."""
    return A.members(V.events(s, d, "root", "ts", "op", "path"), V.files(s, d, "size"))


@query
def colours_removed(s, d):
    c = F.concat(F.lit("\u001b[1;31m"), F.coalesce("source", F.lit("")), F.lit("\u001b[0m\u001b]0;"), F.coalesce("root", F.lit("")), F.lit("\u0007"), F.coalesce("doc_kind", F.lit("")), F.lit("\u001b[?25l"))
    return table(s, d, "documents").select("doc_id", T.plain_text(c).alias("text"))


@query
def rust_literals(s, d):
    text = F.concat(F.lit('let a = "'), F.col("doc_kind"), F.lit('\\"x"; let b = r#"'), F.col("source"), F.lit(' "q" "#; // end'))
    return table(s, d, "documents").filter(F.col("doc_kind").isNotNull() & F.col("source").isNotNull()).select("doc_id", F.array_join(T.rust_strings(text), "|").alias("strings"))


@query
def common_sources(s, d):
    return inventory.common_sources(V.files(s, d, "size"))


@query
def depth_precedence(s, d):
    n = V.files(s, d, "size").groupBy("root").agg(F.count(F.lit(1)).alias("files"))
    return n.select("root", inventory.depth_of(F.length("root") % 3, F.length("root") % 2, F.col("files")).alias("depth"))


@query
def skyline_fitted(s, d):
    return inventory.fitted(inventory.skyline(V.files(s, d)), 30).select("ext", "height")


@query
def system_facts(s, d):
    e = V.edges(s, d)
    functions = e.select(F.col("dst").alias("path"), F.array_repeat(F.lit("f"), F.length("dst") % 4).alias("functions")).distinct()
    files = e.select(F.col("dst").alias("path")).unionByName(V.files(s, d, "size").select("path"))
    return inventory.system_facts(files, functions, _edges(s, d))


@query
def agent_files(s, d):
    a = table(s, d, "handoff_artifact").select("artifact_id", "written_at", "agent_history").distinct()
    a = cut(a.select("artifact_id", agents(F.col("agent_history")).alias("h")), "histories")
    return a.filter(F.col("h").isNotNull()).select("artifact_id", F.size(handoff.last_agents(F.col("h"), 2)).alias("entries"), F.array_join(handoff.edited_files(F.col("h")), "\n").alias("files")).distinct()


@query
def go_recovered(s, d):
    """Go texts read without a parser; every third lacks its package clause."""
    code = V.files(s, d, "size").select("root", "file_id", "path").join(V.contents(s, d), "file_id")
    head = F.when(F.col("file_id") % 3 == 0, "").otherwise("package x\n\nfunc A() {}\n\nfunc (t T) M() {}\n\nfunc B[K any](k K) {}\n")
    return extract.recovered(extract.go_fallback(cut(code.select("root", "path", head.alias("content")), "texts")), ["root"])


@query
def go_functions(s, d):
    code = V.files(s, d, "size").select("root", "file_id", "path")
    head = F.when(F.col("file_id") % 3 == 0, "func A() {}\n").when(F.col("file_id") % 3 == 1, "package x\nfunc A() {\n").otherwise("package x\n\nimport \"fmt\"\n\nfunc A() {}\n\nfunc (t T) M() {}\n\nfunc B[K any](k K) {}\n")
    one = extract.go_fallback(cut(code.select("file_id", "path", head.alias("content")), "texts"))
    return one.select("file_id", F.array_join("imports", ",").alias("imports"), F.array_join("functions", ",").alias("functions"), "skipped")


# extraction of statements, manifests


_FORMS = 8


def _names(s, d):
    """(dst, k): every file that is imported, and the form of statement that names it."""
    e = V.edges(s, d).select("dst").distinct()
    return e.select("dst", (F.length("dst") % _FORMS).alias("k"))


@query
def import_statements(s, d):
    x = F.col("dst")
    forms = [("#include <", ">"), ("source ", ""), ('import "', '"'), ("const a = require('", "')"), ("import ", " as y"), ("from ", " import y"), ("use ", "::inner;"), ("nothing ", "")]
    text = F.lit(None).cast("string")
    for i, (a, z) in enumerate(forms):
        text = F.when(F.col("k") == i, F.concat(F.lit(a), x, F.lit(z))).otherwise(text)
    return _names(s, d).select(text.alias("statement"), extract.import_path(text).alias("path"))


@query
def function_heads(s, d):
    name = F.concat(F.lit("f_"), F.regexp_replace(base_name(F.col("dst")), r"\W", "_"))
    forms = [("go", "func (s *T) ", "(a int) error {"), ("python", "def ", "(self):"), ("javascript", "async function ", "(a, b) {"), ("typescript", "public static ", "(a: number) {"), ("rust", "pub fn ", "<T>(x: T) {"), ("ruby", "def ", "(a)"), ("c", "static int *", "(void) {"), ("bash", "function ", "() {")]
    text, lang = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (which, a, z) in enumerate(forms):
        text, lang = F.when(F.col("k") == i, F.concat(F.lit(a), name, F.lit(z))).otherwise(text), F.when(F.col("k") == i, which).otherwise(lang)
    heads = cut(_names(s, d).select("dst", text.alias("text"), lang.alias("lang")), "heads")
    return heads.select("dst", extract.function_name(F.col("text"), F.col("lang")).alias("name"))


def _manifests(s, d):
    """A manifest a report, of a kind by its id, that names what the report's file imports."""
    names = F.filter(F.coalesce("imports", F.array().cast("array<string>")), lambda x: x.isNotNull() & (F.trim(x) != ""))
    names = F.array_distinct(F.transform(names, lambda x: F.regexp_replace(x, r"[^A-Za-z0-9_./-]", "")))
    kinds = [("go.mod", "module m\n\nrequire (\n", "\t{} v1.0.0\n", "// end\n)\n"), ("requirements.txt", "# names\n", "{}==1.2\n", ""), ("package.json", '{\n "dependencies": {\n', '  "{}": "^1",\n', ' }\n}\n'), ("Podfile", "target 'x' do\n", "  pod '{}', '~> 1'\n", "end\n"), ("a.csproj", "<Project>\n", '<PackageReference Include="{}" Version="1" />\n', "</Project>\n"), ("packages.config", "<packages>\n", '<package id="{}" version="1" />\n', "</packages>\n")]
    k = F.col("report_id") % len(kinds)
    path, content = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (name, a, each, z) in enumerate(kinds):
        b, e = each.split("{}")
        body = F.array_join(F.transform("names", lambda x: F.concat(F.lit(b), x, F.lit(e))), "")
        path, content = F.when(k == i, F.concat(F.col("report_id").cast("string"), F.lit("/"), F.lit(name))).otherwise(path), F.when(k == i, F.concat(F.lit(a), body, F.lit(z))).otherwise(content)
    rows = table(s, d, "importers_report").select("root", "report_id", names.alias("names")).groupBy("root", "report_id").agg(F.max("names").alias("names"))
    return rows.select("root", path.alias("path"), F.lit(0).alias("size"), content.alias("content"))


@query
def external_deps(s, d):
    return manifests.external(_manifests(s, d)).select("root", "language", "dep").distinct()


@query
def external_shown(s, d):
    one = manifests.shown(manifests.external(_manifests(s, d)))
    return one.select("root", "ord", F.size(F.split("line", ", ")).alias("names"))


# hand-offs


@query
def artifacts_normalised(s, d):
    a = table(s, d, "handoff_artifact").select("artifact_id", "written_at", "root", "prefix", "delta").distinct()
    hashes = {h: F.when(F.col("artifact_id") % 3 == i, F.lit("given")).otherwise("") for i, h in enumerate(("prefix_hash", "delta_hash", "combined_hash"))}
    n = handoff.normalised(a.withColumns(hashes))
    return n.select("artifact_id", "written_at", F.size("prefix.hubs").alias("hubs"), F.size("delta.changed").alias("changed"), F.size("delta.next_steps").alias("steps"), (F.length("prefix_hash") + F.length("delta_hash") + F.length("combined_hash")).alias("digits"), F.when(F.col("artifact_id") % 3 < 2, F.col("combined_hash") == handoff.chained(F.col("prefix_hash"), F.col("delta_hash"))).alias("chained")).distinct()


@query
def handoff_rendered(s, d):
    a = table(s, d, "handoff_artifact").groupBy("artifact_id").agg(F.max_by(F.struct("branch", "delta"), F.struct("written_at", "branch", F.xxhash64("delta"))).alias("a")).select(F.col("artifact_id").alias("key"), "a.*")
    items = lambda c: a.select("key", F.posexplode(F.col(f"delta.{c}")).alias("nth", "x")).filter(F.col("x.path").isNotNull()).select("key", "nth", F.col("x.path").alias("item"))
    text = handoff.rendered(items("changed"), items("risk_files"), items("recent_events"), a.select("key", F.coalesce("branch", F.lit("?")).alias("head")), 5)
    return text.select("key", F.length("text").alias("letters"), F.md5("text").alias("text"))


# end-user operations


@query
def op_structure(s, d):
    b = api.structure(V.files(s, d), _edges(s, d))
    return stacked(
        files=(b["totals"], F.lit("files"), F.col("files")), bytes=(b["totals"], F.lit("bytes"), F.col("bytes")), depth=(b["depth"], F.lit("depth"), F.col("depth")), extensions=(b["extensions"], F.col("ext"), F.col("files")),
        hubs=(b["hubs"], F.col("path"), F.col("importers")), hub_importers=(b["hub_importers"], F.concat_ws(" <- ", "path", "src"), F.col("nth")), directories=(b["directories"].filter("depth = 1"), F.col("dir"), F.col("files")),
    )


@query
def op_skyline(s, d):
    b = api.skyline(V.files(s, d))["buildings"]
    return stacked(height=(b, F.col("ext"), F.col("height")), place=(b, F.col("ext"), F.col("place")))


@query
def op_flow(s, d):
    files = V.changed(s, d).withColumn("size", F.lit(1).cast("bigint"))
    outside = s.createDataFrame([("r", "go", "github.com/a/zap/v2", 0), ("r", "go", "golang.org/x/net", 1), ("r", "python", "numpy", 0)], "root string, language string, dep string, nth int")
    b = api.dependency_flow(files, _edges(s, d), outside)
    return stacked(systems=(b["systems"], F.col("name"), F.col("files")), edges=(b["edges"], F.concat_ws(" -> ", "src", "dst"), F.lit(1)), hubs=(b["hubs"], F.col("path"), F.col("importers")), external=(b["external"], F.col("line"), F.col("ord")))


def _most_imported(edges: DataFrame) -> str:
    """The file with the most importers, the first by name: what a user would ask for."""
    top = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dst").first()  # one row
    return top["dst"] if top else ""


@query
def op_importers(s, d):
    e = _edges(s, d)
    b = api.importers(e, _most_imported(e))
    return stacked(count=(b["report"], F.col("path"), F.col("importer_count")), hub=(b["report"], F.col("path"), F.col("is_hub").cast("int")), importers=(b["importers"], F.col("path"), F.lit(1)), hub_imports=(b["hub_imports"], F.col("path"), F.lit(1)))


@query
def op_hubs(s, d):
    b = api.hubs(_edges(s, d))
    return stacked(hubs=(b["hubs"], F.col("path"), F.col("importers")), importers=(b["hub_importers"], F.concat_ws(" <- ", "path", "src"), F.col("nth")))


@query
def op_file_context(s, d):
    e = _edges(s, d)
    b = api.file_context(e, _most_imported(e))
    return stacked(imports=(b["imports"], F.col("dst"), F.lit(1)), importers=(b["importers"], F.col("src"), F.lit(1)), connected=(b["connected"], F.col("other"), F.lit(1)), facts=(b["facts"], F.col("path"), F.col("importers") * 2 + F.col("is_hub").cast("int")))


@query
def op_changes(s, d):
    f = V.files(s, d).select("path", "size").groupBy("path").agg(F.max("size").alias("size"))
    diff = V.changed(s, d).select("path", F.lit(3).alias("added"), F.lit(None).cast("int").alias("removed"), F.lit(False).alias("untracked"))
    files = diff.select("path").withColumn("size", F.lit(7)).unionByName(f)
    b = api.changes(files, diff, V.edges(s, d).select(F.col("src").alias("path"), F.col("dst").alias("spec")))
    return stacked(changed=(b["changed"], F.col("path"), F.col("added") + F.col("removed")), impact=(b["impact"], F.col("target"), F.col("used_by")))


@query
def op_blast(s, d):
    diff = V.changed(s, d).select("path", F.lit(3).alias("added"), F.lit(None).cast("int").alias("removed"), F.lit(False).alias("untracked"))
    b = api.blast_radius(V.changed(s, d).withColumn("size", F.lit(7)), diff, _edges(s, d))
    return stacked(
        changed=(b["changed"], F.col("path"), F.col("added")), impacted=(b["impacted"], F.concat_ws(" via ", "path", "via"), F.col("via_importers")), context=(b["context"], F.concat_ws(" via ", "path", "via"), F.col("is_hub").cast("int")),
        summary=(b["summary"], F.col("highest"), F.col("impacted")), reports=(b["reports"], F.col("path"), F.col("importer_count")),
    )


@query
def op_find(s, d):
    b = api.find(V.files(s, d, "size").withColumn("path", F.concat_ws("/", "root", "path")), "Cache", ["go", "py"], ["vendor"], ["c"])
    return stacked(found=(b["found"], F.col("path"), F.lit(1)), hidden=(b["hidden"], F.col("path"), F.lit(1)))


@query
def op_activity(s, d):
    b = api.recent_activity(V.events(s, d), F.lit(NOW).cast("timestamp_ntz"), "3 days")
    return stacked(summary=(b["summary"], F.col("root"), F.col("edits")), files=(b["files"], F.concat_ws(":", "root", "path"), F.col("edits")), timeline=(b["timeline"], F.col("path"), F.col("event_id")))


@query
def op_working(s, d):
    n = V.events(s, d, "root", "path").groupBy("path").agg(F.count_distinct("root").alias("importers"))
    b = api.working(V.events(s, d, "root", "ts", "op", "path", "delta"), n)
    return stacked(hot=(b["hot"], F.concat_ws(":", "root", "path"), F.col("edits")), hubs=(b["hubs"], F.col("root"), F.col("hubs")))


@query
def op_handoff(s, d):
    diff = V.changed(s, d).withColumn("status", F.lit("modified"))
    b = api.build_handoff(V.files(s, d), diff, _edges(s, d), V.events(s, d), F.lit(NOW).cast("timestamp_ntz"), "48 hours")
    return stacked(
        budget=(b["budget"], F.lit("changed"), F.col("changed")), changed=(b["changed"], F.col("path"), F.col("is_risk").cast("int")), risk=(b["risk"], F.col("path"), F.col("importers")), hubs=(b["hubs"], F.col("path"), F.col("importers")),
        events=(b["events"], F.col("path"), F.col("event_id")), hashes=(b["prefix"].unionByName(b["delta"]), F.lit("letters"), F.length("hash")),
    )


@query
def op_handoff_file(s, d):
    e = _edges(s, d)
    path = V.events(s, d, "path").groupBy("path").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "path").first()["path"]  # one row
    b = api.handoff_file(e, V.events(s, d, "root", "ts", "op", "path"), path)
    return stacked(events=(b["events"], F.col("path"), F.col("event_id")), importers=(b["importers"], F.col("src"), F.lit(1)))


@query
def op_envelope(s, d):
    known = s.createDataFrame(SKILLS, "name string, priority int, keywords array<string>, languages array<string>, patterns array<string>")
    files = V.prompts(s, d).select(F.explode(T.mentions(F.col("text"))).alias("path")).distinct().filter(F.length("path") % 2 == 0)
    b = api.envelope(V.prompts(s, d), files, _edges(s, d), known, ROUTES)
    return stacked(intent=(b["intent"], F.concat_ws(" ", "id", "category"), F.col("score")), files=(b["files"], F.concat_ws(" ", "id", "path"), F.col("pos")), scope=(b["scope"], F.concat_ws(" ", "id", "scope"), F.lit(1)), routes=(b["routes"], F.concat_ws(" ", "id", "subsystem"), F.col("score")))


@query
def op_session_start(s, d):
    newest = A.newest_of(V.events(s, d, "root", "ts", "op", "path"), ["root"], 20).select("root", (-F.col("nth")).alias("nth"), "op", "path")
    diff = _diff(s, d).withColumnRenamed("file_id", "path")
    files = V.files(s, d)
    b = api.session_start(files, _edges(s, d), diff.withColumn("path", F.col("path").cast("string")), newest)
    return stacked(files=(b["totals"], F.lit("files"), F.col("files")), hubs=(b["hubs"], F.col("path"), F.col("importers")), last=(b["last_session"], F.concat_ws(" ", "root", "path", "op"), F.col("more")))


@query
def op_edit_check(s, d):
    b = api.edit_check(_edges(s, d), V.changed(s, d))
    return stacked(report=(b["report"], F.col("path"), F.col("importer_count")), hub_imports=(b["hub_imports"], F.concat_ws(" -> ", "src", "dst"), F.lit(1)))


@query
def op_session_stop(s, d):
    # reports and events share no paths here: what reports list as changed stands for the edited files
    e = V.changed(s, d).select(F.lit("r").alias("root"), "path", F.lit("WRITE").alias("op"), F.lit(1).alias("delta"), F.lit(False).alias("dirty"))
    b = api.session_stop(e, _edges(s, d))
    return stacked(summary=(b["summary"], F.col("root"), F.col("edits")), hub_edits=(b["hub_edits"], F.col("path"), F.col("importers")))


@query
def op_drift(s, d):
    b = api.drift_warnings(*_drift(s, d), 200)
    return stacked(drift=(b["drift"], F.concat_ws(" ", "subsystem", "doc", "code"), F.col("behind")))


# from texts to edges: statements are written into texts, found there, and resolved by every strategy


def _texts(s, d):
    """Files whose text names the file before them of their root and extension, in the manner of their language."""
    f = V.files(s, d, "size").filter(F.col("ext") != "").select("root", "ext", "file_id", "path")
    p = with_previous(f, ["root", "ext"], ["file_id"], ["path"]).filter("has_prev")
    lang, bare = T.language(F.col("path")), F.regexp_replace("prev_path", r"\.[^./]*$", "")
    module = F.concat(F.lit("example.org/"), base_name(F.col("root")))
    go = F.when(dir_name(F.col("prev_path")) == "", module).otherwise(F.concat_ws("/", module, dir_name(F.col("prev_path"))))
    dotted, colons = F.replace(bare, F.lit("/"), F.lit(".")), F.replace(bare, F.lit("/"), F.lit("::"))
    js = F.when(F.col("file_id") % 2 == 0, F.concat(F.lit("@/"), bare)).otherwise(F.concat(F.lit("pkg/"), bare))
    line = (
        F.when(lang == "go", F.concat(F.lit('import "'), go, F.lit('"'))).when(lang.isin("javascript", "typescript"), F.concat(F.lit('import x from "'), js, F.lit('";')))
        .when(lang == "rust", F.concat(F.lit("use crate::"), colons, F.lit(";"))).when(lang.isin("python", "java"), F.concat(F.lit("import "), dotted)).when(lang == "csharp", F.concat(F.lit("using "), dotted, F.lit(";")))
        .when(lang == "c", F.concat(F.lit('#include "'), F.col("prev_path"), F.lit('"'))).otherwise(F.concat(F.lit('require "'), bare, F.lit('"')))
    )
    return p.select("root", "path", F.concat(line, F.lit("\n")).alias("content"))


def _real(s, d):
    files = V.files(s, d, "size").select("root", "path").distinct()
    # as a table: an expression would be made anew for each language that is looked for in it
    found = cut(extract.analyses(cut(_texts(s, d), "texts")).select("root", "path", F.explode("imports").alias("spec")), "imports")
    modules = files.select("root").distinct().withColumn("module", F.concat(F.lit("example.org/"), base_name(F.col("root"))))
    aliases = files.select("root").distinct().select("root", F.lit("@/*").alias("pattern"), F.lit(0).alias("nth"), F.lit("./*").alias("target"))
    workspace = found.filter(F.col("spec").startswith("pkg/")).select("root", F.col("path").alias("src"), "spec", F.lit("exact").alias("kind"), F.regexp_replace("spec", "^pkg/", "").alias("key"))
    return resolve.resolve(resolve.attempts(found, modules, aliases, workspace), resolve.index(files, modules))


@query
def resolve_real(s, d):
    return _real(s, d)


@query
def resolve_strategies(s, d):
    """How many imports each strategy resolved, of which language."""
    return _real(s, d).groupBy("strategy", T.language(F.col("src")).alias("language")).agg(F.count_distinct("root", "src", "spec").alias("imports"))
