"""The queries on files, edges, changes, events and requests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborlens.functions import text as T
from arborlens.functions.extract import analyses
from arborlens.functions.paths import dir_name, plain_path
from arborlens.operators import activity as A
from arborlens.operators import coverage, graph, handoff, inventory, rank, resolve
from arborlens.operators.ranged import with_previous
from arborlens.plans import views as V
from arborlens.plans.views import NOW
from arborlens.scratch import cut
from arborlens.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable) -> Callable:
    """Register a query by its name."""
    QUERIES[f.__name__] = f
    return f


def _edges(s, d):
    """The edges as a table, for queries that go through them several times."""
    return cut(V.edges(s, d), "edges")


def _ago(text: str):
    return F.lit(NOW).cast("timestamp_ntz") - F.expr(f"interval {text}")


# graph


@query
def degree_table(s, d):
    return graph.degrees(V.edges(s, d))


@query
def hub_files(s, d):
    return graph.hubs(V.edges(s, d))


@query
def hub_files_with_tests(s, d):
    return graph.hubs(V.edges(s, d), "all")


@query
def hub_files_report(s, d):
    return graph.hubs(V.edges(s, d), "report")


@query
def hub_footer_displayed(s, d):
    return graph.hubs(graph.displayed(V.edges(s, d), V.changed(s, d)), "shown")


@query
def hub_top3_importers(s, d):
    e = _edges(s, d)
    return graph.top_importers(e, graph.hubs(e))


@query
def importers_of(s, d):
    return graph.importers_report(_edges(s, d), V.changed(s, d))


@query
def imports_of(s, d):
    return V.edges(s, d).join(V.changed(s, d).withColumnRenamed("path", "src"), "src", "left_semi")


@query
def connected_files(s, d):
    return graph.connected(V.edges(s, d))


@query
def hub_imports(s, d):
    e = _edges(s, d)
    return graph.hub_imports(e, graph.hubs(e))


@query
def displayed_subgraph(s, d):
    return graph.displayed(V.edges(s, d), V.changed(s, d))


# changes


def _diff(s, d):
    f = V.files(s, d).filter(F.coalesce("added", F.lit(0)) + F.coalesce("removed", F.lit(0)) > 20)
    return f.select("file_id", "added", "removed", F.col("is_new").alias("untracked"))


@query
def changed_files_annotated(s, d):
    f = V.files(s, d).select("file_id", "size", "ext").withColumnRenamed("file_id", "path")
    return graph.annotate(f, _diff(s, d).withColumnRenamed("file_id", "path")).withColumnRenamed("path", "file_id")


@query
def changed_semi(s, d):
    return V.files(s, d).select("file_id", "root", "path").join(_diff(s, d), "file_id", "left_semi")


@query
def impact_by_basename(s, d):
    # changed files in order of name; imports as the reports list them
    changed = V.changed(s, d).select(F.col("path").alias("seq"), "path")
    raw = table(s, d, "importers_report").select(plain_path(F.col("file"), F.col("root")).alias("path"), F.explode("imports").alias("spec"))
    return graph.impact(raw.dropna(), changed)


@query
def blast_impacted(s, d):
    return graph.impacted(V.edges(s, d), V.changed(s, d))


@query
def blast_context(s, d):
    e = _edges(s, d)
    return graph.context(e, V.changed(s, d), graph.hubs(e))


@query
def blast_top_impacted(s, d):
    e = _edges(s, d)
    n = graph.degrees(e).select(F.col("path").alias("via"), F.col("importers").alias("via_importers"))
    return graph.impacted(e, V.changed(s, d)).join(n, "via").orderBy(F.desc("via_importers"), "path", "via").limit(12)


@query
def blast_summary(s, d):
    return graph.blast_summary(_edges(s, d), V.changed(s, d))


@query
def risk_files(s, d):
    return graph.risk_files(V.edges(s, d), V.changed(s, d))


@query
def priority_fill(s, d):
    c = V.changed(s, d)
    return graph.first_changed(c, graph.risk_files(V.edges(s, d), c), 60)


@query
def status_rank_merge(s, d):
    rows = table(s, d, "handoff_artifact").select(F.explode("delta.changed").alias("c")).select("c.path", "c.status")
    return graph.merge_statuses(rows.filter(F.col("path").isNotNull()))


# inventory


def _per_root(s, d):
    return V.files(s, d, "size").select("root", "file_id", "path", "size", "ext")


@query
def tree_dir_rollup(s, d):
    return inventory.directories(_per_root(s, d), ["root"])


@query
def tree_chains(s, d):
    return inventory.chains(_per_root(s, d), ["root"])


@query
def tree_depth_hidden(s, d):
    return inventory.hidden_below(_per_root(s, d), 2, ["root"])


@query
def dir_homogeneous_ext(s, d):
    return inventory.one_extension(_per_root(s, d), ["root"])


@query
def tree_totals(s, d):
    return inventory.totals(V.files(s, d))


@query
def top_extensions(s, d):
    return inventory.top_extensions(V.files(s, d))


@query
def top_large_files(s, d):
    f = V.files(s, d)
    return inventory.largest(f.withColumn("path", F.concat_ws("/", "root", "path")))


@query
def top_large_files_per_root(s, d):
    return inventory.largest_in(_per_root(s, d), ["root"])


@query
def ext_aggregate(s, d):
    return inventory.extensions(V.files(s, d))


@query
def skyline_heights(s, d):
    return inventory.skyline(V.files(s, d))


@query
def skyline_arranged(s, d):
    return inventory.arranged(inventory.skyline(V.files(s, d)))


@query
def size_human(s, d):
    return V.files(s, d).filter(F.col("size").isNotNull()).select("file_id", T.human_size(F.col("size")).alias("size"))


@query
def filter_scanned(s, d):
    return inventory.scanned(V.files(s, d)).select("file_id", "root", "path")


@query
def filter_only_exclude(s, d):
    return inventory.scanned(V.files(s, d), only=["go", ".py", "TS"], exclude=["*_test*", "hooks", ".rb", "cmd/*/r*.go"]).select("file_id", "root", "path")


@query
def find_file_split(s, d):
    return inventory.find(V.files(s, d).withColumn("path", F.concat_ws("/", "root", "path")), "Store", only=["go", "py"], exclude=["vendor"], muted=["c"])


@query
def lang_histogram(s, d):
    return inventory.languages(V.files(s, d))


@query
def primary_language(s, d):
    return inventory.primary_language(_per_root(s, d), ["root"])


@query
def adaptive_limits(s, d):
    n = V.files(s, d).groupBy("root").agg(F.count(F.lit(1)).alias("files"))
    b = inventory.budget_for(F.col("files"))
    return n.select("root", "files", inventory.depth_for(F.col("files")).alias("depth"), b["changed"].alias("changed"), b["risk"].alias("risk"), b["events"].alias("events"))


@query
def systems(s, d):
    return inventory.systems(V.files(s, d)).withColumn("name", T.system_name(F.col("system")))


@query
def test_files(s, d):
    return V.files(s, d).filter(T.is_test(F.col("path"))).select("file_id", "path")


# events


@query
def activity_by_file(s, d):
    return A.activity(V.events(s, d, "root", "op", "path", "delta", "ts", "dirty"))


@query
def activity_recent(s, d):
    return A.activity(V.events(s, d, "root", "op", "path", "delta", "ts", "dirty"), _ago("7 days"))


@query
def activity_summary(s, d):
    return A.activity_summary(V.events(s, d, "root", "op", "path", "delta", "dirty"))


@query
def session_summary_all_ops(s, d):
    return A.activity_summary(V.events(s, d, "root", "op", "path", "delta", "dirty"), every_op=True)


@query
def timeline_last_n(s, d):
    return A.newest(V.events(s, d, "ts", "op", "root", "path"), 50).select("event_id", "ts", "op", "path")


@query
def bounded_history(s, d):
    return A.newest_of(V.events(s, d, "root", "ts", "op", "path"), ["root"], 50)


@query
def working_set(s, d):
    return A.working_set(V.events(s, d, "root", "ts", "op", "path", "delta"))


@query
def hot_files(s, d):
    return A.hot_files(A.working_set(V.events(s, d, "root", "ts", "op", "path", "delta")), 20)


@query
def active_files(s, d):
    return A.active_since(A.working_set(V.events(s, d, "root", "ts", "op", "path", "delta")), _ago("3 days"))


@query
def working_set_hubs(s, d):
    return A.working_hubs(A.working_set(V.events(s, d, "root", "ts", "op", "path", "delta")), _hot_counts(s, d))


@query
def debounce_batch(s, d):
    return A.debounced(V.events(s, d, "root", "ts", "op", "path"), 2_000_000)


@query
def unchanged_writes(s, d):
    # sizes and lines in steps, since hardly a write here leaves both exactly as they were
    e = V.events(s, d, "root", "ts", "op", "path", "lines", "size")
    return A.unchanged(e.withColumns({"lines": F.floor(F.col("lines") / 200), "size": F.floor(F.col("size") / 20_000)}))


@query
def stateful_delta(s, d):
    return A.deltas(V.events(s, d, "root", "ts", "op", "path", "lines", "size"))


@query
def related_hot(s, d):
    # reports and events share no paths here: a file is taken to import the one before it in its directory
    e = V.events(s, d, "root", "ts", "op", "path")
    files = e.select("root", "path").distinct().withColumn("dir", dir_name(F.col("path")))
    edges = with_previous(files, ["root", "dir"], ["path"], ["path"]).filter("has_prev").select("root", F.col("path").alias("src"), F.col("prev_path").alias("dst"))
    return A.related_hot(e, graph.connected(edges, ["root"]), 300_000_000)


@query
def event_enrichment(s, d):
    return A.enriched(V.events(s, d, "root", "path"), graph.degrees(V.edges(s, d)))


@query
def control_sessions(s, d):
    return A.bursts(V.events(s, d, "root", "ts", "op"), 2_000_000)


@query
def event_log_lines(s, d):
    c = F.col
    return V.events(s, d).select("event_id", A.log_line(c("ts"), c("op"), c("path"), c("lines"), c("delta"), c("dirty")).alias("line"))


@query
def log_byte_trim(s, d):
    c = F.col
    return A.last_bytes(V.events(s, d), A.log_line(c("ts"), c("op"), c("path"), c("lines"), c("delta"), c("dirty")), 16 * 1024).drop("line")


@query
def last_operation(s, d):
    return A.last_operation(V.events(s, d, "root", "ts", "op", "path"), V.files(s, d, "size"))


@query
def event_gaps(s, d):
    return A.gaps(V.events(s, d, "root", "ts"))


# requests


@query
def intent_scores(s, d):
    return rank.intent_scores(V.prompts(s, d))


@query
def intent_category(s, d):
    return rank.intents(V.prompts(s, d))


@query
def extract_mentions(s, d):
    return V.prompts(s, d).select("id", F.posexplode(T.mentions(F.col("text"))).alias("pos", "mention"))


def _mentioned(s, d):
    return V.prompts(s, d).select("id", F.posexplode_outer(T.mentions(F.col("text"), 5)).alias("pos", "path"))


def _hot_counts(s, d):
    return V.events(s, d, "root", "path").groupBy("path").agg(F.count_distinct("root").alias("importers"))


@query
def task_scope(s, d):
    return rank.scope(_mentioned(s, d))


@query
def task_risk(s, d):
    return rank.risk(_mentioned(s, d), _hot_counts(s, d))


@query
def task_suggestions(s, d):
    return rank.suggestions(_mentioned(s, d), _hot_counts(s, d), rank.intents(V.prompts(s, d)))


@query
def task_next_steps(s, d):
    return rank.next_steps(rank.intents(V.prompts(s, d)), _mentioned(s, d), _hot_counts(s, d))


#: Subsystems to route to: id, keywords, path hints.
ROUTES = [
    ("watching", ["event", "watcher", "daemon"], ["watch/"]),
    ("graph", ["import", "edge", "graph"], ["graph/"]),
    ("handoff", ["handoff", "snapshot", "summary"], ["handoff/"]),
    ("config", ["config", "budget"], ["config"]),
    ("render", ["tree view", "outline", "layout"], ["render/"]),
]


@query
def route_topk(s, d):
    return rank.routes(V.prompts(s, d), ROUTES)


#: Skills: name, priority, keywords, languages, path patterns.
SKILLS = [
    ("explore-code", 10, ["explore"], [], []),
    ("fix-bugs", 5, ["bugfix", "test"], [], ["*_test.go"]),
    ("go-idioms", 0, [], ["go"], ["*.go", "internal/"]),
    ("python-style", 3, [], ["python"], ["*.py"]),
    ("refactoring", 12, ["Refactor"], ["java", "csharp"], ["core/"]),
    ("release-work", 7, ["vcs", "docs"], [], ["CHANGELOG"]),
]


@query
def skill_match(s, d):
    known = s.createDataFrame(SKILLS, "name string, priority int, keywords array<string>, languages array<string>, patterns array<string>")
    one = V.prompts(s, d).withColumn("files", T.mentions(F.col("text"), 5))
    langs = F.array_sort(F.array_distinct(F.filter(F.transform("files", lambda p: T.language(p)), lambda x: x.isNotNull())))
    tasks = one.withColumn("languages", langs).join(rank.intents(V.prompts(s, d)).select("id", "category"), "id").select("id", "category", "files", "languages")
    return rank.skills(tasks, known)


def _drift(s, d):
    """(commits, pairs) of the hand-off artifacts."""
    # commits: times of artifacts, newest first, each once; paths: what all artifacts of that time changed
    artifacts = table(s, d, "handoff_artifact").select("written_at", "delta.changed").filter(F.col("written_at").isNotNull())
    at = artifacts.select(F.explode("changed").alias("c"), "written_at").select(F.col("c.path").alias("path"), "written_at").dropna()
    pos = artifacts.select("written_at").distinct().orderBy(F.desc("written_at")).limit(200).withColumn("pos", F.row_number().over(Window.orderBy(F.desc("written_at"))) - 1)
    commits = at.join(pos, "written_at").select("pos", "path")
    pairs = s.createDataFrame([(a, f"{a}/{b}", c) for a in ("core", "pkg", "lib") for b, c in (("auth/", "src/"), ("render/", "app/"), ("none/", "cmd/"), ("store/", f"{a}/"))], "subsystem string, doc string, code string")
    return commits, pairs


@query
def doc_drift(s, d):
    return rank.drift(*_drift(s, d), 200)


# texts, coverage, hand-off


@query
def truncate_line_boundary(s, d):
    return V.prompts(s, d).select("id", F.md5(T.cut_at_line(F.col("text"), 600)).alias("text"))


@query
def truncate_letters(s, d):
    return V.prompts(s, d).select("id", T.first_letters(F.col("text"), 80).alias("text"))


@query
def line_counts(s, d):
    return V.prompts(s, d).select("id", F.size(T.lines(F.col("text"))).alias("lines"))


@query
def excerpts(s, d):
    return V.contents(s, d).select("file_id", T.excerpt(F.col("content"), F.lit(3), 2).alias("excerpt"))


@query
def snippet_terms(s, d):
    # every file is a request of its own, for its name as a word and the letters it begins with
    f = V.files(s, d).select(F.col("file_id").alias("seq"), F.col("file_id").alias("path"), F.col("path").alias("p"))
    text = V.contents(s, d).select(F.col("file_id").alias("path"), F.posexplode(T.lines(F.col("content"))).alias("n", "line")).select("path", (F.col("n") + 1).alias("line_no"), "line")
    stem = F.regexp_replace(F.substring_index("p", "/", -1), r"\.[^.]*$", "")
    first = F.regexp_extract(stem, r"^[A-Za-z]+", 0)
    terms = f.select(F.col("seq").alias("via"), F.posexplode(F.array(F.struct(stem.alias("term"), F.lit(True).alias("whole")), F.struct(first.alias("term"), F.lit(False).alias("whole")))).alias("rank", "t")).select("via", "rank", "t.term", "t.whole").filter(F.col("term") != "")
    return graph.snippets(f.select("seq", "path", F.col("seq").alias("via")), text, terms, most=None)


@query
def coverage_reduce(s, d):
    rows = table(s, d, "importers_report").select("root", F.when(F.col("coverage_status") == "complete", "authoritative").when(F.col("coverage_status") == "partial", "fallback").otherwise(F.col("coverage_status")).alias("status"))
    return coverage.reduced(rows, ["root"])


@query
def coverage_fold(s, d):
    rows = table(s, d, "importers_report").filter(F.col("coverage_status").isNotNull()).select("root", F.when(F.col("coverage_status") == "complete", "authoritative").when(F.col("coverage_status") == "partial", "mixed").otherwise("timeout").alias("status"))
    return coverage.recorded(rows, ["root"])


@query
def handoff_hash(s, d):
    f = V.files(s, d)
    return f.select("file_id", handoff.chained(F.col("root"), F.col("path"), F.col("size")).alias("hash"))


@query
def handoff_listed(s, d):
    return V.files(s, d).filter(handoff.listed(F.col("path"))).select("file_id")


@query
def cache_metrics(s, d):
    a = table(s, d, "handoff_artifact").select("root", "artifact_id", "written_at", F.coalesce(F.col("prefix.file_count"), F.lit(0)).alias("fc"), F.size(F.coalesce(F.col("delta.changed"), F.array())).alias("n"), "branch").distinct()
    rows = a.select("root", "written_at", "artifact_id", handoff.chained(F.col("branch")).alias("prefix_hash"), handoff.chained(F.col("n")).alias("delta_hash"), F.col("fc").cast("bigint").alias("prefix_bytes"), F.col("n").cast("bigint").alias("delta_bytes"))
    return handoff.metrics(rows, ["root"], ["written_at", "artifact_id"]).drop("written_at")


@query
def handoff_guidance(s, d):
    a = table(s, d, "handoff_artifact")
    size = lambda c: F.size(F.coalesce(F.col(c), F.array()))
    facts = a.groupBy("artifact_id").agg(F.max(size("delta.changed")).alias("changed"), F.max(size("delta.risk_files")).alias("risk"), F.max(size("delta.recent_events")).alias("events"), F.bool_or(F.col("delta").isNotNull()).alias("has_state"), F.bool_or(F.col("prefix").isNotNull()).alias("has_graph"))
    g = handoff.guidance(facts)
    return g.select("artifact_id", F.array_join("next_steps", "; ").alias("next_steps"), F.array_join("open_questions", "; ").alias("open_questions"))


# extraction and resolution


def _code(s, d):
    return V.files(s, d, "size").select("file_id", "root", "path").join(V.contents(s, d), "file_id")


@query
def extract_code(s, d):
    one = analyses(_code(s, d))
    return one.select("file_id", "language", F.array_join("imports", ",").alias("imports"), F.array_join("functions", ",").alias("functions"))


@query
def function_counts(s, d):
    return analyses(_code(s, d)).groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.sum(F.size("functions")).alias("functions"))


def _specs(s, d):
    """Each file imports the one before it of its root and extension, named in five ways by its id."""
    f = V.files(s, d).filter(F.col("ext") != "").select("root", "ext", "file_id", "path")
    p = with_previous(f, ["root", "ext"], ["file_id"], ["path"]).filter("has_prev")
    bare = F.regexp_replace("prev_path", r"\.[^./]*$", "")
    k = F.col("file_id") % 5
    spec = F.when(k == 0, F.replace(bare, F.lit("/"), F.lit("."))).when(k == 1, bare).when(k == 2, F.regexp_replace(bare, "^[^/]*/", "")).when(k == 3, F.concat(F.lit("../../../../../"), bare)).otherwise(dir_name(F.col("prev_path")))
    return p.select("root", "path", spec.alias("spec"))


def _resolved(s, d):
    return resolve.resolve(resolve.attempts(_specs(s, d)), resolve.index(V.files(s, d)))


@query
def resolve_ladder(s, d):
    return _resolved(s, d)


@query
def resolve_degree(s, d):
    e = resolve.edges(_resolved(s, d)).select(F.concat_ws("/", "root", "src").alias("src"), F.concat_ws("/", "root", "dst").alias("dst"))
    return graph.degrees(e)


@query
def file_index_keys(s, d):
    return resolve.index(V.files(s, d)).groupBy("kind", "family").agg(F.count(F.lit(1)).alias("keys"), F.count_distinct("key").alias("distinct_keys"))
