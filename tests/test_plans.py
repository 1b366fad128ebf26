"""Queries on small tables of their own, for what the test tables or the SQL do not show."""

from datetime import datetime, timedelta
from itertools import product

from pyspark.sql import functions as F

from arborlens.operators import coverage
from arborlens.plans import problems, reference


def test_files_without_importers_have_a_row(spark, tmp_path):
    rows = [("r", "a.go", ["x.go", "x.go", None]), ("r", "a.go", []), ("r", "none.go", None), ("r", "empty.go", []), ("r", "null.go", [None]), ("r", None, [])]
    spark.createDataFrame(rows, "root string, file string, importers array<string>").write.parquet(f"{tmp_path}/importers_report.parquet")
    got = {r["path"]: r["importers"] for r in problems.p2_importers(spark, str(tmp_path)).collect()}
    assert got == {"a.go": 1, "none.go": 0, "empty.go": 0, "null.go": 0}


def test_all_outcomes_are_folded(spark, tmp_path):
    rows = [("late", i, "complete") for i in range(9)] + [("late", 9, "unavailable"), ("mixed", 1, "unavailable"), ("mixed", 2, None), *[("mixed", i, "unavailable") for i in range(3, 9)], ("mixed", 9, "partial")]
    rows += [("all", i, "complete") for i in range(9)] + [("none", i, "unavailable") for i in range(9)]
    spark.createDataFrame(rows, "root string, report_id bigint, coverage_status string").write.parquet(f"{tmp_path}/importers_report.parquet")
    got = {r["root"]: r["status"] for r in reference.coverage_fold(spark, str(tmp_path)).collect()}
    assert got == {"late": "partial", "mixed": "partial", "all": "", "none": "unavailable"}


def test_recorded_is_what_the_fold_gives(spark):
    cases = [c for n in range(1, 5) for c in product(("authoritative", "fallback", "mixed", "timeout"), repeat=n)]
    lists = spark.createDataFrame([(i, list(c)) for i, c in enumerate(cases)], "k int, s array<string>")
    want = {r["k"]: r["f"] for r in lists.select("k", coverage.folded(F.col("s")).alias("f")).collect()}
    assert {r["k"]: r["status"] for r in coverage.recorded(lists.select("k", F.explode("s").alias("status")), ["k"]).collect()} == want


def test_every_file_has_its_snippet(spark, tmp_path):
    n = 250
    files = spark.range(n).select(F.col("id").alias("file_id"), F.lit("r").alias("root"), F.format_string("d/name%d.go", "id").alias("path"), F.lit(1).cast("bigint").alias("size"), F.lit(0).alias("added"), F.lit(0).alias("removed"), F.lit(False).alias("is_new"))
    files.write.parquet(f"{tmp_path}/files.parquet")
    spark.range(n).select(F.col("id").alias("file_id"), F.format_string("package d\nfunc name%d() {}", "id").alias("content")).write.parquet(f"{tmp_path}/contents.parquet")
    got = {r["seq"]: r["line_no"] for r in reference.snippet_terms(spark, str(tmp_path)).collect()}
    assert got == dict.fromkeys(range(n), 2)


def test_drift_window_counts_commits(spark, tmp_path):
    t = lambda n: datetime(2024, 1, 1) + timedelta(minutes=n)
    # 300 rows of the newest commit do not fill the window; the document's own commit is older than the code's
    rows = [(i, t(9), ["x.go"]) for i in range(300)] + [(900, t(5), ["src/a.go"]), (901, t(3), ["core/auth/d.md"])]
    df = spark.createDataFrame(rows, "artifact_id bigint, written_at timestamp, paths array<string>")
    df.select("artifact_id", "written_at", F.struct(F.transform("paths", lambda p: F.struct(p.alias("path"))).alias("changed")).alias("delta")).write.parquet(f"{tmp_path}/handoff_artifact.parquet")
    assert [tuple(r) for r in reference.doc_drift(spark, str(tmp_path)).filter("code = 'src/' and subsystem = 'core'").collect()] == [("core", "core/auth/", "src/", 1)]


def test_records_of_null_ids_lineages_and_files(spark, tmp_path):
    t = lambda n: datetime(2024, 1, 1, n)
    rows = [
        (None, None, None, t(1), 1, t(5), '{"root": "a"}'), (None, None, None, t(1), 1, t(6), '{"root": "a"}'), (None, None, None, t(1), 2, t(5), '{"root": "b"}'),
        (7, None, "f2", t(2), 1, t(5), '{"base": "c"}'), (7, None, "f2", t(2), 1, t(6), '{"base": "c"}'), (8, "L", "f1", None, 1, t(5), '{"root": "d"}'), (9, "L", None, t(2), 1, t(5), '{"base": "e"}'),
    ]
    spark.createDataFrame(rows, "record_id bigint, lineage string, file_name string, file_written_at timestamp, line_no int, loaded_at timestamp, payload string").write.parquet(f"{tmp_path}/handoff_raw.parquet")
    got = sorted((r["record_id"] or 0, r["root"]) for r in problems.p3_table(spark, str(tmp_path)).collect())
    assert got == [(0, "a"), (0, "b"), (7, "c"), (8, "d"), (9, "e")]
