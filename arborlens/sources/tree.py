"""Real trees as DataFrames: inventory, texts, ignore files, revisions."""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlens.functions.paths import base_name, dir_name
from arborlens.functions.text import extension
from arborlens.operators.inventory import scanned


def scan(spark: SparkSession, root: str, texts: bool = False, tasks: int = 64) -> DataFrame:
    """(root, path, size, ext, modified[, content]) of every file below ``root``, hidden ones too.

    Spark's own file sources leave out names that begin with a dot or an underscore, which here are files like any
    other. The driver opens directories from the top until there are ``tasks`` of them; each is then walked
    by a task, on a file system that all executors see. Links are not followed; what cannot be read is left out.
    """
    top = str(Path(root).resolve())
    open_dirs, shallow = [top], []
    while open_dirs and len(open_dirs) < tasks:
        inner = []
        for at in open_dirs:
            for e in sorted(os.scandir(at), key=lambda e: e.name):
                (inner if e.is_dir(follow_symlinks=False) else shallow).append(e.path)
        if not inner:
            open_dirs = []
            break
        open_dirs = inner
    starts = [(p, False) for p in shallow] + [(p, True) for p in open_dirs]
    schema = "path string, size bigint, modified timestamp" + (", content string" if texts else "")
    if not starts:
        return spark.createDataFrame([], f"root string, {schema}, ext string")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for start, is_dir in zip(b["start"], b["is_dir"]):
                for at, _, names in os.walk(start) if is_dir else [(os.path.dirname(start), [], [os.path.basename(start)])]:
                    rows = []
                    for n in names:
                        p = os.path.join(at, n)
                        try:
                            st = os.stat(p, follow_symlinks=False)
                            text = (Path(p).read_bytes().decode("utf-8", "replace"),) if texts else ()
                        except OSError:
                            continue
                        rows.append((os.path.relpath(p, top), st.st_size, pd.Timestamp(st.st_mtime_ns // 1000, unit="us"), *text))
                    if rows:
                        yield pd.DataFrame(rows, columns=["path", "size", "modified", "content"][: len(rows[0])])

    begin = spark.createDataFrame(starts, "start string, is_dir boolean").repartition(min(tasks, len(starts)))
    return begin.mapInPandas(work, schema).withColumn("root", F.lit(top)).withColumn("ext", extension(F.col("path")))


def configured(files: DataFrame, only: list[str] = (), exclude: list[str] = (), state_dir: str = ".arborlens") -> DataFrame:
    """A scan with a project's filters, without the directory of the tool's own state."""
    own = (F.col("path") == state_dir) | F.col("path").startswith(state_dir + "/")
    return scanned(files, list(only), list(exclude)).filter(~own)


def ignore_regex(line: str) -> tuple[str, bool] | None:
    """(regular expression on the path from the root, whether it unignores) of a line of an ignore file."""
    line = line.strip()
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line.removeprefix("!").removeprefix("\\")
    anchored = line.startswith("/") or "/" in line.strip("/")
    body = line.strip("/")
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("/**", i) and i + 3 == len(body):
            out, i = out + "/.+", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out, i = out + ("[^/]*" if body[i] == "*" else "[^/]" if body[i] == "?" else re.escape(body[i])), i + 1
    return ("^" if anchored else "^(?:.*/)?") + out + ("/.*$" if line.endswith("/") else "(?:/.*)?$"), negated


def ignore_rules(files: DataFrame) -> DataFrame:
    """(root, dir, line, regex, negated) of all ignore files; ``files``: root, path, content.

    Rules of a directory are put behind those of the directories above it and, as in the engine this stands in
    for, are matched against the path from the root: a nested rule with a slash must name its directory.
    """
    parse = F.udf(lambda text: [(n, *r) for n, line in enumerate((text or "").split("\n")) if (r := ignore_regex(line))], "array<struct<line:int,regex:string,negated:boolean>>")
    own = files.filter(base_name(F.col("path")) == ".gitignore")  # a few files of a tree
    return own.select("root", dir_name(F.col("path")).alias("dir"), F.explode(parse("content")).alias("r")).select("root", "dir", "r.*")


def not_ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Files that no rule ignores; of the rules that match a path the last one counts, deeper directories after higher ones."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    met = files.select("root", "path", F.explode(above).alias("dir")).join(rules, ["root", "dir"]).filter(F.expr("path rlike regex"))
    last = met.groupBy("root", "path").agg(F.max_by("negated", F.struct(F.length("dir"), "line")).alias("kept"))
    return files.join(last.filter(~F.col("kept")), ["root", "path"], "left_anti")


def numstat(lines: Column) -> Column:
    """A row of ``git diff --numstat`` as a struct (path, added, removed), null if it is none; ``-`` counts 0."""
    fields = F.split(F.trim(lines), r"\s+")
    ok = (F.size(fields) >= 3) & F.try_element_at(fields, F.lit(1)).rlike(r"^(\d+|-)$") & F.try_element_at(fields, F.lit(2)).rlike(r"^(\d+|-)$")
    n = lambda i: F.coalesce(F.try_element_at(fields, F.lit(i)).try_cast("int"), F.lit(0))
    return F.when(ok, F.struct(F.array_join(F.slice(fields, F.lit(3), F.size(fields)), " ").alias("path"), n(1).alias("added"), n(2).alias("removed")))


def _git(root: str, *args: str) -> str:
    return subprocess.run(["git", "-C", root, *args], check=True, capture_output=True, text=True, timeout=60).stdout


def diff(spark: SparkSession, root: str, ref: str) -> DataFrame:
    """(path, added, removed, untracked): what changed against a revision, and files not tracked yet."""
    changed = _git(root, "diff", "--numstat", ref).splitlines()
    try:
        new = _git(root, "ls-files", "--others", "--exclude-standard").splitlines()
    except (subprocess.SubprocessError, OSError):
        new = []
    rows = spark.createDataFrame([(x, False) for x in changed] + [(x, True) for x in new if x], "line string, untracked boolean")
    r = F.when(F.col("untracked"), F.struct(F.col("line").alias("path"), F.lit(0).alias("added"), F.lit(0).alias("removed"))).otherwise(numstat(F.col("line")))
    one = rows.select(r.alias("r"), "untracked").filter(F.col("r").isNotNull()).select("r.*", "untracked")
    return one.groupBy("path").agg(F.max("added").alias("added"), F.max("removed").alias("removed"), F.bool_or("untracked").alias("untracked"))


def changed_entries(spark: SparkSession, root: str, base: str) -> DataFrame:
    """(path, status) of four lists: the branch against its base, modified, staged and untracked paths, one row each time a path is in a list.

    A list that cannot be read is empty; if all are and the branch's could not be read, its error is raised.
    """
    lists = {"branch": ("diff", "--name-only", f"{base}...HEAD"), "modified": ("diff", "--name-only"), "staged": ("diff", "--name-only", "--cached"), "untracked": ("ls-files", "--others", "--exclude-standard")}
    rows, failed = [], None
    for status, args in lists.items():
        try:
            rows += [(p, status) for p in _git(root, *args).splitlines() if p.strip()]
        except (subprocess.SubprocessError, OSError) as e:
            failed = e if status == "branch" else failed
    if not rows and failed:
        raise failed
    return spark.createDataFrame(rows, "path string, status string")


def commits(spark: SparkSession, root: str, last: int) -> DataFrame:
    """(pos, hash, path): what the last commits touched; pos 0 is the latest."""
    rows, pos = [], -1
    for line in _git(root, "log", f"-{last}", "--name-only", "--format=%x00%h").splitlines():
        if line.startswith("\0"):
            pos, commit = pos + 1, line[1:]
        elif line:
            rows.append((pos, commit, line))
    return spark.createDataFrame(rows, "pos int, hash string, path string")


def child_repositories(files: DataFrame) -> DataFrame:
    """(root, dir): directories below a root that are repositories themselves."""
    at = F.regexp_extract("path", r"^(.*?)/\.git/", 1)
    return files.select("root", at.alias("dir")).filter(F.col("dir") != "").distinct()


def projects(spark: SparkSession, folder: str, pattern: str = "", most: int = 50, examine: int = 200) -> tuple[DataFrame, bool]:
    """((name), truncated): directories of a folder by name; nothing but the flag if there are more entries than are examined."""
    entries = sorted(Path(folder).iterdir())
    if len(entries) > examine:
        return spark.createDataFrame([], "name string"), True
    names = [e.name for e in entries if e.is_dir() and not e.name.startswith(".") and pattern.lower() in e.name.lower()]
    return spark.createDataFrame([(n,) for n in names[:most]], "name string"), len(names) > most
