"""Requests in words: intent, risk, routes, skills, documentation drift. Tables of phrases are parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborlens.functions.dims import CONFIDENCE_FLOOR, HUB, SIGNALS
from arborlens.functions.paths import dir_name
from arborlens.functions.text import skill_path


def intents(prompts: DataFrame, signals: list[tuple[str, int, str, int]] = SIGNALS) -> DataFrame:
    """(id, category, score, total, confidence, sure): the category whose phrases, found anywhere in lower case, weigh most.

    Phrases are a fixed list, so a prompt is scored by one expression in one pass; nothing is joined.
    Ties go to the category that comes first; without any phrase it is ``feature`` with confidence 0.
    """
    low = F.lower("text")
    order = list(dict.fromkeys(c for c, *_ in sorted(signals, key=lambda s: s[1])))
    scores = {c: sum((F.when(F.contains(low, F.lit(p)), w).otherwise(0) for k, _, p, w in signals if k == c), F.lit(0)) for c in order}
    rows = prompts.select("id", *[F.coalesce(s, F.lit(0)).alias(f"s_{c}") for c, s in scores.items()])
    best = F.greatest(*[F.struct(F.col(f"s_{c}").alias("score"), F.lit(-i).alias("o"), F.lit(c).alias("category")) for i, c in enumerate(order)])
    total = sum((F.col(f"s_{c}") for c in order), F.lit(0))
    rows = rows.select("id", best.alias("b"), total.alias("total"))
    confidence = F.when(F.col("total") > 0, F.col("b.score") / F.col("total")).otherwise(0.0)
    return rows.select("id", F.when(F.col("b.score") > 0, F.col("b.category")).otherwise("feature").alias("category"), F.col("b.score").alias("score"), "total", confidence.alias("confidence"), (confidence >= CONFIDENCE_FLOOR).alias("sure"))


def intent_scores(prompts: DataFrame, signals: list[tuple[str, int, str, int]] = SIGNALS) -> DataFrame:
    """(id, category, score) of every category with a phrase in the prompt."""
    low = F.lower("text")
    order = list(dict.fromkeys(c for c, *_ in signals))
    per = F.array(*[F.struct(F.lit(c).alias("category"), F.coalesce(sum((F.when(F.contains(low, F.lit(p)), w).otherwise(0) for k, _, p, w in signals if k == c), F.lit(0)), F.lit(0)).alias("score")) for c in order])
    return prompts.select("id", F.explode(F.filter(per, lambda s: s["score"] > 0)).alias("s")).select("id", "s.category", "s.score")


def scope(mentioned: DataFrame) -> DataFrame:
    """(id, scope): unknown, single-file, package or cross-cutting, by the files a request names; ``mentioned``: id, path (null: none)."""
    per = mentioned.groupBy("id").agg(F.count_distinct("path").alias("n"), F.count_distinct(dir_name(F.col("path"))).alias("d"))
    return per.select("id", F.when(F.col("n") == 0, "unknown").when(F.col("n") == 1, "single-file").when(F.col("d") <= 1, "package").otherwise("cross-cutting").alias("scope"))


def risk(mentioned: DataFrame, importers: DataFrame) -> DataFrame:
    """(id, hubs, most, risk): low, medium or high by the hubs a request names; unknown without files."""
    one = mentioned.join(importers, "path", "left").groupBy("id").agg(F.count("path").alias("files"), F.count_if(F.coalesce("importers", F.lit(0)) >= HUB).alias("hubs"), F.coalesce(F.max("importers"), F.lit(0)).alias("most"))
    level = F.when(F.col("files") == 0, "unknown").when((F.col("hubs") >= 2) | (F.col("most") >= 8), "high").when(F.col("hubs") > 0, "medium").otherwise("low")
    return one.select("id", "hubs", "most", level.alias("risk"))


def suggestions(mentioned: DataFrame, importers: DataFrame, intent: DataFrame, most: int = 5) -> DataFrame:
    """(id, nth, kind, target): review hubs, check their dependents, run tests; ``mentioned`` has id, pos, path."""
    one = mentioned.filter(F.col("path").isNotNull()).join(importers, "path", "left").join(intent.select("id", "category"), "id")
    hub = F.coalesce("importers", F.lit(0)) >= HUB
    risky = F.col("category").isin("refactor", "feature")
    rows = one.filter(hub).select("id", "pos", F.lit(0).alias("o"), F.lit("review-hub").alias("kind"), F.col("path").alias("target"))
    rows = rows.unionByName(one.filter(hub & risky).select("id", "pos", F.lit(1).alias("o"), F.lit("check-deps").alias("kind"), F.col("path").alias("target")))
    first = one.groupBy("id", "category").agg(F.min_by("path", "pos").alias("path"))
    d = dir_name(F.col("path"))
    tests = first.filter(F.col("category").isin("bugfix", "refactor")).select("id", F.lit(1_000_000).alias("pos"), F.lit(2).alias("o"), F.lit("run-tests").alias("kind"), F.when((F.col("category") == "refactor") | (d == ""), ".").otherwise(d).alias("target"))
    nth = F.row_number().over(Window.partitionBy("id").orderBy("pos", "o"))
    return rows.unionByName(tests).withColumn("nth", nth).filter(F.col("nth") <= most).select("id", "nth", "kind", "target")


def routes(prompts: DataFrame, subsystems: list[tuple[str, list[str], list[str]]], most: int = 3) -> DataFrame:
    """(id, nth, subsystem, score): subsystems by the keywords and path hints a request holds; (id, keywords, paths) each."""
    low = F.lower("text")
    def points(words: list[str]):
        return sum((F.when(F.contains(low, F.lit(w.strip().lower())), 1).otherwise(0) for w in words if w.strip()), F.lit(0))
    per = F.array(*[F.struct((-points([*k, *p])).alias("m"), F.lit(s.strip() or "(unnamed)").alias("subsystem")) for s, k, p in subsystems])
    best = F.slice(F.array_sort(F.filter(per, lambda x: x["m"] < 0)), 1, most)
    return prompts.select("id", F.posexplode(best).alias("pos", "s")).select("id", (F.col("pos") + 1).alias("nth"), "s.subsystem", (-F.col("s.m")).alias("score"))


def skills(tasks: DataFrame, known: DataFrame, most: int = 3) -> DataFrame:
    """(id, nth, name, score, reason) of the skills that suit a task.

    ``tasks``: id, category, files, languages (arrays); ``known``: name, priority, keywords, languages,
    patterns (arrays), a short list. 3 for a keyword that is the category, 2 for each language, 1 for each
    pattern and file; a fifth of the priority is added where there is any.
    """
    t = tasks.select("id", "category", "files", F.col("languages").alias("speaks"))
    pairs = t.join(F.broadcast(known), F.lit(True))  # skills are a configured list of at most a few hundred
    by_word = F.filter("keywords", lambda k: F.lower(k) == F.lower("category"))
    by_lang = F.flatten(F.transform("speaks", lambda s: F.filter("languages", lambda x: F.lower(x) == F.lower(s))))
    by_path = F.flatten(F.transform("patterns", lambda p: F.filter("files", lambda f: skill_path(p, f))))
    points = 3 * F.size(by_word) + 2 * F.size(by_lang) + F.size(by_path)
    said = F.flatten(F.transform("speaks", lambda s: F.transform(F.filter("languages", lambda x: F.lower(x) == F.lower(s)), lambda _: F.concat(F.lit("language:"), s))))
    reason = F.array_join(F.concat(F.transform(by_word, lambda _: F.concat(F.lit("category:"), F.col("category"))), said, F.transform(by_path, lambda f: F.concat(F.lit("path:"), f))), ", ")
    scored = pairs.withColumn("points", points).filter(F.col("points") > 0).select("id", "name", (F.col("points") + F.floor(F.col("priority") / 5)).cast("int").alias("score"), reason.alias("reason"))
    nth = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "name"))
    return scored.withColumn("nth", nth).filter(F.col("nth") <= most).select("id", "nth", "name", "score", "reason")


def drift(commits: DataFrame, pairs: DataFrame, window: int = 10) -> DataFrame:
    """(subsystem, doc, code, behind): documents that changed longer ago than the code they describe.

    ``commits``: pos (0 the latest), path; ``pairs``: subsystem, doc, code, where code is a file or a directory
    ending in ``/``. Code without a commit in the window is left out; a document without one is ``window`` behind.
    """
    seen = commits.filter(F.col("pos") < window)
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/")))
    place = seen.select("pos", F.explode(F.when(F.size(parts) > 1, F.array_append(above, F.col("path"))).otherwise(F.array("path"))).alias("p")).groupBy("p").agg(F.min("pos").alias("pos"))
    one = pairs.join(place.select(F.col("p").alias("code"), F.col("pos").alias("c")), "code").join(place.select(F.col("p").alias("doc"), F.col("pos").alias("d")), "doc", "left")
    return one.filter(F.col("d").isNull() | (F.col("c") < F.col("d"))).select("subsystem", "doc", "code", F.coalesce(F.col("d") - F.col("c"), F.lit(window)).alias("behind"))


def next_steps(intent: DataFrame, mentioned: DataFrame, importers: DataFrame, most: int = 2) -> DataFrame:
    """(id, nth, step): views to open next, for sure categories only.

    First the importers of the named file with the most of them (the first named among equals), and the
    dependencies if it is a hub; then by category: the change for version control; the tree or the
    dependencies for exploring; the dependencies for refactoring; the tree and the dependencies for a feature;
    the change, or around a hub the dependencies, for a bug. ``mentioned``: id, pos, path (null: none).
    """
    n = F.coalesce("importers", F.lit(0))
    top = mentioned.filter(F.col("path").isNotNull()).join(importers, "path", "left").groupBy("id").agg(F.max_by(F.struct("path", n.alias("n")), F.struct(n.alias("n"), -F.col("pos"))).alias("t"))
    one = intent.filter("sure").select("id", "category").join(top, "id", "left")
    file, c = F.col("t.path"), F.col("category")
    some, hub = file.isNotNull(), F.coalesce(F.col("t.n") >= HUB, F.lit(False))
    deps, diff, tree = F.lit("dependencies"), F.lit("change"), F.lit("structure")
    steps = F.array(
        F.when(some, F.concat(F.lit("importers of "), file)), F.when(hub, deps), F.when(c == "vcs", diff), F.when(c == "explore", F.when(some, deps).otherwise(tree)), F.when(c == "refactor", deps),
        F.when((c == "feature") & ~some, tree), F.when(c == "feature", deps), F.when(c == "bugfix", F.when(~some, diff).when(hub, deps)),
    )
    kept = F.slice(F.array_distinct(F.filter(steps, lambda s: s.isNotNull())), 1, most)
    return one.select("id", F.posexplode(kept).alias("pos", "step")).select("id", (F.col("pos") + 1).alias("nth"), "step")
