"""How much of a tree its sources have told: never more than they know."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statuses of a source that told anything.
USABLE = ("authoritative", "fallback", "mixed")


def reduced(sources: DataFrame, key: list[str]) -> DataFrame:
    """(key, status): complete if all sources are authoritative, partial if any is usable, else unavailable.

    ``sources``: key, status; a key with a null status only has no source and is unavailable.
    """
    s = F.col("status")
    one = sources.groupBy(*key).agg(F.count(s).alias("n"), F.bool_and(s == "authoritative").alias("all"), F.bool_or(s.isin(*USABLE)).alias("some"))
    return one.select(*key, F.when((F.col("n") > 0) & F.col("all"), "complete").when(F.col("some"), "partial").otherwise("unavailable").alias("status"))


def folded(statuses: Column) -> Column:
    """The status after sources were recorded one by one; '' means complete.

    Authoritative sources alone leave ''; one that comes after unavailable ones makes it partial. Usable
    others make it partial, the rest unavailable as long as nothing usable was recorded.
    """

    def step(state: Column, s: Column) -> Column:
        usable = state["usable"] | s.isin(*USABLE)
        status = (
            F.when(s == "authoritative", F.when(state["status"] == "unavailable", "partial").otherwise(state["status"]))
            .when(s.isin("fallback", "mixed"), "partial")
            .otherwise(F.when(usable, "partial").otherwise("unavailable"))
        )
        return F.struct(status.alias("status"), usable.alias("usable"))

    start = F.struct(F.lit("").alias("status"), F.lit(False).alias("usable"))
    return F.aggregate(F.coalesce(statuses, F.array().cast("array<string>")), start, step, lambda s: s["status"])


def recorded(sources: DataFrame, key: list[str]) -> DataFrame:
    """(key, status): what :func:`folded` gives for all sources of each key, without a list of them.

    It ends at '' if all are authoritative, at unavailable if none is usable, else at partial, in whatever order they
    are recorded: partial never changes again, and unavailable only lasts until a usable source comes.
    """
    s = F.col("status")
    one = sources.groupBy(*key).agg(F.bool_and(F.coalesce(s == "authoritative", F.lit(False))).alias("all"), F.bool_or(F.coalesce(s.isin(*USABLE), F.lit(False))).alias("some"))
    return one.select(*key, F.when(F.col("all"), "").when(F.col("some"), "partial").otherwise("unavailable").alias("status"))


def merged(outcome: DataFrame, fallback: DataFrame, key: list[str]) -> DataFrame:
    """(key, status, detail): an outcome with that of the source that stood in for it.

    A fallback that told anything makes what was not authoritative ``mixed`` if something was told before and
    ``fallback`` if nothing was; one that told nothing changes nothing. Details of both are kept.
    """
    two = fallback.select(*key, F.col("status").alias("f"), F.col("detail").alias("g"))
    both = outcome.select(*key, "status", "detail").join(two, list(key), "full")
    helped, had = F.coalesce(F.col("f").isin(*USABLE), F.lit(False)), F.coalesce(F.col("status").isin(*USABLE), F.lit(False))
    status = F.when(~helped | (F.coalesce("status", F.lit("")) == "authoritative"), F.coalesce("status", "f")).when(had, "mixed").otherwise("fallback")
    return both.select(*key, status.alias("status"), F.concat_ws("; ", F.nullif("detail", F.lit("")), F.nullif("g", F.lit(""))).alias("detail"))


def notes(sources: DataFrame, key: list[str]) -> DataFrame:
    """(key, notes): details in order of record, each once."""
    rows = sources.filter(F.coalesce("detail", F.lit("")) != "").groupBy(*key, "detail").agg(F.min("seq").alias("seq"))
    return rows.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "detail"))), lambda x: x["detail"]).alias("notes"))
