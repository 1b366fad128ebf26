"""Results for every key where a few keys hold most rows.

Rows are first combined to one state a (key, member), in each task before anything is shuffled, so that a pair that
holds most rows costs one row a task. The states are range partitioned on (key, member) by sampled quantiles: a
heavy key's members lie in as many partitions as its share of the pairs asks for. Each partition then holds one
partial state of a key; where a key crosses an edge between partitions, its states are stitched by a last aggregation
over one row a key and partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pair_ranges(rows: DataFrame, key: Sequence[str], member: str, extra: dict[str, Column] | None = None, named: bool = False) -> DataFrame:
    """(key, member, rows, extra): one state a pair, in ranges of (key, member) of about equal numbers of pairs.

    What is computed for the pairs is shuffled once, so that the sampling of the bounds does not compute it again.
    ``named``: without pairs whose member is null; they are left out behind the aggregation, where the member is computed already.
    """
    pairs = rows.groupBy(*key, member).agg(F.count(F.lit(1)).alias("rows"), F.count(member).alias("__named"), *[c.alias(n) for n, c in (extra or {}).items()])
    pairs = (pairs.filter(F.col("__named") > 0) if named else pairs).drop("__named")
    return pairs.repartitionByRange(*[F.col(k) for k in key], F.col(member))


def distinct_members(rows: DataFrame, key: Sequence[str], member: str, extra: dict[str, Column] | None = None, named: bool = False) -> DataFrame:
    """(key, rows, members): of each key its rows and its distinct non-null members.

    ``extra`` names further aggregates of rows as (column over the rows of one pair, e.g. ``F.max("x")``);
    they are taken for each pair first and then by ``max`` for each key. Keys with no member but null have
    0 members; null keys form a key of their own; an empty input gives no rows. Nothing is sampled but
    the bounds of the ranges, and these do not change the result. ``named``: rows with a null member do not count.
    """
    extra = extra or {}
    return pair_ranges(rows, key, member, extra, named).groupBy(*key).agg(F.sum("rows").alias("rows"), F.count(member).alias("members"), *[F.max(n).alias(n) for n in extra])


def heavy_keys(rows: DataFrame, key: Sequence[str], member: str, share: float) -> DataFrame:
    """Of :func:`distinct_members` the keys that hold at least ``share`` of all pairs, with their ``share``."""
    counts = distinct_members(rows, key, member, named=True)
    total = counts.agg(F.sum("members").alias("total"))
    # one row: the sum of all counts
    return counts.join(F.broadcast(total), counts["members"] >= F.lit(share) * total["total"]).select(*key, "rows", "members", (F.col("members") / F.col("total")).alias("share"))
