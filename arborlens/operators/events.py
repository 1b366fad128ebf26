"""Raw edit events and agent histories made sound: one spelling, one shape, unusable rows left out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The operations an event can have.
OPERATIONS = ("CREATE", "WRITE", "REMOVE", "RENAME")


def with_sound_op(events: DataFrame) -> DataFrame:
    """Rows with a ``ts`` and a known operation, ``op`` in plain upper case. Others, nulls too, are left out."""
    # most are plain already; the filter computes the column a second time
    op = F.when(F.col("op").isin(*OPERATIONS), F.col("op")).otherwise(F.upper(F.regexp_replace("op", r"^\s+|\s+$", "")))
    return events.withColumn("op", op).filter(F.col("ts").isNotNull() & F.col("op").isin(*OPERATIONS))


def agents(history: Column) -> Column:
    """A hand-off's agent history, JSON in several shapes, as an array of entries; unreadable text gives null.

    A list stays a list, one entry becomes a list of it, and either may be wrapped once more as a JSON string.
    An edited file is its path or an object with path and edits. Null entries and null files stay null.
    """

    def some(v: Column) -> Column:
        return F.when(~F.is_variant_null(v), v)

    def kind(v: Column) -> Column:
        return F.schema_of_variant(v)

    def items(v: Column, of: Callable[[Column], Column]) -> Column:
        return F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.when(some(x).isNotNull(), of(x)))

    def text(v: Column, name: str) -> Column:
        return F.try_variant_get(v, f"$.{name}", "string")

    def edit(v: Column) -> Column:
        return F.struct(F.try_variant_get(v, "$.line", "bigint").alias("line"), F.try_variant_get(v, "$.delta", "bigint").alias("delta"))

    def file(v: Column) -> Column:
        bare = kind(v) == "STRING"
        return F.struct(F.when(bare, F.try_variant_get(v, "$", "string")).otherwise(text(v, "path")).alias("path"), F.when(~bare, items(F.try_variant_get(v, "$.edits", "variant"), edit)).alias("edits"))

    def entry(v: Column) -> Column:
        return F.struct(
            text(v, "agent_id").alias("agent_id"), text(v, "started_at").alias("started_at"), text(v, "ended_at").alias("ended_at"), text(v, "summary").alias("summary"),
            items(F.try_variant_get(v, "$.files_edited", "variant"), file).alias("files_edited"),
        )

    v = F.try_parse_json(history)
    v = F.when(kind(v) == "STRING", F.try_parse_json(F.try_variant_get(v, "$", "string"))).otherwise(v)
    return F.when(kind(v).startswith("OBJECT"), F.array(entry(v))).when(kind(v).startswith("ARRAY"), items(v, entry))
