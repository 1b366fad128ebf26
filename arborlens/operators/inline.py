"""Nested records as related flat tables, by shared inlining.

The schema is read as a graph whose nodes are named shapes: a struct with one parent is inlined into the parent's
table, with its fields under dotted names; an element that repeats (array, map) gets a table of its own, and
so does one that is shared, that is, has several parents by the same name and with the same fields, repeated or
not: its rows lie in one table and tell their parent. A struct that contains its own shape again (recursion as far as
the schema writes it out) shares its table in the same way. Rows of a child table carry the key of the record, the
positions of all enclosing entries (``outer_pos`` is the innermost, -1 at the top) and their own ``pos``, 0 for one that does not repeat.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Repeated:
    """A repeated element: where it hangs and what its table holds."""

    table: str
    parent: str
    steps: tuple[str, ...]
    element: T.DataType
    kind: str = "array"
    columns: dict[str, tuple[str, ...]] = field(default_factory=dict)
    depth: int = 0
    up: int = -1  # the place of what it hangs on in the list of elements, -1 for the record


def shared_shapes(schema: T.StructType) -> set[tuple[str, str]]:
    """(name, shape) of the structs that several parents have; each node of the graph is looked into once."""
    parents: dict[tuple[str, str], int] = defaultdict(int)
    todo = [schema]
    while todo:
        for f in todo.pop().fields:
            kind = f.dataType
            while isinstance(kind, (T.ArrayType, T.MapType)):
                kind = kind.valueType if isinstance(kind, T.MapType) else kind.elementType
            if isinstance(kind, T.StructType):
                node = (f.name, kind.simpleString())
                parents[node] += 1
                if parents[node] == 1:
                    todo.append(kind)
    return {node for node, n in parents.items() if n > 1}


def _inline(kind: T.StructType, at: tuple[str, ...], columns: dict, own: list, shared: set) -> None:
    for f in kind.fields:
        here = (*at, f.name)
        if isinstance(f.dataType, T.StructType) and (f.name, f.dataType.simpleString()) not in shared:
            _inline(f.dataType, here, columns, own, shared)
        elif isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            own.append((here, f.dataType))
        else:
            name = ".".join(here)
            while name in columns:  # a name with a dot that is also a field of a struct
                name += "_"
            columns[name] = here


def schema_graph(schema: T.StructType, root: str) -> tuple[dict[str, tuple[str, ...]], list[Repeated]]:
    """The root's inlined columns and every repeated or shared element, outermost first.

    Tables have the name of their field. Fields of one name share a table if their elements are alike;
    otherwise the later one has its parent's name in front, and a number behind if that is taken.
    """
    columns: dict = {}
    todo: list = []
    shared = shared_shapes(schema)
    _inline(schema, (), columns, todo, shared)
    todo = [(root, -1, 0, steps, kind) for steps, kind in todo]
    out: list[Repeated] = []
    shapes: dict[str, str] = {root: ""}
    while todo:
        parent, up, depth, steps, kind = todo.pop(0)
        how = "map" if isinstance(kind, T.MapType) else "single" if isinstance(kind, T.StructType) else "array"
        element = kind if how == "single" else kind.elementType if how == "array" else T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])
        shape = element.simpleString()
        own = steps[-1] if steps else "item"
        name, n = own, 1
        while shapes.setdefault(name, shape) != shape:
            name = f"{parent}_{own}" if n == 1 else f"{parent}_{own}_{n}"
            n += 1
        node = Repeated(name, parent, steps, element, how, depth=depth, up=up)
        inner: list = []
        if isinstance(element, T.StructType):
            _inline(element, (), node.columns, inner, shared)
        elif isinstance(element, (T.ArrayType, T.MapType)):
            inner.append(((), element))
        else:
            node.columns["value"] = ()
        out.append(node)
        todo += [(name, len(out) - 1, depth + 1, s, k) for s, k in inner]
    return columns, out


def _get(at: Column, steps: tuple[str, ...]) -> Column:
    for s in steps:
        at = at[s]
    return at


def flatten(df: DataFrame, key: list[str], root: str) -> dict[str, DataFrame]:
    """The flat tables of ``df`` by name; the ``root`` table has the inlined columns of each record.

    Children: key, ``parent_table``, ``places`` (positions of the enclosing entries, outermost first),
    ``outer_pos``, ``pos`` and the inlined columns; a column that has one of these names gets ``item.`` in front. Elements that are null have no row but count in positions;
    null or empty arrays and structs give no child rows. Records with a null key keep it. ``df`` is read once for each
    table, of which each reads the columns it needs only: give a table, not a computation.
    """
    columns, nodes = schema_graph(T.StructType([f for f in df.schema.fields if f.name not in key]), root)
    out = {root: df.select(*key, *[_get(F.col(f"`{s[0]}`"), s[1:]).alias(n) for n, s in columns.items()])}
    made: dict[str, list[DataFrame]] = defaultdict(list)
    entries = {-1: df.select(*key, F.array().cast("array<int>").alias("__path"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__entry"))}
    for place, node in enumerate(nodes):
        up = entries[node.up]
        many = _get(F.col("__entry"), node.steps)
        if node.kind != "array":
            many = F.map_entries(many) if node.kind == "map" else F.when(many.isNotNull(), F.array(many))
        rows = up.select(*key, "__path", F.posexplode(many).alias("pos", "__item")).filter(F.col("__item").isNotNull())
        taken = {*key, "parent_table", "places", "outer_pos", "pos"}
        cols = [(_get(F.col("__item"), s) if s else F.col("__item")).alias("item." * (n in taken) + n) for n, s in node.columns.items()]
        outer = F.coalesce(F.try_element_at("__path", F.lit(-1)), F.lit(-1))
        made[node.table].append(rows.select(*key, F.lit(node.parent).alias("parent_table"), F.col("__path").alias("places"), outer.alias("outer_pos"), "pos", *cols))
        entries[place] = rows.select(*key, F.array_append("__path", F.col("pos")).alias("__path"), F.col("__item").alias("__entry"))
    for name, frames in made.items():
        whole = frames[0]
        for more in frames[1:]:
            whole = whole.unionByName(more)
        out[name] = whole
    return out


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of rows with one key the one that is last by ``order`` (null first), then by its content."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    content = F.to_json(row) if "map<" in df.schema.simpleString() else row  # maps have no hash
    picked = df.groupBy(*key).agg(F.max_by(row, F.struct(*order, F.xxhash64(content))).alias("__row"))
    return picked.select("__row.*")
