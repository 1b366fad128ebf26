"""Schemas that drift between files: what each file holds, what changed, and one table of all records.

A file's schema is a tree: names below a parent, each with the set of JSON types found there. The change from
one tree to the next is the cheapest script of the tree edit distance for unordered, named trees, top down:
adding or removing a field costs one for it and for each field below it, renaming it or changing its type one and
whatever its inside costs. A path that both trees have is one field; of the others below one parent, those of
equal types are paired by a minimum-cost assignment. A cheapest script may rest on a choice between equals, so a
rename is told only where no other pairing is possible; else it counts as the removal and addition it replaces.
Optionally a subtree that reappears under another parent, name and content unchanged, becomes one move.

Scripts of a lineage's files compose: what a file's paths were called first is a map of path prefixes, found for all
files in one scan of ordered ranges. Compiled to a trie, a file's map is the projection of each of its records.

Inside this module paths are escaped (``\\`` before ``.``, ``[`` and ``\\`` in a name, ``\\e`` for an empty name), so that
names with dots are fields like others; results show them as they are.
"""

from __future__ import annotations

import json
import re
import sys
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlens.operators.ranged import PART, differs, in_ranges, scan, shifted, with_previous
from arborlens.scratch import cut

_KINDS = {str: "string", bool: "boolean", int: "number", float: "number", list: "array", dict: "object"}
_STEP = re.compile(r"\[\]|(?:\\.|[^.\[\\])+", re.S)


def _reject(text: str):
    raise ValueError(text)


def read_json(text: str | None):
    """The value of a text that is whole JSON and an object, else None."""
    try:
        value = json.loads(text, parse_constant=_reject) if text is not None else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


@lru_cache(maxsize=65_536)
def escaped(name: str) -> str:
    """A name as one step of a path."""
    if not name:
        return "\\e"
    return name if name.isalnum() else re.sub(r"([.\[\\])", r"\\\1", name)


def shown(path: str) -> str:
    """A path as results have it."""
    return re.sub(r"\\(.)", lambda m: "" if m[1] == "e" else m[1], path, flags=re.S) if "\\" in path else path


def parts(path: str) -> list[str]:
    """A path as a list of its steps: escaped names and ``[]``."""
    return _STEP.findall(path)


def joined(steps: list[str]) -> str:
    """The path of some steps."""
    return "".join(s if s == "[]" or not i else "." + s for i, s in enumerate(steps))


def parent(path: str) -> str:
    """The path one level up; '' for a name at the top."""
    if "\\" in path:
        return joined(parts(path)[:-1])
    return path[:-2] if path.endswith("[]") else path.rpartition(".")[0]


def last(path: str) -> str:
    """The last step of a path."""
    if "\\" in path:
        return parts(path)[-1]
    return "[]" if path.endswith("[]") else path.rpartition(".")[2]


def typed_paths(value, at: str = "", found: set[tuple[str, str]] | None = None) -> set[tuple[str, str]]:
    """(path, type) of every value other than null below an object or array."""
    found = set() if found is None else found
    todo = [(at, value)]
    while todo:
        at, v = todo.pop()
        inner = [(f"{at}.{escaped(k)}" if at else escaped(k), x) for k, x in v.items()] if isinstance(v, dict) else [(at + "[]", x) for x in v]
        for path, x in inner:
            if x is not None:
                found.add((path, _KINDS[type(x)]))
                if isinstance(x, (dict, list)):
                    todo.append((path, x))
    return found


def assigned(cost: np.ndarray) -> list[int]:
    """Of a square matrix the column of each row in an assignment of least sum (successive shortest paths with potentials)."""
    n = len(cost)
    row_of, u, v = np.full(n + 1, -1), np.zeros(n), np.zeros(n + 1)
    for i in range(n):
        row_of[n], j = i, n
        least, way, done = np.full(n, np.inf), np.full(n, n), np.zeros(n + 1, bool)
        while row_of[j] >= 0:
            done[j] = True
            r = row_of[j]
            reach = cost[r] - u[r] - v[:n]
            closer = ~done[:n] & (reach < least)
            least[closer], way[closer] = reach[closer], j
            nxt = int(np.argmin(np.where(done[:n], np.inf, least)))
            step = least[nxt]
            u[row_of[done]] += step
            v[done] -= step
            least[~done[:n]] -= step
            j = nxt
        while j != n:
            row_of[j], j = row_of[way[j]], way[j]
    out = [0] * n
    for j in range(n):
        out[row_of[j]] = j
    return out


class _Schema:
    """A schema as a tree: types, children and number of fields of each path."""

    def __init__(self, kinds: dict[str, str]) -> None:
        self.kinds, self.kids = kinds, defaultdict(list)
        for p in sorted(kinds):
            self.kids[parent(p)].append(p)
        self._size: dict[str, int] = {}

    def size(self, path: str) -> int:
        """Fields of the subtree."""
        if path not in self._size:
            self._size[path] = 1 + sum(self.size(k) for k in self.kids.get(path, ()))
        return self._size[path]

    def shape(self, path: str) -> tuple:
        """What a subtree is, its place apart: the last name and all below with their types."""
        out, todo = [], [path]
        while todo:
            q = todo.pop()
            out.append((q[len(path) :], self.kinds[q]))
            todo += self.kids.get(q, ())
        return last(path), tuple(sorted(out))


class _Script:
    """The cheapest script between two trees; distances of subtrees are found once."""

    def __init__(self, old: dict[str, str], new: dict[str, str]) -> None:
        self.old, self.new = _Schema(old), _Schema(new)
        self.known: dict[tuple[str, str], int] = {}

    def below(self, a: str, z: str, told: list | None = None) -> int:
        """The cost of turning what lies below ``a`` into what lies below ``z``; ``told`` gets the pairs and leftovers of this level."""
        if told is None and (a, z) in self.known:
            return self.known[a, z]
        was = {last(p): p for p in self.old.kids.get(a, ())}
        now = {last(p): p for p in self.new.kids.get(z, ())}
        total = 0
        for name in was.keys() & now.keys():
            p, q = was[name], now[name]
            same = self.old.kinds[p] == self.new.kinds[q]
            if told is not None:
                told.append(("same" if same else "retyped", p, q, True))
            if told is None or not same:
                total += (not same) + self.below(p, q)
        goes, comes = defaultdict(list), defaultdict(list)
        for name in was.keys() - now.keys():
            goes[self.old.kinds[was[name]]].append(was[name])
        for name in now.keys() - was.keys():
            comes[self.new.kinds[now[name]]].append(now[name])
        for kind in sorted(goes.keys() | comes.keys()):
            left, right = sorted(goes[kind]), sorted(comes[kind])
            only = len(left) == len(right) == 1
            for p, q, cost in self.pairs(left, right):
                total += cost
                if told is not None:
                    told.append(("renamed" if p and q else "removed" if p else "added", p, q, only))
        if told is None:
            self.known[a, z] = total
        return total

    def pairs(self, left: list[str], right: list[str]) -> list[tuple[str, str, int]]:
        """(goes, comes, cost) of the cheapest pairing of fields of equal types; '' stands for none."""
        n, m = len(left), len(right)
        if not n or not m:
            return [(p, "", self.old.size(p)) for p in left] + [("", q, self.new.size(q)) for q in right]
        if not any(self.old.kids.get(p) for p in left) and not any(self.new.kids.get(q) for q in right):  # nothing below: all pairs cost the same
            k = min(n, m)
            return [(left[i], right[i], 1) for i in range(k)] + [(p, "", 1) for p in left[k:]] + [("", q, 1) for q in right[k:]]
        cost = np.full((n + m, n + m), 1e12)
        for i, p in enumerate(left):
            cost[i, :m] = [1 + self.below(p, q) for q in right]
            cost[i, m + i] = self.old.size(p)
        for j, q in enumerate(right):
            cost[n + j, j] = self.new.size(q)
        cost[n:, m:] = 0
        out = []
        for i, j in enumerate(assigned(cost)):
            if i < n or j < m:
                out.append((left[i] if i < n else "", right[j] if j < m else "", int(cost[i, j])))
        return out


def distance(old: dict[str, str], new: dict[str, str]) -> int:
    """The cost of the cheapest script."""
    return _Script(old, new).below("", "")


def edit_script(old: dict[str, str], new: dict[str, str], moves: bool = False) -> list[tuple[str, str, str]]:
    """(kind, old path, new path) that turns one schema into the other; schemas map a path to its types.

    The cheapest script, but for renames that rest on a choice, which are told as removal and addition. Nothing
    is told below a path that is told itself.
    """
    if old == new:
        return []
    if sys.getrecursionlimit() < 20_000:
        sys.setrecursionlimit(20_000)  # as deep as JSON may be nested
    work, script, todo = _Script(old, new), [], [("", "")]
    while todo:
        told: list = []
        work.below(*todo.pop(), told)
        for kind, p, q, only in told:
            if kind == "same":
                todo.append((p, q))
            elif kind == "renamed" and not only:
                script += [("removed", p, ""), ("added", "", q)]
            else:
                script.append((kind, p, q))
    if moves:
        left, come = defaultdict(list), defaultdict(list)
        for s in script:
            if s[0] == "removed":
                left[work.old.shape(s[1])].append(s)
            elif s[0] == "added":
                come[work.new.shape(s[2])].append(s)
        for what, a in left.items():
            if len(a) == len(b := come.get(what, [])) == 1:
                script = [s for s in script if s not in (a[0], b[0])] + [("moved", a[0][1], b[0][2])]
    return sorted(script)


def file_schemas(raw: DataFrame, lineage: str, file: str, written: str, payload: str) -> DataFrame:
    """(lineage, file, written, schema) of each file with a readable record; schema is a list of "path, types".

    Each batch of records is reduced to its distinct paths and types before anything is shuffled, so that
    a file with very many records costs one set a batch.
    """
    kinds = {f.name: f.dataType.simpleString() for f in raw.schema}
    schema = f"`{lineage}` {kinds[lineage]}, `{file}` {kinds[file]}, written {kinds[written]}, path string, kind string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[tuple, set] = {}
            for ln, fl, at, text in zip(*(c.to_pylist() for c in b.columns)):
                value = read_json(text)
                if value is not None:
                    typed_paths(value, found=found.setdefault((ln, fl, at), {("", "object")}))
            rows = [(*k, p, t) for k, s in found.items() for p, t in s]
            types = [b.schema.field(0).type, b.schema.field(1).type, b.schema.field(2).type, pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[lineage, file, "written", "path", "kind"])

    found = raw.select(lineage, file, written, payload).mapInArrow(work, schema)
    # one row a file and path, then one a file: as long as its schema, however many records it has
    types = found.groupBy(lineage, file, "path").agg(F.min("written").alias("written"), F.array_join(F.array_sort(F.collect_set("kind")), "|").alias("kinds"))
    return types.groupBy(lineage, file).agg(F.min("written").alias("written"), F.collect_list(F.when(F.col("path") != "", F.struct("path", "kinds"))).alias("schema"))


def file_scripts(raw: DataFrame, lineage: str, file: str, written: str, payload: str, moves: bool = False) -> DataFrame:
    """(lineage, file, written, script): what each file changes against the one before, in escaped paths.

    Files of a lineage are ordered by their (earliest) time of writing, null first, then by name; the script of the
    first is empty. Payloads that are not whole JSON objects, null and empty ones too, are left out, and
    with them files that hold no other. Null lineages form a lineage; an empty input gives no rows.
    """
    files = with_previous(file_schemas(raw, lineage, file, written, payload), [lineage], ["written", file], ["schema"])
    kinds = {f.name: f.dataType.simpleString() for f in files.schema}
    schema = f"`{lineage}` {kinds[lineage]}, `{file}` {kinds[file]}, written {kinds['written']}, script array<struct<change_kind:string,old_path:string,new_path:string>>"
    step = pa.list_(pa.struct([(n, pa.string()) for n in ("change_kind", "old_path", "new_path")]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for now, was, follows in zip(*(c.to_pylist() for c in b.columns[3:])):
                script = edit_script(*({x["path"]: x["kinds"] for x in s} for s in (was, now)), moves) if follows else []
                made.append([{"change_kind": kind, "old_path": p, "new_path": q} for kind, p, q in script])
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(made, step)], names=[lineage, file, "written", "script"])

    return files.select(lineage, file, "written", "schema", "prev_schema", "has_prev").mapInArrow(work, schema)


def schema_changes(raw: DataFrame, lineage: str, file: str, written: str, payload: str, moves: bool = False) -> DataFrame:
    """(lineage, file, written, change_kind, old_path, new_path): the scripts of :func:`file_scripts`, a row a change, paths as they are."""
    bare = lambda c: F.when(F.contains(c, F.lit("\\")), F.regexp_replace(F.regexp_replace(c, r"((?:^|[^\\])(?:\\{2})*)\\e", "$1"), r"\\(.)", "$1")).otherwise(c)
    one = file_scripts(raw, lineage, file, written, payload, moves).select(lineage, file, "written", F.explode("script").alias("s"))
    return one.select(lineage, file, "written", "s.change_kind", bare(F.col("s.old_path")).alias("old_path"), bare(F.col("s.new_path")).alias("new_path"))


# first names: a map of path prefixes, path now -> "=" and the path then, or "+" and the first name of what came since


def _under(path: str, top: str) -> bool:
    return path == top or path.startswith((top + ".", top + "[]"))


def _then(names: dict[str, str], path: str) -> str:
    """What a path was called, by its longest prefix that the map knows."""
    steps = parts(path)
    for n in range(len(steps), 0, -1):
        was = names.get(joined(steps[:n]))
        if was is not None:
            return was[0] + joined(parts(was[1:]) + steps[n:])
    return "=" + path


def after(names: dict[str, str], script: list[tuple[str, str, str]]) -> dict[str, str]:
    """The map behind a file, from the map before it and the file's script."""
    if not script:
        return names
    out = {k: v for k, v in names.items() if not any(s[1] and s[0] != "retyped" and _under(k, s[1]) for s in script)}
    for kind, p, q in script:
        if kind == "added":
            out[q] = "+" + q
        elif kind in ("renamed", "moved"):
            out.update({q + k[len(p) :]: v for k, v in names.items() if _under(k, p)})
            out[q] = _then(names, p)
    return out


def behind(before: dict[str, str], names: dict[str, str]) -> dict[str, str]:
    """``names``, whose "then" is a later time, carried on to the "then" of ``before``."""
    out = {k: v if v[0] == "+" else _then(before, v[1:]) for k, v in names.items()}
    took = [(k, v[1:]) for k, v in names.items() if v[0] == "="]
    for k, v in before.items():  # what the later map leaves as it is, or takes along in a subtree
        for now in [k, *(top + k[len(was) :] for top, was in took if k != was and _under(k, was))]:
            if now not in out and _then(names, now) == "=" + k:
                out[now] = v
    return out


def first_names(scripts: DataFrame, lineage: str, file: str) -> DataFrame:
    """(lineage, file, names): of each file the first name of every path that had another.

    ``scripts``: :func:`file_scripts`. Files are read in ranges of (lineage, written, file), so that a
    lineage with very many files is read by many tasks; maps of ranges are composed from one row a range.
    """
    kinds = {f.name: f.dataType.simpleString() for f in scripts.schema}
    files = in_ranges(scripts, [lineage, "written", file]).select(lineage, file, "script")
    schema = f"`{lineage}` {kinds[lineage]}, `{file}` {kinds[file]}, names map<string,string>, {PART} int, opening boolean, nth bigint"
    names_type = pa.map_(pa.string(), pa.string())

    def work(part: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, names, opening, n = None, {}, True, 0
        for b in batches:
            if not b.num_rows:
                continue
            fresh = differs(b.column(0), shifted(b.column(0), last)).to_pylist()
            made, opens = [], []
            for i, (new, todo) in enumerate(zip(fresh, b.column(2).to_pylist())):
                if new and (n or i):
                    names, opening = {}, False
                names = after(names, [(s["change_kind"], s["old_path"], s["new_path"]) for s in todo])
                made.append(list(names.items()))
                opens.append(opening)
            last, at = b.column(0).slice(b.num_rows - 1), n
            n += b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, names_type), pa.array([part] * b.num_rows, pa.int32()), pa.array(opens), pa.array(range(at, n), pa.int64())], names=[lineage, file, "names", PART, "opening", "nth"])

    table = cut(scan(files, work, schema), "names")
    # one row a range: its last lineage, that lineage's map, and whether the range holds no other
    ends = table.groupBy(PART).agg(F.max_by(F.struct(F.col(lineage).alias("l"), "names", "opening"), "nth").alias("z"), F.min_by(F.struct(F.col(lineage).alias("l")), "nth").alias("a"))
    carried: dict[int, dict] = {}
    at, names = None, {}
    for r in sorted(ends.collect(), key=lambda r: r[PART]):
        goes_on = at is not None and at[0] == r["a"]["l"]
        if goes_on and names:
            carried[r[PART]] = names
        here = dict(r["z"]["names"])
        names = behind(names, here) if goes_on and r["z"]["opening"] else here
        at = (r["z"]["l"],)
    before = scripts.sparkSession.sparkContext.broadcast(carried)  # at most one map a range, each bounded by a schema

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for names, part, opening in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
                whole = behind(before.value[part], dict(names)) if opening and part in before.value else dict(names)
                made.append([(k, v[1:]) for k, v in whole.items() if k != v[1:]])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, names_type)], names=[lineage, file, "names"])

    return table.select(lineage, file, "names", PART, "opening").mapInArrow(stitch, f"`{lineage}` {kinds[lineage]}, `{file}` {kinds[file]}, names map<string,string>")


class Projection:
    """A file's map compiled: each name below a parent with the place its value has in the table."""

    def __init__(self, names: list[tuple[str, str]]) -> None:
        self.top: dict = {}
        for path, place in names:
            node = self.top
            for s in parts(path):
                node = node.setdefault(s, {})
            node[""] = parts(place)  # no step is empty

    def fields(self, record: dict) -> tuple[dict[str, str], dict[str, str]]:
        """(fields, conflicts): values by place; a value whose place another holds is a conflict, under its own path."""
        out: dict[str, str] = {}
        other: dict[str, str] = {}
        late = []
        todo = [(record, self.top, [], [])]
        while todo:
            value, node, own, place = todo.pop()
            for k, x in reversed(value.items()):
                if x is None:
                    continue
                k = escaped(k)
                inner = node.get(k, {})
                at = inner.get("", [*place, k])
                if isinstance(x, dict):
                    todo.append((x, inner, [*own, k], at))
                else:
                    late.append((at != [*own, k], joined([*own, k]), joined(at), x if isinstance(x, str) else json.dumps(self.element(x, inner.get("[]"), [*at, "[]"]) if isinstance(x, list) and inner else x)))
        # fields that were here first, under whatever name, before those that came later with a name once theirs
        for _, own, at, text in sorted(late, key=lambda r: not r[0]):
            if shown(at) not in out:
                out[shown(at)] = text
            else:
                n, key = 1, shown(own)
                while key in other:
                    n, key = n + 1, f"{shown(own)}#{n + 1}"
                other[key] = text
        return dict(sorted(out.items())), other

    def element(self, value, node: dict | None, place: list[str]):
        """A value inside an array, its fields under their first names; ``place``: where the value itself lies."""
        if not node:
            return value
        if isinstance(value, list):
            return [self.element(x, node, place) if isinstance(x, dict) else self.element(x, node.get("[]"), [*place, "[]"]) for x in value]
        if not isinstance(value, dict):
            return value
        out: dict = {}
        late = []
        for k, x in value.items():
            inner = node.get(escaped(k), {})
            at = inner.get("", [*place, escaped(k)])
            if at[: len(place)] != place or len(at) == len(place) or "[]" in at[len(place) :]:
                at = [*place, escaped(k)]  # outside of this element: it stays where it is
            late.append((at[len(place) :], k, self.element(x, inner.get("[]") if isinstance(x, list) else inner, [*at, "[]"] if isinstance(x, list) else at)))
        for steps, k, x in sorted(late, key=lambda r: [shown(s) for s in r[0]] == [r[1]]):
            into = out
            for s in steps[:-1]:
                into = into.setdefault(shown(s), {}) if isinstance(into, dict) else None
            if isinstance(into, dict) and shown(steps[-1]) not in into:
                into[shown(steps[-1])] = x
            else:
                n, key = 1, k
                while key in out:
                    n, key = n + 1, f"{k}#{n + 1}"
                out[key] = x
        return {shown(escaped(k)): out[k] for k in [*(k for k in value if k in out), *(k for k in out if k not in value)]}


def conform(raw: DataFrame, scripts: DataFrame, lineage: str, file: str, payload: str, keep: list[str]) -> DataFrame:
    """All readable records in one schema: ``keep``, lineage, file, ``fields`` and ``conflicts``, maps of field path to value.

    Fields that files rename or move have the first name they had in their lineage: the scripts of
    all files up to the record's are composed and compiled to a projection a file. Values are text, arrays JSON, so
    that a field that changes its type stays one column; null fields are left out. A value whose place is taken in
    its record goes to ``conflicts`` under its own path (in an array's element: stays under its name, or gets a number).
    Records that cannot be read are left out. ``scripts``: :func:`file_scripts` of these records.
    """
    names = first_names(scripts, lineage, file)
    names = names.filter(F.size("names") > 0).select(F.col(lineage).alias("__l"), F.col(file).alias("__f"), "names")
    source = raw.select(*dict.fromkeys([*keep, lineage, file, payload]))
    # null lineages and files are such as others
    both = source.join(names, source[lineage].eqNullSafe(names["__l"]) & source[file].eqNullSafe(names["__f"]), "left").drop("__l", "__f")
    base = list(dict.fromkeys([*keep, lineage, file]))
    kinds = {f.name: f.dataType.simpleString() for f in both.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in base) + ", fields map<string,string>, conflicts map<string,string>"
    pairs = pa.map_(pa.string(), pa.string())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled: dict[tuple, Projection] = {}
        for b in batches:
            took, maps, others = [], [], []
            for i, (text, names) in enumerate(zip(b.column(payload).to_pylist(), b.column("names").to_pylist())):
                value = read_json(text)
                if value is None:
                    continue
                key = tuple(names or ())
                if key not in compiled:
                    if len(compiled) > 1000:
                        compiled.clear()
                    compiled[key] = Projection(list(key))
                found, conflicts = compiled[key].fields(value)
                took.append(i)
                maps.append(list(found.items()))
                others.append(list(conflicts.items()))
            picked = b.take(pa.array(took, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(picked.column(c) for c in base), pa.array(maps, pairs), pa.array(others, pairs)], names=[*base, "fields", "conflicts"])

    return both.mapInArrow(work, schema)
