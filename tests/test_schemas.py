"""Tree edit distance against all mappings, scripts, and first names against a plain replay."""

import json
import random
from datetime import datetime, timedelta
from itertools import permutations

import numpy as np

from arborlens.operators import schemas as S

T0 = datetime(2024, 1, 1)


def tree(value):
    return dict(S.typed_paths(value))


def plain_distance(a, z):
    """The least cost over every pairing of fields below one parent; ``a``, ``z``: name -> (type, children)."""

    def size(t):
        return sum(1 + size(k) for _, k in t.values())

    total = 0
    for n in a.keys() & z.keys():
        total += (a[n][0] != z[n][0]) + plain_distance(a[n][1], z[n][1])
    left, right = [a[n] for n in a.keys() - z.keys()], [z[n] for n in z.keys() - a.keys()]
    best = None
    slots = [*range(len(right)), *[None] * len(left)]
    for pick in set(permutations(slots, len(left))):
        cost = sum(1 + size(right[j][1]) for j in set(range(len(right))) - set(pick))
        for x, j in zip(left, pick):
            if j is None:
                cost += 1 + size(x[1])
            elif x[0] != right[j][0]:
                cost += 10**6
            else:
                cost += 1 + plain_distance(x[1], right[j][1])
        best = cost if best is None else min(best, cost)
    return total + best


def random_tree(rng, depth):
    return {n: (rng.choice("os"), {}) if depth == 0 or rng.random() < 0.4 else ("d", random_tree(rng, depth - 1)) for n in rng.sample("abcdef", rng.randint(0, 3))}


def as_paths(t, at=""):
    out = {}
    for n, (kind, kids) in t.items():
        p = f"{at}.{n}" if at else n
        out[p] = kind
        out.update(as_paths(kids, p))
    return out


def test_distance_is_the_least_of_all_mappings():
    rng = random.Random(7)
    for _ in range(400):
        a, z = random_tree(rng, 2), random_tree(rng, 2)
        assert S.distance(as_paths(a), as_paths(z)) == plain_distance(a, z), (a, z)


def test_assignment_is_the_least_of_all():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 4, 5, 6):
        for _ in range(20):
            cost = rng.integers(0, 20, (n, n)).astype(float)
            got = S.assigned(cost)
            assert sorted(got) == list(range(n))
            assert sum(cost[i, j] for i, j in enumerate(got)) == min(sum(cost[i, j] for i, j in enumerate(p)) for p in permutations(range(n)))


def test_two_for_two_cost_two_and_are_not_told_apart():
    a, z = tree({"a": 1, "b": 2}), tree({"c": 1, "d": 2})
    assert S.distance(a, z) == 2
    assert S.edit_script(a, z) == [("added", "", "c"), ("added", "", "d"), ("removed", "a", ""), ("removed", "b", "")]
    # subtrees pair with what is most like them
    assert S.distance(tree({"p": {"x": 1, "y": 1}, "q": {"u": 1}}), tree({"r": {"u": 1}, "s": {"x": 1, "y": 1, "w": 1}})) == 3


def test_odd_names():
    assert S.edit_script({}, tree({"a.b": 1})) == [("added", "", "a\\.b")]
    assert S.edit_script(tree({"a.b": 1, "a": {"b": 1}}), tree({"a.b": "1", "a": {"b": 1}})) == [("retyped", "a\\.b", "a\\.b")]
    for name in ("", "[]", "x[]", "\\", "\\e", ".", "a.b[].c", "e"):
        path = next(iter(S.typed_paths({"top": {name: 1}}) - {("top", "object")}))[0]
        assert S.parent(path) == "top" and S.parts(path) == ["top", S.escaped(name)] and S.shown(path) == f"top.{name}", name


def test_shown_as_they_are(spark):
    rows = [(1, "L", "f1", 1, "{}"), (2, "L", "f2", 2, json.dumps({"a.b": 1, "": "x", "\\e": [1], "q": {"\\": True}}))]
    got = S.schema_changes(spark.createDataFrame(rows, "id int, l string, f string, at int, p string"), "l", "f", "at", "p").collect()
    assert sorted(r["new_path"] for r in got) == sorted(["a.b", "", "\\e", "q"])


def run(spark, rows):
    df = spark.createDataFrame([(i, ln, f, T0 + timedelta(hours=h) if h is not None else None, json.dumps(v)) for i, (ln, f, h, v) in enumerate(rows)], "id bigint, lineage string, file string, at timestamp, payload string")
    changes = S.file_scripts(df, "lineage", "file", "at", "payload", moves=True)
    out = S.conform(df, changes, "lineage", "file", "payload", ["id"]).collect()
    return {r["id"]: (dict(r["fields"]), dict(r["conflicts"])) for r in out}


def test_no_value_is_lost(spark):
    got = run(spark, [
        ("L", "f1", 1, {"a": 1, "o": {"k": 1}, "x.y": 5}), ("L", "f2", 2, {"b": 2, "o": {"k": 1}, "x.y": 5}),
        ("L", "f3", 3, {"b": 3, "a": 4, "o": 7, "x.y": 6}),  # the name is back for another field, and a parent has become a value
        ("L", "f4", 4, {"b": 3, "o": {"k": 2}, "x.y": True}), ("L", "f5", 5, {"b": 9, "o": {"j": 8}, "x.z": True}),
    ])
    assert got[0] == ({"a": "1", "o.k": "1", "x.y": "5"}, {}) and got[1] == ({"a": "2", "o.k": "1", "x.y": "5"}, {})
    assert got[2] == ({"a": "3", "o": "7", "x.y": "6"}, {"a": "4"})
    assert got[3] == ({"a": "3", "o.k": "2", "x.y": "true"}, {})
    assert got[4] == ({"a": "9", "o.k": "8", "x.y": "true"}, {})


def test_fields_inside_arrays(spark):
    got = run(spark, [
        ("L", "f1", 1, {"c": [{"p": "a", "n": {"u": 1}}], "m": [[{"q": 1}]]}), ("L", "f2", 2, {"d": [{"p": "a", "n": {"u": 1}}], "m": [[{"r": 2}]]}), ("L", "f3", 3, {"d": [{"s": "b", "n": {"v": 3}}, None, {"p": "new"}], "m": [[{"r": 2}, 4], 5]}),
    ])
    assert json.loads(got[1][0]["c"]) == [{"p": "a", "n": {"u": 1}}] and json.loads(got[1][0]["m"]) == [[{"q": 2}]]
    assert json.loads(got[2][0]["c"]) == [{"s": "b", "n": {"u": 3}}, None, {"p": "new"}] and json.loads(got[2][0]["m"]) == [[{"q": 2}, 4], 5]


def test_a_long_lineage_over_many_ranges(spark):
    # one lineage of 120 files, each with one rename; small ones before and behind
    rows = [("A", "a1", 1, {"v": 1}), ("A", "a2", 2, {"w": 1}), ("Z", "z1", 1, {"v": 1}), ("Z", "z2", 2, {"w": 1})]
    rows += [("M", f"f{i:04}", i, {f"n{i}": i, "t": {f"k{i // 2}": "s", "deep": {"x": 1}}}) for i in range(120)] + [("M", "g", 500, {"n119": 9, "t": {"k59": "s"}})]
    got = run(spark, rows)
    assert got[1][0] == {"v": "1"} and got[3][0] == {"v": "1"}
    assert got[124][0] == {"n0": "9", "t.k0": "s"}
    for i in range(120):
        assert got[4 + i][0] == {"n0": str(i), "t.k0": "s", "t.deep.x": "1"}, i


def test_maps_compose():
    rng = random.Random(5)
    for _ in range(200):
        trees = [random_tree(rng, 2) for _ in range(7)]
        scripts = [S.edit_script(as_paths(a), as_paths(z), moves=True) for a, z in zip(trees, trees[1:])]
        whole, first, second = {}, {}, {}
        for n, s in enumerate(scripts):
            whole = S.after(whole, s)
            if n < 3:
                first = S.after(first, s)
            else:
                second = S.after(second, s)
        both = S.behind(first, second)
        for p in as_paths(trees[-1]):
            assert S._then(both, p) == S._then(whole, p), (p, trees, whole, first, second, both)
