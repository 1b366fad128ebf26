import math
import random

import numpy as np
import pytest

from arborlens.llm import leaks as L
from arborlens.llm.text import words

VOCAB = [f"w{i}" for i in range(400)]


def distance(item, text):
    """Least edit distance of the item to any part of the text, by the plain table."""
    d = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, v in enumerate(text, 1):
            new.append(min(d[j - 1] + (w != v), d[j] + 1, new[-1] + 1))
        d = new
    return min(d)


def plainly(item, text):
    return any(distance(item[a : a + n], text) <= n // L.ONE_IN for n in range(L.PASSAGE, min(2 * L.PASSAGE, len(item) + 1)) for a in range(len(item) - n + 1))


def edited(r, ws, n):
    ws = list(ws)
    for _ in range(n):
        k = r.randrange(len(ws))
        ws[k : k + 1] = r.choice([[], [r.choice(VOCAB)], [ws[k], r.choice(VOCAB)]])
    return ws


@pytest.mark.parametrize("most_bytes", [L.BROADCAST_BYTES, 0])
def test_search_equals_a_plain_one(spark, most_bytes):
    r = random.Random(7)
    items = [(i, [r.choice(VOCAB) for _ in range(r.choice([10, 30, 45, 70]))]) for i in range(6)]
    docs = []
    for i in range(60):
        body = [r.choice(VOCAB) for _ in range(r.choice([0, 5, 80]))]
        item = r.choice(items)[1]
        a = r.randrange(max(1, len(item) - 35))
        body[len(body) // 2 : len(body) // 2] = edited(r, item[a : a + r.choice([15, 29, 30, 40, 70])], r.choice([0, 1, 3, 4, 7]))
        docs.append((1000 + i, body))
    want = {(i, d) for d, t in docs for i, w in items if plainly(w, t)}
    rows = [(d, " ".join(t).upper() if d % 2 else ",\n> ".join(t), "x") for d, t in docs] + [(1, None, "x"), (2, "", "x")]
    df = L.leaked(spark.createDataFrame(rows + rows[:3], "doc_id bigint, text string, item_id string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(99, None), (98, "")], "item_id bigint, text string"), most_bytes=most_bytes)
    got = {tuple(x) for x in df.collect()}
    assert len(want) > 10 and got == want


@pytest.mark.parametrize("most_bytes", [0, -1])
def test_no_items_or_documents(spark, most_bytes):
    d, i = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")
    assert L.leaked(d, i, most_bytes=most_bytes).count() == 0
    assert L.leaked(spark.createDataFrame([(1, "a b " * 50)], "doc_id bigint, text string"), i, most_bytes=most_bytes).count() == 0


@pytest.mark.parametrize("most_bytes", [L.BROADCAST_BYTES, 0])
def test_other_names_and_types(spark, most_bytes):
    items = [(i, " ".join(f"g{i}x{k}" for k in range(40))) for i in range(5)]
    docs = spark.createDataFrame([(f"d{i}", f"before {t} after", 1, "x") for i, t in items], "item string, said string, block int, doc string")
    got = L.leaked(docs, spark.createDataFrame(items, "place int, value string"), "item", "said", "place", "value", most_bytes).collect()
    assert {(x["place"], x["item"]) for x in got} == {(i, f"d{i}") for i in range(5)}


def test_least_is_what_edits_leave():
    for n in range(L.PASSAGE, 2 * L.PASSAGE):
        ws = list(range(n))
        edits = n // L.ONE_IN
        for k in range(edits):  # spread so that each kills as many shingles as it can
            ws[5 + 9 * k if 5 + 9 * k < n else n - 1] = -1 - k
        left = len({tuple(ws[i : i + 5]) for i in range(n - 4)} & {tuple(range(i, i + 5)) for i in range(n - 4)})
        assert left >= L.surviving(n) >= L.LEAST - 0 or left >= L.LEAST


@pytest.mark.parametrize("a,b", [("Café déjà", "cafe deja"), ("CafÃ© x", "café x"), ("a&nbsp;b<br/>c", "a b c"), ('say \\"hi\\"\\nnow \\u00e9', 'say "hi" now é'), ("> one\n// two", "one two"), ("STRASSE", "straße")])
def test_only_words_count(a, b):
    assert words(a) == words(b)


def test_signatures_estimate_likeness():
    r = np.random.default_rng(1)
    a, b = r.integers(0, 2**63, 60).astype(np.uint64), r.integers(0, 2**63, 60).astype(np.uint64)
    b[:30] = a[:30]
    both = L.signatures(np.concatenate([a, b]), np.array([0, 60]))
    assert 0.15 < (both[:, 0] == both[:, 1]).mean() < 0.55


def test_least_likeness_holds_for_full_blocks():
    # two tiles of an item and of a document, LEAST shingles in common
    for size, want in zip(L._SIZES, L._NEEDED):
        p = L.LEAST / (max(int(size), L.LEAST) + 2 * L.STRIDE - L.LEAST)
        assert sum(math.comb(L.HASHES, n) * p**n * (1 - p) ** (L.HASHES - n) for n in range(want)) <= L.MISS
    assert L._SIZES[-1] == 2 * L.STRIDE


@pytest.mark.parametrize("most_bytes", [L.BROADCAST_BYTES, 0])
def test_words_broken_at_a_line_end(spark, most_bytes):
    item = [f"{a}{b}put" for a in "abcdef" for b in "ghijk"] + ["well", "known"]
    text = lambda ws: " ".join(ws)
    broken = lambda ws, *at: text(w[:2] + "-\n" + w[2:] if i in at else w for i, w in enumerate(ws))
    # two breaks and, in the second, a third edit; a hyphen of its own at a line's end beside two breaks
    docs = {1: broken(item[:30], 3, 17), 2: broken(item[:30], 3, 17).replace(item[9], "other"), 3: broken(item[2:30], 5, 19, 23) + " well-\nknown", 4: broken(item[:30], 3, 17).replace("-\n", "-\r\n> ")}
    rows = [(1, text(item[:30]) + " well-known"), (2, broken(item, 7, 8, 9))]
    got = {tuple(x) for x in L.leaked(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string"), spark.createDataFrame(rows, "item_id bigint, text string"), most_bytes=most_bytes).collect()}
    assert got == {(i, d) for i in (1, 2) for d in docs}
