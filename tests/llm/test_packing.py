import random
import time
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from arborlens.llm import packing as P


@pytest.mark.parametrize("seed", range(6))
def test_plans_use_up_all_counts(seed):
    r = random.Random(seed)
    cap = r.choice([1, 7, 64, 512])
    counts = Counter(min(cap, max(1, int(r.expovariate(1 / (cap / 5))))) for _ in range(r.choice([0, 1, 50, 5000])))
    left = Counter(counts)
    windows = 0
    for used, times in P.plan(dict(counts), cap):
        assert sum(x * k for x, k in used) <= cap and times > 0
        windows += times
        for x, k in used:
            left[x] -= k * times
    assert not any(left.values())
    total = sum(x * n for x, n in counts.items())
    if len(counts) > 20:  # enough lengths to close gaps with
        assert windows <= -(-total // cap) * 1.01 + 1


@pytest.mark.parametrize("seed", range(5))
def test_index_of_sums_equals_a_search(seed):
    r = random.Random(seed)
    cap = 40
    left = np.zeros(cap + 1, np.int64)
    for x in r.sample(range(1, cap + 1), r.randint(1, 12)):
        left[x] = r.randint(1, 3)
    sums = P.Sums(left, [x for x in range(1, cap + 1) if left[x]])
    while left.any():
        for total in r.sample(range(1, cap + 1), 10):
            own = [x for x in range(1, cap + 1) for _ in range(min(left[x], 3))]
            possible = any(sum(c) == total for k in (1, 2, 3) for c in combinations(own, k))
            got = sums.closing(total)
            assert (got is not None) == possible, (total, left, got)
            if got:
                assert sum(got) == total and all(left[x] >= got.count(x) for x in got)
        x = r.choice(np.flatnonzero(left).tolist())
        left[x] -= 1  # counts only fall


def test_a_wide_window_is_planned_in_seconds():
    r = np.random.default_rng(3)
    lengths, n = np.unique(np.minimum(1 + r.lognormal(8, 1.6, 400_000).astype(np.int64), 131_072), return_counts=True)
    began = time.time()
    steps = P.plan(dict(zip(lengths.tolist(), n.tolist())), 131_072)
    took = time.time() - began
    windows, total = sum(t for _, t in steps), int((lengths * n).sum())
    assert took < 60 and windows <= -(-total // 131_072) * 1.001 + 1, (took, windows, total / 131_072)


def test_complements_are_exact():
    (one,) = P.plan({6: 10, 4: 10}, 10)
    assert one == ([(6, 1), (4, 1)], 10)
    assert P.plan({5: 3}, 10) == [([(5, 2)], 1), ([(5, 1)], 1)]
    assert P.plan({7: 2, 1: 6}, 10) == [([(7, 1), (1, 3)], 2)]


@pytest.mark.parametrize("seed,cap", [(1, 10), (2, 50), (3, 1), (4, 1000)])
def test_every_text_has_its_place(spark, seed, cap):
    r = random.Random(seed)
    rows = [(i if r.random() > 0.02 else None, r.choice([0, 1, 3, 3, 3, 3, cap, cap + 1, 3 * cap, 2 * cap + 5, r.randint(1, 40)]), "x") for i in range(600)]
    rows += rows[:5]
    got = P.pack(spark.createDataFrame(rows, "doc_id bigint, tokens bigint, window string"), cap).collect()
    fill, texts = defaultdict(int), defaultdict(list)
    for x in got:
        if x["window"] is None:
            assert x["tokens"] == 0
        else:
            fill[x["window"]] += x["tokens"]
            assert x["tokens"] > 0 and (x["pieces"] == 1 or x["piece"] < x["pieces"])
        texts[x["doc_id"], x["pieces"]].append(x["tokens"])
    assert max(fill.values()) <= cap and sorted(fill) == list(range(len(fill)))
    want = Counter()
    for i, n, _ in rows:
        want[i] += n
    have = Counter()
    for (i, _), ns in texts.items():
        have[i] += sum(ns)
    assert have == want
    assert len(got) == sum(max(1, -(-n // cap)) for _, n, _ in rows)


def test_nothing_to_pack(spark):
    assert P.pack(spark.createDataFrame([], "doc_id bigint, tokens bigint"), 5).count() == 0
    with pytest.raises(ValueError):
        P.pack(spark.createDataFrame([], "doc_id bigint, tokens bigint"), 0)


def test_tokens_are_those_of_the_tokenizer(spark, data):
    count = P.Counter(*P.vocabulary_of())
    texts = ["", None, "Hello, wörld!  \n\n x", "a" * 5000, "<|endoftext|>"] + [r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").limit(50).collect()]
    assert [count(t) for t in texts] == [len(count.encoding.encode_ordinary(t or "")) for t in texts]
