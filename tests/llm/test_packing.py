"""Packing: every piece once, no container overfull, little room left."""

from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import packing
from millrace.llm.queries import QUERIES


def filled(histogram, capacity):
    plan = packing.plan_containers(histogram, capacity)
    keys, first, each, container = packing._lookup(plan)
    out = defaultdict(list)
    import numpy as np

    for length, n in histogram.items():
        for rank in range(n):
            k = int(np.searchsorted(keys, length * packing._RANKS + rank, side="right")) - 1
            out[int(container[k] + (rank - first[k]) // each[k])].append(length)
    return plan, out


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 60).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c), st.integers(1, 9), max_size=25))))
def test_any_histogram(case):
    capacity, histogram = case
    plan, out = filled(histogram, capacity)
    assert Counter(x for xs in out.values() for x in xs) == Counter(histogram)
    assert sorted(out) == list(range(plan.containers)) and all(sum(xs) <= capacity for xs in out.values())
    half = [c for c, xs in out.items() if sum(xs) * 2 <= capacity]
    assert len(half) <= 1  # two half-empty ones would have been one


def test_exact_complements():
    assert packing.plan_containers({60: 5, 40: 5}, 100).containers == 5
    assert packing.plan_containers({70: 4, 20: 4, 10: 4}, 100).containers == 4
    assert packing.plan_containers({50: 3, 25: 3, 15: 3, 10: 3}, 100).containers == 3
    assert packing.plan_containers({100: 10**9}, 100).containers == 10**9
    assert packing.plan_containers({}, 10).containers == 0


def test_combinations_are_hashed_by_sum():
    stock = packing.Sums({50: 1, 30: 2, 20: 1, 7: 1})
    assert stock.filling(50, {}) == [50] and stock.filling(50, {50: 1}) == [30, 20] and stock.filling(60, {}) == [30, 30] and stock.filling(57, {}) == [50, 7]
    assert stock.filling(60, {30: 1}) is None and stock.filling(80, {50: 1}) == [30, 30, 20] and stock.filling(87, {}) == [50, 30, 7] and stock.filling(8, {}) is None
    stock.left[30] = 0
    assert stock.filling(60, {}) is None and stock.filling(80, {}) is None and stock.longest(49, {}) == 20 and stock.longest(19, {7: 1}) is None


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 3), min_size=1, max_size=12), st.lists(st.integers(1, 90), min_size=1, max_size=12))
def test_no_exact_filling_is_missed(histogram, gaps):
    from itertools import combinations_with_replacement

    stock = packing.Sums(histogram)
    for gap in gaps:
        ways = [c for n in (1, 2, 3) for c in combinations_with_replacement(sorted(stock.left), n) if sum(c) == gap and all(stock.left[x] >= c.count(x) for x in c)]
        got = stock.filling(gap, {})
        assert (got is None) == (not ways)
        if got:
            assert sum(got) == gap
            for x in got:
                stock.left[x] -= 1
                assert stock.left[x] >= 0


def test_great_capacities():
    plan = packing.plan_containers({10**12: 3, 10**12 - 5: 1, 5: 1}, 10**12)
    assert plan.containers == 4
    import random

    rng = random.Random(1)
    histogram = Counter(rng.randint(1, 6_000) for _ in range(12_000))
    assert packing.plan_containers(histogram, 20_000).containers <= sum(k * v for k, v in histogram.items()) / 20_000 * 1.01 + 1


def test_plan_as_a_table(spark, budgets):
    df = spark.createDataFrame([(i, " ".join(["one"] * (i % 9 + 1))) for i in range(60)], "doc_id bigint, text string")
    same = [sorted(map(tuple, packing.packed(spark, df, budgets, plan_bytes=b).collect())) for b in (0, 1 << 20)]
    assert same[0] == same[1] and len(same[0]) > 60


def test_hot_length():
    plan = packing.plan_containers({7: 10**7, 3: 10**7, 5: 1}, 10)
    assert plan.containers == 10**7 + 1 and len(plan.length) < 10


@pytest.fixture(scope="module")
def budgets(spark):
    return spark.createDataFrame([("a", "x", 8), ("b", "x", 3), ("none", "x", 0)], "budget string, tokenizer string, capacity_tokens bigint")


def test_rows(spark, budgets):
    texts = [(1, "one two three four five six seven eight nine ten eleven", "z"), (2, None, "z"), (3, "", "z"), (4, "one", "z"), (4, "one", "z"), (5, " ", "z"), (6, "a b c d e f g h", "z")]
    df = spark.createDataFrame(texts, "doc_id bigint, text string, rank string")
    got = packing.packed(spark, df, budgets).collect()
    for b, capacity in (("a", 8), ("b", 3)):
        rows = [r for r in got if r.budget == b]
        used = Counter()
        for r in rows:
            used[r.container_id] += r.n_tokens
        assert max(used.values()) <= capacity and sorted(used) == list(range(len(used)))
        pieces = defaultdict(list)
        for r in rows:
            pieces[r.doc_id].append((r.piece, r.start_token, r.n_tokens))
        assert set(pieces) == {1, 4, 5, 6} and len(pieces[4]) == 2
        total = 0
        for piece, start, n in sorted(pieces[1]):
            assert start == total and start == piece * capacity
            total += n
        assert total == 11
        assert len(pieces[6]) == -(-8 // capacity)
    assert {r.budget for r in got} == {"a", "b"}
    assert packing.packed(spark, df.where("false"), budgets).isEmpty()
    assert packing.packed(spark, df, budgets.where("false")).isEmpty()


def test_small_table(spark, small):
    for r in QUERIES["p8_fill"](spark, small).collect():
        assert r.tokens > 0 and r.unused * 20 < r.tokens
