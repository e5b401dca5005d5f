from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from gramforge.llm import packing
from gramforge.llm.packing import Knapsack, pack, plan_packing


def _loads(plan, histogram):
    load, seen = Counter(), defaultdict(list)
    for size, start, stop, first, per in zip(plan.size, plan.start, plan.stop, plan.first, plan.per, strict=True):
        seen[size].append((start, stop))
        for r in range(start, stop):
            load[first + (r - start) // per] += size
    for size, n in histogram.items():
        at = 0
        for a, b in sorted(seen[size]):
            assert a == at
            at = b
        assert at == n
    assert not load or max(load.values()) <= plan.capacity
    assert set(load) == set(range(plan.n_containers))
    return load


@given(st.dictionaries(st.integers(1, 100), st.integers(1, 30), max_size=25))
@settings(max_examples=60, deadline=None)
def test_every_item_once_and_within_capacity(histogram):
    _loads(plan_packing(histogram, 100), histogram)


def test_fills_well():
    rng = np.random.default_rng(3)
    histogram = dict(Counter(np.clip(rng.lognormal(6.2, 0.7, 20_000), 1, 5000).astype(int).tolist()))
    plan = plan_packing(histogram)
    _loads(plan, histogram)
    total = sum(s * n for s, n in histogram.items())
    assert total / 5000 / plan.n_containers > 0.99


def test_the_program_fills_most_containers():
    rng = np.random.default_rng(3)
    histogram = dict(Counter(np.clip(rng.lognormal(6.0, 0.8, 10_000), 1, 5000).astype(int).tolist()))
    plan = plan_packing(histogram)
    assert plan.n_configured > 0.9 * plan.n_containers


def test_basic_solution_covers_the_demand():
    rng = np.random.default_rng(8)
    for n in (1, 3, 12):
        solution = {tuple(rng.integers(0, 4, n).tolist()): float(rng.random()) for _ in range(60)}
        solution.pop((0,) * n, None)
        demand = sum(np.array(c) * x for c, x in solution.items())
        basic = packing.basic_solution(solution, demand)
        assert np.allclose(sum(np.array(c) * x for c, x in basic.items()), demand)
        assert len(basic) <= n and min(basic.values()) > 0
        assert sum(basic.values()) <= sum(solution.values()) + 1e-6
    assert packing.basic_solution({}, np.array([2.0])) == {(1,): 2.0}


def test_knapsack_against_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(20):
        sizes = np.unique(rng.integers(2, 12, 4))
        values = rng.random(len(sizes))
        config = Knapsack(sizes, 20).best(values)
        assert config @ sizes <= 20
        best = [0.0] * 21
        for w in range(1, 21):
            best[w] = max([best[w - 1], *(best[w - s] + v for s, v in zip(sizes, values, strict=True) if s <= w)])
        assert abs(config @ values - best[20]) < 1e-9


def test_no_items():
    assert plan_packing({}).n_containers == 0


def test_pack_rows(spark):
    rows = [(i, 700) for i in range(300)] + [(i, 300 + i % 50) for i in range(300, 500)]
    rows += [(900, 0), (901, None), (902, 12_345), (903, 5_000), (903, 5_000), (None, 42)]
    packed = pack(spark.createDataFrame(rows, "doc_id long, n_tokens long")).collect()
    assert len(packed) == len(rows) + 2
    load = Counter()
    for r in packed:
        if r.n_tokens:
            load[r.container] += r.n_tokens
        else:
            assert r.container is None
    assert max(load.values()) <= packing.CAPACITY
    assert sorted(r.n_tokens for r in packed if r.doc_id == 902) == [2_345, 5_000, 5_000]
    assert {r.n_pieces for r in packed if r.doc_id == 902} == {3}
    assert len({r.container for r in packed if r.doc_id == 903}) == 2
    assert sum(load.values()) == sum(n or 0 for _, n in rows)
    got = packing.containers(pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"))).collect()
    assert {r.container: r.n_tokens for r in got} == dict(load)
    assert all(r.unused == packing.CAPACITY - r.n_tokens for r in got)


def test_one_length_holds_most_rows(spark):
    packed = pack(spark.range(3000).selectExpr("id as doc_id", "1250L as n_tokens")).collect()
    load = Counter(r.container for r in packed)
    assert set(load.values()) == {4} and len(load) == 750


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, n_tokens long")).collect() == []
