from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from gramforge.llm import lossy, terms

ROWS = [
    (1, "a", 3, 1), (1, "a", 3, 1), (2, "a", None, 1), (3, "a", 1, 1), (1, "b", 9, 1), (2, "c", 0, 1), (None, "b", 2, 1),
    (1, None, 5, 1), (4, "x y", 7, 2),
]


def test_frequencies_and_marks(spark):
    rows = spark.createDataFrame(ROWS, "segment_id long, word string, cnt long, ord int").withColumnRenamed("ord", "total")
    freq = terms.term_frequencies(rows, where=rows["total"] == 1)
    got = {r.term: (r.total, r.n_records) for r in freq.collect()}
    assert got == {"a": (4, 3), "b": (11, 1), "c": (0, 1)}
    marks = {r.term: r.mark for r in terms.mark_terms(freq, terms.record_count(rows)).collect()}
    assert marks == {"a": "rare", "b": None, "c": "rare"}
    marks = {r.term: r.mark for r in terms.mark_terms(freq, terms.record_count(rows), min_total=1).collect()}
    assert marks == {"a": "common", "b": None, "c": "rare"}
    assert terms.term_frequencies(rows.limit(0)).collect() == []
    assert {r.term: r.total for r in terms.term_frequencies(rows, count=None).collect()}["a"] == 4


@pytest.mark.parametrize("epsilon", [0.5, 0.01, 1e-4])
def test_guaranteed_intervals(epsilon, monkeypatch):
    monkeypatch.setattr(lossy, "CHUNK", 64)
    rng = np.random.default_rng(2)
    items = [f"i{x}" for x in rng.zipf(1.4, 20_000)]
    weights = rng.integers(0, 4, len(items)).tolist()
    counter = lossy.LossyCounter(epsilon)
    for k in range(0, len(items), 50):
        counter.add(pa.array(items[k : k + 50]), pa.array(weights[k : k + 50], pa.int64()))
    counter.close_bucket()
    true = Counter()
    for i, w in zip(items, weights, strict=True):
        true[i] += w
    assert counter.weight == sum(weights) and counter.bucket <= epsilon * counter.weight
    held = {r["item"]: r for r in counter.entries.to_pylist()}
    for item, n in true.items():
        if item in held:
            assert held[item]["count"] <= n <= held[item]["count"] + held[item]["delta"]
        else:
            assert n <= counter.bucket
    assert len(held) <= (1 / epsilon) * (1 + np.log(1 + epsilon * counter.weight)) + 64


@pytest.mark.parametrize("epsilon", [0.3, 0.002, 1e-5])
def test_top_items(spark, epsilon):
    rng = np.random.default_rng(4)
    rows = [(f"i{x}", int(w)) for x, w in zip(rng.zipf(1.3, 5000), rng.integers(0, 5, 5000), strict=True)]
    df = spark.createDataFrame([*rows, (None, 9), ("i1", None)], "item string, total long").repartition(4)
    true = Counter()
    for i, w in rows:
        true[i] += w
    want = sorted(true.items(), key=lambda x: (-x[1], x[0]))[:15]
    got = lossy.top_items(df, "item", "total", 15, epsilon).collect()
    assert [(r.item, r.total) for r in got] == want
    assert all(r.at_least <= r.total <= r.at_most for r in got)


def test_top_of_little(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("c", None)], "item string, cnt long")
    assert [r.item for r in lossy.top_items(df, "item", "cnt", 2).collect()] == ["a", "b"]
    assert [r.item for r in lossy.top_items(df, "item", "cnt", 9).collect()] == ["a", "b", "c"]
    assert lossy.top_items(df.limit(0), "item", "cnt", 3).collect() == []
    once = lossy.deliveries_once(spark.createDataFrame([(1, "a", 4), (1, "a", 4), (2, "a", None)], "s long, g string, cnt long"), ["s", "g"], "cnt")
    assert sorted((r.s, r.cnt) for r in once.collect()) == [(1, 4), (2, 0)]


def test_top_items_of_short_summary(spark):
    rows = [(f"heavy{i}", 1_000_000 + i) for i in range(3)] + [(f"light{i}", i) for i in range(50)]
    df = spark.createDataFrame(rows, "item string, cnt long").coalesce(1)
    _, kth, missing = lossy.intervals(df, "item", "cnt", 6, 0.01)
    assert (kth, missing > 49) == (0, True)
    got = [(r.item, r.total) for r in lossy.top_items(df, "item", "cnt", 6, 0.01).collect()]
    assert got == [*rows[2::-1], *rows[:-4:-1]]


@pytest.mark.parametrize("tasks", [1, 8])
def test_top_items_with_finer_epsilon(spark, monkeypatch, tasks):
    passes, intervals = [], lossy.intervals

    def noted(*args):
        passes.append(intervals(*args))
        return passes[-1]

    monkeypatch.setattr(lossy, "intervals", noted)
    rows = [(f"i{i}", 10 + i) for i in range(500)]
    df = spark.createDataFrame(rows, "item string, cnt long").repartition(tasks)
    assert [(r.item, r.total) for r in lossy.top_items(df, "item", "cnt", 5, 0.01).collect()] == rows[:-6:-1]
    (_, kth, missing), (_, finer_kth, finer_missing) = passes
    assert kth <= missing and finer_kth > finer_missing


def test_buckets_end_by_weight_and_bound_the_summary():
    """Buckets far smaller than the stream: pruning happens at each, and the summary stays small."""
    rng = np.random.default_rng(6)
    counter, most, distinct = lossy.LossyCounter(1e-3), 0, set()
    for _ in range(300):
        items = [f"i{x}" for x in rng.zipf(1.2, 500)]
        distinct |= set(items)
        counter.add(pa.array(items), pa.array(rng.integers(1, 4, 500).tolist(), pa.int64()))
        most = max(most, 0 if counter.entries is None else len(counter.entries))
    assert counter.pruned > 200 and counter.waiting_rows < lossy.CHUNK
    assert most < 5_000 < 25_000 < len(distinct)


def test_weightless_items_do_not_fill_memory(monkeypatch):
    monkeypatch.setattr(lossy, "CHUNK", 64)
    counter = lossy.LossyCounter(0.01)
    for k in range(50):
        counter.add(pa.array([f"i{k}-{i}" for i in range(50)]), pa.array([0] * 50, pa.int64()))
        assert counter.entries is None or len(counter.entries) <= 300
    assert counter.missing == 1 and counter.bucket == 0


def test_slices_instead_of_memory(spark, monkeypatch):
    monkeypatch.setattr(lossy, "MIN_EPSILON", 0.02)
    rows = [(f"i{i:03}", 10 + i // 3) for i in range(400)]
    df = spark.createDataFrame(rows, "item string, cnt long").repartition(3)
    want = sorted(rows, key=lambda r: (-r[1], r[0]))[:5]
    assert [(r.item, r.total) for r in lossy.top_items(df, "item", "cnt", 5, 0.02).collect()] == want


def test_flat_data_give_intervals(spark, monkeypatch):
    monkeypatch.setattr(lossy, "MIN_EPSILON", 0.1)
    monkeypatch.setattr(lossy, "MAX_SLICES", 2)
    df = spark.createDataFrame([(f"i{i}", 1) for i in range(3000)], "item string, cnt long")
    assert all(r.total is None and r.at_least <= 1 <= r.at_most for r in lossy.top_items(df, "item", "cnt", 5, 0.1).collect())
