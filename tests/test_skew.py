from __future__ import annotations

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gramforge.operators import skew

ROWS = (
    [(s, "hot", f"w{s % 7}", s % 3) for s in range(400)]
    + [(1, "hot", "w1", 1)] * 300
    + [(s, f"h{s}", "x", 1) for s in range(100)]
    + [(5, None, "w", 3), (5, "", "w", None), (6, "", "w", 2), (7, "hot", None, 4)]
)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "segment_id long, hist string, word string, cnt long").repartition(5)


def test_history_statistics(rows):
    n, words, once = Counter(), defaultdict(set), {}
    for s, h, w, c in ROWS:
        if h is None:
            continue
        n[h] += 1
        if w is not None:
            words[h].add(w)
        once[s, h, w] = max(once.get((s, h, w), 0), c or 0)
    total = Counter()
    for (_, h, _), c in once.items():
        total[h] += c
    got = {r.hist: (r.n_rows, r.n_followers, r.total) for r in skew.history_statistics(rows).collect()}
    assert got == {h: (n[h], len(words[h]), total[h]) for h in n}


def test_heavy_keys_and_salts(rows):
    assert [r.hist for r in skew.heavy_keys(rows, "hist", 0.3).collect()] == ["hot"]
    salted = skew.with_salt(rows, "hist", ["word"], skew.heavy_keys(rows, "hist", 0.3), 16)
    salts = {(r.hist == "hot", r["__salt"]) for r in salted.collect()}
    assert {s for hot, s in salts if not hot} == {0} and len({s for hot, s in salts if hot}) > 1
    assert salted.count() == len(ROWS)


@pytest.mark.parametrize("share", [0.0001, 0.3, 0.99])
def test_salted_aggregate(rows, share):
    got = skew.salted_aggregate(
        rows,
        "hist",
        {"n": ("count", "segment_id"), "s": ("sum", "cnt"), "lo": ("min", "cnt"), "hi": ("max", "cnt"), "d": ("count_distinct", "word")},
        "word",
        skew.heavy_keys(rows, "hist", share),
    )
    want = rows.where("hist is not null").groupBy("hist").agg(
        F.count("segment_id").alias("n"), F.sum("cnt").alias("s"), F.min("cnt").alias("lo"), F.max("cnt").alias("hi"), F.count_distinct("word").alias("d")
    )
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(ValueError):
        skew.salted_aggregate(rows, "hist", {"d": ("count_distinct", "cnt")}, "word")


@pytest.mark.parametrize("how", ["left", "inner"])
def test_skew_join(spark, rows, how):
    right = spark.createDataFrame([("hot", 1), ("h3", 2), ("", 3)], "hist string, v int")
    sizes = rows.where("hist is not null").groupBy("hist").agg(F.count(F.lit(1)).alias("n_rows"))
    key = lambda r: tuple(map(str, r))
    got = skew.skew_join(rows, right, ["hist"], sizes, ["segment_id", "word"], how, share=0.1, salts=8)
    want = rows.join(right, "hist", how)
    assert sorted(map(key, got.select(want.columns).collect())) == sorted(map(key, want.collect()))


def test_empty(rows):
    assert skew.history_statistics(rows.limit(0)).collect() == []
