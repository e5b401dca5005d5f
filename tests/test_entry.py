"""Every registered query of the core against its SQL over the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from gramforge.plans import registry

SMALL = "/root/testdata/sf0.001"


def test_flagship(spark):
    assert entry.entry(spark).columns == ["ord", "ngram", "log10prob", "bow"]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, compare, name):
    assert name in entry.queries()
    mine, theirs = compare(spark, entry, name, SMALL)
    assert mine == theirs


def test_queries_without_sql(spark):
    """Those that SQL can't express: confidences are probabilities, and the fields' lines are the reasons' lines."""
    rest = set(registry.queries()) - set(registry.oracle_sql())
    assert rest == {"lattice_confidence", "p3_fields"}
    q = entry.queries()
    lines = [r.value.split("\t") for r in q["lattice_confidence"](spark, SMALL).collect()]
    assert {t for t, _ in lines} == {r.tag for r in q["lattice_best_score"](spark, SMALL).collect()}
    assert all(0.0 <= float(c) <= 1.0 for _, c in lines)
    by_reason = {}
    for r in q["p3_fields"](spark, SMALL).collect():
        by_reason[r.reason] = by_reason.get(r.reason, 0) + r.n_lines
        assert r.field is not None
    want = {}
    for r in q["p3_reasons"](spark, SMALL).collect():
        want[r.reason] = want.get(r.reason, 0) + r.n_lines
    assert by_reason == want


def test_vectors(spark):
    from pyspark.sql import functions as F

    from gramforge.functions import vectors as V

    df = spark.createDataFrame([("a", 1, 2.0), ("a", 5, float("inf")), ("b", None, float("nan"))], "k string, i int, x double")
    assert {r.k: r.n for r in V.bin_count(df, "k").collect()} == {"a": 2, "b": 1}
    assert {r.i: r.n for r in V.bin_clipped_count(df, "i", 3).collect()} == {1: 1}
    assert {r.k: r.total for r in V.bin_weight(df, "k", "i", F.col("x") < 3).collect()} == {"a": 1, "b": 0}
    got = df.select(V.is_finite(F.col("x")).alias("f"), V.is_infinite(F.col("x")).alias("n"), V.mask_assign(F.col("i") > 1, F.lit(0), F.col("i")).alias("m")).collect()
    assert [(r.f, r.n, r.m) for r in got] == [(True, False, 1), (False, True, 0), (False, False, None)]
    one = df.agg(V.any_true(F.col("i") > 4).alias("a"), V.all_true(F.col("i") > 4).alias("b"), V.dot(F.col("i"), F.col("i")).alias("d")).first()
    assert (one.a, one.b, one.d) == (True, False, 26)
    table = spark.createDataFrame([("a", 7)], "k string, v int")
    assert {r.k: r.v for r in V.lookup(df, table, "k", "v", -1).collect()} == {"a": 7, "b": -1}
