"""Operations on whole models: truncation, merging of key sets, re-alignment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from .counts import keyed
from .skew import heavy_sides, of_side, skew_join


def truncate(model: DataFrame, order: int) -> DataFrame:
    """The model's orders up to `order`; the top order has no back-off weights."""
    cut = model.where(F.col("ord") <= order)
    return cut.withColumn("bow", F.when(F.col("ord") < order, F.col("bow")))


def merged_keys(models: list[DataFrame]) -> DataFrame:
    """(ord, ngram) of all models, each once."""
    return reduce(DataFrame.unionByName, [m.select("ord", "ngram") for m in models]).distinct()


def stacked(models: list[DataFrame]) -> DataFrame:
    """(ord, ngram, p, b): merged keys with each model's prob (0 where it lacks the n-gram) and bow (1 there) in arrays.

    A full outer join of all models by one aggregation: every model's rows are tagged and pivoted."""
    n = len(models)
    tagged = [
        m.select("ord", "ngram", F.lit(i).alias("__i"), "prob", F.coalesce("bow", F.lit(1.0)).alias("bow"))
        for i, m in enumerate(models)
    ]
    rows = reduce(DataFrame.unionByName, tagged)
    each = lambda c, default: F.array(*[
        F.coalesce(F.max(F.when(F.col("__i") == i, F.col(c))), F.lit(default)) for i in range(n)
    ])
    return rows.groupBy("ord", "ngram").agg(each("prob", 0.0).alias("p"), each("bow", 1.0).alias("b"))


def refill(rows: DataFrame, order: int, heavy: DataFrame | None = None) -> dict[int, DataFrame]:
    """stacked rows by order, with hist, suffix and word, prob 0 filled by the suffix's prob (s) times the
    history's bow, in ascending order.  At order 1 there is nothing to fill from and s is 0.

    heavy: the frequent suffixes and histories (`heavy_sides`), whose joins are salted."""
    k = keyed(rows)
    heavy = checkpoint(heavy_sides(k.where("ord > 1"), "ord", ["suffix", "hist"])) if heavy is None else heavy
    out: dict[int, DataFrame] = {}
    for o in range(1, order + 1):
        own = k.where(F.col("ord") == o)
        if o == 1:
            out[o] = own.withColumn("s", F.transform("p", lambda x: F.lit(0.0)))
            continue
        lower = out[o - 1]
        below = lower.select(F.col("ngram").alias("suffix"), F.col("p").alias("__p"))
        above = lower.select(F.col("ngram").alias("hist"), F.col("b").alias("__b"))
        own = skew_join(own, below, ["suffix"], None, ["ngram"], heavy=of_side(heavy, o, "suffix"))
        own = skew_join(own, above, ["hist"], None, ["ngram"], heavy=of_side(heavy, o, "hist"))
        one = F.transform("p", lambda x: F.lit(1.0))
        zero = F.transform("p", lambda x: F.lit(0.0))
        q = F.zip_with(F.coalesce("__p", zero), F.coalesce("__b", one), lambda x, y: x * y)
        own = own.withColumns({"s": F.coalesce("__p", zero), "__q": q})
        own = own.withColumn("p", F.zip_with("p", "__q", lambda x, y: F.when(x == 0, y).otherwise(x)))
        own = own.drop("__p", "__b", "__q")
        out[o] = checkpoint(own) if o < order else own  # the next order reads it twice
    return out


def realign(counts: DataFrame, keys: DataFrame) -> DataFrame:
    """counts over other keys (ord, ngram): missing n-grams count 0, those that keys lacks are gone.

    Smoothing these counts again gives a component of a mixture over the mixture's n-grams."""
    return keys.select("ord", "ngram").join(counts.select("ord", "ngram", "cnt"), ["ord", "ngram"], "left").select(
        "ord", "ngram", F.coalesce("cnt", F.lit(0)).alias("cnt")
    )


def needed_keys(needed: DataFrame, keys: DataFrame, order: int) -> DataFrame:
    """Of the keys (ord, ngram) those that a mixture needs to give the probabilities of `needed` n-grams and the back-off
    weights of their histories: the n-grams, all followers of each history (a weight is a sum over them), and the suffixes
    and prefixes of all these."""
    own = needed.select("ord", "ngram").where(F.col("ord").between(1, order)).distinct()
    of = keyed(keys.select("ord", "ngram"))
    hists = keyed(own).where("ord > 1").select("ord", "hist").distinct()
    sizes = of.groupBy("ord", "hist").agg(F.count(F.lit(1)).alias("n_rows"))
    flagged = hists.withColumn("__in", F.lit(True))
    followers = skew_join(of.where("ord > 1"), flagged, ["ord", "hist"], sizes, ["ngram"]).where("__in").select("ord", "ngram")
    words = F.split("ngram", " ")
    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.col("ord")),
            lambda o: F.transform(
                F.sequence(F.lit(1), F.col("ord") - o + 1),
                lambda i: F.struct(o.alias("ord"), F.array_join(F.slice(words, i, o), " ").alias("ngram")),
            ),
        )
    )
    every = own.unionByName(followers).select(F.explode(inner).alias("__g")).select("__g.*").distinct()
    return keys.select("ord", "ngram").join(every, ["ord", "ngram"], "left_semi")
