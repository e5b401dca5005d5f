"""Smoothed back-off models: maximum likelihood and the Kneser-Ney family.

A model is one table (ord, ngram, hist, suffix, word, prob, bow); bow belongs to the n-gram as a history and is null at the
top order and where it is 1 because the history has no followers.

For fixed discounts the sum of discounts of a history is D1*N1 + D2*N2 + ... over integers N_i (followers with effective
count i), so a back-off weight doesn't depend on how the rows were partitioned.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from .counts import effective_counts, keyed
from .skew import heavy_sides, mark, of_side, skew_join

MAX_FEATURE_WEIGHT = 100.0


@dataclass(frozen=True)
class Smoothing:
    """kind: `ML`, `ML_COMPAT` or `KN`; discounts: number of discounts; tune: whether they are parameters."""

    kind: str
    discounts: int = 0
    tune: bool = False


def smoothing(name: str) -> Smoothing:
    """ML, ML_COMPAT; FixKN, FixModKN and FixKN<n> with 1, 3 and n fixed discounts; KN, ModKN and KN<n> with tunable
    ones."""
    if name in ("ML", "ML_COMPAT"):
        return Smoothing(name)
    m = re.fullmatch(r"(Fix)?(Mod)?KN(\d*)", name)
    if not m or (m[2] and m[3]) or m[3] == "0":
        raise ValueError(f"unknown smoothing {name}")
    return Smoothing("KN", int(m[3]) if m[3] else 3 if m[2] else 1, not m[1])


def smoothing_list(names: str, order: int) -> list[Smoothing]:
    """Smoothings of orders 1 to order from one name or one for each order, separated by commas."""
    each = [smoothing(x.strip()) for x in names.split(",")]
    if len(each) == 1:
        each *= order
    if len(each) != order:
        raise ValueError("give one smoothing or one for each order")
    return each


def check_bounds(discounts: list[float], weights: list[float] = ()) -> bool:
    """Whether parameters are in bounds: discount i within 0 to i, feature weights within +-100."""
    return all(0 <= d <= i for i, d in enumerate(discounts, 1)) and all(abs(x) <= MAX_FEATURE_WEIGHT for x in weights)


def discounts(eff: DataFrame, number: int) -> DataFrame:
    """(ord, d): an array of the discounts D_1 to D_number of each order; one row per order."""
    n = eff.groupBy("ord").agg(
        *[F.count(F.when(F.col("eff") == i, F.lit(1))).cast("double").alias(f"n{i}") for i in range(1, number + 2)],
        *([F.lit(0.0).alias("n2")] if number < 1 else []),
    )
    n1, n2 = F.col("n1"), F.col("n2")
    y = F.when((n1 == 0) & (n2 == 0), F.lit(1.0)).otherwise(n1 / F.nullif(n1 + 2 * n2, F.lit(0.0)))
    out = []
    for i in range(1, number + 1):
        d = F.lit(float(i)) - F.lit(float(i + 1)) * F.col("y") * F.col(f"n{i + 1}") / F.nullif(F.col(f"n{i}"), F.lit(0.0))
        out.append(F.when(F.col(f"n{i}") == 0, F.lit(float(i))).otherwise(F.least(F.greatest(d, F.lit(0.0)), F.lit(float(i)))))
    return n.withColumn("y", y).select("ord", "y", F.array(*out).alias("d"))


def discounts_by_order(eff: DataFrame, numbers: list[int]) -> DataFrame:
    """(ord, d) with numbers[o - 1] discounts at order o, the last one repeated up to the largest number.

    An order with 0 discounts has zeros: nothing is taken from its counts."""
    most = max(1, *numbers)
    every = discounts(eff, most).select("ord", "d")
    out = F
    for o, k in enumerate(numbers, 1):
        own = [F.element_at("d", min(i, k)) if k else F.lit(0.0) for i in range(1, most + 1)]
        out = out.when(F.col("ord") == o, F.array(*own))
    return every.select("ord", out.alias("d"))


def given_discounts(eff: DataFrame, values: dict[int, list[float]]) -> DataFrame:
    """(ord, d) of discounts given as parameters."""
    for order, d in values.items():
        if not check_bounds(d):
            raise ValueError(f"discounts of order {order} are out of bounds")
    most = max(1, *(len(d) for d in values.values()))
    full = [(o, [float(d[min(i, len(d) - 1)]) if d else 0.0 for i in range(most)]) for o, d in values.items()]
    return eff.sparkSession.createDataFrame(full, "ord int, d array<double>")


def _discount(number: int, eff: Column) -> Column:
    return F.when(eff > 0, F.element_at("d", F.least(eff, F.lit(number)).cast("int"))).otherwise(F.lit(0.0))


def history_sums(eff: DataFrame, number: int, weight: Column | None = None) -> DataFrame:
    """(ord, hist, tot, n, n_rows): per history the sum of effective counts, the numbers of followers with effective count
    1, 2, ... number or more, and of all.  With a weight: tot is the weighted sum and n the weighted numbers."""
    e = F.col("eff")
    w = weight if weight is not None else F.lit(1)
    bins = [F.sum(F.when((e == i) if i < number else (e >= i), w).otherwise(F.lit(0))) for i in range(1, number + 1)]
    return eff.groupBy("ord", "hist").agg(
        F.sum(w * e).alias("tot"), F.array(*bins).alias("n"), F.count(F.lit(1)).alias("n_rows")
    )


def back_off_weights(sums: DataFrame, d: DataFrame, number: int) -> DataFrame:
    """(ord, hist, tot, bow, n_rows); bow is 1 where the total is 0."""
    total = reduce(
        lambda a, b: a + b, [F.element_at("d", i) * F.element_at("n", i) for i in range(1, number + 1)]
    )
    return sums.join(F.broadcast(d), "ord").select(  # one row per order
        "ord",
        "hist",
        "tot",
        F.when(F.col("tot") > 0, total / F.col("tot")).otherwise(F.lit(1.0)).alias("bow"),
        "n_rows",
    )


def zero_order(counts: DataFrame, closed: bool) -> Column:
    """1 / number of unigrams, of those with a count above 0 in an open vocabulary, as a scalar subquery."""
    uni = counts.where("ord = 1" if closed else "ord = 1 and cnt > 0")
    n = uni.agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.when(F.col("n") > 0, 1.0 / F.col("n")).otherwise(F.lit(0.0))).scalar()


def kneser_ney(
    counts: DataFrame,
    order: int,
    number: int | list[int] = 3,
    closed: bool = False,
    given: dict[int, list[float]] | None = None,
    features: DataFrame | None = None,
    weights: list[float] | None = None,
    needed: DataFrame | None = None,
) -> DataFrame:
    """Kneser-Ney model with `number` discounts (1: plain, 3: modified), or with a number for each order.

    An order with 0 discounts is a maximum likelihood order: its raw counts over their sum, and nothing for back-off.

    given: discounts of each order instead of the estimated ones.  features: (ord, ngram, f array<double>), missing rows
    are zeros, with one weight for each: an n-gram then counts exp(weights . f) times.  needed: (ord, ngram); only these
    and the rows their probabilities depend on are estimated, with the same values.
    """
    numbers = list(number) if isinstance(number, (list, tuple)) else [number] * order
    if len(numbers) != order:
        raise ValueError("give one number of discounts for each order")
    number = max(1, *numbers)
    eff = keyed(effective_counts(counts, order))
    raw = [o for o, k in enumerate(numbers, 1) if not k]
    if raw:
        eff = eff.withColumn("eff", F.when(F.col("ord").isin(raw), F.col("cnt")).otherwise(F.col("eff")))
    eff = checkpoint(eff)
    weight = None
    if features is not None and weights:
        if not check_bounds([], weights):
            raise ValueError("feature weights are out of bounds")
        dot = reduce(
            lambda a, b: a + b,
            [F.coalesce(F.element_at("f", i + 1), F.lit(0.0)) * F.lit(float(x)) for i, x in enumerate(weights)],
        )
        eff = eff.join(features, ["ord", "ngram"], "left").withColumn("__weight", F.exp(F.coalesce(dot, F.lit(0.0)))).drop("f")
        weight = F.col("__weight")
    d = given_discounts(eff, given) if given else discounts_by_order(eff, numbers)
    want = None if needed is None else checkpoint(dependencies(needed, order))
    sums = history_sums(eff if want is None else _followers(eff, want), number, weight)
    bows = checkpoint(back_off_weights(sums, d, number))
    rows = eff.drop("n_left").join(F.broadcast(d), "ord")  # one row per order
    mass = (F.col("eff") - _discount(number, F.col("eff"))) * (weight if weight is not None else F.lit(1.0))
    rows = rows.select("ord", "ngram", "hist", "suffix", "word", "eff", mass.alias("mass"))
    p0 = zero_order(eff, closed)
    heavy = None
    if want is not None:
        rows = checkpoint(rows.join(want, ["ord", "ngram"], "left_semi"))
        heavy = checkpoint(heavy_sides(rows.where("ord > 1"), "ord", ["hist", "suffix"]))
    models: list[DataFrame] = []
    lower: DataFrame | None = None
    for o in range(1, order + 1):
        own = rows.where(F.col("ord") == o).drop("ord")
        of_hist = bows.where(F.col("ord") == o).select("hist", "tot", F.col("bow").alias("__bow"), "n_rows")
        if o == 1:  # one history, the empty one: a scalar, not a join
            of_empty = {"tot": of_hist.select("tot").scalar(), "__bow": of_hist.select("__bow").scalar()}
            joined = own.withColumns({**of_empty, "__lower": p0})
        else:
            below = lower.select(F.col("ngram").alias("suffix"), F.col("prob").alias("__lower"))
            if heavy is None:  # the counts that tell the heavy keys are there already
                joined = skew_join(own, of_hist.drop("n_rows"), ["hist"], of_hist.select("hist", "n_rows"), ["ngram"])
                by_suffix = eff.where(F.col("ord") == o - 1).select(F.col("ngram").alias("suffix"), F.col("n_left").alias("n_rows"))
                n_own = eff.where(F.col("ord") == o).agg(F.count(F.lit(1))).scalar()
                joined = skew_join(joined, below, ["suffix"], by_suffix, ["ngram"], total=n_own)
            else:
                joined = skew_join(own, of_hist.drop("n_rows"), ["hist"], None, ["ngram"], heavy=of_side(heavy, o, "hist"))
                joined = skew_join(joined, below, ["suffix"], None, ["ngram"], heavy=of_side(heavy, o, "suffix"))
        seen = F.when((F.col("eff") > 0) & (F.col("tot") > 0), F.col("mass") / F.col("tot")).otherwise(F.lit(0.0))
        prob = seen + F.coalesce("__lower", F.lit(0.0)) * F.col("__bow")
        if o == 1 and not closed:
            prob = F.when(F.col("eff") == 0, F.lit(0.0)).otherwise(prob)
        lower = joined.select(F.lit(o).alias("ord"), "ngram", "hist", "suffix", "word", prob.alias("prob"))
        lower = checkpoint(lower) if o < order else lower  # read by its own order and the next
        models.append(lower)
    probs = reduce(DataFrame.unionByName, models)
    return attach_bows(probs, bows)


def _followers(eff: DataFrame, want: DataFrame) -> DataFrame:
    """The rows of eff whose history is that of a wanted n-gram or is a wanted n-gram itself: what sums over histories need."""
    hists = keyed(want).select("hist").unionByName(want.select(F.col("ngram").alias("hist")))
    known = checkpoint(hists.distinct())  # a history's words tell its order
    return mark(eff, known, "hist", "__in", ["ngram"]).where("__in").drop("__in")


def attach_bows(probs: DataFrame, bows: DataFrame) -> DataFrame:
    """probs with the back-off weight of each n-gram as a history."""
    own = bows.where("ord > 1").select((F.col("ord") - 1).alias("ord"), F.col("hist").alias("ngram"), "bow")
    return probs.join(own, ["ord", "ngram"], "left").select("ord", "ngram", "hist", "suffix", "word", "prob", "bow")


def maximum_likelihood(counts: DataFrame, compat: bool = False) -> DataFrame:
    """prob = count / count of the history; with compat the divisor is the number of different followers.  bow is 0."""
    k = keyed(counts)
    divisor = F.count(F.lit(1)) if compat else F.sum("cnt")
    of_hist = k.groupBy("ord", "hist").agg(divisor.cast("double").alias("__tot"), F.count(F.lit(1)).alias("n_rows"))
    rows = skew_join(k, of_hist.drop("n_rows"), ["ord", "hist"], of_hist.select("ord", "hist", "n_rows"), ["ngram"])
    prob = F.when(F.col("__tot") > 0, F.col("cnt") / F.col("__tot")).otherwise(F.lit(0.0))
    probs = rows.select("ord", "ngram", "hist", "suffix", "word", prob.alias("prob"))
    return attach_bows(probs, of_hist.withColumn("bow", F.lit(0.0)))


def dependencies(needed: DataFrame, order: int) -> DataFrame:
    """needed (ord, ngram) with all their suffixes down to order 1, each once."""
    rows = needed.where(F.col("ord").between(1, order))
    words = F.split("ngram", " ")
    parts = F.transform(
        F.sequence(F.lit(1), F.col("ord")),
        lambda o: F.struct(o.alias("ord"), F.array_join(F.slice(words, F.col("ord") - o + 1, o), " ").alias("ngram")),
    )
    return rows.select(F.explode(parts).alias("__p")).select("__p.*").distinct()
