"""Interpolation of several models: linear (LI), count merging (CM) and generalised linear (GLI).

weight_l(h) = exp(bias_l + sum of coefficients times features of h in model l), normalised over the models; LI has no
features, CM the one feature ln(total effective count of h in model l) with coefficient 1.  The result is a static model
with renormalised back-off weights.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from .counts import keyed
from .model import needed_keys, refill, stacked
from .skew import heavy_sides, of_side, skew_join


@dataclass
class Mixture:
    """Parameters: biases per order (one row for all orders if tied) and coefficients per order and model.

    The first model's bias is 0; biases has one value for each other model.  features: per model the feature tables (ord,
    ngram of the history, value)."""

    biases: list[list[float]]
    coefficients: list[list[list[float]]] = field(default_factory=list)
    features: list[list[DataFrame]] = field(default_factory=list)
    tuned_coefficients: bool = False  # whether coefficients are parameters
    tie_models: bool = False  # one set of coefficients for all models

    def of_order(self, values: list, order: int) -> list:
        return values[min(order, len(values)) - 1]

    def params(self) -> list[float]:
        """Biases of all models but the first, row by row, then the coefficients, row by row and model by model."""
        out = [x for row in self.biases for x in row]
        if self.tuned_coefficients:
            out += [x for row in self.coefficients for c in (row[:1] if self.tie_models else row) for x in c]
        return out

    def with_params(self, params: list[float]) -> Mixture:
        """The same mixture with other parameters."""
        if len(params) != len(self.params()):
            raise ValueError(f"expected {len(self.params())} parameters")
        rest = iter(params)
        biases = [[next(rest) for _ in row] for row in self.biases]
        coefficients = self.coefficients
        if self.tuned_coefficients:
            coefficients = []
            for row in self.coefficients:
                first = [next(rest) for _ in row[0]]
                coefficients.append([list(first) if i == 0 or self.tie_models else [next(rest) for _ in c] for i, c in enumerate(row)])
        return replace(self, biases=biases, coefficients=coefficients)


def default_mixture(n: int, order: int, features: list[list[DataFrame]] | None = None, tie_order: bool = True) -> Mixture:
    """Equal biases; every coefficient 1."""
    rows = 1 if tie_order else order
    fs = features or [[] for _ in range(n)]
    return Mixture([[0.0] * (n - 1) for _ in range(rows)], [[[1.0] * len(f) for f in fs] for _ in range(rows)], fs)


def count_merging_features(effective: list[DataFrame]) -> list[list[DataFrame]]:
    """Per model the feature ln(sum of the effective counts of a history's followers + 1e-99), from (ord, hist, eff)."""
    out = []
    for e in effective:
        total = e.groupBy((F.col("ord") - 1).alias("ord"), F.col("hist").alias("ngram")).agg(F.sum("eff").alias("t"))
        out.append([total.select("ord", "ngram", F.log(F.col("t") + F.lit(1e-99)).alias("value"))])
    return out



#: Feature value of a history without counts in count merging.
NO_COUNT = math.log(1e-99)


def interpolate(
    models: list[DataFrame], order: int, mixture: Mixture, absent: float = 0.0, needed: DataFrame | None = None
) -> DataFrame:
    """(ord, ngram, hist, suffix, word, prob, bow) of the interpolated model.

    absent: feature value of histories that a feature table lacks (ln(1e-99) for count merging).  A history whose seen
    words take all of the back-off mass gets back-off weight 0.  needed: (ord, ngram); only the rows that their
    probabilities and the back-off weights of their histories depend on are mixed, with the same values; back-off weights of
    other histories are null.

    Joins on suffixes and histories are salted for frequent keys; the empty history's weights are scalars.
    """
    rows = stacked(models)
    if needed is not None:
        rows = checkpoint(rows)
        rows = rows.join(needed_keys(needed, rows, order), ["ord", "ngram"], "left_semi")
    rows = checkpoint(rows)
    heavy = checkpoint(heavy_sides(keyed(rows).where("ord > 1"), "ord", ["suffix", "hist"]))
    by_order = refill(rows, order, heavy)
    n = len(models)
    has_features = any(mixture.features)
    lower: DataFrame | None = None
    probs, bows = [], []
    for o in range(1, order + 1):
        own = by_order[o]
        bias = [0.0, *mixture.of_order(mixture.biases, o)]
        if not has_features:
            top_bias = max(bias)
            own = own.withColumn("__w", F.array(*[F.lit(math.exp(b - top_bias)) for b in bias]))
        elif o == 1:  # one history, the empty one: scalars, not a join
            value = lambda t: t.where("ord = 0").agg(F.first("value")).scalar()
            own = own.withColumn("__w", _weights(mixture, o, [[value(t) for t in ts] for ts in mixture.features], bias, absent))
        else:
            # the lookup is per history: (hist, weights) is made once and joined by history
            hists = own.select("hist").distinct()
            for i in range(n):
                for k, table in enumerate(mixture.features[i]):
                    of = table.where(F.col("ord") == o - 1).select(F.col("ngram").alias("hist"), F.col("value").alias(f"__f{i}_{k}"))
                    hists = hists.join(of, "hist", "left")
            values = [[F.col(f"__f{i}_{k}") for k in range(len(mixture.features[i]))] for i in range(n)]
            hists = hists.select("hist", _weights(mixture, o, values, bias, absent).alias("__w"))
            own = skew_join(own, hists, ["hist"], None, ["ngram"], heavy=of_side(heavy, o, "hist"))
        weight = F.aggregate("__w", F.lit(0.0), lambda a, x: a + x)
        mixed = F.aggregate(F.zip_with("__w", "p", lambda w, p: w * p), F.lit(0.0), lambda a, x: a + x)
        own = own.select(F.lit(o).alias("ord"), "ngram", "hist", "suffix", "word", (mixed / weight).alias("prob"))
        own = checkpoint(own)  # read by its own order, its back-off weights and the next order
        if lower is not None:
            below = lower.select(F.col("ngram").alias("suffix"), F.col("prob").alias("__below"))
            both = skew_join(own, below, ["suffix"], None, ["ngram"], heavy=of_side(heavy, o, "suffix"))
            sums = both.groupBy("hist").agg(F.sum("prob").alias("p"), F.sum(F.coalesce("__below", F.lit(0.0))).alias("q"))
            bow = F.when(1 - F.col("q") > 1e-9, F.greatest((1 - F.col("p")) / (1 - F.col("q")), F.lit(0.0))).otherwise(0.0)
            bows.append(sums.select(F.lit(o - 1).alias("ord"), F.col("hist").alias("ngram"), bow.alias("bow")))
        probs.append(own)
        lower = own
    result = reduce(DataFrame.unionByName, probs)
    if not bows:
        return result.withColumn("bow", F.lit(None).cast("double"))
    weights = reduce(DataFrame.unionByName, bows)
    if needed is not None:
        known = keyed(needed.where("ord > 1")).select((F.col("ord") - 1).alias("ord"), F.col("hist").alias("ngram")).distinct()
        weights = weights.join(known, ["ord", "ngram"], "left_semi")
    return result.join(weights, ["ord", "ngram"], "left")


def _weights(mixture: Mixture, order: int, values: list[list[Column]], bias: list[float], absent: float) -> Column:
    """Array of the models' weights, the largest being 1, from the values of their features."""
    parts = []
    for i, of_model in enumerate(values):
        score = F.lit(bias[i])
        for k, value in enumerate(of_model):
            score = score + F.lit(mixture.of_order(mixture.coefficients, order)[i][k]) * F.coalesce(value, F.lit(absent))
        parts.append(score)
    top = F.greatest(*parts) if len(parts) > 1 else parts[0]
    return F.array(*[F.exp(x - top) for x in parts])
