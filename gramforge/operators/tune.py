"""Tuning of discounts and interpolation weights on held-out text or lattices.

No Spark job runs per evaluation.  What a held-out set needs of the model is collected once as compact statistics whose
number is that of the set's distinct n-grams; each evaluation is a few numpy operations.  A set with more than `MAX_CONTEXTS`
of them raises `TooMany`, and the caller (`api`) lets each evaluation be a job over the needed rows instead, with the same
values.  Feature weights need sums over all followers of a history besides, whose number grows with the corpus: beyond
`MAX_CONTEXTS` sums these stay distributed and each evaluation is one aggregation.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from .counts import effective_counts, keyed
from .evaluate import contexts
from .lattice import Lattice, arc_contexts, word_errors
from .interpolate import Mixture, default_mixture
from .model import merged_keys, needed_keys, refill, stacked
from .optimize import Minimum, minimise
from .smoothing import MAX_FEATURE_WEIGHT, discounts, history_sums

MAX_CONTEXTS = 2_000_000


class TooMany(ValueError):
    """The held-out set has too many distinct n-grams for statistics on the driver."""


def _bounded(rows: DataFrame) -> list:
    got = rows.limit(MAX_CONTEXTS + 1).collect()
    if len(got) > MAX_CONTEXTS:
        raise TooMany(f"the tuning set has more than {MAX_CONTEXTS} distinct contexts")
    return got


def expand(params: np.ndarray, numbers: list[int]) -> np.ndarray | None:
    """Discounts by order, as many as the largest number, the last of an order repeated; null if one is out of bounds.  An
    order without discounts takes nothing."""
    most, at = max(1, *numbers), 0
    out = np.zeros((len(numbers), most))
    for o, k in enumerate(numbers):
        own = np.asarray(params[at : at + k], float)
        if np.any(own < 0) or np.any(own > np.arange(1, k + 1)):
            return None
        if k:
            out[o] = own[np.minimum(np.arange(most), k - 1)]
        at += k
    return out


@dataclass
class KneserNeyStatistics:
    """Per context: its count, the chain of (effective count, total, follower bins) of its suffixes from order 1 up to the
    matched order, and of the histories dropped above it."""

    order: int
    numbers: list[int]  # of discounts, by order
    p0: float
    default: np.ndarray  # discounts, order by order
    context: list[tuple[int, str]]
    count: np.ndarray
    matched: np.ndarray
    eff: np.ndarray  # (contexts, order), 0 where absent
    total: np.ndarray
    bins: np.ndarray  # (contexts, order, largest number)
    dropped: np.ndarray  # (contexts, order): whether the history of this order's n-gram was dropped and exists

    def log_probabilities(self, params: np.ndarray) -> np.ndarray | None:
        """ln of prob times dropped back-off weights of each context; null if a discount is out of bounds."""
        d = expand(params, self.numbers)
        if d is None:
            return None
        prob = np.full(len(self.count), self.p0)
        out = np.zeros(len(self.count))
        with np.errstate(divide="ignore", invalid="ignore"):
            for o in range(self.order):
                eff, total = self.eff[:, o], self.total[:, o]
                bow = np.where(total > 0, self.bins[:, o] @ d[o] / total, 1.0)
                cut = np.where(eff > 0, d[o][np.clip(eff, 1, d.shape[1]).astype(int) - 1], 0.0)
                seen = np.where((eff > 0) & (total > 0), (eff - cut) / total, 0.0)
                prob = np.where(o < self.matched, seen + bow * prob, prob)
                out += np.where(self.dropped[:, o], np.log(bow), 0.0)
            return out + np.log(prob)

    def entropy(self, params: np.ndarray) -> float:
        """Entropy; infinite if parameters are out of bounds."""
        lp = self.log_probabilities(params)
        if lp is None:
            return math.inf
        value = -(self.count @ lp) / max(1, self.count.sum())
        return math.inf if math.isnan(value) else float(value)


def _numbers(number: int | list[int], order: int) -> list[int]:
    return list(number) if isinstance(number, (list, tuple)) else [number] * order


def _effective(counts: DataFrame, order: int, numbers: list[int]) -> DataFrame:
    """Effective counts with keys; orders without discounts have their counts."""
    eff = keyed(effective_counts(counts, order))
    raw = [o for o, k in enumerate(numbers, 1) if not k]
    return eff.withColumn("eff", F.when(F.col("ord").isin(raw), F.col("cnt")).otherwise(F.col("eff"))) if raw else eff


def kneser_ney_statistics(
    counts: DataFrame, looked: DataFrame, order: int, number: int | list[int], closed: bool = False
) -> KneserNeyStatistics:
    """looked: (ctx, ngram, cnt) of the held-out set, made with the unigrams of counts as vocabulary.  number: of discounts,
    one for all orders or one for each."""
    numbers = _numbers(number, order)
    number = max(1, *numbers)
    eff = checkpoint(_effective(counts, order, numbers))
    sums = checkpoint(history_sums(eff, number))
    d = {r["ord"]: r["d"] for r in discounts(eff, number).collect()}
    uni = eff.where("ord = 1" if closed else "ord = 1 and cnt > 0").count()
    words = F.split("ngram", " ")
    tries = F.transform(
        F.sequence(F.lit(1), F.col("ctx")),
        lambda o: F.struct(
            o.alias("ord"),
            F.array_join(F.slice(words, F.col("ctx") - o + 1, o), " ").alias("g"),
            F.array_join(F.slice(words, F.col("ctx") - o + 1, o - 1), " ").alias("hist"),
        ),
    )
    rows = looked.select("ctx", "ngram", "cnt", F.explode(tries).alias("t")).select("ctx", "ngram", "cnt", "t.*")
    rows = rows.join(eff.select("ord", F.col("ngram").alias("g"), "eff"), ["ord", "g"], "left")
    rows = rows.join(sums.select("ord", "hist", "tot", "n"), ["ord", "hist"], "left")
    got = _bounded(rows.groupBy("ctx", "ngram").agg(F.first("cnt").alias("cnt"), F.collect_list(F.struct("ord", "eff", "tot", "n")).alias("t")))
    got.sort(key=lambda r: (r["ctx"], r["ngram"]))
    m = len(got)
    s = KneserNeyStatistics(
        order, numbers, 1.0 / uni if uni else 0.0,
        np.array([x for o, k in enumerate(numbers, 1) for x in d.get(o, [float(i + 1) for i in range(number)])[:k]], float),
        [(r["ctx"], r["ngram"]) for r in got], np.array([r["cnt"] for r in got], float), np.zeros(m, int),
        np.zeros((m, order)), np.zeros((m, order)), np.zeros((m, order, number)), np.zeros((m, order), bool),
    )
    for k, r in enumerate(got):
        for t in r["t"]:
            o = t["ord"] - 1
            if t["eff"] is not None:
                s.matched[k] = max(s.matched[k], t["ord"])
                s.eff[k, o] = t["eff"]
            if t["tot"] is not None:
                s.total[k, o], s.bins[k, o] = t["tot"], t["n"]
                s.dropped[k, o] = True
        s.dropped[k] &= np.arange(order) >= s.matched[k]
        s.dropped[k, 0] = False
    return s


@dataclass
class WeightedStatistics(KneserNeyStatistics):
    """The same with weighting features: an n-gram counts exp(weights . features) times, so of each needed history the
    followers with other features or another discount stay apart.  Parameters are the discounts, then one weight for each
    feature."""

    hists: dict[tuple[int, str], int] = None  # number of each needed history
    followers: DataFrame | None = None  # (ord, hist, bin, f, n, eff); null where they were collected
    hist_of: np.ndarray = None  # of the collected followers: history
    follower_bin: np.ndarray = None  # place of the discount
    follower_n: np.ndarray = None
    follower_eff: np.ndarray = None
    follower_features: np.ndarray = None  # (followers, features)
    own_features: np.ndarray = None  # (contexts, order, features)
    hist_at: np.ndarray = None  # (contexts, order): history of this order's n-gram, -1 where it doesn't exist

    def _sums(self, d: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weighted effective count, and what the discounts take of it, of each history; 0 at the end."""
        size = len(self.hists)
        if self.followers is None:
            w = np.exp(self.follower_features @ theta)
            total = np.bincount(self.hist_of, w * self.follower_eff, size)
            taken = np.bincount(self.hist_of, w * self.follower_n * d.ravel()[self.follower_bin], size)
            return np.append(total, 0.0), np.append(taken, 0.0)
        score = sum((F.lit(float(t)) * F.element_at("f", i + 1) for i, t in enumerate(theta)), F.lit(0.0))
        discount = F.element_at(F.array(*[F.lit(float(x)) for x in d.ravel()]), F.col("bin") + 1)
        rows = self.followers.withColumn("w", F.exp(score)).groupBy("ord", "hist")
        total, taken = np.zeros(size + 1), np.zeros(size + 1)
        for o, hist, t, x in rows.agg(F.sum(F.col("w") * F.col("eff")), F.sum(F.col("w") * F.col("n") * discount)).collect():
            total[self.hists[o, hist]], taken[self.hists[o, hist]] = t, x
        return total, taken

    def log_probabilities(self, params: np.ndarray) -> np.ndarray | None:
        n = sum(self.numbers)
        d, theta = expand(params[:n], self.numbers), np.asarray(params[n:], float)
        if d is None or np.any(np.abs(theta) > MAX_FEATURE_WEIGHT):
            return None
        total, taken = self._sums(d, theta)
        prob, out = np.full(len(self.count), self.p0), np.zeros(len(self.count))
        with np.errstate(divide="ignore", invalid="ignore"):
            for o in range(self.order):
                t, x, eff = total[self.hist_at[:, o]], taken[self.hist_at[:, o]], self.eff[:, o]
                bow = np.where(t > 0, x / t, 1.0)
                own = np.where(eff > 0, d[o][np.clip(eff, 1, d.shape[1]).astype(int) - 1], 0.0)
                seen = np.where((eff > 0) & (t > 0), np.exp(self.own_features[:, o] @ theta) * (eff - own) / t, 0.0)
                prob = np.where(o < self.matched, seen + bow * prob, prob)
                out += np.where(self.dropped[:, o], np.log(bow), 0.0)
            return out + np.log(prob)


def weighted_statistics(
    counts: DataFrame, looked: DataFrame, order: int, number: int | list[int], features: DataFrame, n_features: int, closed: bool = False
) -> WeightedStatistics:
    """features: (ord, ngram, f array<double>).  The followers of the held-out set's histories are summed by history,
    discount and features; at most `MAX_CONTEXTS` such sums are collected, more stay distributed."""
    numbers = _numbers(number, order)
    s, number = kneser_ney_statistics(counts, looked, order, numbers, closed), max(1, *numbers)
    eff = _effective(counts, order, numbers).select("ord", "ngram", "hist", "eff")
    f = F.coalesce("f", F.array(*[F.lit(0.0)] * n_features))
    eff = checkpoint(eff.join(features, ["ord", "ngram"], "left").withColumn("f", f))
    words = F.split("ngram", " ")
    tries = F.transform(
        F.sequence(F.lit(1), F.col("ctx")),
        lambda o: F.struct(
            o.alias("ord"),
            F.array_join(F.slice(words, F.col("ctx") - o + 1, o), " ").alias("g"),
            F.array_join(F.slice(words, F.col("ctx") - o + 1, o - 1), " ").alias("hist"),
        ),
    )
    parts = looked.select("ctx", "ngram", F.explode(tries).alias("t")).select("ctx", "ngram", "t.*")
    own = parts.join(eff.select("ord", F.col("ngram").alias("g"), "f"), ["ord", "g"]).groupBy("ctx", "ngram")
    own = {(r["ctx"], r["ngram"]): r["t"] for r in _bounded(own.agg(F.collect_list(F.struct("ord", "f")).alias("t")))}
    place = ((F.col("ord") - 1) * number + F.least("eff", F.lit(number)) - 1).cast("int").alias("bin")
    followers = eff.where("eff > 0").join(parts.select("ord", "hist").distinct(), ["ord", "hist"], "left_semi")
    followers = followers.groupBy("ord", "hist", place, "f").agg(F.count(F.lit(1)).alias("n"), F.sum("eff").alias("eff"))
    followers = checkpoint(followers)
    # at most one history for each context and order
    hists = {(r["ord"], r["hist"]): i for i, r in enumerate(followers.select("ord", "hist").distinct().orderBy("ord", "hist").collect())}
    few = followers.count() <= MAX_CONTEXTS
    got = followers.orderBy("ord", "hist", "bin", "f").collect() if few else []
    m = len(s.count)
    own_features, hist_at = np.zeros((m, order, n_features)), np.full((m, order), -1)
    for i, (ctx, ngram) in enumerate(s.context):
        w = ngram.split(" ")
        for o in range(1, ctx + 1):
            hist_at[i, o - 1] = hists.get((o, " ".join(w[ctx - o : -1])), -1)
        for o, values in own.get((ctx, ngram), []):
            own_features[i, o - 1] = values
    fields = {k: getattr(s, k) for k in KneserNeyStatistics.__dataclass_fields__}
    fields["default"] = np.concatenate([s.default, np.zeros(n_features)])
    return WeightedStatistics(
        **fields, hists=hists, followers=None if few else followers,
        hist_of=np.array([hists[r["ord"], r["hist"]] for r in got], int), follower_bin=np.array([r["bin"] for r in got], int),
        follower_n=np.array([r["n"] for r in got], float), follower_eff=np.array([r["eff"] for r in got], float),
        follower_features=np.array([r["f"] for r in got], float).reshape(-1, n_features),
        own_features=own_features, hist_at=hist_at,
    )


def tune_perplexity(s: KneserNeyStatistics, technique: str = "Powell") -> Minimum:
    """Discounts (and feature weights) of least entropy, starting from the estimated ones; never worse than these."""
    return minimise(technique, s.entropy, s.default)


def held_out_contexts(counts: DataFrame, tokens: DataFrame, order: int, keep: list[str]) -> DataFrame:
    """(ctx, ngram, cnt) of held-out tokens, with the unigrams of counts as vocabulary."""
    return contexts(tokens, counts, order, keep)[0]


class Objective:
    """WER and margin of collected lattices as functions of a model's parameters.

    s: statistics of the lattices' contexts (with `context`, `default` and `log_probabilities`).  Fails, as rescoring does, on
    an arc whose histories differ in their score."""

    def __init__(self, s: KneserNeyStatistics | MixtureStatistics, looked: DataFrame, arcs: DataFrame, refs: DataFrame) -> None:
        self.s = s
        index = {c: i for i, c in enumerate(self.s.context)}
        each = looked.groupBy("tag", "arc").agg(F.array_sort(F.collect_set(F.struct("ctx", "ngram"))).alias("c"))
        rows = _bounded(arcs.join(each, ["tag", "arc"]).orderBy("tag", "src", "dst", "arc"))
        # of arcs with several contexts: the first and each other one
        self.first = np.array([index[tuple(r["c"][0])] for r in rows for _ in r["c"][1:]], int)
        self.other = np.array([index[tuple(c)] for r in rows for c in r["c"][1:]], int)
        self.other_tag = [r["tag"] for r in rows for _ in r["c"][1:]]
        words = {r["tag"]: list(r["words"] or []) for r in _bounded(refs.select("tag", "words"))}
        self.lattices: list[tuple[Lattice, np.ndarray, np.ndarray, list[str]]] = []
        by_tag: dict[str, list] = {}
        for r in rows:
            by_tag.setdefault(r["tag"], []).append(r)
        for tag, g in by_tag.items():
            base = np.array([r["base_w"] for r in g])
            at = np.array([index[tuple(r["c"][0])] for r in g])
            self.lattices.append((Lattice([r["src"] for r in g], [r["dst"] for r in g], [r["word"] for r in g], base.tolist()), base, at, words.get(tag, [])))
        self._weighed(self.s.default)

    def _weighed(self, params: np.ndarray) -> bool:
        lp = self.s.log_probabilities(params)
        if lp is None:
            return False
        with np.errstate(invalid="ignore"):
            differ = np.abs(lp[self.first] - lp[self.other]) > 1e-9
        if differ.any():
            raise ValueError(f"lattice history not unique: {self.other_tag[int(differ.argmax())]}")
        for lattice, base, at, _ in self.lattices:
            lattice.weight = (base - lp[at]).tolist()
        return True

    def word_error_rate(self, params: np.ndarray) -> float:
        """Percent; 100 if parameters are out of bounds."""
        if not self._weighed(params):
            return 100.0
        errors = sum(word_errors(x.words(x.best_path()[1]), ref) for x, _, _, ref in self.lattices)
        return 100.0 * errors / max(1, sum(len(ref) for *_, ref in self.lattices))

    def negative_margin(self, params: np.ndarray) -> float:
        """Minus the mean margin, infinite if parameters are out of bounds."""
        if not self._weighed(params):
            return math.inf
        return -sum(x.margin(ref) for x, _, _, ref in self.lattices) / max(1, len(self.lattices))

    def tune(self, what: str, technique: str = "Powell") -> Minimum:
        f = {"wer": self.word_error_rate, "margin": self.negative_margin}[what]
        return minimise(technique, f, self.s.default)


class LatticeObjective(Objective):
    """The same for the discounts of a Kneser-Ney model."""

    def __init__(self, counts: DataFrame, arcs: DataFrame, refs: DataFrame, order: int, number: int | list[int]) -> None:
        looked = checkpoint(arc_contexts(arcs, order))
        s = kneser_ney_statistics(counts, _each_context(looked), order, number)
        super().__init__(s, looked, arcs, refs)


def _each_context(looked: DataFrame) -> DataFrame:
    return looked.groupBy("ctx", "ngram").agg(F.count(F.lit(1)).alias("cnt"))


@dataclass
class MixtureStatistics:
    """Per context the components' probabilities at the matched n-gram and the features of its history; per dropped history
    the sums of the components' probabilities over its followers and over their suffixes, with the features of the history
    and of its suffix.

    All followers of a history share its weights, and their suffixes the weights of the history's suffix, so the mixture's
    sums are weighted sums of these, for any interpolation."""

    mixture: Mixture
    absent: float
    context: list[tuple[int, str]]
    count: np.ndarray
    matched: np.ndarray  # order
    prob: np.ndarray  # (contexts, models)
    feature: np.ndarray  # (contexts, models, features)
    drop_of: np.ndarray  # context of each dropped history
    drop_order: np.ndarray  # order of the n-gram that isn't there
    seen: np.ndarray  # (dropped, models)
    below: np.ndarray
    feature_seen: np.ndarray  # (dropped, models, features)
    feature_below: np.ndarray

    @property
    def default(self) -> np.ndarray:
        return np.array(self.mixture.params(), float)

    def _weights(self, mixture: Mixture, order: np.ndarray, feature: np.ndarray) -> np.ndarray:
        """(rows, models), summing to 1."""
        out = np.zeros(feature.shape[:2])
        for o in np.unique(order):
            own = order == o
            score = np.tile([0.0, *mixture.of_order(mixture.biases, int(o))], (int(own.sum()), 1))
            for i, of_model in enumerate(mixture.features):
                for k in range(len(of_model)):
                    score[:, i] += mixture.of_order(mixture.coefficients, int(o))[i][k] * feature[own, i, k]
            score = np.exp(score - score.max(axis=1, keepdims=True))
            out[own] = score / score.sum(axis=1, keepdims=True)
        return out

    def log_probabilities(self, params: np.ndarray) -> np.ndarray | None:
        """ln of prob times dropped back-off weights of each context."""
        m = self.mixture.with_params([float(x) for x in params])
        with np.errstate(divide="ignore", invalid="ignore"):
            lp = np.log((self.prob * self._weights(m, self.matched, self.feature)).sum(axis=1))
            if len(self.drop_of):
                up = self._weights(m, self.drop_order, self.feature_seen)
                low = self._weights(m, self.drop_order - 1, self.feature_below)
                rest = 1 - (self.below * low).sum(axis=1)
                bow = np.where(rest > 1e-9, np.maximum((1 - (self.seen * up).sum(axis=1)) / rest, 0.0), 0.0)
                np.add.at(lp, self.drop_of, np.log(bow))
        return lp

    def entropy(self, params: np.ndarray) -> float:
        """Words of probability 0 add nothing, as in `evaluate.perplexity`."""
        lp = self.log_probabilities(params)
        ok = self.prob.any(axis=1)
        with np.errstate(invalid="ignore"):
            value = -(self.count[ok] @ lp[ok]) / max(1, self.count[ok].sum())
        return math.inf if math.isnan(value) else float(value)

    def tune(self, technique: str = "LBFGS") -> Minimum:
        return minimise(technique, self.entropy, self.default)


def mixture_statistics(
    models: list[DataFrame], looked: DataFrame, order: int, mixture: Mixture | None = None, absent: float = 0.0
) -> MixtureStatistics:
    """looked: (ctx, ngram, cnt) of the held-out set, made with the unigrams of all models as vocabulary."""
    n = len(models)
    mixture = mixture or default_mixture(n, order)
    words = F.split("ngram", " ")
    piece = lambda a, size: F.array_join(F.slice(words, a, size), " ")
    tries = F.transform(
        F.sequence(F.lit(1), F.col("ctx")),
        lambda o: F.struct(
            o.alias("ord"),
            piece(F.col("ctx") - o + 1, o).alias("g"),
            piece(F.col("ctx") - o + 1, o - 1).alias("hist"),
            piece(F.col("ctx") - o + 2, F.greatest(o - 2, F.lit(0))).alias("low"),
        ),
    )
    t = checkpoint(looked.select("ctx", "ngram", "cnt", F.explode(tries).alias("t")).select("ctx", "ngram", "cnt", "t.*"))
    rows = checkpoint(stacked(models))
    needed = needed_keys(t.select("ord", F.col("g").alias("ngram")).distinct(), rows, order)
    by_order = refill(checkpoint(rows.join(needed, ["ord", "ngram"], "left_semi")), order)
    most = max(1, *(len(f) for f in mixture.features))
    hists = t.select((F.col("ord") - 1).alias("ord"), F.col("hist").alias("ngram"))
    hists = hists.unionByName(t.where("ord > 1").select((F.col("ord") - 2).alias("ord"), F.col("low").alias("ngram"))).distinct()
    for i, of_model in enumerate(mixture.features):
        for k, table in enumerate(of_model):
            hists = hists.join(table.select("ord", "ngram", F.col("value").alias(f"__f{i}_{k}")), ["ord", "ngram"], "left")
    value = lambda i, k: F.coalesce(F.col(f"__f{i}_{k}"), F.lit(absent)) if k < len(mixture.features[i]) else F.lit(0.0)
    hists = checkpoint(hists.select("ord", "ngram", F.array(*[value(i, k) for i in range(n) for k in range(most)]).alias("f")))
    parts = None
    for o, own in by_order.items():
        grams = own.select(F.col("ngram").alias("g"), "p")
        sums = own.groupBy("hist").agg(
            F.array(*[F.sum(F.element_at("p", i + 1)) for i in range(n)]).alias("seen"),
            F.array(*[F.sum(F.element_at("s", i + 1)) for i in range(n)]).alias("below"),
        )
        up = hists.where(F.col("ord") == o - 1).select(F.col("ngram").alias("hist"), F.col("f").alias("up"))
        down = hists.where(F.col("ord") == o - 2).select(F.col("ngram").alias("low"), F.col("f").alias("down"))
        part = t.where(F.col("ord") == o).join(grams, "g", "left").join(sums, "hist", "left").join(up, "hist", "left").join(down, "low", "left")
        part = part.select("ctx", "ngram", "cnt", "ord", "p", "seen", "below", "up", "down")
        parts = part if parts is None else parts.unionByName(part)
    each = F.collect_list(F.struct("ord", "p", "seen", "below", "up", "down"))
    got = _bounded(parts.groupBy("ctx", "ngram").agg(F.first("cnt").alias("cnt"), each.alias("t")))
    got.sort(key=lambda r: (r["ctx"], r["ngram"]))
    matched, prob, feature, drops = [], [], [], []
    for k, r in enumerate(got):
        there = [x for x in r["t"] if x["p"] is not None]
        if not there:
            raise ValueError(f"out-of-vocabulary word in {r['ngram']!r}")
        best = max(there, key=lambda x: x["ord"])
        matched.append(best["ord"])
        prob.append(best["p"])
        feature.append(best["up"])
        drops += [(k, x) for x in r["t"] if x["ord"] > best["ord"] and x["seen"] is not None]
    table = lambda rows, *shape: np.array(rows, float).reshape(-1, n, *shape)
    return MixtureStatistics(
        mixture, absent, [(r["ctx"], r["ngram"]) for r in got], np.array([r["cnt"] for r in got], float), np.array(matched, int),
        table(prob), table(feature, most), np.array([k for k, _ in drops], int), np.array([x["ord"] for _, x in drops], int),
        table([x["seen"] for _, x in drops]), table([x["below"] for _, x in drops]),
        table([x["up"] for _, x in drops], most), table([x["down"] for _, x in drops], most),
    )


def mixture_contexts(models: list[DataFrame], tokens: DataFrame, order: int, keep: list[str]) -> DataFrame:
    """(ctx, ngram, cnt) of held-out tokens, with the unigrams of all models as vocabulary."""
    return contexts(tokens, merged_keys([m.where("ord = 1") for m in models]), order, keep)[0]


def mixture_lattices(
    models: list[DataFrame], arcs: DataFrame, refs: DataFrame, order: int, mixture: Mixture, absent: float = 0.0
) -> Objective:
    """WER and margin as functions of the parameters of a mixture."""
    looked = checkpoint(arc_contexts(arcs, order))
    return Objective(mixture_statistics(models, _each_context(looked), order, mixture, absent), looked, arcs, refs)
