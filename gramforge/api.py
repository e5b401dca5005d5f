"""What the command line does, as functions: estimate, evaluate and interpolate models."""

from __future__ import annotations

import logging
import os
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import counts as C
from .operators import evaluate as E
from .operators import features as X
from .operators import interpolate as I
from .operators import lattice as L
from .operators import model as M
from .operators import smoothing as S
from .operators import tune
from .session import checkpoint
from .sources import files

log = logging.getLogger("gramforge")


@dataclass
class Estimated:
    """Counts of a corpus and the model made of them."""

    spark: SparkSession
    order: int
    counts: DataFrame
    smoothings: list[S.Smoothing]
    closed: bool = False
    features: list[DataFrame] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    params: np.ndarray | None = None
    _model: DataFrame | None = None

    def feature_table(self) -> DataFrame | None:
        """(ord, ngram, f) of all weighting features."""
        if not self.features:
            return None
        keys = self.counts.select("ord", "ngram")
        out = keys
        for i, f in enumerate(self.features):
            out = out.join(X.align(f, keys).withColumnRenamed("value", f"__v{i}"), ["ord", "ngram"])
        return out.select("ord", "ngram", F.array(*[F.col(f"__v{i}") for i in range(len(self.features))]).alias("f"))

    def model(self) -> DataFrame:
        if self._model is None:
            kinds = {s.kind for s in self.smoothings}
            if kinds <= {"ML", "ML_COMPAT"} and len(kinds) == 1:
                m = S.maximum_likelihood(self.counts, kinds == {"ML_COMPAT"})
            elif "ML_COMPAT" in kinds:
                raise ValueError("ML_COMPAT can't be mixed with other smoothings")
            else:
                m = self._smoothed(self.counts)
            self._model = checkpoint(m)
        return self._model

    def _smoothed(self, counts: DataFrame, needed: DataFrame | None = None) -> DataFrame:
        given, weights = None, self.weights
        if self.params is not None:
            given, at = {}, 0
            for o, k in enumerate(self.discounts, 1):
                given[o] = [float(x) for x in self.params[at : at + k]]
                at += k
            weights = [float(x) for x in self.params[at:]] or weights
        return S.kneser_ney(counts, self.order, self.discounts, self.closed, given, self.feature_table(), weights or None, needed)

    def realigned(self, keys: DataFrame) -> DataFrame:
        """The model smoothed again over other n-grams, with the present parameters: a component of a mixture."""
        return checkpoint(self._smoothed(checkpoint(M.realign(self.counts, keys))))

    @property
    def discounts(self) -> list[int]:
        """Number of discounts of each order."""
        if any(s.kind == "ML_COMPAT" for s in self.smoothings) or not any(s.discounts for s in self.smoothings):
            raise ValueError("parameters need Kneser-Ney smoothing")
        return [s.discounts for s in self.smoothings]

    @property
    def n_params(self) -> int:
        return sum(self.discounts) + len(self.features)

    def effective(self) -> DataFrame:
        return C.effective_counts(self.counts, self.order)

    def with_params(self, params: np.ndarray) -> None:
        self.params, self._model = np.asarray(params, float), None

    def tune_perplexity(self, tokens: DataFrame, technique: str) -> tune.Minimum:
        try:
            looked = tune.held_out_contexts(self.counts, tokens, self.order, [])
            if self.features:
                s = tune.weighted_statistics(self.counts, looked, self.order, self.discounts, self.feature_table(), len(self.features), self.closed)
            else:
                s = tune.kneser_ney_statistics(self.counts, looked, self.order, self.discounts, self.closed)
            best = tune.tune_perplexity(s, technique)
        except tune.TooMany:
            best = self._by_jobs(technique, *_job_entropy(tokens, self.order))
        self.with_params(best.x)
        return best

    def tune_lattices(self, arcs: DataFrame, refs: DataFrame, what: str, technique: str) -> tune.Minimum:
        """what: wer or margin."""
        try:
            o = tune.LatticeObjective(self.counts, arcs, refs, self.order, self.discounts)
            best = o.tune(what, technique)
        except tune.TooMany:
            best = self._by_jobs(technique, *_job_lattices(arcs, refs, self.order, what))
        self.with_params(best.x)
        return best

    def _by_jobs(self, technique: str, needed: DataFrame, value: Callable[[DataFrame], float]) -> tune.Minimum:
        """Tuning on a set too large for the driver: each evaluation is a job over the needed rows."""
        eff = checkpoint(self.effective())
        d = {r["ord"]: r["d"] for r in S.discounts(eff, max(1, *self.discounts)).collect()}
        start = [x for o, k in enumerate(self.discounts, 1) for x in d[o][:k]] + [0.0] * len(self.features)

        def cost(x: np.ndarray) -> float:
            if tune.expand(x[: sum(self.discounts)], self.discounts) is None:
                return float("inf")
            self.with_params(x)
            return value(checkpoint(self._smoothed(self.counts, needed)))

        return tune.minimise(technique, cost, np.array(start))


def _job_entropy(tokens: DataFrame, order: int) -> tuple[DataFrame, Callable[[DataFrame], float]]:
    tokens = checkpoint(tokens)

    def value(model: DataFrame) -> float:
        entropy = E.perplexity(tokens, model, order, []).first()["entropy"]
        return float("inf") if entropy is None else entropy

    return checkpoint(C.count_ngrams(tokens, order).select("ord", "ngram")), value


def _job_lattices(arcs: DataFrame, refs: DataFrame, order: int, what: str) -> tuple[DataFrame, Callable[[DataFrame], float]]:
    arcs = checkpoint(arcs)

    def value(model: DataFrame) -> float:
        got = L.word_error_rate(L.utterances(L.rescore(arcs, model, order), refs)).first()[what]
        return float("inf") if got is None else {"wer": got, "margin": -got}[what]

    return checkpoint(L.needed_ngrams(arcs, order)), value


def load_counts(
    spark: SparkSession,
    order: int,
    text: str | None = None,
    counts: str | None = None,
    vocab: str | None = None,
    unknown: bool = False,
) -> DataFrame:
    """Counts of corpus files and counts files together, over a closed vocabulary if one is given."""
    parts = []
    if text:
        parts.append(C.count_ngrams(files.corpus(spark, text), order))
    if counts:
        for name in files.paths(counts):
            parts.append(files.read_table(spark, name).where(F.col("ord") <= order) if files.is_table(name) else files.counts(spark, name, order))
    if not parts:
        raise ValueError("give texts or counts")
    all_counts = parts[0]
    for p in parts[1:]:
        all_counts = all_counts.unionByName(p)
    if len(parts) > 1:
        all_counts = all_counts.groupBy("ord", "ngram").agg(F.sum("cnt").alias("cnt"))
    if vocab:
        words = files.vocab(spark, vocab)
        all_counts = checkpoint(all_counts)
        all_counts = C.replace_unknown(all_counts, words) if unknown else all_counts
        if unknown:
            words = words.unionByName(spark.createDataFrame([("<unk>",)], "word string"))
        all_counts = C.close_vocabulary(checkpoint(all_counts), words)
    return checkpoint(all_counts)


def load_feature(spark: SparkSession, text: str, order: int, corpus: str | None) -> DataFrame:
    """A computed feature `f1:f2:loader:file`."""

    def load(loader: str | None, source: str) -> DataFrame:
        if loader in ("freq", "entropy"):
            return files.documents(spark, source)
        if loader:
            return files.hmm_lda(spark, source)
        return files.features(spark, source)

    made = X.feature(text, order, load, corpus)
    most = made.agg(F.max("value")).first()[0]
    if most is not None and most > X.WARN_ABOVE:
        log.warning("feature %s has values up to %g; above %g weights may overflow", text, most, X.WARN_ABOVE)
    return made


def estimate(
    spark: SparkSession,
    order: int = 3,
    text: str | None = None,
    counts: str | None = None,
    vocab: str | None = None,
    unknown: bool = False,
    smoothing: str = "ModKN",
    weight_features: str | None = None,
    weights: list[float] | None = None,
) -> Estimated:
    names = S.smoothing_list(smoothing, order)
    table = load_counts(spark, order, text, counts, vocab, unknown)
    fs = [load_feature(spark, f, order, text) for f in (weight_features or "").split(",") if f]
    return Estimated(spark, order, table, names, bool(vocab), fs, weights or [0.0] * len(fs))


@dataclass
class Mixed:
    """Component models and their interpolation."""

    order: int
    models: list[DataFrame]
    mixture: I.Mixture
    absent: float
    components: list[Estimated | None] = field(default_factory=list)  # what can be smoothed again
    _model: DataFrame | None = None

    def model(self) -> DataFrame:
        if self._model is None:
            self._model = checkpoint(I.interpolate(self.models, self.order, self.mixture, self.absent))
        return self._model

    def with_params(self, params: list[float]) -> None:
        self.mixture, self._model = self.mixture.with_params([float(x) for x in params]), None

    def params(self) -> list[float]:
        return self.mixture.params()

    def smooth_again(self, params: list[np.ndarray | None]) -> None:
        """Components of counts with other discounts and feature weights, smoothed again over the n-grams of all models; null
        leaves a component as it is."""
        keys = checkpoint(M.merged_keys(self.models))
        for i, (c, p) in enumerate(zip(self.components, params, strict=True)):
            if p is None:
                continue
            if c is None:
                raise ValueError("a loaded model can't be smoothed again")
            c.with_params(p)
            self.models[i] = c.realigned(keys)
        self._model = None

    def tune_components(self, tokens: DataFrame, technique: str) -> None:
        """Discounts of each component of counts, tuned on its own, then all are smoothed again."""
        made = [None if c is None else c.tune_perplexity(tokens, technique).x for c in self.components]
        self.smooth_again(made)

    def tune_perplexity(self, tokens: DataFrame, technique: str) -> tune.Minimum:
        """On compact statistics, for every kind of interpolation."""
        try:
            looked = tune.mixture_contexts(self.models, tokens, self.order, [])
            best = tune.mixture_statistics(self.models, looked, self.order, self.mixture, self.absent).tune(technique)
        except tune.TooMany:
            best = self._by_jobs(technique, *_job_entropy(tokens, self.order))
        self.with_params(best.x.tolist())
        return best

    def tune_lattices(self, arcs: DataFrame, refs: DataFrame, what: str, technique: str) -> tune.Minimum:
        """what: wer or margin."""
        try:
            arcs = checkpoint(arcs)
            best = tune.mixture_lattices(self.models, arcs, refs, self.order, self.mixture, self.absent).tune(what, technique)
        except tune.TooMany:
            best = self._by_jobs(technique, *_job_lattices(arcs, refs, self.order, what))
        self.with_params(best.x.tolist())
        return best

    def _by_jobs(self, technique: str, needed: DataFrame, value: Callable[[DataFrame], float]) -> tune.Minimum:
        """Tuning on a set too large for the driver: each evaluation mixes the needed rows."""

        def cost(x: np.ndarray) -> float:
            m = I.interpolate(self.models, self.order, self.mixture.with_params(x.tolist()), self.absent, needed)
            return value(checkpoint(m))

        return tune.minimise(technique, cost, np.array(self.params()))


def interpolate(
    spark: SparkSession,
    order: int = 3,
    models: list[str] | None = None,
    text: list[str] | None = None,
    counts: list[str] | None = None,
    smoothing: list[str] | None = None,
    interpolation: str = "LI",
    features: list[str] | None = None,
    tie_order: bool = True,
    tie_models: bool = False,
    vocab: str | None = None,
    unknown: bool = False,
    weight_features: list[str] | None = None,
) -> Mixed:
    """Models of ARPA or binary files, and models estimated from texts or counts, interpolated.

    vocab, unknown, smoothing and weight_features are for the estimated ones; of the last two, the last value holds for all
    further models."""
    if bool(text) and bool(counts):
        raise ValueError("give texts or counts, not both")
    parts: list[DataFrame] = []
    eff: list[DataFrame | None] = []
    names, weighting = smoothing or ["ModKN"], weight_features or [None]
    sources = [("text", x) for x in text or []] + [("counts", x) for x in counts or []]
    made: list[Estimated | None] = []
    for i, (kind, name) in enumerate(sources):
        own = {"smoothing": names[min(i, len(names) - 1)], "weight_features": weighting[min(i, len(weighting) - 1)]}
        e = estimate(spark, order, **{kind: name}, vocab=vocab, unknown=unknown, **own)
        parts.append(e.model())
        eff.append(C.keyed(e.effective()))
        made.append(e)
    for name in models or []:
        parts.append(checkpoint(files.read_model(spark, name, order)))
        eff.append(None)
        made.append(None)
    if len(parts) < 2:
        raise ValueError("give two models or more")
    absent, fs = 0.0, None
    if interpolation == "CM" and not features:
        if any(e is None for e in eff):
            raise ValueError("count merging of loaded models needs their effective counts as features")
        fs, absent = I.count_merging_features(eff), I.NO_COUNT
    elif interpolation in ("CM", "GLI"):
        each = features or []
        files_of = [n for _, n in sources] + list(models or [])
        per_model = [each[min(i, len(each) - 1)].split(",") if each else [] for i in range(len(parts))]
        fs = [[load_feature(spark, f, order, files_of[i]) for f in names if f] for i, names in enumerate(per_model)]
        absent = I.NO_COUNT if interpolation == "CM" else 0.0
    elif interpolation != "LI":
        raise ValueError(f"unknown interpolation {interpolation}")
    mixture = replace(I.default_mixture(len(parts), order, fs, tie_order), tuned_coefficients=interpolation == "GLI", tie_models=tie_models)
    return Mixed(order, parts, mixture, absent, made)


def perplexity(spark: SparkSession, model: DataFrame, order: int, name: str) -> float:
    return E.perplexity(files.corpus(spark, name), model, order, []).first()["perplexity"]


def evaluate_lattices(spark: SparkSession, model: DataFrame, order: int, name: str) -> dict[str, float]:
    """WER, oracle WER, margin and confidence of a list of lattices."""
    arcs, refs = load_lattices(spark, name)
    u = L.utterances(L.rescore(checkpoint(arcs), model, order), refs)
    return L.word_error_rate(u).first().asDict()


def load_lattices(spark: SparkSession, name: str) -> tuple[DataFrame, DataFrame]:
    """Arcs and references of a lattice list, or of its compiled form `<name>.bin`."""
    if os.path.isdir(name):
        return files.read_table(spark, os.path.join(name, "arcs")), files.read_table(spark, os.path.join(name, "refs"))
    return files.lattice_list(spark, name)


def compile_lattices(spark: SparkSession, name: str) -> str:
    arcs, refs = files.lattice_list(spark, name)
    files.compile_lattices(arcs, os.path.join(name + ".bin", "arcs"))
    refs.write.mode("overwrite").parquet(os.path.join(name + ".bin", "refs"))
    return name + ".bin"


def load_model(spark: SparkSession, name: str, order: int | None) -> tuple[DataFrame, int]:
    m = checkpoint(files.read_model(spark, name, order))
    top = m.agg(F.max("ord")).first()[0] or 1
    return M.truncate(m, min(top, order or top)), min(top, order or top)
