"""Smoothing, evaluation, interpolation and features against plain Python and invariants."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest

from gramforge.operators import counts as C
from gramforge.operators import evaluate as E
from gramforge.operators import features as X
from gramforge.operators import interpolate as I
from gramforge.operators import model as M
from gramforge.operators import smoothing as S
from gramforge.operators import text as T
from gramforge.operators import tune
from gramforge.session import checkpoint

ORDER = 3


def _texts(seed, letters="abcdefgh", n=60):
    rng = random.Random(seed)
    return ["\n".join(" ".join(rng.choice(letters) for _ in range(rng.randint(1, 8))) for _ in range(3)) for _ in range(n)]


def _tokens(spark, texts):
    return T.token_rows(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), ["doc_id"])


@pytest.fixture(scope="module")
def counts(spark):
    return checkpoint(C.count_ngrams(_tokens(spark, _texts(1)), ORDER))


@pytest.fixture(scope="module")
def other(spark):
    return checkpoint(C.count_ngrams(_tokens(spark, _texts(2, "bcdefghij", 40)), ORDER))


class Lookup:
    """Back-off lookup of a collected model."""

    def __init__(self, model):
        self.p = {}
        self.b = {}
        for r in model.collect():
            assert (r.ord, r.ngram) not in self.p
            self.p[r.ngram] = r.prob
            self.b[r.ngram] = 1.0 if r.bow is None else r.bow
        self.words = [g for g in self.p if " " not in g]

    def prob(self, words):
        g = " ".join(words)
        if g in self.p:
            return self.p[g]
        return self.b.get(" ".join(words[:-1]), 1.0) * self.prob(words[1:])

    def histories(self):
        return [g.split(" ") for g in self.p if g.count(" ") < ORDER - 1]


@pytest.mark.parametrize("number", [1, 2, 3, 5])
def test_probabilities_sum_to_one(counts, number):
    m = Lookup(S.kneser_ney(counts, ORDER, number))
    for h in [[], *m.histories()]:
        assert sum(m.prob([*h, w]) for w in m.words) == pytest.approx(1, abs=1e-9)


def test_closed_vocabulary_sums_to_one(spark, counts):
    vocab = spark.createDataFrame([("a",), ("b",), ("never",)], "word string")
    m = Lookup(S.kneser_ney(checkpoint(C.close_vocabulary(counts, vocab)), ORDER, 3, closed=True))
    assert set(m.words) == {"a", "b", "never", "</s>"} and m.p["never"] > 0
    for h in [[], *m.histories()]:
        assert sum(m.prob([*h, w]) for w in m.words) == pytest.approx(1, abs=1e-9)


def test_hot_histories_and_suffixes(counts, monkeypatch):
    from gramforge.operators import skew

    plain = {r.ngram: (r.prob, r.bow) for r in S.kneser_ney(counts, ORDER).collect()}
    monkeypatch.setattr(skew.skew_join, "__defaults__", ("left", 1e-9, 3, None, None))
    salted = {r.ngram: (r.prob, r.bow) for r in S.kneser_ney(counts, ORDER).collect()}
    assert plain == salted


def test_zero_weights_change_nothing(counts):
    f = C.effective_counts(counts, ORDER).selectExpr("ord", "ngram", "array(1.0D) as f")
    a = {r.ngram: r.prob for r in S.kneser_ney(counts, ORDER).collect()}
    b = {r.ngram: r.prob for r in S.kneser_ney(counts, ORDER, features=f, weights=[0.0]).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-12) for k in a)
    m = Lookup(S.kneser_ney(counts, ORDER, features=f, weights=[0.5]))
    for h in m.histories():
        assert sum(m.prob([*h, w]) for w in m.words) == pytest.approx(1, abs=1e-9)


def test_masked(spark, counts):
    full = {r.ngram: r.prob for r in S.kneser_ney(counts, ORDER).collect()}
    needed = spark.createDataFrame([(3, "a b c"), (2, "b a"), (1, "e"), (3, "no such gram")], "ord int, ngram string")
    got = {r.ngram: r.prob for r in S.kneser_ney(counts, ORDER, needed=needed).collect()}
    assert set(got) == {"a b c", "b c", "c", "b a", "a", "e"} & set(full)
    assert all(got[k] == full[k] for k in got)


def test_maximum_likelihood(counts):
    true = defaultdict(int)
    rows = C.keyed(counts).collect()
    for r in rows:
        true[r.ord, r.hist] += r.cnt
    n = defaultdict(int)
    for r in rows:
        n[r.ord, r.hist] += 1
    by = {(r.ord, r.ngram): r for r in rows}
    for m in S.maximum_likelihood(counts).collect():
        assert m.prob == pytest.approx(by[m.ord, m.ngram].cnt / true[m.ord, m.hist]) and m.bow in (0.0, None)
    for m in S.maximum_likelihood(counts, compat=True).collect():
        assert m.prob == pytest.approx(by[m.ord, m.ngram].cnt / n[m.ord, m.hist])


def test_names_and_bounds(counts):
    assert S.smoothing("ModKN") == S.Smoothing("KN", 3, True) and S.smoothing("FixKN") == S.Smoothing("KN", 1, False)
    assert S.smoothing("FixKN5") == S.Smoothing("KN", 5, False) and S.smoothing("ML").kind == "ML"
    assert len(S.smoothing_list("KN", 3)) == 3
    for bad in ("KN0", "XX", "FixModKN2"):
        with pytest.raises(ValueError):
            S.smoothing(bad)
    with pytest.raises(ValueError):
        S.smoothing_list("KN,ML", 3)
    assert S.check_bounds([0.5, 2, 3], [100]) and not S.check_bounds([1.5]) and not S.check_bounds([], [101])
    with pytest.raises(ValueError):
        S.kneser_ney(counts, ORDER, 1, given={1: [2.0], 2: [0.5], 3: [0.5]})


def test_empty_counts(spark):
    none = spark.createDataFrame([], "ord int, ngram string, cnt long")
    assert S.kneser_ney(none, 2).collect() == [] and S.maximum_likelihood(none).collect() == []


# -- perplexity --------------------------------------------------------------------------------------------------------


def brute_entropy(m, texts, order):
    total, words, oov, zero = 0.0, 0, 0, set()
    for text in texts:
        for line in (text or "").split("\n") if text is not None else []:
            w = ["</s>", *line.split(), "</s>"]
            ctx = min(2, order)
            for i in range(1, len(w)):
                if w[i] not in m.p:
                    ctx, oov = 1, oov + 1
                    continue
                o = ctx
                while " ".join(w[i - o + 1 : i + 1]) not in m.p:
                    bow = m.b.get(" ".join(w[i - o + 1 : i]), 1.0)
                    total += math.log(bow) if bow > 0 else -math.inf
                    o -= 1
                p = m.p[" ".join(w[i - o + 1 : i + 1])]
                if p > 0:
                    total += math.log(p)
                else:
                    zero.add(" ".join(w[i - o + 1 : i + 1]))
                words += 1
                ctx = min(order, ctx + 1)
    return words, oov, len(zero), -total / (words - len(zero))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_perplexity(spark, counts, order):
    model = checkpoint(S.kneser_ney(counts.where(counts.ord <= order), order))
    texts = [*_texts(9, "abcdefghx", 8), None, "", "x x", "a"]
    got = E.perplexity(_tokens(spark, texts), model, order, ["doc_id"]).first()
    words, oov, zero, entropy = brute_entropy(Lookup(model), texts, order)
    assert (got.n_words, got.n_oov, got.n_zero) == (words, oov, zero)
    assert got.entropy == pytest.approx(entropy, abs=1e-9) and got.perplexity == pytest.approx(math.exp(entropy))


def test_zero_back_off_is_infinite(spark, counts):
    m = checkpoint(S.maximum_likelihood(counts))
    assert E.perplexity(_tokens(spark, _texts(8)), m, ORDER, ["doc_id"]).first().perplexity == math.inf


def test_no_held_out_text(spark, counts):
    m = S.kneser_ney(counts, ORDER)
    got = E.perplexity(_tokens(spark, [None]), m, ORDER, ["doc_id"]).first()
    assert got.n_words == 0 and got.entropy is None


# -- interpolation -----------------------------------------------------------------------------------------------------


def test_interpolation_with_itself(counts):
    m = checkpoint(S.kneser_ney(counts, ORDER))
    a, b = Lookup(m), Lookup(I.interpolate([m, m], ORDER, I.default_mixture(2, ORDER)))
    assert a.p.keys() == b.p.keys() and all(a.p[k] == pytest.approx(b.p[k], abs=1e-12) for k in a.p)
    for h in a.histories():
        if 1 - sum(a.prob([*h[1:], w]) for w in a.words if " ".join([*h, w]) in a.p) > 1e-6:
            assert a.b[" ".join(h)] == pytest.approx(b.b[" ".join(h)], abs=1e-9)


@pytest.mark.parametrize("kind", ["li", "cm", "gli"])
def test_mixtures_sum_to_one(counts, other, kind):
    models = [checkpoint(S.kneser_ney(c, ORDER)) for c in (counts, other)]
    eff = [C.keyed(C.effective_counts(c, ORDER)) for c in (counts, other)]
    mixture, absent = {
        "li": (I.Mixture([[0.7]], [], [[], []]), 0.0),
        "cm": (I.default_mixture(2, ORDER, I.count_merging_features(eff)), I.NO_COUNT),
        "gli": (I.Mixture([[0.1], [0.5], [-0.5]], [[[0.5], [0.25]]], I.count_merging_features(eff)), 0.0),
    }[kind]
    m = Lookup(I.interpolate(models, ORDER, mixture, absent))
    assert set(m.p) == set(Lookup(models[0]).p) | set(Lookup(models[1]).p)
    for h in m.histories():
        assert sum(m.prob([*h, w]) for w in m.words) == pytest.approx(1, abs=1e-6)


def test_truncate(counts):
    m = M.truncate(S.kneser_ney(counts, ORDER), 2)
    assert {r.ord for r in m.collect()} == {1, 2} and all(r.bow is None for r in m.where("ord = 2").collect())


# -- tuning ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("technique", ["Powell", "LBFGS", "LBFGSB"])
def test_tuned_discounts_are_no_worse(spark, counts, technique):
    dev = _tokens(spark, _texts(5, "abcdefgh", 10))
    looked = tune.held_out_contexts(counts, dev, ORDER, ["doc_id"])
    s = tune.kneser_ney_statistics(counts, looked, ORDER, 3)
    model = checkpoint(S.kneser_ney(counts, ORDER))
    start = E.perplexity(dev, model, ORDER, ["doc_id"]).first().entropy
    assert s.entropy(s.default) == pytest.approx(start, abs=1e-9)
    best = tune.tune_perplexity(s, technique)
    assert best.value <= start + 1e-12
    d = {o + 1: best.x.reshape(ORDER, 3)[o].tolist() for o in range(ORDER)}
    again = checkpoint(S.kneser_ney(counts, ORDER, 3, given=d))
    assert E.perplexity(dev, again, ORDER, ["doc_id"]).first().entropy == pytest.approx(best.value, abs=1e-9)
    assert s.entropy(s.default + 10) == math.inf


def test_tuned_feature_weights(spark, counts):
    dev = _tokens(spark, _texts(5, "abcdefgh", 10))
    looked = tune.held_out_contexts(counts, dev, ORDER, ["doc_id"])
    f = checkpoint(C.effective_counts(counts, ORDER).selectExpr("ord", "ngram", "array(ln(1 + eff)) as f"))
    s = tune.weighted_statistics(counts, looked, ORDER, 2, f, 1)
    plain = tune.kneser_ney_statistics(counts, looked, ORDER, 2)
    assert s.entropy(s.default) == pytest.approx(plain.entropy(plain.default), abs=1e-9)
    params = s.default.copy()
    params[-1] = 0.3
    d = {o + 1: params[:-1].reshape(ORDER, 2)[o].tolist() for o in range(ORDER)}
    m = checkpoint(S.kneser_ney(counts, ORDER, 2, given=d, features=f, weights=[0.3]))
    assert E.perplexity(dev, m, ORDER, ["doc_id"]).first().entropy == pytest.approx(s.entropy(params), abs=1e-9)
    assert tune.tune_perplexity(s, "LBFGS").value <= s.entropy(s.default) + 1e-12
    params[-1] = 101
    assert s.entropy(params) == math.inf


def test_feature_weights_of_many_followers(spark, counts, monkeypatch):
    looked = checkpoint(tune.held_out_contexts(counts, _tokens(spark, ["a b c"]), ORDER, ["doc_id"]))
    f = checkpoint(counts.selectExpr("ord", "ngram", "array(pmod(xxhash64(ngram), 1000) / 1000, 1D) as f"))
    near = tune.weighted_statistics(counts, looked, ORDER, 2, f, 2)
    monkeypatch.setattr(tune, "MAX_CONTEXTS", len(near.count))
    far = tune.weighted_statistics(counts, looked, ORDER, 2, f, 2)
    assert near.followers is None and far.followers is not None and not len(far.hist_of)
    params = far.default.copy()
    params[-2:] = 0.7, -0.4
    for x in (far.default, params):
        assert far.entropy(x) == pytest.approx(near.entropy(x), abs=1e-12)
    d = {o + 1: params[:-2].reshape(ORDER, 2)[o].tolist() for o in range(ORDER)}
    m = checkpoint(S.kneser_ney(counts, ORDER, 2, given=d, features=f, weights=[0.7, -0.4]))
    dev = _tokens(spark, ["a b c"])
    assert E.perplexity(dev, m, ORDER, ["doc_id"]).first().entropy == pytest.approx(far.entropy(params), abs=1e-9)


def test_smoothing_by_order(counts):
    same = {r.ngram: r.prob for r in S.kneser_ney(counts, ORDER, 2).collect()}
    assert same == {r.ngram: r.prob for r in S.kneser_ney(counts, ORDER, [2, 2, 2]).collect()}
    m = Lookup(S.kneser_ney(counts, ORDER, [1, 3, 2]))
    for h in m.histories():
        assert sum(m.prob([*h, w]) for w in m.words) == pytest.approx(1, abs=1e-9)
    ml = {r.ngram: r.prob for r in S.maximum_likelihood(counts).collect()}
    mixed = {r.ngram: (r.ord, r.prob) for r in S.kneser_ney(counts, ORDER, [0, 3, 0]).collect()}
    assert all(p == pytest.approx(ml[g]) for g, (o, p) in mixed.items() if o != 2)
    assert any(abs(p - ml[g]) > 1e-6 for g, (o, p) in mixed.items() if o == 2)


def test_tuned_mixture_is_no_worse(spark, counts, other):
    models = [checkpoint(S.kneser_ney(c, ORDER)) for c in (counts, other)]
    dev = _tokens(spark, _texts(6, "abcdefghij", 10))
    s = tune.mixture_statistics(models, tune.mixture_contexts(models, dev, ORDER, ["doc_id"]), ORDER)
    for b in (0.0, 0.8):
        m = checkpoint(I.interpolate(models, ORDER, I.Mixture([[b]], [], [[], []])))
        assert s.entropy([b]) == pytest.approx(E.perplexity(dev, m, ORDER, ["doc_id"]).first().entropy, abs=1e-9)
    assert s.tune("LBFGS").value <= s.entropy([0.0]) + 1e-12


@pytest.mark.parametrize("kind", ["cm", "gli", "tied"])
def test_statistics_of_any_mixture(spark, counts, other, kind):
    """Entropies from compact statistics are those of the whole interpolated model."""
    models = [checkpoint(S.kneser_ney(c, ORDER)) for c in (counts, other)]
    fs = I.count_merging_features([C.keyed(C.effective_counts(c, ORDER)) for c in (counts, other)])
    mixture, absent = {
        "cm": (I.default_mixture(2, ORDER, fs, tie_order=False), I.NO_COUNT),
        "gli": (I.Mixture([[0.1], [0.5], [-0.5]], [[[0.5], [0.25]]], fs, tuned_coefficients=True), 0.0),
        "tied": (I.Mixture([[0.1]], [[[0.5], [0.5]]], fs, tuned_coefficients=True, tie_models=True), 0.0),
    }[kind]
    dev = _tokens(spark, _texts(6, "abcdefghij", 10))
    s = tune.mixture_statistics(models, tune.mixture_contexts(models, dev, ORDER, ["doc_id"]), ORDER, mixture, absent)
    other_params = [x + 0.3 for x in mixture.params()]
    for params in (mixture.params(), other_params):
        m = checkpoint(I.interpolate(models, ORDER, mixture.with_params(params), absent))
        assert s.entropy(params) == pytest.approx(E.perplexity(dev, m, ORDER, ["doc_id"]).first().entropy, abs=1e-9)
    assert s.tune("LBFGS").value <= s.entropy(mixture.params()) + 1e-12


def test_discounts_by_order_are_tuned(spark, counts):
    dev = _tokens(spark, _texts(5, "abcdefgh", 10))
    looked = tune.held_out_contexts(counts, dev, ORDER, ["doc_id"])
    s = tune.kneser_ney_statistics(counts, looked, ORDER, [1, 3, 2])
    plain = checkpoint(S.kneser_ney(counts, ORDER, [1, 3, 2]))
    assert len(s.default) == 6
    assert s.entropy(s.default) == pytest.approx(E.perplexity(dev, plain, ORDER, ["doc_id"]).first().entropy, abs=1e-9)
    best = tune.tune_perplexity(s, "Powell")
    given = {1: best.x[:1].tolist(), 2: best.x[1:4].tolist(), 3: best.x[4:].tolist()}
    m = checkpoint(S.kneser_ney(counts, ORDER, [1, 3, 2], given=given))
    assert E.perplexity(dev, m, ORDER, ["doc_id"]).first().entropy == pytest.approx(best.value, abs=1e-9)


def test_realigned_counts_are_smoothed_as_refilled(counts, other):
    """Over the merged n-grams, smoothing again gives what filling from back-off gives."""
    models = [checkpoint(S.kneser_ney(c, ORDER)) for c in (counts, other)]
    keys = checkpoint(M.merged_keys(models))
    again = {(r.ord, r.ngram): r.prob for r in S.kneser_ney(checkpoint(M.realign(counts, keys)), ORDER).collect()}
    filled = {(o, r.ngram): r.p[0] for o, rows in M.refill(checkpoint(M.stacked(models)), ORDER).items() for r in rows.collect()}
    assert again.keys() == filled.keys() and all(again[k] == pytest.approx(filled[k], abs=1e-12) for k in again)


def test_vocabulary_of_an_evaluation(spark, counts):
    model = checkpoint(S.kneser_ney(counts, ORDER))
    tokens = _tokens(spark, ["a b a c", "b b"])
    vocab = spark.createDataFrame([("a",), ("</s>",), ("zz",)], "word string")
    whole = E.perplexity(tokens, model, ORDER, ["doc_id"]).first()
    part = E.perplexity(tokens, model, ORDER, ["doc_id"], vocab=vocab).first()
    assert (whole.n_oov, part.n_oov) == (0, 4) and part.n_words == whole.n_words - 4


def test_weighted_and_masked_model(spark, counts):
    f = checkpoint(C.effective_counts(counts, ORDER).selectExpr("ord", "ngram", "array(ln(1 + eff)) as f"))
    needed = spark.createDataFrame([(3, "a b c"), (2, "b a"), (1, "d")], "ord int, ngram string")
    whole = {(r.ord, r.ngram): r.prob for r in S.kneser_ney(counts, ORDER, 3, features=f, weights=[0.3]).collect()}
    part = {(r.ord, r.ngram): r.prob for r in S.kneser_ney(counts, ORDER, 3, features=f, weights=[0.3], needed=needed).collect()}
    assert part.items() <= whole.items() and (1, "d") in part and len(part) < len(whole)


def test_masked_mixture(spark, counts, other):
    models = [checkpoint(S.kneser_ney(c, ORDER)) for c in (counts, other)]
    mixture = I.default_mixture(2, ORDER, I.count_merging_features([C.keyed(C.effective_counts(c, ORDER)) for c in (counts, other)]))
    whole = {(r.ord, r.ngram): (r.prob, r.bow) for r in I.interpolate(models, ORDER, mixture, I.NO_COUNT).collect()}
    needed = C.count_ngrams(_tokens(spark, ["a b c a"]), ORDER).select("ord", "ngram")
    part = {(r.ord, r.ngram): (r.prob, r.bow) for r in I.interpolate(models, ORDER, mixture, I.NO_COUNT, needed).collect()}
    keys = {(r.ord, r.ngram) for r in needed.collect()} & whole.keys()
    assert keys <= part.keys()
    for k in keys:
        assert part[k][0] == pytest.approx(whole[k][0], abs=1e-12)
        if part[k][1] is not None:
            assert part[k][1] == pytest.approx(whole[k][1], abs=1e-9)


def test_marks_without_broadcast(spark, monkeypatch):
    """Members that are too many to be broadcast are joined with salts."""
    from gramforge.operators import skew

    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"w{i}") for i in range(300)] + [(300, None)], "i int, w string")
    members = checkpoint(spark.createDataFrame([("hot",), ("w3",), ("other",)], "w string"))
    want = {(r.i, r.w, r.m) for r in skew.mark(rows, members, "w", "m", ["i"]).collect()}
    monkeypatch.setattr(skew, "MAX_BROADCAST", 0)
    assert {(r.i, r.w, r.m) for r in skew.mark(rows, members, "w", "m", ["i"]).collect()} == want
    assert sum(m for *_, m in want) == 201 and (300, None, False) in want


# -- features ----------------------------------------------------------------------------------------------------------


def test_feature_grammar(spark):
    assert X.parse_feature("log:sumhist:%s.eff", "/x/corp.txt") == (["log", "sumhist"], None, "corp.eff")
    assert X.parse_feature("norm:freq:f.txt") == (["norm"], "freq", "f.txt")
    with pytest.raises(ValueError):
        X.parse_feature("nothing:f.txt")
    base = spark.createDataFrame([(2, "a b", 3.0), (2, "a c", 1.0), (1, "a", 4.0), (1, "b", 0.0)], "ord int, ngram string, value double")
    f = {(r.ord, r.ngram): r.value for r in X.feature("log1p:sumhist:x", 2, lambda loader, source: base).collect()}
    assert f == {(1, "a"): pytest.approx(math.log(5)), (0, ""): pytest.approx(math.log(5))}
    n = {(r.ord, r.ngram): r.value for r in X.norm(base).collect()}
    assert n[2, "a b"] == 1.0 and n[2, "a c"] == pytest.approx(1 / 3) and n[1, "b"] == 0.0
    lines = base.withColumn("line", base.value.cast("long")).unionByName(spark.createDataFrame([(2, "a b", 9.0, 99)], "ord int, ngram string, value double, line long"))
    a = {r.ngram: r.value for r in X.align(lines, spark.createDataFrame([(2, "a b"), (2, "z z")], "ord int, ngram string")).collect()}
    assert a == {"a b": 9.0, "z z": 0.0}


def test_document_features(spark):
    tokens = _tokens(spark, ["a b\na", "a c", "c"])
    f = {(r.ord, r.ngram): r.value for r in X.document_frequency(tokens, 2).collect()}
    assert f[1, "a"] == pytest.approx(2 / 3) and f[2, "a b"] == pytest.approx(1 / 3)
    h = {(r.ord, r.ngram): r.value for r in X.document_entropy(tokens, 1).collect()}
    want = -(2 / 3 * math.log(2 / 3) + 1 / 3 * math.log(1 / 3)) / math.log(3)
    assert h[1, "a"] == pytest.approx(want) and h[1, "b"] == pytest.approx(0.0)
    one = {r.ngram: r.value for r in X.document_entropy(_tokens(spark, ["a b"]), 1).collect()}
    assert set(one.values()) == {0.0}
