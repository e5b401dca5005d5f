"""Lattices against enumeration of all paths."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest

from gramforge.operators import lattice as L
from gramforge.operators.optimize import lbfgs, minimise, powell

FST = "#FSTBasic MinPlus\nI 0\nT 0 1 a a 1.5\nT 0 2 b b 0.5\nT 1 3 c c\nP 1 0.1\nT 2 3 c c 2\nF 3 0.25\n"


def random_lattice(seed):
    rng = random.Random(seed)
    n = rng.randint(3, 7)
    arcs = [(i, i + 1, rng.choice("abc"), rng.random()) for i in range(n)]
    arcs += [(i, j, rng.choice("abc"), rng.random()) for i in range(n) for j in range(i + 1, n + 1) if rng.random() < 0.3]
    arcs.append((n, n + 1, "</s>", 0.1))
    arcs.sort(key=lambda a: (a[0], a[1]))
    return L.Lattice([a[0] for a in arcs], [a[1] for a in arcs], [a[2] for a in arcs], [a[3] for a in arcs])


def all_paths(x, node=0):
    if node == x.final:
        yield []
        return
    for i in x.out[node]:
        for rest in all_paths(x, x.dst[i]):
            yield [i, *rest]


def edit(a, b):
    d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    return d[-1][-1]


@pytest.mark.parametrize("seed", range(15))
def test_against_all_paths(seed):
    x = random_lattice(seed)
    rng = random.Random(seed + 100)
    paths = list(all_paths(x))
    cost = {tuple(p): sum(x.weight[i] for i in p) for p in paths}
    score, best = x.best_path()
    assert score == pytest.approx(min(cost.values())) and cost[tuple(best)] == pytest.approx(score)
    assert x.n_best(5) == pytest.approx(sorted(cost.values())[:5])
    mass = {p: math.exp(-c) for p, c in cost.items()}
    total = sum(mass.values())
    want = [sum(m for p, m in mass.items() if i in p) / total for i in range(len(x.src))]
    assert x.posteriors() == pytest.approx(want)
    assert x.forward()[x.final] == pytest.approx(math.log(total)) == pytest.approx(x.backward()[0])
    ref = [rng.choice("abc") for _ in range(rng.randint(0, 6))]
    errors, oracle_cost, oracle = x.oracle(ref)
    every = {p: edit(x.words(list(p)), ref) for p in cost}
    assert errors == min(every.values()) and every[tuple(oracle)] == errors
    assert oracle_cost == pytest.approx(min(c for p, c in cost.items() if every[p] == errors))
    assert x.margin(ref) == pytest.approx(0.0 if oracle == best else score - oracle_cost)
    place = x.positions()
    assert place[0] == 0 and place[x.final] == pytest.approx(1) and np.all((place >= 0) & (place <= 1))
    assert 0 <= x.confidence() <= 1 + 1e-9


def test_certain_lattice():
    x = L.Lattice([0, 1], [1, 2], ["a", "</s>"], [3.0, 0.0])
    assert x.confidence() == pytest.approx(1.0) and x.margin(["a"]) == 0.0


def test_word_errors():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 7))] for _ in range(2))
        assert L.word_errors(a, b) == edit(a, b)


def test_text_form():
    arcs = L.parse_fst(FST)
    assert arcs == [(0, 1, "a", 1.5), (0, 2, "b", 0.5), (1, 3, "c", 0.0), (2, 3, "c", 2.0), (3, 4, "</s>", 0.25)]
    g = pd.DataFrame(arcs, columns=["src", "dst", "word", "base_w"])
    assert L.parse_fst(L.format_fst(g)) == arcs
    for bad in ("x", "#FSTBasic MinPlus\nI 1", FST.replace("T 0 1", "T 1 1"), FST + "Q\n"):
        with pytest.raises(ValueError):
            L.parse_fst(bad)
    assert L.reference_words("a <tag> b") == ["a", "b"]


def test_rescoring(spark):
    from gramforge.operators.smoothing import kneser_ney
    from gramforge.operators import counts as C
    from gramforge.operators import text as T

    docs = spark.createDataFrame([("a c\nb c\na b c\nc",)], "text string")
    m = kneser_ney(C.count_ngrams(T.token_rows(docs, []), 2), 2).persist()
    p = {r.ngram: r.prob for r in m.collect()}
    b = {r.ngram: r.bow for r in m.collect()}
    arcs = L.parse_lattices(spark.createDataFrame([("u1", FST.replace("T 2 3 c c 2", "T 2 3 c c 2")), ("u2", FST)], "tag string, text string"))
    got = {(r.tag, r.src, r.dst): r.weight for r in L.rescore(arcs, m, 2).collect()}
    look = lambda h, w: p.get(f"{h} {w}", (b[h] or 1.0) * p[w])
    assert got["u1", 0, 1] == pytest.approx(1.5 - math.log(look("</s>", "a")))
    assert got["u2", 2, 3] == pytest.approx(2 - math.log(look("b", "c")))
    assert got["u2", 3, 4] == pytest.approx(0.25 - math.log(look("c", "</s>")))
    refs = spark.createDataFrame([("u1", ["a", "c"])], "tag string, words array<string>")
    u = {r.tag: r for r in L.utterances(L.rescore(arcs, m, 2), refs).collect()}
    assert u["u1"].n_ref == 2 and u["u2"].n_ref == 0 and u["u2"].n_errors == len(u["u2"].words)
    wrong = L.parse_lattices(spark.createDataFrame([("u", FST.replace("T 0 1 a a", "T 0 1 zz zz"))], "tag string, text string"))
    with pytest.raises(Exception, match="out-of-vocabulary"):
        L.rescore(wrong, m, 2).collect()


def test_tuning_with_several_histories(spark):
    from gramforge.operators.smoothing import kneser_ney
    from gramforge.operators.tune import LatticeObjective
    from gramforge.operators import counts as C
    from gramforge.operators import text as T

    docs = spark.createDataFrame([("a b c\na b d\nb c\nc x\nc y\nd a",)], "text string")
    counts = C.count_ngrams(T.token_rows(docs, []), 2).persist()
    refs = spark.createDataFrame([("u", ["y", "b", "c"])], "tag string, words array<string>")

    def lattice(word):
        text = f"{L.HEADER}\n{L.INITIAL}\nT 0 1 x x 1\nT 0 1 {word} {word} 0.7\nT 1 2 b b\nT 2 3 c c 0.5\nT 2 3 c c\nF 3\n"
        return L.parse_lattices(spark.createDataFrame([("u", text)], "tag string, text string"))

    m = kneser_ney(counts, 2, 1)
    o = LatticeObjective(counts, lattice("y"), refs, 2, 1)
    want = L.word_error_rate(L.utterances(L.rescore(lattice("y"), m, 2), refs)).first()
    assert o.word_error_rate(o.s.default) == pytest.approx(want.wer) and -o.negative_margin(o.s.default) == pytest.approx(want.margin)
    with pytest.raises(Exception, match="history not unique"):
        L.rescore(lattice("a"), m, 2).collect()
    with pytest.raises(ValueError, match="history not unique: u"):
        LatticeObjective(counts, lattice("a"), refs, 2, 1)


def test_minimisers():
    f = lambda x: float((x[0] - 1) ** 2 + 10 * (x[1] + 2) ** 2 + x[0] * x[1])
    want = np.linalg.solve([[2, 1], [1, 20]], [2, -40])
    for name in ("Powell", "LBFGS", "LBFGSB"):
        m = minimise(name, f, np.zeros(2))
        assert m.x == pytest.approx(want, abs=2e-2) and m.value <= f(np.zeros(2))
    rosen = lambda x: float(100 * (x[1] - x[0] ** 2) ** 2 + (1 - x[0]) ** 2)
    assert lbfgs(rosen, np.array([-1.2, 1.0])).value < 1e-3
    bounded = lambda x: math.inf if abs(x[0]) > 1 else float((x[0] - 3) ** 2)
    assert powell(bounded, np.array([0.0])).value < 9
    assert powell(lambda x: 1.0, np.zeros(0)).value == 1.0
    with pytest.raises(ValueError):
        minimise("none", f, np.zeros(2))
