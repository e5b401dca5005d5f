"""Tokens and counts against plain Python."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

from gramforge.operators import counts as C
from gramforge.operators import text as T


def tokenise(line):
    words = [w for w in line.replace("\x0b", " ").replace("\f", " ").replace("\r", " ").replace("\t", " ").split(" ") if w]
    return ["</s>", *["</s>" if w == "<s>" else w for w in words], "</s>"]


def brute(texts, order):
    out = Counter()
    for text in texts:
        if text is None:
            continue
        for line in text.split("\n"):
            if line.startswith("<DOC ") or line == "</DOC>":
                continue
            w = tokenise(line)
            for i in range(1, len(w)):
                for o in range(1, min(i + 1, order) + 1):
                    out[o, " ".join(w[i - o + 1 : i + 1])] += 1
    return out


TEXTS = [
    "a b  c\n\n d\te\r\nx<s> <s> y", None, "", "\n", "<DOC 1>\na a a a\n</DOC>\n<DOC2>", "é ü x", "a b  c\n\n d\te\r\nx<s> <s> y",
    "w " * 3000,
]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, t, i) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, cnt long")


def as_dict(df, value="cnt"):
    rows = df.collect()
    out = {(r.ord, r.ngram): r[value] for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 5])
def test_counts(corpus, order):
    assert as_dict(C.count_ngrams(T.token_rows(corpus, ["doc_id"]), order)) == dict(brute(TEXTS, order))


def test_no_text(corpus):
    assert C.count_ngrams(T.token_rows(corpus.limit(0), []), 3).collect() == []
    assert C.count_ngrams(T.token_rows(corpus.where("text is null"), []), 3).collect() == []


def _random_corpus(seed=1, n=40):
    rng = random.Random(seed)
    return ["\n".join(" ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 9))) for _ in range(3)) for _ in range(n)]


@pytest.fixture(scope="module")
def counted(spark):
    texts = _random_corpus()
    c = C.count_ngrams(T.token_rows(spark.createDataFrame([(t,) for t in texts], "text string"), []), 3)
    return c, brute(texts, 3)


def test_neighbours_and_effective_counts(counted):
    c, true = counted
    left, right = defaultdict(set), defaultdict(set)
    for o, g in true:
        w = g.split(" ")
        left[o - 1, " ".join(w[1:])].add(g)
        right[o - 1, " ".join(w[:-1])].add(g)
    own = [(0, ""), *[k for k in true if k[0] < 3]]
    assert as_dict(C.branching(c, 3, "left"), "n") == {k: len(left[k]) for k in own}
    assert as_dict(C.branching(c, 3, "right"), "n") == {k: len(right[k]) for k in own}
    eff = {k: (len(left[k]) or n) if k[0] < 3 else n for k, n in true.items()}
    assert as_dict(C.effective_counts(c, 3), "eff") == eff
    bins = Counter((k[0], e) for k, e in eff.items() if 1 <= e <= 4)
    assert {(r.ord, r.eff): r.n for r in C.count_of_counts(C.effective_counts(c, 3), 4).collect()} == dict(bins)


def test_closed_vocabulary(spark, counted):
    c, true = counted
    vocab = spark.createDataFrame([("a",), ("b",), ("zz",), ("a",), (None,)], "word string")
    known = {"a", "b", "zz", "</s>"}
    want = {k: n for k, n in true.items() if set(k[1].split(" ")) <= known}
    want |= {(1, w): want.get((1, w), 0) for w in known}
    assert as_dict(C.close_vocabulary(c, vocab)) == want
    renamed = Counter()
    for (o, g), n in true.items():
        renamed[o, " ".join(w if w in known else "<unk>" for w in g.split(" "))] += n
    assert as_dict(C.replace_unknown(c, vocab)) == dict(renamed)


def test_missing_parts(spark):
    rows = spark.createDataFrame([(3, "a b c", 5), (1, "a", 2), (3, "a b c", 1)], "ord int, ngram string, cnt long")
    want = {(3, "a b c"): 6, (1, "a"): 2, (2, "a b"): 0, (2, "b c"): 0, (1, "b"): 0, (1, "c"): 0}
    assert as_dict(C.add_missing(rows)) == want


def test_missing_parts_of_all_orders(spark):
    rows = spark.createDataFrame([(5, "</s> a b a c", 5), (5, "a b a c d", 2)], "ord int, ngram string, cnt long")
    want = {(r.ord, r.ngram): r.cnt for r in rows.collect()}
    for g in [g.split(" ") for _, g in want]:
        want |= {(o, " ".join(g[i : i + o])): 0 for o in range(1, 5) for i in range(6 - o)}
    assert as_dict(C.add_missing(rows)) == want


def test_vocabulary_file(spark):
    rows = spark.createDataFrame([("a",), ("# no",), ("",), (" ",), (None,), ("b x",), ("a",)], "value string")
    assert sorted(r.word for r in T.vocabulary(rows).collect()) == ["a", "b"]
