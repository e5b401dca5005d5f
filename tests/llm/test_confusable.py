from __future__ import annotations

from itertools import combinations

import pytest

from gramforge.llm import confusable
from gramforge.llm.confusable import forms, repair_token
from gramforge.llm.lookalikes import plain, to_latin

SAME = [
    ("paper", "рареr"), ("paper", "ｐａｐｅｒ"), ("paper", "pa​per"), ("paper ", "paper"), ("paper ", "paper"), ("café", "café"),
    ("a b", "a b"), ("a-b", "a‑b"), ("so­ft", "soft"), ("gut", "ɡսt"), ("ring", "rіng"), ("жаба", "жaба"), ("oslo", "оѕӏо"),
]
DIFFERENT = [("paper", "Paper"), ("cafe", "café"), ("a b", "ab"), ("a-b", "a b"), ("2", "²"), ("жук", "жuk"), ("rn", "m"), (" a", "a"), ("a–b", "a-b")]


@pytest.mark.parametrize("a, b", SAME)
def test_same_in_print(a, b):
    assert forms(a)[1] == forms(b)[1]


@pytest.mark.parametrize("a, b", DIFFERENT)
def test_different_in_print(a, b):
    assert forms(a)[1] != forms(b)[1]


def test_dominant_script():
    assert repair_token("жaбa") == "жаба"  # Latin a in a Cyrillic word
    assert repair_token("wіnd") == "wind"
    assert repair_token("жук") == "жук" and repair_token("wind") == "wind"
    assert plain("ﬁne") == "fine" and to_latin("Аlt") == "Alt"


def test_pairs(spark):
    rows = [(1, "paper"), (2, "рареr"), (3, "paper"), (4, None), (5, "ｐaper"), (6, "other"), (7, ""), (8, "​"), (9, "оnlyhere"), (10, "Paper")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "word_id long, word string, form string")
    got = sorted((r.word_id_a, r.word_id_b) for r in confusable.lookalike_pairs(df).collect())
    words = [r for r in rows if r[1] is not None]
    want = [(a, b) for (a, x), (b, y) in combinations(words, 2) if x != y and forms(x)[1] == forms(y)[1]]
    assert got == sorted(want) == [(1, 2), (1, 5), (2, 3), (2, 5), (3, 5), (7, 8)]
    by_id = {r.word_id: (r.form, r.repaired) for r in confusable.canonical(df).collect()}
    assert by_id[2] == ("paper", True) and by_id[5] == ("paper", False)
    assert by_id[9] == ("оnlyhere", False)  # the repaired form isn't in the vocabulary
    assert 4 not in by_id
    assert confusable.lookalike_pairs(df.limit(0)).collect() == []


def test_large_class_is_spread(spark, monkeypatch):
    monkeypatch.setattr(confusable, "BLOCK", 7)
    rows = [(i, "ｎoon" if i % 3 == 0 else "noon" if i % 3 == 1 else "noon ") for i in range(60)] + [(99, "other"), (100, None)]
    df = spark.createDataFrame(rows, "word_id long, word string")
    got = {tuple(r) for r in confusable.lookalike_pairs(df).collect()}
    assert got == {(i, j) for i in range(60) for j in range(i + 1, 60) if i % 3 != j % 3}
    assert {(r.form, r.n_rows) for r in confusable.classes(df).collect()} == {("noon", 60)}
