"""Every registered query of the training-data problems over the smallest tables, against SQL or against brute force."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest

import __spark_entry__ as entry
from gramforge.llm import leaks, queries
from gramforge.llm.bpe import TOKENIZER_DIR
from gramforge.llm.mime import visible

SMALL = "/root/testdata/sf0.001"


def _rows(spark, name):
    return queries.queries()[name](spark, SMALL).collect()


def _table(spark, name):
    return spark.read.parquet(f"{SMALL}/{name}.parquet").collect()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, compare, name):
    mine, theirs = compare(spark, entry, name, SMALL)
    assert mine == theirs


def test_entry_has_all():
    assert queries.queries().keys() <= entry.queries().keys()


def test_leaks_against_brute_force(spark):
    items = {r.item_id: leaks.words_of(r.text) for r in _table(spark, "eval_items")}
    grams = defaultdict(set)
    for i, w in items.items():
        for k in range(len(w) - leaks.MIN_WORDS + 1):
            grams[tuple(w[k : k + leaks.MIN_WORDS])].add(i)
    want, longest = set(), {}
    for r in _table(spark, "documents"):
        for segment in visible(r.text):
            w = leaks.words_of(segment)
            runs = Counter()
            for k in range(len(w) - leaks.MIN_WORDS + 1):
                found = grams.get(tuple(w[k : k + leaks.MIN_WORDS]), set())
                runs = Counter({i: runs[i] + 1 for i in found})
                for i in found:
                    want.add((r.doc_id, i))
                    longest[r.doc_id, i] = max(longest.get((r.doc_id, i), 0), runs[i] + leaks.MIN_WORDS - 1)
    assert {tuple(r) for r in _rows(spark, "p2_found")} == want
    assert {(r.doc_id, r.item_id): r.n_words for r in _rows(spark, "p2_leaks")} == longest


def test_cleaned_messages_leak_nothing(spark):
    cleaned = queries.queries()["p2_clean"](spark, SMALL)
    again = leaks.find_leaks(cleaned.selectExpr("doc_id", "'\n' || clean as text"), spark.read.parquet(f"{SMALL}/eval_items.parquet"))
    assert again.collect() == []
    assert {r.doc_id for r in cleaned.where("n_removed > 0").collect()} == {r.doc_id for r in _rows(spark, "p2_found")}


def test_intervals(spark):
    rows = _rows(spark, "p4_intervals")
    assert len(rows) == 40 and all(r.at_least <= r.total <= r.at_most for r in rows)


def test_forms_give_the_pairs(spark):
    words = {r.word_id: r.word for r in _table(spark, "vocab")}
    by_form = defaultdict(list)
    for r in _rows(spark, "p5_forms"):
        by_form[r.form].append(r.word_id)
    want = {(a, b) for ids in by_form.values() for a in ids for b in ids if a < b and words[a] != words[b]}
    assert {tuple(r) for r in _rows(spark, "p5_found")} == want


def test_ids_of_another_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    texts = {r.doc_id: r.text or "" for r in _table(spark, "documents")}
    rows = _rows(spark, "p7_ids")
    other = tokenizers.Tokenizer.from_file(f"{TOKENIZER_DIR}/byte_bpe_50k.json")
    other.encode_special_tokens = True  # their strings are ordinary text
    assert len(rows) == len(texts)
    for r in rows:
        assert r.ids == other.encode(texts[r.doc_id], add_special_tokens=False).ids


def test_packing_is_whole(spark):
    sizes = {r.doc_id: len(r.ids) for r in _rows(spark, "p7_ids")}
    packed = _rows(spark, "p8_pack")
    tokens, load, items = Counter(), Counter(), Counter()
    for r in packed:
        tokens[r.doc_id] += r.n_tokens
        assert (r.container is None) == (r.n_tokens == 0) and r.n_tokens <= 5000
        assert r.n_pieces == max(1, -(-sizes[r.doc_id] // 5000))
        if r.container is not None:
            load[r.container] += r.n_tokens
            items[r.container] += 1
    assert {k: v for k, v in tokens.items() if v} == {k: v for k, v in sizes.items() if v} and max(load.values()) <= 5000
    assert {r.container: (r.n_items, r.n_tokens, r.unused) for r in _rows(spark, "p8_containers")} == {
        c: (items[c], n, 5000 - n) for c, n in load.items()
    }
    assert {r.doc_id for r in _rows(spark, "p8_found")} == {d for d, n in sizes.items() if n > 5000}
    assert len(load) <= -(-sum(sizes.values()) // 5000) + 2


def test_rates_follow_from_scores(spark):
    scores = _rows(spark, "p9_scores")
    n, flagged = Counter(r.source for r in scores), Counter(r.source for r in scores if r.flagged)
    assert {r.source: (r.n_docs, r.n_flagged) for r in _rows(spark, "p9_rates")} == {s: (n[s], flagged[s]) for s in n}
    assert {r.doc_id for r in _rows(spark, "p9_found")} == {r.doc_id for r in scores if r.flagged}
    assert len(scores) == len(_table(spark, "documents")) and all(r.flagged == (r.score >= 1.0) for r in scores)
