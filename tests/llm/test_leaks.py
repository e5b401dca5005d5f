from __future__ import annotations

import base64
import quopri
import random

import pytest

from gramforge.llm import leaks
from gramforge.llm.leaks import Search, SuffixAutomaton, letters, passages, words_of
from gramforge.llm.mime import visible


class _Value:
    def __init__(self, value):
        self.value = value


class _Found(Search):
    """Search over one block without Spark."""

    def __init__(self, items, least):
        block = [(i, w) for i, w in items if len(w) >= least]
        super().__init__([_Value(leaks._pack(block))], least)

    def items(self, segments):
        """Item -> (longest passage, words in passages)."""
        ends = {}
        for _, k, at, _, of in self.found([[s.split() for s in segments]]):
            for item in of:
                ends.setdefault(item, {}).setdefault(k, []).append(at)
        each = {i: [passages(e, self.min_words) for e in by.values()] for i, by in ends.items()}
        return {i: (max(n for n, _ in x), sum(n for _, n in x)) for i, x in each.items()}


def _finder(items, least=4):
    return _Found([(i, words_of(t)) for i, t in items], least)


def test_automaton_against_brute_force():
    rng = random.Random(7)
    for _ in range(40):
        items = [(i, [rng.choice("abc") for _ in range(rng.randint(1, 25))]) for i in range(5)]
        least = rng.choice([2, 4, 6])
        automaton = SuffixAutomaton(items, least)
        finder = _Found(items, least)
        for _ in range(20):
            words = [rng.choice("abcd") for _ in range(rng.randint(0, 30))]
            grams = {tuple(words[i : i + least]) for i in range(len(words) - least + 1)}
            want = {k for k, w in items if any(tuple(w[i : i + least]) in grams for i in range(len(w) - least + 1))}
            assert set(finder.items([" ".join(words)])) == want
            # matching lengths
            ids = [automaton.word_ids.get(w, -1) for w in words]
            for i, n, _ in automaton.matches(ids):
                tail = words[i - n + 1 : i + 1]
                assert any(w[j : j + n] == tail for _, w in items for j in range(len(w)))
                if i - n >= 0:
                    longer = words[i - n : i + 1]
                    assert not any(w[j : j + n + 1] == longer for _, w in items for j in range(len(w)))


def test_letters():
    assert letters("„Häuser“,") == letters("Häuser") == "häuser"
    assert letters("раѕѕ") == "pass" and letters("ｆｕｌｌ") == "full" and letters("so­ft") == "soft"
    assert letters("2024!") == ""


PASSAGE = "Every green kettle under the bridge counts slow panels before noon"
SHOUTED = PASSAGE.upper().replace(" ", ", ")


def _mail(body, kind="text/plain; charset=utf-8", encoding="8bit"):
    return f"From: a@b.example\nSubject: x\nContent-Type: {kind}\nContent-Transfer-Encoding: {encoding}\n\n{body}"


FORMS = {
    "plain": _mail(PASSAGE),
    "quoted": _mail("> > " + PASSAGE.replace(" under", "\n> > under").replace(" slow", "\r\n> > slow")),
    "shouted": _mail(SHOUTED),
    "base64": _mail(base64.b64encode(("x\n" + PASSAGE).encode()).decode(), encoding="base64"),
    "qp": _mail(quopri.encodestring((PASSAGE + " é" * 40).encode()).decode(), encoding="quoted-printable"),
    "html": _mail("<p>Every <b>gr</b>een kettle&nbsp;under <i>the bridge</i><br>counts slow panels&#44; before noon</p>", "text/html"),
    "latin": _mail(base64.b64encode((PASSAGE + " é").encode("latin-1")).decode(), "text/plain; charset=iso-8859-1", "base64"),
    "subject": f"Subject: {PASSAGE.replace(' the', chr(10) + ' the')}\nFrom: a@b\n\nbody",
    "word": f"Subject: =?utf-8?B?{base64.b64encode(PASSAGE.encode()).decode()}?=\n\nbody",
    "attachment": 'Content-Type: multipart/mixed; boundary="bb"\n\n--bb\nContent-Type: text/plain\n\nhello\n--bb\n'
    'Content-Type: application/octet-stream; name="notes.txt"\nContent-Transfer-Encoding: base64\n\n'
    + base64.b64encode(PASSAGE.encode()).decode() + "\n--bb--\n",
    "unclosed": f'Content-Type: multipart/mixed; boundary="bb"\n\n--bb\nContent-Type: text/plain\n\n{PASSAGE}',
    "no header": "\n" + PASSAGE,
    "hidden": _mail("​".join(PASSAGE).replace("e", "е", 3)),
}


@pytest.mark.parametrize("form", sorted(FORMS))
def test_as_a_reader_sees_it(form):
    finder = _finder([(1, PASSAGE), (2, "something else altogether here")], 11)
    assert finder.items(visible(FORMS[form])) == {1: (11, 11)}


def test_binary_attachment_is_no_text():
    data = base64.b64encode(bytes(range(256))).decode()
    text = f"Content-Type: application/octet-stream\nContent-Transfer-Encoding: base64\n\n{data}"
    assert len(visible(text)) == 1


def test_any_depth_and_whole_boundary_lines():
    for depth in (20, 25, 2000):
        text = "".join(f'Content-Type: multipart/mixed; boundary="d{i}"\n\n--d{i}\n' for i in range(depth))
        text += "Content-Transfer-Encoding: base64\n\n" + base64.b64encode(PASSAGE.encode()).decode()
        assert _finder([(1, PASSAGE)], 11).items(visible(text)) == {1: (11, 11)}
    inner = "Content-Type: text/plain\n\nbefore\n--b10 is a line of text\nafter\n"
    text = f'Content-Type: multipart/mixed; boundary="b1"\n\n--b1\n{inner}--b1 \nContent-Type: multipart/x; boundary=b10\n\n--b10\n\none\n--b10--\nx\n--b1\n\ntwo\n--b1--\n'
    assert [s for s in visible(text) if "Content" not in s] == ["before\n--b10 is a line of text\nafter", "one", "two"]
    same = 'Content-Type: multipart/x; boundary=b\n\n--b\nContent-Type: multipart/x; boundary=b\n\nfirst\n--b\n\nsecond\n--b--'
    assert [s for s in visible(same) if "Content" not in s] == ["first", "second"]


def test_messages_within_messages():
    text = "Subject: inner\n\n" + PASSAGE
    for _ in range(3):
        body = base64.b64encode(text.encode()).decode()
        text = f"Content-Type: message/rfc822\nContent-Transfer-Encoding: base64\n\n{body}"
    assert _finder([(1, PASSAGE)], 11).items(visible(text)) == {1: (11, 11)}
    nested = "Content-Type: message/rfc822\n\n\n" * 3000 + "Subject: inner\n\n" + PASSAGE
    assert visible(nested)[-2:] == ["Subject: inner", PASSAGE]
    printable = "Content-Type: message/rfc822\nContent-Transfer-Encoding: quoted-printable\n\n" * 1500 + "Subject: x\n\n" + PASSAGE
    assert visible(printable)[-1] == PASSAGE


def test_headers_of_parts_and_late_html():
    text = "Content-Type: application/octet-stream; name*=utf-8''a%20b.txt\nContent-Transfer-Encoding: base64\n\n"
    text += base64.b64encode((" " * 250 + "<html><p>one</p>two</html>").encode()).decode()
    head, body = visible(text)
    assert "a b.txt" in head and body.split() == ["one", "two"]


@pytest.mark.parametrize("gap", [0, 39, 60, 500])
def test_signs_between_words_do_not_end_a_passage(gap):
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40)]
    text = " ".join(words[:20] + ["--"] * gap + words[20:])
    assert _finder([(1, " ".join(words))], 12).items([text]) == {1: (40, 40)}


def test_passages():
    assert passages([5, 6, 7], 4) == (6, 6)
    assert passages([5, 7], 4) == (4, 6) and passages([30, 5], 4) == (4, 8)


def test_shared_and_short_items():
    items = [(1, "a b c d e f g"), (2, "x c d e f y"), (3, "b c"), (4, ""), (5, None)]
    assert _finder(items).items(["zz c d e f zz"]) == {1: (4, 4), 2: (4, 4)}
    assert _finder(items).items(["b c d e"]) == {1: (4, 4)}
    assert _finder(items).items(["c d e", "f"]) == {}


@pytest.mark.parametrize("block", [leaks.MAX_ITEM_WORDS, 12])
def test_find_and_remove(spark, monkeypatch, block):
    monkeypatch.setattr(leaks, "MAX_ITEM_WORDS", block)
    docs = spark.createDataFrame(
        [(1, f"\nhello there {PASSAGE} bye now and then again more words follow here too", "x"), (2, None, "y"), (3, "", "z"), (1, "\nnothing", "x"), (4, "\n" + PASSAGE, "w")],
        "doc_id long, text string, item_id string",
    )
    items = spark.createDataFrame([(1, PASSAGE, "p"), (2, None, "q"), (3, "short", "r"), (4, "one two " * 9, "s")], "item_id long, text string, purpose string")
    found = leaks.find_leaks(docs, items, min_words=11).collect()
    assert sorted((r.doc_id, r.item_id, r.n_words, r.covered) for r in found) == [(1, 1, 11, 11), (4, 1, 11, 11)]
    clean = {(r.doc_id, r.clean): (r.n_removed, r.dropped) for r in leaks.remove_leaks(docs, items, min_words=11).collect()}
    assert clean[(1, "hello there  bye now and then again more words follow here too")] == (11, False)
    assert clean[(4, "")] == (11, True) and clean[(2, None)] == (0, False) and clean[(3, "")] == (0, False)
    named = items.select(items.item_id.cast("string").alias("item_id"), "text")
    assert {(r.doc_id, r.item_id) for r in leaks.find_leaks(docs, named, min_words=11).collect()} == {(1, "1"), (4, "1")}
    assert leaks.find_leaks(docs.limit(0), items).collect() == [] and leaks.find_leaks(docs, items.limit(0)).collect() == []


def test_blocks_find_what_one_automaton_finds(spark, monkeypatch):
    """Items longer than a block go on in the next; more blocks than automata are kept."""
    rng = random.Random(3)
    items = [(i, " ".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 60)))) for i in range(12)]
    docs = [(i, "\n" + " ".join(rng.choice("abcdefg") for _ in range(200))) for i in range(30)]
    docs += [(100 + i, "\nz " + t) for i, t in items]
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    whole = {tuple(r) for r in leaks.find_leaks(a, b, min_words=5).collect()}
    cleaned = {tuple(r) for r in leaks.remove_leaks(a, b, min_words=5).collect()}
    monkeypatch.setattr(leaks, "MAX_ITEM_WORDS", 20)
    assert {tuple(r) for r in leaks.find_leaks(a, b, min_words=5).collect()} == whole and len(whole) > 20
    assert {tuple(r) for r in leaks.remove_leaks(a, b, min_words=5).collect()} == cleaned
