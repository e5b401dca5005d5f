from __future__ import annotations

import base64
from pathlib import Path

import pytest

from gramforge.llm import abuse
from gramforge.llm.abuse import Scorer

BAD = [
    "Shut up, you pathetic little moron.", "Go to hell, you lying piece of shit.", "You use1e$$ b4stard.", "Y o u u-s-e-l-e-s-s b.a.s.t.a.r.d",
    "youuu uselesss bastarddd", "Yоu usеlеss bаstаrd", "you use​less bas­tard", "All of them are v e r m i n, throw them out.",
    "Halt die Fresse, du dummes Arschloch.", "Ferme ta gueule, espèce de connard.", "Cállate, pedazo de imbécil.", "send me nude pics",
    "I will break your legs.",
]
GOOD = [
    "This stupid printer jammed again.", "That bloody weather ruined the day, damn it.", "An idiot-proof guide to the backup.",
    "The clinic moved the breast cancer screening.", "The bitch had nine healthy puppies, the breeder writes.", "Please kill the stuck process and its child.",
    "A dumb terminal and a slave drive.", "The lecture on sexual reproduction in ferns.", "Mix the cocktail with dick-cissel seed.",
    "The Vorlanders and the Tamurans sent a cable to the fair.", "Peut-on enlever la bitte du pont ?", "", "A 1 2 3 b c d.",
]


@pytest.fixture(scope="module")
def scorer():
    return Scorer()


@pytest.mark.parametrize("text", BAD)
def test_flagged(scorer, text):
    assert scorer.score("\n" + text)[0] >= abuse.THRESHOLD
    assert scorer.score("Subject: x\nContent-Transfer-Encoding: base64\n\n" + base64.b64encode(text.encode()).decode())[0] >= abuse.THRESHOLD


@pytest.mark.parametrize("text", GOOD)
def test_not_flagged(scorer, text):
    assert scorer.score("\n" + text)[0] < abuse.THRESHOLD


def test_length_does_not_dilute(scorer):
    short, long = scorer.score("\n" + BAD[1]), scorer.score("\n" + "word " * 5000 + BAD[1] + " word" * 5000)
    assert short[0] == long[0] and short[1] > long[1] and long[2] == "abuse"


def test_light_terms_far_apart_do_not_add_up(scorer):
    assert scorer.score("\nstupid disgusting")[0] == pytest.approx(0.4)
    assert scorer.score("\nstupid " + "word " * 60 + "disgusting")[0] == pytest.approx(0.2)


def test_score_falls_with_the_length_of_the_stretch(scorer):
    """Weights for each WINDOW words of the densest stretch."""
    near, far = (scorer.score("\nthey stink " + "word " * n + "they steal")[0] for n in (5, 30))
    assert near == pytest.approx(0.8) and far == pytest.approx(0.8 * abuse.WINDOW / 34, abs=1e-4)


def test_places_and_names(scorer):
    """File names, any header field, deep parts, and peoples that only a parameter knows."""
    assert scorer.score('Content-Type: text/plain; name="fuck you.txt"\n\nhello')[0] >= abuse.THRESHOLD
    deep = "".join(f'Content-Type: multipart/mixed; boundary="d{i}"\n\n--d{i}\n' for i in range(40))
    assert scorer.score(deep + "Content-Type: text/plain\n\nYou filthy bastard.")[0] >= abuse.THRESHOLD
    text = "\nDirty plutonians and their liars."
    assert scorer.score(text)[0] < abuse.THRESHOLD <= Scorer(groups="plutonians").score(text)[0]


def _sentences(name):
    lines = (Path(__file__).parent / name).read_text().splitlines()
    return [x.split("\t") for x in lines if not x.startswith("#")]


@pytest.mark.parametrize("name, recall, precision", [("abuse_heldout.txt", 0.9, 0.9), ("abuse_later.txt", 0.7, 0.9)])
def test_hand_made_sentences(scorer, name, recall, precision):
    """The README has the figures of the first measurement; these bounds keep the lexicon from getting worse."""
    marks = [(kind == "1", scorer.score("\n" + text)[0] >= abuse.THRESHOLD) for kind, text in _sentences(name)]
    right = sum(a and b for a, b in marks)
    assert right >= recall * sum(a for a, _ in marks) and right >= precision * sum(b for _, b in marks)

def test_documents(spark):
    rows = [(1, "\n" + BAD[0], "s", 7.0), (2, None, "s", 7.0), (3, "", None, 7.0), (1, "\n" + BAD[0], "s", 7.0), (4, "\nfine", None, 7.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, score double")
    scored = abuse.score_documents(docs, keep=("source",))
    got = sorted((r.doc_id, r.source or "", r.flagged) for r in scored.collect())
    assert got == [(1, "s", True), (1, "s", True), (2, "s", False), (3, "", False), (4, "", False)]
    rate = {r.source: (r.n_docs, r.n_flagged, r.rate) for r in abuse.rates(scored).collect()}
    assert rate == {"s": (3, 2, 0.666667), None: (2, 0, 0.0)}
    assert abuse.score_documents(docs.limit(0)).collect() == []


def test_own_lexicon(spark):
    docs = spark.createDataFrame([(1, "\nthe blue moon")], "doc_id long, text string")
    assert abuse.score_documents(docs, lexicon="MOON odd 1.0: blue moon\n", exceptions="", rules="", groups="").first().kind == "odd"


def test_insults_said_to_somebody():
    scorer = abuse.Scorer()
    for text in (
        "You are a scumbag", "you're such a b4stard", "Du bist ein Trottel", "Tu es un salaud",
        "¡Eres un imbécil!", "no friend of mine: a twat like you",
    ):
        assert scorer.score(text)[0] >= abuse.THRESHOLD, text
    for text in ("The landlord is a bastard", "you are not an idiot", "you told him he is a moron", "you need a bastard file", ""):
        assert scorer.score(text)[0] < abuse.THRESHOLD, text
