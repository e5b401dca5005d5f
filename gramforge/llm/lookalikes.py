"""Letters of other scripts that print like Latin letters, and characters that do not print at all."""

from __future__ import annotations

import unicodedata

# Letters (left) that look like the Latin letter to their right, by script.
CYRILLIC = "аaеeоoрpсcуyхxіiјjѕsԁdԛqԝwһhӏl" "АAВBЕEКKМMНHОOРPСCТTУYХXІIЈJЅSԌGԜW"
GREEK = "οoνvρpαaιiκkυuχx" "ΑAΒBΕEΖZΗHΙIΚKΜMΝNΟOΡPΤTΥYΧX"
ARMENIAN = "սuօoոnհhցgզqյj" "ՍUՏSՕOԼL"
LATIN_VARIANTS = "ɑaɡgıiɩiʋvᴏoᴄcᴠvᴡwᴢzꜱs"
INVISIBLE = (
    "­͏؜ᅟᅠ឴឵᠋᠌᠍᠎​‌‍‎‏"
    "‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩⁪⁫"
    "⁬⁭⁮⁯︀︁︂︃︄︅︆︇︈︉︊︋"
    "︌︍︎️﻿￹￺￻"
)
BLANKS = "               　"
HYPHENS = "‐‑﹣－"


def _pairs(text: str) -> dict[int, str]:
    return {ord(text[i]): text[i + 1] for i in range(0, len(text), 2)}


#: Code point of a look-alike to its Latin letter.
TO_LATIN: dict[int, str] = {k: v for s in (CYRILLIC, GREEK, ARMENIAN, LATIN_VARIANTS) for k, v in _pairs(s).items()}

#: What `plain` replaces one by one: nothing for invisible characters, a blank for blanks, "-" for hyphens.
_SIMPLE: dict[int, str] = (
    {ord(c): "" for c in INVISIBLE} | {ord(c): " " for c in BLANKS} | {ord(c): "-" for c in HYPHENS}
)


class _Plain(dict):
    """Translation table that fills itself: width and presentation forms go, other characters stay."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        kind, _, rest = unicodedata.decomposition(char).partition("> ")
        same = rest and (kind in ("<wide", "<narrow", "<noBreak") or 0xFB00 <= code <= 0xFB06)
        value = "".join(chr(int(x, 16)) for x in rest.split()) if same else char
        value = "".join(_SIMPLE.get(ord(x), x) for x in value)
        if len(self) < 20_000:
            self[code] = value
        return value


_PLAIN = _Plain(_SIMPLE)


def plain(text: str) -> str:
    """Text in composed form without invisible characters and without differences of width, blank or hyphen.

    Case, accents and the letters themselves stay.  Superscripts, fractions and the like look different and stay too.
    """
    if text.isascii():
        return text
    return unicodedata.normalize("NFC", text.translate(_PLAIN))


class _Latin(dict):
    def __missing__(self, code: int) -> str:
        value = TO_LATIN.get(code) or "".join(TO_LATIN.get(ord(x), x) for x in _PLAIN[code])
        if len(self) < 20_000:
            self[code] = value
        return value


_LATIN = _Latin()


def to_latin(text: str) -> str:
    """`plain`, with every look-alike letter replaced by its Latin letter, whatever the script around it."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFC", text.translate(_LATIN))
