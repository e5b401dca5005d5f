"""Problem 5: one form for texts that look the same in print.

Every text is brought to composed characters without invisible ones, with one width, one kind of blank and hyphen, and no
blank at the end.  Then script-aware repair: in each token (between blanks and hyphens) the dominant script is found from
the letters that have no double in another script; look-alikes of other scripts are replaced by letters of the dominant
script, but only in tokens of mixed script, or in tokens that consist of look-alikes throughout, and only when the result
exists in the vocabulary, that is, when another entry has or reaches the same form.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import skew_join
from ..session import checkpoint, spread
from .lookalikes import TO_LATIN, plain

BLOCK = 1_000
_TOKENS = re.compile(r"([ \-]+)")


@lru_cache(maxsize=20_000)
def script(char: str) -> str:
    """LATIN, CYRILLIC, GREEK, ...; '' for what is no letter.  Latin letters that double others count as foreign."""
    if not char.isalpha():
        return ""
    name = unicodedata.name(char, "").partition(" ")[0]
    return "VARIANT" if name == "LATIN" and ord(char) in TO_LATIN else name


def _doubles() -> dict[str, dict[str, str]]:
    """Script -> Latin letter -> the letter of that script that looks like it."""
    out: dict[str, dict[str, str]] = {}
    for code, latin in TO_LATIN.items():
        out.setdefault(script(chr(code)), {}).setdefault(latin, chr(code))
    return out


_DOUBLES = _doubles()
_ALIKE = {latin for table in _DOUBLES.values() for latin in table}


def repair_token(token: str) -> str:
    """The token in its dominant script; the token itself if it has one script with letters of its own."""
    scripts: dict[str, int] = {}
    own: dict[str, int] = {}
    for c in unicodedata.normalize("NFD", token):
        kind = script(c)
        if not kind:
            continue
        scripts[kind] = scripts.get(kind, 0) + 1
        if ord(c) not in TO_LATIN and not (kind == "LATIN" and c in _ALIKE):
            own[kind] = own.get(kind, 0) + 1
    if set(scripts) <= {"LATIN"}:
        return token
    if own:
        dominant = max(sorted(own), key=lambda k: (own[k], scripts[k]))
    else:
        dominant = "LATIN"  # look-alikes throughout
    if scripts.keys() == {dominant}:
        return token
    table = _DOUBLES.get(dominant, {})
    out = []
    for c in unicodedata.normalize("NFD", token):
        latin = TO_LATIN.get(ord(c), c)
        if dominant == "LATIN":
            out.append(latin)
        else:
            out.append(table.get(latin, c) if script(c) != dominant else c)
    return unicodedata.normalize("NFC", "".join(out))


def forms(text: str) -> tuple[str, str]:
    """The plain form and the repaired form."""
    one = plain(text).rstrip(" ")
    if one.isascii():
        return one, one
    return one, "".join(repair_token(t) if t.strip(" -") else t for t in _TOKENS.split(one))


def normal_forms(rows: DataFrame, id_column: str = "word_id", text_column: str = "word") -> DataFrame:
    """(id, text, plain, repaired) for each row with a text; null texts have no form and give no row."""
    picked = spread(rows.where(F.col(text_column).isNotNull()).select(id_column, text_column))
    kinds = [f.dataType.simpleString() for f in picked.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [forms(t) for t in batch.column(1).to_pylist()]
            one, two = zip(*both, strict=True) if both else ((), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(one, pa.string()), pa.array(two, pa.string())],
                [id_column, text_column, "plain", "repaired"],
            )

    return picked.mapInArrow(run, f"`{id_column}` {kinds[0]}, `{text_column}` {kinds[1]}, plain string, repaired string")


def _several(rows: DataFrame, key: str, text_column: str) -> DataFrame:
    """(key, n_rows) of the keys with at least two different texts; one aggregation, combined before its shuffle."""
    groups = rows.groupBy(key).agg(
        F.min(text_column).alias("__a"), F.max(text_column).alias("__b"), F.count(F.lit(1)).alias("n_rows")
    )
    return groups.where("__a <> __b").select(key, "n_rows")


def canonical(rows: DataFrame, id_column: str = "word_id", text_column: str = "word") -> DataFrame:
    """(id, text, form, repaired): form is the repaired form where it exists in the vocabulary, else the plain form.

    repaired tells whether look-alikes were replaced.  Only rows whose look-alikes could be replaced are looked up.
    """
    f = checkpoint(normal_forms(rows, id_column, text_column))  # read twice below
    same = f.where("repaired = plain").select(id_column, text_column, F.col("plain").alias("form"), F.lit(False).alias("repaired"))
    other = f.where("repaired <> plain")
    support = _several(f, "repaired", text_column)
    joined = skew_join(other, support, ["repaired"], support, [id_column, text_column])
    known = F.col("n_rows").isNotNull()
    form = F.when(known, F.col("repaired")).otherwise(F.col("plain"))
    return same.unionByName(joined.select(id_column, text_column, form.alias("form"), known.alias("repaired")))


def classes(rows: DataFrame, id_column: str = "word_id", text_column: str = "word") -> DataFrame:
    """(id, text, form, n_rows) of the rows whose form another text has too: form is the class, n_rows its size.

    This is the form of the result that grows with the rows, not with the pairs."""
    f = checkpoint(canonical(rows, id_column, text_column).drop("repaired"))  # read twice
    groups = _several(f, "form", text_column)
    return skew_join(f, groups, ["form"], groups, [id_column, text_column], how="inner")


def lookalike_pairs(rows: DataFrame, id_column: str = "word_id", text_column: str = "word") -> DataFrame:
    """All pairs (id_a < id_b) of rows whose texts have the same form but differ in characters.

    The result is the pairs themselves, as asked for, expanded from `classes`.  A class of n rows is spread over n / `BLOCK`
    tasks: each takes a part of the rows on one side and all rows of the class on the other.
    """
    members = checkpoint(classes(rows, id_column, text_column))
    parts = F.ceil(F.col("n_rows") / F.lit(float(BLOCK))).cast("int")
    a = members.select(
        "form",
        F.pmod(F.xxhash64(id_column), parts).cast("int").alias("__part"),
        F.col(id_column).alias(f"{id_column}_a"),
        F.col(text_column).alias("__text_a"),
    )
    b = members.select(
        "form",
        F.explode(F.sequence(F.lit(0), parts - 1)).alias("__part"),
        F.col(id_column).alias(f"{id_column}_b"),
        F.col(text_column).alias("__text_b"),
    )
    pairs = a.join(b, ["form", "__part"])
    pairs = pairs.where((F.col(f"{id_column}_a") < F.col(f"{id_column}_b")) & (F.col("__text_a") != F.col("__text_b")))
    return pairs.select(f"{id_column}_a", f"{id_column}_b")
