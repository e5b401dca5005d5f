"""Sentences and tokens.

A sentence is a line of a text; its words are what the six white-space characters of the C locale separate.  Both sentence
boundaries are the one symbol `</s>`; `<s>` in a text is that symbol too.  Everything here is built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOUNDARY, START, UNKNOWN = "</s>", "<s>", "<unk>"
SPACE = "[ \\t\\n\\u000B\\f\\r]+"


def words(line: Column) -> Column:
    """Words of a line without boundaries; [] for a blank line, null for null."""
    return F.filter(F.split(line, SPACE), lambda x: x != "")


def bounded(line: Column) -> Column:
    """Words of a line between two boundary symbols."""
    inner = F.transform(words(line), lambda x: F.when(x == START, F.lit(BOUNDARY)).otherwise(x))
    return F.concat(F.array(F.lit(BOUNDARY)), inner, F.array(F.lit(BOUNDARY)))


def is_marker(line: Column) -> Column:
    """Whether a line only marks the begin or end of a document."""
    return line.startswith("<DOC ") | (line == "</DOC>")


def sentences(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """(keep, line_no, line) for each line of each text, document markers left out; null texts have no line.

    line_no counts from 0 and includes the markers.
    """
    lines = docs.where(F.col(text).isNotNull()).select(
        *keep, F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "line")
    )
    return lines.where(~is_marker(F.col("line")))


def token_rows(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """(keep, line_no, w): the bounded words of each sentence."""
    return sentences(docs, keep, text).select(*keep, "line_no", bounded(F.col("line")).alias("w"))


def vocabulary(lines: DataFrame, column: str = "value") -> DataFrame:
    """Vocabulary file as rows (word): one word per line, blank lines and lines that start with # left out, each once."""
    word = F.col(column)
    rows = lines.where(word.isNotNull() & (F.regexp_replace(word, SPACE, "") != "") & ~word.startswith("#"))
    return rows.select(F.get(words(word), 0).alias("word")).where("word is not null").distinct()
