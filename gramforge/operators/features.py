"""Computed features of n-grams: tables (ord, ngram, value), n-grams without a row having 0.

A feature is written `f1:f2:...:loader:source`; functions apply from right to left to what the loader makes of the source.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .counts import hist, occurrences

WARN_ABOVE = 20.0


def _map(change: Callable[[Column], Column]) -> Callable[[DataFrame], DataFrame]:
    return lambda f: f.withColumn("value", change(F.col("value")))


def norm(f: DataFrame) -> DataFrame:
    """Values over the largest of their order; 0 where that isn't positive.  One row per order is broadcast."""
    top = f.groupBy("ord").agg(F.max("value").alias("__max"))
    joined = f.join(F.broadcast(top), "ord")
    return joined.withColumn("value", F.when(F.col("__max") > 0, F.col("value") / F.col("__max")).otherwise(0.0)).drop("__max")


def sum_history(f: DataFrame) -> DataFrame:
    """Sum of the values of the n-grams of the next order with the n-gram as prefix; order 0 is the empty n-gram."""
    return f.groupBy((F.col("ord") - 1).alias("ord"), hist().alias("ngram")).agg(F.sum("value").cast("double").alias("value"))


FUNCTIONS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "log": _map(lambda x: F.log(x + F.lit(1e-99))),
    "log1p": _map(F.log1p),
    "pow2": _map(lambda x: x * x),
    "pow3": _map(lambda x: x * x * x),
    "norm": norm,
    "sumhist": sum_history,
}


def document_frequency(tokens: DataFrame, order: int, doc: str = "doc_id") -> DataFrame:
    """Share of the documents that hold the n-gram."""
    n_docs = tokens.select(doc).distinct().agg(F.count(F.lit(1))).scalar()
    each = occurrences(tokens, order, (doc,)).distinct()
    return each.groupBy("ord", "ngram").agg(F.count(F.lit(1)).alias("n")).select(
        "ord", "ngram", (F.col("n") / n_docs.cast("double")).alias("value")
    )


def document_entropy(tokens: DataFrame, order: int, doc: str = "doc_id") -> DataFrame:
    """Entropy of the n-gram's distribution over documents, over ln of their number; 0 for one document."""
    n_docs = tokens.select(doc).distinct().agg(F.count(F.lit(1)).cast("double")).scalar()
    each = occurrences(tokens, order, (doc,)).groupBy("ord", "ngram", doc).agg(F.count(F.lit(1)).cast("double").alias("c"))
    both = each.groupBy("ord", "ngram").agg(F.sum("c").alias("t"), F.sum(F.col("c") * F.log("c")).alias("s"))
    h = F.when(F.col("__n") > 1, (F.log("t") - F.col("s") / F.col("t")) / F.log("__n")).otherwise(0.0)
    return both.withColumn("__n", n_docs).select("ord", "ngram", h.alias("value"))


def _with_topics(tokens: DataFrame, order: int, state: str, w: str = "w") -> DataFrame:
    """Occurrences (ord, ngram, n_topic, last) with the number of topic words (state 1) and whether the last is one."""
    size = F.size(w)

    def of_order(o: int) -> Column:
        ends = F.filter(F.sequence(F.lit(max(2, o)), F.greatest(size, F.lit(max(2, o)))), lambda i: i <= size)
        return F.transform(
            ends,
            lambda i: F.struct(
                F.lit(o).alias("ord"),
                F.array_join(F.slice(w, i - (o - 1), o), " ").alias("ngram"),
                F.exists(F.slice(state, i - (o - 1), o), lambda s: s == 1).alias("some"),
                (F.element_at(state, i) == 1).alias("last"),
            ),
        )

    per_order = [of_order(o) for o in range(1, order + 1)]
    return tokens.select(F.explode(F.concat(*per_order)).alias("__g")).select("__g.*")


def topic_share(tokens: DataFrame, order: int, state: str = "s", kind: str = "hist") -> DataFrame:
    """tokens have words w and their states.  kind `hist`: share of occurrences with a topic word; `word`: whose last word
    is one; `wordtopic`: per history, share of following words that are topic words."""
    rows = _with_topics(tokens, order, state)
    if kind == "wordtopic":
        rows = rows.select((F.col("ord") - 1).alias("ord"), hist().alias("ngram"), F.col("last").alias("hit"))
    else:
        rows = rows.withColumn("hit", F.col("some" if kind == "hist" else "last"))
    return rows.groupBy("ord", "ngram").agg(F.avg(F.col("hit").cast("double")).alias("value"))


LOADERS: dict[str, Callable[..., DataFrame]] = {
    "freq": document_frequency,
    "entropy": document_entropy,
    "histtopicprob": lambda t, n: topic_share(t, n, kind="hist"),
    "wordprob": lambda t, n: topic_share(t, n, kind="word"),
    "wordtopicprob": lambda t, n: topic_share(t, n, kind="wordtopic"),
}


def parse_feature(text: str, corpus: str | None = None) -> tuple[list[str], str | None, str]:
    """(functions from the outermost, loader or None, source).  `%s` in the source is the corpus file without directory
    and last extension."""
    *names, source = text.split(":")
    loader = names.pop() if names and names[-1] in LOADERS else None
    for name in names:
        if name not in FUNCTIONS:
            raise ValueError(f"unknown feature function {name}")
    if "%s" in source:
        if corpus is None:
            raise ValueError("%s needs a corpus file")
        source = source.replace("%s", os.path.splitext(os.path.basename(corpus))[0])
    return names, loader, source


def feature(text: str, order: int, load: Callable[[str | None, str], DataFrame], corpus: str | None = None) -> DataFrame:
    """The feature table.  load(loader, source) gives tokens for a loader, else a feature table."""
    functions, loader, source = parse_feature(text, corpus)
    f = load(loader, source)
    if loader:
        f = LOADERS[loader](f, order)
    for name in reversed(functions):
        f = FUNCTIONS[name](f)
    return f


def align(f: DataFrame, keys: DataFrame) -> DataFrame:
    """value of every row of keys (ord, ngram), 0 where the feature has none; of repeated feature rows the largest `line`
    (the last in the file) counts if there is such a column."""
    if "line" in f.columns:
        f = f.groupBy("ord", "ngram").agg(F.max_by("value", "line").alias("value"))
    return keys.join(f, ["ord", "ngram"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
