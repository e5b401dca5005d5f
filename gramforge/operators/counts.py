"""n-gram counts of all orders as one table (ord, ngram, cnt), and what is counted from it.

ngram joins its words by single blanks; words hold no white space, so that is injective.  hist, suffix and word are
functions of ngram and are derived where needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from .skew import mark
from .text import BOUNDARY, START, UNKNOWN


def hist() -> Column:
    return F.expr("substring_index(ngram, ' ', ord - 1)")


def suffix() -> Column:
    return F.expr("CASE WHEN ord = 1 THEN '' ELSE substring_index(ngram, ' ', 1 - ord) END")


def word() -> Column:
    return F.substring_index("ngram", " ", -1)


def keyed(counts: DataFrame) -> DataFrame:
    """counts with hist, suffix and word."""
    return counts.withColumns({"hist": hist(), "suffix": suffix(), "word": word()})


def occurrences(tokens: DataFrame, order: int, keep: tuple[str, ...] = (), w: str = "w") -> DataFrame:
    """(keep, ord, ngram) of every occurrence of every n-gram up to the order; the first boundary alone is none.

    One generator for all orders: the words are exploded once, and each position yields its n-grams.
    """
    size = F.size(w)

    def of_order(o: int) -> Column:
        ends = F.sequence(F.lit(max(2, o)), F.greatest(size, F.lit(max(2, o))))
        grams = F.transform(
            F.filter(ends, lambda i: i <= size),
            lambda i: F.struct(F.lit(o).alias("ord"), F.array_join(F.slice(w, i - (o - 1), o), " ").alias("ngram")),
        )
        return grams

    grams = F.concat(*[of_order(o) for o in range(1, order + 1)])
    return tokens.select(*keep, F.explode(grams).alias("__g")).select(*keep, "__g.ord", "__g.ngram")


def count_ngrams(tokens: DataFrame, order: int) -> DataFrame:
    """(ord, ngram, cnt); partial aggregation before the one shuffle, so frequent n-grams cost one row per task."""
    return occurrences(tokens, order).groupBy("ord", "ngram").agg(F.count(F.lit(1)).alias("cnt"))


def _each_word(counts: DataFrame, vocab: DataFrame, replace: bool) -> DataFrame:
    """Counts with every word looked up: OOV n-grams dropped, or OOV words replaced and counts added up.

    Works on counted n-grams, never on the text.  The OOV words are found among the distinct words; if they are few (their
    bytes are counted) they are broadcast and n-grams are not shuffled by their words, else the words' join is salted."""
    known = vocab.select("word").where("word is not null").union(
        counts.sparkSession.createDataFrame([(BOUNDARY,), *([(UNKNOWN,)] if replace else [])], "word string")
    ).distinct()
    rows = counts.select("ord", "ngram", "cnt", F.posexplode(F.split("ngram", " ")).alias("__i", "word"))
    unknown = checkpoint(rows.select("word").distinct().join(known, "word", "left_anti"))
    marked = mark(rows, unknown, "word", "__oov", ["ord", "ngram", "__i"])
    if replace:
        new = marked.groupBy("ord", "ngram").agg(
            F.first("cnt").alias("cnt"),
            F.array_sort(
                F.collect_list(
                    F.struct("__i", F.when(F.col("__oov"), F.lit(UNKNOWN)).otherwise(F.col("word")).alias("word"))
                )
            ).alias("__w"),
        )
        joined = F.array_join(F.transform("__w", lambda s: s["word"]), " ")
        return new.select("ord", joined.alias("ngram"), "cnt").groupBy("ord", "ngram").agg(F.sum("cnt").alias("cnt"))
    whole = marked.groupBy("ord", "ngram").agg(F.first("cnt").alias("cnt"), F.bool_or("__oov").alias("__bad"))
    return whole.where(~F.col("__bad")).drop("__bad")


def close_vocabulary(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """Counts over a fixed vocabulary: n-grams with another word are gone, every vocabulary word has a unigram row."""
    kept = _each_word(counts, vocab, replace=False)
    spark = counts.sparkSession
    boundary = spark.createDataFrame([(BOUNDARY,)], "word string")
    every = vocab.select("word").where("word is not null").union(boundary).distinct()
    every = every.where(F.col("word") != START)
    zero = every.select(F.lit(1).alias("ord"), F.col("word").alias("ngram"), F.lit(0).cast("bigint").alias("cnt"))
    return kept.unionByName(zero).groupBy("ord", "ngram").agg(F.sum("cnt").alias("cnt"))


def replace_unknown(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """Counts with every word outside the vocabulary read as `<unk>`."""
    return _each_word(counts, vocab, replace=True)


def add_missing(counts: DataFrame) -> DataFrame:
    """counts with count-0 rows for the prefixes and suffixes they lack, and for those of these, down to the unigrams;
    equal n-grams are added up."""
    size, w = F.col("ord"), F.split("ngram", " ")
    # the prefixes and suffixes of an n-gram, and theirs in turn, are all of its shorter runs of words
    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(1), size - 1),
            lambda o: F.transform(
                F.sequence(F.lit(1), size - o + 1),
                lambda i: F.struct(o.alias("ord"), F.array_join(F.slice(w, i, o), " ").alias("ngram")),
            ),
        )
    )
    more = counts.where("ord > 1").select(F.explode(inner).alias("__g")).select("__g.*").distinct()
    zero = more.withColumn("cnt", F.lit(0).cast("bigint"))
    return counts.select("ord", "ngram", "cnt").unionByName(zero).groupBy("ord", "ngram").agg(F.sum("cnt").alias("cnt"))


def _with_neighbours(counts: DataFrame, part: Column) -> DataFrame:
    """(ord, ngram, cnt, n, n_positive): each n-gram with its count (null for what counts lacks, as order 0) and the number
    of n-grams of the next order that have it as `part`, all and those with a count above 0.

    One aggregation of two rows per n-gram instead of a self-join."""
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    own = F.struct(F.col("ord"), F.col("ngram"), F.col("cnt"), zero.alias("n"), zero.alias("m"))
    of = F.struct(
        (F.col("ord") - 1).alias("ord"), part.alias("ngram"), F.lit(None).cast("bigint").alias("cnt"), one.alias("n"),
        F.when(F.col("cnt") > 0, one).otherwise(zero).alias("m"),
    )
    rows = counts.select(F.explode(F.array(own, of)).alias("__r")).select("__r.*")
    return rows.groupBy("ord", "ngram").agg(F.max("cnt").alias("cnt"), F.sum("n").alias("n"), F.sum("m").alias("n_positive"))


def branching(counts: DataFrame, order: int, side: str) -> DataFrame:
    """(ord, ngram, n) of orders 0 to order - 1: how many n-grams of the next order have it as suffix (side left) or
    prefix (side right)."""
    rows = _with_neighbours(counts, suffix() if side == "left" else hist())
    return rows.where((F.col("ord") < order) & ((F.col("ord") == 0) | F.col("cnt").isNotNull())).select("ord", "ngram", "n")


def effective_counts(counts: DataFrame, order: int) -> DataFrame:
    """(ord, ngram, cnt, eff, n_left): below the top order the number of different left neighbours with a count above 0,
    or the count itself where there is none; at the top order the count.  n_left is the number of all left neighbours."""
    rows = _with_neighbours(counts.where(F.col("ord") <= order), suffix()).where("cnt is not null")
    eff = F.when(F.col("n_positive") > 0, F.col("n_positive")).otherwise(F.col("cnt"))
    return rows.select("ord", "ngram", "cnt", eff.alias("eff"), F.col("n").alias("n_left"))


def count_of_counts(eff: DataFrame, most: int) -> DataFrame:
    """(ord, eff, n): how many n-grams have each effective count from 1 to most."""
    return eff.where(F.col("eff").between(1, most)).groupBy("ord", "eff").agg(F.count(F.lit(1)).alias("n"))


def export_order() -> list[Column]:
    """Sort keys of files: by order, then word by word with `</s>` and `<unk>` before all other words."""
    ranks = F.transform(
        F.split("ngram", " "),
        lambda x: F.when(x == BOUNDARY, F.lit("\x00")).when(x == UNKNOWN, F.lit("\x01")).otherwise(x),
    )
    return [F.col("ord"), ranks]


def shown() -> Column:
    """ngram as files show it: a boundary at the start is `<s>`."""
    return F.when(F.col("ngram") == BOUNDARY, F.lit(START)).otherwise(
        F.regexp_replace("ngram", f"^{BOUNDARY} ", f"{START} ")
    )
