"""Perplexity of held-out text: longest-suffix match of every token in a back-off model.

Tokens are reduced to distinct contexts with counts before anything is joined with the model, so the joins grow with the
distinct n-grams of the held-out text only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint
from .skew import mark


def ln(x: Column) -> Column:
    """Natural logarithm with -inf at 0."""
    return F.when(x > 0, F.log(x)).when(x == 0, F.lit(float("-inf")))


def contexts(
    tokens: DataFrame, model: DataFrame, order: int, keep: list[str], vocab: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Distinct contexts (ctx, ngram, cnt) of the in-vocabulary tokens, and the OOV tokens (keep, line_no, i, word).

    ctx is the length of the longest n-gram to try: 2 at a line's first word, one more at each next word up to the order,
    1 after an OOV word.  The vocabulary is the model's unigrams, with vocab (word) only those of them that it has.

    The text's distinct words are looked up, not its tokens; the OOV ones among them mark the tokens (broadcast after their
    bytes were counted, or by a salted join).
    """
    last = F.transform(
        F.sequence(F.lit(2), F.size("w")),
        lambda i: F.struct(
            (i - 1).alias("i"),
            F.slice(F.col("w"), F.greatest(i - (order - 1), F.lit(1)), F.least(F.lit(order), i)).alias("__last"),
        ),
    )
    rows = tokens.select(*keep, "line_no", F.explode(last).alias("__t")).select(*keep, "line_no", "__t.*")
    rows = rows.withColumn("word", F.element_at("__last", -1))
    known = model.where("ord = 1").select(F.col("ngram").alias("word"))
    if vocab is not None:
        known = known.join(vocab.select("word").distinct(), "word", "left_semi")
    unknown = checkpoint(rows.select("word").distinct().join(known, "word", "left_anti"))
    rows = mark(rows, unknown, "word", "__oov", [*keep, "line_no", "i"])
    before = Window.partitionBy(*keep, "line_no").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    reset = F.coalesce(F.max(F.when(F.col("__oov"), F.col("i"))).over(before), F.lit(-1))
    rows = rows.withColumn("ctx", F.least(F.lit(order), F.col("i") - reset))
    oov = rows.where("__oov").select(*keep, "line_no", "i", "word")
    ngram = F.array_join(F.slice("__last", F.size("__last") - F.col("ctx") + 1, F.col("ctx")), " ")
    seen = rows.where(~F.col("__oov")).select("ctx", ngram.alias("ngram"))
    return seen.groupBy("ctx", "ngram").agg(F.count(F.lit(1)).alias("cnt")), oov


def longest_match(contexts: DataFrame, model: DataFrame) -> DataFrame:
    """contexts with ord and prob of the longest suffix the model has, and ln_bow, the sum of ln of the back-off weights of
    the histories that were dropped on the way (histories the model lacks weigh 1)."""
    words = F.split("ngram", " ")
    tries = F.transform(
        F.sequence(F.lit(1), F.col("ctx")),
        lambda o: F.struct(
            o.alias("o"),
            F.array_join(F.slice(words, F.col("ctx") - o + 1, o), " ").alias("__gram"),
            F.when(o > 1, F.array_join(F.slice(words, F.col("ctx") - o + 1, o - 1), " ")).alias("__hist"),
        ),
    )
    rows = contexts.select("ctx", "ngram", "cnt", F.explode(tries).alias("__t")).select("ctx", "ngram", "cnt", "__t.*")
    grams = model.select(F.col("ord").alias("o"), F.col("ngram").alias("__gram"), "prob")
    hists = model.where("bow is not null").select((F.col("ord") + 1).alias("o"), F.col("ngram").alias("__hist"), "bow")
    rows = rows.join(grams, ["o", "__gram"], "left").join(hists, ["o", "__hist"], "left")
    found = rows.groupBy("ctx", "ngram").agg(
        F.first("cnt").alias("cnt"),
        F.max(F.when(F.col("prob").isNotNull(), F.struct(F.col("o"), F.col("prob")))).alias("__best"),
        F.sort_array(F.collect_list(F.struct("o", "bow"))).alias("__bows"),  # at most `order` elements
    )
    dropped = F.filter("__bows", lambda b: (b["o"] > F.coalesce(F.col("__best.o"), F.lit(0))) & b["bow"].isNotNull())
    return found.select(
        "ctx",
        "ngram",
        "cnt",
        F.col("__best.o").alias("ord"),
        F.col("__best.prob").alias("prob"),
        F.aggregate(dropped, F.lit(0.0), lambda a, b: a + ln(b["bow"])).alias("ln_bow"),
    )


def matched_ngram() -> Column:
    return F.expr("substring_index(ngram, ' ', -ord)")


def perplexity(
    tokens: DataFrame, model: DataFrame, order: int, keep: list[str], per_token: bool = False, vocab: DataFrame | None = None
) -> DataFrame:
    """One row: n_words (scored), n_oov, n_zero, entropy, perplexity.

    Words of probability 0 add nothing to the log-probability.  n_zero counts them once per distinct model row, and with
    per_token once per token; it is taken from the number of words in the mean.  A back-off weight of 0 gives infinity.
    """
    seen, oov = contexts(tokens, model, order, keep, vocab)
    m = longest_match(seen, model)
    zero = (F.col("prob") == 0).cast("int")
    n_zero = F.sum(F.col("cnt") * zero) if per_token else F.count_distinct(F.when(F.col("prob") == 0, F.struct("ord", matched_ngram())))
    total = F.sum(F.col("cnt") * (F.when(F.col("prob") > 0, F.log("prob")).otherwise(0.0) + F.col("ln_bow")))
    one = m.agg(
        F.coalesce(F.sum("cnt"), F.lit(0)).alias("n_words"), F.coalesce(n_zero, F.lit(0)).alias("n_zero"), total.alias("__total")
    ).withColumn("n_oov", oov.agg(F.count(F.lit(1))).scalar())
    n = F.col("n_words") - F.col("n_zero")
    one = one.withColumn("entropy", F.when(n > 0, -F.col("__total") / n))
    return one.select("n_words", "n_oov", "n_zero", "entropy", F.exp("entropy").alias("perplexity"))
