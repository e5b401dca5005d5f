"""Registered queries of tokenising, counting and smoothing, over all lines of all documents."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import counts as C
from ..operators import smoothing as S
from ..operators import text as T
from ..session import checkpoint, spread
from . import lm_sql as Q

ORDER = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokens(spark: SparkSession, sf_dir: str, where: Column | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = (docs if where is None else docs.where(where)).select("doc_id", "text")
    return T.token_rows(spread(docs), ["doc_id"])


def counted(spark: SparkSession, sf_dir: str, order: int = ORDER) -> DataFrame:
    return C.count_ngrams(tokens(spark, sf_dir), order)


def log10(prob: Column) -> Column:
    return F.round(F.when(prob > 0, F.log10(prob)).otherwise(F.lit(-99.0)), 6) + F.lit(0.0)


def vocab_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closed vocabulary of these queries: words of at least 5 occurrences."""
    uni = C.count_ngrams(tokens(spark, sf_dir), 1)
    return uni.where("cnt >= 5").select(F.col("ngram").alias("word"))


VOCAB = "SELECT ngram AS word FROM occ1 GROUP BY ngram HAVING count(*) >= 5"


# -- counting ----------------------------------------------------------------------------------------------------------


def ngram_counts(spark: SparkSession, sf_dir: str, order: int) -> DataFrame:
    c = C.count_ngrams(tokens(spark, sf_dir), order).where(F.col("ord") == order)
    return c.select("ngram", "cnt")


def token_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tokens(spark, sf_dir)
    return t.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), (F.size("w") - 2).cast("bigint").alias("n_words"))


def vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(spark, sf_dir, 1).select(C.shown().alias("word"))


def closed_vocab_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = checkpoint(counted(spark, sf_dir))
    v = c.where("ord = 1 and cnt >= 5").select(F.col("ngram").alias("word"))
    return C.close_vocabulary(c, v).select("ord", "ngram", "cnt")


def unk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = checkpoint(counted(spark, sf_dir))
    v = c.where("ord = 1 and cnt >= 5").select(F.col("ngram").alias("word"))
    return C.replace_unknown(c, v).select("ord", "ngram", "cnt")


def oov_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the evaluation texts that the documents lack, with their occurrences."""
    items = T.token_rows(table(spark, sf_dir, "eval_items"), ["item_id"])
    words = C.count_ngrams(items, 1).select(F.col("ngram").alias("word"), "cnt")
    known = counted(spark, sf_dir, 1).select(F.col("ngram").alias("word"))
    return words.join(known, "word", "left_anti")


def left_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.branching(counted(spark, sf_dir), ORDER, "left")


def right_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.branching(counted(spark, sf_dir), ORDER, "right")


def eff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.effective_counts(counted(spark, sf_dir), ORDER).select("ord", "ngram", "eff")


def count_of_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.count_of_counts(C.effective_counts(counted(spark, sf_dir), ORDER), 4)


def history_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    eff = C.keyed(C.effective_counts(counted(spark, sf_dir), ORDER))
    sums = S.history_sums(eff, 3)
    return sums.select("ord", "hist", "tot", F.round(F.when(F.col("tot") > 0, 1.0 / F.col("tot")).otherwise(0.0), 9).alias("inv"))


def kn_discounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = S.discounts(C.effective_counts(counted(spark, sf_dir), ORDER), 3)
    return d.select("ord", F.round("y", 9).alias("y"), *[F.round(F.element_at("d", i), 9).alias(f"d{i}") for i in (1, 2, 3)])


def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts source: the delivered n-gram counts, duplicate keys added up."""
    rows = table(spark, sf_dir, "ngram_counts").where("ngram is not null")
    return rows.groupBy("ord", "ngram").agg(F.sum(F.coalesce("cnt", F.lit(0))).alias("cnt"))


def table_counts_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with count-0 rows for missing prefixes and suffixes."""
    return C.add_missing(table_counts(spark, sf_dir))


# -- smoothing ---------------------------------------------------------------------------------------------------------


def _model(m: DataFrame) -> DataFrame:
    bow = F.round(F.coalesce("bow", F.lit(1.0)), 6) + F.lit(0.0)
    return m.select("ord", "ngram", log10(F.col("prob")).alias("log10prob"), bow.alias("bow"))


def kn(spark: SparkSession, sf_dir: str, order: int = ORDER, number: int = 3) -> DataFrame:
    return S.kneser_ney(counted(spark, sf_dir, order), order, number)


def modkn_probs(spark: SparkSession, sf_dir: str, order: int) -> DataFrame:
    m = _model(kn(spark, sf_dir, order)).where(F.col("ord") == order)
    return m.select("ngram", "log10prob")


def modkn_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model(kn(spark, sf_dir))


def kn_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model(kn(spark, sf_dir, number=1))


def kn5_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model(kn(spark, sf_dir, number=5))


GIVEN = {1: [0.517293871273, 1.093827193817, 1.531729382911], 2: [0.617283917311, 1.129381724197, 1.418293718833], 3: [0.718293147119, 1.239281733771, 1.352839193317]}


def fixed_modkn_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model(S.kneser_ney(counted(spark, sf_dir), ORDER, 3, given=GIVEN))


def mixed_smoothing_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One discount at order 1, three at order 2, two at order 3."""
    return _model(S.kneser_ney(counted(spark, sf_dir), ORDER, [1, 3, 2]))


def closed_modkn_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model(S.kneser_ney(closed_vocab_counts(spark, sf_dir), ORDER, 3, closed=True))


def masked_modkn_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the rows that the evaluation texts' n-grams need."""
    items = T.token_rows(table(spark, sf_dir, "eval_items"), ["item_id"])
    needed = C.count_ngrams(items, ORDER).select("ord", "ngram")
    return _model(S.kneser_ney(counted(spark, sf_dir), ORDER, 3, needed=needed))


def weighted_kn_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One weighting feature, ln(1 + effective count), with weight 0.3."""
    c = checkpoint(counted(spark, sf_dir))
    f = C.effective_counts(c, ORDER).select("ord", "ngram", F.array(F.log1p("eff")).alias("f"))
    return _model(S.kneser_ney(c, ORDER, 3, features=f, weights=[0.3]))


def weighted_masked_kn_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, only the rows that the evaluation texts' n-grams need."""
    c = checkpoint(counted(spark, sf_dir))
    f = C.effective_counts(c, ORDER).select("ord", "ngram", F.array(F.log1p("eff")).alias("f"))
    needed = C.count_ngrams(T.token_rows(table(spark, sf_dir, "eval_items"), ["item_id"]), ORDER).select("ord", "ngram")
    return _model(S.kneser_ney(c, ORDER, 3, features=f, weights=[0.3], needed=needed))


def ml_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model(S.maximum_likelihood(counted(spark, sf_dir))).select("ord", "ngram", "log10prob")


def ml_probs_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model(S.maximum_likelihood(counted(spark, sf_dir), compat=True)).select("ord", "ngram", "log10prob")


def lm_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model cut to order 2."""
    from ..operators import model as M

    return _model(M.truncate(kn(spark, sf_dir), 2))


def table_modkn_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model of the delivered counts."""
    return _model(S.kneser_ney(checkpoint(table_counts_closed(spark, sf_dir)), ORDER, 3))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for o in (1, 2, 3):
        out[f"ngram_counts_{o}"] = partial(ngram_counts, order=o)
        out[f"modkn_probs_{o}"] = partial(modkn_probs, order=o)
    made = (
        token_lines, vocab, closed_vocab_counts, unk_counts, oov_tokens, left_counts, right_counts, eff_counts,
        count_of_counts, history_totals, kn_discounts, table_counts, table_counts_closed, modkn_model, kn_model, kn5_model,
        fixed_modkn_model, mixed_smoothing_model, closed_modkn_model, masked_modkn_model, weighted_kn_model, weighted_masked_kn_model,
        ml_probs, ml_probs_compat,
        lm_truncate, table_modkn_model,
    )
    return out | {f.__name__: f for f in made}


# -- SQL ---------------------------------------------------------------------------------------------------------------

SHOWN = "CASE WHEN ngram = '</s>' THEN '<s>' ELSE regexp_replace(ngram, '^</s> ', '<s> ') END"
MODEL = f"SELECT ord, ngram, {Q.log10('prob')} AS log10prob, round(coalesce(bow, 1.0), 6) + 0.0 AS bow FROM lm"
ITEMS = Q.tokens("eval_items", "item_id")


def _branching(side: str) -> str:
    return f"""WITH {Q.counts(ORDER)}, k AS (SELECT ord - 1 AS ord, {side} AS ngram, count(*) AS n FROM c GROUP BY 1, 2),
  own AS (SELECT ord, ngram FROM c WHERE ord < {ORDER} UNION ALL SELECT 0, '')
SELECT own.ord, own.ngram, coalesce(k.n, 0) AS n FROM own LEFT JOIN k ON own.ord = k.ord AND own.ngram = k.ngram"""


def _closed(name: str = "c") -> str:
    """CTEs of the closed-vocabulary counts."""
    return f"""{Q.counts(ORDER, "c0")}, v AS (SELECT ngram AS word FROM c0 WHERE ord = 1 AND cnt >= 5),
  bad AS (SELECT DISTINCT ord, ngram FROM (SELECT ord, ngram, unnest(string_split(ngram, ' ')) AS word FROM c0)
          WHERE word <> '</s>' AND word NOT IN (SELECT word FROM v)),
  kept AS (SELECT ord, ngram, cnt FROM c0 ANTI JOIN bad USING (ord, ngram)
           UNION ALL SELECT 1, word, 0 FROM (SELECT word FROM v UNION SELECT '</s>')),
  {name} AS (SELECT *, {Q.KEYS} FROM (SELECT ord, ngram, CAST(sum(cnt) AS BIGINT) AS cnt FROM kept GROUP BY ord, ngram))"""


_TABLE = "SELECT ord, ngram, CAST(sum(coalesce(cnt, 0)) AS BIGINT) AS cnt FROM ngram_counts WHERE ngram IS NOT NULL GROUP BY ord, ngram"
_PARTS = """SELECT ord - 1 AS ord, unnest([array_to_string(string_split(ngram, ' ')[1:ord - 1], ' '),
     array_to_string(string_split(ngram, ' ')[2:ord], ' ')]) AS ngram, 0 AS cnt FROM {t} WHERE ord > 1"""
_TABLE_CLOSED = f"""t0 AS ({_TABLE}), t1 AS ({_PARTS.format(t="t0")}), t2 AS ({_PARTS.format(t="t1")}),
  t3 AS (SELECT ord, ngram, CAST(sum(cnt) AS BIGINT) AS cnt FROM (FROM t0 UNION ALL FROM t1 UNION ALL FROM t2) GROUP BY ord, ngram)"""


def _kn(order: int = ORDER, number: int = 3, counts: str | None = None, closed: bool = False) -> str:
    return f"WITH {counts or Q.counts(order)}, {Q.effective(order)}, {Q.discounts(number)}, {Q.kneser_ney(order, number, closed)}"


def oracle_sql() -> dict[str, str]:
    c, e = Q.counts(ORDER), Q.effective(ORDER)
    out = {}
    for o in (1, 2, 3):
        out[f"ngram_counts_{o}"] = f"WITH {Q.counts(o)} SELECT ngram, cnt FROM c WHERE ord = {o}"
        out[f"modkn_probs_{o}"] = f"{_kn(o)} SELECT ngram, {Q.log10('prob')} AS log10prob FROM lm WHERE ord = {o}"
    given = ", ".join(f"({o}, {', '.join(f'{x}e0' for x in d)})" for o, d in GIVEN.items())
    fixed = f"d AS (SELECT * FROM (VALUES {given}) AS t(ord, d1, d2, d3))"
    want = f"""{Q.counts(ORDER, "need", ITEMS, "n")}, want AS (
            SELECT DISTINCT i AS ord, array_to_string(string_split(ngram, ' ')[ord - i + 1:ord], ' ') AS ngram
            FROM (SELECT ord, ngram, unnest(range(1, ord + 1)) AS i FROM need))"""
    weighted = "e AS (SELECT *, exp(0.3 * ln(1 + eff)) AS wt FROM e0)"
    return out | {
        "token_lines": f"WITH tok AS ({Q.tokens()}) SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, CAST(len(w) - 2 AS BIGINT) AS n_words FROM tok",
        "vocab": f"WITH {Q.counts(1)} SELECT {SHOWN} AS word FROM c",
        "closed_vocab_counts": f"WITH {_closed()} SELECT ord, ngram, cnt FROM c",
        "unk_counts": f"""WITH {Q.counts(ORDER, "c0")}, k AS (SELECT ngram AS word FROM c0 WHERE ord = 1 AND cnt >= 5),
          g AS (SELECT ord, ngram, cnt, w.word, w.i FROM (SELECT ord, ngram, cnt, unnest(list_transform(string_split(ngram, ' '), lambda x, i: {{'word': x, 'i': i}})) AS w FROM c0)),
          m AS (SELECT ord, ngram, any_value(cnt) AS cnt, array_to_string(list(CASE WHEN g.word = '</s>' OR k.word IS NOT NULL THEN g.word ELSE '<unk>' END ORDER BY i), ' ') AS n
                FROM g LEFT JOIN k ON k.word = g.word GROUP BY ord, ngram)
          SELECT ord, n AS ngram, CAST(sum(cnt) AS BIGINT) AS cnt FROM m GROUP BY ord, n""",
        "oov_tokens": f"""WITH {Q.counts(1, "c", ITEMS)}, {Q.counts(1, "k", prefix="k")}
          SELECT c.ngram AS word, c.cnt FROM c ANTI JOIN k USING (ngram)""",
        "left_counts": _branching("suffix"),
        "right_counts": _branching("hist"),
        "eff_counts": f"WITH {c}, {e} SELECT ord, ngram, eff FROM e",
        "count_of_counts": f"WITH {c}, {e} SELECT ord, eff, count(*) AS n FROM e WHERE eff BETWEEN 1 AND 4 GROUP BY ord, eff",
        "history_totals": f"""WITH {c}, {e} SELECT ord, hist, CAST(sum(eff) AS BIGINT) AS tot,
          round(CASE WHEN sum(eff) > 0 THEN 1.0 / CAST(sum(eff) AS DOUBLE) ELSE 0 END, 9) AS inv FROM e GROUP BY ord, hist""",
        "kn_discounts": f"WITH {c}, {e}, {Q.discounts(3)} SELECT ord, round(y, 9) AS y, round(d1, 9) AS d1, round(d2, 9) AS d2, round(d3, 9) AS d3 FROM d",
        "table_counts": _TABLE,
        "table_counts_closed": f"WITH {_TABLE_CLOSED} SELECT ord, ngram, cnt FROM t3",
        "modkn_model": f"{_kn()} {MODEL}",
        "kn_model": f"{_kn(number=1)} {MODEL}",
        "kn5_model": f"{_kn(number=5)} {MODEL}",
        "fixed_modkn_model": f"WITH {c}, {e}, {fixed}, {Q.kneser_ney(ORDER, 3)} {MODEL}",
        "mixed_smoothing_model": f"""WITH {c}, {e}, {Q.discounts(3, name="d0")}, d AS (SELECT ord, d1, CASE ord WHEN 1 THEN d1 ELSE d2 END AS d2,
          CASE ord WHEN 1 THEN d1 WHEN 2 THEN d3 ELSE d2 END AS d3 FROM d0), {Q.kneser_ney(ORDER, 3)} {MODEL}""",
        "closed_modkn_model": f"{_kn(counts=_closed(), closed=True)} {MODEL}",
        "masked_modkn_model": f"{_kn()}, {want} {MODEL} SEMI JOIN want USING (ord, ngram)",
        "weighted_masked_kn_model": f"""WITH {c}, {Q.effective(ORDER, name='e0')}, {weighted}, {Q.discounts(3)}, {Q.kneser_ney(ORDER, 3, weight='wt')},
          {want} {MODEL} SEMI JOIN want USING (ord, ngram)""",
        "weighted_kn_model": f"WITH {c}, {Q.effective(ORDER, name='e0')}, {weighted}, {Q.discounts(3)}, {Q.kneser_ney(ORDER, 3, weight='wt')} {MODEL}",
        "ml_probs": f"WITH {c} SELECT ord, ngram, {Q.log10('cnt / CAST(sum(cnt) OVER (PARTITION BY ord, hist) AS DOUBLE)')} AS log10prob FROM c",
        "ml_probs_compat": f"WITH {c} SELECT ord, ngram, {Q.log10('cnt / CAST(count(*) OVER (PARTITION BY ord, hist) AS DOUBLE)')} AS log10prob FROM c",
        "lm_truncate": f"""{_kn()} SELECT ord, ngram, {Q.log10('prob')} AS log10prob,
          CASE WHEN ord = 2 THEN 1.0 ELSE round(coalesce(bow, 1.0), 6) + 0.0 END AS bow FROM lm WHERE ord <= 2""",
        "table_modkn_model": f"{_kn(counts=f'{_TABLE_CLOSED}, c AS (SELECT *, {Q.KEYS} FROM t3)')} {MODEL}",
    }
