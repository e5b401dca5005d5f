"""Registered queries of the training-data problems, and SQL for those that SQL can express."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import abuse, confusable, encode, leaks, lossy, packing, terms
from .lookalikes import TO_LATIN, plain


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- 1: frequencies ----------------------------------------------------------------------------------------------------


def p1_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total, number of segments and mark of every word."""
    rows = _table(spark, sf_dir, "ngram_counts")
    freq = terms.term_frequencies(rows, "segment_id", "word", "cnt", F.col("ord") == 1)
    return terms.mark_terms(freq, terms.record_count(rows)).select(
        F.col("term").alias("word"), "total", F.col("n_records").alias("n_segments"), "mark"
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_terms(spark, sf_dir).where(F.col("mark").isNotNull()).select("word", "mark")


P1_TERMS = """
WITH one AS (
  SELECT segment_id, word, max(coalesce(cnt, 0)) AS cnt FROM ngram_counts
  WHERE ord = 1 AND word IS NOT NULL GROUP BY segment_id, word
), freq AS (
  SELECT word, CAST(sum(cnt) AS BIGINT) AS total, CAST(count(segment_id) AS BIGINT) AS n_segments FROM one GROUP BY word
)
SELECT word, total, n_segments,
  CASE WHEN total < 5 THEN 'rare'
       WHEN n_segments >= 0.4 * (SELECT count(DISTINCT segment_id) FROM ngram_counts) THEN 'common' END AS mark
FROM freq
"""

# -- 2: leaks ----------------------------------------------------------------------------------------------------------


def p2_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked items of every message with purpose, longest passage and the number of words in passages."""
    items = _table(spark, sf_dir, "eval_items")
    found = leaks.find_leaks(_table(spark, sf_dir, "documents"), items)
    return found.join(items.select("item_id", "purpose"), "item_id").select("doc_id", "item_id", "purpose", "n_words", "covered")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"))
    return found.select("doc_id", "item_id")


def p2_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every message without leaked passages."""
    return leaks.remove_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"))


# -- 4: most frequent --------------------------------------------------------------------------------------------------


def p4_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 40 most frequent n-grams with their guaranteed interval and exact total."""
    rows = _table(spark, sf_dir, "ngram_counts").select("segment_id", "ngram", "cnt")
    once = lossy.deliveries_once(rows, ["segment_id", "ngram"], "cnt")
    return lossy.top_items(once, "ngram", "cnt", 40).withColumnRenamed("item", "ngram")


def p4_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 40 most frequent n-grams with their total, and whether the guaranteed interval holds it."""
    within = F.col("total").between(F.col("at_least"), F.col("at_most"))
    return p4_intervals(spark, sf_dir).select("ngram", "total", within.alias("within"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_intervals(spark, sf_dir).select("ngram")


P4_TOP = """
WITH one AS (
  SELECT segment_id, ngram, max(coalesce(cnt, 0)) AS cnt FROM ngram_counts WHERE ngram IS NOT NULL GROUP BY segment_id, ngram
)
SELECT ngram, CAST(sum(cnt) AS BIGINT) AS total, true AS within FROM one GROUP BY ngram ORDER BY total DESC, ngram LIMIT 40
"""

# -- 5: look-alikes ----------------------------------------------------------------------------------------------------


def p5_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one form of every vocabulary entry."""
    return confusable.canonical(_table(spark, sf_dir, "vocab")).select("word_id", "form", "repaired")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusable.lookalike_pairs(_table(spark, sf_dir, "vocab"))


def _look() -> str:
    """SQL of a word's look: one width, blank, hyphen and composition, invisible characters gone, look-alikes as Latin."""
    every = map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x20000)])
    changed = {c: plain(c) for c in every if plain(c) != unicodedata.normalize("NFC", c)}
    gone = "".join(c for c, x in changed.items() if not x)
    single = {c: x for c, x in changed.items() if len(x) == 1 and x != "'"}
    sql = f"translate(word, '{''.join(single)}{gone}', '{''.join(single.values())}')"
    for c, x in changed.items():
        if len(x) > 1:
            sql = f"replace({sql}, '{c}', '{x}')"
    alike = {chr(k): v for k, v in TO_LATIN.items()}
    for code in range(0xC0, 0x2000):  # accented letters of other scripts
        base, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and base in alike and len(x := unicodedata.normalize("NFC", alike[base] + "".join(marks))) == 1:
            alike[chr(code)] = x
    return f"nfc_normalize(translate(nfc_normalize(rtrim({sql}, ' ')), '{''.join(alike)}', '{''.join(alike.values())}'))"


P5_FOUND = """
WITH looks AS MATERIALIZED (SELECT word_id, word, {look} AS look FROM vocab WHERE word IS NOT NULL)
SELECT a.word_id AS word_id_a, b.word_id AS word_id_b FROM looks a JOIN looks b ON a.look = b.look AND a.word_id < b.word_id AND a.word <> b.word
"""

# -- 7: tokens ---------------------------------------------------------------------------------------------------------


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode_documents(_table(spark, sf_dir, "documents"))


# -- 8: packing --------------------------------------------------------------------------------------------------------


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every message or piece of a message."""
    return packing.pack(encode.count_tokens(_table(spark, sf_dir, "documents")))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.containers(p8_pack(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages that the packing lays into more than one container."""
    used = p8_pack(spark, sf_dir).groupBy("doc_id").agg(F.min("container").alias("a"), F.max("container").alias("b"))
    return used.where("a <> b").select("doc_id")


# -- 9: abuse ----------------------------------------------------------------------------------------------------------


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every message."""
    return abuse.score_documents(_table(spark, sf_dir, "documents"), keep=("source",))


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate of flagged messages per source."""
    return abuse.rates(p9_scores(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.score_documents(_table(spark, sf_dir, "documents")).where("flagged").select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (p1_terms, p1_found, p2_leaks, p2_found, p2_clean, p4_top, p4_intervals, p4_found, p5_forms, p5_found, p7_ids, p8_pack)
    return {f.__name__: f for f in (*made, p8_containers, p8_found, p9_scores, p9_rates, p9_found)}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_terms": P1_TERMS,
        "p1_found": f"SELECT word, mark FROM ({P1_TERMS}) WHERE mark IS NOT NULL",
        "p5_found": P5_FOUND.format(look=_look()),
        "p4_top": P4_TOP,
        "p4_found": f"SELECT ngram FROM ({P4_TOP})",
    }
