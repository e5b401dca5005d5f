"""Problem 1: frequency of every distinct term, and which terms are too rare or too common to keep.

Counts are first made per record (record, term), which also takes repeated deliveries once, then summed per term.  Both
aggregations combine partially by hash before their shuffle.  The first shuffle is keyed by record and term, so a term
that occurs in every record is spread over all tasks; after it a term has one partial row per task, so a hot term costs
the second shuffle no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_TOTAL = 5
MAX_SHARE = 0.4


def term_frequencies(
    rows: DataFrame,
    record: str | Column = "segment_id",
    term: str | Column = "word",
    count: str | Column | None = "cnt",
    where: Column | None = None,
) -> DataFrame:
    """One row (term, total, n_records) for each distinct term.

    A (record, term) pair that occurs in several rows counts once, with its largest count; a null count is 0, and without
    a count column every row is one occurrence (then repeated rows add up).  A null term is no term; rows of the null
    record add to total but are no record.
    """
    record, term = (F.col(x) if isinstance(x, str) else x for x in (record, term))
    if where is not None:
        rows = rows.where(where)
    if count is None:
        value, once = F.lit(1), F.sum("__count")
    else:
        value = F.coalesce((F.col(count) if isinstance(count, str) else count).cast("bigint"), F.lit(0))
        once = F.max("__count")
    per_record = (
        rows.select(record.alias("__record"), term.alias("term"), value.alias("__count"))
        .where(F.col("term").isNotNull())
        .groupBy("__record", "term")
        .agg(once.alias("__n"))
    )
    return per_record.groupBy("term").agg(F.sum("__n").alias("total"), F.count("__record").alias("n_records"))


def mark_terms(
    frequencies: DataFrame,
    n_records: Column,
    min_total: int = MIN_TOTAL,
    max_share: float = MAX_SHARE,
) -> DataFrame:
    """frequencies with column mark: `rare` below min_total, else `common` from max_share of all records on, else null."""
    share = F.col("n_records") >= F.lit(max_share) * n_records
    return frequencies.withColumn(
        "mark", F.when(F.col("total") < min_total, F.lit("rare")).when((n_records > 0) & share, F.lit("common"))
    )


def record_count(rows: DataFrame, record: str = "segment_id") -> Column:
    """Number of distinct non-null records as a scalar subquery."""
    return rows.select(record).distinct().agg(F.count(record)).scalar()
