"""Incremental n-gram counts: a stream of texts kept as a count table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import counts as C
from ..operators import text as T


def stream_counts(docs: DataFrame, order: int, text: str = "text") -> DataFrame:
    """Running (ord, ngram, cnt) of a stream of documents, for output modes update and complete.

    The state holds one row per distinct n-gram, partitioned by n-gram."""
    return C.count_ngrams(T.token_rows(docs, [], text), order)


def merge_counts(docs: DataFrame, order: int, folder: str, checkpoint: str, text: str = "text") -> StreamingQuery:
    """Keeps the counts of each micro-batch as a table in folder, named by batch: a batch that runs again replaces its own
    table, so every document counts once.  `total_counts` adds the tables up."""

    def write(batch: DataFrame, number: int) -> None:
        c = C.count_ngrams(T.token_rows(batch, [], text), order)
        c.write.mode("overwrite").parquet(os.path.join(folder, f"batch={number}"))

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def total_counts(tables: DataFrame) -> DataFrame:
    return tables.groupBy("ord", "ngram").agg(F.sum("cnt").alias("cnt"))
