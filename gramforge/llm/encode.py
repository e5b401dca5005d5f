"""Problem 7: token ids of every document by a public tokenizer.

Every document is encoded where its row is, in Arrow batches, without a shuffle.  A batch of long texts is worked off in
slices of at most `SLICE` characters, so that memory follows the longest single text, not the batch.  The driver reads the
vocabulary file and sends it with its digest; no other machine needs it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .bpe import TOKENIZER_DIR, encoder_of, vocabulary

SLICE = 4_000_000


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have at most `most` bytes together, or a single longer text."""
    if not len(texts):
        return
    ends = np.cumsum(np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False)))
    start = 0
    while start < len(texts):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
        yield start, stop
        start = stop


def encode_documents(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    tokenizer: str = "byte_bpe_50k",
    directory: str = TOKENIZER_DIR,
) -> DataFrame:
    """One row (id, ids array<int>) for each row of docs, without special tokens.

    Null and empty texts get an empty list.  The strings of special tokens in a text are ordinary text.  Repeated rows and
    null ids are rows like any other; other columns of docs are not read.
    """
    picked = spread(docs.select(F.col(id_column), F.col(text_column).alias("__text")))
    kind = picked.schema[0].dataType.simpleString()

    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(tokenizer, directory))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder_of(*shared.value)
        for batch in batches:
            texts = batch.column(1)
            for a, b in slices(texts):
                ids, offsets = bpe.encode(texts.slice(a, b - a).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], [id_column, "ids"])

    return picked.mapInArrow(run, f"`{id_column}` {kind}, ids array<int>")


def count_tokens(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    tokenizer: str = "byte_bpe_50k",
    directory: str = TOKENIZER_DIR,
) -> DataFrame:
    """One row (id, n_tokens) for each row of docs; 0 for null and empty texts."""
    picked = spread(docs.select(F.col(id_column), F.col(text_column).alias("__text")))
    kind = picked.schema[0].dataType.simpleString()

    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(tokenizer, directory))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder_of(*shared.value)
        for batch in batches:
            texts = batch.column(1)
            for a, b in slices(texts):
                n = bpe.count(texts.slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64())], [id_column, "n_tokens"])

    return picked.mapInArrow(run, f"`{id_column}` {kind}, n_tokens bigint")
