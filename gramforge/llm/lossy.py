"""Problem 4: the most frequent items among billions, in memory that does not grow with the distinct items.

Lossy counting with weights.  Each task keeps a summary of (item, count, delta): the stream is cut into buckets of
1 / epsilon weight, an item that enters in bucket b gets delta = b - 1, and whenever a bucket has ended, items with
count + delta <= b are dropped.  So a true count lies in [count, count + delta], an item that is missing has at most b,
and the summary stays within O(1 / epsilon * log(epsilon * weight)) entries; beside it wait the rows of one bucket, at most
`CHUNK` rows.  Summaries of tasks merge by sums: counts and deltas add, and a task that lacks the item adds its whole b to
the upper end.

`top_items` takes the items whose upper end reaches the k-th largest lower end and counts just these exactly.  If the k-th
lower end does not exceed what a missing item may have, epsilon is too coarse for these data and the pass is made again with
one at which a missing item may have a quarter of that lower end.  Where this takes an epsilon below `MIN_EPSILON`, whose
summaries would be too large for a task, the items are cut into slices by their hash and each slice has a pass of its own
over its part of the weight: more passes instead of more memory.  Beyond `MAX_SLICES` the data have no k items that stand
out; then the k largest guaranteed intervals are given, and totals stay null.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint

EPSILON = 1e-5
CHUNK = 1 << 18
MIN_EPSILON = 1e-6
MAX_SLICES = 256
MAX_BROADCAST = 32 << 20


def _group(table: pa.Table) -> pa.Table:
    out = table.group_by("item", use_threads=False).aggregate([("count", "sum"), ("delta", "min")])
    return out.rename_columns({"count_sum": "count", "delta_min": "delta"}).select(["item", "count", "delta"])


class LossyCounter:
    """Summary of one stream."""

    def __init__(self, epsilon: float) -> None:
        self.width = max(1, int(1 / epsilon))
        self.weight = 0
        self.entries: pa.Table | None = None
        self.waiting: list[pa.Table] = []
        self.waiting_rows = self.waiting_weight = 0
        self.pruned = 0
        self.lost = 0

    @property
    def bucket(self) -> int:
        """Buckets that have ended."""
        return self.weight // self.width

    @property
    def missing(self) -> int:
        """The most that a missing item may have."""
        return max(self.bucket, self.lost)

    def add(self, items: pa.Array, counts: pa.Array) -> None:
        self.waiting.append(pa.table({"item": items, "count": counts}))
        self.waiting_rows += len(items)
        self.waiting_weight += pc.sum(counts).as_py() or 0
        if self.weight % self.width + self.waiting_weight >= self.width or self.waiting_rows >= CHUNK:
            self.close_bucket()

    def close_bucket(self) -> None:
        """Takes what waits into the summary; where a bucket has ended, drops what has become too small."""
        if not self.waiting:
            return
        table = pa.concat_tables(self.waiting)
        before = self.bucket
        table = table.append_column("delta", pa.repeat(pa.scalar(before, pa.int64()), len(table)))
        self.weight += self.waiting_weight
        self.waiting, self.waiting_rows, self.waiting_weight = [], 0, 0
        if self.entries is not None:
            table = pa.concat_tables([self.entries, table])
        table = _group(table)
        if self.bucket > before:
            table = table.filter(pc.greater(pc.add(table["count"], table["delta"]), self.bucket))
            self.pruned += 1
        elif len(table) > self.width and not self.bucket:
            # items without weight end no bucket
            rest = table.filter(pc.greater(table["count"], 0))
            self.lost = 1 if len(rest) < len(table) else self.lost
            table = rest
        self.entries = table


def summaries(rows: DataFrame, item: str, count: str, epsilon: float = EPSILON, slices: int = 1) -> DataFrame:
    """The summary of each task: (item, count, delta, missing), and a row with null item, the weight in count and what a
    missing item may have in missing.  Rows with null items are not counted.  With slices, a task has one summary after the
    other, each from its own pass over the rows."""
    picked = rows.where(F.col(item).isNotNull()).select(
        F.col(item).alias("item"), F.coalesce(F.col(count).cast("bigint"), F.lit(0)).alias("count")
    )
    names = ["item", "count", "delta", "missing"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = LossyCounter(epsilon)
        kind = pa.string()
        for batch in batches:
            kind = batch.schema.field(0).type
            counter.add(batch.column(0), batch.column(1))
        counter.close_bucket()
        if counter.entries is None:
            return
        b = counter.missing
        for part in counter.entries.to_batches(max_chunksize=65_536):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.repeat(pa.scalar(b, pa.int64()), len(part))], names)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(1, kind), *[pa.array([x], pa.int64()) for x in (counter.weight, 0, b)]], names
        )

    schema = f"item {picked.schema['item'].dataType.simpleString()}, count bigint, delta bigint, missing bigint"
    if slices == 1:
        return picked.mapInArrow(run, schema).withColumn("slice", F.lit(0))
    number = F.pmod(F.xxhash64("item"), F.lit(slices)).cast("int")
    parts = [picked.where(number == i).mapInArrow(run, schema).withColumn("slice", F.lit(i)) for i in range(slices)]
    return reduce(DataFrame.unionByName, parts)


def merge(parts: DataFrame) -> DataFrame:
    """(slice, item, at_least, present_delta, present_missing) of all tasks' summaries."""
    return (
        parts.where(F.col("item").isNotNull())
        .groupBy("slice", "item")
        .agg(
            F.sum("count").alias("at_least"),
            F.sum("delta").alias("present_delta"),
            F.sum("missing").alias("present_missing"),
        )
    )


def intervals(
    rows: DataFrame, item: str, count: str, k: int, epsilon: float = EPSILON, slices: int = 1
) -> tuple[DataFrame, int, int]:
    """(item, at_least, at_most) of every item that may be among the k most frequent, the k-th largest at_least, and
    what an item without a row may have at most.  Where fewer than k items are left of more, the k-th at_least is 0."""
    parts = checkpoint(summaries(rows, item, count, epsilon, slices))
    absent = parts.where(F.col("item").isNull()).groupBy("slice").agg(F.sum("missing").alias("absent"))  # a row per slice
    missing = absent.agg(F.coalesce(F.max("absent"), F.lit(0))).first()[0]
    merged = merge(parts).join(F.broadcast(absent), "slice").select(
        "item",
        "at_least",
        (F.col("at_least") + F.col("present_delta") + F.col("absent") - F.col("present_missing")).alias("at_most"),
    )
    best = merged.orderBy(F.col("at_least").desc()).limit(k)
    n, kth = best.agg(F.count(F.lit(1)), F.coalesce(F.min("at_least"), F.lit(0))).first()
    if n < k and missing:  # the lower ranks were dropped everywhere
        kth = 0
    return merged.where(F.col("at_most") >= kth), kth, missing


def top_items(
    rows: DataFrame, item: str, count: str, k: int, epsilon: float = EPSILON
) -> DataFrame:
    """The k items with the largest total count, with (item, at_least, at_most, total); ties go to the smaller item.

    total is exact, counted for the candidates only.  Null counts are 0, null items are no items, an empty table gives no
    row, fewer than k items give all.  Where no k items stand out (see above) total is null and the rows are those with the
    largest at_least.
    """
    slices = 1
    candidates, kth, missing = intervals(rows, item, count, k, epsilon)
    while kth <= missing and missing and slices < MAX_SLICES:
        # an item of at least kth then keeps 3/4 of it; where too few items were kept, kth is unknown
        finer = kth / (4 * missing) if kth else 0.01
        if slices == 1 and epsilon * finer >= MIN_EPSILON:
            epsilon *= finer
        else:
            finer *= epsilon / MIN_EPSILON
            slices, epsilon = min(MAX_SLICES, max(2 * slices, int(slices / finer) + 1)), MIN_EPSILON
        candidates, kth, missing = intervals(rows, item, count, k, epsilon, slices)
    candidates = checkpoint(candidates)
    if kth <= missing and missing:
        best = candidates.withColumn("total", F.lit(None).cast("bigint"))
        return best.orderBy(F.col("at_least").desc(), "item").limit(k)
    value = F.sum(F.coalesce(F.col(count).cast("bigint"), F.lit(0))).alias("total")
    exact = rows.where(F.col(item).isNotNull()).select(F.col(item).alias("item"), F.col(count))
    weight = candidates.agg(F.coalesce(F.sum(F.octet_length(F.col("item").cast("string")) + F.lit(32)), F.lit(0))).first()[0]
    few = weight <= MAX_BROADCAST
    exact = exact.join(F.broadcast(candidates.select("item")) if few else candidates.select("item"), "item", "left_semi")
    exact = exact.groupBy("item").agg(value).join(F.broadcast(candidates) if few else candidates, "item")
    return exact.select("item", "at_least", "at_most", "total").orderBy(F.col("total").desc(), "item").limit(k)


def deliveries_once(rows: DataFrame, keys: list[str], count: str) -> DataFrame:
    """One row for each key, with its largest count (0 for null): repeated deliveries count once.

    The key is the whole row identity, so the shuffle has no hot key; the aggregation combines before it."""
    return rows.groupBy(*keys).agg(F.max(F.coalesce(F.col(count).cast("bigint"), F.lit(0))).alias(count))
