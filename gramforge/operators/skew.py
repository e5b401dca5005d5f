"""Problem 6: per-key results although a few keys hold most rows.

Two-stage salted aggregation.  A key that holds more than `HEAVY_SHARE` of all rows gets a salt, its partial results are
made per (key, salt) and then merged per key.  The salt is a hash of the column that `spread` names: as good as a random
one for balance, but equal when a lost task is run again, and it puts equal values of that column under one salt, so that
even distinct counts merge by sums.  There are at most 1 / HEAVY_SHARE heavy keys, which bounds what is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAVY_SHARE = 0.005
SALTS = 48


def key_rows(rows: DataFrame, key: str) -> DataFrame:
    """(key, n_rows); combined within each task before the shuffle."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))


def heavy_keys(rows: DataFrame, key: str, share: float = HEAVY_SHARE) -> DataFrame:
    """The keys that hold more than `share` of all rows; at most 1 / share of them.  Null is no key."""
    total = rows.agg(F.count(F.lit(1))).scalar()
    counts = key_rows(rows.where(F.col(key).isNotNull()), key)
    return counts.where(F.col("n_rows") > F.lit(share) * total).select(key)


def with_salt(rows: DataFrame, key: str, spread: list[str], heavy: DataFrame, salts: int = SALTS) -> DataFrame:
    """rows with a column __salt: 0 for ordinary keys, a hash of `spread` within 0 to salts - 1 for the heavy ones."""
    heavy = heavy.select(F.col(key).alias("__heavy"))
    marked = rows.join(F.broadcast(heavy), F.col(key) == F.col("__heavy"), "left")  # at most 1 / share rows
    number = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    return marked.withColumn("__salt", F.when(F.col("__heavy").isNotNull(), number).otherwise(F.lit(0))).drop("__heavy")


_MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max, "count_distinct": F.sum}


def salted_aggregate(
    rows: DataFrame,
    key: str,
    aggregates: dict[str, tuple[str, str]],
    spread: str,
    heavy: DataFrame | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """One row for each non-null key with the named aggregates: name -> (count, sum, min, max or count_distinct, column).

    `spread` is the column whose hash is the salt; count_distinct is for this column only.  Every aggregate ignores nulls,
    as in SQL; an empty table gives no row.  heavy: the heavy keys, if they are known already.
    """
    for kind, column in aggregates.values():
        if kind not in _MERGE or (kind == "count_distinct" and column != spread):
            raise ValueError(f"{kind}({column}) can't be merged from salts of {spread}")
    rows = rows.where(F.col(key).isNotNull())
    rows = with_salt(rows, key, [spread], heavy_keys(rows, key) if heavy is None else heavy, salts)
    # equal values of `spread` first: what remains for a (key, salt) is one row per distinct value
    first, second, last = [], [], []
    for name, (kind, column) in aggregates.items():
        if kind == "count_distinct":
            second.append(F.count(F.col(spread)).alias(name))
        else:
            first.append(getattr(F, kind)(F.col(column)).alias(name))
            second.append(_MERGE[kind](name).alias(name))
        last.append(_MERGE[kind](name).alias(name))
    once = rows.groupBy(key, "__salt", spread)
    once = once.agg(*first) if first else once.agg(F.lit(1).alias("__one"))
    return once.groupBy(key, "__salt").agg(*second).groupBy(key).agg(*last)


def history_statistics(
    rows: DataFrame, key: str = "hist", follower: str = "word", record: str = "segment_id", count: str = "cnt"
) -> DataFrame:
    """(key, n_rows, n_followers, total): rows, distinct followers and total count of every non-null key.

    A (record, key, follower) that was delivered several times counts once in total, with its largest count, null being 0;
    n_rows counts every row.
    """
    once = (
        rows.where(F.col(key).isNotNull())
        .groupBy(key, follower, record)
        .agg(
            F.count(F.lit(1)).alias("__rows"),
            F.max(F.coalesce(F.col(count).cast("bigint"), F.lit(0))).alias("__count"),
        )
    )
    return salted_aggregate(
        once,
        key,
        {"n_rows": ("sum", "__rows"), "n_followers": ("count_distinct", follower), "total": ("sum", "__count")},
        follower,
        heavy_keys(rows, key),  # of the rows as delivered: counted before their shuffle
    )


def share_of(column: str, share: float, total: Column) -> Column:
    return F.col(column) > F.lit(share) * total


def skew_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    sizes: DataFrame | None,
    spread: list[str],
    how: str = "left",
    share: float = HEAVY_SHARE,
    salts: int = SALTS,
    total: Column | None = None,
    heavy: DataFrame | None = None,
) -> DataFrame:
    """left join right on keys (unique in right) although a few keys hold most rows of left.

    sizes: (keys, n_rows) of left, which the caller mostly has already; total: their sum, if known.  The rows of a key with more than `share` of all
    rows are spread over `salts` tasks by a hash of `spread`, and the right row of just these keys is repeated once for
    each salt.  At most 1 / share keys are heavy, which bounds the broadcast of their list.  heavy: these keys, where they
    are known already; sizes may then be null.
    """
    if heavy is None:
        total = sizes.agg(F.sum("n_rows")).scalar() if total is None else total
        heavy = sizes.where(F.col("n_rows") > F.lit(share) * total)
    heavy = F.broadcast(heavy.select(*keys, F.lit(True).alias("__heavy")))
    number = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    a = left.join(heavy, keys, "left").withColumn("__salt", F.when(F.col("__heavy"), number).otherwise(F.lit(0)))
    copies = F.when(F.col("__heavy"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    b = right.join(heavy, keys, "left").withColumn("__salt", F.explode(copies))
    return a.drop("__heavy").join(b.drop("__heavy"), [*keys, "__salt"], how).drop("__salt")


#: Most bytes of a table that is broadcast after it was measured.
MAX_BROADCAST = 32 << 20


def small(rows: DataFrame, key: str) -> bool:
    """Whether the strings of a (checkpointed) key table can be broadcast: their bytes are counted."""
    size = rows.agg(F.coalesce(F.sum(F.octet_length(key) + F.lit(32)), F.lit(0))).first()[0]
    return size <= MAX_BROADCAST


def mark(rows: DataFrame, members: DataFrame, key: str, name: str, spread: list[str]) -> DataFrame:
    """rows with a boolean column `name`: whether key is among members (checkpointed, each key once).

    Members of at most `MAX_BROADCAST` bytes are broadcast, so rows are not shuffled; beyond that the join is salted."""
    flagged = members.select(key, F.lit(True).alias(name))
    if small(members, key):
        out = rows.join(F.broadcast(flagged), key, "left")
    else:
        out = skew_join(rows, flagged, [key], key_rows(rows, key), spread)
    return out.withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def heavy_sides(rows: DataFrame, group: str, keys: list[str], share: float = HEAVY_SHARE) -> DataFrame:
    """(group, side, key): of each group's rows the values of each of `keys` (side names it) that hold more than `share`; at
    most 1 / share for each group and side.  One aggregation, combined before its shuffle."""
    sides = F.explode(F.array(*[F.struct(F.lit(k).alias("side"), F.col(k).alias("key")) for k in keys])).alias("__s")
    n = rows.select(group, sides).groupBy(group, "__s.side", "__s.key").agg(F.count(F.lit(1)).alias("n_rows"))
    totals = n.where(F.col("side") == keys[0]).groupBy(group).agg(F.sum("n_rows").alias("__total"))
    return n.join(F.broadcast(totals), group).where(F.col("n_rows") > F.lit(share) * F.col("__total")).select(group, "side", "key")


def of_side(heavy: DataFrame, order: int, side: str) -> DataFrame:
    """The heavy keys of one order and side."""
    return heavy.where((F.col("ord") == order) & (F.col("side") == side)).select(F.col("key").alias(side))
