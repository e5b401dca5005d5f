"""Problem 8: pack items of varying length into containers of fixed capacity.

Only the histogram of lengths (at most `capacity` rows, whatever the number of items) comes to the driver.  There:

1. Items longer than `SMALL` of the capacity are put into about `CLASSES` length classes of equal numbers of items, so
   that a length that many items share is a class of its own; a class counts as its longest item.  The configuration
   linear program over these classes is solved by multiplicative weights: each step prices classes by their weight over
   their demand, finds the best configuration by an unbounded-knapsack dynamic program over the capacity in tokens and
   lowers the weights of what it covers.
2. The fractional solution is made a basic one, with at most one configuration for each class and the same coverage, so that
   rounding it down loses less than one container for each class; each configuration's copies take real items of its
   classes, longest first.
3. The remaining items, short ones included, go best-fit decreasing into the exact space left, then into new containers.

All of it works on runs (length, range of ranks -> range of containers), never on single items.  Back on the executors
each item gets its rank among the items of its length from two counts (its salt's offset and its place within the salt) and
finds its run by binary search.  A length has one salt for each `SALT_ROWS` of its items, known from the histogram, so that no
group of a window grows with the data even if a third of all rows share one length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint

CAPACITY = 5_000
CLASSES = 80
SMALL = 0.1
ROOMS = (0.5, 0.9)
SALT_ROWS = 100_000
ROUNDS = 6
ETA = 0.25
PIVOTS = 20


@dataclass
class Plan:
    """Runs of items: those of `size` with rank in [start, stop) go to container first + (rank - start) // per."""

    capacity: int
    size: list[int] = field(default_factory=list)
    start: list[int] = field(default_factory=list)
    stop: list[int] = field(default_factory=list)
    first: list[int] = field(default_factory=list)
    per: list[int] = field(default_factory=list)
    n_containers: int = 0
    n_configured: int = 0  # of them from the configuration program

    def add(self, size: int, start: int, n: int, first: int, per: int) -> None:
        for column, value in zip((self.size, self.start, self.stop, self.first, self.per), (size, start, start + n, first, per), strict=True):
            column.append(value)


class Knapsack:
    """Unbounded knapsack over fixed sizes by dynamic programming, one vector operation per size.

    Taking k items of one size moves the value by k sizes and k values: within a residue class of the size, that is a
    running maximum of value minus quotient times the item's value."""

    def __init__(self, sizes: np.ndarray, capacity: int) -> None:
        self.sizes, self.capacity = [int(s) for s in sizes], capacity
        self.quotient = [(np.arange(-(-(capacity + 1) // s) * s) // s).astype(float) for s in self.sizes]

    def best(self, values: np.ndarray) -> np.ndarray:
        """Copies of each size of the most valuable configuration."""
        n = self.capacity + 1
        steps = [np.zeros(n)]
        for s, q, v in zip(self.sizes, self.quotient, values.tolist(), strict=True):
            gain = q * v
            f = np.full(len(q), -np.inf)
            np.subtract(steps[-1], gain[:n], out=f[:n])
            rows = f.reshape(-1, s)
            for i in range(1, len(rows)):
                np.maximum(rows[i], rows[i - 1], out=rows[i])
            f += gain
            steps.append(f[:n])
        out = np.zeros(len(self.sizes), np.int64)
        room = int(steps[-1].argmax())
        for j in range(len(self.sizes) - 1, -1, -1):
            s, v, before = self.sizes[j], float(values[j]), steps[j]
            most = room // s
            if most:
                k = np.arange(most + 1)
                k = int((before[room - k * s] + k * v).argmax())
                out[j] = k
                room -= k * s
        return out


def length_classes(sizes: list[int], counts: dict[int, int], number: int) -> list[list[int]]:
    """Sizes, longest first, in about `number` runs with equal numbers of items; none is split."""
    total = sum(counts[s] for s in sizes)
    out: list[list[int]] = []
    held = 0
    for s in sorted(sizes, reverse=True):
        if not out or held + counts[s] > total / number:
            out.append([])
            held = 0
        out[-1].append(s)
        held += counts[s]
    return out


def fractional_configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> dict[tuple[int, ...], float]:
    """Configurations (copies of each class) with fractional multiplicities that cover the demand nearly evenly."""
    weight, cover = np.ones(len(sizes)), np.zeros(len(sizes))
    knapsack = Knapsack(sizes, capacity)
    used: dict[tuple[int, ...], float] = {}
    while cover.min() < ROUNDS:
        config = knapsack.best(weight / demand)
        inside = config > 0
        step = float((demand[inside] / config[inside]).min())
        cover += step * config / demand
        weight = np.exp(-ETA * (cover - cover.min()))
        key = tuple(config.tolist())
        used[key] = used.get(key, 0.0) + step
    return {k: x / float(np.median(cover)) for k, x in used.items()}


def basic_solution(solution: dict[tuple[int, ...], float], demand: np.ndarray) -> dict[tuple[int, ...], float]:
    """A solution from the same configurations that covers just the demand with at most as many configurations as classes.

    The given solution is scaled down until no class has too much; what then lacks is covered by single items.  Each
    configuration in turn is written as a combination of those kept so far (at first the single items) and its multiplicity
    is moved to them as far as all stay positive; where one falls to 0 before, the configuration takes its place.  At last
    configurations that are cheaper than the combination they stand for come back in, as in the simplex method."""
    n = len(demand)
    columns = np.array(list(solution), float).reshape(-1, n)
    amounts = np.array(list(solution.values()))
    cover = amounts @ columns
    amounts = amounts * float((demand / np.maximum(cover, 1e-12)).min(initial=1.0, where=cover > 0))
    kept = np.eye(n)
    value, inverse = np.maximum(demand - amounts @ columns, 0.0), np.eye(n)

    def enter(column: np.ndarray, x: float) -> None:
        nonlocal value, inverse
        way = inverse @ column  # the configuration in terms of those kept
        sign = 1.0 if way.sum() > 1 + 1e-9 else -1.0  # more of it, where it is cheaper than what it stands for, else less
        limits = np.divide(value, sign * way, out=np.full(n, np.inf), where=sign * way > 1e-9)
        out = int(limits.argmin())
        step = float(limits[out])
        if sign < 0 and step >= x:
            value = value + way * x
            return
        value = np.maximum(value - sign * step * way, 0.0)
        value[out] = x + sign * step
        kept[out] = column
        row = inverse[out] / way[out]
        inverse = inverse - np.outer(way, row)
        inverse[out] = row

    for i in np.argsort(-amounts, kind="stable"):
        enter(columns[i], float(amounts[i]))
    for _ in range(PIVOTS * n if len(columns) else 0):
        gain = columns @ inverse.sum(axis=0)
        best = int(gain.argmax())
        if gain[best] <= 1 + 1e-7:
            break
        enter(columns[best], 0.0)
    return {tuple(c): float(v) for c, v in zip(kept.astype(int).tolist(), value, strict=True) if v > 1e-9}


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """histogram: number of items of each size, 1 to capacity.

    The program is solved for each of `ROOMS`: that part of what short items take on average in a container is left free for
    them, so that they fill each container to the brim.  The plan with fewer containers is taken."""
    mass = sum(s * n for s, n in histogram.items())
    short = sum(s * n for s, n in histogram.items() if s <= capacity * SMALL)
    rooms = {capacity - int(part * capacity * short / mass) if mass else capacity for part in ROOMS}
    plans = [_plan(histogram, capacity, r) for r in sorted(rooms, reverse=True)]
    return min(plans, key=lambda p: (p.n_containers, -p.n_configured))


def _plan(histogram: dict[int, int], capacity: int, room_of_large: int) -> Plan:
    plan = Plan(capacity)
    sizes = sorted(s for s, n in histogram.items() if n > 0)
    if sizes and not 0 < sizes[0] <= sizes[-1] <= capacity:
        raise ValueError("sizes must be 1 to capacity")
    left = {s: histogram[s] for s in sizes}
    taken = dict.fromkeys(sizes, 0)
    space: dict[int, list[tuple[int, int]]] = {}  # room left -> runs (first container, containers)
    rooms: list[int] = []

    def free(room: int, first: int, n: int) -> None:
        if room <= 0 or n <= 0:
            return
        if room not in space:
            space[room] = []
            insort(rooms, room)
        space[room].append((first, n))

    def take(size: int, n: int, first: int, per: int) -> None:
        plan.add(size, taken[size], n, first, per)
        taken[size] += n
        left[size] -= n

    large = [s for s in sizes if capacity * SMALL < s <= room_of_large]
    if large:
        groups = length_classes(large, left, CLASSES)
        demand = np.array([sum(left[s] for s in g) for g in groups], float)
        solution = fractional_configurations(np.array([g[0] for g in groups]), demand, room_of_large)
        solution = basic_solution(solution, demand)
        for config, x in sorted(solution.items(), key=lambda c: (-c[1], c[0])):
            enough = [sum(left[s] for s in g) // n for g, n in zip(groups, config, strict=True) if n]
            copies = min(int(x + 1e-6), *enough)
            if not copies:
                continue
            # each slot of the configuration takes `copies` items, longest first: pieces of containers with equal content
            marks, pieces = {0, copies}, []
            for group, count in zip(groups, config, strict=True):
                for _ in range(count):
                    at = 0
                    for s in group:
                        n = min(left[s], copies - at)
                        if n > 0:
                            take(s, n, plan.n_containers + at, 1)
                            pieces.append((at, at + n, s))
                            at += n
                            marks.add(at)
            edges = sorted(marks)
            load = np.zeros(len(edges), np.int64)
            for a, b, s in pieces:
                load[bisect_left(edges, a)] += s
                load[bisect_left(edges, b)] -= s
            load = np.cumsum(load)
            for i in range(len(edges) - 1):
                free(capacity - int(load[i]), plan.n_containers + edges[i], edges[i + 1] - edges[i])
            plan.n_containers += copies
    plan.n_configured = plan.n_containers
    for s in reversed(sizes):
        while left[s]:
            i = bisect_left(rooms, s)
            if i == len(rooms):
                per = capacity // s
                n = -(-left[s] // per)
                free(capacity, plan.n_containers, n)
                plan.n_containers += n
                continue
            room = rooms[i]
            first, n = space[room].pop()
            if not space[room]:
                del space[room]
                rooms.pop(i)
            per = room // s
            whole = min(n, left[s] // per)
            if whole:
                take(s, whole * per, first, per)
                free(room - per * s, first, whole)
            if whole < n:
                rest = left[s]
                if rest and rest < per:
                    take(s, rest, first + whole, rest)
                    free(room - rest * s, first + whole, 1)
                    whole += 1
                free(room, first + whole, n - whole)
    return plan



def pack(
    sizes: DataFrame,
    id_column: str = "doc_id",
    size_column: str = "n_tokens",
    capacity: int = CAPACITY,
) -> DataFrame:
    """One row for each piece: id, piece (from 0), n_pieces, n_tokens of the piece, container.

    An item longer than the capacity is cut into pieces of the capacity and a rest; no other item is split.  Items of size
    0 or null need no space and get a null container and 0 tokens.  Repeated rows are items of their own.
    """
    spark = sizes.sparkSession
    size = F.coalesce(F.col(size_column).cast("bigint"), F.lit(0))
    items = sizes.select(F.col(id_column), size.alias("__size"))
    items = checkpoint(items)
    n_pieces = F.greatest(F.lit(1), F.ceil(F.col("__size") / F.lit(float(capacity)))).cast("int")
    pieces = items.withColumn("n_pieces", n_pieces)
    pieces = pieces.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)))
    rest = F.col("__size") - F.col("piece").cast("bigint") * capacity
    pieces = pieces.select(id_column, "piece", "n_pieces", F.least(F.lit(capacity).cast("bigint"), rest).alias("n_tokens"))
    nothing = pieces.where("n_tokens <= 0").withColumn("container", F.lit(None).cast("bigint"))
    pieces = pieces.where("n_tokens > 0")
    counts = pieces.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("__n"))
    histogram = {r[0]: r[1] for r in counts.collect()}  # at most `capacity` rows
    many = {n: -(-count // SALT_ROWS) for n, count in histogram.items() if count > SALT_ROWS}
    salts = spark.createDataFrame(list(many.items()), "n_tokens bigint, __salts bigint")
    number = F.pmod(F.xxhash64(id_column, "piece"), F.coalesce("__salts", F.lit(1))).cast("int")
    pieces = pieces.join(F.broadcast(salts), "n_tokens", "left").select(  # at most `capacity` rows
        id_column, "piece", "n_pieces", "n_tokens", number.alias("__salt")
    )
    per_salt = pieces.groupBy("n_tokens", "__salt").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("n_tokens").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_salt.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    plan = plan_packing(histogram, capacity)
    key = np.array(plan.size, np.int64) << 42 | np.array(plan.start, np.int64)
    order = np.argsort(key)
    shared = spark.sparkContext.broadcast(
        tuple(np.array(x, np.int64)[order] for x in (key, plan.start, plan.first, plan.per))
    )
    within = Window.partitionBy("n_tokens", "__salt").orderBy(id_column, "piece")
    ranked = (
        pieces.withColumn("__place", F.row_number().over(within).cast("bigint") - 1)
        .join(offsets.select("n_tokens", "__salt", "__before"), ["n_tokens", "__salt"], "left")
        .select(id_column, "piece", "n_pieces", "n_tokens", (F.col("__place") + F.col("__before")).alias("__rank"))
    )
    kind = items.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, start, first, per = shared.value
        for batch in batches:
            tokens = batch.column(3).to_numpy(zero_copy_only=False)
            rank = batch.column(4).to_numpy(zero_copy_only=False)
            i = np.searchsorted(keys, tokens << 42 | rank, "right") - 1
            container = first[i] + (rank - start[i]) // per[i]
            column = pa.array(container, pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], column], [*batch.schema.names[:4], "container"])

    schema = f"`{id_column}` {kind}, piece int, n_pieces int, n_tokens bigint, container bigint"
    return ranked.mapInArrow(run, schema).unionByName(nothing)


def containers(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Items, tokens and unused space of each container."""
    return (
        packed.where(F.col("container").isNotNull())
        .groupBy("container")
        .agg(F.count(F.lit(1)).alias("n_items"), F.sum("n_tokens").alias("n_tokens"))
        .withColumn("unused", F.lit(capacity) - F.col("n_tokens"))
    )
