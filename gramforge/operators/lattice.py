"""Word lattices: directed acyclic graphs of weighted arcs, one per utterance.

A lattice is the unit of work: the model's probabilities are joined to all arcs of all lattices at once (by distinct
n-gram), and what walks a lattice runs per lattice in grouped pandas functions.  Arc tables are (tag, arc, src, dst, word,
base_w), sorted within a lattice by (src, dst); src < dst; node 0 begins, the largest node ends.  Weights are costs.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluate import longest_match
from .text import BOUNDARY

ARCS = "tag string, arc int, src int, dst int, word string, base_w double"
# The first two lines of a lattice file, and the number of arcs from which confidence is 0.
HEADER, INITIAL = "#FSTBasic MinPlus", "I 0"
MAX_NETWORK_ARCS = 1_000_000


# -- text form ---------------------------------------------------------------------------------------------------------


def parse_fst(text: str) -> list[tuple[int, int, str, float]]:
    """Sorted arcs (src, dst, word, weight) of a lattice file; final states get an arc to the one final node."""
    lines = [x.rstrip("\r") for x in text.split("\n")]
    while lines and not lines[-1]:
        lines.pop()
    if not lines or lines[0] != HEADER:
        raise ValueError("invalid lattice header")
    if len(lines) < 2 or lines[1] != INITIAL:
        raise ValueError("invalid initial state")
    arcs: list[tuple[int, int, str, float]] = []
    finals: list[tuple[int, float]] = []
    for line in lines[2:]:
        kind, *rest = line.split()
        if kind == "T" and len(rest) in (4, 5):
            src, dst = int(rest[0]), int(rest[1])
            if src >= dst:
                raise ValueError("lattice isn't topologically sorted")
            arcs.append((src, dst, rest[3], float(rest[4]) if len(rest) == 5 else 0.0))
        elif kind == "F" and len(rest) in (1, 2):
            finals.append((int(rest[0]), float(rest[1]) if len(rest) == 2 else 0.0))
        elif kind != "P":
            raise ValueError(f"invalid lattice line {line!r}")
    last = max([*(a[0] for a in arcs), *(a[1] for a in arcs), *(s for s, _ in finals)], default=-1) + 1
    arcs += [(s, last, BOUNDARY, w) for s, w in finals]
    return sorted(arcs, key=lambda a: (a[0], a[1]))


def format_fst(arcs: pd.DataFrame) -> str:
    """The text form of one lattice's arcs."""
    final = int(arcs["dst"].max())
    out = [HEADER, INITIAL]
    for src, dst, word, weight in arcs[["src", "dst", "word", "base_w"]].itertuples(index=False):
        out.append(f"F {src} {weight:g}" if dst == final else f"T {src} {dst} {word} {word} {weight:g}")
    return "\n".join(out) + "\n"


def parse_lattices(files: DataFrame) -> DataFrame:
    """Arcs of files (tag, text)."""

    def run(batches):
        for b in batches:
            rows = [(t, i, *a) for t, x in zip(b["tag"], b["text"], strict=True) for i, a in enumerate(parse_fst(x))]
            yield pd.DataFrame(rows, columns=["tag", "arc", "src", "dst", "word", "base_w"])

    return files.select("tag", "text").mapInPandas(run, ARCS)


def reference_words(text: str | None, skip_tags: bool = True) -> list[str]:
    """Words of a transcript; tags (words that begin with <) are left out."""
    return [w for w in (text or "").split() if not (skip_tags and w.startswith("<"))]


# -- model lookup ------------------------------------------------------------------------------------------------------


def arc_contexts(arcs: DataFrame, order: int) -> DataFrame:
    """(tag, arc, ctx, ngram): what each arc looks up, from the last words of all paths to its source.

    A node may be reached by several histories of order - 1 words; their arcs then have several contexts, which must give
    the same score."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["src", "dst", "arc"])
        histories: dict[int, set[tuple[str, ...]]] = {0: {(BOUNDARY,) if order > 1 else ()}}
        out = []
        for tag, arc, src, dst, word in g[["tag", "arc", "src", "dst", "word"]].itertuples(index=False):
            for h in histories.get(src, ()):
                words = (*h, word)
                out.append((tag, arc, min(order, len(words)), " ".join(words[-order:])))
                to = histories.setdefault(dst, set())
                to.add(words[-(order - 1) :] if order > 1 else ())
        return pd.DataFrame(out, columns=["tag", "arc", "ctx", "ngram"])

    return arcs.groupBy("tag").applyInPandas(run, "tag string, arc int, ctx int, ngram string")


def rescore(arcs: DataFrame, model: DataFrame, order: int) -> DataFrame:
    """arcs with weight = base weight - ln prob - sum of ln of back-off weights.

    Fails on a word the model lacks and on a node whose histories differ in the model."""
    looked = arc_contexts(arcs, order)
    scored = longest_match(looked.groupBy("ctx", "ngram").agg(F.count(F.lit(1)).alias("cnt")), model)
    lnp = F.when(F.col("prob") > 0, F.log("prob")).when(F.col("prob") == 0, F.lit(float("-inf"))) + F.col("ln_bow")
    per_arc = looked.join(scored.select("ctx", "ngram", lnp.alias("lnp")), ["ctx", "ngram"]).groupBy("tag", "arc").agg(
        F.min("lnp").alias("lo"), F.max("lnp").alias("hi"), F.count_if(F.col("lnp").isNull()).alias("oov")
    )
    checked = (
        F.when(F.col("oov") > 0, F.raise_error(F.concat(F.lit("lattice has an out-of-vocabulary word: "), "tag")).cast("double"))
        .when(F.col("hi") - F.col("lo") > 1e-9, F.raise_error(F.concat(F.lit("lattice history not unique: "), "tag")).cast("double"))
        .otherwise(F.col("lo"))
    )
    joined = arcs.join(per_arc.select("tag", "arc", checked.alias("lnp")), ["tag", "arc"], "left")
    return joined.withColumn("weight", F.col("base_w") - F.coalesce("lnp", F.lit(0.0))).drop("lnp")


# -- one lattice -------------------------------------------------------------------------------------------------------


@dataclass
class Lattice:
    """One lattice in arrays, arcs sorted by (src, dst)."""

    src: list[int]
    dst: list[int]
    word: list[str]
    weight: list[float]

    @classmethod
    def of(cls, g: pd.DataFrame, weight: str = "weight") -> Lattice:
        g = g.sort_values(["src", "dst", "arc"])
        return cls(g["src"].tolist(), g["dst"].tolist(), g["word"].tolist(), g[weight].tolist())

    def __post_init__(self) -> None:
        self.final = max(self.dst, default=0)
        self.out: list[list[int]] = [[] for _ in range(self.final + 1)]
        for i, s in enumerate(self.src):
            self.out[s].append(i)

    def best_from(self) -> tuple[list[float], list[int]]:
        """Least cost from each node to the end, and the arc it begins with; of equal costs the later arc."""
        cost, arc = [math.inf] * (self.final + 1), [-1] * (self.final + 1)
        cost[self.final] = 0.0
        for node in range(self.final - 1, -1, -1):
            for i in reversed(self.out[node]):
                c = cost[self.dst[i]] + self.weight[i]
                if c < cost[node]:
                    cost[node], arc[node] = c, i
        return cost, arc

    def best_path(self) -> tuple[float, list[int]]:
        cost, arc = self.best_from()
        path, node = [], 0
        while node != self.final and arc[node] >= 0:
            path.append(arc[node])
            node = self.dst[arc[node]]
        return cost[0], path

    def words(self, path: list[int], skip_tags: bool = True) -> list[str]:
        """Words of a path without the arc into the final node."""
        return [
            self.word[i] for i in path if self.dst[i] != self.final and not (skip_tags and self.word[i].startswith("<"))
        ]

    def n_best(self, n: int) -> list[float]:
        """Costs of the n cheapest paths, by A* with the exact rest costs."""
        rest, _ = self.best_from()
        heap, out = [(rest[0], 0, 0.0)], []
        while heap and len(out) < n:
            total, node, so_far = heapq.heappop(heap)
            if node == self.final:
                out.append(total)
                continue
            for i in self.out[node]:
                cost = so_far + self.weight[i]
                if rest[self.dst[i]] < math.inf:
                    heapq.heappush(heap, (cost + rest[self.dst[i]], self.dst[i], cost))
        return out

    def oracle(self, ref: list[str]) -> tuple[int, float, list[int]]:
        """(errors, cost, path) of the path nearest to ref, by least errors, then least cost.

        Boundary arcs may be passed without an error."""
        start = (0, 0)
        best: dict[tuple[int, int], tuple[int, float]] = {start: (0, 0.0)}
        parent: dict[tuple[int, int], tuple[tuple[int, int], int]] = {}
        heap, done = [(0, 0.0, start)], set()
        while heap:
            errors, cost, state = heapq.heappop(heap)
            if state in done:
                continue
            done.add(state)
            node, at = state
            if node == self.final and at == len(ref):
                path = []
                while state != start:
                    state, i = parent[state]
                    if i >= 0:
                        path.append(i)
                return errors, cost, path[::-1]
            moves = []
            for i in self.out[node]:
                if at < len(ref):
                    moves.append(((self.dst[i], at + 1), errors + (self.word[i] != ref[at]), cost + self.weight[i], i))
                free = self.word[i] == BOUNDARY
                moves.append(((self.dst[i], at), errors + (not free), cost + self.weight[i], i))
            if at < len(ref):
                moves.append(((node, at + 1), errors + 1, cost, -1))
            for to, e, c, i in moves:
                if to not in done and (e, c) < best.get(to, (1 << 60, math.inf)):
                    best[to] = e, c
                    parent[to] = state, i
                    heapq.heappush(heap, (e, c, to))
        raise ValueError("lattice has no complete path")

    def margin(self, ref: list[str]) -> float:
        """Best cost minus oracle cost; 0 if the oracle path is the best path."""
        _, cost, oracle = self.oracle(ref)
        best, path = self.best_path()
        return 0.0 if oracle == path else best - cost

    def forward(self) -> np.ndarray:
        """ln of the summed weight of all paths from the begin to each node."""
        f = np.full(self.final + 1, -np.inf)
        f[0] = 0.0
        for s, d, w in zip(self.src, self.dst, self.weight, strict=True):
            f[d] = np.logaddexp(f[d], f[s] - w)
        return f

    def backward(self) -> np.ndarray:
        b = np.full(self.final + 1, -np.inf)
        b[self.final] = 0.0
        for i in range(len(self.src) - 1, -1, -1):
            b[self.src[i]] = np.logaddexp(b[self.src[i]], b[self.dst[i]] - self.weight[i])
        return b

    def posteriors(self) -> np.ndarray:
        """Probability of each arc."""
        f, b, w = self.forward(), self.backward(), np.array(self.weight)
        return np.exp(f[self.src] - w + b[self.dst] - f[self.final])

    def positions(self) -> np.ndarray:
        """Expected place of each node between begin (0) and end (1), in steps."""
        f, b = self.forward(), self.backward()
        before, after = np.full(self.final + 1, -np.inf), np.full(self.final + 1, -np.inf)
        for s, d, w in zip(self.src, self.dst, self.weight, strict=True):
            before[d] = np.logaddexp(before[d], np.logaddexp(before[s], f[s]) - w)
        for i in range(len(self.src) - 1, -1, -1):
            d = self.dst[i]
            after[self.src[i]] = np.logaddexp(after[self.src[i]], np.logaddexp(after[d], b[d]) - self.weight[i])
        with np.errstate(invalid="ignore"):
            x, y = before - f, after - b
            out = np.exp(x - np.logaddexp(x, y))
        return np.nan_to_num(out)

    def confidence(self) -> float:
        """Mean posterior of the best path's words in a confusion network around that path; 0 for a huge lattice.

        Pivot alignment: every arc belongs to the stretch of the best path that it overlaps most, measured in expected
        places.  Arcs of one stretch that follow each other can't be alternatives, so a stretch has a column for each
        number of arcs that come before an arc within it.  A word's posterior is the mass of its column's arcs with that
        word; what a column lacks to 1 belongs to the empty word."""
        if len(self.src) > MAX_NETWORK_ARCS:
            return 0.0
        posterior, place = self.posteriors(), self.positions()
        _, path = self.best_path()
        if not path:
            return 0.0
        stretch = self._stretches(place, path)
        column = np.zeros(len(self.src), int)
        reached: dict[tuple[int, int], int] = {}  # (stretch, node) -> arcs that lead to the node within the stretch
        for i, k in enumerate(stretch.tolist()):
            column[i] = reached.get((k, self.src[i]), 0)
            to = k, self.dst[i]
            reached[to] = max(column[i] + 1, reached.get(to, 0))
        cell = list(zip(stretch.tolist(), column.tolist(), strict=True))
        mass: dict[tuple[int, int], float] = {}
        of_word: dict[tuple[int, int, str], float] = {}
        for c, w, p in zip(cell, self.word, posterior.tolist(), strict=True):
            mass[c] = mass.get(c, 0.0) + p
            of_word[*c, w] = of_word.get((*c, w), 0.0) + p
        each = [
            of_word[*cell[i], self.word[i]] + (max(0.0, 1.0 - mass[cell[i]]) if self.word[i] == BOUNDARY else 0.0) for i in path
        ]
        return float(np.mean(each))

    def _stretches(self, place: np.ndarray, path: list[int]) -> np.ndarray:
        """For each arc the arc of the path (its number) that it overlaps most; of equal overlaps, and without any, the one
        whose middle is nearest."""
        begin, end = place[self.src], place[self.dst]
        ends = np.maximum.accumulate(place[[self.dst[i] for i in path]])
        begins = np.concatenate([[0.0], ends[:-1]])
        # only the stretches from the one where an arc begins to the one where it ends can overlap it
        first = np.minimum(np.searchsorted(ends, begin, "right"), len(path) - 1)
        last = np.maximum(np.minimum(np.searchsorted(begins, end, "left") - 1, len(path) - 1), first)
        best, score = first.copy(), np.full(len(begin), -np.inf)
        for step in range(int((last - first).max(initial=0)) + 1):
            k = np.minimum(first + step, last)
            overlap = np.minimum(end, ends[k]) - np.maximum(begin, begins[k])
            nearness = -np.abs((begin + end) - (begins[k] + ends[k])) * 1e-6
            better = overlap + nearness > score
            best, score = np.where(better, k, best), np.where(better, overlap + nearness, score)
        best[path] = np.arange(len(path))
        return best


def word_errors(hyp: list[str], ref: list[str]) -> int:
    """Edit distance in words."""
    row = np.arange(len(ref) + 1)
    steps = np.arange(len(ref) + 1)
    for i, h in enumerate(hyp, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + np.array([h != r for r in ref], np.int64))
        row = np.minimum.accumulate(new - steps) + steps
    return int(row[-1])


# -- all lattices ------------------------------------------------------------------------------------------------------

UTTERANCE = (
    "tag string, best_score double, words array<string>, n_ref int, n_errors int, oracle_errors int, oracle_score double, "
    "margin double, confidence double"
)


def utterances(arcs: DataFrame, refs: DataFrame) -> DataFrame:
    """One row per lattice of arcs (with weight): 1-best words and cost, errors against refs (tag, words), oracle errors
    and cost, margin, confidence.  A lattice without a reference has an empty one."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        lattice = Lattice.of(g)
        ref = g["words"].iloc[0]
        ref = [] if ref is None else list(ref)
        score, path = lattice.best_path()
        hyp = lattice.words(path)
        errors, oracle_score, oracle_path = lattice.oracle(ref)
        margin = 0.0 if oracle_path == path else score - oracle_score
        row = (g["tag"].iloc[0], score, hyp, len(ref), word_errors(hyp, ref), errors, oracle_score, margin, lattice.confidence())
        return pd.DataFrame([row], columns=[c.split()[0] for c in UTTERANCE.split(", ")])

    return arcs.join(refs.select("tag", "words"), "tag", "left").groupBy("tag").applyInPandas(run, UTTERANCE)


def per_arc(arcs: DataFrame, values: Callable[[Lattice], np.ndarray], name: str) -> DataFrame:
    """(tag, arc, name) for each arc."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["src", "dst", "arc"])
        return pd.DataFrame({"tag": g["tag"], "arc": g["arc"], name: values(Lattice.of(g))})

    return arcs.groupBy("tag").applyInPandas(run, f"tag string, arc int, {name} double")


def arc_posteriors(arcs: DataFrame) -> DataFrame:
    return per_arc(arcs, Lattice.posteriors, "posterior")


def arc_positions(arcs: DataFrame) -> DataFrame:
    """Expected place of each arc's end node."""
    return per_arc(arcs, lambda x: x.positions()[x.dst], "position")


def n_best(arcs: DataFrame, n: int) -> DataFrame:
    """(tag, rank, score) of the n cheapest paths of each lattice."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        costs = Lattice.of(g).n_best(n)
        return pd.DataFrame({"tag": [g["tag"].iloc[0]] * len(costs), "rank": range(1, len(costs) + 1), "score": costs})

    return arcs.groupBy("tag").applyInPandas(run, "tag string, rank int, score double")


def word_error_rate(u: DataFrame) -> DataFrame:
    """One row: WER and oracle WER in percent, mean margin, mean confidence."""
    n = F.sum("n_ref")
    rate = lambda c: F.when(n > 0, 100.0 * F.sum(c) / n)
    return u.agg(
        F.count(F.lit(1)).alias("n_lattices"),
        rate("n_errors").alias("wer"),
        rate("oracle_errors").alias("oracle_wer"),
        F.avg("margin").alias("margin"),
        F.avg("confidence").alias("confidence"),
    )


def transcripts(u: DataFrame) -> DataFrame:
    """Lines `words (tag)` of the 1-best transcripts."""
    return u.select("tag", F.format_string("%s (%s)", F.array_join("words", " "), F.col("tag")).alias("value"))


def needed_ngrams(arcs: DataFrame, order: int) -> DataFrame:
    """(ord, ngram) that rescoring the lattices looks up at most: arcs' n-grams and their histories."""
    own = arc_contexts(arcs, order).select(F.col("ctx").alias("ord"), "ngram").distinct()
    hists = own.where("ord > 1").select((F.col("ord") - 1).alias("ord"), F.expr("substring_index(ngram, ' ', ord - 1)").alias("ngram"))
    return own.unionByName(hists).distinct()
