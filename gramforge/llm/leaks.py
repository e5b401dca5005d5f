"""Problem 2: evaluation texts that leak into training text.

The test items, normalised to word sequences, are cut into blocks of at most `MAX_ITEM_WORDS` words; an item that is longer
goes on in the next block, with `min_words - 1` words repeated.  The driver streams the items, holds one block at a time and
broadcasts it as plain word sequences; each Python worker makes a block's generalised suffix automaton when it needs it and
keeps the last `AUTOMATA` of them.  There is one pass over the documents, however many blocks there are: a batch of
documents is decoded and folded once, then its words stream through one automaton after the other.  The automaton tracks
the longest match that ends at each word; where that is at least `min_words` long, the items that hold the last `min_words`
words are looked up in the state.  No shuffle, no pairs; memory is bounded by a block's automata and a batch of documents.

Words are what blanks and line breaks separate in the message as a reader sees it (`mime.visible`).  A word is compared by
its letters: look-alikes, width, case, invisible characters, punctuation, digits and quote marks do not count, and what
has no letter is no word.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import spread
from .lookalikes import to_latin
from .mime import visible

MIN_WORDS = 12
MAX_COVERAGE = 0.5
MAX_ITEM_WORDS = 200_000
AUTOMATA = 2
_MEMO = 400_000


def letters(word: str) -> str:
    """The letters of a word in one form; '' if it has none."""
    word = to_latin(word).casefold()
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def words_of(text: str | None) -> list[str]:
    return [w for w in map(letters, (text or "").split()) if w]


class SuffixAutomaton:
    """Generalised suffix automaton of the items' word sequences."""

    def __init__(self, items: Iterable[tuple[object, list[str]]], min_words: int = MIN_WORDS) -> None:
        self.min_words = min_words
        self.word_ids: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]
        ends: list[tuple[int, object]] = []
        for item, words in items:
            last = 0
            for w in words:
                last = self._extend(last, self.word_ids.setdefault(w, len(self.word_ids)))
                ends.append((last, item))
        # items of a state: those of all states that link to it; a state needs them only from min_words words on
        held: list[set] = [set() for _ in self.next]
        for state, item in ends:
            held[state].add(item)
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True)
        for state in order:
            if self.link[state] > 0 and self.length[self.link[state]] >= min_words:
                held[self.link[state]] |= held[state]
        self.items: list[tuple] = [tuple(h) for h in held]
        # the state of the last min_words words of what a state matches
        self.least: list[int] = [0] * len(self.next)
        for state in reversed(order):
            up = self.link[state]
            if self.length[state] >= min_words:
                self.least[state] = self.least[up] if self.length[up] >= min_words else state

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        state = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = state
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[state] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return state

    def _clone(self, p: int, c: int, q: int) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def matches(self, ids: list[int]) -> Iterator[tuple[int, int, int]]:
        """(position of the last word, words matched, state) wherever at least min_words words match."""
        nxt, link, length, least = self.next, self.link, self.length, self.min_words
        state = n = 0
        for i, c in enumerate(ids):
            step = nxt[state].get(c)
            while step is None and state:
                state = link[state]
                n = length[state]
                step = nxt[state].get(c)
            if step is None:
                n = 0
                continue
            state = step
            n += 1
            if n >= least:
                yield i, n, state


class Words:
    """Numbers for the distinct raw words of documents; `folded` has the letters of each number ('' for what is no word)."""

    def __init__(self) -> None:
        self.numbers = _Numbers(self)
        self.folded: list[str] = []

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words))


class _Numbers(dict):
    def __init__(self, owner: Words) -> None:
        self.owner = owner

    def __missing__(self, raw: str) -> int:
        self[raw] = number = len(self)
        self.owner.folded.append(letters(raw))
        return number


class Finder:
    """Ends of passages of a block's items within documents."""

    def __init__(self, automaton: SuffixAutomaton) -> None:
        self.automaton = automaton
        self.known = np.zeros(0, np.int32)
        self.words: Words | None = None

    def look_up(self, words: Words) -> None:
        """Makes the table from word numbers to the automaton's ids: -1 for words no item has, -2 for what is no word."""
        if words is not self.words:
            self.words, self.known = words, np.zeros(0, np.int32)
        ids = self.automaton.word_ids
        more = [ids.get(w, -1) if w else -2 for w in words.folded[len(self.known) :]]
        if more:
            self.known = np.concatenate([self.known, np.array(more, np.int32)])

    def ends(self, numbers: np.ndarray) -> Iterator[tuple[int, np.ndarray, int]]:
        """(place of the last word, places, state of the last min_words words) of each match end.

        A place counts the words of the text that are words; places has the index into numbers of each place."""
        ids = self.known[numbers]
        places = np.flatnonzero(ids != -2)
        known = ids[places]
        gaps = np.concatenate([[-1], np.flatnonzero(known < 0), [len(known)]])
        for g in np.flatnonzero(np.diff(gaps) > self.automaton.min_words):
            a, b = int(gaps[g]) + 1, int(gaps[g + 1])
            for i, _, state in self.automaton.matches(known[a:b].tolist()):
                yield a + i, places, self.automaton.least[state]


def passages(ends: Iterable[int], least: int) -> tuple[int, int]:
    """Words of the longest passage, and words in passages, from the places where matches of `least` words end."""
    longest = total = run = 0
    before: int | None = None
    for at in sorted(ends):
        step = least if before is None else min(least, at - before)
        run = run + 1 if step == 1 else least
        total += step
        longest = max(longest, run)
        before = at
    return longest, total


Block = list[tuple[object, list[str]]]


class Search:
    """All blocks of items, on a Python worker."""

    def __init__(self, blocks: list[Broadcast], min_words: int) -> None:
        self.blocks, self.min_words = blocks, min_words
        self.words = Words()
        self.finders: dict[int, Finder] = {}

    def finder(self, i: int) -> Finder:
        """The automaton of block i; the one that was made first gives way when there are too many."""
        if i not in self.finders:
            while len(self.finders) >= AUTOMATA:
                del self.finders[next(iter(self.finders))]
            block: Block = _unpack(self.blocks[i].value)
            self.finders[i] = Finder(SuffixAutomaton(block, self.min_words))
        return self.finders[i]

    def read(self, texts: list[str | None]) -> list[list[list[str]]]:
        """Words of each segment of each text."""
        if len(self.words.folded) >= _MEMO:
            self.words = Words()
        return [[s.split() for s in visible(t)] for t in texts]

    def found(self, docs: list[list[list[str]]]) -> Iterator[tuple[int, int, int, np.ndarray, tuple]]:
        """(document, segment, place, places, items) of each match end in each block."""
        numbers = [
            (d, k, self.words.of(words))
            for d, segments in enumerate(docs)
            for k, words in enumerate(segments)
            if len(words) >= self.min_words
        ]
        for i in range(len(self.blocks)):
            finder = self.finder(i)
            finder.look_up(self.words)
            for d, k, ids in numbers:
                for at, places, state in finder.ends(ids):
                    yield d, k, at, places, finder.automaton.items[state]


def _pack(block: Block) -> tuple[list, str]:
    """One string instead of many: workers hold the blocks they have read."""
    return [item for item, _ in block], "\n".join(" ".join(words) for _, words in block)


def _unpack(packed: tuple[list, str]) -> Block:
    ids, text = packed
    return [(item, line.split(" ")) for item, line in zip(ids, text.split("\n"), strict=True)] if ids else []


def item_blocks(items: DataFrame, id_column: str, text_column: str, min_words: int) -> Iterator[Block]:
    """(item, words) of all items in blocks; items without an id or with fewer than min_words words are left out.

    The items are folded on the executors and come to the driver one partition at a time."""
    rows = spread(items.select(id_column, F.col(text_column).alias("__text")).where(F.col("__text").isNotNull() & F.col(id_column).isNotNull()))
    kind = rows.schema[0].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folded = [words_of(t) for t in batch.column(1).to_pylist()]
            keep = [i for i, w in enumerate(folded) if len(w) >= min_words]
            texts = pa.array([" ".join(folded[i]) for i in keep], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int32())), texts], [id_column, "__words"])

    block: Block = []
    room = MAX_ITEM_WORDS
    for item, text in rows.mapInArrow(fold, f"`{id_column}` {kind}, __words string").toLocalIterator():
        words = text.split(" ")
        at = 0
        while len(words) - at >= min_words:
            if room < min(len(words) - at, max(min_words, MAX_ITEM_WORDS)):
                if block:
                    yield block
                block, room = [], max(MAX_ITEM_WORDS, min_words)
            part = words[at : at + room]
            block.append((item, part))
            room -= len(part)
            at += len(part) - (min_words - 1)  # what follows begins with the next word's match
    if block:
        yield block


def _broadcast(items: DataFrame, id_column: str, text_column: str, min_words: int) -> list[Broadcast]:
    context = items.sparkSession.sparkContext
    return [context.broadcast(_pack(b)) for b in item_blocks(items, id_column, text_column, min_words)]


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    min_words: int = MIN_WORDS,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row for each document row and item of which it holds min_words consecutive words.

    Columns: id, `keep`, item, n_words (longest passage), covered (words of the document that lie in passages of the item).
    Null, empty and shorter items match nothing, null and empty documents hold nothing.  Items that share a passage are
    all listed, and every copy of a document is.  Ids may have any type.
    """
    picked = spread(docs.select(id_column, *keep, F.col(text_column).alias("__text")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema[:-1])
    kind = items.schema[item_column].dataType
    arrow = to_arrow_type(kind)
    blocks = _broadcast(items, item_column, item_text_column, min_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(blocks, min_words)
        for batch in batches:
            held: dict[tuple[int, object], list[list[int]]] = {}
            for d, k, at, _, of in search.found(search.read(batch.column(batch.num_columns - 1).to_pylist())):
                for item in of:
                    segments = held.setdefault((d, item), [])
                    while len(segments) <= k:
                        segments.append([])
                    segments[k].append(at)
            if held:
                each = [[passages(ends, min_words) for ends in segments] for segments in held.values()]
                out = batch.take(pa.array([d for d, _ in held], pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [
                        *out.columns[:-1],
                        pa.array([item for _, item in held], arrow),
                        pa.array([max(n for n, _ in x) for x in each], pa.int32()),
                        pa.array([sum(n for _, n in x) for x in each], pa.int64()),
                    ],
                    [*out.schema.names[:-1], item_column, "n_words", "covered"],
                )

    return picked.mapInArrow(run, f"{schema}, `{item_column}` {kind.simpleString()}, n_words int, covered bigint")


def remove_leaks(
    docs: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    min_words: int = MIN_WORDS,
    max_coverage: float = MAX_COVERAGE,
) -> DataFrame:
    """The visible text of every document without leaked passages.

    Columns: id, clean (segments joined by blank lines; null for null texts), n_removed (words cut), dropped (true if
    passages make up more than max_coverage of the document's words: clean is then empty).
    """
    picked = spread(docs.select(id_column, F.col(text_column).alias("__text")))
    kind = picked.schema[0].dataType.simpleString()
    blocks = _broadcast(items, item_column, item_text_column, min_words)

    def clean(text: str | None, cuts: dict[int, list[tuple[int, int]]]) -> tuple[str | None, int, bool]:
        """cuts: (first word, end) of the passages' matches of each segment."""
        if text is None:
            return None, 0, False
        kept, n_cut, n_all = [], 0, 0
        for k, segment in enumerate(visible(text)):
            words = list(re.finditer(r"\S+", segment)) if k in cuts else []
            n_all += len(words) or len(segment.split())
            gone = np.zeros(len(words) + 1, np.int32)
            for first, end in cuts.get(k, []):
                gone[first] += 1
                gone[end] -= 1
            gone = np.cumsum(gone)[:-1] > 0
            n_cut += int(gone.sum())
            edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]))).tolist()
            out, at = [], 0
            for a, b in zip(edges[::2], edges[1::2], strict=True):
                out.append(segment[at : words[a].start()])
                at = words[b - 1].end()
            kept.append("".join([*out, segment[at:]]))
        dropped = n_cut > max_coverage * n_all
        return ("" if dropped else "\n\n".join(kept)), n_cut, dropped

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(blocks, min_words)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            cuts: list[dict[int, list[tuple[int, int]]]] = [{} for _ in texts]
            for d, k, at, places, _ in search.found(search.read(texts)):
                cuts[d].setdefault(k, []).append((int(places[at - min_words + 1]), int(places[at]) + 1))
            rows = [clean(t, c) for t, c in zip(texts, cuts, strict=True)]
            text, removed, dropped = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(text, pa.string()), pa.array(removed, pa.int64()), pa.array(dropped, pa.bool_())],
                [id_column, "clean", "n_removed", "dropped"],
            )

    return picked.mapInArrow(run, f"`{id_column}` {kind}, clean string, n_removed bigint, dropped boolean")
