"""Byte-pair encoding in numpy.

Texts are cut into pieces by the tokenizer's pattern.  The distinct pieces that are not in the cache are encoded together:
they are put into padded matrices by length, one row for each piece, and in each round every row merges its leftmost pair
of minimum rank.  The rank of a pair is looked up in an open-addressing hash table; a merge changes two pairs only, so
just these are looked up again.  Rows are compacted after the merge, and a row without a pair to merge leaves the matrix.

Pieces longer than `LONG` bytes would make the matrices quadratic; they merge in the same order by a heap.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import os
import re
from collections.abc import Sequence

import numpy as np
import regex

#: Where the public vocabulary files are; a parameter of everything that needs them.
TOKENIZER_DIR = "/opt/tokenizers"
#: Fixed value: the pattern that cuts text into pieces before the merges of the rank files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for ASCII texts, where it finds the same pieces in less than half the time.
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
LONG = 192
_BUCKETS = (2, 3, 4, 5, 6, 8, 10, 12, 16, 24, 32, 64, 128, LONG)
_NONE = np.int32(1 << 30)
_CACHE = 600_000


class _Column:
    """An array that grows at its end; its room doubles, so that growing costs no more than filling."""

    def __init__(self, kind: type) -> None:
        self._room, self._n = np.empty(1024, kind), 0

    def __len__(self) -> int:
        return self._n

    @property
    def values(self) -> np.ndarray:
        return self._room[: self._n]

    def extend(self, more: np.ndarray) -> None:
        n = self._n + len(more)
        if n > len(self._room):
            room = np.empty(max(n, 2 * len(self._room)), self._room.dtype)
            room[: self._n] = self.values
            self._room = room
        self._room[self._n : n] = more
        self._n = n


class Encoder:
    """One vocabulary.  `encode(texts)` gives flat ids and offsets, `count(texts)` the number of tokens of each text."""

    def __init__(self, data: bytes) -> None:
        """data: content of a rank file."""
        self.ranks: dict[bytes, int] = {}
        for line in data.splitlines():
            token, rank = line.split()
            self.ranks[base64.b64decode(token)] = int(rank)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self._hash_pairs()
        self.split = regex.compile(PATTERN).findall
        self.split_ascii = re.compile(ASCII_PATTERN, re.ASCII).findall
        self._reset()

    # -- pairs ---------------------------------------------------------------------------------------------------------

    def _hash_pairs(self) -> None:
        pairs: dict[int, int] = {}
        get = self.ranks.get
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = get(token[:i]), get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = rank
        self.pairs = pairs
        bits = max(10, (len(pairs) * 4).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        keys, values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE, np.int32)
        left = np.fromiter(pairs, np.int64, len(pairs))
        value = np.fromiter(pairs.values(), np.int32, len(pairs))
        slot = self._slot(left)
        while len(left):
            free = keys[slot] < 0
            keys[slot[free]] = left[free]  # of several for one slot the last stays
            done = keys[slot] == left
            values[slot[done]] = value[done]
            left, value, slot = left[~done], value[~done], (slot[~done] + 1) & self._mask
        self._keys, self._values = keys, values

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, `_NONE` where no token is their concatenation; ids below 0 are padding."""
        key = a.astype(np.int64) << 20 | b
        key[(a < 0) | (b < 0)] = -2
        slot = self._slot(key)
        found = self._keys[slot]
        out = np.where(found == key, self._values[slot], _NONE)
        open_ = np.flatnonzero((found != key) & (found >= 0) & (key >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self._mask
            found = self._keys[slot[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self._values[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    # -- merging -------------------------------------------------------------------------------------------------------

    def _merge_rows(self, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids: padded with -1, at least two columns.  The ids after all merges, and each row's number of ids."""
        out, out_size = ids.copy(), size.copy()
        row = np.arange(len(ids))
        rank = self.rank_of(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        while len(row):
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(row)), at]
            ends = best == _NONE
            if ends.any():
                done = row[ends]
                out[done, : ids.shape[1]] = ids[ends]
                out_size[done] = size[ends]
                keep = ~ends
                row, ids, size, rank, at, best = row[keep], ids[keep], size[keep], rank[keep], at[keep], best[keep]
                if not len(row):
                    break
                width = max(2, int(size.max()))
                ids, rank = ids[:, :width], rank[:, : width - 1]
            # the merged id replaces the left one, what is right of the pair moves up by one
            width = ids.shape[1]
            column = np.arange(width)
            source = column + (column > at[:, None])
            ids = np.take_along_axis(np.pad(ids, ((0, 0), (0, 1)), constant_values=-1), source, axis=1)
            n = np.arange(len(row))
            ids[n, at] = best
            size = size - 1
            source = column[:-1] + (column[:-1] > at[:, None])
            rank = np.take_along_axis(np.pad(rank, ((0, 0), (0, 1)), constant_values=_NONE), source, axis=1)
            right = np.where(at + 1 < width, ids[n, np.minimum(at + 1, width - 1)], -1)
            inside = at < width - 1
            rank[n[inside], at[inside]] = self.rank_of(best[inside], right[inside])
            before = at > 0
            rank[n[before], at[before] - 1] = self.rank_of(ids[n[before], at[before] - 1], best[before])
        return out, out_size

    def _merge_long(self, raw: bytes) -> list[int]:
        ids = self.byte_ids[np.frombuffer(raw, np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        get = self.pairs.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        end = len(ids)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= end or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k < end:
                before[k] = i
                if (x := get(r << 20 | ids[k])) is not None:
                    heapq.heappush(heap, (x, i, r, ids[k]))
            if (h := before[i]) >= 0 and (x := get(ids[h] << 20 | r)) is not None:
                heapq.heappush(heap, (x, h, ids[h], r))
        return [x for x in ids if x >= 0]

    def _encode_new(self, words: list[str]) -> None:
        """Encodes words and appends them to the store in their order."""
        raws = [w.encode("utf-8", "surrogatepass") for w in words]
        length = np.fromiter(map(len, raws), np.int64, len(raws))
        sizes = np.ones(len(raws), np.int64)
        flat: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        low = 0
        for high in (1, *_BUCKETS):
            rows = np.flatnonzero((length > low) & (length <= high))
            low = high
            for part in np.array_split(rows, max(1, len(rows) * high // 2_000_000)):
                if not len(part):
                    continue
                width = max(2, high)
                joined = np.frombuffer(b"".join(raws[i] for i in part), np.uint8)
                size = length[part]
                ids = np.full((len(part), width), -1, np.int32)
                ids[np.arange(width) < size[:, None]] = self.byte_ids[joined]
                if high > 1:
                    ids, size = self._merge_rows(ids, size)
                sizes[part] = size
                flat.append((part, ids, size))
        long_rows = {int(i): self._merge_long(raws[i]) for i in np.flatnonzero(length > LONG)}
        for i, x in long_rows.items():
            sizes[i] = len(x)
        start = np.concatenate([[0], np.cumsum(sizes)])
        values = np.empty(start[-1], np.int32)
        for part, ids, size in flat:
            inside = np.arange(ids.shape[1]) < size[:, None]
            values[(start[part][:, None] + np.arange(ids.shape[1]))[inside]] = ids[inside]
        for i, x in long_rows.items():
            values[start[i] : start[i + 1]] = x
        self._starts.extend(start[:-1] + len(self._values_of))
        self._sizes.extend(sizes)
        self._values_of.extend(values)

    # -- texts ---------------------------------------------------------------------------------------------------------

    def _reset(self) -> None:
        self._code: dict[str, int] = {}
        self._starts, self._sizes, self._values_of = _Column(np.int64), _Column(np.int64), _Column(np.int32)

    def _codes(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The pieces' numbers in the store, and the number of pieces of each text."""
        if len(self._code) > _CACHE:
            self._reset()
        code, new = self._code, []
        codes: list[int] = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if not text:
                continue
            pieces = self.split_ascii(text) if text.isascii() else self.split(text)
            counts[i] = len(pieces)
            for p in set(pieces).difference(code):
                code[p] = len(code)
                new.append(p)
            codes += map(code.__getitem__, pieces)
        if new:
            self._encode_new(new)
        return np.array(codes, np.int64), counts

    def count(self, texts: Sequence[str | None]) -> np.ndarray:
        """Number of tokens of each text; 0 for null and empty texts."""
        codes, pieces = self._codes(texts)
        total = np.concatenate([[0], np.cumsum(self._sizes.values[codes])]) if len(codes) else np.zeros(1, np.int64)
        end = np.cumsum(pieces)
        return total[end] - total[end - pieces]

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids, and offsets with one more element than texts."""
        codes, pieces = self._codes(texts)
        if not len(codes):
            return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        sizes, starts = self._sizes.values[codes], self._starts.values[codes]
        total = np.concatenate([[0], np.cumsum(sizes)])
        index = np.arange(total[-1]) + np.repeat(starts - total[:-1], sizes)
        offsets = np.concatenate([[0], total[np.cumsum(pieces)]])
        return self._values_of.values[index], offsets


_ENCODERS: dict[str, Encoder] = {}


def vocabulary(tokenizer: str = "byte_bpe_50k", directory: str = TOKENIZER_DIR) -> tuple[str, bytes]:
    """Digest and content of a rank file `<directory>/<tokenizer>.tiktoken`; its size is that of a vocabulary."""
    with open(os.path.join(directory, tokenizer + ".tiktoken"), "rb") as f:
        data = f.read()
    return hashlib.sha256(data).hexdigest(), data


def encoder_of(digest: str, data: bytes) -> Encoder:
    """The encoder of a rank file's content, kept for the life of the Python worker."""
    if digest not in _ENCODERS:
        if hashlib.sha256(data).hexdigest() != digest:
            raise ValueError("the vocabulary isn't the one that was sent")
        _ENCODERS[digest] = Encoder(data)
    return _ENCODERS[digest]


def encoder(tokenizer: str = "byte_bpe_50k", directory: str = TOKENIZER_DIR) -> Encoder:
    """The encoder of a rank file on this machine."""
    return encoder_of(*vocabulary(tokenizer, directory))
