"""Words and pairs of neighbours as numbers, counted in sorted arrays; strings are made only of what is handed on.

A word's number is its place in a task's dictionary; an n-gram's hash is made of CRCs, the same in every task. Hashes only
choose which n-grams are counted exactly: one that shares its bucket costs time, never a result."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import count, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words and products of a chunk, words a dictionary holds, n-grams held before they are handed on.
WORDS, DOCS, HELD_WORDS, HELD_KEYS = 1_000_000, 4096, 300_000, 1_000_000
BITS, DOC_BITS = 25, 12
SKETCH, SLICES, SAMPLE = 22, 64, 256
_FIRST, _SECOND, _MIX = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def _mixed(x: np.ndarray) -> np.ndarray:
    return (x ^ (x >> np.uint64(32))) * _MIX


def _crcs(words: Iterable[str]) -> np.ndarray:
    return np.array([zlib.crc32(x.encode()) for x in words], np.uint64)


def hashes(terms: Iterable[str]) -> np.ndarray:
    """The hashes of n-grams given as strings."""
    parts = [t.split(" ") for t in terms]
    second = np.array([zlib.crc32(p[1].encode()) + 1 if len(p) > 1 else 0 for p in parts], np.uint64)
    return _mixed(_crcs(p[0] for p in parts) * _FIRST + second * _SECOND)


def buckets(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def has(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each bit is set."""
    return (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


class Kept:
    """The n-grams whose bucket is marked."""

    def __init__(self, packed: np.ndarray) -> None:
        self.packed, self.bits = packed, (len(packed) * 8).bit_length() - 1

    def __call__(self, h: np.ndarray) -> np.ndarray:
        return has(self.packed, buckets(h, self.bits))


def sampled(h: np.ndarray, one_in: int = SAMPLE) -> np.ndarray:
    """One n-gram in so many, by bits that choose no bucket."""
    return (h >> np.uint64(16)) % np.uint64(one_in) == 0


def lined_up(ids: list[np.ndarray], product: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of all texts, product of each, places of those that have a neighbour in their text)."""
    sizes = np.array([len(x) for x in ids], np.int64)
    words = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    joined = np.ones(len(words), bool)
    joined[np.cumsum(sizes)[sizes > 0] - 1] = False
    return words, np.repeat(np.array(product, np.int64), sizes), np.flatnonzero(joined)


class Counted:
    """Counts n-grams of the products of a task: chunk by chunk, in one dictionary of words until it is handed on."""

    def __init__(self, words: Callable, keep: Callable | None, all_hashes: Callable | None = None) -> None:
        self.words, self.keep, self.all_hashes = words, keep, all_hashes
        self.reset()

    def reset(self) -> None:
        self.ids, self.crc, self.held, self.size = defaultdict(count().__next__), np.zeros(0, np.uint64), [], 0

    def __call__(self, products: Iterable[list]) -> Iterator[pa.RecordBatch]:
        texts, product, n, words = [], [], 0, 0
        for some in products:
            for t in some:
                if t is not None:
                    w = self.words(t)
                    texts.append(np.fromiter(map(self.ids.__getitem__, w), np.int64, len(w)))
                    product.append(n)
                    words += len(w)
            n += 1
            if n == DOCS or words > WORDS:
                yield from self.chunk(texts, product)
                texts, product, n, words = [], [], 0, 0
        yield from self.chunk(texts, product)
        if self.held:
            yield self.out()

    def chunk(self, texts: list[np.ndarray], product: list[int]) -> Iterator[pa.RecordBatch]:
        w, doc, at = lined_up(texts, product)
        if not len(w):
            return
        names = list(self.ids)
        self.crc = np.r_[self.crc, _crcs(names[len(self.crc) :])]
        one, two, nxt = self.crc * _FIRST, (self.crc + np.uint64(1)) * _SECOND, at + 1
        a, b = np.r_[w, w[at]], np.r_[np.zeros(len(w), np.int64), w[nxt] + 1]
        d = np.r_[doc, doc[at]]
        if self.keep or self.all_hashes:
            h = one[a]
            h[len(w) :] += two[w[nxt]]
            h = _mixed(h)
            if self.all_hashes:
                self.all_hashes(h)
            if self.keep:
                these = np.flatnonzero(self.keep(h))
                a, b, d = a[these], b[these], d[these]
        if len(a):
            self.held.append(_counts(a, b, d))
            self.size += len(self.held[-1][0])
        full = len(self.ids) > HELD_WORDS
        if self.size > HELD_KEYS:
            self.merge()
            full = full or self.size > HELD_KEYS // 2
        if full and self.held:
            yield self.out()
        if len(self.ids) > HELD_WORDS:
            self.reset()

    def merge(self) -> None:
        key, df, total = (np.concatenate(x) for x in zip(*self.held))
        order = np.argsort(key)
        key, df, total = key[order], df[order], total[order]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        self.held, self.size = [(key[start], np.add.reduceat(df, start), np.add.reduceat(total, start))], len(start)

    def out(self) -> pa.RecordBatch:
        self.merge()
        key, df, total = self.held[0]
        self.held, self.size = [], 0
        a, b = key >> BITS, key & ((1 << BITS) - 1)
        alone = np.flatnonzero(b == 0)
        pair = np.flatnonzero(b)
        names = pa.array(self.ids, pa.string())
        terms = pa.concat_arrays([names.take(pa.array(a[alone])), pc.binary_join_element_wise(names.take(pa.array(a[pair])), names.take(pa.array(b[pair] - 1)), " ")])
        order = np.r_[alone, pair]
        return pa.RecordBatch.from_arrays([terms, pa.array(df[order]), pa.array(total[order])], ["term", "df", "total"])


def _counts(a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, products, occurrences) of each n-gram. Word, next word and product make one number, sorted once."""
    x = np.sort(((a << BITS | b) << DOC_BITS) | doc)
    first = np.r_[True, x[1:] != x[:-1]]
    key = x >> DOC_BITS
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[start], np.add.reduceat(first.astype(np.int64), start), np.diff(np.r_[start, len(key)])


class Sketch:
    """Occurrences of all n-grams by bucket: of none are there more than its bucket has."""

    def __init__(self) -> None:
        self.n = np.zeros(1 << SKETCH, np.uint32)

    def __call__(self, h: np.ndarray) -> None:
        self.n += np.bincount(buckets(h, SKETCH), minlength=1 << SKETCH).astype(np.uint32)

    def out(self) -> pa.RecordBatch:
        data = [zlib.compress(x.tobytes(), 1) for x in np.split(self.n, SLICES)]
        return sketch_rows({"at": pa.array(range(SLICES), pa.int32()), "data": pa.array(data, pa.binary())})


SKETCHED = "at int, data binary, term string, df bigint, total bigint"


def sketch_rows(given: dict) -> pa.RecordBatch:
    """A batch of SKETCHED: what isn't given is null."""
    n = len(next(iter(given.values())))
    kinds = {"at": pa.int32(), "data": pa.binary(), "term": pa.string(), "df": pa.int64(), "total": pa.int64()}
    return pa.RecordBatch.from_arrays([given[x] if x in given else pa.nulls(n, t) for x, t in kinds.items()], list(kinds))


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of sketches and counts of sampled n-grams, added up."""
    sums, df, total = {}, Counter(), Counter()
    for b in batches:
        for at, data, term, d, t in zip(*(b.column(x).to_pylist() for x in ("at", "data", "term", "df", "total"))):
            if term is None:
                x = np.frombuffer(zlib.decompress(data), np.uint32)
                sums[at] = sums[at] + x if at in sums else x.astype(np.int64)
            else:
                df[term] += d
                total[term] += t
    for at, x in sums.items():
        yield sketch_rows({"at": pa.array([at], pa.int32()), "data": pa.array([x.tobytes()], pa.binary())})
    yield sketch_rows({"term": pa.array(total.keys(), pa.string()), "df": pa.array([df[t] for t in total], pa.int64()), "total": pa.array(total.values(), pa.int64())})


class Lookup:
    """Finds the n-grams of a vocabulary in texts, by the numbers of its words."""

    def __init__(self, terms: dict[str, int]) -> None:
        self.words, alone, pairs = {}, [], []
        for t, i in terms.items():
            w = [self.words.setdefault(x, len(self.words)) for x in t.split(" ")]
            (pairs if len(w) > 1 else alone).append((*w, i))
        self.unknown, self.n = len(self.words), len(terms)
        self.alone = np.full(self.unknown + 1, -1, np.int64)
        if alone:
            w, i = np.array(alone, np.int64).T
            self.alone[w] = i
        a, b, i = np.array(pairs, np.int64).reshape(-1, 3).T
        key = a << 32 | b
        order = np.argsort(key)
        self.key, self.pair = np.r_[key[order], np.int64(-1)], np.r_[i[order], np.int64(-1)]
        self.some = np.zeros(1 << 21, bool)
        self.some[self.cell(key)] = True

    def cell(self, key: np.ndarray) -> np.ndarray:
        return (_mixed(key.astype(np.uint64) * _FIRST) >> np.uint64(64 - 21)).astype(np.int64)

    def __call__(self, products: list[list], words: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(product, term, count), by product and term."""
        ids, product, get = [], [], self.words.get
        for i, texts in enumerate(products):
            for t in texts:
                w = [] if t is None else words(t)
                ids.append(np.fromiter(map(get, w, repeat(self.unknown)), np.int64, len(w)))
                product.append(i)
        w, doc, at = lined_up(ids, product)
        at = at[(w[at] < self.unknown) & (w[at + 1] < self.unknown)]
        key = w[at] << 32 | w[at + 1]
        some = np.flatnonzero(self.some[self.cell(key)])
        at, key = at[some], key[some]
        place = np.searchsorted(self.key[:-1], key)
        found = np.flatnonzero(self.key[place] == key)
        alone = self.alone[w]
        known = np.flatnonzero(alone >= 0)
        cell = np.r_[doc[known] * self.n + alone[known], doc[at[found]] * self.n + self.pair[place[found]]]
        cell, tf = np.unique(cell, return_counts=True)
        return cell // max(self.n, 1), cell % max(self.n, 1), tf.astype(np.float64)
