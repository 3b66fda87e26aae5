"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

Each benchmark item of n words meets the windows of n words of every document (one
window, the whole document, where that is shorter). Windows and items are sets of
weighted 5-word shingles (weight: how often one occurs; fewer than five words: the
whole sequence). A window is a match where its weighted Jaccard similarity
sum(min)/sum(max) with the item is 0.8 or more.

Search. Both sides have a 64-bit SimHash. It is cut into five blocks of 12 or 13 bits;
of two fingerprints within `RADIUS` (19) bits some block differs in 3 bits at most, so
the index holds, for each block, every value within 3 bits of an item's: five lookups
find all items within the radius, for certain. Candidates are then compared exactly.
Sets of similarity 0.8 lie 9.5 bits apart on average, with a standard deviation of
2.8; so at the threshold itself one in some thousand lies beyond the radius, and
fewer above it (equal sets have distance 0).

Only windows that share enough shingles with an item of their size are fingerprinted:
of sets of a and b shingles, weights counted, at least 0.8 / 1.8 of a + b must be in
both. Where an item's places are dense enough is found in one pass over them, and the
bit sums of windows roll along the text; so a long document, or a sentence that all
items share, costs time in proportion to its places.

Scale. The benchmark is the small side: its index is broadcast where its size is
within `BROADCAST_BYTES` (checked); a larger one is dealt out in parts of that size,
each of which makes one pass over the documents. Documents are never shuffled, so
a passage in a third of them makes no hot task; a task holds one slice of text.

Null and empty texts and items have no shingles and match nothing. Repeated rows
and items are each reported. Empty tables give empty results. Extra columns don't
matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as c
from ._common import U64

WORDS, SIMILAR = 5, 0.8
RADIUS, WIDTHS = 19, (13, 13, 13, 13, 12)
BROADCAST_BYTES = 128 << 20
#: What one item takes in the index: 5 blocks of 378 neighbours at most each, its shingles aside.
ITEM_BYTES = 5 * 378 * 4
#: Windows whose bits are summed at once.
RUN = 4096


def simhash(hashes: np.ndarray) -> int:
    """SimHash of a multiset of shingle hashes: a bit where over half have it."""
    bits = np.unpackbits(c.mix(hashes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def weighted_jaccard(a: Counter, b: Counter) -> float:
    low = sum(min(n, b[k]) for k, n in a.items() if k in b)
    return low / (sum(a.values()) + sum(b.values()) - low) if a or b else 0.0


class Index:
    """Benchmark items: shingles, fingerprints and neighbour tables of their blocks."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.words, self.bags, self.prints = [], [], [], []
        owner: dict[int, list[int]] = {}
        for item_id, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            h, _, _, rows = c.words_of(raw, np.array([0, len(raw)]))
            sh, _, _ = c.word_shingles(h, rows, 1, WORDS)
            if not len(sh):
                continue
            k = len(self.ids)
            self.ids.append(item_id)
            self.words.append(len(h))
            self.bags.append(Counter(sh.tolist()))
            self.prints.append(simhash(sh))
            for s in set(sh.tolist()):
                owner.setdefault(s, []).append(k)
        self.shingles = np.array(sorted(owner), np.uint64)
        #: Items of each shingle, end to end, and where a shingle's begin.
        self.owned = np.concatenate([[0], np.cumsum([len(owner[s]) for s in self.shingles.tolist()])]).astype(np.int64)
        self.owner = np.array([k for s in self.shingles.tolist() for k in owner[s]], np.int64)
        #: Items of fewer words than a shingle: by size, the items of each hash of the whole sequence.
        self.short: dict[int, dict[int, list[int]]] = {}
        for k, n in enumerate(self.words):
            if n < WORDS:
                self.short.setdefault(n, {}).setdefault(next(iter(self.bags[k])), []).append(k)
        #: For each block: where it begins, its mask, items by value, and where each value's begin.
        self.blocks: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        self.prints = np.array(self.prints, np.uint64)
        shift = 0
        for width in WIDTHS:
            near = np.array([sum(1 << i for i in at) for r in range(RADIUS // len(WIDTHS) + 1) for at in combinations(range(width), r)], np.uint64)
            mask = (1 << width) - 1
            value = (((self.prints >> U64(shift)) & U64(mask))[:, None] ^ near[None, :]).astype(np.int64).ravel()
            order = np.argsort(value, kind="stable")
            self.blocks.append((shift, mask, (order // len(near)).astype(np.int32), np.searchsorted(value[order], np.arange(mask + 2))))
            shift += width

    def within(self, f: int) -> list[int]:
        """Every item whose fingerprint is within RADIUS bits of f."""
        found = []
        for shift, mask, items, begin in self.blocks:
            v = f >> shift & mask
            found.append(items[begin[v] : begin[v + 1]])
        found = np.unique(np.concatenate(found))
        return found[np.bitwise_count(self.prints[found] ^ U64(f)) <= RADIUS].tolist()


def rolled(sh: np.ndarray, starts: np.ndarray, span: int) -> np.ndarray:
    """SimHash of the windows of `span` shingles from each of `starts` (ascending): bit sums roll over neighbouring windows."""
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = int(np.searchsorted(starts, starts[lo] + RUN))
        part = sh[starts[lo] : starts[hi - 1] + span]
        bits = np.unpackbits(c.mix(part).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.zeros((len(part) + 1, 64), np.int32)
        np.cumsum(bits, axis=0, out=sums[1:])
        at = starts[lo:hi] - starts[lo]
        size = np.minimum(span, len(part) - at)[:, None]
        out[lo:hi] = np.packbits((sums[at + size[:, 0]] - sums[at]) * 2 > size, axis=1, bitorder="little").view(np.uint64)[:, 0]
        lo = hi
    return out


def match_document(index: Index, sh: np.ndarray, n_words: int, at: np.ndarray, which: np.ndarray) -> dict[int, tuple[float, int, int]]:
    """Best (similarity, first word, words) for each item that some window of one document matches.

    sh: the document's shingles in order. at, which: those of them that some item has, and its place in index.shingles.
    """
    many = index.owned[which + 1] - index.owned[which]
    place = np.repeat(at, many)
    item = index.owner[np.repeat(index.owned[which] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
    order = np.argsort(item, kind="stable")
    place, item = place[order], item[order]
    cuts = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]])) if len(item) else np.zeros(0, np.int64)
    # Windows to look at for each size: those with enough places of an item of that size.
    todo: dict[int, list[np.ndarray]] = {}
    dense: dict[int, list[tuple[int, np.ndarray]]] = {}
    for lo, hi in zip(cuts.tolist(), np.append(cuts[1:], len(item)).tolist()):
        k = int(item[lo])
        span = max(1, index.words[k] - WORDS + 1)
        size = min(span, len(sh))
        need = max(1, int(np.ceil(SIMILAR / (1 + SIMILAR) * (span + size) - 1e-9)))
        if hi - lo < need:
            continue
        p = place[lo:hi]
        # The window from w holds p[i] to p[i + need - 1] where p[i + need - 1] - size < w <= p[i].
        first, last = np.maximum(p[need - 1 :] - size + 1, 0), np.minimum(p[: len(p) - need + 1], len(sh) - size)
        some = np.flatnonzero(first <= last)
        if not len(some):
            continue
        depth = np.zeros(len(sh) - size + 2, np.int32)
        np.add.at(depth, first[some], 1)
        np.add.at(depth, last[some] + 1, -1)
        w = np.flatnonzero(np.cumsum(depth[:-1]) > 0)
        todo.setdefault(span, []).append(w)
        dense.setdefault(span, []).append((k, w))
    best: dict[int, tuple[float, int, int]] = {}
    for span, parts in todo.items():
        starts = np.unique(np.concatenate(parts))
        hopeful = {k: set(w.tolist()) for k, w in dense[span]}
        for w, f in zip(starts.tolist(), rolled(sh, starts, min(span, len(sh))).tolist()):
            bag = None
            for k in index.within(f):
                if k not in hopeful or w not in hopeful[k]:
                    continue
                bag = bag or Counter(sh[w : w + span].tolist())
                s = weighted_jaccard(index.bags[k], bag)
                if s >= SIMILAR - 1e-12 and (k not in best or s > best[k][0]):
                    best[k] = (s, w, min(n_words - w, index.words[k]))
    return best


def _match_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for rows, data, offs in c.slices(batches, "text"):
            n = rows.num_rows
            h, _, _, row = c.words_of(data, offs)
            sh, of, _ = c.word_shingles(h, row, n, WORDS)
            if not len(sh) or not len(index.shingles):
                continue
            words = np.bincount(row, minlength=n)
            ids = rows.column(0).to_pylist()
            out: list[tuple] = []
            at = np.minimum(np.searchsorted(index.shingles, sh), len(index.shingles) - 1)
            hit = np.flatnonzero((index.shingles[at] == sh) & (words[of] >= WORDS))
            begin = np.searchsorted(of, np.arange(n + 1))
            for r in np.unique(of[hit]).tolist():
                lo, hi = begin[r], begin[r + 1]
                mine = hit[np.searchsorted(hit, lo) : np.searchsorted(hit, hi)]
                for k, (s, w, size) in match_document(index, sh[lo:hi], int(words[r]), mine - lo, at[mine]).items():
                    out.append((ids[r], index.ids[k], s, w, size))
            # Windows of fewer words than a shingle are alike or equal: their one shingle is the whole sequence.
            first = np.concatenate([[0], np.cumsum(words)])
            for size, items in index.short.items():
                windows = c.combine(h, size)
                same = np.flatnonzero((row[: len(windows)] == row[size - 1 :]) & np.isin(windows, np.array(list(items), np.uint64)))
                seen = set()
                for p in same.tolist():
                    for k in items[int(windows[p])]:
                        if (row[p], k) not in seen:
                            seen.add((row[p], k))
                            out.append((ids[row[p]], index.ids[k], 1.0, p - int(first[row[p]]), size))
            if out:
                a, b, s, w, size = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, rows.schema.field(0).type), pa.array(b, pa.int64()), pa.array(s, pa.float64()), pa.array(w, pa.int64()), pa.array(size, pa.int64())], names=["doc_id", "item_id", "similarity", "first_word", "n_words"])

    return run


def matches(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): for each document row and item the best matching window."""
    return _matches(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), benchmark, broadcast_bytes)


def _matches(rows: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """matches() for rows (doc_id, text), whose doc_id may be of any type."""
    ddl = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id bigint, similarity double, first_word bigint, n_words bigint"
    items = benchmark.select("item_id", "text").where(F.length("text") > 0)
    size = items.agg((F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) * 16 + F.count("*") * ITEM_BYTES).alias("b")).first()[0]
    parts = max(1, -(-int(size) // broadcast_bytes))
    out = None
    for k in range(parts):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k) if parts > 1 else items
        shared = rows.sparkSession.sparkContext.broadcast(Index(sorted(map(tuple, mine.collect()), key=repr)))
        found = rows.mapInArrow(_match_batches(shared), ddl)
        out = found if out is None else out.unionByName(found)
    return out


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return matches(docs, benchmark)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of docs, all columns as they are, of which no window matches an item. Rows are matched by id and text hash, as
    rows of one id may differ; those found are few, and join by an anti-join that Spark plans."""
    docs, back = c.plain(docs, "doc_id", "text")
    named = docs.select(F.struct("doc_id", c.row_key().alias("key")).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = c.cut(_matches(named, benchmark).select(F.col("doc_id.doc_id").alias("hit_id"), F.col("doc_id.key").alias("hit_key")).distinct())
    rows = docs.withColumn("row_key", c.row_key())
    return back(rows.join(found, rows["doc_id"].eqNullSafe(found["hit_id"]) & (rows["row_key"] == found["hit_key"]), "left_anti").drop("row_key"))


OP5_SQL = None
