"""Token counts by trie-shared dynamic programming.

The distinct pre-tokens of a block of text are inserted in a trie. A node's forward
score is the best log probability of its prefix as a sequence of vocabulary pieces,

    best(node) = max over pieces that end there of best(ancestor) + log p(piece),

so a prefix that many pre-tokens share is scored once; the node where a pre-token
ends stores its token count. Of equal scores the segmentation of fewer tokens counts.
A document's count is the sum over its pre-tokens.

The trie is built and scored level by level on arrays: a level's nodes are the
distinct (parent, byte) pairs, and each piece length is one lookup for all of them.

Vocabulary: the byte-level pieces of a public tokenizer file. Its entries are in
order of frequency; by Zipf's law p(rank) is taken as proportional to 1 / (rank + 1).
Every byte is a piece, so every text has a segmentation.

Scale. Map-only: the vocabulary (bounded by its file) is broadcast, the trie is that
of one slice of text. A pre-token of more than `LONG` bytes shares hardly anything
but would be a level of the trie for each byte; the same recurrence runs along it
alone, over the places where pieces match (`forward_alone`), in time proportional to
its length.

A null or empty text has no token and score 0. Repeated rows are each counted. An
empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as c
from . import bpe
from ._common import U64

SLICE = 6 << 20
LONG = 1024
_STEP = 0xD1342543DE82EF95


class Pieces:
    """Vocabulary pieces by length and hash."""

    def __init__(self, ranks: dict[bytes, int]):
        z = float(np.sum(1.0 / (1 + np.arange(max(ranks.values()) + 1))))
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by: dict[int, list[tuple[int, float]]] = {}
        for piece, rank in ranks.items():
            h = 0
            for b in piece:
                h = (h * _STEP + int(c._BYTE[b])) % 2**64
            by.setdefault(len(piece), []).append((h, -float(np.log((rank + 1) * z))))
        for n, pairs in sorted(by.items()):
            pairs.sort()
            self.tables[n] = (np.array([h for h, _ in pairs], np.uint64), np.array([s for _, s in pairs]))
        #: By length, which low bits of a hash some piece has: most places hold no piece of a length.
        self.maybe = {n: np.bincount((h & U64(0xFFFF)).astype(np.int64), minlength=1 << 16) > 0 for n, (h, _) in self.tables.items()}
        self.power = [pow(_STEP, n, 2**64) for n in range(max(by) + 1)]
        self.longest = max(by)


def forward(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, int]:
    """(tokens, score) of each distinct pre-token, and the number of trie nodes scored."""
    size = ends - starts
    tokens, score = np.zeros(len(size), np.int64), np.zeros(len(size))
    node = np.zeros(len(size), np.int64)  # of each pre-token, on the level reached
    live = np.flatnonzero(size > 0)
    # Levels so far, no more than the longest piece: hash of the prefix, best score, tokens, parent's place.
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(1, np.uint64), np.zeros(1), np.zeros(1, np.int64), np.zeros(1, np.int64))]
    depth = n_nodes = 0
    while len(live):
        byte = data[starts[live] + depth].astype(np.int64)
        key, where = np.unique(node[live] << 8 | byte, return_inverse=True)
        parent = key >> 8
        h = levels[-1][0][parent] * U64(_STEP) + c._BYTE[key & 255]
        best, count = np.full(len(key), -np.inf), np.zeros(len(key), np.int64)
        up = parent
        for n in range(1, min(depth + 1, pieces.longest) + 1):
            above = levels[-n]
            if n in pieces.tables:
                hashes, logs = pieces.tables[n]
                tail = h - above[0][up] * U64(pieces.power[n])
                at = np.minimum(np.searchsorted(hashes, tail), len(hashes) - 1)
                s = np.where(hashes[at] == tail, above[1][up] + logs[at], -np.inf)
                k = above[2][up] + 1
                better = (s > best + 1e-12) | ((s > best - 1e-12) & np.isfinite(s) & (k < count))
                best, count = np.where(better, s, best), np.where(better, k, count)
            up = above[3][up]
        levels.append((h, best, count, parent))
        if len(levels) > pieces.longest:
            levels.pop(0)
        n_nodes += len(key)
        node[live] = where
        depth += 1
        done = live[size[live] == depth]
        tokens[done], score[done] = count[node[done]], best[node[done]]
        live = live[size[live] > depth]
    return tokens, score, n_nodes


def _matches(data: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(end, length, log p) of every occurrence of a piece, by end, then by length."""
    m = len(data)
    # Hash of data[i:i+n] from those of lengths doubled and added: h(x + y) = h(x) * STEP^len(y) + h(y).
    codes = c._BYTE[data]
    at, size, logs = [], [], []
    h, have = codes.copy(), 1
    for n in sorted(pieces.tables):
        if n > m:
            break
        while have < n:
            h = h[:-1] * U64(_STEP) + codes[have:]
            have += 1
        hashes, table = pieces.tables[n]
        near = np.flatnonzero(pieces.maybe[n][h & U64(0xFFFF)])
        where = np.minimum(np.searchsorted(hashes, h[near]), len(hashes) - 1)
        hit = hashes[where] == h[near]
        at.append(near[hit] + n)
        size.append(np.full(int(hit.sum()), n))
        logs.append(table[where[hit]])
    at, size, logs = np.concatenate(at), np.concatenate(size), np.concatenate(logs)
    order = np.lexsort((size, at))
    return at[order], size[order], logs[order]


def forward_alone(data: np.ndarray, pieces: Pieces, block: int = 1 << 16) -> tuple[int, float]:
    """(tokens, score) of one pre-token, by the recurrence of `forward` along its bytes; matches are found a block at a time."""
    best, count = [0.0] * (len(data) + 1), [0] * (len(data) + 1)
    for lo in range(0, len(data), block):
        # Occurrences that end in (lo, lo + block]: they begin at most `longest` before.
        first = max(0, lo - pieces.longest + 1)
        ends, sizes, logs = _matches(data[first : lo + block], pieces)
        mine = ends + first > lo
        now, s0, k0 = 0, -np.inf, 0
        for e, n, p in zip((ends[mine] + first).tolist(), sizes[mine].tolist(), logs[mine].tolist()):
            if e != now:
                if now:
                    best[now], count[now] = s0, k0
                now, s0, k0 = e, -np.inf, 0
            s, k = best[e - n] + p, count[e - n] + 1
            if s > s0 + 1e-12 or (s > s0 - 1e-12 and k < k0):
                s0, k0 = s, k
        if now:
            best[now], count[now] = s0, k0
    return count[-1], best[-1]


def _count_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: Pieces = shared.value
        for rows, data, offs in c.slices(batches, "text", SLICE):
            n = rows.num_rows
            starts, ends, row = bpe.pre_tokens(data, offs)
            _, first, which = np.unique(c.span_hashes(data, None, starts, ends), return_index=True, return_inverse=True)
            long = ends[first] - starts[first] > LONG
            tokens, score = np.zeros(len(first), np.int64), np.zeros(len(first))
            tokens[~long], score[~long], _ = forward(data, starts[first[~long]], ends[first[~long]], pieces)
            for i in np.flatnonzero(long).tolist():
                tokens[i], score[i] = forward_alone(data[starts[first[i]] : ends[first[i]]], pieces)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.bincount(row, minlength=n)), pa.array(np.bincount(row, tokens[which], n).astype(np.int64)), pa.array(np.bincount(row, score[which], n))], names=["doc_id", "n_pre_tokens", "n_tokens", "score"])

    return run


def count(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_pre_tokens, n_tokens, score) for each row of docs (doc_id, text)."""
    pieces = docs.sparkSession.sparkContext.broadcast(Pieces(bpe.read_ranks(vocabulary)))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_count_batches(pieces), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_pre_tokens bigint, n_tokens bigint, score double")


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    return count(spark.read.parquet(f"{sf_dir}/documents.parquet"), bpe.default_vocabulary())


OP2_SQL = None
