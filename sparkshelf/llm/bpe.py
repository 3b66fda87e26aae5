"""Byte-level BPE encoding and decoding by a two-tier lookup.

Tier 1: a minimal perfect hash over the vocabulary resolves every pre-token that
is a vocabulary entry (the entry's bytes confirm it). Tier 2: other pre-tokens are
merged by rank with a heap of candidate pairs over linked bytes.

Texts are split into pre-tokens by the published pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

whose matches are runs of letters, numbers, white space and other characters; the
split is computed on whole slices of text from a table of character classes.

Scale. Encoding is map-only: the vocabulary (bounded by its file) is the only thing
broadcast, and every distinct pre-token of a slice is encoded once. What a worker
remembers of earlier slices is bounded by `CACHE` pre-tokens.

A null text is empty: no ids. Repeated rows are each encoded. An empty table gives
an empty result. A text of any length is one row; no part of it is cut.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as c

LETTER, NUMBER, OTHER, BLANK = 0, 1, 2, 3
CACHE = 200_000
SHORT, NONE = 64, 1 << 40
SLICE_BYTES = 1 << 20
_tables: dict[str, np.ndarray] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: base64 of the bytes and the rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def classes() -> np.ndarray:
    """Class of every code point, as the regular-expression library sees it."""
    if "class" not in _tables:
        table = np.full(0x110000, OTHER, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
            for m in regex.finditer(pattern, every):
                lo, hi = ord(m[0][0]), ord(m[0][-1])
                table[lo : hi + 1] = kind
        table[0xD800:0xE000] = OTHER
        _tables["class"] = table
    return _tables["class"]


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, byte offset of each) of UTF-8 bytes."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    first = data[lead].astype(np.uint32)
    out = first.copy()
    size = np.diff(np.append(lead, len(data)))
    for n, keep in ((2, 0x1F), (3, 0x0F), (4, 0x07)):
        at = np.flatnonzero(size == n)
        if len(at):
            v = first[at] & keep
            for k in range(1, n):
                v = (v << 6) | (data[lead[at] + k] & 0x3F)
            out[at] = v
    return out, lead


def pre_tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, end byte, row) of every match of the pattern, in order."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    cp, lead = code_points(data)
    kind = classes()[cp]
    n = len(cp)
    begins = np.searchsorted(lead, offs[:-1][np.diff(offs) > 0])
    edge = np.zeros(n + 1, bool)
    edge[begins] = edge[n] = True
    # A start wherever the class changes or a row begins.
    start = np.empty(n, bool)
    start[0] = True
    start[1:] = kind[1:] != kind[:-1]
    start |= edge[:n]
    run = np.flatnonzero(start)
    run_end = np.append(run[1:], n)
    blank = kind[run] == BLANK
    # White space before a word in the same row: its last character stands apart, and joins the word if it is U+0020.
    ahead = blank & ~edge[run_end]
    last = run_end[ahead] - 1
    start[last] = True
    attach = last[cp[last] == 32]
    start[attach + 1] = False
    # A lone apostrophe before a suffix of the list takes the suffix with it.
    lone = run[(run_end - run == 1) & (cp[run] == 39)]
    lone = lone[(lone == 0) | edge[lone] | (cp[np.maximum(lone, 1) - 1] != 32)]
    lone = lone[(lone + 1 < n)]
    lone = lone[~edge[lone + 1]]
    one = cp[lone + 1]
    two = np.where((lone + 2 < n) & ~edge[np.minimum(lone + 2, n)], cp[np.minimum(lone + 2, n - 1)], 0)
    size = np.where(np.isin(one, [ord(x) for x in "stmd"]), 2, 0)
    for a, b in ("re", "ve", "ll"):
        size = np.where((one == ord(a)) & (two == ord(b)), 3, size)
    at, size = lone[size > 0], size[size > 0]
    start[at + 1] = False
    after = at + size
    inner = after[(after < n)]
    start[inner] = True
    begin = np.flatnonzero(start)
    begin_byte = lead[begin]
    return begin_byte, np.append(begin_byte[1:], len(data)), np.searchsorted(offs, begin_byte, side="right") - 1


class PerfectHash:
    """Minimal perfect hash by displacement: n keys take the n slots of a table. A
    bucket's displacement is found by trial; buckets of one key name a free slot."""

    def __init__(self, keys: np.ndarray):
        n = self.n = len(keys)
        self.n_buckets = max(1, n // 2)
        bucket = (keys >> c.U64(32)) % c.U64(self.n_buckets)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(self.n_buckets + 1))
        self.shift = np.zeros(self.n_buckets, np.int64)
        taken = np.zeros(n, bool)
        sizes = np.diff(cuts)
        for b in np.argsort(-sizes, kind="stable"):
            if sizes[b] < 2:
                break
            mine = keys[order[cuts[b] : cuts[b + 1]]]
            d = 1
            while True:
                slots = self._slots(mine, d)
                if not taken[slots].any() and len(np.unique(slots)) == len(slots):
                    break
                d += 1
            taken[slots] = True
            self.shift[b] = d
        singles = np.flatnonzero(sizes == 1)
        self.shift[singles] = -np.flatnonzero(~taken)[: len(singles)] - 1

    def _slots(self, keys: np.ndarray, d) -> np.ndarray:
        return (c.mix(keys + np.asarray(d, np.uint64) * c.U64(0x9E3779B97F4A7C15)) % c.U64(self.n)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; for a key outside the set, any slot."""
        d = self.shift[((keys >> c.U64(32)) % c.U64(self.n_buckets)).astype(np.int64)]
        return np.where(d < 0, -d - 1, self._slots(keys, np.maximum(d, 0)))


def _hash_tokens(tokens: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(tokens), np.uint8)
    ends = np.cumsum([len(t) for t in tokens])
    return c.span_hashes(data, None, np.concatenate([[0], ends[:-1]]), ends)


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = list(ranks)
        self.ranks, self.token_of = ranks, {r: t for t, r in ranks.items()}
        self.hash = PerfectHash(_hash_tokens(tokens))
        slot = self.hash(_hash_tokens(tokens))
        self.slots: list[bytes] = [b""] * len(tokens)
        for s, t in zip(slot.tolist(), tokens):
            self.slots[s] = t
        self.slot_rank = np.array([ranks[t] for t in self.slots], np.int64)
        self.byte_rank = [ranks[bytes([b])] for b in range(256)]
        #: Rank of what two entries give side by side, where that is an entry too.
        self.pairs = {(ranks[t[:k]], ranks[t[k:]]): r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        #: The same for two bytes, NONE where they make no entry.
        self.first = [[self.pairs.get((a, b), NONE) for b in self.byte_rank] for a in self.byte_rank]
        #: One object for each id, which all that is remembered shares.
        self.ids = list(range(max(ranks.values()) + 1))
        self.cache: dict[bytes, tuple[int, ...]] = {}

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Ids of a pre-token outside the vocabulary: the pair of least rank (leftmost first) merges until none is left. Up to
        SHORT bytes the least of a plain list is found faster than a heap is kept; the result is the same."""
        if len(word) > SHORT:
            return self.merge_by_heap(word)
        get, ids = self.pairs.get, self.ids
        rank = [row[b] for row, b in zip(map(self.first.__getitem__, word), word[1:])]
        part = [self.byte_rank[b] for b in word]
        while rank:
            r = min(rank)
            if r == NONE:
                break
            i = rank.index(r)
            part[i] = r
            del part[i + 1], rank[i]
            if i < len(rank):
                rank[i] = get((r, part[i + 1]), NONE)
            if i:
                rank[i - 1] = get((part[i - 1], r), NONE)
        return tuple([ids[p] for p in part])

    def merge_by_heap(self, word: bytes) -> tuple[int, ...]:
        get, n = self.pairs.get, len(word)
        bits = n.bit_length()
        low = (1 << bits) - 1
        part = [self.byte_rank[b] for b in word]
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        # A heap entry is the rank of a pair and the place of its left part, in one integer.
        heap = [r << bits | i for i, ab in enumerate(zip(part, part[1:])) if (r := get(ab)) is not None]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            entry = pop(heap)
            r, i = entry >> bits, entry & low
            j = nxt[i]
            if j >= n or part[i] < 0 or get((part[i], part[j])) != r:
                continue  # one of the two has merged since
            part[i], part[j] = r, -1
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
                ahead = get((r, part[k]))
                if ahead is not None:
                    push(heap, ahead << bits | i)
            h = prv[i]
            if h >= 0:
                behind = get((part[h], r))
                if behind is not None:
                    push(heap, behind << bits | h)
        ids = self.ids
        return tuple([ids[p] for p in part if p >= 0])

    def encode_distinct(self, tokens: list[bytes], hashes: np.ndarray) -> list[tuple[int, ...]]:
        """Ids of each distinct pre-token."""
        slot = self.hash(hashes).tolist()
        out, cache, slots, rank = [], self.cache, self.slots, self.slot_rank
        if len(cache) > CACHE:
            cache.clear()
        for t, s in zip(tokens, slot):
            if slots[s] == t:
                out.append((int(rank[s]),))
                continue
            ids = cache.get(t)
            if ids is None:
                ids = cache[t] = self.merge(t)
            out.append(ids)
        return out

    def encode_slice(self, data: np.ndarray, offs: np.ndarray) -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray]:
        """(ids of each distinct pre-token, which of them each pre-token is, row of each pre-token)."""
        starts, ends, rows = pre_tokens(data, offs)
        h = c.span_hashes(data, None, starts, ends)
        _, first, which = np.unique(h, return_index=True, return_inverse=True)
        raw = data.tobytes()
        tokens = [raw[i:j] for i, j in zip(starts[first].tolist(), ends[first].tolist())]
        return self.encode_distinct(tokens, h[first]), which, rows

    def encode(self, text: str) -> list[int]:
        raw = np.frombuffer(text.encode(), np.uint8)
        ids, which, _ = self.encode_slice(raw, np.array([0, len(raw)]))
        return [i for w in which.tolist() for i in ids[w]]

    def decode(self, ids) -> bytes:
        token_of = self.token_of
        return b"".join(token_of[i] for i in ids)


def _per_row(which: np.ndarray, rows: np.ndarray, n: int) -> Iterator[list[int]]:
    cuts = np.searchsorted(rows, np.arange(n + 1))
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield which[lo:hi].tolist()


def _digest_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec: Codec = shared.value
        c.trim()
        for rows, data, offs in c.slices(batches, "text", SLICE_BYTES):
            ids, which, row = codec.encode_slice(data, offs)
            n = rows.num_rows
            size = np.array([len(x) for x in ids], np.int64)
            written = [" ".join(map(str, x)).encode() for x in ids]
            back = [codec.decode(x) for x in ids]
            a, b = [], []
            for mine in _per_row(which, row, n):
                a.append(hashlib.sha256(b" ".join([written[w] for w in mine])).hexdigest())
                b.append(hashlib.sha256(b"".join([back[w] for w in mine])).hexdigest())
            count = np.bincount(row, size[which], n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(count), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            del ids, which, row, written, back
            c.trim()

    return run


def _encode_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec: Codec = shared.value
        c.trim()
        for rows, data, offs in c.slices(batches, "text", SLICE_BYTES):
            ids, which, row = codec.encode_slice(data, offs)
            size = np.array([len(x) for x in ids], np.int64)
            flat = np.array([i for x in ids for i in x], np.int32)
            # Ids of each pre-token, taken from those of its distinct form.
            begin = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else size
            many = size[which]
            take = np.repeat(begin[which] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(int(many.sum())) if len(which) else np.zeros(0, np.int64)
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, many, rows.num_rows))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(rows.num_columns)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat[take]))], names=[*rows.schema.names, "ids"])

    return run


def _decode_batches(shared, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec: Codec = shared.value
        for batch in batches:
            text = pa.array([None if x is None else codec.decode(x).decode("utf-8", "replace") for x in batch.column(column).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, text], names=[*batch.schema.names, "decoded"])

    return run


def _shared(df: DataFrame, vocabulary: str):
    return df.sparkSession.sparkContext.broadcast(Codec(read_ranks(vocabulary)))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def encode(docs: DataFrame, vocabulary: str, key: str = "doc_id") -> DataFrame:
    """(key, ids array<int>) for each row of docs."""
    rows = docs.select(key, F.coalesce("text", F.lit("")).alias("text"))
    got = rows.mapInArrow(_encode_batches(_shared(docs, vocabulary)), f"{_ddl(rows)}, ids array<int>")
    return got.select(key, "ids")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """encoded with `decoded`, the text of its `ids`; null ids give null."""
    at = encoded.columns.index("ids")
    return encoded.mapInArrow(_decode_batches(_shared(encoded, vocabulary), at), f"{_ddl(encoded)}, decoded string")


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row of docs: encoded, then decoded from the ids."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_digest_batches(_shared(docs, vocabulary)), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op10_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_vocabulary())


OP10_SQL = None
