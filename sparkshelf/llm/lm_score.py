"""LM scoring: a log-frequency Bloom filter holds quantised n-gram counts.

An n-gram of count c is quantised to the level q = 1 + floor(log_b c) and entered
once for each level 1..q; a lookup probes level 1, 2, ... until the first miss.
The level found gives the expected count, which smooths the next-word
probability with a Dirichlet prior on the unigram model:

    P(w | u) = (n(uw) + mu * P1(w)) / (n(u) + mu),   P1(w) = (c(w)+a) / (N + a*(V+1))

n(uw) comes from the filter and is never above the exact counts of u and w (which
also rejects most false positives); c(w), c(u), N and V are exact.

Scale. n-grams leave the map side as sorted binary blocks, pre-aggregated for
every 16 MB of text. A bucket is a range of hashes, so a block holds the steps
between neighbours: about 4 bytes a pair (of 48 bits of hash) and one for its
count. Each bucket becomes one block of the filter. Where all blocks and the
unigram table stay within `broadcast_bytes` (checked after they are built), they
are broadcast and texts are scored in place. Beyond that, `_score_dealt` deals
texts into chunks; a chunk's distinct words and pairs, coded in the same way, ask
every bucket where it lies, and counts and levels come back in order, a byte or so
each. Scores are the same.

Nulls: a null text is empty (one end token). Repeated rows are scored and, where
trained on, counted each. An empty table gives an empty result. Other columns of
the input don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as c
from ._common import U64

END = U64(0x5851F42D4C957F2D)
BEGIN = U64(0x14057B7EF767814F)
ALPHA, MU, LOG_BASE = 0.1, 5.0, 2.0
BITS_PER_ITEM, PROBES = 10, 7
BROADCAST_BYTES = 192 << 20
FLUSH_WORDS = 3_000_000
CHUNK_BYTES = 8 << 20
#: Answers are looked up for so many hashes at once.
ASK = 1 << 20


def _tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, hash of the word before or BEGIN) of every token, each row's end included."""
    h, _, _, rows = c.words_of(data, offs)
    n = len(offs) - 1
    count = np.bincount(rows, minlength=n)
    stop = np.cumsum(count + 1) - 1
    out = np.empty(len(h) + n, np.uint64)
    word = np.ones(len(out), bool)
    word[stop] = False
    out[word], out[stop] = h, END
    prev = np.empty_like(out)
    prev[1:] = out[:-1]
    prev[stop - count] = BEGIN
    return out, np.repeat(np.arange(n), count + 1), prev


def _pair(prev: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of each pair in the upper 48 bits: one in 200,000 pairs shares its with another at 10^9 pairs, where one in 100 probes of the filter is a false positive."""
    return c.mix(prev * U64(0xA0761D6478BD642F) + word) & U64(0xFFFFFFFFFFFF0000)


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    """Buckets are ranges: of sorted hashes, each bucket's stand together."""
    return (((h >> U64(32)) * U64(n)) >> U64(32)).astype(np.int64)


def _planes(x: np.ndarray) -> bytes:
    """Numbers as bytes: a mask of the byte places that any of them fills, then each such place of all."""
    filled = int(np.bitwise_or.reduce(x)) if len(x) else 0
    at = [k for k in range(8) if filled >> 8 * k & 255] or [0]
    return bytes([sum(1 << k for k in at)]) + x.view(np.uint8).reshape(-1, 8).T[at].tobytes()


def _from_planes(body: bytes) -> np.ndarray:
    at = [k for k in range(8) if body[0] >> k & 1]
    planes = np.frombuffer(body, np.uint8, offset=1).reshape(len(at), -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, at] = planes.T
    return out.reshape(-1).view(np.uint64)


def _pack(h: np.ndarray) -> bytes:
    """Sorted hashes, one at least: the first, and the steps from each to the next."""
    return h[:1].tobytes() + _planes(np.diff(h))


def _unpack(body: bytes) -> np.ndarray:
    return np.cumsum(np.concatenate([np.frombuffer(body, np.uint64, 1), _from_planes(body[8:])]), dtype=np.uint64)


def _cuts(h: np.ndarray, n_buckets: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(bucket, (first, last + 1)) of every bucket's part of sorted hashes."""
    b = _bucket(h, n_buckets)
    first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
    return b[first], list(zip(first.tolist(), np.append(first[1:], len(b)).tolist()))


def _summed(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h)
    h, n = h[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(n, first) if len(h) else n


def _count_blocks(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words = {1: [], 2: []}, 0

        def flush():
            for kind, parts in held.items():
                h, n = np.unique(np.concatenate(parts), return_counts=True)
                b, cuts = _cuts(h, n_buckets)
                n = n.astype(np.uint64)
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(b, pa.int32()), "kind": pa.array(np.full(len(b), kind), pa.int32()), "h": pa.array([_pack(h[i:j]) for i, j in cuts], pa.binary()), "n": pa.array([_planes(n[i:j]) for i, j in cuts], pa.binary())})
                parts.clear()

        for _, data, offs in c.slices(batches, "text"):
            tok, _, prev = _tokens(data, offs)
            held[1].append(tok)
            held[2].append(_pair(prev, tok))
            words += len(tok)
            if words >= FLUSH_WORDS:
                yield from flush()
                words = 0
        if words:
            yield from flush()

    return run


def _level_keys(h: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    g = c.mix(h + U64(level * 0xD6E8FEB86659FD93 % 2**64))
    return g, (g >> U64(32)) | U64(1)


def _filter_block(h: np.ndarray, n: np.ndarray, base: float) -> bytes:
    level = 1 + np.floor(np.log(n.astype(np.float64)) / np.log(base) + 1e-9).astype(np.int64)
    size = int(-(-int(level.sum()) * BITS_PER_ITEM // 64) * 64) or 64
    bits = np.zeros(size, bool)
    for j in range(1, int(level.max(initial=0)) + 1):
        g, step = _level_keys(h[level >= j], j)
        for k in range(PROBES):
            bits[(g + U64(k) * step) % U64(size)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _reduce_blocks(base: float):
    """Rows come sorted by bucket and kind. Unigrams: exact sorted hashes and counts. Pairs: a block of the filter."""

    def done(bucket: int, kind: int, hs: list[bytes], ns: list[bytes]) -> pa.RecordBatch:
        h, n = _summed(np.concatenate([_unpack(x) for x in hs]), np.concatenate([_from_planes(x) for x in ns]).astype(np.int64))
        body = h.tobytes() if kind == 1 else _filter_block(h, n, base)
        return pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int32()), "kind": pa.array([kind], pa.int32()), "body": pa.array([body], pa.binary()), "n": pa.array([n.tobytes() if kind == 1 else None], pa.binary()), "items": pa.array([len(h)], pa.int64()), "total": pa.array([int(n.sum())], pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, hs, ns = None, [], []
        for batch in batches:
            for b, k, h, n in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (b, k) != key:
                    if key:
                        yield done(*key, hs, ns)
                    key, hs, ns = (b, k), [], []
                hs.append(h)
                ns.append(n)
        if key:
            yield done(*key, hs, ns)

    return run


_BLOCK = "bucket int, kind int, body binary, n binary, items bigint, total bigint"


def train(docs: DataFrame, base: float = LOG_BASE) -> tuple[DataFrame, int]:
    """Blocks of the model over every row's `text`, in the shared folder: for each bucket the exact unigram counts (kind 1) and a filter block (kind 2). Second: the number of buckets."""
    n = c.n_buckets(docs.sparkSession)
    counted = docs.select("text").mapInArrow(_count_blocks(n), "bucket int, kind int, h binary, n binary")
    blocks = c.deal(counted, n).sortWithinPartitions("bucket", "kind").mapInArrow(_reduce_blocks(base), _BLOCK)
    return c.cut(blocks), n


class Model:
    """The broadcast form: sorted unigram table and the filter's blocks, end to end."""

    def __init__(self, rows, n_buckets: int, base: float, n_words: int, n_bytes: int):
        """rows: blocks, taken one at a time; n_words, n_bytes: what they hold of words and of filter."""
        self.n_buckets, self.base = n_buckets, base
        self.h, self.n = np.empty(n_words, np.uint64), np.empty(n_words, np.uint32)
        self.bytes = np.empty(n_bytes, np.uint8)
        self.start, self.bits = np.zeros(n_buckets, np.uint64), np.zeros(n_buckets, np.uint64)
        self.first, self.last = np.zeros(n_buckets, np.int64), np.zeros(n_buckets, np.int64)
        at = word = 0
        for r in rows:
            b, body = r["bucket"], np.frombuffer(r["body"], np.uint8)
            if r["kind"] == 2:
                self.bytes[at : at + len(body)] = body
                self.start[b], self.bits[b] = at * 8, len(body) * 8
                at += len(body)
            else:
                h, n = body.view(np.uint64), np.frombuffer(r["n"], np.uint64)
                if n.max(initial=0) >= 2**32 and self.n.dtype == np.uint32:
                    self.n = self.n.astype(np.uint64)
                self.h[word : word + len(h)], self.n[word : word + len(h)] = h, n
                self.first[b], self.last[b] = word, word + len(h)
                word += len(h)

    def counts(self, h: np.ndarray) -> np.ndarray:
        """Exact count of each word: a binary search in the sorted words of its bucket, in all at once."""
        b = _bucket(h, self.n_buckets)
        lo, hi = self.first[b], self.last[b]
        end = hi.copy()
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) >> 1
            less = self.h[mid] < h[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
        out = np.zeros(len(h), np.int64)
        there = np.flatnonzero(lo < end)
        there = there[self.h[lo[there]] == h[there]]
        out[there] = self.n[lo[there]]
        return out

    def levels(self, h: np.ndarray) -> np.ndarray:
        """Level of each n-gram: probes go on until the first miss."""
        out = np.zeros(len(h), np.int64)
        b = _bucket(h, self.n_buckets)
        live = np.flatnonzero(self.bits[b] > 0)
        level = 1
        while len(live):
            g, step = _level_keys(h[live], level)
            start, size = self.start[b[live]], self.bits[b[live]]
            ok = np.ones(len(live), bool)
            for k in range(PROBES):
                at = start + (g + U64(k) * step) % size
                ok &= (self.bytes[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8)) & 1 == 1
            live = live[ok]
            out[live] = level
            level += 1
        return out


def expected(level: np.ndarray, base: float) -> np.ndarray:
    """The mean count of a level; 0 for no level."""
    q = level.astype(np.float64)
    return np.where(level > 0, (base ** (q - 1) + base**q - 1) / 2, 0.0)


def token_logs(n_pair, n_word, n_prev, total: float, vocab: float, mu: float):
    """(log10 of the unigram, log10 of the smoothed pair probability) of each token."""
    p1 = (n_word + ALPHA) / (total + ALPHA * (vocab + 1))
    return np.log10(p1), np.log10((np.minimum(n_pair, np.minimum(n_word, n_prev)) + mu * p1) / (n_prev + mu))


def _sums(ids, held_out, row, prev, n_word, n_pair, total: int, vocab: int, n_docs: int, mu: float) -> pa.RecordBatch:
    """A row of results for each text, from what is known of each of its tokens."""
    n_prev = np.empty_like(n_word)
    n_prev[1:] = n_word[:-1]
    n_prev[prev == BEGIN] = n_docs
    one, two = token_logs(n_pair, n_word, n_prev, total, vocab, mu)
    n = len(ids)
    return pa.RecordBatch.from_arrays(
        [ids, held_out, pa.array(np.bincount(row, minlength=n), pa.int64()), pa.array(np.bincount(row, n_word > 0, n).astype(np.int64)), pa.array(np.bincount(row, one, n)), pa.array(np.bincount(row, two, n))],
        names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
    )


_SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def _score_batches(shared, *stats):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for rows, data, offs in c.slices(batches, "text"):
            tok, row, prev = _tokens(data, offs)
            words, where = np.unique(tok, return_inverse=True)
            pairs, back = np.unique(_pair(prev, tok), return_inverse=True)
            yield _sums(rows.column(0), rows.column(1), row, prev, m.counts(words)[where], expected(m.levels(pairs), m.base)[back], *stats)

    return run


def _chunk_tokens(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`_tokens` of all rows of a chunk."""
    parts, n = [], 0
    for part, data, offs in c.slices(rows.to_batches(), "text"):
        tok, row, prev = _tokens(data, offs)
        parts.append((tok, row + n, prev))
        n += part.num_rows
    return tuple(np.concatenate(x) for x in zip(*parts))


def _ask(n_buckets: int):
    """The distinct words (kind 1) and pairs (kind 2) of a chunk, a row for each bucket."""

    def run(rows: pa.Table) -> pa.Table:
        tok, _, prev = _chunk_tokens(rows)
        chunk, out = rows.column("chunk")[0].as_py(), {"bucket": [], "kind": [], "chunk": [], "h": []}
        for kind, h in ((1, np.unique(tok)), (2, np.unique(_pair(prev, tok)))):
            b, cuts = _cuts(h, n_buckets)
            out["bucket"] += b.tolist()
            out["kind"] += [kind] * len(b)
            out["chunk"] += [chunk] * len(b)
            out["h"] += [_pack(h[i:j]) for i, j in cuts]
        return pa.table(out, pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("chunk", pa.int32()), ("h", pa.binary())]))

    return run


def _answer(n_buckets: int, base: float):
    """Rows come sorted by bucket and kind, the model's block before what chunks ask of it. Counts of words, levels of pairs, in the order asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, model, asked, size = None, None, [], 0

        def flush():
            h = np.concatenate([x for _, x in asked])
            got = (model.counts(h) if key[1] == 1 else model.levels(h)).astype(np.uint64)
            ends = np.cumsum([len(x) for _, x in asked])
            body = [_planes(x) for x in np.split(got, ends[:-1])]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in asked], pa.int32()), pa.array([key[1]] * len(asked), pa.int32()), pa.array([key[0]] * len(asked), pa.int32()), pa.array(body, pa.binary())], names=["chunk", "kind", "bucket", "body"])
            asked.clear()

        for batch in batches:
            for b, k, chunk, h, n in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if (b, k) != key:
                    if asked:
                        yield from flush()
                    key, size = (b, k), 0
                    # A bucket without a block holds nothing that was learned.
                    model = Model([] if chunk >= 0 else [{"bucket": b, "kind": k, "body": h, "n": n}], n_buckets, base, len(h) // 8 if k == 1 and chunk < 0 else 0, len(h) if k == 2 and chunk < 0 else 0)
                if chunk >= 0:
                    asked.append((chunk, _unpack(h)))
                    size += len(asked[-1][1])
                    if size >= ASK:
                        yield from flush()
                        size = 0
        if asked:
            yield from flush()

    return run


def _score_chunk(base: float, *stats):
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        tok, row, prev = _chunk_tokens(rows)
        words, where = np.unique(tok, return_inverse=True)
        pairs, back = np.unique(_pair(prev, tok), return_inverse=True)
        # Buckets are ranges, so the answers of one bucket after the other are in the order of the sorted hashes.
        got = sorted(zip(*(answers.column(x).to_pylist() for x in ("kind", "bucket", "body"))))
        n_word, level = (np.concatenate([_from_planes(x) for k, _, x in got if k == kind]).astype(np.int64) for kind in (1, 2))
        if len(n_word) != len(words) or len(level) != len(pairs):
            raise RuntimeError("a chunk's answers don't fit what it asked")
        rows = rows.combine_chunks()
        ids, held_out = (rows.column(x).chunk(0) for x in ("doc_id", "held_out"))
        return pa.Table.from_batches([_sums(ids, held_out, row, prev, n_word[where], expected(level, base)[back], *stats)])

    return run


def _score_dealt(rows: DataFrame, blocks: DataFrame, n_buckets: int, base: float, *stats) -> DataFrame:
    """Scores where the model is too large to broadcast. Texts are dealt into chunks of about `CHUNK_BYTES` by a hash of id
    and text, once for both uses; what a chunk asks and is answered follows from its rows alone, in whatever order they come."""
    n = (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // CHUNK_BYTES + 1
    c.free_shuffles(rows.sparkSession)  # those of training
    dealt = c.deal(rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")), n, "chunk")
    asked = dealt.groupBy("chunk").applyInArrow(_ask(n_buckets), "bucket int, kind int, chunk int, h binary")
    model = blocks.select("bucket", "kind", F.lit(-1).alias("chunk"), F.col("body").alias("h"), "n")
    met = c.deal(model.unionByName(asked.withColumn("n", F.lit(None).cast("binary"))), n_buckets).sortWithinPartitions("bucket", "kind", "chunk")
    answers = met.mapInArrow(_answer(n_buckets, base), "chunk int, kind int, bucket int, body binary")
    return dealt.groupBy("chunk").cogroup(c.deal(answers, n, "chunk").groupBy("chunk")).applyInArrow(_score_chunk(base, *stats), _SCORES)


def score(docs: DataFrame, learn_from, base: float = LOG_BASE, mu: float = MU, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, held_out (not learn_from), n_tokens, n_known, train_tokens,
    base_score, score (both log10). `learn_from`: a boolean Column that marks the rows to learn from."""
    rows = docs.select("doc_id", (~learn_from).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    blocks, n = train(rows.where("not held_out"), base)
    sizes = {r["kind"]: r for r in blocks.groupBy("kind").agg(F.sum("items").alias("items"), F.sum("total").alias("total"), F.sum(F.length("body")).alias("bytes")).collect()}
    vocab, total = (sizes[1]["items"], sizes[1]["total"]) if 1 in sizes else (0, 0)
    n_docs = rows.where("not held_out").count()
    if vocab * 12 + (sizes[2]["bytes"] if 2 in sizes else 0) <= broadcast_bytes:
        # Block by block, so that the driver holds the model once.
        model = docs.sparkSession.sparkContext.broadcast(Model(blocks.toLocalIterator(), n, base, vocab, sizes[2]["bytes"] if 2 in sizes else 0))
        out = rows.mapInArrow(_score_batches(model, total, vocab, n_docs, mu), _SCORES)
    else:
        out = _score_dealt(rows, blocks, n, base, total, vocab, n_docs, mu)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), "base_score", "score")


def op1_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, c.remainder("doc_id", 10) != 0)


#: score is the operator's own model; tests hold it against brute force.
OP1_SQL = None
