"""Substring dedup by sliding sentence spans.

A sentence ends with a word that ends in `.`, `!` or `?`, or before a newline. Every
run of several consecutive sentences is hashed (word by word, so white space between
words doesn't matter): runs of three of at least 8 words, runs of two of at least
20, and single sentences of 40 words or more, which are passages of their own.
Where three sentences are too short, the run grows, forwards from each sentence and
backwards, until it has 8 words. A passage cut inside of sentences may hold none of
these: windows of `WINDOW` words whose whole sentences no run covers are hashed as
well, and stand for those sentences. So of a repeated passage of `WINDOW` words or
more every sentence that lies in it as a whole belongs to a repeated span; one
without a whole sentence has nothing that could be removed.

A span that occurs at several places is repeated; its first place is that of the
smallest (doc_id, text hash, sentence). Sentences covered by any non-first place of
a repeated span are removed, with the white space after them.

A sentence is never lost with its last copy: the place that makes it go is smaller,
and the smallest place has none before it.

Scale. Which spans are repeated is told by their hashes alone: those of some
`FLUSH` spans leave the map side as sorted binary blocks, each hash twice at most,
dealt by hash. A Bloom filter of the repeated ones, of at most `BLOOM_BYTES`, keeps
the places of other spans on the map side (it never misses one). The rest get their
first place by partial minima, and join it by hash; those of very many places, of
which there are `HOT` at most, are broadcast instead, as a passage that a third of
all documents hold would be one task. What a document loses is a set of its own
spans, no longer than a few times the document.

Nulls: a null text is empty and has no sentence; a null doc_id comes first. Rows are
told apart by doc_id and a hash of the text, so rows that share an id (or have none)
are documents of their own; rows equal in both count as one. Very long texts are one
document each; sentences of any length. Empty tables give empty results; other
columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as c
from ._common import U64

#: Sentences of a run and the words it needs.
RUNS = {3: 8, 2: 20, 1: 40}
#: Words of a passage that loses its whole sentences wherever it is cut.
WINDOW = 51
BLOOM_BYTES = 16 << 20
#: A span with more than 1 / HOT of all places of repeated spans isn't dealt by hash.
HOT = 1000
#: Spans in hand before their hashes are sorted and leave.
FLUSH = 2_000_000
#: Sentences of a span take so many bits of a place; no span has more than a window's words.
_SIZE_BITS = 6
#: Tells the hash of a window from that of a run.
_MARK = U64(0x2545F4914F6CDD1D)
_STOP = np.zeros(256, bool)
_STOP[[33, 46, 63]] = True


def sentences(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, words, start byte) of every sentence, in order, and the words' hashes."""
    h, starts, ends, rows = c.words_of(data, offs, lower=False)
    if not len(h):
        z = np.zeros(0, np.int64)
        return h, z, z, z, h
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    new = np.ones(len(h), bool)
    new[1:] = (rows[1:] != rows[:-1]) | _STOP[data[ends[:-1] - 1]] | (lines[starts[1:]] > lines[ends[:-1]])
    at = np.flatnonzero(new)
    vals = h * c._power_table(len(h), "pow")
    sums = np.add.reduceat(vals, at) * c._power_table(len(h), "inv")[at]
    words = np.diff(np.append(at, len(h)))
    return c.mix(sums + words.astype(np.uint64)), rows[at], words, starts[at], h


def runs(h: np.ndarray, row: np.ndarray, words: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, index of the first sentence, hash) of the runs of each length."""
    total = np.concatenate([[0], np.cumsum(words)])
    for n, least in RUNS.items():
        m = len(h) - n + 1
        if m <= 0:
            continue
        at = np.flatnonzero((row[:m] == row[n - 1 :]) & (total[n:] - total[:-n] >= least))
        yield n, at, c.combine(h, n)[at]
    # Longer runs: the shortest of enough words that begins, or ends, with each sentence. A sentence has a word at least.
    most, least = max(RUNS), RUNS[max(RUNS)]
    edge = np.arange(len(total))
    stop, begin = np.searchsorted(total, total + least), np.searchsorted(total, total - least, side="right") - 1
    size_from, size_to = np.where(stop < len(total), stop - edge, 0), np.where(begin >= 0, edge - begin, 0)
    for n in range(most + 1, least + 1):
        at = np.union1d(np.flatnonzero(size_from == n), np.flatnonzero(size_to == n) - n)
        at = at[row[at] == row[at + n - 1]]
        if len(at):
            yield n, at, c.combine(h, n)[at]


def windows(word: np.ndarray, row: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, index of the first whole sentence, hash) of the windows of WINDOW words with n whole sentences that no run covers."""
    total = np.concatenate([[0], np.cumsum(words)])
    m = len(word) - WINDOW + 1
    if m <= 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64)
    of = np.append(np.repeat(np.arange(len(words)), words), len(words))
    # Sentences from the first that begins at word p or later to the last that ends before p + WINDOW.
    first = of[:m] + (total[of[:m]] < np.arange(m))
    n = of[WINDOW:] - first
    at = np.flatnonzero((n > 0) & (row[of[:m]] == row[of[WINDOW - 1 : -1]]))
    first, n = first[at], n[at]
    least = np.array([0, *(RUNS[k] for k in sorted(RUNS))])[np.minimum(n, max(RUNS))]
    bare = total[first + n] - total[first] < least
    at, first, n = at[bare], first[bare], n[bare]
    sums = np.zeros(len(word) + 1, np.uint64)
    np.cumsum(word * c._power_table(len(word), "pow"), out=sums[1:])
    return n, first, c.mix((sums[at + WINDOW] - sums[at]) * c._power_table(len(word), "inv")[at] + _MARK)


def spans(h: np.ndarray, row: np.ndarray, words: np.ndarray, word: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(n, index of the first sentence, hash) of all spans."""
    for n, at, span in runs(h, row, words):
        yield np.full(len(at), n), at, span
    yield windows(word, row, words)


def _hash_blocks(buckets: int):
    """(bucket, hashes): the hashes of spans, sorted, each once, or twice if it is repeated among those in hand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            h = np.sort(np.concatenate(held))
            h = h[np.concatenate([np.ones(min(2, len(h)), bool), h[2:] != h[:-2]])]
            b = (h >> U64(32)) * U64(buckets) >> U64(32)
            cuts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
            return pa.RecordBatch.from_arrays([pa.array(b[cuts].astype(np.int32)), pa.array([h[i:j].tobytes() for i, j in zip(cuts, np.append(cuts[1:], len(h)))], pa.binary())], names=["bucket", "hashes"])

        for _, data, offs in c.slices(batches, "text"):
            h, row, words, _, word = sentences(data, offs)
            for _, _, span in spans(h, row, words, word):
                if len(span):
                    held.append(span)
                    size += len(span)
            if size >= FLUSH:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes that occur twice or more, of the blocks of one bucket a partition."""
    blocks = [x for batch in batches for x in batch.column(1).to_pylist()]
    h = np.sort(np.frombuffer(b"".join(blocks), np.uint64))
    del blocks
    again = h[1:][h[1:] == h[:-1]]
    again = again[np.concatenate([np.ones(min(1, len(again)), bool), again[1:] != again[:-1]])]
    yield pa.RecordBatch.from_arrays([pa.array(c.signed(again))], names=["h"])


def _place_batches(shared):
    """(h, doc_id, row_key, at, n) of every span that the Bloom filter may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in c.slices(batches, "text"):
            h, row, words, _, word = sentences(data, offs)
            begin = np.searchsorted(row, np.arange(rows.num_rows + 1))
            for n, at, span in spans(h, row, words, word):
                keep = c.may_hold(shared.value, span)
                n, at, span = n[keep], at[keep], span[keep]
                of = pa.array(row[at])
                yield pa.RecordBatch.from_arrays([pa.array(c.signed(span)), rows.column(0).take(of), rows.column(1).take(of), pa.array(at - begin[row[at]]), pa.array(n.astype(np.int64))], names=["h", "doc_id", "row_key", "at", "n"])

    return run


def removals(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, lost array<bigint>): for each document that loses sentences, the spans lost: first sentence and, in
    the low bits, the number of sentences."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", c.row_key().alias("row_key"), F.coalesce("text", F.lit("")).alias("text"))
    buckets = c.n_buckets(spark)
    repeated = c.deal(rows.select("text").mapInArrow(_hash_blocks(buckets), "bucket int, hashes binary"), buckets).mapInArrow(_repeated, "h bigint")
    shared = spark.sparkContext.broadcast(c.bloom(repeated, BLOOM_BYTES))
    places = c.cut(rows.mapInArrow(_place_batches(shared), f"h bigint, doc_id {docs.schema['doc_id'].dataType.simpleString()}, row_key bigint, at bigint, n bigint"))
    first = c.cut(places.groupBy("h").agg(F.min(F.struct("doc_id", "row_key", "at")).alias("first"), F.count("*").alias("times")).where("times > 1"))
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row_key") == F.col("first.row_key")) & (F.col("at") == F.col("first.at"))
    # Spans with a large share of all places, HOT at most, meet their places where these lie; the others are dealt by hash.
    total = first.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    hot = F.broadcast(first.where(F.col("times") * HOT > total))
    rest = first.where(F.col("times") * HOT <= total)
    later = places.join(hot, "h").unionByName(places.join(hot.select("h"), "h", "left_anti").join(rest, "h")).where(~same)
    return later.groupBy("doc_id", "row_key").agg(F.collect_set(F.shiftleft("at", _SIZE_BITS) + F.col("n")).alias("lost"))


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, whole, lost) to doc_id, n_sentences, n_removed, removed_words and what is left of the text."""
    for rows, data, offs in c.slices(batches, "whole"):
        _, row, words, starts, _ = sentences(data, offs)
        n = rows.num_rows
        begin = np.searchsorted(row, np.arange(n + 1))
        raw = data.tobytes()
        left, gone_words, gone = [], np.zeros(n, np.int64), np.zeros(n, np.int64)
        lost = rows.column(2)
        places, each = lost.flatten().to_numpy(), pc.fill_null(pc.list_value_length(lost), 0).to_numpy(zero_copy_only=False)
        upto = np.concatenate([[0], np.cumsum(each)])
        for i in range(n):
            lo, hi = int(offs[i]), int(offs[i + 1])
            if not each[i]:
                left.append(raw[lo:hi])
                continue
            mine = places[upto[i] : upto[i + 1]]
            size = int(begin[i + 1] - begin[i])
            depth = np.zeros(size + 1, np.int64)
            at = mine >> _SIZE_BITS
            np.add.at(depth, at, 1)
            np.add.at(depth, at + (mine & ((1 << _SIZE_BITS) - 1)), -1)
            cut = np.cumsum(depth[:-1]) > 0
            edge = np.append(starts[begin[i] : begin[i + 1]], hi)
            # Runs of sentences that stay, after the white space before the first sentence.
            stays = np.flatnonzero(np.diff(np.concatenate([[0], ~cut, [0]]).astype(np.int8)))
            parts = [raw[lo : int(edge[0])], *(raw[int(edge[x]) : int(edge[y])] for x, y in stays.reshape(-1, 2).tolist())]
            left.append(b"".join(parts))
            gone[i], gone_words[i] = cut.sum(), words[begin[i] : begin[i + 1]][cut].sum()
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(begin).astype(np.int64)), pa.array(gone), pa.array(gone_words), pa.array(left, pa.binary()).cast(pa.string())], names=["doc_id", "n_sentences", "n_removed", "removed_words", "text"])


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_sentences, n_removed, removed_words, text) for each row of docs: text is what is left."""
    gone = removals(docs).select(F.col("doc_id").alias("gone_id"), F.col("row_key").alias("gone_key"), "lost")
    rows = docs.select("doc_id", c.row_key().alias("row_key"), F.coalesce("text", F.lit("")).alias("whole"))
    joined = rows.join(gone, rows["doc_id"].eqNullSafe(gone["gone_id"]) & (rows["row_key"] == gone["gone_key"]), "left").select("doc_id", "whole", "lost")
    return joined.mapInArrow(_cut_batches, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_sentences bigint, n_removed bigint, removed_words bigint, text string")


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = None
