"""What the operators of this subpackage share: byte-level text kernels on Arrow
buffers, 64-bit hashing, and helpers that keep state in the shared folder.

Texts reach Python as Arrow batches (`mapInArrow`); every kernel below works on
the raw UTF-8 buffer of a slice of a batch, so its memory is bounded by
`SLICE_BYTES` (or by one text, if that is longer) whatever the table holds.
"""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 2 << 20
_LIBC = ctypes.CDLL(None) if os.name == "posix" else None
U64 = np.uint64
_MULT = U64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_BASE = 0xD1342543DE82EF95
_BASE_INV = pow(_BASE, -1, 2**64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The contract's separators: U+0020 and U+0009 to U+000D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: every output bit depends on every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_powers: dict[str, np.ndarray] = {}


def _power_table(n: int, which: str) -> np.ndarray:
    have = _powers.get(which)
    if have is None or len(have) < n:
        base = np.full(1 << max(18, (n - 1).bit_length()), _BASE if which == "pow" else _BASE_INV, dtype=np.uint64)
        base[0] = 1
        have = np.multiply.accumulate(base)
        if n <= 4 * SLICE_BYTES:
            _powers[which] = have
    return have[:n]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets (from 0) of a string or binary array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "" if pa.types.is_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, off, data = texts.buffers()
    offs = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes of `column`, offsets): each of about `limit` bytes, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offs = buffers(batch.column(batch.schema.get_field_index(column)))
        lo, n = 0, batch.num_rows
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
            hi = min(hi, n)
            yield batch.slice(lo, hi - lo), data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
            lo = hi


def spans(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of `inside` bytes; rows never share a run."""
    n = len(inside)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    first = np.empty(n, bool)
    first[0], first[1:] = True, ~inside[:-1]
    begins = offs[:-1]
    first[begins[begins < n]] = True
    last = np.empty(n, bool)
    last[-1], last[:-1] = True, ~inside[1:]
    last[offs[1:][offs[1:] > 0] - 1] = True
    starts = np.flatnonzero(inside & first)
    ends = np.flatnonzero(inside & last) + 1
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


def span_hashes(data: np.ndarray, inside: np.ndarray | None, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span's bytes. `inside` is false on the bytes between spans; None: spans touch or overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    vals = _BYTE[data]
    vals *= _power_table(len(data), "pow")
    if inside is None:
        total = np.empty(len(data) + 1, np.uint64)
        total[0] = 0
        np.cumsum(vals, out=total[1:])
        sums = total[ends] - total[starts]
    else:
        vals *= inside
        sums = np.add.reduceat(vals, starts)
    sums = sums * _power_table(len(data), "inv")[starts]
    return mix(sums + (ends - starts).astype(np.uint64) * _MULT)


def trim() -> None:
    """Hands this process's freed memory back to the system, where the C library can; workers outlive their tasks and stages."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def _hold_while_running() -> None:
    """Sets M_MMAP_THRESHOLD and M_TRIM_THRESHOLD to what they can grow to by themselves: without, a new process faults on each page again and again."""
    if hasattr(_LIBC, "mallopt"):
        _LIBC.mallopt(-3, 32 << 20)
        _LIBC.mallopt(-1, 64 << 20)


def lean(run):
    """`run` (of batches), after which the process keeps little of what it held: an executor's workers wait side by side."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _hold_while_running()
        yield from run(batches)
        trim()  # what `run` held is free by now

    return out


def words_of(data: np.ndarray, offs: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, row) of every contract word, A-Z lower-cased."""
    data = LOWER[data] if lower else data
    inside = ~SPACE[data]
    starts, ends, rows = spans(inside, offs)
    return span_hashes(data, inside, starts, ends), starts, ends, rows


def combine(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive hashes (length: len - n + 1)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = out * U64(0xA0761D6478BD642F) + hashes[k : k + m]
    return mix(out + U64(n))


def word_shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first word) of every n-word shingle; a row of fewer words gives its whole sequence, an empty one none."""
    count = np.bincount(rows, minlength=n_rows)
    begin = np.concatenate([[0], np.cumsum(count)[:-1]])
    at = np.flatnonzero(rows[: max(0, len(rows) - n + 1)] == rows[n - 1 :]) if len(rows) >= n else np.zeros(0, np.int64)
    got, row = combine(hashes, n)[at], rows[at]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        extra = np.array([combine(hashes[begin[r] : begin[r] + count[r]], int(count[r]))[0] for r in short], np.uint64)
        got, row, at = np.concatenate([got, extra]), np.concatenate([row, short]), np.concatenate([at, begin[short]])
        order = np.argsort(at, kind="stable")
        got, row, at = got[order], row[order], at[order]
    return got, row, at


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session on one machine (as in tests) may do
    without; it gets a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = os.path.join(tempfile.gettempdir(), f"checkpoints-{uuid.uuid4().hex[:8]}")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(df: DataFrame) -> tuple[DataFrame, str]:
    """df, written as Parquet to a new folder in the shared one and read again, and that folder (for `remove`)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    to.getFileSystem(spark._jsc.hadoopConfiguration()).delete(to, True)


def free_shuffles(spark: SparkSession) -> None:
    """Shuffle files of plans that nothing refers to any more (as after `cut`) go now; else they stay until the driver happens to collect its garbage."""
    for _ in range(2):  # what the first round sets free holds more
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def n_buckets(spark: SparkSession, times: int = 2) -> int:
    """Buckets of a hash-partitioned exchange: they follow spark.sql.shuffle.partitions, which follows the input."""
    return max(8, times * int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def deal(df: DataFrame, buckets: int, column: str = "bucket") -> DataFrame:
    """df with each of the buckets 0..buckets-1 in a partition of its own."""
    return df.repartitionById(buckets, F.col(column).cast("int"))


def remainder(doc_id: str, mod: int):
    """crc32 of the id as text, modulo `mod`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % mod


def row_key():
    """Tells rows of one id apart: a 64-bit hash of the text, a null one counting as empty."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def plain(df: DataFrame, *known: str):
    """(df, its columns but the known ones renamed by their place, and what gives a table of these columns its names back): so
    columns of any name, clashing or with marks of their own, pass through."""
    back = df.columns
    return df.toDF(*(n if n in known else f"_{i}" for i, n in enumerate(back))), lambda out: out.toDF(*back)


def free_name(base: str, taken) -> str:
    taken = {t.lower() for t in taken}
    while base.lower() in taken:
        base += "_"
    return base


def _bloom_bits(h: np.ndarray, size: int) -> list[np.ndarray]:
    g = mix(h)
    return [((g + U64(k) * ((g >> U64(32)) | U64(1))) % U64(size)).astype(np.int64) for k in range(3)]


def _bloom_parts(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, bool)
        for batch in batches:
            for at in _bloom_bits(batch.column(0).to_numpy().view(np.uint64), size):
                bits[at] = True
        # Places of few bits, else the bits themselves: never more than the filter.
        few = int(bits.sum()) < size // 32
        body = np.flatnonzero(bits).astype(np.uint32) if few else np.packbits(bits, bitorder="little")
        yield pa.RecordBatch.from_arrays([pa.array([few]), pa.array([body.tobytes()], pa.binary())], names=["few", "body"])

    return run


def bloom(hashes: DataFrame, most_bytes: int) -> np.ndarray:
    """Bloom filter (bytes) of a column of 64-bit hashes: 16 bits each, `most_bytes` at most. Fuller filters pass more, but never miss."""
    hashes = cut(hashes)
    size = int(min(most_bytes * 8, max(1 << 16, hashes.count() * 16))) // 8 * 8
    out = np.zeros(size // 8, np.uint8)
    for row in hashes.coalesce(16).mapInArrow(_bloom_parts(size), "few boolean, body binary").toLocalIterator():  # a part at a time
        if row["few"]:
            at = np.frombuffer(row["body"], np.uint32)
            np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
        else:
            out |= np.frombuffer(row["body"], np.uint8)
    return out


def may_hold(filter_bytes: np.ndarray, h: np.ndarray) -> np.ndarray:
    ok = np.ones(len(h), bool)
    for at in _bloom_bits(h, len(filter_bytes) * 8):
        ok &= (filter_bytes[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return ok


class Forest:
    """Union-find over 0..n-1; the root of a set is its smallest member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _stars(large: bool):
    """Rows (u, v) sorted by u and v. Large star: each v > u is linked to the least of u and its neighbours. Small star (all
    v < u): u and its other neighbours are linked to the least of these. Rows stream through; of a node only its least
    neighbour is held, however many it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = least = before = None
        for batch in batches:
            u, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(u):
                continue
            first = np.concatenate([[node is None or u[0] != node], u[1:] != u[:-1]])
            new = np.concatenate([[bool(first[0]) or v[0] != before], (u[1:] != u[:-1]) | (v[1:] != v[:-1])])
            begin = np.flatnonzero(first)
            group = np.cumsum(first) - 1
            low = np.minimum(u[begin], v[begin]) if large else v[begin]
            m = np.where(group >= 0, low[np.maximum(group, 0)] if len(low) else 0, least if least is not None else 0)
            keep = new & (v > u) if large else new & (v != m)
            a, b = v[keep], m[keep]
            if not large:
                a, b = np.concatenate([a, u[begin]]), np.concatenate([b, m[begin]])
            node, least, before = u[-1], m[-1], v[-1]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["u", "v"])

    return run


#: A node with a share of the links above 1 / HUBS is a hub; so there are 2 * HUBS at most.
HUBS = 200


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row (null, links, two sums of their hashes), and (node, its links here, its least neighbour here) of nodes with more
    than 1 / (2 * HUBS) of this partition's links. A hub is among them in some partition."""
    links, high, low, at, n = 0, 0, 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        u, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        links += len(u)
        h = mix(u.view(np.uint64) * _MULT + v.view(np.uint64))
        high, low = high + int((h >> U64(32)).sum()), low + int((h & U64(0xFFFFFFFF)).sum())
        # A batch's nodes that can't reach the share in it are left out; the error is less than that share.
        node, count = np.unique(np.concatenate([u, v]), return_counts=True)
        heavy = count > max(4, len(u) // (4 * HUBS))
        if heavy.any():
            at, back = np.unique(np.concatenate([at, node[heavy]]), return_inverse=True)
            n = np.bincount(back, np.concatenate([n, count[heavy]])).astype(np.int64)
    heavy = n > max(8, links // (4 * HUBS))
    none = [0] * int(heavy.sum())
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ([None, *at[heavy].tolist()], [links, *n[heavy].tolist()], [high, *none], [low, *none])], names=["node", "n", "high", "low"])


def _hub_minima(hubs: np.ndarray):
    """(node, least neighbour in this partition) of each hub."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.full(len(hubs), np.iinfo(np.int64).max)
        for batch in batches:
            for a, b in ((0, 1), (1, 0)):
                u, v = batch.column(a).to_numpy(), batch.column(b).to_numpy()
                at = np.minimum(np.searchsorted(hubs, u), len(hubs) - 1)
                mine = hubs[at] == u
                np.minimum.at(least, at[mine], v[mine])
        yield pa.RecordBatch.from_arrays([pa.array(hubs), pa.array(least)], names=["node", "low"])

    return run


def _both_ways(hubs: np.ndarray):
    """(u, v) and (v, u) of every link, without those whose first is a hub."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = (np.concatenate([batch.column(a).to_numpy(), batch.column(b).to_numpy()]) for a, b in ((0, 1), (1, 0)))
            keep = ~np.isin(u, hubs)
            yield pa.RecordBatch.from_arrays([pa.array(u[keep]), pa.array(v[keep])], names=["u", "v"])

    return run


def _hub_stars(hubs: np.ndarray, least: np.ndarray):
    """The large star of every hub, in place: its least neighbour is known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = (np.concatenate([batch.column(a).to_numpy(), batch.column(b).to_numpy()]) for a, b in ((0, 1), (1, 0)))
            at = np.minimum(np.searchsorted(hubs, u), len(hubs) - 1)
            keep = (hubs[at] == u) & (v > u)
            yield pa.RecordBatch.from_arrays([pa.array(v[keep]), pa.array(least[at[keep]])], names=["u", "v"])

    return run


def _near_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small stars within a batch (all v < u): of a node's links one, to the least, goes on; what they connect stays connected."""
    for batch in batches:
        u, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(u):
            continue
        order = np.lexsort((v, u))
        u, v = u[order], v[order]
        begin = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
        low = np.repeat(v[begin], np.diff(np.append(begin, len(u))))
        rest = v != low
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([u[begin], v[rest]])), pa.array(np.concatenate([v[begin], low[rest]]))], names=["u", "v"])


def _near_hub_stars(hubs: np.ndarray, least: np.ndarray):
    return lambda batches: _near_stars(_hub_stars(hubs, least)(batches))


def _near_large(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Large stars, and near stars of these by 10,000 links or so: two steps in one process, where each mapInArrow of a stage takes one."""
    held, size = [], 0
    for batch in _stars(True)(batches):
        held.append(batch)
        size += batch.num_rows
        if size >= 10_000:
            yield from _near_stars(iter([pa.concat_batches(held)]))
            held, size = [], 0
    if held:
        yield from _near_stars(iter([pa.concat_batches(held)]))


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of an edge table: the root is the smallest node its component holds.

    Distributed union-find by alternating large-star and small-star rounds: a round
    is two exchanges by node, streamed through in order, and the number of rounds
    grows with the logarithm of the component size. Neither links nor components
    leave the executors; each round is written to the shared folder and replaces the
    one before.

    A hub (a node with a large share of all links, as the root of a large component
    is) isn't sent to one task: there are 2 * HUBS of them at most, their least
    neighbours are found by partial minima, and their links are changed where they
    lie. Small stars start within batches, so a node's links are few once dealt.
    """
    spark = edges.sparkSession
    most = max(2, n_buckets(spark) // 2)
    # Few links need few tasks: 20,000 or more for each.
    by_node = lambda x, links: x.repartition(max(2, min(most, links // 20_000)), "u").sortWithinPartitions("u", "v")
    ddl = "u bigint, v bigint"

    def digest(x: DataFrame) -> tuple[tuple, np.ndarray]:
        """(what tells tables of links apart, hubs)"""
        parts = x.mapInArrow(_digest, "node bigint, n bigint, high bigint, low bigint")
        sums = parts.groupBy("node").agg(F.sum("n").alias("n"), *(F.sum(F.col(k).cast("decimal(38,0)")).alias(k) for k in ("high", "low")))
        # All links, and at most 4 * HUBS nodes that hold more than 1 / (4 * HUBS) of them each.
        rows = sums.orderBy(F.col("node").isNotNull(), F.col("n").desc(), "node").limit(1 + 4 * HUBS).collect()
        links, high, low = (rows[0][k] for k in ("n", "high", "low")) if rows else (0, 0, 0)
        hubs = [r["node"] for r in rows if r["node"] is not None and r["n"] > max(512, links // (2 * HUBS))]
        return (links, high, low), np.array(sorted(hubs), np.int64)

    pairs, path = table(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).cast("bigint").alias("u"), F.least(a, b).cast("bigint").alias("v")))
    before, hubs = digest(pairs)
    for _ in range(most_rounds if before[0] else 0):
        large = by_node(pairs.mapInArrow(_both_ways(hubs), ddl), 2 * before[0]).mapInArrow(_near_large, ddl)
        if len(hubs):
            low = {r["node"]: r["low"] for r in pairs.mapInArrow(_hub_minima(hubs), "node bigint, low bigint").groupBy("node").agg(F.min("low").alias("low")).collect()}
            least = np.minimum(hubs, np.array([low[h] for h in hubs.tolist()], np.int64))
            large = large.unionByName(pairs.mapInArrow(_near_hub_stars(hubs, least), ddl))
        old = path
        pairs, path = table(by_node(large, before[0]).mapInArrow(_stars(False), ddl))
        remove(spark, old)
        after, hubs = digest(pairs)
        if before == after:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    pairs = pairs.distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
