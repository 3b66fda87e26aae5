"""SimHash near-dedup by a binary trie self-join.

A fingerprint has bit i where over half of the text's 3-word shingles (repeats
included) have bit i in their XXH64. Distinct fingerprints form a binary trie;
the join walks pairs of its nodes together, adds up differing bits along the
edges and drops a pair of nodes as soon as its sum exceeds the budget. Pairs of
leaves that survive are links.

Scale. Only distinct fingerprints take part, so a group of exact copies is one
row whatever its size. The top `p` levels of the trie are walked ahead: subtrees
are named by their prefix, and a subtree meets only those whose prefix differs in
at most 3 bits, as one (subtree, subtree) task. A subtree of `BLOCK` fingerprints is
8 MB, so p stays at 6 (42 subtrees to meet) up to some 67 million fingerprints, and
grows with the logarithm of their number beyond, which bounds a task; a prefix that
still holds more than `BLOCK` of them is split into chunks, and pairs of chunks meet. A task returns a
spanning forest of its links (at most one row a fingerprint, never all pairs);
`components` merges the forests without the driver.

A row with no words (null, empty or blank text) has fingerprint zero, linked like
any other. Repeated rows share their id's component; a null doc_id is carried, and
names a component only if no other id does. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as c

WORDS, RADIUS, SEED = 3, 3, 42
BLOCK = 1 << 20
#: Fingerprints in hand before the links of their subtrees are merged.
FLUSH = 1 << 17
#: Eight 8-bit lanes, one for each bit of a byte: sums of up to 255 bytes' bits.
_LANES = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def fingerprints(data: np.ndarray, offs: np.ndarray, n: int = WORDS) -> np.ndarray:
    """uint64 fingerprint of each row of a slice of texts."""
    rows = len(offs) - 1
    low = c.LOWER[data]
    starts, ends, row = c.spans(~c.SPACE[low], offs)
    out = np.zeros(rows, np.uint64)
    if not len(starts):
        return out
    # Words again, joined by one space each: a shingle is then one slice of bytes.
    size = ends - starts
    to = np.concatenate([[0], np.cumsum(size + 1)])
    joined = np.full(to[-1], 32, np.uint8)
    keep = ~c.SPACE[low]
    joined[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = low[keep]
    text, begin, stop = joined.tobytes(), to[:-1], to[:-1] + size
    count = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    at = np.flatnonzero(row[: max(0, len(row) - n + 1)] == row[n - 1 :]) if len(row) >= n else np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < n))
    lo = np.concatenate([begin[at], begin[first[short]]])
    hi = np.concatenate([stop[at + n - 1], stop[first[short] + count[short] - 1]])
    of = np.concatenate([row[at], short])
    order = np.argsort(of, kind="stable")
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(text[i:j], SEED) for i, j in zip(lo[order].tolist(), hi[order].tolist())], np.uint64)
    of = of[order]
    # Sums of bits: at most 255 shingles at a time fill the 8-bit lanes.
    total = np.bincount(of, minlength=rows)
    edge = np.concatenate([[0], np.cumsum(total)[:-1]])
    has = np.flatnonzero(total)
    pieces = -(-total[has] // 255)
    cut_row = np.repeat(has, pieces)
    within = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    cuts = edge[cut_row] + 255 * within
    bits = np.zeros((len(cuts), 64), np.int64)
    octets = h.view(np.uint8).reshape(-1, 8)
    for k in range(8):
        bits[:, 8 * k : 8 * k + 8] = np.add.reduceat(_LANES[octets[:, k]], cuts).view(np.uint8).reshape(-1, 8)
    sums = np.add.reduceat(bits, np.cumsum(pieces) - pieces, axis=0)
    out[has] = np.packbits(sums * 2 > total[has][:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offs in c.slices(batches, "text"):
        yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(c.signed(fingerprints(data, offs)))], names=[*rows.schema.names[:-1], "fp"])


def masks(bits: int, radius: int) -> list[int]:
    """Every difference of `bits`-bit prefixes within the radius."""
    return [sum(1 << i for i in at) for k in range(radius + 1) for at in combinations(range(bits), k)]


def trie_join(left: np.ndarray, right: np.ndarray, skip: int, budget: int, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) with hamming(left[i], right[j]) <= budget, for sorted uint64 arrays.

    A trie node is the range of a sorted array that shares a prefix; a pair of
    nodes descends by one bit to at most four pairs of children. Pairs are walked
    level by level; a frontier over `most` pairs is walked in parts. The first
    `skip` bits are walked already, and are counted at a leaf only.
    """
    same = left is right

    def children(a: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
        """Where the 1-children begin in ranges [lo, hi): a binary search in each range at once."""
        lo, hi = lo.copy(), hi.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) >> 1
            one = (a[mid] >> np.uint64(bit)) & np.uint64(1) == 1
            hi[open_[one]] = mid[one]
            lo[open_[~one]] = mid[~one] + 1

    stack = [(63 - skip, np.array([0]), np.array([len(left)]), np.array([0]), np.array([len(right)]), np.array([0]))]
    while stack:
        bit, a0, a1, b0, b1, d = stack.pop()
        if len(a0) > most:
            half = len(a0) // 2
            stack += [(bit, *(x[:half] for x in (a0, a1, b0, b1, d))), (bit, *(x[half:] for x in (a0, a1, b0, b1, d)))]
            continue
        # Both nodes hold one fingerprint: the rest of their path is compared at once.
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
        if leaf.any() or bit < 0:
            if bit < 0:
                leaf = np.ones(len(a0), bool)
            i, j = a0[leaf], b0[leaf]
            near = np.bitwise_count(left[i] ^ right[j]) <= budget
            if same:
                near &= i < j
            if near.any():
                yield i[near], j[near]
            a0, a1, b0, b1, d = (x[~leaf] for x in (a0, a1, b0, b1, d))
        if not len(a0):
            continue
        am, bm = children(left, a0, a1, bit), children(right, b0, b1, bit)
        nxt = []
        for x0, x1, xb in ((a0, am, 0), (am, a1, 1)):
            for y0, y1, yb in ((b0, bm, 0), (bm, b1, 1)):
                cost = d + (xb != yb)
                ok = (x0 < x1) & (y0 < y1) & (cost <= budget)
                if same:
                    ok &= x0 < y1
                nxt.append((x0[ok], x1[ok], y0[ok], y1[ok], cost[ok]))
        stack.append((bit - 1, *(np.concatenate(z) for z in zip(*nxt))))


def _forest(parts: list[tuple[np.ndarray, np.ndarray, int]], radius: int) -> pa.RecordBatch:
    """Spanning forest of the links that the tasks of one batch of node pairs find."""
    values = np.unique(np.concatenate([x for a, b, _ in parts for x in (a, b)]))
    forest = c.Forest(len(values))
    for a, b, skip in parts:
        ia, ib = np.searchsorted(values, a), np.searchsorted(values, b)
        for i, j in trie_join(a, b, skip, radius):
            for x, y in zip(ia[i].tolist(), ib[j].tolist()):
                forest.join(x, y)
    root = np.array([forest.root(x) for x in range(len(values))])
    at = np.flatnonzero(root != np.arange(len(values)))
    return pa.RecordBatch.from_arrays([pa.array(c.signed(values[at])), pa.array(c.signed(values[root[at]]))], names=["a", "b"])


def _join_tasks(radius: int, bits: int):
    """Rows (task, side, fps), sorted by task and side, of binary blocks; a task joins its two sides."""

    def one(sides: dict[int, list[bytes]], task: int):
        at = {s: np.sort(np.frombuffer(b"".join(x), np.uint64)) for s, x in sides.items()}
        if set(at) == {0}:
            return at[0], at[0], bits
        return (at[0], at[1], 0) if len(at) == 2 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides, held, size = None, {}, [], 0
        for batch in batches:
            for task, side, alone, fps in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if task != key:
                    if key is not None and (got := one(sides, key)):
                        held.append(got)
                        size += len(got[0]) + len(got[1])
                        if size > FLUSH:
                            yield _forest(held, radius)
                            held, size = [], 0
                    key, sides = task, {}
                if alone or side >= 0:
                    sides.setdefault(max(side, 0), []).append(fps)
        if key is not None and (got := one(sides, key)):
            held.append(got)
        if held:
            yield _forest(held, radius)

    return run


def _pack(bits: int):
    """Sorted rows (node, fp) to blocks of at most BLOCK fingerprints: (node, chunk, fps)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held, chunk = None, [], 0

        def block():
            return pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([chunk], pa.int64()), pa.array([np.concatenate(held).tobytes()], pa.binary())], names=["node", "chunk", "fps"])

        for batch in batches:
            nodes, fps = (batch.column(i).to_numpy() for i in (0, 1))
            cuts = np.concatenate([[0], np.flatnonzero(nodes[1:] != nodes[:-1]) + 1, [len(nodes)]])
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if lo == hi:
                    continue
                if node is not None and nodes[lo] != node:
                    if held:
                        yield block()
                    held, chunk = [], 0
                node = int(nodes[lo])
                part = fps[lo:hi].view(np.uint64)
                while len(part):
                    room = BLOCK - sum(map(len, held))
                    held.append(part[:room])
                    part = part[room:]
                    if sum(map(len, held)) == BLOCK:
                        yield block()
                        held, chunk = [], chunk + 1
        if held:
            yield block()

    return run


def _meet(bits: int, radius: int):
    """Each block's rows (task, side, alone, fps): one for itself, one for each subtree (or chunk) it has to meet."""
    diffs = masks(bits, radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, chunk, chunks, fps, have in zip(*(batch.column(i).to_pylist() for i in range(5))):
                tasks, side, alone = [], [], []
                for m in diffs:
                    other = node ^ m
                    others = chunks if m == 0 else have.get(other, 0) if isinstance(have, dict) else dict(have or []).get(other, 0)
                    for k in range(others):
                        if (other, k) == (node, chunk):
                            tasks.append(f"{node}.{chunk}")
                            side.append(0)
                            alone.append(True)
                            continue
                        x, y = sorted([(node, chunk), (other, k)])
                        tasks.append(f"{x[0]}.{x[1]}-{y[0]}.{y[1]}")
                        side.append(0 if x == (node, chunk) else 1)
                        alone.append(False)
                yield pa.RecordBatch.from_arrays([pa.array(tasks, pa.string()), pa.array(side, pa.int32()), pa.array(alone, pa.bool_()), pa.array([fps] * len(tasks), pa.binary())], names=["task", "side", "alone", "fps"])

    return run


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints (`fp` bigint, distinct) reachable over links within the radius."""
    spark = distinct.sparkSession
    total = distinct.count()
    bits = min(40, max(6, math.ceil(math.log2(max(2, total) / BLOCK))))
    n = c.n_buckets(spark)
    nodes = distinct.select(F.expr(f"shiftrightunsigned(fp, {64 - bits})").alias("node"), "fp")
    blocks = c.cut(nodes.repartition(n, "node").sortWithinPartitions("node", "fp").mapInArrow(_pack(bits), "node bigint, chunk bigint, fps binary"))
    # For each subtree the subtrees to meet and their numbers of chunks: at most C(bits, <=3) small rows a subtree.
    sizes = blocks.groupBy("node").agg(F.count("*").alias("chunks"))
    near = sizes.select(F.explode(F.expr("transform(array(" + ",".join(f"{m}L" for m in masks(bits, radius)) + "), m -> node ^ m)")).alias("to"), F.struct("node", "chunks").alias("x")).where(F.col("to") != F.col("x.node")).groupBy("to").agg(F.map_from_entries(F.collect_list("x")).alias("have"))
    meeting = blocks.join(sizes, "node").join(near, blocks["node"] == near["to"], "left").select("node", "chunk", "chunks", "fps", "have")
    tasks = meeting.mapInArrow(_meet(bits, radius), "task string, side int, alone boolean, fps binary")
    return tasks.repartition(n, "task").sortWithinPartitions("task", "side").mapInArrow(_join_tasks(radius, bits), "a bigint, b bigint")


def _least(rows: DataFrame, low, radius: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For rows (doc_id, ..., text) of which `low` tells the first: the rows with fp for text, (fp, low, root) of each
    fingerprint, and (root, component_id), the first row of each component."""
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    prints = c.cut(rows.mapInArrow(_fingerprint_batches, f"{ddl}, fp bigint"))
    # Per fingerprint one row: exact copies take no part in the join.
    distinct = c.cut(prints.groupBy("fp").agg(low.alias("low")))
    member = c.components(links(distinct.select("fp"), radius))
    of = distinct.join(member, distinct["fp"] == member["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    # Whole components to their smallest id, then back to fingerprints: few rows, as most have no link.
    return prints, of, of.groupBy("root").agg(F.min("low").alias("component_id"))


def groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp bigint, component_id) for each row of docs (doc_id, text)."""
    prints, of, least = _least(docs.select("doc_id", "text"), F.min("doc_id"), radius)
    return prints.join(of.join(least, "root").select("fp", "component_id"), "fp")


def op8_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """docs without the near duplicates of another row: of each component one row stays, of the smallest id (a null one comes
    last) and of that id's rows the one of the smallest text hash. Rows that share an id but not a component don't meet.
    Columns are those of docs."""
    docs, back = c.plain(docs, "doc_id", "text")
    low = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key"))
    first = _least(docs.select("doc_id", c.row_key().alias("row_key"), "text"), low, RADIUS)[2].select(F.col("component_id.doc_id").alias("first_id"), F.col("component_id.row_key").alias("first_key"))
    rows = docs.withColumn("row_key", c.row_key())
    return back(rows.join(first, rows["doc_id"].eqNullSafe(first["first_id"]) & (rows["row_key"] == first["first_key"]), "left_semi").dropDuplicates(["doc_id", "row_key"]).drop("row_key"))


OP8_SQL = None
