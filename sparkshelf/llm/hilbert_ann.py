"""Approximate nearest neighbours by shifted space-filling curves.

Unit vectors are projected to `DIMS` coordinates by a random rotation, shifted,
quantised, and ordered by their Hilbert index; `CURVES` rotations and shifts give
as many orderings. Spark range-partitions all orderings in one sort; a row's rank
follows from its place in its partition and the sizes of those before it. A query
meets the rows within `window` ranks of its own in each ordering (neighbouring key
windows), and the nearest of all windows, by exact cosine on the original vectors,
are its result.

The window is fitted, not guessed: for at most `PROBES` queries the exact
neighbours are found by brute force over all rows, and the window is the rank
distance within which `TARGET` of them lie on some curve. So recall holds at every
size; on vectors without structure (independent in all dimensions) windows
then grow with the table, as no ordering of few dimensions can do better there.

Scale. Equal vectors are one row of the index (a vector that a third of the table
holds is one row) with its smallest ids. Windows are cut into blocks of at most
`BLOCK` rows, so a task holds one block and the queries that meet it; each block
returns its best for each query only.

Vectors that are null, zero, or hold null or non-finite components take no part,
nor do rows without an id, or of another length than most. Of rows that repeat an
id the smallest vector counts. Tables of fewer candidates return what there is; an
empty one returns nothing. Extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import _common as c

CURVES, DIMS, BITS = 8, 12, 4
PROBES, TARGET = 200, 0.96
BLOCK = 8192
SAMPLE = 5000
SEED = 5


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index (uint64) of integer points (n, d) of `bits` bits a coordinate; d * bits <= 63."""
    x = x.astype(np.int64).copy()
    d = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            flip = (x[:, i] & q) > 0
            swap = np.where(flip, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(flip, p, swap)
            if i:
                x[:, i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[:, d - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << np.uint64(1) | (x[:, i] >> b & 1).astype(np.uint64)
    return key


class Curves:
    """Rotations, shifts and scale of the orderings; the scale is that of a bounded sample."""

    def __init__(self, sample: np.ndarray, curves: int = CURVES):
        dim = sample.shape[1]
        self.d = min(DIMS, dim)
        rng = np.random.default_rng(SEED)
        self.turn = [np.linalg.qr(rng.standard_normal((dim, dim)))[0][:, : self.d] for _ in range(curves)]
        self.shift = [rng.random(self.d) * 0.5 for _ in range(curves)]
        self.low, self.wide = [], []
        for r in self.turn:
            p = sample @ r
            lo, hi = np.quantile(p, 0.001, axis=0), np.quantile(p, 0.999, axis=0)
            self.low.append(lo)
            self.wide.append(np.maximum(hi - lo, 1e-9))

    def key(self, unit: np.ndarray, k: int) -> np.ndarray:
        z = (unit @ self.turn[k] - self.low[k]) / self.wide[k] * 0.5 + self.shift[k]
        return hilbert(np.clip((z * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1), BITS)


def matrix(column: pa.Array) -> np.ndarray:
    """(n, dim) float64 of an Arrow list column whose lists are of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _order_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        curves: Curves = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(matrix(batch.column(1)))
            for k in range(len(curves.turn)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), k, np.int32)), pa.array(c.signed(curves.key(x, k))), *batch.columns], names=["curve", "key", "cid", "embedding", "asks"])

    return run


def _place_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each row's partition and its place in it."""
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n)), *batch.columns], names=["part", "place", *batch.schema.names])
        at += n


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of a row of scores, ties to the smaller id."""
    if len(score) > 4 * k:
        edge = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= edge)
    else:
        some = np.arange(len(score))
    return some[np.lexsort((ids[some], -score[some]))[:k]]


def _search_blocks(k: int):
    """Rows (block, asks, cid, embedding), sorted by block, candidates before queries: the k best of the block for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, rows, units = None, [], [], None

        def answer(qid: np.ndarray, q: np.ndarray):
            nonlocal units
            if units is None:
                # Curves that meet in a block may bring a row twice.
                once, first = np.unique(np.concatenate(ids), return_index=True)
                units = (once, unit(np.concatenate(rows)[first]))
            cid, x = units
            a, b, s = [], [], []
            for lo in range(0, len(qid), 256):
                part = unit(q[lo : lo + 256]) @ x.T
                for i in range(len(part)):
                    score = part[i]
                    at = _best(score, cid, k + 1)
                    at = at[cid[at] != qid[lo + i]][:k]
                    a.append(np.full(len(at), qid[lo + i]))
                    b.append(cid[at])
                    s.append(score[at])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b)), pa.array(np.concatenate(s))], names=["query", "cid", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            of, asks, cid = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            x = matrix(batch.column(3))
            cuts = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (asks[1:] != asks[:-1])]))
            for lo, hi in zip(cuts, np.append(cuts[1:], len(of))):
                if of[lo] != block:
                    block, ids, rows, units = of[lo], [], [], None
                if not asks[lo]:
                    ids.append(cid[lo:hi])
                    rows.append(x[lo:hi])
                elif ids:
                    yield answer(cid[lo:hi], x[lo:hi])

    return run


def _exact_batches(shared, k: int):
    """The k nearest of a batch for each of the broadcast queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            cid, x = batch.column(0).to_numpy(zero_copy_only=False), unit(matrix(batch.column(1)))
            s = q @ x.T
            out = []
            for i in range(len(qid)):
                at = _best(s[i], cid, k + 1)
                at = at[cid[at] != qid[i]][:k]
                out.append((np.full(len(at), qid[i]), cid[at], s[i][at]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in zip(*out)], names=["query", "cid", "score"])

    return run


_FOUND = "query bigint, cid bigint, score double"


def _top(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query", "cid").agg(F.max("score").alias("score"))
    return once.withColumn("k", F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "cid"))).where(F.col("k") <= k)


def exact(classes: DataFrame, queries: list, k: int) -> DataFrame:
    """Brute force: each of a bounded list of queries (cid, embedding) against all rows, in blocks."""
    q = (np.array([r[0] for r in queries], np.int64), unit(np.array([r[1] for r in queries], np.float64)))
    return _top(classes.select("cid", "embedding").mapInArrow(_exact_batches(classes.sparkSession.sparkContext.broadcast(q), k), _FOUND), k)


def search(vectors: DataFrame, asks, k: int = 5, curves: int = CURVES, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found for each row of vectors (vec_id, embedding) that the boolean
    Column `asks` marks, its own row apart."""
    spark = vectors.sparkSession
    fine = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(asks, F.lit(False)).alias("asks")).where(fine)
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    sizes = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.col("count").desc(), "n").limit(1).collect()
    if not sizes:
        return empty
    rows = rows.where(F.size("embedding") == sizes[0]["n"])
    rows = c.cut(rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"), F.max("asks").alias("asks")))
    # One class for equal vectors: its id is its smallest member; k + 1 members are enough to answer with.
    classes = c.cut(rows.groupBy("embedding").agg(F.min("vec_id").alias("cid"), F.max("asks").alias("asks"), F.count("*").alias("n")).select("cid", "embedding", "asks", "n"))
    shared_class = classes.where("n > 1").select("embedding", "cid")
    member = rows.join(shared_class, "embedding", "left").select(F.coalesce("cid", "vec_id").alias("cid"), "vec_id", "asks")
    members = c.cut(member)
    some = classes.select("embedding").orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE).collect()
    fitted = Curves(unit(np.array([r[0] for r in some], np.float64)), curves)
    keyed = classes.select("cid", "embedding", "asks").mapInArrow(_order_rows(spark.sparkContext.broadcast(fitted)), "curve int, key bigint, cid bigint, embedding array<double>, asks boolean")
    n = c.n_buckets(spark)
    placed = c.cut(keyed.withColumn("embedding", F.col("embedding").cast("array<double>")).repartitionByRange(n, "curve", "key", "cid").sortWithinPartitions("curve", "key", "cid").mapInArrow(_place_rows, "part int, place bigint, curve int, key bigint, cid bigint, embedding array<double>, asks boolean"))
    before, offsets = 0, []
    for r in placed.groupBy("part").count().orderBy("part").collect():  # a number for each partition
        offsets.append((r["part"], before))
        before += r["count"]
    ranked = placed.join(F.broadcast(spark.createDataFrame(offsets, "part int, before bigint")), "part").withColumn("rank", F.col("place") + F.col("before"))
    window = _fit_window(classes, ranked, k, target)
    block = min(window, BLOCK)
    reach = -(-window // block)
    at = ranked.withColumn("block", F.floor(F.col("rank") / block).cast("bigint"))
    candidates = at.select("block", F.lit(False).alias("asks"), "cid", "embedding")
    questions = at.where("asks").select(F.explode(F.sequence(F.col("block") - reach, F.col("block") + reach)).alias("block"), F.lit(True).alias("asks"), "cid", "embedding")
    found = candidates.unionByName(questions).repartition(n, "block").sortWithinPartitions("block", "asks", "cid").mapInArrow(_search_blocks(k), _FOUND)
    near = _top(found, k).select("query", "cid", "score")
    own = classes.where("asks and n > 1").select(F.col("cid").alias("query"), "cid", F.lit(1.0).alias("score"))
    # The first k + 1 members of a class: partial limits keep a large class from gathering in one task.
    first = members.withColumn("k", F.row_number().over(Window.partitionBy("cid").orderBy("vec_id"))).where(F.col("k") <= k + 1).select("cid", "vec_id")
    wide = near.unionByName(own).join(first, "cid")
    lists = wide.withColumn("k", F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id"))).where(F.col("k") <= k + 1)
    lists = lists.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))).alias("all"))
    ask = members.where("asks").select(F.col("vec_id").alias("query_id"), F.col("cid").alias("query"))
    mine = ask.join(lists, "query").select("query_id", F.slice(F.filter("all", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("mine"))
    return mine.select("query_id", F.posexplode("mine").alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score"))


def _fit_window(classes: DataFrame, ranked: DataFrame, k: int, target: float) -> int:
    """The rank distance within which `target` of the exact neighbours of a bounded sample of queries lie on some curve."""
    probes = classes.where("asks").orderBy(F.xxhash64("cid"), "cid").limit(PROBES).select("cid", "embedding").collect()
    if not probes:
        return 1
    truth = [(r["query"], r["cid"]) for r in exact(classes, probes, k).collect()]
    if not truth:
        return 1
    wanted = classes.sparkSession.createDataFrame([(x,) for x in sorted({x for pair in truth for x in pair})], "cid bigint")
    place: dict[tuple[int, int], int] = {}
    for r in ranked.join(F.broadcast(wanted), "cid").select("curve", "cid", "rank").collect():  # PROBES * (k + 1) rows a curve
        place[r["curve"], r["cid"]] = r["rank"]
    curves = sorted({q for q, _ in place})
    apart = np.array([min(abs(place[q, a] - place[q, b]) for q in curves) for a, b in truth])
    return max(16, int(np.quantile(apart, target, method="higher")))


def op7_hilbert_ann(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, F.col("vec_id") % 50 == 0)


OP7_SQL = None
