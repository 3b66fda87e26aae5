"""Toxicity: a factorization machine over hashed terms.

    score = sigmoid(w0 + sum_i w_i + sum_{i<j} <v_i, v_j>)

over the distinct terms i of a text. The factors v learn which terms are toxic
only together (an insult and a group), which additive weights can't hold. Terms
are lower-cased words (runs of letters, digits and non-ASCII characters) and their
4-, 5- and 6-byte beginnings, hashed to `BITS` bits; so an inflected form shares
features with its stem. Every term of the learning rows is a feature, and all
features interact. The factors of those that don't tell the classes apart on their
own by more than chance (`STRONG`) join after `ALONE` epochs, start calmly (`CALM`) and
pay a group-lasso penalty (`LASSO`), or they would mostly fit noise; one whose pairs
matter keeps its factors all the same.

Learning. Labels come from a sample of labelled rows bounded by `SAMPLE` (the rows
of the smallest hash of doc_id, so the choice doesn't depend on order): a share of
the hash's range that holds so many of them, so no task or driver sorts the labels.
Only the hashed terms of those rows, in bounded pieces, come to the driver, where
the machine is fitted; its size, and that of the broadcast model, follow from them.
`L1`, `LASSO` and `CALM` were chosen by cross-validation within learning rows.

Scoring is map-only, over whole texts; a very long one has more terms, each counted
once. A null or empty text has no terms and the score of the bias; equal texts have
equal scores. Labels that are null, or of ids that no document has, count for
nothing; of several labels of an id the largest counts, and rows that share a
labelled id are all learned from. Without labels of both classes every score is 0.
Repeated rows are each scored. Extra columns don't matter, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as st

from . import _common as c
from ._common import U64

THRESHOLD = 0.7
SAMPLE = 24_000
BITS = 24
FACTORS, EPOCHS, BATCH = 4, 12, 64
RATE, L1, L2 = 0.15, 1e-3, 1e-4
STRONG = 10.8  # chi-square of a term, p < 0.001
ALONE, LASSO = 4, 3e-3
CALM = 1.0  # what squared gradients of w, and of factors that aren't strong, start from: rare terms move little
SEED = 11

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
STEMS = (4, 5, 6)


def terms(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the terms of a slice of texts, distinct within each row."""
    low = c.LOWER[data]
    inside = _WORD[low]
    starts, ends, rows = c.spans(inside, offs)
    h = [c.span_hashes(low, inside, starts, ends)]
    r = [rows]
    codes = low.astype(np.uint64)
    for k in STEMS:
        long = np.flatnonzero(ends - starts > k)
        at, v = starts[long], np.zeros(len(long), np.uint64)
        for j in range(k):
            v = (v << U64(8)) | codes[at + j]
        h.append(c.mix(v + U64(k << 56)))
        r.append(rows[long])
    h, r = np.concatenate(h), np.concatenate(r)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[new], r[new]


def _id_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, toxic, ids) of each sampled row: the hashed terms, as binary."""
    for rows, data, offs in c.slices(batches, "text"):
        h, r = terms(data, offs)
        ids = (h >> U64(64 - BITS)).astype(np.uint32)
        cuts = np.searchsorted(r, np.arange(rows.num_rows + 1))
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([ids[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:])], pa.binary())], names=["doc_id", "toxic", "ids"])


class Machine:
    """A factorization machine with binary features in a hashed space, held sparsely."""

    def __init__(self, vocab: np.ndarray, factors: int = FACTORS):
        self.vocab = vocab  # sorted hashed terms
        self.w0 = 0.0
        self.w = np.zeros(len(vocab), np.float32)
        rng = np.random.default_rng(SEED)
        self.v = (rng.standard_normal((len(vocab), factors)) * 0.01).astype(np.float32)
        self.strong = np.ones(len(vocab), bool)  # terms whose factors pay no penalty
        self.active = np.ones(len(vocab), bool)  # terms that interact; all of them once it is fitted

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash, -1 if it is no feature."""
        if not len(self.vocab):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.vocab, h), len(self.vocab) - 1)
        return np.where(self.vocab[at] == h, at, -1)

    def raw(self, index: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        out = self.w0 + np.bincount(row, self.w[index], n)
        live = self.active[index]
        index, row = index[live], row[live]
        for f in range(self.v.shape[1]):
            v = self.v[index, f].astype(np.float64)
            out += 0.5 * (np.bincount(row, v, n) ** 2 - np.bincount(row, v * v, n))
        return out

    def fit(self, index: np.ndarray, cuts: np.ndarray, y: np.ndarray, epochs: int = EPOCHS) -> None:
        """index[cuts[i]:cuts[i + 1]]: features of row i. AdaGrad on logistic loss; L1 on w (proximal), L2 on v, of terms that aren't strong group lasso on v (proximal);
        classes of equal total weight up to a factor of 4."""
        n = len(y)
        pos = max(1, int(y.sum()))
        weight = np.where(y == 1, min(4.0, max(1.0, (n - pos) / pos)), 1.0)
        rate = pos / n
        self.w0 = float(np.log((rate + 1e-9) / (1 - rate + 1e-9)))
        gw, g0 = np.full(len(self.w), CALM), 1e-2
        gv = np.repeat(np.where(self.strong, 1e-2, CALM)[:, None], self.v.shape[1], axis=1)
        rng = np.random.default_rng(SEED)
        lasso = np.where(self.strong, 0.0, LASSO)[:, None]
        for epoch in range(epochs):
            self.active = self.strong | (epoch >= ALONE)
            order = rng.permutation(n)
            for lo in range(0, n, BATCH):
                docs = order[lo : lo + BATCH]
                size = cuts[docs + 1] - cuts[docs]
                total = int(size.sum())
                take = np.repeat(cuts[docs] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(total)
                i, r = index[take], np.repeat(np.arange(len(docs)), size)
                z = self.raw(i, r, len(docs))
                err = weight[docs] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[docs]) / len(docs)
                g0 += float(err.sum()) ** 2
                self.w0 -= RATE * float(err.sum()) / np.sqrt(g0)
                feats, back = np.unique(i, return_inverse=True)
                g = np.bincount(back, err[r], len(feats))
                gw[feats] += g * g
                step = RATE / np.sqrt(gw[feats])
                w = self.w[feats] - step * g
                self.w[feats] = np.sign(w) * np.maximum(np.abs(w) - step * L1, 0)
                on = self.active[i]
                if on.any():
                    ia, ra = i[on], r[on]
                    fa, ba = np.unique(ia, return_inverse=True)
                    v = self.v[fa]
                    grad = L2 * v.astype(np.float64)
                    for f in range(v.shape[1]):
                        mine = v[ba, f]
                        s = np.bincount(ra, mine, len(docs))
                        grad[:, f] += np.bincount(ba, err[ra] * (s[ra] - mine), len(fa))
                    gv[fa] += grad * grad
                    step = RATE / np.sqrt(gv[fa])
                    v = v - step * grad
                    size = np.sqrt((v * v).sum(axis=1, keepdims=True))
                    self.v[fa] = v * np.maximum(1 - step.mean(axis=1, keepdims=True) * lasso[fa] / np.maximum(size, 1e-12), 0)
        # Features without weight and factors add nothing.
        live = (self.w != 0) | (self.v != 0).any(axis=1)
        self.vocab, self.w, self.v = self.vocab[live], self.w[live], self.v[live]
        self.active = np.ones(len(self.vocab), bool)


def _spread(n: np.ndarray, pos: np.ndarray, docs: int, toxic: int) -> np.ndarray:
    """Chi-square statistic of each term's documents by class."""
    want = n * (toxic / max(docs, 1))
    return (pos - want) ** 2 / np.maximum(want * (1 - n / max(docs, 1)) * (1 - toxic / max(docs, 1)), 1e-9)


def learn(flat: np.ndarray, cuts: np.ndarray, y: np.ndarray) -> Machine:
    """A machine of rows of both classes: flat[cuts[i]:cuts[i + 1]] holds the hashed terms of row i, and in the end their features."""
    seen = np.zeros(1 << BITS, bool)
    seen[flat] = True
    vocab = np.flatnonzero(seen).astype(np.uint32)
    del seen
    model = Machine(vocab)
    n, pos = np.zeros(len(vocab)), np.zeros(len(vocab))
    # In pieces, as the driver has room for the terms about once.
    for lo in range(0, len(y), 256):
        hi = min(lo + 256, len(y))
        mine = np.searchsorted(vocab, flat[cuts[lo] : cuts[hi]])
        flat[cuts[lo] : cuts[hi]] = mine
        n += np.bincount(mine, minlength=len(vocab))
        pos += np.bincount(mine, np.repeat(y[lo:hi], np.diff(cuts[lo : hi + 1])), len(vocab))
    model.strong = _spread(n, pos, len(y), int(y.sum())) > STRONG
    model.fit(flat, cuts, y)
    return model


def fit(docs: DataFrame, labels: DataFrame, learn_from, sample: int = SAMPLE) -> Machine | None:
    """A machine fitted on some `sample` labelled rows at most; None where there aren't both classes. `learn_from`: a boolean
    Column over doc_id."""
    chosen = labels.where(learn_from & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # The share of the hash's range that holds `sample` rows but for chance: no order, and nothing but a count at the driver.
    share = min(1.0, sample / max(1, chosen.count()))
    chosen = chosen.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # Some `sample` rows of two numbers, so they may be broadcast.
    held = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")
    kind = st.StructType([st.StructField("doc_id", docs.schema["doc_id"].dataType), st.StructField("toxic", st.IntegerType()), st.StructField("ids", st.BinaryType())])
    found = c.cut(held.mapInArrow(_id_batches, kind))
    rows = []
    for r in found.toLocalIterator():  # a part at a time
        rows.append((r["doc_id"], int(r["toxic"] > 0), len(r["ids"]) // 4, zlib.crc32(r["ids"]), r["ids"]))
    # The same order however the table is partitioned.
    rows.sort(key=lambda r: r[:4])
    y = np.array([r[1] for r in rows], np.float64)
    if not len(y) or y.min() == y.max():
        return None
    cuts = np.concatenate([[0], np.cumsum([r[2] for r in rows])])
    flat = np.empty(cuts[-1], np.uint32)
    for i in range(len(rows)):
        flat[cuts[i] : cuts[i + 1]] = np.frombuffer(rows[i][4], np.uint32)
        rows[i] = None
    return learn(flat, cuts, y)


def _score_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for rows, data, offs in c.slices(batches, "text"):
            n = rows.num_rows
            score = np.zeros(n)
            if model is not None:
                h, r = terms(data, offs)
                at = model.find((h >> U64(64 - BITS)).astype(np.uint32))
                score = 1 / (1 + np.exp(-np.clip(model.raw(at[at >= 0], r[at >= 0], n), -40, 40)))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(score)], names=[*rows.schema.names, "score"])

    return run


def score(docs: DataFrame, model: Machine | None, keep: list[str]) -> DataFrame:
    """`keep` columns, text (null: empty) and score of each row of docs."""
    rows = docs.select(*keep, F.coalesce("text", F.lit("")).alias("text"))
    kind = st.StructType([*rows.schema.fields, st.StructField("score", st.DoubleType())])
    return rows.mapInArrow(_score_batches(docs.sparkSession.sparkContext.broadcast(model)), kind)


def learn_rows():
    return c.remainder("doc_id", 3) != 1


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels, learn_rows())
    scored = score(docs.withColumn("held_out", ~learn_rows()), model, ["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of docs, all columns as they are, that score below the threshold."""
    model = fit(docs, labels, learn_rows())
    rows, back = c.plain(docs, "doc_id", "text")
    kind = st.StructType([*rows.schema.fields, st.StructField("score", st.DoubleType())])
    return back(rows.mapInArrow(_score_batches(docs.sparkSession.sparkContext.broadcast(model)), kind).where(F.col("score") < threshold).drop("score"))


OP3_SQL = None
