"""The operators against brute force, and their edge cases: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import collections
import hashlib
import math
import os
import random
import re
import subprocess
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex
import tiktoken
import xxhash
from pyspark.sql import functions as F

from sparkshelf.llm import _common as c
from sparkshelf.llm import bpe, decontaminate, hilbert_ann, line_dedup, lm_score, simhash_dedup, span_dedup, token_counts, toxicity, url_rules

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "word " * 60_000
EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, "Éß\u00a0x \U0001f600 中文"), (7, LONG), (8, "same text here"), (9, "same text here"), (9, "same text here"), (None, "no id"), (None, None)]


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOW))


def frame(spark, rows, extra=True):
    """doc_id, text and columns whose names clash with those that operators make."""
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return df.withColumns({n: F.lit(7) for n in ("score", "line", "component_id", "ids", "hit_id", "lost", "removed", "fp", "key", "n_tokens")}) if extra else df


def corpus(n=120, seed=3):
    """Random texts with copies, near copies, shared lines and passages."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(400)]
    sentence = lambda: " ".join(r.choice(vocab) for _ in range(r.randint(3, 14))).capitalize() + "."
    shared = [" ".join(sentence() for _ in range(6)) for _ in range(4)]
    out = []
    for i in range(n):
        lines = [" ".join(sentence() for _ in range(r.randint(1, 5))) for _ in range(r.randint(1, 6))]
        if r.random() < 0.3:
            lines.insert(r.randrange(len(lines) + 1), r.choice(shared))
        if out and r.random() < 0.25:
            old = r.choice(out)[1]
            w = old.split(" ")
            if r.random() < 0.6:
                w[r.randrange(len(w))] = r.choice(vocab)
            lines = " ".join(w).split("\n")
        out.append((i, "\n".join(lines)))
    return out


@pytest.fixture(scope="module")
def texts():
    return corpus()


def union(edges, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


# Shared kernels


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(300, 360)] + [(r.randrange(250), r.randrange(250)) for _ in range(160)] + [(500, k) for k in range(501, 560)]
    want = union(edges, {x for e in edges for x in e})
    got = {x.node: x.root for x in c.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {n: k for n, k in want.items() if n in got} and set(got) == {x for e in edges if e[0] != e[1] for x in e}
    assert c.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_components_with_hubs(spark, seed):
    """Stars round a least, a middle and a greatest node, joined by chains: hubs are changed in place, with the same result."""
    r = random.Random(seed)
    edges = [(10, k) for k in range(1000, 2500)] + [(5000, k) for k in range(4000, 7000) if k != 5000] + [(20000, k) for k in range(12000, 14000)]
    edges += [(2499, 30000), (30000, 30001), (30001, 5), (6999, 40000), (40000, 12000)] + [(r.randrange(50000, 52000), r.randrange(50000, 52000)) for _ in range(900)]
    r.shuffle(edges)
    want = union(edges, {x for e in edges for x in e})
    got = {x.node: x.root for x in c.components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(7)).collect()}
    assert got == {n: k for n, k in want.items() if n in got} and set(got) == {x for e in edges if e[0] != e[1] for x in e}


@pytest.mark.parametrize("size", [0, 3, 5000])
def test_bloom_never_misses(spark, size):
    h = [int(x) for x in np.random.default_rng(1).integers(-(2**62), 2**62, size)]
    b = c.bloom(spark.createDataFrame([(x,) for x in h], "h bigint"), 1 << 12)
    assert c.may_hold(b, np.array(h, np.int64).view(np.uint64)).all()
    if size == 3:
        assert not c.may_hold(b, np.arange(1000, dtype=np.uint64)).any()


# 1


def lm_brute(rows, mu=lm_score.MU):
    learn = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 != 0
    uni, big, n_docs = collections.Counter(), collections.Counter(), 0
    for i, t in rows:
        if learn(i):
            w = ["<s>", *words(t), "</s>"]
            uni.update(w[1:])
            big.update(zip(w, w[1:]))
            n_docs += 1
    total, v = sum(uni.values()), len(uni)
    out = []
    for i, t in rows:
        w = ["<s>", *words(t), "</s>"]
        base = score = 0.0
        for a, b in zip(w, w[1:]):
            p1 = (uni[b] + 0.1) / (total + 0.1 * (v + 1))
            base += math.log10(p1)
            cu = n_docs if a == "<s>" else uni[a]
            q = big[a, b]
            est = 0.0
            if q:
                level = 1 + math.floor(math.log2(q) + 1e-9)
                est = (2 ** (level - 1) + 2**level - 1) / 2
            score += math.log10((min(est, uni[b], cu) + mu * p1) / (cu + mu))
        out.append((i, not learn(i), len(w) - 1, sum(uni[x] > 0 for x in w[1:]), total, base, score))
    return out


@pytest.mark.parametrize("limit", [1 << 30, 0])
def test_lm_scores(spark, texts, limit):
    rows = texts + EDGES
    got = lm_score.score(frame(spark, rows), c.remainder("doc_id", 10) != 0, broadcast_bytes=limit).collect()
    key = lambda r: (repr(r[0]), r[2], round(r[5], 4))
    want = sorted(lm_brute(rows), key=key)
    got = sorted(map(tuple, got), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert all(math.isclose(a[5], b[5], rel_tol=1e-9) for a, b in zip(got, want))
    # The filter never misses a level; its false positives, about 1 in 100 probes, raise a few counts.
    off = [(a[0], a[2], a[6], b[6]) for a, b in zip(got, want) if not b[6] - 1e-6 <= a[6] <= b[6] + 0.08 * abs(b[6]) + 1e-6]
    assert not off


def test_lm_shuffle_of_large_models(spark, tmp_path):
    """Beyond the broadcast limit all shuffles together write less than four times the table (F1)."""
    r = np.random.default_rng(2)
    vocab = np.array(["".join(map(chr, r.integers(97, 123, n))) for n in r.integers(3, 11, 20_000)])
    text = [" ".join(vocab[(20_000 ** r.random(150)).astype(int)]) for _ in range(8000)]
    spark.createDataFrame(list(enumerate(text)), "doc_id bigint, text string").coalesce(2).write.parquet(path := str(tmp_path / "docs"))
    docs, size = spark.read.parquet(path), sum(f.stat().st_size for f in (tmp_path / "docs").glob("*.parquet"))
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    learn, before = c.remainder("doc_id", 10) != 0, written()
    got = lm_score.score(docs, learn, broadcast_bytes=0).collect()
    assert 0 < written() - before < 4 * size
    # The same scores as with the model broadcast, also where ids and texts occur twice.
    assert [tuple(x)[:5] for x in sorted(got)] == [tuple(x)[:5] for x in sorted(lm_score.score(docs, learn).collect())]
    two = docs.limit(300).union(docs.limit(200))
    assert np.allclose(*([tuple(x) for x in sorted(lm_score.score(two, learn, broadcast_bytes=b).collect())] for b in (0, 1 << 30)), rtol=1e-12)


def test_lm_packed_hashes():
    r = np.random.default_rng(1)
    for n in (1, 2, 1000):
        h = np.unique(r.integers(0, 2**64, n, dtype=np.uint64) | c.U64(1 << 63))
        assert (lm_score._unpack(lm_score._pack(h)) == h).all()
        assert (lm_score._from_planes(lm_score._planes(h)) == h).all()
        b, cuts = lm_score._cuts(h, 7)
        assert [x for k, (i, j) in zip(b.tolist(), cuts) for x in [k] * (j - i)] == lm_score._bucket(h, 7).tolist()
    small = np.array([0, 300, 1], np.uint64)
    assert len(lm_score._planes(small)) == 7 and (lm_score._from_planes(lm_score._planes(small)) == small).all()


def test_lm_empty(spark):
    assert lm_score.score(frame(spark, []), c.remainder("doc_id", 10) != 0).count() == 0
    one = lm_score.score(frame(spark, [(1, None)]), F.lit(False)).collect()
    assert one[0].train_tokens == 0 and one[0].n_known == 0


# 2


def test_token_counts(spark, texts):
    ranks = bpe.read_ranks(bpe.default_vocabulary())
    z = sum(1 / (1 + k) for k in range(max(ranks.values()) + 1))
    log = {p: -math.log((r + 1) * z) for p, r in ranks.items()}
    import public_tokenizers

    pattern = regex.compile(public_tokenizers.PATTERN)

    def viterbi(b):
        best = [(0.0, 0)]
        for e in range(1, len(b) + 1):
            some = [(best[k][0] + log[b[k:e]], best[k][1] + 1) for k in range(max(0, e - 128), e) if b[k:e] in log]
            top = max(s for s, _ in some)
            best.append(min((x for x in some if x[0] > top - 1e-12), key=lambda x: x[1]))
        return best[-1]

    rows = texts[:30] + [e for e in EDGES if e[1] != LONG]
    got = collections.Counter((r.doc_id, r.n_pre_tokens, r.n_tokens, round(r.score, 4)) for r in token_counts.count(frame(spark, rows), bpe.default_vocabulary()).collect())
    want = collections.Counter()
    for i, t in rows:
        parts = [viterbi(m.encode()) for m in pattern.findall(t or "")]
        want[i, len(parts), sum(k for _, k in parts), round(sum(s for s, _ in parts), 4) + 0.0] += 1
    assert got == want
    assert token_counts.count(frame(spark, []), bpe.default_vocabulary()).count() == 0


def test_trie_shares_prefixes():
    pieces = token_counts.Pieces({bytes([b]): b for b in range(256)})
    data = np.frombuffer(b"abcdabceab", np.uint8)
    tokens, _, nodes = token_counts.forward(data, np.array([0, 4, 8]), np.array([4, 8, 10]), pieces)
    assert tokens.tolist() == [4, 4, 2] and nodes == 5


# 3


def test_toxicity_learns_interaction(spark):
    """Insult or group alone is fine, both together are toxic: no additive weights tell these apart as well."""
    r = random.Random(2)
    filler = ["".join(r.choice("qwertyu") for _ in range(6)) for _ in range(60)]
    rows, labels = [], []
    for i in range(1600):
        a, b = r.random() < 0.5, r.random() < 0.5
        w = [r.choice(filler) for _ in range(12)] + ["zzinsult"] * a + ["xxgroup"] * b
        r.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(a and b)))
    docs, lab = frame(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(docs, lab, toxicity.learn_rows())
    got = {x.doc_id: x.s for x in toxicity.score(docs.select("doc_id", "text"), model, ["doc_id"]).withColumnRenamed("score", "s").collect()}
    held = [(i, y) for i, _, y in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((got[i] >= 0.7) == bool(y) for i, y in held) > 0.97 * len(held)


def test_toxicity_learns_pairs_of_neutral_terms(spark):
    """Exactly one of two words makes a text toxic: each alone is equally frequent in both classes."""
    r = random.Random(2)
    filler = ["".join(r.choice("qwertyu") for _ in range(6)) for _ in range(60)]
    rows, labels = [], []
    for i in range(2400):
        a, b = i % 2, i // 2 % 2
        w = [r.choice(filler) for _ in range(12)] + ["zzinsult"] * a + ["xxgroup"] * b
        r.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(a != b)))
    docs, lab = frame(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(docs, lab, toxicity.learn_rows())
    got = {x.doc_id: x.s for x in toxicity.score(docs.select("doc_id", "text"), model, ["doc_id"]).withColumnRenamed("score", "s").collect()}
    held = [(i, y) for i, _, y in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((got[i] >= 0.7) == bool(y) for i, y in held) > 0.97 * len(held)


def terms_brute(text):
    """Distinct words and word beginnings, as bytes; the two kinds apart."""
    out = set()
    for w in re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().translate(bytes(c.LOWER))):
        out |= {(0, w)} | {(k, w[:k]) for k in toxicity.STEMS if len(w) > k}
    return out


def test_toxicity_terms_and_sums(texts):
    """Terms and the machine's sum against plain loops: bias, weights and every pair of features."""
    rows = [t for _, t in texts[:20]] + ["", None, "one", "Éclair éclair ÉCLAIR", "a-b_c 12ab", "wordword " * 50]
    raws = [(t or "").encode() for t in rows]
    h, row = toxicity.terms(np.frombuffer(b"".join(raws), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raws])]))
    names = {}
    for i, t in enumerate(rows):
        mine = h[row == i].tolist()
        want = terms_brute(t)
        assert len(mine) == len(set(mine)) == len(want)
        for x in mine:
            names.setdefault(x, []).append(i)
    # A hash stands for one term: both occur in the same rows.
    assert sorted(names.values()) == sorted([i for i, t in enumerate(rows) if x in terms_brute(t)] for x in set().union(*map(terms_brute, rows)))
    r = np.random.default_rng(1)
    model = toxicity.Machine(np.unique((h >> np.uint64(40)).astype(np.uint32)))
    model.w0, model.w, model.v = -0.5, r.normal(size=len(model.vocab)).astype(np.float32), r.normal(size=(len(model.vocab), 4)).astype(np.float32)
    at = model.find((h >> np.uint64(40)).astype(np.uint32))
    got = model.raw(at, row, len(rows))
    for i in range(len(rows)):
        mine = at[row == i].tolist()
        want = model.w0 + sum(float(model.w[k]) for k in mine) + sum(float(model.v[a] @ model.v[b]) for x, a in enumerate(mine) for b in mine[x + 1 :])
        assert abs(got[i] - want) < 1e-2 * max(1, abs(want))


def test_toxicity_query(spark, sf):
    """All documents, whole texts; held_out and predicted as defined; held-out labels and other columns change nothing."""
    got = {r.doc_id: r for r in toxicity.op3_toxicity(spark, sf).collect()}
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    assert set(got) == {r.doc_id for r in docs.select("doc_id").collect()}
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    other = labels.withColumn("toxic", F.when(toxicity.learn_rows(), F.col("toxic")).otherwise(1 - F.col("toxic")))
    changed = docs.withColumns({"lang": F.lit("x"), "source": F.lit("y"), "a`b": F.lit(1)}).repartition(3)
    model = toxicity.fit(changed, other, toxicity.learn_rows())
    again = {r.doc_id: r.score for r in toxicity.score(changed, model, ["doc_id"]).collect()}
    assert all(abs(again[i] - r.score) < 1e-9 for i, r in got.items())
    assert toxicity.drop_toxic(changed, other).columns == changed.columns


def test_toxicity_edges(spark):
    lab = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (4, 0, None), (None, 0, 1), (99, 0, 1)], "doc_id bigint, quality int, toxic int")
    docs = frame(spark, EDGES)
    assert toxicity.drop_toxic(docs, lab).columns == docs.columns
    none = toxicity.fit(docs, lab.limit(0), toxicity.learn_rows())
    assert none is None and {r.score for r in toxicity.score(docs.drop("score"), none, ["doc_id"]).collect()} == {0.0}
    assert toxicity.drop_toxic(frame(spark, []), lab).count() == 0


# 4


def sentences(t):
    out, prev = [], None
    for m in re.finditer("[^\x20\x09-\x0d]+", t or ""):
        if prev is None or prev.group()[-1] in ".!?" or "\n" in t[prev.end() : m.start()]:
            out.append([])
        out[-1].append(m)
        prev = m
    return out


def spans_brute(rows, signed_key):
    """(id, text): (sentences, lost, what is left); rows equal in both are one, others of one id are apart."""
    keyed = {(i is not None, i, signed_key[t or ""], t or "") for i, t in rows}
    split = {k: sentences(k[3]) for k in keyed}
    places = collections.defaultdict(set)
    for k, s in split.items():
        for n, least in span_dedup.RUNS.items():
            for a in range(len(s) - n + 1):
                run = tuple(tuple(m.group() for m in x) for x in s[a : a + n])
                if sum(map(len, run)) >= least:
                    places[n, run].add((k, a))
    lost = collections.defaultdict(set)
    for (n, _), at in places.items():
        for k, a in sorted(at, key=lambda x: (x[0][0], x[0][1] or 0, x[0][2], x[1]))[1:]:
            lost[k].update(range(a, a + n))
    out = {}
    for k, s in split.items():
        t = k[3]
        edge, at, left = [x[0].start() for x in s] + [len(t)], 0, ""
        for x in sorted(lost[k]):
            left += t[at : edge[x]]
            at = edge[x + 1]
        out[k[1], t] = (len(s), len(lost[k]), left + t[at:])
    return out


def text_keys(spark, rows):
    """The hash by which rows of one id are told apart."""
    return {r.text: r.k for r in spark.createDataFrame([(t or "",) for _, t in rows], "text string").select("text", c.row_key().alias("k")).collect()}


def test_span_dedup(spark, texts):
    want = spans_brute(texts, text_keys(spark, texts))
    got = span_dedup.dedup(frame(spark, texts)).collect()
    assert {r.doc_id: (r.n_sentences, r.n_removed, r.text) for r in got} == {i: x for (i, _), x in want.items()}
    assert sum(n for _, n, _ in want.values()) > 50


def test_span_dedup_rows_of_one_id(spark, texts):
    """Rows that share an id, or have none, are documents of their own."""
    rows = [(None if i % 5 == 0 else i % 11, t) for i, t in texts] + [(None, None), (3, "Hi there."), (3, "")]
    want = spans_brute(rows, text_keys(spark, rows))
    got = span_dedup.dedup(frame(spark, rows)).select("doc_id", "n_sentences", "n_removed", "text").collect()
    assert sorted((r.n_sentences, r.n_removed, r.text, str(r.doc_id)) for r in got) == sorted((*want[i, t or ""], str(i)) for i, t in rows)
    passage = "Alpha beta gamma delta. Epsilon zeta eta theta iota. Kappa lambda mu nu xi omicron."
    for i in (5, None):
        rows = [(i, "Start here now. " + passage), (i, "Hi there."), (1, passage)]
        out = {r.text for r in span_dedup.dedup(frame(spark, rows)).collect()}
        assert "Hi there." in out and (passage in out) == (i is not None)


def test_span_dedup_many_equal_rows(spark):
    """Equal rows are one place, however many they are; a smaller id with the passage makes each of them lose it."""
    passage = "Alpha beta gamma delta. Epsilon zeta eta theta iota. Kappa lambda mu nu xi omicron."
    rows = [(7, passage)] * 400
    assert {r.text for r in span_dedup.dedup(frame(spark, rows)).collect()} == {passage}
    assert {(r.doc_id, r.text) for r in span_dedup.dedup(frame(spark, [*rows, (2, passage)])).collect()} == {(2, passage), (7, "")}


def test_span_dedup_edges(spark):
    assert span_dedup.dedup(frame(spark, EDGES)).count() == len(EDGES)
    assert span_dedup.dedup(frame(spark, [])).count() == 0
    passage = "Alpha beta gamma delta. Epsilon zeta eta theta iota. Kappa lambda mu nu xi omicron."
    rows = [(1, "Start here now. " + passage), (2, passage + " Other end here."), (2, passage + " Other end here.")]
    got = sorted((r.doc_id, r.text) for r in span_dedup.dedup(frame(spark, rows)).collect())
    assert got == [(1, rows[0][1]), (2, "Other end here."), (2, "Other end here.")]


def planted_passages(seed=17):
    """(rows, want): passages of over 50 words, each in two documents amid text of their own, and for the second one the
    sentences that lie in the passage as a whole. Sentences are of 1 to 60 words; both ends are cut anywhere."""
    r = random.Random(seed)
    fresh = lambda k: ["".join(r.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(k)]
    rows, want = [], {}
    for k, sizes in enumerate([[1] * 80, [2] * 40, [1, 2] * 30, [6, 1, 1, 1] * 10, [12, 39, 12], [14, 24, 15], [20, 5, 6, 22], [22, 2, 3, 1, 25], [30, 1, 30], [9, 9, 9, 9, 9, 9], [60, 30], [3, 50, 3]] * 3):
        passage, ends = [], []
        for n in sizes:
            passage += fresh(n)
            passage[-1] += r.choice([".", "!!", "?"])
            ends.append(len(passage))
        a = r.randint(0, min(sizes[0] - 1, len(passage) - 51))
        b = min(len(passage), max(a + 51, len(passage) - r.randint(0, sizes[-1] - 1)))
        for side in (0, 1):
            before, after = fresh(r.randint(1, 30)), fresh(r.randint(1, 30))
            before[-1] += "" if a else "."
            rows.append((2 * k + side, " ".join([*before, *passage[a:b], *after]) + "."))
        want[2 * k + 1] = [" ".join(passage[i:j]) for i, j in zip([0, *ends], ends) if a <= i and j <= b]
    return rows, want


def test_span_dedup_planted_passages(spark):
    """Whatever the length of its sentences and wherever it is cut, a passage loses its whole sentences in the second document, and nothing else."""
    rows, want = planted_passages()
    out = {x.doc_id: x for x in span_dedup.dedup(frame(spark, rows)).collect()}
    for i, text in rows:
        left = text
        for x in want.get(i, []):
            left = left.replace(x + " ", "", 1)
        assert out[i].text == left and out[i].n_removed == len(want.get(i, []))
    assert sum(map(len, want.values())) > 300


# 5


def jaccard_windows(item, doc):
    """Best weighted Jaccard of any window of the item's size."""
    a, b = words(item), words(doc)
    n = len(a)

    def bag(w):
        return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])

    A, best = bag(a), 0.0
    if len(b) >= n >= 5 and not A.keys() & bag(b).keys():
        return 0.0
    for s in range(max(1, len(b) - n + 1)):
        B = bag(b[s : s + n])
        low = sum((A & B).values())
        best = max(best, low / max(1, sum((A | B).values())))
    return best


def test_decontamination(spark, texts):
    r = random.Random(4)
    items, rows = [], []
    for k in range(12):
        src = words(texts[k * 7][1])
        n = min(len(src), r.choice([2, 3, 5, 9, 20, 40]))
        items.append((k, " ".join(src[:n])))
    rows = [(i, t) for i, t in texts[60:]]
    for k, t in items:
        w = t.split()
        for edit in (0, 1, 3):
            v = list(w)
            for _ in range(edit):
                v[r.randrange(len(v))] = "edited"
            rows.append((1000 + 10 * k + edit, "lead in words " + " ".join(v) + " and the rest follows"))
    want = {(i, k): s for i, t in rows for k, x in items if (s := jaccard_windows(x, t)) >= 0.8}
    bench = spark.createDataFrame(items + [(50, None), (51, "")], "item_id bigint, text string")
    for limit in (decontaminate.BROADCAST_BYTES, 200_000):
        got = {(x.doc_id, x.item_id): x.similarity for x in decontaminate.matches(frame(spark, rows), bench, limit).collect()}
        assert set(got) == set(want) and all(math.isclose(got[k], want[k]) for k in want)
    assert len(want) > 20


def test_decontamination_edges(spark):
    bench = spark.createDataFrame([(1, "a benchmark item of some seven words")], "item_id bigint, text string")
    docs = frame(spark, EDGES + [(20, "x a benchmark item of some seven words y")])
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(EDGES)
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == len(EDGES) + 1
    assert decontaminate.matches(frame(spark, []), bench).count() == 0


def test_hamming_index_is_complete():
    r = np.random.default_rng(3)
    index = decontaminate.Index([(k, " ".join(map(str, r.integers(0, 1000, 30)))) for k in range(60)])
    for _ in range(200):
        f = int(index.prints[r.integers(60)])
        for b in r.choice(64, r.integers(0, 25), replace=False):
            f ^= 1 << int(b)
        assert index.within(f) == [k for k, p in enumerate(index.prints.tolist()) if (p ^ f).bit_count() <= decontaminate.RADIUS]


# 6


def lines_brute(rows):
    places = {}
    for i, t in rows:
        for k, x in enumerate((t or "").split("\n")):
            if x.strip(" \t\n\x0b\x0c\r"):
                places.setdefault(x, set()).add((i, k))
    keys = list(places)
    sets = [{b[j : j + 8] for j in range(len(b) - 7)} if len(b) >= 8 else {b} for b in (k.encode() for k in keys)]
    # Every pair that shares a shingle, by counting; others have similarity 0.
    holders, edges = collections.defaultdict(list), []
    for j, mine in enumerate(sets):
        both = collections.Counter(i for x in mine for i in holders[x])
        edges += [(i, j) for i, n in both.items() if n >= 0.8 * (len(sets[i]) + len(mine) - n)]
        for x in mine:
            holders[x].append(j)
    root = union(edges, range(len(keys)))
    kept = {}
    for i, k in enumerate(keys):
        kept[root[i]] = min(kept.get(root[i], (10**9, 0)), min(places[k]))
    return {p for i, k in enumerate(keys) for p in places[k] if p != kept[root[i]]}


def test_line_dedup(spark, texts):
    want = lines_brute(texts)
    got = [(r.doc_id, r.number) for r in line_dedup.removals(frame(spark, texts)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 30
    docs = frame(spark, texts).withColumn("n_chars", F.length("text").cast("bigint"))
    out = line_dedup.drop_repeated_lines(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        left = [x for k, x in enumerate(dict(texts)[r.doc_id].split("\n")) if (r.doc_id, k) not in want]
        assert r.text == "\n".join(left) and r.n_chars == len(r.text)


def test_line_dedup_large_set(spark, monkeypatch):
    """A set of more members than a chunk is compared in pairs of chunks, and loses no link."""
    monkeypatch.setattr(line_dedup, "CHUNK", 8)
    base = "the quick brown fox jumps over the lazy dog again and again until the evening comes to the quiet town"
    rows = [(i, base + " " + chr(97 + i % 26) * (1 + i // 26)) for i in range(40)]
    assert {(r.doc_id, r.number) for r in line_dedup.removals(frame(spark, rows)).collect()} == lines_brute(rows)


def test_line_dedup_joins_small_sets():
    """Sets of one least member are compared as one: before, what they share was shuffled and compared again for each."""
    rows = [(5, [5, 7, 9]), (5, [5, 7]), (5, [5, 9, 11]), (6, [6, 8])]
    batch = pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows]), *(pa.array([np.array(m, t).tobytes() for _, m in rows], pa.binary()) for t in (np.int64, np.uint8))], names=["set", "members", "sizes"])
    got = [(r["line"], r["task"]) for b in line_dedup._memberships(iter([batch])) for r in b.to_pylist()]
    assert sorted(x for x, _ in got) == [5, 6, 7, 8, 9, 11] and len({t for _, t in got}) == 2


def test_line_dedup_matrix(monkeypatch):
    """The same lines are joined whether shared shingles are counted by matrix or by lists."""
    rng = np.random.default_rng(5)
    base = [bytes(rng.integers(97, 123, n).tolist()) for n in (5, 9, 60, 400)]
    bodies = [b[: len(b) - k] + b"~" * (k % 3) for b in base for k in range(0, len(b) // 3, 3)] + [b"x"] * 2

    def joined() -> list[int]:
        forest = c.Forest(len(bodies))
        links = list(line_dedup.linked(bodies))
        assert all(forest.join(i, k) for i, k in links)  # a forest
        return [forest.root(i) for i in range(len(bodies))]

    by_matrix = joined()
    monkeypatch.setattr(line_dedup, "MATRIX_CELLS", 0)
    assert joined() == by_matrix and 1 < len(set(by_matrix)) < len(bodies)


def test_line_dedup_edges(spark):
    docs = frame(spark, EDGES)
    out = line_dedup.drop_repeated_lines(docs)
    assert out.count() == len(EDGES) and out.columns == docs.columns
    assert sorted(r.text for r in out.where("doc_id in (8, 9)").collect()) == ["", "", "same text here"]
    assert line_dedup.drop_repeated_lines(frame(spark, [])).count() == 0


def test_line_dedup_worker_memory():
    """What workers have used goes back to the system, and few are started: they share the executor's memory with a grown heap."""
    code = """
import os, re, numpy as np, pandas as pd
from pathlib import Path
from pyspark.sql import SparkSession
from sparkshelf.llm import line_dedup
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
r = np.random.default_rng(1)
words = np.array(["".join(map(chr, r.integers(97, 123, 6))) for _ in range(20_000)])
lines = [" ".join(words[r.integers(0, len(words), 12)]) for _ in range(30_000)]
lines += [x + " end" for x in lines[:10_000]]
texts = ["\\n".join(lines[i] for i in r.integers(0, len(lines), 35)) for _ in range(4_000)]
docs = spark.createDataFrame(pd.DataFrame({"doc_id": range(4_000), "text": texts})).coalesce(2)
assert line_dedup.removals(docs).count() > 100_000
held = []
for p in Path("/proc").glob("[0-9]*"):
    try:
        up, name = re.search(r"PPid:\\s+(\\d+)", (p / "status").read_text())[1], (p / "cmdline").read_text()
        if "pyspark.daemon" in name and "pyspark.daemon" in Path(f"/proc/{up}/cmdline").read_text() and os.getsid(int(p.name)) == os.getsid(0):
            held.append(int(re.search(r"Pss_Anon:\\s+(\\d+)", (p / "smaps_rollup").read_text())[1]) / 1024)
    except OSError:
        pass
print(len(held), sum(held))
"""
    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=os.path.dirname(os.path.dirname(os.path.dirname(__file__))), start_new_session=True)
    workers, held = map(float, got.stdout.split()) if got.stdout else (0, 0)
    assert workers and held < 320, got.stdout + got.stderr


# 7


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumns({"query": F.lit(1), "cid": F.lit(2), "rank": F.lit(0)})


def test_ann_recall_and_ties(spark):
    r = np.random.default_rng(7)
    x = r.standard_normal((1500, 24)).astype(np.float32)
    x[300:700] = x[300]  # a large group of equal vectors
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(5000, None), (5050, [0.0] * 24), (5100, [float("nan")] + [1.0] * 23), (5150, [None] + [1.0] * 23), (None, x[0].tolist()), (5200, [1.0, 2.0]), (0, x[0].tolist())]
    got = collections.defaultdict(list)
    for q in hilbert_ann.search(vectors(spark, rows), F.col("vec_id") % 50 == 0).collect():
        got[q.query_id].append((q.rank, q.vec_id, q.score))
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    hits = 0
    for q in range(0, 1500, 50):
        s = np.round(u @ u[q], 12)
        s[q] = -9
        want = np.lexsort((np.arange(1500), -s))[:5].tolist()
        mine = [v for _, v, _ in sorted(got[q])]
        assert [k for k, _, _ in sorted(got[q])] == [1, 2, 3, 4, 5]
        hits += len(set(want) & set(mine))
        if 300 <= q < 700:
            assert mine == want
    assert set(got) == set(range(0, 1500, 50)) and hits >= 0.9 * 150


def test_ann_small(spark):
    few = hilbert_ann.search(vectors(spark, [(0, [1.0, 0.0]), (1, [0.6, 0.8]), (50, [0.0, 2.0])]), F.col("vec_id") % 50 == 0)
    assert sorted((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in few.collect()) == [(0, 1, 1, 0.6), (0, 2, 50, 0.0), (50, 1, 1, 0.8), (50, 2, 0, 0.0)]
    assert hilbert_ann.search(vectors(spark, []), F.lit(True)).count() == 0
    assert hilbert_ann.search(vectors(spark, [(1, [1.0, 2.0])]), F.lit(True)).count() == 0


def test_hilbert_visits_every_cell_by_neighbours():
    grid = np.array([(a, b, d) for a in range(8) for b in range(8) for d in range(8)])
    order = grid[np.argsort(hilbert_ann.hilbert(grid, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


# 8


def fingerprint(t):
    w = words(t)
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_groups(spark, texts):
    rows = texts + EDGES
    got = simhash_dedup.groups(frame(spark, rows)).collect()
    prints = [(i, fingerprint(t)) for i, t in rows]
    assert sorted((repr(r.doc_id), r.fp % 2**64) for r in got) == sorted((repr(i), f) for i, f in prints)
    fps = sorted({f for _, f in prints})
    root = union([(a, b) for k, a in enumerate(fps) for b in fps[k + 1 :] if (a ^ b).bit_count() <= 3], fps)
    least = {}
    for i, f in prints:
        if i is not None:
            least[root[f]] = min(least.get(root[f], i), i)
    assert all(r.component_id == least.get(root[r.fp % 2**64]) for r in got)


def test_trie_join_is_complete():
    r = np.random.default_rng(5)
    base = r.integers(0, 2**63, 60, dtype=np.uint64)
    a = np.unique(np.concatenate([base] + [base ^ np.uint64(sum(1 << int(b) for b in r.choice(64, r.integers(0, 6), replace=False))) for _ in range(6)]))
    want = {(i, j) for i in range(len(a)) for j in range(i + 1, len(a)) if int(a[i] ^ a[j]).bit_count() <= 3}
    got = [(int(i), int(j)) for x, y in simhash_dedup.trie_join(a, a, 0, 3) for i, j in zip(x, y)]
    assert set(got) == want and len(got) == len(want)
    left, right = a[: len(a) // 2], a[len(a) // 3 :]
    got = {(int(i), int(j)) for x, y in simhash_dedup.trie_join(left, right, 0, 3, most=50) for i, j in zip(x, y)}
    assert got == {(i, j) for i in range(len(left)) for j in range(len(right)) if int(left[i] ^ right[j]).bit_count() <= 3}


def test_simhash_large_subtree(spark, monkeypatch):
    """A subtree of more fingerprints than a block meets itself in chunks."""
    monkeypatch.setattr(simhash_dedup, "BLOCK", 16)
    r = random.Random(9)
    fps = sorted({0x0123456789ABCDEF ^ sum(1 << b for b in r.sample(range(40), r.randint(0, 7))) for _ in range(150)})
    want = union([(a, b) for k, a in enumerate(fps) for b in fps[k + 1 :] if (a ^ b).bit_count() <= 3], fps)
    edges = [(x.a % 2**64, x.b % 2**64) for x in simhash_dedup.links(spark.createDataFrame([(f,) for f in fps], "fp bigint")).collect()]
    got = union(edges, fps)
    assert {frozenset(k for k in fps if got[k] == got[n]) for n in fps} == {frozenset(k for k in fps if want[k] == want[n]) for n in fps}
    assert all((a ^ b).bit_count() <= 64 for a, b in edges)


def test_keep_first(spark):
    docs = frame(spark, EDGES)
    out = simhash_dedup.keep_first(docs)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert 8 in ids and 9 not in ids and ids.count(1) == 1 and 2 not in ids and 3 not in ids
    assert simhash_dedup.keep_first(frame(spark, [])).count() == 0


#: Rows that share an id, or have none, and nothing else.
SHARED = [(None, "alpha beta gamma delta epsilon zeta\nfirst line of one"), (None, "entirely other words stand in this row\nsecond line of two"), (None, "and a third text is here as well"), (5, "five has one text of its own here"), (5, "quite another text under the same number"), (6, "and a third text is here as well"), (None, "only this group has no id at all"), (None, "only this group has no id at all")]


def test_rows_of_one_id(spark):
    """Rows that share an id are told apart: of each group of copies one row stays, and one row's removals leave the others alone."""
    docs = frame(spark, SHARED)
    kept = simhash_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r.text, r.doc_id) for r in kept.collect()) == sorted((t, i) for i, t in {*SHARED} - {(None, "and a third text is here as well")})
    lines = [(None, "own start of one\nshared closing line of all"), (None, "another start of two\nwhole second line of two"), (1, "shared closing line of all")]
    out = line_dedup.drop_repeated_lines(frame(spark, lines))
    assert sorted(r.text for r in out.collect()) == sorted([lines[0][1], lines[1][1], ""])
    lines = [(0, "shared closing line of all"), *((9, t) for _, t in lines[:2])]
    out = line_dedup.drop_repeated_lines(frame(spark, lines))
    assert sorted(r.text for r in out.collect()) == sorted(["own start of one", lines[2][1], lines[0][1]])
    bench = spark.createDataFrame([(1, "five has one text of its own here")], "item_id bigint, text string")
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and sorted(r.text for r in left.collect()) == sorted(t for _, t in SHARED if t != SHARED[3][1])
    hit = decontaminate.drop_contaminated(frame(spark, SHARED[:3]), spark.createDataFrame([(1, SHARED[2][1])], "item_id bigint, text string"))
    assert sorted(r.text for r in hit.collect()) == sorted(t for _, t in SHARED[:2])


# 9


def test_url_rules(spark):
    rows = [
        (1, None), (2, ""), (3, "no scheme"), (4, "http://Example.COM/en/x"), (5, "https://www.example.com/en/"), (6, "https://a.b.example.com/en/q?x=http://net/es/"),
        (7, "http://x.net/es/1"), (8, "http://x.net/esx"), (9, "http://net/fr/#a"), (10, "http://com"), (11, "http://com/"), (12, "http://notcom/"), (13, "http://www.example.com/EN/"),
        (14, "x://y.example.com?en/"), (15, "http://.com/a"), (None, "http://b.net/fr/2"), (7, "http://x.net/es/1"),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string").withColumns({"rule": F.lit("r"), "host": F.lit(1), "verdict": F.lit(2)})
    rules = url_rules.rule_table(spark, url_rules.RULES)
    got = sorted((repr(r.page_id), r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(pages, rules).collect())

    def brute(url):
        host = path = ""
        if url and "://" in url:
            m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
            host, path = m[1].translate(LOW), m[2]
        fits = [(len(r), r, v) for r, v in url_rules.RULES for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        return (host, path, *(max(fits)[1:] if fits else (None, url_rules.DEFAULT)))

    assert got == sorted((repr(i), *brute(u)) for i, u in rows)
    none = url_rules.rule_table(spark, [("x.org/", "block")]).limit(0)
    assert {r.rule for r in url_rules.judge(pages, none).collect()} == {None}
    assert url_rules.judge(pages.limit(0), rules).count() == 0


# 10


@pytest.fixture(scope="module")
def reference_encoding():
    import public_tokenizers

    ranks = bpe.read_ranks(bpe.default_vocabulary())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), bpe.Codec(ranks)


def test_bpe_matches_library(reference_encoding):
    lib, own = reference_encoding
    r = random.Random(5)
    alphabet = [*"aZé'’ strevldm09²\n\t  ,.!-_ßñ中😀'", "'ll", "\u3000", "\x85", "\u200c", " the", "ing"]
    for _ in range(1500):
        t = "".join(r.choice(alphabet) for _ in range(r.randint(0, 40)))
        ids = own.encode(t)
        assert ids == lib.encode_ordinary(t) and own.decode(ids).decode() == t


def test_bpe_perfect_hash_is_minimal(reference_encoding):
    own = reference_encoding[1]
    assert len(own.slots) == len(own.ranks) and set(own.slots) == set(own.ranks)


def test_bpe_short_words_merge_in_a_list(reference_encoding):
    """The same ids as by the heap, which is kept for long words only; before, every word built one."""
    codec = reference_encoding[1]
    rng = np.random.default_rng(5)
    words = [bytes(rng.choice(list(b"aabetr \xd9\x84nnxq0"), n).tolist()) for n in [1, 2, 3, *range(4, 70)] * 4]
    by_heap = [codec.merge_by_heap(w) for w in words]
    codec.merge_by_heap = None
    assert [codec.merge(w) for w in words if len(w) <= bpe.SHORT] == [x for w, x in zip(words, by_heap) if len(w) <= bpe.SHORT]
    del codec.merge_by_heap
    assert [codec.merge(w) for w in words] == by_heap


def test_bpe_worker_memory():
    """A worker keeps little more than what it remembers, whatever it has encoded: it shares the executor's memory with a grown heap."""
    code = """
import re, numpy as np, pyarrow as pa
from sparkshelf.llm import bpe
held = lambda: int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024
class Shared: value = bpe.Codec(bpe.read_ranks(bpe.default_vocabulary()))
r = np.random.default_rng(1)
words = np.array(["".join(map(chr, r.integers(97, 123, 9))) for _ in range(150_000)])
text = [" ".join(words[r.integers(0, len(words), 200)]) for _ in range(3000)]
batch = pa.record_batch({"doc_id": pa.array(range(3000)), "text": pa.array(text)})
next(bpe._digest_batches(Shared)(iter([batch.slice(0, 1)])))
before = held()
assert sum(x.num_rows for x in bpe._digest_batches(Shared)(iter([batch]))) == 3000
print(held() - before)
"""
    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=200, cwd=os.path.dirname(os.path.dirname(os.path.dirname(__file__))))
    assert float(got.stdout) < 45, got.stderr


def test_bpe_digests(spark, reference_encoding):
    lib = reference_encoding[0]
    rows = EDGES + [(30, "x" * 3000 + " " * 50)]
    got = collections.Counter(map(tuple, bpe.digests(frame(spark, rows), bpe.default_vocabulary()).collect()))
    want = collections.Counter()
    for i, t in rows:
        ids = lib.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert got == want
    both = bpe.decode(bpe.encode(frame(spark, rows), bpe.default_vocabulary()), bpe.default_vocabulary()).collect()
    assert collections.Counter(r.decoded for r in both) == collections.Counter(t or "" for _, t in rows)
    assert bpe.digests(frame(spark, []), bpe.default_vocabulary()).count() == 0


# Pipeline


def test_pipeline_stages(spark, sf):
    """Each stage, judged on its own input, against brute force."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, sf)
        rows = out.collect()
        ids = {r.doc_id for r in rows}
        if name == "line_dedup":
            gone = lines_brute(sorted(before.items()))
            assert {r.doc_id: r.text for r in rows} == {i: (lambda x: x if x.strip(" \t\n\x0b\x0c\r") else "" if any((i, k) in gone for k in range(len(t.split("\n")))) else x)("\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)) for i, t in before.items()}
        if name == "simhash_near_dedup":
            prints = {i: fingerprint(t) for i, t in before.items()}
            fps = sorted(set(prints.values()))
            root = union([(a, b) for k, a in enumerate(fps) for b in fps[k + 1 :] if (a ^ b).bit_count() <= 3], fps)
            least = {}
            for i, f in prints.items():
                least[root[f]] = min(least.get(root[f], i), i)
            assert ids == set(least.values())
        if name == "benchmark_decontamination":
            assert ids == {i for i, t in before.items() if not any(jaccard_windows(x, t) >= 0.8 for x in items)}
        if name != "byte_bpe":
            assert out.columns == columns
            docs = spark.createDataFrame(rows, out.schema)
    assert len(rows) == len(before) and corpus_pipeline.run(spark, sf).count() == len(rows)
