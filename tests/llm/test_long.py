"""Very long inputs cost time in proportion to their length, and repetitive ones find their like."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkshelf.llm import bpe, line_dedup, token_counts, url_rules
from tests.llm.test_llm import frame, lines_brute

MB = 1 << 20


def test_long_host(spark):
    rows = [(1, "http://" + "a." * (MB // 2) + "www.Example.com/en/x"), (2, "http://" + "b" * MB + ".net/es/" + "y" * MB), (3, "http://" + "." * 5000 + "/")]
    spark.createDataFrame(rows, "page_id bigint, url string").count()
    began = time.time()
    got = {r.page_id: (r.rule, r.verdict, len(r.host), len(r.path)) for r in url_rules.judge(spark.createDataFrame(rows, "page_id bigint, url string"), url_rules.rule_table(spark, url_rules.RULES)).collect()}
    assert time.time() - began < 10
    assert got == {1: ("www.example.com/en/", "allow", MB + 15, 5), 2: ("net/es/", "block", MB + 4, MB + 4), 3: (None, "allow", 5000, 1)}


def test_long_pre_token():
    pieces = token_counts.Pieces(bpe.read_ranks(bpe.default_vocabulary()))
    r = random.Random(4)
    # The same recurrence as along the trie, at lengths that both can take.
    for text in ("a" * 2500, "".join(r.choice("etaoin") for _ in range(3000)), " the" * 300 + "é" * 700, "x"):
        data = np.frombuffer(text.encode(), np.uint8)
        tokens, score, _ = token_counts.forward(data, np.array([0]), np.array([len(data)]), pieces)
        for block in (1 << 16, 100):
            got = token_counts.forward_alone(data, pieces, block)
            assert got[0] == tokens[0] and abs(got[1] - score[0]) < 1e-6
    data = np.frombuffer("".join(r.choice("etaoinshrdlu") for _ in range(MB)).encode(), np.uint8)
    began = time.time()
    tokens, _ = token_counts.forward_alone(data, pieces)
    assert time.time() - began < 10 and MB / 8 < tokens < MB


def test_long_lines(spark):
    r = random.Random(5)
    long = "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(MB))
    other = "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(MB))
    near = long[: MB // 2] + "!" + long[MB // 2 + 1 :]
    rows = [(1, long), (2, near), (3, other), (4, "short\n" + near)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    line_dedup.removals(docs.limit(0)).count()
    began = time.time()
    got = sorted((x.doc_id, x.number) for x in line_dedup.removals(docs).collect())
    assert got == [(2, 0), (4, 1)]
    assert time.time() - began < 40  # some twenty small jobs, on a slow machine too


def test_repetitive_lines(spark):
    """Lines of few different shingles are alike whatever their lengths."""
    rows = [(k, x * n) for k, (x, n) in enumerate((x, n) for x in ("-", "=", "ab", "= - ") for n in (9, 20, 35, 60, 90, 150, 700, 30000))]
    rows += [(100 + n, "".join(chr(97 + k % 26) for k in range(n))) for n in (30, 40, 60, 70, 80, 100, 200)]
    assert {(r.doc_id, r.number) for r in line_dedup.removals(frame(spark, rows)).collect()} == lines_brute(rows)


def test_chunks_are_bounded():
    r = np.random.default_rng(1)
    long = r.integers(3, 25, 4000).astype(np.uint8)
    chunk = line_dedup._chunks(long)
    assert chunk[0] == 0 and set(np.diff(chunk).tolist()) <= {0, 1}
    for k in range(chunk[-1] + 1):
        mine = long[chunk == k]
        assert len(mine) <= line_dedup.CHUNK and (len(mine) == 1 or (2.0**mine).sum() <= line_dedup.CHUNK_BYTES)


def test_many_lines_of_one_document(spark):
    """Numbers that go are looked up in a set: 60,000 lines of which half go."""
    text = "\n".join(f"line {k % 30000} has a text of its own {k % 30000 * 7919}" for k in range(60000))
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    gone = spark.createDataFrame([(1, k) for k in range(30000)], "doc_id bigint, number int")
    assert gone.count() == 30000
    began = time.time()
    lost = docs.withColumn("lost", F.sequence(F.lit(30000), F.lit(59999)))
    stay = lost.select(F.split("text", "\n").alias("lines"), "lost").select(F.size(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "lost")).alias("n"))
    assert stay.first().n == 30000 and time.time() - began < 10


@pytest.mark.parametrize("n", [9, 20, 60, 64, 100, 400])
def test_recall_of_bands(n):
    """Lines of n shingles and similarity 0.8 share a band; README states the recall that this measures."""
    r = np.random.default_rng(n)
    missed = 0
    size = round(n * 2 * 0.8 / 1.8)
    for _ in range(150):
        both = r.integers(0, 2**63, size, dtype=np.uint64)
        sides = [np.concatenate([both, r.integers(0, 2**63, n - size, dtype=np.uint64)]) for _ in range(2)]
        a, b = (line_dedup.signatures(x, np.zeros(len(x), np.int64), 1)[0] for x in sides)
        missed += not (a == b).any()
    assert missed <= 6
