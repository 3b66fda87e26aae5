"""Scores by scanning the products: no shuffle of pairs, blocks, repeated ids, and the best of each task."""

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkshelf.operators import analysis as G
from sparkshelf.operators import features as X
from sparkshelf.operators import grams as N
from sparkshelf.operators import index as I
from sparkshelf.operators import relational as R
from sparkshelf.operators import retrieval as V
from sparkshelf.operators import scan as S


@pytest.fixture(scope="module")
def products(spark):
    rows = [(i, f"p{i}", f"{'red' if i % 2 else 'blue'} phone {i % 5} case {i % 3}") for i in range(40)]
    return spark.createDataFrame(rows, "ord bigint, p_id string, text_norm string").repartition(3)


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(q, q, q) for q in ("red case 1", "blue blue 4", "none")], "query_id string, query string, query_norm string")


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def rows(df, name):
    return {(r.query_id, r.p_id): pytest.approx(r[name]) for r in df.collect()}


def test_pair_scores_are_not_shuffled(queries, products):
    assert exchanges(I.bm25_scores(queries, products.coalesce(3))) == exchanges(products)
    assert exchanges(I.tfidf_scores(queries, products, I.TfIdf(min_df=1))) == exchanges(products)


def test_blocks_give_the_same(queries, products, monkeypatch):
    whole = rows(I.bm25_scores(queries, products), "bm25"), rows(I.tfidf_scores(queries, products), "tfidf")
    monkeypatch.setattr(S, "BLOCK_CELLS", 1)
    assert (rows(I.bm25_scores(queries, products), "bm25"), rows(I.tfidf_scores(queries, products), "tfidf")) == whole


def test_best_of_each_task(queries, products, monkeypatch):
    every = {}
    for r in V.with_place(I.bm25_scores(queries, products), products).collect():
        every.setdefault(r.query_id, []).append((-round(r.bm25, 9), r.ord))
    monkeypatch.setattr(S, "HELD_ROWS", 1)
    monkeypatch.setattr(S, "SLICE_CELLS", 1)
    got = {}
    for r in V.bm25_candidates(queries, products, 3).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.ord
    assert got == {q: {i + 1: o for i, (_, o) in enumerate(sorted(x)[:3])} for q, x in every.items()}


def test_repeated_ids_count_once(spark, queries):
    p = spark.createDataFrame([(0, "a", "red case"), (1, "a", "red 1"), (2, "b", "blue")], "ord bigint, p_id string, text_norm string")
    assert {(r.token, r.p_id): r.tf for r in I.postings(p).collect()}["red", "a"] == 2
    stored = rows(I.bm25_scores(queries, p, post=I.postings(p.coalesce(1))), "bm25")
    assert rows(I.bm25_scores(queries, p), "bm25") == stored
    assert [(r.query_id, r.p_id, r.ord) for r in V.bm25_candidates(queries, p).where("query_id = 'red case 1'").orderBy("rank").collect()] == [("red case 1", "a", 0), ("red case 1", "a", 1)]


def test_no_queries(queries, products):
    assert I.bm25_scores(queries.limit(0), products).count() == 0 and V.train_candidates(queries.limit(0), products).count() == 0


def test_only_asked_products_are_sorted(queries, products):
    asked = X._with_products(queries.limit(1).selectExpr("query_id", "'p1' as p_id"), products)
    plan = asked._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and asked.first().text_norm == "red phone 1 case 1"


def test_serving_shuffles_no_pairs(queries, products, monkeypatch):
    """All pairs' scores by hand, and the same whatever terms count as frequent; before, every pair was shuffled."""
    bm25, cosine = (rows_ for rows_ in ({(r.query_id, r.p_id): r[n] for r in df.collect()} for n, df in (("bm25", I.bm25_scores(queries, products, I.SERVE, "query")), ("tfidf", I.tfidf_scores(queries, products, I.TFIDF_SERVE, "query")))))
    want, n = {}, products.count()
    for q in {q for q, _ in bm25}:
        b = {p: x for (r, p), x in bm25.items() if r == q}
        lo, hi = (min(b.values()), max(b.values())) if len(b) == n else (0.0, max(b.values()))
        for p in {p for r, p in (*bm25, *cosine) if r == q}:
            want[q, p] = 0.6 * cosine.get((q, p), 0.0) + 0.4 * ((b[p] - lo) / (hi - lo) if p in b and hi > lo else b.get(p, 0.0))
    for frequent in (1, 200_000):
        monkeypatch.setattr(V, "FREQUENT", frequent)
        got = V.serve_candidates(queries, products, 40).collect()
        assert {(r.query_id, r.p_id): r.score for r in got if r.score} == pytest.approx({k: x for k, x in want.items() if x})
        assert {r.query_id: r.tfidf for r in got if r.p_id == "p1"} == pytest.approx({q: cosine.get((q, "p1"), 0.0) for q in ("red case 1", "blue blue 4", "none")})


def test_candidates_read_texts_once(spark, queries, products):
    """Before, every text was normalised and read twice: for frequencies and for scores."""
    read = spark.sparkContext.accumulator(0)

    def note(texts: pd.Series) -> pd.Series:
        read.add(len(texts))
        return texts

    noted = products.withColumn("text_norm", F.pandas_udf(note, "string")("text_norm"))
    assert V.bm25_candidates(queries, noted, 3).count() == 6 and read.value == 40


def test_all_pairs_read_texts_once(spark, queries, products):
    """Before, every text was normalised and read twice: for frequencies and for scores."""
    read = spark.sparkContext.accumulator(0)

    def note(texts: pd.Series) -> pd.Series:
        read.add(len(texts))
        return texts

    noted = products.withColumn("text_norm", F.pandas_udf(note, "string")("text_norm"))
    assert rows(I.bm25_scores(queries, noted, digits=6), "bm25") == {k: pytest.approx(round(x.expected, 6)) for k, x in rows(I.bm25_scores(queries, products), "bm25").items()}
    assert read.value == 40


def test_finder_finds_what_a_dictionary_does(monkeypatch):
    """Words of all lengths, with the same beginnings, of several bytes a character and longer than any term; also where many terms share a cell."""
    words = ["a", "ab", "a_b", "abcdefgh", "abcdefghi", "abcdefgh" * 2, "abcdefgh" * 2 + "x", "日本語日本語", "日本語日本語日", "z" * 100_000, "ünï", *(f"w{i}" for i in range(50))]
    terms = {t: i for i, t in enumerate(words[1::2])}
    products = [[" ".join(words), None], [], [None], ["", "a ab\tab, a_b  abcdefghi! abcdefgh"], [" ".join(reversed(words))] * 2]
    for bits in (18, 3):
        monkeypatch.setattr(S.Finder, "BITS", bits)
        for tokenizer in (S._WORD, S._words_split, S._words_vectorizer):
            for given in (terms, {}):
                got, want = S.term_matches(products, tokenizer, given, S.Finder(given)), S.term_matches(products, tokenizer, given)
                assert all(np.array_equal(x, y) for x, y in zip(got, want, strict=True))


def test_decimals_are_those_of_round(spark):
    x = [0.0, -0.0, 1e-9, -1e-9, 0.0000005, -0.0000005, 1.0000005, 2.5000015, 0.1234565, 1.4999995, -7.1234565, 8.000000499999999, 123456.7890125, 1e12 / 3, 2.0**70, 1e300, *np.random.default_rng(3).normal(0, 10, 2000).tolist(), *(i / 1e6 + 5e-7 for i in range(2000))]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 6)).collect()]
    assert [repr(v) for v in S.decimals(np.array(x), 6).tolist()] == [repr(v) for v in want]


def test_only_asked_products_are_scored(spark, queries, products):
    """Before, the texts of all products were joined with the pairs."""
    noted = products.withColumn("text_norm", F.pandas_udf(lambda x: x, "string")("text_norm"))
    pairs = spark.createDataFrame([("red case 1", "p1"), ("red case 1", "p2")], "query_id string, p_id string")
    got = I.bm25_scores(queries, noted, pairs=pairs)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "substring" in plan[plan.index("ArrowEvalPython") :]
    every = rows(I.bm25_scores(queries, products), "bm25")
    assert rows(got, "bm25") == {("red case 1", p): every["red case 1", p] for p in ("p1", "p2") if ("red case 1", p) in every}


def test_weights_are_a_matrix():
    rng = np.random.default_rng(1)
    w, x = rng.random((7, 5)) * (rng.random((7, 5)) < 0.4), rng.random((6, 7)) * (rng.random((6, 7)) < 0.5)
    (t, q), (d, u) = np.nonzero(w), np.nonzero(x)
    score, there = S.Weights(t, q, w[t, q], 7, 5)(d, u, x[d, u], 6)
    assert np.allclose(score, x @ w) and (there == ((x > 0).astype(int) @ (w > 0) > 0)).all()


def test_words_of_any_text():
    for x in ("red phone", "a-b  c d", "ë x", "۔٠ \x1cy", "", " ", "ẗ_1"):
        assert S._WORD(x) == S._WORD_RUNS(x)


def test_sample_reads_few_texts(spark, products):
    """Before, all texts were normalised, and each task handed its first n rows on whole."""
    read = spark.sparkContext.accumulator(0)

    def note(texts: pd.Series) -> pd.Series:
        read.add(len(texts))
        return texts

    noted = products.withColumn("text_norm", F.pandas_udf(note, "string")("text_norm"))
    got = [(r.p_id, r.text_norm) for r in R.sample(noted, 2, "p_id").collect()]
    by_md5 = sorted(products.collect(), key=lambda r: hashlib.md5(f"42:{r.p_id}".encode()).hexdigest())
    assert got == [(r.p_id, r.text_norm) for r in by_md5[:2]] and read.value < 20


def test_token_frequency_by_first_place(spark, products, monkeypatch):
    """Counts are summed in tasks, not one row a token; ties fall to the first row and place."""
    p = spark.createDataFrame([(2, "b a a"), (0, "c d"), (1, "d c b"), (3, None)], "ord int, text_norm string").repartition(3)
    want = [("c", 2), ("d", 2), ("b", 2), ("a", 2)]
    assert [(r.token, r.n) for r in G.token_frequency(p).collect()] == want
    monkeypatch.setattr(S, "HELD_TERMS", 0)
    assert [(r.token, r.n) for r in G.token_frequency(p).collect()] == want
    assert "Generate" not in G.token_frequency(p)._jdf.queryExecution().executedPlan().toString()


def vocabularies(products, preset, monkeypatch, **parts):
    rows_, words = S.by_product(products, F.col("text_norm"), "p_id"), S._WORD
    monkeypatch.setattr(S, "SKETCHED", 10**9)
    want = {tuple(r.values()) for r in I._bounded_vocabulary(rows_, words, 60, preset).to_pylist()}
    monkeypatch.setattr(S, "SKETCHED", 0)
    for name, value in parts.items():
        monkeypatch.setattr(N, name, value)
    return rows_, words, want, {tuple(r.values()) for r in I._bounded_vocabulary(rows_, words, 60, preset).to_pylist()}


@pytest.fixture(scope="module")
def long_products(spark):
    text = lambda i: " ".join(f"w{i * j * j % (7 + j)}" for j in range(1, 60)) + f" only{i}"
    return spark.createDataFrame([(i, f"p{i}", text(i) if i % 9 else None) for i in range(60)], "ord bigint, p_id string, text_norm string").repartition(3)


def test_vocabulary_counts_few_terms(long_products, monkeypatch):
    """Before, every n-gram of every task was shuffled and kept; now those that can't be among the most frequent aren't."""
    rows_, words, want, got = vocabularies(long_products, I.TfIdf(min_df=2, max_features=20), monkeypatch, SAMPLE=1)
    assert got == want and len(got) == 20
    least, marks = S.least_total(rows_, words, 60, 2, 1.0, 20)
    every, few = S.term_stats(rows_, words), S.term_stats(rows_, words, marks=marks)
    assert least > 1 and few.count() < every.count() / 2
    assert set(few.where(F.col("total") >= least).collect()) == set(every.where(F.col("total") >= least).collect())


def test_misleading_sample(long_products, monkeypatch):
    monkeypatch.setattr(S, "least_total", lambda *a: (10**6, np.zeros(8, np.uint8)))
    rows_, words, want, got = vocabularies(long_products, I.TfIdf(min_df=1, max_features=60), monkeypatch)
    assert got == want and len(got) == 60


@pytest.mark.parametrize("bounds", [{}, {"WORDS": 100, "DOCS": 7, "HELD_WORDS": 50, "HELD_KEYS": 100}, {"HELD_WORDS": 30, "WORDS": 500, "HELD_KEYS": 50}])
def test_ngrams_are_counted_in_chunks(bounds, monkeypatch):
    """As dictionaries of strings count them; of no n-gram are there more than the sketch's bucket has."""
    for name, value in bounds.items():
        monkeypatch.setattr(N, name, value)
    rng = np.random.default_rng(1)
    products = [[None if rng.random() < 0.1 else " ".join(f"w{x}" for x in rng.integers(0, 40, rng.integers(0, 30))) for _ in range(rng.integers(1, 3))] for _ in range(200)]
    want, got, sketch = Counter(), Counter(), N.Sketch()
    for texts in products:
        g = [x for t in texts if t is not None for x in S.grams(t.split())]
        want.update({(x, "total"): n for x, n in Counter(g).items()})
        want.update((x, "df") for x in set(g))
    for b in N.Counted(str.split, None, sketch)(products):
        for t, df, total in zip(*(c.to_pylist() for c in b.columns)):
            got.update({(t, "df"): df, (t, "total"): total})
    assert got == want
    terms = [t for t, x in want if x == "total"]
    assert (sketch.n[N.buckets(N.hashes(terms), N.SKETCH)] >= [want[t, "total"] for t in terms]).all()
    assert sketch.n.sum() == sum(want[t, "total"] for t in terms)


def test_frequencies_of_asked_terms(spark, long_products):
    """Before, the terms of all products were shuffled to find those of a few pairs."""
    rows_, words = S.by_product(long_products, F.col("text_norm"), "p_id"), S._WORD
    wanted = spark.createDataFrame([("w1",), ("w1 w4",), ("only5",), ("none",)], "term string")
    every = {r for r in S.term_stats(rows_, words).collect() if r.term in ("w1", "w1 w4", "only5")}
    few = S.term_stats(rows_, words, marks=S.marks_of(wanted)).collect()
    assert len(every) >= 2 and every == set(few)


def test_lookup_finds_the_vocabulary():
    terms = {t: i for i, t in enumerate(["a", "b c", "c", "a a", "zz"])}
    doc, term, tf = N.Lookup(terms)([["a a a", None], ["b c", "c b"], [""], ["q"]], str.split)
    assert list(zip(doc, term, tf)) == [(0, 0, 3.0), (0, 3, 2.0), (1, 1, 1.0), (1, 2, 2.0)]
    assert [len(x) for x in N.Lookup({})([["a"]], str.split)] == [0, 0, 0]


def test_train_candidates_score_once(spark, queries, products):
    """Before, texts were read for the scores once for each use of the hits: now once for the vocabulary and once for these."""
    read = spark.sparkContext.accumulator(0)

    def note(texts: pd.Series) -> pd.Series:
        read.add(len(texts))
        return texts

    noted = products.withColumn("text_norm", F.pandas_udf(note, "string")("text_norm"))
    assert V.train_candidates(queries, noted, 3).count() == 9 and read.value == 80
