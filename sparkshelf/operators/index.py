"""Inverted index as tables: postings, BM25 under three presets, TF-IDF vectors, popularity.

Tables: docs(ord, p_id, text_norm, dl), postings(token, p_id, tf, dl), stats(n, avgdl),
terms(token, df), tfidf(p_id, term, w), popularity(p_id, n). Scoring joins query
stored postings by token and sums by (query, product). Without a stored index the
products are scanned (`scan`): a pair's score is made where the product lies, and only
document frequencies and results leave a task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.io import load_table, save_table
from . import scan as S


@dataclass(frozen=True)
class BM25:
    """A BM25 variant. `idf`: 'plain' ln((N-df+.5)/(df+.5) + idf_eps), which may be negative, or 'plus1' ln(1 + ...).
    `repeats`: whether a repeated query token counts again. `tokenizer`: text column to tokens."""

    k1: float = 1.5
    b: float = 0.75
    idf: str = "plain"
    idf_eps: float = 1e-9
    eps: float = 1e-9
    repeats: bool = False
    tokenizer: object = T.tokens

    def idf_of(self, n: Column, df: Column) -> Column:
        odds = (n - df + 0.5) / (df + 0.5)
        return F.log(odds + self.idf_eps) if self.idf == "plain" else F.log(1 + odds)


INDEX = BM25()
SERVE = BM25(idf="plus1", idf_eps=0.0, eps=0.0, repeats=True, tokenizer=T.tokens_split)
TRAIN = BM25(k1=1.2, eps=1e-12)


@dataclass(frozen=True)
class TfIdf:
    """A TF-IDF variant: raw counts, smooth idf ln((1+n)/(1+df)) + 1, unit length. Ties of `max_features` fall to the smaller term."""

    min_df: int = 2
    max_df: float = 1.0
    max_features: int | None = 200_000
    tokenizer: object = T.tokens


TFIDF_INDEX = TfIdf()
TFIDF_SERVE = TfIdf(min_df=1, max_df=0.95, max_features=None, tokenizer=T.tokens_vectorizer)
TFIDF_TRAIN = TfIdf(min_df=1, max_features=75_000)


def postings(products: DataFrame, preset: BM25 = INDEX, text: str = "text_norm", key: str = "p_id") -> DataFrame:
    """(token, p_id, tf, dl), dl being the number of tokens of the product."""
    words = products.select(key, preset.tokenizer(text).alias("_t")).select(key, F.size("_t").alias("dl"), F.explode("_t").alias("token"))
    return words.groupBy("token", key).agg(F.count("*").alias("tf"), F.first("dl").cast("bigint").alias("dl"))


def corpus_stats(products: DataFrame, preset: BM25 = INDEX, text: str = "text_norm") -> DataFrame:
    """One row: n, avgdl (0 for no products)."""
    n = F.size(preset.tokenizer(text))
    return products.agg(F.count("*").alias("n"), F.coalesce(F.avg(n), F.lit(0.0)).alias("avgdl"))


def document_frequency(post: DataFrame) -> DataFrame:
    return post.groupBy("token").agg(F.count("*").alias("df"))


def query_tokens(queries: DataFrame, preset: BM25, text: str = "query_norm") -> DataFrame:
    """(query_id, token, qtf) of each query's tokens; qtf is 1 where repeats don't count."""
    words = queries.select("query_id", F.explode(preset.tokenizer(text)).alias("token"))
    return words.groupBy("query_id", "token").agg((F.count("*") if preset.repeats else F.lit(1)).cast("int").alias("qtf"))


def _stored_bm25(queries: DataFrame, products: DataFrame, preset: BM25, query_text: str, text: str, post: DataFrame) -> DataFrame:
    n, avgdl = corpus_stats(products, preset, text).first()
    q = query_tokens(queries, preset, query_text)
    # Postings of query tokens only, used twice: for document frequencies and for scores.
    wanted = post.join(q.select("token").distinct(), "token", "left_semi")
    weighted = wanted.join(document_frequency(wanted), "token")
    length = F.lit(1 - preset.b) + preset.b * F.col("dl") / F.lit(avgdl if avgdl else 1.0)
    part = preset.idf_of(F.lit(float(n)), F.col("df")) * F.col("tf") * (preset.k1 + 1) / (F.col("tf") + preset.k1 * length + preset.eps)
    return q.join(weighted.select("token", "p_id", part.alias("part")), "token").groupBy("query_id", "p_id").agg(F.sum(F.col("part") * F.col("qtf")).alias("bm25"))


def _no_pairs(products: DataFrame, name: str, key: str = "p_id") -> DataFrame:
    """(query_id, key, ord, name), empty."""
    return products.sparkSession.createDataFrame([], f"query_id string, {key} {products.schema[key].dataType.simpleString()}, ord bigint, {name} double")


def bm25_scores(queries: DataFrame, products: DataFrame, preset: BM25 = INDEX, query_text: str = "query_norm", text: str = "text_norm", post: DataFrame | None = None, pairs: DataFrame | None = None, k: int | None = None, digits: int | None = None) -> DataFrame:
    """(query_id, p_id, bm25) for every pair that shares a token; with `pairs` (query_id, p_id), for those only. With k, also
    `ord`, and of each query at least the k best by score to nine decimals, then ord. `digits`: without k, scores are rounded to so many."""
    if post is not None:
        scores = _stored_bm25(queries, products, preset, query_text, text, post)
        scores = scores if digits is None else scores.withColumn("bm25", F.round("bm25", digits))
        return scores if pairs is None else scores.join(pairs.select("query_id", "p_id").distinct(), ["query_id", "p_id"], "left_semi")
    column, words = S.reader(preset.tokenizer, text)
    rows = S.by_product(products, column, "p_id")
    parts = []
    for block in S.blocks(queries, preset.tokenizer, query_text, lambda c: {t: float(x if preset.repeats else 1) for t, x in c.items()}):
        kind, kept = products.schema["p_id"].dataType.simpleString(), None
        if pairs is None:
            kept = S.matches(rows, "p_id", kind, words, block.terms)
        n, avgdl, df = S.bm25_stats(rows, words, block.terms) if kept is None else S.match_stats(kept, len(block.terms))
        odds = (n - df + 0.5) / (df + 0.5)
        idf = np.log(odds + preset.idf_eps) if preset.idf == "plain" else np.log(1 + odds)
        make = S.BM25Maker(preset, words, block.terms, block.weights(), idf, avgdl)
        if kept is None:
            scores = S.scan(rows, "p_id", kind, block, make, "bm25", k, pairs, digits=digits)
        else:
            scores = S.scan(kept, "p_id", kind, block, S.MatchMaker(make), "bm25", k, read=S.read_matches, columns=S.MATCHED, digits=digits)
        parts.append(scores.withColumnRenamed("_ord", "ord"))
    out = S.union(parts, lambda: _no_pairs(products, "bm25"))
    return out.drop("ord") if k is None else out


def term_counts(rows: DataFrame, key: str, text: str, preset: TfIdf) -> DataFrame:
    return rows.select(key, F.explode(T.ngrams(preset.tokenizer(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def vocabulary(counts: DataFrame, n: int, preset: TfIdf) -> DataFrame:
    """(term, df, idf) of the terms kept."""
    terms = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    terms = terms.where((F.col("df") >= preset.min_df) & (F.col("df") <= preset.max_df * n))
    if preset.max_features:
        terms = terms.orderBy(F.col("total").desc(), "term").limit(preset.max_features)
    return terms.select("term", "df", (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def _unit(counts: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    w = counts.join(vocab.select("term", "idf"), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_n"))
    return w.join(norm, key).select(key, "term", (F.col("w") / F.col("_n")).alias("w"))


def _bounded_vocabulary(rows: DataFrame, words, n: int, preset: TfIdf) -> pa.Table:
    """`vocabulary` of `max_features` terms in the driver. A first reading finds a total that enough terms reach, and the buckets
    that may reach it: only their terms are counted exactly and shuffled. The last total that still fits is found by how many
    terms have each total, so no task holds more than the terms of that one total."""
    least, marks = S.least_total(rows, words, n, preset.min_df, preset.max_df, preset.max_features)
    fits = (F.col("df") >= preset.min_df) & (F.col("df") <= preset.max_df * n)
    terms = S.term_stats(rows, words, marks=marks).where(fits & (F.col("total") >= least)).persist()
    if least > 1 and terms.count() < preset.max_features:  # the sample was misleading: all terms count
        terms.unpersist()
        terms = S.term_stats(rows, words).where(fits).persist()
    cut, above = 0, 0
    for total, c in terms.groupBy("total").count().orderBy(F.col("total").desc()).collect():  # totals that differ: a root of the text
        if above + c > preset.max_features:
            cut = total
            break
        above += c
    kept = terms.where(F.col("total") > cut)
    if cut:
        kept = kept.unionByName(terms.where(F.col("total") == cut).orderBy("term").limit(preset.max_features - above))
    out = kept.select("term", "df").toArrow()
    terms.unpersist()
    return out.append_column("idf", pa.array(np.log((1.0 + n) / (1.0 + out["df"].to_numpy())) + 1.0))


def tfidf_fit(products: DataFrame, preset: TfIdf = TFIDF_INDEX, text: str = "text_norm", key: str = "p_id") -> tuple[DataFrame, DataFrame]:
    """(vocabulary, unit vectors (p_id, term, w))."""
    if not preset.max_features:
        counts = term_counts(products, key, text, preset)
        vocab = vocabulary(counts, products.count(), preset)
        return vocab, _unit(counts, vocab, key)
    column, words = S.reader(preset.tokenizer, text)
    rows = S.by_product(products, column, key)
    vocab = _bounded_vocabulary(rows, words, products.count(), preset)
    terms = vocab["term"].to_pylist()
    make = S.CosineMaker(words, {t: i for i, t in enumerate(terms)}, vocab["idf"].to_numpy(), None)
    return products.sparkSession.createDataFrame(vocab, "term string, df bigint, idf double"), S.vectors(rows, key, products.schema[key].dataType.simpleString(), make, terms)


def tfidf_query(queries: DataFrame, vocab: DataFrame, preset: TfIdf = TFIDF_INDEX, text: str = "query_norm") -> DataFrame:
    return _unit(term_counts(queries, "query_id", text, preset), vocab, "query_id")


def cosine_scores(query_vectors: DataFrame, product_vectors: DataFrame) -> DataFrame:
    """(query_id, p_id, tfidf) for every pair that shares a term."""
    q = query_vectors.select("query_id", "term", F.col("w").alias("wq"))
    return q.join(product_vectors, "term").groupBy("query_id", "p_id").agg(F.sum(F.col("wq") * F.col("w")).alias("tfidf"))


def tfidf_scores(queries: DataFrame, products: DataFrame, preset: TfIdf = TFIDF_INDEX, query_text: str = "query_norm", text: str = "text_norm", key: str = "p_id", pairs: DataFrame | None = None, k: int | None = None) -> DataFrame:
    """cosine_scores without a stored index. With `pairs` (query_id, p_id), norms and scores of those only. With k, also
    `ord`, and of each query at least the k best by score to nine decimals, then ord."""
    if not preset.max_features:
        return _open_tfidf(queries, products, preset, query_text, text, key, pairs)
    column, words = S.reader(preset.tokenizer, text)
    rows = S.by_product(products, column, key)
    vocab = _bounded_vocabulary(rows, words, products.count(), preset)
    idf = dict(zip(vocab["term"].to_pylist(), vocab["idf"].to_pylist()))
    parts = []
    for block in S.blocks(queries, preset.tokenizer, query_text, lambda c: S.unit(c, idf), ngrams=True):
        terms = dict(block.terms)
        for t in idf:
            terms.setdefault(t, len(terms))
        make = S.CosineMaker(words, terms, np.array([idf[t] for t in terms]), block.weights())
        parts.append(S.scan(rows, key, products.schema[key].dataType.simpleString(), block, make, "tfidf", k, pairs).withColumnRenamed("_ord", "ord"))
    out = S.union(parts, lambda: _no_pairs(products, "tfidf", key))
    return out.drop("ord") if k is None else out


def _open_tfidf(queries: DataFrame, products: DataFrame, preset: TfIdf, query_text: str, text: str, key: str, pairs: DataFrame | None) -> DataFrame:
    """tfidf_scores with a vocabulary without bound, which stays a table. Where there are pairs, counts are made of their
    products alone, and document frequencies of the terms of these and of the queries."""
    column, words = S.reader(preset.tokenizer, text)
    rows, own = S.by_product(products, column, key), term_counts(queries, "query_id", query_text, preset)
    if pairs is not None:
        both = pairs.select("query_id", key).distinct()
        counts = term_counts(products.join(both.select(key).distinct(), key, "left_semi"), key, text, preset).persist()
        wanted = counts.select("term").union(own.select("term")).distinct()
        stats = S.term_stats(rows, words, marks=S.marks_of(wanted)).join(wanted, "term", "left_semi")
    else:
        stats, counts = S.term_stats(rows, words), term_counts(products, key, text, preset)
    n = products.count()
    vocab = stats.where((F.col("df") >= preset.min_df) & (F.col("df") <= preset.max_df * n)).select("term", "df", (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    vocab = vocab.persist() if pairs is not None else vocab
    q = _unit(own, vocab, "query_id").select("query_id", "term", F.col("w").alias("wq"))
    if pairs is not None:
        q = q.join(both, "query_id")
    weighted = counts.join(vocab.select("term", "idf"), "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = weighted.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_n"))
    part = q.join(weighted, ["term"] if pairs is None else ["term", key]).groupBy("query_id", key).agg(F.sum(F.col("wq") * F.col("w")).alias("_s"))
    return part.join(norm, key).select("query_id", key, (F.col("_s") / F.col("_n")).alias("tfidf"))


def popularity(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("p_id").agg(F.count("*").alias("n"))


@dataclass
class ProductIndex:
    """The stored index: everything retrieval needs, as tables."""

    docs: DataFrame
    post: DataFrame
    stats: DataFrame
    vocab: DataFrame | None
    tfidf: DataFrame | None
    popular: DataFrame | None

    @classmethod
    def fit(cls, products: DataFrame, text: str = "text_norm", pairs: DataFrame | None = None, tfidf: TfIdf | None = TFIDF_INDEX, bm25: BM25 = INDEX) -> ProductIndex:
        docs = products.withColumn("model_tokens", T.model_tokens(text))
        vocab, vectors = tfidf_fit(products, tfidf, text) if tfidf else (None, None)
        return cls(docs, postings(products, bm25, text), corpus_stats(products, bm25, text), vocab, vectors, popularity(pairs) if pairs is not None else None)

    def save(self, path: str) -> None:
        for name, df in self.__dict__.items():
            if df is not None:
                save_table(df.repartition("token") if name == "post" else df, f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, parts=("docs", "post", "stats", "vocab", "tfidf", "popular")) -> ProductIndex:
        from ..sources.io import exists

        return cls(**{n: load_table(spark, f"{path}/{n}") if n in parts and exists(spark, f"{path}/{n}") else None for n in ("docs", "post", "stats", "vocab", "tfidf", "popular")})
