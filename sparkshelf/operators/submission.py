"""Ranked results as a wide table, and its checks: alignment, coverage, format, fuzzy suggestions, fallback."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .catalog import keep_first

PIDS = [f"pid{i}" for i in range(1, 11)]
STRATEGIES = ("exact", "no_zwnj", "casefold", "casefold_no_zwnj")


def export_wide(ranked: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(ord, query, pid1..pidk) in the order of queries; '' where there are fewer."""
    wide = ranked.where(F.col("rank") <= k).groupBy("query_id").agg(*[F.max(F.when(F.col("rank") == i, F.col("p_id"))).alias(f"pid{i}") for i in range(1, k + 1)])
    return queries.select("ord", "query_id", "query").join(wide, "query_id", "left").select("ord", "query", *[F.coalesce(f"pid{i}", F.lit("")).alias(f"pid{i}") for i in range(1, k + 1)])


def check_columns(df: DataFrame) -> list[str]:
    """Required columns that are missing."""
    return [n for n in ["query", *PIDS] if n not in df.columns]


def align(preds: DataFrame, sample: DataFrame) -> DataFrame:
    """(ord, sample_query, strategy, pred_ord, query, pid1..pid10) for each sample row, in order.

    Strategy: the strictest key that some prediction shares. Of the predictions of that key the first that no earlier
    sample row took counts, else the first. All keys of a row imply its loosest one, so rows of one loosest key are
    settled together, and no state crosses groups. A task gets the groups one after the other, each group's predictions
    before its rows, in order; it holds the places of one group's predictions, and each is passed once a key."""
    if missing := check_columns(preds):
        raise ValueError(f"predictions lack columns {missing}")
    keys = [f"k_{n}" for n in STRATEGIES]
    last = keys[-1]
    row = lambda df, side: df.select(F.lit(side).alias("side"), "ord", F.col("query").alias("sample_query"), *[x.alias(f"k_{n}") for n, x in T.match_keys("query").items()])
    both = row(preds, 0).unionByName(row(sample, 1)).repartition(last).sortWithinPartitions(last, "side", "ord", "sample_query")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, free, used = None, {}, set()
        for b in batches:
            out: list[tuple] = []
            for side, place, query, *ks in zip(*(b.column(n).to_pylist() for n in ("side", "ord", "sample_query", *keys))):
                if ks[-1] != group:
                    group, free, used = ks[-1], {}, set()
                if not side:
                    for key in enumerate(ks):
                        free.setdefault(key, [0, []])[1].append(place)
                    continue
                found = next((i for i, k in enumerate(ks) if (i, k) in free), None)
                if found is None:
                    out.append((place, query, None, None))
                    continue
                here = free[found, ks[found]]
                while here[0] < len(here[1]) and here[1][here[0]] in used:
                    here[0] += 1
                pick = here[1][here[0] if here[0] < len(here[1]) else 0]
                used.add(pick)
                out.append((place, query, STRATEGIES[found], pick))
            cols = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.int64()))], ["ord", "sample_query", "strategy", "pred_ord"])

    picked = both.mapInArrow(settle, "ord bigint, sample_query string, strategy string, pred_ord bigint")
    rows_of = preds.select(F.col("ord").alias("pred_ord"), F.col("query").alias("_q"), *PIDS)
    out = picked.join(rows_of, "pred_ord", "left")
    return out.select("ord", "sample_query", "strategy", "pred_ord", F.coalesce("_q", "sample_query").alias("query"), *[F.coalesce(n, F.lit("")).alias(n) for n in PIDS])


def alignment_counts(aligned: DataFrame) -> DataFrame:
    return aligned.groupBy(F.coalesce("strategy", F.lit("unmatched")).alias("strategy")).agg(F.count("*").alias("n"))


def alignment_report(aligned: DataFrame, n_preds: int, most: int = 200, most_unmatched: int = 50) -> DataFrame:
    """(ord, line) of a tab-separated text report: rows by strategy, the first rows, the first queries without a prediction."""
    counts = {r["strategy"]: r["n"] for r in alignment_counts(aligned).collect()}  # five at most
    head = [f"aligned\t{sum(counts.values())} rows\t{n_preds} predictions", *(f"by {k}\t{counts.get(k, 0)}" for k in (*STRATEGIES, "unmatched"))]
    show = F.concat_ws("\t", F.lit("row"), F.col("ord").cast("string"), F.coalesce("strategy", F.lit("-")), F.coalesce(F.col("pred_ord").cast("string"), F.lit("-")), "sample_query")
    rows = aligned.orderBy("ord").limit(most).select(show.alias("line")).collect()
    lost = aligned.where("strategy is null").orderBy("ord").limit(most_unmatched).select(F.concat_ws("\t", F.lit("unmatched"), "sample_query").alias("line")).collect()
    return aligned.sparkSession.createDataFrame(list(enumerate([*head, *(r["line"] for r in [*rows, *lost])])), "ord bigint, line string")


def coverage(preds: DataFrame, sample: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sample rows without a prediction, prediction rows without a sample row), repeats and order kept."""
    missing = sample.join(preds.select("query").distinct(), "query", "left_anti")
    extra = preds.join(sample.select("query").distinct(), "query", "left_anti")
    return missing, extra


def missing_context(preds: DataFrame, sample: DataFrame, before: int = 3, after: int = 3) -> DataFrame:
    """(missing_query, place, side, ord, query): sample rows around each missing query's first place, and predictions at -5..+4 of it."""
    missing, _ = coverage(preds, sample)
    first = missing.groupBy("query").agg(F.min("ord").alias("place")).withColumnRenamed("query", "missing_query")
    near = lambda lo, hi: first.select("missing_query", "place", F.explode(F.sequence(F.col("place") - lo, F.col("place") + hi)).alias("ord"))
    out = near(before, after).join(sample.select("ord", "query"), "ord").withColumn("side", F.lit("sample"))
    return out.unionByName(near(5, 4).join(preds.select("ord", "query"), "ord").withColumn("side", F.lit("pred"))).select("missing_query", "place", "side", "ord", "query")


def fuzzy_suggestions(missing: DataFrame, candidates: DataFrame, k: int = 5, cutoff: float = 0.6) -> DataFrame:
    """(query, candidate, ratio, rank): the k closest distinct candidates with ratio >= cutoff.

    2 * min / (la + lb) bounds the ratio by lengths, so pairs meet by length; 2 * (characters in both, repeats counted) /
    (la + lb) bounds it too, and only pairs that pass are compared. Ratios of equal value fall to the greater text, as heaps
    of pairs do."""
    # The k-th occurrence of a character is a member of its own: sets of these hold repeats.
    bag = lambda x: F.transform(F.split(x, ""), lambda ch, i: F.concat(ch, F.size(F.filter(F.slice(F.split(x, ""), 1, i + 1), lambda y: y == ch)).cast("string")))
    q = missing.select("query").distinct().withColumn("la", F.length("query")).where("la > 0").withColumn("qa", bag("query"))
    c = candidates.select(F.col("query").alias("candidate")).distinct().withColumn("lb", F.length("candidate")).where("lb > 0").withColumn("ca", bag("candidate"))
    reach = (1 - cutoff / 2) / (cutoff / 2)
    lengths = q.withColumn("lb", F.explode(F.sequence(F.ceil(F.col("la") / reach).cast("int"), F.floor(F.col("la") * reach).cast("int"))))
    near = lengths.join(c, "lb").where(2 * F.size(F.array_intersect("qa", "ca")) >= cutoff * (F.col("la") + F.col("lb")) - 1e-9).drop("qa", "ca")
    scored = near.withColumn("ratio", T.fuzzy_ratio(F.col("candidate"), F.col("query"))).where(F.col("ratio") >= cutoff)
    w = Window.partitionBy("query").orderBy(F.col("ratio").desc(), F.col("candidate").desc())
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "candidate", "ratio", "rank")


def popular_pids(preds: DataFrame, k: int = 10) -> DataFrame:
    """(p_id, n): the most predicted products, ties by first appearance (row, then column)."""
    cells = preds.select("ord", F.posexplode(F.array(*PIDS)).alias("col", "p_id")).where("p_id <> ''")
    counted = cells.groupBy("p_id").agg(F.count("*").alias("n"), F.min(F.struct("ord", "col")).alias("first"))
    return counted.orderBy(F.col("n").desc(), "first").limit(k)


def fill_with_popular(preds: DataFrame, sample: DataFrame) -> DataFrame:
    """(ord, query, pid1..pid10): each sample row with the last prediction of its query, else the ten most popular products."""
    top = [r["p_id"] for r in popular_pids(preds).collect()]  # ten rows
    top += [""] * (len(PIDS) - len(top))
    last = keep_first(preds, "query", last=True).select("query", F.lit(True).alias("_there"), *PIDS)
    joined = sample.select("ord", "query").join(last, "query", "left")
    return joined.select("ord", "query", *[F.when(F.col("_there"), F.coalesce(n, F.lit(""))).otherwise(F.lit(t)).alias(n) for n, t in zip(PIDS, top)])


def row_problems(preds: DataFrame, most: int = 20) -> DataFrame:
    """The first problematic rows: empty, padded, repeated, invisible and non-numeric product cells."""
    cells = F.array(*[F.coalesce(F.col(n), F.lit("")) for n in PIDS])
    bare = F.transform("cells", T.strip)
    place = lambda cond: F.filter(F.transform("cells", lambda x, i: F.when(cond(x), i + 1)), lambda i: i.isNotNull())
    out = preds.withColumn("cells", cells).withColumn("bare", bare).select(
        "ord",
        "query",
        place(lambda x: T.strip(x) == "").alias("empty_pids"),
        place(lambda x: x != T.strip(x)).alias("padded_pids"),
        F.array_distinct(F.filter("bare", lambda x: (x != "") & (F.size(F.filter("bare", lambda y: y == x)) > 1))).alias("repeated_pids"),
        place(lambda x: T.has_invisible(T.strip(x))).alias("invisible_pids"),
        place(lambda x: (T.strip(x) != "") & ~T.strip(x).rlike("^[0-9]+$")).alias("non_digit_pids"),
    )
    any_problem = F.size("empty_pids") + F.size("padded_pids") + F.size("repeated_pids") + F.size("invisible_pids") + F.size("non_digit_pids")
    return out.where(any_problem > 0).orderBy("ord").limit(most)


def format_check(preds: DataFrame, sample: DataFrame) -> DataFrame:
    """(issue, n): every failed check of the prediction table against the sample; no row means it passes."""
    spark = preds.sparkSession
    found: list[tuple[str, int]] = []
    names = lambda df: [n for n in df.columns if n != "ord"]
    if names(preds) != names(sample):
        found.append(("header differs", len(set(names(preds)) ^ set(names(sample)))))
    if missing := check_columns(preds):
        return spark.createDataFrame([*found, ("missing columns", len(missing))], "issue string, n bigint")
    p = preds.withColumn("q", T.strip(F.coalesce("query", F.lit(""))))
    s = sample.select("ord", T.strip(F.coalesce("query", F.lit(""))).alias("sq"))
    n_p, n_s = preds.count(), sample.count()
    if n_p != n_s:
        found.append(("row count differs", abs(n_p - n_s)))
    cases = {
        "invisible characters in queries": p.where(T.has_invisible("q")),
        "order differs": p.join(s, "ord").where(F.col("q") != F.col("sq")),
        "queries not in sample": p.select("q").distinct().join(s.select(F.col("sq").alias("q")), "q", "left_anti"),
        "sample queries missing": s.select(F.col("sq").alias("q")).distinct().join(p.select("q"), "q", "left_anti"),
        "repeated queries": p.groupBy("q").count().where("count > 1"),
        "product cells": row_problems(preds),
    }
    found += [(name, n) for name, df in cases.items() if (n := df.count())]
    return spark.createDataFrame(found, "issue string, n bigint")
