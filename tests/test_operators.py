"""Operators on small hand-made tables, and the flows from CSV to predictions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sparkshelf.operators import catalog as C
from sparkshelf.operators import features as X
from sparkshelf.operators import index as I
from sparkshelf.operators import ltr as M
from sparkshelf.operators import retrieval as V
from sparkshelf.operators import submission as Q
from sparkshelf.plans import pipeline as P
from sparkshelf.sources import io as S

CATALOG = [(0, "p1", "red phone case"), (1, "p2", "red shoe"), (2, "p3", "phone charger phone")]
QUERIES = ["phone case", "phone phone", "charger", "red"]


@pytest.fixture(scope="module")
def products(spark):
    return spark.createDataFrame(CATALOG, "ord bigint, p_id string, text_norm string")


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(i, q, q, q) for i, q in enumerate(QUERIES)], "ord bigint, query_id string, query string, query_norm string")


def scores(df, column):
    return {(r.query_id, r.p_id): r[column] for r in df.collect()}


def test_bm25_presets(queries, products):
    a = scores(I.bm25_scores(queries, products), "bm25")
    assert a["phone case", "p1"] == pytest.approx(0, abs=1e-6) and a["phone case", "p3"] == pytest.approx(-0.701563, abs=1e-6) and ("phone case", "p2") not in a
    assert a["phone phone", "p1"] == pytest.approx(-0.483622, abs=1e-6) and a["charger", "p3"] == pytest.approx(0.483622, abs=1e-6)
    b = scores(I.bm25_scores(queries, products, I.SERVE, "query"), "bm25")
    assert b["phone case", "p1"] == pytest.approx(1.373570, abs=1e-6) and b["phone phone", "p3"] == pytest.approx(1.290997, abs=1e-6) and b["charger", "p3"] == pytest.approx(0.928596, abs=1e-6)
    t = scores(I.bm25_scores(queries, products, I.TRAIN), "bm25")
    assert t["phone case", "p3"] == pytest.approx(-0.678531, abs=1e-6)


def test_tfidf_cosine(queries, products):
    t = scores(I.tfidf_scores(queries, products, I.TfIdf(min_df=1)), "tfidf")
    assert t["phone case", "p1"] == pytest.approx(0.787582, abs=1e-6) and t["phone case", "p3"] == pytest.approx(0.312528, abs=1e-6)
    assert t["red", "p1"] == pytest.approx(0.373022, abs=1e-6) and t["red", "p2"] == pytest.approx(0.473630, abs=1e-6)


def test_padding_on_a_short_catalog(queries, products):
    got = V.train_candidates(queries, products, 50)
    assert {(r.query_id, r["count"]) for r in got.groupBy("query_id").count().collect()} == {(q, 3) for q in QUERIES}
    served = V.serve_candidates(queries, products, 2)
    assert {r["count"] for r in served.groupBy("query_id").count().collect()} == {2}
    assert [r.rank for r in served.where("query_id = 'red'").orderBy("rank").collect()] == [1, 2]


def test_index_round_trip(spark, products, queries, tmp_path):
    pairs = spark.createDataFrame([("phone", "p1"), ("phone", "p1"), ("shoe", "p2")], "query string, p_id string")
    I.ProductIndex.fit(products, pairs=pairs, tfidf=I.TfIdf(min_df=1)).save(str(tmp_path))
    back = I.ProductIndex.load(spark, str(tmp_path))
    assert {r.p_id: r.n for r in back.popular.collect()} == {"p1": 2, "p2": 1}
    assert scores(I.bm25_scores(queries, back.docs, post=back.post), "bm25") == pytest.approx(scores(I.bm25_scores(queries, products), "bm25"))


def test_ranking_metrics(spark):
    ranked = spark.createDataFrame([("q", x, i + 1) for i, x in enumerate("abc")], "query_id string, p_id string, rank int")
    pos = lambda ids: spark.createDataFrame([("q", x) for x in ids], "query_id string, p_id string")
    one = M.per_query_metrics(ranked, pos("b")).first()
    assert (one.p_at_1, one.p_at_10) == (0, 0.1) and one.ndcg_at_10 == pytest.approx(0.630930, abs=1e-6)
    assert M.per_query_metrics(ranked, pos("ac"), (2,)).first().ndcg_at_2 == pytest.approx(0.613147, abs=1e-6)
    assert M.per_query_metrics(ranked, pos("")).first().ndcg_at_10 == 0


def test_labels_and_split(spark):
    rows = [("q1", f"p{i}") for i in range(8)] + [("q2", f"p{i}") for i in range(8)] + [("q3", "p0")]
    feats = spark.createDataFrame(rows, "query_id string, p_id string")
    pos = spark.createDataFrame([("q1", "p0"), ("q2", "zz")], "query_id string, p_id string")
    got = {r.query_id: (r.n, r.pos) for r in M.prepare_training_data(feats, pos).groupBy("query_id").agg(F.count("*").alias("n"), F.sum("label").alias("pos")).collect()}
    assert got == {"q1": (5, 1), "q2": (4, 0)}
    for n, want in ((1, 1), (9, 1), (10, 1), (25, 2)):
        df = spark.createDataFrame([(str(i), "p") for i in range(n)], "query_id string, p_id string")
        a, b = M.split_by_query(df)
        assert b.count() == want and a.count() == n - want
    with pytest.raises(ValueError):
        M.require_trainable(M.label(feats, pos.limit(0)))


def test_catalog_and_dedup(spark):
    df = spark.createDataFrame([(0, "1.0", "A", None, "x"), (1, "2", "a", None, "x"), (2, "2", "b", "c", "y,z")], "ord bigint, p_id string, title string, brand string, attributes string")
    clean = C.clean_products(df)
    rows = clean.orderBy("ord").collect()
    assert [r.p_id for r in rows] == ["1", "2", "2"] and rows[0].text == "A x" and rows[0].brand_norm == "" and rows[2].attributes_list == ["y", "z"]
    assert C.clean_products(df, C.Preparation(null_text="nan")).where("ord = 0").first().brand_norm == "nan"
    first, stats = C.remove_exact_duplicates(clean)
    assert {r.ord for r in first.collect()} == {0, 2} and stats.first().asDict() == {"n_original": 3, "n_after": 2, "n_removed": 1}
    with pytest.raises(ValueError):
        C.clean_products(df.drop("p_id"))


def greedy(preds, sample):
    """Row-by-row alignment, as a check of the set-based one."""
    import unicodedata

    def keys(q):
        a = unicodedata.normalize("NFC", q).strip()
        b = a.replace("‌", "")
        return [("exact", a), ("no_zwnj", b), ("casefold", a.casefold()), ("casefold_no_zwnj", b.casefold())]

    used, out = set(), []
    for s, q in sample:
        row = (s, None, None)
        for name, key in keys(q):
            at = [i for i, p in preds if dict(keys(p))[name] == key]
            if at:
                row = (s, name, next((i for i in at if i not in used), at[0]))
                used.add(row[2])
                break
        out.append(row)
    return out


def test_align_matches_greedy(spark):
    r = random.Random(3)
    words = ["Red", "red", "re‌d", "RED", "blue", "Blue", "gr‌een", "green", "Straße", "STRASSE", "none"]
    preds = [(i, r.choice(words[:-1])) for i in range(14)]
    sample = [(i, r.choice(words)) for i in range(30)]
    p = spark.createDataFrame([(i, q, *[str(i)] * 10) for i, q in preds], "ord bigint, query string, " + ", ".join(f"{n} string" for n in Q.PIDS))
    s = spark.createDataFrame(sample, "ord bigint, query string")
    got = sorted((x.ord, x.strategy, x.pred_ord) for x in Q.align(p, s).collect())
    assert got == greedy(preds, sample)
    report = Q.alignment_report(Q.align(p, s), len(preds)).collect()
    assert report[0].line == "aligned\t30 rows\t14 predictions" and sum(r.line.startswith("row\t") for r in report) == 30
    assert sum(int(r.line.split("\t")[1]) for r in report if r.line.startswith("by ")) == 30


def test_submission_checks(spark):
    cols = "ord bigint, query string, " + ", ".join(f"{n} string" for n in Q.PIDS)
    good = spark.createDataFrame([(0, "a", *map(str, range(10))), (1, "b", *map(str, range(10)))], cols)
    assert Q.format_check(good, good).count() == 0
    bad = spark.createDataFrame([(0, "b‌", "1", "1", "", " 2", "x", *map(str, range(3, 8)))], cols)
    issues = {r.issue for r in Q.format_check(bad, good).collect()}
    assert {"row count differs", "invisible characters in queries", "order differs", "queries not in sample", "sample queries missing", "product cells"} == issues
    row = Q.row_problems(bad).first()
    assert (row.empty_pids, row.padded_pids, row.repeated_pids, row.non_digit_pids) == ([3], [4], ["1"], [5])
    few = spark.createDataFrame([(0, "a", "7", *[""] * 9)], cols)
    filled = Q.fill_with_popular(few, good.select("ord", "query")).orderBy("ord").collect()
    assert filled[1].pid1 == "7" and filled[1].pid2 == ""
    missing = spark.createDataFrame([(0, "red phnoe")], "ord bigint, query string")
    cands = spark.createDataFrame([(0, "red phone"), (1, "zzzzzzzzz"), (2, "red phones")], "ord bigint, query string")
    assert [r.candidate for r in Q.fuzzy_suggestions(missing, cands).orderBy("rank").collect()] == ["red phone", "red phones"]


def test_sources(spark, tmp_path):
    f = tmp_path / "x.csv"
    f.write_bytes("﻿ p_id ,title\n1,\n2,\"\"\n3,NA\n4,\"a \"\"b\"\"\nc\"\n".encode())
    assert S.detect_bom(spark, str(f)) == ["utf-8-sig"] and S.detect_encoding(spark, str(f)) == "utf-8" and S.sniff_delimiter(spark, str(f)) == ","
    strict = S.read_csv(spark, str(f), ordered=True)
    assert strict.columns == ["p_id", "title", "ord"]
    assert [(r.ord, r.p_id, r.title) for r in strict.orderBy("ord").collect()] == [(0, "1", None), (1, "2", None), (2, "3", "NA"), (3, "4", 'a "b"\nc')]
    assert [r.title for r in S.read_csv(spark, str(f), "default").orderBy("p_id").collect()] == [None, None, None, 'a "b"\nc']
    assert [r.title for r in S.read_csv(spark, str(f), "empty").orderBy("p_id").collect()][:2] == ["", ""]
    S.write_csv(strict, str(tmp_path / "out"))
    assert S.read_csv(spark, str(tmp_path / "out"), "strict").count() == 4
    g = tmp_path / "w.csv"
    g.write_bytes("query;x\nسلام دنیا;1\n".encode("cp1256", "replace"))
    assert S.detect_encoding(spark, str(g)) == "windows-1256" and S.sniff_delimiter(spark, str(g), "cp1256") == ";"
    built = S.cached_or_built(spark, str(tmp_path / "t"), lambda: spark.range(3))
    assert built.count() == 3 and S.cached_or_built(spark, str(tmp_path / "t"), lambda: 1 / 0).count() == 3
    with pytest.raises(FileNotFoundError):
        S.require_files(spark, [str(tmp_path / "no")])
    with pytest.raises(ValueError):
        S.load_train_pairs(strict)


def test_flows(spark, tmp_path):
    r = random.Random(1)
    nouns, brands = ["phone", "case", "shoe", "charger", "cable", "lamp"], ["acme", "orbit", "zed"]
    rows = [(f"{i}.0", f"{r.choice(brands)} {r.choice(nouns)} m{10 + i}", r.choice(nouns), r.choice(brands), "color: red, size: L") for i in range(60)]
    pick = [rows[r.randrange(60)] for _ in range(40)]
    write = lambda name, head, body: (tmp_path / name).write_text(head + "\n" + "\n".join(",".join(f'"{x}"' for x in b) for b in body) + "\n", encoding="utf-8")
    write("products.csv", "p_id,title,category,brand,attributes", rows)
    write("pairs.csv", "query,p_id", [(" ".join(x[1].split()[:2]), x[0]) for x in pick])
    write("queries.csv", "query_id,query", [(str(i), x[1]) for i, x in enumerate(rows[:8])])
    paths = P.Paths(*(str(tmp_path / n) for n in ("products.csv", "pairs.csv", "queries.csv", "out")))
    assert P.preprocess(spark, paths)["products_clean_full"].count() == 60
    model, metrics = P.train(spark, paths, k=20)
    assert 0 <= metrics.first().p10 <= 0.1 * 10 and not math.isnan(metrics.first().ndcg10)
    wide = P.serve(spark, paths, k=20)
    assert [x.query for x in wide.orderBy("ord").collect()] == [x[1] for x in rows[:8]]
    assert wide.where("pid10 = ''").count() == 0
    assert P.analyse(spark, paths).first().products_summary.n_products == 60
    done = P.check_submission(spark, wide, wide.select("ord", F.upper("query").alias("query")), paths)
    assert done.count() == 8 and done.where("pid1 = ''").count() == 0
    assert S.read_csv(spark, paths.table("predictions_top10_csv")).columns == ["query", *Q.PIDS]


def test_set_b_shape(spark, products, queries):
    p = products.withColumns({"title": F.col("text_norm"), "brand": F.lit("Red"), "category": F.lit("phone"), "attributes_norm": F.lit("case"), "title_norm": F.col("text_norm")})
    got = X.features_for_queries(queries, p)
    assert got.columns == ["query_id", "p_id", "rank", *X.SET_B]
    row = got.where("query_id = 'phone case' and p_id = 'p1'").first()
    assert (row.category_match, row.brand_match, row.token_overlap, row.attr_overlap, row.title_contains_query) == (1, 0, 2, 1, 1)


def test_normalisation_works_on_streams(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("1", "Straße ۱")], "p_id string, title string").write.parquet(str(src))
    stream = spark.readStream.schema("p_id string, title string").parquet(str(src))
    q = C.clean_products(stream).select("p_id", "title_norm").writeStream.format("memory").queryName("clean_stream").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("clean_stream").first().title_norm == "strasse 1"


def test_align_of_one_large_group(spark):
    """4,000 predictions and rows of one text; before, each row walked all of them and all taken ones."""
    p = spark.range(4000).selectExpr("id as ord", "if(id % 2 = 0, 'Red', 'red') as query", *[f"'1' as {n}" for n in Q.PIDS])
    s = spark.range(4000).selectExpr("id as ord", "if(id % 3 = 0, 'RED', 'red') as query")
    free, want = {"exact": list(range(1, 4000, 2)), "casefold": list(range(4000))}, []
    used = set()
    for i in range(4000):
        name = "casefold" if i % 3 == 0 else "exact"
        pick = next((x for x in free[name] if x not in used), free[name][0])
        used.add(pick)
        want.append((i, name, pick))
    assert sorted((r.ord, r.strategy, r.pred_ord) for r in Q.align(p, s).collect()) == want


def test_head_bytes_reads_the_head_only(spark, tmp_path):
    d = tmp_path / "d"
    d.mkdir()
    (d / "_meta").write_bytes(b"no")
    (d / "a").write_bytes(b"abc" * 5000)
    (d / "b").write_bytes(b"x")
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    assert S.head_bytes(spark, str(d), 7) == b"abcabca" and S.head_bytes(spark, str(d / "b")) == b"x" and S.head_bytes(spark, str(tmp_path / "none")) == b""
    assert len(tracker.getJobIdsForGroup(None)) == before
