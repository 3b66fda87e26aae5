"""Scalar fixtures: normaliser, tokens, numbers, keys."""

import difflib
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkshelf.functions import arrays as A
from sparkshelf.functions import text as T

NORM = [
    (None, ""),
    ("كتاب عربي", "کتاب عربی"),
    ("آینه أحمد إسم", "اینه احمد اسم"),
    ("مؤمن مسئول جزء", "مومن مسیول جز"),
    ("کـتـاب", "کتاب"),
    ("کِتابٌ", "کتاب"),
    ("می‌خواهم", "میخواهم"),
    ("Redmi-12 (۲۰۲۳)", "redmi 12 2023"),
    ("a_b، c", "a_b، c"),
    ("Straße", "strasse"),
    ("é", "é"),
    ("\t a   b \n", "a b"),
]


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


def test_normalize(spark):
    assert column(spark, [a for a, _ in NORM], lambda c: T.normalize(c, T.Normalizer(map_digits=True))) == [b for _, b in NORM]
    out = [b for _, b in NORM]
    assert column(spark, out, lambda c: T.normalize(c)) == out  # idempotent


def test_normalize_options(spark):
    assert column(spark, ["a-b.c"], lambda c: T.normalize(c, T.Normalizer(keep_punct="-"))) == ["a-b c"]
    assert column(spark, ["a-b"], lambda c: T.normalize(c, T.Normalizer(remove_punct=False))) == ["a-b"]
    assert column(spark, ["كی"], lambda c: T.normalize(c, T.Normalizer(map_chars=False))) == ["كی"]
    assert column(spark, ["می‌خواهم ۱۲"], lambda c: T.normalize_text(c)) == ["میخواهم 12"]
    assert column(spark, ["كِ‌ي A"], T.normalize_legacy) == ["ک ی a"]


def test_casefold_and_nfc_match_unicode(spark):
    chars = [chr(i) for i in [*range(32, 0x3000), *range(0xAB00, 0xAC00), *range(0xF900, 0xFFFE)] if unicodedata.category(chr(i)) not in ("Cn", "Cs")]
    values = [f"x{c}y{c}" for c in chars]
    assert column(spark, values, T.casefold) == [v.casefold() for v in values]
    assert column(spark, values, T.nfc) == [unicodedata.normalize("NFC", v) for v in values]


def test_tokenizers(spark):
    texts = ["Hello, می‌خواهم a_b x", "", "a bb  ccc\td", "iPhone12 پرو"]
    assert column(spark, texts, T.tokens) == [re.findall(r"[\w؀-ۿ]+", t) for t in texts]
    assert column(spark, texts, T.tokens_split) == [t.lower().split() for t in texts]
    assert column(spark, texts, T.tokens_vectorizer) == [re.findall(r"\b\w\w+\b", t.lower()) for t in texts]
    assert column(spark, ["aa bb cc", "aa", ""], lambda c: T.ngrams(T.tokens_vectorizer(c))) == [["aa", "bb", "cc", "aa bb", "bb cc"], ["aa"], []]


def test_model_and_numeric_tokens(spark):
    rows = {"galaxy a35 note9 iphone12 a-35": ["a35", "hone12", "a-35"], "iphone 12": ["hone12"], "m33g": ["m33"], "galaxy note 10": ["note10"], "2018a750": ["2018a", "750"]}
    assert column(spark, list(rows), T.model_tokens) == list(rows.values())
    assert column(spark, ["a35 12 ۲۰"], lambda c: T.numeric_tokens(T.tokens(c))) == [["12", "۲۰"]]
    assert column(spark, ["a35 12 bc"], lambda c: T.model_tokens_loose(T.tokens(c))) == [["a35"]]
    assert column(spark, ["a35b35"], T.digit_runs) == [["35", "35"]]
    assert column(spark, ["a3²53"], T.digit_chars) == [["3", "²", "5"]]


def test_numbers_and_ids(spark):
    numbers = {"1,234.5": 1234.5, "0,5": 5.0, "1,2345": 1.2345, "۱۲٫۵x": 125.0, "nan": 0.0, "1e-05": 0.00001, None: 0.0, "": 0.0}
    assert column(spark, list(numbers), T.parse_number) == list(numbers.values())
    assert column(spark, [" 123.0 ", "12.05", "10", None], T.canonical_id) == ["123", "12.05", "10", ""]
    assert column(spark, ["۱", "2", "x", None], T.parse_number_audit) == [1.0, 2.0, None, None]


def test_attributes_and_sets(spark):
    assert column(spark, ["رنگ: آبی، سایز: L,جنس؛نخ;x\n", None], A.split_attributes) == [["رنگ: آبی", "سایز: L", "جنس", "نخ;x"], []]
    pair = lambda a, b, f: spark.range(1).select(f(F.array(*map(F.lit, a)).cast("array<string>"), F.array(*map(F.lit, b)).cast("array<string>"))).first()[0]
    assert pair(["a", "b", "b"], ["b", "c"], A.jaccard) == pytest.approx(1 / 3)
    assert pair([], [], A.jaccard) == 0
    assert pair(["1", "1", "2"], ["1"], A.share_present) == pytest.approx(2 / 3)


def test_fuzzy_ratio(spark):
    pairs = [("red phone", "red phone case"), ("phone case", "case phone"), ("", "x"), (None, "x"), ("a" * 300, "b" * 150 + "a" * 150)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = [r.x for r in df.select("i", T.fuzzy_ratio("a", "b").alias("x")).orderBy("i").collect()]
    assert got == [difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0 for a, b in pairs]
    assert got[0] == pytest.approx(0.782609, abs=1e-6) and got[1] == 0.5


def test_keys_and_invisible(spark):
    df = spark.createDataFrame([(" Ab‌C ",)], "q string")
    assert df.select(*[x.alias(n) for n, x in T.match_keys("q").items()]).first().asDict() == {"exact": "Ab‌C", "no_zwnj": "AbC", "casefold": "ab‌c", "casefold_no_zwnj": "abc"}
    assert column(spark, ["a‌b\x07", "ab", None], T.has_invisible) == [True, False, False]
    assert [(x["pos"], x["code"]) for x in column(spark, ["a‌b\x07"], T.invisible_positions)[0]] == [(1, "0x200c"), (3, "0x7")]


def test_stem_hook(spark):
    assert column(spark, ["running dogs"], lambda c: T.stem(T.tokens(c), lambda w: w.rstrip("s"))) == [["running", "dog"]]
    with pytest.raises(ImportError):
        T.stem(F.lit(None), None)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_categories=("Cs", "Cn")), max_size=20), min_size=20, max_size=40))
def test_normalize_is_stable(spark, texts):
    once = column(spark, texts, T.normalize)
    assert all(x == x.strip() and "  " not in x for x in once)


def test_far_and_near_texts_fold_alike(spark):
    """Texts with a character from U+0300 on take the long way; both ways fold, map and collapse as the rules say."""
    rows = ["Straße 1", "Straße ۱", "ΟΔΟΣ ß ﬁ", "Ǆ µ ſ ŉ ǰ İ", "a\u0301-B،c\u200cd", "x!!  ?y", "کِتابٌ عربي ٣", "", None, " \t\n", "e\u0301É"]
    got = [r.n for r in spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").orderBy("i").select(T.normalize_text("t").alias("n")).collect()]

    def brute(t):
        t = (t or "").translate(str.maketrans(T.PERSIAN_DIGITS + T.ARABIC_DIGITS, "0123456789" * 2))
        t = unicodedata.normalize("NFC", t)
        t = t.translate(str.maketrans("آأإىيئكؤ", "اااییی" + "کو", "ءـ"))
        t = re.sub("[\u0610-\u061a\u064b-\u065f\u06d6-\u06ed\u08d4-\u08e1\u200c\u200d]", "", t)
        t = re.sub(r"[^\w\s\u0600-\u06ff]", " ", t).casefold()
        return " ".join(t.split())

    assert got == [brute(t) for t in rows]
