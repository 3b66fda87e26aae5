"""Text scalars as Column expressions: normalisation, tokens, numbers, match keys.

Everything stays in the JVM but the normaliser, which one pass in Python does several times
faster than a chain of expressions, NFC composition (sent to Python only for texts that may
need it, others pass as null) and the difflib ratio. Character classes are explicit, as Java's \\w and \\d are
ASCII-only: letters, numbers and the underscore make words.
"""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as st

WORD = r"\p{L}\p{N}_"
WHITE = r"\s\x1C-\x1F\x85\p{Z}"
ARABIC = r"\x{0600}-\x{06FF}"

# Fixed values of the normalisation rules: character map, removed marks, digits.
ALEF_FORMS, ALEF = "آأإ", "ا"
YEH_FORMS, YEH = "ىيئ", "ی"
KAF_FORMS, KAF = "ك", "ک"
WAW_FORMS, WAW = "ؤ", "و"
HAMZA, TATWEEL = "ء", "ـ"
ZERO_WIDTH = "‌‍"
DIACRITICS = r"[\x{0610}-\x{061A}\x{064B}-\x{065F}\x{06D6}-\x{06ED}\x{08D4}-\x{08E1}]"
PERSIAN_DIGITS, ARABIC_DIGITS = "۰۱۲۳۴۵۶۷۸۹", "٠١٢٣٤٥٦٧٨٩"
ATTRIBUTE_SEPARATORS = r"[,،؛\n]"

NA_LITERALS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


@dataclass(frozen=True)
class Normalizer:
    """Options of `normalize`. `keep_punct`: characters that punctuation removal spares."""

    remove_punct: bool = True
    keep_punct: str = ""
    map_chars: bool = True
    map_digits: bool = False
    legacy: bool = False

    def __call__(self, col: Column) -> Column:
        return normalize(col, self)

    def but(self, **changes) -> Normalizer:
        return replace(self, **changes)


def c_(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def collapse(col) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(c_(col), f"[{WHITE}]+", " "), "^ | $", "")


def strip(col) -> Column:
    """Without white space at the ends (of any kind: `trim` knows U+0020 only)."""
    return F.regexp_replace(c_(col), f"^[{WHITE}]+|[{WHITE}]+$", "")


def delete(col: Column, chars: str) -> Column:
    return F.translate(col, chars, "")


def map_digits(col) -> Column:
    """Persian and Arabic digits to ASCII."""
    return F.translate(c_(col), PERSIAN_DIGITS + ARABIC_DIGITS, "0123456789" * 2)


def map_letters(col) -> Column:
    """Arabic letter forms to Persian ones; hamza and tatweel go."""
    source = ALEF_FORMS + YEH_FORMS + KAF_FORMS + WAW_FORMS
    target = ALEF * len(ALEF_FORMS) + YEH * len(YEH_FORMS) + KAF + WAW
    return F.translate(c_(col), source + HAMZA + TATWEEL, target)


def _compose(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(lambda x: x if x is None else unicodedata.normalize("NFC", x))


#: Marks, jamo and the blocks with canonical singletons: a text without them is composed already.
_MAY_COMPOSE = r"[\p{M}\x{0340}-\x{037E}\x{0387}\x{0958}-\x{0FFF}\x{1160}-\x{11FF}\x{1F70}-\x{1FFF}\x{2000}-\x{2001}\x{2126}-\x{212B}\x{2329}-\x{232A}\x{2ADC}\x{F900}-\x{FAFF}\x{FB1D}-\x{FB4E}\x{10000}-\x{10FFFF}]"


def nfc(col) -> Column:
    """Canonical composition; only texts that may change visit Python."""
    col = c_(col)
    compose = F.pandas_udf(_compose, st.StringType())
    return F.coalesce(compose(F.when(col.rlike(_MAY_COMPOSE), col)), col)


@lru_cache
def _folds() -> tuple[dict[str, str], dict[str, str]]:
    """Case folds that lower() doesn't give: to one character, and to several."""
    pairs = {chr(i): chr(i).casefold() for i in range(0x110000) if not 0xD800 <= i < 0xE000 and chr(i).casefold() != chr(i).lower()}
    single = {a: b for a, b in pairs.items() if len(b) == 1}
    return single, {a: b for a, b in pairs.items() if len(b) > 1}


def _ranges(chars, gap: int) -> str:
    """A character class of few ranges (long lists of single characters match slowly); ranges closer than `gap` are joined."""
    runs: list[list[int]] = []
    for x in sorted(map(ord, chars)):
        if runs and x - runs[-1][1] <= gap:
            runs[-1][1] = x
        else:
            runs.append([x, x])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs) + "]"


def casefold(col, probe: Column | None = None) -> Column:
    """Unicode case folding: lower(), with the folds that differ patched in where a text has such a character.

    `probe`: the text to look for these characters in, where col is costly to compute twice; what it may compose to counts.
    Folds to several characters are lower(upper(x)) but for the few of `odd_ones`."""
    col = c_(col)
    single, several = _folds()
    odd_ones = {a: b for a, b in several.items() if a.upper().lower() != b}
    x = F.translate(col, "".join(single), "".join(single.values()))
    for a, b in odd_ones.items():
        x = F.replace(x, F.lit(a), F.lit(b))
    many = _ranges([c for c in several if c not in odd_ones], 1)
    pieces = F.transform(F.split(x, f"(?={many})|(?<={many})"), lambda p: F.when(p.rlike(f"^{many}$"), F.upper(p)).otherwise(p))
    # What lower() turns away from its fold: final sigma, and letters that fold to upper case.
    back = {"ς": "σ"} | {b.lower(): b for b in single.values() if b.lower() != b}
    odd = (col if probe is None else probe).rlike(_ranges([*single, *several], 8) if probe is None else f"{_ranges([*single, *several], 8)}|{_MAY_COMPOSE}")
    return F.translate(F.lower(F.when(odd, F.array_join(pieces, "")).otherwise(col)), "".join(back), "".join(back.values()))


def keep_class(keep: str) -> str:
    return "".join("\\" + x if x in r"\[]^-&" else x for x in keep)


def drop_punctuation(col, keep: str = "") -> Column:
    """What is neither word, white space, nor in the Arabic block becomes a space."""
    return F.regexp_replace(c_(col), f"[^{WORD}{WHITE}{ARABIC}{keep_class(keep)}]", " ")


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body names it (the optimizer copies it otherwise)."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


_FAR = re.compile("[^\x00-\u02ff]").search
_MARKS = re.compile(DIACRITICS.replace("\\x{", "\\u").replace("}", "")).sub
_LETTERS_MAP = str.maketrans(ALEF_FORMS + YEH_FORMS + KAF_FORMS + WAW_FORMS, ALEF * len(ALEF_FORMS) + YEH * len(YEH_FORMS) + KAF + WAW, HAMZA + TATWEEL)
_DIGITS_MAP = str.maketrans(PERSIAN_DIGITS + ARABIC_DIGITS, "0123456789" * 2)
_GONE = str.maketrans("", "", TATWEEL + ZERO_WIDTH)


def normalizing(how: Normalizer, digits: bool = False) -> Callable[[str | None], str]:
    """`normalize` for one text: null is empty; NFC, letters, marks, zero-width, punctuation, case, white space, in this order.

    A text without a character from U+0300 on needs the last steps only (below that all is composed and nothing is Arabic);
    up to U+00FF a table of bytes does them."""
    keep = "".join(re.escape(x) for x in how.keep_punct if not x.isspace())
    parts = re.compile(f"[\\w\u0600-\u06ff{keep}]+" if how.remove_punct else r"\S+").findall
    folds = [chr(i).casefold() if parts(chr(i)) else " " for i in range(256)]
    near = [x if x <= "\xff" and len(x) == 1 else chr(i) for i, x in enumerate(folds)]
    table, others = "".join(near).encode("latin-1"), [(chr(i), x) for i, x in enumerate(folds) if x != near[i]]

    def one(x: str | None) -> str:
        if not x:
            return ""
        try:
            y = x.encode("latin-1").translate(table).decode("latin-1")
        except UnicodeEncodeError:
            return far(x)
        if not y.isascii():
            for a, b in others:
                y = y.replace(a, b)
        return " ".join(y.split())

    def far(x: str) -> str:
        if not x.isascii() and _FAR(x):
            x = unicodedata.normalize("NFC", x)
            if how.map_digits or digits:
                x = x.translate(_DIGITS_MAP)
            if how.map_chars:
                x = x.translate(_LETTERS_MAP)
            x = _MARKS("", x).translate(_GONE)
        return " ".join(parts(x)).casefold()  # no fold makes white space

    return one


def normalize(col, how: Normalizer = Normalizer(), digits: bool = False) -> Column:
    """The normaliser, in Arrow batches (`normalizing`). `digits`: digits are mapped, whatever the options say."""
    col = F.coalesce(c_(col), F.lit(""))
    if how.legacy:
        return normalize_legacy(map_digits(col) if digits else col, how)
    one = normalizing(how, digits)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(one)

    return F.pandas_udf(run, st.StringType())(col)


def normalize_legacy(col, how: Normalizer = Normalizer()) -> Column:
    """The older rules: yeh and kaf only, marks and zero-width characters become spaces, lower()."""
    col = F.translate(F.coalesce(c_(col), F.lit("")), "يك", "یک")
    col = F.regexp_replace(col, DIACRITICS, " ")
    col = F.regexp_replace(col, "[\\x{200C}\\x{200D}]", " ")
    if how.remove_punct:
        col = drop_punctuation(col, how.keep_punct)
    return collapse(F.lower(col))


def normalize_text(col, how: Normalizer = Normalizer(), digits: bool = True, strip_zwnj: bool = False, remove_punct: bool | None = None) -> Column:
    """`normalize` after the optional digit map and zero-width removal. An explicit `remove_punct` uses a default normaliser."""
    col = F.coalesce(c_(col), F.lit(""))
    if strip_zwnj:
        col = delete(col, "‌")
    return normalize(col, how if remove_punct is None else Normalizer(remove_punct=remove_punct), digits)


# Tokens


def tokens(col) -> Column:
    """Runs of word characters and of the Arabic block."""
    return F.regexp_extract_all(c_(col), F.lit(f"[{WORD}{ARABIC}]+"), 0)


def tokens_split(col) -> Column:
    """Lower-cased, split at white space."""
    return F.filter(F.split(F.lower(c_(col)), f"[{WHITE}]+"), lambda x: x != "")


def tokens_vectorizer(col) -> Column:
    """Lower-cased words of two characters or more."""
    return F.regexp_extract_all(F.lower(c_(col)), F.lit(f"[{WORD}]{{2,}}"), 0)


def ngrams(words: Column) -> Column:
    """Words and space-joined pairs of neighbours."""

    def both(w: Column) -> Column:
        less = F.greatest(F.size(w) - 1, F.lit(0))
        return F.concat(w, F.zip_with(F.slice(w, 1, less), F.slice(w, 2, less), lambda a, b: F.concat_ws(" ", a, b)))

    return let(words, both)


#: Model names: letters with two digits or more, digits with letters, or letters joined to digits by a mark.
MODEL = r"(?i)([A-Za-z]{1,4}[\s\-_/]?\p{Nd}{2,6}|\p{Nd}{2,6}[A-Za-z]{0,4}|[A-Za-z0-9]+[\-_/]\p{Nd}+)"


def model_tokens(col) -> Column:
    """Distinct model-like tokens in order, lower-cased, without white space, of two characters or more."""
    found = F.regexp_extract_all(c_(col), F.lit(MODEL), 1)
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.lower(F.regexp_replace(x, f"[{WHITE}]+", ""))), lambda x: F.length(x) >= 2))


def model_tokens_loose(words: Column) -> Column:
    """Tokens that hold a digit and a letter."""
    return F.filter(words, lambda x: x.rlike(r"\p{Nd}") & x.rlike(r"\p{L}"))


def numeric_tokens(words: Column) -> Column:
    return F.filter(words, lambda x: x.rlike(r"^\p{Nd}+$"))


def digit_runs(col) -> Column:
    return F.regexp_extract_all(c_(col), F.lit(r"\p{Nd}+"), 0)


@lru_cache
def _other_digits() -> str:
    """Characters that count as digits but aren't decimal: superscripts, circled digits and the like."""
    return "".join(f"\\x{{{i:X}}}" for i in range(0x110000) if chr(i).isdigit() and not chr(i).isdecimal())


def digit_chars(col) -> Column:
    """Distinct digit characters."""
    return F.array_distinct(F.regexp_extract_all(c_(col), F.lit(rf"[\p{{Nd}}{_other_digits()}]"), 0))


# Fuzzy matching


def ratio(a: str | None, b: str | None) -> float:
    """difflib's ratio of a and b, in this order; 0 where either is empty."""
    return difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def fuzzy_ratio(a, b) -> Column:
    """`ratio` of two columns, in Arrow batches."""
    return F.pandas_udf(_ratios, st.DoubleType())(c_(a), c_(b))


# Numbers


def parse_number(col) -> Column:
    """Number of a free-form text: digits mapped, thousands commas dropped, other commas as points, the rest stripped; 0 where none is left."""
    col = map_digits(strip(F.coalesce(c_(col).cast("string"), F.lit(""))))
    col = F.regexp_replace(col, r",(?=\d{1,3}(?:\D|$))", "")
    col = F.regexp_replace(col, ",", ".")
    col = F.regexp_replace(col, r"[^0-9eE+\-.]", "")
    number = F.when(col.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), col.try_cast("double"))
    return F.coalesce(number, F.lit(0.0))


def parse_number_audit(col) -> Column:
    """The stricter parse of the audit: only ۰ and ۱ mapped; null where the text is no number."""
    col = F.translate(c_(col).cast("string"), "۰۱", "01")
    return col.try_cast("double")


def coerce_number(col) -> Column:
    return F.coalesce(c_(col).try_cast("double"), F.lit(0.0))


# Ids, parts, keys


def canonical_id(col) -> Column:
    """Id as text, without white space around it and a trailing `.0`; null is empty."""
    return F.regexp_replace(strip(F.coalesce(c_(col).cast("string"), F.lit(""))), r"\.0$", "")


def concat_parts(*cols, keep_empty: bool = False) -> Column:
    """Parts that aren't null (nor, by default, empty), joined by a space."""
    return F.concat_ws(" ", *[c_(x) if keep_empty else F.when(c_(x) != "", c_(x)) for x in cols])


def truncate(col, n: int = 1024) -> Column:
    """The first n code points."""
    return F.substring(c_(col), 1, n)


def contains(text, part) -> Column:
    """Whether a part that isn't empty occurs in text."""
    return F.coalesce((F.length(c_(part)) > 0) & F.contains(c_(text), c_(part)), F.lit(False))


def same_first(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_element_at(a, F.lit(1)) == F.try_element_at(b, F.lit(1)), F.lit(False))


def match_keys(col) -> dict[str, Column]:
    """Keys by falling strictness: composed and stripped; without ZWNJ; case-folded; both."""
    exact = strip(nfc(F.coalesce(c_(col), F.lit(""))))
    bare = F.replace(exact, F.lit("‌"), F.lit(""))
    return {"exact": exact, "no_zwnj": bare, "casefold": casefold(exact), "casefold_no_zwnj": casefold(bare)}


INVISIBLE = r"[\p{Cc}\p{Cf}\p{Cs}\p{Co}]"


def has_invisible(col) -> Column:
    return F.coalesce(c_(col).rlike(INVISIBLE), F.lit(False))


def invisible_positions(col) -> Column:
    """array<struct<pos, char, code>> of invisible characters, positions from 0."""
    chars = F.transform(F.split(c_(col), ""), lambda x, i: F.struct(i.alias("pos"), x.alias("char"), F.concat(F.lit("0x"), F.lower(F.hex(F.ascii(x)))).alias("code")))
    return F.filter(chars, lambda x: x["char"].rlike(INVISIBLE))


def stem(words: Column, stemmer) -> Column:
    """Words through a pluggable stemmer (text to text); no stemmer is an ImportError, as none is bundled."""
    if stemmer is None:
        raise ImportError("stemming needs a stemmer: pass a callable from text to text")

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda xs: None if xs is None else [stemmer(x) for x in xs])

    return F.pandas_udf(run, st.ArrayType(st.StringType()))(words)
