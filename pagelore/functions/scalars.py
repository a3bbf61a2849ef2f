"""Scalar functions over text, numbers, cells and geometry as column expressions.

Everything here is built from JVM expressions except Unicode normalisation and
sequence similarity, which Spark lacks; those are Arrow functions. Null in gives
null out throughout.
"""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def collapse(text: Column) -> Column:
    """White space runs to one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def squeeze(text: Column) -> Column:
    """Lower case with every run of other than ASCII letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^0-9a-z]+", " "))


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: unicodedata.normalize("NFC", s), na_action="ignore")


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")


@F.pandas_udf(T.StringType())
def casefold(text: pd.Series) -> pd.Series:
    return text.map(str.casefold, na_action="ignore")


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks similarity of two strings (2 M / T), null if either is null."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def scripts(text: Column) -> Column:
    """The scripts that occur in a text, sorted."""
    names = (("arabic", "IsArabic"), ("cyrillic", "IsCyrillic"), ("greek", "IsGreek"), ("han", "IsHan"), ("hiragana", "IsHiragana"), ("katakana", "IsKatakana"), ("latin", "IsLatin"))
    return F.array_compact(F.array(*[F.when(text.rlike(rf"\p{{{block}}}"), name) for name, block in names]))


def has_unsafe_characters(text: Column) -> Column:
    """Control, format, private or unassigned characters other than tab and line ends."""
    return F.regexp_replace(text, r"[\t\r\n]", "").rlike(r"[\p{Cc}\p{Cf}\p{Co}\p{Cn}]")


def escape_markdown(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\`*_\[\]<>|])", r"\\$1")


def escape_html(text: Column) -> Column:
    out = text
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


def number(text: Column) -> Column:
    """A printed number: thousands separators, a currency sign, percent or parentheses for negatives."""
    body = F.regexp_replace(F.trim(text), r"(?i)^(?:us)?[$€£¥]|^chf\s*|,|\s*(?:%|per cent)$", "")
    negative = body.rlike(r"^\(.*\)$")
    value = F.regexp_replace(body, r"^\((.*)\)$", "$1").try_cast("double")
    return F.when(negative, -value).otherwise(value)


def marker(text: Column) -> Column:
    """struct(style, ordinal) of a list or outline marker at the start, null without one."""
    decimal, alpha = F.regexp_extract(text, r"^\s*\(?(\d{1,3})[.)]\s", 1), F.regexp_extract(text, r"^\s*\(?([a-zA-Z])[.)]\s", 1)
    return (
        F.when(text.rlike(r"^\s*[•*–·-]\s"), F.struct(F.lit("bullet").alias("style"), F.lit(None).cast("int").alias("ordinal")))
        .when(decimal != "", F.struct(F.lit("decimal").alias("style"), decimal.cast("int").alias("ordinal")))
        .when(alpha != "", F.struct(F.lit("alpha").alias("style"), (F.ascii(F.lower(alpha)) - 96).cast("int").alias("ordinal")))
    )


def column_index(label: Column) -> Column:
    """1-based index of a column label of any length (A = 1, AA = 27); null beyond a bigint."""
    letters = F.filter(F.split(F.upper(label), ""), lambda c: c != "")
    return F.when(label.rlike("^[A-Za-z]+$"), F.aggregate(letters, F.lit(0).cast("bigint"), lambda a, c: F.try_add(F.try_multiply(a, F.lit(26).cast("bigint")), (F.ascii(c) - 64).cast("bigint"))))


def column_label(index: Column) -> Column:
    """The label of a 1-based column index of any size; null below 1."""
    start = F.struct(index.cast("bigint").alias("n"), F.lit("").alias("label"))

    def prepend(a: Column, _: Column) -> Column:
        last = F.pmod(a["n"] - 1, F.lit(26))
        whole = F.call_function("div", a["n"] - 1, F.lit(26).cast("bigint"))
        return F.when(a["n"] > 0, F.struct(whole.alias("n"), F.concat(F.char(last + 65), a["label"]).alias("label"))).otherwise(a)

    # a bigint has fourteen letters at most
    return F.when(index > 0, F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, prepend)["label"])


def excel_date(serial: Column, base_1904: Column | None = None) -> Column:
    """ISO text of a serial date. Serial 60 of the 1900 system is the day that never was."""
    old = F.coalesce(base_1904, F.lit(False)) if base_1904 is not None else F.lit(False)
    days = F.floor(serial).cast("int")
    seconds = F.round((serial - F.floor(serial)) * 86400).cast("bigint")
    shifted = F.when(old, F.date_add(F.lit("1904-01-01").cast("date"), days)).when(days > 60, F.date_add(F.lit("1899-12-31").cast("date"), days - 1)).otherwise(F.date_add(F.lit("1899-12-31").cast("date"), days))
    day = F.when(~old & (days == 60), F.lit("1900-02-29")).otherwise(F.date_format(shifted, "yyyy-MM-dd"))
    clock = F.concat(F.lpad((F.floor(seconds / 3600)).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.floor(seconds / 60) % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((seconds % 60).cast("string"), 2, "0"))
    return F.when(serial >= 0, F.when(seconds == 0, day).otherwise(F.concat(day, F.lit("T"), clock)))


def join_split_hex(text: Column) -> Column:
    """Fragments of a digest after its label put together: SHA-256 (64), SHA-1 (40), MD5 (32)."""
    out = text
    for label, length in (("SHA-?256", 64), ("SHA-?1", 40), ("MD5", 32)):
        found = F.regexp_extract(out, rf"(?i)\b{label}:?\s+((?:[A-F0-9]{{2,}}\s+)+[A-F0-9]{{2,}})\b", 1)
        joined = F.regexp_replace(found, r"\s+", "")
        fits = (found != "") & (F.length(joined) == length) & joined.rlike("[A-F]") & (F.length(found) <= 128)
        out = F.when(fits, F.replace(out, found, joined)).otherwise(out)
    return out


def stable_id(*parts: Column) -> Column:
    """A content hash that depends on neither order of arrival nor time."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]), 256), 1, 24)


def safe_url(url: Column) -> Column:
    """The URL if it is http or https with a host, else null."""
    return F.when(url.rlike(r"(?i)^https?://[^\s/?#@]+(?:[/?#]\S*)?$"), url)


def affine(matrix: Column, x: Column, y: Column) -> Column:
    """Point (x, y) under a 6-number matrix [a, b, c, d, e, f]."""
    m = lambda i: F.get(matrix, F.lit(i))
    return F.struct((m(0) * x + m(2) * y + m(4)).alias("x"), (m(1) * x + m(3) * y + m(5)).alias("y"))


def compose(outer: Column, inner: Column) -> Column:
    """The matrix that applies `inner`, then `outer`."""
    o, i = (lambda k: F.get(outer, F.lit(k))), (lambda k: F.get(inner, F.lit(k)))
    return F.array(o(0) * i(0) + o(2) * i(1), o(1) * i(0) + o(3) * i(1), o(0) * i(2) + o(2) * i(3), o(1) * i(2) + o(3) * i(3), o(0) * i(4) + o(2) * i(5) + o(4), o(1) * i(4) + o(3) * i(5) + o(5))
